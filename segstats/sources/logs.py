"""Review manifests, epoch logs and metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segstats.schemas import METRIC, REVIEW_MANIFEST

NUMBER = r"([+-]?[0-9.]+|nan)"


def read_review_manifest(spark: SparkSession, path: str) -> DataFrame:
    """CSV manifests under ``path/<run>/manifest.csv``; the run name comes from the folder."""
    rows = spark.read.csv(f"{path}/*/manifest.csv", schema=REVIEW_MANIFEST, header=True, quote='"', escape='"')
    folder = F.regexp_extract(F.input_file_name(), r"([^/]+)/manifest\.csv(?:/[^/]*)?$", 1)  # the file itself, or a folder that Spark wrote
    return rows.select(folder.alias("run"), *REVIEW_MANIFEST.fieldNames())


def write_review_manifest(pairs: DataFrame, path: str, run: str) -> None:
    """``path/<run>`` as one CSV file in the order of the pairs; a review set is small."""
    rows = pairs.select(*REVIEW_MANIFEST.fieldNames()).repartition(1).sortWithinPartitions("pair_id")
    rows.write.mode("overwrite").csv(f"{path}/{run}/manifest.csv", header=True, quote='"', escape='"')


def parse_epoch_log(lines: DataFrame, col: str = "value") -> DataFrame:
    """Numbers of every epoch line; real_iou and divergence are NULL where the line has none."""
    text = F.col(col)

    def number(name: str) -> Column:
        found = F.regexp_extract(text, rf"(?:^|\s){name}\s+{NUMBER}", 1)
        return F.when(found != "", F.when(found == "nan", F.lit(None)).otherwise(found)).cast("double")

    epoch = F.regexp_extract(text, r"^\s*Epoch (\d+): time (\d+)s", 1)
    seconds = F.regexp_extract(text, r"^\s*Epoch (\d+): time (\d+)s", 2)
    names = ["train_loss", "val_loss", "synth_iou", "ref_match_auc", "real_iou"]
    keep = [c for c in lines.columns if c != col]
    return lines.where(epoch != "").select(
        *keep, epoch.cast("bigint").alias("epoch"), seconds.cast("bigint").alias("seconds"), *[number(n).alias(n) for n in names],
        number("DIVERGENCE").alias("divergence"))


def read_epoch_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_epoch_log(spark.read.text(path))


def metrics_from_log(log: DataFrame, run: str) -> DataFrame:
    """Epoch log as the long metric table."""
    tags = ["train_loss", "val_loss", "synth_iou", "ref_match_auc", "real_iou", "divergence"]
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.col(t).alias("value")) for t in tags]))
    return log.select(F.lit(run).alias("run"), F.col("epoch").alias("step"), rows.alias("_m")).where(
        F.col("_m.value").isNotNull()).select("run", F.col("_m.tag").alias("tag"), "step", F.col("_m.value").alias("value"))


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append (run, tag, step, value) rows, one folder per run."""
    metrics.select(*METRIC.fieldNames()).write.mode("append").partitionBy("run").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC).parquet(path)
