"""Metric roll-up and arriving annotation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from segstats.scale import forget, settle
from segstats.schemas import ANNOTATION_FILE
from segstats.sources.records import parse_annotation_list


def metric_rollup(metrics: DataFrame, window: str = "1 day", watermark: str = "1 hour", ts: str = "ts", tag: str = "tag",
                  value: str = "value") -> DataFrame:
    """Count, mean, min and max of each tag in tumbling windows; the same code for a table and a stream.

    On a stream, rows later than the watermark are dropped and a window is
    emitted once it is closed (append mode).
    """
    rows = metrics.withWatermark(ts, watermark) if metrics.isStreaming else metrics
    rolled = rows.groupBy(F.window(ts, window).alias("_w"), F.col(tag).alias("tag")).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return rolled.select(F.col("_w.start").alias("window_start"), "tag", "n", "mean", "min", "max")


def read_annotation_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Annotation documents (one JSON per line) as their files arrive, with the text of rows that are broken in any part."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    whole = T.StructType([*[f for f in ANNOTATION_FILE.fields if f.name != "annotations"], T.StructField("annotations", T.ArrayType(T.StringType())), T.StructField("_corrupt", T.StringType())])
    doc = F.from_json(F.col("value"), whole, {"columnNameOfCorruptRecord": "_corrupt"})
    parsed = lines.select("value", doc.alias("_d"), F.current_timestamp().alias("arrived"))
    parsed = parsed.withColumn("_a", parse_annotation_list(F.col("_d.annotations")))
    broken = F.col("_d").isNull() | F.col("_d._corrupt").isNotNull() | F.col("_d.image.file_name").isNull() | F.coalesce(F.size("_a.bad") > 0, F.lit(False))
    # A document goes on either as text or parsed, never as both.
    parsed = parsed.withColumn("_broken", broken)
    broken = F.col("_broken")
    return parsed.select(F.when(broken, F.col("value")).alias("value"), "arrived", "_d.image.file_name", "_d.image.width", "_d.image.height", "_d.mode", F.when(~broken, F.col("_a.good")).alias("annotations"), broken.alias("bad"))


def ingest_annotations_stream(spark: SparkSession, path: str, out: str, checkpoint: str, watermark: str = "1 day") -> StreamingQuery:
    """Write good documents to ``out/records`` and the rest to ``out/rejected``, once per file name within the watermark.

    Runs over what has arrived and stops; a repeated batch rewrites its own folder, so a restart adds nothing twice.
    """
    # The names seen so far grow with the documents; they belong on disk, not on the heap.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    docs = read_annotation_stream(spark, path).withWatermark("arrived", watermark)
    key = F.when(F.col("bad"), F.sha2("value", 256)).otherwise(F.col("file_name"))
    unique = docs.withColumn("doc_key", key).dropDuplicatesWithinWatermark(["doc_key"]).drop("doc_key", "arrived")

    def save(batch: DataFrame, number: int) -> None:
        held = settle(batch)  # one run of the state for both writes; a block of the cache would take three times the room
        good = held.where(~F.col("bad")).select("file_name", "width", "height", "mode", "annotations")
        good.write.mode("overwrite").parquet(f"{out}/records/batch={number}")
        held.where("bad").select("value").write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")
        forget(held)

    return (unique.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start())
