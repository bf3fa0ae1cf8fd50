"""Splits and draws from hashes of seed and id: the same on any cluster and any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segstats.functions.scalar import hash_bits, hash_uniform, weighted_choice
from segstats.scale import attach, kth_smallest, row_numbers

JOB_STRIDE = 1_000_003  # fixed value: seed multiplier of the job table


def _first_k(df: DataFrame, ident: str, seed: int, k: Column) -> Column:
    """The row is among the first k in hash order (a column for a table that has ``_h``)."""
    last = kth_smallest(df.select(hash_bits(seed, ident).alias("_h"), ident), "_h", ident, k)
    return F.coalesce(F.struct(F.col("_h").alias("h"), F.col(ident).alias("id")) <= last, F.lit(False))


def split(df: DataFrame, ident: str, frac: float = 0.9, seed: int = 42) -> DataFrame:
    """Adds ``split``: train for the first floor(n * frac) records in hash order, val for the rest.

    Only the cut value is searched for; rows are compared with it where they are.
    """
    k = F.floor(F.col("n_rows") * F.lit(frac))
    hashed = df.withColumn("_h", hash_bits(seed, ident))
    return hashed.withColumn("split", F.when(_first_k(df, ident, seed, k), "train").otherwise("val")).drop("_h")


def holdout_k(df: DataFrame, ident: str, k: int, seed: int = 42) -> DataFrame:
    """Adds ``split``: exactly k test records, the rest train."""
    hashed = df.withColumn("_h", hash_bits(seed, ident))
    few = F.least(F.lit(k), F.col("n_rows"))
    return hashed.withColumn("split", F.when(_first_k(df, ident, seed, few), "test").otherwise("train")).drop("_h")


def validation_head(df: DataFrame, ident: str, n: int, frac: float = 0.9, seed: int = 42) -> DataFrame:
    """First n records of the validation part, in hash order."""
    val = split(df, ident, frac, seed).where(F.col("split") == "val").withColumn("_h", hash_bits(seed, ident))
    return val.orderBy("_h", ident).limit(n).drop("_h")


def epoch_order(df: DataFrame, ident: str, epoch: int, seed: int = 42) -> DataFrame:
    """Adds ``position``: a new record order for each epoch."""
    hashed = df.withColumn("_h", hash_bits(seed, F.lit(epoch), ident))
    return row_numbers(hashed, ["_h", ident], out="position").drop("_h")


def job_seeds(jobs: DataFrame, ident: str, seed: int) -> DataFrame:
    """Adds ``job_seed``, which depends on the seed and the job number only."""
    return jobs.withColumn("job_seed", F.lit(seed * JOB_STRIDE) + F.col(ident))


def job_table(spark: SparkSession, start: int, n: int, seed: int) -> DataFrame:
    """(job_id, job_seed) for n jobs."""
    return job_seeds(spark.range(start, start + n).withColumnRenamed("id", "job_id"), "job_id", seed)


def draw_modes(df: DataFrame, ident: str, weights: dict[str, float], seed: int = 42) -> DataFrame:
    """Adds ``drawn_mode``, a weighted categorical draw per id."""
    return df.withColumn("drawn_mode", weighted_choice(hash_uniform(seed, ident), weights))


def sample_k_per_group(df: DataFrame, by: Sequence[str], ident: str, k: int, seed: int = 42) -> DataFrame:
    """k rows of every group without replacement (all of a smaller group)."""
    hashed = df.withColumn("_h", hash_bits(seed, ident))
    return row_numbers(hashed, ["_h", ident], by, "_rn").where(F.col("_rn") <= k).drop("_h", "_rn")


def reference_targets(annotations: DataFrame, seed: int = 42, image: str = "image_id", ident: str = "gt_idx",
                      category: str = "category_name") -> DataFrame:
    """Per image one category (uniform over distinct ones), one reference instance of it, and a label for every instance.

    A minimum over hashes picks uniformly: over (image, category) for the
    category, over instances for the reference.
    """
    per_category = annotations.groupBy(image, category).agg(
        F.min(F.struct(hash_bits(seed, image, ident).alias("h"), F.col(ident).alias("i"))).alias("_instance"))
    drawn = per_category.groupBy(image).agg(F.min(F.struct(
        hash_bits(seed + 1, image, category).alias("h"), F.col(category).alias("c"), F.col("_instance.i").alias("i"))).alias("_t"))
    targets = drawn.select(image, F.col("_t.c").alias("target_category"), F.col("_t.i").alias("reference_idx"))
    labelled = attach(annotations, targets, [image], [ident], how="inner")
    return labelled.withColumns({"ref_match": F.when(F.col(category) == F.col("target_category"), F.lit(1.0)).otherwise(F.lit(0.0)),
                                 "is_reference": F.col(ident) == F.col("reference_idx")})


def select_records(df: DataFrame, ident: str, indices: Sequence[int] | DataFrame) -> DataFrame:
    """Records of an explicit index list of any length, or of a table whose first column holds the indices."""
    if not isinstance(indices, DataFrame):
        indices = df.sparkSession.createDataFrame([(i,) for i in indices], df.select(ident).schema)
    wanted = indices.select(F.col(indices.columns[0]).alias("_wanted")).distinct()
    return df.join(wanted, df[ident] == wanted["_wanted"], "left_semi")
