"""Ranks, running values, batches, top lists and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.scale import ROWS_PER_CHUNK, attach, row_numbers, running, with_chunks


def avg_rank(df: DataFrame, score: str, ids: Sequence[str], rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Ascending rank with ties averaged, found once per distinct score and looked up by every row."""
    counts = with_chunks(df.groupBy(score).agg(F.count(F.lit(1)).alias("_n")), [score], rows_per_chunk)
    upto = running(counts, [], [score], {"_upto": ("sum", "_n")}, rows_per_chunk=rows_per_chunk)
    ranks = upto.select(score, (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias("avg_rank"))
    return attach(df, ranks, [score], ids, how="inner")


def running_best(metrics: DataFrame, by: Sequence[str] = ("run",), order: str = "epoch", value: str = "value",
                 rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """``is_best``: the value beats every earlier one of its run, and 0."""
    chunked = with_chunks(metrics, [order], rows_per_chunk, by)
    before = running(chunked, by, [order], {"_before": ("max", value)}, through=False, rows_per_chunk=rows_per_chunk)
    beats = F.col(value) > F.greatest(F.coalesce("_before", F.lit(0.0)), F.lit(0.0))
    return before.withColumn("is_best", F.coalesce(beats, F.lit(False))).drop("_before", "_chunk")


def moving_mean(metrics: DataFrame, by: Sequence[str] = ("run", "epoch"), order: str = "step", value: str = "value",
                rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Mean of all values of a group up to each step."""
    counted = with_chunks(metrics.withColumn("_one", F.lit(1)), [order], rows_per_chunk, by)
    sums = running(counted, by, [order], {"_s": ("sum", value), "_n": ("sum", "_one")}, rows_per_chunk=rows_per_chunk)
    return sums.withColumn("running_mean", F.col("_s") / F.col("_n")).drop("_s", "_n", "_one", "_chunk")


def local_category(annotations: DataFrame, tile: str = "reference_tile", pos: str = "ann_idx", image: str = "image_id",
                   rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Adds ``local_name`` = pattern{n}, n = order in which the tile first appears in its image."""
    first = annotations.groupBy(image, tile).agg(F.min(pos).alias("_first"))
    numbered = row_numbers(first, ["_first"], [image], "_n", rows_per_chunk)
    named = numbered.select(image, tile, F.concat(F.lit("pattern"), F.col("_n").cast("string")).alias("local_name"))
    return attach(annotations, named, [image, tile], [pos])


def cycle_assign(pieces: DataFrame, palette: Sequence[str], by: Sequence[str], ident: str, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Deal palette entries in turn along the long side of each group; a lone piece gets the first.

    ``pieces``: key, id, axis ('h' sorts by centre y then x, 'v' by centre x then y), x0..y1.
    """
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    keyed = pieces.withColumns({"_major": F.when(F.col("axis") == "h", cy).otherwise(cx), "_minor": F.when(F.col("axis") == "h", cx).otherwise(cy)})
    numbered = row_numbers(keyed, ["_major", "_minor", ident], by, "_n", rows_per_chunk)
    entry = F.get(F.array(*[F.lit(p) for p in palette]), F.pmod(F.col("_n") - 1, F.lit(len(palette))).cast("int"))
    return numbered.withColumn("palette_entry", entry).drop("_major", "_minor", "_n")


def batch_plan(images: DataFrame, batch_size: int, divisor: int = 32, drop_last: bool = False, order: str = "image_id",
               rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Batches in record order: size, padded height and width (multiples of ``divisor``), share of padding.

    ``images``: order column, height, width (after resize).
    """
    placed = row_numbers(images.select(order, "height", "width"), [order], rows_per_chunk=rows_per_chunk)
    up = lambda c: (F.ceil(F.max(c) / divisor) * divisor).cast("bigint")
    plan = placed.groupBy(F.floor((F.col("rn") - 1) / batch_size).alias("batch_id")).agg(
        F.count(F.lit(1)).alias("n_images"), up("height").alias("max_h"), up("width").alias("max_w"), F.sum(F.col("height") * F.col("width")).alias("_px"))
    if drop_last:
        plan = plan.where(F.col("n_images") == batch_size)
    padded = F.col("n_images") * F.col("max_h") * F.col("max_w")
    return plan.select("batch_id", "n_images", "max_h", "max_w", (1.0 - F.col("_px") / padded).alias("padding_waste"))


def top_n_by_count(annotations: DataFrame, n: int, image: str = "image_id") -> DataFrame:
    """The n images with most instances; equal counts by index."""
    return annotations.groupBy(image).agg(F.count(F.lit(1)).alias("n_instances")).orderBy(F.desc("n_instances"), image).limit(n)


def first_with_count_between(annotations: DataFrame, lo: int, hi: int, image: str = "image_id") -> DataFrame:
    """First image whose number of instances lies in [lo, hi]."""
    counts = annotations.groupBy(image).agg(F.count(F.lit(1)).alias("n_instances"))
    return counts.where(F.col("n_instances").between(lo, hi)).orderBy(image).limit(1)


def worst_images(per_image: DataFrame, n: int | None = None, below: float | None = None) -> DataFrame:
    """Images with the lowest mean IoU (first n) or all under a bound."""
    rows = per_image if below is None else per_image.where(F.col("mean_iou") < below)
    return rows if n is None else rows.orderBy("mean_iou", "image_id").limit(n)


def largest_per_group(df: DataFrame, by: Sequence[str], ident: str, area: str) -> DataFrame:
    """Item with the largest area of each group; equal areas by lowest id."""
    best = F.min(F.struct((-F.col(area)).alias("neg"), F.col(ident).alias("i")))
    return df.groupBy(*by).agg(best.alias("_b")).select(*by, F.col("_b.i").alias(ident), (-F.col("_b.neg")).alias(area))


def ordered_distinct(df: DataFrame, by: Sequence[str], value: str, pos: str, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Distinct values of each group with the order in which they first appear."""
    first = df.groupBy(*by, value).agg(F.min(pos).alias("first_pos"))
    return row_numbers(first, ["first_pos"], by, "order_no", rows_per_chunk)


def palette_union(primary: DataFrame, alternatives: DataFrame, by: Sequence[str], path: str) -> DataFrame:
    """Primary tile of each group plus the alternatives that differ from it."""
    return primary.select(*by, path).unionByName(alternatives.select(*by, path)).distinct()


def set_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``a`` that are not in ``b``."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_anti")


def filter_with_fallback(df: DataFrame, predicate, by: Sequence[str], ids: Sequence[str], at_least: int = 1) -> DataFrame:
    """Rows that pass; groups with fewer than ``at_least`` passing rows keep all of theirs."""
    passed = df.where(predicate).groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= at_least)
    marked = attach(df, passed, by, ids)
    return marked.where(F.col("_n").isNull() | predicate).drop("_n")


def filter_min_area(df: DataFrame, area: str, role: str = "role") -> DataFrame:
    """Drop slivers: under 38 x 38 pixels for roof plans, 48 x 48 otherwise."""
    return df.where(F.col(area) >= F.when(F.col(role) == "roof_plan", F.lit(38 * 38)).otherwise(F.lit(48 * 48)))
