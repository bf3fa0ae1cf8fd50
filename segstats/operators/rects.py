"""Union of axis-aligned rectangles: area and outline, by vertical strips.

The rectangles of a key are brought together in one row and many keys go through
one call; keys with more rectangles than a row should hold go through joins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.functions.groups import by_load, members, sizes, union_areas, union_edges
from segstats.operators.intervals import intersect_intervals, merge_intervals, subtract_intervals
from segstats.scale import ROWS_PER_GROUP, fields, packed_by, parted, running, settle, with_chunks


BOX = ["x0", "y0", "x1", "y1"]


def _strips(rects: DataFrame, by: Sequence[str]) -> DataFrame:
    """Covered y intervals of every strip between neighbouring x coordinates: key, x_lo, x_hi, lo, hi."""
    cuts = rects.select(*by, F.explode(F.array("x0", "x1")).alias("x")).distinct()
    cuts = with_chunks(cuts, ["x"], by=by)
    strips = running(cuts, by, ["x"], {"_before": ("max", "x")}, through=False).where(F.col("_before").isNotNull())
    strips = strips.select(*by, F.col("_before").alias("lo"), F.col("x").alias("hi"))
    wide = rects.distinct().select(*by, F.col("x0").alias("lo"), F.col("x1").alias("hi"), "y0", "y1")
    inside = intersect_intervals(wide, strips, by, ["y0", "y1"], [])  # a rectangle covers a strip whole or not at all
    columns = inside.select(*by, F.col("lo").alias("x_lo"), F.col("hi").alias("x_hi"), F.col("y0").alias("lo"), F.col("y1").alias("hi"))
    return merge_intervals(columns, [*by, "x_lo", "x_hi"])


def _common_type(rects: DataFrame) -> str:
    whole = {"tinyint", "smallint", "int", "bigint"}
    return "bigint" if all(rects.schema[c].dataType.simpleString() in whole for c in BOX) else "double"


def _parted(rects: DataFrame, by: Sequence[str], rows_per_group: int) -> tuple[DataFrame, DataFrame | None]:
    """Packed rectangles of the small keys, and the others as they are; empty rectangles go."""
    kind = _common_type(rects)
    real = rects.select(*by, *[F.col(c).cast(kind).alias(c) for c in BOX]).where((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")))
    (small,), large = parted([real], by, rows_per_group)
    return packed_by(small, by, *BOX), large and large[0]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return by_load(batches, lambda batch: 2 * sizes(batch.column("members")) ** 2)


def rect_union_area(rects: DataFrame, by: Sequence[str], rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """Area of the union of the rectangles (x0, y0, x1, y1) of each key."""
    packed, large = _parted(rects, by, rows_per_group)
    keys = list(by)

    def areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            row, box = members(batch.column("members"))
            yield pa.record_batch([*[batch.column(k) for k in keys], pa.array(union_areas(row, box, batch.num_rows))], names=[*keys, "area"])

    out = packed.mapInArrow(areas, f"{fields(packed, keys)}, area {_common_type(rects)}")
    if large is None:
        return out
    covered = _strips(large, by)
    return out.unionByName(covered.groupBy(*by).agg(F.sum((F.col("x_hi") - F.col("x_lo")) * (F.col("hi") - F.col("lo"))).alias("area")))


def rect_union_edges(rects: DataFrame, by: Sequence[str], rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """Outline of the union: key, axis, at, lo, hi.

    Level edges are the ends of the covered intervals of the strips; upright
    ones are what one side of an x coordinate covers and the other does not.
    """
    packed, large = _parted(rects, by, rows_per_group)
    keys, kind = list(by), _common_type(rects)

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            row, upright, *ends = union_edges(*members(batch.column("members")))
            owner, axis = pa.array(row), pa.array(["h", "v"]).take(pa.array(upright.astype(np.int64)))
            yield pa.record_batch([*[batch.column(k).take(owner) for k in keys], axis, *map(pa.array, ends)], names=[*keys, "axis", "at", "lo", "hi"])

    out = packed.mapInArrow(outline, f"{fields(packed, keys)}, axis string, at {kind}, lo {kind}, hi {kind}")
    return out if large is None else out.unionByName(_joined_edges(large, by))


def _joined_edges(rects: DataFrame, by: Sequence[str]) -> DataFrame:
    covered = settle(_strips(rects, by))
    level = covered.select(*by, F.inline(F.array(
        F.struct(F.lit("top").alias("side"), F.col("lo").alias("at")), F.struct(F.lit("bottom").alias("side"), F.col("hi").alias("at")))),
        F.col("x_lo").alias("lo"), F.col("x_hi").alias("hi"))
    level = merge_intervals(level, [*by, "side", "at"]).select(*by, F.lit("h").alias("axis"), "at", "lo", "hi")
    left = covered.select(*by, F.col("x_hi").alias("at"), "lo", "hi", F.lit("left").alias("side"))
    right = covered.select(*by, F.col("x_lo").alias("at"), "lo", "hi", F.lit("right").alias("side"))
    only = [subtract_intervals(a, b, [*by, "at"], ["side"]) for a, b in ((left, right), (right, left))]
    upright = only[0].unionByName(only[1]).select(*by, F.lit("v").alias("axis"), "at", "lo", "hi")
    return level.unionByName(upright)
