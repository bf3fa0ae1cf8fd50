"""Interval algebra on tables of continuous intervals (lo, hi) per key.

Touching intervals merge; an intersection needs a positive length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstats.functions.groups import by_load, meetings, members, ranked, sizes, two_sided
from segstats.scale import ROWS_PER_CHUNK, ROWS_PER_GROUP, attach, fields, packed_by, parted, running, skew_join, with_chunks


def merge_intervals(df: DataFrame, by: Sequence[str], rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Union of the intervals of each key as disjoint intervals; empty ones are dropped.

    A start is an interval that begins after every earlier end; its position is
    carried forward as the name of the island, and islands are folded with
    ``max(hi)``.  Copies with the same start are folded before any sort.
    """
    starts = df.where(F.col("hi") > F.col("lo")).groupBy(*by, "lo").agg(F.max("hi").alias("hi"))
    starts = with_chunks(starts, ["lo"], rows_per_chunk, by)
    seen = running(starts, by, ["lo"], {"_before": ("max", "hi")}, through=False, rows_per_chunk=rows_per_chunk)
    opens = F.col("_before").isNull() | (F.col("lo") > F.col("_before"))
    marked = running(seen.withColumn("_open", F.when(opens, F.col("lo"))), by, ["lo"], {"_island": ("max", "_open")}, rows_per_chunk=rows_per_chunk)
    return marked.groupBy(*by, F.col("_island").alias("lo")).agg(F.max("hi").alias("hi"))


def _bins(width: float, lo: Column, hi: Column) -> Column:
    return F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))


def intersect_intervals(a: DataFrame, b: DataFrame, by: Sequence[str], a_ids: Sequence[str], b_ids: Sequence[str],
                        bin_width: float = 1024.0) -> DataFrame:
    """Every overlap of positive length between an interval of ``a`` and one of ``b``.

    Candidates meet on (key, bin); a pair that shares several bins is kept in
    the bin of its own start.  Output: key, ids of both sides, lo, hi.
    """
    left = a.select(*by, *a_ids, F.col("lo").alias("_alo"), F.col("hi").alias("_ahi")).withColumn(
        "_bin", _bins(bin_width, F.col("_alo"), F.col("_ahi")))
    right = b.select(*by, *b_ids, F.col("lo").alias("_blo"), F.col("hi").alias("_bhi")).withColumn(
        "_bin", _bins(bin_width, F.col("_blo"), F.col("_bhi")))
    lo, hi = F.greatest("_alo", "_blo"), F.least("_ahi", "_bhi")
    met = skew_join(left, right, [*by, "_bin"], [*a_ids, "_alo"], [*b_ids, "_blo"])
    return met.where((lo < hi) & (F.col("_bin") == F.floor(lo / bin_width))).select(
        *by, *a_ids, *b_ids, lo.alias("lo"), hi.alias("hi"))


def complement(hidden: DataFrame, by: Sequence[str], bounds: DataFrame,
               rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Gaps between the merged ``hidden`` intervals inside the bounds (key, first, last)."""
    merged = attach(merge_intervals(hidden, by, rows_per_chunk), bounds, by, ["lo"], how="inner")
    merged = with_chunks(merged, ["lo"], rows_per_chunk, by)
    before = running(merged, by, ["lo"], {"_end": ("max", "hi")}, through=False, rows_per_chunk=rows_per_chunk)
    inner = before.select(*by, F.coalesce("_end", "first").alias("lo"), F.col("lo").alias("hi"))
    tail = merged.groupBy(*by).agg(F.max("hi").alias("lo"), F.max("last").alias("hi"))
    return inner.unionByName(tail).where(F.col("lo") < F.col("hi"))


def subtract_intervals(segments: DataFrame, hidden: DataFrame, by: Sequence[str], ids: Sequence[str],
                       bin_width: float = 1024.0, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Visible parts of each segment: its overlap with the gaps between hidden intervals."""
    bounds = segments.groupBy(*by).agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    gaps = complement(hidden, by, bounds, rows_per_chunk)
    cut = intersect_intervals(segments, gaps, by, ids, [], bin_width)
    covered = hidden.where(F.col("hi") > F.col("lo")).select(*by).distinct()
    untouched = attach(segments, covered, by, ids, how="left_anti").where(F.col("lo") < F.col("hi"))
    return cut.unionByName(untouched.select(*by, *ids, "lo", "hi"))


def two_sided_cover(segments: DataFrame, rects: DataFrame, by: Sequence[str], bin_width: float = 1024.0,
                    rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """Parts of each wall line covered on both sides by rectangles of one cluster.

    ``segments``: key, seg_id, kind ('v'/'h'), pos, lo, hi.  ``rects``: key,
    cluster, x0, y0, x1, y1.  A rectangle covers the near side of a line at
    ``pos`` when it reaches from at most pos-1 to at least pos across it, and the
    far side from at most pos to at least pos+1.

    Lines and rectangles of a key are brought together in one row each, and many
    keys go through one call; larger keys go through joins.
    """
    box = ["x0", "y0", "x1", "y1"]
    lines = segments.select(*by, "seg_id", "kind", "pos", "lo", "hi").where(F.col("kind").isin("v", "h") & (F.col("lo") < F.col("hi"))).dropna()
    sides = rects.select(*by, "cluster", *box).dropna()
    (lines, sides), large = parted([lines, sides], by, rows_per_group)
    upright = lines.withColumn("kind", F.col("kind") == "v")
    met = packed_by(upright, by, "seg_id", "kind", "pos", "lo", "hi", out="lines").join(packed_by(sides, by, "cluster", *box, out="sides"), list(by))
    keys = list(by)

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_load(batches, lambda b: sizes(b.column("lines")) * sizes(b.column("sides"))):
            row, (names, upright, pos, lo, hi) = members(batch.column("lines"))
            _, (clusters, *ends) = members(batch.column("sides"))
            (names, (name,)), (_, (cluster,)) = ranked(names), ranked(clusters)
            i, j = meetings(*(sizes(batch.column(c)) for c in ("lines", "sides")))
            x0, y0, x1, y1 = (e[j] for e in ends)
            v, pos = upright.astype(bool)[i], pos[i]
            from_, to = np.where(v, x0, y0), np.where(v, x1, y1)
            near, far = (from_ <= pos - 1) & (to >= pos), (from_ <= pos) & (to >= pos + 1)
            lo, hi = np.maximum(lo[i], np.where(v, y0, x0)), np.minimum(hi[i], np.where(v, y1, x1))
            some = (near | far) & (lo < hi)
            line = (row[i] * len(names) + name[i])[some]
            line, lo, hi = two_sided((line, cluster[j][some]), (lo[some], hi[some]), near[some], far[some])
            owner, kind = pa.array(line // max(len(names), 1)), batch.schema.field("lines").type.value_type.field("seg_id").type
            yield pa.record_batch([*[batch.column(k).take(owner) for k in keys], pa.array(names[line % max(len(names), 1)], kind), pa.array(lo), pa.array(hi)],
                                  names=[*keys, "seg_id", "lo", "hi"])

    kinds = [f"{c} {span.schema[c].dataType.simpleString()}" for span in [_ends(lines, sides)] for c in ("lo", "hi")]
    out = met.mapInArrow(cover, ", ".join([fields(segments, [*by, "seg_id"]), *kinds]))
    return out if large is None else out.unionByName(_joined_cover(*large, by, bin_width))


def _ends(lines: DataFrame, sides: DataFrame) -> DataFrame:
    """No rows; ``lo`` and ``hi`` of the type that both sides have in common."""
    return lines.select("lo", "hi").limit(0).union(sides.select(F.greatest("x0", "y0"), F.greatest("x1", "y1")).limit(0))


def _joined_cover(segments: DataFrame, rects: DataFrame, by: Sequence[str], bin_width: float) -> DataFrame:
    along_v = rects.select(*by, "cluster", F.lit("v").alias("kind"), F.col("x0").alias("_p0"), F.col("x1").alias("_p1"),
                           F.col("y0").alias("_lo"), F.col("y1").alias("_hi"))
    along_h = rects.select(*by, "cluster", F.lit("h").alias("kind"), F.col("y0").alias("_p0"), F.col("y1").alias("_p1"),
                           F.col("x0").alias("_lo"), F.col("x1").alias("_hi"))
    bands = along_v.unionByName(along_h).withColumn("_bin", _bins(bin_width, F.col("_p0"), F.col("_p1")))
    lines = segments.withColumn("_bin", F.floor(F.col("pos") / bin_width))
    met = skew_join(lines, bands, [*by, "kind", "_bin"], ["seg_id"], ["cluster", "_p0", "_lo"])
    span = met.select(*by, "seg_id", "cluster", "pos", "_p0", "_p1",
                      F.greatest("lo", "_lo").alias("lo"), F.least("hi", "_hi").alias("hi"))
    key = [*by, "seg_id", "cluster"]
    near = merge_intervals(span.where((F.col("_p0") <= F.col("pos") - 1) & (F.col("_p1") >= F.col("pos"))), key)
    far = merge_intervals(span.where((F.col("_p0") <= F.col("pos")) & (F.col("_p1") >= F.col("pos") + 1)), key)
    return merge_intervals(intersect_intervals(near, far, key, [], [], bin_width), [*by, "seg_id"])


def point_hits_interval(points: DataFrame, hidden: DataFrame, by: Sequence[str], ids: Sequence[str],
                        bin_width: float = 1024.0, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add ``hit``: the point ``pos`` lies inside (or on an end of) a hidden interval of its key."""
    merged = merge_intervals(hidden, by, rows_per_chunk).withColumn("_bin", _bins(bin_width, F.col("lo"), F.col("hi")))
    placed = points.withColumn("_bin", F.floor(F.col("pos") / bin_width))
    inside = skew_join(placed, merged, [*by, "_bin"], ids, [*by, "lo"]).where(
        (F.col("lo") <= F.col("pos")) & (F.col("pos") <= F.col("hi"))).select(*by, *ids, F.lit(True).alias("_hit"))
    # Merged intervals are disjoint, so each point is hit at most once.
    return points.join(inside, [*by, *ids], "left").select(
        *[points[c] for c in points.columns], F.coalesce("_hit", F.lit(False)).alias("hit"))
