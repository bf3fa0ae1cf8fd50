"""Pixel tables (image_id, y, x, r, g, b) or (image_id, y, x, gray)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segstats.functions.groups import cut_boxes, ink_of_spans, sampled
from segstats.functions.scalar import GRAY_SATURATION, byte_luma, hash_uniform, luma, saturation
from segstats.operators.masks import clip_spans
from segstats.scale import ROWS_PER_GROUP, are_numbers, in_calls, skew_join


def running_counts(pixels: DataFrame) -> DataFrame:
    """One row per picture line: image_id, y, x_from and ``upto``, whose element k counts the pixels with x < x_from + k.

    A run of the line is counted by two look-ups, whatever its length and however many runs cross it.
    """
    lines = pixels.groupBy("image_id", "y").agg(F.min("x").cast("bigint").alias("x_from"), F.collect_list(F.col("x").cast("bigint")).alias("xs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, lists = np.asarray(batch.column(2)), batch.column(3)
            line = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
            place = np.asarray(lists.flatten()) - first[line] + 1
            size = np.zeros(batch.num_rows, np.int64)
            np.maximum.at(size, line, place + 1)
            ends = np.cumsum(np.r_[0, size])
            total = np.cumsum(np.bincount(ends[:-1][line] + place, minlength=ends[-1]))
            before = np.r_[0, total][ends[:-1]]  # what the lines before have added up to
            upto = pa.array(total - np.repeat(before, size), pa.int32())
            yield pa.record_batch([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), upto)], names=["image_id", "y", "x_from", "upto"])

    kinds = ", ".join(f"{c} {lines.schema[c].dataType.simpleString()}" for c in ("image_id", "y", "x_from"))
    return lines.mapInArrow(run, f"{kinds}, upto array<int>")


def counted(upto: str, x_from: str, x0: Column, x1: Column) -> Column:
    """Pixels of a line (see :func:`running_counts`) with x0 <= x <= x1."""
    at = lambda x: F.get(upto, F.greatest(F.lit(0), F.least(x - F.col(x_from), F.size(upto) - 1)).cast("int"))
    return F.greatest(F.lit(0), at(x1 + 1) - at(x0))


def ink_coverage(pixels: DataFrame, spans: DataFrame, headers: DataFrame, threshold: int = 200,
                 ids: Sequence[str] = ("image_id", "obj_id"), rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """Share of the pixels of each mask that are darker than ``threshold``; empty masks drop out.

    Many small pictures go through one call.  In the others dark pixels become
    running counts of their line, and every span of a mask looks up two of them:
    the join has a row per span, not per span and pixel.
    """
    dark, own = pixels.where(F.col("gray") < threshold).select("image_id", "y", "x"), [c for c in ids if c != "image_id"]
    frames = [dark, spans.select("image_id", *own, "y", "x0", "x1"), headers.select("image_id", "width", "height")]
    like = _joined_ink(*frames, ids)
    if len(own) != 1 or not all(are_numbers(f, "image_id") for f in frames):
        return like
    out, large = in_calls(frames, "image_id", ink_of_spans, T.StructType([like.schema[c] for c in ("image_id", *own, "area", "ink")]), rows_per_group)
    out = out.select(*ids, "area", "ink")
    return out if large is None else out.unionByName(_joined_ink(*large, ids))


def _joined_ink(dark: DataFrame, spans: DataFrame, headers: DataFrame, ids: Sequence[str]) -> DataFrame:
    inside = clip_spans(spans, headers)
    own = [c for c in ids if c != "image_id"]
    dark = running_counts(dark)
    met = skew_join(inside, dark, ["image_id", "y"], own, how="left")
    ink = F.coalesce(counted("upto", "x_from", F.col("x0"), F.col("x1")), F.lit(0))
    sums = met.groupBy(*ids).agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("_area"), F.sum(ink).alias("_ink"))
    return sums.select(*ids, F.col("_area").alias("area"), (F.col("_ink") / F.col("_area")).alias("ink"))


def tile_stats(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """Ink density, mean saturation and the gray flag of every picture."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    stats = pixels.groupBy(key).agg((F.avg(255.0 - luma(r, g, b)) / 255.0).alias("ink_density"),
                                    F.avg(saturation(r, g, b)).alias("sat_mean"))
    return stats.withColumn("is_gray", F.col("sat_mean") < GRAY_SATURATION)


def mono_report(stats: DataFrame) -> DataFrame:
    """Number and share of monochrome pictures."""
    return stats.agg(F.count(F.lit(1)).alias("n_images"), F.sum(F.col("is_gray").cast("bigint")).alias("n_mono"),
                     F.avg(F.col("is_gray").cast("double")).alias("mono_share"))


def to_gray(pixels: DataFrame) -> DataFrame:
    """All three channels replaced by their luma, a byte."""
    v = byte_luma(F.col("r"), F.col("g"), F.col("b"))
    return pixels.withColumns({"r": v, "g": v, "b": v})


def crop(pixels: DataFrame, boxes: DataFrame, box_id: str = "box_id", rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """Pixels of each box (x, y, w, h), with coordinates relative to its corner.

    Many small pictures go through one call.  In the others a picture line is one
    row with its pixels in order; a box line takes its stretch of it, by place
    where the line has no gaps.
    """
    frames = [pixels.select("image_id", "y", "x", *[c for c in pixels.columns if c not in ("image_id", "y", "x")]), boxes.select("image_id", box_id, "x", "y", "w", "h")]
    like = _joined_crop(*frames, box_id)
    if not all(are_numbers(f, "image_id") for f in frames):
        return like
    out, large = in_calls(frames, "image_id", cut_boxes, like.schema, rows_per_group)
    return out if large is None else out.unionByName(_joined_crop(*large, box_id))


def _joined_crop(pixels: DataFrame, boxes: DataFrame, box_id: str) -> DataFrame:
    values = [c for c in pixels.columns if c not in ("image_id", "y", "x")]
    lines = pixels.groupBy("image_id", "y").agg(F.sort_array(F.collect_list(F.struct("x", *values))).alias("_px"))
    first, last = (F.get("_px", i)["x"] for i in (F.lit(0), F.size("_px") - 1))
    lines = lines.select("image_id", "y", "_px", first.alias("_x0"), (last - first + 1 == F.size("_px")).alias("_whole"))
    rows = boxes.select("image_id", box_id, F.col("x").alias("_bx"), F.col("y").alias("_by"), F.col("w").alias("_bw"),
                        F.explode(F.sequence(F.col("y"), F.col("y") + F.col("h") - 1)).alias("y"))
    met = skew_join(rows, lines, ["image_id", "y"], [box_id])
    start = F.greatest(F.col("_bx") - F.col("_x0"), F.lit(0))
    by_place = F.slice("_px", (start + 1).cast("int"), F.greatest(F.col("_bx") + F.col("_bw") - F.col("_x0") - start, F.lit(0)).cast("int"))
    by_value = F.filter("_px", lambda p: (p["x"] >= F.col("_bx")) & (p["x"] < F.col("_bx") + F.col("_bw")))
    cut = met.select("image_id", box_id, (F.col("y") - F.col("_by")).alias("y"), "_bx", F.inline(F.when(F.col("_whole"), by_place).otherwise(by_value)))
    return cut.select("image_id", box_id, "y", (F.col("x") - F.col("_bx")).alias("x"), *values)


def bilinear_sample(raster: DataFrame, points: DataFrame, headers: DataFrame, value: str = "v", image: str = "image_id",
                    rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """Value at points (u, v in the unit square), pixel centres at half steps, borders repeated.

    Every point asks for its four neighbours; neighbours off the picture fall on
    the border pixel.  Many small pictures go through one call.
    """
    frames = [raster.select(image, "y", "x", value), points.select(image, "point_id", "u", "v"), headers.select(image, "width", "height")]
    like = _joined_sample(*frames, value, image)
    if not all(are_numbers(f, image) for f in frames):
        return like
    out, large = in_calls(frames, image, sampled, like.schema, rows_per_group)
    return out if large is None else out.unionByName(_joined_sample(*large, value, image))


def _joined_sample(raster: DataFrame, points: DataFrame, headers: DataFrame, value: str, image: str) -> DataFrame:
    placed = points.select(image, "point_id", "u", "v").join(headers.select(image, "width", "height"), image)
    fx = F.least(F.greatest(F.col("u") * F.col("width") - 0.5, F.lit(0.0)), F.col("width") - 1.0)
    fy = F.least(F.greatest(F.col("v") * F.col("height") - 0.5, F.lit(0.0)), F.col("height") - 1.0)
    base = placed.select(image, "point_id", "width", "height", fx.alias("_fx"), fy.alias("_fy")).withColumns(
        {"_x": F.floor("_fx"), "_y": F.floor("_fy")})
    wx, wy = F.col("_fx") - F.col("_x"), F.col("_fy") - F.col("_y")
    right, down = F.least(F.col("_x") + 1, F.col("width") - 1), F.least(F.col("_y") + 1, F.col("height") - 1)

    def corner(x, y, w):
        return F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), w.alias("w"))

    corners = F.array(corner(F.col("_x"), F.col("_y"), (1 - wx) * (1 - wy)), corner(right, F.col("_y"), wx * (1 - wy)),
                      corner(F.col("_x"), down, (1 - wx) * wy), corner(right, down, wx * wy))
    asked = base.select(image, "point_id", F.inline(corners))
    found = asked.join(raster.select(image, "y", "x", F.col(value).alias("_value")), [image, "y", "x"])
    return found.groupBy(image, "point_id").agg(F.sum(F.col("w") * F.col("_value")).alias("value"))


def sample_points(rows: DataFrame, ids: Sequence[str], seed: int) -> DataFrame:
    """``rows`` with a uniform point (u, v) of the unit square each, drawn by hash of their ``ids``."""
    return rows.withColumns({axis: hash_uniform(seed, F.lit(axis), *ids) for axis in ("u", "v")})


#: Lines of a band of a picture, whose pixels are brought together.
BAND_LINES = 64
SUMS = ("n", "total", "squares", "n_white", "n_below", "below", "n_right", "right")


def _bands(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Pixels (image_id, y, x, v) of a batch as one row per image and band; the first line of a band goes to the band above too."""
    code = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    y, x, v = (np.asarray(batch.column(k)) for k in (1, 2, 3))
    top = np.flatnonzero(y % BAND_LINES == 0)
    rows = np.r_[np.arange(len(y)), top]
    band = np.r_[y // BAND_LINES, y[top] // BAND_LINES - 1]
    order = np.lexsort((band, code[rows]))
    rows, band = rows[order], band[order]
    first = np.flatnonzero(np.r_[True, (code[rows][1:] != code[rows][:-1]) | (band[1:] != band[:-1])][: len(rows)])
    ends = pa.array(np.r_[first, len(rows)], pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(c[rows])) for c in (y, x, v)]
    return pa.record_batch([batch.column(0).take(pa.array(rows[first])), pa.array(band[first]), *lists], names=["image_id", "band", "ys", "xs", "vs"])


def _band_sums(batch: pa.RecordBatch, white: float) -> pa.RecordBatch:
    """Sums over the pixels of each band: a place counts once, with its largest value."""
    n = batch.num_rows
    row = np.repeat(np.arange(n), np.asarray(batch.column(2).value_lengths()))
    y, x, v = (np.asarray(batch.column(k).flatten()) for k in (2, 3, 4))
    order = np.lexsort((v, x, y, row))
    last = np.r_[(row[order][1:] != row[order][:-1]) | (y[order][1:] != y[order][:-1]) | (x[order][1:] != x[order][:-1]), True][: len(order)]
    row, y, x, v = (c[order][last] for c in (row, y, x, v))
    own = y // BAND_LINES == np.asarray(batch.column(1))[row]
    width, low = int(x.max() - x.min() + 2), int(x.min())
    place = (row * (BAND_LINES + 2) + y - np.asarray(batch.column(1))[row] * BAND_LINES) * width + x - low  # ascending

    def step(away: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(place, place + away), len(place) - 1)
        met = own & (place[at] == place + away)
        return row[met], np.abs(v[at[met]] - v[met])

    down, right = step(width), step(1)
    add = lambda rows, weights=None: np.bincount(rows, weights, n).astype(np.int64 if weights is None else np.float64)
    mine, g = row[own], v[own]
    far = [np.full(n, np.iinfo(np.int64).min) for _ in "xy"]
    np.maximum.at(far[0], mine, x[own])
    np.maximum.at(far[1], mine, y[own])
    sums = [add(mine), add(mine, g), add(mine, g * g), add(mine[g > white]), add(down[0]), add(*down), add(right[0]), add(*right)]
    return pa.record_batch([batch.column(0), *map(pa.array, [*sums, *far])], names=["image_id", *SUMS, "x_last", "y_last"])


def image_features(pixels: DataFrame) -> DataFrame:
    """Gray mean, deviation, white share, edge strength and aspect of every picture.

    Edge strength is the mean step to the pixel below plus the mean step to the
    pixel on the right.  The pixels of a band of lines are brought together as
    arrays, with the line below the band, and summed in Arrow batches.
    """
    rows = pixels.where(F.col("gray").isNotNull()).select("image_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), (F.col("gray") / 255.0).alias("v"))
    image = f"image_id {rows.schema['image_id'].dataType.simpleString()}"
    parts = rows.mapInArrow(lambda batches: (_bands(b) for b in batches if b.num_rows), f"{image}, band bigint, ys array<bigint>, xs array<bigint>, vs array<double>")
    bands = parts.groupBy("image_id", "band").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("ys", "xs", "vs")])
    kinds = ", ".join(f"{c} {'bigint' if c.startswith('n') else 'double'}" for c in SUMS)
    sums = bands.mapInArrow(lambda batches: (_band_sums(b, 0.97) for b in batches if b.num_rows), f"{image}, {kinds}, x_last bigint, y_last bigint")
    whole = sums.groupBy("image_id").agg(*[F.sum(c).alias(c) for c in SUMS], F.max("x_last").alias("x_last"), F.max("y_last").alias("y_last")).where("n > 0")
    share = lambda a, n: F.when(F.col(n) > 0, F.col(a) / F.col(n))
    mean = share("total", "n")
    return whole.select("image_id", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), share("squares", "n") - mean * mean)).alias("std"), share("n_white", "n").alias("white"),
                        (share("below", "n_below") + share("right", "n_right")).alias("edge"), ((F.col("x_last") + 1) / F.greatest(F.lit(1), F.col("y_last") + 1)).alias("aspect"))
