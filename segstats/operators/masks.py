"""Masks as span tables (image_id, obj_id, y, x0, x1), both ends inside the mask.

One rasterising rule: a pixel belongs to the mask when its integer point is
inside or on the outline and not inside or on a hole; vertices are truncated
towards zero first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segstats.functions.geometry import point_in_ring, polygon_bbox, rect_in_ring
from segstats.functions.groups import by_load, codes, joined, meetings, members, sizes
from segstats.functions.scalar import hash_int, hash_uniform, let
from segstats.functions.scanlines import batch_differences, batch_masks, expand_runs, fold_lines, run_commons, run_gaps, run_lists, run_overlaps
from segstats.operators.matching import BOX, connected_groups, meeting_boxes
from segstats.scale import ROWS_PER_GROUP, attach, fields, packed_by, parted, settle, skew_join

SPAN = "struct<a:bigint,b:bigint>"
NO_SPANS = f"array<{SPAN}>"


def _span(a: Column, b: Column) -> Column:
    return F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))


def _empty() -> Column:
    return F.array().cast(NO_SPANS)


def merge_span_array(spans: Column) -> Column:
    """Sorted, disjoint spans; runs that touch (next pixel) are joined."""

    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(_span(last["a"], F.greatest(last["b"], s["b"]))))
        return F.when(F.size(acc) == 0, F.array(s)).when(s["a"] > last["b"] + 1, F.concat(acc, F.array(s))).otherwise(grown)

    return let(spans, lambda all_: F.when(F.size(all_) <= 1, all_).otherwise(F.aggregate(F.array_sort(all_), _empty(), add)))


def subtract_span_array(spans: Column, holes: Column) -> Column:
    """Spans minus holes, both sorted and disjoint."""

    def cut(s: Column, inside: Column) -> Column:
        starts = F.concat(F.array(s["a"]), F.transform(inside, lambda h: h["b"] + 1))
        ends = F.concat(F.transform(inside, lambda h: h["a"] - 1), F.array(s["b"]))
        return F.filter(F.zip_with(starts, ends, _span), lambda p: p["a"] <= p["b"])

    def all_cut(cover: Column) -> Column:
        pieces = F.transform(spans, lambda s: let(F.filter(cover, lambda h: (h["a"] <= s["b"]) & (h["b"] >= s["a"])), lambda inside: cut(s, inside)))
        return F.when(F.size(cover) == 0, spans).otherwise(F.flatten(pieces))

    return let(holes, all_cut)


def rasterize(objects: DataFrame, ids: Sequence[str] = ("image_id", "obj_id"), segmentation: str = "segmentation") -> DataFrame:
    """Scan conversion of polygons with holes to spans, without a shuffle.

    Objects are independent, so each Arrow batch is converted where it is, all
    of its objects at once, and leaves Python as runs of equal lines.  Output grows
    with the height of the objects: give a table with few partitions more of them
    first (:func:`spread`).
    """
    return unpack_spans(rasterize_packed(objects, ids, segmentation), ids)


def _rings(objects: DataFrame, ids: Sequence[str], segmentation: str) -> DataFrame:
    """Objects with rings of whole points.  Those without an outline leave no mask; a filter would make all rings a second time, before they are spread."""
    whole = F.transform(F.col(segmentation), lambda r: F.slice(r, 1, F.size(r) - F.size(r) % 2).cast("array<double>"))
    return objects.select(*ids, whole.alias("rings"))


def spread(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """At least as many partitions as the session shuffles into, cut by a hash of the ids."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *ids)


def box_spans(boxes: DataFrame, ids: Sequence[str] = ("image_id", "obj_id")) -> DataFrame:
    """Spans of pixel boxes x0, y0, x1, y1."""
    return boxes.select(*ids, F.explode(F.sequence("y0", "y1")).alias("y"), "x0", "x1")


def packed_boxes(boxes: DataFrame, ids: Sequence[str] = ("image_id", "obj_id")) -> DataFrame:
    """Pixel boxes x0, y0, x1, y1 in the form of :func:`rasterize_packed`: one run each, no line is listed."""
    x0, y0, x1, y1 = (F.col(c).cast("bigint") for c in BOX)
    area = (x1 - x0 + 1) * (y1 - y0 + 1)
    return boxes.where((x0 <= x1) & (y0 <= y1)).select(
        *ids, area.alias("area"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), F.array(y0, y1, x0, x1).alias("runs"))


def clip_spans(spans: DataFrame, headers: DataFrame, image: str = "image_id") -> DataFrame:
    """Spans cut to the canvas (headers: image, width, height)."""
    ids = [c for c in spans.columns if c not in ("x0", "x1", image)]
    placed = attach(spans, headers.select(image, "width", "height"), [image], ids, how="inner")
    x0, x1 = F.greatest(F.col("x0"), F.lit(0)), F.least(F.col("x1"), F.col("width") - 1)
    return placed.where((F.col("y") >= 0) & (F.col("y") < F.col("height")) & (x0 <= x1)).select(
        *[x0.alias(c) if c == "x0" else x1.alias(c) if c == "x1" else F.col(c) for c in spans.columns])


def merge_spans(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """Union of the spans on each scan line of ``by`` (a group is at most one picture row wide)."""
    starts = spans.groupBy(*by, "x0").agg(F.max("x1").alias("x1"))
    w = Window.partitionBy(*by).orderBy("x0")
    before = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = starts.withColumn("_open", F.when(before.isNull() | (F.col("x0") > before + 1), F.col("x0")))
    named = marked.withColumn("_run", F.max("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy(*by, F.col("_run").alias("x0")).agg(F.max("x1").alias("x1"))


def subtract_holes(outer: DataFrame, holes: DataFrame, by: Sequence[str] = ("image_id", "obj_id", "y")) -> DataFrame:
    """Outline spans minus hole spans on each scan line.

    Distinct spans of a line are brought together as two arrays; a line is at
    most one picture row of one object.
    """
    tagged = outer.select(*by, "x0", "x1", F.lit(False).alias("_hole")).unionByName(
        holes.select(*by, "x0", "x1", F.lit(True).alias("_hole")))
    span = _span(F.col("x0"), F.col("x1"))
    lines = tagged.groupBy(*by).agg(
        F.collect_set(F.when(~F.col("_hole"), span)).alias("_o"), F.collect_set(F.when(F.col("_hole"), span)).alias("_h"))
    cut = subtract_span_array(merge_span_array(F.col("_o")), merge_span_array(F.col("_h")))
    return lines.where(F.size("_o") > 0).select(*by, F.explode(cut).alias("_s")).select(
        *by, F.col("_s.a").alias("x0"), F.col("_s.b").alias("x1"))


def mask_stats(spans: DataFrame, ids: Sequence[str] = ("image_id", "obj_id"), inclusive: bool = True) -> DataFrame:
    """Pixel area, box, sides and truncated centroid of each mask.

    ``inclusive`` counts pixels along a side (max - min + 1); otherwise it is the extent.
    """
    n = F.col("x1") - F.col("x0") + 1
    extra = 1 if inclusive else 0
    sums = spans.groupBy(*ids).agg(
        F.sum(n).alias("area"), F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1"),
        F.sum(n * F.col("y")).alias("_sy"), F.sum((F.col("x0") + F.col("x1")) * n).alias("_sx2"))
    return sums.select(
        *ids, "area", "x0", "y0", "x1", "y1", (F.col("x1") - F.col("x0") + extra).alias("w"), (F.col("y1") - F.col("y0") + extra).alias("h"),
        (F.col("_sx2") / 2 / F.col("area")).cast("bigint").alias("cx"), (F.col("_sy") / F.col("area")).cast("bigint").alias("cy"))


def span_overlaps(a: DataFrame, b: DataFrame, a_id: str, b_id: str, image: str = "image_id", x_bin: int = 2048) -> DataFrame:
    """Common pieces of spans on the same scan line: image, ids, y, x0, x1.

    Spans are cut at multiples of ``x_bin`` and meet on (image, y, bin), so pieces never repeat.
    """
    def cut(df: DataFrame, ident: str, tag: str) -> DataFrame:
        listed = df.select(image, F.col(ident), "y", "x0", "x1", F.explode(F.sequence(
            F.floor(F.col("x0") / x_bin), F.floor(F.col("x1") / x_bin))).alias("_bin"))
        return listed.select(image, ident, "y", "_bin", F.greatest(F.col("x0"), F.col("_bin") * x_bin).alias(f"_{tag}0"),
                             F.least(F.col("x1"), F.col("_bin") * x_bin + (x_bin - 1)).alias(f"_{tag}1"))

    met = skew_join(cut(a, a_id, "a"), cut(b, b_id, "b"), [image, "y", "_bin"], [a_id], [b_id])
    lo, hi = F.greatest("_a0", "_b0"), F.least("_a1", "_b1")
    return met.where(lo <= hi).select(image, a_id, b_id, "y", lo.alias("x0"), hi.alias("x1"))


def _areas(spans: DataFrame, image: str, ident: str, out: str) -> DataFrame:
    return spans.groupBy(image, ident).agg(F.sum(F.col("x1") - F.col("x0") + 1).alias(out))


def rasterize_packed(objects: DataFrame, ids: Sequence[str] = ("image_id", "obj_id"), segmentation: str = "segmentation") -> DataFrame:
    """:func:`rasterize` with one row per object: area, box and ``runs``, all from the one conversion.

    ``runs`` is a flat list [y from, y to, x0, x1, ...]: spans with equal ends on
    neighbouring lines are one run, so an upright mask has a handful of them.
    """
    rings, names = _rings(objects, ids, segmentation), list(ids)
    schema = ", ".join(f"`{c}` {rings.schema[c].dataType.simpleString()}" for c in ids) + ", area bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint, runs array<bigint>"

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from batch_masks(batch, names, "rings")

    return rings.mapInArrow(convert, schema)


def pack_spans(spans: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Span tables in the form of :func:`rasterize_packed`; the lines of an object are brought together once."""
    line = F.struct(*[F.col(c).cast("bigint").alias(c) for c in ("y", "x0", "x1")])
    listed = spans.groupBy(*ids).agg(
        F.sum(F.col("x1") - F.col("x0") + 1).cast("bigint").alias("area"), F.min("x0").cast("bigint").alias("x0"), F.min("y").cast("bigint").alias("y0"),
        F.max("x1").cast("bigint").alias("x1"), F.max("y").cast("bigint").alias("y1"), F.collect_list(line).alias("lines"))
    keep = listed.columns[:-1]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*[batch.column(c) for c in keep], fold_lines(batch.column("lines"))], names=[*keep, "runs"])

    return listed.mapInArrow(fold, ", ".join(f"`{c}` {listed.schema[c].dataType.simpleString()}" for c in keep) + ", runs array<bigint>")


def unpack_spans(packed: DataFrame, ids: Sequence[str] = ("image_id", "obj_id")) -> DataFrame:
    """The spans of packed masks."""
    at = lambda k: F.get("runs", F.col("_run") * 4 + k)
    listed = packed.where(F.size("runs") > 0).select(*ids, "runs", F.explode(F.sequence(F.lit(0), (F.size("runs") / 4).cast("int") - 1)).alias("_run"))
    return listed.select(*ids, at(0).alias("_y0"), at(1).alias("_y1"), at(2).alias("x0"), at(3).alias("x1")).select(
        *ids, F.explode(F.sequence("_y0", "_y1")).alias("y"), "x0", "x1")


def _packed(masks: DataFrame, ids: Sequence[str]) -> DataFrame:
    return masks if "runs" in masks.columns else pack_spans(masks, ids)


def subtract_packed(outer: DataFrame, holes: DataFrame, ids: Sequence[str] = ("image_id", "obj_id")) -> DataFrame:
    """:func:`subtract_holes` for packed masks: ids and ``runs``; a mask meets all of its holes in one row."""
    cover = holes.groupBy(*ids).agg(F.flatten(F.collect_list("runs")).alias("_holes"))
    met = outer.select(*ids, "runs").join(cover, list(ids), "left").select(*ids, "runs", F.coalesce("_holes", F.array().cast("array<bigint>")).alias("_holes"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*[batch.column(c) for c in ids], batch_differences(batch.column("runs"), batch.column("_holes"))], names=[*ids, "runs"])

    return met.mapInArrow(cut, ", ".join(f"`{c}` {met.schema[c].dataType.simpleString()}" for c in ids) + ", runs array<bigint>")


def mask_iou(a: DataFrame, b: DataFrame, a_id: str = "gt_idx", b_id: str = "q_idx", image: str = "image_id",
             candidates: DataFrame | None = None, cell: int = 512) -> DataFrame:
    """IoU of every overlapping mask pair of an image; zero pairs only where ``candidates`` asks for them.

    Both sides are span tables or packed masks.  Only masks whose boxes overlap
    meet, in grid cells of the boxes; areas ride along with the runs, which are
    intersected in Arrow batches where the pair is.
    """
    a, b = (_packed(m, [image, i]) for m, i in ((a, a_id), (b, b_id)))
    left = a.withColumnsRenamed({"area": "area_a", "runs": "runs_a"})
    right = b.withColumnsRenamed({"area": "area_b", "runs": "runs_b"})
    met = meeting_boxes(left, right, [image], a_id, b_id, cell, keep_a=["area_a", "runs_a"], keep_b=["area_b", "runs_b"])
    rows = met.select(image, a_id, b_id, "area_a", "area_b", "runs_a", "runs_b")
    keys = [image, a_id, b_id, "area_a", "area_b"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys) + ", inter bigint"

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inter = pa.array(run_overlaps(batch.column("runs_a"), batch.column("runs_b")), pa.int64())
            yield pa.record_batch([*[batch.column(k) for k in keys], inter], names=[*keys, "inter"])

    sized = rows.mapInArrow(intersect, schema).where(F.col("inter") > 0)
    if candidates is not None:
        asked = candidates.select(image, a_id, b_id)
        sized = asked.join(sized.select(image, a_id, b_id, "inter"), [image, a_id, b_id], "left").na.fill(0, ["inter"])
        sized = attach(sized, a.select(image, a_id, F.col("area").alias("area_a")), [image, a_id], [b_id])
        sized = attach(sized, b.select(image, b_id, F.col("area").alias("area_b")), [image, b_id], [a_id]).na.fill(0, ["area_a", "area_b"])
    union = F.col("area_a") + F.col("area_b") - F.col("inter")
    return sized.select(image, a_id, b_id, "inter", union.alias("union_area"),
                        (F.col("inter").cast("double") / F.greatest(union, F.lit(1))).alias("iou"))


def _images(frames: dict[str, DataFrame], image: str) -> DataFrame:
    """One row per image of the first frame with the list of each frame's rows; frames that were spread by image are not moved."""
    packed = [packed_by(f, [image], *[c for c in f.columns if c != image], out=tag) for tag, f in frames.items()]
    whole = reduce(lambda a, b: a.join(b, [image], "left"), packed)
    return whole.select(image, *[F.coalesce(tag, F.array().cast(whole.schema[tag].dataType)).alias(tag) for tag in frames])


def listed_masks(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array, np.ndarray, list[np.ndarray], pa.ListArray]:
    """Row, id, area, box and runs of the masks of lists of (id, rings), rows ascending; empty masks drop out."""
    ids, rings = lists.flatten().flatten()
    kinds = {"row": pa.int64(), "id": ids.type, **dict.fromkeys(("area", *BOX), pa.int64()), "runs": pa.list_(pa.int64())}
    batch = pa.record_batch([pc.list_parent_indices(lists).cast(pa.int64()), ids, rings], names=["row", "id", "rings"])
    parts = [b.cast(pa.schema(kinds)) for b in batch_masks(batch, ["row", "id"], "rings")] if batch.num_rows else []
    table = pa.Table.from_batches(parts, pa.schema(kinds))
    row, ids, area, *box, runs = (table[c].combine_chunks() for c in table.column_names)
    return row.to_numpy(), ids, area.to_numpy(), [c.to_numpy() for c in box], runs


def listed_pairs(a: tuple, b: tuple, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the masks (see :func:`listed_masks`) of a row that overlap, and their common pixels."""
    i, j = meetings(*(np.bincount(m[0], minlength=rows) for m in (a, b)))
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = a[3], b[3]
    near = (ax0[i] <= bx1[j]) & (bx0[j] <= ax1[i]) & (ay0[i] <= by1[j]) & (by0[j] <= ay1[i])
    i, j = i[near], j[near]
    inter = run_overlaps(a[4].take(pa.array(i)), b[4].take(pa.array(j)))
    return i[inter > 0], j[inter > 0], inter[inter > 0]


def polygon_iou(a: DataFrame, b: DataFrame, a_id: str = "gt_idx", b_id: str = "q_idx", image: str = "image_id",
                rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """:func:`mask_iou` of polygons (image, id, segmentation).

    The polygons of an image are brought together in one row before they are
    converted, so masks are made and met in one call for many images; images with
    more polygons than a row should hold go through :func:`mask_iou`.
    """
    (small_a, small_b), large = parted([a.select(image, a_id, "segmentation"), b.select(image, b_id, "segmentation")], [image], rows_per_group)
    packed = _images({"a": _rings(small_a, [image, a_id], "segmentation"), "b": _rings(small_b, [image, b_id], "segmentation")}, image).where((F.size("a") > 0) & (F.size("b") > 0))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_load(batches, lambda x: sizes(x.column("a")) * sizes(x.column("b"))):
            left, right = (listed_masks(batch.column(c)) for c in ("a", "b"))
            i, j, inter = listed_pairs(left, right, batch.num_rows)
            union = left[2][i] + right[2][j] - inter
            yield pa.record_batch([batch.column(image).take(pa.array(left[0][i])), left[1].take(pa.array(i)), right[1].take(pa.array(j)),
                                   *map(pa.array, (inter, union, inter / np.maximum(union, 1)))], names=[image, a_id, b_id, "inter", "union_area", "iou"])

    out = packed.mapInArrow(meet, f"{fields(a, [image, a_id])}, {fields(b, [b_id])}, inter bigint, union_area bigint, iou double")
    return out if large is None else out.unionByName(mask_iou(*(rasterize_packed(f, (image, i)) for f, i in zip(large, (a_id, b_id))), a_id, b_id, image))


def suppress_polygons(items: DataFrame, polygons: DataFrame, frac: float = 0.03, floor: int = 64, rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """:func:`suppress_overlaps` of polygons (image_id, obj_id, segmentation); an image whose items and polygons a row may hold is walked in one call."""
    ids = ["image_id", "obj_id"]
    (small, outlines), large = parted([items, polygons.select(*ids, "segmentation")], ["image_id"], rows_per_group, nulls=True)
    names = [c for c in items.columns if c != "image_id"]
    packed = _images({"items": small, "masks": _rings(outlines, ids, "segmentation")}, "image_id").where(F.size("items") > 0)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_load(batches, lambda b: sizes(b.column("items")) ** 2 + sizes(b.column("masks"))):
            row, columns = members(batch.column("items"))
            masks = listed_masks(batch.column("masks"))
            obj, pos = (columns[names.index(c)] for c in ("obj_id", "pos"))
            # Items meet their masks by (row, id), which has one number on both sides.
            first, number = codes(np.r_[row, masks[0]], np.r_[obj, masks[1].to_numpy(zero_copy_only=False)])
            mine, theirs = np.split(number, [len(row)])
            item, mask = joined(mine, theirs)
            order = np.lexsort((obj[item], pos[item], row[item]))
            item, mask = item[order], mask[order]
            there = (masks[0][mask], None, masks[2][mask], [c[mask] for c in masks[3]], masks[4].take(pa.array(mask)))
            i, j, _ = listed_pairs(there, there, batch.num_rows)
            before = (pos[item[j]] < pos[item[i]]) | ((pos[item[j]] == pos[item[i]]) & (obj[item[j]] < obj[item[i]]))
            i, j = i[before], j[before]
            limit = np.maximum(floor, np.floor(there[2][i] * frac)).astype(np.int64)
            common = run_commons(there[4].take(pa.array(i)), there[4].take(pa.array(j)))
            walk = pa.record_batch([*map(pa.array, (row[item[i]], row[item[i]], mine[item[i]], mine[item[j]], limit)), common],
                                   names=["image_id", "group_id", "obj_id", "earlier", "limit", "common"])
            gone = np.zeros(len(first), bool)
            for out in _walk(iter([walk])):
                gone[out.column("obj_id").to_numpy()] = True
            yield pa.record_batch([batch.column("image_id").take(pa.array(row)), *batch.column("items").flatten().flatten(), pa.array(~gone[mine])],
                                  names=["image_id", *names, "accepted"])

    out = packed.mapInArrow(decide, f"{fields(items, ['image_id', *names])}, accepted boolean").select(*items.columns, "accepted")
    return out if large is None else out.unionByName(suppress_overlaps(large[0], rasterize_packed(large[1]), frac, floor))


def suppress_overlaps(items: DataFrame, spans: DataFrame, frac: float = 0.03, floor: int = 64) -> DataFrame:
    """Walk the items of an image in order; drop one that covers too much of what was accepted before.

    ``items``: image_id, obj_id, pos (the order; ties by obj_id); adds
    ``accepted``.  Items that overlap, directly or through others, form a group;
    groups do not depend on each other, and each is walked once: its overlaps
    pass through a task in order, which keeps the overlaps of the item at hand and
    the ids dropped so far.  The rounds are those of finding the groups, the
    logarithm of the longest chain.
    """
    order = items.select("image_id", "obj_id", "pos")
    packed = settle(_packed(spans, ["image_id", "obj_id"]).select("image_id", "obj_id", "area", *BOX, "runs").join(order, ["image_id", "obj_id"]))
    first = packed.select("image_id", F.col("obj_id").alias("earlier"), F.col("pos").alias("earlier_pos"), *BOX, F.col("runs").alias("earlier_runs"))
    met = meeting_boxes(packed, first, ["image_id"], "obj_id", "earlier", keep_a=["pos", "area", "runs"], keep_b=["earlier_pos", "earlier_runs"])
    before = F.struct("earlier_pos", "earlier") < F.struct(F.col("pos").alias("earlier_pos"), F.col("obj_id").alias("earlier"))
    limit = F.greatest(F.lit(floor), F.floor(F.col("area") * F.lit(frac))).cast("bigint")
    rows = met.where(before).select("image_id", "obj_id", "earlier", "pos", limit.alias("limit"), "runs", "earlier_runs")
    keys = ["image_id", "obj_id", "earlier", "pos", "limit"]

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*[batch.column(k) for k in keys], run_commons(batch.column("runs"), batch.column("earlier_runs"))], names=[*keys, "common"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys) + ", common array<bigint>"
    pieces = settle(rows.mapInArrow(share, schema).where(F.size("common") > 0))
    links = pieces.select("image_id", "obj_id", "earlier")
    met = links.select("image_id", "obj_id").unionByName(links.select("image_id", F.col("earlier").alias("obj_id")))
    groups = settle(connected_groups(links, met, ["image_id"], "obj_id", "earlier"))
    walk = attach(pieces, groups, ["image_id", "obj_id"], ["earlier"], how="inner").select(
        "image_id", "group_id", "pos", "obj_id", F.col("earlier").cast("bigint").alias("earlier"), "limit", "common")
    # A group is small in most tables; a large one passes through its task in order, a few numbers of an item at a time.
    sorted_ = walk.repartition("image_id", "group_id").sortWithinPartitions("image_id", "group_id", "pos", "obj_id")
    kinds = ", ".join(f"{c} {walk.schema[c].dataType.simpleString()}" for c in ("image_id", "obj_id"))
    dropped = settle(sorted_.mapInArrow(_walk, kinds)).withColumn("_dropped", F.lit(True))
    return items.join(dropped, ["image_id", "obj_id"], "left").withColumn("accepted", F.col("_dropped").isNull()).drop("_dropped")


def _union_length(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> int:
    """Pixels in the union of runs [x0, x1] of lines y."""
    low, width = x0.min(), x1.max() - x0.min() + 2
    start = (y - y.min()) * width + (x0 - low)
    order = np.argsort(start, kind="stable")
    start, end = start[order], (start + x1 - x0 + 1)[order]
    reached = np.r_[start[:1], np.maximum.accumulate(end)[:-1]]
    return int(np.maximum(0, end - np.maximum(start, reached)).sum())


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of overlaps sorted by group and item, the items that are dropped."""
    group, dropped, rest = None, [], None

    def decide(item: pa.Table) -> bool:
        nonlocal group, dropped
        key = (item["image_id"][0].as_py(), item["group_id"][0].as_py())
        if key != group:
            group, dropped = key, []
        stays = ~np.isin(item["earlier"].to_numpy(), dropped)
        if not stays.any():
            return False
        _, y, x0, x1 = expand_runs(item["common"].combine_chunks().filter(pa.array(stays)))
        if _union_length(y, x0, x1) <= item["limit"][0].as_py():
            return False
        dropped.append(item["obj_id"][0].as_py())
        return True

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        if not table.num_rows:
            continue
        keys = [table[c].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in ("image_id", "group_id", "obj_id")]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        starts = np.r_[0, cuts]
        gone = [int(i) for i, j in zip(starts, cuts) if decide(table.slice(int(i), int(j - i)))]
        rest = table.slice(int(starts[-1]))  # the last item may go on
        if gone:
            yield from table.select(["image_id", "obj_id"]).take(pa.array(gone)).combine_chunks().to_batches()
    if rest is not None and rest.num_rows and decide(rest):
        yield from rest.select(["image_id", "obj_id"]).slice(0, 1).combine_chunks().to_batches()


def threshold_mask(raster: DataFrame, ids: Sequence[str] = ("image_id", "obj_id"), value: str = "v", threshold: float = 0.5) -> DataFrame:
    """Spans of pixels whose sigmoid exceeds the threshold.

    Neighbouring pixels of a line share x minus their rank; a group is one picture row.
    """
    on = raster.where(1.0 / (1.0 + F.exp(-F.col(value))) > threshold)
    w = Window.partitionBy(*ids, "y").orderBy("x")
    runs = on.withColumn("_run", F.col("x") - F.row_number().over(w))
    return runs.groupBy(*ids, "y", "_run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_run")


def resize_spans(spans: DataFrame, plans: DataFrame, image: str = "image_id") -> DataFrame:
    """Nearest-neighbour resize of masks (plans: image, height, width, nh, nw).

    Target pixel t reads source pixel floor(t * source / target), so source
    pixels [a, b] fill targets ceil(a*t/s) .. ceil((b+1)*t/s) - 1.  The same holds
    for lines, so boxes and upright runs (y0, y1 in place of y) are resized as a
    whole and listed line by line only then.
    """
    if "y" in spans.columns:
        spans = spans.withColumns({"y0": F.col("y"), "y1": F.col("y")}).drop("y")
    ids = [c for c in spans.columns if c not in (image, "y0", "y1", "x0", "x1")]
    placed = attach(spans, plans.select(image, "height", "width", "nh", "nw"), [image], [*ids, "y0"], how="inner")

    def first(v: Column, target: str, source: str) -> Column:
        return F.floor((v * F.col(target) + F.col(source) - 1) / F.col(source))

    y0, y1 = first(F.col("y0"), "nh", "height"), first(F.col("y1") + 1, "nh", "height") - 1
    x0, x1 = first(F.col("x0"), "nw", "width"), first(F.col("x1") + 1, "nw", "width") - 1
    sized = placed.select(image, *ids, y0.alias("_y0"), y1.alias("_y1"), x0.alias("x0"), x1.alias("x1")).where(
        (F.col("_y0") <= F.col("_y1")) & (F.col("x0") <= F.col("x1")))
    return sized.select(image, *ids, F.explode(F.sequence("_y0", "_y1")).alias("y"), "x0", "x1")


def pairwise_gap(spans: DataFrame, categories: DataFrame, max_gap: float | None = None) -> DataFrame:
    """Smallest pixel distance of same-category masks of an image; 0 if they overlap.

    ``spans`` is a span table or packed masks.  One row per pair is the result
    asked for: all pairs, or with ``max_gap`` those within it, whose boxes are
    paired by grid cells first.  A mask travels as one list of runs; distances
    are taken in Arrow batches where a pair is, in blocks of a bounded number of
    pairs of runs.
    """
    named = _packed(spans, ["image_id", "obj_id"])
    if "category_name" not in named.columns:
        named = named.join(categories.select("image_id", "obj_id", "category_name"), ["image_id", "obj_id"])
    boxes, named = named, named.select("image_id", "obj_id", "category_name", "runs")
    other = named.select("image_id", "category_name", F.col("obj_id").alias("other"), F.col("runs").alias("other_runs"))
    if max_gap is None:
        pairs = skew_join(named, other, ["image_id", "category_name"], ["obj_id"], ["other"]).where(F.col("obj_id") < F.col("other"))
    else:
        close = meeting_boxes(boxes.select("image_id", "category_name", "obj_id", "x0", "y0", "x1", "y1"),
                              boxes.select("image_id", "category_name", F.col("obj_id").alias("other"), "x0", "y0", "x1", "y1"),
                              ["image_id", "category_name"], "obj_id", "other", reach=int(-(-max_gap // 1)))
        close = close.where(F.col("obj_id") < F.col("other")).select("image_id", "category_name", "obj_id", "other")
        pairs = close.join(named.drop("category_name"), ["image_id", "obj_id"]).join(other.drop("category_name"), ["image_id", "other"])
    keys = ["image_id", "category_name", "obj_id", "other"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps = pa.array(run_gaps(batch.column("runs"), batch.column("other_runs")), pa.float64())
            yield pa.record_batch([*[batch.column(k) for k in keys], gaps], names=[*keys, "gap"])

    rows = pairs.select(*keys, "runs", "other_runs")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:4]) + ", gap double"
    out = rows.mapInArrow(run, schema)
    return out if max_gap is None else out.where(F.col("gap") <= max_gap)


def points_in_polygons(points: DataFrame, polygons: DataFrame, image: str = "image_id", cell: int = 256) -> DataFrame:
    """(point, polygon) hits by even-odd ray casting; points meet polygons in grid cells of the polygon's box."""
    box = polygon_bbox(F.col("ring"))
    listed = (polygons.select(image, "poly_id", "ring", box.alias("_box"))
              .withColumn("_gx", F.explode(F.sequence(F.floor(F.col("_box.x0") / cell), F.floor(F.col("_box.x1") / cell))))
              .withColumn("_gy", F.explode(F.sequence(F.floor(F.col("_box.y0") / cell), F.floor(F.col("_box.y1") / cell))))
              .drop("_box"))
    placed = points.select(image, "point_id", "px", "py", F.floor(F.col("px") / cell).alias("_gx"), F.floor(F.col("py") / cell).alias("_gy"))
    met = skew_join(placed, listed, [image, "_gx", "_gy"], ["point_id"], ["poly_id"])
    return met.where(point_in_ring(F.col("px"), F.col("py"), F.col("ring"))).select(image, "point_id", "poly_id")


def rects_in_polygons(rects: DataFrame, polygons: DataFrame, image: str = "image_id", margin: int = 8, cell: int = 256) -> DataFrame:
    """(rect, polygon) pairs where the grown rectangle has all corners inside; rects: rect_id, x, y, w, h."""
    box = polygon_bbox(F.col("ring"))
    listed = (polygons.select(image, "poly_id", "ring", box.alias("_box"))
              .withColumn("_gx", F.explode(F.sequence(F.floor(F.col("_box.x0") / cell), F.floor(F.col("_box.x1") / cell))))
              .withColumn("_gy", F.explode(F.sequence(F.floor(F.col("_box.y0") / cell), F.floor(F.col("_box.y1") / cell)))))
    placed = rects.select(image, "rect_id", "x", "y", "w", "h", F.floor((F.col("x") - margin) / cell).alias("_gx"),
                          F.floor((F.col("y") - margin) / cell).alias("_gy"))
    # A rectangle that leaves the box of a ring (by more than rounding) is not inside it; most pairs end here.
    within = ((F.col("x") - margin >= F.col("_box.x0") - 1) & (F.col("x") + F.col("w") + margin <= F.col("_box.x1") + 1)
              & (F.col("y") - margin >= F.col("_box.y0") - 1) & (F.col("y") + F.col("h") + margin <= F.col("_box.y1") + 1))
    met = skew_join(placed, listed, [image, "_gx", "_gy"], ["rect_id"], ["poly_id"])
    inside = rect_in_ring(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("ring"), margin)
    return met.where(within).where(inside).select(image, "rect_id", "poly_id")


def _centroids(packed: DataFrame) -> DataFrame:
    """Packed masks with sides and truncated centroid (``w``, ``h``, ``cx``, ``cy``)."""
    def add(acc: Column, k: Column) -> Column:
        y0, y1, x0, x1 = (F.get("runs", k * 4 + i) for i in range(4))
        n = (y1 - y0 + 1) * (x1 - x0 + 1)
        return F.struct((acc["x"] + (x0 + x1) * n).alias("x"), (acc["y"] + (y0 + y1) * n).alias("y"))

    zero = F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"))
    sums = packed.where(F.size("runs") > 0).withColumn("_sums", F.aggregate(F.sequence(F.lit(0), (F.size("runs") / 4).cast("int") - 1), zero, add))
    return sums.withColumns({
        "w": F.col("x1") - F.col("x0") + 1, "h": F.col("y1") - F.col("y0") + 1, "cx": (F.col("_sums.x") / 2 / F.col("area")).cast("bigint"),
        "cy": (F.col("_sums.y") / 2 / F.col("area")).cast("bigint")}).drop("_sums")


TRY = "try bigint, pixel bigint, bx bigint, by bigint, bw bigint, bh bigint"
DRAWN = ["_try", "_bx", "_by", "_bw", "_bh"]


def _first_covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first box of ``_tries`` that its mask covers, a bounded number of lines and meetings at a time.

    Boxes with a pixel number are centred on that pixel of the mask, in reading order, and moved inside the canvas.
    """
    for batch in batches:
        heights = np.bincount(*_run_heights(batch.column("runs")), minlength=batch.num_rows).astype(np.int64)
        n_tries, n_runs = (np.asarray(pc.list_value_length(batch.column(c))).astype(np.int64) for c in ("_tries", "runs"))
        load = np.where(n_tries > 0, heights + n_tries * n_runs, 0)
        cuts = np.r_[0, np.flatnonzero(np.diff((np.cumsum(load) - load) // 1_000_000)) + 1, batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:]):
            part = batch.slice(start, end - start)
            drawn = [part.column(c).to_numpy(zero_copy_only=False) for c in DRAWN]
            open_ = pa.array(np.flatnonzero(n_tries[start:end]))
            if len(open_):
                row, boxes = _covered(*(part.column(c).take(open_) for c in ("runs", "_tries", "_right", "_bottom")))
                drawn = [d.astype(np.float64) for d in drawn]  # a null is NaN; pixel numbers of a canvas are exact
                for d, values in zip(drawn, boxes):
                    d[open_.to_numpy()[row]] = values
            yield pa.record_batch([*[part.column(c) for c in part.schema.names if c not in ("_tries", *DRAWN)],
                                   *[pa.array(d, from_pandas=True).cast(pa.int64()) for d in drawn]],
                                  names=[*[c for c in part.schema.names if c not in ("_tries", *DRAWN)], *DRAWN])


def _run_heights(runs: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    flat = np.asarray(runs.flatten()).reshape(-1, 4)
    return np.repeat(np.arange(len(runs)), np.asarray(pc.list_value_length(runs)) // 4), flat[:, 1] - flat[:, 0] + 1


def _covered(runs: pa.ListArray, tries: pa.ListArray, right: pa.Array, bottom: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Number of each mask that covers one of its boxes, and the first such box (try, x, y, w, h)."""
    row = np.asarray(pc.list_parent_indices(tries)).astype(np.int64)
    flat = tries.flatten()
    number, pixel, x, y, w, h = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(6))
    if (pixel >= 0).any():
        line_row, line_y, x0, x1 = expand_runs(runs)
        order = np.lexsort((x0, line_y, line_row))
        line_row, line_y, x0, x1 = line_row[order], line_y[order], x0[order], x1[order]
        upto = np.cumsum(x1 - x0 + 1)
        first = np.searchsorted(line_row, np.arange(len(runs)))
        place = (np.r_[0, upto][first])[row] + pixel
        at = np.searchsorted(upto, place, side="right")
        half = w // 2
        x = np.maximum(0, np.minimum(x0[at] + place - (upto[at] - (x1[at] - x0[at] + 1)) - half, np.asarray(right)[row] - w))
        y = np.maximum(0, np.minimum(line_y[at] - half, np.asarray(bottom)[row] - h))
    boxes = np.column_stack([y, y + h - 1, x, x + w - 1]).astype(np.int64)
    common = run_overlaps(run_lists(np.arange(len(row)), boxes, len(row)), runs.take(pa.array(row)))
    hit = np.flatnonzero(common == w * h)
    served, first = np.unique(row[hit], return_index=True)
    return served, [v[hit[first]] for v in (number, x, y, w, h)]


def sample_reference_box(spans: DataFrame, headers: DataFrame, min_size: int = 128, max_size: int = 512, seed: int = 42,
                         objects: DataFrame | None = None) -> DataFrame:
    """A square patch that lies wholly inside each mask, drawn by hash.

    ``spans`` is a span table or packed masks.  ``objects`` (image_id, obj_id)
    names masks that may be empty: without a span they get (0, 0, 32, 32).

    200 squares centred on mask pixels, size min + (max - min) * sqrt(u); then
    50 boxes for each of five side fractions; else 32 x 32 at the centroid.  The
    first try whose box is fully covered wins.  Masks are independent: each stays
    one row with its runs, and its tries are looked at where it is.
    """
    ids = ["image_id", "obj_id"]
    packed = spans if "runs" in spans.columns else pack_spans(merge_spans(spans, [*ids, "y"]), ids)
    state = _centroids(packed).join(headers.select("image_id", "width", "height"), "image_id")
    cap = F.greatest(F.least(F.lit(max_size), F.floor(F.col("w") * 0.7), F.floor(F.col("h") * 0.7)), F.lit(min_size))
    free = F.lit(1 << 40)  # a canvas of unknown size does not move a box
    state = state.select(*ids, "area", *BOX, "w", "h", "cx", "cy", "runs", cap.alias("_cap"), F.coalesce("width", free).cast("bigint").alias("_right"),
                         F.coalesce("height", free).cast("bigint").alias("_bottom"), *[F.lit(None).cast("bigint").alias(c) for c in DRAWN])

    def u(stage: str, t: Column) -> Column:
        return hash_uniform(seed, F.lit(stage), "image_id", "obj_id", t)

    def row(t: Column, *values: Column) -> Column:
        return F.struct(*[v.cast("bigint").alias(n.split()[0]) for n, v in zip(TRY.split(", "), (t, *values))])

    def squares(t: Column) -> Column:
        size = F.floor(F.lit(min_size) + (F.col("_cap") - min_size) * F.sqrt(u("size", t)))
        return row(t, hash_int(F.lit(0), F.col("area") - 1, u("pixel", t)), F.lit(0), F.lit(0), size, size)

    def boxes(t: Column) -> Column:
        frac = F.get(F.array(*[F.lit(f) for f in (0.6, 0.5, 0.4, 0.3, 0.2)]), F.floor((t - 201) / 50).cast("int"))
        return let(F.struct(F.greatest(F.lit(min_size), F.floor(F.col("w") * frac)).alias("w"), F.greatest(F.lit(min_size), F.floor(F.col("h") * frac)).alias("h")), lambda b: row(
            t, F.lit(-1), hash_int(F.col("x0"), F.greatest(F.col("x0"), F.col("x1") - b["w"]), u("x", t)),
            hash_int(F.col("y0"), F.greatest(F.col("y0"), F.col("y1") - b["h"]), u("y", t)), b["w"], b["h"]))

    # Fixed values of the draw: 200 squares, 50 boxes for each of five fractions, 32 pixels.
    # Most masks are served by the first few squares; only the others go on to the later tries.
    none = F.array().cast(f"array<struct<{TRY.replace(' ', ':')}>>".replace(",:", ","))
    fits = lambda b: (b["bw"] * b["bh"] <= F.col("area")) & (b["bw"] <= F.col("w")) & (b["bh"] <= F.col("h"))
    for make, start, end in ((squares, 1, 10), (squares, 11, 200), (boxes, 201, 450)):
        asked = F.col("_try").isNull() & (F.least("w", "h") >= min_size)  # no box is smaller
        state = state.withColumn("_tries", F.when(asked, F.filter(F.transform(F.sequence(F.lit(start), F.lit(end)), make), fits)).otherwise(none))
        kept = state.drop("_tries", *DRAWN).schema.fields
        state = state.mapInArrow(_first_covered, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], *[f"{c} bigint" for c in DRAWN]]))
    side = F.lit(32).cast("bigint")
    drawn = state.select(
        *ids, F.coalesce("_bx", F.greatest(F.lit(0), F.col("cx") - 16)).cast("bigint").alias("x"),
        F.coalesce("_by", F.greatest(F.lit(0), F.col("cy") - 16)).cast("bigint").alias("y"),
        F.coalesce("_bw", side).alias("w"), F.coalesce("_bh", side).alias("h"), F.coalesce("_try", F.lit(0)).cast("bigint").alias("try"))
    if objects is None:
        return drawn
    drawn = settle(drawn)  # read twice
    nothing = objects.select(*ids).distinct().join(drawn.select(*ids), ids, "left_anti")
    zero = F.lit(0).cast("bigint")
    return drawn.unionByName(nothing.select(*ids, zero.alias("x"), zero.alias("y"), side.alias("w"), side.alias("h"), zero.alias("try")))
