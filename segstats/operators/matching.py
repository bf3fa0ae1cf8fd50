"""Pairing of ground truth and predictions, nearest neighbours, assignment, groups.

Pair tables hold the overlapping pairs of an image only: a pair that is absent
has IoU 0, so no image ever expands to all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from segstats.functions.geometry import box_iou, rect_intersection_area
from segstats.functions.groups import by_load, greedy_pairs, members, numbers, point_costs, shared_sides, sizes, smallest_reachable
from segstats.functions.scalar import foreground_score, hash_bits, sigmoid, softplus
from segstats.scale import ROWS_PER_GROUP, attach, batched_by, fields, forget, has_null, packed_by, parted, settle, skew_join, until_stable

BOX = ["x0", "y0", "x1", "y1"]


def collapse_boxes(df: DataFrame, idx: str, same: Sequence[str] = (), image: str = "image_id") -> DataFrame:
    """Fold copies of a box (equal in ``same`` too) into the one with the lowest index and a count ``n``.

    Copies have the same IoU with everything and ties go to the lowest index, so
    the others can never be a best match; ``n`` keeps their weight.
    """
    return df.groupBy(image, *BOX, *same).agg(F.min(idx).alias(idx), F.count(F.lit(1)).alias("n"))


def meeting_boxes(a: DataFrame, b: DataFrame, by: Sequence[str], a_id: str, b_id: str, cell: int = 512,
                  reach: int = 0, keep_a: Sequence[str] = (), keep_b: Sequence[str] = ()) -> DataFrame:
    """Pairs whose boxes share a pixel, or come within ``reach`` pixels on both axes.

    Boxes are listed in every grid cell they cover and meet on (key, cell); a
    pair that shares several cells is kept in the cell of its top-left common
    corner.  Boxes of ``b`` come out as bx0..by1, those of ``a`` as ax0..ay1.
    """
    def listed(df: DataFrame, tag: str, ident: str, keep: Sequence[str], grow: int) -> DataFrame:
        box = [F.col(c).alias(f"{tag}{c}") for c in BOX]
        return (df.select(*by, F.col(ident), *keep, *box)
                .withColumn("_gx", F.explode(F.sequence(F.floor((F.col(f"{tag}x0") - grow) / cell), F.floor((F.col(f"{tag}x1") + grow) / cell))))
                .withColumn("_gy", F.explode(F.sequence(F.floor((F.col(f"{tag}y0") - grow) / cell), F.floor((F.col(f"{tag}y1") + grow) / cell)))))

    left, right = listed(a, "a", a_id, keep_a, reach), listed(b, "b", b_id, keep_b, 0)
    met = skew_join(left, right, [*by, "_gx", "_gy"], [a_id], [b_id])
    corner_x = F.greatest(F.col("ax0") - reach, F.col("bx0"))
    corner_y = F.greatest(F.col("ay0") - reach, F.col("by0"))
    near = ((corner_x <= F.least(F.col("ax1") + reach, F.col("bx1"))) & (corner_y <= F.least(F.col("ay1") + reach, F.col("by1"))))
    return met.where(near & (F.col("_gx") == F.floor(corner_x / cell)) & (F.col("_gy") == F.floor(corner_y / cell))).drop("_gx", "_gy")


def box_pairs(gt: DataFrame, preds: DataFrame, image: str = "image_id", gt_idx: str = "gt_idx", q_idx: str = "q_idx",
              cell: int = 512, keep_gt: Sequence[str] = (), keep_pred: Sequence[str] = ()) -> DataFrame:
    """Overlapping (ground truth, prediction) boxes of each image with their IoU."""
    met = meeting_boxes(gt, preds, [image], gt_idx, q_idx, cell, keep_a=keep_gt, keep_b=keep_pred)
    iou = box_iou(*[F.col(f"a{c}") for c in BOX], *[F.col(f"b{c}") for c in BOX])
    return met.select(image, gt_idx, q_idx, *keep_gt, *keep_pred, iou.alias("iou"))


def best_match_per_gt(pairs: DataFrame, by: Sequence[str] = ("image_id", "gt_idx"), q_idx: str = "q_idx") -> DataFrame:
    """Prediction with the highest IoU for each ground truth; ties go to the lowest index."""
    best = F.min(F.struct((-F.col("iou")).alias("neg"), F.col(q_idx).alias("q")))
    return pairs.groupBy(*by).agg(best.alias("_b")).select(*by, F.col("_b.q").alias(q_idx), (-F.col("_b.neg")).alias("iou"))


def claim_matches(best: DataFrame, iou_t: float = 0.5, by: Sequence[str] = ("image_id",), gt_idx: str = "gt_idx",
                  q_idx: str = "q_idx") -> DataFrame:
    """True positives: each prediction serves the first ground truth that has it as its best.

    A ground truth whose best prediction is taken gets no second choice.
    """
    winner = F.min(F.struct(F.col(gt_idx).alias("g"), F.col("iou").alias("iou")))
    return (best.where(F.col("iou") >= iou_t).groupBy(*by, q_idx).agg(winner.alias("_w"))
            .select(*by, q_idx, F.col("_w.g").alias(gt_idx), F.col("_w.iou").alias("iou")))


def best_gt_per_pred(kept: DataFrame, gt: DataFrame, pairs: DataFrame, image: str = "image_id") -> DataFrame:
    """Ground truth with the highest IoU for each kept prediction, over all of its image.

    Without any overlap all IoUs are 0 and the lowest index wins.  Adds
    ``best_gt``, ``best_ref_match`` and ``n_wanted`` of the image; images without
    ground truth drop out.
    """
    weight = F.col("n") if "n" in gt.columns else F.lit(1)
    first = gt.groupBy(image).agg(F.min("gt_idx").alias("_first_gt"), F.min_by("ref_match", "gt_idx").alias("_first_match"),
                                  F.sum(weight * F.col("ref_match")).alias("n_wanted"))
    labelled = pairs if "ref_match" in pairs.columns else pairs.join(gt.select(image, "gt_idx", "ref_match"), [image, "gt_idx"])
    best = labelled.groupBy(image, "q_idx").agg(F.min(F.struct(
        (-F.col("iou")).alias("neg"), F.col("gt_idx").alias("g"), F.col("ref_match").alias("m"))).alias("_best"))
    placed = attach(kept, first, [image], ["q_idx"], how="inner").join(best, [image, "q_idx"], "left")
    return placed.select(*kept.columns, F.coalesce("_best.g", "_first_gt").alias("best_gt"),
                         F.coalesce("_best.m", "_first_match").alias("best_ref_match"), "n_wanted")


def overlap_pairs(rects: DataFrame, image: str = "image_id", ident: str = "gt_idx", cell: int = 512) -> DataFrame:
    """Pairs of rectangles of an image (continuous ends) with a positive common area."""
    met = meeting_boxes(rects, rects.withColumnRenamed(ident, "other"), [image], ident, "other", cell)
    area = rect_intersection_area(*[F.col(f"a{c}") for c in BOX], *[F.col(f"b{c}") for c in BOX])
    return met.where(F.col(ident) < F.col("other")).select(image, ident, "other", area.alias("area")).where(F.col("area") > 0)


def shared_edges(rects: DataFrame, image: str = "image_id", ident: str = "gt_idx", bin_width: int = 512,
                 rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """Pairs of rectangles that share part of an edge: equal coordinate, positive overlap along it.

    The rectangles of an image are brought together in one row, and many images
    go through one call; in images with more than a row should hold, sides meet
    on (image, axis, coordinate, bin along the edge).
    """
    whole = rects.select(image, ident, *BOX)
    (small,), large = parted([whole.dropna()], [image], rows_per_group)
    packed = packed_by(small, [image], ident, *BOX)

    def touching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_load(batches, lambda b: sizes(b.column("members")) ** 2):
            row, (names, *box) = members(batch.column("members"))
            at, a, b = shared_sides(row, names, box, sizes(batch.column("members")))
            kind = batch.schema.field("members").type.value_type.field(ident).type
            yield pa.record_batch([batch.column(image).take(pa.array(at)), pa.array(a, kind), pa.array(b, kind)], names=[image, ident, "other"])

    out = packed.mapInArrow(touching, f"{fields(whole, [image, ident])}, other {whole.schema[ident].dataType.simpleString()}")
    return out if large is None else out.unionByName(_joined_edges(large[0], image, ident, bin_width))


def _joined_edges(rects: DataFrame, image: str, ident: str, bin_width: int) -> DataFrame:
    def sides(far: bool, out: str) -> DataFrame:
        v = F.struct(F.lit("v").alias("axis"), F.col("x1" if far else "x0").alias("at"), F.col("y0").alias("lo"), F.col("y1").alias("hi"))
        h = F.struct(F.lit("h").alias("axis"), F.col("y1" if far else "y0").alias("at"), F.col("x0").alias("lo"), F.col("x1").alias("hi"))
        s = rects.select(image, F.col(ident).alias(out), F.explode(F.array(v, h)).alias("s"))
        return (s.select(image, out, F.col("s.axis").alias("axis"), F.col("s.at").alias("at"),
                         F.col("s.lo").alias(f"_{out}_lo"), F.col("s.hi").alias(f"_{out}_hi"))
                .withColumn("_bin", F.explode(F.sequence(F.floor(F.col(f"_{out}_lo") / bin_width), F.floor(F.col(f"_{out}_hi") / bin_width)))))

    met = skew_join(sides(True, "a"), sides(False, "b"), [image, "axis", "at", "_bin"], ["a"], ["b"])
    lo, hi = F.greatest("_a_lo", "_b_lo"), F.least("_a_hi", "_b_hi")
    touching = met.where((lo < hi) & (F.col("_bin") == F.floor(lo / bin_width)) & (F.col("a") != F.col("b")))
    return touching.select(image, F.least("a", "b").alias(ident), F.greatest("a", "b").alias("other")).distinct()


def semi_by_membership(df: DataFrame, members: DataFrame, keys: Sequence[str], ids: Sequence[str], keep: bool = True) -> DataFrame:
    """Rows whose key is (or is not) among ``members``; hot keys are split."""
    unique = members.select(*keys).distinct()
    return attach(df, unique, keys, ids, how="left_semi" if keep else "left_anti")


# ---------------------------------------------------------------- nearest neighbours


#: Pivots of a key at most; rows of a block.
PIVOTS, BLOCK_ROWS = 64, 2048


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by one matrix product; off by rounding of about 1e-13 of the squared lengths."""
    return np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T))


def _cells(df: DataFrame, ident: str, pivots: DataFrame, by: Sequence[str], block_rows: int) -> DataFrame:
    """``df`` (by, ident, vector) with the nearest pivot of its key (_pivot), the distance to it (_far) and a block of about ``block_rows`` rows of that cell."""
    kinds = f"{', '.join(f'`{b}` {df.schema[b].dataType.simpleString()}' for b in by)}, {ident} bigint, vector array<double>, _pivot int, _far double"
    part = F.pmod(hash_bits(17, ident), F.greatest(F.lit(1), F.ceil(F.col("_n") / block_rows))).cast("int")
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    dealt = attach(df, sizes, by, [ident], how="inner").withColumn("_part", part)
    parts = dealt.groupBy(*by).agg(F.max("_part").alias("_last"))
    sent = pivots.join(parts, list(by)).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_last"))))

    def place(key: tuple, rows: pa.Table, centres: pa.Table) -> pa.Table:
        if not rows.num_rows:
            near, far = np.zeros(0, np.int32), np.zeros(0)
        else:
            d = _distances(_matrix(rows["vector"]), _matrix(centres["centre"]))
            near = d.argmin(axis=1)
            far = np.sqrt(d[np.arange(len(d)), near])
        return pa.table({**{c: rows[c] for c in (*by, ident, "vector")}, "_pivot": pa.array(centres["_pivot"].to_numpy()[near] if len(near) else near, pa.int32()), "_far": far})

    group = [*by, "_part"]
    placed = settle(dealt.groupBy(*group).cogroup(sent.groupBy(*group)).applyInArrow(place, kinds))
    sizes = placed.groupBy(*by, "_pivot").agg(F.count(F.lit(1)).alias("_n"))
    return attach(placed, sizes, [*by, "_pivot"], [ident], how="inner").withColumn("_block", part).drop("_n")


def block_pairs(queries: DataFrame, corpus: DataFrame, pivots: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """The pairs of blocks (by, _qp, _qb, _cp, _cb) that can hold one of the k nearest of some query.

    By the triangle inequality a block of the corpus lies at least
    |pivots| - both radii and at most |pivots| + both radii from every query of a
    block; it is visited unless k corpus vectors are surely nearer.
    """
    shape = lambda df, p, b, r: df.groupBy(*by, F.col("_pivot").alias(p), F.col("_block").alias(b)).agg(F.max("_far").alias(r), F.count(F.lit(1)).alias(f"{r}_n"))
    q, c = shape(queries, "_qp", "_qb", "_qr"), shape(corpus, "_cp", "_cb", "_cr")
    one, two = (pivots.select(*by, F.col("_pivot").alias(p), F.col("centre").alias(v)) for p, v in (("_qp", "_v"), ("_cp", "_w")))
    apart = F.sqrt(F.aggregate(F.zip_with("_v", "_w", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    between = one.join(two, list(by)).select(*by, "_qp", "_cp", apart.alias("_d"))  # PIVOTS squared rows of a key at most
    met = q.join(between, [*by, "_qp"]).join(c, [*by, "_cp"])
    slack = 1e-9 * (1 + F.col("_d") + F.col("_qr") + F.col("_cr"))
    bounds = met.select(*by, "_qp", "_qb", "_cp", "_cb", "_cr_n", (F.col("_d") - F.col("_qr") - F.col("_cr") - slack).alias("_least"),
                        (F.col("_d") + F.col("_qr") + F.col("_cr") + slack).alias("_most"))
    nearer = Window.partitionBy(*by, "_qp", "_qb").orderBy("_most").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    limit = Window.partitionBy(*by, "_qp", "_qb")
    enough = bounds.withColumn("_sure", F.sum("_cr_n").over(nearer)).withColumn("_limit", F.min(F.when(F.col("_sure") >= k, F.col("_most"))).over(limit))
    return enough.where(F.col("_limit").isNull() | (F.col("_least") <= F.col("_limit"))).select(*by, "_qp", "_qb", "_cp", "_cb")


def topk_nearest(queries: DataFrame, corpus: DataFrame, k: int = 8, by: Sequence[str] = (), block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """The k corpus vectors with the smallest squared distance to each query vector, exactly.

    ``queries``: key, query_id, vector; ``corpus``: key, vec_id, vector.  Every
    vector goes to the cell of the nearest of some corpus vectors drawn by hash
    (``pivots`` of a key at most), cells are cut into blocks, and only pairs of
    blocks that :func:`block_pairs` cannot rule out meet, each in a task of its
    own: one matrix product, whose k smallest per query and all within its
    rounding are computed again difference by difference.  Only the k best of a
    block leave it; a second step merges them.  Ties go to the lowest vec_id.
    """
    if not by:
        queries, corpus, by = queries.withColumn("_all", F.lit(0)), corpus.withColumn("_all", F.lit(0)), ["_all"]
    by = list(by)
    vector = F.col("vector").cast("array<double>").alias("vector")
    queries = queries.select(*by, F.col("query_id").cast("bigint").alias("query_id"), vector)
    corpus = corpus.select(*[F.col(n).alias(n) for n in by], F.col("vec_id").cast("bigint").alias("vec_id"), vector)  # fresh column ids: both sides may be one table
    drawn = corpus.groupBy(*by).agg(F.slice(F.sort_array(F.collect_list(F.when(hash_bits(23, "vec_id") < _share(corpus, by, pivots), F.struct(hash_bits(23, "vec_id").alias("h"), "vec_id", "vector")))), 1, pivots).alias("p"))
    first = corpus.groupBy(*by).agg(F.min(F.struct(hash_bits(23, "vec_id").alias("h"), "vec_id", "vector")).alias("f"))  # a key may have drawn none
    centres = settle(drawn.join(first, by).select(*by, F.posexplode(F.when(F.size("p") > 0, F.col("p")).otherwise(F.array("f"))).alias("_pivot", "c")).select(*by, "_pivot", F.col("c.vector").alias("centre")))
    q, c = _cells(queries, "query_id", centres, by, block_rows), _cells(corpus, "vec_id", centres, by, block_rows)
    pairs = settle(block_pairs(q, c, centres, by, k))
    group = [*by, "_qp", "_qb", "_cp", "_cb"]
    q = skew_join(q.withColumnsRenamed({"_pivot": "_qp", "_block": "_qb"}).drop("_far"), pairs, [*by, "_qp", "_qb"], ["query_id"])
    c = skew_join(c.withColumnsRenamed({"_pivot": "_cp", "_block": "_cb"}).drop("_far"), pairs, [*by, "_cp", "_cb"], ["vec_id"])
    kinds = ", ".join(f"`{b}` {q.schema[b].dataType.simpleString()}" for b in by)

    def nearest(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({**{b: left[b][:0] for b in by}, "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        right = right.sort_by("vec_id")
        a, b, ids = _matrix(left["vector"]), _matrix(right["vector"]), right["vec_id"].to_numpy()
        rough = _distances(a, b)
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1] if rough.shape[1] > k else np.full(len(a), np.inf)
        margin = 1e-9 * ((a * a).sum(1) + (b * b).sum(1).max())
        i, j = np.nonzero(rough <= (limit + margin)[:, None])
        exact = ((b[j] - a[i]) ** 2).sum(axis=1)
        order = np.lexsort((j, exact, i))
        i, j, exact = i[order], j[order], exact[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, exact = i[rank < k], j[rank < k], exact[rank < k]
        return pa.table({**{name: left[name].take(pa.array(i)) for name in by}, "query_id": left["query_id"].take(pa.array(i)), "vec_id": ids[j], "dist": exact})

    found = q.groupBy(*group).cogroup(c.groupBy(*group)).applyInArrow(nearest, f"{kinds}, query_id bigint, vec_id bigint, dist double")
    # At most k rows per visited block reach the merge; row_number <= k lets Spark
    # cut every query to k rows before the shuffle as well.
    w = Window.partitionBy(*by, "query_id").orderBy("dist", "vec_id")
    merged = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return merged.select(*by, "query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", "dist").drop("_all")


def _share(corpus: DataFrame, by: Sequence[str], pivots: int) -> int:
    """Hashes below this draw some ``pivots`` vectors of the largest key; smaller keys get fewer, as they need."""
    largest = corpus.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    return min(1 << 32, (1 << 32) * pivots // largest)


def pick_neighbour(nearest: DataFrame, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """One of the k nearest per query, drawn by hash."""
    choice = F.min(F.struct(hash_bits(seed, "query_id", "rank").alias("h"), F.col("rank").alias("rank"),
                            F.col("vec_id").alias("vec_id"), F.col("dist").alias("dist")))
    return nearest.groupBy(*by, "query_id").agg(choice.alias("_c")).select(
        *by, "query_id", F.col("_c.rank").alias("rank"), F.col("_c.vec_id").alias("vec_id"), F.col("_c.dist").alias("dist"))


# ---------------------------------------------------------------- matching cost and assignment


#: Points, queries and ground truths of a block of the matrix product: at most 16 MB of doubles on either side.
POINT_BLOCK, ROW_BLOCK = 4096, 512
#: Entries of either side that one task's call takes together, on average.
ENTRIES_AT_ONCE = 500_000
#: Meetings of points that weigh as much as one entry.
MEETINGS_OF_ENTRY = 100


def _point_products(pred_points: DataFrame, gt_points: DataFrame) -> DataFrame:
    """image_id, q_idx, gt_idx, xg = sum of logit * value, pg = sum of sigmoid(logit) * value, one row per pair and block of points.

    Both sides are packed into (image, block of points, blocks of queries and of
    ground truths).  The blocks of an image are as many as its rows ask for,
    whatever their numbers are, and many small meetings go through one call.
    """
    truths = gt_points.where(F.col("value") > 0)

    def packed(df: DataFrame, row: str, value: str, block: str) -> tuple[DataFrame, DataFrame]:
        placed = df.where(~has_null(["point_id", value])).select("image_id", F.floor(F.col("point_id") / POINT_BLOCK).cast("bigint").alias("_pb"), F.col(row).cast("bigint").alias(row),
                           F.pmod("point_id", F.lit(POINT_BLOCK)).cast("int").alias("p"), F.col(value).cast("double").alias("v"))
        rows = settle(placed.groupBy("image_id", "_pb", row).agg(F.collect_list("p").alias("ps"), F.collect_list("v").alias("vs")))  # POINT_BLOCK points in a row at most
        blocks = rows.groupBy("image_id", "_pb").agg(F.ceil(F.count(F.lit(1)) / ROW_BLOCK).cast("int").alias(f"{block}s"))
        dealt = attach(rows, blocks, ["image_id", "_pb"], [row], how="inner")
        return dealt.withColumn(block, F.pmod(hash_bits(29, row), F.col(f"{block}s")).cast("int")), blocks

    (q, q_blocks), (g, g_blocks) = packed(pred_points, "q_idx", "logit", "_qb"), packed(truths, "gt_idx", "value", "_gb")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = attach(q.drop("_qbs"), g_blocks, ["image_id", "_pb"], ["q_idx"], how="inner").withColumn("_gb", each("_gbs")).drop("_gbs")
    g = attach(g.drop("_gbs"), q_blocks, ["image_id", "_pb"], ["gt_idx"], how="inner").withColumn("_qb", each("_qbs")).drop("_qbs")
    keys = ["image_id", "_pb", "_qb", "_gb"]
    entries = q.agg(F.sum(F.size("ps"))).first()[0] or 0
    together = F.pmod(hash_bits(31, *keys), F.lit(-(-entries // ENTRIES_AT_ONCE) or 1)).cast("bigint").alias("_call")
    q, g = q.select(together, *keys, "q_idx", "ps", "vs"), g.select(together, *keys, "gt_idx", "ps", "vs")
    kinds = ", ".join(f"{c} {t}" for c, t in (("image_id", q.schema["image_id"].dataType.simpleString()), ("q_idx", "bigint"), ("gt_idx", "bigint"), ("xg", "double"), ("pg", "double")))

    def side(table: pa.Table, row: str) -> tuple[np.ndarray, ...]:
        """Names of the rows, how many entries each has, and the points and values of all."""
        places = table["ps"].combine_chunks()
        return table[row].to_numpy(), np.asarray(places.value_lengths()).astype(np.int64), np.asarray(places.flatten()), np.asarray(table["vs"].combine_chunks().flatten())

    def product(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[] for _ in range(4)]
        if left.num_rows and right.num_rows:
            left, right = (t.append_column("_at", pa.array(np.arange(t.num_rows))) for t in (left, right))
            left, right = left.sort_by([(k, "ascending") for k in keys]), right.sort_by([(k, "ascending") for k in keys])
            qs, qn, qp, qv = side(left, "q_idx")
            gs, gn, gp, gv = side(right, "gt_idx")
            names = [pa.concat_arrays([left[k].combine_chunks(), right[k].combine_chunks()]).dictionary_encode().indices.to_numpy() for k in keys]
            codes = np.unique(np.column_stack(names), axis=0, return_inverse=True)[1].ravel()
            q_code, g_code = codes[:len(qs)], codes[len(qs):]
            # Equal codes stand together on either side, since both are in the order of the keys.
            q_first, g_first = (np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) for c in (q_code, g_code))
            g_where = {int(g_code[i]): (i, j) for i, j in zip(g_first, np.r_[g_first[1:], len(gs)])}
            q_at, g_at = (np.r_[0, np.cumsum(n)] for n in (qn, gn))
            sure = 1 / (1 + np.exp(-np.clip(qv, -700, 700)))
            for i, j in zip(q_first, np.r_[q_first[1:], len(qs)]):
                k, m = g_where.get(int(q_code[i]), (0, 0))
                if k == m:
                    continue
                mine, theirs = slice(q_at[i], q_at[j]), slice(g_at[k], g_at[m])
                points, column = np.unique(gp[theirs], return_inverse=True)  # only where some ground truth is
                v = np.zeros((m - k, len(points)))
                np.add.at(v, (np.repeat(np.arange(m - k), gn[k:m]), column), gv[theirs])
                place = np.minimum(np.searchsorted(points, qp[mine]), len(points) - 1)
                here = points[place] == qp[mine]
                cells = (np.repeat(np.arange(j - i), qn[i:j]) * len(points) + place)[here]
                matrix = lambda weights: np.bincount(cells, weights, (j - i) * len(points)).reshape(j - i, len(points)) @ v.T  # noqa: B023, E731
                met = matrix(sure[mine][here])
                a, b = np.nonzero(met)
                for part, values in zip(out, (a + i, b + k, matrix(qv[mine][here])[a, b], met[a, b])):
                    part.append(values)
        i, j = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in out[:2])
        xg, pg = (np.concatenate(p) if p else np.zeros(0) for p in out[2:])
        if not len(i):
            return pa.table({"image_id": left["image_id"][:0], "q_idx": pa.array([], pa.int64()), "gt_idx": pa.array([], pa.int64()), "xg": xg, "pg": pg})
        return pa.table({"image_id": left["image_id"].take(pa.array(i)), "q_idx": qs[i], "gt_idx": gs[j], "xg": xg, "pg": pg})

    return q.groupBy("_call").cogroup(g.groupBy("_call")).applyInArrow(product, kinds)


def _costs(preds: DataFrame, pred_points: DataFrame, gt_points: DataFrame, weights: tuple[float, float, float], rows_per_group: int,
           lists: bool) -> tuple[DataFrame, DataFrame | None]:
    """Costs of the images whose points a row may hold (one row a pair, or with ``lists`` an image), and of the larger ones."""
    preds, frames = preds.select("image_id", "q_idx", "logit0", "logit1"), (pred_points.select("image_id", "q_idx", "point_id", "logit"), gt_points.select("image_id", "gt_idx", "point_id", "value"))
    keys = [f.select("image_id", F.lit(q).alias("_q"), F.lit(g).alias("_g"), has_null(f.columns).alias("_odd")) for f, q, g in zip((preds, *frames), (0, 1, 0), (0, 0, 1))]
    n_q, n_g = F.sum("_q"), F.sum("_g")
    counted = settle(reduce(DataFrame.unionByName, keys).groupBy("image_id").agg(
        (n_q + n_g).alias("_n"), F.greatest(n_q, n_g, n_q * n_g / MEETINGS_OF_ENTRY).alias("_load"), F.max("_odd").alias("_odd")))
    (small, q, g), large = parted([preds, *frames], ["image_id"], rows_per_group, nulls=True, counted=counted)
    load = counted.where(F.col("_n") <= rows_per_group).agg(F.sum("_load")).first()[0] or 0
    forget(counted)
    together = F.pmod(hash_bits(31, "image_id"), F.lit(int(load // ENTRIES_AT_ONCE) + 1)).cast("bigint").alias("_call")

    def side(df: DataFrame, ident: str, value: Column, score: bool = False) -> DataFrame:
        rows = df.select("image_id", F.col(ident).cast("bigint").alias(ident), *[] if score else [F.col("point_id").cast("bigint").alias("point_id")], value.cast("double").alias("_v"))
        packed = batched_by(rows, ["image_id"], *rows.columns[1:])
        return packed.select(together, "image_id", ident, (F.lit(None).cast("binary") if score else F.col("point_id")).alias("point_id"), "_v")

    left = side(q, "q_idx", F.col("logit")).unionByName(side(small, "q_idx", foreground_score(F.col("logit0"), F.col("logit1")), True))  # a score is no point
    right = side(g, "gt_idx", F.col("value"))
    kinds = {"image_id": pred_points.schema["image_id"].dataType, "q_idx": pred_points.schema["q_idx"].dataType, "gt_idx": gt_points.schema["gt_idx"].dataType}
    kinds = [*((n, k.simpleString()) for n, k in kinds.items()), ("cost", "double")]
    if lists:
        kinds = [kinds[0], *((n, f"array<{k}>") for n, k in kinds[1:])]
    schema = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in T.StructType.fromDDL(", ".join(f"{n} {k}" for n, k in kinds)).fields])

    def product(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        images = pa.concat_arrays([left["image_id"].combine_chunks(), right["image_id"].combine_chunks()]).dictionary_encode()
        rows = np.split(images.indices.to_numpy(), [left.num_rows])

        def points(table: pa.Table, row: np.ndarray, ident: str, score: bool = False) -> list[np.ndarray]:
            only = table["point_id"].is_null().to_numpy() == score
            table = table.filter(pa.array(only)).combine_chunks()
            flat = {c: numbers(table[c].combine_chunks(), kind) for c, kind in ((ident, np.int64), ("point_id", np.int64), ("_v", np.float64)) if c != "point_id" or not score}
            return [np.repeat(row[only], flat[ident][0]), *(values for _, values in flat.values())]

        found = list(point_costs(points(left, rows[0], "q_idx"), points(right, rows[1], "gt_idx"), points(left, rows[0], "q_idx", True), weights))
        row, *columns = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), *[np.zeros(0)] * 3)
        if not lists:
            arrays = [images.dictionary.take(pa.array(row)), *map(pa.array, columns)]
        else:
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
            ends = pa.array(np.r_[first, len(row)], pa.int32())
            arrays = [images.dictionary.take(pa.array(row[first])), *[pa.ListArray.from_arrays(ends, pa.array(c)) for c in columns]]
        return pa.table([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)

    out = left.groupBy("_call").cogroup(right.groupBy("_call")).applyInArrow(product, ", ".join(f"{n} {k}" for n, k in kinds))
    return out, None if large is None else _joined_costs(*large, weights)


def match_cost(preds: DataFrame, pred_points: DataFrame, gt_points: DataFrame, weights: tuple[float, float, float] = (2.0, 5.0, 5.0),
               rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """Cost of every (query, ground truth) of an image: -class, point BCE and point dice, weighted.

    ``preds``: image_id, q_idx, logit0, logit1; ``pred_points``: image_id, q_idx,
    point_id, logit; ``gt_points``: image_id, gt_idx, point_id, value in [0, 1].
    BCE(x, g) = softplus(x) - x*g, so the sums over all points are one number
    per query, and what both sides share is summed where their points meet.

    Points are packed where they stand and shuffled once, many images go through
    one call.  Images with more points than a row should hold go through matrix
    products of blocks (:func:`_point_products`): no row holds a point of a pair.
    """
    out, large = _costs(preds, pred_points, gt_points, weights, rows_per_group, False)
    return out if large is None else out.unionByName(large)


def _joined_costs(preds: DataFrame, pred_points: DataFrame, gt_points: DataFrame, weights: tuple[float, float, float]) -> DataFrame:
    p = sigmoid(F.col("logit"))
    per_query = pred_points.groupBy("image_id", "q_idx").agg(
        F.count(F.lit(1)).alias("_points"), F.sum(softplus(F.col("logit"))).alias("_soft"), F.sum(p).alias("_psum"))
    per_query = per_query.join(preds.select("image_id", "q_idx", foreground_score(F.col("logit0"), F.col("logit1")).alias("_fg")),
                               ["image_id", "q_idx"])
    per_gt = gt_points.groupBy("image_id", "gt_idx").agg(F.sum("value").alias("_gsum"))
    common = _point_products(pred_points, gt_points).groupBy("image_id", "q_idx", "gt_idx").agg(F.sum("xg").alias("_xg"), F.sum("pg").alias("_pg"))
    pairs = skew_join(per_query, per_gt, ["image_id"], ["q_idx"], ["gt_idx"]).join(
        common, ["image_id", "q_idx", "gt_idx"], "left").na.fill(0.0, ["_xg", "_pg"])
    bce = (F.col("_soft") - F.col("_xg")) / F.col("_points")
    dice = 1.0 - (2.0 * F.col("_pg") + 1.0) / (F.col("_psum") + F.col("_gsum") + 1.0)
    w_class, w_bce, w_dice = weights
    return pairs.select("image_id", "q_idx", "gt_idx", (F.col("_fg") * -w_class + bce * w_bce + dice * w_dice).alias("cost"))


def _greedy(packed: DataFrame) -> DataFrame:
    """The pairs that stay of images in one row: image_id, and lists q_idx, gt_idx, cost."""
    names = ["image_id", "q_idx", "gt_idx", "cost"]

    def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_load(batches, lambda b: sizes(b.column("cost"))):
            row = np.repeat(np.arange(batch.num_rows), sizes(batch.column("cost")))
            flat = [batch.column(c).flatten() for c in names[1:]]
            stay = greedy_pairs(row, *[c.to_numpy(zero_copy_only=False) for c in flat])
            yield pa.record_batch([batch.column("image_id").take(pa.array(row[stay])), *[c.take(pa.array(stay)) for c in flat]], names=names)

    kinds = ", ".join(f"{c} {packed.schema[c].dataType.elementType.simpleString()}" for c in names[1:])
    return packed.select(*names).mapInArrow(fix, f"{fields(packed, ['image_id'])}, {kinds}")


def assign_one_to_one(costs: DataFrame, rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """One-to-one pairs by ascending cost (greedy; ties by q_idx, gt_idx), not the optimal assignment.

    The pairs of an image are brought together in one row and walked there.  In
    images with more pairs than a row should hold, pairs that are the cheapest
    for both of their sides are fixed together, their rows leave the table, and
    the rest repeats; every round at least the cheapest pair of each image is fixed.
    """
    names = ["image_id", "q_idx", "gt_idx", "cost"]
    (small,), large = parted([settle(costs.select(*names))], ["image_id"], rows_per_group, nulls=True)
    out = _greedy(small.groupBy("image_id").agg(*[F.collect_list(c).alias(c) for c in names[1:]]))
    return out if large is None else out.unionByName(_assigned_in_rounds(*large).select(*names))


def match_one_to_one(preds: DataFrame, pred_points: DataFrame, gt_points: DataFrame, weights: tuple[float, float, float] = (2.0, 5.0, 5.0),
                     rounded: int | None = None, rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """:func:`assign_one_to_one` of :func:`match_cost`, to ``rounded`` places; the costs of an image are walked where they are made."""
    cost = lambda c: c if rounded is None else F.round(c, rounded)
    packed, large = _costs(preds, pred_points, gt_points, weights, rows_per_group, True)
    out = _greedy(packed.withColumn("cost", F.transform("cost", cost)))
    return out if large is None else out.unionByName(assign_one_to_one(large.withColumn("cost", cost(F.col("cost"))), rows_per_group))


def _assigned_in_rounds(costs: DataFrame) -> DataFrame:
    order = F.struct("cost", "q_idx", "gt_idx")
    state = settle(costs.select("image_id", "q_idx", "gt_idx", "cost"))
    fixed = None
    while not state.isEmpty():
        by_q = state.groupBy("image_id", "q_idx").agg(F.min(order).alias("_b")).select("image_id", "_b.*")
        by_g = state.groupBy("image_id", "gt_idx").agg(F.min(order).alias("_b")).select("image_id", "_b.*")
        chosen = settle(by_q.join(by_g, ["image_id", "q_idx", "gt_idx", "cost"]))
        fixed = chosen if fixed is None else fixed.unionByName(chosen)
        before, state = state, state.join(chosen.select("image_id", "q_idx"), ["image_id", "q_idx"], "left_anti")
        state = settle(state.join(chosen.select("image_id", "gt_idx"), ["image_id", "gt_idx"], "left_anti"))
        forget(before)
    return fixed if fixed is not None else state


def connected_groups(edges: DataFrame, nodes: DataFrame, by: Sequence[str], ident: str, other: str,
                     rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """Smallest node id reachable from each node, as ``group_id``; a node without a key or id is a group of its own.

    Nodes and edges of a key are brought together in one row, and many keys go
    through one call.  Keys with more than a row should hold, and a table without
    keys, go in rounds: a node takes the smallest label among its neighbours and
    then the label of that label, so long chains halve each time.
    """
    if not by:
        return _groups_in_rounds(edges, nodes, by, ident, other)
    kept = nodes.select(*by, ident).dropna()
    alone = nodes.select(*by, ident).where(reduce(or_, [F.col(c).isNull() for c in [*by, ident]])).distinct().withColumn("group_id", F.col(ident))
    links = settle(edges.select(*by, ident, other).dropna())  # read twice
    (links, kept), large = parted([links, kept], by, rows_per_group)
    rows = links.select(*by, F.col(ident).alias("u"), F.col(other).alias("v"), F.lit(False).alias("node")).unionByName(
        kept.select(*by, F.col(ident).alias("u"), F.col(ident).alias("v"), F.lit(True).alias("node")))
    packed, keys = packed_by(rows, by, "u", "v", "node"), list(by)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_load(batches, lambda b: sizes(b.column("members"))):
            row, (u, v, node) = members(batch.column("members"))
            at, name, least = smallest_reachable(row, u, v, node.astype(bool))
            kind, owner = batch.schema.field("members").type.value_type.field("u").type, pa.array(at)
            yield pa.record_batch([*[batch.column(k).take(owner) for k in keys], pa.array(name, kind), pa.array(least, kind)], names=[*keys, ident, "group_id"])

    out = packed.mapInArrow(reach, f"{fields(nodes, [*by, ident])}, group_id {nodes.schema[ident].dataType.simpleString()}")
    out = out.unionByName(alone)
    return out if large is None else out.unionByName(_groups_in_rounds(*large, by, ident, other))


def _groups_in_rounds(edges: DataFrame, nodes: DataFrame, by: Sequence[str], ident: str, other: str) -> DataFrame:
    both = edges.select(*by, F.col(ident).alias("u"), F.col(other).alias("v")).unionByName(
        edges.select(*by, F.col(other).alias("u"), F.col(ident).alias("v"))).distinct()
    both = settle(both)
    start = nodes.select(*by, F.col(ident).alias("u")).distinct().withColumn("label", F.col("u")).withColumn("moved", F.lit(True))

    def step(state: DataFrame) -> DataFrame:
        labels = state.select(*by, F.col("u").alias("v"), F.col("label").alias("l"))
        seen = attach(both, labels, [*by, "v"], ["u"], how="inner").groupBy(*by, "u").agg(F.min("l").alias("l"))
        lower = state.join(seen, [*by, "u"], "left").select(*by, "u", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        jump = lower.select(*by, F.col("u").alias("label"), F.col("label").alias("jumped"))
        done = attach(lower, jump, [*by, "label"], ["u"])
        new = F.least("label", "jumped")
        return done.select(*by, "u", new.alias("label"), (new < F.col("old")).alias("moved"))

    state = until_stable(start, step, lambda s: F.col("moved"))
    return state.select(*by, F.col("u").alias(ident), F.col("label").alias("group_id"))


# ---------------------------------------------------------------- tiles and review pairs


def join_tiles(annotations: DataFrame, tiles: DataFrame) -> DataFrame:
    """Annotations with the tile they were filled from; ``tile_found`` is false for orphans."""
    known = tiles.select("tile_file", F.col("category_id").alias("tile_category_id"), F.lit(True).alias("_found"))
    joined = attach(annotations, known.withColumnRenamed("tile_file", "reference_tile"), ["reference_tile"], ["image_id", "ann_idx"])
    return joined.withColumn("tile_found", F.coalesce("_found", F.lit(False))).drop("_found")


def orphan_annotations(annotations: DataFrame, tiles: DataFrame) -> DataFrame:
    return attach(annotations, tiles.select(F.col("tile_file").alias("reference_tile")).distinct(), ["reference_tile"],
                  ["image_id", "ann_idx"], how="left_anti")


def safe_name(col: Column) -> Column:
    """File-name form of a title: letters, digits, '-', '_' stay, blanks and dots turn to '_', the rest goes."""
    mapped = F.regexp_replace(F.regexp_replace(col, "[ .]", "_"), r"[^\p{L}\p{N}_-]", "")
    cut = F.substring(F.regexp_replace(mapped, "^_+|_+$", ""), 1, 80)
    return F.when(cut == "", F.lit("pair")).otherwise(cut)


def review_pair_check(manifest: DataFrame) -> DataFrame:
    """Per run: rows, distinct reals and synths, one-to-one flag and rows with a wrong picture name."""
    expected = F.format_string("%03d_%s.png", F.col("pair_id").cast("int"), safe_name(F.col("real_filename")))
    return manifest.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("real_filename").alias("n_real"),
        F.count_distinct("synth_filename").alias("n_synth"),
        F.sum((F.col("pair_image") != expected).cast("bigint")).alias("bad_names"),
    ).withColumn("one_to_one", (F.col("n_pairs") == F.col("n_real")) & (F.col("n_pairs") == F.col("n_synth")))


def cross_run_pairs(manifests: DataFrame, runs: Sequence[str]) -> DataFrame:
    """One row per real picture with the synth chosen in each run."""
    return manifests.groupBy("real_filename").pivot("run", list(runs)).agg(F.min("synth_filename"))


# ---------------------------------------------------------------- choice of review pairs

PICTURE_FEATURES = ("aspect", "mean", "std", "white", "edge")
#: Weights of the picture distance, in the order of PICTURE_FEATURES.
PICTURE_WEIGHTS = (4.0, 2.0, 2.0, 2.5, 3.0)
MAX_REALS = 4096


def picture_distance(a: Column, b: Column) -> Column:
    """Distance of two feature structs: log ratio of the aspects and weighted differences of the others."""
    aspect = lambda f: F.greatest(f["aspect"], F.lit(1e-6))
    parts = [F.abs(F.log(aspect(a) / aspect(b)))] + [F.abs(a[n] - b[n]) for n in PICTURE_FEATURES[1:]]
    total = F.lit(PICTURE_WEIGHTS[0]) * parts[0]
    for weight, part in zip(PICTURE_WEIGHTS[1:], parts[1:]):
        total = total + F.lit(weight) * part
    return total


def _nearest_of_task(batches: Iterator[pa.RecordBatch], n: int, room: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Of pairs (pos, synth_pos, other_mode, distance) the n nearest of each (pos, other_mode), held n at a time and ``room`` rows more."""
    def cut(parts: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(parts).combine_chunks()
        pos, synth, other, distance = (table[c].to_numpy() for c in ("pos", "synth_pos", "other_mode", "distance"))
        order = np.lexsort((synth, distance, other, pos))
        pos, other = pos[order], other[order]
        first = np.r_[True, (pos[1:] != pos[:-1]) | (other[1:] != other[:-1])]
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        return table.take(pa.array(order[place < n]))

    parts, rows, held = [], 0, 0
    for batch in batches:
        parts, rows = [*parts, batch], rows + batch.num_rows
        if rows - held > room + held:
            parts = cut(parts).combine_chunks().to_batches()
            rows = held = sum(p.num_rows for p in parts)
    if rows:
        yield from cut(parts).combine_chunks().to_batches()


def choose_review_pairs(reals: DataFrame, synths: DataFrame) -> DataFrame:
    """A synth for each real picture: in the order of ``pos``, the nearest unused one of its mode, or of any mode when none is left.

    ``reals``: pos, real_filename, mode, features; ``synths``: synth_pos,
    synth_filename, mode, features.  People look at every pair, so there are at
    most MAX_REALS reals, which makes them small enough to copy to every task.

    A real can lose at most as many synths to others as there are reals, so that
    many of either kind per real are candidates.  All reals then ask for their
    best candidate, the first in order keeps it and the others strike it out,
    until nobody has to.  That ends in the same pairs as choosing one by one.
    """
    n = reals.count()
    if n > MAX_REALS:
        raise ValueError(f"{n} real pictures; a review set has {MAX_REALS} at most")
    left = F.broadcast(reals.select(F.lit(0).alias("_k"), "pos", F.col("mode").alias("_mode"), F.col("features").alias("_f")))
    pairs = synths.select(F.lit(0).alias("_k"), "synth_pos", "mode", "features").join(left, "_k")
    wish = pairs.select("pos", "synth_pos", (F.col("mode") != F.col("_mode")).cast("int").alias("other_mode"), picture_distance(F.col("_f"), F.col("features")).alias("distance"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wish.schema.fields)
    wish = wish.mapInArrow(lambda batches: _nearest_of_task(batches, n), kinds)  # no task sorts all of its pairs
    nearest = Window.partitionBy("pos", "other_mode").orderBy("distance", "synth_pos")
    wishes = settle(wish.withColumn("_rn", F.row_number().over(nearest)).where(F.col("_rn") <= n).drop("_rn"))
    order = F.struct("other_mode", "distance", "synth_pos")
    while True:
        asked = settle(wishes.groupBy("pos").agg(F.min(order).alias("w")).select("pos", "w.synth_pos", "w.distance"))
        first = asked.groupBy("synth_pos").agg(F.min("pos").alias("_first"))
        struck = settle(asked.join(first, "synth_pos").where(F.col("pos") != F.col("_first")).select("pos", "synth_pos"))
        if struck.isEmpty():
            break
        before, wishes = wishes, settle(wishes.join(struck, ["pos", "synth_pos"], "left_anti"))
        for table in (before, asked, struck):
            forget(table)
    chosen = asked.join(reals.select("pos", "real_filename"), "pos").join(synths.select("synth_pos", "synth_filename"), "synth_pos")
    ranked = chosen.withColumn("pair_id", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("pos")) - 1).cast("int"))  # MAX_REALS rows at most
    name = F.format_string("%03d_%s.png", F.col("pair_id"), safe_name(F.col("real_filename")))
    return ranked.select("pair_id", "real_filename", "synth_filename", name.alias("pair_image"), "distance")
