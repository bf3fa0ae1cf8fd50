"""Evaluation of predictions against ground truth, thresholds, losses and run logs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segstats.functions.groups import by_load, codes, grid_counts, joined, members, overlaps, sizes
from segstats.functions.scalar import bce_with_logits, foreground_score, sigmoid, strip_aux
from segstats.operators import masks
from segstats.operators.matching import BOX, best_gt_per_pred, box_pairs, collapse_boxes
from segstats.scale import ROWS_PER_CHUNK, ROWS_PER_GROUP, packed_by, parted, quantile_columns, running, settle, skew_join, with_chunks

# Loss weights and the weight of the no-object class.
LOSS_WEIGHTS = {"loss_ce": 2.0, "loss_mask": 5.0, "loss_dice": 5.0, "loss_ref": 2.0}
NO_OBJECT_WEIGHT = 0.1
REF_SCALE = 10.0


def filter_detections(preds: DataFrame, score_t: float = 0.5, match_t: float = 0.0) -> DataFrame:
    """Predictions above both cut-offs; both comparisons are strict."""
    return preds.where((F.col("score") > score_t) & (F.col("sim") > match_t))


def _passed(value: str, cuts: Sequence[float]) -> Column:
    """How many of the ascending cut-offs the value exceeds."""
    return reduce(add, [(F.col(value) > float(c)).cast("int") for c in cuts])


def _ratios(totals: DataFrame) -> DataFrame:
    precision = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    recall = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    rated = totals.withColumns({"precision": precision, "recall": recall})
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-9))
    return rated.withColumn("f1", f1)


def evaluate_pairs(gt: DataFrame, preds: DataFrame, pairs: DataFrame, score_ts: Sequence[float] = (0.5,),
                   match_ts: Sequence[float] = (0.0,), iou_t: float = 0.5, count_unmatched_images: bool = False) -> DataFrame:
    """Detection and matching metrics at every (score, match) cut-off, from one table of overlapping pairs.

    ``gt``: image_id, gt_idx, ref_match; ``preds``: image_id, q_idx, score, sim;
    ``pairs``: image_id, gt_idx, q_idx, iou > 0.

    Cut-offs are ascending, so a prediction is described by how many of each it
    passes and small histograms give all counts of the grid.  Images
    without any ground truth are left out.  In images where nothing is wanted,
    kept predictions count as false positives, and for ``ref_acc`` only with
    ``count_unmatched_images``.
    """
    if iou_t <= 0:
        raise ValueError("iou_t must be positive: pairs with IoU 0 are not in the table")
    if "ref_match" not in pairs.columns:
        s_cuts, m_cuts = sorted(score_ts), sorted(match_ts)
        gt = gt.select("image_id", "gt_idx", F.col("ref_match").cast("int").alias("ref_match"), F.lit(1).alias("n"))
        preds = preds.select("image_id", "q_idx", F.lit(1).alias("n"), _passed("score", s_cuts).alias("si"), _passed("sim", m_cuts).alias("mi"))
        preds = preds.where(F.col("si") > 0)
        pairs = pairs.select("image_id", "gt_idx", "q_idx", "iou").join(
            preds.select("image_id", "q_idx", "si", "mi"), ["image_id", "q_idx"]).join(
            gt.select("image_id", "gt_idx", "ref_match", F.col("n").alias("gt_n")), ["image_id", "gt_idx"])
    return _grid_metrics(gt, preds, pairs, sorted(score_ts), sorted(match_ts), iou_t, count_unmatched_images)


def _staircase(per_gt: DataFrame) -> DataFrame:
    """image_id, gt_idx, q_idx, iou, and per score cut-off s the range [m, end) of match cut-offs at which the prediction is the best of the ground truth.

    ``entries`` hold the best prediction of every (si, mi), best first.  At score
    cut-off s an entry begins where the entries before it that pass s have all
    failed, and ends where it fails itself.
    """
    def lines(e: Column, k: Column) -> Column:
        better = F.slice("entries", F.lit(1), k)

        def line(i: Column) -> Column:
            begins = F.array_max(F.transform(F.filter(better, lambda b: b["si"] > i), lambda b: b["mi"]))
            return F.struct(i.alias("s"), F.coalesce(begins, F.lit(0)).alias("m"), e["mi"].alias("end"), e["q_idx"].alias("q_idx"), (-e["neg"]).alias("iou"))

        return F.filter(F.transform(F.sequence(F.lit(0), e["si"] - 1), line), lambda x: x["m"] < x["end"])

    return per_gt.select("image_id", "gt_idx", F.inline(F.flatten(F.transform("entries", lines))))


def _grid_metrics(gt: DataFrame, preds: DataFrame, pairs: DataFrame, s_cuts: Sequence[float], m_cuts: Sequence[float], iou_t: float,
                  count_unmatched_images: bool) -> DataFrame:
    """Metrics from folded tables: gt with n, preds with n, si, mi (cut-offs passed), pairs with both sides' columns."""
    return _grid_rates(_grid_parts(gt, preds, pairs, s_cuts, m_cuts, iou_t, count_unmatched_images), s_cuts, m_cuts)


def _grid_parts(gt: DataFrame, preds: DataFrame, pairs: DataFrame, s_cuts: Sequence[float], m_cuts: Sequence[float], iou_t: float,
                count_unmatched_images: bool) -> DataFrame:
    """A few rows per grid point s, m (numbers of the cut-offs), which add up to its counts."""
    pairs = settle(pairs)  # read by both aggregates below
    n_s, n_m = len(s_cuts), len(m_cuts)

    def spread(df: DataFrame, *keep: str) -> DataFrame:
        """Small histograms by (si, mi), once per grid point passed."""
        both = df.where((F.col("si") > 0) & (F.col("mi") > 0)).select(
            *keep, "mi", F.explode(F.sequence(F.lit(0), F.col("si") - 1)).alias("s"))
        return both.select(*keep, "s", F.explode(F.sequence(F.lit(0), F.col("mi") - 1)).alias("m"))

    # Per ground truth: how many score cut-offs its best-scored cover passes, and its staircase.
    order = F.min(F.struct((-F.col("iou")).alias("neg"), F.col("q_idx").alias("q_idx")))
    cells = pairs.where(F.col("iou") >= iou_t).groupBy("image_id", "gt_idx", "gt_n", "ref_match", "si", "mi").agg(order.alias("o"))
    entry = F.when((F.col("ref_match") == 1) & (F.col("mi") > 0), F.struct("o.neg", "o.q_idx", "si", "mi"))
    per_gt = settle(cells.groupBy("image_id", "gt_idx", "gt_n").agg(F.max("si").alias("si"), F.sort_array(F.collect_list(entry)).alias("entries")))  # a row per grid point at most
    found = per_gt.groupBy("si").agg(F.sum("gt_n").alias("found"))
    # All claims on a prediction end at the cut-off it fails, so where an earlier ground truth begins, a later one ends.
    earlier = Window.partitionBy("image_id", "q_idx", "s").orderBy("gt_idx").rowsBetween(Window.unboundedPreceding, -1)
    claims = _staircase(per_gt).withColumn("end", F.least("end", F.min("m").over(earlier))).where(F.col("m") < F.col("end"))
    ends = F.array(F.struct("m", F.lit(1).alias("tp"), F.col("iou").alias("iou_sum")), F.struct(F.col("end").alias("m"), F.lit(-1).alias("tp"), (-F.col("iou")).alias("iou_sum")))
    steps = claims.select("s", F.inline(ends)).where(F.col("m") < n_m).groupBy("s", "m").agg(F.sum("tp").alias("tp"), F.sum("iou_sum").alias("iou_sum"))
    # Kept predictions by number of cut-offs passed, with the label of their best ground truth.
    matchable = preds.where(F.col("mi") > 0)
    labelled = best_gt_per_pred(matchable, gt, pairs.where(F.col("mi") > 0))
    counted = F.lit(True) if count_unmatched_images else F.col("n_wanted") > 0
    hist = labelled.groupBy("si", "mi").agg(
        F.sum("n").alias("kept"), F.sum(F.when(counted, F.col("n"))).alias("match_total"),
        F.sum(F.col("n") * F.col("best_ref_match")).alias("match_ok"))
    totals = gt.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("gt_total"), F.coalesce(F.sum(F.col("n") * F.col("ref_match")), F.lit(0)).alias("wanted"))
    # From here on there are a few rows per grid point.
    small = settle(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        steps.withColumn("part", F.lit("match")), found.withColumn("part", F.lit("found")), hist.withColumn("part", F.lit("kept")), totals.withColumn("part", F.lit("total"))]))
    part = lambda name: small.where(F.col("part") == name)
    tps = part("match").select("s", F.explode(F.sequence("m", F.lit(n_m - 1))).alias("m"), "tp", "iou_sum")
    det = spread(part("found").withColumn("mi", F.lit(n_m)), "found")
    kept = spread(part("kept"), "kept", "match_total", "match_ok")
    whole = spread(part("total").select("gt_total", "wanted").withColumns({"si": F.lit(n_s), "mi": F.lit(n_m)}), "gt_total", "wanted")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [whole, tps, kept, det])


COUNTS = ["gt_total", "wanted", "tp", "kept", "match_total", "match_ok", "found"]


def _grid_rates(parts: DataFrame, s_cuts: Sequence[float], m_cuts: Sequence[float]) -> DataFrame:
    """Metrics of every grid point from the counts that make it up."""
    summed = parts.groupBy("s", "m").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [*COUNTS, "iou_sum"]])
    cut = lambda cuts, i: F.get(F.array(*[F.lit(float(c)) for c in cuts]), F.col(i))
    counts = summed.select(
        cut(s_cuts, "s").alias("score_t"), cut(m_cuts, "m").alias("match_t"), F.col("tp").cast("bigint").alias("tp"),
        (F.col("kept") - F.col("tp")).cast("bigint").alias("fp"), (F.col("wanted") - F.col("tp")).cast("bigint").alias("fn"),
        (F.col("iou_sum") / F.greatest(F.col("tp"), F.lit(1))).alias("mean_iou"),
        (F.col("match_ok") / F.greatest(F.col("match_total"), F.lit(1))).alias("ref_acc"),
        (F.col("found") / F.greatest(F.col("gt_total"), F.lit(1))).alias("det_recall"))
    return _ratios(counts)


def evaluate_boxes(gt: DataFrame, preds: DataFrame, score_ts: Sequence[float] = (0.5,), match_ts: Sequence[float] = (0.0,),
                   iou_t: float = 0.5, count_unmatched_images: bool = False, cell: int = 512, rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """:func:`evaluate_pairs` for boxes.

    The boxes of an image are brought together in two rows, and an image adds its
    counts where it is.  In images with more boxes than a row should hold, copies
    of a box are folded and pairs are formed by joins.
    """
    if iou_t <= 0:
        raise ValueError("iou_t must be positive: pairs with IoU 0 are not in the table")
    s_cuts, m_cuts = sorted(score_ts), sorted(match_ts)
    gt = gt.select("image_id", "gt_idx", *BOX, F.col("ref_match").cast("int").alias("ref_match"))
    signed = preds.select("image_id", "q_idx", *BOX, _passed("score", s_cuts).alias("si"), _passed("sim", m_cuts).alias("mi")).where(F.col("si") > 0)
    (gt, signed), large = parted([gt, signed], ["image_id"], rows_per_group, nulls=True)
    met = packed_by(gt, ["image_id"], "gt_idx", *BOX, "ref_match", out="gt").join(
        packed_by(signed, ["image_id"], "q_idx", *BOX, "si", "mi", out="preds"), ["image_id"], "left")
    met = met.select("gt", F.coalesce("preds", F.array().cast(met.schema["preds"].dataType)).alias("preds"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_load(batches, lambda b: sizes(b.column("gt")) * np.maximum(sizes(b.column("preds")), 1)):
            row, (ident, *box, ref_match) = members(batch.column("gt"))
            q_row, (q_ident, *q_box, si, mi) = members(batch.column("preds"))
            pairs = overlaps(box, q_box, *(sizes(batch.column(c)) for c in ("gt", "preds")))
            yield _image_counts({"row": row, "id": ident, "ref_match": ref_match}, {"row": q_row, "id": q_ident, "si": si, "mi": mi}, pairs, s_cuts, m_cuts, iou_t, count_unmatched_images)

    parts = _with_grid(met.mapInArrow(count, IMAGE_COUNTS), s_cuts, m_cuts)
    if large is not None:
        parts = parts.unionByName(_folded_parts(*large, s_cuts, m_cuts, iou_t, count_unmatched_images, cell), allowMissingColumns=True)
    return _grid_rates(parts, s_cuts, m_cuts)


def evaluate_masks(gt: DataFrame, gt_polygons: DataFrame, preds: DataFrame, pred_polygons: DataFrame, score_ts: Sequence[float] = (0.5,),
                   match_ts: Sequence[float] = (0.0,), iou_t: float = 0.5, count_unmatched_images: bool = False, rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """:func:`evaluate_pairs` for polygons (image_id, gt_idx or q_idx, segmentation).

    What belongs to an image is brought together in one row and adds its counts
    where it is; larger images go through the pairs of :func:`mask_iou`.
    """
    if iou_t <= 0:
        raise ValueError("iou_t must be positive: pairs with IoU 0 are not in the table")
    s_cuts, m_cuts = sorted(score_ts), sorted(match_ts)
    frames = [gt.select("image_id", "gt_idx", F.col("ref_match").cast("int").alias("ref_match")),
              preds.select("image_id", "q_idx", _passed("score", s_cuts).alias("si"), _passed("sim", m_cuts).alias("mi")).where(F.col("si") > 0),
              gt_polygons.select("image_id", "gt_idx", "segmentation"), pred_polygons.select("image_id", "q_idx", "segmentation")]
    (gt, signed, outlines, found), large = parted(frames, ["image_id"], rows_per_group, nulls=True)
    rings = [masks._rings(f, ["image_id", i], "segmentation") for f, i in ((outlines, "gt_idx"), (found, "q_idx"))]
    met = masks._images(dict(zip(("gt", "preds", "a", "b"), (gt, signed, *rings))), "image_id").where(F.size("gt") > 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_load(batches, lambda b: sizes(b.column("a")) * sizes(b.column("b")) + sizes(b.column("gt")) + sizes(b.column("preds"))):
            row, (ident, ref_match) = members(batch.column("gt"))
            q_row, (q_ident, si, mi) = members(batch.column("preds"))
            left, right = (masks.listed_masks(batch.column(c)) for c in ("a", "b"))
            i, j, inter = masks.listed_pairs(left, right, batch.num_rows)
            iou = inter / np.maximum(left[2][i] + right[2][j] - inter, 1)
            named = [np.split(codes(np.r_[r, m[0][k]], np.r_[n, m[1].to_numpy(zero_copy_only=False)[k]])[1], [len(r)]) for r, n, m, k in ((row, ident, left, i), (q_row, q_ident, right, j))]
            pair, g = joined(named[0][1], named[0][0])  # pairs of masks as pairs of members
            at, q = joined(named[1][1][pair], named[1][0])
            pairs = g[at], q, iou[pair[at]]
            yield _image_counts({"row": row, "id": ident, "ref_match": ref_match}, {"row": q_row, "id": q_ident, "si": si, "mi": mi}, pairs, s_cuts, m_cuts, iou_t, count_unmatched_images)

    parts = _with_grid(met.mapInArrow(count, IMAGE_COUNTS), s_cuts, m_cuts)
    if large is not None:
        pairs = masks.mask_iou(*(masks.rasterize_packed(f, ("image_id", i)) for f, i in zip(large[2:], ("gt_idx", "q_idx"))))
        parts = parts.unionByName(_pair_parts(large[0], large[1], pairs, s_cuts, m_cuts, iou_t, count_unmatched_images), allowMissingColumns=True)
    return _grid_rates(parts, s_cuts, m_cuts)


def _pair_parts(gt: DataFrame, signed: DataFrame, pairs: DataFrame, s_cuts: Sequence[float], m_cuts: Sequence[float], iou_t: float,
                count_unmatched_images: bool) -> DataFrame:
    """What images add whose pairs are a table; gt: ref_match, signed: si, mi."""
    gt, signed = gt.withColumn("n", F.lit(1)), signed.withColumn("n", F.lit(1))
    pairs = pairs.select("image_id", "gt_idx", "q_idx", "iou").join(
        signed.select("image_id", "q_idx", "si", "mi"), ["image_id", "q_idx"]).join(
        gt.select("image_id", "gt_idx", "ref_match", F.col("n").alias("gt_n")), ["image_id", "gt_idx"])
    return _grid_parts(gt, signed, pairs, s_cuts, m_cuts, iou_t, count_unmatched_images)


IMAGE_COUNTS = f"s bigint, m bigint, {', '.join(f'{c} bigint' for c in COUNTS)}, iou_sum double"


def _image_counts(gt: dict, preds: dict, pairs: tuple, s_cuts: Sequence[float], m_cuts: Sequence[float], iou_t: float, count_unmatched_images: bool) -> pa.RecordBatch:
    """What whole images add to each point of the grid."""
    n_s, n_m = len(s_cuts), len(m_cuts)
    counts = grid_counts(gt, preds, pairs, n_s, n_m, iou_t, count_unmatched_images)
    counts |= {"gt_total": np.full(n_s * n_m, len(gt["row"])), "wanted": np.full(n_s * n_m, gt["ref_match"].sum())}
    return pa.record_batch([*map(pa.array, np.divmod(np.arange(n_s * n_m), n_m)), *[pa.array(counts[c].astype(np.int64)) for c in COUNTS], pa.array(counts["iou_sum"])],
                           names=["s", "m", *COUNTS, "iou_sum"])


def _with_grid(parts: DataFrame, s_cuts: Sequence[float], m_cuts: Sequence[float]) -> DataFrame:
    """A point of the grid that nothing adds to is there as well."""
    n_s, n_m = len(s_cuts), len(m_cuts)
    empty = parts.sparkSession.range(n_s * n_m).select(F.floor(F.col("id") / n_m).alias("s"), (F.col("id") % n_m).alias("m"))
    return parts.unionByName(empty, allowMissingColumns=True)


def _folded_parts(gt: DataFrame, signed: DataFrame, s_cuts: Sequence[float], m_cuts: Sequence[float], iou_t: float,
                  count_unmatched_images: bool, cell: int) -> DataFrame:
    """What images of any size add.  Copies of a box are folded before any pair is formed."""
    objects = collapse_boxes(gt, "gt_idx", ["ref_match"]).withColumnRenamed("n", "gt_n")
    signed = collapse_boxes(signed, "q_idx", ["si", "mi"])
    pairs = box_pairs(objects, signed, cell=cell, keep_gt=["ref_match", "gt_n"], keep_pred=["si", "mi"])
    # Image totals and first ground truths come from the unfolded table: one aggregate, no folding again.
    return _grid_parts(gt.select("image_id", "gt_idx", "ref_match", F.lit(1).alias("n")), signed, pairs, s_cuts, m_cuts, iou_t, count_unmatched_images)


def threshold_sweep(gt: DataFrame, preds: DataFrame, score_ts: Sequence[float] = (0.1, 0.2, 0.3, 0.4, 0.5),
                    match_ts: Sequence[float] = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5), iou_t: float = 0.5) -> DataFrame:
    """All metrics over a grid of cut-offs, counted as the sweep does (``count_unmatched_images``)."""
    return evaluate_boxes(gt, preds, score_ts, match_ts, iou_t, count_unmatched_images=True)


def sweep_matrix(sweep: DataFrame, metric: str, match_ts: Sequence[float]) -> DataFrame:
    """Rows = score cut-off, columns = match cut-off (named m_0, m_1, ...)."""
    return sweep.groupBy("score_t").agg(*[
        F.max(F.when(F.col("match_t") == float(m), F.col(metric))).alias(f"m_{i}") for i, m in enumerate(sorted(match_ts))])


def detection_recall(gt: DataFrame, preds: DataFrame, score_t: float = 0.5, iou_t: float = 0.5) -> DataFrame:
    """Share of all ground truth covered by some prediction that passes the score (not exclusive)."""
    best = best_ious(gt, preds, score_t)
    return best.agg(F.sum("n").cast("bigint").alias("gt_total"), F.sum(F.when(F.col("iou") >= iou_t, F.col("n")).otherwise(0)).cast("bigint").alias("found")
                    ).withColumn("det_recall", F.col("found") / F.greatest(F.col("gt_total"), F.lit(1)))


def best_ious(gt: DataFrame, preds: DataFrame, score_t: float = 0.5, cell: int = 512) -> DataFrame:
    """Best IoU of every distinct ground-truth box over predictions above the score (0 if none), with its count ``n``."""
    objects = collapse_boxes(gt, "gt_idx")
    found = collapse_boxes(preds.where(F.col("score") > score_t), "q_idx")
    best = box_pairs(objects, found, cell=cell).groupBy("image_id", "gt_idx").agg(F.max("iou").alias("iou"))
    return objects.join(best, ["image_id", "gt_idx"], "left").select("image_id", "gt_idx", "n", F.coalesce("iou", F.lit(0.0)).alias("iou"))


def mean_gt_iou(gt: DataFrame, preds: DataFrame, score_t: float = 0.5) -> DataFrame:
    """Mean over all ground truth of its best IoU; missed ones count 0."""
    return best_ious(gt, preds, score_t).agg(
        (F.sum(F.col("iou") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("mean_gt_iou"), F.sum("n").cast("bigint").alias("gt_total"))


def matched_similarity(gt: DataFrame, preds: DataFrame, score_t: float = 0.5, iou_t: float = 0.5, cell: int = 512) -> DataFrame:
    """(sim, label, n): similarity of the best prediction of each well-detected ground truth, and whether it is wanted."""
    objects = gt.groupBy("image_id", *BOX, F.col("ref_match").cast("int").alias("label")).agg(
        F.min("gt_idx").alias("gt_idx"), F.count(F.lit(1)).alias("n"))
    found = preds.where(F.col("score") > score_t).groupBy("image_id", *BOX).agg(F.min(F.struct("q_idx", "sim")).alias("_q")).select(
        "image_id", *BOX, F.col("_q.q_idx").alias("q_idx"), F.col("_q.sim").alias("sim"))
    pairs = box_pairs(objects, found, cell=cell, keep_gt=["label", "n"], keep_pred=["sim"]).where(F.col("iou") >= iou_t)
    best = pairs.groupBy("image_id", "gt_idx", "label", "n").agg(F.min(F.struct((-F.col("iou")).alias("neg"), "q_idx", "sim")).alias("_b"))
    return best.select(F.col("_b.sim").alias("sim"), "label", "n")


def _by_score(scores: DataFrame, score: str, label: str, weight: str | None) -> DataFrame:
    w = F.lit(1) if weight is None else F.col(weight)
    return scores.groupBy(F.col(score).alias("score")).agg(
        F.sum(w * F.col(label)).cast("double").alias("pos"), F.sum(w * (1 - F.col(label))).cast("double").alias("neg"))


def roc_auc(scores: DataFrame, score: str = "sim", label: str = "label", weight: str | None = None,
            rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Area under the ROC curve with ties at half weight; NULL when a class is missing.

    Scores are counted per distinct value, and each positive is credited with
    the negatives below it plus half of those at its own score.
    """
    counts = with_chunks(_by_score(scores, score, label, weight), ["score"], rows_per_chunk)
    below = running(counts, [], ["score"], {"_below": ("sum", "neg")}, through=False, rows_per_chunk=rows_per_chunk)
    credit = F.col("pos") * (F.coalesce("_below", F.lit(0.0)) + F.col("neg") / 2)
    sums = below.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(credit).alias("_u"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return sums.select(F.when(both, F.col("_u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"),
                       F.col("n_pos").cast("bigint").alias("n_pos"), F.col("n_neg").cast("bigint").alias("n_neg"))


def sim_distribution(scores: DataFrame, score: str = "sim", label: str = "label", weight: str | None = None) -> DataFrame:
    """Count, mean, p10, median and p90 of the similarity for each label."""
    w = F.lit(1) if weight is None else F.col(weight)
    counts = settle(scores.groupBy(label, F.col(score).alias("_v")).agg(F.sum(w).alias("_w")))
    base = counts.groupBy(label).agg(F.sum("_w").cast("bigint").alias("n"), (F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("mean"))
    return base.join(quantile_columns(counts, [label], "_v", {"p10": 0.1, "median": 0.5, "p90": 0.9}, "_w"), label)


def accuracy_at(scores: DataFrame, t: float, score: str = "sim", label: str = "label", weight: str | None = None) -> DataFrame:
    w = F.lit(1) if weight is None else F.col(weight)
    right = ((F.col(score) > t).cast("int") == F.col(label)).cast("int")
    return scores.agg((F.sum(w * right) / F.sum(w)).alias("accuracy"))


def best_threshold(scores: DataFrame, n: int = 200, score: str = "sim", label: str = "label", weight: str | None = None) -> DataFrame:
    """Most accurate of ``n`` evenly spaced cut-offs between the lowest and highest score; the lowest wins ties.

    Every distinct score is filed under the number of cut-offs it exceeds; a
    running sum over those n + 1 numbers gives the accuracy of each cut-off.
    """
    counts = settle(_by_score(scores, score, label, weight))
    ends = counts.agg(F.struct(F.min("score").alias("lo"), F.max("score").alias("hi"))).scalar()
    filed = counts.withColumn("_ends", ends)

    def cut(i: Column) -> Column:
        # the last point is the maximum itself, not a rounded neighbour of it
        return F.when(i == n - 1, F.col("_ends.hi")).otherwise(
            F.col("_ends.lo") + i * ((F.col("_ends.hi") - F.col("_ends.lo")) / float(n - 1)))

    passed = F.size(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("score") > cut(i)))
    hist = filed.groupBy(passed.alias("_passed")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.first("_ends").alias("_ends"))
    # n + 1 rows at most from here on
    every = Window.partitionBy(F.lit(0))
    below = every.orderBy("_passed").rowsBetween(Window.unboundedPreceding, -1)
    full = hist.select("*", F.sum("pos").over(every).alias("_all_pos"), F.sum(F.col("pos") + F.col("neg")).over(every).alias("_all"),
                       F.coalesce(F.sum("pos").over(below), F.lit(0.0)).alias("_pos_below"), F.coalesce(F.sum("neg").over(below), F.lit(0.0)).alias("_neg_below"),
                       F.coalesce(F.lag("_passed").over(every.orderBy("_passed")), F.lit(-1)).alias("_previous"))
    # Scores filed under k exceed cut-offs 0..k-1: cut-off i counts them as positive when k > i.
    at = full.select("_ends", F.explode(F.sequence(F.greatest(F.col("_previous"), F.lit(0)), F.greatest(F.col("_passed") - 1, F.lit(0)))).alias("i"),
                     F.col("_passed"), ((F.col("_all_pos") - F.col("_pos_below") + F.col("_neg_below")) / F.col("_all")).alias("accuracy"))
    at = at.where(F.col("i") < F.col("_passed")).select(F.col("i"), cut(F.col("i")).alias("threshold"), "accuracy")
    top = full.groupBy().agg(F.max("_passed").alias("_top"), F.first("_ends").alias("_ends"), F.max("_all_pos").alias("_p"), F.max("_all").alias("_a"))
    rest = top.select("_ends", F.explode(F.sequence(F.col("_top"), F.lit(n - 1))).alias("i"), ((F.col("_a") - F.col("_p")) / F.col("_a")).alias("accuracy"))
    rest = rest.select("i", cut(F.col("i")).alias("threshold"), "accuracy")
    curve = at.unionByName(rest)
    best = curve.agg(F.max(F.struct(F.col("accuracy"), (-F.col("i")).alias("_neg"), F.col("threshold"))).alias("_b"))
    return best.select(F.col("_b.threshold").alias("threshold"), F.col("_b.accuracy").alias("accuracy"))


def per_image_errors(gt: DataFrame, preds: DataFrame, headers: DataFrame, score_t: float = 0.5) -> DataFrame:
    """Per image with ground truth: number of ground truths and predictions, mean best IoU, over-prediction, mono flag."""
    best = best_ious(gt, preds, score_t).groupBy("image_id").agg(
        F.sum("n").cast("bigint").alias("n_gt"), (F.sum(F.col("iou") * F.col("n")) / F.sum("n")).alias("mean_iou"))
    counted = preds.where(F.col("score") > score_t).groupBy("image_id").agg(F.count(F.lit(1)).alias("n_pred"))
    joined = best.join(counted, "image_id", "left").join(headers.select("image_id", "mono"), "image_id", "left").na.fill(0, ["n_pred"])
    return joined.select("image_id", "mono", "n_gt", "n_pred", "mean_iou", (F.col("n_pred") / F.col("n_gt")).alias("over_prediction"))


def error_summary(per_image: DataFrame) -> DataFrame:
    """Means, medians, ratio of totals, correlation of prediction count and IoU; overall and by mono flag."""
    scoped = settle(per_image).select(F.explode(F.array(F.lit("all"), F.when(F.col("mono"), F.lit("mono")).otherwise(F.lit("colour")))).alias("scope"),
                              "n_gt", "n_pred", "mean_iou")
    base = scoped.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n_images"), F.avg("mean_iou").alias("mean_iou"), F.avg("n_pred").alias("mean_pred"), F.avg("n_gt").alias("mean_gt"),
        (F.sum("n_pred") / F.sum("n_gt")).alias("over_prediction"), F.corr(F.col("n_pred").cast("double"), F.col("mean_iou")).alias("corr_pred_iou"))
    return base.join(quantile_columns(scoped, ["scope"], "n_pred", {"median_pred": 0.5}), "scope").join(
        quantile_columns(scoped, ["scope"], "n_gt", {"median_gt": 0.5}), "scope")


# ---------------------------------------------------------------- losses


def class_loss(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weighted two-class cross entropy (weighted mean); rows: logit0, logit1, target."""
    w = F.when(F.col("target") == 1, F.lit(1.0)).otherwise(F.lit(NO_OBJECT_WEIGHT))
    p = foreground_score(F.col("logit0"), F.col("logit1"))
    nll = -F.log(F.when(F.col("target") == 1, p).otherwise(1.0 - p))
    return rows.groupBy(*by).agg((F.sum(w * nll) / F.sum(w)).alias("loss_ce"))


#: Point numbers of a block: the points of an instance are shuffled as lists of that many.
POINTS_PER_LIST = 64


def paired_points(pred_points: DataFrame, gt_points: DataFrame, instance: Sequence[str], point: str = "point_id") -> DataFrame:
    """Instance keys, logit and value of every point that both sides have, as the join on (instance, point) gives them.

    Points are shuffled as lists of a block of numbers; where both lists name the
    same points in the same order, and none twice, they pair up by place.
    """
    def packed(df: DataFrame, value: str, tag: str) -> DataFrame:
        lists = {f"_{tag}p": F.col(point), f"_{tag}v": F.coalesce(F.col(value).cast("double"), F.lit(0.0)), f"_{tag}n": F.col(value).isNull()}  # lists leave nulls out
        block = F.floor(F.col(point) / POINTS_PER_LIST).alias("_block")
        return df.where(F.col(point).isNotNull()).groupBy(*instance, block).agg(*[F.collect_list(c).alias(n) for n, c in lists.items()])

    names = ["_pv", "_pn", "_gv", "_gn"]
    places = lambda tag: F.sequence(F.lit(0), F.size(f"_{tag}p") - 1)
    pair = lambda i, j: F.struct(*[F.get(n, i if n.startswith("_p") else j).alias(n) for n in names])
    met = skew_join(packed(pred_points, "logit", "p"), packed(gt_points, "value", "g"), [*instance, "_block"], list(instance))
    same = (F.col("_pp") == F.col("_gp")) & (F.size(F.array_distinct("_pp")) == F.size("_pp"))
    apart = F.flatten(F.transform(places("p"), lambda i: F.transform(
        F.filter(places("g"), lambda j: F.get("_gp", j) == F.get("_pp", i)), lambda j: pair(i, j))))
    rows = met.select(*instance, F.inline(F.when(same, F.arrays_zip(*names)).otherwise(apart)))
    return rows.select(*instance, F.when(~F.col("_pn"), F.col("_pv")).alias("logit"), F.when(~F.col("_gn"), F.col("_gv")).alias("value"))


def mask_losses(points: DataFrame, instance: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean point BCE and mean dice over matched instances; points: instance keys, logit, value."""
    p, g = sigmoid(F.col("logit")), F.col("value")
    each = points.groupBy(*instance).agg(
        F.sum(bce_with_logits(F.col("logit"), g)).alias("_bce"), F.count(F.lit(1)).alias("_n"),
        (1.0 - (2.0 * F.sum(p * g) + 1.0) / (F.sum(p) + F.sum(g) + 1.0)).alias("_dice"))
    return each.groupBy(*by).agg((F.sum("_bce") / F.sum("_n")).alias("loss_mask"), F.avg("_dice").alias("loss_dice"))


def reference_loss(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """BCE of scaled cosine against the match label; rows: sim, label."""
    return rows.groupBy(*by).agg(F.avg(bce_with_logits(F.col("sim") * REF_SCALE, F.col("label").cast("double"))).alias("loss_ref"))


def total_loss(parts: DataFrame, by: Sequence[str], weights: dict[str, float] = LOSS_WEIGHTS) -> DataFrame:
    """Weighted sum of loss parts (key, value); auxiliary keys share the weight of their base name."""
    table = F.create_map(*[F.lit(x) for item in weights.items() for x in item])
    return parts.groupBy(*by).agg(F.sum(F.col("value") * F.try_element_at(table, strip_aux(F.col("key")))).alias("total_loss"))


# ---------------------------------------------------------------- run logs


def run_divergence(metrics: DataFrame) -> DataFrame:
    """synth_iou - real_iou per run and epoch, from the long table (run, epoch, tag, value)."""
    def pick(tag: str) -> Column:
        return F.max(F.when(F.col("tag") == tag, F.col("value")))

    wide = metrics.where(F.col("tag").isin("synth_iou", "real_iou")).groupBy("run", "epoch").agg(
        pick("synth_iou").alias("synth_iou"), pick("real_iou").alias("real_iou"))
    return wide.withColumn("divergence", F.col("synth_iou") - F.col("real_iou"))


def compare_runs(metrics: DataFrame, tag: str, a: str, b: str) -> DataFrame:
    """One tag of two runs side by side by epoch, with the difference."""
    def of(run: str) -> Column:
        return F.max(F.when(F.col("run") == run, F.col("value")))

    wide = metrics.where((F.col("tag") == tag) & F.col("run").isin(a, b)).groupBy("epoch").agg(of(a).alias("a"), of(b).alias("b"))
    return wide.withColumn("delta", F.col("b") - F.col("a"))


def epoch_range_mean(metrics: DataFrame, first: int, last: int) -> DataFrame:
    """Mean of every tag of every run over an epoch range."""
    return metrics.where(F.col("epoch").between(first, last)).groupBy("run", "tag").agg(F.avg("value").alias("mean_value"))
