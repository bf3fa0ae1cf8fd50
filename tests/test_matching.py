"""Matching rules against plain loops on small cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segstats import scale
from segstats.operators import matching, metrics


def loop_eval(images, score_t, match_t, iou_t, unmatched):
    """The sequential rules, image by image, on dense IoU tables."""
    tp = fp = fn = mc = mt = found = total = 0
    ious = []
    for gt, preds, iou in images:
        if not gt:
            continue
        total += len(gt)
        detected = [q for q, p in enumerate(preds) if p[0] > score_t]
        found += sum(any(iou[g][q] >= iou_t for q in detected) for g in range(len(gt)))
        kept = [q for q in detected if preds[q][1] > match_t]
        wanted = [g for g, m in enumerate(gt) if m]
        if not kept:
            fn += len(wanted)
            continue
        if not wanted:
            fp += len(kept)
            mt += len(kept) if unmatched else 0
            continue
        taken = set()
        for g in wanted:
            q = max(kept, key=lambda k: (iou[g][k], -k))
            if iou[g][q] >= iou_t and q not in taken:
                taken.add(q)
                tp += 1
                ious.append(iou[g][q])
            else:
                fn += 1
        fp += len(kept) - len(taken)
        for q in kept:
            mc += gt[max(range(len(gt)), key=lambda g: (iou[g][q], -g))]
        mt += len(kept)
    return {"tp": tp, "fp": fp, "fn": fn, "mean_iou": sum(ious) / max(len(ious), 1), "ref_acc": mc / max(mt, 1), "det_recall": found / max(total, 1)}


def tables(spark, images):
    gt = [(i, g, bool(m)) for i, (gs, _, _) in enumerate(images) for g, m in enumerate(gs)]
    preds = [(i, q, float(s), float(m)) for i, (_, ps, _) in enumerate(images) for q, (s, m) in enumerate(ps)]
    pairs = [(i, g, q, float(v)) for i, (_, _, t) in enumerate(images) for g, row in enumerate(t) for q, v in enumerate(row) if v > 0]
    return (spark.createDataFrame(gt, "image_id long, gt_idx long, ref_match boolean"), spark.createDataFrame(preds, "image_id long, q_idx long, score double, sim double"),
            spark.createDataFrame(pairs, "image_id long, gt_idx long, q_idx long, iou double"))


@pytest.mark.parametrize("unmatched", [False, True])
def test_evaluation_equals_the_loop(spark, unmatched):
    rnd = random.Random(5)
    images = [([], [(0.9, 0.4)], []), ([1], [], [[]]), ([0], [(0.9, 0.5)], [[0.7]]), ([1, 1], [(0.9, 0.5)], [[0.8], [0.9]])]
    for _ in range(60):
        gs, qs = rnd.randint(0, 5), rnd.randint(0, 6)
        images.append(([int(rnd.random() < 0.5) for _ in range(gs)], [(rnd.choice([0.2, 0.5, 0.6, 0.9]), rnd.choice([-0.2, 0.0, 0.1, 0.5])) for _ in range(qs)],
                       [[rnd.choice([0, 0, 0.3, 0.5, 0.5, 0.8]) for _ in range(qs)] for _ in range(gs)]))
    grid = metrics.evaluate_pairs(*tables(spark, images), (0.2, 0.5), (-0.3, 0.0), 0.5, unmatched).collect()
    assert len(grid) == 4
    for row in grid:
        want = loop_eval(images, row["score_t"], row["match_t"], 0.5, unmatched)
        assert {k: pytest.approx(row[k]) for k in want} == want


def test_one_grid_point_is_the_sweep(spark):
    rnd = random.Random(2)
    box = lambda: (rnd.randrange(40), rnd.randrange(40))
    gt = [(i, g, *(b := box()), b[0] + 20, b[1] + 20, rnd.random() < 0.6) for i in range(30) for g in range(4)]
    preds = [(i, q, *(b := box()), b[0] + 20, b[1] + 20, rnd.random(), rnd.random() - 0.5) for i in range(30) for q in range(6)]
    gt = spark.createDataFrame(gt + gt[:9], "image_id long, gt_idx long, x0 long, y0 long, x1 long, y1 long, ref_match boolean")
    preds = spark.createDataFrame(preds, "image_id long, q_idx long, x0 long, y0 long, x1 long, y1 long, score double, sim double")
    sweep = metrics.evaluate_boxes(gt, preds, (0.2, 0.5), (-0.1, 0.0)).where((F.col("score_t") == 0.5) & (F.col("match_t") == 0.0)).first()
    assert metrics.evaluate_boxes(gt, preds).first() == sweep


def test_copies_of_a_box_are_folded_without_changing_counts(spark):
    """A third of all boxes are copies of one box in one image."""
    copies = [(0, 1000 + k, 10, 10, 40, 40, True) for k in range(300)]
    other = [(i, k, 10 * k, 5, 10 * k + 8, 20, True) for i in range(1, 60) for k in range(10)]
    schema = "image_id long, gt_idx long, x0 long, y0 long, x1 long, y1 long, ref_match boolean"
    gt = spark.createDataFrame(copies + other, schema)
    preds = gt.select("image_id", F.col("gt_idx").alias("q_idx"), "x0", "y0", "x1", "y1", F.lit(0.9).alias("score"), F.lit(0.5).alias("sim"))
    row = metrics.evaluate_boxes(gt, preds).first()
    # all 300 copies have the first copy as their best prediction: one is matched
    assert (row["tp"], row["fn"], row["fp"]) == (591, 299, 299)
    assert row["det_recall"] == 1.0 and row["ref_acc"] == 1.0
    assert matching.collapse_boxes(gt, "gt_idx").where("image_id = 0").count() == 1


def test_iou_threshold_must_be_positive(spark):
    gt, preds, pairs = tables(spark, [([1], [(0.9, 0.5)], [[0.7]])])
    with pytest.raises(ValueError):
        metrics.evaluate_pairs(gt, preds, pairs, iou_t=0.0)


def test_auc_counts_ties_half_and_is_null_for_one_class(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([0.1, 0.2, 0.3, 0.4]), rnd.randint(0, 1)) for _ in range(200)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "sim double, label int")
    assert metrics.roc_auc(df).first()["auc"] == pytest.approx(want)
    assert metrics.roc_auc(df, rows_per_chunk=1).first()["auc"] == pytest.approx(want)
    assert metrics.roc_auc(df.where("label = 1")).first()["auc"] is None


def test_best_threshold_equals_a_scan(spark):
    rnd = random.Random(4)
    rows = [(rnd.gauss(0.3 * y, 0.4), y) for y in (0, 1) for _ in range(80)]
    lo, hi = min(s for s, _ in rows), max(s for s, _ in rows)
    cuts = [lo + i * ((hi - lo) / 49) for i in range(49)] + [hi]
    acc = [sum((s > t) == bool(y) for s, y in rows) / len(rows) for t in cuts]
    best = max(range(50), key=lambda i: (acc[i], -i))
    row = metrics.best_threshold(spark.createDataFrame(rows, "sim double, label int"), n=50).first()
    assert (row["threshold"], row["accuracy"]) == (pytest.approx(cuts[best]), pytest.approx(acc[best]))


def test_assignment_is_greedy_by_cost(spark):
    rnd = random.Random(3)
    costs = [(i, q, g, round(rnd.random(), 1)) for i in range(8) for q in range(6) for g in range(5)]
    got = {tuple(r) for r in matching.assign_one_to_one(spark.createDataFrame(costs, "image_id long, q_idx long, gt_idx long, cost double"))
           .select("image_id", "q_idx", "gt_idx").collect()}
    want = set()
    for i in range(8):
        q_free, g_free = set(range(6)), set(range(5))
        for _, q, g in sorted((c, q, g) for k, q, g, c in costs if k == i):
            if q in q_free and g in g_free:
                want.add((i, q, g))
                q_free.remove(q)
                g_free.remove(g)
    assert got == want


def test_connected_groups_equal_a_search(spark):
    rnd = random.Random(6)
    nodes = [(0, n) for n in range(60)] + [(1, n) for n in range(40)]
    edges = [(0, n, n + 1) for n in range(30)] + [(1, rnd.randrange(40), rnd.randrange(40)) for _ in range(25)]
    label = {n: n[1] for n in nodes}
    for _ in nodes:
        for i, a, b in edges:
            label[i, a] = label[i, b] = min(label[i, a], label[i, b])
    out = matching.connected_groups(spark.createDataFrame(edges, "image_id long, room_id long, other long"),
                                    spark.createDataFrame(nodes, "image_id long, room_id long"), ["image_id"], "room_id", "other")
    assert {(r["image_id"], r["room_id"]): r["group_id"] for r in out.collect()} == label


def test_nearest_neighbours_equal_brute_force_in_small_blocks(spark):
    rnd = random.Random(9)
    vecs = [(n, n % 2, [rnd.random() for _ in range(5)]) for n in range(60)]
    df = spark.createDataFrame(vecs, "vec_id long, grp int, vector array<double>")
    got = matching.topk_nearest(df.withColumnRenamed("vec_id", "query_id"), df, k=3, by=["grp"], block_rows=7).collect()
    for q, grp, v in vecs:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), n) for n, g2, w in vecs if g2 == grp)[:3]
        mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [n for _, n in mine] == [n for _, n in near]


def test_review_names(spark):
    rows = [("v1", 0, "A b.c, d", "s1.png", "000_A_b_c_d.png"), ("v1", 1, "x", "s2.png", "001_y.png")]
    row = matching.review_pair_check(spark.createDataFrame(rows, "run string, pair_id int, real_filename string, synth_filename string, pair_image string")).first()
    assert row["bad_names"] == 1 and row["one_to_one"]


def test_sweep_of_a_thousand_points_equals_single_cut_offs(spark):
    """One sweep over 40 x 25 cut-offs; the plan of the staircases does not grow with the grid."""
    rnd = random.Random(11)
    box = lambda: (x := rnd.randrange(40), y := rnd.randrange(40), x + 19, y + 19)
    gt = spark.createDataFrame([(i, g, *box(), rnd.randrange(3) > 0) for i in range(12) for g in range(5)],
                               "image_id long, gt_idx long, x0 long, y0 long, x1 long, y1 long, ref_match boolean")
    preds = spark.createDataFrame([(i, q, *box(), rnd.random(), rnd.random() - 0.3) for i in range(12) for q in range(40)],
                                  "image_id long, q_idx long, x0 long, y0 long, x1 long, y1 long, score double, sim double")
    scores, matches = [k / 40 for k in range(40)], [k / 30 - 0.2 for k in range(25)]
    swept = {(r["score_t"], r["match_t"]): r for r in metrics.threshold_sweep(gt, preds, scores, matches, iou_t=0.3).collect()}
    assert len(swept) == 1000
    for s, m in rnd.sample(sorted(swept), 4):
        one = metrics.threshold_sweep(gt, preds, [s], [m], iou_t=0.3).first().asDict()
        many = swept[s, m].asDict()
        assert {k: pytest.approx(v) for k, v in one.items()} == many


def test_nearest_neighbours_skip_blocks_of_far_clusters(spark):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(12, 6)) * 50
    vectors = (centres[np.arange(1200) % 12] + rnd.normal(size=(1200, 6))).tolist()
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(vectors)], "grp int, vec_id long, vector array<double>")
    got = matching.topk_nearest(df.withColumnRenamed("vec_id", "query_id"), df, k=3, by=["grp"], block_rows=40).collect()
    all_of = np.array(vectors)
    want = {(q, r + 1): v for q in range(1200) for r, v in enumerate(np.lexsort((np.arange(1200), ((all_of - all_of[q]) ** 2).sum(1)))[:3])}
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in got} == want
    centre = scale.settle(df.where("vec_id < 12").selectExpr("grp", "cast(vec_id as int) as _pivot", "vector as centre"))
    q, c = (matching._cells(df.withColumnRenamed("vec_id", n), n, centre, ["grp"], 40) for n in ("query_id", "vec_id"))
    blocks = c.select("_pivot", "_block").distinct().count()
    assert matching.block_pairs(q, c, centre, ["grp"], 3).count() <= blocks ** 2 / 4


def test_costs_of_whole_images_equal_those_of_the_joins(spark):
    """Images in one call and images in blocks give the same, with points that only one side has, repeated queries, and nulls."""
    rnd = random.Random(8)
    q = [(i, i * 100 + k, p, rnd.uniform(-3, 3)) for i in range(12) for k in range(1 + i % 4) for p in rnd.sample(range(9), 6)]
    g = [(i, i * 100 + k, p, rnd.choice([0.0, 0.5, 1.0])) for i in range(1, 13) for k in range(1 + i % 3) for p in rnd.sample(range(9), 6)]
    q, g = [*q, (5, 501, 3, None), *[r for r in q if r[0] == 6][:2]], [*g, (7, 700, 2, None)]
    scores = [(i, k, rnd.random(), rnd.random()) for i, k in sorted({r[:2] for r in q})][1:]
    frames = [spark.createDataFrame(rows, kinds).repartition(3) for rows, kinds in (
        ([*scores, scores[4]], "image_id long, q_idx int, logit0 double, logit1 double"), (q, "image_id long, q_idx int, point_id int, logit double"), (g, "image_id long, gt_idx long, point_id int, value double"))]
    whole, joined = (sorted((*r[:3], round(r["cost"], 9)) for r in matching.match_cost(*frames, rows_per_group=n).collect() if r["cost"] is not None) for n in (1000, 0))
    assert whole and whole == joined and matching.match_cost(*frames).schema == matching.match_cost(*frames, rows_per_group=0).schema
    kept = [frames[0].dropDuplicates(["image_id", "q_idx"]), *(f.dropna() for f in frames[1:])]
    fused = {tuple(r) for r in matching.match_one_to_one(*kept, rounded=6).collect()}
    costs = matching.match_cost(*kept).withColumn("cost", F.round("cost", 6))
    assert fused and fused == {tuple(r) for r in matching.assign_one_to_one(costs, 0).collect()} == {tuple(r) for r in matching.assign_one_to_one(costs).collect()}
    assert fused == {tuple(r) for r in matching.match_one_to_one(*kept, rounded=6, rows_per_group=20).collect()}


def test_points_are_packed_before_they_are_shuffled(spark):
    """A point is no row of a shuffle, and pairs that are assigned where they are made are in none at all."""
    def frames(images):
        points = spark.range(images * 16).selectExpr("id div 16 image_id", "id div 8 ident", "id % 8 point_id", "id % 5 - 2.0d v")
        scores = spark.range(images * 2).selectExpr("id div 2 image_id", "id q_idx", "0.5d logit0", "id % 3 + 0.0d logit1")
        return scores, points.withColumnsRenamed({"ident": "q_idx", "v": "logit"}), points.withColumnsRenamed({"ident": "gt_idx", "v": "value"})

    def shuffled(df):
        store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
        df.write.format("noop").mode("overwrite").save()
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    for run in (lambda: matching.match_cost(*frames(2000)), lambda: matching.match_one_to_one(*frames(2000))):
        before = shuffled(spark.range(1))
        assert shuffled(run()) - before < 20_000  # 64,000 points
