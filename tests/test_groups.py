"""Small keys are worked on in one row, large ones through joins: both must say the same."""

import random

import pytest
from pyspark.sql import functions as F

from segstats.operators import intervals, matching, rects


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def boxes():
    rnd, out = random.Random(8), []
    for image in range(60):
        for k in range(rnd.choice([1, 2, 4, 9, 30])):
            x, y = rnd.randrange(-6, 12), rnd.randrange(-6, 12)
            out.append((image, k, x, y, x + rnd.randrange(0, 6), y + rnd.randrange(0, 6)))
    return out


def frame(spark, boxes, name="room_id"):
    return spark.createDataFrame(boxes, f"image_id long, {name} long, x0 long, y0 long, x1 long, y1 long")


@pytest.mark.parametrize("limit", [0, 5, 1000])
def test_union_of_small_and_large_keys(spark, boxes, limit):
    """Area and outline equal those of cells, whichever way a key goes (0: all through joins)."""
    df = frame(spark, boxes)
    cells = {}
    for i, _, x0, y0, x1, y1 in boxes:
        cells.setdefault(i, set()).update((x, y) for x in range(x0, x1) for y in range(y0, y1))
    got = {r["image_id"]: r["area"] for r in rects.rect_union_area(df, ["image_id"], limit).collect()}
    assert got == {i: len(c) for i, c in cells.items() if c}
    edges = rects.rect_union_edges(df, ["image_id"], limit).collect()
    for i, c in cells.items():
        units = [(e["axis"], e["at"], u) for e in edges if e["image_id"] == i for u in range(e["lo"], e["hi"])]
        level = [("h", y + d, x) for x, y in c for d, o in ((0, -1), (1, 1)) if (x, y + o) not in c]
        upright = [("v", x + d, y) for x, y in c for d, o in ((0, -1), (1, 1)) if (x + o, y) not in c]
        assert sorted(units) == sorted(level + upright)


def test_union_of_small_keys_takes_one_shuffle(spark, boxes):
    assert plan_of(rects.rect_union_edges(frame(spark, boxes), ["image_id"])).count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("limit", [0, 5, 1000])
def test_groups_of_small_and_large_keys(spark, boxes, limit):
    df = frame(spark, boxes)
    label, links = {(i, k): k for i, k, *_ in boxes}, set()
    for i, a, x0, y0, x1, y1 in boxes:
        for _, b, u0, v0, u1, v1 in [o for o in boxes if o[0] == i and o[1] != a]:
            if (x1 == u0 and max(y0, v0) < min(y1, v1)) or (y1 == v0 and max(x0, u0) < min(x1, u1)):
                links.add((i, min(a, b), max(a, b)))
    edges = matching.shared_edges(df, ident="room_id", rows_per_group=limit)
    assert sorted(tuple(r) for r in edges.collect()) == sorted(links)
    before = None
    while label != before:
        before = dict(label)
        for i, a, b in links:
            label[i, a] = label[i, b] = min(label[i, a], label[i, b])
    stray = edges.unionByName(spark.createDataFrame([(0, 0, 999), (77, 1, 2)], edges.schema))  # ends that are no nodes lead nowhere
    out = matching.connected_groups(stray, df, ["image_id"], "room_id", "other", limit).collect()
    assert {(r["image_id"], r["room_id"]): r["group_id"] for r in out} == label and len(out) == len(label)


def test_groups_of_small_keys_take_no_rounds(spark, boxes, monkeypatch):
    monkeypatch.setattr(matching, "until_stable", None)
    df = frame(spark, boxes)
    nulls = df.select("image_id", "room_id").unionByName(spark.createDataFrame([(None, 4), (None, 4), (3, None)], "image_id long, room_id long"))
    out = matching.connected_groups(matching.shared_edges(df, ident="room_id"), nulls, ["image_id"], "room_id", "other").collect()
    assert len(out) == len(boxes) + 2 and {tuple(r) for r in out} >= {(None, 4, 4), (3, None, None)}


@pytest.mark.parametrize("limit", [0, 9, 1000])
def test_cover_of_small_and_large_keys(spark, boxes, limit):
    """Unit pieces of each line with one cluster on both sides, joined."""
    df = frame(spark, boxes).withColumn("cluster", F.col("room_id") % 2)
    lines = df.select("image_id", (2 * F.col("room_id")).alias("seg_id"), F.lit("v").alias("kind"), F.col("x1").alias("pos"), F.col("y0").alias("lo"), F.col("y1").alias("hi"))
    lines = lines.unionByName(df.select("image_id", (2 * F.col("room_id") + 1).alias("seg_id"), F.lit("h").alias("kind"), F.col("y1").alias("pos"), F.col("x0").alias("lo"), F.col("x1").alias("hi")))
    want = []
    for i, k, x0, y0, x1, y1 in boxes:
        own = [b for b in boxes if b[0] == i]
        for seg, pos, lo, hi, flip in ((2 * k, x1, y0, y1, False), (2 * k + 1, y1, x0, x1, True)):
            turned = [(b[1] % 2, *((b[3], b[2], b[5], b[4]) if flip else b[2:])) for b in own]
            on = [any(all(any(c == d and p <= pos - s and q >= pos + 1 - s and l <= u and u + 1 <= h for d, p, l, q, h in turned) for s in (0, 1)) for c in (0, 1))
                  for u in range(lo, hi)]
            start = None
            for u, yes in zip(range(lo, hi + 1), [*on, False]):
                if yes and start is None:
                    start = u
                if not yes and start is not None:
                    want.append((i, seg, start, u))
                    start = None
    got = intervals.two_sided_cover(lines, df, ["image_id"], rows_per_group=limit)
    if limit == 1000:
        assert plan_of(got).count("Exchange hashpartitioning") == 2
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and want


def test_points_pair_up_as_a_join_pairs_them(spark):
    """Shuffled as lists; missing, repeated and shuffled points, several blocks and null values included."""
    from segstats.operators import metrics

    rnd = random.Random(2)
    pred = [(i % 3, i, p, rnd.choice([None, 0.5, -2.0, float(p)])) for i in range(12) for p in rnd.sample(range(-70, 200), 40 + i)] + [(0, 0, None, 1.0), (1, 1, 5, 7.0), (1, 1, 5, 8.0)]
    gt = [(i % 3, i, p, rnd.choice([None, 0.0, 1.0])) for i in range(1, 13) for p in range(-80, 150, 1 + i % 2)] + [(0, 0, None, 1.0), (1, 1, 5, 0.25)]
    even = [(5, 99, p, float(p)) for p in range(8)]
    a = spark.createDataFrame(pred + even, "image_id long, q_idx long, point_id long, logit double").repartition(3)
    b = spark.createDataFrame(gt + even, "image_id long, q_idx long, point_id long, value double")
    out = metrics.paired_points(a, b, ["image_id", "q_idx"])
    assert "point_id" not in [line for line in plan_of(out).splitlines() if "Exchange hashpartitioning" in line][0]
    key = lambda r: tuple((v is not None, v) for v in r)
    joined = a.join(b, ["image_id", "q_idx", "point_id"]).select("image_id", "q_idx", "logit", "value")
    assert sorted(map(tuple, out.collect()), key=key) == sorted(map(tuple, joined.collect()), key=key)


@pytest.mark.parametrize("limit", [0, 12, 1000])
def test_grid_of_small_and_large_images(spark, limit):
    """Counts of images in rows, by joins and of both; ties, copies, nulls and images of one side included."""
    from segstats.operators import metrics

    rnd = random.Random(4)
    gt, preds = [(50, 0, 0, 0, 5, 5, 1), (None, 7, 0, 0, 5, 5, 1), (0, 900, None, 0, 5, 5, 0)], [(51, 0, 0, 0, 5, 5, 0.9, 0.9), (None, 3, 0, 0, 5, 5, 0.9, 0.9), (1, 901, 0, 0, 5, 5, 0.9, None)]
    for i in range(25):
        for k in range(rnd.choice([1, 3, 6, 14])):
            x, y, w, h = rnd.randrange(5), rnd.randrange(5), rnd.randrange(8), rnd.randrange(8)
            gt.append((i, k, x, y, x + w, y + h, rnd.randrange(2)))
            for c in range(rnd.randrange(3)):
                preds.append((i, 10 * k + c, x + rnd.randrange(2), y, x + w, y + h, rnd.choice([0.15, 0.35, 0.6]), rnd.choice([-0.5, 0.05, 0.7])))
    g = spark.createDataFrame(gt, "image_id long, gt_idx long, x0 long, y0 long, x1 long, y1 long, ref_match int")
    p = spark.createDataFrame(preds, "image_id long, q_idx long, x0 long, y0 long, x1 long, y1 long, score double, sim double")
    cuts = ((0.1, 0.3, 0.5), (-0.6, 0.0, 0.5))
    want = metrics.evaluate_pairs(g, p, matching.box_pairs(g, p), *cuts, count_unmatched_images=True).collect()
    got = metrics.evaluate_boxes(g, p, *cuts, count_unmatched_images=True, rows_per_group=limit).collect()
    assert len(got) == 9
    for a, b in zip(sorted(want), sorted(got)):
        assert tuple(b) == pytest.approx(tuple(a))


def test_grid_of_small_images_forms_no_pair_table(spark, boxes, monkeypatch):
    from segstats.operators import metrics

    monkeypatch.setattr(metrics, "box_pairs", None)
    gt = frame(spark, boxes, "gt_idx").withColumn("ref_match", F.lit(1))
    preds = frame(spark, boxes, "q_idx").withColumns({"score": F.lit(0.9), "sim": F.lit(0.9)})
    assert metrics.evaluate_boxes(gt, preds).first()["det_recall"] > 0
