"""Masks against brute force."""

import os
import random
import subprocess
import sys
from math import gcd

import numpy as np
import pytest
from pyspark.sql import functions as F

from segstats.operators import masks, pixels


def on_edge(px, py, ring):
    pts = list(zip(ring[0::2], ring[1::2]))
    for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1]):
        if (x2 - x1) * (py - y1) == (y2 - y1) * (px - x1) and min(x1, x2) <= px <= max(x1, x2) and min(y1, y2) <= py <= max(y1, y2):
            return True
    return False


def inside(px, py, ring):
    if on_edge(px, py, ring):
        return True
    pts, odd = list(zip(ring[0::2], ring[1::2])), False
    for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1]):
        if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def pixels_of(rows):
    return {(r["y"], x) for r in rows for x in range(r["x0"], r["x1"] + 1)}


def test_rasterize_equals_point_tests(spark):
    rnd = random.Random(11)
    objects = []
    for n in range(40):
        ring = [rnd.randrange(0, 24) for _ in range(2 * rnd.randint(3, 7))]
        hole = [[rnd.randrange(4, 16) for _ in range(6)] for _ in range(n % 3)]
        objects.append((0, n, [ring, *hole]))
    objects.append((0, 99, [[5, 5, 5, 5, 5, 5]]))
    df = spark.createDataFrame(objects, "image_id long, obj_id long, segmentation array<array<long>>")
    got = masks.rasterize(df).collect()
    for _, n, (outer, *holes) in objects:
        want = {(y, x) for y in range(25) for x in range(25) if inside(x, y, outer) and not any(inside(x, y, h) for h in holes)}
        mine = [r for r in got if r["obj_id"] == n]
        assert pixels_of(mine) == want
        assert sum(r["x1"] - r["x0"] + 1 for r in mine) == len(want)  # no pixel twice


def test_pixel_count_follows_picks_theorem(spark):
    rings = [(0, 0, [[0, 0, 9, 0, 9, 4, 4, 4, 4, 9, 0, 9]]), (0, 1, [[0, 0, 12, 3, 7, 11]])]
    got = masks.mask_stats(masks.rasterize(spark.createDataFrame(rings, "image_id long, obj_id long, segmentation array<array<long>>"))).collect()
    for _, n, (ring,) in rings:
        pts = list(zip(ring[0::2], ring[1::2]))
        ends = list(zip(pts, pts[1:] + pts[:1]))
        area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in ends)) / 2
        border = sum(gcd(abs(a[0] - b[0]), abs(a[1] - b[1])) for a, b in ends)
        assert [r["area"] for r in got if r["obj_id"] == n] == [area + border / 2 + 1]


def test_vertices_are_truncated_towards_zero(spark):
    df = spark.createDataFrame([(0, 0, [[0.9, 0.9, 3.9, 0.2, 3.5, 2.7, -0.4, 2.1]])], "image_id long, obj_id long, segmentation array<array<double>>")
    assert pixels_of(masks.rasterize(df).collect()) == {(y, x) for y in range(3) for x in range(4)}


def test_span_subtraction_and_merge(spark):
    outer = spark.createDataFrame([(0, 0, 1, 0, 9), (0, 0, 1, 8, 14), (0, 0, 2, 0, 3)], "image_id long, obj_id long, y long, x0 long, x1 long")
    holes = spark.createDataFrame([(0, 0, 1, 3, 4), (0, 0, 1, 5, 6), (0, 0, 1, 14, 20), (0, 0, 2, 0, 3)], outer.schema)
    got = {tuple(r)[2:] for r in masks.subtract_holes(outer, holes).collect()}
    assert got == {(1, 0, 2), (1, 7, 13)}
    assert {tuple(r)[2:] for r in masks.merge_spans(outer, ["image_id", "obj_id", "y"]).collect()} == {(1, 0, 14), (2, 0, 3)}


def test_iou_is_symmetric_and_one_on_itself(spark):
    boxes = spark.createDataFrame([(0, 1, 0, 0, 9, 9), (0, 2, 5, 5, 14, 14), (0, 3, 4000, 0, 4200, 3)], "image_id long, obj_id long, x0 long, y0 long, x1 long, y1 long")
    spans = masks.box_spans(boxes)
    iou = {(r["a"], r["b"]): r["iou"] for r in masks.mask_iou(spans.withColumnRenamed("obj_id", "a"), spans.withColumnRenamed("obj_id", "b"), "a", "b", cell=64).collect()}
    assert iou[1, 1] == iou[2, 2] == iou[3, 3] == 1.0
    assert iou[1, 2] == iou[2, 1] == pytest.approx(25 / 175)
    assert (1, 3) not in iou
    asked = spark.createDataFrame([(0, 1, 3)], "image_id long, a long, b long")
    zero = masks.mask_iou(spans.withColumnRenamed("obj_id", "a"), spans.withColumnRenamed("obj_id", "b"), "a", "b", candidates=asked).first()
    assert zero["iou"] == 0.0 and zero["union_area"] == 100 + 201 * 4


def test_suppression_equals_the_sequential_walk(spark):
    rnd = random.Random(8)
    boxes = [(i, k, (x := rnd.randrange(60)), (y := rnd.randrange(60)), x + rnd.randint(8, 30), y + rnd.randint(8, 30)) for i in range(3) for k in range(14)]
    df = spark.createDataFrame(boxes, "image_id long, obj_id long, x0 long, y0 long, x1 long, y1 long")
    got = {(r["image_id"], r["obj_id"]): r["accepted"] for r in masks.suppress_overlaps(
        df.select("image_id", "obj_id", F.col("obj_id").alias("pos")), masks.box_spans(df)).collect()}
    for i in range(3):
        taken = np.zeros((120, 120), bool)
        for _, k, x0, y0, x1, y1 in [b for b in boxes if b[0] == i]:
            own = np.zeros_like(taken)
            own[y0:y1 + 1, x0:x1 + 1] = True
            keep = (own & taken).sum() <= max(64, int(0.03 * own.sum()))
            assert got[i, k] == keep
            if keep:
                taken |= own


def test_reference_box_lies_inside_its_mask(spark):
    boxes = spark.createDataFrame([(0, 0, 10, 10, 209, 179), (1, 0, 0, 0, 19, 300), (2, 0, 5, 5, 70, 70)], "image_id long, obj_id long, x0 long, y0 long, x1 long, y1 long")
    heads = spark.createDataFrame([(i, 400, 400) for i in range(3)], "image_id long, width long, height long")
    got = {r["image_id"]: r for r in masks.sample_reference_box(masks.box_spans(boxes), heads, min_size=32, max_size=128).collect()}
    for i, (x0, y0, x1, y1) in enumerate([(10, 10, 209, 179), (0, 0, 19, 300), (5, 5, 70, 70)]):
        r = got[i]
        if i == 1:  # narrower than the smallest patch: 32 x 32 at the centroid
            assert (r["try"], r["x"], r["y"], r["w"], r["h"]) == (0, 0, 134, 32, 32)
        else:
            assert r["try"] > 0 and x0 <= r["x"] and r["x"] + r["w"] - 1 <= x1 and y0 <= r["y"] and r["y"] + r["h"] - 1 <= y1
    named = boxes.select("image_id", "obj_id").unionByName(spark.createDataFrame([(2, 9)], "image_id long, obj_id long"))
    every = masks.sample_reference_box(masks.box_spans(boxes), heads, min_size=32, max_size=128, objects=named).collect()
    assert {r["image_id"]: r for r in every if r["obj_id"] == 0} == got and len(every) == 4
    assert [(r["x"], r["y"], r["w"], r["h"]) for r in every if r["obj_id"] == 9] == [(0, 0, 32, 32)]


def test_reference_box_of_packed_masks(spark):
    """A mask stays one row with its runs; packed boxes, span tables and masks with holes draw the same patches."""
    boxes = [(i, 0, 3 * i, 5, 3 * i + 40 + 7 * i, 60 + 9 * i) for i in range(8)]
    df = spark.createDataFrame(boxes, "image_id long, obj_id long, x0 long, y0 long, x1 long, y1 long")
    heads = spark.createDataFrame([(i, 90 + 10 * i, 110) for i in range(8)], "image_id long, width long, height long")
    draw = lambda m: sorted(tuple(r) for r in masks.sample_reference_box(m, heads, min_size=12, max_size=64).collect())
    packed = draw(masks.packed_boxes(df))
    assert packed == draw(masks.box_spans(df)) and len(packed) == 8
    ring = [[0, 0, 100, 0, 60, 90, 0, 90], [20, 20, 50, 20, 50, 60, 20, 60]]
    polygons = spark.createDataFrame([(i, 0, ring) for i in range(4)], "image_id long, obj_id long, segmentation array<array<long>>")
    cells = {(r["y"], x) for r in masks.rasterize(polygons.where("image_id = 0")).collect() for x in range(r["x0"], r["x1"] + 1)}
    drawn = draw(masks.rasterize_packed(polygons))
    assert drawn == draw(masks.rasterize(polygons)) and any(r[-1] > 0 for r in drawn)
    for _, _, x, y, w, h, tried in drawn:
        assert not tried or all((v, u) in cells for v in range(y, y + h) for u in range(x, x + w))


def test_gaps_equal_pixel_distances(spark):
    boxes = [(0, 1, 0, 0, 4, 4, "a"), (0, 2, 8, 7, 10, 9, "a"), (0, 3, 3, 3, 6, 6, "a"), (0, 4, 5, 0, 6, 4, "b"), (0, 5, 90, 90, 95, 95, "a")]
    df = spark.createDataFrame(boxes, "image_id long, obj_id long, x0 long, y0 long, x1 long, y1 long, category_name string")
    got = {(r["obj_id"], r["other"]): r["gap"] for r in masks.pairwise_gap(masks.box_spans(df), df, 10).collect()}
    assert got == {(1, 2): pytest.approx(5.0), (1, 3): 0.0, (2, 3): pytest.approx(5 ** 0.5)}
    every = {(r["obj_id"], r["other"]): r["gap"] for r in masks.pairwise_gap(masks.box_spans(df), df).collect()}
    assert len(every) == 6 and every[1, 5] == pytest.approx((86 ** 2 * 2) ** 0.5) and {k: v for k, v in every.items() if v <= 10} == got


def test_every_hole_is_removed(spark):
    ring = lambda x, y, w: [x, y, x + w, y, x + w, y + w, x, y + w]
    df = spark.createDataFrame([(0, 1, [[float(v) for v in r] for r in (ring(0, 0, 20), ring(2, 2, 3), ring(10, 10, 4))])], "image_id long, obj_id long, segmentation array<array<double>>")
    whole = masks.mask_stats(masks.rasterize(df)).first()["area"]
    outline = df.withColumn("segmentation", F.slice("segmentation", 1, 1))
    holes = df.select("image_id", "obj_id", F.explode(F.slice("segmentation", 2, 9)).alias("r")).select("image_id", "obj_id", F.array("r").alias("segmentation"))
    apart = masks.mask_stats(masks.subtract_holes(masks.rasterize(outline), masks.rasterize(holes))).first()["area"]
    assert whole == apart == 21 * 21 - 16 - 25


def test_executors_import_the_package_from_any_folder(tmp_path):
    """Spark started elsewhere, without the package on the path of its workers."""
    script = tmp_path / "job.py"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script.write_text(f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as entry
print("rows", entry.queries()["rasterize_spans"](spark, "/root/testdata/sf0.001").count())
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in done.stdout, done.stderr[-2000:]


def test_ink_skips_empty_masks_and_uses_strict_limit(spark):
    px = spark.createDataFrame([(0, y, x, float(10 * x)) for y in range(4) for x in range(4)], "image_id long, y int, x int, gray double")
    spans = spark.createDataFrame([(0, 1, 0, 0, 3), (0, 2, 9, 0, 3)], "image_id long, obj_id long, y long, x0 long, x1 long")
    heads = spark.createDataFrame([(0, 4, 4)], "image_id long, width long, height long")
    got = {r["obj_id"]: r["ink"] for r in pixels.ink_coverage(px, spans, heads, threshold=20).collect()}
    assert got == {1: 0.5}


def test_suppression_of_a_chain_of_two_hundred(spark):
    """Every item overlaps the one before it too much, so every other one stays; the rounds do not follow the chain."""
    n = 200
    items = spark.createDataFrame([(1, i, i) for i in range(n)] + [(2, 0, 0)], "image_id long, obj_id long, pos long")
    spans = spark.createDataFrame([(1, i, y, 12 * i, 12 * i + 19) for i in range(n) for y in range(10)] + [(2, 0, 0, 0, 5)], "image_id long, obj_id long, y long, x0 long, x1 long")
    got = {(r["image_id"], r["obj_id"]): r["accepted"] for r in masks.suppress_overlaps(items, spans).collect()}
    assert got == {(1, i): i % 2 == 0 for i in range(n)} | {(2, 0): True}


def random_polygons(seed, images, ident, most=6):
    """Polygons with slanted edges, holes (some far away) and repeated shapes; some images are empty, some objects have no outline."""
    rnd, rows = random.Random(seed), []
    for image in range(images):
        for k in range(rnd.randrange(most)):
            x, y, w, h = rnd.randrange(40), rnd.randrange(40), rnd.randrange(3, 30), rnd.randrange(3, 30)
            rings = [rnd.choice([[x, y, x + w, y, x + w, y + h, x, y + h], [x + w // 2, y, x + w, y + h, x, y + h - 2], [x, y, x + w, y + h, x + w, y, x, y + h], []])]
            rings += rnd.choice([[], [[x + 1, y + 1, x + w // 2, y + 1, x + w // 2, y + h // 2]], [[x, 5000, x + 2, 5000, x + 2, 5003]]])
            rows.append((image, k, rings))
    return rows, f"image_id long, {ident} long, segmentation array<array<long>>"


def test_crossings_of_a_place_pair_up():
    """Rings that cross a line more than twice, and twice at one point, against the point tests."""
    import pyarrow as pa
    from segstats.functions import scanlines

    rings = [[0, 0, 20, 0, 20, 12, 15, 4, 10, 12, 5, 4, 0, 12], [0, 0, 9, 9, 9, 0, 0, 9], [3, 1, 7, 5, 3, 9, 0, 5]]
    batch = pa.record_batch([pa.array(range(3)), pa.array([[[float(v) for v in r]] for r in rings], pa.list_(pa.list_(pa.float64())))], names=["id", "rings"])
    got = {k: set() for k in range(3)}
    for out in scanlines.batch_masks(batch, ["id"], "rings"):
        row, y, x0, x1 = scanlines.expand_runs(out.column("runs"))
        for i, line, a, b in zip(row, y, x0, x1):
            got[out.column("id")[int(i)].as_py()] |= {(int(line), x) for x in range(a, b + 1)}
    for k, ring in enumerate(rings):
        assert got[k] == {(y, x) for x in range(-1, 22) for y in range(-1, 14) if inside(x, y, ring)}


def test_polygons_of_whole_images_equal_the_joins(spark):
    """IoU, suppression and metrics of images in one row are those of the pair tables."""
    from segstats.operators import metrics

    a, b = (spark.createDataFrame(*random_polygons(s, 40, i)).repartition(3) for s, i in ((3, "gt_idx"), (4, "q_idx")))
    pairs = masks.mask_iou(masks.rasterize_packed(a, ("image_id", "gt_idx")), masks.rasterize_packed(b, ("image_id", "q_idx")))
    want = {tuple(r) for r in pairs.collect()}
    for rows in (1000, 8):
        found = masks.polygon_iou(a, b, rows_per_group=rows)
        assert want and {tuple(r) for r in found.collect()} == want and found.columns == pairs.columns
    gt = a.select("image_id", "gt_idx", (F.col("gt_idx") % 2 == 0).alias("ref_match"))
    preds = b.select("image_id", "q_idx", (F.col("q_idx") / 5).alias("score"), (F.col("q_idx") % 3 - 1.0).alias("sim"))
    cuts = ((0.1, 0.5), (-0.5, 0.5), 0.1)
    want = sorted(tuple(round(v, 9) for v in r) for r in metrics.evaluate_pairs(gt, preds, pairs, *cuts).collect())
    for rows in (1000, 16):
        assert sorted(tuple(round(v, 9) for v in r) for r in metrics.evaluate_masks(gt, a, preds, b, *cuts, rows_per_group=rows).collect()) == want
    polygons = spark.createDataFrame(*random_polygons(9, 40, "obj_id", 9))
    items = polygons.select("image_id", "obj_id", (F.col("obj_id") % 4).alias("pos"))
    want = {tuple(r) for r in masks.suppress_overlaps(items, masks.rasterize_packed(polygons), 0.1, 5).collect()}
    assert len({accepted for *_, accepted in want}) == 2
    for rows in (1000, 10):
        assert {tuple(r) for r in masks.suppress_polygons(items, polygons, 0.1, 5, rows).collect()} == want


@pytest.mark.parametrize("name, exchanges", [("span_iou", 2), ("suppress_overlaps", 2)])
def test_masks_of_an_image_are_not_shuffled(spark, name, exchanges):
    """Boxes are spread by image; masks are made and met there."""
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(moved) == exchanges and not [line for line in moved if "runs" in line]


@pytest.mark.parametrize("name", ["span_iou", "rasterize_spans"])
def test_rings_are_made_once(spark, name):
    """No filter on the rings goes below the spread of the boxes, where it would make them as well."""
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "CASE WHEN" in line]
    odd = spark.createDataFrame([(0, 1, None), (0, 2, []), (0, 3, [[]]), (0, 4, [None, [0, 0, 4, 0, 4, 4]]), (0, 5, [[], [0, 0, 4, 0, 4, 4]]), (0, 6, [[7]]), (0, 7, [[1, 1, 2, 1, 2, 2], None])],
                                "image_id long, obj_id long, segmentation array<array<long>>")
    assert [r["obj_id"] for r in masks.rasterize_packed(odd).collect()] == [7]
    assert masks.rasterize_packed(odd.where("obj_id < 3")).collect() == []


def test_small_pictures_in_one_call_equal_the_joins(spark):
    """Crops, ink and samples of pictures with gaps, nulls, odd boxes and missing headers."""
    rnd = random.Random(12)
    px = [(i, y, x, None if i == 5 and x == y else float(rnd.randrange(256))) for i in range(14) for y in range(-1, 6) for x in range(7) if rnd.random() < 0.8 or i % 3]
    boxes = [(i, i * 10 + k, rnd.randrange(-2, 6), rnd.randrange(-2, 6), rnd.randrange(-1, 9), rnd.randrange(1, 9)) for i in range(16) for k in range(i % 4)]
    spans = [(i, b, y + k, x, x + w - 1) for i, b, x, y, w, h in boxes for k in range(h)]
    points = [(i, i * 10 + k, rnd.choice([rnd.random(), 0.0, 1.0, float("nan")]), rnd.random()) for i in range(16) for k in range(3)]
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds).repartition(3)
    px, boxes, spans = frame(px, "image_id long, y int, x int, gray double"), frame(boxes, "image_id long, box_id int, x int, y int, w int, h int"), frame(spans, "image_id long, obj_id long, y int, x0 int, x1 int")
    points, headers = frame(points, "image_id long, point_id long, u double, v double"), frame([(i, 7, 6) for i in range(13)], "image_id long, width int, height int")
    runs = [lambda n: pixels.crop(px, boxes, rows_per_group=n), lambda n: pixels.ink_coverage(px, spans, headers, 100, rows_per_group=n),
            lambda n: pixels.bilinear_sample(px, points, headers, "gray", rows_per_group=n)]
    for run in runs:
        whole, mixed, joins = (run(n) for n in (1000, 60, 0))
        want = sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in joins.collect())
        assert want and whole.dtypes == joins.dtypes
        for found in (whole, mixed):
            assert sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in found.collect()) == want


@pytest.mark.parametrize("name", ["crop_patches", "ink_report", "bilinear_sample"])
def test_pixels_are_packed_before_they_are_shuffled(spark, name):
    """No pixel, line or corner is a row of a shuffle."""
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" in plan
    assert not [line for line in plan.splitlines() if "Exchange" in line and (" y#" in line or "(y#" in line or " x#" in line)]
