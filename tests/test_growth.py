"""Queries whose cost must not grow faster than their tables."""

import __spark_entry__ as entry
import pytest

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ink_coverage", "ink_report", "crop_patches", "bilinear_sample"])
def test_pixels_are_not_broadcast_on_an_estimate(spark, name):
    """The estimate of the pixel view is that of its orders, 64 times too small."""
    assert "BroadcastHashJoin" not in plan_of(entry.queries()[name](spark, SF))


def test_masks_leave_python_as_few_runs(spark):
    """An upright mask has a handful of runs, however tall it is; a slanted one a run for each line at most."""
    from segstats.operators import masks

    tall = [[0, 0, 9, 0, 9, 5000, 0, 5000], [2, 10, 4, 10, 4, 4000, 2, 4000]]
    df = spark.createDataFrame([(0, 1, tall), (0, 2, [[0, 0, 8, 0, 8, 8]])], "image_id long, obj_id long, segmentation array<array<long>>")
    packed = {r["obj_id"]: r for r in masks.rasterize_packed(df).collect()}
    assert len(packed[1]["runs"]) == 4 * 4 and packed[1]["area"] == 10 * 5001 - 3 * 3991
    assert len(packed[2]["runs"]) == 4 * 9 and packed[2]["area"] == 45
    assert masks.rasterize(df).where("obj_id = 1").count() == 5001 + 3991


def test_polygons_are_made_after_the_shuffle(spark):
    """The boxes are spread, not the rings: a ring takes several times the room."""
    plan = plan_of(entry.queries()["mask_stats"](spark, SF))
    exchanges = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
    assert exchanges and all("gt_idx" in line and "obj_id" not in line for line in exchanges)


def test_holes_are_subtracted_a_row_for_a_mask(spark):
    """No span is shuffled: a mask meets its holes as one row."""
    assert "collect_set" not in plan_of(entry.queries()["hole_subtract"](spark, SF))


def test_rings_are_bound_once(spark):
    """A ring that is an expression is not made anew for each of its vertices."""
    from pyspark.sql import functions as F
    from segstats.functions import geometry as g

    ring = F.transform(F.col("r"), lambda v: v + 0.25)
    text = spark.createDataFrame([([0, 0, 8, 0, 8, 8],)], "r array<long>").select(g.ring_points(ring).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert text.count("0.25") == 1


@pytest.mark.parametrize("name", ["annotation_json_roundtrip", "annotation_files"])
def test_documents_are_grouped_where_the_boxes_were_spread(spark, name):
    """Annotations are not shuffled with their rings."""
    from segstats.plans.dataset import _annotations, _headers
    from segstats.plans.registry import Source
    from segstats.sources import records

    s = Source(spark, SF)
    plan = plan_of(records.annotation_documents(_annotations(s).select("image_id", "a.*"), _headers(s)))
    assert not [line for line in plan.splitlines() if "Exchange" in line and "segmentation" in line]
    assert sum("Exchange hashpartitioning" in line for line in plan.splitlines()) == 2  # boxes and headers


def test_many_small_images_share_a_call(spark):
    """Numbers far apart make no block of their own: the products of many images go through one call."""
    plan = plan_of(entry.queries()["match_cost"](spark, SF))
    line = next(line for line in plan.splitlines() if "FlatMapCoGroups" in line)
    assert "_call" in line and "image_id" not in line.split("product")[0]


def test_nearest_of_a_task_are_held_a_few_at_a_time():
    import numpy as np
    import pyarrow as pa
    from segstats.operators.matching import _nearest_of_task

    rnd = np.random.default_rng(3)
    rows = [(int(p), s, int(o), float(d)) for s, (p, o, d) in enumerate(zip(rnd.integers(0, 3, 5000), rnd.integers(0, 2, 5000), rnd.integers(0, 40, 5000)))]
    names = ["pos", "synth_pos", "other_mode", "distance"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[i:i + 100]]) for i in range(0, 5000, 100)]
    got = sorted(tuple(r.values()) for b in _nearest_of_task(iter(batches), 4, room=300) for r in b.to_pylist())
    want = [sorted((r for r in rows if (r[0], r[2]) == (p, o)), key=lambda r: (r[3], r[1]))[:4] for p in range(3) for o in range(2)]
    assert got == sorted(r for part in want for r in part)


def test_picture_features_take_bands_of_lines(spark):
    """Pixels are shuffled as arrays of a band, and steps across bands are not lost."""
    import numpy as np
    from segstats.operators import pixels

    gray = np.random.default_rng(5).integers(0, 256, (130, 7)).astype(float)
    rows = [(1, y, x, float(gray[y, x])) for y in range(130) for x in range(7)]
    df = pixels.image_features(spark.createDataFrame(rows, "image_id long, y int, x int, gray double").repartition(5))
    assert "array<bigint>" in df._jdf.queryExecution().analyzed().toString() or "ys" in plan_of(df)
    got, v = df.first(), gray / 255
    assert got["mean"] == pytest.approx(v.mean()) and got["std"] == pytest.approx(v.std()) and got["white"] == pytest.approx((v > 0.97).mean())
    assert got["edge"] == pytest.approx(np.abs(np.diff(v, axis=0)).mean() + np.abs(np.diff(v, axis=1)).mean()) and got["aspect"] == 7 / 130


def test_boxes_are_resized_as_a_whole(spark):
    """A box gives the spans that its lines would give, and no line is shuffled to its picture."""
    from segstats.operators import masks

    boxes = spark.createDataFrame([(0, 1, 3, 2, 40, 33), (0, 2, 0, 0, 5, 59)], "image_id long, obj_id long, x0 long, y0 long, x1 long, y1 long")
    plans = spark.createDataFrame([(0, 60, 80, 17, 23)], "image_id long, height long, width long, nh long, nw long")
    order = ["image_id", "obj_id", "y", "x0", "x1"]
    whole, lines = (sorted(tuple(r) for r in masks.resize_spans(df, plans).select(order).collect()) for df in (boxes, masks.box_spans(boxes)))
    assert whole and whole == sorted(set(lines)) and len(whole) == len(lines)


def test_variants_are_not_broadcast_on_an_estimate(spark):
    """The estimate of the variants is that of their fingerprints, 33 times too small."""
    from segstats.llm import simhash
    from segstats.scale import settle

    names = [f"spark.sql.{adaptive}autoBroadcastJoinThreshold" for adaptive in ("", "adaptive.")]
    old = {n: spark.conf.get(n, None) for n in names}
    try:
        for n in names:
            spark.conf.unset(n)
        fps = settle(spark.createDataFrame([(1,), (3,), (1 << 40,)], "fp long"))
        found = simhash.links(fps)
        assert "BroadcastHashJoin" not in plan_of(found)
        assert sorted(tuple(r) for r in found.collect()) == [(1, 3), (1, 1 << 40), (3, 1 << 40)]
    finally:
        for n, v in old.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
