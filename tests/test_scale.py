"""Chunked, split and hash-ordered building blocks against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from segstats import scale
from segstats.functions.scalar import hash_bits
from segstats.operators import intervals, rects, sampling, windows


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows belong to key 0."""
    rnd = random.Random(1)
    rows = [(0 if n % 3 == 0 else rnd.randrange(1, 40), n, rnd.randrange(500), rnd.random()) for n in range(3000)]
    return spark.createDataFrame(rows, "k int, id long, v long, x double").cache()


@pytest.mark.parametrize("through", [True, False])
def test_running_in_chunks_equals_one_window(skewed, through):
    cut = scale.with_chunks(skewed, "v", rows_per_chunk=100)
    assert "_chunk" in cut.columns
    largest = cut.groupBy("k", "_chunk").count().agg(F.max("count")).first()[0]
    assert largest < 200  # the hot key is spread as well
    got = scale.running(cut, ["k"], ["v", "id"], {"s": ("sum", "v"), "m": ("max", "x"), "n": ("min", "x")}, through=through)
    w = Window.partitionBy("k").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0 if through else -1)
    want = skewed.select("id", F.sum("v").over(w).alias("s"), F.max("x").over(w).alias("m"), F.min("x").over(w).alias("n"))
    assert sorted(map(tuple, got.select("id", "s", "m", "n").collect())) == sorted(map(tuple, want.collect()))


def test_row_numbers_without_groups(skewed):
    got = scale.row_numbers(skewed, ["v", "id"], rows_per_chunk=70).select("v", "id", "rn").collect()
    assert [r["rn"] for r in sorted(got, key=lambda r: (r["v"], r["id"]))] == list(range(1, 3001))


@pytest.mark.parametrize("chunk", [50, 10_000_000])
def test_quantiles_equal_numpy(skewed, chunk):
    got = {r["k"]: r for r in scale.quantile_columns(skewed, ["k"], "v", {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 1.0}, rows_per_chunk=chunk).collect()}
    values = {}
    for r in skewed.collect():
        values.setdefault(r["k"], []).append(r["v"])
    for k, vs in values.items():
        assert [got[k][c] for c in "abcde"] == pytest.approx(list(np.percentile(vs, [0, 10, 50, 90, 100])))


def test_kth_smallest_and_exact_splits(spark, skewed):
    ids = skewed.select("id")
    out = sampling.split(ids, "id", 0.9, seed=7).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in out} == {"train": 2700, "val": 300}
    few = sampling.holdout_k(ids, "id", 11, seed=7)
    assert few.where("split = 'test'").count() == 11 and few.count() == 3000
    tiny = spark.range(3).withColumnRenamed("id", "rid")
    assert sampling.holdout_k(tiny, "rid", 10).where("split = 'test'").count() == 3
    assert sampling.holdout_k(tiny, "rid", 0).where("split = 'test'").count() == 0
    head = [r["id"] for r in sampling.validation_head(ids, "id", 5, seed=7).collect()]
    order = ids.withColumn("h", hash_bits(7, "id")).orderBy("h", "id").collect()
    assert head == [r["id"] for r in order[2700:2705]]


def test_split_does_not_depend_on_partitioning(skewed):
    a = sampling.split(skewed.select("id").repartition(7), "id").collect()
    b = sampling.split(skewed.select("id").coalesce(1), "id").collect()
    assert sorted(a) == sorted(b)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain(spark, skewed, how):
    right = spark.createDataFrame([(k, 10 * k) for k in range(0, 40, 2)], "k int, w int")
    plain = skewed.join(right, "k", how)
    salted = scale.skew_join(skewed, right, ["k"], ["id"], how=how, salts=5)
    assert sorted(map(tuple, salted.select(plain.columns).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_both_sides_salted(skewed):
    left, right = skewed.select("k", "id").where("id < 600"), skewed.select("k", F.col("id").alias("id2")).where("id2 < 300")
    salted = scale.skew_join(left, right, ["k"], ["id"], ["id2"], salts=4)
    assert sorted(map(tuple, salted.select("k", "id", "id2").collect())) == sorted(map(tuple, left.join(right, "k").collect()))
    with pytest.raises(ValueError):
        scale.skew_join(left, right, ["k"], ["id"], ["id2"], how="left", salts=2)


def test_hot_key_is_split_at_run_time(spark):
    """With the settings of ``configure`` the join of a hot key runs in several tasks."""
    scale.configure(spark)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
                                          "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionFactor")}
    for key, value in zip(old, ("-1", "20KB", "20KB", "2")):
        spark.conf.set(key, value)
    try:
        ids = spark.range(0, 60_000, numPartitions=12)
        left = ids.select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000).alias("k"), "id")
        right = spark.range(0, 5000, numPartitions=6).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
        joined = scale.attach(left, right, ["k"], ["id"])
        assert joined.agg(F.sum("w")).first()[0] == left.agg(F.sum(F.col("k") * 2)).first()[0]
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def merged(ivs):
    out = []
    for lo, hi in sorted(i for i in ivs if i[1] > i[0]):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(i) for i in out]


@pytest.fixture(scope="module")
def spans(spark):
    rnd = random.Random(5)
    rows = [("hot" if n % 3 == 0 else f"k{n % 7}", n, (lo := rnd.randrange(5000)), lo + rnd.choice([0, 1, 5, 40])) for n in range(900)]
    return rows, spark.createDataFrame(rows, "k string, id long, lo long, hi long")


@pytest.mark.parametrize("chunk", [60, 10_000_000])
def test_merge_is_right_and_idempotent(spans, chunk):
    rows, df = spans
    got = intervals.merge_intervals(df, ["k"], rows_per_chunk=chunk)
    want = sorted((k, lo, hi) for k in {r[0] for r in rows} for lo, hi in merged([r[2:] for r in rows if r[0] == k]))
    assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, intervals.merge_intervals(got, ["k"]).collect())) == want


@pytest.mark.parametrize("chunk", [40, 10_000_000])
def test_visible_and_hidden_parts_make_up_each_segment(spans, chunk):
    rows, df = spans
    seg, hid = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    visible = intervals.subtract_intervals(seg, hid, ["k"], ["id"], bin_width=100, rows_per_chunk=chunk).collect()
    cover = intervals.intersect_intervals(seg, intervals.merge_intervals(hid, ["k"]), ["k"], ["id"], [], bin_width=100).collect()
    for k, n, lo, hi in [r for r in rows if r[1] % 2 == 0 and r[3] > r[2]]:
        parts = sorted((r["lo"], r["hi"]) for r in [*visible, *cover] if r["id"] == n)
        assert parts[0][0] == lo and parts[-1][1] == hi and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert merged([(r["lo"], r["hi"]) for r in visible if r["k"] == "hot"])  # something is left of the hot key too


def test_touching_intervals_merge_but_do_not_intersect(spark):
    a = spark.createDataFrame([(0, 1, 0.0, 2.0)], "k int, id int, lo double, hi double")
    b = spark.createDataFrame([(0, 2, 2.0, 3.0)], a.schema)
    assert [tuple(r) for r in intervals.merge_intervals(a.unionByName(b), ["k"]).collect()] == [(0, 0.0, 3.0)]
    assert intervals.intersect_intervals(a, b.withColumnRenamed("id", "id2"), ["k"], ["id"], ["id2"]).isEmpty()


def test_rect_union_equals_a_grid(spark):
    rnd = random.Random(3)
    boxes = [(i, (x := rnd.randrange(12)), (y := rnd.randrange(12)), x + rnd.randint(1, 6), y + rnd.randint(1, 6)) for i in range(5) for _ in range(5)]
    df = spark.createDataFrame(boxes, "k int, x0 long, y0 long, x1 long, y1 long")
    area = {r["k"]: r["area"] for r in rects.rect_union_area(df, ["k"]).collect()}
    edges = rects.rect_union_edges(df, ["k"]).collect()
    for i in range(5):
        grid = np.zeros((22, 22), int)
        for _, x0, y0, x1, y1 in [b for b in boxes if b[0] == i]:
            grid[y0 + 1:y1 + 1, x0 + 1:x1 + 1] = 1
        assert area[i] == grid.sum()
        assert sum(r["hi"] - r["lo"] for r in edges if r["k"] == i) == np.abs(np.diff(grid, axis=0)).sum() + np.abs(np.diff(grid, axis=1)).sum()


def test_windows_with_small_chunks(spark, skewed):
    ranks = {r["id"]: r["avg_rank"] for r in windows.avg_rank(skewed.select("id", "v"), "v", ["id"], rows_per_chunk=40).collect()}
    rows = skewed.select("id", "v").collect()
    vs = [r["v"] for r in rows]
    for r in rows[:50]:
        below, same = sum(v < r["v"] for v in vs), vs.count(r["v"])
        assert ranks[r["id"]] == below + (same + 1) / 2
    m = spark.createDataFrame([("a", 0, -1.0), ("a", 1, 0.2), ("a", 2, 0.2), ("a", 3, 0.3), ("b", 0, 0.0)], "run string, epoch int, value double")
    best = windows.running_best(m, rows_per_chunk=2).where("is_best").select("run", "epoch").collect()
    assert sorted(map(tuple, best)) == [("a", 1), ("a", 3)]


def test_batches_keep_or_drop_the_short_one(spark):
    images = spark.createDataFrame([(i, 33, 64) for i in range(5)], "image_id long, height long, width long")
    plan = {r["batch_id"]: (r["n_images"], r["max_h"], r["max_w"]) for r in windows.batch_plan(images, 2, rows_per_chunk=2).collect()}
    assert plan == {0: (2, 64, 64), 1: (2, 64, 64), 2: (1, 64, 64)}
    assert windows.batch_plan(images, 2, drop_last=True).count() == 2


@pytest.mark.parametrize("kind", ["string", "date", "timestamp", "binary"])
def test_running_takes_keys_of_any_kind(spark, kind):
    """Text and time keys give the same numbers below and above the size where a table is cut."""
    value = {"string": F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 4, "0")), "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")),
             "timestamp": F.timestamp_seconds("id"), "binary": F.lpad(F.col("id").cast("string"), 4, "0").cast("binary")}[kind]
    df = spark.range(60).select(F.pmod(F.col("id") * 7, F.lit(60)).alias("id")).withColumn("key", value).withColumn("n", F.lit(1).cast("bigint"))
    out = []
    for rows_per_chunk in (1000, 10):
        cut = scale.with_chunks(df, "key", rows_per_chunk)
        assert ("_chunk" in cut.columns) == (rows_per_chunk == 10)
        out.append(sorted((r["id"], r["s"]) for r in scale.running(cut, [], ["key"], {"s": ("sum", "n")}).collect()))
    assert out[0] == out[1] == [(i, i + 1) for i in range(60)]


def test_rounds_leave_one_table(spark):
    import os
    from urllib.parse import urlparse
    scale.ensure_checkpoint_dir(spark)
    folder = urlparse(spark.sparkContext.getCheckpointDir()).path
    before = set(os.listdir(folder))
    out = scale.until_stable(spark.range(3).withColumn("n", F.lit(5)), lambda d: d.withColumn("n", F.col("n") - 1), lambda d: F.col("n") > 0)
    assert [r["n"] for r in out.collect()] == [0, 0, 0] and len(set(os.listdir(folder)) - before) == 1


def test_skew_join_prepares_the_session(spark):
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "false")
    df = spark.range(3).withColumn("k", F.lit(1))
    assert scale.skew_join(df, df.withColumnRenamed("id", "other"), ["k"], ["id"]).count() == 9
    assert spark.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == "true"


@pytest.mark.parametrize("through", [True, False])
def test_prefix_scan_of_ties_and_null_keys_to_any_depth(spark, through):
    """One group with a single order value, a null group and many small ones, cut into chunks of 3 rows, whose totals are cut again."""
    rows = [(None if n % 5 == 0 else 0 if n % 5 < 3 else n, 7 if n % 5 in (1, 2) else n, n) for n in range(400)]
    df = spark.createDataFrame(rows, "k long, o long, v long")
    cut = scale.with_chunks(df, ["o"], 3, by=["k"])
    assert cut.groupBy("_chunk").count().agg(F.max("count")).first()[0] < 40 and cut.select("_chunk").distinct().count() > 60
    got = scale.running(cut, ["k"], ["o"], {"s": ("sum", "v"), "x": ("xor", "v")},
                        through=through, rows_per_chunk=3).collect()
    assert len(got) == 400
    for k in {r["k"] for r in got}:
        mine = sorted((r for r in got if r["k"] == k), key=lambda r: (r["o"], (r["s"] or 0)))
        s = x = None
        for r in mine:
            after = ((s or 0) + r["v"], (x or 0) ^ r["v"])
            assert (r["s"], r["x"]) == (after if through else (s, x))
            s, x = after
    numbers = scale.row_numbers(df.select("k", "o"), ["o"], ["k"], rows_per_chunk=3).groupBy("k").agg(F.count("rn"), F.countDistinct("rn"), F.max("rn")).collect()
    assert all(r[1] == r[2] == r[3] for r in numbers)
