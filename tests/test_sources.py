"""Readers, writers, streams and column functions on hand-made inputs."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from segstats.functions import geometry as g
from segstats.functions.scalar import saturation, strip_aux, weighted_choice
from segstats.operators import metrics, reports
from segstats.sources import logs, records
from segstats.streaming.jobs import ingest_annotations_stream, metric_rollup


def annotation(n, seg, **extra):
    return {"id": n, "category_id": 1, "category_name": "pattern1", "reference_tile": "t.png", "segmentation": seg, "num_holes": len(seg) - 1,
            "bbox": [0, 0, 4, 4], "area": 16.0, "role": "wall", **extra}


SQUARE = [[0, 0, 4, 0, 4, 4, 0, 4]]


def png(path, rows):
    """A small colour PNG written by hand."""
    h, w = len(rows), len(rows[0])
    raw = b"".join(b"\0" + bytes(v for px in row for v in px) for row in rows)
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture()
def data_set(tmp_path):
    for d in ("images", "annotations"):
        (tmp_path / d).mkdir()
    for i in range(3):
        name = f"synth_{i:06d}"
        png(tmp_path / "images" / f"{name}.png", [[(255, 0, 10), (1, 2, 3)], [(0, 0, 0), (200, 200, 200)], [(9, 8, 7), (50, 60, 70)]])
        doc = {"image": {"file_name": f"{name}.png", "width": 2, "height": 3}, "mode": "elevation", "annotations": [annotation(k, SQUARE) for k in range(i)]}
        (tmp_path / "annotations" / f"{name}.json").write_text(json.dumps(doc, indent=1))
    return tmp_path


def test_local_records_and_pixels(spark, data_set):
    recs = records.read_local_records(spark, str(data_set)).orderBy("file_name").collect()
    assert [len(r["annotations"]) for r in recs] == [0, 1, 2] and all(bytes(r["image"])[1:4] == b"PNG" for r in recs)
    px = records.read_pixels(spark, str(data_set / "images")).where("file_name = 'synth_000001.png'")
    got = {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in px.collect()}
    assert got == {(0, 0): (255, 0, 10), (0, 1): (1, 2, 3), (1, 0): (0, 0, 0), (1, 1): (200, 200, 200), (2, 0): (9, 8, 7), (2, 1): (50, 60, 70)}
    files = records.sorted_files(records.read_annotation_files(spark, str(data_set)), 2).collect()
    assert [r["file_name"] for r in files] == ["synth_000000.png", "synth_000001.png"]


def test_annotations_as_text_or_structs(spark):
    text = spark.createDataFrame([(0, json.dumps([annotation(5, SQUARE), {"id": 6, "segmentation": SQUARE}])), (1, "[]"), (2, "no json"), (3, None)], "record_id long, annotations string")
    parsed = records.normalise_annotations(text)
    assert [r["bad_annotations"] for r in parsed.orderBy("record_id").collect()] == [None, None, "no json", None]
    rows = records.explode_annotations(parsed, "record_id").orderBy("ann_idx").collect()
    assert [(r["id"], r["category_name"], r["role"]) for r in rows] == [(5, "pattern1", "wall"), (6, "pattern", "unknown")]
    again = records.normalise_annotations(parsed.select("record_id", "annotations"))
    assert records.explode_annotations(again, "record_id").count() == 2


def test_partitioned_records(spark, tmp_path):
    rows = [(i, "real-world-test" if i % 2 else "default", "test" if i % 2 else "train", "[]") for i in range(10)]
    path = str(tmp_path / "recs")
    spark.createDataFrame(rows, "record_id long, config string, split string, annotations string").write.partitionBy("config", "split").parquet(path)
    assert records.read_records(spark, path, "default").count() == 5
    assert [r["record_id"] for r in records.read_records(spark, path, "real-world-test", "test", max_records=2).collect()] == [1, 3]


def test_tile_manifest_order(spark, tmp_path):
    (tmp_path / "manifest.json").write_text(json.dumps({"z": {"p1": {"tile_file": "a.png"}, "p0": {"tile_file": "b.png"}}, "a": {"q": {"tile_file": "c.png"}}}))
    got = records.read_tile_manifest(spark, str(tmp_path / "manifest.json")).orderBy("category_id").collect()
    assert [tuple(r) for r in got] == [(1, "z", "p1", "a.png"), (2, "z", "p0", "b.png"), (3, "a", "q", "c.png")]


def test_large_images_stay_one_document_in_order(spark, tmp_path):
    anns = spark.range(10_001).select(F.lit(0).cast("long").alias("image_id"), F.col("id"), (10_000 - F.col("id")).alias("ann_idx")).unionByName(
        spark.createDataFrame([(1, 7, 0)], "image_id long, id long, ann_idx long"))
    anns = anns.select("*", F.lit("pattern1").alias("category_name"), F.lit(SQUARE[0]).cast("array<double>").alias("ring"), F.lit(1).alias("category_id"), F.lit("t").alias("reference_tile"),
                       F.lit(0).alias("num_holes"), F.array(F.lit(0.0)).alias("bbox"), F.lit(16.0).alias("area"), F.lit("wall").alias("role")).withColumn("segmentation", F.array("ring"))
    heads = spark.createDataFrame([(i, f"{i}.png", 9, 9, "elevation") for i in range(3)], "image_id long, file_name string, width long, height long, mode string")
    docs = records.annotation_documents(anns, heads)
    assert docs.count() == 3 and docs.where("image_id = 2").first()["annotations"] == []
    assert [a["id"] for a in docs.where("image_id = 0").first()["annotations"]] == list(range(10_000, -1, -1))
    records.write_annotations(docs, str(tmp_path / "out"), "parquet")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select(F.explode("annotations")).count() == 10_002


def test_pictures_that_are_missing_or_broken_are_marked(spark, data_set):
    (data_set / "images" / "broken.png").write_bytes(b"no picture")
    (data_set / "images" / "synth_000002.png").unlink()
    recs = {r["file_name"]: r for r in records.read_local_records(spark, str(data_set)).collect()}
    assert recs["synth_000002.png"]["picture_missing"] and not recs["synth_000001.png"]["picture_missing"]
    assert [r["file_name"] for r in records.unreadable_pictures(spark, str(data_set / "images")).collect()] == ["broken.png"]
    assert records.read_pixels(spark, str(data_set / "images")).where("file_name = 'broken.png'").isEmpty()
    (data_set / "annotations" / "synth_000001.json").unlink()
    assert [tuple(r) for r in records.read_synth_listing(spark, str(data_set)).collect()] == [("broken.png", "unknown"), ("synth_000000.png", "elevation"), ("synth_000001.png", "unknown")]


def test_broken_annotations_are_kept_apart(spark):
    good, wrong = annotation(5, SQUARE), {"id": "x", "segmentation": SQUARE}
    text = spark.createDataFrame([(0, json.dumps([good, wrong, "junk", 7, None])), (1, '{"id": 1}'), (2, json.dumps([wrong]))], "record_id long, annotations string")
    rows = {r["record_id"]: r for r in records.normalise_annotations(text).collect()}
    assert [a["id"] for a in rows[0]["annotations"]] == [5] and len(json.loads(rows[0]["bad_annotations"])) == 4
    assert rows[1]["annotations"] is None and rows[1]["bad_annotations"] == '{"id": 1}'
    assert rows[2]["annotations"] == [] and json.loads(json.loads(rows[2]["bad_annotations"])[0]) == wrong


def test_stream_rejects_broken_annotations(spark, tmp_path):
    from segstats.streaming import jobs
    (tmp_path / "in").mkdir()
    head = {"image": {"file_name": "a.png", "width": 2, "height": 2}, "mode": "elevation"}
    lines = [head | {"annotations": [annotation(1, SQUARE)]}, {**head, "image": {"file_name": "b.png"}, "annotations": "oops"},
             {**head, "image": {"file_name": "c.png"}, "annotations": [{"id": "x"}]}, {**head, "image": {"file_name": "d.png"}, "annotations": []}]
    (tmp_path / "in" / "x.json").write_text("\n".join([*map(json.dumps, lines), "no json"]))
    jobs.ingest_annotations_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["file_name"] for r in spark.read.parquet(str(tmp_path / "out" / "records")).collect()) == ["a.png", "d.png"]
    assert spark.read.parquet(str(tmp_path / "out" / "rejected")).count() == 3


def test_gray_is_a_byte(spark):
    row = spark.createDataFrame([(200.0, 199.0, 201.0), (199.0, 200.0, 200.0), (255.0, 255.0, 255.0)], "r double, g double, b double")
    from segstats.operators.pixels import to_gray
    assert sorted(r["r"] for r in to_gray(row).collect()) == [200.0, 200.0, 255.0]


def test_review_manifests(spark, tmp_path):
    for run in ("v1", "v2"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "manifest.csv").write_text('pair_id,real_filename,synth_filename,pair_image\n0,"A, B ""x""",s.png,000_A_B_x.png\n')
    got = logs.read_review_manifest(spark, str(tmp_path)).orderBy("run").collect()
    assert [(r["run"], r["real_filename"]) for r in got] == [("v1", 'A, B "x"'), ("v2", 'A, B "x"')]


def test_epoch_log_and_metric_table(spark, tmp_path):
    (tmp_path / "log.txt").write_text("noise\nEpoch 3: time 42s | train_loss 1.5000 | val_loss 2.0000 | synth_iou 0.5000 | ref_match_auc nan || real_iou 0.6000 | DIVERGENCE -0.1000\n"
                                      "Epoch 4: time 40s | train_loss 1.4000 | val_loss 1.9000 | synth_iou 0.5500 | ref_match_auc 0.9000\n")
    log = logs.read_epoch_log(spark, str(tmp_path / "log.txt")).orderBy("epoch")
    a, b = log.collect()
    assert (a["epoch"], a["seconds"], a["real_iou"], a["divergence"], a["ref_match_auc"]) == (3, 42, 0.6, -0.1, None)
    assert b["real_iou"] is None and b["ref_match_auc"] == 0.9
    table = str(tmp_path / "metrics")
    for run in ("r1", "r2"):
        logs.append_metrics(logs.metrics_from_log(log, run), table)
    back = logs.read_metrics(spark, table)
    assert back.count() == 18 and back.where("run = 'r1' and tag = 'divergence'").first()["value"] == -0.1


def test_rollup_of_a_stream_equals_the_table(spark, tmp_path):
    rows = [(f"2024-01-0{1 + n % 3} 10:00:00", "a" if n % 2 else "b", float(n)) for n in range(30)]
    df = spark.createDataFrame(rows, "ts string, tag string, value double").withColumn("ts", F.to_timestamp("ts"))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.write.parquet(src)
    stream = metric_rollup(spark.readStream.schema(df.schema).parquet(src))
    stream.writeStream.outputMode("complete").format("memory").queryName("rolled").trigger(availableNow=True).option("checkpointLocation", out).start().awaitTermination()
    got = sorted(map(tuple, spark.table("rolled").collect()))
    assert got == sorted(map(tuple, metric_rollup(df).collect())) and len(got) == 6


def test_arriving_annotation_files(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    doc = lambda n: json.dumps({"image": {"file_name": n, "width": 1, "height": 1}, "mode": "m", "annotations": []})
    (src / "a.json").write_text(doc("x.png") + "\n" + doc("y.png") + "\nbroken\n")
    ingest_annotations_stream(spark, str(src), out, cp).awaitTermination()
    (src / "b.json").write_text(doc("y.png") + "\n" + doc("z.png") + "\n")
    ingest_annotations_stream(spark, str(src), out, cp).awaitTermination()
    assert sorted(r["file_name"] for r in spark.read.parquet(f"{out}/records").collect()) == ["x.png", "y.png", "z.png"]
    assert [r["value"] for r in spark.read.parquet(f"{out}/rejected").collect()] == ["broken"]


def test_arrived_documents_are_held_as_a_table(spark, tmp_path, monkeypatch):
    """A batch is not held as uncompressed blocks of the cache, and what holds it goes with it."""
    import os

    from segstats import scale

    monkeypatch.setattr(type(spark.range(1)), "persist", lambda *_: pytest.fail("persisted"))
    scale.ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"image": {"file_name": "x.png", "width": 1, "height": 1}, "mode": "m", "annotations": [annotation(1, SQUARE)]}) + "\nbroken\n")
    ingest_annotations_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    good, bad = (spark.read.parquet(str(tmp_path / "out" / k)) for k in ("records", "rejected"))
    assert [(r["file_name"], len(r["annotations"])) for r in good.collect()] == [("x.png", 1)] and [r["value"] for r in bad.collect()] == ["broken"]
    assert set(os.listdir(folder)) == before


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def ring(*v):
    return F.array(*[F.lit(x) for x in v])


def test_small_shapes(spark):
    r = one(spark, g.polygon_area(ring(0, 0, 8, 0, 8, 8, 0, 8)).alias("square"), g.polygon_area(ring(3, 3, 3, 3, 3, 3)).alias("flat"),
            g.is_axis_rect(ring(0, 0, 4, 0, 4, 3, 0, 3)).alias("rect"), g.is_axis_rect(ring(0, 0, 4, 0, 4, 3, 1, 3)).alias("no_rect"),
            g.dedupe_vertices(ring(0.5, 0.5, 0.4, 0.4, 1.5, 2.5, 0.1, 0.0)).alias("deduped"), g.simplify_rectilinear(ring(0, 0, 2, 0, 4, 0, 4, 4, 4, 4, 0, 4)).alias("simple"),
            g.resize_plan(F.lit(5), F.lit(2000), 1000).alias("plan"), g.bbox_xywh(ring(1, 2, 5, 9), inclusive=True).alias("box"))
    assert (r["square"], r["flat"], r["rect"], r["no_rect"]) == (64.0, 0.0, True, False)
    assert r["deduped"] == [0, 0, 2, 2] and r["simple"] == [0, 0, 4, 0, 4, 4, 0, 4]
    assert (r["plan"]["nh"], r["plan"]["nw"]) == (2, 1000) and r["box"] == [1, 2, 5, 8]  # 2.5 rounds to 2


def test_four_quarter_turns_are_the_identity(spark):
    at = (3, 1, 10, 6)
    for _ in range(4):
        at = tuple(one(spark, g.flip_rot90(*[F.lit(v) for v in at], F.lit(False), F.lit(False), F.lit(1)).alias("m"))["m"])
    assert at == (3, 1, 10, 6)
    turned = one(spark, g.flip_rot90(F.lit(9), F.lit(0), F.lit(10), F.lit(6), F.lit(False), F.lit(False), F.lit(1)).alias("m"))["m"]
    assert tuple(turned) == (0, 0, 6, 10)  # the top right corner turns to the top left


def test_scalars(spark):
    r = one(spark, saturation(F.lit(0), F.lit(0), F.lit(0)).alias("black"), saturation(F.lit(200), F.lit(100), F.lit(200)).alias("s"), strip_aux(F.lit("aux12_loss_ce")).alias("k"),
            weighted_choice(F.lit(0.55), {"a": 55, "b": 15, "c": 30}).alias("w"))
    assert (r["black"], r["s"], r["k"], r["w"]) == (0.0, 127.5, "loss_ce", "b")


def test_losses_and_totals(spark):
    df = spark.createDataFrame([("aux0_loss_ce", 1.0), ("loss_mask", 2.0)], "key string, value double").withColumn("run", F.lit("r"))
    assert metrics.total_loss(df, ["run"]).first()["total_loss"] == 12.0
    big = spark.createDataFrame([(800.0, 1), (-800.0, 0)], "sim double, label int").withColumn("sim", F.col("sim") / 10)
    assert metrics.reference_loss(big).first()["loss_ref"] == pytest.approx(0.0)


def test_touch_report_takes_the_median_of_all_pairs(spark):
    members = spark.createDataFrame([(0, n, "a") for n in range(4)] + [(1, 0, "b")], "image_id long, obj_id long, category_name string")
    gaps = [(0, "a", i, j, float(g)) for (i, j), g in zip([(0, 1), (1, 2), (0, 2), (0, 3), (1, 3), (2, 3)], [3, 4, 90, 200, 300, 400])]
    rows = {r["image_id"]: r for r in reports.touch_report(members, spark.createDataFrame(gaps, "image_id long, category_name string, obj_id long, other long, gap double")).collect()}
    r = rows[0]
    assert (r["n_pairs"], r["touching_pairs"], r["touching_instances"], r["min_gap"], r["median_gap"]) == (6, 1, 2, 3.0, 145.0)
    assert (rows[1]["n_pairs"], rows[1]["median_gap"]) == (0, None)
