"""Dataset reports: sizes, ink, categories, touching neighbours, checks, comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstats.functions.geometry import area_with_holes, bbox_xywh, polygon_bbox, resize_plan
from segstats.scale import quantile_columns


def _one_row(frames: Sequence[DataFrame]) -> DataFrame:
    """One-row tables with different columns, side by side."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def size_report(instances: DataFrame, headers: DataFrame, max_size: int = 2048) -> DataFrame:
    """Instances per image and shorter box side (pixels, before and after resize).

    ``instances``: image_id, w, h (inclusive sides); ``headers``: image_id, width, height, every image once.
    """
    counts = instances.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
    per_image = headers.select("image_id").join(counts, "image_id", "left").select(F.coalesce("_n", F.lit(0)).alias("n"))
    scale = resize_plan(F.col("height"), F.col("width"), max_size)["scale"]
    side = F.least("w", "h")
    # Sides repeat, so rows are folded per image size before the header is looked up.
    folded = instances.groupBy("image_id", side.alias("side")).agg(F.count(F.lit(1)).alias("c"))
    sized = folded.join(headers.select("image_id", scale.alias("_scale")), "image_id").select(
        "c", F.col("side").cast("double").alias("side"), (F.col("side") * F.col("_scale")).alias("resized"))
    below = [(F.sum(F.when(F.col("resized") < t, F.col("c")).otherwise(0)) / F.sum("c")).alias(f"share_below_{t}") for t in (16, 32, 48)]
    return _one_row([
        per_image.agg(F.count(F.lit(1)).alias("n_images"), F.avg("n").alias("mean_instances"), F.max("n").alias("max_instances")),
        quantile_columns(per_image, [], "n", {"median_instances": 0.5}),
        sized.agg(F.sum("c").alias("n_instances"), F.min("side").alias("side_min"), F.min("resized").alias("resized_min"), *below),
        quantile_columns(sized, [], "side", {"side_p10": 0.1, "side_median": 0.5, "side_p90": 0.9}, "c"),
        quantile_columns(sized, [], "resized", {"resized_p10": 0.1, "resized_median": 0.5, "resized_p90": 0.9}, "c"),
    ])


def ink_report(values: DataFrame, role: str = "role", value: str = "ink") -> DataFrame:
    """Count, mean, median, p10 and p90 of ink, overall and per role."""
    named = F.coalesce(F.col(role), F.lit("unknown"))
    counts = values.groupBy(named.alias("_role"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    scoped = counts.select(F.explode(F.array(F.lit("overall"), F.col("_role"))).alias("scope"), "_v", "_c")
    base = scoped.groupBy("scope").agg(F.sum("_c").alias("n"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean"))
    return base.join(quantile_columns(scoped, ["scope"], "_v", {"median": 0.5, "p10": 0.1, "p90": 0.9}, "_c"), "scope")


def category_report(annotations: DataFrame, by: Sequence[str] = ("image_id",), category: str = "category_name",
                    tile: str = "reference_tile") -> DataFrame:
    """Instances and distinct reference tiles per category (names are local to an image)."""
    tiles = annotations.groupBy(*by, F.col(category).alias("category_name"), F.col(tile).alias("_tile")).agg(F.count(F.lit(1)).alias("_n"))
    return tiles.groupBy(*by, "category_name").agg(F.sum("_n").alias("n_instances"), F.count("_tile").alias("n_tiles"))


def touch_report(members: DataFrame, gaps: DataFrame, touch: float = 3.0) -> DataFrame:
    """Per image and category: pairs, touching pairs, instances with a touching neighbour, smallest and median gap.

    ``members``: image_id, obj_id, category_name; ``gaps``: all pairs of a group.
    The median takes the middle of the counted gaps, so half of all pairs have to
    be known in any case.
    """
    key = ["image_id", "category_name"]
    sizes = members.groupBy(*key).agg(F.count(F.lit(1)).alias("n_instances"))
    near = gaps.groupBy(*key).agg(F.count(F.lit(1)).alias("_near"), F.sum((F.col("gap") <= touch).cast("bigint")).alias("touching_pairs"),
                                  F.min("gap").alias("min_gap"))
    close = gaps.where(F.col("gap") <= touch)
    ends = close.select(*key, F.explode(F.array("obj_id", "other")).alias("obj_id")).distinct().groupBy(*key).agg(
        F.count(F.lit(1)).alias("touching_instances"))
    pairs = F.col("n_instances") * (F.col("n_instances") - 1) / 2
    joined = sizes.join(near, key, "left").join(ends, key, "left").withColumn("n_pairs", pairs.cast("bigint"))
    counted = joined.na.fill(0, ["_near", "touching_pairs", "touching_instances"])
    # Rank of the median among all pairs.
    lower, upper = _median_rows(gaps, counted.select(*key, "n_pairs"), key)
    full = counted.join(lower, key, "left").join(upper, key, "left")
    return full.select(*key, "n_instances", "n_pairs", "touching_pairs", "touching_instances", "min_gap",
                       ((F.col("_low") + F.col("_high")) / 2).alias("median_gap"))


def _median_rows(gaps: DataFrame, sizes: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    from segstats.scale import attach, running, with_chunks

    counts = with_chunks(gaps.groupBy(*key, "gap").agg(F.count(F.lit(1)).alias("_n")), ["gap"], by=key)
    upto = attach(running(counts, key, ["gap"], {"_upto": ("sum", "_n")}), sizes, key, ["gap"], how="inner")

    def row(rank: Column, out: str) -> DataFrame:
        return upto.where((rank > F.col("_upto") - F.col("_n")) & (rank <= F.col("_upto"))).select(*key, F.col("gap").alias(out))

    half = F.col("n_pairs")
    return row(F.floor((half + 1) / 2), "_low"), row(F.floor(half / 2) + 1, "_high")


def annotation_qa(annotations: DataFrame, seg: str = "segmentation") -> DataFrame:
    """Per annotation: agreement of hole count, box and area with the rings, holes inside, repeated id."""
    rings = F.col(seg)
    outline = polygon_bbox(F.get(rings, F.lit(0)))
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))

    def inside(h: Column) -> Column:
        b = polygon_bbox(h)
        return (b["x0"] >= outline["x0"]) & (b["y0"] >= outline["y0"]) & (b["x1"] <= outline["x1"]) & (b["y1"] <= outline["y1"])

    box = bbox_xywh(F.get(rings, F.lit(0)))
    near = F.forall(F.zip_with(box, F.col("bbox"), lambda a, b: F.abs(a - b) < 1e-6), lambda ok: ok)
    repeated = annotations.groupBy("image_id", "id").agg(F.count(F.lit(1)).alias("_copies"))
    return annotations.join(repeated, ["image_id", "id"]).select(
        "image_id", "id", (F.col("num_holes") == F.size(rings) - 1).alias("holes_ok"), near.alias("bbox_ok"),
        (F.abs(area_with_holes(rings) - F.col("area")) < 1e-6).alias("area_ok"), F.forall(holes, inside).alias("holes_inside"),
        (F.col("_copies") > 1).alias("repeated_id"))


def qa_violations(checked: DataFrame) -> DataFrame:
    """Number of annotations that fail each check."""
    def failed(c: str) -> Column:
        return F.sum((~F.col(c)).cast("bigint"))

    return checked.agg(F.count(F.lit(1)).alias("n"), failed("holes_ok").alias("bad_holes"), failed("bbox_ok").alias("bad_bbox"),
                       failed("area_ok").alias("bad_area"), failed("holes_inside").alias("holes_outside"),
                       F.sum(F.col("repeated_id").cast("bigint")).alias("repeated_ids"))


def dataset_profile(images: DataFrame, instances: DataFrame, by: str = "source", max_size: int = 2048) -> DataFrame:
    """Per data source: images, instances per image, area share p90, resized side median, mono share.

    ``images``: source, image_id, width, height, mono; ``instances``: source, image_id, w, h, area.
    """
    counts = instances.groupBy(by, "image_id").agg(F.count(F.lit(1)).alias("_n"))
    per_image = images.select(by, "image_id", "mono").join(counts, [by, "image_id"], "left").na.fill(0, ["_n"])
    head = images.select(by, "image_id", (F.col("width") * F.col("height")).alias("_px"),
                         resize_plan(F.col("height"), F.col("width"), max_size)["scale"].alias("_scale"))
    sized = instances.join(head, [by, "image_id"]).select(
        by, (F.col("area") / F.col("_px")).alias("share"), (F.least("w", "h") * F.col("_scale")).alias("side"))
    base = per_image.groupBy(by).agg(F.count(F.lit(1)).alias("n_images"), F.sum("_n").alias("n_instances"), F.avg("_n").alias("mean_instances"),
                                     F.avg(F.col("mono").cast("double")).alias("mono_share"))
    return (base.join(quantile_columns(per_image, [by], "_n", {"median_instances": 0.5}), by)
            .join(quantile_columns(sized, [by], "share", {"area_share_p90": 0.9}), by)
            .join(quantile_columns(sized, [by], "side", {"side_median": 0.5}), by))


def profile_compare(profile: DataFrame, a: str, b: str, by: str = "source") -> DataFrame:
    """The profile turned round: one row per measure, one column per source."""
    measures = [c for c in profile.columns if c != by]
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]))
    long = profile.select(by, rows.alias("_m")).select(by, "_m.*")
    wide = long.groupBy("measure").agg(F.max(F.when(F.col(by) == a, F.col("value"))).alias("a"), F.max(F.when(F.col(by) == b, F.col("value"))).alias("b"))
    return wide.withColumn("delta", F.col("b") - F.col("a"))
