"""Queries: records, reports, windows, sampling, streams' batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from segstats.functions import geometry as g
from segstats.functions.scalar import hash_uniform, padded_name, scaled_count
from segstats.operators import matching, reports, sampling, windows
from segstats.plans.registry import big, query, r6, rounded
from segstats.scale import settle, shared_folder
from segstats.schemas import ANNOTATION_FILE
from segstats.sources import logs, records
from segstats.streaming.jobs import ingest_annotations_stream
from segstats.streaming.jobs import metric_rollup as rollup

H32 = "('0x'||substr(md5({}),1,8))::bigint"
AREA = """area as (select image_id, obj_id, sum(case when ring_idx=0 then a else -a end) as area, count(*)-1 as holes from (select image_id, obj_id, ring_idx,
  abs(list_sum(list_transform(range(0,len(ring)//2), lambda i: ring[2*i+1]*ring[(2*i+3)%len(ring)+1]-ring[(2*i+2)%len(ring)+1]*ring[2*i+2])))/2 as a from
  (select image_id, obj_id, idx-1 as ring_idx, segmentation[idx] as ring from (select *, unnest(range(1,len(segmentation)+1)) as idx from fx_polygons) r) q) s group by 1,2)"""


def _annotations(s):
    """Annotations as the reader would deliver them: packed to JSON per image, parsed again, exploded."""
    return _bodies(s.by_image().polygons)


def _bodies(p, *keep):
    outline = F.get("segmentation", F.lit(0))
    body = F.struct(F.col("id"), (F.col("l_partkey") % 5 + 1).alias("category_id"), F.when(F.col("cat") < 2, F.col("category_name")).alias("category_name"),
                    F.concat(F.lit("tile_"), (F.col("l_partkey") % 5).cast("string"), F.lit(".png")).alias("reference_tile"), F.col("segmentation"),
                    (F.size("segmentation") - 1).alias("num_holes"), g.bbox_xywh(outline).alias("bbox"), g.area_with_holes(F.col("segmentation")).alias("area"),
                    F.when(F.col("role") != "garage", F.col("role")).alias("role"))
    return p.select("image_id", body.alias("a"), *keep)


@query(f"""with {AREA} select p.image_id, p.id, row_number() over (partition by p.image_id order by p.id)-1 as ann_idx, a.holes as num_holes, round(a.area,6)::double as area,
 case when cat<2 then p.category_name else 'pattern' end as category_name, case when p.role<>'garage' then p.role else 'unknown' end as role,
 list_min(list_transform(range(0,len(segmentation[1])//2), lambda i: segmentation[1][2*i+1]))::double as bx from fx_polygons p join area a on a.image_id=p.image_id and a.obj_id=p.obj_id""")
def annotation_json_roundtrip(s):
    """All annotations of an image in one document, stored as JSON text and read again."""
    docs = records.annotation_documents(_annotations(s).select("image_id", "a.*"), _headers(s))
    stored = settle(docs.select("image_id", F.to_json("annotations").alias("annotations")))
    listed = records.explode_annotations(records.normalise_annotations(stored), "image_id")
    return rounded(big(listed.select("image_id", "id", "ann_idx", "num_holes", "area", "category_name", "role", F.get("bbox", F.lit(0)).alias("bx")), "num_holes", "ann_idx"), "area", "bx")


def _headers(s):
    return s.images.select("image_id", F.concat(F.lit("img_"), F.col("image_id").cast("string"), F.lit(".png")).alias("file_name"), "width", "height", "mode")


# Each check is spoiled for some annotations: hole counts, boxes, areas, the place of holes, ids.
SPOILED = """spoiled as (select image_id, case when l_suppkey%17=0 then 0 else id end as id, rings, l_partkey, l_suppkey
 from (select image_id, id, len(segmentation) as rings, l_partkey, obj_id//1000%1000000 as l_suppkey from fx_polygons) p)"""


@query(f"""with {SPOILED} select image_id, id, l_partkey%11<>0 as holes_ok, l_partkey%9<>0 as bbox_ok, l_partkey%7<>0 as area_ok, not (rings>1 and l_suppkey%13=0) as holes_inside,
 count(*) over (partition by image_id, id)>1 as repeated_id from spoiled""")
def annotation_qa(s):
    flat = _bodies(s.by_image().polygons, "l_partkey", F.expr("obj_id div 1000 % 1000000").alias("l_suppkey")).select("image_id", "a.*", "l_partkey", "l_suppkey")
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    moved = F.transform("segmentation", lambda ring, i: F.transform(ring, lambda v: v + F.when((i > 0) & (supp % 13 == 0), F.lit(100_000)).otherwise(F.lit(0))))
    spoiled = flat.withColumns({"area": F.when(part % 7 == 0, F.col("area") + 1).otherwise(F.col("area")), "segmentation": moved,
                                "bbox": F.when(part % 9 == 0, F.transform("bbox", lambda v: v + 1)).otherwise(F.col("bbox")),
                                "num_holes": F.when(part % 11 == 0, F.col("num_holes") + 1).otherwise(F.col("num_holes")),
                                "id": F.when(supp % 17 == 0, F.lit(0).cast("bigint")).otherwise(F.col("id"))})
    return reports.annotation_qa(spoiled)


@query(f"""with {SPOILED} select count(*) as n, sum((l_partkey%11=0)::int)::bigint as bad_holes, sum((l_partkey%9=0)::int)::bigint as bad_bbox, sum((l_partkey%7=0)::int)::bigint as bad_area,
 sum((rings>1 and l_suppkey%13=0)::int)::bigint as holes_outside, sum((copies>1)::int)::bigint as repeated_ids from (select *, count(*) over (partition by image_id, id) as copies from spoiled) t""")
def annotation_violations(s):
    return reports.qa_violations(annotation_qa(s))


@query("select image_id, category_name, count(*) as n_instances, count(distinct reference_tile) as n_tiles from fx_gt group by 1,2")
def category_report(s):
    return reports.category_report(s.gt)


@query("""with i as (select g.image_id, least(w,h) as side, least(w,h)*(2048.0::double/greatest(i.width,i.height)) as resized from fx_gt g join fx_images i on g.image_id=i.image_id),
n as (select i.image_id, count(g.image_id) as n from fx_images i left join fx_gt g on g.image_id=i.image_id group by 1)
select (select count(*) from n) as n_images, (select round(avg(n),6) from n) as mean_instances, (select max(n) from n) as max_instances, (select round(median(n),6) from n) as median_instances,
 count(*) as n_instances, round(min(side),6)::double as side_min, round(min(resized),6) as resized_min,
 round(avg((resized<16)::int),6) as share_below_16, round(avg((resized<32)::int),6) as share_below_32, round(avg((resized<48)::int),6) as share_below_48,
 round(quantile_cont(side,0.1),6)::double as side_p10, round(median(side),6)::double as side_median, round(quantile_cont(side,0.9),6)::double as side_p90,
 round(quantile_cont(resized,0.1),6) as resized_p10, round(median(resized),6) as resized_median, round(quantile_cont(resized,0.9),6) as resized_p90 from i""")
def size_report(s):
    report = reports.size_report(s.gt.select("image_id", "w", "h"), s.images)
    counts = ("n_images", "max_instances", "n_instances")
    return rounded(report, *[c for c in report.columns if c not in counts])


PROFILE = """src as (select case when image_id%2=0 then 'synth' else 'real' end as source, * from fx_images), ins as (select s.source, g.image_id, g.w, g.h, g.w*g.h as area,
 s.width*s.height as px, 2048.0::double/greatest(s.width,s.height) as scale from fx_gt g join src s on s.image_id=g.image_id),
n as (select s.source, s.image_id, s.mono, count(g.image_id) as n from src s left join fx_gt g on g.image_id=s.image_id group by 1,2,3),
prof as (select a.source, n_images::double as n_images, n_instances::double as n_instances, mean_instances, mono_share, median_instances, area_share_p90, side_median from
 (select source, count(*) as n_images, sum(n) as n_instances, avg(n) as mean_instances, avg(mono::int) as mono_share, median(n) as median_instances from n group by 1) a
 join (select source, quantile_cont(area/px,0.9) as area_share_p90, median(least(w,h)*scale) as side_median from ins group by 1) b on a.source=b.source)"""


@query(f"""with {PROFILE}, l as (unpivot prof on n_images, n_instances, mean_instances, mono_share, median_instances, area_share_p90, side_median into name measure value v),
w as (select measure, max(case when source='real' then v end) as a, max(case when source='synth' then v end) as b from l group by 1)
select measure, round(a,6) as a, round(b,6) as b, round(b-a,6)+0.0::double as delta from w""")
def dataset_profile_compare(s):
    tagged = s.images.withColumn("source", F.when(F.col("image_id") % 2 == 0, "synth").otherwise("real"))
    ins = s.gt.join(tagged.select("image_id", "source"), "image_id").select("source", "image_id", "w", "h", (F.col("w") * F.col("h")).alias("area"))
    return rounded(reports.profile_compare(reports.dataset_profile(tagged, ins), "real", "synth"), "a", "b", "delta")


# ---------------------------------------------------------------- lists, windows, sets


@query("select image_id, count(*) as n_instances from fx_gt group by 1 order by 2 desc, 1 limit 25")
def top_n_by_count(s):
    return windows.top_n_by_count(s.gt, 25)


@query("select image_id, count(*) as n_instances from fx_gt group by 1 having count(*) between 4 and 8 order by 1 limit 1")
def first_with_count_between(s):
    return windows.first_with_count_between(s.gt, 4, 8)


@query("""with f as (select image_id, reference_tile, min(gt_idx) as p from fx_gt group by 1,2), d as (select *, dense_rank() over (partition by image_id order by p) as n from f)
select g.image_id, g.gt_idx, concat('pattern', d.n) as local_name from fx_gt g join d on d.image_id=g.image_id and d.reference_tile=g.reference_tile""")
def local_category(s):
    return windows.local_category(s.gt, pos="gt_idx").select("image_id", "gt_idx", "local_name")


@query("""with k as (select image_id, gt_idx, row_number() over (partition by image_id order by case when image_id%2=0 then y0+y1 else x0+x1 end,
 case when image_id%2=0 then x0+x1 else y0+y1 end, gt_idx)-1 as n from fx_gt) select image_id, gt_idx, ['brick','stone','wood'][n%3+1] as palette_entry from k""")
def cycle_assign(s):
    pieces = s.gt.select("image_id", "gt_idx", "x0", "y0", "x1", "y1", F.when(F.col("image_id") % 2 == 0, "h").otherwise("v").alias("axis"))
    return windows.cycle_assign(pieces, ["brick", "stone", "wood"], ["image_id"], "gt_idx").select("image_id", "gt_idx", "palette_entry")


BATCH = """p as (select image_id, greatest(1,round_even(height*(1024.0::double/greatest(width,height)),0))::bigint as h, greatest(1,round_even(width*(1024.0::double/greatest(width,height)),0))::bigint as w from fx_images),
b as (select *, (row_number() over (order by image_id)-1)//16 as batch_id from p),
plan as (select batch_id, count(*) as n_images, (ceil(max(h)/32)*32)::bigint as max_h, (ceil(max(w)/32)*32)::bigint as max_w, sum(h*w) as px from b group by 1)"""


def _sized(s):
    return s.images.select("image_id", g.resize_plan(F.col("height"), F.col("width"), 1024).alias("p")).select("image_id", F.col("p.nh").alias("height"), F.col("p.nw").alias("width"))


@query(f"with {BATCH} select batch_id, n_images, max_h, max_w, round(1-px/(n_images*max_h*max_w),6) as padding_waste from plan")
def batch_plan(s):
    return rounded(windows.batch_plan(_sized(s), 16), "padding_waste")


@query(f"with {BATCH} select batch_id, n_images, max_h, max_w, round(1-px/(n_images*max_h*max_w),6) as padding_waste from plan where n_images=16")
def batch_plan_drop_last(s):
    return rounded(windows.batch_plan(_sized(s), 16, drop_last=True), "padding_waste")


@query("select image_id, gt_idx, w*h as area from fx_gt qualify row_number() over (partition by image_id order by w*h desc, gt_idx)=1")
def largest_per_image(s):
    return windows.largest_per_group(s.gt.withColumn("area", F.col("w") * F.col("h")), ["image_id"], "gt_idx", "area")


@query("""with f as (select image_id, category_name, min(gt_idx) as first_pos from fx_gt group by 1,2)
select image_id, category_name, first_pos, row_number() over (partition by image_id order by first_pos) as order_no from f""")
def ordered_categories(s):
    return windows.ordered_distinct(s.gt, ["image_id"], "category_name", "gt_idx")


@query("""select distinct image_id, reference_tile from fx_gt where role='wall' except select image_id, reference_tile from fx_gt where role='garage'""")
def tile_difference(s):
    keys = ["image_id", "reference_tile"]
    return windows.set_difference(s.gt.where(F.col("role") == "wall"), s.gt.where(F.col("role") == "garage"), keys)


@query("""select image_id, reference_tile from fx_gt where role='wall' union select image_id, reference_tile from fx_gt where role='roof_plan'""")
def palette_union(s):
    return windows.palette_union(s.gt.where(F.col("role") == "wall"), s.gt.where(F.col("role") == "roof_plan"), ["image_id"], "reference_tile")


@query("""with c as (select *, sum((w>=150)::int) over (partition by image_id) as n from fx_gt) select image_id, gt_idx, w from c where n<2 or w>=150""")
def filter_with_fallback(s):
    return windows.filter_with_fallback(s.gt, F.col("w") >= 150, ["image_id"], ["gt_idx"], at_least=2).select("image_id", "gt_idx", "w")


@query("select image_id, gt_idx, w*h as area from fx_gt where w*h >= case when role='roof_plan' then 1444 else 2304 end")
def filter_min_area(s):
    return windows.filter_min_area(s.gt.withColumn("area", F.col("w") * F.col("h")), "area").select("image_id", "gt_idx", "area")


@query("select image_id, count(*) as n from fx_gt where image_id in (select image_id from fx_preds where score>0.9) group by 1")
def members_semi(s):
    kept = matching.semi_by_membership(s.gt, s.preds.where(F.col("score") > 0.9), ["image_id"], ["gt_idx"])
    return kept.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))


@query("select i.image_id from fx_images i where i.image_id not in (select image_id from fx_gt)")
def images_without_annotations(s):
    return matching.semi_by_membership(s.images, s.gt, ["image_id"], ["image_id"], keep=False).select("image_id")


@query("""select g.image_id, g.gt_idx, t.k+1 as tile_category_id, t.k is not null as tile_found from fx_gt g left join (select l_partkey%5 as k, concat('tile_', l_partkey%5, '.png') as f
 from lineitem where l_partkey%5<4 group by 1,2) t on t.f=g.reference_tile""")
def join_tiles(s):
    return matching.join_tiles(s.gt.withColumnRenamed("gt_idx", "ann_idx"), _tiles(s)).select(
        "image_id", F.col("ann_idx").alias("gt_idx"), "tile_category_id", "tile_found")


def _tiles(s):
    k = F.col("l_partkey") % 5
    return s.table("lineitem").where(k < 4).select((k + 1).alias("category_id"), F.concat(F.lit("tile_"), k.cast("string"), F.lit(".png")).alias("tile_file")).distinct()


@query("select image_id, gt_idx from fx_gt where l_partkey%5=4")
def orphan_annotations(s):
    return matching.orphan_annotations(s.gt.withColumnRenamed("gt_idx", "ann_idx"), _tiles(s)).select("image_id", F.col("ann_idx").alias("gt_idx"))


MANIFEST = """man as (select o_orderpriority as run, o_custkey as pair_id, concat('Plan set, ', c_name, ' v.', o_custkey%7) as real_filename, concat('synth_', o_orderkey, '.png') as synth_filename,
 concat(case when o_custkey<1000 then lpad(cast(o_custkey as varchar),3,'0') else cast(o_custkey as varchar) end, '_', case when o_orderkey%50=0 then 'wrong' else concat('Plan_set_', replace(c_name,'#','') , '_v_', o_custkey%7) end, '.png') as pair_image
 from orders join customer on c_custkey=o_custkey)"""


def _manifest(s):
    o = s.table("orders").join(s.table("customer"), F.col("c_custkey") == F.col("o_custkey"))
    seven = (F.col("o_custkey") % 7).cast("string")
    name = F.when(F.col("o_orderkey") % 50 == 0, F.lit("wrong")).otherwise(F.concat(F.lit("Plan_set_"), F.regexp_replace("c_name", "#", ""), F.lit("_v_"), seven))
    return o.select(F.col("o_orderpriority").alias("run"), F.col("o_custkey").alias("pair_id"), F.concat(F.lit("Plan set, "), F.col("c_name"), F.lit(" v."), seven).alias("real_filename"),
                    padded_name("synth_", F.col("o_orderkey"), 1, ".png").alias("synth_filename"), F.concat(F.format_string("%03d", "o_custkey"), F.lit("_"), name, F.lit(".png")).alias("pair_image"))


@query(f"""with {MANIFEST} select run, count(*) as n_pairs, count(distinct real_filename) as n_real, count(distinct synth_filename) as n_synth,
 sum((split_part(pair_image,'_',2)='wrong.png')::int)::bigint as bad_names, count(*)=count(distinct real_filename) and count(*)=count(distinct synth_filename) as one_to_one from man group by 1""")
def review_pair_check(s):
    return matching.review_pair_check(_manifest(s))


RUNS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(f"""with {MANIFEST} select real_filename, """ + ", ".join(f"""min(case when run='{r}' then synth_filename end) as "{r}\"""" for r in RUNS) + " from man group by 1")
def cross_run_pairs(s):
    return matching.cross_run_pairs(_manifest(s), RUNS)


PICTURES = """real as (select n_nationkey as pos, n_name as real_filename, case n_regionkey%3 when 0 then 'elevation' when 1 then 'freeform' else 'roof_plan' end as mode,
  0.5+(n_nationkey*7%10)/8.0::double as aspect, (n_nationkey*3%11)/11.0::double as mean, (n_nationkey*5%13)/26.0::double as std, (n_nationkey%4)/4.0::double as white, (n_nationkey%6)/24.0::double as edge from nation),
synth as (select p_partkey as synth_pos, concat('synth_', p_partkey, '.png') as synth_filename, case p_size%4 when 0 then 'elevation' when 1 then 'freeform' when 2 then 'roof_plan' else 'unknown' end as mode,
  0.4+(p_partkey*37%101)/60.0::double as aspect, (p_partkey*13%97)/97.0::double as mean, (p_size*7%53)/106.0::double as std, (p_partkey*11%89)/89.0::double as white, (p_size%23)/92.0::double as edge from part)"""
DISTANCE = """4.0::double*abs(ln(greatest(r.aspect,1e-6)/greatest(s.aspect,1e-6)))+2.0::double*abs(r.mean-s.mean)+2.0::double*abs(r.std-s.std)+2.5::double*abs(r.white-s.white)+3.0::double*abs(r.edge-s.edge)"""


def _pictures(s, real: bool):
    """Reals from nation, synths from part, with made-up features."""
    if real:
        k, mode, names = F.col("n_nationkey"), F.col("n_regionkey") % 3, ("elevation", "freeform", "roof_plan")
        features = (0.5 + (k * 7 % 10) / 8.0, (k * 3 % 11) / 11.0, (k * 5 % 13) / 26.0, (k % 4) / 4.0, (k % 6) / 24.0)
        ids = (k.alias("pos"), F.col("n_name").alias("real_filename"))
    else:
        k, size = F.col("p_partkey"), F.col("p_size")
        mode, names = size % 4, ("elevation", "freeform", "roof_plan", "unknown")
        features = (0.4 + (k * 37 % 101) / 60.0, (k * 13 % 97) / 97.0, (size * 7 % 53) / 106.0, (k * 11 % 89) / 89.0, (size % 23) / 92.0)
        ids = (k.alias("synth_pos"), F.concat(F.lit("synth_"), k.cast("string"), F.lit(".png")).alias("synth_filename"))
    named = F.get(F.array(*map(F.lit, names)), mode.cast("int"))
    return s.table("nation" if real else "part").select(*ids, named.alias("mode"), F.struct(*[f.alias(n) for f, n in zip(features, matching.PICTURE_FEATURES)]).alias("features"))


CHOSEN = f"""with recursive {PICTURES}, step(i, used, pick) as (select 0::bigint, []::bigint[], null::bigint union all
  select st.i+1, list_append(any_value(st.used), arg_min(s.synth_pos, row(s.mode<>r.mode, {DISTANCE}, s.synth_pos))), arg_min(s.synth_pos, row(s.mode<>r.mode, {DISTANCE}, s.synth_pos))
  from step st join (select *, row_number() over (order by pos)-1 as i from real) r on r.i=st.i join synth s on not list_contains(st.used, s.synth_pos) group by st.i),
chosen as (select (step.i-1)::int as pair_id, r.real_filename, s.synth_filename, round({DISTANCE},6) as distance from step
 join (select *, row_number() over (order by pos) as i from real) r on r.i=step.i join synth s on s.synth_pos=step.pick)"""


@query(CHOSEN + " select * from chosen")
def choose_review_pairs(s):
    chosen = matching.choose_review_pairs(_pictures(s, True), _pictures(s, False))
    return rounded(chosen.drop("pair_image"), "distance")


@query(f"""with {PICTURES} select r.pos, s.synth_pos, round({DISTANCE},6) as distance from real r join synth s on r.mode=s.mode""")
def picture_distance(s):
    left = _pictures(s, True).select("pos", "mode", F.col("features").alias("a"))
    pairs = _pictures(s, False).select("synth_pos", "mode", F.col("features").alias("b")).join(left, "mode")
    return rounded(pairs.select("pos", "synth_pos", matching.picture_distance(F.col("a"), F.col("b")).alias("distance")), "distance")


# ---------------------------------------------------------------- sources: written to the shared folder and read again


@query("""select image_id as record_id, mode, width, height from fx_images where image_id%10<2""")
def records_of_a_split(s):
    """Records in folders by config and split; one of each is read."""
    path = shared_folder(s.spark, "records")
    rows = s.images.select(F.col("image_id").alias("record_id"), "mode", "width", "height", F.lit("default").alias("config"),
                           F.when(F.col("image_id") % 10 < 2, F.lit("test")).otherwise(F.lit("train")).alias("split"))
    rows.write.partitionBy("config", "split").parquet(path)
    return records.read_records(s.spark, path, "default", "test").select("record_id", "mode", "width", "height")


@query(f"""with {AREA} select p.image_id, p.id, row_number() over (partition by p.image_id order by p.id)-1 as ann_idx, a.holes as num_holes, i.mode
 from fx_polygons p join area a on a.image_id=p.image_id and a.obj_id=p.obj_id join fx_images i on i.image_id=p.image_id""")
def annotation_files(s):
    """Annotation documents written as JSON in folders by mode and read with the fixed schema."""
    path = shared_folder(s.spark, "annotations")
    records.write_annotations(records.annotation_documents(_annotations(s).select("image_id", "a.*"), _headers(s)), path, compression="gzip")
    docs = s.spark.read.schema(ANNOTATION_FILE).json(path)
    image = F.regexp_extract("image.file_name", r"(\d+)", 1).cast("bigint").alias("image_id")
    return big(records.explode_annotations(docs.select(image, "mode", "annotations"), "image_id", "mode").select("image_id", "id", "ann_idx", "num_holes", "mode"), "ann_idx")


@query("""select row_number() over (order by r_name, n_name)::int as category_id, r_name as image_key, n_name as pattern_key, concat('tile_', n_nationkey, '.png') as tile_file
 from nation join region on n_regionkey=r_regionkey""")
def tile_manifest(s):
    """A manifest {image: {pattern: {tile_file}}} and its tiles in order."""
    tiles = s.table("nation").join(s.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    tile = F.struct(F.col("n_name").alias("key"), F.struct(F.concat(F.lit("tile_"), F.col("n_nationkey").cast("string"), F.lit(".png")).alias("tile_file")).alias("value"))
    images = tiles.groupBy("r_name").agg(F.map_from_entries(F.array_sort(F.collect_list(tile))).alias("value"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("r_name").alias("key"), F.map_entries("value").alias("entries"))))
    whole = images.agg(F.to_json(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.map_from_entries(e["entries"]).alias("value"))))).alias("value"))
    return records.parse_tile_manifest(whole)


@query(CHOSEN + """ select 'r1' as run, pair_id, real_filename, synth_filename, printf('%03d_%s.png', pair_id, replace(real_filename, ' ', '_')) as pair_image from chosen""")
def review_manifest(s):
    """The manifest of the chosen pairs, written as CSV and read again."""
    path = shared_folder(s.spark, "review")
    logs.write_review_manifest(matching.choose_review_pairs(_pictures(s, True), _pictures(s, False)), path, "r1")
    return logs.read_review_manifest(s.spark, path)


@query("""select run, tag, epoch as step, round(value,6) as value from fx_metrics""")
def metric_tables(s):
    """Metrics appended in two steps, and the table they make."""
    path = shared_folder(s.spark, "metrics")
    rows = s.metrics.select("run", "tag", F.col("epoch").alias("step"), "value")
    for tag in ("synth_iou", "real_iou"):
        logs.append_metrics(rows.where(F.col("tag") == tag), path)
    return rounded(logs.read_metrics(s.spark, path), "value")


@query("""with n as (select image_id, count(*) as n from fx_polygons group by 1)
select concat('img_', i.image_id, '.png') as file_name, coalesce(n, 0) as n_annotations from fx_images i left join n on n.image_id=i.image_id where i.image_id%7<>0 and i.image_id%11<>0
union all select null as file_name, count(*) as n_annotations from fx_images where image_id%7=0 or image_id%11=0""")
def ingested_stream(s):
    """Arriving documents; every seventh has no list of annotations, every eleventh a broken one.  The row without a name counts what was rejected."""
    path = shared_folder(s.spark, "stream")
    docs = records.annotation_documents(_annotations(s).select("image_id", "a.*"), _headers(s)).withColumn("text", F.to_json(F.struct("image", "mode", "annotations")))
    spoiled = F.when(F.col("image_id") % 7 == 0, F.to_json(F.struct("image", "mode", F.lit("oops").alias("annotations")))).when(
        F.col("image_id") % 11 == 0, F.to_json(F.struct("image", "mode", F.array(F.struct(F.lit("x").alias("id"))).alias("annotations")))).otherwise(F.col("text"))
    docs.select(spoiled.alias("value")).write.option("compression", "gzip").text(f"{path}/in")
    ingest_annotations_stream(s.spark, f"{path}/in", f"{path}/out", f"{path}/state").awaitTermination()
    good = s.spark.read.parquet(f"{path}/out/records").select("file_name", F.size("annotations").cast("bigint").alias("n_annotations"))
    return good.unionByName(s.spark.read.parquet(f"{path}/out/rejected").agg(F.lit(None).cast("string").alias("file_name"), F.count(F.lit(1)).alias("n_annotations")))


# ---------------------------------------------------------------- draws

SPLIT = f"""h as (select o_orderkey, {H32.format("'42:'||o_orderkey")} as h from orders), r as (select *, row_number() over (order by h, o_orderkey) as rn, count(*) over () as n from h)"""


@query(f"with {SPLIT} select o_orderkey, case when rn<=floor(n*0.9) then 'train' else 'val' end as split from r")
def split_exact(s):
    return sampling.split(s.table("orders").select("o_orderkey"), "o_orderkey")


@query(f"with {SPLIT} select o_orderkey, case when rn<=10 then 'test' else 'train' end as split from r")
def holdout_k(s):
    return sampling.holdout_k(s.table("orders").select("o_orderkey"), "o_orderkey", 10)


@query(f"with {SPLIT} select o_orderkey from r where rn>floor(n*0.9) order by rn limit 50")
def validation_head(s):
    return sampling.validation_head(s.table("orders").select("o_orderkey"), "o_orderkey", 50).select("o_orderkey")


@query(f"""with h as (select o_orderkey, {H32.format("'42:3:'||o_orderkey")} as h from orders) select o_orderkey, row_number() over (order by h, o_orderkey) as position from h""")
def epoch_order(s):
    return sampling.epoch_order(s.table("orders").select("o_orderkey"), "o_orderkey", epoch=3)


@query("select o_orderkey as job_id, 7*1000003+o_orderkey as job_seed from orders")
def job_table(s):
    """A job for every order; order keys are numbered without gaps."""
    first, n = s.table("orders").agg(F.min("o_orderkey"), F.count(F.lit(1))).first()
    return sampling.job_table(s.spark, first or 0, n, 7)


@query(f"""with u as (select o_orderkey, {H32.format("'42:'||o_orderkey")}/4294967296.0::double as u from orders)
select o_orderkey, round(u,6) as u, case when u*100<55 then 'elevation' when u*100<70 then 'freeform' else 'roof_plan' end as drawn_mode from u""")
def weighted_choice(s):
    drawn = sampling.draw_modes(s.table("orders").select("o_orderkey"), "o_orderkey", {"elevation": 55, "freeform": 15, "roof_plan": 30})
    return rounded(drawn.withColumn("u", hash_uniform(42, "o_orderkey")), "u")


@query(f"""select image_id, gt_idx from fx_gt qualify row_number() over (partition by image_id order by {H32.format("'42:'||gt_idx")}, gt_idx)<=2""")
def sample_k_per_group(s):
    return sampling.sample_k_per_group(s.gt.select("image_id", "gt_idx"), ["image_id"], "gt_idx", 2)


@query(f"""with i as (select image_id, category_name, gt_idx, row_number() over (partition by image_id, category_name order by {H32.format("'42:'||image_id||':'||gt_idx")}, gt_idx) as rn from fx_gt),
t as (select image_id, category_name as target_category, gt_idx as reference_idx from i where rn=1
 qualify row_number() over (partition by image_id order by {H32.format("'43:'||image_id||':'||category_name")}, category_name)=1)
select g.image_id, g.gt_idx, t.target_category, t.reference_idx, (g.category_name=t.target_category)::int::double as ref_match, g.gt_idx=t.reference_idx as is_reference
 from fx_gt g join t on t.image_id=g.image_id""")
def reference_targets(s):
    return sampling.reference_targets(s.gt.select("image_id", "gt_idx", "category_name")).drop("category_name")


@query("select o_orderkey, o_totalprice from orders where o_orderkey in (3, 14, 159, 265, 358)")
def select_records(s):
    return sampling.select_records(s.table("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", [3, 14, 159, 265, 358])


@query("select image_id, round_even(3+(12-3)*(image_id%11)/10.0::double,0)::bigint as n from fx_images")
def scaled_counts(s):
    return s.images.select("image_id", scaled_count(F.lit(12), F.lit(3), F.col("image_id") % 11 / 10).alias("n"))


# ---------------------------------------------------------------- metric stream, batch form


@query("""select date_trunc('day', ts) as window_start, event_type as tag, count(value) as n, round(avg(value),6) as mean, round(min(value),6) as min, round(max(value),6) as max
 from events group by 1,2""")
def metric_rollup(s):
    rolled = rollup(s.table("events").withColumnRenamed("event_type", "tag"))
    return rounded(rolled.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), "mean", "min", "max")
