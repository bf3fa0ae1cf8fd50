"""Queries: polygons, rectangles, intervals, shapes of pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from segstats.functions import geometry as g
from segstats.operators import intervals, masks, matching
from segstats.operators.rects import rect_union_area, rect_union_edges
from segstats.plans.registry import big, query, r6, rounded

# ---------------------------------------------------------------- polygons

# Vertices of every ring, one row each, in the checking engine.
VERTS = """rings as (select image_id, obj_id, r.idx-1 as ring_idx, segmentation[r.idx] as ring from (select *, unnest(range(1, len(segmentation)+1)) as idx from fx_polygons) r),
verts as (select image_id, obj_id, ring_idx, i, len(ring)//2 as n, ring[2*i+1] as x, ring[2*i+2] as y from (select *, unnest(range(0, len(ring)//2)) as i from rings) v),
edges as (select a.image_id, a.obj_id, a.ring_idx, a.i, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from verts a join verts b
  on a.image_id=b.image_id and a.obj_id=b.obj_id and a.ring_idx=b.ring_idx and b.i=(a.i+1)%a.n)"""


@query(f"with {VERTS} select image_id, obj_id, round(abs(sum(x1*y2-x2*y1))/2,6) as area from edges where ring_idx=0 group by 1,2")
def polygon_area(s):
    return s.polygons.select("image_id", "obj_id", r6(g.polygon_area(F.get("segmentation", F.lit(0)))).alias("area"))


@query(f"""with {VERTS}, a as (select image_id, obj_id, ring_idx, abs(sum(x1*y2-x2*y1))/2 as area from edges group by 1,2,3)
select image_id, obj_id, round(sum(case when ring_idx=0 then area else -area end),6) as area from a group by 1,2""")
def area_with_holes(s):
    return s.polygons.select("image_id", "obj_id", r6(g.area_with_holes(F.col("segmentation"))).alias("area"))


@query(f"with {VERTS} select image_id, obj_id, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from verts where ring_idx=0 group by 1,2")
def polygon_bbox(s):
    return s.polygons.select("image_id", "obj_id", F.inline(F.array(g.polygon_bbox(F.get("segmentation", F.lit(0))))))


@query("select image_id, obj_id, idx-1 as ring_idx, len(segmentation[idx])//2 as n_points from (select *, unnest(range(1, len(segmentation)+1)) as idx from fx_polygons) r")
def explode_rings(s):
    from segstats.sources.records import explode_rings as rings

    listed = rings(s.polygons, "image_id", "obj_id")
    return big(listed.withColumn("n_points", F.floor(F.size("ring") / 2)).drop("ring"), "ring_idx", "n_points")


def _ring_sums(df, ring):
    """A ring as numbers an engine without ring columns can be compared with."""
    df, pts = df.select("image_id", "obj_id", g.ring_points(ring).alias("_pts")), F.col("_pts")
    total = lambda f: F.aggregate(F.transform(pts, f), F.lit(0.0), lambda a, b: a + b)
    return df.select("image_id", "obj_id", F.size(pts).cast("bigint").alias("n"), r6(total(lambda p: p["x"].cast("double"))).alias("sx"),
                     r6(total(lambda p: p["y"].cast("double"))).alias("sy"),
                     r6(total(lambda p, i: (p["x"] * 3 + p["y"] * 5).cast("double") * (i + 1))).alias("weighted"))


RING_SUMS = "select image_id, obj_id, count(*) as n, round(sum(x),6)::double as sx, round(sum(y),6)::double as sy, round(sum((x*3+y*5)*(k+1)),6)::double as weighted from k group by 1,2"


@query(f"""with {VERTS}, k as (select image_id, obj_id, i as k, greatest(0,least(x-8,499)) as x, greatest(0,least(y-8,299)) as y from verts where ring_idx=0) {RING_SUMS}""")
def clamp_polygon(s):
    ring = g.clamp_polygon(F.transform(F.get("segmentation", F.lit(0)), lambda v: v - 8), F.lit(500), F.lit(300))
    return _ring_sums(s.polygons, ring)


@query(f"""with {VERTS}, k as (select image_id, obj_id, i as k, x+7 as x, y-3 as y from verts where ring_idx=0) {RING_SUMS}""")
def translate_polygon(s):
    return _ring_sums(s.polygons, g.translate(F.get("segmentation", F.lit(0)), F.lit(7), F.lit(-3)))


@query(f"""with {VERTS}, v as (select image_id, obj_id, i, round_even(x/4.0::double,0) as x, round_even(y/4.0::double,0) as y, n from verts where ring_idx=0),
d as (select *, lag(x) over w as px, lag(y) over w as py, row_number() over w as rn from v window w as (partition by image_id,obj_id order by i)),
kept as (select image_id, obj_id, x, y, row_number() over (partition by image_id,obj_id order by i)-1 as k, count(*) over (partition by image_id,obj_id) as c,
  first_value(x) over (partition by image_id,obj_id order by i) as fx, first_value(y) over (partition by image_id,obj_id order by i) as fy from d where rn=1 or x<>px or y<>py),
k as (select * from kept where not (c>1 and k=c-1 and x=fx and y=fy)) {RING_SUMS}""")
def dedupe_vertices(s):
    return _ring_sums(s.polygons, g.dedupe_vertices(F.transform(F.get("segmentation", F.lit(0)), lambda v: v / 4.0)))


# Outlines with the middle of every edge added, which simplification has to remove again where edges are upright or level.
@query(f"""with {VERTS}, m as (select image_id, obj_id, 2*i as k, x1 as x, y1 as y from edges where ring_idx=0
 union all select image_id, obj_id, 2*i+1, (x1+x2)/2, (y1+y2)/2 from edges where ring_idx=0),
p as (select *, count(*) over (partition by image_id,obj_id) as n from m),
q as (select b.image_id, b.obj_id, b.k, b.x, b.y from p b join p a on a.image_id=b.image_id and a.obj_id=b.obj_id and a.k=(b.k-1+b.n)%b.n
  join p c on c.image_id=b.image_id and c.obj_id=b.obj_id and c.k=(b.k+1)%b.n where not ((a.x=b.x and b.x=c.x) or (a.y=b.y and b.y=c.y))),
k as (select image_id, obj_id, x, y, row_number() over (partition by image_id,obj_id order by k)-1 as k from q) {RING_SUMS}""")
def simplify_rectilinear(s):
    mid = lambda p, i, c: (p[c] + F.get(F.col("_pts"), F.pmod(i + 1, F.size("_pts")))[c]) / 2.0
    df = s.polygons.select("image_id", "obj_id", g.ring_points(F.get("segmentation", F.lit(0))).alias("_pts"))
    finer = F.flatten(F.transform("_pts", lambda p, i: F.array(p["x"].cast("double"), p["y"].cast("double"), mid(p, i, "x"), mid(p, i, "y"))))
    return _ring_sums(df.select("image_id", "obj_id", finer.alias("ring")), g.simplify_rectilinear(F.col("ring")))


@query(f"""with {VERTS}, c as (select image_id, obj_id, ring_idx, count(*) as n, count(distinct x) as nx, count(distinct y) as ny from verts group by 1,2,3)
select image_id, obj_id, ring_idx, n=4 and nx=2 and ny=2 as axis_rect from c""")
def is_axis_rect(s):
    rings = s.polygons.select("image_id", "obj_id", F.posexplode("segmentation").alias("ring_idx", "ring"))
    return big(rings.select("image_id", "obj_id", "ring_idx", g.is_axis_rect(F.col("ring")).alias("axis_rect")), "ring_idx")


POINTS = "pts as (select image_id, gt_idx as point_id, x0+w//10 as px, y0+h//12 as py from fx_gt)"
IN_RING = "sum(case when (y1>{y})<>(y2>{y}) and {x} < (x1-x2)*({y}-y2)::double/(y1-y2+1e-9)+x2 then 1 else 0 end)%2"


def _points(s):
    return s.gt.select("image_id", F.col("gt_idx").alias("point_id"), (F.col("x0") + F.floor(F.col("w") / 10)).alias("px"),
                       (F.col("y0") + F.floor(F.col("h") / 12)).alias("py"))


def _outlines(s):
    return s.polygons.select("image_id", F.col("obj_id").alias("poly_id"), F.get("segmentation", F.lit(0)).alias("ring"))


@query(f"""with {VERTS}, {POINTS}, hits as (select p.image_id, p.point_id, e.obj_id as poly_id, {IN_RING.format(x='p.px', y='p.py')} as odd
 from pts p join edges e on p.image_id=e.image_id and e.ring_idx=0 group by 1,2,3) select image_id, point_id, poly_id from hits where odd=1""")
def points_in_polygons(s):
    return masks.points_in_polygons(_points(s), _outlines(s))


_CORNERS = " and ".join(IN_RING.format(x=x, y=y) + "=1" for x, y in (("p.x-2", "p.y-2"), ("p.x+p.w+2", "p.y-2"), ("p.x+p.w+2", "p.y+p.h+2"), ("p.x-2", "p.y+p.h+2")))


@query(f"""with {VERTS}, p as (select image_id, gt_idx as rect_id, x0+6 as x, y0+4 as y, 3+l_partkey%4 as w, 2+l_suppkey%3 as h from fx_gt)
select p.image_id, p.rect_id, e.obj_id as poly_id from p join edges e on p.image_id=e.image_id and e.ring_idx=0 group by 1,2,3 having {_CORNERS}""")
def rects_in_polygons(s):
    rects = s.gt.select("image_id", F.col("gt_idx").alias("rect_id"), (F.col("x0") + 6).alias("x"), (F.col("y0") + 4).alias("y"),
                        (F.col("l_partkey") % 4 + 3).alias("w"), (F.col("l_suppkey") % 3 + 2).alias("h"))
    return masks.rects_in_polygons(rects, _outlines(s), margin=2)


# ---------------------------------------------------------------- rectangles


@query("""select g.image_id, g.gt_idx, o.gt_idx as other, (least(g.x1,o.x1)-greatest(g.x0,o.x0))*(least(g.y1,o.y1)-greatest(g.y0,o.y0)) as area
 from fx_gt g join fx_gt o on g.image_id=o.image_id and g.gt_idx<o.gt_idx and least(g.x1,o.x1)>greatest(g.x0,o.x0) and least(g.y1,o.y1)>greatest(g.y0,o.y0)""")
def overlap_pairs(s):
    return matching.overlap_pairs(s.gt)


ADJACENT = """adj as (select a.image_id, a.room_id, b.room_id as other from fx_rooms a join fx_rooms b on a.image_id=b.image_id and a.room_id<b.room_id where
 ((a.x1=b.x0 or b.x1=a.x0) and least(a.y1,b.y1)>greatest(a.y0,b.y0)) or ((a.y1=b.y0 or b.y1=a.y0) and least(a.x1,b.x1)>greatest(a.x0,b.x0)))"""


@query(f"with {ADJACENT} select * from adj")
def adjacent_rects(s):
    return matching.shared_edges(s.rooms, ident="room_id")


@query(f"""with recursive {ADJACENT}, both_ways as (select image_id, room_id as u, other as v from adj union all select image_id, other, room_id from adj),
reach(image_id, u, v) as (select image_id, room_id, room_id from fx_rooms union select r.image_id, r.u, b.v from reach r join both_ways b on r.image_id=b.image_id and r.v=b.u)
select image_id, u as room_id, min(v) as group_id from reach group by 1,2""")
def connected_groups(s):
    return matching.connected_groups(matching.shared_edges(s.rooms, ident="room_id"), s.rooms, ["image_id"], "room_id", "other")


SIDES = """(values ('top'),('bottom'),('left'),('right')) v(side)"""


@query(f"""with e as (select image_id, room_id, side, x0 + case when side='right' then x1-x0 else 0 end as ex0, y0 + case when side='bottom' then y1-y0 else 0 end as ey0,
  x1 - case when side='left' then x1-x0 else 0 end as ex1, y1 - case when side='top' then y1-y0 else 0 end as ey1 from fx_rooms cross join {SIDES})
select e.image_id, e.room_id, r.room_id as other, e.side from e join fx_rooms r on e.image_id=r.image_id and e.room_id<>r.room_id where
 case when ex0=ex1 then (ex0=r.x0 or ex0=r.x1) and greatest(least(ey0,ey1),r.y0)<least(greatest(ey0,ey1),r.y1)
 when ey0=ey1 then (ey0=r.y0 or ey0=r.y1) and greatest(least(ex0,ex1),r.x0)<least(greatest(ex0,ex1),r.x1) else false end""")
def edges_on_perimeter(s):
    other = s.rooms.withColumnRenamed("room_id", "other")
    met = matching.meeting_boxes(s.rooms, other, ["image_id"], "room_id", "other").where(F.col("room_id") != F.col("other"))
    side = F.explode(F.array(*[F.struct(F.lit(n).alias("side"), F.col(f"a{a}").alias("ex0"), F.col(f"a{b}").alias("ey0"), F.col(f"a{c}").alias("ex1"), F.col(f"a{d}").alias("ey1"))
                               for n, a, b, c, d in (("top", "x0", "y0", "x1", "y0"), ("bottom", "x0", "y1", "x1", "y1"), ("left", "x0", "y0", "x0", "y1"), ("right", "x1", "y0", "x1", "y1"))]))
    edges = met.select("image_id", "room_id", "other", "bx0", "by0", "bx1", "by1", side.alias("e")).select("*", "e.*")
    on = g.edge_on_rect_perimeter(*[F.col(c) for c in ("ex0", "ey0", "ex1", "ey1", "bx0", "by0", "bx1", "by1")])
    return edges.where(on).select("image_id", "room_id", "other", "side")


UNION_CELLS = """xs as (select distinct image_id, unnest([x0,x1]) as x from fx_rooms), ys as (select distinct image_id, unnest([y0,y1]) as y from fx_rooms),
gx as (select *, lead(x) over (partition by image_id order by x) as xn, row_number() over (partition by image_id order by x) as i from xs),
gy as (select *, lead(y) over (partition by image_id order by y) as yn, row_number() over (partition by image_id order by y) as j from ys),
cells as (select distinct gx.image_id, i, j, x, xn, y, yn from gx join gy on gx.image_id=gy.image_id join fx_rooms r on r.image_id=gx.image_id
  and r.x0<=x and xn<=r.x1 and r.y0<=y and yn<=r.y1)"""


@query(f"""with {UNION_CELLS} select image_id, sum((xn-x)*(yn-y))::bigint as area from cells group by 1""")
def rect_union_areas(s):
    return big(rect_union_area(s.rooms, ["image_id"]), "area")


@query(f"""with {UNION_CELLS}, n as (select c.*, l.i is null as no_l, r.i is null as no_r, u.i is null as no_u, d.i is null as no_d from cells c
 left join cells l on l.image_id=c.image_id and l.j=c.j and l.i=c.i-1 left join cells r on r.image_id=c.image_id and r.j=c.j and r.i=c.i+1
 left join cells u on u.image_id=c.image_id and u.i=c.i and u.j=c.j-1 left join cells d on d.image_id=c.image_id and d.i=c.i and d.j=c.j+1),
e as (select image_id, 'v' as axis, x as pos, yn-y as len from n where no_l union all select image_id, 'v', xn, yn-y from n where no_r
 union all select image_id, 'h', y, xn-x from n where no_u union all select image_id, 'h', yn, xn-x from n where no_d)
select image_id, axis, pos, sum(len)::bigint as length from e group by 1,2,3""")
def rect_union_outline(s):
    edges = rect_union_edges(s.rooms, ["image_id"])
    return edges.groupBy("image_id", "axis", F.col("at").alias("pos")).agg(F.sum(F.col("hi") - F.col("lo")).cast("bigint").alias("length"))


STRIPS = """a as (select image_id, gt_idx, x0, y0, x1, y1, w>=h as across, greatest(w,h)-1 as span, greatest(1, least(2+l_partkey%3, (greatest(w,h)-1)//60)) as n from
  (select *, x1-x0 as w2, y1-y0 as h2 from fx_gt) q),
b as (select * exclude(across), (x1-x0)>=(y1-y0) as across from a),
c as (select image_id, gt_idx, x0, y0, x1, y1, across, n, i, (case when across then x0 else y0 end)+(span*i)//n + case when i=0 or i=n then 0 else
  -greatest(1, span//(5*n)) + floor(('0x'||substr(md5('7:'||gt_idx||':'||i),1,8))::bigint/4294967296.0::double*(2*greatest(1, span//(5*n))+1))::bigint end as cut
  from (select *, unnest(range(0, n+1)) as i from (select * exclude(span), greatest(x1-x0,y1-y0) as span from b) b2) d),
k as (select *, list(cut) over (partition by image_id, gt_idx) as cuts from c),
l as (select distinct image_id, gt_idx, x0, y0, x1, y1, across, n, list_sort(cuts) as cuts from k)"""


@query(f"""with {STRIPS} select image_id, gt_idx, i as strip, case when across then cuts[i+1] else x0 end as x0, case when across then y0 else cuts[i+1] end as y0,
 case when across then cuts[i+2] else x1 end as x1, case when across then y1 else cuts[i+2] end as y1 from (select *, unnest(range(0,n)) as i from l) m""")
def strip_tiles(s):
    strips = g.strip_tiles(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("l_partkey") % 3 + 2, 7, F.col("gt_idx"))
    listed = s.gt.select("image_id", "gt_idx", F.posexplode(strips).alias("strip", "s"))
    return big(listed.select("image_id", "gt_idx", "strip", "s.*"), "strip")


# ---------------------------------------------------------------- pictures


@query("""select image_id, round(1024.0::double/greatest(width,height),6) as scale, greatest(1,round_even(height*(1024.0::double/greatest(width,height)),0))::bigint as nh,
 greatest(1,round_even(width*(1024.0::double/greatest(width,height)),0))::bigint as nw from fx_images""")
def resize_plan(s):
    return rounded(s.images.select("image_id", g.resize_plan(F.col("height"), F.col("width"), 1024).alias("p")).select("image_id", "p.*"), "scale")


@query("""with o as (select image_id, gt_idx, x0 as x, y0 as y, 1000 as w, 700 as h, l_partkey%2=0 as hf, l_suppkey%2=0 as vf, l_partkey%4 as k from fx_gt),
f as (select image_id, gt_idx, case when hf then w-1-x else x end as x, case when vf then h-1-y else y end as y, w, h, k from o),
t1 as (select image_id, gt_idx, k, case when k>=1 then y else x end as x, case when k>=1 then w-1-x else y end as y, case when k>=1 then h else w end as w, case when k>=1 then w else h end as h from f),
t2 as (select image_id, gt_idx, k, case when k>=2 then y else x end as x, case when k>=2 then w-1-x else y end as y, case when k>=2 then h else w end as w, case when k>=2 then w else h end as h from t1),
t3 as (select image_id, gt_idx, k, case when k>=3 then y else x end as x, case when k>=3 then w-1-x else y end as y, case when k>=3 then h else w end as w, case when k>=3 then w else h end as h from t2)
select image_id, gt_idx, x::bigint as x, y::bigint as y, w::bigint as width, h::bigint as height from t3""")
def flip_rot90(s):
    moved = g.flip_rot90(F.col("x0"), F.col("y0"), F.lit(1000), F.lit(700), F.col("l_partkey") % 2 == 0, F.col("l_suppkey") % 2 == 0, F.col("l_partkey") % 4)
    return big(s.gt.select("image_id", "gt_idx", moved.alias("m")).select("image_id", "gt_idx", "m.*"), "x", "y", "width", "height")


@query("""select image_id, y, x from (select image_id, width, unnest(case when height>=512 then range(0, height-512+1, 256) else [0] end) as y from fx_images) a,
 lateral (select unnest(case when width>=512 then range(0, width-512+1, 256) else [0] end) as x) b""")
def patch_index(s):
    return s.images.select("image_id", F.inline(g.patch_index(F.col("height"), F.col("width"), 512, 256)))


# ---------------------------------------------------------------- intervals

ISLANDS = """isl_{0} as (select {1}, lo, hi, sum(new) over (partition by {1} order by lo, hi rows unbounded preceding) as no from
 (select {1}, lo, hi, case when lo <= max(hi) over (partition by {1} order by lo, hi rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from (select distinct {1}, lo, hi from {2} where hi>lo) d) a),
m_{0} as (select {1}, min(lo) as lo, max(hi) as hi from isl_{0} group by {1}, no)"""


@query("with " + ISLANDS.format("all", "grp", "fx_intervals") + " select grp, lo, hi from m_all")
def interval_merge(s):
    return intervals.merge_intervals(s.intervals, ["grp"])


SPLIT_IV = """seg as (select grp, event_id, lo, hi from fx_intervals where event_type in ('click','view','error')),
hid as (select grp, lo, hi from fx_intervals where event_type not in ('click','view','error'))"""
KIND, OTHER = "event_type in ('click','view','error')", "event_type not in ('click','view','error')"


@query(f"with {SPLIT_IV}, " + ISLANDS.format("h", "grp", "hid") + """ select s.grp, s.event_id, greatest(s.lo,h.lo) as lo, least(s.hi,h.hi) as hi
 from seg s join m_h h on s.grp=h.grp and least(s.hi,h.hi)>greatest(s.lo,h.lo)""")
def interval_intersect(s):
    hidden = intervals.merge_intervals(s.intervals.where(OTHER), ["grp"])
    return intervals.intersect_intervals(s.intervals.where(KIND), hidden, ["grp"], ["event_id"], [])


@query(f"with {SPLIT_IV}, " + ISLANDS.format("h", "grp", "hid") + """, c as (select s.grp, s.event_id, s.lo as s0, s.hi as s1, greatest(s.lo,h.lo) as lo, least(s.hi,h.hi) as hi
 from seg s join m_h h on s.grp=h.grp and least(s.hi,h.hi)>greatest(s.lo,h.lo)),
g as (select grp, event_id, coalesce(lag(hi) over w, s0) as lo, lo as hi from c window w as (partition by event_id order by lo)
 union all select grp, event_id, max(hi), max(s1) from c group by grp, event_id union all select grp, event_id, lo, hi from seg where event_id not in (select event_id from c))
select * from g where hi>lo""")
def interval_subtract(s):
    return intervals.subtract_intervals(s.intervals.where(KIND), s.intervals.where(OTHER), ["grp"], ["event_id"])


@query(f"with {SPLIT_IV}, " + ISLANDS.format("h", "grp", "hid") + """ select s.grp, s.event_id, (s.lo+s.hi)/2 as pos, count(h.lo)>0 as hit
 from seg s left join m_h h on s.grp=h.grp and (s.lo+s.hi)/2 between h.lo and h.hi group by 1,2,3""")
def point_hits_interval(s):
    mid = s.intervals.where(KIND).select("grp", "event_id", ((F.col("lo") + F.col("hi")) / 2).alias("pos"))
    return intervals.point_hits_interval(mid, s.intervals.where(OTHER), ["grp"], ["event_id"])


SEGS = """segs as (select image_id, 2*room_id as seg_id, 'v' as kind, x1 as pos, y0 as lo, y1 as hi from fx_rooms union all
 select image_id, 2*room_id+1 as seg_id, 'h' as kind, y1 as pos, x0 as lo, x1 as hi from fx_rooms)"""
COVER = """sp as (select s.image_id, s.seg_id, r.room_id%2 as cluster, greatest(s.lo,case kind when 'v' then r.y0 else r.x0 end) as lo, least(s.hi,case kind when 'v' then r.y1 else r.x1 end) as hi,
  case kind when 'v' then r.x0<=pos-1 and r.x1>=pos else r.y0<=pos-1 and r.y1>=pos end as near, case kind when 'v' then r.x0<=pos and r.x1>=pos+1 else r.y0<=pos and r.y1>=pos+1 end as far
 from segs s join fx_rooms r on s.image_id=r.image_id), nr as (select * from sp where near), fr as (select * from sp where far)"""


@query(f"with {SEGS}, {COVER}, " + ISLANDS.format("n", "image_id, seg_id, cluster", "nr") + ", " + ISLANDS.format("f", "image_id, seg_id, cluster", "fr") + """,
x as (select n.image_id, n.seg_id, greatest(n.lo,f.lo) as lo, least(n.hi,f.hi) as hi from m_n n join m_f f on n.image_id=f.image_id and n.seg_id=f.seg_id and n.cluster=f.cluster
 and least(n.hi,f.hi)>greatest(n.lo,f.lo)), """ + ISLANDS.format("x", "image_id, seg_id", "x") + " select image_id, seg_id, lo, hi from m_x")
def two_sided_cover(s):
    """Right-hand and lower edges of all rooms."""
    right = s.rooms.select("image_id", (2 * F.col("room_id")).alias("seg_id"), F.lit("v").alias("kind"), F.col("x1").alias("pos"), F.col("y0").alias("lo"), F.col("y1").alias("hi"))
    lower = s.rooms.select("image_id", (2 * F.col("room_id") + 1).alias("seg_id"), F.lit("h").alias("kind"), F.col("y1").alias("pos"), F.col("x0").alias("lo"), F.col("x1").alias("hi"))
    segs = right.unionByName(lower)
    rects = s.rooms.withColumn("cluster", F.col("room_id") % 2)
    return intervals.two_sided_cover(segs, rects, ["image_id"])
