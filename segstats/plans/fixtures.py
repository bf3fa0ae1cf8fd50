"""Views over the driver's tables that look like the engine's inputs.

One text per view serves Spark and the checking engine; words in braces are the
few spellings that differ.  Every view covers the whole of its table.

* images      header of every order
* gt, preds   ground-truth boxes from lineitem, and jittered copies with scores
* polygons    outlines with holes from lineitem, pred_polygons moved copies
* rooms       boxes on a coarse grid, which share edges
* intervals   intervals from events
* runs        per-epoch metrics from orders
* pixels      an 8 x 8 picture per order; marks = boxes on it
* logits, points   network outputs and point samples from lineitem
"""

from __future__ import annotations

import re

from segstats.operators.masks import spread

SPARK_WORDS = {"list": "array", "each8": "explode(sequence(0L, 7L))", "text": "string",
               "hash32": "cast(conv(substr(md5({0}), 1, 8), 16, 10) as bigint)"}
DUCK_WORDS = {"list": "list_value", "each8": "unnest(range(8))", "text": "varchar",
              "hash32": "cast(('0x' || substr(md5({0}), 1, 8)) as bigint)"}

_RING = """case when l_partkey % 2 = 0
  then {list}(bx, by_, bx+sw, by_, bx+sw, by_+hh, bx+hw, by_+hh, bx+hw, by_+sh, bx, by_+sh)
  else {list}(bx+s5, by_, bx+sw, by_, bx+sw, by_+sh, bx, by_+sh) end"""
_HOLE = "{list}(bx+hw, by_+h8, bx+hw+w4, by_+h8, bx+hw+w4, by_+h4, bx+hw, by_+h4)"


def _polygons(dx: str, dy: str) -> str:
    return f"""
select image_id, gt_idx as obj_id, gt_idx as id, category_name, role, ref_match, cat, l_partkey,
 case when sw >= 24 and sh >= 24 then {{list}}({_RING}, {_HOLE}) else {{list}}({_RING}) end as segmentation
from (select *, cast(floor(sw/2) as bigint) as hw, cast(floor(sh/2) as bigint) as hh, cast(floor(sw/4) as bigint) as w4,
  cast(floor(sh/4) as bigint) as h4, cast(floor(sh/8) as bigint) as h8, cast(floor(sw/5) as bigint) as s5
 from (select *, x0 + {dx} as bx, y0 + {dy} as by_, 2 + cast(floor(w/5) as bigint) as sw, 8 + l_partkey % 40 as sh from fx_gt) a) b"""


VIEWS = {
    "images": """
select o_orderkey as image_id, 1400+(o_custkey*37)%4100 as width, 900+(o_custkey*53)%2600 as height,
 case o_orderstatus when 'O' then 'elevation' when 'F' then 'freeform' else 'roof_plan' end as mode, o_orderkey%2=0 as mono from orders""",
    "gt": """
select image_id, gt_idx, x0, y0, x0+w-1 as x1, y0+h-1 as y1, w, h, cat, concat('pattern', cast(cat+1 as {text})) as category_name,
 cat = image_id%3 as ref_match, case l_returnflag when 'A' then 'wall' when 'N' then 'roof_plan' else 'garage' end as role,
 concat('tile_', cast(l_partkey%5 as {text}), '.png') as reference_tile, l_partkey, l_suppkey, l_discount
from (select l_orderkey as image_id, l_partkey*1000000000 + l_suppkey*1000 + l_linenumber*100 + cast(l_quantity as bigint) as gt_idx,
  (l_partkey*13)%600 as x0, (l_suppkey*29)%400 as y0, 30+cast(l_quantity as bigint)*5 as w, 30+(l_partkey%40)*5 as h, l_partkey%3 as cat,
  l_returnflag, l_partkey, l_suppkey, l_discount from lineitem) g""",
    "preds": """
select image_id, gt_idx as q_idx, x0+jx as x0, y0+jy as y0, x0+jx+w-1 as x1, y0+jy+h-1 as y1, l_discount*10 as score,
 cast((l_partkey*7+l_suppkey)%201-100 as double)/100 as sim
from (select *, (l_partkey+l_suppkey)%31-15 as jx, (l_partkey*3+l_suppkey)%31-15 as jy from fx_gt) g""",
    "polygons": _polygons("0", "0"),
    "pred_polygons": _polygons("l_suppkey%7-3", "l_partkey%5-2"),
    "rooms": """
select image_id, gt_idx as room_id, rx as x0, ry as y0, rx + 40*(1+l_partkey%2) as x1, ry + 30*(1+l_suppkey%2) as y1
from (select *, (l_partkey%6)*40 as rx, (l_suppkey%5)*30 as ry from fx_gt) r""",
    "intervals": """
select user_id as grp, event_id, (event_id*7919)%100000 as lo,
 (event_id*7919)%100000+10+cast(floor(abs(coalesce(value,0))) as bigint)%500 as hi, event_type, value from events""",
    "runs": """
select o_orderpriority as run, o_custkey%15 as epoch, avg(case when o_orderkey%2=0 then cast(o_orderkey%1000 as double)/1000 end) as synth_iou,
 avg(case when o_orderkey%2=1 then cast(o_orderkey%1000 as double)/1000 end) as real_iou from orders group by o_orderpriority, o_custkey%15""",
    "metrics": """
select run, epoch, 'synth_iou' as tag, synth_iou as value from fx_runs union all select run, epoch, 'real_iou' as tag, real_iou as value from fx_runs""",
    "steps": """
select o_orderpriority as run, o_custkey%15 as epoch, o_orderkey as step, cast((o_custkey*31+o_orderkey)%1000 as double) as value from orders""",
    "pixels": """
select image_id, y, x, cast((x*31+y*17+image_id*13)%256 as double) as gray, cast((x*31+y*17+image_id*13)%256 as double) as r,
 cast(case when image_id%2=0 then (x*31+y*17+image_id*13)%256 else (x*29+y*11+image_id*7)%256 end as double) as g, cast((x*31+y*17+image_id*13)%256 as double) as b
from (select image_id, y, {each8} as x from (select o_orderkey as image_id, {each8} as y from orders) a) p""",
    "marks": """
select image_id, gt_idx as obj_id, mx as x0, my as y0, mx + l_suppkey%4 as x1, my + l_partkey%5 as y1, role
from (select *, l_partkey%7 as mx, l_suppkey%7-1 as my from fx_gt) m""",
    "logits": """
select image_id, gt_idx as q_idx, cast(l_partkey%13 as double)/4 - 1.5 as logit0, cast(l_suppkey%17 as double)/4 - 2 as logit1,
 cast(l_discount >= 0.05 as int) as target from fx_gt""",
    "pred_points": """
select image_id, q_idx, point_id, cast((q_idx%97 + point_id*37)%41 as double)/5 - 4 as logit
from (select image_id, gt_idx as q_idx, {each8} as point_id from fx_gt) p""",
    "gt_points": """
select image_id, gt_idx, point_id, cast((gt_idx%89 + point_id*5)%3 as double)/2 as value
from (select image_id, gt_idx, {each8} as point_id from fx_gt) p""",
    "refs": """
select e.vec_id, e.label, e.embedding, r.embedding as reference, r.vec_id as ref_id from embeddings e
 join (select label, min(vec_id) as first_id from embeddings group by label) f on e.label = f.label join embeddings r on r.vec_id = f.first_id""",
}

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
_USED = re.compile(r"\bfx_(\w+)")


def _spell(text: str, words: dict[str, str]) -> str:
    for word, spelling in words.items():
        text = text.replace("{" + word + "}", spelling)
    return text


def _needed(text: str) -> list[str]:
    """Views used in a text, each after the ones it builds on."""
    found: list[str] = []
    for name in _USED.findall(text):
        if name in VIEWS:
            for n in [*_needed(VIEWS[name]), name]:
                if n not in found:
                    found.append(n)
    return found


def with_views(sql: str) -> str:
    """The query with the views it uses as leading common table expressions."""
    parts = [f"fx_{n} as ({_spell(VIEWS[n], DUCK_WORDS).strip()})" for n in _needed(sql)]
    body = _spell(sql.strip(), DUCK_WORDS)
    if not parts:
        return body
    views = ",\n".join(parts)
    for head, joined in (("with recursive ", "with recursive "), ("with ", "with ")):
        if body.lower().startswith(head):
            return f"{joined}{views},\n{body[len(head):]}"
    return f"with {views}\n{body}"


def view(source, name: str):
    """A view as a DataFrame; views and tables it builds on are passed as arguments, nothing is registered."""
    if name not in VIEWS:
        raise AttributeError(name)
    text = _spell(VIEWS[name], SPARK_WORDS)
    inputs = {}
    for used in dict.fromkeys(_USED.findall(text)):
        inputs[f"fx_{used}"] = view(source, used)
    for table in TABLES:
        if re.search(rf"\b(from|join) {table}\b", text):
            inputs[table] = source.table(table)
    for used in inputs:
        text = re.sub(rf"\b(from|join) {used}\b", rf"\1 {{{used}}}", text)
    # Polygon work is long per row: use every core even when the table is one small file.
    # The boxes are spread, not the rings that are made of them.
    if name.endswith("polygons"):
        inputs["fx_gt"] = spread(inputs["fx_gt"], source.spread_by)
    return source.spark.sql(text, **inputs)
