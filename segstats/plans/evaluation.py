"""Queries: evaluation, matching, thresholds, losses, run logs."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from segstats.functions.scalar import cosine_sim, foreground_score, l2_normalize
from segstats.operators import matching, metrics, windows
from segstats.plans.registry import big, query, r6, rounded
from segstats.sources.logs import metrics_from_log, parse_epoch_log

PAIRS = """pairs as (select image_id, gt_idx, q_idx, ref_match, score, sim, inter::double/(area_g+area_p-inter) as iou from
 (select g.image_id, g.gt_idx, g.ref_match, p.q_idx, p.score, p.sim,
   (least(g.x1,p.x1)-greatest(g.x0,p.x0)+1)*(least(g.y1,p.y1)-greatest(g.y0,p.y0)+1) as inter,
   (g.x1-g.x0+1)*(g.y1-g.y0+1) as area_g, (p.x1-p.x0+1)*(p.y1-p.y0+1) as area_p
  from fx_gt g join fx_preds p on g.image_id=p.image_id and g.x0<=p.x1 and p.x0<=g.x1 and g.y0<=p.y1 and p.y0<=g.y1) i)"""


def grid_sql(scores: str, matches: str, pairs: str, unmatched: bool, gt: str = "fx_gt", preds: str = "fx_preds") -> str:
    """All metrics at every cut-off of a grid, straight from the definitions."""
    counted = "true" if unmatched else "i.ng>0"
    return f"""
with {pairs},
grid as (select s, m from (select unnest([{scores}]) as s) a cross join (select unnest([{matches}]) as m) b),
img as (select image_id, count(*) as g, sum(ref_match::int) as ng, min(gt_idx) as first_gt from {gt} group by image_id),
kp as (select s, m, p.* from grid join {preds} p on p.score>s and p.sim>m where image_id in (select image_id from img)),
good as (select s, m, image_id, gt_idx, q_idx, iou from grid join pairs on score>s and sim>m where ref_match and iou>=0.5),
best as (select * from good qualify row_number() over (partition by s,m,image_id,gt_idx order by iou desc, q_idx)=1),
tps as (select * from best qualify row_number() over (partition by s,m,image_id,q_idx order by gt_idx)=1),
bestgt as (select image_id, q_idx, gt_idx from pairs qualify row_number() over (partition by image_id,q_idx order by iou desc, gt_idx)=1),
lab as (select k.s, k.m, i.ng, x.ref_match from kp k join img i on k.image_id=i.image_id left join bestgt b on b.image_id=k.image_id and b.q_idx=k.q_idx
  join {gt} x on x.image_id=k.image_id and x.gt_idx=coalesce(b.gt_idx, i.first_gt) join img on img.image_id=k.image_id),
kept as (select s, m, count(*) as kept, sum(case when {counted.replace('i.ng','ng')} then 1 else 0 end) as mt, sum(case when ng>0 and ref_match then 1 else 0 end) as mc from lab group by s, m),
tpa as (select s, m, count(*) as tp, sum(iou) as iou_sum from tps group by s, m),
det as (select s, m, count(*) as found from (select distinct s, m, image_id, gt_idx from grid join pairs on score>s where iou>=0.5) d group by s, m),
tot as (select sum(g) as gt_total, sum(ng) as wanted from img),
j as (select grid.s, grid.m, coalesce(tp,0) as tp, coalesce(kept,0) as kept, coalesce(iou_sum,0) as iou_sum, coalesce(mt,0) as mt, coalesce(mc,0) as mc,
  coalesce(found,0) as found, gt_total, wanted from grid left join tpa using(s,m) left join kept using(s,m) left join det using(s,m) cross join tot),
k as (select s as score_t, m as match_t, tp::bigint as tp, (kept-tp)::bigint as fp, (wanted-tp)::bigint as fn, iou_sum/greatest(tp,1) as mean_iou,
  mc/greatest(mt,1) as ref_acc, found/greatest(gt_total,1) as det_recall, tp/greatest(kept,1) as p, tp/greatest(wanted,1) as r from j)
select score_t, match_t, tp, fp, fn, round(mean_iou,6) as mean_iou, round(ref_acc,6) as ref_acc, round(det_recall,6) as det_recall,
 round(p,6) as "precision", round(r,6) as recall, round(2*p*r/greatest(p+r,1e-9),6) as f1 from k"""


RATES = ("mean_iou", "ref_acc", "det_recall", "precision", "recall", "f1")
SWEEP_S, SWEEP_M = (0.1, 0.2, 0.3, 0.4, 0.5), (0.0, 0.1, 0.2, 0.3, 0.4, 0.5)
SWEEP_SQL = grid_sql("0.1::double,0.2,0.3,0.4,0.5", "0.0::double,0.1,0.2,0.3,0.4,0.5", PAIRS, True)


@query(grid_sql("0.5::double", "0.0::double", PAIRS, False))
def eval_summary(s):
    return rounded(metrics.evaluate_boxes(s.gt, s.preds), *RATES)


@query(SWEEP_SQL)
def threshold_sweep(s):
    return rounded(metrics.threshold_sweep(s.gt, s.preds, SWEEP_S, SWEEP_M), *RATES)


@query(grid_sql("0.3::double", "-0.3::double,-0.1,0.0", PAIRS, True))
def threshold_sweep_negative(s):
    return rounded(metrics.threshold_sweep(s.gt, s.preds, (0.3,), (-0.3, -0.1, 0.0)), *RATES)


@query(re.sub(r"\nselect score_t, match_t, tp.*", """
select score_t, """ + ", ".join(f"round(max(case when match_t={m} then 2*p*r/greatest(p+r,1e-9) end),6) as m_{i}" for i, m in enumerate(SWEEP_M)) +
              " from k group by score_t", SWEEP_SQL, flags=re.S))
def sweep_matrix(s):
    sweep = metrics.threshold_sweep(s.gt, s.preds, SWEEP_S, SWEEP_M)
    return rounded(metrics.sweep_matrix(sweep, "f1", SWEEP_M), *[f"m_{i}" for i in range(len(SWEEP_M))])


@query(f"with {PAIRS} select image_id, gt_idx, q_idx, round(iou,6) as iou from pairs")
def box_iou_pairs(s):
    return rounded(matching.box_pairs(s.gt, s.preds), "iou")


@query(f"""with {PAIRS} select image_id, gt_idx, q_idx, round(iou,6) as iou from
 (select *, row_number() over (partition by image_id,gt_idx order by iou desc,q_idx) as rn from pairs) r where rn=1""")
def best_match_per_gt(s):
    return rounded(matching.best_match_per_gt(matching.box_pairs(s.gt, s.preds)), "iou")


@query(f"""with {PAIRS}, best as (select * from pairs qualify row_number() over (partition by image_id,gt_idx order by iou desc,q_idx)=1)
select image_id, gt_idx, q_idx, round(iou,6) as iou from best where iou>=0.5 qualify row_number() over (partition by image_id,q_idx order by gt_idx)=1""")
def claim_matches(s):
    return rounded(matching.claim_matches(matching.best_match_per_gt(matching.box_pairs(s.gt, s.preds))), "iou")


@query(f"""with {PAIRS}, img as (select image_id, min(gt_idx) as first_gt from fx_gt group by image_id),
b as (select image_id, q_idx, gt_idx from pairs qualify row_number() over (partition by image_id,q_idx order by iou desc,gt_idx)=1)
select p.image_id, p.q_idx, g.gt_idx as best_gt, g.ref_match::int as best_ref_match from fx_preds p join img on img.image_id=p.image_id
 left join b on b.image_id=p.image_id and b.q_idx=p.q_idx join fx_gt g on g.image_id=p.image_id and g.gt_idx=coalesce(b.gt_idx,first_gt)
 where p.score>0.5 and p.sim>0""")
def reference_match(s):
    kept = metrics.filter_detections(s.preds).select("image_id", "q_idx", "x0", "y0", "x1", "y1")
    gt = s.gt.withColumn("ref_match", F.col("ref_match").cast("int"))
    pairs = matching.box_pairs(gt, kept, keep_gt=["ref_match"])
    return matching.best_gt_per_pred(kept.select("image_id", "q_idx"), gt, pairs).drop("n_wanted")


@query("select image_id, q_idx, round(score,6) as score, round(sim,6) as sim from fx_preds where score>0.5 and sim>0")
def filter_detections(s):
    return rounded(metrics.filter_detections(s.preds).select("image_id", "q_idx", "score", "sim"), "score", "sim")


@query(f"""with {PAIRS}, b as (select g.image_id, g.gt_idx, coalesce(max(p.iou),0) as iou from fx_gt g
 left join pairs p on p.image_id=g.image_id and p.gt_idx=g.gt_idx and p.score>0.5 group by g.image_id, g.gt_idx)
select count(*) as gt_total, sum((iou>=0.5)::int)::bigint as found, round(avg((iou>=0.5)::int),6) as det_recall from b""")
def detection_recall(s):
    return rounded(metrics.detection_recall(s.gt, s.preds), "det_recall")


@query(f"""with {PAIRS}, b as (select g.image_id, g.gt_idx, coalesce(max(p.iou),0) as iou from fx_gt g
 left join pairs p on p.image_id=g.image_id and p.gt_idx=g.gt_idx and p.score>0.5 group by g.image_id, g.gt_idx)
select round(avg(iou),6) as mean_gt_iou, count(*) as gt_total from b""")
def mean_gt_iou(s):
    return rounded(metrics.mean_gt_iou(s.gt, s.preds), "mean_gt_iou")


MATCHED = f"""{PAIRS}, sc as (select sim, ref_match::int as label from (select *, row_number() over (partition by image_id,gt_idx order by iou desc,q_idx) as rn
 from pairs where score>0.5) r where rn=1 and iou>=0.5)"""
AUC = """cnt as (select {x} as x, sum({l}) as pos, sum(1-{l}) as neg from sc group by 1),
below as (select *, coalesce(sum(neg) over (order by x rows between unbounded preceding and 1 preceding),0) as nb from cnt)
select round(sum(pos*(nb+neg/2))/(sum(pos)*sum(neg)),6) as auc, sum(pos)::bigint as n_pos, sum(neg)::bigint as n_neg from below"""


@query(f"with {MATCHED}, " + AUC.format(x="sim", l="label"))
def match_auc(s):
    return rounded(metrics.roc_auc(metrics.matched_similarity(s.gt, s.preds), weight="n"), "auc")


def _similarities(s):
    return s.refs.select("vec_id", cosine_sim(F.col("embedding"), F.col("reference")).alias("sim"))


COS = "list_dot_product(e::double[], r::double[])/sqrt(list_dot_product(e::double[], e::double[])*list_dot_product(r::double[], r::double[]))"
EMB_SCORES = f"""sc as (select round({COS},9) as sim, (e.label%2=0)::int as label from (select embedding as e, reference as r, label, vec_id from fx_refs) e)"""


def _embedding_scores(s):
    sim = F.round(cosine_sim(F.col("embedding"), F.col("reference")), 9)
    return s.refs.select(sim.alias("sim"), (F.col("label") % 2 == 0).cast("int").alias("label"))


@query(f"with {EMB_SCORES}, " + AUC.format(x="sim", l="label"))
def roc_auc(s):
    return rounded(metrics.roc_auc(_embedding_scores(s)), "auc")


@query(f"""with {EMB_SCORES} select label, count(*) as n, round(avg(sim),6) as mean, round(quantile_cont(sim,0.1),6) as p10,
 round(median(sim),6) as median, round(quantile_cont(sim,0.9),6) as p90 from sc group by label""")
def sim_distribution(s):
    return rounded(metrics.sim_distribution(_embedding_scores(s)), "mean", "p10", "median", "p90")


@query(f"""with {MATCHED} select label, count(*) as n, round(avg(sim),6) as mean, round(quantile_cont(sim,0.1),6) as p10,
 round(median(sim),6) as median, round(quantile_cont(sim,0.9),6) as p90 from sc group by label""")
def match_sim_distribution(s):
    return rounded(metrics.sim_distribution(metrics.matched_similarity(s.gt, s.preds), weight="n"), "mean", "p10", "median", "p90")


@query(f"""with {MATCHED}, e as (select min(sim) as lo, max(sim) as hi from sc), n as (select count(*) as n from sc),
t as (select i, case when i=199 then hi else lo+i*((hi-lo)/199.0::double) end as t from e cross join (select unnest(range(200)) as i) r),
h as (select sim, label, count(*) as c from sc group by 1,2),
a as (select i, t, sum(case when (sim>t)::int=label then c else 0 end)/(select n from n) as acc from t cross join h group by i,t)
select round(t,6) as threshold, round(acc,6) as accuracy from a order by acc desc, i limit 1""")
def best_threshold(s):
    return rounded(metrics.best_threshold(metrics.matched_similarity(s.gt, s.preds), weight="n"), "threshold", "accuracy")


@query(f"with {MATCHED} select round(avg(((sim>0.5)::int=label)::int),6) as accuracy from sc")
def accuracy_at(s):
    return rounded(metrics.accuracy_at(metrics.matched_similarity(s.gt, s.preds), 0.5, weight="n"), "accuracy")


@query(f"select vec_id, ref_id, round({COS},6) as sim from (select vec_id, ref_id, embedding as e, reference as r from fx_refs) v")
def cosine_similarity(s):
    sim = cosine_sim(F.col("embedding"), F.col("reference"))
    return s.refs.select("vec_id", "ref_id", r6(sim).alias("sim"))


@query("""select vec_id, round(list_sum(list_transform(n, lambda x: x)),6) as total, round(list_dot_product(n,n),6) as norm2, round(n[1],6) as first from
 (select vec_id, list_transform(e, lambda x: x/sqrt(list_dot_product(e,e))) as n from (select vec_id, embedding::double[] as e from embeddings) v) w""")
def l2_normalized(s):
    unit = s.table("embeddings").select("vec_id", l2_normalize(F.col("embedding")).alias("n"))
    add = lambda f: F.aggregate(F.transform("n", f), F.lit(0.0), lambda a, b: a + b)
    return unit.select("vec_id", r6(add(lambda x: x)).alias("total"), r6(add(lambda x: x * x)).alias("norm2"), r6(F.get("n", F.lit(0))).alias("first"))


NEAR = """d as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.embedding::double[], c.embedding::double[]), lambda p: (p[1]-p[2])*(p[1]-p[2]))) as dist
  from embeddings q join embeddings c on q.label=c.label),
near as (select query_id, row_number() over (partition by query_id order by round(dist,9), vec_id) as rank, vec_id, dist from d)"""


def _nearest(s):
    e = s.table("embeddings").withColumnRenamed("embedding", "vector")
    found = matching.topk_nearest(e.withColumnRenamed("vec_id", "query_id"), e, k=8, by=["label"])
    return found.drop("label")


@query(f"with {NEAR} select query_id, rank, vec_id, round(dist,6) as dist from near where rank<=8")
def topk_nearest(s):
    return rounded(_nearest(s), "dist")


@query(f"""with {NEAR}, c as (select *, row_number() over (partition by query_id order by {{hash32}}, rank) as pick from near where rank<=8)
select query_id, rank, vec_id, round(dist,6) as dist from c where pick=1""".replace("{hash32}", "('0x'||substr(md5('5:'||query_id||':'||rank),1,8))::bigint"))
def topk_pick(s):
    return rounded(matching.pick_neighbour(_nearest(s), seed=5), "dist")


# ---------------------------------------------------------------- costs and losses

FG = "1/(1+exp(logit0-logit1))"
COSTS = f"""pts as (select image_id, q_idx, count(*) as n, sum(greatest(logit,0)+ln(1+exp(-abs(logit)))) as soft, sum(1/(1+exp(-logit))) as ps from fx_pred_points group by 1,2),
gs as (select image_id, gt_idx, sum(value) as gs from fx_gt_points group by 1,2),
common as (select p.image_id, p.q_idx, g.gt_idx, sum(p.logit*g.value) as xg, sum(g.value/(1+exp(-p.logit))) as pg from fx_pred_points p
  join fx_gt_points g on p.image_id=g.image_id and p.point_id=g.point_id group by 1,2,3),
costs as (select c.image_id, c.q_idx, c.gt_idx, -2*({FG}) + 5*(soft-xg)/n + 5*(1-(2*pg+1)/(ps+gs+1)) as cost from common c join pts using(image_id,q_idx)
  join gs using(image_id,gt_idx) join fx_logits l on l.image_id=c.image_id and l.q_idx=c.q_idx)"""


def _costs(s):
    return matching.match_cost(s.logits, s.pred_points, s.gt_points)


@query(f"with {COSTS} select image_id, q_idx, gt_idx, round(cost,6) as cost from costs")
def match_cost(s):
    return rounded(_costs(s), "cost")


@query(f"""with recursive {COSTS}, c as materialized (select image_id, q_idx, gt_idx, round(cost,6) as cost from costs), step as (
 select distinct image_id, []::bigint[] as uq, []::bigint[] as ug, null::bigint as q, null::bigint as g, null::double as cost from c union all
 select image_id, list_append(uq, b.q), list_append(ug, b.g), b.q, b.g, b.c from (select st.image_id, st.uq, st.ug, arg_min({{{{'q': c.q_idx, 'g': c.gt_idx, 'c': c.cost}}}}, row(c.cost, c.q_idx, c.gt_idx)) as b
  from step st join c on c.image_id=st.image_id and not list_contains(st.uq, c.q_idx) and not list_contains(st.ug, c.gt_idx) group by st.image_id, st.uq, st.ug) t)
select image_id, q as q_idx, g as gt_idx, round(cost,6) as cost from step where q is not null""".replace("{{", "{").replace("}}", "}"))
def assign_one_to_one(s):
    return rounded(matching.match_one_to_one(s.logits, s.pred_points, s.gt_points, rounded=6), "cost")


@query(f"select image_id, q_idx, round({FG},6) as score from fx_logits")
def foreground_scores(s):
    return s.logits.select("image_id", "q_idx", r6(foreground_score(F.col("logit0"), F.col("logit1"))).alias("score"))


@query(f"""select image_id, round(sum(w*nll)/sum(w),6) as loss_ce from (select image_id, case when target=1 then 1 else 0.1::double end as w,
 -ln(case when target=1 then {FG} else 1-{FG} end) as nll from fx_logits) l group by image_id""")
def class_loss(s):
    return rounded(metrics.class_loss(s.logits, ["image_id"]), "loss_ce")


@query("""with each as (select p.image_id, p.q_idx, sum(greatest(logit,0)-logit*value+ln(1+exp(-abs(logit)))) as bce, count(*) as n,
 1-(2*sum(value/(1+exp(-logit)))+1)/(sum(1/(1+exp(-logit)))+sum(value)+1) as dice from fx_pred_points p
 join fx_gt_points g on p.image_id=g.image_id and p.q_idx=g.gt_idx and p.point_id=g.point_id group by 1,2)
select image_id, round(sum(bce)/sum(n),6) as loss_mask, round(avg(dice),6) as loss_dice from each group by image_id""")
def mask_losses(s):
    matched = metrics.paired_points(s.pred_points, s.gt_points.withColumnRenamed("gt_idx", "q_idx"), ["image_id", "q_idx"])
    return rounded(metrics.mask_losses(matched, ["image_id", "q_idx"], ["image_id"]), "loss_mask", "loss_dice")


@query("""select p.image_id, round(avg(greatest(10*sim,0)-10*sim*ref_match::int+ln(1+exp(-abs(10*sim)))),6) as loss_ref from fx_preds p
 join fx_gt g on p.image_id=g.image_id and p.q_idx=g.gt_idx group by p.image_id""")
def reference_loss(s):
    labels = s.gt.select("image_id", F.col("gt_idx").alias("q_idx"), F.col("ref_match").cast("int").alias("label"))
    return rounded(metrics.reference_loss(s.preds.join(labels, ["image_id", "q_idx"]), ["image_id"]), "loss_ref")


PARTS = """parts as (select o_orderpriority as run, o_custkey%15 as epoch,
 case o_orderkey%8 when 0 then 'loss_ce' when 1 then 'loss_mask' when 2 then 'loss_dice' when 3 then 'loss_ref' when 4 then 'aux0_loss_ce' when 5 then 'aux3_loss_mask'
 when 6 then 'aux10_loss_dice' else 'aux1_loss_ref' end as key, cast(o_orderkey%1000 as double)/1000 as value from {orders})"""


@query("with " + PARTS.replace("{orders}", "orders") + """ select run, epoch, round(sum(value*case regexp_replace(key,'^aux[0-9]+_','') when 'loss_ce' then 2 when 'loss_mask' then 5
 when 'loss_dice' then 5 else 2 end),6) as total_loss from parts group by run, epoch""")
def total_loss(s):
    parts = s.spark.sql("with " + PARTS + " select * from parts", orders=s.table("orders"))
    return rounded(metrics.total_loss(parts, ["run", "epoch"]), "total_loss")


# ---------------------------------------------------------------- run logs


@query("select run, epoch, round(synth_iou,6) as synth_iou, round(real_iou,6) as real_iou, round(synth_iou-real_iou,6)+0.0::double as divergence from fx_runs")
def run_divergence(s):
    return rounded(metrics.run_divergence(s.metrics), "synth_iou", "real_iou", "divergence")


@query("""select a.epoch, round(a.synth_iou,6) as a, round(b.synth_iou,6) as b, round(b.synth_iou-a.synth_iou,6)+0.0::double as delta
 from (select * from fx_runs where run='1-URGENT') a full join (select * from fx_runs where run='5-LOW') b on a.epoch=b.epoch""")
def compare_runs(s):
    return rounded(metrics.compare_runs(s.metrics, "synth_iou", "1-URGENT", "5-LOW"), "a", "b", "delta")


@query("select run, tag, round(avg(value),6) as mean_value from fx_metrics where epoch between 6 and 14 group by run, tag")
def epoch_range_mean(s):
    return rounded(metrics.epoch_range_mean(s.metrics, 6, 14), "mean_value")


@query("""select run, epoch, tag, round(value,6) as value, value > greatest(coalesce(max(value) over
 (partition by run, tag order by epoch rows between unbounded preceding and 1 preceding),0),0) as is_best from fx_metrics""")
def running_best(s):
    return rounded(windows.running_best(s.metrics, ["run", "tag"]), "value")


@query("""select run, epoch, step, round(value,6) as value, round(avg(value) over (partition by run, epoch order by step rows between unbounded preceding and current row),6)
 as running_mean from fx_steps""")
def moving_mean(s):
    return rounded(windows.moving_mean(s.steps), "value", "running_mean")


LOG_FIELDS = "cast(o_orderkey%15 as bigint) as epoch, cast(o_custkey%900 as bigint) as seconds, o_custkey%1000 as a, o_orderkey%1000 as b"


def _log_lines(s):
    o = s.table("orders")
    n = lambda e: F.format_string("%.4f", F.expr(e).cast("double") / 1000)
    head = F.concat(F.lit("Epoch "), (F.col("o_orderkey") % 15).cast("string"), F.lit(": time "), (F.col("o_custkey") % 900).cast("string"),
                    F.lit("s | train_loss "), n("o_custkey % 1000"), F.lit(" | val_loss "), n("o_orderkey % 1000"), F.lit(" | synth_iou "), n("o_orderkey % 700"),
                    F.lit(" | ref_match_auc "), F.when(F.col("o_orderkey") % 11 == 0, "nan").otherwise(n("o_custkey % 600")))
    tail = F.concat(F.lit(" || real_iou "), n("o_custkey % 500"), F.lit(" | DIVERGENCE "), F.format_string("%+.4f", F.expr("o_orderkey % 700 - o_custkey % 500").cast("double") / 1000))
    line = F.when(F.col("o_orderkey") % 3 == 0, head).otherwise(F.concat(head, tail))
    return o.select("o_orderkey", line.alias("value"))


@query("""select o_orderkey, o_orderkey%15 as epoch, o_custkey%900 as seconds, round((o_custkey%1000)/1000,6) as train_loss, round((o_orderkey%1000)/1000,6) as val_loss,
 round((o_orderkey%700)/1000,6) as synth_iou, case when o_orderkey%11=0 then null else round((o_custkey%600)/1000,6) end as ref_match_auc,
 case when o_orderkey%3=0 then null else round((o_custkey%500)/1000,6) end as real_iou,
 case when o_orderkey%3=0 then null else round((o_orderkey%700-o_custkey%500)/1000,6)+0.0::double end as divergence from orders""")
def parse_epoch_lines(s):
    parsed = parse_epoch_log(_log_lines(s))
    return rounded(parsed, "train_loss", "val_loss", "synth_iou", "ref_match_auc", "real_iou", "divergence")


@query("""select 'logged' as run, tag, count(*) as n, round(avg(v),6) as mean from (
 select 'train_loss' as tag, (o_custkey%1000)/1000 as v from orders union all select 'val_loss', (o_orderkey%1000)/1000 from orders
 union all select 'synth_iou', (o_orderkey%700)/1000 from orders union all select 'ref_match_auc', (o_custkey%600)/1000 from orders where o_orderkey%11<>0
 union all select 'real_iou', (o_custkey%500)/1000 from orders where o_orderkey%3<>0
 union all select 'divergence', (o_orderkey%700-o_custkey%500)/1000 from orders where o_orderkey%3<>0) x group by tag""")
def metric_log(s):
    long = metrics_from_log(parse_epoch_log(_log_lines(s)), "logged")
    return long.groupBy("run", "tag").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"))


# ---------------------------------------------------------------- per-image errors

PER_IMAGE = f"""{PAIRS}, b as (select g.image_id, g.gt_idx, coalesce(max(p.iou),0) as iou from fx_gt g
 left join pairs p on p.image_id=g.image_id and p.gt_idx=g.gt_idx and p.score>0.5 group by g.image_id, g.gt_idx),
per as (select b.image_id, i.mono, b.n_gt, coalesce(n_pred,0) as n_pred, b.mean_iou, coalesce(n_pred,0)/b.n_gt as over_prediction
 from (select image_id, count(*) as n_gt, avg(iou) as mean_iou from b group by image_id) b
 left join (select image_id, count(*) as n_pred from fx_preds where score>0.5 group by image_id) p on p.image_id=b.image_id left join fx_images i on i.image_id=b.image_id)"""


def _per_image(s):
    return metrics.per_image_errors(s.gt, s.preds, s.images)


@query(f"with {PER_IMAGE} select image_id, mono, n_gt, n_pred, round(mean_iou,6) as mean_iou, round(over_prediction,6) as over_prediction from per")
def per_image_errors(s):
    return rounded(_per_image(s), "mean_iou", "over_prediction")


@query(f"""with {PER_IMAGE}, sc as (select 'all' as scope, * from per union all select case when mono then 'mono' else 'colour' end, * from per)
select scope, count(*) as n_images, round(avg(mean_iou),6) as mean_iou, round(avg(n_pred),6) as mean_pred, round(avg(n_gt),6) as mean_gt,
 round(sum(n_pred)/sum(n_gt),6) as over_prediction, round(corr(n_pred,mean_iou),6) as corr_pred_iou, round(median(n_pred),6) as median_pred, round(median(n_gt),6) as median_gt
 from sc group by scope""")
def error_summary(s):
    return rounded(metrics.error_summary(_per_image(s)), "mean_iou", "mean_pred", "mean_gt", "over_prediction", "corr_pred_iou", "median_pred", "median_gt")


@query(f"with {PER_IMAGE} select image_id, n_gt, n_pred, round(mean_iou,6) as mean_iou from per order by round(mean_iou,9), image_id limit 20")
def worst_images(s):
    ranked = _per_image(s).withColumn("mean_iou", F.round("mean_iou", 9))
    return rounded(windows.worst_images(ranked, n=20).select("image_id", "n_gt", "n_pred", "mean_iou"), "mean_iou")


@query(f"with {PER_IMAGE} select image_id, n_gt, n_pred, round(mean_iou,6) as mean_iou from per where round(mean_iou,9) < 0.1")
def failed_images(s):
    ranked = _per_image(s).withColumn("mean_iou", F.round("mean_iou", 9))
    return rounded(windows.worst_images(ranked, below=0.1).select("image_id", "n_gt", "n_pred", "mean_iou"), "mean_iou")


@query("""with t as (select score, rank() over (order by score) as rk, count(*) over (partition by score) as c, image_id, q_idx from fx_preds)
select image_id, q_idx, round(score,6) as score, round(rk+(c-1)/2,6) as avg_rank from t""")
def avg_rank(s):
    ranked = windows.avg_rank(s.preds.select("image_id", "q_idx", "score"), "score", ["image_id", "q_idx"])
    return rounded(ranked, "score", "avg_rank")
