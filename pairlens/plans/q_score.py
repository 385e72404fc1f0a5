"""Queries of the rubric, thresholds and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import score as s
from ..operators.sample import portable_hash
from ..sources.io import with_ordinal
from .fixtures import Queries
from .q_columns import LOC, r6, tier_sql

Q = Queries()
TL = f"cast({tier_sql(LOC, c.LOCATION_TIERS)} as double)"
TS = f"cast({tier_sql('abs(scale-gt_scale)/gt_scale', c.SCALE_TIERS)} as double)"
TR = f"cast({tier_sql('abs(theta-gt_rot)', c.ROTATION_TIERS)} as double)"
#: Measured rows of the graded sets, as a common table expression g.
G = f"g as (select *, {LOC} as err, {TL} as rl, {TS} as rs, {TR} as rr, case when gt_found=1 and {LOC}<=5 then 1 else 0 end as ok5 from v1 where grp in ('A','B','C'))"


def auc_sql(cte: str, rows: str, key: str, label: str = "ok5", score: str = "score") -> str:
    return f"""{cte}h as (select {key} as k, {score} as s, sum({label}) as p, count(*)-sum({label}) as q from {rows} group by 1,2),
 {cte}w as (select *, sum(q) over (partition by k order by s) - q as below from {cte}h),
 {cte}auc as (select k, sum(p*(below+0.5*q))/nullif(sum(p)*sum(q),0) as auc from {cte}w group by 1)"""


def rubric_sql(key: str, t: float) -> str:
    return f"""with {G}, {auc_sql('x', 'g', key)},
 r as (select {key} as k, avg(case when grp='A' then case when score>={t} then rl else 0 end end) as loc_a, avg(case when grp='B' then case when score>={t} then rl else 0 end end) as loc_b,
  avg(case when gt_found=1 and score>={t} and rl>0 then rs end) as sc, avg(case when gt_found=1 and score>={t} and rl>0 then rr end) as rot,
  count_if(score<{t} and gt_found=0) as tp, count_if(score<{t} and gt_found=1) as fp, count_if(score>={t} and gt_found=0) as fn, count_if(score>={t} and gt_found=1) as tpp,
  count(*) as n, sum(gt_found)::bigint as n_present from g group by 1),
 f as (select r.*, 2.0*tp/(2*tp+fp+fn) as f1, 2.0*tpp/(2*tpp+fn+fp) as f1p, 0.45*loc_a+0.55*loc_b as loc from r)"""


@Q.add("a02_rubric", rubric_sql("architecture", 0.5) + " select f.k as architecture, round(loc_a,6) as loc_a, round(loc_b,6) as loc_b, round(sc,6) as scale, round(rot,6) as rot, round(f1::double,6) as f1, round(f1p::double,6) as f1_found, round(auc::double,6) as auc, round(40*loc+10*sc+10*rot+15*f1+10*auc,4) as total, n, n_present from f join xauc on f.k=xauc.k", "v1")
def a02(v):
    out = s.rubric(s.measured(v), ["architecture"], 0.5)
    return out.select("architecture", *(r6(F.col(k)).alias(k) for k in ("loc_a", "loc_b", "scale", "rot", "f1", "f1_found", "auc")), F.round("total", 4).alias("total"), "n", "n_present")


CONF = "select architecture, count_if(score<0.5 and gt_found=0)::bigint as tp, count_if(score<0.5 and gt_found=1)::bigint as fp, count_if(score>=0.5 and gt_found=0)::bigint as fn from v1 group by 1"


@Q.add("a03_confusion_f1", f"select architecture, tp, fp, fn, round((2.0*tp/(2*tp+fp+fn))::double,6) as f1 from ({CONF})", "v1")
def a03(v):
    out = v.groupBy("architecture").agg(*(e.alias(k) for k, e in s.confusion(F.col("score") >= 0.5, F.col("gt_found") == 1).items()))
    return out.withColumn("f1", r6(s.f1(F.col("tp"), F.col("fp"), F.col("fn"))))


@Q.add("a04_precision_recall", "select severity, round((tp*1.0/nullif(tp+fp,0))::double,6) as precision, round((tp*1.0/nullif(tp+fn,0))::double,6) as recall, round(coalesce(2.0*tp/nullif(2*tp+fp+fn,0),0)::double,6) as f1 from (select severity, count_if(score>=0.5 and gt_found=1) as tp, count_if(score>=0.5 and gt_found=0) as fp, count_if(score<0.5 and gt_found=1) as fn from v1 group by 1)", "v1")
def a04(v):
    n = v.groupBy("severity").agg(*(e.alias(k) for k, e in s.confusion(F.col("score") >= 0.5, F.col("gt_found") == 1, "present").items()))
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    return n.select("severity", r6(s.ratio(tp, tp + fp)).alias("precision"), r6(s.ratio(tp, tp + fn)).alias("recall"), r6(s.f1(tp, fp, fn)).alias("f1"))


@Q.add("a05_auc", f"with {G}, {auc_sql('x', 'g', 'architecture')} select k as architecture, round(auc::double,9) as auc from xauc", "v1")
def a05(v):
    return s.auc(s.measured(v).filter("grp in ('A','B','C')"), ["architecture"], "correct").select("architecture", F.round("auc", 9).alias("auc"))


LABELS = "l as (select score, unnest([{'label':'present','y':ok5},{'label':'submitted','y':case when (gt_found=1 and score>=0.5 and err<=5) or (gt_found=0 and score<0.5) then 1 else 0 end},{'label':'reject_ok','y':case when gt_found=0 then cast(score<0.5 as int) else ok5 end}]) as u from g), m as (select score, u.label as label, u.y as y from l)"


@Q.add("a06_auc_labels", f"with {G}, {LABELS}, {auc_sql('x', 'm', 'label', 'y')} select k as label, round(auc::double,9) as auc from xauc", "v1")
def a06(v):
    rows = s.measured(v).filter("grp in ('A','B','C')")
    near, said, there = F.coalesce(F.col("err") <= 5, F.lit(False)), F.col("score") >= 0.5, F.col("gt_found") == 1
    labels = {"present": there & near, "submitted": (there & said & near) | (~there & ~said), "reject_ok": F.when(there, near).otherwise(~said)}
    long = rows.select("score", c.stacked({k: e.cast("int") for k, e in labels.items()}, "label", "y"))
    return s.auc(long, ["label"], "y").select("label", F.round("auc", 9).alias("auc"))


CDF = "select grp, err, round((sum(n) over (partition by grp order by err)*1.0/sum(n) over (partition by grp))::double,6) as share from (select grp, round(err,1) as err, count(*) as n from g where gt_found=1 group by 1,2)"


@Q.add("a16_error_cdf", f"with {G} {CDF}", "v1")
def a16(v):
    rows = s.measured(v).filter("grp in ('A','B','C') and gt_found = 1").select("grp", F.round("err", 1).alias("err"), F.lit(1).alias("n"))
    swept = s.running(s.histogram(rows, ["grp"], ("n",), "err"), ["grp"], ("n",), "err", high=100.0)
    return swept.select("grp", "err", r6((F.col("all_n") - F.col("ge_n") + F.col("n")) / F.col("all_n")).alias("share"))


PR = "h as (select architecture as k, score as s, sum(ok5) as p, count(*) as n from g group by 1,2), w as (select *, sum(p) over (partition by k order by s desc) as cp, sum(n) over (partition by k order by s desc) as cn, sum(n) over (partition by k) as tot from h), pr as (select k, s, cp*1.0::double/cn as prec, cp*1.0::double/tot as rec from w)"


@Q.add("a17_average_precision", f"with {G}, {PR}, z as (select k, prec, rec, lag(prec,1,1.0) over (partition by k order by s desc) as p0, lag(rec,1,0.0) over (partition by k order by s desc) as r0 from pr) select k as architecture, round(sum((rec-r0)*(prec+p0)/2),6) as ap from z group by 1", "v1")
def a17(v):
    curve = s.pr_curve(s.measured(v).filter("grp in ('A','B','C')"), ["architecture"], "correct")
    return s.average_precision(curve, ["architecture"]).select("architecture", r6(F.col("ap")).alias("ap"))


@Q.add("w04_cumulative_counts", f"with {G}, {PR} select k as architecture, s as score, cp::bigint as tp, (cn-cp)::bigint as fp from w", "v1")
def w04(v):
    rows = s.measured(v).filter("grp in ('A','B','C')")
    swept = s.running(s.histogram(rows, ["architecture"], ("correct", "n")), ["architecture"], ("correct", "n"))
    return swept.select("architecture", "score", F.col("ge_correct").alias("tp"), (F.col("ge_n") - F.col("ge_correct")).alias("fp"))


@Q.add("a33_bonus_gates", rubric_sql("1", 0.5) + ", d as (select avg(case when score>=0.5 then rl else 0 end) as set_d from (select score, " + TL + " as rl from v1 where grp='D')) select round(set_d,6) as set_d, round(loc,6) as gray, (set_d>=0.4 and loc>=0.5) as bonus_d, f1>=0.9 as bonus_f1 from f, d", "v1")
def a33(v):
    rows = s.measured(v)
    one = s.rubric(rows, [], 0.5)
    d = rows.filter("grp = 'D'").agg(F.avg(F.when(F.col("score") >= 0.5, F.col("raw_loc")).otherwise(0.0)).alias("set_d"))
    return one.crossJoin(d).select(r6(F.col("set_d")).alias("set_d"), r6(F.col("loc")).alias("gray"), ((F.col("set_d") >= 0.4) & (F.col("loc") >= 0.5)).alias("bonus_d"), (F.col("f1") >= 0.9).alias("bonus_f1"))


def sweep_sql(key: str, rows: str = "g", score: str = "score", cte: str = "") -> str:
    """Common table expressions ending in ``{cte}t``: the rubric at every score of each key."""
    return f"""{cte}sh as (select {key} as k, {score} as s, count(*) as n, sum(gt_found) as pre, sum(1-gt_found) as ab, sum(ok5) as ok5, sum(case when grp='A' then rl else 0 end) as la, sum(case when grp='B' then rl else 0 end) as lb,
  sum(case when grp='A' then 1 else 0 end) as na, sum(case when grp='B' then 1 else 0 end) as nb, sum(case when gt_found=1 and rl>0 then 1 else 0 end) as ok, sum(case when gt_found=1 and rl>0 then rs else 0 end) as sc, sum(case when gt_found=1 and rl>0 then rr else 0 end) as rc from {rows} group by 1,2),
 {cte}sw as (select k, s, {', '.join(f'sum({m}) over (partition by k order by s desc) as ge_{m}, sum({m}) over (partition by k) as all_{m}' for m in ('n', 'pre', 'ab', 'ok5', 'la', 'lb', 'na', 'nb', 'ok', 'sc', 'rc'))}, n, ok5 from {cte}sh),
 {cte}sa as (select k, coalesce(sum(ok5*((all_n-all_ok5)-(ge_n-ge_ok5)+0.5*(n-ok5)))/nullif(max(all_ok5)*(max(all_n)-max(all_ok5)),0),0) as auc from {cte}sw group by 1),
 {cte}sp as (select w.k, s, auc, 0.45*ge_la/nullif(all_na,0)+0.55*ge_lb/nullif(all_nb,0) as loc, coalesce(ge_sc/nullif(ge_ok,0),0) as scale, coalesce(ge_rc/nullif(ge_ok,0),0) as rot,
  coalesce(2.0*(all_ab-ge_ab)/nullif(2*(all_ab-ge_ab)+(all_pre-ge_pre)+ge_ab,0),0) as f1, coalesce(2.0*ge_pre/nullif(2*ge_pre+(all_pre-ge_pre)+ge_ab,0),0) as f1p from {cte}sw w join {cte}sa a on w.k=a.k),
 {cte}t as (select k, s, loc, f1::double as f1, round((40*loc+10*scale+10*rot+15*f1+10*auc)::double,9) as total, round((40*loc+10*scale+10*rot+15*f1p+10*auc)::double,9) as total_found from {cte}sp)"""


@Q.add("m01_best_f1_threshold", f"with {G}, {sweep_sql('architecture')} select k as architecture, round(max(f1),6) as best, min(s) filter (where rf=mf) as threshold from (select *, round(f1,9) as rf, max(round(f1,9)) over (partition by k) as mf from t) group by 1", "v1")
def m01(v):
    swept = s.sweep(s.measured(v), ["architecture"]).withColumn("f1", F.round("f1", 9))
    return s.best(swept, ["architecture"], "f1").select("architecture", r6(F.col("best")).alias("best"), "threshold")


STATS = "st as (select g.* exclude (score), u.stat as stat, u.value as score from (select *, unnest([{'stat':'score','value':score},{'stat':'min','value':least(score,zncc)},{'stat':'mean','value':(score+zncc)/2}]) as u from g) g)"


@Q.add("m02_best_total_threshold", f"with {G}, {STATS}, {sweep_sql('stat', 'st')} select k as stat, round(max(total),6) as best, min(s) filter (where total=mt) as threshold from (select *, max(total) over (partition by k) as mt from t) group by 1", "v1")
def m02(v):
    rows, stats = s.measured(v), c.statistics()
    long = rows.select(*(x for x in rows.columns if x != "score"), c.stacked({k: stats[k] for k in ("score", "min", "mean")}, "stat", "score"))
    swept = s.sweep(long, ["stat"]).withColumn("total", F.round("total", 9))
    return s.best(swept, ["stat"]).select("stat", r6(F.col("best")).alias("best"), "threshold")


def cv_sql(fold: str) -> str:
    return f"""with {G.replace('from v1', f', {fold} as fold from v1')}, fs as (select distinct fold as f from g), tr as (select g.*, fs.f as hold from g, fs where g.fold<>fs.f),
 {sweep_sql('hold', 'tr', cte='ka')}, best as (select k, min(s) filter (where total=mt) as threshold from (select *, max(total) over (partition by k) as mt from kat) group by 1),
 {sweep_sql('fold', 'g', cte='kb')}
 select b.k as fold, threshold, round(min_by(total, s),6) as held_total, round(min_by(f1, s),6) as held_f1 from kbt b join best on best.k=b.k where s>=threshold group by 1,2"""


@Q.add("m03_two_fold_threshold", cv_sql("cast((row_number() over (order by pair_id)-1)%2 as int)"), "v1")
def m03(v):
    """Folds are alternating rows of the graded sets, in the order of their ids."""
    rows = with_ordinal(s.measured(v).filter("grp in ('A','B','C')"), "pair_id", "fold")
    out = s.held_out(rows.withColumn("fold", (F.col("fold") % 2).cast("int")), "fold")
    return out.select("fold", "threshold", r6(F.col("held_total")).alias("held_total"), r6(F.col("held_f1")).alias("held_f1"))


HASH4 = "cast(('0x'||substr(md5(concat_ws('|',pair_id,0)),1,8))::bigint%4 as int)"


@Q.add("m04_kfold_threshold", cv_sql(HASH4), "v1")
def m04(v):
    out = s.held_out(s.measured(v).withColumn("fold", (portable_hash("pair_id", F.lit(0)) % 4).cast("int")), "fold")
    return out.select("fold", "threshold", r6(F.col("held_total")).alias("held_total"), r6(F.col("held_f1")).alias("held_f1"))


M09 = "select k as architecture, round(mt,6) as best, min(s) as threshold, round(any_value(mtf),6) as best_found, min(s) filter (where total_found>=mtf-0.05) as threshold_found from (select *, max(total) over (partition by k) as mt, max(total_found) over (partition by k) as mtf from t) group by 1,2"


@Q.add("m09_downward_biased_threshold", f"with {G}, {sweep_sql('architecture')} {M09.replace('min(s) as threshold,', 'min(s) filter (where total>=mt-0.05) as threshold,')}", "v1")
def m09(v):
    """The least threshold within 0.05 of the best total, with refusals and with findings as the positive answers of F1."""
    swept = s.found_total(s.sweep(s.measured(v), ["architecture"])).withColumns({k: F.round(k, 9) for k in ("total", "total_found")})
    x = s.best(swept, ["architecture"], margin=0.05)
    y = s.best(swept, ["architecture"], "total_found", margin=0.05).withColumnsRenamed({"best": "best_found", "threshold": "threshold_found"})
    return x.join(y, "architecture").select("architecture", r6(F.col("best")).alias("best"), "threshold", r6(F.col("best_found")).alias("best_found"), "threshold_found")


GRID = (0.2, 0.3, 0.4, 0.5, 0.6)


@Q.add("m23_arm_threshold_grid", f"with {G}, {sweep_sql('architecture')}, th as (select unnest({list(GRID)}::double[]) as threshold) select k as architecture, threshold, round(min_by(total,s),6) as total from t, th where s>=threshold group by 1,2", "v1")
def m23(v):
    swept = s.sweep(s.measured(v), ["architecture"])
    grid = F.explode(F.array(*(F.lit(t) for t in GRID)))
    at = swept.select("architecture", "score", F.round("total", 9).alias("total"), grid.alias("threshold")).filter("score >= threshold")
    return at.groupBy("architecture", "threshold").agg(r6(F.min_by("total", "score")).alias("total"))


RUNS = "rr as (select 'a' as run, * from v1 union all select 'b', * from v2)"


@Q.add("t05_rank_by_objective", f"with {RUNS}, {G.replace('from v1', 'from rr')}, {sweep_sql('run')}, at5 as (select k, min_by(total,s) as total, min_by(f1,s) as f1 from t where s>=0.5 group by 1) select k as run, round(total+4*cast(f1>=0.9 as int),6) as objective, row_number() over (order by total+4*cast(f1>=0.9 as int) desc, k) as place from at5", "v1 v2")
def t05(v, w):
    from pyspark.sql import Window

    both = v.withColumn("run", F.lit("a")).union(w.withColumn("run", F.lit("b")))
    at = s.sweep(s.measured(both), ["run"]).filter("score >= 0.5").groupBy("run").agg(F.min_by(F.round("total", 9), "score").alias("total"), F.min_by("f1", "score").alias("f1"))
    value = F.col("total") + 4 * (F.col("f1") >= 0.9).cast("int")
    return at.select("run", r6(value).alias("objective"), F.row_number().over(Window.orderBy(F.desc(value), "run")).cast("long").alias("place"))
