"""Queries of samples, bootstraps and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import sample as m
from ..operators import score as s
from ..sources.io import stored
from .fixtures import Queries
from .q_columns import r6
from .q_score import G, HASH4, auc_sql, sweep_sql

Q = Queries()
H = "('0x'||substr(md5(concat_ws('|',{})),1,8))::bigint"
QUOTAS = {"A": 70, "B": 70, "C": 40}
QSQL = "q as (select unnest(['A','B','C']) as grp, unnest([70,70,40]) as quota)"


@Q.add("m13_stratified_draw", f"with {QSQL}, r as (select pair_id, grp, row_number() over (partition by grp order by {H.format('pair_id,7')}, pair_id) as i from v1) select pair_id, grp from r join q using (grp) where i<=quota", "v1")
def m13(v):
    return m.stratified(v.select("pair_id", "grp"), "grp", QUOTAS, 7)


N_DRAWS = 2000


def draws_sql(rows: str) -> str:
    """Common table expressions ending in k: rows of the draws, with draw."""
    return f"""nu as (select *, row_number() over (partition by grp order by pair_id)-1 as at from {rows}), st as (select grp, count(*) as n, any_value(quota) as quota from nu join q using (grp) group by 1),
 tr as (select grp, n, quota, draw, unnest(range((ceil(-2*n*ln(greatest(1-quota/(n+0.5),1e-9)))+40)::bigint)) as i from st, (select unnest(range({N_DRAWS})) as draw)),
 pl as (select draw, grp, quota, {H.format('grp,draw,i')}%n as place, min(i) as i from tr group by 1,2,3,4),
 fp as (select draw, grp, place from (select *, row_number() over (partition by draw, grp order by i) as r from pl) where r<=quota),
 k as (select fp.draw, nu.* from fp join nu on nu.grp=fp.grp and nu.at=fp.place)"""


THRESHOLDS = (0.3, 0.4, 0.5)
PARTS = "z as (select draw, t, coalesce(2.0*count_if(score<t and gt_found=0)/nullif(2*count_if(score<t and gt_found=0)+count_if(score<t and gt_found=1)+count_if(score>=t and gt_found=0),0),0) as f1, 0.45*avg(case when grp='A' then case when score>=t then rl else 0 end end)+0.55*avg(case when grp='B' then case when score>=t then rl else 0 end end) as loc, coalesce(avg(case when gt_found=1 and rl>0 and score>=t then rs end),0) as sc, coalesce(avg(case when gt_found=1 and rl>0 and score>=t then rr end),0) as rot from k, (select unnest([0.3,0.4,0.5]::double[]) as t) group by 1,2), o as (select z.*, 40*loc+10*sc+10*rot+15*f1+10*coalesce(auc,0) as total from z join xauc on xauc.k=z.draw)"


@Q.add("m14_stratified_bootstrap", f"with {G}, {QSQL}, {draws_sql('g')}, {auc_sql('x', 'k', 'draw')}, {PARTS} select t as threshold, round(avg(f1)::double,6) as mean_f1, round(avg(case when f1>=0.9 then 1.0::double else 0 end),6) as p_bonus, round(avg(loc),6) as mean_loc, round(avg(total)::double,6) as mean_total, round((avg(total)+4*avg(case when f1>=0.9 then 1.0::double else 0 end))::double,6) as mean_with_bonus from o group by 1", "v1")
def m14(v):
    """2,000 draws, shared by all thresholds: mean F1, credit and total, and the chance of the bonus."""
    drawn = m.draws(s.measured(v).filter("grp in ('A','B','C')"), "grp", QUOTAS, N_DRAWS)
    hist = stored(s.histogram(drawn, ["draw"]).withColumn("wrong", F.col("n") - F.col("correct")))  # all else is a sum over it
    ranked = s.auc_of(hist, ["draw"], positive="correct", negative="wrong")
    grid = F.explode(F.array(*(F.lit(t) for t in THRESHOLDS)))
    on = F.when(F.col("score") >= F.col("threshold"), 1).otherwise(0)
    at = hist.withColumn("threshold", grid).groupBy("draw", "threshold").agg(*(F.sum(F.col(k) * on).alias(f"ge_{k}") for k in s.MEASURES), *(F.sum(k).alias(f"all_{k}") for k in s.MEASURES))
    one = at.select("draw", "threshold", *(e.alias(k) for k, e in s.parts_at().items())).join(ranked, "draw").withColumn("auc", F.coalesce("auc", F.lit(0.0)))
    bonus = F.avg((F.col("f1") >= 0.9).cast("double"))
    total = F.avg(s.total({k: F.col(k) for k in s.POINTS}))
    return one.groupBy("threshold").agg(r6(F.avg("f1")).alias("mean_f1"), r6(bonus).alias("p_bonus"), r6(F.avg("loc")).alias("mean_loc"), r6(total).alias("mean_total"), r6(total + 4 * bonus).alias("mean_with_bonus"))


#: ln k! and ln p(k) of a Poisson count of mean n
LOGFACT = "case when k<=20 then ln(factorial(least(k,20)::int)::double) else k*ln(k::double)-k+0.5*ln(2*3.141592653589793*k)+1/(12.0e0*k)-1/(360.0e0*k*k*k)+1/(1260.0e0*k*k*k*k*k) end"
LOGP = f"case when k=0 then -n::double else k*ln(1+(n-k)/k::double)+(k-n)-({LOGFACT})+(k*ln(k::double)-k) end"


def paired_sql(a: str, b: str, strata: str = "", name: str = "") -> str:
    """Common table expressions ending in ``{name}dd``: draw, delta."""
    s_ = f"{strata}," if strata else ""
    u = f"(({H.format(','.join((strata, 'a', 'b', 'draw', '0') if strata else ('a', 'b', 'draw', '0')))})+0.5)/4294967296.0"
    on = "and ".join(f"w.{k}=t.{k} " for k in ((strata, "a", "b") if strata else ("a", "b")))
    return f"""{name}c as (select {s_} round(va*1000)::int as a, round(vb*1000)::int as b, count(*) as n from (select a.grp, {a} as va, {b} as vb from v1 a join v2 b using (pair_id) where a.gt_found=1) group by all),
 {name}k as (select *, unnest(range(greatest(0,n-ceil(9*sqrt(n))::bigint-40), n+ceil(9*sqrt(n))::bigint+41)) as k from {name}c),
 {name}t as (select {s_} a, b, n, k, coalesce(sum(exp({LOGP})) over (partition by {s_} a, b order by k rows between unbounded preceding and 1 preceding),0) as low from {name}k),
 {name}u as (select {s_} a, b, n, draw, ({u})::double as u from {name}c, (select unnest(range({N_DRAWS})) as draw)),
 {name}w as (select w.*, t.k as wt from {name}u w asof join {name}t t on {on} and w.u>=t.low),
 {name}d as (select draw, {s_} sum(wt*(b-a))/sum(wt)/1000 as d from {name}w where wt>0 group by all), {name}dd as (select draw, avg(d) as delta from {name}d group by 1)"""


CREDIT = "case when sqrt(({r}.x-{r}.gt_x)**2+({r}.y-{r}.gt_y)**2)<=1 then 1.0::double when sqrt(({r}.x-{r}.gt_x)**2+({r}.y-{r}.gt_y)**2)<=2 then 0.8 when sqrt(({r}.x-{r}.gt_x)**2+({r}.y-{r}.gt_y)**2)<=3 then 0.6 when sqrt(({r}.x-{r}.gt_x)**2+({r}.y-{r}.gt_y)**2)<=5 then 0.4 else 0 end"
HIT = "case when sqrt(({r}.x-{r}.gt_x)**2+({r}.y-{r}.gt_y)**2)<={t} then 1.0::double else 0 end"
HITS = {"a": HIT.format(r="a", t=5), "b": HIT.format(r="b", t=5)}
CREDITS = {"a": CREDIT.format(r="a"), "b": CREDIT.format(r="b")}
ENDS = "round(avg(delta),6) as mean, round(quantile_cont(delta,0.025),6) as lo, round(quantile_cont(delta,0.975),6) as hi, round(avg(case when delta>0 then 1.0::double else 0 end),6) as p_better, round(avg(case when delta<0 then 1.0::double else 0 end),6) as p_worse, round(avg(case when delta>=0.35 then 1.0::double else 0 end),6) as p_bar"


def both(v, w, /, **values):
    x = v.filter("gt_found = 1").select("pair_id", "grp", *(e.alias(f"{k}a") for k, e in values.items()))
    return x.join(w.select("pair_id", *(e.alias(f"{k}b") for k, e in values.items())), "pair_id")


def credit():
    return c.tier(c.location_error(), c.LOCATION_TIERS)


def hit(t: float = 5):
    return F.coalesce(c.location_error() <= t, F.lit(False)).cast("double")


@Q.add("m15_paired_bootstrap", f"with {paired_sql(CREDITS['a'], CREDITS['b'], 'grp')} select {ENDS} from dd", "v1 v2")
def m15(v, w):
    out = m.interval(m.paired_difference(both(v, w, v=credit()), "va", "vb", N_DRAWS, strata=["grp"]))
    return out.select(*(r6(F.col(k)).alias(k) for k in out.columns))


@Q.add("m16_paired_accuracy_bootstrap", f"with {paired_sql(HITS['a'], HITS['b'])} select {ENDS} from dd", "v1 v2")
def m16(v, w):
    out = m.interval(m.paired_difference(both(v, w, v=hit()), "va", "vb", N_DRAWS))
    return out.select(*(r6(F.col(k)).alias(k) for k in out.columns))


OTHERS = f"ot as (select avg({CREDITS['b']})-avg({CREDITS['a']}) as d_credit, avg({HIT.format(r='b', t=1)})-avg({HIT.format(r='a', t=1)}) as d_fine from v1 a join v2 b using (pair_id) where a.gt_found=1)"


@Q.add("m26_promotion_rule", f"with {paired_sql(HITS['a'], HITS['b'])}, {OTHERS}, i as (select avg(delta) as mean, quantile_cont(delta,0.025) as lo, quantile_cont(delta,0.975) as hi from dd) select mean>0 as better, not(lo<=0 and hi>=0) as clear, round(d_credit,6) as d_credit, round(d_fine,6) as d_fine, d_credit>=0 and d_fine>=0 as no_worse, case when mean<=0 then 'keep' when lo>0 and d_credit>=0 and d_fine>=0 then 'promote' else 'under the gate' end as verdict from i, ot", "v1 v2")
def m26(v, w):
    """Promoted: more hits with an interval above 0, and neither less credit nor fewer hits within 1 px."""
    rows = both(v, w, hit=hit(), credit=credit(), fine=hit(1))
    i = m.interval(m.paired_difference(rows, "hita", "hitb", N_DRAWS))
    other = rows.agg(*((F.avg(f"{k}b") - F.avg(f"{k}a")).alias(f"d_{k}") for k in ("credit", "fine")))
    better, clear, no_worse = F.col("mean") > 0, ~((F.col("lo") <= 0) & (F.col("hi") >= 0)), (F.col("d_credit") >= 0) & (F.col("d_fine") >= 0)
    verdict = F.when(~better, "keep").when((F.col("lo") > 0) & no_worse, "promote").otherwise("under the gate")
    return i.crossJoin(other).select(better.alias("better"), clear.alias("clear"), r6(F.col("d_credit")).alias("d_credit"), r6(F.col("d_fine")).alias("d_fine"), no_worse.alias("no_worse"), verdict.alias("verdict"))


def chosen_sql(fold: str, train: str, name: str) -> str:
    """Common table expressions ending in ``{name}b``: k (the fold), threshold with the best total on the training rows."""
    return f"{sweep_sql(fold, train, cte=name)}, {name}b as (select k, min(s) filter (where total=mt) as threshold from (select *, max(total) over (partition by k) as mt from {name}t) group by 1)"


OOF = f"gf as (select g.*, {HASH4} as fold from g), rt as (select gf.*, x.f as hold from gf, (select unnest([0,1,2,3]) as f) x where gf.fold<>x.f), {chosen_sql('hold', 'rt', 'ka')}, sd as (select gf.*, score>=threshold as said from gf join kab on kab.k=gf.fold)"


@Q.add("m17_out_of_fold_gate", f"with {G}, {QSQL}, {OOF}, {draws_sql('sd')}, z as (select draw, coalesce(2.0*count_if(not said and gt_found=0)/nullif(2*count_if(not said and gt_found=0)+count_if(not said and gt_found=1)+count_if(said and gt_found=0),0),0) as f1 from k group by 1) select round(avg(f1)::double,6) as mean_f1, round(quantile_cont(f1,0.9)::double,6) as p90_f1, round(avg(case when f1>=0.9 then 1.0::double else 0 end),6) as p_gate from z", "v1")
def m17(v):
    """Each row is decided by the threshold with the best total on the other folds; the gate is an F1 of 0.9 in a draw."""
    rows = s.measured(v).filter("grp in ('A','B','C')").withColumn("fold", (m.portable_hash("pair_id", 0) % 4).cast("int"))
    t = s.fold_thresholds(stored(s.histogram(rows, ["fold"])), "fold")
    said = rows.join(F.broadcast(t), "fold").withColumn("said", F.col("score") >= F.col("threshold"))
    one = m.draws(said, "grp", QUOTAS, N_DRAWS).groupBy("draw").agg(s.f1(**s.confusion(F.col("said"), F.col("gt_found") == 1)).alias("f1"))
    return one.agg(r6(F.avg("f1")).alias("mean_f1"), r6(F.percentile("f1", F.lit(0.9))).alias("p90_f1"), r6(F.avg((F.col("f1") >= 0.9).cast("double"))).alias("p_gate"))


HALVES = f"l as (select g.*, seed, row_number() over (partition by seed, gt_found order by {H.format('pair_id,seed')}, pair_id)>count(*) over (partition by seed, gt_found)/2.0 as second from g, (select unnest(range(5))::int as seed)), h0 as (select * from l where not second), h1 as (select * from l where second)"


@Q.add("m18_half_splits", f"with {G}, {HALVES}, {chosen_sql('seed', 'h0', 'ka')}, {sweep_sql('seed', 'h1', cte='kb')}, e as (select b.k, min_by(total, s) as total, min_by(f1, s) as f1 from kbt b join kab on kab.k=b.k where s>=threshold group by 1) select round(avg(total),6) as mean_total, round(stddev_samp(total),6) as sd_total, round(avg(f1)::double,6) as mean_f1, round(stddev_samp(f1)::double,6) as sd_f1 from e", "v1")
def m18(v):
    """The threshold with the best total on one half, and what it earns on the other, over seeds."""
    long = m.half_splits(s.measured(v).filter("grp in ('A','B','C')"), "gt_found", 5)
    hist = stored(s.histogram(long, ["seed", "half"]))
    swept = lambda half: s.sweep_hist(hist.filter(F.col("half") == half).drop("half"), ["seed"]).withColumn("total", F.round("total", 9))
    t = s.best(swept(0), ["seed"]).select(F.col("seed").alias("_k"), "threshold")
    at = swept(1).join(F.broadcast(t), F.col("seed") == F.col("_k")).filter("score >= threshold").groupBy("seed").agg(F.min_by("total", "score").alias("total"), F.min_by("f1", "score").alias("f1"))
    return at.agg(*(r6(f(k)).alias(f"{n}_{k}") for k in ("total", "f1") for n, f in (("mean", F.avg), ("sd", F.stddev_samp))))


@Q.add("m19_fixed_sample", f"select pair_id from v1 order by {H.format('pair_id,11')}, pair_id limit 500", "v1")
def m19(v):
    return m.fixed_size(v.select("pair_id"), 500, 11)


APPORTIONED = "w as (select architecture as name, count(*) as weight from v1 group by 1), x as (select name, weight*1.0::double/sum(weight) over ()*100 as e from w), f as (select name, floor(e) as n, e-floor(e) as r from x), ap as (select name, (n+cast(row_number() over (order by round(r,9) desc, name)<=100-sum(n) over () as int))::bigint as n from f)"


@Q.add("m24_composition_plan", f"with {APPORTIONED}, it as (select name, n, unnest(range(n)) as i from ap where n>0) select row_number() over (order by round((i+0.5)/n,9), name)-1 as place, name, (i%5)::int as level, round(8+(12-8)*(({H.format('name,i,3')})+0.5)/4294967296.0,6) as value from it", "v1")
def m24(v):
    weights = v.groupBy(F.col("architecture").alias("name")).agg(F.count("*").alias("weight"))
    return m.composition_plan(weights, 100, levels=5, low=8.0, high=12.0, seed=3).withColumn("value", r6(F.col("value")))


@Q.add("m25_worker_quotas", "with n as (select count(*) as t from v1), w as (select unnest(range(7)) as worker), q as (select worker, t//7+cast(worker<t%7 as int) as n from w, n) select worker, greatest(0,least(n, 10000-(sum(n) over (order by worker)-n)))::bigint as n from q", "v1")
def m25(v):
    return m.worker_quotas(v.sparkSession, v.count(), 7, cap=10_000)
