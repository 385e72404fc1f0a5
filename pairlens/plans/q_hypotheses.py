"""Queries of candidates, selectors and votes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import hypotheses as h
from ..operators.aggregate import each_alone
from .fixtures import Queries
from .q_columns import LOC, r6

Q = Queries()
PLACES = ", ".join(f"rank() over (partition by pair_id order by {s} desc) as {s}_place" for s in h.SCORES)


@Q.add("w01_ranks", f"select pair_id, hypothesis_index, {PLACES} from v3", "v3")
def w01(v):
    out = h.ranked(v)
    return out.select("pair_id", "hypothesis_index", *(F.col(f"{s}_place").cast("long").alias(f"{s}_place") for s in h.SCORES)).withColumn("hypothesis_index", F.col("hypothesis_index").cast("long"))


def first(score: str) -> str:
    return f"arg_max(hypothesis_index, struct_pack(s := {score}, i := -hypothesis_index))"


WIN = f"win as (select *, case when by_rank=by_band then by_rank else by_zncc end as by_consensus, case when by_rank=by_band then by_rank else by_zncc end as by_majority from (select pair_id, {first('zncc')} as by_zncc, {first('rank_score')} as by_rank, {first('band_score')} as by_band, {first('dog_score')} as by_dog from v3 group by 1))"


@Q.add("w02_winners", f"with {WIN} select pair_id, {', '.join(f'{k}::bigint as {k}' for k in ('by_zncc', 'by_rank', 'by_band', 'by_dog', 'by_consensus', 'by_majority'))} from win", "v3")
def w02(v):
    out = h.winners(v)
    return out.select("pair_id", *(F.col(k).cast("long").alias(k) for k in out.columns if k.startswith("by_")))


@Q.add("w03_winner_margin", f"with {WIN} select v3.pair_id, round(max(case when hypothesis_index=by_zncc then least(rank_score,zncc) end)-max(case when hypothesis_index<>by_zncc then least(rank_score,zncc) end),6) as margin from v3 join win on v3.pair_id=win.pair_id group by 1", "v3")
def w03(v):
    return h.winner_margin(v, h.winners(v)).withColumn("margin", r6(F.col("margin")))


FIRSTS = "fi as (select box, pair_id, coalesce(min(case when location_error<=t then hypothesis_index end),-1) as f from v3, (select unnest(['tight','basin','loose']) as box, unnest([1.0,3.0,6.0]) as t) group by 1,2)"


@Q.add("a18_candidate_recall", f"with {FIRSTS} select box, count(*) as n, " + ", ".join(f"round(avg(case when f>=0 and f<{k} then 1.0::double else 0 end),6) as recall{k}" for k in (1, 2, 5)) + ", count_if(f<0)::bigint as never from fi group by 1", "v3")
def a18(v):
    out = h.recall_at(v, "location_error", (1, 2, 5))
    return out.select("box", "n", *(r6(F.col(f"recall{k}")).alias(f"recall{k}") for k in (1, 2, 5)), "never")


SEL = "sel as (" + " union all ".join(f"select pair_id, '{s}' as selector, arg_max(location_error, struct_pack(s := {s}, i := -hypothesis_index)) as err from v3 group by 1" for s in h.SCORES) + " union all select pair_id, 'oracle', min(location_error) from v3 group by 1)"


@Q.add("a19_oracle", f"with {SEL}, b as (select a.pair_id, a.err as base, o.err as best from sel a join sel o on a.pair_id=o.pair_id and a.selector='zncc' and o.selector='oracle') select count_if(base>5)::bigint as failures, count_if(base>5 and best<=5)::bigint as recoverable, round(avg(best),6) as oracle_mean from b", "v3")
def a19(v):
    pair = h.selected_errors(v, scores=("zncc",))
    return pair.agg(F.count_if(F.col("zncc") > 5).alias("failures"), F.count_if((F.col("zncc") > 5) & (F.col("oracle") <= 5)).alias("recoverable"), r6(F.avg("oracle")).alias("oracle_mean"))


NET = "select a.selector, count_if(a.err<=5 and b.err>5)::bigint as rescued, count_if(a.err>5 and b.err<=5)::bigint as broken, (count_if(a.err<=5 and b.err>5)-count_if(a.err>5 and b.err<=5))::bigint as net from sel a join sel b on a.pair_id=b.pair_id and b.selector='zncc' where a.selector<>'zncc'"


@Q.add("a20_score_functions", f"with {SEL} {NET} group by 1", "v3")
def a20(v):
    return h.against(h.selector_errors(v), "zncc")


@Q.add("j12_selector_vs_baseline", f"with {SEL} {NET} and a.selector='rank_score' group by 1", "v3")
def j12(v):
    return h.against(h.selector_errors(v, scores=("zncc", "rank_score")), "zncc").filter("selector = 'rank_score'")


@Q.add("a21_union_of_rescues", f"with {SEL}, b as (select pair_id from sel where selector='zncc' and err>5), r as (select pair_id, bool_or(err<=5) as hit from sel where selector in ('rank_score','band_score','dog_score') group by 1) select count(*) as failures, count_if(hit)::bigint as rescued from b join r using (pair_id)", "v3")
def a21(v):
    e = h.selector_errors(v)
    failed = e.filter("selector = 'zncc' and err > 5").select("pair_id")
    some = e.filter(F.col("selector").isin("rank_score", "band_score", "dog_score")).groupBy("pair_id").agg(F.bool_or(F.col("err") <= 5).alias("any"))
    return failed.join(some, "pair_id").agg(F.count("*").alias("failures"), F.count_if("any").alias("rescued"))


@Q.add("a22_oracle_pose_gap", f"with {SEL}, j as (select v1.grp, a.err as est, o.err as best from v1 join sel a on v1.pair_id=a.pair_id and a.selector='zncc' join sel o on v1.pair_id=o.pair_id and o.selector='oracle') select grp, count(*) as n, round(avg(est-best),6) as gap, round((count_if(est>5 and best<=5)*1.0/nullif(count_if(est>5),0))::double,6) as fixed from j group by rollup(grp)", "v1 v3")
def a22(v, w):
    pair = h.selected_errors(w, scores=("zncc",))
    bad = F.col("zncc") > 5
    return v.select("pair_id", "grp").join(pair, "pair_id").rollup("grp").agg(F.count("*").alias("n"), r6(F.avg(F.col("zncc") - F.col("oracle"))).alias("gap"), r6(F.try_divide(F.count_if(bad & (F.col("oracle") <= 5)), F.count_if(bad))).alias("fixed"))


@Q.add("m20_routing_sweep", f"with {SEL}, j as (select v1.pair_id, peak_ratio, a.err as es, o.err as et from v1 join sel a on v1.pair_id=a.pair_id and a.selector='zncc' join sel o on v1.pair_id=o.pair_id and o.selector='oracle'), b as (select avg(case when et<=5 then 1.0::double else 0 end) as ba, quantile_cont(et,0.99) as bp from j), g as (select t, avg(case when case when peak_ratio<=t then es else et end<=5 then 1.0::double else 0 end) as acc, quantile_cont(case when peak_ratio<=t then es else et end,0.99) as p99, avg(case when peak_ratio<=t then 1.0::double else 9 end) as passes from j, (select unnest([0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]::double[]) as t) group by 1), k as (select *, acc>=ba and p99<=bp*1.05 as ok from g, b) select t as threshold, round(acc,6) as acc, round(p99,6) as p99, round(passes,6) as passes, ok, coalesce(t=arg_min(t, struct_pack(p := passes, t := t)) filter (where ok) over (), false) as chosen from k", "v1 v3")
def m20(v, w):
    pair = h.selected_errors(w, scores=("zncc",))
    out = h.routed(v.select("pair_id", "peak_ratio").join(pair, "pair_id"), [k / 10 for k in range(11)], "peak_ratio", "zncc", "oracle")
    return out.select("threshold", r6(F.col("acc")).alias("acc"), r6(F.col("p99")).alias("p99"), r6(F.col("passes")).alias("passes"), "ok", "chosen")


def proposals(v, check: str | None = None):
    some = [F.col("zncc").alias("score"), F.col("px").alias("x"), F.col("py").alias("y"), *([F.col(check).alias("check")] if check else [])]
    return v.groupBy("pair_id").agg(F.collect_set(F.struct(*some)).alias("props"))


ALPHAS = (0.0, 0.2, 0.35, 0.5, 1.0)


def alone(p: str) -> str:
    return f"{{'x0':{p}.x,'y0':{p}.y,'n':1::double,'s':{p}.score,'sx':{p}.score*{p}.x,'sy':{p}.score*{p}.y,'top':{p}.score,'c':{p}.c}}"


M21 = f"""with recursive pr as (
  select pair_id, list({{'score':zncc,'x':px,'y':py,'c':band_score}} order by zncc desc, px desc, py desc, band_score desc) as props
  from (select distinct pair_id, zncc, px, py, band_score from v3) group by 1),
t(pair_id, props, i, cl) as (
  select pair_id, props[2:], 1, [{alone("props[1]")}] from pr
  union all
  select pair_id, props, i+1, case when spot>0 then list_transform(cl, lambda k, j: case when j=spot then
    {{'x0':k.x0,'y0':k.y0,'n':k.n+1,'s':k.s+p.score,'sx':k.sx+p.score*p.x,'sy':k.sy+p.score*p.y,'top':k.top,'c':greatest(k.c,p.c)}} else k end)
    else list_append(cl, {alone("p")}) end
  from (select *, props[i] as p, coalesce(list_position(list_transform(cl, lambda k: sqrt((props[i].x-k.x0)*(props[i].x-k.x0)+(props[i].y-k.y0)*(props[i].y-k.y0))<=6), true), 0) as spot
    from t where i<=len(props))),
u as (select pair_id, len(cl) as clusters, unnest(cl) as k, generate_subscripts(cl, 1) as i from t where i>len(props)),
sh as (select *, sum(k.s) over (partition by pair_id) as whole from (select *, row_number() over (partition by pair_id order by k.s desc, i) as i4 from u) where i4<=4),
scored as (
  select pair_id, clusters, k, i, unnest([{{'rule':'sum','a':k.s,'b':k.n}},{{'rule':'top1','a':k.top,'b':0.0::double}},{{'rule':'count','a':k.n,'b':k.s}},
    {{'rule':'max','a':k.top,'b':1.0::double}},{{'rule':'count_mean','a':k.n*(k.s/k.n),'b':0.0::double}}]) as r from u
  union all
  select pair_id, clusters, k, i4, {{'rule':case when alpha=0 then 'verify' else 'verify+'||alpha end,'a':k.c+alpha/(case when whole=0 then 1.0 else whole end)*k.s,'b':0.0::double}}
  from sh, (select unnest({list(ALPHAS)}::double[]) as alpha)),
best as (select *, row_number() over (partition by pair_id, r.rule order by r.a desc, r.b desc, i) as place from scored)
select pair_id, clusters::int as clusters, r.rule as rule, round(case when r.rule='top1' then k.x0 else k.sx/(case when k.s=0 then 1.0 else k.s end) end,6) as x,
  round(case when r.rule='top1' then k.y0 else k.sy/(case when k.s=0 then 1.0 else k.s end) end,6) as y from best where place=1"""


@Q.add("m21_vote_rules", M21, "v3")
def m21(v):
    """x, y of each rule for each pair, with the band score as the check of the verified rules."""
    k = proposals(v, "band_score").select("pair_id", h.clustered(F.col("props"), verify=True).alias("k"))
    k = k.withColumn("short", h.shortlisted(F.col("k"))).withColumn("whole", h.confidence(F.col("short")))
    rules = {r: h.voted(F.col("k"), r) for r in h.RULES} | {"verify" if a == 0 else f"verify+{a}": h.verified(F.col("short"), F.col("whole"), a) for a in ALPHAS}
    return k.select("pair_id", F.size("k").alias("clusters"), F.inline(F.array(*(F.struct(F.lit(r).alias("rule"), p.alias("p")) for r, p in rules.items())))).select("pair_id", "clusters", "rule", r6(F.col("p.x")).alias("x"), r6(F.col("p.y")).alias("y"))


@Q.add("t03_top_clusters", "with p as (select distinct pair_id, zncc, px, py from v3), r as (select *, row_number() over (partition by pair_id order by zncc desc, px desc, py desc) as i from p) select pair_id, string_agg(cast(zncc as decimal(8,6)), ',' order by i) as top from r where i<=2 group by 1", "v3")
def t03(v):
    top = F.slice(F.reverse(F.array_sort("props")), 1, 2)
    return proposals(v).select("pair_id", F.array_join(F.transform(top, lambda p: p["score"].cast("decimal(8,6)").cast("string")), ",").alias("top"))


AB = f"ab as (select 'base' as variant, *, {LOC} as err from v1 union all select 'other', *, {LOC} from v2), tt as (select *, unnest([{{'d':'severity','v':cast(severity as varchar)}},{{'d':'architecture','v':architecture}}]) as u, case when err<=1 then 1.0::double when err<=2 then 0.8 when err<=3 then 0.6 when err<=5 then 0.4 else 0 end as cr from ab where err is not null), gg as (select variant, u.d as dimension, u.v as value, avg(cr) as credit, avg(abs(x-gt_x)) as dx, avg(case when err<=1 then 1.0::double else 0 end) as le1, max(err) as worst from tt group by 1,2,3)"


@Q.add("m22_variant_ab", f"with {AB} select g.variant, g.dimension, g.value, round(g.credit,6) as credit, round(g.dx,6) as dx, round(g.le1,6) as le1, round(g.worst,6) as worst, round(40*(g.credit-b.credit),6) as points from gg g join gg b on b.variant='base' and b.dimension=g.dimension and b.value=g.value", "v1 v2")
def m22(v, w):
    both = v.withColumn("variant", F.lit("base")).union(w.withColumn("variant", F.lit("other"))).withColumn("err", c.location_error()).filter("err is not null")
    one = each_alone(both, {"severity": F.lit(True), "architecture": F.lit(True)}).groupBy("variant", "dimension", "value").agg(F.avg(c.tier("err", c.LOCATION_TIERS)).alias("credit"), F.avg(F.abs(F.col("x") - F.col("gt_x"))).alias("dx"), F.avg((F.col("err") <= 1).cast("double")).alias("le1"), F.max("err").alias("worst"))
    base = one.filter("variant = 'base'").select("dimension", "value", F.col("credit").alias("_b"))
    return one.join(base, ["dimension", "value"]).select("variant", "dimension", "value", *(r6(F.col(k)).alias(k) for k in ("credit", "dx", "le1", "worst")), r6(40 * (F.col("credit") - F.col("_b"))).alias("points"))


@Q.add("w06_first_n_per_class", "select pair_id, ok from (select pair_id, ok, row_number() over (partition by ok order by pair_id) as i from (select pair_id, score>=0.5 as ok from v1)) where i<=50", "v1")
def w06(v):
    rows = v.select("pair_id", (F.col("score") >= 0.5).alias("ok"))
    return rows.withColumn("i", F.row_number().over(Window.partitionBy("ok").orderBy("pair_id"))).filter("i <= 50").drop("i")


@Q.add("w05_monotonic_levels", "with m as (select architecture, severity, avg(score) as s from v1 where gt_found=1 group by 1,2), k as (select architecture, s>lag(s) over (partition by architecture order by severity) as up from m) select architecture, bool_and(coalesce(up,true)) as rising from k group by 1", "v1")
def w05(v):
    from ..operators.aggregate import strictly_rising

    m = v.filter("gt_found = 1").groupBy("architecture", "severity").agg(F.avg("score").alias("s"))
    return strictly_rising(m, ["architecture"], "severity", "s")


@Q.add("e01_registry_of_rules", "select 'zncc' as rule, round(avg(zncc),6) as mean from v1 union all select 'min', round(avg(least(score,zncc)),6) from v1 union all select 'root', round(avg(sqrt(greatest(score,0)*greatest(zncc,0))),6) from v1", "v1")
def e01(v):
    stats = c.statistics()
    one = v.agg(*(F.avg(stats[k]).alias(k) for k in ("zncc", "min", "root")))
    return one.select(c.stacked({k: F.col(k) for k in ("zncc", "min", "root")}, "rule", "mean")).withColumn("mean", r6(F.col("mean")))


@Q.add("e04_fallback_chain", "select pair_id, round(coalesce(case when c%3<>0 and score>=0.6 then x end, case when zncc>=0.3 then gt_x end, 0.0),6) as x, case when c%3<>0 and score>=0.6 then 'primary' when zncc>=0.3 then 'secondary' else 'declined' end as note from v1", "v1")
def e04(v):
    answer = lambda ok, x, name: F.when(ok, F.struct(F.col(x).alias("x"), F.lit(name).alias("note")))
    first = answer((F.col("c") % 3 != 0) & (F.col("score") >= 0.6), "x", "primary")
    second = answer(F.col("zncc") >= 0.3, "gt_x", "secondary")
    out = F.coalesce(first, second, F.struct(F.lit(0.0).alias("x"), F.lit("declined").alias("note")))
    return v.select("pair_id", r6(out["x"]).alias("x"), out["note"].alias("note"))
