"""Queries of aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import aggregate as a
from ..operators import score as s
from ..sources.io import stored
from .fixtures import Queries
from .q_columns import LOC, r6
from .q_score import G

Q = Queries()
E = f"e as (select *, {LOC} as err from v1)"
ACC = ", ".join(f"round(avg(case when err<={t} then 1.0::double else 0 end),6) as acc{t}" for t in (1, 2, 5, 10))
SUMMARY = f"count(*) as n, round(median(err),6) as median, round(avg(err),6) as mean, round(quantile_cont(err,0.9),6) as p90, round(quantile_cont(err,0.99),6) as p99, {ACC}"


def rounded(df, keys, places=6):
    return df.select(*(F.round(k, places).alias(k) if k not in keys and df.schema[k].dataType.simpleString() == "double" else F.col(k) for k in df.columns))


@Q.add("a01_summarize", f"with {E} select grp, {SUMMARY} from e where err is not null group by 1", "v1")
def a01(v):
    return rounded(a.summarize(v.withColumn("err", c.location_error()), ["grp"]), ["grp"])


BAND = "case when err<=1 then '<=1' when err<=2 then '1-2' when err<=3 then '2-3' when err<=5 then '3-5' else '>5' end"


@Q.add("a07_error_bands", f"with {E} select grp, {BAND} as band, count(*) as n, round((count(*)*1.0/sum(count(*)) over (partition by grp))::double,6) as share from e where err is not null group by 1,2", "v1")
def a07(v):
    rows = v.withColumn("err", c.location_error()).filter("err is not null").groupBy("grp", a.error_band("err").alias("band")).agg(F.count("*").alias("n"))
    return rows.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("grp"))))


BREAK = "select '{k}' as dimension, cast({k} as varchar) as value, count(*) as n, count_if(score<0.5)::bigint as declined, round(avg(case when score>=0.5 then rl else 0 end),6) as credit, round(avg(case when err<=1 then 1.0::double else 0 end),6) as le1, count_if(err>5)::bigint as gt5, round(median(err),6) as median, round(median(score),6) as median_score from g where gt_found=1 group by {k}"
ABSENT = "select 'absent by severity' as dimension, cast(severity as varchar) as value, count(*) as n, count_if(score<0.5)::bigint as declined, null::double as credit, null::double as le1, 0::bigint as gt5, null::double as median, round(median(score),6) as median_score from g where gt_found=0 group by severity"


@Q.add("a08_breakdowns", f"with {G} " + " union all ".join([*(BREAK.replace("{k}", k) for k in ("grp", "severity", "architecture")), ABSENT]), "v1")
def a08(v):
    rows = s.measured(v).filter("grp in ('A','B','C')")
    there = F.col("gt_found") == 1
    here = rows.withColumns({n: F.when(there, F.col(n)) for n in ("err", "raw_loc")})
    # one reading: a present row stands under three dimensions, an absent one under its own
    long = a.each_alone(here, {"grp": there, "severity": there, "architecture": there, "absent by severity": ~there}, {"absent by severity": "severity"})
    said, keys = F.col("score") >= 0.5, ["dimension", "value"]
    credit, near = F.when(said, F.col("raw_loc")).otherwise(F.when(F.col("raw_loc").isNotNull(), 0.0)), F.when(F.col("err").isNotNull(), F.col("err") <= 1)
    plain = [F.count("*").alias("n"), F.count_if(~said).alias("declined"), r6(F.avg(credit)).alias("credit"), r6(a.share(near)).alias("le1"), F.count_if(F.col("err") > 5).alias("gt5")]
    return rounded(a.selected(long, keys, {"median": ("err", 0.5), "median_score": ("score", 0.5)}, plain), keys)


@Q.add("a09_set_severity_matrix", f"with {E} select grp, severity, count(*) as n, round(avg(case when err<=5 then 1.0::double else 0 end),6) as acc5 from e where err is not null group by rollup(grp, severity)", "v1")
def a09(v):
    return v.withColumn("err", c.location_error()).filter("err is not null").rollup("grp", "severity").agg(F.count("*").alias("n"), r6(a.share(F.col("err") <= 5)).alias("acc5"))


VARS = ("score", "zncc", "peak_ratio", "pose_peak", "secs")
EFFECT = " union all ".join(f"select '{x}' as variable, {x} as x, f from y" for x in VARS)


@Q.add("a10_effect_sizes", f"with {E}, y as (select *, case when err>5 then 1 else 0 end as f from e where err is not null), l as ({EFFECT}), m as (select variable, avg(x) filter (where f=0) as m0, avg(x) filter (where f=1) as m1, var_samp(x) filter (where f=0) as v0, var_samp(x) filter (where f=1) as v1_, count(x) filter (where f=0) as n0, count(x) filter (where f=1) as n1 from l group by 1) select variable, round((m1-m0)/sqrt(((n0-1)*v0+(n1-1)*v1_)/(n0+n1-2)),5) as d, n1 as n_fail, n0 as n_ok from m", "v1")
def a10(v):
    rows = v.withColumn("err", c.location_error()).filter("err is not null").withColumn("f", (F.col("err") > 5).cast("int"))
    return rounded(a.cohens_d(rows, VARS, "f"), ["variable"], 5)


@Q.add("t02_effects_by_size", f"with {E}, y as (select *, case when err>5 then 1 else 0 end as f from e where err is not null), l as ({EFFECT}), m as (select variable, (avg(x) filter (where f=1)-avg(x) filter (where f=0))/sqrt((((count(x) filter (where f=0))-1)*(var_samp(x) filter (where f=0))+((count(x) filter (where f=1))-1)*(var_samp(x) filter (where f=1)))/(count(x)-2)) as d from l group by 1) select variable, row_number() over (order by coalesce(abs(round(d,5)),0) desc, variable) as place from m", "v1")
def t02(v):
    return a10(v).select("variable", F.row_number().over(Window.orderBy(F.desc(F.coalesce(F.abs("d"), F.lit(0.0))), "variable")).cast("long").alias("place"))


@Q.add("a11_severity_medians", f"with {E}, cr as (select *, case when err<=1 then 1.0::double when err<=2 then 0.8 when err<=3 then 0.6 when err<=5 then 0.4 else 0 end as credit from e where err is not null), m as (select grp, severity, median(err) as med from cr group by 1,2), k as (select grp, med > lag(med) over (partition by grp order by severity) as up from m), t as (select grp, bool_and(coalesce(up,true)) as rising from k group by 1) select cr.grp, round(avg(credit),6) as credit, round(median(err),6) as median, any_value(rising) as rising from cr join t on t.grp=cr.grp group by 1", "v1")
def a11(v):
    rows = v.withColumn("err", c.location_error()).filter("err is not null")
    # a row stands for its group and for its level of the group
    both = rows.withColumn("level", F.explode(F.array(F.lit(None).cast("int"), F.col("severity").cast("int"))))
    one = stored(a.selected(both, ["grp", "level"], {"median": ("err", 0.5)}, [F.avg(c.tier("err", c.LOCATION_TIERS)).alias("credit")]))
    rising = a.strictly_rising(one.filter("level is not null"), ["grp"], "level", "median")
    return rounded(a.joined(one.filter("level is null").drop("level"), rising, ["grp"]), ["grp"])


@Q.add("a12_score_range_by_presence", "select gt_found, min(score) as lo, max(score) as hi, bool_and(case when gt_found=0 then grp='C' else grp<>'C' end) as family_ok from v1 group by 1", "v1")
def a12(v):
    return v.groupBy("gt_found").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.bool_and(F.when(F.col("gt_found") == 0, F.col("grp") == "C").otherwise(F.col("grp") != "C")).alias("family_ok"))


NR = "min(case when upto > least(floor({p}*total), total-1) then secs end)"


@Q.add("a13_latency", f"with q as (select grp, secs, sum(count(*)) over (partition by grp order by secs) as upto, sum(count(*)) over (partition by grp) as total from v1 group by 1,2), n as (select grp, {NR.format(p=0.5)} as nr50, {NR.format(p=0.9)} as nr90 from q group by 1) select v1.grp, round(median(secs),6) as median, round(quantile_cont(secs,0.9),6) as p90, max(secs) as top, count_if(secs>1.5)::bigint as slow, any_value(nr50) as nr50, any_value(nr90) as nr90 from v1 join n on v1.grp=n.grp group by 1", "v1")
def a13(v):
    plain = [F.max("secs").alias("top"), F.count_if(F.col("secs") > 1.5).alias("slow")]
    wanted = {"median": ("secs", 0.5), "p90": ("secs", 0.9), "nr50": ("secs", 0.5), "nr90": ("secs", 0.9)}
    one = a.selected(v, ["grp"], wanted, plain, nearest=["nr50", "nr90"])
    return one.withColumns({k: r6(F.col(k)) for k in ("median", "p90")})


@Q.add("a14_run_health", "select architecture, count(*) as n, count_if(f)::bigint as errors, count_if(score>=0.8)::bigint as found, concat_ws(' | ', case when count_if(f)*1.0/count(*)>=0.2 then 'errors' end, case when count_if(score>=0.8)*1.0/count(*)<0.3 then 'few found' end) as reasons from (select architecture, score, (c%29=0 or (architecture='1-URGENT' and c%4=0)) as f from v1) group by 1", "v1")
def a14(v):
    rows = v.withColumn("f", F.expr("cast(c%29=0 or (architecture='1-URGENT' and c%4=0) as int)")).withColumn("said", (F.col("score") >= 0.8).cast("int"))
    return a.health(rows, ["architecture"], "f", "said")


@Q.add("a15_value_counts", "select event_type, count(*) as n from events group by 1", "events")
def a15(e):
    return e.groupBy("event_type").agg(F.count("*").alias("n"))


@Q.add("a23_binomial_error", f"with {E} select grp, round(p,6) as acc, round(sqrt(p*(1-p)/n),6) as se from (select grp, avg(case when err<=5 then 1.0::double else 0 end) as p, count(*) as n from e where err is not null group by 1)", "v1")
def a23(v):
    p = v.withColumn("err", c.location_error()).filter("err is not null").groupBy("grp").agg(a.share(F.col("err") <= 5).alias("p"), F.count("*").alias("n"))
    return p.select("grp", r6(F.col("p")).alias("acc"), r6(F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))).alias("se"))


@Q.add("a24_composition", "select architecture, count(*) as n, round(avg(abs(x-gt_x)),6) as mean_shift, round(quantile_cont(abs(x-gt_x),0.95),6) as p95_shift, max(abs(x-gt_x)) as max_shift, round(stddev_samp(gt_x),4) as spread, (count(*)-count(distinct pair_id))::bigint as duplicates, count_if(not(gt_x between 100 and 899))::bigint as outside from v1 group by 1", "v1")
def a24(v):
    rows = v.withColumn("shift", F.abs(F.col("x") - F.col("gt_x")))
    plain = [F.count("*").alias("n"), r6(F.avg("shift")).alias("mean_shift"), F.max("shift").alias("max_shift"), F.round(F.stddev_samp("gt_x"), 4).alias("spread"), F.count_if(~F.col("gt_x").between(100, 899)).alias("outside")]
    one = a.selected(rows, ["architecture"], {"p95_shift": ("shift", 0.95)}, plain).withColumn("p95_shift", r6(F.col("p95_shift")))
    # ids of the whole table are told apart by a count of their own: a distinct count beside other aggregates would expand every row
    ids = v.groupBy("architecture", "pair_id").agg(F.count("*").alias("_n")).groupBy("architecture").agg(F.sum(F.col("_n") - 1).alias("duplicates"))
    return a.joined(one, ids, ["architecture"])


ERF = "(1-(tt*(0.254829592+tt*(-0.284496736+tt*(1.421413741+tt*(-1.453152027+tt*1.061405429)))))*exp(-z*z))"


@Q.add("a25_label_noise_floor", f"select severity, round(avg(abs(mu)),6) as shear, round(avg(0.25*sqrt(2/3.141592653589793)*exp(-z*z)+abs(mu)*{ERF}),6) as noise, round(avg(sqrt(ox*ox+oy*oy)),6) as barrel, round(avg(case when abs(mu)>0.4 then 1.0::double else 0 end),6) as beyond from (select *, 1/(1+0.3275911*z) as tt from (select severity, (gt_y-500)/1000.0e0 as mu, abs((gt_y-500)/1000.0e0)/0.25/sqrt(2.0e0) as z, (gt_x-500)*0.00000002*((gt_x-500)*(gt_x-500)+(gt_y-500)*(gt_y-500)) as ox, (gt_y-500)*0.00000002*((gt_x-500)*(gt_x-500)+(gt_y-500)*(gt_y-500)) as oy from v1)) group by 1", "v1")
def a25(v):
    """Shear, expected distance with a jitter of 0.25 on it, barrel offset, and the share of shears beyond 0.4."""
    mu = (F.col("gt_y") - 500) / 1000.0
    x, y = F.col("gt_x") - 500, F.col("gt_y") - 500
    barrel = 2e-8 * (x * x + y * y) * F.sqrt(x * x + y * y)
    one = v.groupBy("severity").agg(F.avg(F.abs(mu)).alias("shear"), F.avg(a.folded_normal_mean(mu, 0.25)).alias("noise"), F.avg(barrel).alias("barrel"), a.share(F.abs(mu) > 0.4).alias("beyond"))
    return rounded(one, ["severity"])


FIND = "f as (select pair_id, architecture, unnest([{'s':case when failed=1 then 'FAIL' else 'OK' end,'r':'raised'},{'s':case when score<0.3 then 'WARN' else 'OK' end,'r':'low score'},{'s':case when secs>1.9 then 'WARN' else 'OK' end,'r':'slow'}]) as u from v1)"


@Q.add("a26_status_rollup", f"with {FIND} select pair_id, case max(case u.s when 'FAIL' then 2 when 'WARN' then 1 else 0 end) when 2 then 'FAIL' when 1 then 'WARN' else 'OK' end as status, coalesce(string_agg(distinct u.r, ' | ' order by u.r) filter (where u.s<>'OK'),'') as reasons from f group by 1", "v1")
def a26(v):
    rules = {"raised": F.when(F.col("failed") == 1, "FAIL"), "low score": F.when(F.col("score") < 0.3, "WARN"), "slow": F.when(F.col("secs") > 1.9, "WARN")}
    long = v.select("pair_id", F.inline(F.array(*(F.struct(F.lit(k).alias("reason"), F.coalesce(e, F.lit("OK")).alias("status")) for k, e in rules.items()))))
    return a.status_rollup(long, "pair_id")


@Q.add("a27_composition_rules", "select x.grp, x.least, coalesce(g.n,0) as n, coalesce(g.n,0)>=x.least as enough, coalesce(g.present,0)::bigint as present, coalesce(g.absent,0)::bigint as absent, case when x.grp='C' then coalesce(present,0)=0 else coalesce(g.absent,0)=0 end as presence_ok, coalesce(g.k,0)=5 as all_presets, coalesce(g.lo<=8.5 and g.hi>=11.5, false) as scale_ends, coalesce(g.s0 and g.s4, false) as level_ends from (select unnest(['A','B','C','D','E']) as grp, unnest([100,100,100,5000,1]) as least) x left join (select grp, count(*) as n, count_if(gt_found=1) as present, count_if(gt_found=0) as absent, count(distinct architecture) as k, min(gt_scale) as lo, max(gt_scale) as hi, bool_or(severity=0) as s0, bool_or(severity=4) as s4 from v1 group by 1) g on g.grp=x.grp", "v1")
def a27(v):
    """Counts, presence, presets, and whether both ends of the scales and levels occur, against what is expected."""
    want = v.sparkSession.createDataFrame([("A", 100), ("B", 100), ("C", 100), ("D", 5000), ("E", 1)], "grp string, least int")
    have = v.groupBy("grp").agg(
        F.count("*").alias("_n"), F.count_if(F.col("gt_found") == 1).alias("_present"), F.count_if(F.col("gt_found") == 0).alias("_absent"), F.count_distinct("architecture").alias("_k"),
        F.min("gt_scale").alias("_lo"), F.max("gt_scale").alias("_hi"), F.bool_or(F.col("severity") == 0).alias("_s0"), F.bool_or(F.col("severity") == 4).alias("_s4"),
    )
    n, present, absent, k = (F.coalesce(f"_{x}", F.lit(0)).cast("long") for x in ("n", "present", "absent", "k"))
    none = lambda e: F.coalesce(e, F.lit(False))
    return want.join(have, "grp", "left").select(
        "grp", "least", n.alias("n"), (n >= F.col("least")).alias("enough"), present.alias("present"), absent.alias("absent"), F.when(F.col("grp") == "C", present == 0).otherwise(absent == 0).alias("presence_ok"),
        (k == 5).alias("all_presets"), none((F.col("_lo") <= 8.5) & (F.col("_hi") >= 11.5)).alias("scale_ends"), none(F.col("_s0") & F.col("_s4")).alias("level_ends"),
    )


@Q.add("a28_residual_before_after", "with j as (select a.severity, abs(a.x-a.gt_x) as before, abs(b.x-b.gt_x) as after from v1 a join v2 b using (pair_id) where a.score>=0.7) select severity, count(*) as n, round(avg(before),6) as before, round(avg(after),6) as after from j group by 1", "v1 v2")
def a28(v, w):
    far = lambda d, name: d.select("pair_id", F.abs(F.col("x") - F.col("gt_x")).alias(name))
    locked = v.filter("score >= 0.7").select("pair_id", "severity")
    return locked.join(far(v, "before"), "pair_id").join(far(w, "after"), "pair_id").groupBy("severity").agg(F.count("*").alias("n"), r6(F.avg("before")).alias("before"), r6(F.avg("after")).alias("after"))


@Q.add("a29_optimum_to_label_gap", f"with {E} select severity, round(median(err),6) as gap, round(median(err)/0.25,6) as in_jitter, count(*) as n from e where err is not null and score>=0.5 group by 1", "v1")
def a29(v):
    rows = v.withColumn("err", c.location_error()).filter("err is not null and score >= 0.5")
    one = a.selected(rows, ["severity"], {"gap": ("err", 0.5)}, [F.count("*").alias("n")])
    return rounded(one.withColumn("in_jitter", F.col("gap") / 0.25), ["severity"])


RUNS = f"u as (select 'a' as run, *, {LOC} as err from v1 union all select 'b', *, {LOC} from v2)"


@Q.add("a30_leaderboard", f"with {RUNS} select run, count_if(err<=5)::bigint as hits, {ACC}, row_number() over (order by avg(case when err<=5 then 1.0 else 0 end) desc, run) as place from u where err is not null group by 1", "v1 v2")
def a30(v, w):
    both = v.withColumn("run", F.lit("a")).union(w.withColumn("run", F.lit("b"))).withColumn("err", c.location_error())
    one = a.summarize(both, ["run"]).drop("median", "mean", "p90", "p99", "n").join(both.groupBy("run").agg(F.count_if(F.col("err") <= 5).alias("hits")), "run")
    one = one.withColumn("place", F.row_number().over(Window.orderBy(F.desc("acc5"), "run")).cast("long"))
    return rounded(one, ["run"])


BATCHES = "b as (select cast(c%4 as int) as epoch, cast(pair_id%50 as int) as batch, case when c%4=3 then 0 else cast(c%4 as int) end as shown, pair_id%50 as p from v1)"


@Q.add("a31_repeat_batches", f"with {BATCHES}, d as (select epoch, batch, md5(string_agg(distinct (shown||'|'||p), ',')) as dg from b group by 1,2) select x.epoch as a, y.epoch as b, bool_and(x.dg=y.dg) as frozen from d x join d y on x.batch=y.batch and x.epoch<y.epoch group by 1,2", "v1")
def a31(v):
    rows = v.select((F.col("c") % 4).cast("int").alias("epoch"), (F.col("pair_id") % 50).cast("int").alias("batch"), F.when(F.col("c") % 4 == 3, 0).otherwise((F.col("c") % 4).cast("int")).alias("shown")).distinct()
    d = rows.groupBy("epoch", "batch").agg(a.digest(["shown", "batch"]).alias("dg"))
    x, y = d.select(F.col("epoch").alias("a"), "batch", F.col("dg").alias("da")), d.select(F.col("epoch").alias("b"), "batch", F.col("dg").alias("db"))
    return x.join(y, "batch").filter("a < b").groupBy("a", "b").agg(F.bool_and(F.col("da") == F.col("db")).alias("frozen"))


@Q.add("a32_cohort_gap", f"with {E}, m as (select avg(err) filter (where pair_id%3=0) as seen, avg(err) filter (where pair_id%3<>0) as unseen from e) select round(seen,6) as seen, round(unseen,6) as unseen, round((unseen-seen)/seen,6) as gap, case when (unseen-seen)/seen>0.25 then 'overfit' when (unseen-seen)/seen>0.1 then 'watch' else 'ok' end as verdict from m", "v1")
def a32(v):
    rows = v.withColumn("err", c.location_error())
    m = rows.agg(F.avg(F.when(F.col("pair_id") % 3 == 0, F.col("err"))).alias("seen"), F.avg(F.when(F.col("pair_id") % 3 != 0, F.col("err"))).alias("unseen"))
    gap = (F.col("unseen") - F.col("seen")) / F.col("seen")
    return m.select(r6(F.col("seen")).alias("seen"), r6(F.col("unseen")).alias("unseen"), r6(gap).alias("gap"), F.when(gap > 0.25, "overfit").when(gap > 0.1, "watch").otherwise("ok").alias("verdict"))


@Q.add("a34_history_shortlist", f"with {E}, h as (select cast(pair_id%20 as int) as epoch, round(avg(case when err<=5 then 1.0::double else 0 end),6) as acc5, round(median(err),6) as med from e where err is not null group by 1), r as (select *, row_number() over (order by (1-acc5)*1000+med, epoch) as k, max(epoch) over () as last from h) select epoch, acc5, med from r where k<=3 or epoch=last", "v1")
def a34(v):
    rows = v.withColumn("err", c.location_error()).filter("err is not null")
    rows = rows.withColumn("epoch", (F.col("pair_id") % 20).cast("int"))
    one = a.selected(rows, ["epoch"], {"med": ("err", 0.5)}, [a.share(F.col("err") <= 5).alias("acc5")])
    one = rounded(one, ["epoch"])
    # the history as one JSON text, as a training run leaves it; one row for each epoch
    text = one.agg(F.to_json(F.sort_array(F.collect_list(F.struct("epoch", "acc5", "med")))).alias("history"))
    h = text.select(F.inline(F.from_json("history", "array<struct<epoch:int,acc5:double,med:double>>")))
    every = Window.partitionBy(F.lit(0))
    ranked = h.withColumns({"k": F.row_number().over(every.orderBy((1 - F.col("acc5")) * 1000 + F.col("med"), "epoch")), "last": F.max("epoch").over(every)})
    return ranked.filter("k <= 3 or epoch = last").select("epoch", "acc5", "med")


ARM = ", ".join(f"round(avg(case when err<={t} then 1.0::double else 0 end),6) as le{t}" for t in (1, 2, 3, 5))


BEST3 = "k as (select pair_id, zncc, row_number() over (partition by pair_id order by zncc desc, hypothesis_index) as i from v3), b as (select pair_id, max(zncc) filter (where i=1) as best, max(zncc) filter (where i=2) as next from k group by 1)"


@Q.add("a35_arm_table", f"with {BEST3}, {E} select architecture, round(avg(err),6) as mean, round(median(err),6) as median, {ARM}, round(median(score),6) as score, round(median(best-next),6) as margin from e left join b on b.pair_id=e.pair_id where err is not null group by 1", "v1 v3")
def a35(v, w):
    """The margin is the best candidate's score less its best competitor's; pairs with one candidate have none."""
    top = w.groupBy("pair_id").agg(F.slice(F.reverse(F.array_sort(F.collect_list("zncc"))), 1, 2).alias("top"))
    margin = top.select("pair_id", (F.get("top", F.lit(0)) - F.get("top", F.lit(1))).alias("margin"))
    rows = v.withColumn("err", c.location_error()).filter("err is not null").join(margin, "pair_id", "left")
    plain = [F.avg("err").alias("mean"), *(a.share(F.col("err") <= t).alias(f"le{t}") for t in (1, 2, 3, 5))]
    return rounded(a.selected(rows, ["architecture"], {"median": ("err", 0.5), "score": ("score", 0.5), "margin": ("margin", 0.5)}, plain), ["architecture"])


@Q.add("a36_gross_miss_gate", f"with {E} select architecture, count_if(err>5)::bigint as misses, count_if(err>10)::bigint as gross, count_if(err>5)=0 as all_within, round(median(err),6) as median from e where err is not null group by 1", "v1")
def a36(v):
    rows = v.withColumn("err", c.location_error()).filter("err is not null")
    plain = [F.count_if(F.col("err") > 5).alias("misses"), F.count_if(F.col("err") > 10).alias("gross"), (F.count_if(F.col("err") > 5) == 0).alias("all_within")]
    return rounded(a.selected(rows, ["architecture"], {"median": ("err", 0.5)}, plain), ["architecture"])


@Q.add("a37_shard_counts", "with a as (select source, count(*) as claimed from claimed where source<>'src3' group by 1), b as (select source, count(*) as present from present_files where source<>'src5' group by 1) select coalesce(a.source,b.source) as source, claimed, present, case when claimed is null then 'no manifest' when present is null then 'empty' when claimed<>present then 'count differs' else 'ok' end as reason from a full join b on a.source=b.source", "claimed present_files")
def a37(claimed, there):
    x = claimed.filter("source <> 'src3'").groupBy("source").agg(F.count("*").alias("claimed"))
    y = there.filter("source <> 'src5'").groupBy("source").agg(F.count("*").alias("present"))
    reason = F.when(F.col("claimed").isNull(), "no manifest").when(F.col("present").isNull(), "empty").when(F.col("claimed") != F.col("present"), "count differs").otherwise("ok")
    return x.join(y, "source", "full").select("source", "claimed", "present", reason.alias("reason"))
