"""Queries of joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins as j
from .fixtures import Queries
from .q_columns import r6

Q = Queries()


@Q.add("j01_scoring_join", "select a.pair_id, a.gt_x, a.severity, b.x, b.score from v1 a left join v2 b using (pair_id)", "v1 v2")
def j01(v, w):
    return j.scoring_join(v.select("pair_id", "gt_x"), v.select("pair_id", "severity"), w.select("pair_id", "x", "score"))


@Q.add("j02_lenient_join", "select a.pair_id, case when b.c%13=0 then 0.0 else b.x end as x, case when b.c%7=0 then -1 else cast(b.score>=0.5 as int) end as found from v1 a join v2 b using (pair_id) where b.c%3<>0", "v1 v2")
def j02(v, w):
    run = w.filter("c % 3 <> 0").select("pair_id", F.when(F.col("c") % 13 != 0, F.col("x")).alias("x"), F.when(F.col("c") % 7 != 0, (F.col("score") >= 0.5).cast("int")).alias("found"))
    return j.lenient_join(v.select("pair_id"), run)


@Q.add("j03_enrichment", "select a.pair_id, a.score, b.zncc, b.severity from v1 a left join (select * from v2 where c%2=0) b using (pair_id)", "v1 v2")
def j03(v, w):
    return j.enriched(v.select("pair_id", "score"), w.filter("c % 2 = 0"), ["zncc", "severity", "score", "no_such"])


@Q.add("j04_variant_fan_out", "select name, count(*) as n, round(avg(score*gain),6) as mean from v1, (select unnest(['a','b','c']) as name, unnest([0.5,1.0,2.0]::double[]) as gain) group by 1", "v1")
def j04(v):
    variants = v.sparkSession.createDataFrame([("a", 0.5), ("b", 1.0), ("c", 2.0)], "name string, gain double")
    return j.fan_out(v, variants).groupBy("name").agg(F.count("*").alias("n"), r6(F.avg(F.col("score") * F.col("gain"))).alias("mean"))


@Q.add("j05_run_alignment", "select count(*) filter (where a.pair_id is not null and b.pair_id is not null) as both, count(*) filter (where b.pair_id is null) as only_left, count(*) filter (where a.pair_id is null) as only_right, 0::bigint as repeated from (select pair_id from v1 where pair_id%5<>0) a full join (select pair_id from v2 where pair_id%7<>0) b using (pair_id)", "v1 v2")
def j05(v, w):
    return j.one_sided(v.filter("pair_id % 5 <> 0"), w.filter("pair_id % 7 <> 0"))


REC = "select a.doc_id, 'missing' as finding from claimed a where not exists (select 1 from present_files b where a.doc_id=b.doc_id) union all select doc_id, 'unclaimed' from present_files where doc_id not in (select doc_id from claimed) union all select a.doc_id, 'digest' from claimed a join present_files b using (doc_id) where a.sha<>b.sha"


@Q.add("j06_reconciliation", REC, "claimed present_files")
def j06(x, y):
    return j.reconciled(x, y, "doc_id", "sha")


@Q.add("j07_file_audit", "select (select count(*) from claimed where doc_id not in (select doc_id from present_files)) as missing, (select count(*) from present_files where doc_id not in (select doc_id from claimed)) as orphans, (select count(*) from (select sha from claimed group by 1 having count(*)>1)) as repeated, (select count(distinct sha) from present_files) as contents", "claimed present_files")
def j07(x, y):
    found = j.reconciled(x, y, "doc_id", "sha").agg(F.count_if(F.col("finding") == "missing").alias("missing"), F.count_if(F.col("finding") == "unclaimed").alias("orphans"))
    again = x.groupBy("sha").count().filter("count > 1").agg(F.count("*").alias("repeated"))
    return found.crossJoin(again).crossJoin(y.agg(F.count_distinct("sha").alias("contents")))


@Q.add("j08_target_selection", "with t as (select pair_id, row_number() over (partition by score>=0.5 order by pair_id) as i from v1) select v3.pair_id, hypothesis_index::bigint as hypothesis_index from v3 where pair_id in (select pair_id from t where i<=100)", "v1 v3")
def j08(v, w):
    chosen = v.withColumn("i", F.row_number().over(Window.partitionBy(F.col("score") >= 0.5).orderBy("pair_id"))).filter("i <= 100")
    return w.join(chosen, "pair_id", "left_semi").select("pair_id", F.col("hypothesis_index").cast("long").alias("hypothesis_index"))


@Q.add("j11_row_lookup", "with rs as (select cast(p_partkey%1000 as int) as r, min(p_size)/10.0e0 as shift from part group by 1) select pair_id, coalesce(shift,0) as shift from v1 left join rs on rs.r=cast(round_even(gt_y,0) as int)", "v1 part")
def j11(v, part):
    shifts = part.groupBy((F.col("p_partkey") % 1000).cast("int").alias("r")).agg((F.min("p_size") / 10.0).alias("shift"))
    return v.select("pair_id", F.bround("gt_y", 0).cast("int").alias("r")).join(shifts, "r", "left").select("pair_id", F.coalesce("shift", F.lit(0.0)).alias("shift"))


@Q.add("j13_composite_ids", "select grp || ':' || pair_id as id, grp, pair_id, severity from v1", "v1")
def j13(v):
    ids = v.select(F.concat_ws(":", "grp", "pair_id").alias("id"))
    at = F.split("id", ":", 2)
    back = ids.select("id", at[0].alias("grp"), at[1].cast(v.schema["pair_id"].dataType).alias("pair_id"))
    return back.join(v.select("grp", "pair_id", "severity"), ["grp", "pair_id"]).select("id", "grp", "pair_id", "severity")


@Q.add("u01_union_by_name", "select pair_id, score, cast(null as double) as zncc from v1 where grp='A' union all select pair_id, null, zncc from v2 where grp='B'", "v1 v2")
def u01(v, w):
    return v.filter("grp = 'A'").select("pair_id", "score").unionByName(w.filter("grp = 'B'").select("zncc", "pair_id"), allowMissingColumns=True)


@Q.add("u02_difference", "select o_custkey from (select o_custkey from orders where o_orderstatus='F' except all select c_custkey from customer where c_custkey%2=0)", "orders customer")
def u02(o, c):
    return o.filter("o_orderstatus = 'F'").select("o_custkey").exceptAll(c.filter("c_custkey % 2 = 0").select("c_custkey"))


@Q.add("u03_common", "select pair_id from v1 where score>=0.5 intersect select pair_id from v2 where score>=0.5", "v1 v2")
def u03(v, w):
    return v.filter("score >= 0.5").select("pair_id").intersect(w.filter("score >= 0.5").select("pair_id"))


@Q.add("u04_holdout", "select pair_id from v1 where pair_id not in (select pair_id from v1 where c%4=0)", "v1")
def u04(v):
    return v.select("pair_id").join(v.filter("c % 4 = 0").select("pair_id"), "pair_id", "left_anti")


CLIP = "select distinct layer, round(greatest(x0,{a})-{a},1) as u0, round(least(x1,{b})-{a},1) as u1, round(greatest(y0,{a})-{a},1) as w0, round(least(y1,{b})-{a},1) as w1 from v4 where x1>{a} and x0<{b} and y1>{a} and y0<{b}"


@Q.add("u05_clipped_overlap", f"with a as ({CLIP.format(a=100, b=600)}), b as ({CLIP.format(a=100, b=500)}) select count(*) as n, count_if(exists(select 1 from b where b.layer=a.layer and b.u0=a.u0 and b.u1=a.u1 and b.w0=a.w0 and b.w1=a.w1))::bigint as both from a", "v4")
def u05(v):
    from ..operators.spatial import clipped

    a, b = clipped(v, 100, 600), clipped(v, 100, 500)
    return a.agg(F.count("*").alias("n")).crossJoin(a.join(b, a.columns, "left_semi").agg(F.count("*").alias("both")))


@Q.add("t01_input_order", "select pair_id, row_number() over (order by pair_id)-1 as ordinal from v1 where score>=0.5", "v1")
def t01(v):
    from ..sources.io import with_ordinal

    return with_ordinal(v.filter("score >= 0.5").select("pair_id"), "pair_id")


@Q.add("t04_stratum_union", "select pair_id, grp, i as ordinal from (select pair_id, grp, row_number() over (order by pair_id)-1 as i from v1) where grp in ('A','C')", "v1")
def t04(v):
    from ..sources.io import with_ordinal

    rows = with_ordinal(v.select("pair_id", "grp"), "pair_id")
    return rows.filter("grp = 'A'").union(rows.filter("grp = 'C'")).orderBy("ordinal")
