"""Queries of readers, writers and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..sources import io
from .fixtures import Queries
from .q_columns import r6

Q = Queries()


@Q.add("s03_key_faults", "select count(*) filter (where k is null or trim(k)='') as empty, (select count(*) from (select k from (select case when doc_id%50=0 then '' else source||(doc_id%400) end as k from documents) where k<>'' group by 1 having count(*)>1)) as repeated from (select case when doc_id%50=0 then '' else source||(doc_id%400) end as k from documents)", "documents")
def s03(d):
    rows = d.select(F.when(F.col("doc_id") % 50 == 0, "").otherwise(F.concat("source", F.col("doc_id") % 400)).alias("pair_id"))
    return io.key_faults(rows)


@Q.add("s04_blind_view", "select cast(doc_id as varchar) as pair_id, case when doc_id%3<>0 and doc_id%4<>0 then 'r'||doc_id end as reference_sem_path, case when doc_id%3<>0 and doc_id%4<>0 then 'p'||doc_id end as params_json_path from documents", "documents")
def s04(d):
    i = F.col("doc_id").cast("string")
    rows = d.select(i.alias("pair_id"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("r"), i)).alias("reference_sem_path"), F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("p"), i)).otherwise(" ").alias("params_json_path"))
    return io.withheld(rows)


PATHS = "case doc_id%5 when 0 then '/abs/'||doc_id when 1 then 'C:\\x'||doc_id when 2 then '\\\\host\\'||doc_id when 3 then 'D:/y'||doc_id else 'rel/'||doc_id end"


@Q.add("s05_rooted_paths", f"select doc_id, case when doc_id%5=4 then '/base/rel/'||doc_id else p end as path from (select doc_id, {PATHS} as p from documents)", "documents")
def s05(d):
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    path = F.when(k == 0, F.concat(F.lit("/abs/"), i)).when(k == 1, F.concat(F.lit("C:\\x"), i)).when(k == 2, F.concat(F.lit("\\\\host\\"), i)).when(k == 3, F.concat(F.lit("D:/y"), i)).otherwise(F.concat(F.lit("rel/"), i))
    return d.select("doc_id", c.resolved(path, "/base").alias("path"))


@Q.add("s07_complete_shards", "select doc_id, source from documents where source in (select source from documents group by 1 having count(*)%2=0)", "documents")
def s07(d):
    done = d.groupBy("source").count().filter("count % 2 = 0").select("source")
    return io.complete_only(d.select("doc_id", "source"), done, "source")


@Q.add("s08_shard_merge", "with n as (select source, sum(count(*)) over (order by source) - count(*) as start from documents group by 1) select d.source, (start + row_number() over (partition by d.source order by doc_id) - 1)::bigint as id, row_number() over (partition by d.source order by doc_id) - 1 as shard_id, d.source||'/'||doc_id as path from documents d join n on n.source=d.source", "documents")
def s08(d):
    rows = d.select("source", F.col("doc_id").cast("string").alias("path"), "doc_id")
    return io.merge_shards(rows, "source", "doc_id", ["path"]).select("source", "id", "shard_id", "path")




@Q.add("s09_chunk_merge", "select floor(i/500)::bigint as chunk, count(*) as n, bool_and(pair_id%777<>0) as ok from (select pair_id, row_number() over (order by pair_id)-1 as i from v1) group by 1", "v1")
def s09(v):
    given = io.with_ordinal(v.select("pair_id"), "pair_id")
    back = given.select("ordinal", F.when(F.col("pair_id") % 777 == 0, -1).otherwise(F.col("pair_id")).alias("pair_id"))
    return io.merge_check(given, back, 500).withColumn("chunk", F.col("chunk").cast("long"))


FMT = ", ".join(f"printf('%.4f', case when score>=0.55 then {k} else 0 end) as {k}" for k in ("x", "y", "theta", "scale"))


@Q.add("s10_prediction_sink", f"select pair_id, cast(score>=0.55 as int) as found, printf('%.6f', score) as score, printf('%.4f', case when score>=0.55 then x else 0 end) as x, printf('%.4f', case when score>=0.55 then y else 0 end) as y from v1", "v1")
def s10(v):
    return io.prediction_text(v, 0.55).select("pair_id", "found", "score", "x", "y")


@Q.add("s11_output_contract", "select 'ids' as rule, count_if(pair_id%97=0)::bigint as n from v1 union all select 'found', count_if(pair_id%89=0 and pair_id%97<>0)::bigint from v1 union all select 'numbers', count_if(pair_id%83=0 and pair_id%97<>0)::bigint from v1 union all select 'zeros', count_if(score<0.55 and pair_id%7=0 and pair_id%83<>0 and pair_id%97<>0 and pair_id%89<>0)::bigint from v1 union all select 'repeated', 0", "v1")
def s11(v):
    given = io.with_ordinal(v, "pair_id").select("pair_id", "ordinal", "x", "y", "theta", "scale", "score")
    out = given.join(io.prediction_text(v, 0.55).select("pair_id", "found", *(F.col(k).alias(f"_{k}") for k in ("x", "y", "theta", "scale", "score"))), "pair_id")
    i = F.col("pair_id")
    out = out.filter(i % 97 != 0).select("ordinal", i.cast("string").alias("pair_id"), F.when((F.col("found") == 0) & (i % 7 == 0), "1.5").otherwise(F.col("_x")).alias("x"), F.col("_y").alias("y"), F.col("_theta").alias("theta"), F.col("_scale").alias("scale"), F.when(i % 89 == 0, "maybe").otherwise(F.col("found").cast("string")).alias("found"), F.when(i % 83 == 0, "n/a").otherwise(F.col("_score")).alias("score"))
    return io.contract_faults(given.select("ordinal", i.cast("string").alias("pair_id")), out)


JSON = """'{"schema_version":'||(case when doc_id%7=0 then 2 else 1 end)||(case when doc_id%5=0 then '' else ',"architecture":"x"' end)||',"layer_intensities":{'||(case when doc_id%11=0 then '' when doc_id%3=0 then '"k":20' else '"1":'||(doc_id%300) end)||'}}'"""


@Q.add("s12_params_json", "select doc_id, concat_ws(',', case when doc_id%7=0 then 'version' end, case when doc_id%5=0 then 'architecture' end, case when doc_id%11=0 then 'layers' end, case when doc_id%11<>0 and doc_id%3<>0 and doc_id%300>255 then 'range' end, case when doc_id%11<>0 and doc_id%3=0 then 'keys' end) as faults from documents", "documents")
def s12(d):
    return d.select("doc_id", F.array_join(io.params_faults(F.expr(JSON)), ",").alias("faults"))


@Q.add("s17_truth_overlay", "select a.pair_id, case when b.pair_id is not null then b.gt_x else a.x end as x, a.y from v1 a left join (select pair_id, gt_x from v1 where c%2=0) b using (pair_id)", "v1")
def s17(v):
    truth = v.filter("c % 2 = 0").select("pair_id", F.col("gt_x").alias("x"))
    return io.overlaid(v.select("pair_id", "x", "y"), truth, "pair_id")


@Q.add("s18_blind_export", "select pair_id, '' as reference_sem_path, gt_found as present, case when gt_found=1 then gt_x else 0 end as x, case when gt_found=1 then gt_y else 0 end as y, severity from v1", "v1")
def s18(v):
    rows = v.select("pair_id", F.when(F.col("gt_found") == 1, " True").otherwise("false").alias("present"), F.col("gt_x").alias("x"), F.col("gt_y").alias("y"), F.col("severity"))
    pairs, truth = io.blind_export(rows, ["reference_sem_path"], pose=("x", "y"), meta=("severity",))
    return pairs.join(truth, "pair_id")


@Q.add("s19_alias_coalesce", "select doc_id, coalesce(case when doc_id%3=0 then null else source end, lang, 'none') as name from documents", "documents")
def s19(d):
    rows = d.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("source")).otherwise("  ").alias("first"), F.col("lang").alias("second"))
    return rows.select("doc_id", c.first_filled(["missing", "first", "second"], rows.columns, "none").alias("name"))


@Q.add("s20_ledger_replay", "select doc_id from documents where not (doc_id in (select user_id from (select user_id, arg_max(event_type, event_id) as last from events group by 1) where last='purchase'))", "documents events")
def s20(d, e):
    ledger = e.select(F.col("user_id").alias("doc_id"), F.when(F.col("event_type") == "purchase", "done").otherwise("failed").alias("status"), F.col("event_id").alias("ts"))
    return io.remaining(d.select("doc_id"), ledger, "doc_id")


NAMES = "case doc_id%6 when 0 then 'A_'||(doc_id%40) when 1 then 'test_B_'||(doc_id%30) when 2 then 'E_1' when 3 then 'test_'||doc_id when 4 then 'D_'||(doc_id%9) else 'C_x' end"


@Q.add("s21_shard_keys", f"select case when n like 'test_%' then 'test_'||split_part(n,'_',2)||'_'||lpad(split_part(n,'_',3),4,'0') else 'train_'||split_part(n,'_',1)||'_'||lpad(split_part(n,'_',2),4,'0') end as shard, min(n) as name from (select {NAMES} as n from documents) where regexp_full_match(n,'(test_)?[ABCD]_[0-9]+') group by 1", "documents")
def s21(d):
    return io.shard_keys(d.select(F.expr(NAMES).alias("name")))


@Q.add("s14_report_files", "select grp, count(*) as n, round(avg(score),6) as mean, round(max(score),6) as top from v1 group by 1", "v1")
def s14(v):
    """Rows as JSON lines, metrics as JSON and a report as CSV, written and read back; one row of each for each set."""
    at = io.passing_folder(v.sparkSession, "reports")
    read = v.sparkSession.read
    v.select("pair_id", "grp", "score").write.json(f"{at}/rows")
    rows = read.schema("pair_id long, grp string, score double").json(f"{at}/rows")
    rows.groupBy("grp").agg(F.avg("score").alias("mean")).write.json(f"{at}/metrics")
    rows.groupBy("grp").agg(F.max("score").alias("top")).write.option("header", True).csv(f"{at}/report")
    metrics, report = read.schema("grp string, mean double").json(f"{at}/metrics"), read.schema("grp string, top double").csv(f"{at}/report", header=True)
    return rows.groupBy("grp").agg(F.count("*").alias("n")).join(metrics, "grp").join(report, "grp").select("grp", "n", r6(F.col("mean")).alias("mean"), r6(F.col("top")).alias("top"))


@Q.add("s01_pick_columns", "select o_orderkey as id, o_totalprice as price from orders", "orders")
def s01(o):
    """An exact name but for case and spaces, and the only column with a candidate's first word."""
    names = {"id": io.pick_column(o.columns, [" O_OrderKey", "key"], "id"), "price": io.pick_column(o.columns, ["totalprice_usd"], "price")}
    return o.select(*(F.col(f).alias(n) for n, f in names.items()))


@Q.add("s02_resolved_schema", "select doc_id as pair_id, source as search_path, lang from documents", "documents")
def s02(d):
    names = io.resolve_schema(d.columns, ("pair_id", "search_path", "lang"), {"pair_id": "doc_id", "search_path": "source"})
    return d.select(*(F.col(f).alias(n) for n, f in names.items()))


@Q.add("s13_results_files", "select cast(o_custkey as varchar) as name, count(*) as n, round(sum(round(o_totalprice,2)),2) as total from orders group by 1", "orders")
def s13(o):
    """Files of splits in both layouts, some customers in each file; a split holds the prices of a customer's orders."""
    at = io.passing_folder(o.sparkSession, "results")
    split = o.groupBy("o_custkey").agg(F.collect_list(F.round(F.col("o_totalprice").cast("double"), 2)).alias("errors"))
    split = split.select(F.floor(F.col("o_custkey") / 500).alias("file"), F.struct(F.col("o_custkey").cast("string").alias("name"), "errors").alias("s"))
    lists = split.groupBy("file").agg(F.collect_list("s").alias("splits"))
    whole = F.to_json(F.struct(F.struct(F.lit("x").alias("commit"), F.lit("now").alias("utc")).alias("provenance"), "splits"))
    text = lists.select("file", F.when(F.col("file") % 2 == 0, F.to_json("splits")).otherwise(whole).alias("value"))
    text.write.partitionBy("file").text(at)
    found = io.read_results(o.sparkSession, at)
    total = F.aggregate("errors", F.lit(0.0), lambda t, x: t + x)
    return found.select("name", F.size("errors").cast("long").alias("n"), F.round(total, 2).alias("total"))


@Q.add("s15_comment_lines", "select doc_id, lang from documents where doc_id%10<>0", "documents")
def s15(d):
    at = io.passing_folder(d.sparkSession, "comments")
    d.select(F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("# note "), "doc_id")).otherwise(F.concat_ws(",", "doc_id", "lang"))).write.text(at)
    return io.read_commented(d.sparkSession, at, "doc_id long, lang string")


FILES = "select doc_id, '/a/'||doc_id||'_left.png' as path from documents where doc_id%3<>0 union all select doc_id, '/b/'||doc_id||'_right.png' from documents where doc_id%4<>0"


@Q.add("s16_paired_files", f"with f as ({FILES}) select cast(doc_id as varchar) as stem, max(case when path like '%left%' then doc_id||'_left.png' end) as left, max(case when path like '%right%' then doc_id||'_right.png' end) as right from f group by doc_id", "documents")
def s16(d):
    name = lambda folder, end: F.concat(F.lit(f"/{folder}/"), F.col("doc_id").cast("string"), F.lit(end)).alias("path")
    files = d.filter("doc_id % 3 <> 0").select(name("a", "_left.png")).union(d.filter("doc_id % 4 <> 0").select(name("b", "_right.png")))
    return io.paired_files(files, "_left.png", "_right.png")
