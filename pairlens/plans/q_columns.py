"""Queries of column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators.aggregate import quantiles
from .fixtures import Queries

Q = Queries()
r6 = lambda x: F.round(x, 6)
LOC = "case when gt_found=1 then sqrt((x-gt_x)*(x-gt_x)+(y-gt_y)*(y-gt_y)) end"


def tier_sql(value: str, tiers) -> str:
    return "case " + " ".join(f"when {value} <= {b} then {k}" for b, k in tiers) + " else 0.0 end"


@Q.add("p01_location_error", f"select pair_id, round({LOC},6) as err from v1", "v1")
def p01(v):
    return v.select("pair_id", r6(c.location_error()).alias("err"))


@Q.add("p02_tier", f"select pair_id, cast({tier_sql(LOC, c.LOCATION_TIERS)} as double) as loc, cast({tier_sql('abs(scale-gt_scale)/gt_scale', c.SCALE_TIERS)} as double) as sc, cast({tier_sql('abs(theta-gt_rot)', c.ROTATION_TIERS)} as double) as rot from v1", "v1")
def p02(v):
    return v.select("pair_id", c.tier(c.location_error(), c.LOCATION_TIERS).alias("loc"), c.tier(c.scale_error(), c.SCALE_TIERS).alias("sc"), c.tier(c.rotation_error(), c.ROTATION_TIERS).alias("rot"))


@Q.add("p03_pose_errors", "select pair_id, round(abs(scale-gt_scale)/case when gt_scale=0 then 1 else abs(gt_scale) end,6) as scale_err, round(abs(theta-gt_rot),6) as rot_err from v1", "v1")
def p03(v):
    return v.select("pair_id", r6(c.scale_error()).alias("scale_err"), r6(c.rotation_error()).alias("rot_err"))


@Q.add("p04_clamp_pose", "select pair_id, round(greatest(least(scale,12.0),8.0),6) as scale, round(greatest(least(theta,5.0),-5.0),6) as theta from v1", "v1")
def p04(v):
    return v.select("pair_id", *(r6(c.clamp(k, *b)).alias(k) for k, b in c.POSE_BOUNDS.items()))


@Q.add("p05_decide", "select pair_id, cast(score>=0.55 as int) as found, " + ", ".join(f"round(case when score>=0.55 then {k} else 0.0 end,6) as {k}" for k in ("x", "y", "theta", "scale")) + " from v1", "v1")
def p05(v):
    d = c.decide(0.55)
    return v.select("pair_id", d["found"].alias("found"), *(r6(d[k]).alias(k) for k in ("x", "y", "theta", "scale")))


@Q.add("p06_mask", f"select pair_id, cast(case when score>=0.5 then {tier_sql(LOC, c.LOCATION_TIERS)} else 0.0 end as double) as credit from v1", "v1")
def p06(v):
    return v.select("pair_id", c.masked(c.tier(c.location_error(), c.LOCATION_TIERS), (F.col("score") >= 0.5).cast("int")).alias("credit"))


@Q.add("p07_pixel_shift", "select pair_id, x-0.5 as x, y-0.5 as y from v1", "v1")
def p07(v):
    return v.select("pair_id", *(c.centre_from_edge(k).alias(k) for k in ("x", "y")))


@Q.add("p08_statistics", """select pair_id, s.stat, round(s.value,6) as value from (select pair_id, unnest([
 {'stat':'score','value':score},{'stat':'zncc','value':zncc},{'stat':'min','value':least(score,zncc)},{'stat':'product','value':score*zncc},
 {'stat':'root','value':sqrt(greatest(score,0)*greatest(zncc,0))},{'stat':'mean','value':(score+zncc)/2},{'stat':'distinct','value':score*(1-peak_ratio)},
 {'stat':'min_pose','value':least(zncc,pose_peak)}]) as s from v1)""", "v1")
def p08(v):
    return v.select("pair_id", c.stacked(c.statistics())).withColumn("value", r6(F.col("value")))


@Q.add("p09_derived", "select pair_id, round(least(score,zncc),6) as f_min, round(score*zncc,6) as f_prod, round(abs(score-zncc),6) as f_gap, round(score/greatest(zncc,0.000001),6) as f_ratio, round(peak_ratio*pose_peak,6) as f_peak_pose, cast(n_hyp as double) as f_n_hyp from v1", "v1")
def p09(v):
    return v.select("pair_id", *(r6(e).alias(k) for k, e in c.derived().items()))


NANS = "case when c%17=0 then cast('nan' as double) when c%19=0 then cast('infinity' as double) else zncc end"


@Q.add("p10_missing_policy", f"with z as (select pair_id, {NANS} as v from v1), f as (select pair_id, case when isfinite(v) then v end as v from z) select pair_id, round(coalesce(v,0),6) as zero, round(coalesce(v,(select median(v) from f)),6) as med, cast(v is null as int) as missing from f", "v1")
def p10(v):
    rows = v.select("pair_id", c.finite(F.expr(NANS)).alias("v"))
    median = quantiles(rows, [], "v", {"median": 0.5})
    return rows.crossJoin(F.broadcast(median)).select("pair_id", r6(c.zero_if_missing("v")).alias("zero"), r6(F.coalesce("v", "median")).alias("med"), F.col("v").isNull().cast("int").alias("missing"))


@Q.add("p11_available", f"with z as (select {NANS} as a, case when c%3=0 then zncc end as b from v1) select 'a' as feature, round(avg(case when isfinite(a) then 1.0::double else 0.0 end),6) as share, avg(case when isfinite(a) then 1.0 else 0.0 end)>=0.5 as usable from z union all select 'b', round(avg(case when isfinite(b) then 1.0::double else 0.0 end),6), avg(case when isfinite(b) then 1.0 else 0.0 end)>=0.5 from z union all select 'missing', 0.0::double, false", "v1")
def p11(v):
    rows = v.select(F.expr(NANS).alias("a"), F.expr("case when c%3=0 then zncc end").alias("b"))
    return c.available(rows, ["a", "b", "missing"]).withColumn("share", r6(F.col("share")))


W9 = {"score": 2.5, "zncc": 1.25, "peak_ratio": -1.5, "pose_peak": 0.75}


@Q.add("p12_logistic_score", "select pair_id, round(1/(1+exp(-(-1.0+2.5*score+1.25*zncc-1.5*peak_ratio+0.75*pose_peak))),6) as p from v1", "v1")
def p12(v):
    return v.select("pair_id", r6(c.logistic_score(W9, -1.0, v.columns)).alias("p"))


@Q.add("p13_rank_aligned", "with z as (select pair_id, case when c%17<>0 then score*0.5 end as fitted, zncc as plain from v1), b as (select min(fitted) as lo, max(fitted) as hi, min(case when fitted is null then plain end) as plo, max(case when fitted is null then plain end) as phi from z) select pair_id, round(coalesce(fitted, lo+(plain-plo)/case when phi=plo then 1 else phi-plo end*(hi-lo)),6) as s from z, b", "v1")
def p13(v):
    rows = v.select("pair_id", F.when(F.col("c") % 17 != 0, F.col("score") * 0.5).alias("fitted"), F.col("zncc").alias("plain"))
    bad = F.when(F.col("fitted").isNull(), F.col("plain"))
    span = rows.agg(F.min("fitted").alias("lo"), F.max("fitted").alias("hi"), F.min(bad).alias("plo"), F.max(bad).alias("phi"))
    wide = F.when(F.col("phi") == F.col("plo"), 1.0).otherwise(F.col("phi") - F.col("plo"))
    return rows.crossJoin(F.broadcast(span)).select("pair_id", r6(F.coalesce("fitted", F.col("lo") + (F.col("plain") - F.col("plo")) / wide * (F.col("hi") - F.col("lo")))).alias("s"))


@Q.add("p14_early_exit", "select pair_id, (score>=0.8 and zncc>=0.4 and peak_ratio<=0.5 and abs(score-zncc)>=0.1) or (score>=0.6 and zncc>=0.3 and peak_ratio<=0.25) as fires from v1", "v1")
def p14(v):
    rows = v.withColumn("gap", F.abs(F.col("score") - F.col("zncc")))
    return rows.select("pair_id", c.early_exit([(0.8, 0.4, 0.5, 0.1), (0.6, 0.3, 0.25, None)]).alias("fires"))


KIND = "case when gt_found=0 then 'absent' when severity<3 then 'verified' else 'unverified' end"


@Q.add("p15_bands", f"select pair_id, round(case {KIND} when 'absent' then 0.05*score when 'unverified' then 0.05+0.05*score else 0.1+0.9*score end,6) as conf from v1", "v1")
def p15(v):
    return v.select("pair_id", r6(c.banded(F.expr(KIND), "score")).alias("conf"))


NOISE = {"low": 1, "medium": 2, "high": 3, "extreme": 4}
NOISE_SQL = "case severity when 0 then 'low' when 1 then 'medium' when 2 then 'high' when 3 then 'extreme' end"


@Q.add("p16_normalise_metadata", f"select pair_id, case {NOISE_SQL} when 'low' then 1 when 'medium' then 2 when 'high' then 3 when 'extreme' then 4 end as severity, case when {NOISE_SQL} in ('high','extreme') then 'B' else 'A' end as proxy from v1", "v1")
def p16(v):
    rows = v.select("pair_id", F.expr(NOISE_SQL).alias("noise"))
    return rows.select("pair_id", c.lookup("noise", NOISE).alias("severity"), c.lookup("noise", {"high": "B", "extreme": "B"}, "A").alias("proxy"))


@Q.add("p17_family", "select pair_id, split_part(architecture,'-',1) as family from v1", "v1")
def p17(v):
    return v.select("pair_id", c.prefix("architecture", "-").alias("family"))


@Q.add("p18_pooled_mode", "select case when gt_found=1 then 'A' else 'C' end as grp, count(*) as n, case when gt_found=1 then 1.0e0 else 0.0e0 end as weight from v1 group by gt_found", "v1")
def p18(v):
    pooled = v.drop("grp").withColumn("grp", F.when(F.col("gt_found") == 1, "A").otherwise("C"))
    return pooled.groupBy("grp").agg(F.count("*").alias("n")).withColumn("weight", c.lookup("grp", {"A": 1.0}, 0.0))


@Q.add("p19_observable_layers", "select box_id, array_to_string(list_filter([0,1,2,3,4,5,6,7], lambda i: i<>layer), ',') as seen, array_to_string(list_transform([0,1,2,3,4,5,6,7], lambda i: case when i=layer then cast(x0 as int) when i=(layer+3)%8 then 7 else 0 end), ',') as dense from v4", "v4")
def p19(v):
    sparse = F.map_from_arrays(F.array("layer", (F.col("layer") + 3) % 8), F.array(F.col("x0").cast("int"), F.lit(7)))
    every = F.sequence(F.lit(0), F.lit(7))
    return v.select("box_id", F.array_join(F.array_except(every, F.array("layer")), ",").alias("seen"), F.array_join(c.dense(sparse, 8), ",").alias("dense"))


@Q.add("p20_sentinels", "select pair_id, case when gt_found=0 then x else gt_x end as gt_x, case when c%23=0 then 1.0 else gt_scale end as gt_scale from v1", "v1")
def p20(v):
    raw = v.select("pair_id", "x", F.when(F.col("gt_found") == 1, F.col("gt_x")).alias("gt_x"), F.when(F.col("c") % 23 == 0, 0.0).otherwise(F.col("gt_scale")).alias("gt_scale"))
    return raw.select("pair_id", F.coalesce("gt_x", "x").alias("gt_x"), F.when(F.col("gt_scale") == 0, 1.0).otherwise(F.col("gt_scale")).alias("gt_scale"))


@Q.add("p21_brightness", "select layer, cast(round_even(least(greatest(0.25+0.7*(layer/7.0e0),0),1)*255,0) as int) as grey from (select distinct layer from v4)", "v4")
def p21(v):
    return v.select("layer").distinct().select("layer", c.brightness("layer", F.lit(8)).alias("grey"))


@Q.add("p22_repeat_confusion", f"select pair_id from v1 where score>=0.7 and {LOC}>10", "v1")
def p22(v):
    return v.filter((F.col("score") >= 0.7) & (c.location_error() > 10)).select("pair_id")


@Q.add("p23_every_nth", "select pair_id from (select pair_id, grp, row_number() over (partition by grp order by pair_id)-1 as i from v1) where i%7=0 and i<700", "v1")
def p23(v):
    from pyspark.sql import Window

    # a limit on the row number itself is applied before the shuffle
    at = F.row_number().over(Window.partitionBy("grp").orderBy("pair_id"))
    return v.withColumn("i", at).filter("i <= 700").filter("(i - 1) % 7 = 0").select("pair_id")


SPECS = ("base:gain=1.0,steps=3", "fast:gain=0.5,steps=1,blur=true", "slow:gain=2.5,steps=9")


@Q.add("p24_variant_specs", "select s.name, s.gain, s.steps, s.blur, count(*) as pairs from v1, (select unnest([{'name':'base','gain':1.0::double,'steps':3,'blur':null},{'name':'fast','gain':0.5::double,'steps':1,'blur':true},{'name':'slow','gain':2.5::double,'steps':9,'blur':null}]) as s) group by 1,2,3,4", "v1")
def p24(v):
    spark = v.sparkSession
    text = spark.createDataFrame([(s,) for s in SPECS], "spec string")
    keys = F.str_to_map(F.split_part("spec", F.lit(":"), F.lit(2)), F.lit(","), F.lit("="))
    get = lambda k, kind: F.element_at(keys, F.lit(k)).cast(kind).alias(k)
    variants = text.select(F.split_part("spec", F.lit(":"), F.lit(1)).alias("name"), get("gain", "double"), get("steps", "int"), get("blur", "boolean"))
    n = v.agg(F.count("*").alias("pairs"))
    return variants.crossJoin(n)


# geometry and scalar functions


@Q.add("f01_affine", "with m as (select pair_id, x, y, scale*cos(radians(theta)) as a, -scale*sin(radians(theta)) as b, gt_x as c, scale*sin(radians(theta)) as d, scale*cos(radians(theta)) as e, gt_y as f from v1) select pair_id, round(a*x+b*y+c,4) as u, round(d*x+e*y+f,4) as v, 0.0e0 as back from m", "v1")
def f01(v):
    m = c.affine(*(F.col(k) for k in ("scale", "theta", "gt_x", "gt_y")))
    u, w = c.apply_affine(m, F.col("x"), F.col("y"))
    bx, by = c.apply_affine(c.invert_affine(m), u, w)
    return v.select("pair_id", F.round(u, 4).alias("u"), F.round(w, 4).alias("v"), F.abs(F.round(F.hypot(bx - F.col("x"), by - F.col("y")), 6)).alias("back"))


@Q.add("f02_label_offset", "select pair_id, round((gt_scale-1)/(2*gt_scale),6) as off from v1", "v1")
def f02(v):
    return v.select("pair_id", r6(c.label_offset("gt_scale")).alias("off"))


@Q.add("f03_barrel", "select pair_id, round(r*(1+0.05*r*r),6) as fwd, round(r,6) as inv, round(u,4) as label_x, round(w,4) as label_y from (select pair_id, sqrt(gt_x*gt_x+gt_y*gt_y)/1000 as r, gt_x as u, gt_y as w from v1)", "v1")
def f03(v):
    """A radius distorted and back; and a label seen through drift and distortion, moved there first: the correction finds it again."""
    r = F.hypot("gt_x", "gt_y") / 1000
    middle, k = 499.5, 0.05
    u, w = (F.col("gt_x") - middle) / middle, (F.col("gt_y") - middle) / middle
    way = 1 + k * (u * u + w * w)
    shift = F.col("severity") * 0.75
    # the label whose corrected place is gt_x, gt_y
    x, y = u * way * middle + middle + shift, w * way * middle + middle
    px, py = c.corrected_label(x, y, shift, k, 1000)
    return v.select("pair_id", r6(c.barrel(r, 0.05)).alias("fwd"), r6(c.barrel_inverse(c.barrel(r, 0.05), 0.05)).alias("inv"), F.round(px, 4).alias("label_x"), F.round(py, 4).alias("label_y"))


@Q.add("f04_dihedral", "with p as (select pair_id, cast(c%8 as int) as t, cast(case when c%8>=4 then 999-gt_x else gt_x end as double) as a, gt_y as b, gt_x, gt_y from v1) select pair_id, case t%4 when 1 then b when 2 then 999-a when 3 then 999-b else a end as u, case t%4 when 1 then 999-a when 2 then 999-b when 3 then a else b end as v, gt_x as bx, gt_y as by from p", "v1")
def f04(v):
    t = (F.col("c") % 8).cast("int")
    u, w = c.dihedral(t, F.col("gt_x"), F.col("gt_y"), 1000.0)
    rows = v.select("pair_id", t.alias("t"), u.alias("u"), w.alias("v"))
    bx, by = c.dihedral_inverse(F.col("t"), F.col("u"), F.col("v"), 1000.0)
    return rows.select("pair_id", "u", "v", bx.alias("bx"), by.alias("by"))


@Q.add("f05_design_to_pixel", "select pair_id, round(x+scale*(gt_x*cos(radians(theta))-gt_y*sin(radians(theta)))/10,2) as u, round(y+scale*(gt_x*sin(radians(theta))+gt_y*cos(radians(theta)))/10,2) as v from v1", "v1")
def f05(v):
    m = c.affine(F.col("scale") / 10, F.col("theta"), F.col("x"), F.col("y"))
    u, w = c.apply_affine(m, F.col("gt_x"), F.col("gt_y"))
    return v.select("pair_id", F.round(u, 2).alias("u"), F.round(w, 2).alias("v"))


@Q.add("f06_parabola", "select pair_id, round(case when abs(zncc-2*score+pose_peak)<1e-12 then 0 else greatest(least((zncc-pose_peak)/(2*(zncc-2*score+pose_peak)),1),-1) end,6) as off from v1", "v1")
def f06(v):
    return v.select("pair_id", r6(c.parabola(F.col("zncc"), F.col("score"), F.col("pose_peak"))).alias("off"))


@Q.add("f10_boxes", "select pair_id, gt_x-scale/2 as x0, gt_x+scale/2 as x1, (gt_x-scale/2>=0 and gt_x+scale/2<=890 and gt_y-scale/2>=0 and gt_y+scale/2<=890) as inside, not(gt_x+scale/2<0 or gt_x-scale/2>890) as visible from (select pair_id, gt_x, gt_y, case when c%3=0 then 24.0 else 32.0 end as scale from v1)", "v1")
def f10(v):
    size = F.when(F.col("c") % 3 == 0, F.lit(24.0))  # explicit on some rows, else the default
    half = F.coalesce(size, F.lit(32.0)) / 2
    b = v.select("pair_id", *((F.col(f"gt_{k}") + s * half).alias(f"{k}{i}") for k in "xy" for i, s in enumerate((-1, 1))))
    return b.select("pair_id", "x0", "x1", ((F.col("x0") >= 0) & (F.col("x1") <= 890) & (F.col("y0") >= 0) & (F.col("y1") <= 890)).alias("inside"), (~((F.col("x1") < 0) | (F.col("x0") > 890))).alias("visible"))


@Q.add("f17_sigmoid_logloss", "select round(avg(-case when gt_found=1 then ln(p) else ln(1-p) end),6) as loss, round(max(p),6) as top from (select gt_found, greatest(least(1/(1+exp(-(score*40-20))),1-1e-12),1e-12) as p from v1)", "v1")
def f17(v):
    p = c.sigmoid(F.col("score") * 40 - 20)
    return v.agg(r6(F.avg(c.log_loss(p, "gt_found"))).alias("loss"), r6(F.max(p)).alias("top"))


@Q.add("f18_strings", "select o_orderkey, split_part(o_orderpriority,'-',1) as head, concat('shard_',o_orderkey%4,'/',o_orderstatus) as path, lower(trim(o_orderstatus)) in ('1','true','yes','y') as truth from orders", "orders")
def f18(v):
    return v.select("o_orderkey", c.prefix("o_orderpriority", "-").alias("head"), F.concat(F.lit("shard_"), F.col("o_orderkey") % 4, F.lit("/"), F.col("o_orderstatus")).alias("path"), c.truthy("o_orderstatus").alias("truth"))


@Q.add("f19_maps_arrays", "select vec_id, round(cast(list_sum(list_transform(embedding[1:8], lambda e: cast(e as double))) as double),4) as total, round(cast(embedding[3] as double),5) as third, len(embedding) as n from embeddings", "embeddings")
def f19(v):
    m = F.map_from_entries(F.transform(F.slice("embedding", 1, 8), lambda e, i: F.struct(i.cast("int"), e.cast("double"))))
    total = F.aggregate(c.dense(m, 8), F.lit(0.0), lambda s, x: s + x)
    return v.select("vec_id", F.round(total, 4).alias("total"), F.round(F.element_at(m, F.lit(2)), 5).alias("third"), F.size("embedding").cast("long").alias("n"))


@Q.add("f16_content_hash", "select doc_id, sha256(text) as sha from documents", "documents")
def f16(d):
    return d.select("doc_id", c.content_hash("text").alias("sha"))


@Q.add("f20_utc_stamp", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as utc from events", "events")
def f20(e):
    return e.select("event_id", c.utc_text(F.col("ts")).alias("utc"))
