"""Queries of boxes, votes, grids and fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import spatial as s
from ..operators.joins import band_join
from .fixtures import Queries
from .q_columns import r6

Q = Queries()
REF = "ref as (select layer, box_id as ref_id, x0-300 as rx0, y0-300 as ry0, x1-300 as rx1, y1-300 as ry1 from v4 where x0>300 and x1<600 and y0>300 and y1<600)"
MATCH = f"{REF}, mt as (select b.layer, box_id, ref_id, x0-rx0 as dx, y0-ry0 as dy from v4 b join ref r on b.layer=r.layer and abs((x0+x1)/2-305-(rx0+rx1)/2)<=15 and abs((y0+y1)/2-297-(ry0+ry1)/2)<=15 and abs((x1-x0)-(rx1-rx0))<=0.3 and abs((y1-y0)-(ry1-ry0))<=0.3)"
GUESS = (305.0, 297.0)


@Q.add("j09_box_near_join", f"with {MATCH} select layer, box_id, ref_id, dx, dy from mt", "v4")
def j09(v):
    return s.box_matches(v, s.interior(v, 300, 600), GUESS)


@Q.add("f12_offset_vote", f"with {MATCH}, vt as (select round(dx,2) as dx, round(dy,2) as dy, count(distinct ref_id) as votes from mt group by 1,2) select dx, dy, votes, round((votes*1.0/n)::double,6) as support, votes*1.0/n>=case when n<8 then 0.8 else 0.5 end as accepted from (select * from vt order by votes desc, dx, dy limit 1), (select count(*) as n from ref)", "v4")
def f12(v):
    ref = s.interior(v, 300, 600)
    return s.voted_offset(s.box_matches(v, ref, GUESS), ref).withColumn("support", r6(F.col("support")))


EDGE = "select layer, round(e-r+305,2) as d, count(*) as votes from (select b.layer, x0-305 as e, rx0 as r from v4 b join ref on b.layer=ref.layer and abs(x0-305-rx0)<=15) group by 1,2"


@Q.add("j10_edge_band_join", f"with {REF} {EDGE}", "v4")
def j10(v):
    left = v.select("layer", (F.col("x0") - 305).alias("e"))
    right = s.interior(v, 300, 600).select("layer", F.col("x0").alias("r"))
    gaps = s.edge_differences(left, right, 15.0)
    return gaps.groupBy("layer", F.round(F.col("gap") + 305, 2).alias("d")).agg(F.sum("n").alias("votes"))


def axis(k: str, g: int) -> str:
    return f"{k}v as (select round({k}0-r{k}0,2) as d{k}, count(*) as votes from v4 b join ref on b.layer=ref.layer and abs({k}0-{g}-r{k}0)<=15 group by 1 order by votes desc, d{k} limit 3)"


@Q.add("f13_clipped_vote", f"with {REF}, {axis('x', 305)}, {axis('y', 297)}, ok as (select dx, dy, count(*) as hits from xv, yv, ref r where exists (select 1 from v4 b where b.layer=r.layer and b.x0=r.rx0+dx and b.y0=r.ry0+dy and b.x1=r.rx1+dx and b.y1=r.ry1+dy) group by 1,2) select dx, dy, round((hits*1.0/(select count(*) from ref))::double,6) as overlap from ok", "v4")
def f13(v):
    ref = s.interior(v, 300, 600)
    tops = [s.edge_votes(v, ref, f"{k}0", g).select(F.col("d").alias(f"d{k}")) for k, g in (("x", GUESS[0]), ("y", GUESS[1]))]
    pairs = tops[0].crossJoin(tops[1])  # at most 3 x 3
    moved = ref.crossJoin(F.broadcast(pairs)).select("layer", "dx", "dy", *((F.col(f"{k}{i}") + F.col(f"d{k}")).alias(f"{k}{i}") for k in "xy" for i in (0, 1)))
    hits = moved.join(v.select("layer", "x0", "x1", "y0", "y1").distinct(), ["layer", "x0", "x1", "y0", "y1"], "left_semi").groupBy("dx", "dy").agg(F.count("*").alias("hits"))
    return hits.crossJoin(ref.agg(F.count("*").alias("n"))).select("dx", "dy", r6(F.col("hits") / F.col("n")).alias("overlap"))


@Q.add("f11_bounding_boxes", "select layer, box_id%100 as poly, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from v4 group by 1,2", "v4")
def f11(v):
    corners = v.select("layer", (F.col("box_id") % 100).alias("poly"), F.inline(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))))
    return s.bounding_boxes(corners, ["layer", "poly"])


EMB = "em as (select vec_id, label, list_transform(embedding, lambda e: cast(e as double)) as a from embeddings)"


@Q.add("f07_correlation", f"with {EMB}, r as (select label, arg_min(a, vec_id) as b from em group by 1), p as (select vec_id, unnest(a) as x, unnest(b) as y from em join r using (label)) select vec_id, round(corr(x,y),5) as ncc from p group by 1", "embeddings")
def f07(e):
    ref = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("b"))
    return e.join(ref, "label").select("vec_id", F.round(c.correlation(F.col("embedding"), F.col("b")), 5).alias("ncc"))


@Q.add("f08_array_qa", f"with {EMB}, p as (select vec_id, unnest(a) as x from em) select vec_id, stddev_pop(x)<0.1 as blank, round(avg(case when abs(x)>0.25 then 1.0::double else 0 end),6) as extreme, count(*)=64 as right_size from p group by 1", "embeddings")
def f08(e):
    x = F.transform("embedding", lambda v: v.cast("double"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)
    n = F.size("embedding")
    var = total(F.transform(x, lambda v: v * v)) / n - F.pow(total(x) / n, 2)
    return e.select("vec_id", (F.sqrt(F.greatest(var, F.lit(0.0))) < 0.1).alias("blank"), r6(F.size(F.filter(x, lambda v: F.abs(v) > 0.25)) / n).alias("extreme"), (n == 64).alias("right_size"))


@Q.add("f09_best_candidate", f"with {EMB}, k as (select * from (select label, a as b, row_number() over (partition by label order by vec_id) as i from em) where i<=3), p as (select vec_id, i, unnest(a) as x, unnest(b) as y from em join k using (label)), d as (select vec_id, i, avg(abs(x-y)) as d from p group by 1,2) select vec_id, round(min(d),5) as mad from d group by 1", "embeddings")
def f09(e):
    from pyspark.sql import Window

    cand = e.withColumn("i", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).filter("i <= 3").select("label", F.col("embedding").alias("b"))
    gap = F.aggregate(F.zip_with("embedding", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda a, x: a + x) / F.size("b")
    return e.join(cand, "label").groupBy("vec_id").agg(F.round(F.min(gap), 5).alias("mad"))


CELL = f"{EMB}, q as (select vec_id, cast((p-1)//8 as int) as i, cast((p-1)%8 as int) as j, a[p] as value from em, (select unnest(range(1,65)) as p))"


@Q.add("w09_local_maxima", f"with {CELL}, k as (select q.vec_id, q.i, q.j, q.value from q join q r on q.vec_id=r.vec_id and abs(q.i-r.i)<=2 and abs(q.j-r.j)<=2 group by 1,2,3,4 having q.value>=max(r.value)) select vec_id, i, j, round(value,6) as value, place from (select *, row_number() over (partition by vec_id order by value desc, i, j) as place from k) where place<=3", "embeddings")
def w09(e):
    out = s.local_maxima(s.cells(e, "vec_id", "embedding", 8), "vec_id")
    return out.select("vec_id", "i", "j", r6(F.col("value")).alias("value"), F.col("place").cast("long").alias("place"))


@Q.add("w10_peak_choice", f"with {CELL}, b as (select vec_id, max(value) as best from q group by 1), n as (select q.*, row_number() over (partition by q.vec_id order by sqrt((i-3.5)*(i-3.5)+(j-3.5)*(j-3.5)), -value, i, j) as k from q join b using (vec_id) where value>=best-0.04*abs(best)), o as (select * from n where k=1) select o.vec_id, o.i, o.j, round(o.value,6) as value, round(max(q.value)/nullif(o.value,0),6) as ratio from o join q on q.vec_id=o.vec_id and greatest(abs(q.i-o.i),abs(q.j-o.j))>2 group by o.vec_id, o.i, o.j, o.value", "embeddings")
def w10(e):
    out = s.peak_choice(s.cells(e, "vec_id", "embedding", 8), "vec_id", (3.5, 3.5))
    return out.select("vec_id", "i", "j", r6(F.col("value")).alias("value"), r6(F.col("ratio")).alias("ratio"))


@Q.add("w11_sidelobe_ratios", f"with {CELL}, p as (select * from (select *, row_number() over (partition by vec_id order by value desc, i, j) as k, min(value) over (partition by vec_id) as low from q) where k=1), a as (select q.vec_id, any_value(p.value) as top, any_value(low) as low, avg(q.value) filter (where abs(q.i-p.i)>1 or abs(q.j-p.j)>1) as m, stddev_pop(q.value) filter (where abs(q.i-p.i)>1 or abs(q.j-p.j)>1) as s, avg((q.value-low)*(q.value-low)) as e from q join p on q.vec_id=p.vec_id group by 1) select vec_id, round((top-m)/s,4) as psr, round((top-low)*(top-low)/e,4) as apce from a", "embeddings")
def w11(e):
    return s.sidelobes(s.cells(e, "vec_id", "embedding", 8), "vec_id", half=1).select("vec_id", F.round("psr", 4).alias("psr"), F.round("apce", 4).alias("apce"))


@Q.add("w12_best_lag", f"with {CELL}, z as (select *, lag(value) over (partition by vec_id,i order by j) as l, lead(value) over (partition by vec_id,i order by j) as r, row_number() over (partition by vec_id,i order by value desc, j) as k from q) select vec_id, i, round(j+case when abs(l-2*value+r)<1e-12 then 0 else greatest(least((l-r)/(2*(l-2*value+r)),1),-1) end,4) as lag from z where k=1 and l is not null and r is not null", "embeddings")
def w12(e):
    from pyspark.sql import Window

    row = Window.partitionBy("vec_id", "i").orderBy("j")
    near = s.cells(e, "vec_id", "embedding", 8).withColumns({"l": F.lag("value").over(row), "r": F.lead("value").over(row)})
    top = near.groupBy("vec_id", "i").agg(F.max_by(F.struct("j", "l", "value", "r"), F.struct("value", -F.col("j"))).alias("t"))
    some = top.filter(F.col("t.l").isNotNull() & F.col("t.r").isNotNull())
    return some.select("vec_id", "i", F.round(F.col("t.j") + c.parabola(F.col("t.l"), F.col("t.value"), F.col("t.r")), 4).alias("lag"))


OUT = f"with {EMB}, w as (select vec_id, p, a[p] as x, (select median(a[greatest(least(p+o,64),1)]) from (select unnest(range(-7,8)) as o)) as md from em, (select unnest(range(1,65)) as p)), r as (select vec_id, p, x-md as d from w), m as (select vec_id, list_sort(list(abs(d)))[32] as mad from r group by 1) select r.vec_id, count_if(d>4*1.4826*mad)::bigint as n, round(coalesce(sum(case when d>4*1.4826*mad then d end),0),5) as total from r join m on r.vec_id=m.vec_id group by 1"


@Q.add("w07_running_outliers", OUT, "embeddings")
def w07(e):
    out = e.select("vec_id", s.running_outliers(F.col("embedding")).alias("o"))
    return out.select("vec_id", F.size(F.filter("o", lambda x: x > 0)).cast("long").alias("n"), F.round(F.aggregate("o", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


MASKS = "mk as (select cast(floor(x0/100) as int) as cell, layer, least(count(*)/40.0::double,1.0) as m from v4 group by 1,2)"


@Q.add("w08_layered_coverage", f"with {MASKS} select cell, layer, round(m*coalesce(product(1-m) over (partition by cell order by layer desc rows between unbounded preceding and 1 preceding),1),6) as visible from mk union all select cell, -1, round(product(1-m),6) from mk group by 1", "v4")
def w08(v):
    masks = v.groupBy(F.floor(F.col("x0") / 100).cast("int").alias("cell"), "layer").agg(F.least(F.count("*") / 40.0, F.lit(1.0)).alias("m"))
    return s.coverage(masks, "cell", "layer", "m").withColumn("visible", r6(F.col("visible")))


W13 = """with recursive t(vec_id, embedding, taken) as (
  select vec_id, embedding, []::bigint[] from embeddings
  union all
  select vec_id, embedding, list_append(taken, list_reduce(free, lambda a, b: case when embedding[b+1]>embedding[a+1] then b else a end))
  from (select *, list_filter(range(len(embedding)), lambda i: len(list_filter(taken, lambda p: abs(p-i)<=3))=0) as free from t where len(taken)<5) where len(free)>0)
select vec_id, array_to_string(arg_max(taken, len(taken)), ',') as tops from t group by 1"""


@Q.add("w13_suppressed_top", W13, "embeddings")
def w13(e):
    """Positions of the five strongest values of each vector."""
    return e.select("vec_id", F.array_join(F.transform(s.suppressed_top(F.col("embedding"), 5), lambda i: i.cast("string")), ",").alias("tops"))


def solved_sql(names: tuple[str, str, str]) -> str:
    """Cramer's rule for the normal equations of z on x, y and a constant, with the sums of sums_sql."""
    det = lambda m: f"({m[0]}*({m[4]}*{m[8]}-{m[5]}*{m[7]})-{m[1]}*({m[3]}*{m[8]}-{m[5]}*{m[6]})+{m[2]}*({m[3]}*{m[7]}-{m[4]}*{m[6]}))"
    m, r = "xx xy sx xy yy sy sx sy sw".split(), "xz yz sz".split()
    put = lambda k: [r[i // 3] if i % 3 == k else m[i] for i in range(9)]
    return ", ".join(f"{det(put(k))}/nullif({det(m)},0) as {name}" for k, name in enumerate(names))


def sums_sql(w: str = "1.0::double") -> str:
    terms = {"sx": "x", "sy": "y", "sz": "z", "xx": "x*x", "xy": "x*y", "yy": "y*y", "xz": "x*z", "yz": "y*z"}
    return f"count(*) as n, sum({w}) as sw, " + ", ".join(f"sum({w}*{t}) as {k}" for k, t in terms.items())


def plane_sql(rounds: int = 3) -> str:
    parts = ["r0 as (select architecture as k, gt_x as x, gt_y as y, x as z from v1)"]
    for t in range(rounds):
        parts.append(f"f{t} as (select k, n, {solved_sql(('a', 'b', 'c'))} from (select k, {sums_sql()} from r{t} group by 1))")
        if t:
            kept = ", ".join(f"case when f.n>=6 and f.a is not null then f.{c} else g.{c} end as {c}" for c in "nabc")
            parts.append(f"g{t} as (select g.k, {kept} from g{t - 1} g left join f{t} f using (k))")
        else:
            parts.append("g0 as (select * from f0)")
        parts.append(f"o{t} as (select k, x, y, z, abs(z-(a*x+b*y+c)) as off from r0 join g{t} using (k))")
        parts.append(f"r{t + 1} as (select k, x, y, z from o{t} join (select k, greatest(3*quantile_cont(off,0.5),0.15) as most from o{t} group by 1) using (k) where off<=most)")
    return f"with {', '.join(parts)} select k as architecture, n, round(a,6) as a, round(b,6) as b, round(c,4) as c from g{rounds - 1}"


@Q.add("f14_plane_fit", plane_sql(), "v1")
def f14(v):
    out = s.plane_fit(v, "architecture", "gt_x", "gt_y", "x")
    return out.select("architecture", "n", r6(F.col("a")).alias("a"), r6(F.col("b")).alias("b"), F.round("c", 4).alias("c"))


def huber_sql(rounds: int = 4) -> str:
    parts = ["h0 as (select architecture as k, gt_x as x, gt_y as y, x as z, 1.0::double as w from v1)"]
    for t in range(rounds):
        parts.append(f"f{t} as (select k, {solved_sql(('a', 'b', 'c'))} from (select k, {sums_sql('w')} from h{t} group by 1))")
        parts.append(f"o{t} as (select k, x, y, z, z-(a*x+b*y+c) as off, a, b, c from h0 join f{t} using (k))")
        parts.append(f"h{t + 1} as (select k, x, y, z, case when abs(off)/s<=1.345 then 1.0 else 1.345/(abs(off)/s) end as w from o{t} join (select k, 1.4826*quantile_cont(abs(off),0.5)+1e-12 as s from o{t} group by 1) using (k))")
    last = f"o{rounds - 1}"
    return f"with {', '.join(parts)} select k as architecture, round(any_value(a),6) as a, round(any_value(b),6) as b, round(any_value(c),4) as c, round(1-sum(off*off)/nullif(var_pop(z)*count(*),0),6) as r2 from {last} group by 1"


@Q.add("f15_huber_fit", huber_sql(), "v1")
def f15(v):
    out = s.huber_fit(v, "architecture", ["gt_x", "gt_y"], "x")
    w = F.col("weights")
    return out.select("architecture", r6(w[0]).alias("a"), r6(w[1]).alias("b"), F.round(w[2], 4).alias("c"), r6(F.col("r2")).alias("r2"))
