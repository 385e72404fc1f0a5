"""Queries of fits, batch mapping and streams."""

from __future__ import annotations


from pyspark.sql import functions as F


from ..operators import batch, boost, fit
from ..operators import score as s
from ..sources.io import passing_folder, stored
from ..streaming import streams
from .fixtures import Queries, view
from .q_columns import r6
from ..operators.sample import portable_hash

Q = Queries()
FEATURES = ("score", "zncc", "peak_ratio", "pose_peak")


def table(v, raw: dict, bias: float):
    rows = [(k, float(w)) for k, w in raw.items()] + [("(bias)", float(bias))]
    return v.sparkSession.createDataFrame(rows, "feature string, weight double")


@Q.add("m05_logistic_fit", None, "v1")
def m05(v):
    return table(v, *fit.raw_weights(fit.logistic(v, FEATURES, "gt_found"))).withColumn("weight", F.round("weight", 4))


@Q.add("m06_newton_fit", None, "v1")
def m06(v):
    return table(v, *fit.raw_weights(fit.newton(v, FEATURES, "gt_found"))).withColumn("weight", r6(F.col("weight")))


@Q.add("m07_boosted_trees", None, "v1")
def m07(v):
    """What boosted trees, a linear fit and the plain statistic earn on a held-out fold; thresholds come from the others."""
    rows = stored(s.measured(v).filter("grp in ('A','B','C')").withColumn("fold", (portable_hash("pair_id", F.lit(0)) % 4).cast("int")))
    train = rows.filter("fold <> 0")
    values = {"boosted": boost.predicted(boost.boosted(train, FEATURES, "gt_found")), "linear": fit.predicted(fit.newton(train, FEATURES, "gt_found")), "plain": F.least("score", "zncc")}
    each = None
    for name, e in values.items():
        one = rows.select(F.lit(name).alias("statistic"), "fold", e.alias("score"), *s.MEASURES)
        each = one if each is None else each.unionByName(one)
    hist = stored(s.histogram(each, ["statistic", "fold"]))
    sides = {k: s.sweep_hist(hist.filter(on).groupBy("statistic", "score").agg(*(F.sum(m).alias(m) for m in s.MEASURES)), ["statistic"]) for k, on in (("train", "fold <> 0"), ("test", "fold = 0"))}
    chosen = s.best(sides["train"].withColumn("total", F.round("total", 9)), ["statistic"]).select("statistic", "threshold")
    at = sides["test"].join(chosen, "statistic").filter("score >= threshold")
    return at.groupBy("statistic").agg(F.round(F.first("auc"), 4).alias("auc"), F.round(F.min_by("f1", "score"), 4).alias("held_f1"), F.round(F.min_by("total", "score"), 4).alias("held_total"))


@Q.add("m08_raw_weights_check", None, "v1")
def m08(v):
    model = fit.newton(v, FEATURES, "gt_found")
    gap = F.abs(fit.predicted(model) - fit.predicted_raw(*fit.raw_weights(model)))
    return v.agg(F.round(F.max(gap), 9).alias("largest_gap"))


@Q.add("m10_f1_ceiling", None, "v1")
def m10(v):
    best = fit.f1_ceiling(v.filter("grp in ('A','B','C')"), fit.predicted(fit.newton(v, FEATURES, "gt_found")))
    return best.select(r6(F.col("best")).alias("best"), r6(F.col("threshold")).alias("threshold"))


@Q.add("m11_convergence", None, "v1")
def m11(v):
    """Gradient norm, largest step and mean log-loss at each iteration of the fit."""
    steps = fit.fitted(v, {"all": (FEATURES, F.lit(True))}, "gt_found")["all"]["trace"]
    rows = [(i + 1, round(g, 6), round(d, 6), round(loss, 6)) for i, (g, d, loss) in enumerate(steps)]
    return v.sparkSession.createDataFrame(rows, "iteration int, gradient double, largest_step double, loss double")


@Q.add("m12_feature_sets", None, "v1")
def m12(v):
    """Two folds by a hash; every fit, its threshold and its scores keep to their sides."""
    sets = {"plain": ["score"], "pair": ["score", "zncc"], "all": list(FEATURES), "missing": ["score", "no_such"]}
    rows = s.measured(v).withColumn("fold", (portable_hash("pair_id", F.lit(0)) % 2).cast("int"))
    out = fit.compared(rows, sets, "gt_found", "fold")
    return out.select("name", "eligible", *(F.round(k, 4).alias(k) for k in ("auc", "held_total", "held_f1")))


@Q.add("e02_cv_callback", None, "v1")
def e02(v):
    rows = s.measured(v).withColumn("fold", (portable_hash("pair_id", F.lit(0)) % 2).cast("int"))

    def build(rows, training):
        models = fit.fitted(rows, {k: (FEATURES[:2], on) for k, on in training.items()}, "gt_found")
        return {k: fit.predicted(m) for k, m in models.items()}

    return fit.cross_validated(rows, build, folds=2)


def _nothing() -> dict:
    return {}


def _answer(_: dict, row: dict) -> dict:
    if row["failed"]:
        raise ValueError(row["pair_id"])
    return {"x": row["x"], "y": row["y"], "theta": row["theta"], "scale": row["scale"], "score": row["score"], "found": int(row["score"] >= 0.5)}


@Q.add("e03_isolated_map", "select pair_id, case when failed=1 then 0 else cast(score>=0.5 as int) end as found, case when failed=1 then 0.0 else score end as score, case when failed=1 then 'ValueError' end as error from v1", "v1")
def e03(v):
    return batch.isolated_map(v, "pair_id", _nothing, _answer).select("pair_id", "found", "score", "error")


def _folder(spark) -> str:
    return passing_folder(spark, "stream")


def stream(name: str, sql: str | None = None):
    """Registers a query over the events table, written to files and read back as a stream."""

    def put(f):
        def run(spark, sf_dir):
            events = view(spark, sf_dir, "events").withColumn("run", (F.col("user_id") % 8).cast("int"))
            return f(events, _folder(spark))

        Q[name] = run
        if sql:
            Q.sql[name] = sql
        return f

    return put


def failed():
    return F.col("event_type") == "error"


def arrive(events, at, parts: int = 4):
    """Yields the stream of what has arrived, after each of so many parts of the events has."""
    for k in range(parts):
        events.filter(F.col("event_id") % parts == k).write.mode("append").parquet(f"{at}/in")
        yield streams.read(events.sparkSession, f"{at}/in", events.schema, files=1_000_000)


X01 = "with p as (select cast(user_id%8 as int) as run, event_id%4 as part, count(*) as n, count_if(event_type='error') as errors from events group by 1,2), c as (select run, part, sum(n) over (partition by run order by part) as n, sum(errors) over (partition by run order by part) as errors from p), a as (select *, row_number() over (partition by run order by part) as k from c where n>=8 and errors>=0.2*n) select run, n::bigint as n, errors::bigint as errors from a where k=1"


@stream("x01_mass_failure_alarm", X01)
def x01(events, at):
    """Each run's state when the alarm first fires; the events arrive in four parts, each a batch of the same query."""
    spark = events.sparkSession
    for rows in arrive(events, at):
        streams.alarm(rows, "run", failed(), f"{at}/out", f"{at}/check")
    if streams.exists(spark, f"{at}/out"):
        return spark.read.parquet(f"{at}/out").select("run", "n", "errors")
    return events.groupBy("run").agg(F.count("*").alias("n"), F.count("*").alias("errors")).limit(0)


@stream("x02_live_progress", "select cast(user_id%8 as int) as run, count(*) as done, count_if(event_type='purchase')::bigint as found, round(quantile_disc(value,0.5),6) as median, round(count(*)/sum(value),6) as rate, round(greatest(10000-count(*),0)/(count(*)/sum(value)),3) as eta from events group by 1")
def x02(events, at):
    for rows in arrive(events, at, 2):
        out = streams.drained(streams.progress(rows, "run", F.col("event_type") == "purchase", "value", 10_000), f"{at}/out", f"{at}/check", "complete")
    return out.select("run", "done", "found", r6(F.col("median")).alias("median"), r6(F.col("rate")).alias("rate"), F.round("eta", 3).alias("eta"))


@stream("x03_growing_pool", "select event_id from events where cast(user_id%8 as int) in (1,3,5)")
def x03(events, at):
    """Shard 5 is marked as finished only after its first rows have arrived."""
    spark = events.sparkSession
    mark = lambda *ks: spark.createDataFrame([(k,) for k in ks], "run int").write.mode("append").parquet(f"{at}/markers")
    mark(1, 3)
    for rows in arrive(events, at, 2):
        streams.grow_pool(rows, f"{at}/out", f"{at}/check")
        mark(5)
    return streams.pool(spark, f"{at}/out", f"{at}/markers", "run").select("event_id")


@stream("x04_resume", "select event_id from events")
def x04(events, at):
    for rows in arrive(events, at, 2):
        streams.resume(rows.select("event_id"), "event_id", f"{at}/out", f"{at}/check")
    # again from the start, as after a lost checkpoint: nothing is added
    streams.resume(rows.select("event_id"), "event_id", f"{at}/out", f"{at}/check2")
    return streams.committed(events.sparkSession, f"{at}/out")


def x05(spark, sf_dir):
    at = _folder(spark)
    v = view(spark, sf_dir, "v1")
    for k in range(2):
        v.filter(F.col("pair_id") % 2 == k).write.mode("append").parquet(f"{at}/in")
        rows = s.measured(streams.read(spark, f"{at}/in", v.schema, files=1_000_000))
        streams.score_stream(rows, ["grp"], f"{at}/out", f"{at}/check")
    # again from the start, as after a lost checkpoint: every file counts once
    streams.score_stream(rows, ["grp"], f"{at}/out", f"{at}/check2")
    return streams.scored(spark, f"{at}/out", ["grp"]).select("grp", "n", r6(F.col("acc")).alias("acc"), r6(F.col("se")).alias("se"))


Q["x05_incremental_scoring"] = x05


@stream("x06_unique_ids", "select distinct event_id from events")
def x06(events, at):
    for rows in arrive(events, at, 1):
        twice = rows.unionByName(rows)
    return streams.drained(streams.unique(twice, "event_id", "ts", "3650 days").select("event_id"), f"{at}/out", f"{at}/check")


def s06(spark, sf_dir):
    """Two CSV shards with differing columns, and the shard of each row."""
    from ..sources import io

    at = _folder(spark)
    v = view(spark, sf_dir, "v1")
    v.filter("grp = 'A'").select("pair_id", "score").write.option("header", True).csv(f"{at}/one")
    v.filter("grp = 'B'").select("pair_id", "zncc").write.option("header", True).csv(f"{at}/two")
    out = io.scan_shards(spark, [f"{at}/one", f"{at}/two"])
    return out.select(F.col("pair_id").cast("long").alias("pair_id"), F.col("score").cast("double").alias("score"), F.col("zncc").cast("double").alias("zncc"), "shard")


Q["s06_shard_scan"] = s06
from .fixtures import with_views  # noqa: E402

Q.sql["s06_shard_scan"] = with_views("select pair_id, score, null::double as zncc, 'one' as shard from v1 where grp='A' union all select pair_id, null, zncc, 'two' from v1 where grp='B'")
Q.sql["x05_incremental_scoring"] = with_views("select grp, count(*) as n, round(p,6) as acc, round(sqrt(p*(1-p)/np),6) as se from (select *, sum(k) over (partition by grp)*1.0::double/nullif(sum(gt_found) over (partition by grp),0) as p, sum(gt_found) over (partition by grp) as np from (select grp, gt_found, case when gt_found=1 and sqrt((x-gt_x)*(x-gt_x)+(y-gt_y)*(y-gt_y))<=5 then 1 else 0 end as k from v1)) group by grp, p, np")
