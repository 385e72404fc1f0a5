"""Deterministic samples, bootstraps and quotas by a hash that any engine can compute.

A row's draw depends on its id and the seed alone, so samples don't change with partitions or retries.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import stored, with_ordinal
from .aggregate import joined


def portable_hash(*parts: Column | str | int) -> Column:
    """32 bits: the first eight hex digits of the md5 of the parts joined by bars."""
    text = F.concat_ws("|", *((F.col(p) if isinstance(p, str) else p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform(*parts) -> Column:
    return (portable_hash(*parts) + 0.5) / 4294967296.0


def stratified(rows: DataFrame, stratum: str, quotas: Mapping[str, int], seed: int, key: str = "pair_id", check: bool = True) -> DataFrame:
    """Exactly the quota of each stratum, without replacement; too few rows are an error."""
    want = rows.sparkSession.createDataFrame(list(quotas.items()), f"{stratum} string, _quota int")
    if check:
        have = {r[stratum]: r["n"] for r in rows.groupBy(stratum).agg(F.count("*").alias("n")).join(F.broadcast(want), stratum).collect()}
        if short := {k: (have.get(k, 0), q) for k, q in quotas.items() if have.get(k, 0) < q}:
            raise ValueError(f"strata with fewer rows than asked for: {short}")
    order = Window.partitionBy(stratum).orderBy(portable_hash(key, seed), key)
    # row_number <= n keeps only the first n of each task before the shuffle
    most = max(quotas.values())
    some = rows.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= most)
    return some.join(F.broadcast(want), stratum).filter("_place <= _quota").drop("_place", "_quota")


def fixed_size(rows: DataFrame, n: int, seed: int, key: str = "pair_id") -> DataFrame:
    """n rows without replacement, or all if there are fewer; a top-n, so no sort of all rows."""
    return rows.withColumn("_h", portable_hash(key, seed)).orderBy("_h", key).limit(n).drop("_h")


def draws(rows: DataFrame, stratum: str, quotas: Mapping[str, int], count: int, key: str = "pair_id") -> DataFrame:
    """rows of ``count`` stratified draws (column draw), each with exact quotas, without replacement, shared by all that is computed on them.

    Rows are numbered once within their stratum (by a numeric key). A draw hashes to places, some more than
    its quota; the first distinct ones count. So the work grows with draws times quotas, not with draws times
    rows. A draw that stays short is an error.
    """
    quota = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))
    # numbered rows are read for the strata's sizes and for the draws
    some = stored(with_ordinal(rows.filter(F.col(stratum).isin(*quotas)), key, "_at", within=[stratum]), "numbered")
    strata = some.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_n")).withColumn("_quota", quota[F.col("_s")])
    # enough tries for the quota of distinct places, with room to spare
    tries = F.ceil(-2 * F.col("_n") * F.log(F.greatest(1 - F.col("_quota") / (F.col("_n") + 0.5), F.lit(1e-9)))) + 40
    asked = strata.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).repartition("draw").withColumn("_i", F.explode(F.sequence(F.lit(0), tries.cast("int") - 1)))
    asked = asked.withColumn("_place", portable_hash("_s", "draw", "_i") % F.col("_n"))
    # a draw's places of one stratum are a few times its quota
    first = asked.groupBy("draw", "_s", "_quota", "_place").agg(F.min("_i").alias("_i"))
    own = Window.partitionBy("draw", "_s")
    first = first.withColumns({"_k": F.row_number().over(own.orderBy("_i")), "_have": F.count("*").over(own)}).filter("_k <= _quota")
    place = F.when(F.col("_have") < F.col("_quota"), F.raise_error(F.lit("a draw has fewer rows than its quota")).cast("long")).otherwise(F.col("_place"))
    chosen = first.select("draw", "_s", place.alias("_place"))
    return some.join(chosen, (F.col(stratum) == F.col("_s")) & (F.col("_at") == F.col("_place"))).drop("_s", "_at", "_place")


def poisson_weight(u: Column) -> Column:
    """A Poisson(1) count from a uniform number of 32 bits; 13 and more are less likely than the least step of such a number."""
    import math

    out = F.lit(13)
    for k in range(12, -1, -1):
        out = F.when(u < sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)), k).otherwise(out)
    return out


def bootstrap_weights(rows: DataFrame, count: int, seed: int = 0, key: str = "pair_id") -> DataFrame:
    """rows once for each draw with their Poisson weight (zeros left out): a bootstrap with replacement without any shuffle."""
    long = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return long.withColumn("weight", poisson_weight(uniform(key, F.col("draw"), seed))).filter("weight > 0")


def _log_factorial(k: Column) -> Column:
    """ln k!, for k above 20 by its series (right to 1e-12)."""
    x = F.greatest(k, F.lit(21)).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * 3.141592653589793 * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(k > 20, series).otherwise(F.log(F.factorial(F.least(k, F.lit(20)).cast("int")).cast("double")))


def poisson_table(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, _k, _before: the chance that a Poisson count of mean n is below k, for all k that a uniform number of 32 bits can tell apart.

    A cell has some 18 sqrt(n) rows: beyond 9 deviations (and 40) to both sides lies less than the least step of such a number.
    """
    n = F.col("n").cast("double")
    far = F.ceil(9 * F.sqrt(n)) + 40
    long = cells.select(*keys, n.alias("_mean"), F.explode(F.sequence(F.greatest(F.lit(0), F.floor(n) - far).cast("long"), (F.floor(n) + far).cast("long"))).alias("_k"))
    k, mean = F.col("_k"), F.col("_mean")
    some = F.greatest(k, F.lit(1)).cast("double")
    # k ln(n / k) + k - n: no difference of large numbers
    close = F.when(k == 0, -mean).otherwise(k * F.log1p((mean - some) / some) + (k - mean))
    stirling = _log_factorial(k) - F.when(k == 0, 0.0).otherwise(some * F.log(some) - some)
    p = F.exp(close - stirling)
    own = Window.partitionBy(*keys).orderBy("_k")
    return long.withColumn("_p", p).select(*keys, "_k", (F.sum("_p").over(own.rowsBetween(Window.unboundedPreceding, -1))).alias("_before")).fillna(0.0, ["_before"])


def cell_weights(cells: DataFrame, keys: Sequence[str], count: int, seed: int = 0) -> DataFrame:
    """cells (keys, n rows alike) once for each draw with the weight of all their rows (zeros left out).

    The weight is a sum of n Poisson(1) counts, which is a Poisson count of mean n: it is read from that law's
    table at one uniform number, the same way for every n. A cell's draws and table are sorted together.
    """
    table = poisson_table(cells, keys).select(*keys, "_k", F.col("_before").alias("_at"), F.lit(None).cast("int").alias("draw"))
    asked = cells.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("draw"))
    asked = asked.select(*keys, F.lit(None).cast("long").alias("_k"), uniform(*keys, "draw", seed).alias("_at"), "draw")
    up_to = Window.partitionBy(*keys).orderBy("_at", F.col("draw").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    drawn = table.unionByName(asked).withColumn("weight", F.last("_k", True).over(up_to)).filter("draw is not null and weight > 0").select(*keys, "draw", "weight")
    return joined(drawn, cells, keys)


def paired_difference(rows: DataFrame, value_a: str, value_b: str, count: int, seed: int = 0, strata: Sequence[str] = ()) -> DataFrame:
    """draw, delta: weighted mean of b less that of a in each draw, both runs with the same weights (mean over strata).

    Values are credits or hits, so rows fall into few cells of stratum and both values (in thousandths); only
    cells are drawn, whatever the number of rows. Round other values first.
    """
    milli = {n: F.round(F.col(v) * 1000).cast("int").alias(n) for n, v in (("_a", value_a), ("_b", value_b))}
    cells = rows.groupBy(*strata, *milli.values()).agg(F.count("*").alias("n"))
    w = cell_weights(cells, [*strata, "_a", "_b"], count, seed)
    one = w.groupBy("draw", *strata).agg((F.sum(F.col("weight") * (F.col("_b") - F.col("_a"))) / F.sum("weight") / 1000).alias("d"))
    return one.groupBy("draw").agg(F.avg("d").alias("delta"))


def interval(deltas: DataFrame, bar: float = 0.35) -> DataFrame:
    """mean, lo, hi (95 %), p_better, p_worse, p_bar of a difference's draws (one row for each draw)."""
    p = lambda q: F.percentile("delta", F.lit(q))
    chance = lambda flag: F.avg(flag.cast("double"))
    d = F.col("delta")
    return deltas.agg(F.avg(d).alias("mean"), p(0.025).alias("lo"), p(0.975).alias("hi"), chance(d > 0).alias("p_better"), chance(d < 0).alias("p_worse"), chance(d >= bar).alias("p_bar"))


def half_splits(rows: DataFrame, stratum: str, seeds: int, key: str = "pair_id") -> DataFrame:
    """rows once for each seed with half (0 or 1): exact halves of each stratum, in the order of a hash.

    Counts of 1,024 ranges of the hash tell in which one a stratum's middle lies; only that one is sorted.
    """
    long = rows.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).withColumn("_h", portable_hash(key, F.col("seed")))
    long = long.withColumn("_range", F.shiftright("_h", 22).cast("int"))
    every = Window.partitionBy("seed", stratum)
    counts = long.groupBy("seed", stratum, "_range").agg(F.count("*").alias("_n"))
    counts = counts.withColumns({"_all": F.sum("_n").over(every), "_upto": F.sum("_n").over(every.orderBy("_range"))})
    counts = counts.select(F.col("seed").alias("_seed"), F.col(stratum).alias("_s"), F.col("_range").alias("_r"), (F.col("_upto") - F.col("_n")).alias("_before"), "_upto", (F.col("_all") / 2).alias("_middle"))
    long = long.join(F.broadcast(counts), (F.col("seed") == F.col("_seed")) & F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))  # 1,024 rows for each seed and stratum
    at_cut = (F.col("_before") < F.col("_middle")) & (F.col("_upto") > F.col("_middle"))
    own = F.row_number().over(Window.partitionBy("seed", stratum, "_range").orderBy("_h", key))
    sure = long.filter(~at_cut).withColumn("half", (F.col("_upto") > F.col("_middle")).cast("int"))
    near = long.filter(at_cut).withColumn("half", (F.col("_before") + own > F.col("_middle")).cast("int"))
    return sure.unionByName(near).select(*rows.columns, "seed", "half")


def apportioned(weights: DataFrame, total: int, name: str = "name", weight: str = "weight") -> DataFrame:
    """name, n: whole numbers that add up to total, by largest remainders (ties by name)."""
    every = Window.partitionBy(F.lit(0))  # one row for each name
    exact = F.col(weight) / F.sum(weight).over(every) * total
    one = weights.withColumns({"_n": F.floor(exact), "_r": exact - F.floor(exact)})
    place = F.row_number().over(every.orderBy(F.desc(F.round("_r", 9)), name))
    return one.select(name, (F.col("_n") + (place <= total - F.sum("_n").over(every)).cast("int")).cast("long").alias("n"))


def worker_quotas(spark, total: int, workers: int, cap: int | None = None) -> DataFrame:
    """worker, n: remainder-exact shares of a total, the first workers taking the rest, within a running cap."""
    n = F.floor(F.lit(total) / workers) + (F.col("id") < total % workers).cast("int")
    one = spark.range(workers).select(F.col("id").alias("worker"), n.alias("n"))
    if cap is None:
        return one.withColumn("n", F.col("n").cast("long"))
    upto = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("worker"))
    return one.select("worker", F.greatest(F.lit(0), F.least(F.col("n"), cap - (upto - F.col("n")))).cast("long").alias("n"))


def composition_plan(weights: DataFrame, total: int, levels: int, low: float, high: float, seed: int = 0, name: str = "name", weight: str = "weight") -> DataFrame:
    """place, name, level, value: one row for each of ``total`` items (a plan is as long as it is asked for).

    Shares by largest remainders; each name cycles through the levels, has a uniform value within the bounds,
    and its items are spread evenly over the plan.
    """
    some = apportioned(weights, total, name, weight).filter("n > 0")
    items = some.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    value = low + (high - low) * uniform(name, F.col("_i"), seed)
    order = Window.partitionBy(F.lit(0)).orderBy(F.round((F.col("_i") + 0.5) / F.col("n"), 9), name)
    return items.select((F.row_number().over(order) - 1).cast("long").alias("place"), name, (F.col("_i") % levels).cast("int").alias("level"), value.alias("value"))
