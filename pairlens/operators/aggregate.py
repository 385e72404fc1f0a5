"""Summaries of errors, breakdowns, verdicts and composition checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import stored

# fixed values: limits of a run's health, and error bands in pixels
ERROR_SHARE, FOUND_SHARE = 0.20, 0.30
ERROR_BANDS = ((1.0, "<=1"), (2.0, "1-2"), (3.0, "2-3"), (5.0, "3-5"))


#: What a sketch is asked for: shares are right to 1 / ACCURACY of the rows.
ACCURACY = 2000
#: A value's window: this far to both sides of the wanted share, twice what the sketch and rounding can be off. Keys with few rows are one window.
MARGIN, FEW = 4 / ACCURACY, 2000
SLICES = 1024  # of a window


def _around(keys: Sequence[str], rows: DataFrame, wanted: dict[str, list[float]], aggregates: Sequence[Column]) -> DataFrame:
    """keys, aggregates, and for value i its number of rows _n{i} and windows [_lo{i}[j], _hi{i}[j]] that hold its shares, from one pass."""
    out, ends = list(aggregates), []
    for i, (value, shares) in enumerate(wanted.items()):
        at = [max(0.0, p - MARGIN) for p in shares] + [min(1.0, p + MARGIN) for p in shares]
        out += [F.count(value).alias(f"_n{i}"), F.min(value).alias(f"_least{i}"), F.max(value).alias(f"_most{i}"), F.percentile_approx(value, at, ACCURACY).alias(f"_at{i}")]
        few, k = F.col(f"_n{i}") <= FEW, len(shares)
        ends.append(F.when(few, F.array(*[F.col(f"_least{i}")] * k)).otherwise(F.slice(f"_at{i}", 1, k)).alias(f"_lo{i}"))
        ends.append(F.when(few, F.array(*[F.col(f"_most{i}")] * k)).otherwise(F.slice(f"_at{i}", k + 1, k)).alias(f"_hi{i}"))
    one = rows.groupBy(*keys).agg(*out)
    return one.select(*(n for n in one.columns if not n.startswith(("_least", "_most", "_at"))), *ends)


def _bin(value: Column, i: int, k: int) -> tuple[Column, Column]:
    """A value's bin, which grows with it, cut by all ends of its k windows; and whether it lies in a window, the same for all of a bin."""
    lo, hi = ([F.col(f"{n}{i}")[j] for j in range(k)] for n in ("_lo", "_hi"))
    begun, ended = (sum((F.when(e, 1).otherwise(0) for e in es), F.lit(0)) for es in ([value >= x for x in lo], [value > x for x in hi]))
    return begun + ended, begun > ended


def _slice(value: Column, i: int, k: int) -> Column:
    """The place of a value inside a window among SLICES even parts of its bin."""
    lo, hi = ([F.col(f"{n}{i}")[j] for j in range(k)] for n in ("_lo", "_hi"))
    # next ends to both sides: the same for all values of a bin
    left = F.greatest(*(F.when(value >= x, x) for x in lo), *(F.when(value > x, x) for x in hi), F.lit(None).cast("double"))
    right = F.least(*(F.when(value < x, x) for x in lo), *(F.when(value <= x, x) for x in hi), F.lit(None).cast("double"))
    return F.coalesce(F.nanvl(F.floor((value - left) / F.nullif(right - left, F.lit(0.0)) * SLICES).cast("double"), F.lit(0.0)), F.lit(0.0)).cast("int")


def selected(rows: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]], aggregates: Sequence[Column] = (), nearest: Sequence[str] = ()) -> DataFrame:
    """keys, aggregates, and for each wanted name (column, share) that share's exact quantile of the key's values: linear
    interpolation, or for the names in nearest the value at index int(share * n); nulls left out, null keys are keys.

    Two passes over rows, whatever the number of keys, columns and shares. The first takes the aggregates and a
    sketch that bounds each share by a window of the key's own values; the second counts rows outside the windows by window
    and only inside by value. Counts of a window's slices tell in which one a rank lies, and only that one is sorted:
    a sort sees less than a 1,000th of a key's rows spread as they are in a window of 0.4 % of them.
    """
    shares = {v: sorted({p for w, p in wanted.values() if w == v}) for v in dict.fromkeys(v for v, _ in wanted.values())}
    values = list(shares)
    some = rows.withColumns({f"_v{i}": F.col(v).cast("double") for i, v in enumerate(values)})
    first = stored(_around(keys, some, {f"_v{i}": shares[v] for i, v in enumerate(values)}, aggregates), "windows")
    windows = first.select(*(F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)), *(f"_{n}{i}" for i in range(len(values)) for n in ("n", "lo", "hi")))
    on = F.lit(True)
    for j, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{j}"))
    met = some.join(windows, on) if keys else some.crossJoin(F.broadcast(windows))
    names = [f"_g{j}" for j in range(len(keys))]
    # in all columns at once: rows outside of all windows fall into few groups before anything is shuffled
    bins = [_bin(F.col(f"_v{i}"), i, len(shares[v])) for i, v in enumerate(values)]
    group = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)] + [e for i, (b, inside) in enumerate(bins) for e in (b.alias(f"_b{i}"), F.when(inside, F.col(f"_v{i}")).alias(f"_x{i}"), F.col(f"_v{i}").isNull().alias(f"_none{i}"))]
    few = met.select(*group).groupBy(*names, *(f"{n}{i}" for i in range(len(values)) for n in ("_b", "_x", "_none"))).agg(F.count("*").alias("_c"))
    each = F.explode(F.array(*(F.when(~F.col(f"_none{i}"), F.struct(F.lit(i).alias("i"), F.col(f"_b{i}").alias("bin"), F.col(f"_x{i}").alias("kept"))) for i in range(len(values)))))
    long = few.select(*names, "_c", each.alias("_p")).filter("_p is not null").select(*names, "_c", "_p.*").groupBy(*names, "i", "bin", "kept").agg(F.sum("_c").alias("_c"))
    at_key = F.lit(True)
    for j, n in enumerate(names):
        at_key = at_key & F.col(n).eqNullSafe(F.col(f"_k{j}"))
    part = F.lit(0)
    for i, v in enumerate(values):
        part = F.when(F.col("i") == i, _slice(F.col("kept"), i, len(shares[v]))).otherwise(part)
    long = long.join(windows, at_key) if keys else long.crossJoin(F.broadcast(windows))
    cells = stored(long.select(*names, "i", "bin", F.when(F.col("kept").isNull(), 0).otherwise(part).alias("slice"), "kept", "_c"), "cells")
    # one row for each slice of each bin
    upto = Window.partitionBy(*names, "i").orderBy("bin", "slice").rowsBetween(Window.unboundedPreceding, 0)
    slices = cells.groupBy(*names, "i", "bin", "slice").agg(F.sum("_c").alias("_s"))
    slices = slices.withColumn("_before", F.sum("_s").over(upto) - F.col("_s"))
    ranks = {}
    for name, (v, p) in wanted.items():
        i = values.index(v)
        n = F.col(f"_n{i}")
        place = F.lit(p) * (n - 1)
        ranks[name] = (i, (F.least(F.floor(F.lit(p) * n), n - 1),) if name in nearest else (F.floor(place), F.ceil(place)), place)
    asked = F.lit(False)
    for i, rs, _ in ranks.values():
        for r in rs:
            asked = asked | ((F.col("i") == i) & (r >= F.col("_before")) & (r < F.col("_before") + F.col("_s")))
    counts = windows.select(*(F.col(f"_k{j}") for j in range(len(keys))), *(f"_n{i}" for i in range(len(values))))
    sought = slices.join(counts, at_key) if keys else slices.crossJoin(F.broadcast(counts))
    sought = sought.filter(asked).select(*(F.col(n).alias(f"_s{n}") for n in (*names, "i", "bin", "slice")), "_before", *(f"_n{i}" for i in range(len(values))))
    same = F.lit(True)
    for n in (*names, "i", "bin", "slice"):
        same = same & F.col(n).eqNullSafe(F.col(f"_s{n}"))
    inside = Window.partitionBy(*names, "i", "bin", "slice").orderBy("kept").rowsBetween(Window.unboundedPreceding, 0)
    found = cells.join(sought, same).withColumn("_upto", F.col("_before") + F.sum("_c").over(inside))
    # a rank outside the windows would be a sketch worse than it promises
    kept = F.when(F.col("kept").isNull(), F.raise_error(F.lit("a sketch missed a rank")).cast("double")).otherwise(F.col("kept"))
    hit = lambda i, r: F.min(F.when((F.col("i") == i) & (F.col("_upto") > r) & (F.col("_upto") - F.col("_c") <= r), kept))
    picked = [hit(i, r).alias(f"_r_{name}_{k}") for name, (i, rs, _) in ranks.items() for k, r in enumerate(rs)]
    n_of = [F.first(f"_n{i}").alias(f"_n{i}") for i in range(len(values))]
    got = found.groupBy(*names).agg(*picked, *n_of)
    ends = lambda name: (F.col(f"_r_{name}_0"), F.col(f"_r_{name}_1"))
    final = [(F.col(f"_r_{name}_0") if name in nearest else ends(name)[0] + (place - F.floor(place)) * (ends(name)[1] - ends(name)[0])).alias(name) for name, (_, _, place) in ranks.items()]
    got = got.select(*(F.col(f"_g{j}").alias(k) for j, k in enumerate(keys)), *final)
    out = first.drop(*(f"_{n}{i}" for i in range(len(values)) for n in ("n", "lo", "hi")))
    return joined(out, got, keys) if keys else out.join(got, how="left") if out.columns else got


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], weight: Column | None = None) -> DataFrame:
    """keys, and for each name that share's quantile of the key's values: exact, with linear interpolation; nulls left out, and keys without values.

    A row stands for ``weight`` equal ones.
    """
    if weight is None:
        some = rows.filter(F.col(value).isNotNull())
        return selected(some, keys, {n: (value, p) for n, p in shares.items()})
    place = {n: F.lit(p) * (F.col("_all") - 1) for n, p in shares.items()}
    ranks = {f"_lo_{n}": F.floor(h) for n, h in place.items()} | {f"_hi_{n}": F.ceil(h) for n, h in place.items()}
    found = _weighted(rows, keys, value, ranks, weight)
    return found.select(*keys, *((F.col(f"_lo_{n}") + (h - F.floor(h)) * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n) for n, h in place.items()))


def nearest_rank(rows: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The value at index int(share * n) of the ascending values, for each named share; no interpolation."""
    return selected(rows.filter(F.col(value).isNotNull()), keys, {n: (value, p) for n, p in shares.items()}, nearest=list(shares))


def _weighted(rows: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column], weight: Column) -> DataFrame:
    """keys, and for each name the value at that place (from 0) of the key's ascending values; a rank may use ``_all``, their number.

    Rows stand for many, so a share of the rows is none of what they stand for: equal values are counted first, splitters that
    cut each key's distinct values evenly make buckets, sums of buckets tell in which one a place lies, and only that is sorted.
    """
    some = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), weight.alias("_w"))
    counts = some.groupBy(*keys, "_v").agg(F.sum("_w").alias("_n"))
    cuts = stored(counts.groupBy(*keys).agg(F.percentile_approx("_v", [k / 256 for k in range(1, 256)], 4096).alias("_cuts")), "cuts")
    counts = joined(counts, cuts, keys).withColumn("_bucket", F.size(F.filter(F.array_distinct("_cuts"), lambda x: x <= F.col("_v")))).drop("_cuts")
    every = Window.partitionBy(*keys, F.lit(0))  # one row for each bucket
    whole = counts.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_in"))
    whole = whole.withColumns({"_all": F.sum("_in").over(every), "_before": F.sum("_in").over(every.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_in")})
    here = F.lit(False)
    for r in ranks.values():
        here = here | ((r >= F.col("_before")) & (r < F.col("_before") + F.col("_in")))
    whole = whole.filter(here).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_bucket").alias("_b"), "_all", "_before")
    on = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.join(whole, on).withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
    at = lambda r: F.min(F.when((F.col("_upto") > r) & (F.col("_upto") - F.col("_n") <= r), F.col("_v")))
    return placed.groupBy(*keys).agg(*(at(r).alias(name) for name, r in ranks.items()), F.first("_all").alias("_all"))


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two tables of one row for each key, side by side; a null key is a key."""
    if not keys:
        return left.crossJoin(right)  # one row each
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(other[f"_r_{k}"])
    return left.join(other, on, "left").drop(*(f"_r_{k}" for k in keys))


def share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def summarize(rows: DataFrame, keys: Sequence[str], err: str = "err", within: Sequence[int] = (1, 2, 5, 10)) -> DataFrame:
    """keys, n, median, mean, p90, p99 and the share within each distance; missing errors are left out."""
    some = rows.filter(F.col(err).isNotNull())
    plain = [F.count("*").alias("n"), F.avg(err).alias("mean"), *(share(F.col(err) <= t).alias(f"acc{t}") for t in within)]
    both = selected(some, keys, {"median": (err, 0.5), "p90": (err, 0.9), "p99": (err, 0.99)}, plain)
    return both.select(*keys, "n", "median", "mean", "p90", "p99", *(f"acc{t}" for t in within))


def error_band(err: Column | str) -> Column:
    out = F.lit(">5")
    for bound, name in reversed(ERROR_BANDS):
        out = F.when((F.col(err) if isinstance(err, str) else err) <= bound, name).otherwise(out)
    return out


def breakdown(rows: DataFrame, by: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """One row for each value of each of ``by``, each taken alone: dimension, value, aggregates."""
    sets = rows.groupingSets([[b] for b in by], *by).agg(F.grouping_id().alias("_g"), *aggregates)
    n = len(by)
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, b in enumerate(by):
        alone = F.col("_g") == (1 << n) - 1 - (1 << (n - 1 - i))
        name, value = F.when(alone, b).otherwise(name), F.when(alone, F.col(b).cast("string")).otherwise(value)
    return sets.select(name.alias("dimension"), value.alias("value"), *(c for c in sets.columns if c not in (*by, "_g")))


def each_alone(rows: DataFrame, by: Mapping[str, Column], columns: Mapping[str, str] | None = None) -> DataFrame:
    """rows once for each dimension in ``by`` whose condition they meet, with its name and value as dimension and value.

    A dimension is the column of its name, or the one that ``columns`` gives.
    """
    one = (F.when(on, F.struct(F.lit(d).alias("d"), F.col((columns or {}).get(d, d)).cast("string").alias("v"))) for d, on in by.items())
    return rows.withColumn("_by", F.explode(F.array_compact(F.array(*one)))).withColumns({"dimension": F.col("_by.d"), "value": F.col("_by.v")}).drop("_by")


def cohens_d(rows: DataFrame, variables: Sequence[str], failed: str) -> DataFrame:
    """variable, d, n_fail, n_ok: standardised difference of failures and successes; null below two of either."""
    long = rows.select(F.col(failed).alias("_f"), F.inline(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in variables)))).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    on = lambda k, e: F.when(F.col("_f") == k, e)
    one = long.groupBy("variable").agg(*(f(on(k, F.col("x"))).alias(f"{n}{k}") for k in (0, 1) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    pooled = F.sqrt(((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / (F.col("n0") + F.col("n1") - 2))
    d = F.when((F.col("n0") >= 2) & (F.col("n1") >= 2) & (pooled > 0), (F.col("m1") - F.col("m0")) / pooled)
    return one.select("variable", d.alias("d"), F.col("n1").alias("n_fail"), F.col("n0").alias("n_ok"))


def strictly_rising(rows: DataFrame, keys: Sequence[str], level: str, value: str) -> DataFrame:
    """keys, rising: whether value grows from each level to the next (few levels for each key)."""
    order = Window.partitionBy(*keys, F.lit(0)).orderBy(level)
    step = rows.withColumn("_up", F.col(value) > F.lag(value).over(order))
    return step.groupBy(*keys).agg(F.bool_and(F.coalesce("_up", F.lit(True))).alias("rising"))


def health(rows: DataFrame, keys: Sequence[str], failed: str, found: str) -> DataFrame:
    """keys, n, errors, found, reasons: why a run doesn't look like a successful one (empty if it does)."""
    one = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(failed) == 1).alias("errors"), F.count_if(F.col(found) == 1).alias("found"))
    reasons = F.array_compact(F.array(F.when(F.col("errors") / F.col("n") >= ERROR_SHARE, "errors"), F.when(F.col("found") / F.col("n") < FOUND_SHARE, "few found")))
    return one.withColumn("reasons", F.array_join(reasons, " | "))


def status_rollup(findings: DataFrame, key: str, status: str = "status", reason: str = "reason") -> DataFrame:
    """key, status (the worst of OK, WARN, FAIL), reasons joined in order; distinct reasons only."""
    rank = F.when(F.col(status) == "FAIL", 2).when(F.col(status) == "WARN", 1).otherwise(0)
    some = F.array_sort(F.collect_set(F.when(rank > 0, F.col(reason))))
    one = findings.groupBy(key).agg(F.max(rank).alias("_r"), F.concat_ws(" | ", some).alias("reasons"))
    return one.select(key, F.when(F.col("_r") == 2, "FAIL").when(F.col("_r") == 1, "WARN").otherwise("OK").alias("status"), "reasons")


def folded_normal_mean(mu: Column, sigma: Column | float) -> Column:
    """Mean of |N(mu, sigma)|, with the error function by a fixed rational approximation (error under 2e-7)."""
    sigma = sigma if isinstance(sigma, Column) else F.lit(sigma)
    z = mu / sigma / F.sqrt(F.lit(2.0))
    a = F.abs(z)
    t = 1 / (1 + 0.3275911 * a)
    # fixed values: a standard approximation of the error function
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = F.signum(z) * (1 - poly * F.exp(-a * a))
    return sigma * F.sqrt(F.lit(2 / 3.141592653589793)) * F.exp(-z * z) + mu * erf


def digest(columns: Sequence[str]) -> Column:
    """An order-independent digest of a group's rows: sums of two halves of their md5."""
    text = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)))
    half = lambda at: F.sum(F.conv(F.substring(text, at, 8), 16, 10).cast("long"))
    return F.concat_ws(":", half(1), half(9))
