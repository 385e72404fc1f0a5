"""Fits of confidence models; every pass over the rows is one distributed aggregate."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from ..sources.io import stored
from . import score as s
from .passes import added


def scaling(rows: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature (deviation 1 where it is 0); missing values count as 0."""
    one = rows.agg(*(f(c.zero_if_missing(x)).alias(f"{n}{i}") for i, x in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {x: (one[f"m{i}"] or 0.0, one[f"s{i}"] or 1.0) for i, x in enumerate(features)}


def _scaled(scale: Mapping[str, tuple[float, float]]) -> list[Column]:
    return [(c.zero_if_missing(x) - m) / d for x, (m, d) in scale.items()]


def logistic(rows: DataFrame, features: Sequence[str], label: str, l2: float = 1e-3, iterations: int = 200) -> dict:
    """Standardised logistic regression with a ridge on the weights (not the intercept).

    Returns scale, weights (standardised), bias and the objective's history.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    scale = scaling(rows, features)
    names = [f"_z{i}" for i in range(len(features))]
    data = rows.select(F.col(label).cast("double").alias("label"), *(e.alias(n) for e, n in zip(_scaled(scale), names, strict=True)))
    data = VectorAssembler(inputCols=names, outputCol="features").transform(data).select("label", "features")
    model = LogisticRegression(regParam=l2, elasticNetParam=0.0, standardization=False, maxIter=iterations, tol=1e-10).fit(data)
    return {"scale": scale, "weights": list(model.coefficients), "bias": float(model.intercept), "history": list(model.summary.objectiveHistory)}


def raw_weights(model: dict) -> tuple[dict[str, float], float]:
    """Weights and bias for unscaled features."""
    raw = {x: w / d for w, (x, (_, d)) in zip(model["weights"], model["scale"].items(), strict=True)}
    return raw, model["bias"] - sum(raw[x] * m for x, (m, _) in model["scale"].items())


def predicted(model: dict) -> Column:
    z = F.lit(model["bias"])
    for w, e in zip(model["weights"], _scaled(model["scale"]), strict=True):
        z = z + w * e
    return c.sigmoid(z)


def predicted_raw(weights: Mapping[str, float], bias: float) -> Column:
    z = F.lit(bias)
    for x, w in weights.items():
        z = z + w * c.zero_if_missing(x)
    return c.sigmoid(z)


def newton(rows: DataFrame, features: Sequence[str], label: str, ridge: float = 1e-6, steps: int = 25, tolerance: float = 1e-10) -> dict:
    """Logistic regression by Newton steps: k(k+1)/2 weighted sums a step in Spark, a k x k solve on the driver."""
    scale = scaling(rows, features)
    names = [f"_z{i}" for i in range(len(features) + 1)]
    data = rows.select(F.col(label).cast("double").alias("_y"), *(e.alias(n) for e, n in zip(_scaled(scale), names, strict=False)), F.lit(1.0).alias(names[-1]))
    data = stored(data)
    k, w = len(names), np.zeros(len(features) + 1)
    for _ in range(steps):
        p = c.sigmoid(sum((float(x) * F.col(n) for x, n in zip(w, names, strict=True)), F.lit(0.0)))
        pq = p * (1 - p)
        sums = data.agg(*(F.sum(pq * F.col(names[i]) * F.col(names[j])).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)), *(F.sum((F.col("_y") - p) * F.col(n)).alias(f"g{i}") for i, n in enumerate(names))).first()
        h = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + ridge * np.eye(k)
        step = np.linalg.solve(h, np.array([sums[f"g{i}"] for i in range(k)]) - ridge * w)
        w = w + step
        if np.abs(step).max() < tolerance:
            break
    return {"scale": scale, "weights": w[:-1].tolist(), "bias": float(w[-1])}


def trace(rows: DataFrame, model: dict, label: str) -> dict[str, float]:
    """Gradient norm and mean log-loss of a fit, by one aggregate."""
    p, y = predicted(model), F.col(label).cast("double")
    one = rows.agg(F.avg(c.log_loss(p, label)).alias("loss"), F.avg(p - y).alias("g"), *(F.avg((p - y) * e).alias(f"g{i}") for i, e in enumerate(_scaled(model["scale"])))).first()
    return {"loss": one["loss"], "gradient": float(np.sqrt(sum(v * v for k, v in one.asDict().items() if k != "loss")))}


def fitted(rows: DataFrame, wanted: Mapping[Hashable, tuple[Sequence[str], Column]], label: str, l2: float = 1e-3, steps: int = 40, tolerance: float = 1e-9, weight: str | None = None) -> dict[Hashable, dict]:
    """A standardised logistic fit for each wanted (features, rows to learn from), with a ridge on the weights (not the bias) of the mean loss.

    All fits go side by side by Newton steps: rows are written once, and one pass takes the normal equations of every
    fit that isn't done. Fits that are given the same column object share its rows. A model has scale, weights, bias and its
    trace: gradient norm, largest step and mean log-loss at the start of each step. Missing values count as 0; weight is how
    many rows a row stands for.
    """
    features = list(dict.fromkeys(x for xs, _ in wanted.values() for x in xs))
    sides = {id(on): on for _, on in wanted.values()}
    turn = {name: list(sides).index(id(on)) for name, (_, on) in wanted.items()}
    one = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    data = stored(rows.select(*(c.zero_if_missing(x).cast("double").alias(f"_x{i}") for i, x in enumerate(features)), F.col(label).cast("double").alias("_y"), one.alias("_w"), *(F.coalesce(on, F.lit(False)).alias(f"_on{i}") for i, on in enumerate(sides.values()))), "fit")
    places = {name: [features.index(x) for x in xs] for name, (xs, _) in wanted.items()}
    k, n_sides = len(features), len(sides)

    def read(batch):
        number = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(k + 2)]
        return np.column_stack(number[:k]) if k else np.zeros((len(batch), 0)), *number[k:]

    def taken(batch, i):
        return batch.column(k + 2 + i).to_numpy(zero_copy_only=False)

    def run_sums(it):
        total = np.zeros((n_sides, 1 + 2 * k))
        for batch in it:
            x, _, w = read(batch)
            for i in range(n_sides):
                on = taken(batch, i)
                z, v = x[on], w[on]
                total[i] += np.concatenate([[v.sum()], v @ z, v @ (z * z)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    first = added(data.mapInArrow(run_sums, "s binary")).reshape(n_sides, 1 + 2 * k)
    n, mean = np.maximum(first[:, 0], 1), first[:, 1 : 1 + k] / np.maximum(first[:, :1], 1)
    spread = np.sqrt(np.maximum(first[:, 1 + k :] / n[:, None] - mean**2, 0))
    spread[spread <= 1e-12 * np.maximum(np.abs(mean), 1)] = 1.0
    weights, traces, todo = {name: np.zeros(len(p) + 1) for name, p in places.items()}, {name: [] for name in places}, list(places)

    def equations(now, at):
        sizes = [len(places[name]) + 1 for name in now]

        def run(it):
            total = [np.zeros(m * m + m + 1) for m in sizes]
            for batch in it:
                x, y, w = read(batch)
                for i in {turn[name] for name in now}:
                    on = taken(batch, i)
                    every, own, v = np.column_stack([(x[on] - mean[i]) / spread[i], np.ones(int(on.sum()))]), y[on], w[on]
                    for j, name in enumerate(now):
                        if turn[name] == i:
                            z = every[:, [*places[name], k]]
                            t = z @ at[name]
                            q = 1 / (1 + np.exp(-t))
                            loss = v @ (np.logaddexp(0, t) - own * t)
                            total[j] += np.concatenate([((z * (v * q * (1 - q))[:, None]).T @ z).ravel(), z.T @ (v * (q - own)), [loss]])
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(total).tobytes()], pa.binary())], ["s"])

        got, out = added(data.mapInArrow(run, "s binary")), {}
        for name, m in zip(now, sizes, strict=True):
            one, got = got[: m * m + m + 1], got[m * m + m + 1 :]
            out[name] = one[: m * m].reshape(m, m), one[m * m : -1], one[-1]
        return out

    for _ in range(steps):
        if not todo:
            break
        for name, (h, g, loss) in equations(todo, weights).items():
            rows_of, own = n[turn[name]], np.r_[np.full(len(places[name]), l2), 0.0]
            g, h = g / rows_of + own * weights[name], h / rows_of + np.diag(own)
            step = -np.linalg.lstsq(h, g, rcond=None)[0]
            traces[name].append((float(np.linalg.norm(g)), float(np.abs(step).max()), float(loss / rows_of)))
            weights[name] = weights[name] + step
        todo = [name for name in todo if traces[name][-1][1] >= tolerance]
    scale = lambda name: {x: (float(mean[turn[name], p]), float(spread[turn[name], p])) for x, p in zip(wanted[name][0], places[name], strict=True)}
    return {name: {"scale": scale(name), "weights": w[:-1].tolist(), "bias": float(w[-1]), "trace": traces[name]} for name, w in weights.items()}


def f1_ceiling(rows: DataFrame, value: Column, present: str = "gt_found") -> DataFrame:
    """best, threshold: the highest reject-positive F1 that any threshold on a fitted value reaches on the same rows."""
    data = rows.select(value.alias("score"), F.when(F.col(present) == 1, 1).otherwise(0).alias("present"), F.when(F.col(present) == 1, 0).otherwise(1).alias("absent"))
    swept = s.running(s.histogram(data, [], ("present", "absent")), [], ("present", "absent"))
    swept = swept.withColumn("f1", s.f1(F.col("all_absent") - F.col("ge_absent"), F.col("all_present") - F.col("ge_present"), F.col("ge_absent")))
    return s.best(swept, [], "f1")


def each_fold(build: Callable[[DataFrame], Column]) -> Callable[[DataFrame, Mapping[int, Column]], dict[int, Column]]:
    """A builder of all folds' statistics from one that sees the training rows of a single fold."""
    return lambda rows, training: {k: build(rows.filter(on)) for k, on in training.items()}


def _held(rows: DataFrame, values: Mapping[tuple[str, int], Column], fold: str) -> DataFrame:
    """name, fold, threshold, auc, held_total, held_f1: for each (name, fold) a statistic of its own, the threshold that is best on the
    other folds, and what it earns on the fold; all of them from one histogram, read once. rows are of the sets A, B and C and have
    the histogram's measures, or sums of them."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(k).alias("of"), e.alias("value")) for (name, k), e in values.items())))
    some = rows.select(F.col(fold).alias("_f"), *s.MEASURES, each.alias("_s"))
    long = some.select("_s.name", "_s.of", (F.col("_f") == F.col("_s.of")).alias("held"), F.col("_s.value").alias("score"), *s.MEASURES)
    hist = stored(s.histogram(long, ["name", "of", "held"]), "held")
    train, test = (s.sweep_hist(hist.filter(on).drop("held"), ["name", "of"]) for on in ("not held", "held"))
    chosen = s.best(train.withColumn("total", F.round("total", 9)), ["name", "of"]).select("name", "of", "threshold")
    at = test.join(chosen, ["name", "of"]).filter("score >= threshold")
    return at.groupBy("name", F.col("of").alias("fold"), "threshold").agg(F.first("auc").alias("auc"), F.min_by("total", "score").alias("held_total"), F.min_by("f1", "score").alias("held_f1"))


def cross_validated(rows: DataFrame, build: Callable[[DataFrame, Mapping[int, Column]], Mapping[int, Column]], folds: int = 4, fold: str = "fold") -> DataFrame:
    """fold, threshold, held_total, held_f1: build(rows, training condition of each fold) gives each fold's statistic; its threshold comes
    from the training rows alone. A builder of one fold at a time goes through ``each_fold``."""
    values = build(rows, {k: F.col(fold) != k for k in range(folds)})
    return _held(rows.filter(F.col("grp").isin("A", "B", "C")), {("", k): e for k, e in values.items()}, fold).select("fold", "threshold", "held_total", "held_f1")


def compared(rows: DataFrame, sets: Mapping[str, Sequence[str]], label: str, fold: str, least: float = 0.5) -> DataFrame:
    """name, eligible, auc, held_total, held_f1: a standardised logistic fit of each named feature set on the other folds,
    with the threshold that is best there, and what both earn on the fold, as the mean over folds (auc: over all rows, each
    scored by the fit that hasn't seen it); a set is eligible if all its columns exist and are finite often enough. rows come from measured().

    Rows alike in fold, label and features are added up first, in one pass, and stand as one row with its sums. The fits of all
    sets and folds share their passes over these, and so do their sweeps.
    """
    wanted = sorted({x for xs in sets.values() for x in xs})
    usable = {r["feature"] for r in c.available(rows, wanted, least).collect() if r["usable"]}
    good = {name: xs for name, xs in sets.items() if usable.issuperset(xs)}
    table = rows.sparkSession.createDataFrame([(name, name in good) for name in sets], "name string, eligible boolean")
    if not good:
        return table.select("name", "eligible", *(F.lit(None).cast("double").alias(k) for k in ("auc", "held_total", "held_f1")))
    at = {x: f"_f{i}" for i, x in enumerate(sorted({x for xs in good.values() for x in xs}))}
    gray = F.col("grp").isin("A", "B", "C")
    alike = (F.col(fold).alias("_fold"), F.col(label).alias("_label"), *(c.zero_if_missing(x).alias(n) for x, n in at.items()))
    some = rows.select(*alike, *(F.when(gray, F.col(m)).otherwise(0).alias(m) for m in s.MEASURES))
    cells = stored(some.groupBy("_fold", "_label", *at.values()).agg(F.count("*").alias("_rows"), *(F.sum(m).alias(m) for m in s.MEASURES)), "cells")
    others = {r[0]: F.col("_fold") != r[0] for r in cells.select("_fold").distinct().collect()}  # a few folds
    models = fitted(cells, {(name, k): ([at[x] for x in xs], on) for name, xs in good.items() for k, on in others.items()}, "_label", weight="_rows")
    values = {of: predicted(m) for of, m in models.items()}
    mean = _held(cells.filter("n > 0"), values, "_fold").groupBy("name").agg(F.avg("held_total").alias("held_total"), F.avg("held_f1").alias("held_f1"))
    own = lambda name: F.coalesce(*(F.when(F.col("_fold") == k, values[name, k]) for k in others))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), own(name).alias("score")) for name in good)))
    signs = (F.when(F.col("_label") == 1, F.col("_rows")).otherwise(0).alias("_pos"), F.when(F.col("_label") == 1, 0).otherwise(F.col("_rows")).alias("_neg"))
    ranked = s.auc_of(s.histogram(cells.select(*signs, each.alias("_s")).select("_s.*", "_pos", "_neg"), ["name"], ("_pos", "_neg")), ["name"])
    return table.join(ranked, "name", "left").join(mean, "name", "left").select("name", "eligible", "auc", "held_total", "held_f1")
