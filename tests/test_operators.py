"""Operators on small hand-made tables with known answers."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.functions import columns as c
from pairlens.operators import aggregate, batch, boost, fit, hypotheses, joins, passes, sample, score, spatial
from pairlens.plans import fixtures
from pairlens.sources import io
from pairlens.streaming import streams


def values(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_tiers_are_inclusive_and_null_earns_nothing(spark):
    df = spark.createDataFrame([(1.0,), (1.0001,), (5.0,), (5.1,), (None,)], "e double")
    assert [r[0] for r in df.select(c.tier("e", c.LOCATION_TIERS)).collect()] == [1.0, 0.8, 0.4, 0.0, 0.0]


def test_nan_never_passes_a_threshold_or_a_gate(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (0.9, float("inf")), (0.9, 0.9)], "score double, zncc double").withColumns({k: F.lit(1.0) for k in ("x", "y", "theta", "scale")} | {"peak_ratio": F.lit(0.1)})
    assert [r[0] for r in df.select(c.decide(0.5)["found"]).collect()] == [0, 1, 1]
    assert [r[0] for r in df.select(c.early_exit([(0.5, 0.5, 0.5, None)])).collect()] == [False, False, True]


def test_sigmoid_and_missing_features(spark):
    df = spark.createDataFrame([(-800.0,), (0.0,), (800.0,), (None,)], "z double")
    assert [r[0] for r in df.select(c.sigmoid(F.col("z"))).collect()[:3]] == [0.0, 0.5, 1.0]
    assert [r[0] for r in df.select(c.logistic_score({"z": 1.0}, 0.0, df.columns)).collect()][-1] == 0.0
    with pytest.raises(KeyError):
        c.logistic_score({"q": 1.0}, 0.0, df.columns)


def test_auc_equals_all_pairs_with_ties(spark):
    rng = np.random.default_rng(0)
    s, y = rng.integers(0, 20, 300) / 20.0, rng.integers(0, 2, 300)
    got = score.auc(spark.createDataFrame([("k", float(a), int(b)) for a, b in zip(s, y, strict=True)], "k string, score double, y int"), ["k"], "y").first()["auc"]
    a, b = s[y == 1], s[y == 0]
    assert abs(got - ((a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean())) < 1e-12
    one = spark.createDataFrame([("k", 0.5, 1)], "k string, score double, y int")
    assert score.auc(one, ["k"], "y").first()["auc"] is None


def test_sweep_equals_rubric_at_each_threshold(spark, sf):
    from pairlens.plans.fixtures import view

    rows = score.measured(view(spark, sf, "v1"))
    swept = {r["score"]: r for r in score.sweep(rows, []).collect()}
    for t in sorted(swept)[:: max(1, len(swept) // 5)]:
        one = score.rubric(rows, [], t, empty=0.0).first()
        assert abs(one["total"] - swept[t]["total"]) < 1e-9 and abs(one["f1"] - swept[t]["f1"]) < 1e-12


def test_refusing_everything_earns_no_localisation(spark, sf):
    from pairlens.plans.fixtures import view

    one = score.rubric(score.measured(view(spark, sf, "v1")), [], 2.0, empty=0.0).first()
    assert one["loc"] == 0 and one["scale"] == 0 and one["rot"] == 0 and one["f1"] > 0


def test_greedy_clusters_and_votes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [(float(s), float(x), float(y)) for s, x, y in zip(rng.integers(1, 99, 9) / 100, rng.integers(0, 30, 9), rng.integers(0, 30, 9), strict=True)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, p array<struct<score:double,x:double,y:double>>").select("id", hypotheses.clustered(F.col("p")).alias("k"))
    got = {r["id"]: r for r in df.select("id", F.size("k").alias("n"), *(hypotheses.voted(F.col("k"), r).alias(r) for r in hypotheses.RULES)).collect()}
    for i, ps in rows:
        clusters = []
        for p in sorted(ps, reverse=True):
            for k in clusters:
                if np.hypot(p[1] - k[0][1], p[2] - k[0][2]) <= 6:
                    k.append(p)
                    break
            else:
                clusters.append([p])
        assert got[i]["n"] == len(clusters)
        best = max(clusters, key=lambda k: (round(sum(p[0] for p in k), 9), len(k)))
        w = [p[0] for p in best]
        assert abs(got[i]["sum"]["x"] - np.average([p[1] for p in best], weights=w)) < 1e-9
        assert got[i]["top1"]["x"] == clusters[0][0][1]


def test_winner_margin_of_single_candidates_is_null(spark):
    df = spark.createDataFrame([(1, 0, 0.9, 0.8), (2, 0, 0.9, 0.5), (2, 1, 0.7, 0.6)], "pair_id int, hypothesis_index int, rank_score double, zncc double").withColumns({"band_score": F.lit(0.0), "dog_score": F.lit(0.0)})
    got = dict(values(hypotheses.winner_margin(df, hypotheses.winners(df)), "pair_id", "margin"))
    assert got[1] is None and abs(got[2] - 0.1) < 1e-12


def test_suppressed_top(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.permutation(30).astype(float).tolist()) for i in range(20)]
    got = dict(values(spark.createDataFrame(rows, "i int, v array<double>").select("i", spatial.suppressed_top(F.col("v"), 4).alias("t")), "i", "t"))
    for i, v in rows:
        want = []
        for p in sorted(range(30), key=lambda p: -v[p]):
            if len(want) < 4 and all(abs(p - q) > 3 for q in want):
                want.append(p)
        assert got[i] == want


def test_band_join_equals_nested_loop(spark):
    rng = np.random.default_rng(0)
    a, b = ([(i, int(k), float(x), float(y)) for i, (k, x, y) in enumerate(zip(rng.integers(0, 3, 80), rng.uniform(-20, 20, 80), rng.uniform(-20, 20, 80), strict=True))] for _ in range(2))
    left, right = spark.createDataFrame(a, "i int, k int, x double, y double"), spark.createDataFrame(b, "j int, k int, u double, v double")
    got = sorted(values(joins.band_join(left, right, ["k"], [("x", "u", 2.5), ("y", "v", 4.0)]), "i", "j"))
    assert got == sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and abs(p[2] - q[2]) <= 2.5 and abs(p[3] - q[3]) <= 4)


def test_plane_and_huber_fits(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(3):
        for i in range(60):
            x, y = rng.uniform(0, 10, 2)
            rows.append((k, float(x), float(y), float((k + 1) * x - 2 * y + 5 + rng.normal(0, 0.01) + (40 if i % 10 == 0 else 0))))
    df = spark.createDataFrame(rows, "k int, x double, y double, z double")
    for r in spatial.plane_fit(df, "k", "x", "y", "z").collect():
        assert np.allclose([r["a"], r["b"], r["c"]], [r["k"] + 1, -2, 5], atol=0.02)
    for r in spatial.huber_fit(df, "k", ["x", "y"], "z", rounds=8).collect():
        assert np.allclose(r["weights"], [r["k"] + 1, -2, 5], atol=0.6)


def test_newton_and_logistic_agree(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    y = rng.random(400) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1] + 0.3)))
    df = spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(x, y, strict=True)], "a double, b double, y int")
    n = fit.newton(df, ["a", "b"], "y")
    assert fit.trace(df, n, "y")["gradient"] < 1e-6
    gap = df.agg(F.max(F.abs(fit.predicted(n) - fit.predicted(fit.logistic(df, ["a", "b"], "y"))))).first()[0]
    assert gap < 0.02
    assert df.agg(F.max(F.abs(fit.predicted(n) - fit.predicted_raw(*fit.raw_weights(n))))).first()[0] < 1e-9


def by_newton(x, y, l2, steps=40):
    """Means and deviations, weights and bias, and the trace of a ridge logistic fit in numpy."""
    mean, dev = x.mean(0), x.std(0)
    z, w, trace = np.column_stack([(x - mean) / np.where(dev > 0, dev, 1), np.ones(len(x))]), np.zeros(x.shape[1] + 1), []
    own = np.r_[np.full(x.shape[1], l2), 0.0]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ w))
        g, h = z.T @ (p - y) / len(y) + own * w, (z * (p * (1 - p))[:, None]).T @ z / len(y) + np.diag(own)
        step = -np.linalg.solve(h, g)
        trace.append((np.linalg.norm(g), np.abs(step).max(), -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))))
        w = w + step
        if trace[-1][1] < 1e-9:
            break
    return w, trace


def test_fits_of_many_sets_and_folds_share_their_passes(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x, fold = rng.normal(size=(500, 3)) * [1, 5, 0.1] + [0, 3, 1], rng.integers(0, 3, 500)
    y = (rng.random(500) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.3 * x[:, 1] + 1)))).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(t), int(k)) for r, t, k in zip(x, y, fold, strict=True)], "a double, b double, c double, y int, fold int").repartition(4)
    passed, keep = [], fit.added
    monkeypatch.setattr(fit, "added", lambda parts: (passed.append(1), keep(parts))[1])
    wanted = {(name, k): (xs, F.col("fold") != k) for name, xs in {"a": ["a"], "ab": ["a", "b"], "all": ["a", "b", "c"]}.items() for k in range(3)}
    got = fit.fitted(df, wanted, "y")
    longest = 0
    for (name, k), model in got.items():
        at = ["abc".index(n) for n in ("abc" if name == "all" else name)]
        w, trace = by_newton(x[fold != k][:, at], y[fold != k], 1e-3)
        assert np.allclose([*model["weights"], model["bias"]], w, atol=1e-8)
        assert len(model["trace"]) == len(trace) and np.allclose(model["trace"], trace, atol=1e-9)
        longest = max(longest, len(trace))
    assert len(passed) == longest + 1  # means and deviations, then one pass a step for all nine


def test_feature_sets_are_compared_on_held_out_folds(spark, sf):
    from pairlens.plans.fixtures import view

    rows = score.measured(view(spark, sf, "v1")).withColumn("fold", (F.col("pair_id") % 2).cast("int"))
    got = {r["name"]: r for r in fit.compared(rows, {"one": ["score"], "none": ["score", "zz"]}, "gt_found", "fold").collect()}
    assert got["one"]["eligible"] and 0 < got["one"]["held_total"] <= 85 and not got["none"]["eligible"] and got["none"]["held_f1"] is None
    # by hand: the other fold's fit and best threshold, on the fold
    for k in (0, 1):
        model = fit.fitted(rows, {0: (["score"], F.col("fold") != k)}, "gt_found")[0]
        rows_k = rows.withColumn("score", fit.predicted(model))
        t = score.best(score.sweep(rows_k.filter(F.col("fold") != k), []).withColumn("total", F.round("total", 9)), []).first()["threshold"]
        one = score.rubric(rows_k.filter(F.col("fold") == k), [], t, empty=0.0).first()
        got[k] = (one["total"], one["f1"])
    assert abs(np.mean([got[k][0] for k in (0, 1)]) - got["one"]["held_total"]) < 1e-6 and abs(np.mean([got[k][1] for k in (0, 1)]) - got["one"]["held_f1"]) < 1e-9
    # the same folds by a callback that builds one fold's statistic at a time
    own = {r["fold"]: r for r in fit.cross_validated(rows, fit.each_fold(lambda train: fit.predicted(fit.fitted(train, {0: (["score"], F.lit(True))}, "gt_found")[0])), 2).collect()}
    assert all(abs(own[k]["held_total"] - got[k][0]) < 1e-6 and abs(own[k]["held_f1"] - got[k][1]) < 1e-9 for k in (0, 1))


def test_feature_sets_read_rows_alike_once(spark, sf, monkeypatch):
    """Rows alike in fold, label and features are added up before the fits, and earn what they earn one by one."""
    from pairlens.plans.fixtures import view

    rows = score.measured(view(spark, sf, "v1").limit(300)).withColumns({"fold": (F.col("pair_id") % 2).cast("int"), "zncc": F.when(F.col("pair_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("zncc"))})
    rows = rows.localCheckpoint()
    sets = {"one": ["score"], "two": ["score", "zncc"], "none": ["score", "zz"]}
    plain = {r["name"]: r for r in fit.compared(rows, sets, "gt_found", "fold").collect()}
    seen, keep = [], fit.fitted

    def counted(data, *args, **kwargs):
        seen.append(data.count())
        return keep(data, *args, **kwargs)

    monkeypatch.setattr(fit, "fitted", counted)
    many = rows.crossJoin(spark.range(40)).drop("id")
    got = {r["name"]: r for r in fit.compared(many, sets, "gt_found", "fold").collect()}
    assert len(seen) == 1 and seen[0] <= 300
    for name, want in plain.items():
        assert got[name]["eligible"] == want["eligible"]
        for k in ("auc", "held_total", "held_f1"):
            assert got[name][k] == want[k] if want[k] is None else abs(got[name][k] - want[k]) < 1e-9
    # ranks by hand: each row by the fit of the other fold, pairs of labels compared one by one
    models = {k: keep(rows, {0: (["score"], F.col("fold") != k)}, "gt_found")[0] for k in (0, 1)}
    value = F.when(F.col("fold") == 0, fit.predicted(models[0])).otherwise(fit.predicted(models[1]))
    own = [(r[0], r[1]) for r in rows.select("gt_found", F.round(value, 12)).collect()]
    a, b = (np.array([v for y, v in own if y == side]) for side in (1, 0))
    assert abs(((a[:, None] > b) + 0.5 * (a[:, None] == b)).mean() - plain["one"]["auc"]) < 1e-9


def test_weights_of_a_fit_are_repeated_rows(spark):
    rows = [(0.1, 0, 3), (0.4, 1, 1), (0.5, 0, 2), (0.9, 1, 4), (None, 1, 1), (float("nan"), 0, 2)]
    df = spark.createDataFrame(rows, "a double, y int, n int")
    wanted = {"all": (["a"], F.lit(True)), "some": (["a"], F.col("a") > 0.2)}  # null: not learned from
    got = fit.fitted(df, wanted, "y", weight="n")
    each = fit.fitted(df.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("n")))), wanted, "y")
    for name in wanted:
        assert np.allclose([*got[name]["weights"], got[name]["bias"]], [*each[name]["weights"], each[name]["bias"]], atol=1e-9)
        assert np.allclose(got[name]["trace"], each[name]["trace"], atol=1e-9)


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(k, float(x)) for k, n in (("a", 1), ("b", 2), ("c", 700), (None, 31)) for x in np.round(rng.normal(size=n), 2)] + [("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r for r in aggregate.quantiles(df, ["k"], "v", {"p0": 0.0, "p37": 0.37, "mid": 0.5, "p1": 1.0}).collect()}
    assert set(got) == {"a", "b", "c", None}
    for k, r in got.items():
        own = [x for q, x in rows if q == k]
        assert np.allclose([r["p0"], r["p37"], r["mid"], r["p1"]], np.quantile(own, [0, 0.37, 0.5, 1]))
    all_ = [x for _, x in rows if x is not None]
    assert np.isclose(aggregate.quantiles(df, [], "v", {"q": 0.9}).first()["q"], np.quantile(all_, 0.9))
    weighted = aggregate.quantiles(spark.createDataFrame([(1.0, 3), (5.0, 1)], "v double, n int"), [], "v", {"q": 0.5}, F.col("n")).first()["q"]
    assert weighted == 1.0
    near = aggregate.nearest_rank(df, ["k"], "v", {"q": 0.9}).filter("k = 'c'").first()["q"]
    assert near == sorted(x for q, x in rows if q == "c")[int(0.9 * 700)]
    assert aggregate.quantiles(df.limit(0), ["k"], "v", {"q": 0.5}).count() == 0


def test_quantiles_of_narrow_ranges_need_small_sorts(spark, monkeypatch):
    """Seconds of one day and scores near 1: all keys, columns and shares at once, and no sort sees 1 % of a key's rows."""
    rng, n = np.random.default_rng(5), 60_000
    when, near = 1.7e9 + rng.random(n) * 86_400, 1 - rng.random(n) ** 2 / 20
    spike = np.where(rng.random(n) < 0.7, 0.25, rng.normal(size=n))
    key = np.where(np.arange(n) < n // 3, "hot", "other")
    df = spark.createDataFrame(list(zip(key.tolist(), when.tolist(), near.tolist(), spike.tolist())), "k string, t double, s double, v double").repartition(6).cache()
    wanted = {"t50": ("t", 0.5), "t99": ("t", 0.99), "s01": ("s", 0.001), "s50": ("s", 0.5), "s51": ("s", 0.5005), "v50": ("v", 0.5), "v90": ("v", 0.9), "vr": ("v", 0.9), "top": ("t", 1.0)}
    got = {r["k"]: r for r in aggregate.selected(df, ["k"], wanted, [F.count("*").alias("n"), F.max("t").alias("last")], ["vr"]).collect()}
    for k, r in got.items():
        own = {"t": when[key == k], "s": near[key == k], "v": spike[key == k]}
        assert r["n"] == len(own["t"]) and r["last"] == own["t"].max()
        for name, (v, p) in wanted.items():
            want = np.sort(own[v])[int(p * len(own[v]))] if name == "vr" else np.quantile(own[v], p)
            assert np.isclose(r[name], want, rtol=1e-14, atol=0)
    first = aggregate._around(["k"], df, {"t": [0.5], "s": [0.5]}, [])
    for i, v in enumerate("ts"):
        in_bin, inside = aggregate._bin(F.col(v), i, 1)
        put = df.join(first, "k").select("k", in_bin.alias("bin"), F.when(inside, aggregate._slice(F.col(v), i, 1)).alias("slice"))
        size = put.filter("slice is not null").groupBy("k", "bin", "slice").agg(F.count("*").alias("n")).groupBy("k").agg(F.max("n").alias("most"), F.sum("n").alias("inside")).collect()
        assert all(r["most"] < 0.0005 * n and r["inside"] < 0.01 * n for r in size)


def test_quantiles_read_their_rows_twice(spark, sf):
    from pairlens.plans import registry

    reads = []
    keep = aggregate.stored
    aggregate.stored = lambda rows, name: (reads.append(rows), keep(rows, name))[1]
    try:
        out = registry.queries()["a08_breakdowns"](spark, sf)
    finally:
        aggregate.stored = keep
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("orders.parquet")
    assert [scans(x) for x in reads] == [1, 1] and scans(out) == 0


def test_draws_have_exact_quotas(spark):
    df = spark.createDataFrame([(i, "AAB"[i % 3]) for i in range(90)], "pair_id int, grp string")
    d = sample.draws(df, "grp", {"A": 50, "B": 30}, 40)
    counts = d.groupBy("draw", "grp").agg(F.count("*").alias("n"), F.count_distinct("pair_id").alias("m")).collect()
    assert {(r["grp"], r["n"], r["m"]) for r in counts} == {("A", 50, 50), ("B", 30, 30)} and len(counts) == 80
    often = [r["n"] for r in d.filter("grp = 'A'").groupBy("pair_id").agg(F.count("*").alias("n")).collect()]
    assert len(often) == 60 and 20 < min(often) <= 40  # 33.3 on average
    with pytest.raises(Exception, match="fewer rows"):
        sample.draws(df, "grp", {"B": 31}, 3).count()


def test_cell_weights_are_poisson_counts_of_any_mean(spark):
    """Mean and variance are n on both sides of small and large counts, and each draw is the law's inverse at its uniform number."""
    from math import exp, lgamma, log

    means, draws = (1, 5, 15, 16, 400, 1_000_000), 4000
    cells = spark.createDataFrame([(f"c{n}", n) for n in means], "k string, n int")
    w = {r["k"]: r for r in sample.cell_weights(cells, ["k"], draws).groupBy("k").agg(F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("q"), F.sort_array(F.collect_list(F.struct("draw", "weight"))).alias("all")).collect()}
    us = {(r["k"], r["draw"]): r["u"] for r in cells.select("k", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("u", sample.uniform("k", "draw", 0)).collect()}
    for n in means:
        mean = w[f"c{n}"]["s"] / draws
        assert abs(mean - n) < 4 * np.sqrt(n / draws) and abs(w[f"c{n}"]["q"] / draws - mean**2 - n) < 0.12 * n
        if n > 1000:
            continue
        chance, upto = [exp(k * log(n) - n - lgamma(k + 1)) for k in range(n + 400)], 0.0
        below = np.cumsum(chance)
        got = {d: x for d, x in w[f"c{n}"]["all"]}
        for d in range(draws):
            assert got.get(d, 0) == np.searchsorted(below, us[f"c{n}", d], side="right")
    table = sample.poisson_table(cells, ["k"]).groupBy("k").agg(F.count("*").alias("n"), F.max("_before").alias("top")).collect()
    assert all(abs(r["top"] - 1) < 1e-9 for r in table) and max(r["n"] for r in table) < 20_000


def test_verified_clusters(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [(float(a) / 100, float(x), float(y), float(v) / 7) for a, x, y, v in zip(rng.integers(1, 99, 12), rng.integers(0, 40, 12), rng.integers(0, 40, 12), rng.integers(0, 7, 12), strict=True)]) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, p array<struct<score:double,x:double,y:double,check:double>>").select("id", hypotheses.shortlisted(hypotheses.clustered(F.col("p"), verify=True)).alias("k")).withColumn("w", hypotheses.confidence(F.col("k")))
    got = {r["id"]: r for r in df.select("id", *(hypotheses.verified(F.col("k"), F.col("w"), a).alias(f"a{n}") for n, a in enumerate((0.0, 0.35)))).collect()}
    for i, ps in rows:
        clusters = []
        for p in sorted(ps, reverse=True):
            near = [k for k in clusters if np.hypot(p[1] - k[0][1], p[2] - k[0][2]) <= 6]
            near[0].append(p) if near else clusters.append([p])
        sums = [sum(p[0] for p in k) for k in clusters]
        top = sorted(range(len(clusters)), key=lambda j: -sums[j])[:4]
        for n, a in enumerate((0.0, 0.35)):
            best = max(top, key=lambda j: (round(max(p[3] for p in clusters[j]) + a * sums[j] / sum(sums[t] for t in top), 12), -top.index(j)))
            w = [p[0] for p in clusters[best]]
            assert np.allclose([got[i][f"a{n}"]["x"], got[i][f"a{n}"]["y"]], [np.average([p[q] for p in clusters[best]], weights=w) for q in (1, 2)])


def test_samples(spark):
    df = spark.createDataFrame([(i, "AB"[i % 2]) for i in range(200)], "pair_id int, grp string")
    a, b = (sorted(values(sample.stratified(d, "grp", {"A": 7, "B": 3}, 1), "pair_id", "grp")) for d in (df, df.repartition(7)))
    assert a == b and len(set(a)) == 10 and sum(g == "A" for _, g in a) == 7
    with pytest.raises(ValueError):
        sample.stratified(df, "grp", {"A": 101}, 1)
    assert sample.fixed_size(df, 500, 1).count() == 200
    halves = sample.half_splits(df, "grp", 3).groupBy("seed", "grp", "half").count().collect()
    assert {r["count"] for r in halves} == {50}
    w = sample.bootstrap_weights(df, 40).groupBy("draw").agg(F.sum("weight").alias("n")).agg(F.avg("n")).first()[0]
    assert abs(w - 200) < 12
    assert sorted(values(sample.apportioned(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "name string, weight int"), 10), "name", "n")) == [("a", 4), ("b", 3), ("c", 3)]
    assert [r[0] for r in values(sample.worker_quotas(spark, 10, 4, cap=7).orderBy("worker"), "n")] == [3, 3, 1, 0]


def test_isolated_map_never_loses_a_row(spark):
    def _make():  # nested, so that workers needn't import this file
        return {"n": 0}

    def _answer(model, row):
        if row["k"] == 1:
            raise RuntimeError
        return {"x": float("nan") if row["k"] == 2 else 1.0, "found": 1}

    df = spark.createDataFrame([(i, i % 4) for i in range(12)], "pair_id int, k int")
    got = {r["pair_id"]: r for r in batch.isolated_map(df, "pair_id", _make, _answer).collect()}
    assert len(got) == 12 and {r["error"] for i, r in got.items() if i % 4 == 1} == {"RuntimeError"} and {r["error"] for i, r in got.items() if i % 4 == 2} == {"not a number"}
    assert all(r["found"] == 0 and r["x"] == 0 for i, r in got.items() if i % 4 in (1, 2)) and all(r["found"] == 1 for i, r in got.items() if i % 4 in (0, 3))

    def _odd(model, row):
        if row["k"] == 3:
            while True:  # hangs
                pass
        return [{"x": "text"}, {"x": None}, "no dict"][row["k"]]

    got = batch.isolated_map(df, "pair_id", _make, _odd, limit=0.2).collect()
    assert len(got) == 12 and {(r["pair_id"] % 4 == 3, r["error"]) for r in got} == {(True, "late"), (False, "not a number")}

    def _strict(model, row):
        return [{"x": "12.5", "found": 1}, {"x": 1.0, "found": 7}, {"x": True}, {"x": 2, "found": True}][row["k"]]

    got = batch.isolated_map(df, "pair_id", _make, _strict).collect()
    assert {(r["pair_id"] % 4, r["error"], r["found"], r["x"]) for r in got} == {*((k, "not a number", 0, 0.0) for k in range(3)), (3, None, 1, 2.0)}

    def _native(model, row):
        import ctypes
        import os

        if row["k"] == 0:
            ctypes.PyDLL(None).sleep(600)  # holds the interpreter's lock: no signal handler runs
        if row["k"] == 1:
            os._exit(3)
        return {"found": 1}

    began = time.perf_counter()
    got = batch.isolated_map(df.filter("pair_id < 8"), "pair_id", _make, _native, limit=0.5).collect()
    assert {(r["pair_id"] % 4, r["error"]) for r in got} == {(0, "late"), (1, "died"), (2, None), (3, None)} and len(got) == 8 and time.perf_counter() - began < 100

    def _broken():
        raise OSError("no weights")

    for limit in (None, 5):
        with pytest.raises(Exception, match="no weights"):
            batch.isolated_map(df, "pair_id", _broken, _strict, limit).collect()

    big = spark.createDataFrame([(2**60 + 1, 1.0), (None, 2.0), (-5, None)], "`odd key` long, x double")
    for limit in (None, 5):
        got = batch.isolated_map(big, "odd key", _make, lambda m, r: {"x": -1.0 if r["x"] is None else float(r["odd key"] is None), "score": 1}, limit).collect()
        assert {(r["odd key"], r["x"], r["error"]) for r in got} == {(2**60 + 1, 0.0, None), (None, 1.0, None), (-5, -1.0, None)}

    def _other():
        return {"n": 5}

    same_name = {"__qualname__": _make.__qualname__, "__module__": _make.__module__}
    for k, v in same_name.items():
        setattr(_other, k, v)
    assert {r["x"] for r in batch.isolated_map(df, "pair_id", _other, lambda m, _: {"x": m["n"]}).collect()} == {5.0}


def test_columns_and_schemas_are_refused(spark, tmp_path):
    assert io.pick_column(["Pair ID", "ref_image"], ["pair id"], "id") == "Pair ID"
    assert io.pick_column(["id", "my_ref_image"], ["ref_path"], "reference") == "my_ref_image"
    for bad in (["a_ref", "b_ref"], ["x"]):
        with pytest.raises(io.SchemaError):
            io.pick_column(bad, ["ref"], "reference")
    with pytest.raises(io.SchemaError, match="near"):
        io.resolve_schema(["Pair_ID", *io.PAIRS3[1:]])
    assert io.resolve_schema(["id", *io.PAIRS3[1:]], mapping={"pair_id": "id"})["pair_id"] == "id"
    path = tmp_path / "p.csv"
    path.write_text("# a comment\n" + ",".join(io.PAIRS3) + "\na,s.png,/r.gds,C:\\q.gds,,\nb,s.png,r.gds,q.gds,e,p\n")
    rows = io.read_pairs(spark, str(path), base="/base/")
    assert sorted(values(rows, "pair_id", "reference_gds_path", "search_gds_path")) == [("a", "/r.gds", "C:\\q.gds"), ("b", "/base/r.gds", "/base/q.gds")]
    assert "params_json_path" not in io.blind(rows).columns
    assert sorted(values(io.withheld(rows), "pair_id", "params_json_path")) == [("a", None), ("b", "/base/p")]
    path.write_text(",".join(io.PAIRS3) + "\na,s,r,q,,\na,s,r,q,,\n")
    with pytest.raises(io.SchemaError, match="repeated"):
        io.read_pairs(spark, str(path))
    path.write_text("a,a\n1,2\n")
    with pytest.raises(io.SchemaError):
        io.header(spark, str(path))
    for name, text in (("a", "x,y\n1,2\n"), ("b", "# c\ny,x\n1,2\n")):
        (tmp_path / "two").mkdir(exist_ok=True)
        (tmp_path / "two" / f"{name}.csv").write_text(text)
    with pytest.raises(io.SchemaError, match="different"):
        io.header(spark, str(tmp_path / "two"))


def test_headers_of_many_files_take_one_job(spark, tmp_path):
    paths = []
    for i in range(40):
        paths.append(str(tmp_path / f"shard {i}" / "pairs.csv"))
        (tmp_path / f"shard {i}").mkdir()
        (tmp_path / f"shard {i}" / "pairs.csv").write_text("# made\n" * (i % 3 * 50) + f"pair_id,c{i % 4}\n" + "1,2\n" * 3000)
    (tmp_path / "empty.csv").write_text("")
    paths.append(str(tmp_path / "empty.csv"))
    before = [spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")]
    spark.sparkContext.setJobGroup("headers", "headers")
    got = io.headers(spark, paths)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("headers")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [got[p] for p in paths] == [["pair_id", f"c{i % 4}"] for i in range(40)] + [[]] and len(jobs) <= 2
    assert before == [spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")]
    rows = io.scan_shards(spark, paths[:-1])
    assert rows.count() == 40 * 3000 and set(rows.columns) == {"pair_id", "c0", "c1", "c2", "c3", "file", "shard"}


def test_results_files_of_both_layouts(spark, tmp_path):
    split = '[{"name": "x", "errors": [1.0, 2.5]}]'
    for text in (split, '{"provenance": {"commit": "c"}, "splits": ' + split + "}"):
        p = tmp_path / f"r{len(text)}.json"
        p.write_text(text)
        assert values(io.read_results(spark, str(p)), "name", "errors") == [("x", [1.0, 2.5])]


def test_files_pair_by_their_endings(spark, tmp_path):
    for n in ("a_ref.png", "a_search.png", "b_ref.png", "c_search.png"):
        (tmp_path / n).write_bytes(n.encode())
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", F.sha2("content", 256).alias("sha"))
    got = io.paired_files(files, "_ref.png", "_search.png")
    assert sorted(values(got, "stem", "left", "right")) == [("a", "a_ref.png", "a_search.png"), ("b", "b_ref.png", None), ("c", None, "c_search.png")]
    import hashlib

    assert {(r["sha256"], r["bytes"]) for r in io.payload_digests(spark, str(tmp_path)).collect()} == {(hashlib.sha256(n.encode()).hexdigest(), len(n)) for n in ("a_ref.png", "a_search.png", "b_ref.png", "c_search.png")}
    assert {r["sha"] for r in files.collect()} == {hashlib.sha256(n.encode()).hexdigest() for n in ("a_ref.png", "a_search.png", "b_ref.png", "c_search.png")}


def test_predictions_are_written_in_order(spark, tmp_path):
    df = spark.createDataFrame([(i, f"p{9 - i}", 0.5 if i % 2 else 0.25) for i in range(10)], "ordinal int, pair_id string, score double").withColumns({k: F.lit(1.23456) for k in ("x", "y", "theta", "scale")})
    out = df.select("ordinal", "pair_id").join(io.prediction_text(df, 0.5), "pair_id")
    io.write_predictions(out, str(tmp_path / "o"))
    back = spark.read.csv(str(tmp_path / "o"), header=True)
    assert sorted(values(back, "pair_id", "found", "x"))[0] == ("p0", "1", "1.2346")
    lines = [x for f in sorted((tmp_path / "o").glob("part-*")) for x in f.read_text().splitlines() if not x.startswith("pair_id")]
    assert [x.split(",")[0] for x in lines] == [f"p{9 - i}" for i in range(10)]


def test_joins_refuse_missing_rows(spark):
    t = spark.createDataFrame([(1,), (2,)], "pair_id int")
    with pytest.raises(joins.MissingRows):
        joins.scoring_join(t, t.withColumn("j", F.lit(1)), t.filter("pair_id = 1").withColumn("s", F.lit(1.0)))
    with pytest.raises(joins.MissingRows):
        joins.aligned(t, t.filter("pair_id = 1"))


def test_ordinals_have_no_gaps(spark):
    df = spark.range(0, 5000, 3).select((F.col("id") * 7 % 5003).alias("k")).repartition(5)
    got = io.with_ordinal(df, "k").orderBy("k").collect()
    assert [r["ordinal"] for r in got] == list(range(len(got)))


def test_streams_keep_unique_rows_and_resume(spark, tmp_path):
    df = spark.range(50).select(F.col("id").alias("k"), F.timestamp_seconds(F.col("id") + 1_000_000).alias("ts"))
    df.union(df).repartition(3).write.parquet(str(tmp_path / "in"))
    rows = lambda: streams.read(spark, str(tmp_path / "in"), df.schema)
    assert streams.drained(streams.unique(rows(), "k", "ts"), str(tmp_path / "u"), str(tmp_path / "c1")).count() == 50
    for k in (2, 3):
        streams.resume(rows(), "k", str(tmp_path / "r"), str(tmp_path / f"c{k}"))
        assert streams.committed(spark, str(tmp_path / "r")).count() == 50
    # more arrives for the second checkpoint, whose state is whole: the output isn't read for it
    df.withColumn("k", F.col("k") + 25).write.mode("append").parquet(str(tmp_path / "in"))
    keep, streams.committed = streams.committed, None
    try:
        streams.resume(rows(), "k", str(tmp_path / "r"), str(tmp_path / "c3"))
    finally:
        streams.committed = keep
    assert sorted(values(streams.committed(spark, str(tmp_path / "r")), "k")) == [(i,) for i in range(75)]


def test_sinks_have_files_by_batches_and_count_a_file_once(spark, tmp_path, monkeypatch):
    at = lambda n: str(tmp_path / n)
    df = spark.range(240).select(F.col("id").alias("k"), (F.col("id") % 3).cast("int").alias("shard"))
    df.repartition(12).write.parquet(at("in"))
    monkeypatch.setattr(streams, "FOLDERS", 3)
    rows = lambda n: streams.read(spark, at("in"), df.schema, n)
    streams.grow_pool(rows(2), at("out"), at("c1"))  # six batches
    log = streams._log(spark, at("out"))
    assert log.count() == 6 and log.agg(F.max(F.size("folders"))).first()[0] <= 3
    assert log.select(F.explode("added").alias("f")).distinct().count() == 12
    streams.grow_pool(rows(5), at("out"), at("lost"))
    spark.createDataFrame([(0,), (1,), (2,)], "shard int").write.parquet(at("m"))
    assert sorted(values(streams.pool(spark, at("out"), at("m"), "shard"), "k")) == [(i,) for i in range(240)]
    # a batch that failed between its rows and its log entry isn't there
    spark.range(5).select(F.col("id").alias("k"), F.lit(1).alias("shard"), F.lit("x").alias("_file")).write.parquet(at("out") + "/data/left")
    assert streams.committed(spark, at("out")).count() == 240


def test_pool_and_scores_survive_late_markers_and_lost_checkpoints(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "k long, shard int")
    at = lambda n: str(tmp_path / n)
    mark = lambda k: spark.createDataFrame([(k,)], "shard int").write.mode("append").parquet(at("m"))
    df.filter("k < 20").write.parquet(at("in"))
    mark(1)
    rows = lambda: streams.read(spark, at("in"), df.schema)
    streams.grow_pool(rows(), at("out"), at("c1"))
    df.filter("k >= 20").write.mode("append").parquet(at("in"))
    mark(2)
    streams.grow_pool(rows(), at("out"), at("c1"))
    streams.grow_pool(rows(), at("out"), at("lost"))
    assert sorted(values(streams.pool(spark, at("out"), at("m"), "shard"), "k")) == [(i,) for i in range(30) if i % 3]


def test_utc_stamp(spark):
    import datetime

    got = io.stamped(spark.range(1)).first()["utc"]
    assert abs(datetime.datetime.fromisoformat(got) - datetime.datetime.now(datetime.UTC)) < datetime.timedelta(minutes=2)


def test_breakdown_and_health(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 0), ("b", 2, 0)], "g string, s int, f int")
    got = sorted(values(aggregate.breakdown(df, ["g", "s"], [F.count("*").alias("n")]), "dimension", "value", "n"))
    assert got == [("g", "a", 2), ("g", "b", 1), ("s", "1", 1), ("s", "2", 2)]
    assert values(aggregate.health(df.withColumn("r", F.lit(1)), ["r"], "f", "f"), "errors", "reasons") == [(1, "errors")]


def newton_trees(x, y, rounds, depth, rate, lam, least):
    """A plain loop: every leaf of every tree, in order from the left, and the margins."""
    p = min(max(y.mean(), 1e-6), 1 - 1e-6)
    f, trees = np.full(len(y), np.log(p / (1 - p))), []

    def grow(rows, g, h, left, leaves, out):
        best = None
        if left and len(rows) >= 2 * least:
            for j in range(x.shape[1]):
                for t in np.unique(x[rows, j])[:-1]:
                    a, b = rows[x[rows, j] <= t], rows[x[rows, j] > t]
                    if min(len(a), len(b)) >= least:
                        gain = g[a].sum() ** 2 / (h[a].sum() + lam) + g[b].sum() ** 2 / (h[b].sum() + lam) - g[rows].sum() ** 2 / (h[rows].sum() + lam)
                        if best is None or gain > best[0] + 1e-12:
                            best = (gain, a, b)
        if best is None or best[0] <= 1e-9:
            leaves.append(-g[rows].sum() / (h[rows].sum() + lam))
            out[rows] = leaves[-1]
            return
        grow(best[1], g, h, left - 1, leaves, out)
        grow(best[2], g, h, left - 1, leaves, out)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        leaves, out = [], np.zeros(len(y))
        grow(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-6), depth, leaves, out)
        f = f + rate * out
        trees.append(leaves)
    return trees, f


def leaves_of(tree, k=0):
    return leaves_of(tree, tree[k][2]) + leaves_of(tree, tree[k][3]) if isinstance(tree[k], tuple) else [tree[k]]


def test_boosted_trees_equal_a_plain_loop(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(140, 3)), 1)
    y = (rng.random(140) < 1 / (1 + np.exp(-2 * x[:, 0] * x[:, 1] + x[:, 2]))).astype(float)
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y int").repartition(5)
    want, f = newton_trees(x, y, 6, 3, 0.3, 1.0, 9)
    for kept, parts in ((25, 64), (2, 1)):  # margins from the table too, and sums added up in tasks
        monkeypatch.setattr(boost, "KEPT", kept)
        monkeypatch.setattr(passes, "PARTS", parts)
        model = boost.boosted(df, ["a", "b", "c"], "y", rounds=6, depth=3, rate=0.3, least=9)
        assert len(model["trees"]) == 6
        for tree, leaves in zip(model["trees"], want, strict=True):
            assert np.allclose(leaves_of(tree), leaves, atol=1e-12)
    got = {(r["a"], r["b"], r["c"]): r["m"] for r in df.withColumn("m", boost.margin(model)).collect()}
    assert all(abs(got[tuple(r)] - v) < 1e-9 for r, v in zip(x.tolist(), f, strict=True))
    missing = spark.createDataFrame([(None, float("nan"), 0.1)], "a double, b double, c double").withColumn("m", boost.margin(model)).first()
    there = spark.createDataFrame([(float(np.median(x[:, 0])), float(np.median(x[:, 1])), 0.1)], "a double, b double, c double").withColumn("m", boost.margin(model)).first()
    assert missing["m"] == there["m"]


def test_boosting_plans_no_query_for_a_level(spark):
    df = spark.createDataFrame([(i / 40, (i * 7 % 40) / 40, int(i % 3 == 0)) for i in range(40)], "a double, b double, y int").repartition(3)
    store, took = spark._jsparkSession.sharedState().statusStore(), []
    for rounds in (1, 5):
        before = store.executionsCount()
        assert len(boost.boosted(df, ["a", "b"], "y", rounds=rounds, least=3)["trees"]) == rounds
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        took.append(store.executionsCount() - before)
    assert took[0] == took[1]


def test_sums_of_passes_are_the_same_in_parts(spark, monkeypatch):
    rows = spark.sparkContext.parallelize(range(20), 6)
    for parts in (64, 2):
        monkeypatch.setattr(passes, "PARTS", parts)
        assert passes.summed(rows, lambda it: [np.array([float(x), 1.0]) for x in it]).tolist() == [190.0, 20.0]


def test_boosted_trees_of_few_bins_learn(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(t), i % 3) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))], "a double, b double, y int, fold int")
    model = boost.boosted(df.filter("fold > 0"), ["a", "b"], "y", rounds=15, rate=0.3, bins=16)
    held = score.auc(df.filter("fold = 0").withColumn("score", boost.predicted(model)), [], "y").first()["auc"]
    assert held > 0.95


def test_running_outliers_of_many_long_arrays(spark):
    rng = np.random.default_rng(11)
    arrays = [rng.normal(size=n).round(3).tolist() for n in (1, 2, 15, 64, 64, 400)]
    arrays[3][20] = None
    df = spark.createDataFrame([(i, a) for i, a in enumerate([*arrays, []])], "i int, a array<double>")
    began = time.perf_counter()
    got = {r["i"]: r["o"] for r in df.select("i", spatial.running_outliers(F.col("a")).alias("o")).collect()}
    assert time.perf_counter() - began < 30  # a deviation worked out for each element takes minutes for 400
    last = lambda x: (x is None, x or 0.0)
    middle = lambda xs: sorted(xs, key=last)[(len(xs) + 1) // 2 - 1]
    less = lambda x, m: None if x is None or m is None else x - m
    for i, a in enumerate(arrays):
        rest = [less(x, middle([a[min(max(k + o, 0), len(a) - 1)] for o in range(-7, 8)])) for k, x in enumerate(a)]
        mad = middle([None if x is None else abs(x) for x in rest])
        assert got[i] == [x if x is not None and x > 4 * 1.4826 * mad else 0.0 for x in rest]
    assert got[6] == []


def test_candidates_are_sorted_in_as_many_tasks_as_they_need(spark, sf, monkeypatch):
    once = fixtures.view(spark, sf, "v3")
    want = sorted(map(tuple, once.collect()))
    monkeypatch.setattr(fixtures, "AT_ONCE", 300)
    many = fixtures.view(spark, sf, "v3")
    assert many.rdd.getNumPartitions() == spark.read.parquet(f"{sf}/lineitem.parquet").count() // 300 + 1
    assert sorted(map(tuple, many.collect())) == want


def test_selectors_take_one_row_for_each_candidate(spark, sf):
    rows = fixtures.view(spark, sf, "v3")
    wide, long = hypotheses.selected_errors(rows), hypotheses.selector_errors(rows)
    for name in (*hypotheses.SCORES, "oracle"):
        assert sorted(values(wide, "pair_id", name)) == sorted(values(long.filter(F.col("selector") == name), "pair_id", "err"))
    plan = hypotheses.selector_errors(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("SortAggregate")  # rows are multiplied after the aggregate, as there are fewer


def test_votes_work_a_cluster_out_once(spark):
    df = spark.createDataFrame([([(0.5, 1.0, 1.0), (0.5, 2.0, 1.0), (0.25, 30.0, 1.0)],)], "p array<struct<score:double,x:double,y:double>>")
    k = hypotheses.clustered(F.col("p"))
    rule = hypotheses.voted(F.col("k"), "sum")
    text = lambda e, rows: rows.select(e)._jdf.queryExecution().optimizedPlan().toString()
    held = io.stored(df.select(k.alias("k")))
    scan = spark.createDataFrame(df.rdd, df.schema)
    assert text(k.alias("o"), scan).count("array_position(") == 1 and text(rule.alias("o"), held).count("array_max(") == 1
    assert held.select(rule["x"].alias("x")).first()["x"] == 1.5


def test_routing_reads_its_pairs_once(spark):
    df = spark.createDataFrame([(0.1, 3.0, 1.0), (0.9, 8.0, 2.0), (0.4, 1.0, 7.0)], "r double, a double, b double")
    out = hypotheses.routed(df, [0.0, 0.5, 1.0], "r", "a", "b")
    assert "LogicalRDD" not in out._jdf.queryExecution().optimizedPlan().toString()  # only their counts are read for each sum
    assert [(r["threshold"], r["passes"]) for r in out.orderBy("threshold").collect()] == [(0.0, 9.0), (0.5, 11 / 3), (1.0, 1.0)]
