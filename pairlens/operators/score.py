"""The scoring rubric and everything that depends on a threshold, from one additive histogram.

AUC, F1 at every threshold and the whole rubric are functions of sums over the rows with
``score >= t``. The histogram has one row for each key and score, so ties and skew vanish there (with
map-side sums); sums over higher scores are taken in two passes, over literal buckets of the score and
within each bucket, so that no task ever sorts all scores. All sums merge: folds are subtracted, and a
stream adds to them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..sources.io import stored

# fixed values: weights of the rubric
WEIGHT_A, WEIGHT_B = 0.45, 0.55
POINTS = {"loc": 40.0, "scale": 10.0, "rot": 10.0, "f1": 15.0, "auc": 10.0}
MEASURES = ("n", "present", "absent", "correct", "n_a", "n_b", "loc_a", "loc_b", "ok", "sc", "rc")


def ratio(a: Column, b: Column, empty=None) -> Column:
    """a / b, or empty where b is 0."""
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(empty).cast("double"))


def measured(pairs: DataFrame, clamp: bool = False) -> DataFrame:
    """Adds err, the raw credits and the histogram's measures of each row (see MEASURES)."""
    if clamp:
        pairs = pairs.withColumns({k: c.clamp(k, *b) for k, b in c.POSE_BOUNDS.items()})
    rows = pairs.withColumns({
        "err": c.location_error(), "score": c.finite("score"),
        "raw_loc": c.tier(c.location_error(), c.LOCATION_TIERS),
        "raw_sc": c.tier(c.scale_error(), c.SCALE_TIERS), "raw_rc": c.tier(c.rotation_error(), c.ROTATION_TIERS),
    })
    present, a, b = F.col("gt_found") == 1, F.col("grp") == "A", F.col("grp") == "B"
    ok = present & (F.col("raw_loc") > 0)
    on = lambda flag, value=1: F.when(flag, value).otherwise(0)
    return rows.withColumns({
        "n": F.lit(1), "present": on(present), "absent": on(~present), "correct": on(present & (F.col("err") <= 5)),
        "n_a": on(a & present), "n_b": on(b & present), "loc_a": on(a & present, F.col("raw_loc")), "loc_b": on(b & present, F.col("raw_loc")),
        "ok": on(ok), "sc": on(ok, F.col("raw_sc")), "rc": on(ok, F.col("raw_rc")),
    })


def histogram(rows: DataFrame, keys: Sequence[str], measures: Sequence[str] = MEASURES, score: str = "score") -> DataFrame:
    return rows.groupBy(*keys, score).agg(*(F.sum(m).alias(m) for m in measures))


def running(hist: DataFrame, keys: Sequence[str], measures: Sequence[str] = MEASURES, score: str = "score", low: float = 0.0, high: float = 1.0, buckets: int = 256) -> DataFrame:
    """hist with ``ge_<m>`` (sums over scores at or above the row's) and ``all_<m>`` (over all of the key's)."""
    bucket = F.floor((c.clamp(score, low, high) - low) / (high - low) * buckets)
    hist = hist.withColumn("_bucket", F.coalesce(bucket, F.lit(-1)))
    whole = hist.groupBy(*keys, "_bucket").agg(*(F.sum(m).alias(f"_{m}") for m in measures))
    higher = Window.partitionBy(*keys, F.lit(0)).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys, F.lit(0))  # at most ``buckets`` rows for each key
    offsets = whole.select(*keys, "_bucket", *(F.coalesce(F.sum(f"_{m}").over(higher), F.lit(0)).alias(f"_above_{m}") for m in measures), *(F.sum(f"_{m}").over(every).alias(f"all_{m}") for m in measures))
    joined = hist.join(offsets, [F.equal_null(hist[k], offsets[k]) for k in (*keys, "_bucket")]).drop(*(offsets[k] for k in (*keys, "_bucket")))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    out = joined.withColumns({f"ge_{m}": F.sum(m).over(inside) + F.col(f"_above_{m}") for m in measures})
    return out.drop("_bucket", *(f"_above_{m}" for m in measures))


def auc(rows: DataFrame, keys: Sequence[str], label: str, score: str = "score") -> DataFrame:
    """keys, auc: the chance that a row with label 1 scores over one with label 0, ties half; null if either is missing."""
    rows = rows.withColumns({"_pos": F.when(F.col(label) == 1, 1).otherwise(0), "_neg": F.when(F.col(label) == 1, 0).otherwise(1)})
    return auc_of(histogram(rows, keys, ("_pos", "_neg"), score), keys, score)


def auc_of(hist: DataFrame, keys: Sequence[str], score: str = "score", positive: str = "_pos", negative: str = "_neg") -> DataFrame:
    """keys, auc of a histogram that has the rows of both labels."""
    hist = hist.select(*keys, score, F.col(positive).alias("_pos"), F.col(negative).alias("_neg"))
    swept = running(hist, keys, ("_pos", "_neg"), score)
    below = F.col("all__neg") - F.col("ge__neg")
    return swept.groupBy(*keys).agg(ratio(F.sum(F.col("_pos") * (below + 0.5 * F.col("_neg"))), F.max("all__pos") * F.max("all__neg")).alias("auc"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn, 0.0)


def confusion(found: Column, present: Column, positive: str = "reject") -> dict[str, Column]:
    """Aggregates tp, fp, fn with refusals or findings as the positive answers."""
    said, real = (~found, ~present) if positive == "reject" else (found, present)
    return {"tp": F.count_if(said & real), "fp": F.count_if(said & ~real), "fn": F.count_if(~said & real)}


def parts_at(t: Column | None = None, empty=0.0) -> dict[str, Column]:
    """loc, scale, rot, f1 of a swept row: found are all scores at or above it."""
    ge, every = lambda m: F.col(f"ge_{m}"), lambda m: F.col(f"all_{m}")
    loc = WEIGHT_A * ratio(ge("loc_a"), every("n_a")) + WEIGHT_B * ratio(ge("loc_b"), every("n_b"))
    return {
        "loc": loc, "scale": ratio(ge("sc"), ge("ok"), empty), "rot": ratio(ge("rc"), ge("ok"), empty),
        "f1": f1(every("absent") - ge("absent"), every("present") - ge("present"), ge("absent")),
    }


def total(parts: dict[str, Column]) -> Column:
    out = F.lit(0.0)
    for k, w in POINTS.items():
        out = out + w * parts[k]
    return out


def sweep(rows: DataFrame, keys: Sequence[str], score: str = "score", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """keys, score (the threshold), loc, scale, rot, f1, auc, total: the rubric at every distinct score.

    rows come from measured(); sets other than A, B and C are left out.
    """
    gray = rows.filter(F.col("grp").isin("A", "B", "C") & F.col(score).isNotNull())
    return sweep_hist(histogram(gray, keys, score=score), keys, score, low, high)


def sweep_hist(hist: DataFrame, keys: Sequence[str], score: str = "score", low: float = 0.0, high: float = 1.0) -> DataFrame:
    swept = running(hist, keys, score=score, low=low, high=high)
    wrong = F.col("n") - F.col("correct")
    below = (F.col("all_n") - F.col("all_correct")) - (F.col("ge_n") - F.col("ge_correct"))
    one = swept.groupBy(*keys).agg(ratio(F.sum(F.col("correct") * (below + 0.5 * wrong)), F.max("all_correct") * (F.max("all_n") - F.max("all_correct")), 0.0).alias("auc"))
    swept = swept.join(one, list(keys)) if keys else swept.crossJoin(F.broadcast(one))
    parts = parts_at()
    kept = [*keys, score, *(f"ge_{m}" for m in MEASURES), *(f"all_{m}" for m in MEASURES), "auc"]
    return swept.select(*kept, *(e.alias(k) for k, e in parts.items())).withColumn("total", total({k: F.col(k) for k in POINTS}))


def rubric(rows: DataFrame, keys: Sequence[str], threshold: float, found: Column | None = None, empty=None) -> DataFrame:
    """The rubric of each key at one threshold: credits, F1 of both kinds, AUC, total, counts.

    rows come from measured(). Refused rows earn nothing in any subset. Components without rows are null
    (or ``empty``).
    """
    gray = rows.filter(F.col("grp").isin("A", "B", "C"))
    said = F.coalesce(F.col("score") >= threshold, F.lit(False)) if found is None else found
    present = F.col("gt_found") == 1
    credit = F.when(present & said, F.col("raw_loc")).otherwise(0.0)
    ok = credit > 0
    rej, acc = confusion(said, present, "reject"), confusion(said, present, "present")
    mean = lambda flag, value: F.coalesce(F.avg(F.when(flag, value)), F.lit(empty).cast("double"))
    one = gray.groupBy(*keys).agg(
        mean(present & (F.col("grp") == "A"), credit).alias("loc_a"), mean(present & (F.col("grp") == "B"), credit).alias("loc_b"),
        mean(ok, F.col("raw_sc")).alias("scale"), mean(ok, F.col("raw_rc")).alias("rot"),
        f1(**rej).alias("f1"), f1(**acc).alias("f1_found"), F.count("*").alias("n"), F.sum("present").alias("n_present"),
    )
    one = one.withColumn("loc", WEIGHT_A * F.col("loc_a") + WEIGHT_B * F.col("loc_b"))
    ranked = auc(gray, keys, "correct")
    one = one.join(ranked, list(keys)) if keys else one.crossJoin(ranked)
    return one.withColumn("total", total({k: F.col(k) for k in POINTS}))


def best(swept: DataFrame, keys: Sequence[str], value: str = "total", score: str = "score", margin: float | None = None) -> DataFrame:
    """Each key's threshold with the greatest value (the least such); with a margin, the least threshold within it."""
    top = swept.groupBy(*keys).agg(F.max(value).alias("best"), F.max_by(score, F.struct(value, -F.col(score))).alias("threshold"))
    if margin is None:
        return top
    joined = swept.join(top.select(*keys, "best"), list(keys)) if keys else swept.crossJoin(top.select("best"))
    return joined.filter(F.col(value) >= F.col("best") - margin).groupBy(*keys).agg(F.first("best").alias("best"), F.min(score).alias("threshold"))


def trained(own: DataFrame, fold: str, measures: Sequence[str] = MEASURES) -> DataFrame:
    """Each fold's training histogram, from the folds' own ones: the total of a score less what the fold has there."""
    ids = own.select(F.col(fold).alias("_f")).distinct()  # a few folds
    entry = F.struct(F.col(fold).alias("key"), F.struct(*measures).alias("value"))
    total = own.groupBy("score").agg(*(F.sum(m).alias(m) for m in measures), F.map_from_entries(F.collect_list(entry)).alias("_own"))
    mine = F.try_element_at("_own", F.col("_f"))
    less = total.crossJoin(F.broadcast(ids)).select(F.col("_f").alias(fold), "score", *((F.col(m) - F.coalesce(mine[m], F.lit(0))).alias(m) for m in measures))
    return less.filter("n > 0")


def fold_thresholds(own: DataFrame, fold: str) -> DataFrame:
    """fold, threshold: the best total on the other folds."""
    return best(sweep_hist(trained(own, fold), [fold]).withColumn("total", F.round("total", 9)), [fold]).select(fold, "threshold")


def held_out(rows: DataFrame, fold: str) -> DataFrame:
    """fold, threshold, held_total, held_f1: each fold's best threshold on the other folds, and what it earns on the fold itself."""
    own = stored(histogram(rows.filter(F.col("grp").isin("A", "B", "C")), [fold]), "folds")  # rows are read once, whatever is swept
    chosen = fold_thresholds(own, fold).withColumnRenamed(fold, "_k")
    # the fold's own row with the least score at or above the threshold tells all sums of score >= threshold
    at = sweep_hist(own, [fold]).join(F.broadcast(chosen), F.col(fold) == F.col("_k")).filter(F.col("score") >= F.col("threshold"))
    return at.groupBy(fold, "threshold").agg(F.min_by("total", "score").alias("held_total"), F.min_by("f1", "score").alias("held_f1"))


def found_total(swept: DataFrame) -> DataFrame:
    """A sweep with f1_found (findings as the positive answers) and total_found, the total with it."""
    found = f1(F.col("ge_present"), F.col("ge_absent"), F.col("all_present") - F.col("ge_present"))
    return swept.withColumn("f1_found", found).withColumn("total_found", F.col("total") + POINTS["f1"] * (F.col("f1_found") - F.col("f1")))


def pr_curve(rows: DataFrame, keys: Sequence[str], label: str, score: str = "score") -> DataFrame:
    """keys, score, precision, recall, and both before the score's own rows: one point for each distinct score, from the highest."""
    rows = rows.withColumns({"_tp": F.when(F.col(label) == 1, 1).otherwise(0), "_all": F.lit(1)})
    swept = running(histogram(rows, keys, ("_tp", "_all"), score), keys, ("_tp", "_all"), score)
    tp, n = F.col("ge__tp"), F.col("ge__all")
    before = (ratio(tp - F.col("_tp"), n - F.col("_all"), 1.0).alias("precision_before"), ratio(tp - F.col("_tp"), F.col("all__all")).alias("recall_before"))
    return swept.select(*keys, score, ratio(tp, n).alias("precision"), ratio(tp, F.col("all__all")).alias("recall"), *before)


def average_precision(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area under the curve from its start at precision 1, recall 0, by trapezoids; curve comes from pr_curve()."""
    area = (F.col("recall") - F.col("recall_before")) * (F.col("precision") + F.col("precision_before")) / 2
    return curve.groupBy(*keys).agg(F.sum(area).alias("ap"))
