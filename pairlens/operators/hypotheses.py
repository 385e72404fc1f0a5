"""Several candidates for each pair: ranks, selectors, margins, votes, clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..sources.io import stored
from .aggregate import joined, quantiles

SCORES = ("zncc", "rank_score", "band_score", "dog_score")
# fixed values: named boxes of tolerance (pixels)
BOXES = {"tight": 1.0, "basin": 3.0, "loose": 6.0}


def ranked(rows: DataFrame, scores: Sequence[str] = SCORES, pair: str = "pair_id") -> DataFrame:
    """Adds each score's rank within its pair, the highest first, equal scores sharing the best rank."""
    return rows.withColumns({f"{s}_place": F.rank().over(Window.partitionBy(pair).orderBy(F.desc(s))) for s in scores})


def first_best(score: str, index: str = "hypothesis_index") -> Column:
    """Aggregate: the index with the highest score, the first one on ties."""
    return F.max_by(index, F.struct(F.col(score), -F.col(index)))


def winners(rows: DataFrame, pair: str = "pair_id", index: str = "hypothesis_index") -> DataFrame:
    """One row for each pair: the winner's index by each score, by consensus and by majority.

    Consensus: the rank score's winner if the band score has the same, else zncc's. Majority: what two
    of zncc, rank and band agree on, else zncc's.
    """
    z, r, b = (F.col(n) for n in ("by_zncc", "by_rank", "by_band"))
    one = rows.groupBy(pair).agg(first_best("zncc", index).alias("by_zncc"), first_best("rank_score", index).alias("by_rank"), first_best("band_score", index).alias("by_band"), first_best("dog_score", index).alias("by_dog"))
    return one.withColumns({"by_consensus": F.when(r == b, r).otherwise(z), "by_majority": F.when(r == b, r).otherwise(z)})


def winner_margin(rows: DataFrame, chosen: DataFrame, pair: str = "pair_id", index: str = "hypothesis_index", winner: str = "by_zncc") -> DataFrame:
    """pair, margin: the winner's least finite score over the best other's; null if not comparable."""
    strength = F.least("rank_score", "zncc")  # least skips nulls
    rows = rows.select(pair, index, strength.alias("_s")).join(chosen.select(pair, F.col(winner).alias("_w")), pair)
    mine, other = F.max(F.when(F.col(index) == F.col("_w"), F.col("_s"))), F.max(F.when(F.col(index) != F.col("_w"), F.col("_s")))
    return rows.groupBy(pair).agg((mine - other).alias("margin"))


def recall_at(rows: DataFrame, error: str, ks: Sequence[int], pair: str = "pair_id", index: str = "hypothesis_index") -> DataFrame:
    """box, n, recall@k for each k, never: how soon a candidate lies inside each box."""
    box = F.inline(F.array(*(F.struct(F.lit(n).alias("box"), F.lit(t).alias("_t")) for n, t in BOXES.items())))
    first = rows.select(pair, index, error, box).groupBy("box", pair).agg(F.coalesce(F.min(F.when(F.col(error) <= F.col("_t"), F.col(index))), F.lit(-1)).alias("first"))
    inside = lambda k: F.avg(((F.col("first") >= 0) & (F.col("first") < k)).cast("double"))
    return first.groupBy("box").agg(F.count("*").alias("n"), *(inside(k).alias(f"recall{k}") for k in ks), F.count_if(F.col("first") < 0).alias("never"))


def selected_errors(rows: DataFrame, error: str = "location_error", pair: str = "pair_id", index: str = "hypothesis_index", scores: Sequence[str] = SCORES) -> DataFrame:
    """pair, one column for each score with the error of its winner, and oracle, the error of the best candidate: one row for each pair."""
    best = lambda v: F.max_by(error, F.struct(v.alias("_v"), -F.col(index)))
    return rows.groupBy(pair).agg(*(best(F.col(s)).alias(s) for s in scores), best(-F.col(error)).alias("oracle"))


def selector_errors(rows: DataFrame, error: str = "location_error", pair: str = "pair_id", index: str = "hypothesis_index", scores: Sequence[str] = SCORES) -> DataFrame:
    """pair, selector, err: the error of each score's winner; and of the best candidate as "oracle"."""
    one = selected_errors(rows, error, pair, index, scores)
    return one.select(pair, F.inline(F.array(*(F.struct(F.lit(s).alias("selector"), F.col(s).alias("err")) for s in (*scores, "oracle")))))


def against(errors: DataFrame, base: str, limit: float = 5.0, pair: str = "pair_id") -> DataFrame:
    """selector, rescued, broken, net: pairs that each selector gets right and the base doesn't, and the reverse."""
    ref = errors.filter(F.col("selector") == base).select(pair, (F.col("err") <= limit).alias("_base"))
    both = errors.filter(F.col("selector") != base).join(ref, pair).withColumn("_own", F.col("err") <= limit)
    one = both.groupBy("selector").agg(F.count_if(F.col("_own") & ~F.col("_base")).alias("rescued"), F.count_if(~F.col("_own") & F.col("_base")).alias("broken"))
    return one.withColumn("net", F.col("rescued") - F.col("broken"))


def clustered(proposals: Column, radius: float = 6.0, verify: bool = False) -> Column:
    """Greedy clusters of an array of (score, x, y) structs, the strongest first; with verify, of (score, x, y, check).

    A proposal joins the first cluster whose first member is within the radius, else it starts one. Each
    cluster carries its start and sums; proposals of one pair are few, so this is a fold over an array.
    """
    start = F.array().cast("array<struct<x0:double,y0:double,n:int,s:double,sx:double,sy:double,top:double,check:double>>")
    check = lambda p: (p["check"] if verify else F.lit(None)).cast("double")
    order = F.sort_array(proposals, asc=False)  # compared natively

    def join(clusters: Column, p: Column) -> Column:
        near = lambda k: F.hypot(p["x"] - k["x0"], p["y"] - k["y0"]) <= radius
        grown = lambda at: F.transform(clusters, lambda k, i: F.when(i + 1 == at, F.struct(k["x0"].alias("x0"), k["y0"].alias("y0"), (k["n"] + 1).alias("n"), (k["s"] + p["score"]).alias("s"), (k["sx"] + p["score"] * p["x"]).alias("sx"), (k["sy"] + p["score"] * p["y"]).alias("sy"), k["top"].alias("top"), F.greatest(k["check"], check(p)).alias("check"))).otherwise(k))
        own = F.struct(p["x"].alias("x0"), p["y"].alias("y0"), F.lit(1).alias("n"), p["score"].alias("s"), (p["score"] * p["x"]).alias("sx"), (p["score"] * p["y"]).alias("sy"), p["score"].alias("top"), check(p).alias("check"))
        return c.named(F.array_position(F.transform(clusters, near), F.lit(True)), lambda at: F.when(at > 0, grown(at)).otherwise(F.concat(clusters, F.array(own))))

    return F.aggregate(order, start, join)


#: Rules that order clusters; the first is best.
RULES = {
    "sum": lambda k: F.struct(k["s"], k["n"].cast("double")), "top1": lambda k: F.struct(k["top"], F.lit(0.0)),
    "count": lambda k: F.struct(k["n"].cast("double"), k["s"]), "max": lambda k: F.struct(k["top"], F.lit(1.0)),
    "count_mean": lambda k: F.struct(k["n"] * (k["s"] / k["n"]), F.lit(0.0)),
}


def centroid(cluster: Column) -> Column:
    weight = F.when(cluster["s"] == 0, 1.0).otherwise(cluster["s"])
    return F.struct((cluster["sx"] / weight).alias("x"), (cluster["sy"] / weight).alias("y"))


def voted(clusters: Column, rule: str) -> Column:
    """(x, y) of the best cluster by a rule: its score-weighted centroid, or for top1 its first member; the earliest on ties."""
    key = RULES[rule]
    best = F.array_max(F.transform(clusters, lambda k, i: F.struct(key(k).alias("key"), (-i).alias("i"), k.alias("k"))))["k"]
    if rule == "top1":
        return c.named(best, lambda b: F.struct(b["x0"].alias("x"), b["y0"].alias("y")))
    return c.named(best, centroid)


def shortlisted(clusters: Column, k: int = 4) -> Column:
    """The k clusters with the greatest total confidence, the earlier first on ties, and their whole confidence."""
    order = F.sort_array(F.transform(clusters, lambda c, i: F.struct((-c["s"]).alias("s"), i.alias("i"), c.alias("k"))))
    return F.transform(F.slice(order, 1, k), lambda c: c["k"])


def verified(shortlist: Column, whole: Column, alpha: Column | float = 0.0) -> Column:
    """(x, y) of the shortlisted cluster that has the best check (the greatest of its members'), plus alpha times its share
    of the shortlist's whole confidence; the first on ties."""
    alpha = alpha if isinstance(alpha, Column) else F.lit(alpha)
    share = alpha / F.when(whole == 0, 1.0).otherwise(whole)
    value = lambda c, i: F.struct((c["check"] + share * c["s"]).alias("v"), (-i).alias("i"), c.alias("k"))
    best = F.array_max(F.transform(shortlist, value))["k"]
    return c.named(best, centroid)


def confidence(clusters: Column) -> Column:
    return F.aggregate(clusters, F.lit(0.0), lambda t, c: t + c["s"])


def routed(rows: DataFrame, thresholds: Sequence[float], ratio: str, cheap: str, costly: str, limit: float = 5.0) -> DataFrame:
    """threshold, acc, p99, passes, ok, chosen: the cheap answer where ratio <= threshold (1 pass), else the costly one (9).

    ok: no less accurate than always costly, and its p99 within 5 %. chosen: of those the one with the fewest
    passes, the least on ties. Rows are counted by the number of thresholds below their ratio and by their
    errors first; only those counts are taken once for each threshold.
    """
    grid = F.array(*(F.lit(float(t)) for t in sorted(thresholds)))
    below = F.size(F.filter(grid, lambda t: t < F.col(ratio)))
    kinds = F.explode(F.array(F.struct(F.lit(True).alias("fast"), F.col(cheap).alias("e")), F.struct(F.lit(False).alias("fast"), F.col(costly).alias("e"))))
    counts = rows.filter(F.col(ratio).isNotNull()).select(below.alias("_below"), kinds.alias("k")).groupBy("_below", "k.fast", "k.e").agg(F.count("*").alias("_n"))
    counts = stored(counts, "counts")  # read for each sum and quantile
    base = counts.filter("not fast").agg((F.sum(F.when(F.col("e") <= limit, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("_acc"))
    p99 = quantiles(counts.filter("not fast"), [], "e", {"_p99": 0.99}, F.col("_n"))
    long = counts.select("*", F.posexplode(grid).alias("_place", "threshold")).filter((F.col("_below") <= F.col("_place")) == F.col("fast"))
    one = long.groupBy("threshold").agg((F.sum(F.when(F.col("e") <= limit, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("acc"), (F.sum(F.when(F.col("fast"), 1.0).otherwise(9.0) * F.col("_n")) / F.sum("_n")).alias("passes"))
    one = joined(one, quantiles(long, ["threshold"], "e", {"p99": 0.99}, F.col("_n")), ["threshold"])
    one = one.crossJoin(base).crossJoin(p99).withColumn("ok", (F.col("acc") >= F.col("_acc")) & (F.col("p99") <= F.col("_p99") * 1.05))
    best = F.min(F.when(F.col("ok"), F.struct("passes", "threshold"))).over(Window.partitionBy(F.lit(0)))  # one row for each threshold
    return one.withColumn("_best", best).select("threshold", "acc", "p99", "passes", "ok", F.coalesce(F.col("threshold") == F.col("_best.threshold"), F.lit(False)).alias("chosen"))
