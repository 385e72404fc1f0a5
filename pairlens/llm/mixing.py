"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words. Among all rates r >= 0 of its documents that meet the target,
with no rate above ``most``, the ones nearest to taking every document once (least sum of r log r - r)
are r = min(most, exp(m * size)), with one multiplier m for each source: documents' rates are tilted
exponentially by what they add to the constraint. The multipliers minimise the convex dual. Constraints of
different sources share no document, so the dual's Hessian is diagonal and a Newton step of all sources
is one aggregate; rates depend on (source, size) alone, so steps run over counts of those pairs, which are
exact and far fewer than the documents. A bracket around each root turns a step that leaves it into a bisection.

Rates become copies by carrying the words rounded off from longer documents to shorter ones, so a source's
words miss its target by about half of its shortest documents' size, as long as these can take what is carried. Which documents of equal source and size
get the odd copy is told by a hash of id and text, and sums are exact, so reruns agree to the last bit.

Defined results: a null text has size 0; documents without words take nothing; a null source is a source
of its own, the last; repeated rows are documents of their own; an empty table gives none; other columns,
whatever their names, are not looked at. No task has a source's documents at once: those of one size
are numbered in buckets of their hash. The carrying sees one row for each distinct size of a source;
n distinct sizes need n * n / 2 words, so even 10^13 words have fewer than five million.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, partitions, settle

WEIGHTS = (5.0, 2.0, 1.0)  # of the sources in order, repeating
SHARE = 1.5  # words of the mix for each word there is
MOST = 2.0  # times that a document may be taken
CLOSE = 1e-9  # of the target
STEPS = 80  # a bisection alone would be as close by then


def sized(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, key (of the source), size (words), place (a hash of id and text), bucket (of the place) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # a prefix keeps the empty name apart from none at all
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select("doc_id", key.alias("key"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), F.xxhash64(F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text).alias("place"))
    return rows.withColumn("bucket", F.pmod("place", F.lit(buckets)).cast("int"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """key, source_size, target from key, source_size: words shared by weight; what exceeds most times the source's words
    is shared again among the others.

    That ends where all targets are min(most * source_size, level * weight) for one level. Sources in order of the level
    at which they fill: the first that doesn't fill at the level which those behind it would have, sets it. The windows
    see one row for each source.
    """
    order = Window.orderBy(F.col("key") == "", "key")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("turn") % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("turn", F.row_number().over(order) - 1).withColumn("weight", weight).withColumn("room", most * F.col("source_size"))
    by_level = Window.orderBy(F.col("room") / F.col("weight"), "turn")
    full = F.coalesce(F.sum("room").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (share * F.sum("source_size").over(Window.partitionBy()) - full) / left
    some = rows.withColumn("level", level).withColumn("sets", F.when(F.col("level") * F.col("weight") <= F.col("room"), F.struct(F.row_number().over(by_level).alias("at"), "level")))
    one = F.min("sets").over(Window.partitionBy())["level"]
    return some.select("key", "source_size", F.coalesce(F.least("room", one * F.col("weight")), "room").alias("target"))


def _rate(multiplier: Column, size: Column, most: float) -> Column:
    return F.exp(F.least(multiplier * size, F.log(F.lit(most))))


def _exact(value: Column, digits: int = 10) -> Column:
    """A sum that doesn't depend on the order of the rows: of decimals."""
    return F.sum(value.cast(f"decimal(38,{digits})")).cast("double")


def multipliers(counts: DataFrame, wanted: DataFrame, most: float = MOST, close: float = CLOSE) -> DataFrame:
    """key, multiplier: the dual's solution; counts has key, size, n (sizes above 0), wanted has key and target (from ``targets``).

    Sources whose target is all they can give have a null multiplier: every rate is ``most``.
    """
    size, n = F.col("size").cast("double"), F.col("n")
    facts = counts.groupBy("key").agg(_exact(n * size, 0).alias("s1"), _exact(n * size * size, 0).alias("s2"), F.min("size").alias("least"))
    ratio = F.log(F.col("target") / F.col("s1"))
    # the root lies between 0 and what the shortest document would need alone; where all had the mean size is a start on the side Newton comes from
    edge = ratio / F.col("least")
    state = wanted.join(facts, "key").select(
        "key", "target", F.least(F.lit(0.0), edge).alias("low"), F.greatest(F.lit(0.0), edge).alias("high"), (ratio * F.col("s1") / F.col("s2")).alias("m"), (F.col("target") >= most * F.col("s1") * (1 - close)).alias("full"), F.lit(False).alias("done")
    )
    state = settle(state.withColumn("done", F.col("full") | (F.col("target") <= 0)))
    for _ in range(STEPS):
        if not state.filter("not done").limit(1).count():
            break
        rate = _rate(F.col("m"), size, most)
        bends = F.when(F.col("m") * size < F.log(F.lit(most)), n * size * size * rate).otherwise(0.0)
        seen = counts.join(state.filter("not done").select("key", "m"), "key").groupBy("key").agg(_exact(n * size * rate).alias("g"), _exact(bends).alias("h"))
        off = F.col("g") - F.col("target")
        state = state.join(seen, "key", "left").withColumn("low", F.when(off < 0, F.greatest("low", "m")).otherwise(F.col("low"))).withColumn("high", F.when(off > 0, F.least("high", "m")).otherwise(F.col("high")))
        step, middle = F.col("m") - off / F.col("h"), (F.col("low") + F.col("high")) / 2
        near = F.abs(off) <= close * F.col("target")
        moved = F.when((F.col("h") > 0) & (step >= F.col("low")) & (step <= F.col("high")), step).otherwise(middle)
        state = settle(state.select("key", "target", "low", "high", F.when(F.col("done") | near, F.col("m")).otherwise(moved).alias("m"), "full", (F.col("done") | near).alias("done")))
    return state.select("key", F.when(~F.col("full"), F.col("m")).alias("multiplier"))


def _carried(rates: DataFrame, most: float) -> DataFrame:
    """key, size, n, rate, copies (of all n documents together): the longest first, what was rounded off goes on to the next size."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ascending=False)
        owed, copies = 0.0, []
        for size, n, rate in zip(rows["size"].tolist(), rows["n"].tolist(), rows["rate"].tolist(), strict=True):
            owed += size * n * rate
            k = min(max(round(owed / size), 0), int(most * n))
            owed -= size * k
            copies.append(k)
        return rows.assign(copies=copies)[["key", "size", "n", "rate", "copies"]]

    return rates.groupBy("key").applyInPandas(run, "key string, size long, n long, rate double, copies long")


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target (of its source), taken (words), copies, rate of every row; docs has doc_id, text, source."""
    rows = settle(sized(docs, max(64, partitions(docs.sparkSession))))
    parts = settle(rows.groupBy("key", "size", "bucket").agg(F.count("*").alias("n")))
    wanted = settle(targets(parts.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most))
    counts = settle(parts.filter("size > 0").groupBy("key", "size").agg(F.sum("n").alias("n")))
    solved = multipliers(counts, wanted, most)
    rate = F.coalesce(_rate(F.col("multiplier"), F.col("size"), most), F.lit(float(most)))
    plan = settle(_carried(counts.join(solved, "key").select("key", "size", "n", rate.alias("rate")), most))
    # documents of one size and source are numbered within buckets of their hash, which are numbered in turn
    before = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("key", "size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    starts = starts.join(plan, ["key", "size"], "left").join(wanted, "key")
    number = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("place", "doc_id")) - 1
    met = rows.withColumn("number", number).join(starts, ["key", "size", "bucket"])
    odd = F.when(F.col("start") + F.col("number") < F.col("copies") % F.col("n"), 1).otherwise(0)
    copies = F.coalesce(F.floor(F.col("copies") / F.col("n")) + odd, F.lit(0)).cast("long")
    return met.withColumn("copies", copies).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", F.coalesce("rate", F.lit(0.0)).alias("rate"))


def op11_mixing(spark, sf_dir):
    return mixed(documents(spark, sf_dir))


QUERIES = {"op11_mixing": op11_mixing}
