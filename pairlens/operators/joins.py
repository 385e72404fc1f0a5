"""Joins of an evaluation: scoring, alignment, reconciliation, band joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class MissingRows(ValueError):
    """A side of a join lacks rows that it must have."""


def scoring_join(truth: DataFrame, jury: DataFrame, predictions: DataFrame, key: str = "pair_id", check: bool = True) -> DataFrame:
    """truth with the jury's columns and the predictions; a pair without a prediction is an error."""
    out = truth.join(jury, key).join(predictions.withColumn("_has", F.lit(1)), key, "left")
    if check:
        lost = [r[key] for r in out.filter("_has is null").select(key).limit(5).collect()]
        if lost:
            raise MissingRows(f"no predictions for {lost} (and maybe more)")
    return out.drop("_has")


def lenient_join(truth: DataFrame, run: DataFrame, key: str = "pair_id", pose: Sequence[str] = ("x", "y", "theta", "scale")) -> DataFrame:
    """Pairs that the run has; a missing found is -1, missing poses are 0."""
    out = truth.join(run, key)
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in pose if c in out.columns} | {"found": F.coalesce("found", F.lit(-1))})


def enriched(rows: DataFrame, parameters: DataFrame, wanted: Sequence[str], key: str = "pair_id") -> DataFrame:
    """rows with those of the wanted parameter columns that exist and that rows don't have yet."""
    some = [c for c in wanted if c in parameters.columns and c not in rows.columns]
    return rows.join(parameters.select(key, *some), key, "left")


def one_sided(left: DataFrame, right: DataFrame, key: str = "pair_id") -> DataFrame:
    """One row: keys on both sides, only left, only right, and keys that either side repeats."""
    count = lambda d, n: d.groupBy(key).agg(F.count("*").alias(n))
    both = count(left, "l").join(count(right, "r"), key, "full")
    return both.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"), F.count_if((F.coalesce("l", F.lit(1)) > 1) | (F.coalesce("r", F.lit(1)) > 1)).alias("repeated"))


def aligned(left: DataFrame, right: DataFrame, key: str = "pair_id") -> DataFrame:
    """left joined to right, whose other columns get the ending _b; keys that differ are an error."""
    n = one_sided(left, right, key).first()
    if n["only_left"] or n["only_right"] or n["repeated"]:
        raise MissingRows(f"runs don't pair up: {n.asDict()}")
    return left.join(right.select(key, *(F.col(c).alias(f"{c}_b") for c in right.columns if c != key)), key)


def reconciled(claimed: DataFrame, present: DataFrame, key: str, digest: str) -> DataFrame:
    """key, finding: claimed but missing, present but not claimed, or with another digest."""
    x, y = claimed.select(key, F.col(digest).alias("_x")), present.select(key, F.col(digest).alias("_y"))
    lost = x.join(y, key, "left_anti").select(key, F.lit("missing").alias("finding"))
    extra = y.join(x, key, "left_anti").select(key, F.lit("unclaimed").alias("finding"))
    other = x.join(y, key).filter("_x <> _y").select(key, F.lit("digest").alias("finding"))
    return lost.unionByName(extra).unionByName(other)


def near_cells(value: Column, radius: float) -> Column:
    """The cell of a value on a grid as wide as the radius, and its two neighbours."""
    cell = F.floor(value / radius)
    return F.array(cell - 1, cell, cell + 1)


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], bands: Sequence[tuple[str, str, float]]) -> DataFrame:
    """Rows of both sides with equal keys whose values differ by at most the radius in each band.

    bands: (left column, right column, radius). The first two bands become grid cells: each right row is
    copied to the neighbouring cells (3, or 9 for two), so the join is an equi-join on keys and cells, and
    the exact differences are checked on what meets. Put the smaller side right.
    """
    grid = bands[:2]
    for i, (_, r, radius) in enumerate(grid):
        right = right.withColumn(f"_c{i}", F.explode(near_cells(F.col(r), radius)))
    for i, (l, _, radius) in enumerate(grid):  # noqa: E741
        left = left.withColumn(f"_c{i}", F.floor(F.col(l) / radius))
    met = left.join(right, [*keys, *(f"_c{i}" for i in range(len(grid)))])
    for l, r, radius in bands:  # noqa: E741
        met = met.filter(F.abs(F.col(l) - F.col(r)) <= radius)
    return met.drop(*(f"_c{i}" for i in range(len(grid))))


def fan_out(rows: DataFrame, variants: DataFrame) -> DataFrame:
    """Each row with every variant of a small table of settings (checked: at most 1000)."""
    if variants.limit(1001).count() > 1000:
        raise ValueError("too many variants to send everywhere")
    return rows.crossJoin(F.broadcast(variants))
