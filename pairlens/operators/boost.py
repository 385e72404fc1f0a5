"""Boosted trees of second order: splits and leaves from sums of gradients and curvatures, one pass over the rows for each level."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from ..sources.io import stored
from .aggregate import selected
from .passes import summed

#: Trees whose answers are worked out anew in each pass, until the rows are written with them.
KEPT = 8


def _filled(rows: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Each feature's median, which stands for missing values."""
    some = rows.select(*(c.finite(x).alias(f"_f{i}") for i, x in enumerate(features)))
    one = selected(some, [], {f"m{i}": (f"_f{i}", 0.5) for i in range(len(features))}).first()
    return {x: (one[f"m{i}"] if one and one[f"m{i}"] is not None else 0.0) for i, x in enumerate(features)}


def _cuts(rows: DataFrame, n: int, bins: int) -> list[np.ndarray]:
    """Each feature's bins as the greatest values in them: at most so many, about as full as each other, and every distinct value
    one of its own in a column of fewer values than bins' shares can miss."""
    shares = [k / bins for k in range(1, bins + 1)]
    one = rows.agg(*(F.percentile_approx(f"_f{i}", shares, 10_000).alias(f"_f{i}") for i in range(n))).first()
    return [np.unique(np.array(one[f"_f{i}"] or [0.0])) for i in range(n)]


def _places(cuts: list[np.ndarray], x: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.minimum(np.searchsorted(e, v, side="left"), len(e) - 1) for e, v in zip(cuts, x, strict=True)])


def _leaf(tree: list, columns: Sequence[np.ndarray], limit: int, k: int = 0):
    """The leaf that each row ends in, below node k: a tree is a list of (feature, last bin that goes left, left, right, greatest
    value that goes left) or of leaves; limit is 1 for columns of bins and 4 for values."""
    node = tree[k]
    if not isinstance(node, tuple):
        return np.min_scalar_type(len(tree)).type(k)
    return np.where(columns[node[0]] <= node[limit], _leaf(tree, columns, limit, node[2]), _leaf(tree, columns, limit, node[3]))


def _values(tree: list, columns: Sequence[np.ndarray], limit: int = 1):
    return np.array([0.0 if isinstance(n, tuple) else n for n in tree])[_leaf(tree, columns, limit)]


def _spread(blocks: DataFrame) -> RDD:
    """The blocks on all cores, planned once and kept for many passes."""
    rows, most = blocks.rdd, min(blocks.sparkSession.sparkContext.defaultParallelism, blocks.count())
    return (rows if rows.getNumPartitions() >= most else blocks.repartition(most).rdd).persist(StorageLevel.MEMORY_AND_DISK)


def _best(sums: np.ndarray, lam: float, least: int):
    """(feature, bin that ends the left side, next bin with rows) of the greatest gain, or None; sums has g, h, n of each (feature, bin)."""
    g, h, n = sums
    whole = g[0].sum(), h[0].sum(), n[0].sum()
    found = None
    for j in range(g.shape[0]):
        some = np.flatnonzero(n[j])
        gl, hl, nl = (np.cumsum(v[j][some])[:-1] for v in (g, h, n))
        ok = (nl >= least) & (whole[2] - nl >= least)
        if not ok.any():
            continue
        gain = np.where(ok, gl**2 / (hl + lam) + (whole[0] - gl) ** 2 / (whole[1] - hl + lam) - whole[0] ** 2 / (whole[1] + lam), -np.inf)
        k = int(np.argmax(gain))
        if found is None or gain[k] > found[0]:
            found = (gain[k], j, int(some[k]), int(some[k + 1]))
    return None if found is None or found[0] <= 1e-9 else found[1:]


def boosted(rows: DataFrame, features: Sequence[str], label: str, rounds: int = 200, depth: int = 3, rate: float = 0.06, least: int = 25, lam: float = 1.0, bins: int = 256) -> dict:
    """A model of ``rounds`` trees for a label of 0 and 1 under the logistic loss.

    A leaf is -G / (H + lam), a split's gain G_l^2 / (H_l + lam) + G_r^2 / (H_r + lam) - G^2 / (H + lam), with at least so many
    rows on both sides; missing values are the feature's median. Rows are placed in bins once and written
    as blocks of bins, labels and answers; each level of a tree is one pass over the blocks that sums g, h and rows of every
    (node, feature, bin) within its tasks. Those sums are as large as the tree's level, whatever the rows. With more bins than distinct values the trees are those of a search over all values;
    else a bin is known by its greatest value, and a split lies between two of those.
    """
    middle = _filled(rows, features)
    names = [f"_f{i}" for i in range(len(features))]
    some = stored(rows.select(*(F.coalesce(c.finite(x), F.lit(middle[x])).alias(n) for x, n in zip(features, names, strict=True)), F.col(label).cast("double").alias("_y"), F.lit(0.0).alias("_m")), "boost")
    cuts = _cuts(some, len(features), bins)
    width = max(map(len, cuts))
    share = min(max(some.agg(F.avg("_y")).first()[0] or 0.0, 1e-6), 1 - 1e-6)
    bias, trees, fresh, kind = float(np.log(share / (1 - share))), [], [], np.min_scalar_type(width - 1)

    def blocks(it):
        for batch in it:
            *x, y, m = (column.to_numpy(zero_copy_only=False) for column in batch.columns)
            yield block(_places(cuts, x).astype(kind), y, m)

    def block(*arrays):
        return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], ["x", "y", "m"])

    def read(x, y, m, fresh):
        places, m = np.frombuffer(x, kind).reshape(len(names), -1), np.frombuffer(m)
        for t in fresh:
            m = m + rate * _values(t, places)
        return places, np.frombuffer(y), m

    def sums(table, tree, open_nodes, fresh):
        n = len(open_nodes)
        slot = np.array([open_nodes.index(k) if k in open_nodes else n for k in range(len(tree))])

        def run(it):
            total = np.zeros((3, len(names), (n + 1) * width))  # the last part is of rows in no open node
            for row in it:
                places, y, m = read(*row, fresh)
                p = 1 / (1 + np.exp(-(bias + m)))
                g, h = p - y, np.maximum(p * (1 - p), 1e-6)
                at = slot[_leaf(tree, places, 1)] * width
                for j in range(len(names)):
                    here = places[j] + at
                    for v, w in enumerate((g, h, None)):
                        total[v, j] += np.bincount(here, w, total.shape[2])
            yield total

        return summed(table, run).reshape(3, len(names), n + 1, width).transpose(2, 0, 1, 3)[:n]

    def written(fresh):
        def run(it):
            for batch in it:
                for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                    places, y, m = read(*row, fresh)
                    yield block(places, y, m)

        return stored(some.mapInArrow(run, some.schema), "boost")

    some = stored(some.mapInArrow(blocks, "x binary, y binary, m binary"), "boost")
    table = _spread(some)
    for turn in range(rounds):
        tree, open_nodes = [None], [0]
        for level in range(depth + 1):
            if not open_nodes:
                break
            if level < depth:
                got = dict(zip(open_nodes, sums(table, tree, open_nodes, fresh), strict=True))
            open_next = []
            for node in open_nodes:
                if level == depth:
                    tree[node] = tree[node][0]
                    continue
                g, h, n = (got[node][v][0].sum() for v in range(3))
                split = _best(got[node], lam, least) if n >= 2 * least else None
                if split is None:
                    tree[node] = -g / (h + lam)
                    continue
                j, last, _ = split
                left = got[node][:2, j, : last + 1].sum(axis=1)
                at = len(tree)
                tree[node] = (j, last, at, at + 1, (cuts[j][last] + cuts[j][split[2]]) / 2)
                # a child that isn't looked at again is a leaf of these sums
                tree += [[-left[0] / (left[1] + lam)], [-(g - left[0]) / (h - left[1] + lam)]]
                open_next += [at, at + 1]
            open_nodes = open_next
        trees.append(tree)
        fresh.append(tree)
        if len(fresh) == KEPT and turn + 1 < rounds:
            some, fresh = written(fresh), []
            table.unpersist()
            table = _spread(some)
    table.unpersist()
    return {"features": list(features), "middle": middle, "cuts": cuts, "bias": bias, "rate": rate, "trees": trees}


def margin(model: dict) -> Column:
    """The model's log odds of a row, as a column."""
    names, middle = model["features"], [model["middle"][x] for x in model["features"]]

    @F.pandas_udf("double")
    def run(x: pd.DataFrame) -> pd.Series:
        values = [np.where(np.isfinite(v), v, m) for v, m in zip((x[k].to_numpy(float) for k in x.columns), middle, strict=True)]
        out = np.full(len(x), model["bias"])
        for tree in model["trees"]:
            out += model["rate"] * _values(tree, values, 4)
        return pd.Series(out)

    return run(F.struct(*(F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(names))))


def predicted(model: dict) -> Column:
    return c.sigmoid(margin(model))
