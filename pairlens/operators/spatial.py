"""Boxes, offset votes, grids of cells, and grouped fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..sources.io import shared_folder
from .aggregate import quantiles
from .joins import band_join


def bounding_boxes(vertices: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    return vertices.groupBy(*keys).agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))


def clipped(boxes: DataFrame, low: float, high: float, places: int = 1) -> DataFrame:
    """Distinct rounded boxes within a square window, in the window's coordinates."""
    cut = lambda c, s: F.round((F.greatest(F.col(c), F.lit(float(low))) if s else F.least(F.col(c), F.lit(float(high)))) - low, places)
    some = boxes.filter((F.col("x1") > low) & (F.col("x0") < high) & (F.col("y1") > low) & (F.col("y0") < high))
    return some.select("layer", cut("x0", 1).alias("u0"), cut("x1", 0).alias("u1"), cut("y0", 1).alias("w0"), cut("y1", 0).alias("w1")).distinct()


def with_centres(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2, "w": F.col("x1") - F.col("x0"), "h": F.col("y1") - F.col("y0")})


def interior(boxes: DataFrame, low: float, high: float) -> DataFrame:
    """Boxes strictly within a square window, moved to its origin."""
    some = boxes.filter((F.col("x0") > low) & (F.col("x1") < high) & (F.col("y0") > low) & (F.col("y1") < high))
    return some.withColumns({c: F.col(c) - low for c in ("x0", "x1", "y0", "y1")})


def box_matches(boxes: DataFrame, reference: DataFrame, guess: tuple[float, float], reach: float = 15.0, size: float = 0.3) -> DataFrame:
    """box_id, ref_id, dx, dy: boxes of a reference box's layer and size near where the guess puts it."""
    left = with_centres(boxes).select("layer", "box_id", "x0", "y0", (F.col("cx") - guess[0]).alias("cx"), (F.col("cy") - guess[1]).alias("cy"), "w", "h")
    right = with_centres(reference).select("layer", F.col("box_id").alias("ref_id"), F.col("x0").alias("rx0"), F.col("y0").alias("ry0"), F.col("cx").alias("rcx"), F.col("cy").alias("rcy"), F.col("w").alias("rw"), F.col("h").alias("rh"))
    met = band_join(left, right, ["layer"], [("cx", "rcx", reach), ("cy", "rcy", reach), ("w", "rw", size), ("h", "rh", size)])
    return met.select("layer", "box_id", "ref_id", (F.col("x0") - F.col("rx0")).alias("dx"), (F.col("y0") - F.col("ry0")).alias("dy"))


def offset_votes(matches: DataFrame, places: int = 2) -> DataFrame:
    return matches.groupBy(F.round("dx", places).alias("dx"), F.round("dy", places).alias("dy")).agg(F.count_distinct("ref_id").alias("votes"))


def voted_offset(matches: DataFrame, n_reference: DataFrame, few: int = 8, bars: tuple[float, float] = (0.8, 0.5)) -> DataFrame:
    """dx, dy, votes, support, accepted: the offset most boxes agree on (least offset on ties); few boxes need a higher bar."""
    best = offset_votes(matches).agg(F.max_by(F.struct("dx", "dy", "votes"), F.struct("votes", -F.col("dx"), -F.col("dy"))).alias("b"))
    one = best.crossJoin(n_reference.agg(F.count("*").alias("n")))
    support = F.col("b.votes") / F.col("n")
    return one.select("b.*", support.alias("support"), (support >= F.when(F.col("n") < few, bars[0]).otherwise(bars[1])).alias("accepted"))


def edge_differences(left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """layer, gap, n: differences e - r within reach of the edges of a layer, and how many pairs have each.

    Equal edges are counted on both sides first, so pairs of edges are never made one by one.
    """
    a = left.groupBy("layer", "e").agg(F.count("*").alias("na"))
    b = right.groupBy("layer", "r").agg(F.count("*").alias("nb"))
    met = band_join(a, b, ["layer"], [("e", "r", reach)])
    return met.groupBy("layer", (F.col("e") - F.col("r")).alias("gap")).agg(F.sum(F.col("na") * F.col("nb")).alias("n"))


def edge_votes(boxes: DataFrame, reference: DataFrame, edge: str, guess: float, reach: float = 15.0, top: int = 3) -> DataFrame:
    """d, votes: the most frequent differences of one edge between boxes and reference boxes of a layer."""
    votes = edge_differences(boxes.select("layer", (F.col(edge) - guess).alias("e")), reference.select("layer", F.col(edge).alias("r")), reach)
    votes = votes.groupBy(F.round(F.col("gap") + guess, 2).alias("d")).agg(F.sum("n").alias("votes"))
    return votes.orderBy(F.desc("votes"), "d").limit(top)


def cells(vectors: DataFrame, key: str, values: str, columns: int) -> DataFrame:
    """key, i, j, value: an array as a grid of rows of so many columns."""
    return vectors.select(key, F.posexplode(values).alias("p", "v")).select(key, F.floor(F.col("p") / columns).cast("int").alias("i"), (F.col("p") % columns).alias("j"), F.col("v").cast("double").alias("value"))


def local_maxima(surface: DataFrame, key: str, reach: int = 2, most: int = 3) -> DataFrame:
    """key, i, j, value, place: cells not below any neighbour, the strongest first.

    Each cell's value goes to its neighbours' places and is reduced there, map-side first.
    """
    span = F.sequence(F.lit(-reach), F.lit(reach))
    near = surface.select(key, "value", F.col("i"), F.explode(span).alias("a"), F.col("j")).withColumn("b", F.explode(span))
    peak = near.groupBy(key, (F.col("i") + F.col("a")).alias("i"), (F.col("j") + F.col("b")).alias("j")).agg(F.max("value").alias("_m"))
    tops = surface.join(peak, [key, "i", "j"]).filter("value >= _m").drop("_m")
    order = Window.partitionBy(key).orderBy(F.desc("value"), "i", "j")
    return tops.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def peak_choice(surface: DataFrame, key: str, centre: tuple[float, float], tie: float = 0.04, apart: int = 2) -> DataFrame:
    """key, i, j, value, ratio: of the cells within ``tie`` of the best the one nearest the centre; ratio of the best rival further than ``apart``."""
    best = surface.groupBy(key).agg(F.max("value").alias("_best"))
    far = F.hypot(F.col("i") - centre[0], F.col("j") - centre[1])
    near = surface.join(best, key).filter(F.col("value") >= F.col("_best") - tie * F.abs("_best"))
    one = near.groupBy(key).agg(F.min_by(F.struct("i", "j", "value"), F.struct(far, -F.col("value"), "i", "j")).alias("p"))
    rest = surface.join(one, key).filter(F.greatest(F.abs(F.col("i") - F.col("p.i")), F.abs(F.col("j") - F.col("p.j"))) > apart)
    rival = rest.groupBy(key).agg(F.max("value").alias("_r"))
    return one.join(rival, key, "left").select(key, "p.*", (F.col("_r") / F.nullif(F.col("p.value"), F.lit(0.0))).alias("ratio"))


def sidelobes(surface: DataFrame, key: str, half: int = 5, least: int = 16) -> DataFrame:
    """key, psr, apce: peak over sidelobes and over energy, without a window around the peak; 0 with few sidelobe cells."""
    peak = surface.groupBy(key).agg(F.max_by(F.struct("i", "j", "value"), F.struct("value", -F.col("i"), -F.col("j"))).alias("p"), F.min("value").alias("low"))
    joined = surface.join(peak, key)
    out = (F.abs(F.col("i") - F.col("p.i")) > half) | (F.abs(F.col("j") - F.col("p.j")) > half)
    side = F.when(out, F.col("value"))
    one = joined.groupBy(key).agg(F.first("p.value").alias("top"), F.first("low").alias("low"), F.count(side).alias("n"), F.avg(side).alias("m"), F.stddev_pop(side).alias("s"), F.avg(F.pow(F.col("value") - F.col("low"), 2)).alias("e"))
    few = F.col("n") < least
    return one.select(key, F.when(few | (F.col("s") == 0), 0.0).otherwise((F.col("top") - F.col("m")) / F.col("s")).alias("psr"), F.when(few | (F.col("e") == 0), 0.0).otherwise(F.pow(F.col("top") - F.col("low"), 2) / F.col("e")).alias("apce"))


def running_outliers(values: Column, half: int = 7, factor: float = 4.0) -> Column:
    """Values less their running median (edges repeated), kept only where over factor times 1.4826 MAD above it; else 0."""
    own = F.transform(values, lambda v: v.cast("double"))
    edge = lambda i: F.array_repeat(F.get(own, i), half)
    holes = F.exists(values, F.isnull)  # nulls count and come last; without them sort_array needs no interpreted comparisons
    middle = lambda xs, holes: F.get(F.when(holes, F.array_sort(xs)).otherwise(F.sort_array(xs)), F.floor((F.size(xs) + 1) / 2).cast("int") - 1)
    named = c.named
    around = F.concat(edge(F.lit(0)), own, edge(F.size(own) - 1))
    rest = lambda w, hole: F.transform(own, lambda v, i: v - middle(F.slice(w, i + 1, 2 * half + 1), hole))
    over = lambda r, mad: F.transform(r, lambda x: F.when(x > factor * 1.4826 * mad, x).otherwise(0.0))
    return named(holes, lambda hole: named(named(around, lambda w: rest(w, hole)), lambda r: named(middle(F.transform(r, F.abs), hole), lambda mad: over(r, mad))))


def coverage(masks: DataFrame, key: str, layer: str, mask: str) -> DataFrame:
    """key, layer, visible: what each layer shows below the higher ones; layer -1 is the background."""
    order = F.reverse(F.array_sort(F.collect_list(F.struct(F.col(layer).alias("l"), F.col(mask).alias("m")))))
    stack = masks.groupBy(key).agg(order.alias("s"))
    step = lambda acc, x: F.struct(F.concat(acc["out"], F.array(F.struct(x["l"].alias("l"), (acc["left"] * x["m"]).alias("v")))).alias("out"), (acc["left"] * (1 - x["m"])).alias("left"))
    start = F.struct(F.array().cast("array<struct<l:int,v:double>>").alias("out"), F.lit(1.0).alias("left"))
    full = stack.select(key, F.aggregate("s", start, step).alias("a"))
    every = F.concat("a.out", F.array(F.struct(F.lit(-1).alias("l"), F.col("a.left").alias("v"))))
    return full.select(key, F.inline(every)).select(key, F.col("l").alias(layer), F.col("v").alias("visible"))


def suppressed_top(values: Column, k: int, reach: int = 3) -> Column:
    """Positions of the k strongest values, none within ``reach`` of a stronger one taken before; first on ties."""
    order = F.reverse(F.array_sort(F.transform(values, lambda v, i: F.struct(v.cast("double").alias("v"), (-i).alias("i")))))
    start = F.array().cast("array<int>")
    take = lambda acc, x: F.when((F.size(acc) < k) & ~F.exists(acc, lambda p: F.abs(p + x["i"]) <= reach), F.concat(acc, F.array(-x["i"]))).otherwise(acc)
    return F.aggregate(order, start, take)


def settled(df: DataFrame) -> DataFrame:
    """A small table between rounds, kept in the session's checkpoint folder, so plans don't grow."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def plane_fit(rows: DataFrame, key: str, x: str, y: str, z: str, rounds: int = 3, floor: float = 0.15, least: int = 6) -> DataFrame:
    """key, a, b, c, n: z = a x + b y + c for each key, refitted without rows off by more than max(3 medians, floor).

    All keys are fitted at once: sums of the normal equations, then Cramer's rule; between rounds only one
    row for each key is kept. A key with fewer than ``least`` rows left keeps its last fit.
    """
    rows = rows.select(F.col(key).alias("_k"), *(F.col(n).cast("double").alias(m) for n, m in ((x, "x"), (y, "y"), (z, "z"))))
    kept, fit = rows, None
    for turn in range(rounds):
        p = lambda u, v: F.sum(F.col(u) * F.col(v))
        s = kept.groupBy("_k").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum("z").alias("sz"), p("x", "x").alias("xx"), p("x", "y").alias("xy"), p("y", "y").alias("yy"), p("x", "z").alias("xz"), p("y", "z").alias("yz"))
        det = lambda m: m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])
        m, r = [F.col(c) for c in ("xx", "xy", "sx", "xy", "yy", "sy", "sx", "sy", "n")], [F.col(c) for c in ("xz", "yz", "sz")]
        whole = F.nullif(det(m), F.lit(0.0))
        put = lambda k: [r[i // 3] if i % 3 == k else m[i] for i in range(9)]
        new = s.select("_k", "n", *((det(put(k)) / whole).alias(name) for k, name in enumerate("abc")))
        if fit is not None:
            new = fit.join(new.select("_k", *(F.col(c).alias(f"_{c}") for c in ("n", *"abc"))), "_k", "left").select("_k", *(F.when((F.col("_n") >= least) & F.col("_a").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("n", *"abc")))
        fit = settled(new)
        if turn + 1 < rounds:
            off = F.abs(F.col("z") - (F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c")))
            scored = rows.join(fit.select("_k", *"abc"), "_k").withColumn("_off", off)
            limit = settled(quantiles(scored, ["_k"], "_off", {"_mid": 0.5}).select("_k", F.greatest(3 * F.col("_mid"), F.lit(floor)).alias("_limit")))
            kept = scored.join(limit, "_k").filter("_off <= _limit").select("_k", "x", "y", "z")
    return fit.withColumnRenamed("_k", key)


def huber_fit(rows: DataFrame, key: str, inputs: Sequence[str], target: str, rounds: int = 4, width: float = 1.345) -> DataFrame:
    """key, weights (of the inputs, then the constant), r2: Huber-reweighted regression of each key.

    Each round sums the weighted normal equations of all keys in Spark; only one small row for each key
    reaches Python, to be solved, and only those rows are kept between rounds.
    """
    import numpy as np
    import pandas as pd

    k = len(inputs) + 1
    names = [f"_x{i}" for i in range(k)]
    rows = rows.select(F.col(key).alias("_k"), *(F.col(c).cast("double").alias(n) for c, n in zip(inputs, names[:-1], strict=True)), F.lit(1.0).alias(names[-1]), F.col(target).cast("double").alias("_z"))
    upper = [(i, j) for i in range(k) for j in range(i, k)]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.to_dict("records"):
            m, v = np.zeros((k, k)), np.array([r[f"v{i}"] for i in range(k)])
            for i, j in upper:
                m[i, j] = m[j, i] = r[f"m{i}_{j}"]
            out.append((r["_k"], np.linalg.lstsq(m, v, rcond=None)[0].tolist()))
        return pd.DataFrame(out, columns=["_k", "_b"])

    kind, weighted = rows.schema["_k"].dataType.simpleString(), rows.withColumn("_w", F.lit(1.0))
    for turn in range(rounds):
        w = F.col("_w")
        sums = weighted.groupBy("_k").agg(*(F.sum(w * F.col(names[i]) * F.col(names[j])).alias(f"m{i}_{j}") for i, j in upper), *(F.sum(w * F.col(n) * F.col("_z")).alias(f"v{i}") for i, n in enumerate(names)))
        fit = settled(sums.groupBy("_k").applyInPandas(solve, f"_k {kind}, _b array<double>"))
        guess = sum((F.col(n) * F.col("_b")[i] for i, n in enumerate(names)), F.lit(0.0))
        off = rows.join(fit, "_k").withColumn("_off", F.col("_z") - guess)
        if turn + 1 < rounds:
            scale = settled(quantiles(off.withColumn("_abs", F.abs("_off")), ["_k"], "_abs", {"_mid": 0.5}).select("_k", (1.4826 * F.col("_mid") + 1e-12).alias("_s")))
            u = F.abs("_off") / F.col("_s")
            weighted = off.join(scale, "_k").withColumn("_w", F.when(u <= width, 1.0).otherwise(width / u))
    r2 = 1 - F.sum(F.col("_off") * F.col("_off")) / F.nullif(F.var_pop("_z") * F.count("*"), F.lit(0.0))
    return off.groupBy("_k").agg(F.first("_b").alias("weights"), r2.alias("r2")).withColumnRenamed("_k", key)
