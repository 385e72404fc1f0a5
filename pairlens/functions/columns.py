"""Column expressions of an evaluation: errors, tiers, confidence statistics, gates, geometry.

All take columns (or names) and give columns; none needs a Python worker. NaN and infinite values are
"not computed" and become null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: bounds and credit of the scoring rubric
LOCATION_TIERS = ((1.0, 1.0), (2.0, 0.8), (3.0, 0.6), (5.0, 0.4))
SCALE_TIERS = ((0.01, 1.0), (0.02, 0.6), (0.05, 0.3))
ROTATION_TIERS = ((0.25, 1.0), (0.5, 0.6), (1.0, 0.3))
POSE_BOUNDS = {"scale": (8.0, 12.0), "theta": (-5.0, 5.0)}
# fixed values: bands of a confidence by how it came about
BANDS = {"absent": (0.0, 0.05), "unverified": (0.05, 0.10), "verified": (0.10, 1.0)}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The value, or null for NaN and infinities."""
    c = col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def location_error(x="x", y="y", gt_x="gt_x", gt_y="gt_y", present="gt_found") -> Column:
    return F.when(col(present) == 1, F.hypot(col(x) - col(gt_x), col(y) - col(gt_y)))


def tier(value: Column | str, tiers: Sequence[tuple[float, float]]) -> Column:
    """Credit of the first bound that the value doesn't exceed, else 0; null counts as beyond."""
    c = F.lit(0.0)
    for bound, credit in reversed(tiers):
        c = F.when(col(value) <= bound, credit).otherwise(c)
    return c


def scale_error(scale="scale", gt_scale="gt_scale") -> Column:
    gt = col(gt_scale)
    return F.abs(col(scale) - gt) / F.when(gt == 0, 1.0).otherwise(F.abs(gt))


def rotation_error(theta="theta", gt_rot="gt_rot") -> Column:
    return F.abs(col(theta) - col(gt_rot))


def clamp(c: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.least(col(c), F.lit(high)), F.lit(low))


def decide(threshold: float, score="score", pose=("x", "y", "theta", "scale")) -> dict[str, Column]:
    """found, and the pose columns zeroed where it is 0; a missing score is a refusal."""
    found = F.coalesce(finite(score) >= threshold, F.lit(False))
    return {"found": found.cast("int")} | {c: F.when(found, col(c)).otherwise(0.0) for c in pose}


def masked(credit: Column | str, found: Column | str) -> Column:
    """Credit of submitted rows; refused rows earn nothing."""
    return F.when(col(found) == 1, F.coalesce(col(credit), F.lit(0.0))).otherwise(0.0)


def centre_from_edge(c: Column | str) -> Column:
    """Pixel coordinates counted from edges to those counted from centres."""
    return col(c) - 0.5


def statistics(score="score", zncc="zncc", peak_ratio="peak_ratio", pose_peak="pose_peak") -> dict[str, Column]:
    """The named confidence statistics."""
    s, z, r, p = map(col, (score, zncc, peak_ratio, pose_peak))
    return {
        "score": s, "zncc": z, "min": F.least(s, z), "product": s * z,
        "root": F.sqrt(F.greatest(s, F.lit(0.0)) * F.greatest(z, F.lit(0.0))), "mean": (s + z) / 2,
        "distinct": s * (1 - r), "min_pose": F.least(z, p),
    }


def stacked(values: Mapping[str, Column], name: str = "stat", value: str = "value") -> Column:
    """An exploding column of (name, value) structs."""
    return F.inline(F.array(*(F.struct(F.lit(k).alias(name), v.cast("double").alias(value)) for k, v in values.items())))


def derived(score="score", zncc="zncc", peak_ratio="peak_ratio", pose_peak="pose_peak", n_hyp="n_hyp") -> dict[str, Column]:
    s, z, r, p = map(col, (score, zncc, peak_ratio, pose_peak))
    return {
        "f_min": F.least(s, z), "f_prod": s * z, "f_gap": F.abs(s - z), "f_ratio": s / F.greatest(z, F.lit(1e-6)),
        "f_peak_pose": r * p, "f_n_hyp": F.coalesce(col(n_hyp), F.lit(0)).cast("double"),
    }


def zero_if_missing(c: Column | str) -> Column:
    return F.coalesce(finite(c), F.lit(0.0))


def sigmoid(z: Column) -> Column:
    """1 / (1 + exp(-z)) without overflow for either sign."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def logistic_score(weights: Mapping[str, float], bias: float, columns: Iterable[str]) -> Column:
    """A frozen linear scorer; a row with a missing feature scores 0, a missing column is an error."""
    absent = [c for c in weights if c not in set(columns)]
    if absent:
        raise KeyError(f"no columns {absent}")
    z = reduce(lambda a, b: a + b, (F.lit(w) * finite(c) for c, w in weights.items()), F.lit(bias))
    return F.coalesce(sigmoid(z), F.lit(0.0))


def log_loss(p: Column | str, label: Column | str, clip: float = 1e-12) -> Column:
    p = clamp(p, clip, 1 - clip)
    return -F.when(col(label) == 1, F.log(p)).otherwise(F.log(1 - p))


def early_exit(gates: Sequence[tuple[float, float, float, float | None]], score="score", zncc="zncc", ratio="peak_ratio", gap="gap") -> Column:
    """Whether any gate (least score, least zncc, greatest ratio, least gap or None) holds; missing values never do."""
    any_ = F.lit(False)
    for s, z, r, g in gates:
        hit = (finite(score) >= s) & (finite(zncc) >= z) & (finite(ratio) <= r)
        if g is not None:
            hit = hit & (finite(gap) >= g)
        any_ = any_ | F.coalesce(hit, F.lit(False))
    return any_


def banded(kind: Column | str, confidence: Column | str) -> Column:
    """A confidence from 0 to 1 put into the band of its kind."""
    c, out = clamp(confidence, 0.0, 1.0), F.lit(None).cast("double")
    for name, (low, high) in BANDS.items():
        out = F.when(col(kind) == name, low + c * (high - low)).otherwise(out)
    return out


def lookup(key: Column | str, table: Mapping, default=None) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(col(key) == k, F.lit(v)).otherwise(out)
    return out


def prefix(c: Column | str, separator: str = "_") -> Column:
    return F.split_part(col(c), F.lit(separator), F.lit(1))


def truthy(c: Column | str) -> Column:
    return F.lower(F.trim(col(c).cast("string"))).isin("1", "true", "yes", "y")


def first_filled(columns: Sequence[str], present: Iterable[str], default=None) -> Column:
    """The first non-empty of those columns that exist, else the default."""
    have = set(present)
    some = [F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns if c in have]
    return F.coalesce(*some, F.lit(default)) if some else F.lit(default)


def dense(sparse: Column | str, n: int) -> Column:
    """A map from place to value as an array of n values, 0 where it has none."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.element_at(col(sparse), i), F.lit(0)))


def brightness(place: Column | str, count: Column | str, low: float = 0.25, high: float = 0.95) -> Column:
    """Grey value of a layer by its place in a stack, rounded half to even."""
    share = F.lit(low) + (high - low) * (col(place) / F.greatest(col(count) - 1, F.lit(1)))
    return F.bround(clamp(share, 0.0, 1.0) * 255, 0).cast("int")


def rooted(path: Column | str) -> Column:
    """Whether a path is absolute: /x, \\\\host\\x, C:\\x or C:/x."""
    return col(path).rlike(r"^(/|\\\\|[A-Za-z]:[\\/])")


def resolved(path: Column | str, base: str) -> Column:
    return F.when(rooted(path), col(path)).otherwise(F.concat_ws("/", F.lit(base.rstrip("/")), col(path)))


def affine(scale: Column, degrees: Column, tx: Column, ty: Column) -> dict[str, Column]:
    """The six coefficients of x' = a x + b y + c, y' = d x + e y + f."""
    c, s = scale * F.cos(F.radians(degrees)), scale * F.sin(F.radians(degrees))
    return {"a": c, "b": -s, "c": tx, "d": s, "e": c, "f": ty}


def apply_affine(m: Mapping[str, Column], x: Column, y: Column) -> tuple[Column, Column]:
    return m["a"] * x + m["b"] * y + m["c"], m["d"] * x + m["e"] * y + m["f"]


def available(rows: DataFrame, features: Sequence[str], least: float = 0.5) -> DataFrame:
    """feature, share, usable: how often each feature is finite; one that no column has is not usable."""
    there = [x for x in features if x in rows.columns]
    shares = rows.agg(F.lit(0).alias("_none"), *(F.avg(finite(x).isNotNull().cast("double")).alias(x) for x in there))
    long = shares.select(stacked({x: F.col(x) if x in there else F.lit(0.0) for x in features}, "feature", "share"))
    return long.select("feature", "share", (F.col("share") >= least).alias("usable"))


def invert_affine(m: Mapping[str, Column]) -> dict[str, Column]:
    det = m["a"] * m["e"] - m["b"] * m["d"]
    a, b, d, e = m["e"] / det, -m["b"] / det, -m["d"] / det, m["a"] / det
    return {"a": a, "b": b, "c": -(a * m["c"] + b * m["f"]), "d": d, "e": e, "f": -(d * m["c"] + e * m["f"])}


def label_offset(magnification: Column | str) -> Column:
    m = col(magnification)
    return (m - 1) / (2 * m)


def barrel(r: Column, k: float) -> Column:
    """Radius after barrel distortion."""
    return r * (1 + k * r * r)


def barrel_inverse(distorted: Column, k: float, steps: int = 50) -> Column:
    """The radius whose distortion is given, by Newton steps."""
    step = lambda r, _: r - (r * (1 + k * r * r) - distorted) / (1 + 3 * k * r * r)
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), distorted.cast("double"), step)


def corrected_label(x: Column, y: Column, shift: Column, k: float, size: int) -> tuple[Column, Column]:
    """Where a labelled point is seen after a drift of its row (shift, to the right) and barrel distortion k of a square image."""
    middle = (size - 1) / 2.0
    u, w = (x - shift - middle) / middle, (y - middle) / middle
    r = F.hypot(u, w)
    scale = F.when(r < 1e-12, 1.0).otherwise(barrel_inverse(r, k) / r)
    return u * scale * middle + middle, w * scale * middle + middle


def dihedral(t: Column, x: Column, y: Column, size: Column | float) -> tuple[Column, Column]:
    """A point of a square under the symmetry t: t % 4 quarter turns, mirrored first if t >= 4."""
    last = (size if isinstance(size, Column) else F.lit(size)) - 1
    x = F.when(t >= 4, last - x).otherwise(x)
    turn = t % 4
    return (
        F.when(turn == 1, y).when(turn == 2, last - x).when(turn == 3, last - y).otherwise(x),
        F.when(turn == 1, last - x).when(turn == 2, last - y).when(turn == 3, x).otherwise(y),
    )


def dihedral_inverse(t: Column, x: Column, y: Column, size: Column | float) -> tuple[Column, Column]:
    """Undoes dihedral."""
    last = (size if isinstance(size, Column) else F.lit(size)) - 1
    turn = t % 4
    u = F.when(turn == 1, last - y).when(turn == 2, last - x).when(turn == 3, y).otherwise(x)
    v = F.when(turn == 1, x).when(turn == 2, last - y).when(turn == 3, last - x).otherwise(y)
    return F.when(t >= 4, last - u).otherwise(u), v


def parabola(left: Column, mid: Column, right: Column) -> Column:
    """Place of the top of a parabola through three points, within one step; 0 where it has none."""
    bend = left - 2 * mid + right
    return F.when(F.abs(bend) < 1e-12, 0.0).otherwise(clamp((left - right) / (2 * bend), -1.0, 1.0))


def correlation(a: Column, b: Column, weights: Column | None = None) -> Column:
    """(Weighted) normalised correlation of two equal arrays; 0 where either is flat."""
    w = F.transform(a, lambda _: F.lit(1.0)) if weights is None else weights
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    times = lambda u, v: F.zip_with(u, v, lambda p, q: p.cast("double") * q.cast("double"))
    n = total(F.transform(w, lambda x: x.cast("double")))
    ma, mb = total(times(w, a)) / n, total(times(w, b)) / n
    cov = total(times(w, times(a, b))) / n - ma * mb
    va, vb = total(times(w, times(a, a))) / n - ma * ma, total(times(w, times(b, b))) / n - mb * mb
    return F.when((va <= 1e-12) | (vb <= 1e-12), 0.0).otherwise(cov / F.sqrt(va * vb))


def content_hash(payload: Column | str) -> Column:
    """SHA-256 of a text or bytes, in hex."""
    return F.sha2(col(payload).cast("binary"), 256)


def utc_text(time: Column) -> Column:
    """A time as a UTC text, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(time.cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def named(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value worked out once: an array's only element is a variable, whereas a column is worked out wherever it stands."""
    return F.transform(F.array(value), f)[0]
