"""Document quality by naive Bayes features and a linear support vector machine.

Features are indicators of hashed character 3-grams, and of word n-grams whose last word is the same as
their first, whatever that word is, by the share of the words that such n-grams end at. Each is scaled by the log ratio of its smoothed
shares in the two classes; a linear model with hinge loss is fitted to the scaled indicators by dual
coordinate descent and turned into a probability on labelled rows that were kept out of the fit.

Fitting uses at most ``SAMPLE`` labelled documents, the first by a hash of their ids, so it costs the
same at any size; scoring reads every whole text once. Only the text is an input of a score.

Nulls count as empty texts; an empty text has no features and gets the model's bias. Rows without a
label, or whose documents are missing, teach nothing; repeated labels of an id are averaged, and of an
id's texts the least counts. Without rows of both classes all scores are the smoothed share of label 1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc_of_id, documents, slices, texts
from .shingles import word_hashes

#: Most labelled documents that a model is fitted to.
SAMPLE = 6000
BITS = 16
#: Distances at which a word may come again, and the shares from which that counts.
AGAIN, SHARES = (1, 2, 3), (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8)
N_FEATURES = (1 << BITS) + len(AGAIN) * len(SHARES)
THRESHOLD = 0.3


def repeats(texts: pa.Array) -> list[np.ndarray]:
    """Features of words that come again at a short distance."""
    words, lens = word_hashes(texts)
    text = np.repeat(np.arange(len(lens)), lens)
    found = np.zeros((len(lens), len(AGAIN), len(SHARES)), bool)
    for k, d in enumerate(AGAIN):
        same = (words[d:] == words[:-d]) & (text[d:] == text[:-d])
        share = np.bincount(text[d:][same], minlength=len(lens)) / np.maximum(lens, 1)
        found[:, k] = share[:, None] >= np.array(SHARES)
    return [(1 << BITS) + np.flatnonzero(f) for f in found.reshape(len(lens), -1)]


def features(texts: pa.Array):
    """Numbers of the features of each text, ascending (as an iterator of arrays)."""
    for a, b in slices(texts):
        part = pa.concat_arrays([texts.slice(a, b - a)])
        edges = np.concatenate([[0], np.cumsum(pc.binary_length(part).to_numpy(zero_copy_only=False))])
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[: edges[-1]].astype(np.uint32)
        gram = (data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)) if len(data) > 2 else data[:0]
        gram = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        for x, y, again in zip(edges[:-1].tolist(), edges[1:].tolist(), repeats(part), strict=True):
            seen = np.zeros(1 << BITS, bool)
            seen[gram[x : max(x, y - 2)]] = True
            yield np.concatenate([np.flatnonzero(seen), again])


def margin(weights: np.ndarray, bias: float, found: np.ndarray) -> float:
    return bias + float(weights[found].sum()) / max(1.0, np.sqrt(len(found)))


def log_ratios(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Each feature's log of its smoothed share in class 1 over that in class 0."""
    count = np.full((2, N_FEATURES), smooth)
    for found, label in zip(rows, labels, strict=True):
        count[int(label), found] += 1
    share = count / (np.bincount(labels.astype(int), minlength=2)[:, None] + 2 * smooth)
    return np.log(share[1] / share[0])


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = 1.0, rounds: int = 20, seed: int = 7):
    """Weights (with the ratios multiplied in) and bias of the hinge-loss model.

    One dual variable for each row, between 0 and its cost, is set to its best value in turn; rarer
    classes cost more in proportion. Stops when no variable's projected gradient is over 0.01.
    """
    sign = np.where(labels > 0, 1.0, -1.0)
    values = [ratios[f] / max(1.0, np.sqrt(len(f))) for f in rows]
    norm = np.array([float(v @ v) + 1.0 for v in values])
    most = cost * len(labels) / (2 * np.where(labels > 0, (labels > 0).sum(), (labels <= 0).sum()))
    dual, weights, bias = np.zeros(len(labels)), np.zeros(N_FEATURES), 0.0
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(len(labels)):
            slope = sign[i] * (float(weights[rows[i]] @ values[i]) + bias) - 1
            step = min(max(dual[i] - slope / norm[i], 0.0), most[i]) - dual[i]
            if abs(step) > 1e-12:
                worst = max(worst, abs(step) * norm[i])
                dual[i] += step
                weights[rows[i]] += step * sign[i] * values[i]
                bias += step * sign[i]
        if worst < 0.01:
            break
    return weights * ratios, bias


def sigmoid_fit(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities; Newton steps on smoothed targets."""
    n1, n0 = (labels > 0).sum(), (labels <= 0).sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.array([1.0, 0.0])
    x = np.stack([margins, np.ones_like(margins)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - target) + 1e-3 * (w - [1.0, 0.0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """A model from labelled documents whose crc32(doc_id as text) mod 5 is not 0."""
    known = labels.select("doc_id", "quality").dropna().filter(crc_of_id() % 5 != 0).join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(it):
        for batch in it:
            found = [f.astype(np.uint32).tobytes() for f in features(batch.column(1).cast(pa.large_string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], ["label", "found", "part"])

    rows = texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = rows.select("label", "text", (crc_of_id() % 5).cast("int").alias("part")).mapInArrow(run, "label int, found binary, part int").collect()
    found, y = [np.frombuffer(r["found"], np.uint32).astype(np.int64) for r in rows], np.array([r["label"] for r in rows], float)
    part = np.array([r["part"] for r in rows])
    test = part == 1
    if min((y[~test] > 0).sum(), (y[~test] <= 0).sum()) == 0:
        return {"weights": np.zeros(N_FEATURES), "bias": 0.0, "slope": 0.0, "offset": float(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))}
    own = [f for f, t in zip(found, test, strict=True) if not t]
    ratios = log_ratios(own, y[~test])
    weights, bias = dual_descent(own, y[~test], ratios)
    held = test if len(set(y[test])) == 2 else ~test
    slope, offset = sigmoid_fit(np.array([margin(weights, bias, f) for f, h in zip(found, held, strict=True) if h]), y[held])
    return {"weights": weights, "bias": bias, "slope": max(slope, 0.0), "offset": offset}


def score(docs: DataFrame, model: dict) -> Column:
    """The column of scores of text."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one fixed-size vector

    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        m = sent.value
        z = [m["slope"] * margin(m["weights"], m["bias"], f) + m["offset"] for f in features(pa.array(text, pa.large_string(), from_pandas=True))]
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))), dtype=float)

    return of(F.coalesce("text", F.lit("")))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    scored = docs.select("doc_id", score(docs, fit(docs, labels)).alias("score"))
    return scored.select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that aren't rejected."""
    return docs.filter(score(docs, fit(docs, labels)) >= threshold)


def op7_quality(spark, sf_dir):
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op7_quality": op7_quality}
