"""Bottom-k sketches of shingle hashes.

A fingerprint is the k smallest distinct hashes of a text's five-word shingles. Sketches of parts
merge into the sketch of the whole (keep the k smallest of the union), and two of them estimate
resemblance, containment and distinct counts. As text: base64 of the hashes, big-endian, ascending.

Nulls count as empty texts; an empty text has an empty sketch, and two empty sketches are alike (1).
A row's next row is the next by doc_id (nulls first), then by the text's digest. Document ids are whole
numbers; any other type is refused with a TypeError.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, partitions, texts, whole_ids
from .shingles import shingle_hashes

K = 128


def sketches(column: pa.Array, k: int = K) -> list[np.ndarray]:
    hashes, lens = shingle_hashes(column)
    ends = np.cumsum(lens)
    out = []
    for a, b in zip((ends - lens).tolist(), ends.tolist(), strict=True):
        h = hashes[a:b]
        if len(h) > 4 * k and (few := np.unique(h[h <= np.partition(h, 2 * k)[2 * k]])).size >= k:
            h = few
        out.append(np.unique(h)[:k])
    return out


def as_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the two texts' distinct shingles that both have."""
    both = np.union1d(a, b)[:k]
    if not len(both):
        return 1.0
    return float(np.isin(both, np.intersect1d(a, b, True)).sum() / len(both))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[-1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's distinct shingles that b has too."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merged(a, b, k), k) / distinct(a, k))


def merge_parts(parts: DataFrame, key: str, k: int = K) -> DataFrame:
    """key, hashes: the sketch of all parts of each key; parts has key and hashes (array of long).

    Hashes are compared as unsigned numbers. Every task keeps its k smallest for each key before
    anything is shuffled, so a key with most of the rows costs no more than any other.
    """
    one = parts.select(F.col(key).alias("_key"), F.explode("hashes").alias("_hash"))
    # flipping the top bit turns the unsigned order into the signed one
    order = Window.partitionBy("_key").orderBy(F.col("_hash").bitwiseXOR(F.lit(-(1 << 63))))
    least = one.withColumn("_rank", F.dense_rank().over(order)).filter(F.col("_rank") <= k)
    kept = F.transform(F.array_sort(F.collect_set(F.struct("_rank", "_hash"))), lambda s: s["_hash"])
    return least.groupBy("_key").agg(kept.alias("hashes")).withColumnRenamed("_key", key)


def _place(known, doc_id, part):
    """A row's place in the order of documents: null ids first, then by id, then by the place of the digest in [0, 1)."""
    return F.struct(known.cast("int").alias("known"), doc_id.cast("long").alias("id"), part.cast("double").alias("part"))


def _bounds(cuts: list[int], nulls: int) -> list[tuple[int, int, float]]:
    """The least place of each range but the first; an id that is the cut m times has m ranges, null ids have nulls (or 1)."""
    out = [(0, 0, k / nulls) for k in range(1, nulls)] + [(1, -(1 << 63), 0.0)]
    for cut, m in sorted(Counter(cuts).items()):
        out += [(1, cut, k / m) for k in range(m)] + ([(1, cut, 1.0)] if m > 1 else [])
    return out


def with_next(docs: DataFrame, run, schema: str) -> DataFrame:
    """run over streams of (doc_id, text, text of the next row in doc_id order); the last is followed by the first.

    Rows are dealt by ranges of doc_id; ids that fill several ranges, and null ids, are parted by the
    texts' digests. The first row of each range goes to the range before too, so no task needs
    another's rows; the ranges' bounds are all that the driver sees.
    """
    spark = docs.sparkSession
    n = 3 * partitions(spark)
    rows = texts(whole_ids(docs)).withColumn("digest", F.md5("text"))
    cuts = F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)
    seen = docs.agg(cuts.alias("cuts"), F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    bounds = _bounds(seen["cuts"] or [], round(n * (1 - seen["known"] / seen["n"])) if seen["n"] else 0)
    part = F.conv(F.substring("digest", 1, 13), 16, 10).cast("double") / 16**13
    at = _place(F.col("doc_id").isNotNull().cast("int"), F.coalesce("doc_id", F.lit(0)), part)
    of = F.size(F.filter(F.array(*(_place(*map(F.lit, b)) for b in bounds)), lambda b: b <= at))
    first = F.struct(F.col("doc_id").isNotNull(), "doc_id", "digest")
    heads = rows.groupBy(of.alias("bucket")).agg(F.min(first).alias("head")).orderBy("bucket").collect()
    befores = [(h["head"]["doc_id"], h["head"]["digest"], heads[i - 1]["bucket"]) for i, h in enumerate(heads)]
    befores = spark.createDataFrame(befores, "head long, head_digest string, before int")
    is_head = F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("digest") == F.col("head_digest"))
    dealt = rows.withColumn("bucket", of).join(F.broadcast(befores), is_head, "left")
    to = F.array_compact(F.array(F.struct("bucket", F.lit(False).alias("carried")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("carried")))))
    dealt = dealt.select("doc_id", "text", "digest", F.explode(to).alias("to")).select("doc_id", "text", "digest", "to.*")
    dealt = dealt.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "carried", "doc_id", "digest").drop("digest")

    def pairs(it):
        held, rows, size = None, [], 0
        for batch in it:
            for doc_id, text, bucket, carried in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[2] == bucket:
                    rows.append((held[0], held[1], text))
                    size += len(held[1])
                held = None if carried else (doc_id, text, bucket)
                if size > 3_000_000:
                    yield run(rows)
                    rows, size = [], 0
        if rows:
            yield run(rows)

    return dealt.mapInArrow(pairs, schema)


def edited(text: str, after: str) -> str:
    """The last half of the code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and their likeness to its own and the next text's."""

    def run(rows):
        ids, own, after = zip(*rows, strict=True)
        changed = [edited(a, b) for a, b in zip(own, after, strict=True)]
        a, b = sketches(pa.array(own, pa.large_string()), k), sketches(pa.array(changed, pa.large_string()), k)
        last = sketches(pa.array(after[-1:], pa.large_string()), k)[0]
        following = [a[i + 1] if i + 1 < len(own) and own[i + 1] == after[i] else None for i in range(len(own))]
        following[-1] = last
        following = [sketches(pa.array([t], pa.large_string()), k)[0] if f is None else f for f, t in zip(following, after, strict=True)]
        columns = {
            "doc_id": pa.array(ids, pa.int64()),
            "n_chars": pa.array(list(map(len, own)), pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            "fingerprint": pa.array(list(map(as_text, a))),
            "edited_fingerprint": pa.array(list(map(as_text, b))),
            "near_edited": pa.array([resemblance(x, y, k) for x, y in zip(a, b, strict=True)], pa.float64()),
            "near_next": pa.array([resemblance(x, y, k) for x, y in zip(a, following, strict=True)], pa.float64()),
            "n_shingles": pa.array([distinct(x, k) for x in a], pa.float64()),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return with_next(docs, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double")


def op10_fingerprints(spark, sf_dir):
    return fingerprints(documents(spark, sf_dir))


QUERIES = {"op10_fingerprints": op10_fingerprints}
