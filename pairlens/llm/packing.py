"""Batches of documents of like length: optimal length buckets, then a token budget.

The histogram of all lengths goes to the driver (at most some ten thousand bins: lengths up to 4096
apart, longer ones rounded up by less than one in 2048; or all lengths apart, as a parameter). Dynamic programming chooses the bucket
lengths that need the least padding; with the lower hull of lines it takes time in proportion to
bins times buckets and is exact. A bucket's documents are numbered and cut into batches of as many
padded documents as the token budget holds, at least one.

Numbers within a bucket come from counts of (bucket, slice): no bucket, however large, is sorted or
numbered in one task. Nulls count as empty texts; a text has one token more for its end, so lengths
are at least 1. Repeated rows are packed like any others; no documents give no rows.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LibraryIds, documents, kept, settle, text_batches, texts

BUCKETS, BUDGET = 16, 32_768


def lengths(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and n_tokens (with the end) of each row."""

    def run(it):
        coder = kept(("ids", tokenizer_path), lambda: LibraryIds(tokenizer_path))
        for ids, column in text_batches(it):
            _, lens = coder.encode(column)
            yield pa.RecordBatch.from_arrays([ids, pa.array(lens + 1, pa.int64())], ["doc_id", "n_tokens"])

    return texts(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def best_bounds(lens, counts, buckets: int = BUCKETS) -> list[int]:
    """At most so many of the lengths as upper bounds, with the least total padding.

    cost(j, i) of one bucket for the bins after j up to i is L_i (C_i - C_j) - (S_i - S_j), with
    counts C and token sums S so far: for each i the least over lines in L_i, with falling slopes.
    """
    order = np.argsort(lens)
    lens, counts = np.asarray(lens, float)[order], np.asarray(counts, float)[order]
    n = len(lens)
    if not n:
        return []
    c, s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lens)])
    before, back, totals = np.concatenate([[0.0], np.full(n, np.inf)]), [], []
    for _ in range(min(buckets, n)):
        now, came, hull = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64), deque()
        for i in range(1, n + 1):
            j = i - 1
            if np.isfinite(before[j]):
                m, q = -c[j], before[j] + s[j]
                while len(hull) > 1 and (hull[-1][1] - hull[-2][1]) * (hull[-1][0] - m) >= (q - hull[-1][1]) * (hull[-2][0] - hull[-1][0]):
                    hull.pop()
                hull.append((m, q, j))
            x = lens[i - 1]
            while len(hull) > 1 and hull[1][0] * x + hull[1][1] <= hull[0][0] * x + hull[0][1]:
                hull.popleft()
            if hull:
                now[i], came[i] = hull[0][0] * x + hull[0][1] + x * c[i] - s[i], hull[0][2]
        back.append(came)
        totals.append(now[n])
        before = now
    k, i, bounds = int(np.argmin(totals)), n, []
    while k >= 0:
        bounds.append(int(lens[i - 1]))
        i, k = int(back[k][i]), k - 1
    return bounds[::-1]


def binned(length: Column, bits: int | None) -> Column:
    """Lengths up to 2 ** bits as they are, longer ones rounded up to so many leading bits; without bits all as they are."""
    if bits is None:
        return length
    step = F.pow(F.lit(2), F.length(F.bin(length)) - bits).cast("long")
    return F.when(length <= 1 << bits, length).otherwise(F.ceil(length / step) * step)


def packed(docs: DataFrame, tokenizer_path: str, buckets: int = BUCKETS, budget: int = BUDGET, bits: int | None = 12) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_tokens (padded length), batch (within the bucket), slot, padding.

    The bounds are optimal for lengths rounded to ``bits`` leading bits; None takes every length by itself, with as many
    bins on the driver as there are different lengths.
    """
    measured = lengths(docs, tokenizer_path).withColumn("row", F.monotonically_increasing_id())
    measured = settle(measured.withColumn("bin", binned(F.col("n_tokens"), bits)))
    bins = measured.groupBy("bin").agg(F.count("*").alias("n")).collect()
    bounds = best_bounds([b["bin"] for b in bins], [b["n"] for b in bins], buckets)
    below = F.array(*(F.lit(b).cast("long") for b in bounds))
    bucket = F.size(F.filter(below, lambda b: b < F.col("bin")))
    rows = measured.withColumn("bucket", bucket if bounds else F.lit(0)).withColumn("slice", F.shiftright("row", 14))
    rows = rows.withColumn("bucket_tokens", F.get(below, F.col("bucket")) if bounds else F.lit(1).cast("long"))
    at = F.row_number().over(Window.partitionBy("bucket", "slice").orderBy("row")) - 1
    counts = rows.groupBy("bucket", "slice").agg(F.count("*").alias("n"))
    # slices are numbered in groups first, so that no window holds more than a group or one row for each
    counts = counts.withColumn("group", F.shiftright("slice", 19))
    inner = Window.partitionBy("bucket", "group").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("bucket").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("bucket", "group").agg(F.sum("n").alias("n")).select("bucket", "group", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("base"))
    starts = counts.select("bucket", "group", "slice", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("offset")).join(groups, ["bucket", "group"])
    rows = rows.withColumn("at", at).join(starts.select("bucket", "slice", (F.col("base") + F.col("offset")).alias("start")), ["bucket", "slice"])
    number, holds = F.col("start") + F.col("at"), F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_tokens")))
    return rows.select("doc_id", "n_tokens", "bucket", "bucket_tokens", F.floor(number / holds).alias("batch"), (number % holds).alias("slot"), (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"))


def op2_packing(spark, sf_dir):
    import public_tokenizers

    return packed(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op2_packing": op2_packing}
