"""Rows of one id and rows without an id are dealt over tasks; ids that aren't whole numbers are refused."""

import hashlib
from collections import Counter

import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from pairlens.llm import byte_bpe, fingerprints, lm_scores, token_store, wordshuffle

BYTE, RANKS = (P.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"))
N = 30_000


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows has the id 7, a third none, the others each their own, from negative ones on."""
    ident = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, None).otherwise(F.col("id") - N // 2)
    return spark.range(N).select(ident.cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).repartition(6).cache()


@pytest.fixture(scope="module")
def in_order(hot):
    return sorted(((r["doc_id"], r["text"]) for r in hot.collect()), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))


def test_next_rows_of_hot_ids(hot, in_order):
    def run(rows):
        ids, own, after = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own), pa.array(after), pa.array([TaskContext.get().partitionId()] * len(ids))], ["doc_id", "own", "after", "task"])

    got = fingerprints.with_next(hot, run, "doc_id long, own string, after string, task long").collect()
    texts = [t for _, t in in_order]
    assert Counter((r["doc_id"], r["own"], r["after"]) for r in got) == Counter((i, t, a) for (i, t), a in zip(in_order, [*texts[1:], texts[0]], strict=True))
    for i in (7, None):
        tasks = Counter(r["task"] for r in got if r["doc_id"] == i)
        assert len(tasks) > 1 and max(tasks.values()) < 0.8 * N / 3


def test_bounds_part_hot_ids_and_nulls():
    bounds = fingerprints._bounds([3, 7, 7, 7, 9], 2)
    assert bounds == sorted(bounds) == [(0, 0, 0.5), (1, -(1 << 63), 0.0), (1, 3, 0.0), (1, 7, 0.0), (1, 7, 1 / 3), (1, 7, 2 / 3), (1, 7, 1.0), (1, 9, 0.0)]
    assert fingerprints._bounds([], 0) == [(1, -(1 << 63), 0.0)]


def test_token_store_of_hot_ids(hot, in_order):
    segments = token_store.write_tokens(hot, BYTE, 2, segment_ids=20_000)
    rows = token_store.read_tokens(segments).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [i for i, _ in in_order]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False)) and rows[0]["start"] == 0
    # no writer has much more than its share: the hot ids are parted
    written = [r["n"] for r in segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()]
    assert len(written) == 4 and max(written) < 0.4 * sum(written)


def test_repeated_rows_of_one_id(spark):
    df = spark.createDataFrame([(7, "a b c")] * 500 + [(None, None)] * 500 + [(8, "d")], "doc_id int, text string").repartition(5)
    got = fingerprints.fingerprints(df).collect()
    ends = Counter((r["doc_id"], r["n_chars"], r["near_next"]) for r in got)
    assert ends == Counter({(7, 5, 1.0): 499, (7, 5, 0.0): 1, (None, 0, 1.0): 499, (None, 0, 0.0): 1, (8, 1, 0.0): 1})
    rows = token_store.read_tokens(token_store.write_tokens(df, BYTE, 2)).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None] * 500 + [7] * 500 + [8] and rows[500]["start"] == 500


@pytest.mark.parametrize("call", [lambda d: token_store.write_tokens(d, BYTE, 2), lambda d: byte_bpe.encode(d, RANKS), lambda d: lm_scores.lm_scores(d, BYTE), fingerprints.fingerprints])
def test_ids_of_other_types_are_refused(spark, call):
    for kind, value in (("string", "a"), ("double", 1.5)):
        with pytest.raises(TypeError, match="whole number"):
            call(spark.createDataFrame([(value, "t")], f"doc_id {kind}, text string"))


def test_buckets_of_words_grow_with_the_corpus(spark, hot):
    assert wordshuffle.bucket_count(hot) == 8 and wordshuffle.bucket_count(hot.limit(0)) == 8
    large = spark.range(2000).select(F.repeat(F.lit("x"), 200_000).alias("text"))
    assert wordshuffle.bucket_count(large) == 20
