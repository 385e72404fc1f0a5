"""A shuffle of distinct words, with their places left at home.

Texts are cut into words by a given function. A block is a run of texts of a bounded size; its distinct
words are numbered, and the words that fall into one bucket of a hash travel together as one row, a
packet. So a word is shuffled once for each block it occurs in, not once for each occurrence, and meets
all its equals in its bucket. The answers return to the block, where the positions (the numbers of the
block's words in order, kept compressed) put them in place. Both shuffles are even: a frequent word has
one entry for each block, like any other, and a block has a bounded size.

Blocks are numbered by task and turn, like monotonically_increasing_id; ``places`` and ``packets`` of
the same documents agree as long as Spark reads them in the same splits, and ``meet`` checks that they do.
"""

from __future__ import annotations

import math
import struct
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, settle, text_batches

BLOCK_BYTES = 4_000_000
_ROW = ("block", "bucket", "payload")
SCHEMA = "block long, bucket int, payload binary"


def bucket_count(rows: DataFrame) -> int:
    """Buckets for the words of rows: two for each shuffle partition, or more for a large corpus.

    A corpus's distinct words grow about with the square root of its size, and so do the buckets; a task
    holds the distinct words of one bucket, some hundred thousand at 100 TB.
    """
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(2 * partitions(rows.sparkSession), math.ceil(math.sqrt(size) / 1000))


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; whole numbers by their bytes' places, which compresses better."""
    parts = []
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
        parts.append(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)) + planes.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def expand(data: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(data):
        kind, n = struct.unpack_from("<2sQ", data, at)
        kind, at = np.dtype("<" + kind.decode()), at + 10
        planes = np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
        at += n * kind.itemsize
    return out


def pack_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(map(len, words), np.uint32, len(words)), np.frombuffer(b"".join(words), np.uint8)


def unpack_words(lens: np.ndarray, data: np.ndarray) -> list[bytes]:
    whole, ends = data.tobytes(), np.cumsum(lens, dtype=np.int64).tolist()
    return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _blocks(it, cut, buckets: int):
    """(block, ids, texts, words by bucket, words in each bucket, numbers of the words in order, words in each text)."""
    task, turn = TaskContext.get().partitionId(), 0
    for ids, column in text_batches(it, BLOCK_BYTES):
        words, numbers, lens = cut(column)
        of = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        order = np.argsort(of, kind="stable")
        place = np.empty(len(words), np.uint32)
        place[order] = np.arange(len(words), dtype=np.uint32)
        yield task << 33 | turn, ids, column, [words[i] for i in order.tolist()], np.bincount(of, minlength=buckets), place[numbers], lens
        turn += 1


def _row(block: int, bucket: int, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([payload], pa.binary())], _ROW)


def packets(rows: DataFrame, cut, buckets: int, extra=None) -> DataFrame:
    """Rows block, bucket, payload: the block's words in the bucket.

    rows has ids and texts; ``extra(ids, numbers, lens, n_words)`` may give a value for each word, which
    goes along (the packet's third array).
    """

    def run(it):
        for block, ids, _, words, sizes, numbers, lens in _blocks(it, cut, buckets):
            more = extra(ids, numbers, lens, len(words)) if extra else None
            at, out = 0, []
            for b in np.flatnonzero(sizes).tolist():
                n = int(sizes[b])
                out.append((b, squeeze(*pack_words(words[at : at + n]), *([more[at : at + n]] if extra else []))))
                at += n
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(out), pa.int64()), pa.array([b for b, _ in out], pa.int32()), pa.array([p for _, p in out], pa.binary())], _ROW)

    return rows.mapInArrow(run, SCHEMA)


def places(rows: DataFrame, cut, buckets: int, extra=None) -> DataFrame:
    """One row for each block, with bucket -1: ids, and the numbers of its words in order.

    ``extra(ids, texts)`` may give a value for each text, which goes along.
    """

    def run(it):
        for block, ids, column, _, sizes, numbers, lens in _blocks(it, cut, buckets):
            known = np.array([i is not None for i in ids.to_pylist()], np.uint8)
            whole = np.array([i or 0 for i in ids.to_pylist()], np.int64)
            more = [extra(ids, column)] if extra else []
            yield _row(block, -1, squeeze(whole, known, sizes.astype(np.uint32), lens.astype(np.uint32), numbers, *more))

    return rows.mapInArrow(run, SCHEMA)


def blocks(rows: DataFrame, cut, buckets: int, extra, home) -> DataFrame:
    """Packets and places of the documents in one pass, from a table written once: rows of packets(), and of places()
    with the arrays that ``home(words)`` gives for a block's distinct words; at_home tells them apart."""

    def run(it):
        for block, ids, _, words, sizes, numbers, lens in _blocks(it, cut, buckets):
            more, at, out = extra(ids, numbers, lens, len(words)), 0, []
            for b in np.flatnonzero(sizes).tolist():
                n = int(sizes[b])
                out.append((b, squeeze(*pack_words(words[at : at + n]), more[at : at + n])))
                at += n
            known = np.array([i is not None for i in ids.to_pylist()], np.uint8)
            whole = np.array([i or 0 for i in ids.to_pylist()], np.int64)
            out.append((-1, squeeze(whole, known, sizes.astype(np.uint32), lens.astype(np.uint32), numbers, *home(words))))
            columns = [pa.array([block] * len(out), pa.int64()), pa.array([b for b, _ in out], pa.int32()), pa.array([p for _, p in out], pa.binary()), pa.array([b < 0 for b, _ in out])]
            yield pa.RecordBatch.from_arrays(columns, [*_ROW, "at_home"])

    return settle(rows.mapInArrow(run, f"{SCHEMA}, at_home boolean"), "none", "at_home")


def by_key(it, key: int):
    """Groups of (block, bucket, payload) rows, sorted by the key's column, one row at a time."""
    rows = (r for batch in it for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return groupby(rows, lambda r: r[key])


def meet(at_home: DataFrame, answers: DataFrame, n: int, finish, schema: str) -> DataFrame:
    """Brings each block's places and answers together.

    ``finish(ids, lens, numbers, answers, extra)`` gets the block's document ids, words in each text,
    the words' numbers in order, the expanded answers' arrays, joined in the order of the numbers, and
    what ``extra`` or ``home`` gave; it returns a record batch.
    """

    def run(it):
        for block, rows in by_key(it, 0):
            _, bucket, payload = next(rows)
            if bucket != -1:
                raise ValueError(f"block {block} has no places")
            whole, known, sizes, lens, numbers, *more = expand(payload)
            got = [(b, expand(p)) for _, b, p in rows]
            if [b for b, _ in got] != np.flatnonzero(sizes).tolist() or any(len(a[0]) != sizes[b] for b, a in got):
                raise ValueError(f"the words of block {block} were cut from other rows than its places")
            joined = [np.concatenate(x) for x in zip(*(a for _, a in got), strict=True)] if got else []
            yield finish([int(i) if k else None for i, k in zip(whole, known, strict=True)], lens.astype(np.int64), numbers, joined, more)

    return at_home.union(answers).repartition(n, "block").sortWithinPartitions("block", "bucket").mapInArrow(run, schema)
