"""Token ids on disk as directly addressable codes.

An id is cut into chunks of 8 bits. Level 0 holds every id's lowest chunk, level k the k-th chunk
of those ids that need it; a bitmap for each level says which ids go on to the next, and a rank
directory (ones before each block of 512 bits) turns a position in one level into the position in
the next. So any id is read with one lookup for each level and no block is ever decoded.

A segment is one value of this format: a header, document ids and lengths, then the levels. Segments
are rows of Parquet files in the shared folder, written in ascending document order (nulls first,
repeated ids by their texts' digests), so writers can be lost and repeated and any store that Spark can
write does. Document ids are whole numbers; any other type is refused with a TypeError.
An index of one row for each segment leads from a position in the corpus to its segment.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LibraryIds, documents, kept, partitions, settle, text_batches, texts, whole_ids

MAGIC = b"DACS0001"
BLOCK = 512  # bits for each entry of a rank directory
RANGE = 1 << 16  # positions that ids_at looks up together
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack(ids: np.ndarray, doc_ids: list, lens: np.ndarray) -> bytes:
    """A segment of these ids; doc_ids and lens tell the documents they belong to."""
    ids = np.asarray(ids, np.uint32)
    known = np.array([i is not None for i in doc_ids], np.uint8)
    parts = [np.array([i or 0 for i in doc_ids], np.int64).tobytes(), np.packbits(known).tobytes(), np.asarray(lens, np.uint32).tobytes()]
    levels, rest = 0, ids
    while levels == 0 or len(rest):
        more = rest >> 8 != 0
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ranks = np.cumsum(_ONES[bits].reshape(-1, BLOCK // 8).sum(1), dtype=np.uint32) if len(bits) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], ranks]).astype(np.uint32)
        parts += [struct.pack("<Q", len(rest)), (rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()]
        rest, levels = rest[more] >> 8, levels + 1
    return MAGIC + struct.pack("<QQI", len(doc_ids), len(ids), levels) + b"".join(parts)


class Segment:
    """Reads a segment: whole, by document, or any single id; document ids are only unpacked when asked for."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.n_docs, self.n_ids, levels = struct.unpack_from("<QQI", data, 8)
        at = 28

        def take(kind, n):
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += got.nbytes
            return got

        self._ids, self._known, self._lens = take("<i8", self.n_docs), take("u1", -(-self.n_docs // 8)), take("<u4", self.n_docs)
        self.levels = []
        for _ in range(levels):
            n = int(take("<u8", 1)[0])
            chunk = take("u1", n)
            bits = take("u1", -(-n // BLOCK) * (BLOCK // 8))
            self.levels.append((chunk, bits, take("<u4", -(-n // BLOCK) + 1)))

    @property
    def doc_ids(self) -> list:
        known = np.unpackbits(self._known, count=self.n_docs)
        return [i if k else None for i, k in zip(self._ids.tolist(), known.tolist(), strict=True)]

    @property
    def lens(self) -> np.ndarray:
        """How many ids each document has."""
        return self._lens.astype(np.int64)

    def __getitem__(self, i: int) -> int:
        """The id at position i, without reading its neighbours."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            value |= int(chunk[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            before = bits[block * (BLOCK // 8) : i >> 3]
            i = int(ranks[block]) + int(_ONES[before].sum()) + bin(int(bits[i >> 3]) & (1 << (i & 7)) - 1).count("1")
        return value

    def all(self) -> np.ndarray:
        """All ids in order."""
        value = np.zeros(0, np.uint32)
        for chunk, bits, _ in reversed(self.levels):
            out = chunk.astype(np.uint32)
            out[np.unpackbits(bits, count=len(chunk), bitorder="little").view(bool)] |= value << 8
            value = out
        return value


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, segment_ids: int = 1_000_000) -> DataFrame:
    """Encodes docs and writes their segments in document order; returns the table of the files.

    Columns: shard (the writing task), seq (order in it), first_doc_id, n_ids, data. A text's ids
    are never parted between segments; a segment closes once it has segment_ids ids.
    """
    n = partitions(docs.sparkSession)

    def run(it):
        coder = kept(("ids", tokenizer_path), lambda: LibraryIds(tokenizer_path))
        shard, seq, held, count = TaskContext.get().partitionId(), 0, [], 0

        def close():
            ids = np.concatenate([h[0] for h in held])
            names = [d for h in held for d in h[1]]
            data = pack(ids, names, np.concatenate([h[2] for h in held]))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in (([shard], pa.int32()), ([seq], pa.int64()), ([names[0]], pa.int64()), ([len(ids)], pa.int64()), ([data], pa.binary()))], ["shard", "seq", "first_doc_id", "n_ids", "data"])

        for ids, column in text_batches(it):
            values, lens = coder.encode(column)
            values = np.insert(values, np.cumsum(lens), end_id)
            held.append((values.astype(np.uint32), ids.to_pylist(), lens + 1))
            count += len(values)
            if count >= segment_ids:
                yield close()
                seq, held, count = seq + 1, [], 0
        if held:
            yield close()

    # with the digest, the rows of one id, or without any, are dealt out as well
    keyed = texts(whole_ids(docs)).withColumn("digest", F.md5("text"))
    ordered = keyed.repartitionByRange(n, "doc_id", "digest").sortWithinPartitions("doc_id", "digest")
    written = ordered.select("doc_id", "text").mapInArrow(run, "shard int, seq long, first_doc_id long, n_ids long, data binary")
    return settle(written, "none")


def read_tokens(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the segments alone: the index and each document's
    place in its segment, no sort of all rows."""

    def run(it):
        for batch in it:
            for shard, seq, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                s = Segment(data)
                ids, ends = s.all().astype("<u4"), np.cumsum(s.lens)
                starts = ends - s.lens
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((np.full(n, shard), pa.int32()), (np.full(n, seq), pa.int64()), (s.doc_ids, pa.int64()), (starts, pa.int64()), (s.lens, pa.int64()), (crcs, pa.int64()))], ["shard", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = segments.select("shard", "seq", "data").mapInArrow(run, "shard int, seq long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(corpus_index(segments), ["shard", "seq"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def corpus_index(segments: DataFrame) -> DataFrame:
    """shard, seq, first, n_ids: the position in the corpus of each segment's first id, and how many it has.

    Shards hold ranges of document ids, so the shards' totals in the order of their first ids and the
    segments' totals within a shard place every segment; the segments' data are not read.
    """
    heads = segments.select("shard", "seq", "first_doc_id", "n_ids")
    least = F.struct(F.col("first_doc_id").isNotNull(), "first_doc_id")
    shards = heads.groupBy("shard").agg(F.min(least).alias("least"), F.sum("n_ids").alias("n"))
    # one row for each writing task; the rows of one id can begin several shards, which are numbered in their order
    before = Window.orderBy("least", "shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("shard", "seq", "n_ids", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("offset"))
    return heads.join(shards, "shard").select("shard", "seq", (F.col("base") + F.col("offset")).alias("first"), "n_ids")


def ids_at(segments: DataFrame, positions: DataFrame, column: str = "position") -> DataFrame:
    """position, id of each distinct position of the corpus that is asked for, read one by one from its segment.

    Positions before the first or behind the last id, and nulls, have no row. A position finds its segment
    by ranges of ``RANGE`` positions; those of one range and segment travel as one list, which is no longer
    than the range, so a segment that is asked for often is no hot key. Segments that aren't asked for stay unread.
    """
    cell = lambda x: F.floor(x / RANGE)
    places = corpus_index(segments).filter("n_ids > 0").withColumn("cell", F.explode(F.sequence(cell(F.col("first")), cell(F.col("first") + F.col("n_ids") - 1))))
    asked = positions.select(F.col(column).cast("long").alias("position")).distinct().withColumn("cell", cell(F.col("position")))
    met = asked.join(places, "cell").filter("position >= first and position < first + n_ids")
    lists = met.groupBy("shard", "seq", "cell", "first").agg(F.collect_list("position").alias("positions"))

    def run(it):
        for batch in it:
            for first, wanted, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = Segment(data)
                yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array([s[p - first] for p in wanted], pa.int64())], ["position", "id"])

    return lists.join(segments.select("shard", "seq", "data"), ["shard", "seq"]).select("first", "positions", "data").mapInArrow(run, "position long, id long")


def op3_token_store(spark, sf_dir):
    import public_tokenizers

    return read_tokens(write_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 2))


QUERIES = {"op3_token_store": op3_token_store}
