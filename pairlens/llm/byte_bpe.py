"""Byte-level BPE by a rank file, encoding each distinct word of the corpus once.

Texts are cut into pre-tokens, with their positions; the distinct ones of all documents meet in a
shuffle (see wordshuffle), each is merged once, its ids go back to the blocks of documents that have
it, and each text's ids are put together by position. Decoding joins ids with the table of tokens'
bytes. The table is as large as the vocabulary, so every task has it whole.

Nulls count as empty texts, which have no ids; repeated rows give repeated rows. Document ids are whole
numbers; any other type is refused with a TypeError.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import merge
from .common import PATTERN, documents, gather, kept, partitions, space_pieces, texts, whole_ids
from .wordshuffle import SCHEMA, bucket_count, by_key, expand, meet, packets, places, squeeze, unpack_words


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode_word(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: itself if it is a token, else what its merges leave."""
    if (whole := rank.get(word)) is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    merge(parts, lambda a, b: rank.get(a + b))
    return [rank[p] for p in parts]


def pre_tokens(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct pre-tokens, their numbers in order, how many each text has."""
    find = kept("pattern", lambda: regex.compile(PATTERN)).findall
    pieces, codes, lens, _ = space_pieces(texts)
    number: dict[str, int] = {}
    flat, ends = [], [0]
    for p in pieces:
        flat += [number.setdefault(t, len(number)) for t in find(p)]
        ends.append(len(flat))
    ends = np.array(ends, np.int64)
    n = np.diff(ends)[codes]
    edges, upto = np.concatenate([[0], np.cumsum(lens)]), np.concatenate([[0], np.cumsum(n)])
    return [t.encode() for t in number], gather(np.array(flat, np.int64), ends[codes], n), np.diff(upto[edges])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers as one binary value) of each row."""
    n, rows = partitions(docs.sparkSession), texts(whole_ids(docs))
    buckets = bucket_count(rows)

    def answer(it):
        rank = kept(("ranks", path), lambda: ranks(path))
        for _, same in by_key(it, 1):
            seen: dict[bytes, list[int]] = {}  # of one bucket
            for block, bucket, payload in same:
                ids = []
                for word in unpack_words(*expand(payload)):
                    if (got := seen.get(word)) is None:
                        got = seen[word] = encode_word(word, rank)
                    ids.append(got)
                lens = np.fromiter(map(len, ids), np.uint32, len(ids))
                flat = np.fromiter((x for i in ids for x in i), np.uint32, int(lens.sum()))
                out = squeeze(lens, flat)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([out], pa.binary())], ["block", "bucket", "payload"])

    def finish(ids, lens, numbers, answers, _):
        if answers:
            n_ids, flat = answers[0].astype(np.int64), answers[1]
            per = n_ids[numbers]
            values = gather(flat, (np.cumsum(n_ids) - n_ids)[numbers], per).astype("<u4")
            ends = np.concatenate([[0], np.cumsum(per)])[np.concatenate([[0], np.cumsum(lens)])]
        else:
            values, ends = np.zeros(0, "<u4"), np.zeros(len(ids) + 1, np.int64)
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends * 4), pa.py_buffer(values)])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), whole.cast(pa.binary())], ["doc_id", "ids"])

    words = packets(rows, pre_tokens, buckets).repartition(n, "bucket").sortWithinPartitions("bucket")
    return meet(places(rows, pre_tokens, buckets), words.mapInArrow(answer, SCHEMA), n, finish, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with the column decoded: the bytes of the tokens in ids."""

    def run(it):
        def table():
            rank = ranks(path)
            words = [b""] * (max(rank.values(), default=-1) + 1)
            for word, i in rank.items():
                words[i] = word
            lens = np.fromiter(map(len, words), np.int64, len(words))
            return np.frombuffer(b"".join(words), np.uint8), np.cumsum(lens) - lens, lens

        data, starts, lens = kept(("table", path), table)
        for batch in it:
            found = []
            for value in batch.column(1).to_pylist():
                ids = np.frombuffer(value or b"", "<u4")
                found.append(gather(data, starts[ids], lens[ids]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def op9_byte_bpe(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = decode(encode(documents(spark, sf_dir), path), path)
    return done.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
