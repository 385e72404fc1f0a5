"""Alignment of two tokenizers' tokens, and which ids they link over a whole corpus.

Both tokenizers read a space and the text; their tokens are byte ranges of the same bytes. In each batch
pandas.merge_asof, keyed by document, finds the token of the other side that covers each token's start;
both directions together give all overlaps, and overlaps that end together close groups: the smallest runs
of tokens that cover the same bytes on both sides. All tokens of a group are linked, A with B.

A link's count is the number of documents in the corpus that have its pair of ids. A block of documents
(of bounded size) sends each of its pairs of ids once, with the number of its documents that have it, to the
bucket of the A id. There the sums of all blocks meet, as do all pairs of an A id, at most as many as B has
ids; a pair's sum and whether it is its A id's highest go back to the blocks, which keep their documents'
groups in a table written once. Frequent ids have one entry a block like any other, so nothing is skewed.

Defined results: null and empty texts, and texts whose tokens' bytes are not the space and the text on both
sides, have no tokens: zeros and an empty digest. Repeated rows are documents of their own, null ids too; ids are whole
numbers (others are an error of the cast); an empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LibraryIds, byte_symbols, documents, gather, kept, looked_up, partitions, settle, space_pieces, spans, text_batches, texts
from .shingles import mix
from .wordshuffle import BLOCK_BYTES, SCHEMA, by_key, expand, meet, squeeze

#: Both tokenizers always begin a new token there: before one space or line end between other characters, and after such a line end.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)")
COMPACT = 4_000_000  # pairs of a bucket that are held before equal ones are added up
_ROW = ("block", "bucket", "payload")


class PlainIds(LibraryIds):
    """Ids of the tokenizers library, special tokens' strings as plain text; and each token's bytes."""

    def __init__(self, path: str):
        super().__init__(path)
        self.lib.encode_special_tokens = True
        back = {s: b for b, s in byte_symbols().items()}
        names = [self.lib.id_to_token(i) or "" for i in range(self.lib.get_vocab_size())]
        self.bytes = [bytes(back[c] for c in n) if all(c in back for c in n) else n.encode() for n in names]


class PieceIds:
    """Ids of the sentencepiece library for pieces of texts, and each token's bytes."""

    MEMO = 200_000

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        # else pieces of a text would not be encoded alike alone and in the text
        if any("\n" in n or "▁" in n.lstrip("▁") for n in names):
            raise ValueError("this model has tokens across words or with line ends")
        self.bytes = [bytes([int(n[3:5], 16)]) if self.lib.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def make(self, pieces: list[str]) -> list[bytes]:
        """The ids of each as 32-bit integers. The library puts a space before a text; a line end before a piece keeps that away."""
        fresh = [p for p in pieces if p not in self.new and p not in self.old]
        found = self.lib.encode([p[1:] if p[:1] == " " else "\n" + p for p in fresh], num_threads=1) if fresh else []
        ends = list(accumulate(map(len, found)))
        flat = np.fromiter(chain.from_iterable(found), np.int32, ends[-1] if ends else 0).tobytes()
        made = {p: flat[4 * (a if p[:1] == " " else a + 2) : 4 * b] for p, a, b in zip(fresh, [0, *ends[:-1]], ends, strict=True)}
        # a piece that is one space only is no text to the library
        made |= {p: np.array(self.lib.encode("\n ")[2:], np.int32).tobytes() for p in fresh if p == " "} | {p: b"" for p in fresh if not p}
        out = [made[p] if p in made else self.new[p] if p in self.new else self.old[p] for p in pieces]
        if len(self.new) + len(made) > self.MEMO:
            self.old, self.new = self.new, {}
        self.new |= made
        return out


class Pair:
    """Two tokenizers over the same texts."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = PlainIds(path_a), PieceIds(path_b)
        self.len_a, self.len_b = (np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b))

    def _unlike(self, side, sizes: np.ndarray, made: list[bytes], pieces: list[bytes]) -> np.ndarray:
        """Whether each piece's tokens have other bytes than the piece."""
        flat, starts, n = spans(made)
        other = _sums(sizes[flat], n) != np.fromiter(map(len, pieces), np.int64, len(pieces))
        if other.any() or b"".join([side.bytes[i] for i in flat.tolist()]) != b"".join(pieces):
            other = np.array([b"".join([side.bytes[i] for i in flat[a : a + k].tolist()]) != p for a, k, p in zip(starts.tolist(), n.tolist(), pieces, strict=True)], bool)
        return other

    def _pieces(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct pieces of a space and each text, their numbers in order, and how many each text has."""
        spaced = pc.if_else(pc.equal(column, ""), column, pc.binary_join_element_wise(pa.scalar("", column.type), column, pa.scalar(" ", column.type)))
        words, codes, lens, whole = space_pieces(spaced)
        if whole.any():  # white space beside white space: cut where there is none
            number = {w: k for k, w in enumerate(words)}
            parts = [[number.setdefault(p, len(number)) for p in _CUT.split(t)] for t in spaced.filter(pa.array(whole)).to_pylist()]
            n = lens.copy()
            n[whole] = [len(x) for x in parts]
            starts = np.where(whole, 0, _starts(lens))
            starts[whole] = len(codes) + _starts(n[whole])
            codes, lens, words = gather(np.concatenate([codes, *(np.array(x, np.int64) for x in parts)]), starts, n), n, list(number)
        return words, codes, lens

    def tokens(self, column: pa.Array):
        """(ids, their document, their end) of A and of B; ends are places in the batch's bytes, the same on both sides."""
        pieces, codes, lens = self._pieces(column)
        a, b, said = self.a.make(pieces), self.b.make(pieces), [p.encode() for p in pieces]
        bad = self._unlike(self.a, self.len_a, a, said) | self._unlike(self.b, self.len_b, b, said)
        if bad.any():
            doc = np.repeat(np.arange(len(lens)), lens)
            out = np.zeros(len(lens), bool)
            out[doc[bad[codes]]] = True
            codes, lens = codes[~out[doc]], np.where(out, 0, lens)
        sides = []
        for made, sizes in ((a, self.len_a), (b, self.len_b)):
            ids, n = looked_up(made, codes, lens) if len(codes) else (np.zeros(0, np.int32), np.zeros(len(lens), np.int64))
            sides.append((ids.astype(np.int64), np.repeat(np.arange(len(n)), n), np.cumsum(sizes[ids])))
        return sides


def overlaps(doc_a, start_a, doc_b, start_b) -> tuple[np.ndarray, np.ndarray]:
    """Places of all A and B tokens that share bytes: each start's covering token of the other side, both directions together."""
    a = pd.DataFrame({"doc": doc_a, "at": start_a, "a": np.arange(len(doc_a))})
    b = pd.DataFrame({"doc": doc_b, "at": start_b, "b": np.arange(len(doc_b))})
    in_b, in_a = pd.merge_asof(a, b, on="at", by="doc")["b"].to_numpy(), pd.merge_asof(b, a, on="at", by="doc")["a"].to_numpy()
    # where both start together the second direction says nothing new
    new = start_a[in_a] != start_b
    return np.concatenate([np.arange(len(a)), in_a[new]]), np.concatenate([in_b, np.arange(len(b))[new]])


def grouped(end_a, end_b, over) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The group of each A and B token, numbered in order, and the last A token of each group: overlaps that end together close it."""
    i, j = over
    same = end_a[i] == end_b[j]
    last_a, last_b = np.zeros(len(end_a), bool), np.zeros(len(end_b), bool)
    last_a[i[same]], last_b[j[same]] = True, True
    return np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b, np.flatnonzero(last_a)


def _starts(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of runs of n values each."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(n)])])


def _distinct_groups(ids_a, ids_b, group_a, group_b, n: int):
    """(number of each group among the distinct ones, their A ids, how many, their B ids, how many)."""
    na, nb = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    at = _starts(1 + na + nb)
    flat = np.empty(int((1 + na + nb).sum()), np.uint32)
    flat[at] = na
    flat[at[group_a] + 1 + np.arange(len(ids_a)) - _starts(na)[group_a]] = ids_a
    flat[(at + 1 + na)[group_b] + np.arange(len(ids_b)) - _starts(nb)[group_b]] = ids_b
    edges = np.concatenate([at, [len(flat)]]).astype(np.int64) * 4
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(edges), pa.py_buffer(flat)]).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    first = np.full(len(coded.dictionary), n, np.int64)
    np.minimum.at(first, codes, np.arange(n))
    na, nb, at = na[first], nb[first], at[first]
    return codes, gather(flat, at + 1, na).astype(np.int64), na, gather(flat, at + 1 + na, nb).astype(np.int64), nb


def _linked(a, na, b, nb):
    """Links of the distinct groups by pair of ids: (A id << 32 | B id, how often) and how many pairs each group has."""

    def counted(ids, n):
        of, times = np.unique(np.repeat(np.arange(len(n)), n) << 32 | ids, return_counts=True)
        return of & 0xFFFFFFFF, times, np.bincount(of >> 32, minlength=len(n))

    (a, ta, na), (b, tb, nb) = counted(a, na), counted(b, nb)
    group = np.repeat(np.arange(len(na)), na)
    many = nb[group]
    with_b = np.repeat(_starts(nb)[group] - _starts(many), many) + np.arange(int(many.sum()))
    return np.repeat(a, many) << 32 | b[with_b], np.repeat(ta, many) * tb[with_b], na * nb


def _block(pair: Pair, column: pa.Array, buckets: int):
    """What a block sends (pairs by bucket, documents with each, pairs in each bucket) and what it keeps (see ``finish``)."""
    n_docs = len(column)
    (ids_a, doc_a, end_a), (ids_b, doc_b, end_b) = pair.tokens(column)
    start_a, start_b = end_a - pair.len_a[ids_a], end_b - pair.len_b[ids_b]
    group_a, group_b, last = grouped(end_a, end_b, overlaps(doc_a, start_a, doc_b, start_b))
    codes, a, na, b, nb = _distinct_groups(ids_a, ids_b, group_a, group_b, len(last))
    doc = doc_a[last]
    x, y, ea, eb = a.tolist(), b.tolist(), np.cumsum(na).tolist(), np.cumsum(nb).tolist()
    said = [",".join(map(str, x[i:j])) + "|" + ",".join(map(str, y[k:m])) for i, j, k, m in zip([0, *ea[:-1]], ea, [0, *eb[:-1]], eb, strict=True)] if ea else []
    n_groups = np.bincount(doc, minlength=n_docs)
    order, upto = codes.tolist(), np.cumsum(n_groups).tolist()
    digests = [hashlib.sha256(";".join([said[c] for c in order[i:j]]).encode()).digest() if j > i else bytes(32) for i, j in zip([0, *upto[:-1]], upto, strict=True)]
    keys, times, n_pairs = _linked(a, na, b, nb)
    distinct, spot = np.unique(keys, return_inverse=True)
    with np.errstate(over="ignore"):
        bucket = (mix((distinct >> 32).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    by_bucket = np.argsort(bucket, kind="stable")
    place = np.empty(len(distinct), np.int64)
    place[by_bucket] = np.arange(len(distinct))
    spot = place[spot]
    has, often = np.unique(doc << 32 | codes, return_counts=True)
    has_doc, has_group = has >> 32, has & 0xFFFFFFFF
    pairs = gather(spot, _starts(n_pairs)[has_group], n_pairs[has_group])
    in_docs = np.unique(np.repeat(has_doc, n_pairs[has_group]) << 32 | pairs) & 0xFFFFFFFF
    n_links = np.bincount(doc, weights=(na * nb)[codes], minlength=n_docs).astype(np.int64)
    home = (
        np.bincount(has_doc, minlength=n_docs).astype(np.uint32), has_group.astype(np.uint32), often.astype(np.uint32), n_pairs.astype(np.uint32), spot.astype(np.uint32), times.astype(np.uint32),
        np.bincount(doc_a, minlength=n_docs), np.bincount(doc_b, minlength=n_docs), n_groups, n_links, np.frombuffer(b"".join(digests), np.uint8),
    )
    return distinct[by_bucket], np.bincount(in_docs, minlength=len(distinct)), np.bincount(bucket, minlength=buckets), home


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], _ROW)


def _blocks(rows: DataFrame, paths: tuple[str, str], buckets: int) -> DataFrame:
    """Rows block, bucket, payload, at_home of all documents, written once: packets of pairs, and what each block keeps (bucket -1)."""

    def run(it):
        pair = kept(("pair", paths), lambda: Pair(*paths))
        task, turn = TaskContext.get().partitionId(), 0
        for ids, column in text_batches(it, BLOCK_BYTES):
            keys, n, sizes, home = _block(pair, column, buckets)
            block, at, out = task << 33 | turn, 0, []
            for b in np.flatnonzero(sizes).tolist():
                part = slice(at, at := at + int(sizes[b]))
                out.append((block, b, squeeze(keys[part], n[part].astype(np.uint32))))
            known = np.array([i is not None for i in ids.to_pylist()], np.uint8)
            whole = np.array([i or 0 for i in ids.to_pylist()], np.int64)
            out.append((block, -1, squeeze(whole, known, sizes.astype(np.uint32), *home)))
            yield pa.RecordBatch.from_arrays([*_rows(out).columns, pa.array([r[1] < 0 for r in out])], [*_ROW, "at_home"])
            turn += 1

    return settle(rows.mapInArrow(run, f"{SCHEMA}, at_home boolean"), "none", "at_home")


def _added(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their values."""
    all_keys, values = np.concatenate(keys), np.concatenate(n)
    order = np.argsort(all_keys, kind="stable")
    all_keys, values = all_keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], all_keys[1:] != all_keys[:-1]]))
    return all_keys[first], np.add.reduceat(values, first)


def _totals(it):
    """One row for each bucket (block -1): its pairs, how many documents have each, whether that is its A id's most."""
    for bucket, rows in by_key(it, 1):
        keys, n, fresh = [], [], 0
        for _, _, payload in rows:
            k, v = expand(payload)
            keys, n, fresh = [*keys, k], [*n, v.astype(np.int64)], fresh + len(k)
            if fresh > max(COMPACT, len(keys[0])):
                k, v = _added(keys, n)
                keys, n, fresh = [k], [v], 0
        k, v = _added(keys, n)
        first = np.flatnonzero(np.concatenate([[True], (k[1:] >> 32) != (k[:-1] >> 32)]))
        most = np.repeat(np.maximum.reduceat(v, first), np.diff(np.concatenate([first, [len(k)]])))
        yield _rows([(-1, bucket, squeeze(k, v, (v == most).astype(np.uint8)))])


def _answers(it):
    """Every packet's counts and marks, looked up in its bucket's totals, which come first."""
    for _, rows in by_key(it, 1):
        keys, n, best = expand(next(rows)[2])
        for block, bucket, payload in rows:
            at = np.searchsorted(keys, expand(payload)[0])
            yield _rows([(block, bucket, squeeze(n[at], best[at]))])


_FOUND = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row; docs has doc_id and text."""
    n, rows = partitions(docs.sparkSession), texts(docs)
    table = _blocks(rows, (path_a, path_b), 2 * n)
    packets = table.filter("not at_home").select(*_ROW)
    totals = settle(packets.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_totals, SCHEMA), "none")
    answers = packets.union(totals).repartition(n, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(_answers, SCHEMA)

    def finish(ids, lens, groups, answers, more):
        often, n_pairs, spot, times, n_a, n_b, n_groups, n_links, digests = more
        count, best = answers if answers else (np.zeros(0, np.int64), np.zeros(0, np.uint8))
        times, n_pairs, often = times.astype(np.int64), n_pairs.astype(np.int64), often.astype(np.int64)
        per_group = [_sums(times * v[spot].astype(np.int64), n_pairs)[groups] * often for v in (best, count)]
        sums = [_sums(v, lens) for v in per_group]
        said = [d.hex() if k else "" for d, k in zip((digests[i : i + 32].tobytes() for i in range(0, len(digests), 32)), n_groups.tolist(), strict=True)]
        numbers = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links, *sums)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *numbers, pa.array(said, pa.string())], [x.split()[0] for x in _FOUND.split(", ")])

    return meet(table.filter("at_home").select(*_ROW), answers, n, finish, _FOUND)


def token_overlaps(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for each overlap: doc_id, a and b (the tokens' places in the text), a_id, b_id, start and end (shared bytes, from the
    space before the text on), group (of the text)."""
    fields = ["a", "b", "a_id", "b_id", "start", "end", "group"]

    def run(it):
        pair = kept(("pair", (path_a, path_b)), lambda: Pair(path_a, path_b))
        for ids, column in text_batches(it, BLOCK_BYTES // 4):
            (ids_a, doc_a, end_a), (ids_b, doc_b, end_b) = pair.tokens(column)
            start_a, start_b = end_a - pair.len_a[ids_a], end_b - pair.len_b[ids_b]
            i, j = over = overlaps(doc_a, start_a, doc_b, start_b)
            group, _, last = grouped(end_a, end_b, over)
            first = [np.searchsorted(d, np.arange(len(ids))) for d in (doc_a, doc_b, doc_a[last])]
            base = np.concatenate([start_a, [0]])[np.minimum(first[0], len(start_a))]
            doc = doc_a[i]
            values = (i - first[0][doc], j - first[1][doc], ids_a[i], ids_b[j], np.maximum(start_a[i], start_b[j]) - base[doc], np.minimum(end_a[i], end_b[j]) - base[doc], group[i] - first[2][doc])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)).cast(pa.int64()), *(pa.array(v, pa.int64()) for v in values)], ["doc_id", *fields])

    return texts(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"`{f}` long" for f in fields))


def op12_alignment(spark, sf_dir):
    import public_tokenizers as P

    return aligned(documents(spark, sf_dir), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


QUERIES = {"op12_alignment": op12_alignment}
