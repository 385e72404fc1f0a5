"""Language-model scores of whole texts.

The model spells words (lower-cased A-Z, between ASCII white space) with the ids of a byte-level BPE
vocabulary, each word as if after one space; a text ends with an end symbol. A small causal
self-attention model (see attention) gives each id's share in overlapping windows, each id scored once,
and at the word's end the share of all ids that start a word, so that words are closed. This is mixed
with the word's share among all training words of the corpus:

    P(word) = MIX * count / N + (1 - MIX) * P(spelling, then a new word)

so scores are log10 probabilities of the sequence of words. Counts, vocabulary and the shares of ids come
from all training texts by way of a shuffle of distinct words; the symbols' groups come from all pairs of
neighbours in them. The attention weights are trained on a hash sample first, then on all training texts, by
as many replicas as these need at ``REPLICA_BYTES`` each, which are averaged after each round (``ROUNDS``).
So all that is gathered grows with the input.

Ids: the ``SYMBOLS`` most frequent of the training words have a symbol each; the others share one, and
within it their smoothed shares. Nulls count as empty texts, which have only an end. Repeated rows give
repeated rows and count as often. Document ids are whole numbers; any other type is refused with a
TypeError. Without training texts the counts are 0 and every word is spelled by an
untrained model.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention
from .common import LibraryIds, crc_of_ids, documents, gather, kept, partitions, settle, spans, text_batches, texts, whole_ids
from .wordshuffle import SCHEMA, blocks, bucket_count, by_key, expand, meet, pack_words, squeeze, unpack_words

#: Weight of the words' own counts.
MIX = 0.2
SYMBOLS, GROUPS = 4096, 64
#: One text in so many is learned from, at this rate: first a start that the replicas share, then all texts.
ROUNDS = ((8, 0.015), (1, 0.01))
#: Ids that a replica learns from, about 16 MB of text; steps that it makes at least; parts in which replicas are averaged.
REPLICA_IDS, LEAST_STEPS, PARTS = 6_000_000, 200, 64
#: Neighbours on one side that the symbols' profiles tell apart; rows of a profile table that travel together.
NEIGHBOURS, TOGETHER = 512, 64
END = b"\n"  # no word holds it

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


def cut(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, their numbers in order with an end after each text, how many each text has."""
    n = len(texts)
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))]).astype(np.int64)
    raw = pc.binary_join_element_wise(texts, pa.scalar("", texts.type), pa.scalar("", texts.type))  # own buffers
    data = _FOLD[np.frombuffer(raw.buffers()[2] or b"", np.uint8)[: ends[-1]]]
    folded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(data)])
    lists = pc.split_pattern(folded, " ")
    lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    words, numbers = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    if b"" in words:  # between two white spaces, and in empty texts
        empty = words.index(b"")
        real = numbers != empty
        upto = np.concatenate([[0], np.cumsum(real)])
        at = np.concatenate([[0], np.cumsum(lens)])
        lens, numbers = np.diff(upto[at]), numbers[real]
        words[empty] = END
    else:
        empty = len(words)
        words.append(END)
    return words, np.insert(numbers, np.cumsum(lens), empty), lens + 1


def is_training(ids: list) -> np.ndarray:
    return np.array([c % 5 != 1 for c in crc_of_ids(ids)], bool)


def _counted(ids, numbers, lens, n_words):
    """Training count of each of a block's words, in the words' order."""
    return np.bincount(numbers, np.repeat(is_training(ids.to_pylist()), lens), n_words).astype(np.uint32)


def dictionary(found: DataFrame, n: int) -> DataFrame:
    """One row for each bucket (block -1): its distinct training words with their counts; and n_words, total."""

    def run(it):
        for _, same in by_key(it, 1):
            counts: dict[bytes, int] = {}
            for _, bucket, payload in same:
                lens, data, some = expand(payload)
                for word, c in zip(unpack_words(lens, data), some.tolist(), strict=True):
                    if c:
                        counts[word] = counts.get(word, 0) + c
            if counts:
                out = squeeze(*pack_words(list(counts)), np.fromiter(counts.values(), np.uint64, len(counts)))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((-1, pa.int64()), (bucket, pa.int32()), (out, pa.binary()), (len(counts), pa.int64()), (sum(counts.values()), pa.int64()))], ["block", "bucket", "payload", "n_words", "total"])

    dealt = found.repartition(n, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, f"{SCHEMA}, n_words long, total long")


class Speller(LibraryIds):
    """Ids of words, each as if after one space."""

    def spans_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return spans(self.make([" " + w.decode("utf-8", "replace") for w in words]))

    def starts_word(self) -> np.ndarray:
        """Which ids are spelled with a space in front."""
        n = self.lib.get_vocab_size()
        return np.array([(self.lib.id_to_token(i) or "?")[0] == self.symbols[32] for i in range(n)], bool)


def _speller(path: str) -> Speller:
    return kept(("speller", path), lambda: Speller(path))


#: Stands for a text's end among the ids.
NO_ID = 0xFFFFFFFF


def spelled(words: list[bytes], speller: Speller) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word has, and the ids of all."""
    flat, _, n = speller.spans_of(words)
    if END in words:
        end = words.index(END)
        at = int(n[:end].sum())
        flat = np.concatenate([flat[:at], [-1], flat[at + n[end] :]])
        n[end] = 1
    return n.astype(np.uint32), flat.astype(np.uint32)


class Block:
    """A block's documents as sequences of ids."""

    def __init__(self, payload: bytes):
        whole, known, _, lens, self.numbers, self.n, self.flat = expand(payload)
        self.ids = [int(i) if k else None for i, k in zip(whole, known, strict=True)]
        self.lens = lens.astype(np.int64)

    def ids_of(self, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents' words one after another (NO_ID at ends), and how many each document has."""
        numbers, lens = self.numbers[np.repeat(documents, self.lens)], self.lens[documents]
        n, at = self.n.astype(np.int64), np.cumsum(self.n, dtype=np.int64) - self.n
        ends = np.concatenate([[0], np.cumsum(n[numbers])])
        return gather(self.flat, at[numbers], n[numbers]), np.diff(ends[np.concatenate([[0], np.cumsum(lens)])])


def _payloads(it):
    return (x for batch in it for x in batch.column(0).to_pylist())


def id_counts(homes: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in the training texts, and last how many ends; the vocabulary bounds what the driver gets."""

    def run(it):
        total = np.zeros(size + 1, np.int64)
        for payload in _payloads(it):
            block = Block(payload)
            times = np.bincount(block.numbers, np.repeat(is_training(block.ids), block.lens), len(block.n))
            ids = np.where(block.flat == NO_ID, size, block.flat.astype(np.int64))
            total += np.bincount(ids, np.repeat(times, block.n), size + 1).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    out = np.zeros(size + 1, np.int64)
    for r in homes.select("payload").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


class Symbols:
    """Which symbol stands for each id; the symbols' groups, all of ids that start words or of others."""

    def __init__(self, counts: np.ndarray, n_ends: int, starts_word: np.ndarray, profiles_of):
        own = np.argsort(-counts, kind="stable")[: min(SYMBOLS, int((counts > 0).sum()))]
        n = len(own)
        number = np.full(len(counts), n, np.int64)
        number[own] = np.arange(n)
        number[(number == n) & starts_word] = n + 1
        share = np.bincount(number, counts, n + 3) + 0.5
        share[n + 2] += n_ends
        starts = np.concatenate([starts_word[own], [False, True, True]])
        profiles, sets = profiles_of(number, n + 3), []
        for flag in (True, False):
            rows = np.flatnonzero(starts == flag)
            sets += [rows[s] for s in attention.groups(profiles[rows], share[rows], max(2, round(GROUPS * share[rows].sum() / share.sum())))]
        place = np.empty(n + 3, np.int64)
        place[np.concatenate(sets)] = np.arange(n + 3)
        self.of, self.end = place[number], int(place[n + 2])
        self.edges = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        self.share = np.empty(n + 3)
        self.share[place] = share / share.sum()
        self.starts = np.array([starts[s[0]] for s in sets])
        # ids without a symbol of their own: smoothed share among all such
        shared = number >= n
        pool = np.bincount(number[shared], counts[shared] + 0.5, n + 3)
        self.within = np.where(shared, np.log10((counts + 0.5) / np.maximum(pool[number], 1e-9)), 0.0)

    def of_ids(self, ids: np.ndarray) -> np.ndarray:
        ends = ids == NO_ID
        return np.where(ends, self.end, self.of[np.where(ends, 0, ids)])


def summed(rows: DataFrame, schema_key: str, n: int) -> dict[int, np.ndarray]:
    """Rows (key, payload: an array) added up by their few keys, in so many tasks of one job; the driver gets one array for each key."""

    def added(it):
        for k, same in by_key(it, 0):
            total = None
            for _, payload in same:
                one = expand(payload)[0]
                total = one if total is None else total + one
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([squeeze(total)], pa.binary())], ["key", "payload"])

    met = rows.repartition(n, schema_key).sortWithinPartitions(schema_key).mapInArrow(added, "key int, payload binary")
    return {r["key"]: expand(r["payload"])[0] for r in met.collect()}


def neighbours(homes: DataFrame, number: np.ndarray, n: int, column: np.ndarray) -> np.ndarray:
    """How often each symbol has each column's symbols behind it, then before it, within the training texts."""
    spark = homes.sparkSession
    sent, blocks = spark.sparkContext.broadcast((number, column)), -(-n // TOGETHER)

    def pairs(it):
        number, column = sent.value
        cells = blocks * TOGETHER * 2 * NEIGHBOURS
        table = None
        for payload in _payloads(it):
            block = Block(payload)
            ids, _ = block.ids_of(is_training(block.ids))
            ends = ids == NO_ID
            s = np.where(ends, n - 1, number[np.where(ends, 0, ids)])
            a, b = s[:-1][~ends[:-1]], s[1:][~ends[:-1]]
            table = np.zeros(cells, np.int64) if table is None else table
            table += np.bincount(a * (2 * NEIGHBOURS) + column[b], minlength=cells)
            table += np.bincount(b * (2 * NEIGHBOURS) + NEIGHBOURS + column[a], minlength=cells)
        if table is not None:
            for k, part in enumerate(table.reshape(blocks, -1)):
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([squeeze(part)], pa.binary())], ["key", "payload"])

    table = np.zeros((blocks, TOGETHER * 2 * NEIGHBOURS), np.float32)
    for k, part in summed(homes.select("payload").mapInArrow(pairs, "key int, payload binary"), "key", min(blocks, partitions(spark))).items():  # of fixed size
        table[k] = part
    return table.reshape(-1, 2 * NEIGHBOURS)[:n]


def train(homes: DataFrame, speller: Speller) -> tuple[Symbols, dict]:
    """Symbols and a model from the training texts."""
    spark = homes.sparkSession
    size = speller.lib.get_vocab_size()
    every_id = id_counts(homes, size)
    counts, n_ends = every_id[:-1], int(every_id[-1])

    def profiles(number: np.ndarray, n: int) -> np.ndarray:
        seen = np.argsort(-np.bincount(number, counts, n), kind="stable")[: NEIGHBOURS - 1]
        column = np.full(n, NEIGHBOURS - 1)
        column[seen] = np.arange(len(seen))
        table = neighbours(homes, number, n, column)
        return np.sqrt(table / np.maximum(1, table.sum(1, keepdims=True)))

    symbols = Symbols(counts, n_ends, speller.starts_word(), profiles)
    model = attention.new_model(symbols.share, symbols.edges)
    if not n_ends:
        return symbols, model
    for turn, (every, rate) in enumerate(ROUNDS):
        sent = spark.sparkContext.broadcast((symbols, model))  # a few hundred kB

        def sequences(it, sent=sent, every=every):
            """One row for each block: the training texts' symbols."""
            symbols, _ = sent.value
            for payload in _payloads(it):
                block = Block(payload)
                some = is_training(block.ids) & np.array([zlib.crc32(b"learn %d" % (i or 0)) % every == 0 for i in block.ids], bool)
                if some.any():
                    ids, lens = block.ids_of(some)
                    yield pa.RecordBatch.from_arrays([pa.array([squeeze(symbols.of_ids(ids).astype(np.uint16), lens.astype(np.uint32))], pa.binary())], ["payload"])

        def learn(it, sent=sent, turn=turn, rate=rate):
            symbols, model = sent.value
            parts = [expand(p) for p in _payloads(it)]
            if not parts:
                return
            seqs, lens = (np.concatenate(x) for x in zip(*parts, strict=True))
            windows = attention.Windows(seqs.astype(np.int32), lens.astype(np.int64), len(model["b"]))
            made, _ = attention.train(model, symbols.edges, windows, LEAST_STEPS, rate, seed=turn)
            flat = np.concatenate([*(made[k].ravel() for k in sorted(made)), [1.0]]).astype(np.float64) * len(windows)
            for k, part in enumerate(np.array_split(flat, PARTS)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([squeeze(part)], pa.binary())], ["key", "payload"])

        replicas = -(-int(every_id.sum()) // every // REPLICA_IDS) or 1
        made = homes.select("payload").mapInArrow(sequences, "payload binary").repartition(replicas).mapInArrow(learn, "key int, payload binary")
        found = summed(made, "key", min(PARTS, partitions(spark)))
        if not found:  # so few texts that the sample has none
            continue
        flat = np.concatenate([found[k] for k in range(PARTS)])
        flat, at = (flat[:-1] / flat[-1]).astype(np.float32), 0
        for k in sorted(model):
            model[k] = flat[at : at + model[k].size].reshape(model[k].shape)
            at += model[k].size
    return symbols, model


def lm_scores(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs."""
    spark = docs.sparkSession
    n, rows = partitions(spark), texts(whole_ids(docs))
    found = blocks(rows, cut, bucket_count(rows), _counted, lambda words: spelled(words, _speller(path)))
    homes, found = found.filter("at_home").drop("at_home"), found.filter("not at_home").drop("at_home")
    words = settle(dictionary(found, n), "none")
    total, distinct = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    sent = spark.sparkContext.broadcast(train(homes, _speller(path)))

    def spelling(numbers, lens, n_ids, flat):
        """log10 of each word's spelling, closed, in the order of the words."""
        symbols, model = sent.value
        n_ids = n_ids.astype(np.int64)
        per_word = n_ids[numbers]
        ids = gather(flat, (np.cumsum(n_ids) - n_ids)[numbers], per_word)
        ends = np.cumsum(per_word)
        per_text = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lens)])])
        own, word = attention.log_probs(model, symbols.edges, symbols.of_ids(ids), per_text, symbols.starts)
        own = own / math.log(10) + np.where(ids == NO_ID, 0.0, symbols.within[np.where(ids == NO_ID, 0, ids)])
        word = word / math.log(10)
        starts = ends - per_word
        # given that a word starts here, and that another (or the end) starts after it
        after = np.append(word[starts[1:]], 0.0)
        after[np.cumsum(lens) - 1] = 0.0
        return np.add.reduceat(own, starts) - word[starts] + after

    def answer(it):
        for bucket, same in by_key(it, 1):
            counts: dict[bytes, int] = {}
            for block, _, payload in same:
                if block == -1:
                    lens, data, some = expand(payload)
                    counts = dict(zip(unpack_words(lens, data), some.tolist(), strict=True))
                    continue
                lens, data, _ = expand(payload)
                out = squeeze(np.array([counts.get(w, 0) for w in unpack_words(lens, data)], np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([out], pa.binary())], ["block", "bucket", "payload"])

    def finish(ids, lens, numbers, answers, extra):
        c, spelled_ = answers[0][numbers].astype(np.float64), spelling(numbers, lens, *extra)
        base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
        mixed = np.log10(MIX * c / max(1, total) + (1 - MIX) * 10.0 ** np.maximum(spelled_, -290)) if total else spelled_
        mixed = np.where(c > 0, mixed, math.log10(1 - MIX) + spelled_) if total else spelled_
        first = np.cumsum(lens) - lens
        columns = {
            "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(~is_training(ids)), "n_tokens": pa.array(lens, pa.int64()),
            "n_known": pa.array(np.add.reduceat(c > 0, first, dtype=np.int64), pa.int64()), "train_tokens": pa.array([total] * len(ids), pa.int64()),
            "base_score": pa.array(np.add.reduceat(base, first)), "score": pa.array(np.add.reduceat(mixed, first)),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    asked = found.union(words.select("block", "bucket", "payload")).repartition(n, "bucket").sortWithinPartitions("bucket", "block")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return meet(homes, asked.mapInArrow(answer, SCHEMA), n, finish, schema)


def op8_lm_scores(spark, sf_dir):
    import public_tokenizers

    return lm_scores(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op8_lm_scores": op8_lm_scores}
