"""Near-duplicate documents by weighted minwise hashing with thrown darts.

A text is the multiset of its five-word shingles, a shingle's weight the times it occurs. Every
shingle owns a random, hash-determined rain of darts on its (weight, rank) quadrant: for each strip
of weights a Poisson process along the rank axis, each dart with a place in the strip and one of the
signature's coordinates. A text sees the darts below its weights; per coordinate the earliest dart
wins. Two texts agree in a coordinate with the probability of their weighted Jaccard similarity.
A text needs about k ln k + 2k darts, however long it is, for ranks beyond that are not thrown; in the
rare case that a coordinate stays empty the rank limit is doubled.

Signatures are cut into bands; equal bands are candidates. Exact copies are set aside first and count
as one document. In each bucket all members are compared with a few hubs, the members with the largest
buckets (the text that others were copied from, as a rule), so that a large group of copies is one class
after a few comparisons for each member. Members of buckets that still hold several classes then meet by
their rarest shingles (see ``_rare``: no pair that is similar enough fails to meet), again with a few hubs
and then with more, until all pairs that meet have been compared. A pair is skipped only if its members are
already in one class or it was compared before, so no link between classes is lost. Texts that share a
long passage but are under the threshold don't meet there, unless their rest is shared by some as well.
Nothing is capped.

Two tests within the join leave few pairs that aren't similar. The parity of the shingles (each place in
a text counts) that fall on each of ``PARITIES`` bits: two texts differ in at least as many shingles as
their parities have different bits, so no similar pair is lost, and texts of some hundred words that are
under the threshold rarely pass. And the coordinates in which 4 bits of the signatures agree: pairs that
agree in less than ``ESTIMATE`` of them are done (at a similarity of 0.8 that happens to 2 pairs in 10,000,
at 0.85 to fewer than one in a million). The texts of the other pairs are compared exactly.

Nulls and empty texts have no shingles: copies of each other form a class, nothing else joins them.
A null or repeated doc_id is a row like any other; rows of one id and text share a class.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, settle, text_batches, texts
from .components import components
from .shingles import mix, shingle_hashes

BANDS, ROWS, THRESHOLD, WIDTH = 24, 6, 0.8, 5
#: Hubs of a bucket in the first turn, and how many times as many in each later one.
HUBS, MORE = 2, 16
#: Bits of a text's parities; a multiple of 64.
PARITIES = 1024
#: Least share of a code's places in which two texts must agree to be compared exactly: 3.5 standard
#: deviations under the share at the threshold, 0.8 + 0.2 / 16.
ESTIMATE = 0.699
#: Most digests (of about 60 bytes) that are broadcast.
SENT = 200_000


def weighted(column: pa.Array, width: int = WIDTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct shingle hashes, ascending, with their counts."""
    hashes, lens = shingle_hashes(column, width)
    ends = np.cumsum(lens)
    return [np.unique(hashes[a:b], return_counts=True) for a, b in zip((ends - lens).tolist(), ends.tolist(), strict=True)]


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """Per set and coordinate the hash of its earliest dart (0 for an empty set)."""
    n = len(sets)
    out = np.zeros((n, k), np.uint64)
    todo = np.array([i for i, s in enumerate(sets) if len(s[0])], np.int64)
    reach = float(k * (math.log(k) + 2))
    while len(todo):
        keys = np.concatenate([sets[i][0] for i in todo])
        weights = np.concatenate([sets[i][1] for i in todo]).astype(np.float64)
        row = np.repeat(np.arange(len(todo)), [len(sets[i][0]) for i in todo])
        limit = reach / np.bincount(row, weights)
        best, name = np.full(len(todo) * k, np.inf), np.zeros(len(todo) * k, np.uint64)
        low, strip = 0.0, 0
        while len(keys):
            high = 1.0 if strip == 0 else 2.0 * low
            _throw(keys, weights, row, limit, strip, low, high, k, best, name)
            some = weights > high
            keys, weights, row = keys[some], weights[some], row[some]
            low, strip = high, strip + 1
        full = np.isfinite(best).reshape(-1, k).all(1)
        out[todo[full]] = name.reshape(-1, k)[full]
        todo, reach = todo[~full], 2 * reach
    return out


def _throw(keys, weights, row, limit, strip, low, high, k, best, name) -> None:
    """All darts of one strip of weights, in the order of their ranks."""
    with np.errstate(over="ignore"):
        seed = mix(keys + np.uint64((strip + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        rank, turn = np.zeros(len(keys)), 0
        while len(seed):
            dart = mix(seed + np.uint64((turn + 1) * 0xD1B54A32D192ED03 % (1 << 64)))
            rank = rank - np.log(_unit(dart)) / (high - low)
            some = rank <= limit[row]
            if not some.all():
                seed, rank, row, weights, dart = seed[some], rank[some], row[some], weights[some], dart[some]
            if not len(seed):
                return
            place = mix(dart ^ np.uint64(0xA0761D6478BD642F))
            hit = low + (high - low) * _unit(place) <= weights if strip or not (weights == 1).all() else slice(None)
            spot = row[hit] * k + (mix(place) % np.uint64(k)).astype(np.int64)[hit]
            r, d = rank[hit], dart[hit]
            np.minimum.at(best, spot, r)
            won = best[spot] == r
            name[spot[won]] = d[won]
            turn += 1


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two shingle multisets; 0 if either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], True, True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / (int(a[1].sum()) + int(b[1].sum()) - common)


def _places(one: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A hash of each shingle of a text; a shingle's repeats have hashes of their own."""
    keys, counts = one
    turn = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    with np.errstate(over="ignore"):
        return mix(np.repeat(keys, counts) + (turn.astype(np.uint64) + np.uint64(1)) * np.uint64(0x8EBC6AF09C88C6E3))


def parities(sets: list[tuple[np.ndarray, np.ndarray]], bits: int = PARITIES) -> np.ndarray:
    """Per set and bit whether an odd number of its shingles falls there; a shingle's repeats fall apart."""
    n = np.array([int(s[1].sum()) for s in sets], np.int64)
    place = np.concatenate([np.zeros(0, np.uint64), *(_places(s) for s in sets)]) % np.uint64(bits)
    odd = np.bincount(np.repeat(np.arange(len(sets)), n) * bits + place.astype(np.int64), minlength=len(sets) * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(sets), bits), axis=1).view(np.int64)


def _lists(values: np.ndarray) -> pa.Array:
    """One list for each row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def _bands(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, bands (empty for a text without shingles), code (4 bits of each coordinate), parity, weight (shingles), digest of every row."""

    def run(ids, column):
        sets = weighted(column)
        signed = signatures(sets, bands * rows).reshape(-1, bands, rows)
        with np.errstate(over="ignore"):
            keys = np.zeros(signed.shape[:2], np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
            for r in range(rows):
                keys = mix(keys ^ signed[:, :, r])
        some = np.array([len(s[0]) > 0 for s in sets], np.int64)
        at = np.concatenate([[0], np.cumsum(some * bands)])
        values = pa.array(keys[some.astype(bool)].ravel().view(np.int64))
        code = (mix(signed.reshape(len(sets), -1)) & np.uint64(15)).astype(np.uint8)
        code = np.pad(code, ((0, 0), (0, -code.shape[1] % 16)))
        code = (code[:, ::2] | code[:, 1::2] << 4).view(np.int64)
        weight = pa.array([int(s[1].sum()) for s in sets], pa.int64())
        return [ids, pa.ListArray.from_arrays(pa.array(at, pa.int32()), values), _lists(code), _lists(parities(sets)), weight]

    def all_of(it):
        for batch in it:
            at = 0
            for ids, column in text_batches([batch.select([0, 1])]):
                yield pa.RecordBatch.from_arrays([*run(ids, column), batch.column(2).slice(at, len(ids))], ["doc_id", "bands", "code", "parity", "weight", "digest"])
                at += len(ids)

    with_digest = texts(docs).select("doc_id", "text", F.md5("text").alias("digest"))
    return with_digest.mapInArrow(all_of, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, bands array<long>, code array<long>, parity array<long>, weight long, digest string")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of the wanted nodes (node, digest)."""
    # few wanted texts are sent to the tasks that read the documents; many are met in a shuffle
    few = F.broadcast(wanted.select("digest")) if wanted.count() <= SENT else wanted.select("digest")
    rows = texts(docs).withColumn("digest", F.md5("text")).join(few, "digest", "left_semi")
    return rows.groupBy("digest").agg(F.first("text").alias("text")).join(wanted, "digest").select("node", "text")


def _similar(pairs: DataFrame, of: DataFrame, threshold: float) -> DataFrame:
    """The pairs a, b whose texts are similar enough, compared exactly."""

    def run(it):
        for batch in it:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            # a hub's text comes once in many pairs of a batch
            nodes, column = pa.concat_arrays([batch.column(0), batch.column(1)]), pa.concat_arrays([batch.column(2), batch.column(3)])
            _, first = np.unique(nodes.to_numpy(), return_index=True)
            some = pa.RecordBatch.from_arrays([nodes.take(pa.array(first)), column.take(pa.array(first))], ["node", "text"])
            sets = {}
            for ids, part in text_batches([some]):
                sets |= dict(zip(ids.to_pylist(), weighted(part), strict=True))
            found = [similarity(sets[x], sets[y]) >= threshold for x, y in zip(a, b, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(found, pa.bool_()))

    left, right = (of.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long")


def _agreeing(a: Column, b: Column, longs: int) -> Column:
    """How many of the 4-bit places of two codes are equal.

    Lambdas over arrays, for the same written out would be too large a method for the JVM to compile.
    """
    other = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    # the lowest bit of each place becomes 1 if any of its bits is
    other = F.transform(other, lambda x: x.bitwiseOR(F.shiftrightunsigned(x, 2)))
    other = F.transform(other, lambda x: x.bitwiseOR(F.shiftrightunsigned(x, 1)))
    count = F.aggregate(other, F.lit(0), lambda n, x: n + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111))))
    return F.lit(16 * longs) - count


def _elements(of: DataFrame) -> DataFrame:
    """node, weight, element for every shingle of the texts (node, text); a shingle's repeats are elements of their own."""

    def run(it):
        for nodes, column in text_batches(it):
            sets = weighted(column)
            n = np.array([int(s[1].sum()) for s in sets], np.int64)
            keys = np.concatenate([np.zeros(0, np.uint64), *(_places(s) for s in sets)])
            rows = [np.repeat(nodes.to_numpy(), n), np.repeat(n, n), keys.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], ["node", "weight", "element"])

    return of.mapInArrow(run, "node long, weight long, element long")


def _rare(of: DataFrame, threshold: float) -> DataFrame:
    """bucket, node, weight, place, short: each text's rarest elements, where another text has them too.

    Texts of sizes x <= y and a similarity of t share at least 2t/(1+t) x and at least t y elements. With all
    elements in one order, one of the first x - 2t/(1+t) x + 1 of the smaller text (``short``) is then among the
    first y - t y + 1 of the larger one. For a given pair the first shared element is so early in both that
    t/(1+t) (x + y) elements can be shared from it on (``_early``). In the order of their numbers of texts, what a whole group has in
    common comes last, and texts that share only that don't meet.
    """
    elements = settle(_elements(of))
    counts = elements.groupBy("element").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("n", "element"))
    first = F.col("weight") - F.ceil(F.col("weight") * threshold - 1e-6) + 1
    shorter = F.col("weight") - F.ceil(F.col("weight") * (2 * threshold / (1 + threshold)) - 1e-6) + 1
    rare = elements.join(counts, "element").withColumn("place", place).filter(F.col("place") <= first)
    rare = settle(rare.select(F.col("element").alias("bucket"), "node", "weight", "place", (F.col("place") <= shorter).alias("short")))
    met = rare.groupBy("bucket").agg(F.count("*").alias("n"), F.max("short").alias("any")).filter("n > 1 and any").select("bucket")
    return rare.join(met, "bucket")


def _early(threshold: float) -> Column:
    """Whether enough elements of a member and its hub are left from the place on where they meet."""
    shared = F.ceil((F.col("weight") + F.col("hub_weight")) * (threshold / (1 + threshold)) - 1e-6)
    return F.least(F.col("weight") - F.col("place"), F.col("hub_weight") - F.col("hub_place")) + 1 >= shared


def _merged(label: DataFrame, fresh: DataFrame) -> DataFrame:
    """The labels of the nodes after the pairs a, b are linked."""
    if not fresh.limit(1).count():
        return label
    # the classes so far are the nodes of the graph
    edges = fresh.join(label.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(label.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    found = components(edges.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    found = found.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return settle(label.join(found, "label", "left").select("node", F.coalesce("to", "label").alias("label")))


def _open(left: DataFrame, label: DataFrame) -> DataFrame:
    """The members of buckets that still hold several classes, with their labels."""
    now = left.join(label, "node")
    several = now.groupBy("bucket").agg(F.min("label").alias("one"), F.max("label").alias("other")).filter("one < other").select("bucket")
    return settle(now.join(several, "bucket", "left_semi"))


def _classes(docs: DataFrame, threshold: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, digest of every row; label, digest, n_exact of each text; and of each class (label) its class_id,
    class_size, and the id and digest that come first in it, nulls last."""
    signed = settle(_bands(docs, bands, rows))
    first = [F.first(k).alias(k) for k in ("bands", "code", "parity", "weight")]
    # a number for each distinct text: its own, for doc_id can be null or have several texts
    exact = signed.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_exact"), *first)
    exact = settle(exact.withColumn("node", F.monotonically_increasing_id()))
    every = exact.select("node", F.explode("bands").alias("bucket"))
    shared = every.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = settle(every.join(shared, "bucket").select("bucket", "node", "n"))
    wide = members.groupBy("node").agg(F.sum("n").alias("wide"))
    flat = [F.col("parity")[k].alias(f"p{k}") for k in range(PARITIES // 64)]
    nodes = settle(wide.join(exact, "node").select("node", "wide", "weight", "digest", "code", *flat))
    of = settle(_texts_of(docs, nodes.select("node", "digest")))
    signs = nodes.drop("digest")
    hubs_signs = signs.select(*(F.col(k).alias(f"hub_{k}" if k != "node" else "hub") for k in signs.columns))
    longs = -(-bands * rows // 16)
    least = ESTIMATE * bands * rows + 16 * longs - bands * rows  # filling places always agree
    differ = sum((F.bit_count(F.col(f"p{k}").bitwiseXOR(F.col(f"hub_p{k}"))) for k in range(1, PARITIES // 64)), F.bit_count(F.col("p0").bitwiseXOR(F.col("hub_p0"))))
    most = (F.col("weight") + F.col("hub_weight")) * ((1 - threshold) / (1 + threshold)) + 1e-6
    likely = (differ <= most) & (_agreeing(F.col("code"), F.col("hub_code"), longs) >= least)
    # the same order in all buckets, so that the buckets of a group agree on its hubs
    order = Window.partitionBy("bucket").orderBy(F.desc("wide"), "node")
    pair = [F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")]
    label, hubs = nodes.select("node", F.col("node").alias("label")), HUBS

    # the buckets of the bands, with a few hubs each
    now = _open(members.select("bucket", "node"), label)
    chosen = now.join(signs.select("node", "wide"), "node").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= hubs)
    chosen = settle(chosen.select("bucket", F.col("node").alias("hub"), F.col("label").alias("hub_label")))
    after = (F.col("hub_wide") > F.col("wide")) | ((F.col("hub_wide") == F.col("wide")) & (F.col("hub") < F.col("node")))
    coded, hub = now.join(signs, "node"), chosen.join(hubs_signs, "hub")
    met = (coded["bucket"] == hub["bucket"]) & (F.col("label") != F.col("hub_label")) & after & likely
    sent = settle(coded.join(hub, met).select(*pair).distinct())
    label = _merged(label, settle(_similar(sent, of, threshold)))
    left = now.select("bucket", "node").join(chosen.select("bucket", F.col("hub").alias("node")), ["bucket", "node"], "left_anti")
    rest = settle(_open(left, label).select("node").distinct())
    if rest.limit(1).count():
        # what these leave in different classes meets by its rarest elements
        left = settle(_rare(of.join(rest, "node", "left_semi"), threshold).join(signs.select("node", "wide"), "node"))
        while True:
            now = _open(left, label)
            chosen = now.filter("short").withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= hubs)
            chosen = settle(chosen.select("bucket", F.col("node").alias("hub"), *(F.col(k).alias(f"hub_{k}") for k in ("label", "weight", "place"))))
            if not chosen.limit(1).count():
                break
            pairs = now.join(chosen, "bucket").filter((F.col("label") != F.col("hub_label")) & _early(threshold))
            pairs = settle(pairs.select(*pair).distinct().join(sent, ["a", "b"], "left_anti"))
            # signatures go to each pair once, texts to the pairs that these leave
            fit = pairs.select(F.col("a").alias("node"), F.col("b").alias("hub")).join(signs, "node").join(hubs_signs, "hub").filter(likely)
            label = _merged(label, settle(_similar(settle(fit.select(*pair)), of, threshold)))
            sent = sent.union(pairs)
            left = now.drop("label").join(chosen.select("bucket", F.col("hub").alias("node")), ["bucket", "node"], "left_anti")
            hubs *= MORE
    grouped = exact.select("node", "digest", "least", "n_exact").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = F.min(F.struct(F.col("least").isNull(), "least", "digest"))
    of = grouped.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n_exact").alias("class_size"), first.alias("first"))
    return signed, grouped, of


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), class_size, n_exact (rows with the same text)."""
    signed, grouped, of = _classes(docs, threshold, bands, rows)
    of = grouped.join(of, "label").select("digest", "class_id", "class_size", "n_exact")
    return signed.select("doc_id", "digest").join(of, "digest").drop("digest")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of docs for each class: the least by doc_id (nulls last), then by the digest of its text.

    A doc_id says nothing about the class, for it can be null or have several texts. Only of rows that
    share id and text any one stays.
    """
    signed, _, of = _classes(docs, THRESHOLD, BANDS, ROWS)
    stay = settle(of.select(F.col("first.least").alias("id"), F.col("first.digest").alias("digest")))
    # rows are one column here, so that no name of theirs can clash
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"), F.md5(F.coalesce("text", F.lit(""))).alias("row_digest"))
    same = F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_digest") == F.col("digest"))
    kept = rows.join(stay, same, "left_semi")
    # texts are only dealt out once more where rows do repeat
    signs = signed.select(F.col("doc_id").alias("row_id"), F.col("digest").alias("row_digest"))
    if signs.join(stay, same, "left_semi").groupBy("row_id", "row_digest").count().filter("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["row_id", "row_digest"])
    return kept.select("row.*")


def op1_near_dedup(spark, sf_dir):
    return near_classes(documents(spark, sf_dir))


QUERIES = {"op1_near_dedup": op1_near_dedup}
