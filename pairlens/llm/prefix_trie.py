"""The trie of all conversations' beginnings, as one row for each node.

A conversation is a path of turns; conversations that begin alike share nodes. Paths are sequences of
16-byte digests of (role, text), so sorted paths put the members of any node next to each other. The
sorted order is cut into shards at splitters, paths (with their conversation's id, so equal paths can be
cut apart) from a sample. A node that is no beginning of a splitter's path lies within one shard, and a
walk over the shard's sorted rows finishes it. The beginnings of the splitters' paths, the skeleton, are
a small trie that every task has: for its nodes each shard gives partial sums, which are then added up.

Defined results: rows are ordered by turn (null first), then role, then the text's digest; null roles and
texts count as empty; repeated rows are repeated turns; rows without a conv_id belong to no conversation
and are left out; an empty table has no nodes, not even a root. Other columns are not looked at.

Bounds: a conversation is one value of about 24 bytes a turn. The skeleton has at most ``SHARDS`` x
``SPLIT_TURNS`` nodes, whatever the corpus. Splitters deeper than that are cut off there, which leaves
results as they are and only makes shards less even.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, partitions, settle

WIDTH = 16  # bytes of a turn's digest
SHARDS = 4096  # at most
SHARD_TURNS = 200_000  # turns of a shard, until there are SHARDS of them
SPLIT_TURNS = 64  # turns of a splitter at most
SAMPLED = 16  # sampled conversations for each splitter
CHUNK = 20_000  # rows of an output batch, ids of a run of ends
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: kind 0: a finished node; 1: a shard's part of a skeleton node; 2: a run of the ids that end at one.
_PART = f"{NODE}, kind int, skeleton long, parent_skeleton long, words long, shard long, run long, ends binary"
_NAMES = [x.split()[0] for x in _PART.split(", ")]


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, turns: each conversation's turns in order, as structs of digest and words."""
    role, text = (F.coalesce(F.col(k).cast("string"), F.lit("")) for k in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("int")
    # texts stay behind: only their digests are shuffled
    some = rows.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", role.alias("role"), digest.alias("digest"), words.alias("words")).alias("t"))
    ordered = some.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"], t["words"])).alias("turns"))


def with_borrowed_heads(paths: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """paths whose first h turns are those of the conversation at the last multiple of ``every``; h is the id's crc32 modulo ``heads``."""
    own = paths.withColumn("h", (crc_of_id("conv_id") % heads).cast("int")).withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(every)))
    head = paths.filter(F.pmod("conv_id", F.lit(every)) == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    none = F.array().cast(paths.schema["turns"].dataType)
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    rest = F.when(F.size("turns") > F.col("h"), rest).otherwise(none)
    return own.join(head, "base", "left").select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), rest).alias("turns"))


def _as_bytes(paths: DataFrame) -> DataFrame:
    """conv_id, path (its digests), words (32-bit integers), n (turns)."""

    def run(it):
        for batch in it:
            lists = batch.column(1)
            flat, n = lists.flatten(), np.diff(np.array(lists.offsets))
            digests, words = b"".join(flat.field(0).to_pylist()), np.array(flat.field(1), np.int32).tobytes()
            ends = np.cumsum(n).tolist()
            spans = list(zip([0, *ends[:-1]], ends, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([digests[WIDTH * a : WIDTH * b] for a, b in spans], pa.binary()), pa.array([words[4 * a : 4 * b] for a, b in spans], pa.binary()), pa.array(n, pa.int64())],
                ["conv_id", "path", "words", "n"],
            )

    return paths.select("conv_id", "turns").mapInArrow(run, "conv_id long, path binary, words binary, n long")


def splitters(paths: DataFrame, shards: int, n: int) -> list[tuple[bytes, int]]:
    """At most shards - 1 (path, conv_id), in order, that cut n sampled conversations into runs of about as many turns."""
    rate = min(1.0, SAMPLED * shards / max(1, n))
    place = F.pmod(F.xxhash64(F.lit("splitter"), "conv_id"), F.lit(1 << 20))
    rows = paths.filter(place < int(rate * (1 << 20)) + 1).select(F.substring("path", 1, WIDTH * SPLIT_TURNS), "conv_id", "n").collect()
    found = sorted((bytes(p), c, t + 1) for p, c, t in rows)
    upto, total, out, last = 0, sum(t for _, _, t in found), [], 0
    for path, conv, t in found:
        if upto * shards // max(1, total) > last:
            out, last = [*out, (path, conv)], upto * shards // total
        upto += t
    return out


def skeleton(cuts: list[tuple[bytes, int]]) -> tuple[dict[tuple[int, bytes], int], list[int], list[int]]:
    """The trie of the splitters' paths: (node, digest) -> child; each node's parent (the root's: -1) and depth. Parents come first."""
    child, parent, depth = {}, [-1], [0]
    for path, _ in cuts:
        at = 0
        for i in range(0, len(path), WIDTH):
            step = (at, path[i : i + WIDTH])
            if step not in child:
                child[step] = len(parent)
                parent.append(at)
                depth.append(depth[at] + 1)
            at = child[step]
    return child, parent, depth


class _Open:
    """A node whose members are being read; ``bone`` is its number in the skeleton, or -1."""

    __slots__ = ("digest", "bone", "words", "first", "n", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, digest, bone, words):
        self.digest, self.bone, self.words = digest, bone, words
        self.first, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends = [] if bone >= 0 else hashlib.sha256()
        self.waiting = []


class _Shard:
    """A walk over one shard's rows in order of path and id."""

    def __init__(self, number: int, child: dict):
        self.number, self.child, self.out = number, child, []
        self.stack, self.runs = [_Open(b"", 0, 0)], {}

    def add(self, conv: int, path: bytes, words: np.ndarray) -> None:
        n, stack, d = len(path) // WIDTH, self.stack, 0
        while d < n and d + 1 < len(stack) and stack[d + 1].digest == path[WIDTH * d : WIDTH * (d + 1)]:
            d += 1
        self.close(d + 1)
        for i in range(d, n):
            digest, bone = path[WIDTH * i : WIDTH * (i + 1)], stack[-1].bone
            stack.append(_Open(digest, self.child.get((bone, digest), -1) if bone >= 0 else -1, int(words[i])))
        top = stack[-1]
        top.first = conv if top.first is None else min(top.first, conv)
        top.n += 1
        if top.bone < 0:
            top.ends.update(f",{conv}".encode() if top.n > 1 else str(conv).encode())
        else:
            top.ends.append(conv)
            if len(top.ends) >= CHUNK:
                self._run(top)

    def _run(self, node: _Open) -> None:
        """The ids that end at a skeleton node leave as one row."""
        turn = self.runs.get(node.bone, 0)
        self.runs[node.bone] = turn + 1
        self.out.append((None,) * 8 + (2, node.bone, None, None, self.number, turn, ",".join(map(str, node.ends)).encode()))
        node.ends = []

    def close(self, keep: int) -> None:
        """Nodes of this depth and more have all their members."""
        stack = self.stack
        while len(stack) > keep:
            node, depth = stack.pop(), len(stack)
            self.out += [(r[0], r[1], node.first, *r[3:]) for r in node.waiting] if node.bone < 0 else node.waiting
            over = stack[-1] if stack else None
            if over is not None:
                over.n += node.n
                over.first = node.first if over.first is None else min(over.first, node.first)
            if node.bone >= 0:
                if node.ends:
                    self._run(node)
                self.out.append((node.first, depth, None, node.n, node.children, node.leaves, node.saved, None, 1, node.bone, None, node.words, self.number, None, None))
                continue
            leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.words
            over.children += 1
            over.leaves += leaves
            over.saved += saved
            above = over.bone if over.bone >= 0 else None
            over.waiting.append((node.first, depth, None, node.n, node.children, leaves, saved, node.ends.hexdigest(), 0, None, above, None, None, None, None))
            if above is not None and len(over.waiting) >= CHUNK:  # their parent's id is looked up later
                self.out += over.waiting
                over.waiting = []


def _walked(rows: DataFrame, cuts, bones) -> DataFrame:
    """Finished nodes, parts of skeleton nodes and runs of ends of all shards (``_PART``)."""
    shared = rows.sparkSession.sparkContext.broadcast((cuts, bones))
    schema = pa.schema([(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]]) for x in _PART.split(", ")])

    def place(it):
        cuts = shared.value[0]
        for batch in it:
            of = [bisect_right(cuts, key) for key in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.int32())], ["conv_id", "path", "words", "n", "shard"])

    def walk(it):
        child, shard = shared.value[1], None

        def ready(least):
            if shard is not None and len(shard.out) >= least:
                done, shard.out = shard.out, []
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)

        for batch in it:
            for conv, path, words, number in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if shard is None or number != shard.number:
                    if shard is not None:
                        shard.close(0)
                        yield from ready(1)
                    shard = _Shard(number, child)
                shard.add(conv, path, np.frombuffer(words, np.int32))
                yield from ready(CHUNK)
        if shard is not None:
            shard.close(0)
            yield from ready(1)

    placed = rows.mapInArrow(place, "conv_id long, path binary, words binary, n long, shard int")
    dealt = placed.repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id")
    return dealt.mapInArrow(walk, _PART)


def _ends(parts: DataFrame) -> DataFrame:
    """skeleton, ends_sha256: runs of ids stream through their node's hash, in order of shard and run."""

    def run(it):
        at, h, out = None, None, []
        for batch in it:
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if node != at:
                    out += [(at, h.hexdigest())] if h else []
                    at, h = node, hashlib.sha256(ids)
                else:
                    h.update(b"," + ids)
        out += [(at, h.hexdigest())] if h else []
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([x for _, x in out], pa.string())], ["skeleton", "ends_sha256"])

    runs = parts.filter("kind = 2").select("skeleton", "shard", "run", "ends").repartition("skeleton").sortWithinPartitions("skeleton", "shard", "run")
    return runs.mapInArrow(run, "skeleton long, ends_sha256 string")


def _joined(sums: DataFrame, parent: list[int], depth: list[int]) -> DataFrame:
    """Skeleton nodes from the sums of their parts: what their children in the skeleton have is added, deepest first.

    One task, for there is one row for each skeleton node.
    """
    shared = sums.sparkSession.sparkContext.broadcast((parent, depth))

    def run(it):
        rows = {r["skeleton"]: r for batch in it for r in batch.to_pylist()}
        parent, depth = shared.value
        for k in sorted(rows, reverse=True):  # a child's number is above its parent's
            r = rows[k]
            r["n_leaves"] = r["n_leaves"] or 1
            r["saved_tokens"] += (r["n_convs"] - 1) * r["words"]
            if k:
                over = rows[parent[k]]
                over["n_children"] += 1
                over["n_leaves"] += r["n_leaves"]
                over["saved_tokens"] += r["saved_tokens"]
        out = [(k, r["conv_id"], depth[k], rows[parent[k]]["conv_id"] if k else None, r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for k, r in rows.items()]
        names = ["skeleton", *(x for x in _NAMES[:7])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(8)], names)

    return sums.coalesce(1).mapInArrow(run, "skeleton long, " + NODE.removesuffix(", ends_sha256 string"))


def prefix_trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """One row for each distinct beginning of the paths (conv_id, turns as ``turns`` gives them): smallest member, depth,
    the parent's smallest member (the root's: null), members, children, childless nodes at or below it, tokens that
    sharing its subtree saves, and the SHA-256 of the ids that end there."""
    spark = paths.sparkSession
    rows = settle(_as_bytes(paths))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = shards or min(SHARDS, max(partitions(spark), -(-total // SHARD_TURNS)))
    cuts = splitters(rows, shards, n)
    child, parent, depth = skeleton(cuts)
    parts = settle(_walked(rows, cuts, child), by="kind")
    sums = parts.filter("kind = 1").groupBy("skeleton").agg(*(f(k).alias(k) for f, k in ((F.min, "conv_id"), (F.sum, "n_convs"), (F.sum, "n_children"), (F.sum, "n_leaves"), (F.sum, "saved_tokens"), (F.max, "words"))))
    bones = settle(_joined(sums, parent, depth))
    none = hashlib.sha256(b"").hexdigest()
    names = _NAMES[:8]
    # the skeleton's size is bounded, see above
    ends = bones.join(F.broadcast(_ends(parts)), "skeleton", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none))).select(names)
    over = F.broadcast(bones.select(F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("_first")))
    local = parts.filter("kind = 0").join(over, "parent_skeleton", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_first")).select(names)
    return local.unionByName(ends)


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie(with_borrowed_heads(settle(turns(conversations(spark, sf_dir)))))


QUERIES = {"op13_prefix_trie": op13_prefix_trie}

#: crc32 by its table of 256 remainders, made from the polynomial; a node is the list of its turns.
_SQL = """
with remainders as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as r),
ids as (select distinct conv_id from conversations where conv_id is not null),
hs as (select conv_id, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
         lambda c, b: xor(c >> 8, r[cast(xor(c, b) & 255 as int) + 1]))) % 4 as h from ids, remainders),
ordered as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) as k
         from conversations where conv_id is not null),
rebuilt as (select c.conv_id, o.k, o.role, o.text from hs c join ordered o on o.conv_id = c.conv_id - c.conv_id % 20 and o.k <= c.h
         union all select c.conv_id, o.k, o.role, o.text from hs c join ordered o on o.conv_id = c.conv_id and o.k > c.h),
lists as (select i.conv_id, coalesce(list(struct_pack(role := r.role, text := r.text) order by r.k) filter (where r.k is not null), []) as turns
         from ids i left join rebuilt r on i.conv_id = r.conv_id group by i.conv_id),
steps as (select conv_id, d, turns[:d] as node, len(turns) as n, case when d > 0 then len(regexp_extract_all(turns[d].text, '[^\\x20\\x09-\\x0D]+')) else 0 end as words
         from (select conv_id, turns, unnest(range(len(turns) + 1)) as d from lists)),
nodes as (select node, d as depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * max(words) as own,
         sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where n = d), '')) as ends_sha256 from steps group by node, d),
links as (select a.node, b.conv_id as parent_conv_id from nodes a join nodes b on b.node = a.node[:a.depth - 1] and b.depth = a.depth - 1 and a.depth > 0),
kids as (select node[:depth - 1] as node, count(*) as n_children from nodes where depth > 0 group by 1),
below as (select n.*, coalesce(k.n_children, 0) as n_children from nodes n left join kids k on n.node = k.node),
sums as (select t.node[:t.d] as node, sum(t.own) as saved_tokens, sum(case when t.n_children = 0 then 1 else 0 end) as n_leaves
         from (select node, own, n_children, unnest(range(depth + 1)) as d from below) t group by 1)
select b.conv_id, cast(b.depth as bigint) as depth, l.parent_conv_id, cast(b.n_convs as bigint) as n_convs, cast(b.n_children as bigint) as n_children,
  cast(s.n_leaves as bigint) as n_leaves, cast(s.saved_tokens as bigint) as saved_tokens, b.ends_sha256
from below b join sums s on b.node = s.node left join links l on b.node = l.node
"""
SQL = {"op13_prefix_trie": _SQL}
