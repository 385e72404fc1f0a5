"""The conversation trie against SQL and against a loop, on odd tables and many shards."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from pairlens.llm import prefix_trie as trie


def by_loop(rows):
    """Nodes of rebuilt conversations by plain dictionaries."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    paths = {c: own.get(c - c % 20, [])[: (h := zlib.crc32(str(c).encode()) % 4)] + ts[h:] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
        ends[tuple(p)].append(c)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = lambda x: sum(len(y) == len(x) + 1 and y[:-1] == x for y in members)
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), kids(node), sum(not kids(x) for x in below), saved, sha))
    return sorted(out, key=str)


ODD = [
    (20, 0, "user", "hi there"), (20, 1, "bot", "hello you two"), (20, None, "system", None), (21, 0, "user", "hi there"), (21, 5, None, "x"), (21, 5, None, "x"),
    (23, 0, "a", "b"), (None, 0, "user", "nobody"), (44, 1, "user", ""), (45, 1, "use", "r"), (46, 1, "user", ""), (60, 0, "user", "hi there"),
]
COPIES = [(100 + 20 * i, k, "user", f"turn {k} of the same talk") for i in range(60) for k in range(4)]
DEEP = [(20 * i + 2000, k, "user", f"t{k}" if k < 150 else f"{i} {k}") for i in range(3) for k in range(155)]


@pytest.mark.parametrize("rows", [ODD, COPIES + ODD, DEEP + ODD, []], ids=["odd", "copies", "deep", "empty"])
@pytest.mark.parametrize("shards", [None, 23])
def test_trie_equals_a_loop(spark, rows, shards, monkeypatch):
    if shards == 23:
        monkeypatch.setattr(trie, "CHUNK", 3)
        monkeypatch.setattr(trie, "SPLIT_TURNS", 7)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, path string, n int").repartition(3)
    got = trie.prefix_trie(trie.with_borrowed_heads(trie.turns(df)), shards).collect()
    assert sorted(map(tuple, got), key=str) == by_loop(rows)


def test_query_equals_its_sql(spark, sf):
    got = trie.op13_prefix_trie(spark, sf)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{sf}/conversations.parquet')")
    want = con.execute(trie.SQL["op13_prefix_trie"])
    assert [d[0] for d in want.description] == got.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_skeleton_holds_every_node_that_shards_share(spark):
    """Equal paths are cut apart by their ids, and a node of two shards is a beginning of a splitter."""
    df = spark.createDataFrame(COPIES, "conv_id long, turn long, role string, text string")
    rows = trie._as_bytes(trie.turns(df)).cache()
    cuts = trie.splitters(rows, 8, rows.count())
    assert len(cuts) >= 5 and len({p for p, _ in cuts}) == 1
    child, parent, depth = trie.skeleton(cuts)
    parts = trie._walked(rows, cuts, child).collect()
    assert not [r for r in parts if r["kind"] == 0] and len({r["shard"] for r in parts}) == len(cuts) + 1 and len(parent) == 5
