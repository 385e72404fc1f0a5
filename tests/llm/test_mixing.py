"""Entropy balancing against a loop: targets, multipliers by bisection, and whole copies near the targets."""

import math
import re
from collections import defaultdict

import pytest

from pairlens.llm import mixing


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def shared(sizes, share=1.5, most=2.0):
    """Targets by sharing, cutting and sharing the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, left, free = {s: 0.0 for s in order}, share * sum(sizes.values()), set(order)
    while left > 1e-9 and free:
        per, spent = left / sum(weight[s] for s in free), 0.0
        for s in sorted(free, key=str):
            give = min(per * weight[s], most * sizes[s] - out[s])
            out[s] += give
            spent += give
        left -= spent
        free = {s for s in free if out[s] < most * sizes[s] - 1e-9}
    return out


def solved(sizes, target, most=2.0):
    """The multiplier of one source by bisection."""
    low, high = -50.0, 50.0
    for _ in range(200):
        m = (low + high) / 2
        low, high = (m, high) if sum(s * min(most, math.exp(min(m * s, 5))) for s in sizes) < target else (low, m)
    return m


def check(rows, got):
    """rows: (doc_id, text, source); got: rows of mixed()."""
    by_source, by_doc = defaultdict(list), defaultdict(list)
    for i, t, s in rows:
        by_source[s].append(words(t))
        by_doc[i].append((words(t), s))
    totals = {s: sum(x) for s, x in by_source.items()}
    want, size_of = shared(totals), {}
    seen, rates = defaultdict(int), defaultdict(set)
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), words(t)) for i, t, _ in rows)
    for r in got:
        source = next(s for n, s in by_doc[r["doc_id"]] if n == r["size"] and totals[s] == r["source_size"] and abs(want[s] - r["target"]) < 1e-6 * (1 + want[s]))
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        seen[source] += r["taken"]
        if r["size"]:
            rates[source].add((r["size"], round(r["rate"], 9)))
            size_of[source] = min(r["size"], size_of.get(source, 1 << 60))
    for s, x in by_source.items():
        if not totals[s]:
            continue
        assert abs(seen[s] - want[s]) <= max(3 * size_of[s], 0.002 * want[s])
        if want[s] < 2 * totals[s] * (1 - 1e-9):
            m = solved(x, want[s])
            assert all(abs(r - min(2, math.exp(m * n))) < 1e-5 for n, r in rates[s])
        else:
            assert {r for _, r in rates[s]} == {2.0}


MANY = [(i, "w " * (1 + i * i % 37), f"s{i % 5}") for i in range(600)] + [(1000 + i, "same five words are here", "s0") for i in range(500)] + [(2000, "long " * 4000, "s1"), (2001, None, None), (2002, "x y\tz", None), (2003, "", "empty"), (2004, "one", "")]


@pytest.mark.parametrize("rows", [MANY, [(1, None, "a"), (2, "", None)], [(None, "a b c", "x"), (None, "a b c", "x"), (3, "d\xa0e\x1c f", None)], []], ids=["many", "wordless", "few", "empty"])
def test_mix_meets_its_targets(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "doc_id long, text string, source string, size int, key string, rate double").repartition(3)
    got = mixing.mixed(df).collect()
    if rows is MANY:
        check(rows, got)
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixed(df.repartition(7)).collect()), key=str)
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)


def test_mix_of_a_table(spark, sf, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    check(rows, mixing.op11_mixing(spark, sf).collect())


def test_odd_documents(odd):
    got = mixing.mixed(odd).collect()
    assert len(got) == odd.count() and {r["source_size"] for r in got} == {sum(r["size"] for r in got)}


def test_targets_share_the_excess_again(spark):
    sizes = {"=a": 10, "=b": 1000, "=c": 5, "=d": 0, "=e": 300, "": 40}
    got = {r["key"]: r["target"] for r in mixing.targets(spark.createDataFrame([(k, v) for k, v in sizes.items()], "key string, source_size long")).collect()}
    want = shared({None if k == "" else k: v for k, v in sizes.items()})
    assert got == pytest.approx({k or "": v for k, v in want.items()})
