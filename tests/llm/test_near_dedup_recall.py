"""Recall of near-duplicate classes against all pairs, on short and long texts with planted near copies.

``python tests/llm/test_near_dedup_recall.py`` prints the figures.
"""

from collections import Counter

import numpy as np
import pytest

from pairlens.llm import near_dedup


def shingles(text):
    w = text.split()
    return Counter(zip(*(w[k:] for k in range(5)), strict=False))


def similarity(a, b):
    common = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return common / (sum(a.values()) + sum(b.values()) - common)


def planted(words, groups, copies, seed):
    """Texts of so many words and edits of them; an edit of one word takes five shingles, so the shares give similarities from 0.7 to 1."""
    rng, rows = np.random.default_rng(seed), []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(words)]
        rows.append(" ".join(base))
        for c in range(copies):
            w = list(base)
            for at in rng.choice(words, rng.integers(0, max(2, round(words * 0.035)) + 1), replace=False):
                w[at] = f"e{g}x{c}x{at}"
            rows.append(" ".join(w))
    return list(enumerate(rows))


def figures(spark, words, groups, copies, seed):
    """(pairs of 0.8 or more, those of them in one class, pairs in one class that no chain of links joins)"""
    rows = planted(words, groups, copies, seed)
    sets = [shingles(t) for _, t in rows]
    per, links, root = copies + 1, [], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for g in range(groups):  # texts of different groups have no shingle in common
        for a in range(g * per, (g + 1) * per):
            links += [(a, b) for b in range(g * per, a) if similarity(sets[a], sets[b]) >= 0.8]
    for a, b in links:
        root[top(a)] = top(b)
    of = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wrong = sum(of[a] == of[b] and top(a) != top(b) for a in range(len(rows)) for b in range(a))
    return len(links), sum(of[a] == of[b] for a, b in links), wrong


CASES = [(60, 40, 6, 1), (300, 20, 6, 2), (1840, 8, 6, 3)]


@pytest.mark.parametrize("case", CASES)
def test_recall_of_links(spark, case):
    links, found, wrong = figures(spark, *case)
    assert links > case[1] and found >= 0.9 * links and wrong == 0


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    for one in CASES:
        print(one, figures(session, *one))
