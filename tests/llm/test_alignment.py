"""Alignment of two tokenizers against a loop over whole texts with the libraries themselves."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece

from pairlens.llm import alignment
from pairlens.llm.common import byte_symbols, tokenizer

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
HARD = ["a  b", " lead", "tail ", "\n", "\n\nx", "a\nb", "a \nb", "a\n b", "tab\there", "a▁b", "▁", "<s> </s> <0x0A> <unk>", "<|endoftext|>", "x\x00y", "ﬁ ﬀ ａ", "a\x1cb \x1c c", "a\xa0b", "中文 字符 🙂🙃", "é é", "''' \"\" ...", "if (x) {\r\n    y();\r\n}\r\n", "'s it's 'S", " ", "   ", "word\n\n\nword", "𝔘𝔫𝔦 " * 3]


def tokens(text, lib, sp, back):
    if not text:
        return None
    a = lib.encode(" " + text, add_special_tokens=False).ids
    b = sp.encode(text)
    ab = [bytes(back[c] for c in lib.id_to_token(i)) for i in a]
    bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    whole = (" " + text).encode()
    if b"".join(ab) != whole or b"".join(bb) != whole:
        return None
    ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))] if len(parts) < 500 else list(__import__("itertools").accumulate(map(len, parts)))
    ea, eb = ends(ab), ends(bb)
    groups, at = [], (0, 0)
    for e in sorted(set(ea) & set(eb)):
        i, j = ea.index(e) + 1 if len(ea) < 500 else __import__("bisect").bisect(ea, e), eb.index(e) + 1 if len(eb) < 500 else __import__("bisect").bisect(eb, e)
        groups.append((a[at[0] : i], b[at[1] : j]))
        at = (i, j)
    return a, b, groups


def by_loop(rows):
    lib, sp = tokenizer(A), sentencepiece.SentencePieceProcessor(model_file=B)
    lib.encode_special_tokens = True
    back = {s: b for b, s in byte_symbols().items()}
    found = [(i, tokens(t, lib, sp, back)) for i, t in rows]
    counts = Counter(p for _, f in found if f for p in {(x, y) for g in f[2] for x in g[0] for y in g[1]})
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = Counter()
    for i, f in found:
        if f is None:
            out[i, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        links = [(x, y) for g in f[2] for x in g[0] for y in g[1]]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in f[2])
        out[i, len(f[0]), len(f[1]), len(f[2]), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest()] += 1
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, block string, n_a int, bucket int").repartition(3)


@pytest.mark.parametrize("which", ["hard", "odd", "docs", "empty"])
def test_alignment_equals_a_loop(request, spark, which, monkeypatch):
    df = table(spark, [(i, t) for i, t in enumerate(HARD * 2)]) if which == "hard" else request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = alignment.aligned(df, A, B).collect()
    assert Counter(map(tuple, got)) == by_loop(rows)


def test_totals_are_added_up_in_parts(spark, docs, monkeypatch):
    monkeypatch.setattr(alignment, "COMPACT", 1000)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 20_000)
    some = docs.limit(60).cache()
    assert Counter(map(tuple, alignment.aligned(some, A, B).collect())) == by_loop([(r["doc_id"], r["text"]) for r in some.collect()])


def test_overlaps_share_the_bytes_they_say(spark):
    rows = [(i, t) for i, t in enumerate([*HARD, "tokenization of unbelievable words, naïvely", ""])]
    got = defaultdict(set)
    for r in alignment.token_overlaps(table(spark, rows), A, B).collect():
        got[r["doc_id"]].add((r["a"], r["b"], r["a_id"], r["b_id"], r["start"], r["end"], r["group"]))
    lib, sp = tokenizer(A), sentencepiece.SentencePieceProcessor(model_file=B)
    lib.encode_special_tokens = True
    back = {s: b for b, s in byte_symbols().items()}
    for i, t in rows:
        found, want, at = tokens(t, lib, sp, back), set(), [0, 0, 0, 0]
        for g, (x, y) in enumerate(found[2] if found else []):
            lens_a = [len(lib.id_to_token(k)) for k in x]
            lens_b = [1 if sp.is_byte(k) else len(sp.id_to_piece(k).replace("▁", " ").encode()) for k in y]
            for p, ka in enumerate(x):
                for q, kb in enumerate(y):
                    s, e = max(sum(lens_a[:p]), sum(lens_b[:q])), min(sum(lens_a[: p + 1]), sum(lens_b[: q + 1]))
                    if s < e:
                        want.add((at[0] + p, at[1] + q, ka, kb, at[2] + s, at[2] + e, g))
            at = [at[0] + len(x), at[1] + len(y), at[2] + sum(lens_a), 0]
        assert got[i] == want
