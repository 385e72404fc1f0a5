"""Token counts by heap-and-linked-list byte-pair merging, without making ids.

A text has as many tokens as its words have initial symbols, less the merges made in them. Words
are counted once per worker and looked up afterwards. Nulls count as empty texts, repeated rows
give repeated rows, an empty table an empty result. Very long texts are merged in n log n.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import merge
from .common import byte_symbols, documents, kept, text_batches, texts


class WordCounts:
    """Counts of lower-cased texts for a tokenizer file with word ends (``</w>``)."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.end = spec["model"]["end_of_word_suffix"] or ""
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, self.added)))
        self.find = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.symbols, self.counts = byte_symbols(), {}

    def rank_of(self, a: str, b: str):
        return self.ranks.get((a, b))

    def count(self, word: str) -> int:
        n = self.counts.get(word)
        if n is None:
            if len(self.counts) > 400_000:
                self.counts.clear()
            symbols = list(word.encode().decode("latin-1").translate(self.symbols))
            symbols[-1] += self.end
            n = len(symbols) - merge(symbols, self.rank_of)
            if len(word) <= 64:
                self.counts[word] = n
        return n

    @staticmethod
    def folded(text: str) -> str:
        if not text.isascii():
            # character by character: a final sigma is no special case
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def of(self, texts: pa.Array) -> np.ndarray:
        plain, extra = texts.to_pylist(), np.zeros(len(texts), np.int64)
        for i, t in enumerate(plain):
            if "<|" in t and (parts := self.cut.split(t))[1:]:
                extra[i] = len(parts) - 1
                plain[i] = "\n".join(self.folded(p) for p in parts)
            else:
                plain[i] = self.folded(t)
        # white space only parts words, so a text may be cut at spaces and line ends
        lists = pc.split_pattern(pc.replace_substring(pa.array(plain, pa.large_string()), "\n", " "), " ")
        lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        counts = np.array([sum(map(self.count, self.find(p))) for p in coded.dictionary.to_pylist()], np.int64)
        ends = np.concatenate([[0], np.cumsum(counts[coded.indices.to_numpy()])])
        edges = np.concatenate([[0], np.cumsum(lens)])
        return np.diff(ends[edges]) + extra


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs."""

    def run(it):
        counter = kept(("counts", path), lambda: WordCounts(path))
        for ids, column in text_batches(it):
            n = pa.array(counter.of(column), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pc.binary_length(column).cast(pa.int64()), n], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = texts(docs).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op5_token_counts": op5_token_counts}
