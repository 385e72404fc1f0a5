"""Helpers shared by the operators of this subpackage.

Every operator takes a DataFrame with at least ``doc_id`` and ``text`` and selects those two
columns first, so extra columns, whatever their names, never clash with the operator's own.
"""

from __future__ import annotations

import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..sources.io import shared_folder


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows of a batch sent to Python; ten thousand texts would take more memory than is needed.
BATCH_ROWS = 1500


def bounded_batches(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text, null texts as empty ones."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def whole_ids(docs: DataFrame) -> DataFrame:
    """docs, if their ids are whole numbers; operators that store ids as such refuse all others."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"doc_id must be a whole number, not {kind.simpleString()}")
    return docs


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that the driver and all executors share; it goes when the session ends."""
    path = shared_folder(spark, "llm")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def settle(df: DataFrame, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """The rows of df from a table written to the shared folder: computed once, lineage cut."""
    spark = df.sparkSession
    path = shared_dir(spark)
    writer = df.write.option("compression", codec)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def crc_of_ids(ids) -> list[int]:
    return [zlib.crc32(b"" if i is None else str(i).encode()) for i in ids]


def looked_up(made: list[bytes], codes: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All values of the words numbered by codes in order; and how many belong to each text of lens words.

    made holds each word's values as the bytes of 32-bit integers.
    """
    flat, starts, n = spans(made)
    n = n[codes]
    ends = np.concatenate([[0], np.cumsum(n)])
    edges = np.concatenate([[0], np.cumsum(lens)])
    return gather(flat, starts[codes], n), np.diff(ends[edges])


def spans(made: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' values one after another, where each word's start, how many it has."""
    n = np.fromiter(map(len, made), np.int64, len(made)) // 4
    return np.frombuffer(b"".join(made), np.int32), np.cumsum(n) - n, n


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """flat[starts[0]:starts[0]+lens[0]], flat[starts[1]:...], ... as one array."""
    total = int(lens.sum())
    shift = np.repeat(starts - (np.cumsum(lens) - lens), lens)
    return flat[shift + np.arange(total)]


#: White space next to white space, or the mark used below: such texts are not cut.
_TIGHT = r"[\t-\r\x1c-\x20\x85\p{Z}]{2}|\x02"


def space_pieces(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pieces of texts cut before single spaces and around single line ends.

    Returns the distinct pieces, their numbers in order, how many each text has, and which texts
    were left whole. The pre-token pattern of byte-level BPE ties one space to what follows it and
    keeps a lone line end apart, so each piece is encoded alike alone and in its text; where white
    space meets white space this doesn't hold, and such texts are one piece.
    """
    whole = pc.match_substring_regex(texts, _TIGHT)
    cut = pc.replace_substring(texts, "\n", " \x02\n \x02")
    cut = pc.binary_join_element_wise(pa.scalar("\x02", texts.type), cut, pa.scalar("", texts.type))
    lists = pc.split_pattern(cut, " ")
    lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    is_whole = whole.to_numpy(zero_copy_only=False)
    if is_whole.any():
        rows = np.repeat(is_whole, lens)
        first = np.zeros(len(rows), bool)
        first[(np.cumsum(lens) - lens)[is_whole]] = True
        flat = pc.replace_with_mask(flat, pa.array(first), texts.filter(whole)).filter(pa.array(~rows | first))
        lens = np.where(is_whole, 1, lens)
        mark = pa.array(np.repeat(is_whole, lens))
        flat = pc.if_else(mark, pc.binary_join_element_wise(pa.scalar("\x02", texts.type), flat, pa.scalar("", texts.type)), flat)
    coded = flat.dictionary_encode()
    words = [w[1:] if w[:1] == "\x02" else " " + w for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
    return words, coded.indices.to_numpy().astype(np.int64), lens, is_whole


def tokenizer(path: str):
    """The tokenizers library's tokenizer; one thread, for Spark runs one task on each core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_symbols() -> dict[int, str]:
    """Byte -> the printable character that stands for it in byte-level BPE files (for str.translate)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class LibraryIds:
    """Ids of whole texts as the tokenizers library gives them for byte-level BPE.

    Each distinct pre-token goes through the library's model once; texts that can't be cut into
    pieces, and pieces that hold an added token's string, go through the whole library. Pieces and
    pre-tokens met before are remembered in two tables of bounded size: what was met in neither the
    last full one nor the one being filled is forgotten.
    """

    MEMO = 200_000

    def __init__(self, path: str):
        import regex

        self.lib = tokenizer(path)
        self.model = self.lib.model
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.find, self.symbols = regex.compile(PATTERN).findall, byte_symbols()
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _tokens(self, piece: str) -> list[str]:
        """Its pre-tokens; a word of plain letters, maybe with a comma or point behind, needs no pattern."""
        if piece.isascii() and (piece[:1] == " " or piece[:1].isalpha()):
            if piece[1:].isalpha():
                return [piece]
            if piece[-1] in ",." and piece[1:-1].isalpha():
                return [piece[:-1], piece[-1]]
        return self.find(piece)

    def _remember(self, key: str, value: bytes) -> None:
        if len(self.new) >= self.MEMO:
            self.old, self.new = self.new, {}
        self.new[key] = value

    def _token(self, token: str) -> bytes:
        if (got := self.new.get(token)) is None:
            if (got := self.old.get(token)) is None:
                plain = token.replace(" ", self.symbols[32]) if token.isascii() and token.isprintable() else token.encode().decode("latin-1").translate(self.symbols)
                got = array("i", [x.id for x in self.model.tokenize(plain)]).tobytes()
            self._remember(token, got)
        return got

    def _piece(self, piece: str) -> bytes:
        if len(piece) > 64 or "<" in piece and any(x in piece for x in self.added):
            return array("i", self.lib.encode(piece, add_special_tokens=False).ids).tobytes()
        tokens = self._tokens(piece)
        if len(tokens) == 1:
            return self._token(piece)
        got = b"".join([self._token(t) for t in tokens])
        self._remember(piece, got)
        return got

    def make(self, pieces: list[str]) -> list[bytes]:
        out = []
        for piece in pieces:
            if (got := self.new.get(piece)) is None:
                if (got := self.old.get(piece)) is None:
                    got = self._piece(piece)
                else:
                    self._remember(piece, got)
            out.append(got)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words, codes, lens, _ = space_pieces(texts)
        return looked_up(self.make(words), codes, lens)


_KEPT: dict = {}


def kept(key, make):
    """One object per worker process, built on first use."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def slices(texts: pa.Array, limit: int = 3_000_000):
    """Start and end of runs of texts with at most so many bytes each, or of one text."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def text_batches(it, limit: int = 3_000_000):
    """(ids, texts) of Arrow batches, a bounded number of bytes at a time."""
    for batch in it:
        ids, column = batch.column(0), batch.column(1).cast(pa.large_string())
        for a, b in slices(column, limit):
            yield ids.slice(a, b - a), pa.concat_arrays([column.slice(a, b - a)])
    pa.default_memory_pool().release_unused()  # the worker process outlives the task
