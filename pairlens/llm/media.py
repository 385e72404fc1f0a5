"""ISO base media files: written with raw 8-bit frames, and read by walking their boxes.

Payloads become uncompressed monochrome video of 16 x 12 samples: 192 bytes a frame, 25 frames a
second, every 25th frame marked as a sync sample. The reader walks nested boxes of any file,
decodes the sample tables (sizes, chunks, offsets, times, sync samples) and gives codec, duration
and the byte range of each key frame, without touching the frames themselves.

Nulls count as empty texts, an empty text is one frame of blanks; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, settle, text_batches, texts

WIDTH, HEIGHT, RATE, GROUP = 16, 12, 25, 25
FRAME = WIDTH * HEIGHT
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"}
_MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def wrap(payload: bytes) -> bytes:
    """A media file whose frames are the payload, a positive multiple of 192 bytes."""
    n = len(payload) // FRAME
    kind = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso4")
    head = len(kind) + (8 if len(payload) + 8 < 1 << 32 else 16)
    chunks = range(0, n, GROUP)
    uncompressed = (
        box(b"cmpd", struct.pack(">IH", 1, 0))
        + full(b"uncC", 0, 0, struct.pack(">IIHBBBBBBBIIIII", 0, 1, 0, 7, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0))
    )
    entry = box(b"uncv", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 8, -1), uncompressed)
    runs = [(1, min(GROUP, n))] + ([(len(chunks), n % GROUP)] if len(chunks) > 1 and n % GROUP else [])
    table = box(
        b"stbl",
        full(b"stsd", 0, 0, struct.pack(">I", 1), entry),
        full(b"stts", 0, 0, struct.pack(">III", 1, n, 1)),
        full(b"stss", 0, 0, struct.pack(f">I{len(chunks)}I", len(chunks), *(c + 1 for c in chunks))),
        full(b"stsc", 0, 0, struct.pack(">I", len(runs)), *(struct.pack(">III", *r, 1) for r in runs)),
        full(b"stsz", 0, 0, struct.pack(">II", FRAME, n)),
        full(b"co64", 0, 0, struct.pack(f">I{len(chunks)}Q", len(chunks), *(head + c * FRAME for c in chunks))),
    )
    info = box(b"minf", full(b"vmhd", 0, 1, bytes(8)), box(b"dinf", full(b"dref", 0, 0, struct.pack(">I", 1), full(b"url ", 0, 1))), table)
    media = box(b"mdia", full(b"mdhd", 0, 0, struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), full(b"hdlr", 0, 0, bytes(4), b"vide", bytes(13)), info)
    track = box(b"trak", full(b"tkhd", 0, 3, struct.pack(">IIIII8xhhhH", 0, 0, 1, 0, n, 0, 0, 0, 0), _MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16)), media)
    movie = box(b"moov", full(b"mvhd", 0, 0, struct.pack(">IIIIIH10x", 0, 0, RATE, n, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2)), track)
    return b"".join((kind, box(b"mdat", payload), movie))


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple = ()):
    """(path of kinds, body start, body end) of every box, nested ones after those that hold them."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} at {start} runs past its holder")
        yield (*path, kind), body, stop
        if kind in _NESTED:
            yield from walk(data, body, stop, (*path, kind))
        start = stop


def tracks(data: bytes) -> list[dict]:
    """Codec, time scale, duration, sizes and byte ranges of each track's samples, key frames."""
    found: list[dict] = []
    for path, a, _ in walk(data):
        kind = path[-1]
        if kind == b"trak":
            found.append({"times": [], "keys": None})
        if not found or b"trak" not in path:
            continue
        t, body = found[-1], a + 4
        number = lambda at, form=">I": struct.unpack_from(form, data, at)
        if kind == b"mdhd":
            t["scale"], t["duration"] = number(body + 16, ">IQ") if data[a] == 1 else number(body + 8, ">II")
        elif kind == b"hdlr":
            t["handler"] = data[body + 4 : body + 8].decode("latin-1")
        elif kind == b"stsd":
            t["codec"] = data[body + 8 : body + 12].decode("latin-1")
            if t.get("handler") == "vide":
                t["width"], t["height"] = number(body + 4 + 32, ">HH")
        elif kind == b"stts":
            t["times"] = [number(body + 4 + 8 * i, ">II") for i in range(number(body)[0])]
        elif kind == b"stss":
            t["keys"] = list(number(body + 4, f">{number(body)[0]}I"))
        elif kind == b"stsc":
            t["runs"] = [number(body + 4 + 12 * i, ">III") for i in range(number(body)[0])]
        elif kind == b"stsz":
            size, n = number(body, ">II")
            t["sizes"] = [size] * n if size else list(number(body + 8, f">{n}I"))
        elif kind in (b"stco", b"co64"):
            t["chunks"] = list(number(body + 4, f">{number(body)[0]}{'I' if kind == b'stco' else 'Q'}"))
    for t in found:
        runs, chunks, sizes, k, t["at"] = t.get("runs", []), t.get("chunks", []), t.get("sizes", []), 0, []
        for i, (first, per, _) in enumerate(runs):
            last = runs[i + 1][0] if i + 1 < len(runs) else len(chunks) + 1
            for c in range(first - 1, last - 1):
                at = chunks[c]
                for size in sizes[k : k + per]:
                    t["at"].append(at)
                    at += size
                k += per
        keys = range(1, len(sizes) + 1) if t["keys"] is None else t["keys"]
        t["key_ranges"] = [(t["at"][i - 1], sizes[i - 1]) for i in keys]
    return found


def feature(track: dict) -> str:
    """Codec, frame, duration and key frame ranges (offset+length) as one line."""
    return f"{track['codec']} {track.get('width', 0)}x{track.get('height', 0)} {track['duration']}/{track['scale']} key=" + ",".join(f"{a}+{n}" for a, n in track["key_ranges"])


def frames(data: bytes, track: dict) -> bytes:
    """All sample bytes of a track, run by run."""
    out, i, at, sizes = [], 0, track["at"], track["sizes"]
    while i < len(at):
        j, end = i + 1, at[i] + sizes[i]
        while j < len(at) and at[j] == end:
            end += sizes[j]
            j += 1
        out.append(data[at[i] : end])
        i = j
    return b"".join(out)


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a media file."""

    def run(it):
        for ids, column in text_batches(it):
            raw = [t.encode() for t in column.to_pylist()]
            files = [wrap(b.ljust(max(1, -(-len(b) // FRAME)) * FRAME)) for b in raw]
            yield pa.RecordBatch.from_arrays([ids, pa.array(list(map(len, raw)), pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def media_facts(stored: DataFrame) -> DataFrame:
    """The facts of a media column's first tracks, with digests of their frames and of the files."""

    def facts(data: bytes):
        track = tracks(data)[0]
        payload = frames(data, track)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(track), track["codec"], track["duration"] / track["scale"], len(track["key_ranges"])

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64())
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "seconds", "n_key_frames")

    def run(it):
        for batch in it:
            rows = [facts(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True))], ["doc_id", "n_bytes", *names])

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, seconds double, n_key_frames long")


def op4_media(spark, sf_dir):
    return media_facts(settle(media_column(documents(spark, sf_dir))))


QUERIES = {"op4_media": op4_media}
