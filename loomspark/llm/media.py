"""Media columns: ISO media containers, written and read through their boxes.

A container is a tree of boxes (size, four-letter type, payload). The tables
below `stbl` say where the samples are, how long they last and which of them
are key frames, so a reader never decodes the payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_bytes

#: A stored sample is a frame of so many 8-bit values; every KEY-th frame is a key frame.
FRAME, KEY, TIMESCALE, PER_CHUNK = 64, 16, 8000, 256
#: Boxes that hold boxes.
PARENTS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"moof", b"traf")

PROBE = T.StructType([
    T.StructField("codec", T.StringType()),
    T.StructField("timescale", T.LongType()),
    T.StructField("duration", T.LongType()),
    T.StructField("samples", T.LongType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("key_frames", T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]))),
    T.StructField("error", T.StringType()),
])


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, flags: int = 0, version: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of FRAME."""
    return data + bytes(max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data))


def store(payload: bytes) -> bytes:
    """An ISO container with one track of raw 8-bit samples, FRAME to a frame."""
    frames = len(payload) // FRAME
    chunks = -(-frames // PER_CHUNK)
    unity = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    length = frames * FRAME
    big = length >= 1 << 32
    time = struct.pack(">QQIQ", 0, 0, TIMESCALE, length) if big else struct.pack(">IIII", 0, 0, TIMESCALE, length)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    runs = [(1, PER_CHUNK, 1)] if frames % PER_CHUNK == 0 or chunks == 1 else [(1, PER_CHUNK, 1), (chunks, frames % PER_CHUNK, 1)]
    if chunks == 1:
        runs = [(1, frames, 1)]
    keys = np.arange(1, frames + 1, KEY, dtype=">u4")

    def moov(first: int) -> bytes:
        at = first + np.arange(chunks, dtype=np.int64) * (PER_CHUNK * FRAME)
        wide = bool(len(at) and at[-1] >= 1 << 32)
        offsets = full(b"co64" if wide else b"stco", struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes())
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, frames, FRAME)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", FRAME, frames)),
            offsets,
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"smhd", bytes(4)), dinf, stbl)
        mdia = box(b"mdia", full(b"mdhd", time, struct.pack(">HH", 0x55C4, 0), version=int(big)), full(b"hdlr", bytes(4), b"soun", bytes(12), b"frames\0"), minf)
        head = struct.pack(">QQIIQ", 0, 0, 1, 0, length) if big else struct.pack(">IIIII", 0, 0, 1, 0, length)
        trak = box(b"trak", full(b"tkhd", head, bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), unity, bytes(8), flags=7, version=int(big)), mdia)
        return box(b"moov", full(b"mvhd", time, struct.pack(">IH", 0x10000, 0x100), bytes(10), unity, bytes(24), struct.pack(">I", 2), version=int(big)), trak)

    lead = 8 if len(payload) + 8 < 1 << 32 else 16
    head = moov(len(ftyp) + len(moov(0)) + lead)
    return ftyp + head + box(b"mdat", payload)


def walk(data: bytes, at: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()):
    """(path, start, end) of every box's payload, depth first, without copying."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        start = at + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, start)
            start += 8
        elif size == 0:
            size = end - at
        if size < start - at or at + size > end:
            raise ValueError(f"box {kind!r} at {at} does not fit")
        yield (*path, kind), start, at + size
        if kind in PARENTS:
            yield from walk(data, start, at + size, (*path, kind))
        at += size
    if at != end:
        raise ValueError(f"{end - at} bytes left over")


def sample_table(data: bytes) -> dict:
    """Codec, times and the byte range of every sample of the first track; the duration is the sum of the samples' where they tell it."""
    got: dict[bytes, tuple[int, int]] = {}
    tracks = 0
    for path, start, end in walk(data):
        tracks += path[-1] == b"trak"
        if tracks <= 1:
            got.setdefault(path[-1], (start, end))

    def table(kind: bytes, dtype: str, skip: int, width: int = 1) -> np.ndarray:
        start, end = got[kind]
        (count,) = struct.unpack_from(">I", data, start + skip - 4)
        if start + skip + count * width * int(dtype[-1]) > end:
            raise ValueError(f"{kind!r} is longer than its box")
        return np.frombuffer(data, dtype, count * width, start + skip).astype(np.int64).reshape(-1, width)

    start, _ = got[b"mdhd"]
    timescale, duration = struct.unpack_from(">IQ", data, start + 20) if data[start] else struct.unpack_from(">II", data, start + 12)
    codec = data[got[b"stsd"][0] + 12 : got[b"stsd"][0] + 16].decode("latin-1")
    size, count = struct.unpack_from(">II", data, got[b"stsz"][0] + 4)
    sizes = np.full(count, size, np.int64) if size else table(b"stsz", ">u4", 12)[:, 0]
    chunk_at = (table(b"co64", ">u8", 8) if b"co64" in got else table(b"stco", ">u4", 8))[:, 0]
    runs = table(b"stsc", ">u4", 8, 3)
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunk_at) + 1))) if len(runs) else np.zeros(0, np.int64)
    if per.sum() != count:
        raise ValueError("sample tables disagree")
    chunk = np.repeat(np.arange(len(per)), per)
    before = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    first = np.concatenate([[0], np.cumsum(per)])[:-1]
    offsets = chunk_at[chunk] + before - before[np.minimum(first, max(count - 1, 0))][chunk] if count else np.zeros(0, np.int64)
    if count and ((offsets < 0) | (offsets + sizes > len(data))).any():
        raise ValueError("samples outside the file")
    keys = table(b"stss", ">u4", 8)[:, 0] - 1 if b"stss" in got else np.arange(count)
    if len(keys) and not 0 <= keys.min() <= keys.max() < count:
        raise ValueError("key frames beyond the samples")
    if b"stts" in got:  # how long each sample lasts, by runs; the samples' sum is what the track lasts
        times = table(b"stts", ">u4", 8, 2)
        if times[:, 0].sum() != count:
            raise ValueError("sample tables disagree")
        duration = int((times[:, 0] * times[:, 1]).sum())
    return {"codec": codec, "timescale": timescale, "duration": duration, "offsets": offsets, "sizes": sizes, "keys": keys}


def payload_of(data: bytes, found: dict) -> bytes:
    """The samples' bytes in order; neighbours in the file are read as one range."""
    o, s = found["offsets"], found["sizes"]
    if not len(o):
        return b""
    cut = np.flatnonzero(o[1:] != o[:-1] + s[:-1]) + 1
    starts, ends = o[np.append(0, cut)], (o + s)[np.append(cut - 1, len(o) - 1)]
    return b"".join(data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))


def probe(media: DataFrame, col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns `keep` plus codec, timescale, duration, samples, payload_bytes and
    the key frames' byte ranges of every container in `col`.

    Null or broken containers give nulls and say why in `error`.
    """

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for value in batch.column(batch.num_columns - 1):
                data = value.as_py()
                try:
                    if data is None:
                        raise ValueError("no media")
                    x = sample_table(data)
                    ranges = [{"offset": int(x["offsets"][k]), "length": int(x["sizes"][k])} for k in x["keys"]]
                    rows.append({"codec": x["codec"], "timescale": x["timescale"], "duration": x["duration"], "samples": len(x["sizes"]), "payload_bytes": int(x["sizes"].sum()), "key_frames": ranges, "error": None})
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    rows.append(dict.fromkeys(PROBE.names) | {"error": f"{type(e).__name__}: {e}"})
            cols = {f.name: pa.array([r[f.name] for r in rows], batch_type(f)) for f in PROBE}
            yield pa.RecordBatch.from_pydict({n: batch.column(i) for i, n in enumerate(batch.schema.names[:-1])} | cols)

    def batch_type(field):
        from pyspark.sql.pandas.types import to_arrow_type

        return to_arrow_type(field.dataType)

    rows = media.select(*keep, col)
    return rows.mapInArrow(read, T.StructType([*rows.schema.fields[:-1], *PROBE.fields]))


STORED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def round_trip(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Stores every text as a container and describes what reading it back gives.

    The payload is the text's UTF-8 bytes (null: empty) with zero bytes up to
    a positive multiple of 64, so an empty text is one zero frame. The
    `feature` names codec, timescale, duration, frames, and the number and a
    digest of the key frames' byte ranges. One document is in memory at a time.
    Repeated rows and null ids each give a row, an empty table none; columns other than doc_id and text are not read.
    with_media adds the container itself.
    """

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            ids, out, held = [], [], 0
            for i, value in enumerate(batch.column(1)):
                text = value.as_py()
                media = store(padded(text))
                found = sample_table(media)
                back = payload_of(media, found)
                keys = found["keys"]
                ranges = np.stack([found["offsets"][keys], found["sizes"][keys]], 1).astype("<i8")
                feature = f"codec={found['codec'].strip()};timescale={found['timescale']};duration={found['duration']};frames={len(found['sizes'])};key_frames={len(keys)};key_ranges={hashlib.sha256(ranges.tobytes()).hexdigest()}"
                ids.append(i)
                out.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, media))
                held += len(media)
                if with_media and held > 1 << 24:
                    yield rows(pa, batch, ids, out)
                    ids, out, held = [], [], 0
            if out:
                yield rows(pa, batch, ids, out)

    def rows(pa, batch, ids, out):
        cols = list(zip(*out, strict=True))
        names = [f.split()[0] for f in STORED.split(", ")] + ["media"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        made = {n: pa.array(c, t) for n, c, t in list(zip(names, cols, types, strict=True))[: 7 + with_media]}
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0).take(pa.array(ids))} | made)

    source = docs.select("doc_id", text_bytes().alias("text"))
    return source.mapInArrow(work, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {STORED}" + ", media binary" * with_media)
