"""Media columns: ISO base media containers are walked box by box; sample tables give codec, duration and
keyframe byte ranges without decoding a payload.

``parse`` takes any ISO BMFF bytes, fragmented files included: samples of movie fragments follow those of the tables. ``wrap`` stores raw bytes losslessly as the 8-bit samples of one track
(192-byte samples, every 16th a sync sample). Null and empty texts give one sample of spaces; repeated rows
give equal values; damaged containers give ``error`` and null fields, never a crash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import bounded, whole_id

SAMPLE, SYNC_EVERY, TIMESCALE = 192, 16, 8000
_PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes) -> bytes:
    """Spaces up to a positive multiple of a sample."""
    return data + b" " * (-len(data) % SAMPLE or (0 if data else SAMPLE))


def wrap(payload: bytes) -> bytes:
    """A file with one audio track ``raw `` (unsigned 8-bit, mono) whose samples are ``payload`` in order."""
    n = len(payload) // SAMPLE
    ticks = n * SAMPLE
    unity = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    long = ticks >= 1 << 32
    when = struct.pack(">QQIQ", 0, 0, TIMESCALE, ticks) if long else struct.pack(">IIII", 0, 0, TIMESCALE, ticks)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    sync = range(1, n + 1, SYNC_EVERY)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")

    def moov(at: int) -> bytes:
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
            _full(b"stss", struct.pack(f">I{len(sync)}I", len(sync), *sync)),
            _full(b"stsc", struct.pack(">IIII", 1, 1, SYNC_EVERY, 1)),
            _full(b"stsz", struct.pack(">II", SAMPLE, n)),
            _full(b"co64", struct.pack(f">I{len(sync)}Q", len(sync), *(at + (k - 1) * SAMPLE for k in sync))),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
        hdlr = _full(b"hdlr", bytes(4), b"soun", bytes(12), b"text\0")
        mdia = _box(b"mdia", _full(b"mdhd", when, struct.pack(">HH", 0x55C4, 0), version=int(long)), hdlr, minf)
        span = struct.pack(">QQIIQ", 0, 0, 1, 0, ticks) if long else struct.pack(">IIIII", 0, 0, 1, 0, ticks)
        tkhd = _full(b"tkhd", span, bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), unity, bytes(8), version=int(long), flags=3)
        mvhd = _full(b"mvhd", when, struct.pack(">IH", 0x10000, 0x100), bytes(10), unity, bytes(24), struct.pack(">I", 2), version=int(long))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    return ftyp + moov(len(ftyp) + len(moov(0)) + head) + _box(b"mdat", payload)


def boxes(data: memoryview, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, body start, body end) of the boxes between two offsets."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise ValueError("box header cut off")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} exceeds its parent")
        yield kind, at + head, at + size
        at += size
    if at != end:
        raise ValueError("bytes after the last box")


def tracks(data: memoryview) -> list[dict[bytes, tuple[int, int]]]:
    """For each track, the places of its leaf boxes; explicit stack, so depth costs no recursion."""
    found: list[dict] = []
    stack = [(0, len(data), None)]
    while stack:
        at, end, track = stack.pop()
        for kind, a, b in boxes(data, at, end):
            if kind == b"trak":
                found.append(own := {})
                stack.append((a, b, own))
            elif kind in _PARENTS:
                stack.append((a, b, track))
            elif track is not None:
                track[kind] = (a, b)
    return found


def parse_track(data: memoryview, leaf: dict[bytes, tuple[int, int]]) -> dict:
    """Codec, duration, sample places and keyframe byte ranges of one track, from its tables alone."""

    def table(kind: bytes, skip: int, width: str) -> list[tuple]:
        if kind not in leaf:
            return []
        a, b = leaf[kind]
        n = struct.unpack_from(">I", data, a + skip - 4)[0]
        size = struct.calcsize(">" + width)
        if a + skip + n * size > b:
            raise ValueError(f"table {kind!r} cut off")
        return list(struct.iter_unpack(">" + width, data[a + skip : a + skip + n * size]))

    a, _ = leaf[b"mdhd"]
    scale, ticks = struct.unpack_from(">IQ", data, a + 20) if data[a] else struct.unpack_from(">II", data, a + 12)
    codec = bytes(data[leaf[b"stsd"][0] + 12 : leaf[b"stsd"][0] + 16]).decode("latin-1")
    a, _ = leaf[b"stsz"]
    fixed, n = struct.unpack_from(">II", data, a + 4)
    if fixed * n > len(data):
        raise ValueError("more samples than the file has bytes")
    sizes = [fixed] * n if fixed else [x for (x,) in table(b"stsz", 12, "I")]
    offsets = [x for (x,) in (table(b"co64", 8, "Q") or table(b"stco", 8, "I"))]
    runs, places, i = table(b"stsc", 8, "III"), [], 0
    for k, (first, per, _) in enumerate(runs):
        stop = runs[k + 1][0] - 1 if k + 1 < len(runs) else len(offsets)
        for chunk in range(first - 1, stop):
            at = offsets[chunk]
            for _ in range(per):
                if i == n:
                    break
                places.append((at, at + sizes[i]))
                at += sizes[i]
                i += 1
    if i != n or any(b > len(data) for _, b in places):
        raise ValueError("samples outside the file")
    sync = [x for (x,) in table(b"stss", 8, "I")] if b"stss" in leaf else range(1, n + 1)
    if any(not 1 <= k <= n for k in sync):
        raise ValueError("a sync sample outside the table")
    a = leaf[b"tkhd"][0] if b"tkhd" in leaf else None
    number = 0 if a is None else struct.unpack_from(">I", data, a + (20 if data[a] else 12))[0]
    return {"codec": codec, "timescale": scale, "ticks": ticks, "places": places, "keyframes": [places[k - 1] for k in sync], "number": number, "table_ticks": sum(c * d for c, d in table(b"stts", 8, "II"))}


def _defaults(data: memoryview) -> dict[int, tuple[int, int, int]]:
    """Track number -> default duration, size and flags of samples in fragments."""
    out = {}
    for kind, a, b in boxes(data, 0, len(data)):
        for kind2, a2, b2 in boxes(data, a, b) if kind == b"moov" else ():
            for kind3, a3, _ in boxes(data, a2, b2) if kind2 == b"mvex" else ():
                if kind3 == b"trex":
                    number, _, *rest = struct.unpack_from(">5I", data, a3 + 4)
                    out[number] = tuple(rest)
    return out


def _words_if(data: memoryview, at: int, flags: int, bits: list[tuple[int, str]]) -> tuple[dict[int, int], int]:
    """The optional fields of a box that its flags announce, and where they end."""
    found = {}
    for bit, width in bits:
        if flags & bit:
            found[bit] = struct.unpack_from(">" + width, data, at)[0]
            at += struct.calcsize(">" + width)
    return found, at


def _run(data: memoryview, a: int, b: int, base: int, at: int, own: tuple[int, int, int]):
    """(place, duration, flags) of each sample of a ``trun`` box."""
    flags = struct.unpack_from(">I", data, a)[0] & 0xFFFFFF
    n = struct.unpack_from(">I", data, a + 4)[0]
    head, pos = _words_if(data, a + 8, flags, [(0x1, "i"), (0x4, "I")])
    fields = [(bit, "I") for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
    if pos + 4 * len(fields) * n > b or (not flags & 0x200 and own[1] * n > len(data)) or (not fields and not own[1] and n > len(data)):
        raise ValueError("a fragment's samples don't fit")
    at = base + head[0x1] if 0x1 in head else at
    for i in range(n):
        x, pos = _words_if(data, pos, flags, fields)
        size = x.get(0x200, own[1])
        what = x.get(0x400, head[0x4] if i == 0 and 0x4 in head else own[2])
        yield (at, at + size), x.get(0x100, own[0]), what
        at += size


def fragments(data: memoryview, found: list[dict]) -> None:
    """Adds the samples of all movie fragments to their tracks."""
    defaults, by = _defaults(data), {t["number"]: t for t in found}
    for kind, a, b in boxes(data, 0, len(data)):
        if kind != b"moof":
            continue
        start, at = a - (16 if bytes(data[a - 12 : a - 8]) == b"moof" else 8), 0  # a long header has its size behind the type
        for kind2, a2, b2 in boxes(data, a, b):
            if kind2 != b"traf":
                continue
            track, base, own = None, start, (0, 0, 0)
            for kind3, a3, b3 in boxes(data, a2, b2):
                if kind3 == b"tfhd":
                    flags, number = struct.unpack_from(">II", data, a3)
                    x, _ = _words_if(data, a3 + 8, flags, [(0x1, "Q"), (0x2, "I"), (0x8, "I"), (0x10, "I"), (0x20, "I")])
                    track, old = by.get(number), defaults.get(number, (0, 0, 0))
                    base, own = x.get(0x1, start), (x.get(0x8, old[0]), x.get(0x10, old[1]), x.get(0x20, old[2]))
                    at = base
                elif kind3 == b"trun" and track is not None:
                    for place, ticks, what in _run(data, a3, b3, base, at, own):
                        if place[0] < 0 or place[1] > len(data):
                            raise ValueError("samples outside the file")
                        track["places"].append(place)
                        track["fragment_ticks"] = track.get("fragment_ticks", 0) + ticks
                        if not what & 0x10000:
                            track["keyframes"].append(place)
                        at = place[1]
    for t in found:
        extra, stored = t.pop("fragment_ticks", 0), t.pop("table_ticks")
        if extra:
            t["ticks"] = max(0 if t["ticks"] in ((1 << 32) - 1, (1 << 64) - 1) else t["ticks"], stored + extra)


def parse(data: bytes) -> list[dict]:
    view = memoryview(data)
    found = [parse_track(view, leaf) for leaf in tracks(view)]
    fragments(view, found)
    return found


def payload(data: bytes, track: dict) -> bytes:
    """The stored bytes of a track, read back through its sample table (neighbouring samples as one slice)."""
    out, start, end = [], None, None
    for a, b in track["places"]:
        if a == end:
            end = b
        else:
            if start is not None:
                out.append(data[start:end])
            start, end = a, b
    out.append(data[start:end] if start is not None else b"")
    return b"".join(out)


def feature(track: dict) -> str:
    keys = ",".join(f"{a}-{b}" for a, b in track["keyframes"])
    seconds = track["ticks"] / track["timescale"] if track["timescale"] else 0.0
    return f"codec={track['codec'].strip()};duration={seconds:.6f};samples={len(track['places'])};keyframes={keys}"


_TRACK = [("codec", pa.string()), ("duration", pa.float64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
_INFO = pa.struct([("tracks", pa.list_(pa.struct(_TRACK))), ("error", pa.string())])


def _info(data: bytes | None) -> dict | None:
    if data is None:
        return None
    try:
        found = parse(data)
    except (ValueError, KeyError, IndexError, OverflowError, struct.error) as e:
        return {"tracks": None, "error": f"{type(e).__name__}: {e}"[:200]}
    rows = [{"codec": t["codec"], "duration": t["ticks"] / t["timescale"] if t["timescale"] else 0.0, "n_samples": len(t["places"]), "keyframes": [{"start": a, "end": b} for a, b in t["keyframes"]]} for t in found]
    return {"tracks": rows or None, "error": None if rows else "no track"}


def probe(df: DataFrame, column: str) -> DataFrame:
    """Adds struct ``media_info``: ``tracks`` (codec, duration, n_samples, keyframes of each track of a binary column) and ``error``.

    A null cell gives a null struct; a damaged or trackless file gives ``error`` and no tracks. ``media_info`` of the input is replaced.
    """
    df = df.drop("media_info")
    names, at = df.columns, df.columns.index(column)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_info(x.as_py()) for x in b.column(at)], _INFO)], [*names, "media_info"])

    kind = "struct<tracks:array<struct<codec:string,duration:double,n_samples:bigint,keyframes:array<struct<start:bigint,end:bigint>>>>,error:string>"
    return bounded(df).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("media_info", T._parse_datatype_string(kind))]))


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: its text stored as media, read back, and the digests of both forms."""

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                media = wrap(pad(raw))
                track = parse(media)[0]
                back = payload(media, track)
                out.append((doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(track)))
            cols = list(zip(*out)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [x.split()[0] for x in DIGEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return bounded(docs).select(whole_id(), F.col("text").cast("string")).mapInArrow(run, DIGEST)


def op10_media_columns(spark, sf_dir):
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
