"""Vectorised text kernels on Arrow string columns: words, word hashes and window hashes.

Texts are read as UTF-8 bytes in chunks of about ``CHUNK`` bytes, so memory follows the chunk
and not the batch; a longer text is a chunk of its own, hashed segment by segment.
Words are ``[^\\x20\\x09-\\x0D]+``. Hashes are 64-bit polynomials over bytes (then over words),
finished with a bit mixer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Workers are reused by later stages: freed batches and large arrays go back to the system instead of staying in pools.
pa.set_memory_pool(pa.system_memory_pool())
if hasattr(ctypes.CDLL(None), "mallopt"):  # glibc: blocks of 2 MB and more are mapped (M_MMAP_THRESHOLD), and unmapped when freed
    ctypes.CDLL(None).mallopt(-3, 2 << 20)

CHUNK = 1 << 20
U = np.uint64
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
_MASK = (1 << 64) - 1
SEP = np.zeros(256, bool)
SEP[9:14] = True
SEP[32] = True
BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
FOLDED = BYTES.copy()
FOLDED[65:91] = FOLDED[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Pow:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            self.up, self.down = _powers(self.base, m), _powers(self.inverse, m)
        return self.up, self.down


_BYTE_POW, _WORD_POW = _Pow(_P), _Pow(_Q)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Chunk:
    """Documents ``lo:hi`` of a batch: bytes, document offsets, word starts and ends, first word of each document."""

    __slots__ = ("lo", "hi", "buf", "offs", "starts", "ends", "first")

    def __init__(self, lo: int, hi: int, buf: np.ndarray, offs: np.ndarray):
        self.lo, self.hi, self.buf, self.offs = lo, hi, buf, offs
        sep = SEP[buf]
        start, end = ~sep, ~sep
        if len(buf):
            word = ~sep
            start[1:] &= sep[:-1]
            end[:-1] &= sep[1:]
            a, b = offs[:-1][offs[:-1] < offs[1:]], offs[1:][offs[:-1] < offs[1:]] - 1
            start[a] |= word[a]
            end[b] |= word[b]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offs)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), self.counts())

    def hashes(self, table: np.ndarray = BYTES) -> np.ndarray:
        return hash_spans(self.buf, self.starts, self.ends, table)

    def total(self, mask: np.ndarray) -> np.ndarray:
        """Sum of a per-byte mask for each document."""
        c = np.concatenate((np.zeros(1, np.int64), np.cumsum(mask, dtype=np.int64)))
        return c[self.offs[1:]] - c[self.offs[:-1]]


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTES) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
        if j == i + 1 and ends[i] - base > CHUNK:
            acc = 0
            for at in range(int(base), int(ends[i]), CHUNK):
                part = table[buf[at : min(at + CHUNK, int(ends[i]))]]
                up, _ = _BYTE_POW.get(CHUNK)
                acc += int((part * up[: len(part)]).sum(dtype=np.uint64)) * pow(_P, at - int(base), 1 << 64)
            out[i] = acc & _MASK
        else:
            span = table[buf[base : ends[j - 1]]]
            up, down = _BYTE_POW.get(len(span) + 1)
            span *= up[: len(span)]
            c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(span, dtype=np.uint64)))
            s = starts[i:j] - base
            out[i:j] = (c[ends[i:j] - base] - c[s]) * down[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * U(0xA24BAED4963EE407))


def window_hashes(h: np.ndarray, w: int) -> np.ndarray:
    """Rolling hash of every ``w`` consecutive words (document borders are the caller's)."""
    n = len(h) - w + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _WORD_POW.get(len(h) + 1)
    c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)))
    return mix((c[w:] - c[:n]) * down[:n] + U((w * 0x9FB21C651E98DF25) & _MASK))


def inside(chunk: Chunk, w: int) -> np.ndarray:
    """Indexes of words that start a window of ``w`` words within their document."""
    n = len(chunk.starts) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    last = np.repeat(chunk.first[1:], chunk.counts())[:n]
    return np.flatnonzero(np.arange(n) + w <= last)


def chunks(col: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """Chunks of a string column; a null text counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if n and col.buffers()[2] is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield Chunk(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column whose cell i holds ``values[bounds[i]:bounds[i+1]]`` as raw little-endian bytes."""
    values = np.ascontiguousarray(values)
    offs = (np.asarray(bounds, np.int64) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offs), pa.py_buffer(values)])


def unpacked(col: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``packed``: all values and the bounds of the cells."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    if not n:
        return np.empty(0, dtype), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    offs = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None else np.empty(0, np.uint8)
    return np.frombuffer(data.tobytes(), dtype), (offs - offs[0]) // np.dtype(dtype).itemsize
