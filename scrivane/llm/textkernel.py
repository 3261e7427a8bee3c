"""Vectorised passes over Arrow string buffers: words, code points, and hashes of words, lines and word windows.

A word is a run of bytes outside 0x20 and 0x09-0x0D. These are ASCII, so splitting UTF-8 bytes splits code points alike.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SEGMENT = 1 << 17
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(0x5C21))
_TABLES = _rng.integers(0, 1 << 63, size=(4, 256), dtype=np.uint64) * _U(2) + _U(1)
_MULT = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
    # Arrays of 4 MB and more are mapped, so that they go back to the system as soon as they are freed; by default that bound grows.
    _LIBC.mallopt(-3, 4 << 20)
except (OSError, AttributeError):  # another C library
    _LIBC = None
#: Arrow's own pools keep what they free; the system's gives it back in the same way.
pa.set_memory_pool(pa.system_memory_pool())
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _count_type(n: int) -> type:
    return np.int32 if n < 1 << 31 else np.int64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = 1 << (n - 1).bit_length()

            def powers(b: int) -> np.ndarray:
                out = np.full(m, b, np.uint64)
                out[0] = 1
                return np.multiply.accumulate(out)

            self.up, self.down = powers(self.base), powers(self.inverse)
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(m) for m in _MULT]


def powers(n: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    return _POWERS[seed].get(n)


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of values[s:e] for each range, by prefix sums of value * base**i modulo 2**64. uint8 values go through a random table.

    starts and ends don't decrease. The sums run over SEGMENT values at a time, which stay in the processor's cache.
    """
    out = np.empty(len(starts), np.uint64)
    at, n = 0, len(starts)
    while at < n:
        lo = int(starts[at])
        # The bound has the array's type: another would convert the whole array.
        to = max(at + 1, int(np.searchsorted(ends, ends.dtype.type(min(lo + SEGMENT, np.iinfo(ends.dtype).max)), "right")))
        hi = int(ends[to - 1])
        up, down = _POWERS[seed].get(hi - lo + 1)
        v = values[lo:hi]
        v = _TABLES[seed][v] if values.dtype == np.uint8 else v
        total = np.empty(hi - lo + 1, np.uint64)
        total[0] = 0
        np.cumsum(v * up[: hi - lo], out=total[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


class Texts:
    """Some texts in one buffer. data: bytes; offsets: n + 1 byte offsets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.n = len(offsets) - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text have the flag."""
        if 128 * self.n < len(flags):
            o = self.offsets.tolist()
            return np.array([np.count_nonzero(flags[a:b]) for a, b in zip(o[:-1], o[1:], strict=True)], np.int64)
        c = np.zeros(len(flags) + 1, _count_type(len(flags)))
        np.cumsum(flags, out=c[1:])
        return (c[self.offsets[1:]] - c[self.offsets[:-1]]).astype(np.int64)

    def words(self) -> Words:
        d, o = self.data, self.offsets
        w = IS_WORD[d]
        first = w.copy()
        last = w.copy()
        if len(d):
            begin = np.zeros(len(d) + 1, bool)
            begin[o] = True
            first[1:] &= ~w[:-1] | begin[1:-1]
            last[:-1] &= ~w[1:] | begin[1:-1]
        starts = np.flatnonzero(first)
        ends = np.flatnonzero(last) + 1
        return Words(self, starts, ends, np.searchsorted(starts, o))


class Words:
    """starts, ends: byte offsets of words; bounds: n + 1 word indices at which texts begin and end."""

    def __init__(self, texts: Texts, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray):
        self.texts, self.starts, self.ends, self.bounds = texts, starts, ends, bounds
        self.counts = np.diff(bounds)
        self._hashes: dict[tuple[int, bool], np.ndarray] = {}

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts.n), self.counts)

    def hashes(self, seed: int = 0, lower: bool = False, keep: bool = False) -> np.ndarray:
        """keep: hold them for later calls."""
        if (seed, lower) in self._hashes:
            return self._hashes[seed, lower]
        h = range_hash(LOWER[self.texts.data] if lower else self.texts.data, self.starts, self.ends, seed)
        if keep:
            self._hashes[seed, lower] = h
        return h

    def join(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kept words of each text joined by one space: bytes and n + 1 offsets."""
        d = self.texts.data.copy()
        out = IS_WORD[d]
        gone = ~keep
        if gone.any():
            out &= ~cover(len(d), self.starts[gone], self.ends[gone] - self.starts[gone])
        k = np.flatnonzero(keep)
        text = self.text_of()[k]
        gap = self.ends[k[:-1][text[1:] == text[:-1]]]
        d[gap], out[gap] = 32, True
        offsets = np.zeros(self.texts.n + 1, np.int64)
        np.cumsum(self.texts.per_text(out), out=offsets[1:])
        return d[out], offsets

    def windows(self, width: int) -> np.ndarray:
        """Indices of the words at which a window of `width` words of one text begins."""
        n = self.bounds[-1]
        ok = np.zeros(n + 1, np.int32)
        has = self.counts >= width
        np.add.at(ok, self.bounds[:-1][has], 1)
        np.add.at(ok, self.bounds[1:][has] - width + 1, -1)
        return np.flatnonzero(np.cumsum(ok[:n]) > 0)


def window_hash(word_hashes: np.ndarray, at: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    return range_hash(word_hashes, at, at + width, seed)


def cover(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which of n items lie in any of the ranges."""
    c = np.zeros(n + 1, _count_type(n))
    np.add.at(c, starts, 1)
    np.add.at(c, starts + lengths, -1)
    np.cumsum(c, out=c)
    return c[:n] > 0


def texts_of(column: pa.Array) -> Texts:
    """Nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return Texts(np.frombuffer(data, np.uint8, hi - lo, lo) if hi > lo else np.zeros(0, np.uint8), offsets - lo)


def release() -> None:
    """Give freed memory back to the system: workers are reused, and several share a machine."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The batch in runs of rows of about `limit` bytes of text; a longer text is a run of its own and stays whole."""
    whole = texts_of(batch.column(batch.schema.get_field_index(text)))
    at, o = 0, whole.offsets
    while at < whole.n:
        to = max(at + 1, int(np.searchsorted(o, o[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), Texts(whole.data[o[at] : o[to]], o[at : to + 1] - o[at])
        at = to
    release()


def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of keys, equal for equal keys."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.empty(len(s), np.int64)
    if len(s):
        new[0] = 0
        np.cumsum(s[1:] != s[:-1], out=new[1:])
    rank = np.empty(len(s), np.int64)
    rank[order] = new
    return rank


def classes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first index of each class of equal hashes, and every row's class. Hashes that agree in all bits but as many as a row's number takes
    may have several classes of one hash; no class has two hashes."""
    low = _U((1 << max(1, len(h).bit_length())) - 1)
    key = h & ~low
    key |= np.arange(len(h), dtype=np.uint64)
    key.sort()  # several times as fast as sorting an index
    order = (key & low).astype(np.int64)
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    of = np.empty(len(s), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def in_text(keys: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """Keys that sort by text first: the text's number takes the high bits, the hash the rest."""
    bits = max(1, int(n_texts - 1).bit_length()) if n_texts else 1
    return (text.astype(np.uint64) << _U(64 - bits)) | (keys >> _U(bits))
