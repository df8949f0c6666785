"""Vectorised word splitting and hashing over Arrow string buffers.

All functions work on the raw UTF-8 bytes of an Arrow batch, so a text is
never turned into Python words. Hashes are deterministic: they depend on the
bytes alone, never on the process or the platform.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Words of more bytes than this are hashed by BLAKE2b, one by one.
LONG_WORD = 64
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 18


def _byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    lut = np.zeros(256, dtype=bool)
    for a, b in ranges:
        lut[a : b + 1] = True
    return lut


#: ``[^\x20\x09-\x0D]+``: every byte but ASCII white space.
NON_SPACE = ~_byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text: digits, a-z and all beyond ASCII.
ALNUM = _byte_class([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: spreads every input bit over the word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=64)
def multipliers(n: int, seed: int = 0) -> np.ndarray:
    """``n`` odd multipliers with nothing in common but the rule that makes them; a longer list starts like a shorter one."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed << 56)) | U64(1)


#: The low k bytes of a 64-bit value.
LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)


def lanes(data: np.ndarray) -> np.ndarray:
    """Element i is the eight bytes from i on, zeros beyond the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: int) -> tuple[np.ndarray, ...]:
    """``hashes`` independent 64-bit hashes of each word.

    A word goes through a chain of non-linear steps, eight bytes each. Words of
    equal length up to eight bytes never collide; longer ones do not collide by
    their structure, as they would under a polynomial modulo 2**64.
    """
    at, length = lanes(data), ends - starts
    first = at[starts] & LOW_BYTES[np.minimum(length, 8)]
    keys = [multipliers(hashes)[k] for k in range(hashes)]
    out = [mix(first ^ (length.astype(U64) + U64(1)) * key) for key in keys]
    live, done = np.flatnonzero((length > 8) & (length <= LONG_WORD)), 8
    while len(live):
        lane = at[starts[live] + done] & LOW_BYTES[np.minimum(length[live] - done, 8)]
        for h, key in zip(out, keys, strict=True):
            h[live] = mix((h[live] * U64(5) + key) ^ lane)
        done += 8
        live = live[length[live] > done]
    for k in np.flatnonzero(length > LONG_WORD).tolist():
        raw = hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=16).digest()
        for s, h in enumerate(out):
            h[k] = int.from_bytes(raw[8 * s : 8 * s + 8], "little")
    return tuple(out)


class Words(NamedTuple):
    """The words of some texts, in order. ``first[i]:first[i+1]`` are those of text i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: tuple[np.ndarray, ...]

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the n+1 offsets into them; null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    if offs is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offs, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) of runs of whole texts with about ``size`` bytes each."""
    data, offsets = buffers(texts)
    lo, n = 0, len(texts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def split(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray = NON_SPACE, lower: bool = False, hashes: int = 1) -> Words:
    """Maximal runs of bytes in ``lut`` within each text, with up to two 64-bit hashes each."""
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = lut[data]
    before = np.empty(n + 1, dtype=bool)
    before[0] = False
    before[1:] = inside
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.empty(n + 1, dtype=bool)
    after[:-1] = inside
    after[-1] = False
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    first = np.searchsorted(starts, offsets)
    return Words(data, starts, ends, first, word_hashes(data, starts, ends, hashes))


def grams(values: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of each ``size`` consecutive values (n - size + 1 of them, over text borders too).

    Every place has a multiplier of its own, so no arrangement of equal words cancels out.
    """
    n = len(values)
    if n < size:
        return np.zeros(0, dtype=U64)
    out = np.zeros(n - size + 1, dtype=U64)
    for i, by in enumerate(multipliers(size, seed + 1)):
        out += values[i : n - size + 1 + i] * by
    return mix(out)


def gram_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Word indices at which a gram of ``size`` words lies within one text."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    skip = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(total) + skip


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost minimum of each ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, at, span = values.copy(), np.arange(len(values)), 1

    def merge(shift: int) -> None:
        nonlocal best, at
        right, right_at = best[shift:], at[shift:]
        left, left_at = best[: len(right)], at[: len(right)]
        take = right < left
        best, at = np.where(take, right, left), np.where(take, right_at, left_at)

    while span * 2 <= width:
        merge(span)
        span *= 2
    if span < width:
        merge(width - span)
    return at[:n]
