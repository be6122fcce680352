"""Whole batches of texts as flat numpy byte arrays: words and their 64-bit hashes without a Python loop over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is one chunk of its own.
CHUNK_BYTES = 1 << 20
#: Spans of more bytes than this are hashed one by one.
LONG_SPAN = 512

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LANE_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, extended on demand."""

    def __init__(self, base: int = int(_BASE)) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_powers = Powers()


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES, rows: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets) of runs of at most ``rows`` rows and ``limit`` bytes, or of one longer row.

    Null texts count as empty.
    """
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        last = min(last, first + rows) if rows else last
        yield first, last, flat[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes other than space and 0x09-0x0D; runs end at the ends of rows."""
    inside = ~_SPACE[data]
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[edges] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets[:-1], starts, "right") - 1


def fold_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes unchanged."""
    return _FOLD[data]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, equal for equal bytes wherever they stand.

    Eight bytes at a time are mixed in by a bijection, so no two spans of up to eight bytes and one length collide, and longer
    ones only by chance, whatever their structure. Spans of more than LONG_SPAN bytes get BLAKE2b, one by one.
    """
    size = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lane = np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))
    out = mix64((size.astype(np.uint64) + np.uint64(1)) * _BASE)
    live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    at, left = starts[live], size[live]
    while len(live):
        out[live] = mix64(out[live] ^ (lane[at] & _LANE_MASK[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` consecutive values, by doubling; runs may cross rows and are for the caller to mask.

    Equal runs have equal hashes. Every step mixes, so that different runs collide only by chance.
    """
    if len(values) < k:
        return np.zeros(0, np.uint64)
    out, width = values, 1
    while width < k:
        step = min(width, k - width)
        out = mix64(out[:-step] ^ (out[step:] * _BASE + np.uint64(width)))
        width += step
    return out


def rolling_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """A cheap rolling hash of each run of ``k`` consecutive values, for choosing and filtering only: long regular runs can collide."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers.upto(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix64((total[k:] - total[:-k]) * down[:n])


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` consecutive values, by doubling."""
    out, width = values, 1
    while width < w:
        step = min(width, w - width)
        out = np.minimum(out[:-step], out[step:])
        width += step
    return out
