"""Words and hashes of many texts at once, as numpy arrays over one Arrow buffer.

Texts come in as an Arrow string column and are looked at as UTF-8 bytes, a few megabytes at a
time, so what a task holds doesn't depend on how many rows there are. A text longer than that
is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal in, equal out, and every bit depends on every bit."""
    x = x.astype(U64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U64(shift)
        x *= U64(factor)
    return x ^ (x >> U64(31))


@cache
def byte_values() -> np.ndarray:
    """A random-looking odd 64-bit number for each byte."""
    return mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


_powers: dict[str, np.ndarray] = {}
BASE = 0xD1342543DE82EF95


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE ** 0, 1, ... n - 1 modulo 2 ** 64, or of its inverse; kept for later calls up to the size of a slice."""
    base = pow(BASE, -1, 1 << 64) if inverse else BASE
    name = "inverse" if inverse else "plain"
    if len(_powers.get(name, ())) < n:
        size = max(n, SLICE_BYTES + 1)
        full = np.full(size, U64(base), dtype=U64)
        full[0] = U64(1)
        full = np.multiply.accumulate(full)
        if size > 4 * SLICE_BYTES:
            return full
        _powers[name] = full
    return _powers[name][:n]


@dataclass
class Texts:
    """Some rows' texts: ``data`` are their bytes, text i is data[offsets[i]:offsets[i + 1]]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Runs of consecutive texts of a string column of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        own = offsets[start : stop + 1]
        yield Texts(start, raw[own[0] : own[-1]], own - own[0])
        start = stop


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the longest runs of true that stay within one text."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    opens[edges] |= inside[edges]
    closes[edges - 1] |= inside[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal bytes have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, U64)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(byte_values()[data] * powers(len(data)), out=total[1:])
    out = (total[ends] - total[starts]) * powers(len(data) + 1, inverse=True)[starts]
    return mix(out + (ends - starts).astype(U64))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive word hashes; shorter than ``words`` by size - 1."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, U64)
    for k in range(size):
        out = out * U64(0x9FB21C651E98DF25) + words[k : k + n]
    return mix(out)


def counts_per_text(numbers: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(numbers, minlength=n).astype(np.int64)


@cache
def byte_class(pattern: str) -> np.ndarray:
    """bool for each byte: ``space`` separates words, ``word13`` belongs to a decontamination word."""
    out = np.zeros(256, bool)
    if pattern == "space":
        out[[0x20, *range(0x09, 0x0E)]] = True
    elif pattern == "word13":
        out[0x30:0x3A] = out[0x41:0x5B] = out[0x61:0x7B] = True
        out[0x80:] = True
    elif pattern == "symbol":
        out[list(b"#*$%&|<>")] = True
    return out
