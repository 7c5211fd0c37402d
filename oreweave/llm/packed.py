"""Words, hashes and n-grams of many texts at once, in numpy on Arrow's UTF-8 bytes.

All hashes are polynomials modulo 2**64 with an odd base, taken from running sums, then finished by a
bit mixer; equal content has equal hashes wherever it stands.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = (1 << 64) - 1
#: Bytes of text worked on at a time.
SLICE = 2_000_000
#: The same where little is kept of it: arrays over bytes and their words take some 50 times as much.
PART = SLICE // 4


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix((np.arange(256, dtype=np.uint64) + U(1)) * U(0x9E3779B97F4A7C15))


class Powers:
    """Powers of an odd base and of its inverse, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.full(n, b, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))


P1, P2 = Powers(0x9FB21C651E98DF25), Powers(0xD6E8FEB86659FD93)


class Rolling:
    """Hashes of any runs of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, powers: Powers = P1):
        powers.to(len(values) + 1)
        self.powers = powers
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers.up[: len(values)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.powers.down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * U(0x9E3779B97F4A7C15))


class Packed:
    """Some texts end to end. ``starts``, ``ends``: byte bounds of each word; ``doc``: its text; ``first``: word bounds of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets = _LOWER[data] if lower else data, offsets
        n = len(offsets) - 1
        space = _SPACE[self.data]
        opens, closes = np.ones(len(data), bool), np.ones(len(data), bool)
        opens[1:], closes[:-1] = space[:-1], space[1:]
        opens[offsets[:-1][offsets[:-1] < len(data)]] = True
        closes[offsets[1:][offsets[1:] > 0] - 1] = True
        self.starts, self.ends = np.flatnonzero(~space & opens), np.flatnonzero(~space & closes) + 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.n_words = np.bincount(self.doc, minlength=n)
        self.first = np.concatenate(([0], np.cumsum(self.n_words)))

    def word_hashes(self) -> np.ndarray:
        return Rolling(_BYTE[self.data]).of(self.starts, self.ends)

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of each run of k words within one text."""
        at = np.arange(max(0, len(hashes) - k + 1))
        at = at[self.doc[at] == self.doc[at + k - 1]] if len(at) else at
        return at, Rolling(hashes).of(at, at + k)


def pack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(column: pa.Array, limit: int = SLICE, lower: bool = False) -> Iterator[tuple[int, int, Packed]]:
    """Runs of rows whose texts take about ``limit`` bytes (a longer text stands alone), packed."""
    data, offs = pack(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, Packed(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], lower)
        i = j


def trim() -> None:
    """Give freed memory back to the system: Python workers live on after a task, beside an executor that needs it by then."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # other systems than those with glibc
        pass


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
