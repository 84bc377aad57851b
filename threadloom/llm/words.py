"""Words of whole texts as arrays: places, 64-bit hashes and rolling hashes of word windows.

A word is a maximal run of bytes other than space and \\x09-\\x0D, so no UTF-8 character is
ever cut.  Hashes are Rabin-Karp: prefix sums of (random value of the byte) * P**place
modulo 2**64, whose differences give any span; windows of words do the same over the
words' hashes, and a final mix spreads the bits.  All of it is a handful of passes over a
block of texts of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.random.default_rng(20_240_607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
#: Multipliers of the two rolling hashes; odd, so that they have inverses.
_P, _Q = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK + 1024), base % (1 << 64), np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= BLOCK + 1024:
            _powers[base] = have
    return have[:n]


def spans(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rolling hash of values[start:end] for each pair."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    back = powers(pow(base, -1, 1 << 64), len(values) + 1)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; nulls count as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Words:
    """Words of a block: ``of[d]:of[d+1]`` are those of text d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        n = len(data)
        inside = ~WHITE[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        before = np.ones(n, bool)
        before[1:] = ~inside[:-1]
        starts = np.flatnonzero(inside & (before | first[:-1]))
        after = np.ones(n, bool)
        after[:-1] = ~inside[1:]
        ends = np.flatnonzero(inside & (after | first[1:])) + 1
        self.of = np.searchsorted(starts, offsets)
        self.hash = spans((_LOWER if lower else _BYTES)[data], _P, starts, ends) if len(starts) else np.empty(0, np.uint64)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of every k consecutive words of one text, their first words, and offsets by text."""
        per = np.maximum(np.diff(self.of) - k + 1, 0)
        out = np.concatenate(([0], np.cumsum(per)))
        starts = np.arange(out[-1]) - np.repeat(out[:-1] - self.of[:-1], per)
        return (spans(self.hash, _Q, starts, starts + k) if len(starts) else np.empty(0, np.uint64)), starts, out


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every k consecutive values."""
    width, have = 1, x
    while width * 2 <= k:
        have = np.minimum(have[: len(have) - width], have[width:])
        width *= 2
    rest = k - width
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have
