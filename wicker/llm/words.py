"""Array-at-a-time words and rolling hashes over a batch of UTF-8 texts.

A batch is one byte array and the offsets of its texts, as Arrow holds it, so no Python
string is made per word. Words are ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(base, -1, 2**64)
        both = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        have = _powers[base] = (both[0], both[1])
    return have


def byte_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTES) -> np.ndarray:
    """Hash of the bytes raw[start:end] of each span, however long; spans ascend and don't overlap.

    A mixed number for each byte and its place in the span is summed. A polynomial modulo 2**64 would not do: on long spans some unequal ones
    collide whatever the base.
    """
    begin = np.zeros(len(raw), np.int64)
    begin[starts[starts < len(raw)]] = starts[starts < len(raw)]
    place = (np.arange(len(raw)) - np.maximum.accumulate(begin)).astype(np.uint64)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(mix(values[raw] + place * U(_BASES[0])), out=sums[1:])
    return mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64) * U(_BASES[2]))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASES[0]) -> np.ndarray:
    """Polynomial hash of values[start:end] for each span, from one prefix sum. For short spans (windows of words, grams) only."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and each text's offsets (a null is an empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together; a longer text stands alone."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Words:
    """The words of some texts: byte spans, and per text the range of its words."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        self.raw, self.offs = raw, offs
        word = ~_SPACE[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[offs] = True
        start = word.copy()
        start[1:] &= ~word[:-1] | cut[1:-1]
        end = word.copy()
        end[:-1] &= ~word[1:] | cut[1:-1]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.of = np.searchsorted(self.starts, offs)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    def hashes(self, lower: bool) -> np.ndarray:
        return byte_hashes(self.raw, self.starts, self.ends, _LOWER if lower else _BYTES)

    def windows(self, hashes: np.ndarray, k: int, base: int = _BASES[1]) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every k consecutive words of one text, and per text the range of its windows."""
        counts = np.maximum(self.counts - k + 1, 0)
        of = np.concatenate(([0], np.cumsum(counts)))
        first = np.repeat(self.of[:-1] - of[:-1], counts) + np.arange(of[-1])
        return span_hashes(hashes, first, first + k, base), of


def words_of(raw: np.ndarray, offs: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int, Words]]:
    """Words of the texts lo..hi, piece by piece."""
    for lo, hi in pieces(offs, most):
        yield lo, hi, Words(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
