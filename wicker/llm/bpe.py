"""Byte-level BPE, array at a time.

Pre-tokenisation runs no regular expression: every code point has a class, every class a transition
function on a handful of states, and composing these functions is associative, so blocks of a text
are scanned side by side. The slices found are hashed, each distinct slice is merged once (all at a
time, lowest rank first) and remembered, and token ids are gathered back with their byte offsets.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .words import byte_hashes, column_bytes, pieces

# classes of code points
LETTER, NUMBER, SPACE, WHITE, OTHER, QUOTE, S_, T_, R_, E_, V_, M_, L_, D_, BREAK = range(15)
_FIXED = {" ": SPACE, "'": QUOTE, "s": S_, "t": T_, "r": R_, "e": E_, "v": V_, "m": M_, "l": L_, "d": D_}
# states: what the current token is, after the code point just read
(START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, LONE_QUOTE, HALF_R, HALF_V, HALF_L, ENDED, SPACED) = range(11)
N_STATES = 11
CACHE_SLICES = 400_000


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state by class and state, and whether a token begins at the code point read."""
    step = np.zeros((15, N_STATES), np.uint8)
    begin = np.zeros((15, N_STATES), bool)
    letters = {LETTER, S_, T_, R_, E_, V_, M_, L_, D_}
    for c in range(15):
        for s in range(N_STATES):
            fresh = {**dict.fromkeys(letters, IN_LETTERS), NUMBER: IN_NUMBERS, SPACE: SPACED, WHITE: IN_WHITE, OTHER: IN_OTHERS, QUOTE: LONE_QUOTE}
            if c == BREAK:
                step[c, s], begin[c, s] = START, True
                continue
            to, new = fresh[c], True
            if s == IN_LETTERS and c in letters or s == IN_NUMBERS and c == NUMBER:
                to, new = s, False
            elif s in (IN_OTHERS, LONE_QUOTE, SPACED) and c in (OTHER, QUOTE):
                to, new = IN_OTHERS, False
            elif s == SPACED and c in letters:
                to, new = IN_LETTERS, False
            elif s == SPACED and c == NUMBER:
                to, new = IN_NUMBERS, False
            elif s in (SPACED, IN_WHITE) and c in (SPACE, WHITE):
                to, new = (SPACED if c == SPACE else IN_WHITE), False
            elif s == LONE_QUOTE and c in letters:
                # a quote that begins a token takes s, t, m, d or re, ve, ll; a first half is settled by the next letter
                if c in (S_, T_, M_, D_):
                    to, new = ENDED, False
                elif c in (R_, V_, L_):
                    to, new = {R_: HALF_R, V_: HALF_V, L_: HALF_L}[c], True
            elif s in (HALF_R, HALF_V, HALF_L) and c in letters:
                to, new = (ENDED, False) if c == (L_ if s == HALF_L else E_) else (IN_LETTERS, False)
            step[c, s], begin[c, s] = to, new
    return step, begin


_STEP, _BEGIN = _tables()


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    whole = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        for m in regex.finditer(pattern, whole):
            out[[ord(x) for x in m[0]]] = c
    for x, c in _FIXED.items():
        out[ord(x)] = c
    return out


def states_before(kinds: np.ndarray, block: int = 128) -> np.ndarray:
    """The state before each code point, by a blocked scan over composed transition functions."""
    n = len(kinds)
    rows = -(-n // block)
    padded = np.full(rows * block, BREAK, np.uint8)
    padded[:n] = kinds
    by_step = np.ascontiguousarray(padded.reshape(rows, block).T)
    # each block as one function from states to states
    whole = np.broadcast_to(np.arange(N_STATES, dtype=np.uint8), (rows, N_STATES))
    for column in by_step:
        whole = _STEP[column[:, None], whole]
    # prefixes of blocks: composition is associative, so spans double
    span = 1
    while span < rows:
        ahead = whole.copy()
        ahead[span:] = np.take_along_axis(whole[span:], whole[:-span], axis=1)
        whole, span = ahead, 2 * span
    state = np.concatenate((np.full(1, START, np.uint8), whole[:-1, START]))
    out = np.empty((block, rows), np.uint8)
    for i, column in enumerate(by_step):
        out[i] = state
        state = _STEP[column, state]
    return out.T.reshape(-1)[:n]


def _code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the byte at which each begins."""
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    text = raw.tobytes().decode("utf-8", "surrogatepass")
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), at


def slice_starts(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bytes at which pre-tokens begin; every text begins one."""
    if not len(raw):
        return np.zeros(0, np.int64)
    points, at = _code_points(raw)
    kinds = classes()[points]
    firsts = np.searchsorted(at, offs[:-1][np.diff(offs) > 0])
    # a BREAK before every text resets the scan
    place = np.arange(len(points)) + np.searchsorted(firsts, np.arange(len(points)), side="right")
    spread = np.full(len(points) + len(firsts), BREAK, np.uint8)
    spread[place] = kinds
    before = states_before(spread)[place]
    begin = _BEGIN[kinds, before]
    # half a contraction that came to nothing: the quote stands alone; one that closed reaches back over its first half
    closed = (_STEP[kinds, before] == ENDED) & np.isin(before, (HALF_R, HALF_V, HALF_L))
    begin[np.flatnonzero(closed) - 1] = False
    # white space before anything else gives its last code point to a token of its own or, if it is a space, to that token
    white = (kinds == SPACE) | (kinds == WHITE)
    follows = np.zeros(len(points), bool)
    follows[:-1] = ~white[1:]
    follows[firsts[1:] - 1] = False
    follows[-1] = False
    last = white & follows
    begin[last] = True
    after = np.flatnonzero(last & (kinds == WHITE)) + 1
    begin[after] = True
    begin[firsts] = True
    return at[begin]


class Merger:
    """Ranks as arrays; distinct slices are merged together."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.to = np.array([pairs[x] for x in self.keys.tolist()], np.int64)
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        size = int(self.lengths.max())
        self.bytes = np.zeros((len(self.lengths), size), np.uint8)
        for token, rank in ranks.items():
            self.bytes[rank, : len(token)] = np.frombuffer(token, np.uint8)
        self.known: dict[bytes, np.ndarray] = {}

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], np.iinfo(np.int64).max)

    def merge(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Token ids of each slice."""
        out: list[np.ndarray | None] = [None] * len(starts)
        whole = raw.tobytes()
        rest = []
        for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
            rank = self.ranks.get(whole[s:e])
            if rank is None:
                rest.append(i)
            else:
                out[i] = np.array([rank], np.int64)
        if not rest:
            return out
        sizes = (ends - starts)[rest]
        of = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(starts[rest] - of[:-1], sizes) + np.arange(of[-1])
        ids, word = self.single[raw[at]], np.repeat(np.arange(len(rest)), sizes)
        no = np.iinfo(np.int64).max
        done_ids, done_word = [], []
        while len(ids):
            joined = np.full(len(ids), no)
            same = word[1:] == word[:-1]
            joined[:-1][same] = self._pair_ranks(ids[:-1][same], ids[1:][same])
            first = np.flatnonzero(np.concatenate(([True], ~same)))
            lowest = np.minimum.reduceat(joined, first)
            sizes = np.diff(np.append(first, len(ids)))
            over = np.repeat(lowest == no, sizes)
            done_ids.append(ids[over])
            done_word.append(word[over])
            hit = (joined == np.repeat(lowest, sizes)) & ~over
            # of touching pairs of one rank the leftmost go first: every second one of a run
            where = np.flatnonzero(hit)
            run = np.concatenate(([True], np.diff(where) > 1))
            begins = where[run][np.cumsum(run) - 1] if len(where) else where
            where = where[(where - begins) % 2 == 0]
            ids[where] = joined[where]
            keep = ~over
            keep[where + 1] = False
            ids, word = ids[keep], word[keep]
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        ids, word = ids[order], word[order]
        for w, part in enumerate(np.split(ids, np.searchsorted(word, np.arange(1, len(rest))))):
            out[rest[w]] = part
        return out

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the byte at which each token begins, and per text the range of its tokens."""
        starts = slice_starts(raw, offs)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
        ends = np.append(starts[1:], len(raw))
        _, at, inverse = np.unique(byte_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        # a slice stands for all of its hash: their bytes are compared
        like = at[inverse]
        same = ends - starts == ends[like] - starts[like]
        if same.all():
            same = bool((raw == raw[np.repeat(starts[like] - starts, ends - starts) + np.arange(len(raw))]).all())
        if not np.all(same):
            names: dict[bytes, int] = {}
            whole = raw.tobytes()
            inverse = np.array([names.setdefault(whole[s:e], len(names)) for s, e in zip(starts.tolist(), ends.tolist())], np.int64)
            at = np.unique(inverse, return_index=True)[1]
        if len(self.known) > CACHE_SLICES:
            self.known = {}
        whole = raw.tobytes()
        slices = [whole[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())]
        new = [i for i, s in enumerate(slices) if s not in self.known]
        if new:
            for i, ids in zip(new, self.merge(raw, starts[at[new]], ends[at[new]])):
                self.known[slices[i]] = ids
        each = [self.known[s] for s in slices]
        flat = np.concatenate(each)
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        of = np.concatenate(([0], np.cumsum(sizes)))
        n = sizes[inverse]
        total = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.repeat(of[:-1][inverse] - total[:-1], n) + np.arange(total[-1])]
        begins = np.concatenate(([0], np.cumsum(self.lengths[ids])))[:-1]
        return ids, begins, np.searchsorted(begins, offs)

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.lengths[ids]
        return self.bytes[ids][np.arange(self.bytes.shape[1]) < sizes[:, None]].tobytes()


@lru_cache(2)
def _merger(path: str) -> Merger:
    return Merger(path)


def _encode(path: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(path)
        for batch in batches:
            raw, offs = column_bytes(batch.column(1))
            for lo, hi in pieces(offs):
                at = offs[lo : hi + 1] - offs[lo]
                ids, begins, of = merger.encode(raw[offs[lo] : offs[hi]], at)
                little = ids.astype("<u4")
                rows = range(hi - lo)
                first = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(of).astype(np.int64))]
                if digests:
                    columns = [
                        pa.array([hashlib.sha256(little[of[i] : of[i + 1]].tobytes()).hexdigest() for i in rows]),
                        pa.array([hashlib.sha256(b"".join(merger.decode(ids[j : min(j + 4096, of[i + 1])]) for j in range(of[i], of[i + 1], 4096))).hexdigest() for i in rows]),
                    ]
                    yield pa.RecordBatch.from_arrays(first + columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    ranges = pa.array(of.astype(np.int32))
                    starts = begins - np.repeat(at[:-1], np.diff(of))
                    decoded = [merger.decode(ids[of[i] : of[i + 1]]) for i in rows]
                    columns = [pa.ListArray.from_arrays(ranges, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(ranges, pa.array(starts.astype(np.int32))), pa.array(decoded, pa.binary())]
                    yield pa.RecordBatch.from_arrays(first + columns, ["doc_id", "n_tokens", "ids", "offsets", "decoded"])

    return run


def encode(docs: DataFrame, path: str, key: str = "doc_id", digests: bool = False) -> DataFrame:
    """``docs(key, text)`` -> ``doc_id, n_tokens, ids, offsets, decoded``, one row for each row of ``docs``.

    ``path`` is a file of base64 tokens and ranks, in place on every machine. ``ids`` are what byte-pair merging by those ranks gives
    for each pre-token separately, without special tokens; ``offsets`` are the bytes at which
    tokens begin, ``decoded`` what the ids decode to. With ``digests``: ``ids_sha256`` (ids as little-endian unsigned 32-bit integers)
    and ``decoded_sha256`` (of the bytes that the ids decode to). A null or empty text has no
    tokens. Repeated rows get a row each; other columns are ignored.
    """
    kind = dict(docs.dtypes)[key]
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, offsets array<int>, decoded binary"
    base = docs.select(F.col(key).alias("id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return base.mapInArrow(_encode(path, digests), f"doc_id {kind}, n_tokens long, {rest}")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(path)
        for batch in batches:
            texts = [merger.decode(np.asarray(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "decoded"])

    return run


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """``encoded(key, ids)`` -> ``doc_id, decoded`` (bytes); null or empty ids decode to no bytes."""
    kind = dict(encoded.dtypes)[key]
    return encoded.select(F.col(key).alias("id"), "ids").mapInArrow(_decode(path), f"doc_id {kind}, decoded binary")
