"""Token counts by a compiled finite-state transducer (byte-pair pieces with byte fallback).

A tokenization by ranked merges is right exactly if every token and every two neighbours are what
merging gives for them alone. So the last token of each prefix follows from the last tokens of the
prefixes at most one piece shorter, and these, with how many tokens each of them has more or less
than the prefix, are a state; there are finitely many. Each transition says how the number of tokens
changes. States are compiled when a text first reaches them. A stream of texts is cut into chunks
that are scanned side by side; each chunk's map from its entry state to its exit state and changes
is computed from a guess, the maps are composed from left to right all at once, and where the entry
turns out to be another one the chunk is run again until it meets its own trace.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import column_bytes, pieces

CHUNK = 256
SLAB = 1 << 21
MOST_STATES = 300_000
SYMBOL_BITS = 17
ROOT = START = 0
SPACE = "▁"


class Transducer:
    """States and transitions of one model, compiled as texts need them."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        chars = sorted({c for piece in scores for c in piece})
        if any(c not in scores for c in chars):
            raise ValueError("every character of a piece must be a piece itself")
        number = {c: i for i, c in enumerate(chars)}
        # barriers after the characters: a text's beginning emits nothing, an unknown code point its bytes
        self.first_barrier = len(chars)
        self.of_point = np.empty(0x110000, np.int32)
        for size, top in ((4, 0x110000), (3, 0x10000), (2, 0x800), (1, 0x80)):
            self.of_point[:top] = self.first_barrier + size
        for c, i in number.items():
            self.of_point[ord(c)] = i
        self.space = number[SPACE]
        self.of_point[ord(" ")] = self.space
        self.pieces = sorted(scores)
        self.last_char = [number[p[-1]] for p in self.pieces]
        self.inside = {(number[a], number[b]) for p in self.pieces for a, b in zip(p, p[1:])}
        self.child: list[dict[int, int]] = [{}]
        self.token_at = [-1]
        for t, piece in enumerate(self.pieces):
            node = ROOT
            for c in piece:
                c = number[c]
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.token_at.append(-1)
                node = self.child[node][c]
            if self.merged(piece) == [piece]:
                self.token_at[node] = t
        self.pairs: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        """Forget the compiled states."""
        self.states: list[tuple] = [((ROOT, -1, 0),)]
        self.number = {self.states[0]: START}
        self.used = 0
        self.keys = np.full(1 << 16, -1, np.int64)
        self.to = np.zeros(1 << 16, np.int64)

    def merged(self, text: str) -> list[str]:
        """Merging by the rule itself: the best adjacent pair first, the leftmost of equals."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def neighbours(self, a: int, b: int) -> bool:
        """Whether merging leaves two tokens as they are."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            x, y = self.pieces[a], self.pieces[b]
            known = self.pairs[key] = self.merged(x + y) == [x, y]
        return known

    def compile(self, state: int, symbol: int) -> tuple[int, int]:
        """The state after a symbol, and the change in the number of tokens."""
        if symbol >= self.first_barrier:
            return START, symbol - self.first_barrier
        live = self.states[state]
        before = live[-1][1]
        if before >= 0 and (self.last_char[before], symbol) not in self.inside:
            live = self.states[START]  # no piece reaches over this place
        change, last, grown = None, -1, []
        for node, token, count in live:
            node = self.child[node].get(symbol)
            if node is None:
                continue
            here = self.token_at[node]
            if change is None and here >= 0 and (token < 0 or self.neighbours(token, here)):
                change, last = count + 1, here
            if self.child[node]:
                grown.append((node, token, count))
        after = (*((n, t, c - change) for n, t, c in grown), (ROOT, last, 0))
        number = self.number.get(after)
        if number is None:
            number = self.number[after] = len(self.states)
            self.states.append(after)
        return number, change

    def _add(self, keys: np.ndarray) -> None:
        """Compile the transitions of some keys into the hash table."""
        if 3 * (self.used + len(keys)) > len(self.keys):
            old, to = self.keys, self.to
            size = 1 << int(6 * (self.used + len(keys))).bit_length()
            self.keys, self.to = np.full(size, -1, np.int64), np.zeros(size, np.int64)
            self._put(old[old >= 0], to[old >= 0])
        out = [self.compile(k >> SYMBOL_BITS, k & (1 << SYMBOL_BITS) - 1) for k in keys.tolist()]
        self._put(keys, np.array([(s << 8) + c + 128 for s, c in out], np.int64))
        self.used += len(keys)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        at = self._home(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.to[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & (len(self.keys) - 1)

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One transition of every lane."""
        keys = states << SYMBOL_BITS | symbols
        at = self._home(keys)
        found = self.keys[at]
        off = np.flatnonzero(found != keys)
        while len(off):
            new = np.unique(keys[off][found[off] < 0])
            if len(new):
                self._add(new)
                at[off] = self._home(keys[off])
                at[:] = self._home(keys)
                off = np.arange(len(keys))
            else:
                at[off] = (at[off] + 1) & (len(self.keys) - 1)
            found[off] = self.keys[at[off]]
            off = off[found[off] != keys[off]]
        to = self.to[at]
        return to >> 8, (to & 255) - 128

    def scan(self, symbols: np.ndarray, entry: int = START) -> tuple[np.ndarray, int]:
        """The change at each symbol, and the state after the last."""
        rows = -(-len(symbols) // CHUNK)
        chunks = np.full(rows * CHUNK, self.first_barrier, np.int64)
        chunks[: len(symbols)] = symbols
        chunks = np.ascontiguousarray(chunks.reshape(rows, CHUNK).T)
        trace = np.empty((CHUNK, rows), np.int32)
        changes = np.empty((CHUNK, rows), np.int8)
        entries = np.full(rows, START, np.int64)
        entries[0] = entry
        state = entries
        for i in range(CHUNK):
            state, changes[i] = self.step(state, chunks[i])
            trace[i] = state
        seen: dict[tuple[bytes, int], tuple[np.ndarray, np.ndarray]] = {}
        while True:
            true = np.concatenate((entries[:1], trace[-1, :-1]))
            lanes = np.flatnonzero(true != entries)
            if not len(lanes):
                break
            entries[lanes] = true[lanes]
            if seen or len(lanes) < 4:  # maps of chunks that did not meet their trace, by content and entry
                again = [(x, seen.get((chunks[:, x].tobytes(), int(true[x])))) for x in lanes.tolist()]
                for x, known in again:
                    if known is not None:
                        trace[:, x], changes[:, x] = known
                lanes = np.array([x for x, known in again if known is None], np.int64)
            state = entries[lanes]
            for i in range(CHUNK):
                if not len(lanes):
                    break
                state, changes[i, lanes] = self.step(state, chunks[i, lanes])
                other = state != trace[i, lanes]
                trace[i, lanes] = state
                lanes, state = lanes[other], state[other]
            for x in lanes.tolist():
                seen[chunks[:, x].tobytes(), int(entries[x])] = trace[:, x].copy(), changes[:, x].copy()
        last = int(trace[(len(symbols) - 1) % CHUNK, -1])
        return changes.T.reshape(-1)[: len(symbols)], last

    def counts(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The number of tokens of each text."""
        if len(self.states) > MOST_STATES:
            self.clear()
        if len(offs) == 2 and len(raw) > SLAB:
            return np.array([self.long_count(raw)])
        points = code_points(raw)
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        firsts = np.searchsorted(at, offs)
        full = np.flatnonzero(np.diff(firsts) > 0)
        # before each text that is not empty: its beginning and a space
        place = np.arange(len(points)) + 2 * np.searchsorted(firsts[full], np.arange(len(points)), side="right")
        stream = np.full(len(points) + 2 * len(full), self.space, np.int32)
        begins = firsts[full] + 2 * np.arange(len(full))
        stream[begins] = self.first_barrier
        stream[place] = self.of_point[points]
        total = np.zeros(len(stream) + 1, np.int64)
        if len(stream):
            np.cumsum(self.scan(stream)[0], dtype=np.int64, out=total[1:])
        out = np.zeros(len(offs) - 1, np.int64)
        out[full] = np.diff(np.append(total[begins], total[-1]))
        return out

    def long_count(self, raw: np.ndarray) -> int:
        """The number of tokens of one long text, read slab by slab."""
        changes, state = self.scan(np.array([self.first_barrier, self.space]))
        total, lo = int(changes.sum(dtype=np.int64)), 0
        while lo < len(raw):
            hi = min(lo + SLAB, len(raw))
            while hi < len(raw) and raw[hi] & 0xC0 == 0x80:
                hi -= 1
            changes, state = self.scan(self.of_point[code_points(raw[lo:hi])], state)
            total += int(changes.sum(dtype=np.int64))
            lo = hi
        return total


def code_points(raw: np.ndarray) -> np.ndarray:
    return np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)


@lru_cache(2)
def _transducer(path: str) -> Transducer:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    scores = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not special(i)}
    # the compiled rules are those of models that change nothing in a text but spaces; others are told apart by what they give
    for text in ("  Ab  \n c ", "ﬁ é Å", "\U0001f92f\x00\x01 x"):
        if model.decode(model.encode(text)) != text or model.encode(text, out_type=str)[0][0] != SPACE:
            raise ValueError("the model normalises texts or adds no space before them")
    return Transducer(scores)


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _transducer(path)
        for batch in batches:
            raw, offs = column_bytes(batch.column(1))
            out = [transducer.counts(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]) for lo, hi in pieces(offs, SLAB)]
            tokens = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offs)), pa.array(tokens)], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 4096, key: str = "doc_id") -> DataFrame:
    """``docs(key, text)`` -> ``doc_id, n_bytes, n_tokens, over_limit``, one row for each row of ``docs``.

    ``path`` is a byte-pair piece model in place on every machine. ``n_tokens`` is the number of pieces that its library gives for the whole
    text without begin and end; strings that look like special tokens are text. ``over_limit`` is whether they are more than ``limit``.
    A null or empty text has no bytes and no tokens. Repeated rows get a row each, a null key stays null, an empty table gives none;
    other columns are ignored.
    """
    kind = dict(docs.dtypes)[key]
    base = docs.select(F.col(key).alias("id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    counted = base.mapInArrow(_count(path), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
