"""Hidden Markov models over integer symbols: exact recursions over many sequences at a time.

Sequences are cut into segments that run side by side. What passes a cut is exact: the product of a
segment's transfer matrices carries the forward message over it and the backward message back, so
a long sequence takes as many steps as a segment has symbols, not as many as it has itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LANE = 512
_ROWS = 1 << 16


@dataclass
class Model:
    first: np.ndarray
    moves: np.ndarray
    emits: np.ndarray  # symbol x state


class _Segments:
    """The segments of sequences ``of[i]..of[i + 1]`` (none empty), laid out time by time; those that others follow come first."""

    def __init__(self, symbols: np.ndarray, of: np.ndarray, model: Model, lane: int, dtype):
        sizes = np.diff(of)
        parts = -(-sizes // lane)
        self.n_texts, self.longest = len(sizes), int(parts.max(initial=0))
        text = np.repeat(np.arange(len(sizes)), parts)
        first = np.cumsum(parts) - parts
        place = np.arange(len(text)) - first[text]
        begin = of[:-1][text] + place * lane
        size = np.minimum(lane, of[1:][text] - begin)
        last = place == parts[text] - 1
        order = np.lexsort((-size, last))
        self.lane_of = np.empty(len(order), np.int64)
        self.lane_of[order] = np.arange(len(order))
        self.first, self.parts = first, parts
        self.text, self.place, begin, size = text[order], place[order], begin[order], size[order]
        self.followed = int((~last).sum())
        self.live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1 if len(size) else 1), side="right")
        self.base = np.concatenate(([0], np.cumsum(self.live)))
        # rows time by time: of each time the segments that last so long
        self.lane_at = np.arange(int(size.sum()), dtype=np.int32) - np.repeat(self.base[:-1].astype(np.int32), self.live)
        t = np.repeat(np.arange(len(self.live), dtype=np.int32), self.live)
        self.symbols = symbols[begin.astype(np.int32 if len(symbols) < 1 << 31 else np.int64)[self.lane_at] + t]
        self.start, self.moves = model.first.astype(dtype), model.moves.astype(dtype)
        # emissions by their symbol's largest, so that products of many stay in range
        self.most = model.emits.max(1).astype(float)
        self.gains = (model.emits / self.most[:, None]).astype(dtype)[self.symbols]

    def _transfers(self) -> np.ndarray:
        """For each followed segment the product of its steps, up to a factor."""
        p, k = self.followed, len(self.start)
        g = self.gains[:p]
        out = np.where((self.place[:p] == 0)[:, None, None], np.eye(k, dtype=g.dtype), self.moves) * g[:, None, :]
        for t in range(1, len(self.live) if p else 0):
            out = (out.reshape(p * k, k) @ self.moves).reshape(p, k, k)
            out *= self.gains[self.base[t] : self.base[t] + p, None, :]
            if t % 8 == 0:
                out /= out.max((1, 2))[:, None, None]
        return out

    def enter(self) -> np.ndarray:
        """The forward message before each segment (a first segment has none)."""
        k = len(self.start)
        self.entering = np.zeros((len(self.text), k), self.gains.dtype)
        self.transfers = self._transfers()
        now = np.flatnonzero(self.parts > 1)
        message = np.broadcast_to(self.start, (len(now), k))
        for j in range(1, self.longest):
            message = np.einsum("ij,ijk->ik", message, self.transfers[self.lane_of[self.first[now] + j - 1]])
            message = message / message.sum(1, keepdims=True)
            self.entering[self.lane_of[self.first[now] + j]] = message
            more = self.parts[now] > j + 1
            now, message = now[more], message[more]
        return self.entering

    def forward(self) -> tuple[np.ndarray, np.ndarray]:
        """Normalised forward messages and their scales."""
        entering = self.enter()
        out, scale = np.empty_like(self.gains), np.empty(len(self.gains), self.gains.dtype)
        ones = np.ones((len(self.start), 1), self.gains.dtype)
        a = np.where((self.place == 0)[:, None], self.start, entering @ self.moves)
        for t, m in enumerate(self.live.tolist()):
            rows = slice(self.base[t], self.base[t + 1])
            a = (a[:m] @ self.moves if t else a) * self.gains[rows]
            s = a @ ones
            a /= s
            out[rows], scale[rows] = a, s[:, 0]
        return out, scale

    def _back(self, lo: int, hi: int, ends: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Backward messages of segments lo..hi from those at their ends; returned are those before their beginnings."""
        ones = np.ones((len(self.start), 1), self.gains.dtype)
        back = self.moves.T.copy()
        b = np.empty((0, len(self.start)), self.gains.dtype)
        for t in range(len(self.live) - 1, -1, -1):
            m = max(min(int(self.live[t]), hi), lo)
            b = np.concatenate((b, ends[len(b) : m - lo]))
            rows = slice(self.base[t] + lo, self.base[t] + m)
            out[rows] = b
            b = (self.gains[rows] * b) @ back
            b /= b @ ones
        return b

    def backward(self) -> np.ndarray:
        p, n, k = self.followed, len(self.text), len(self.start)
        out = np.empty_like(self.gains)
        before = self._back(p, n, np.ones((n - p, k), self.gains.dtype), out)
        ends = np.ones((p, k), self.gains.dtype)
        now = np.flatnonzero(self.parts > 1)
        now = now[np.argsort(-self.parts[now], kind="stable")]
        parts = self.parts[now]
        message = before[self.lane_of[self.first[now] + parts - 1] - p] if len(now) else np.zeros((0, k))
        for j in range(1, self.longest):  # the j-th segment from behind; texts with fewer have dropped out
            m = int(np.searchsorted(-parts, -j, side="left"))
            at = self.lane_of[self.first[now[:m]] + parts[:m] - 1 - j]
            ends[at] = message[:m]
            message = np.einsum("ijk,ik->ij", self.transfers[at], message[:m])
            message = message / message.sum(1, keepdims=True)
        self._back(0, p, ends, out)
        return out


def forward_backward(symbols: np.ndarray, of: np.ndarray, model: Model, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected first states, moves and emissions (symbol x state) of the sequences."""
    k = len(model.first)
    first, moved, emitted = np.zeros(k), np.zeros((k, k)), np.zeros((model.emits.shape[0], k))
    if not len(symbols):
        return first, moved, emitted
    x = _Segments(symbols, of, model, lane, np.float32)
    f, _ = x.forward()
    b = x.backward()
    posterior = f * b
    posterior /= posterior @ np.ones((k, 1), posterior.dtype)
    first += posterior[: x.live[0]][x.place == 0].sum(0, dtype=float)
    weighted = x.gains * b
    lane_at = x.lane_at
    n = len(symbols)
    before = np.zeros(n, np.int32)  # row of the symbol before, in the same segment
    before[x.live[0] :] = np.repeat(x.base[:-2].astype(np.int32), x.live[1:]) + lane_at[x.live[0] :]
    for lo in range(0, n, _ROWS):
        hi = min(lo + _ROWS, n)
        if lo >= x.live[0]:
            p, w = f[before[lo:hi]], weighted[lo:hi]
        else:
            cut = min(int(x.live[0]), hi)
            inner = x.place[lane_at[lo:cut]] > 0
            p = np.concatenate((x.entering[lane_at[lo:cut][inner]], f[before[cut:hi]]))
            w = np.concatenate((weighted[lo:cut][inner], weighted[cut:hi]))
        w = w / (((p @ x.moves) * w) @ np.ones((k, 1), w.dtype))
        moved += p.T @ w
    moved *= model.moves
    for s in range(k):
        emitted[:, s] = np.bincount(x.symbols, posterior[:, s], model.emits.shape[0])
    return first, moved, emitted


def log10_likelihood(symbols: np.ndarray, of: np.ndarray, model: Model, lane: int = LANE) -> np.ndarray:
    """Exact log10 probability of each whole sequence, by the scaled forward recursion."""
    if not len(symbols):
        return np.zeros(len(of) - 1)
    x = _Segments(symbols, of, model, lane, np.float64)
    _, scale = x.forward()
    return np.bincount(x.text[x.lane_at], np.log10(scale) + np.log10(x.most)[x.symbols], x.n_texts)
