"""Language-model scores: a hidden Markov model over words, trained by Baum-Welch.

The corpus gives word counts; the most frequent words are symbols of their own, the others share
symbols by their last two bytes and are drawn from their symbol's counts with one added. Every text is
written once as its symbols, two bytes each. Baum-Welch starts from the corpus's counts and every sweep
runs over every training text, whole: each task sums its expected counts, Spark adds them up by symbol,
and only tables of a fixed size (symbols times states) reach the driver. Scoring is the exact likelihood
by the scaled forward recursion over each whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .hidden_markov import Model, forward_backward, log10_likelihood
from .scratch import written
from .words import column_bytes, pieces, words_of

STATES = 8
#: Words with a symbol of their own, symbols that the other words share, words whose counts every task holds: fixed sizes.
OWN, SHARED, HELD = 16_384, 512, 262_144
#: Bins of counts to each power of two.
BINS = 64
#: Sweeps over all training texts.
SWEEPS = 6
END = np.int64(0x454E44)
PIECE = 4 << 20


def symbols_of_tails(raw: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Shared symbol of each word: by its last two bytes, lower-cased."""
    low = raw + ((raw >= 65) & (raw <= 90)) * np.uint8(32)
    last = low[ends - 1].astype(np.int64)
    before = np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    return (last * 31 + before * 1009) % SHARED


class Lexicon:
    """The most frequent words by hash: their counts, their own symbols (-1: shared), what they add to the scores; sizes of shared symbols."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, symbols: np.ndarray, own: int, shared_mass: np.ndarray, tokens: int, distinct: int):
        order = np.argsort(keys.view(np.uint64))
        self.keys, self.counts, self.symbols = keys.view(np.uint64)[order], counts[order], symbols[order]
        self.logs = np.log10(self.counts + 1.0)
        self.own, self.shared_mass, self.tokens, self.distinct = own, shared_mass, tokens, distinct
        # the leading bits of a hash tell where to look
        self.bits = max(1, int(len(keys)).bit_length() + 2)
        starts = np.searchsorted(self.keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)
        self.starts, self.longest = starts, int(np.diff(np.append(starts, len(keys))).max())
        self.padded = np.append(self.keys, np.zeros(self.longest + 1, np.uint64))

    @property
    def end_symbol(self) -> int:
        return self.own + len(self.shared_mass)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each hash's place, and whether it is held."""
        at = self.starts[hashes >> np.uint64(64 - self.bits)]
        held = (self.padded[at] == hashes) & (at < len(self.keys))
        rest = np.flatnonzero(~held)
        for step in range(1, self.longest):
            if not len(rest):
                break
            there = at[rest] + step
            good = (self.padded[there] == hashes[rest]) & (there < len(self.keys))
            at[rest[good]] = there[good]
            held[rest[good]] = True
            rest = rest[~good]
        return at, held


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offs = column_bytes(batch.column("text"))
        for lo, hi, words in words_of(raw, offs, PIECE):
            hashes = words.hashes(lower=True).view(np.int64)
            tails = symbols_of_tails(words.raw, words.ends, words.starts)
            distinct, at, counts = np.unique(hashes, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(distinct, END)), pa.array(np.append(tails[at], -1).astype(np.int32)), pa.array(np.append(counts, hi - lo).astype(np.int64))], ["h", "tail", "c"]
            )


def _sequences(words, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts with their ends, each text's range; of the words: hashes, places in the lexicon (-1: not held), and which share their symbol."""
    hashes = words.hashes(lower=True)
    at, held = lexicon.find(hashes)
    symbols = np.full(len(hashes), -1, np.int64)
    symbols[held] = lexicon.symbols[at[held]]
    shared = np.flatnonzero(symbols < 0)
    symbols[shared] = lexicon.own + symbols_of_tails(words.raw, words.ends[shared], words.starts[shared])
    n = words.counts
    of = np.concatenate(([0], np.cumsum(n + 1)))
    out = np.full(of[-1], lexicon.end_symbol, np.int64)
    out[np.arange(len(symbols)) + np.repeat(np.arange(len(n)), n)] = symbols
    return out, of, hashes, np.where(held, at, -1), shared


def _encode(lexicon):
    """Texts to symbols, counts of known words, and what the words add to the base score and to the model's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        for batch in batches:
            raw, offs = column_bytes(batch.column("text"))
            for lo, hi, words in words_of(raw, offs, PIECE):
                symbols, of, hashes, at, shared = _sequences(words, lex)
                doc = np.repeat(np.arange(hi - lo), words.counts)
                known = np.append(lex.counts > 0, False)[at]
                logs = np.append(lex.logs, 0.0)[at]
                # of a word that shares its symbol, its part of that symbol
                own = symbols[shared + doc[shared]] - lex.own
                drawn = np.bincount(doc[shared], logs[shared] - np.log10(lex.shared_mass)[own], hi - lo).astype(float)
                rare = np.flatnonzero(at < 0)
                of_rare = np.concatenate(([0], np.cumsum(np.bincount(doc[rare], minlength=hi - lo)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        batch.column("held_out").slice(lo, hi - lo),
                        pa.array(words.counts.astype(np.int64) + 1),
                        pa.array(np.bincount(doc[known], minlength=hi - lo).astype(np.int64)),
                        pa.array(np.bincount(doc, logs, hi - lo).astype(float)),
                        pa.array(drawn),
                        pa.ListArray.from_arrays(pa.array(of_rare), pa.array(hashes[rare].view(np.int64))),
                        pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((2 * of).astype(np.int32)), pa.py_buffer(symbols.astype(np.uint16))]),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "logs", "drawn", "rare", "symbols"],
                )

    return run


def _read(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Encoded texts lo..hi: their symbols and ranges."""
    raw, offs = column_bytes(column)
    for lo, hi in pieces(offs, PIECE // 3):
        yield lo, hi, raw[offs[lo] : offs[hi]].view(np.uint16), (offs[lo : hi + 1] - offs[lo]) // 2


def _expect(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        k = len(m.first)
        rows = np.zeros((m.emits.shape[0] + k + 1, k))
        for batch in batches:
            for _, _, symbols, of in _read(batch.column("symbols")):
                first, moved, emitted = forward_backward(symbols, of, m)
                rows += np.vstack([emitted, moved, first])
        some = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some)] + [pa.array(np.ascontiguousarray(rows[some, s])) for s in range(k)], ["row", *(f"g{s}" for s in range(k))])

    return run


def _maximise(rows: np.ndarray, unigram: np.ndarray, k: int) -> Model:
    """The model of expected counts; a little of the unigram keeps every emission above 0."""
    n = len(unigram)
    emitted, moved, first = rows[:n], rows[n : n + k], rows[n + k]
    emits = emitted + 20.0 * unigram[:, None]
    return Model((first + 1) / (first + 1).sum(), (moved + 1) / (moved + 1).sum(1, keepdims=True), (emits / emits.sum(0)).astype(np.float32))


def _start(unigram: np.ndarray) -> Model:
    """Start values: a random split of the whole corpus's unigram, states that tend to stay."""
    rng = np.random.default_rng(5)
    emits = unigram[:, None] * (0.3 + rng.random((len(unigram), STATES)))
    moves = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(moves, 0.9)
    return Model(np.full(STATES, 1 / STATES), moves, (emits / emits.sum(0)).astype(np.float32))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            rest = batch.schema.names[:-1]
            for lo, hi, symbols, of in _read(batch.column("symbols")):
                score = pa.array(log10_likelihood(symbols, of, m))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in rest), score], [*rest, "likelihood"])

    return run


def learn_lexicon(texts: DataFrame) -> tuple[DataFrame, Lexicon, np.ndarray]:
    """``texts(text binary)`` -> table of word counts ``(h, tail, c)``, lexicon, and each symbol's share of the tokens."""
    counts = texts.mapInArrow(_counts, "h long, tail int, c long").groupBy("h").agg(F.min("tail").alias("tail"), F.sum("c").alias("c"))
    counts = written(counts, "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the frequent words: all above a count, found by a histogram of bins of counts (a few thousand rows), so that no task sends the driver its own first HELD
    words = counts.where(F.col("tail") >= 0).withColumn("bin", F.floor(F.log2("c") * BINS))
    bins = words.groupBy("bin").agg(F.count("*").alias("n")).orderBy(F.desc("bin")).collect()
    above = np.cumsum([r.n for r in bins])
    least = min([r.bin for r, n in zip(bins, above) if n <= HELD], default=1 << 30)
    top = words.where(F.col("bin") >= least).select("h", "tail", "c").toPandas()  # HELD rows at most
    top = top.sort_values(["c", "h"], ascending=[False, True], ignore_index=True)
    own = np.arange(len(top)) < OWN
    by_tail = {r.tail: (r.n, r.v) for r in counts.where("tail >= 0").groupBy("tail").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}  # SHARED rows at most
    mass = np.array([sum(by_tail.get(t, (0, 0))) + 1.0 for t in range(SHARED)])
    head = top[: int(own.sum())]
    mass -= np.bincount(head["tail"], head.c + 1.0, SHARED)
    lexicon = Lexicon(top.h.to_numpy(np.int64), top.c.to_numpy(np.int64), np.where(own, np.arange(len(top)), -1), OWN, mass, int(total), int(distinct))
    # what each symbol has of all tokens: words of their own, shared ones, the end
    unigram = np.full(OWN + SHARED + 1, 0.01)
    unigram[: len(head)] += head.c
    unigram[OWN : OWN + SHARED] += [by_tail.get(t, (0, 0))[0] for t in range(SHARED)] - np.bincount(head["tail"], head.c, SHARED)
    ends = counts.where("tail < 0").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    unigram[-1] += ends
    unigram /= unigram.sum()
    return counts, lexicon, unigram


def train(encoded: DataFrame, unigram: np.ndarray) -> Model:
    """``encoded(symbols)`` -> the model after SWEEPS sweeps over all rows."""
    spark = encoded.sparkSession
    model = _start(unigram)
    for _ in range(SWEEPS):
        schema = "row long, " + ", ".join(f"g{s} double" for s in range(STATES))
        sums = encoded.select("symbols").mapInArrow(_expect(spark.sparkContext.broadcast(model)), schema)
        sums = sums.groupBy("row").agg(*[F.sum(f"g{s}").alias(f"g{s}") for s in range(STATES)]).toPandas()  # symbols + states + 1 rows at most
        rows = np.zeros((len(unigram) + STATES + 1, STATES))
        if len(sums):
            rows[sums.row.to_numpy()] = sums.drop(columns="row").to_numpy()
        model = _maximise(rows, unigram, STATES)
    return model


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    One row for each row of ``docs``; learns from rows that are not ``held_out`` (null: not held out). Tokens are words
    ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and one end. ``base_score`` is the add-one unigram's log10
    probability, ``score`` the hidden Markov model's. A null text is empty: one token. No training rows at all
    leave the start values. Repeated rows count and are scored each; other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counts, lexicon, unigram = learn_lexicon(base.where(~F.col("held_out")).select("text"))
    kind = dict(docs.dtypes)["doc_id"]
    first = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, logs double, drawn double, rare array<long>"
    encoded = base.mapInArrow(_encode(spark.sparkContext.broadcast(lexicon)), f"{first}, symbols binary")
    encoded = written(encoded.withColumn("row", F.monotonically_increasing_id()), "encoded")
    model = train(encoded.where(~F.col("held_out")), unigram)
    narrow = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "drawn", "symbols")
    scored = narrow.mapInArrow(_score(spark.sparkContext.broadcast(model)), f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, logs double, drawn double, likelihood double")
    # words whose counts no task holds are looked up by a join
    rare = encoded.select("row", F.explode("rare").alias("h")).join(counts.select("h", "c"), "h")
    rare = rare.groupBy("row").agg(F.count("*").alias("rare_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("rare_logs"))
    end = counts.where("tail < 0").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    none = F.lit(0.0)
    logs = F.col("logs") + F.coalesce("rare_logs", none) + F.lit(float(np.log10(end + 1)))
    return scored.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(end > 0))).alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(lexicon.tokens + lexicon.distinct + 1)))).alias("base_score"),
        (F.col("likelihood") + F.col("drawn") + F.coalesce("rare_logs", none)).alias("score"),
    )
