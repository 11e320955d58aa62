"""Toxicity by weak supervision.

Many voters look at a text: lexicon entries (words and beginnings of words) and patterns. A generative label model gives each voter's
accuracy on either class and the correlations that remain between voters within a class; labelled rows are anchored,
the others take part by their posterior. Its posterior labels train a linear classifier, which scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import written
from .words import U, column_bytes, mix, pieces, span_hashes

#: Lexicon voters.
LEXICON = 320
EM_SWEEPS = 3
PREFIXES = (4, 5, 6, 7, 8)
PATTERNS = ("exclaims", "shouts", "symbols", "digits", "repeats", "hits", "hit_share", "strong_share")
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_VALUES = np.random.default_rng(9).integers(1, 2**63, 256, dtype=np.uint64)[_LOW]


class Runs:
    """Letter runs of some texts and the hashes of the features each has: its beginnings and the whole."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        letter = _LETTER[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[offs] = True
        start, end = letter.copy(), letter.copy()
        start[1:] &= ~letter[:-1] | cut[1:-1]
        end[:-1] &= ~letter[1:] | cut[1:-1]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.doc = np.searchsorted(offs, self.starts, side="right") - 1
        self.values = _VALUES[raw]

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index of the run and hash of the feature; for the beginnings first, then whole runs."""
        sizes = self.ends - self.starts
        for p in PREFIXES:
            long = np.flatnonzero(sizes > p)
            yield long, span_hashes(self.values, self.starts[long], self.starts[long] + p) ^ U(p)
        all_ = np.flatnonzero(sizes >= 3)
        yield all_, span_hashes(self.values, self.starts[all_], self.ends[all_])


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offs = column_bytes(batch.column("text"))
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for lo, hi in pieces(offs, 4 << 20):
            runs = Runs(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            docs, hashes = zip(*((runs.doc[i], h) for i, h in runs.features()))
            both = np.unique(np.stack([np.concatenate(hashes).view(np.int64), np.concatenate(docs).astype(np.int64)]), axis=1)
            distinct, inverse = np.unique(both[0], return_inverse=True)
            y = toxic[lo:hi][both[1]]
            yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(np.bincount(inverse, y, len(distinct)).astype(np.int64)), pa.array(np.bincount(inverse, 1 - y, len(distinct)).astype(np.int64))], ["h", "a", "b"])


def mine_lexicon(docs: DataFrame, labels: DataFrame, mined: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features that speak most for the label (sorted), and which of them clean texts hardly have; from ``mined`` labelled rows of each class at most."""
    picked = [labels.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id")).limit(mined) for y in (1, 0)]
    picked = F.broadcast(picked[0].union(picked[1]))  # 2 * mined rows at most
    some = docs.join(picked, "doc_id").select(F.col("text").cast("binary").alias("text"), "toxic")
    found = some.mapInArrow(_mine, "h long, a long, b long").groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ones, zeros = (some.where(F.col("toxic") == y).count() + 1.0 for y in (1, 0))
    odds = F.log((F.col("a") + 0.5) / (ones - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (zeros - F.col("b") + 0.5))
    spread = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = found.where(F.col("a") >= 3).select("h", "a", "b", (odds / spread).alias("z"), odds.alias("odds")).where("odds > 1").orderBy(F.desc("z"), "h").limit(LEXICON).toPandas()
    best = best.sort_values("h")
    return best.h.to_numpy(np.int64), (best.b / zeros < 0.004).to_numpy(bool)


def _vote(lexicon: np.ndarray, strong: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = column_bytes(batch.column("text"))
            for lo, hi in pieces(offs):
                part, at = raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                runs = Runs(part, at)
                n = hi - lo
                pairs, hit, strong_hit = [], np.zeros(len(runs.starts), bool), np.zeros(len(runs.starts), bool)
                for i, h in runs.features():
                    if len(lexicon) and len(i):
                        h = h.view(np.int64)
                        place = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
                        good = np.flatnonzero(lexicon[place] == h)
                        hit[i[good]] = True
                        strong_hit[i[good[strong[place[good]]]]] = True
                        pairs.append(runs.doc[i[good]] * len(lexicon) + place[good])
                pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
                doc = pairs // max(1, len(lexicon))
                of = np.searchsorted(doc, np.arange(n + 1))
                words = np.maximum(np.bincount(runs.doc, minlength=n), 1)
                sizes = np.maximum(np.diff(at), 1)
                per = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[at])
                hits, strongs = np.bincount(runs.doc[hit], minlength=n), np.bincount(runs.doc[strong_hit], minlength=n)
                capital = (part >= 65) & (part <= 90)
                same = np.zeros(len(part), bool)
                same[2:] = (part[2:] == part[1:-1]) & (part[1:-1] == part[:-2]) & _LETTER[part[2:]]
                marks = np.stack(
                    [
                        per(part == 33) / words,
                        per(capital) / sizes,
                        per(np.isin(part, np.frombuffer(b"#*$%&|<>", np.uint8))) / sizes,
                        per((part >= 48) & (part <= 57)) / sizes,
                        per(same) / sizes,
                        np.minimum(np.log1p(hits) / 3, 1),
                        np.minimum(100 * hits / words, 8) / 8,
                        np.minimum(100 * strongs / words, 8) / 8,
                    ],
                    1,
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, n),
                        pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.array((pairs % max(1, len(lexicon))).astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, n * marks.shape[1] + 1, marks.shape[1], dtype=np.int32)), pa.array(marks.ravel())),
                    ],
                    ["doc_id", "votes", "marks"],
                )

    return run


def _matrix(batch: pa.RecordBatch, m: int) -> np.ndarray:
    """Votes and pattern measures of a batch, a row for each text."""
    votes = batch.column("votes")
    rows = np.repeat(np.arange(batch.num_rows), votes.value_lengths().to_numpy())
    out = np.zeros((batch.num_rows, m + len(PATTERNS)))
    out[rows, votes.flatten().to_numpy()] = 1
    out[:, m:] = batch.column("marks").flatten().to_numpy().reshape(-1, len(PATTERNS))
    return out


def _ballots(x: np.ndarray, m: int) -> np.ndarray:
    """Every voter's vote, 1 or 0: lexicon entries, and patterns above a level."""
    p = x[:, m:]
    levels = np.stack([p[:, 0] > 0.2, p[:, 1] > 0.3, p[:, 2] > 0.05, p[:, 3] > 0.1, p[:, 4] > 0.01] + [p[:, 6] > s / 8 for s in (0.2, 0.5, 1, 1.5, 2)] + [p[:, 7] > s / 8 for s in (0, 0.2, 0.5, 1)], 1)
    return np.hstack([x[:, :m], levels])


class LabelModel:
    """Rates at which voters fire on either class, the class prior, and the covariance of votes within a class."""

    def __init__(self, on: np.ndarray, off: np.ndarray, prior: float, within: np.ndarray):
        self.on, self.off, self.prior = on, off, prior
        # correlated voters share their weight: the best linear rule under the covariance that remains within classes
        self.weights = np.linalg.solve(within + 0.01 * np.eye(len(on)), on - off)
        centre = self.weights @ (on - off)
        self.middle = self.weights @ (on + off) / 2
        self.scale = 1.0 if centre <= 0 else min(1.0, 40.0 / centre)

    def posterior(self, ballots: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (ballots @ self.weights - self.middle) + np.log(self.prior / (1 - self.prior)), -30, 30)))


def _moments(model, m: int):
    """Sums that the label model needs: by class, how many texts, votes, and votes together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                ballots = _ballots(_matrix(part, m), m)
                y = part.column("toxic").to_numpy(zero_copy_only=False).astype(float)
                guess = model.value.posterior(ballots) if model is not None else np.full(len(y), np.nan)
                p = np.where(np.isnan(y), guess, y)
                use = ~np.isnan(p)
                ballots, p = ballots[use], p[use]
                sums = np.concatenate([np.concatenate(([w.sum()], w @ ballots, ((ballots * w[:, None]).T @ ballots).ravel())) for w in (p, 1 - p)])
                total = sums if total is None else total + sums
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()])], ["slot", "sums"])

    return run


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in table.column("sums").combine_chunks())
    return pa.table({"slot": table.column("slot")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


#: Arrays of tasks that are added in one group.
FAN_IN = 16


def added(sums: DataFrame, tasks: int) -> np.ndarray:
    """The sum of arrays ``slot, sums`` that ``tasks`` tasks made, one each at most: in rounds, so that no group holds more than FAN_IN of them."""
    while tasks > FAN_IN:
        sums = sums.withColumn("slot", F.floor(F.col("slot") / FAN_IN)).groupBy("slot").applyInArrow(_add, "slot long, sums binary")
        tasks = -(-tasks // FAN_IN)
    return sum((np.frombuffer(r.sums) for r in sums.select("sums").collect()), np.float64(0))  # FAN_IN rows at most


def _fit_labels(votes: DataFrame, m: int) -> LabelModel:
    spark = votes.sparkSession
    v = _ballots(np.zeros((1, m + len(PATTERNS))), m).shape[1]
    model = None
    for _ in range(EM_SWEEPS):
        held = None if model is None else spark.sparkContext.broadcast(model)
        made = votes.mapInArrow(_moments(held, m), "slot long, sums binary")
        total = np.zeros(2 * (1 + v + v * v)) + added(made, made.rdd.getNumPartitions())
        one, zero = np.split(total, 2)
        n1, n0 = one[0] + 1, zero[0] + 1
        on, off = (one[1 : v + 1] + 0.5) / n1, (zero[1 : v + 1] + 0.5) / n0
        within = ((one[v + 1 :] + zero[v + 1 :]).reshape(v, v) - n1 * np.outer(on, on) - n0 * np.outer(off, off)) / (n1 + n0)
        model = LabelModel(on, off, n1 / (n1 + n0), within + np.diag(0.02 + np.maximum(on, off) * 0.1))
    return model


def _fit_linear(x: np.ndarray, p: np.ndarray, ridge: float = 1.0, steps: int = 12, block: int = 2000) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps, block by block; the last weight is the constant."""
    n = x.shape[1] + 1
    w = np.zeros(n)
    penalty = np.full(n, ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        h, g = np.diag(penalty), -penalty * w
        for lo in range(0, len(x), block):
            part = np.hstack([x[lo : lo + block], np.ones((len(x[lo : lo + block]), 1))])
            q = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            h += (part * (q * (1 - q))[:, None]).T @ part
            g += part.T @ (p[lo : lo + block] - q)
        w = w + np.linalg.solve(h, g)
    return w


def _predict(weights: np.ndarray, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4000):
                part = batch.slice(lo, 4000)
                z = _matrix(part, m) @ weights[:-1] + weights[-1]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    return run


def _fit(docs: DataFrame, labels: DataFrame, held_out: Column | None, mined: int, fitted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, DataFrame | None]:
    """Lexicon, which of it is strong, weights, and the votes of every row (none where there is nothing to learn)."""
    taught = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    if held_out is not None:
        taught = taught.where(~held_out)
    taught = written(taught.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")), "taught")
    n, ones = taught.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if ones == 0 or ones == n:
        none = np.zeros(len(PATTERNS) + 1)
        none[-1] = 30.0 if ones else -30.0
        return np.zeros(0, np.int64), np.zeros(0, bool), none, None
    lexicon, strong = mine_lexicon(docs, taught, mined)
    m, kind = len(lexicon), dict(docs.dtypes)["doc_id"]
    votes = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_vote(lexicon, strong), f"doc_id {kind}, votes array<int>, marks array<double>")
    votes = written(votes, "votes")
    side = votes if held_out is None else votes.where(~held_out)
    known = written(side.join(taught, "doc_id", "left").select("doc_id", "votes", "marks", "toxic"), "known")
    model = _fit_labels(known.select("votes", "marks", "toxic"), m)
    # a bounded sample of labelled rows; what they teach is the label model's posterior
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, fitted / n))
    batch = known.where(F.col("toxic").isNotNull() & drawn).select("votes", "marks").limit(fitted).toArrow().combine_chunks()
    if not batch.num_rows:  # none of the labelled documents is there
        return np.zeros(0, np.int64), np.zeros(0, bool), np.append(np.zeros(len(PATTERNS)), -30.0), None
    x = np.empty((batch.num_rows, m + len(PATTERNS)), np.float32)
    p = np.empty(batch.num_rows)
    at = 0
    for part in batch.to_batches(max_chunksize=2000):
        rows = _matrix(part, m)
        x[at : at + len(rows)], p[at : at + len(rows)] = rows, model.posterior(_ballots(rows, m))
        at += len(rows)
    return lexicon, strong, _fit_linear(x, p), votes


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, mined: int = 4000, fitted: int = 20_000) -> DataFrame:
    """``docs(doc_id, text)``, ``labels(doc_id, toxic)`` -> ``doc_id, score, predicted``, one row for each row of ``docs``.

    ``score`` (0 to 1, higher: likelier toxic) depends on the text alone. Labels are learnt from rows that
    are not ``held_out`` (a condition on doc_id; default: none is held out); null labels and null ids teach nothing, contradicting ones count as toxic.
    Texts that are null, empty or without letters have no votes and get the score of such texts, a low one. Without any label of
    one of the classes every score is about 0, or about 1 where all labels are toxic. The lexicon is mined from ``mined`` labelled rows of each class at most and the
    classifier fitted on the posterior labels of ``fitted`` labelled rows at most, drawn by hash; the label model sums over all rows that aren't held out. Repeated rows get a row each; other columns are ignored.
    """
    lexicon, strong, weights, votes = _fit(_texts(docs), labels, held_out, mined, fitted)
    kind = dict(docs.dtypes)["doc_id"]
    if votes is None:
        votes = _texts(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_vote(lexicon, strong), f"doc_id {kind}, votes array<int>, marks array<double>")
    scored = votes.mapInArrow(_predict(weights, len(lexicon)), f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _clean(lexicon: np.ndarray, strong: np.ndarray, weights: np.ndarray):
    vote, m = _vote(lexicon, strong), len(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), batch.column("text")], ["doc_id", "text"])
            z = [_matrix(part, m) @ weights[:-1] + weights[-1] for part in vote(iter([texts]))]
            if z:
                yield batch.filter(pa.array(np.concatenate(z) < 0))

    return run


def without_toxic(docs: DataFrame, labels: DataFrame, mined: int = 4000, fitted: int = 20_000) -> DataFrame:
    """The rows of ``docs`` whose score is under 0.5; all columns stay as they are.

    A null text scores as an empty one; rows with a null or repeated doc_id are scored by their own text; repeated rows all stay or all go. An empty table
    gives an empty table, labels without rows leave all documents.
    """
    lexicon, strong, weights, _ = _fit(_texts(docs), labels, None, mined, fitted)
    return docs.mapInArrow(_clean(lexicon, strong, weights), docs.schema)
