"""Document fingerprints by winnowing.

Every run of ``K`` code points is hashed by a rolling polynomial; of every ``WINDOW`` consecutive
hashes the smallest is selected, of equal ones the rightmost. Two texts that share a run of
``WINDOW + K - 1`` code points share a selected hash, and its positions tell where.

Of a text whose first two thirds are shorter than that every hash is selected, and of one whose first
two thirds are shorter than a gram those of grams of half the size too, and so on, so that a text and
a copy with another last third always share a hash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import U, powers, span_hashes

K = 16
WINDOW = 48
#: The shortest grams of short texts.
LEAST_K = 2
#: Ranges of documents at most, and keys drawn for each to find where it begins.
MOST_BUCKETS, DRAWN = 10_000, 20


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Selected 32-bit hashes and their positions (of first code points), by position."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    values = points.astype(np.uint64) * U(0x9E3779B97F4A7C15) + U(0x632BE59BD9B4E019)
    if n - n // 3 < window + k - 1:
        return _all_grams(values, k)
    grams = max(n - k + 1, 1)
    at = np.arange(grams)
    hashes = span_hashes(values, at, np.minimum(at + k, n)) >> U(32)
    # smallest hash and, among equals, largest position: one integer orders both
    least = hashes << U(32) | U(0xFFFFFFFF) - at.astype(np.uint64)
    width = min(window, grams)
    done = 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    chosen = least[np.concatenate(([True], least[1:] != least[:-1]))]
    chosen = chosen[np.concatenate(([True], chosen[1:] != chosen[:-1]))]
    where = (U(0xFFFFFFFF) - (chosen & U(0xFFFFFFFF))).astype(np.int64)
    return chosen >> U(32), where


def _all_grams(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams of a short text, those of half the size too where two thirds of the text don't hold a gram."""
    n = len(values)
    sizes = [k]
    while sizes[-1] > LEAST_K and n - n // 3 < sizes[-1]:
        sizes.append(max(sizes[-1] // 2, LEAST_K))
    hashes, where = [], []
    for size in [x for x in sizes if x <= n] or [n]:
        at = np.arange(n - size + 1)
        hashes.append(span_hashes(values, at, at + size) >> U(32))
        where.append(at)
    hashes, where = np.concatenate(hashes), np.concatenate(where)
    order = np.argsort(where, kind="stable")
    return hashes[order], where[order]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of selected hashes; of two empty ones 1."""
    a, b = np.unique(a), np.unique(b)
    both = len(a) + len(b)
    if not both:
        return 1.0
    common = int(np.isin(a, b, assume_unique=True).sum())
    return common / (both - common)


def written_out(hashes: np.ndarray, where: np.ndarray) -> str:
    return " ".join([f"{p}:{h:08x}" for p, h in zip(where.tolist(), hashes.tolist())])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in order; the guest that ends a bucket is the first text of the next. A bucket of equal rows needs none."""
    held: dict = {}
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    shape = None

    def made(out: dict[str, list]) -> Iterator[pa.RecordBatch]:
        if out["doc_id"]:
            yield pa.RecordBatch.from_arrays([pa.array(v) if c != "doc_id" else pa.array(v, shape) for c, v in out.items()], list(out))

    for batch in batches:
        out: dict[str, list] = {c: [] for c in names}
        shape = batch.schema.field("doc_id").type
        columns = [batch.column(c).to_pylist() for c in ("bucket", "copy", "doc_id", "text", "guest")]
        for bucket, copy, doc_id, text, guest in zip(*columns):
            text = text or ""
            if held and held["bucket"] != (bucket, copy) and held["bucket"][1]:
                _one(held, held["text"], held["own"], out)
                held = {}
            own = winnow(text)
            if held and held["bucket"] == (bucket, copy):
                _one(held, text, own, out)
            held = {} if guest else {"bucket": (bucket, copy), "doc_id": doc_id, "text": text, "own": own}
        yield from made(out)
    if held and held["bucket"][1]:
        out = {c: [] for c in names}
        _one(held, held["text"], held["own"], out)
        yield from made(out)


def _one(held: dict, after: str, after_own, out: dict[str, list]) -> None:
    text = held["text"]
    n = len(text)
    third = n // 3
    edited = text[: n - third] + after[:third]
    changed = winnow(edited)
    for name, value in (
        ("doc_id", held["doc_id"]),
        ("n_chars", n),
        ("edited_sha256", hashlib.sha256(edited.encode()).hexdigest()),
        ("fingerprint", written_out(*held["own"])),
        ("edited_fingerprint", written_out(*changed)),
        ("near_edited", likeness(held["own"][0], changed[0])),
        ("near_next", likeness(held["own"][0], after_own[0])),
    ):
        out[name].append(value)


def _key(doc_id, th) -> tuple:
    """Sorts null ids first."""
    return (doc_id is not None, doc_id if doc_id is not None else 0, th)


def _places(bounds: list[tuple], copies: list[int], first: tuple):
    """Where a row goes: its bucket (0 has the largest ids), its bucket of copies (0: none), and the buckets in which it is a guest.

    ``bounds``: sorted keys of rows that exist. Each heads a bucket, so it is the guest of the bucket before. ``copies``: over how many
    buckets the rows equal to a bound are dealt. ``first``, the first row of all, is the guest of the last bucket.
    """
    m = len(bounds)

    def place(doc_ids: pa.Array, hashes: pa.Array) -> pa.Array:
        out, met = [], Counter()
        for x in map(_key, doc_ids.to_pylist(), hashes.to_pylist()):
            i = bisect_left(bounds, x)
            bound = i < m and bounds[i] == x
            own, copy, guests = m - i, 0, []
            if bound:
                guests.append(own - 1)
                # the first of a batch always stays, so that the bucket keeps its head
                copy = met[x] % copies[i]
                met[x] += 1
            if x == first:
                guests.append(m)
            out.append({"bucket": own, "copy": copy, "guests": [] if copy else guests})
        return pa.array(out, pa.struct([("bucket", pa.int32()), ("copy", pa.int32()), ("guests", pa.list_(pa.int32()))]))

    return place


def fingerprint_neighbours(docs: DataFrame, rows_per_bucket: int = 4000) -> DataFrame:
    """``docs(doc_id, text)`` -> each text's winnowing fingerprint, and how like it is to an edited
    text (its last third gives way to the beginning of the next document's text) and to the next document.

    Next is by descending doc_id, null last, then by text; after the last comes the first, which
    for a single row is that row. A null text is empty: it has an empty fingerprint, and two empty
    fingerprints are alike by 1. A text shorter than the shortest gram is one gram. Repeated rows get a row
    each. Documents are dealt over at most MOST_BUCKETS ranges of doc_id and text, each with the first text of the next range, so that no
    task sorts them all; a row that is repeated more often than a range has rows is dealt over several. The ranges begin at rows drawn from
    a sample of at most about MOST_BUCKETS * DRAWN keys. Other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "th")
    n, first = rows.agg(F.count("*"), F.max(order)).first()
    buckets = min(MOST_BUCKETS, n // rows_per_bucket)
    drawn = []
    if buckets > 1:
        drawn = sorted(_key(*r) for r in rows.select("doc_id", "th").sample(min(1.0, DRAWN * buckets / n), seed=7).collect())  # bounded: see above
    often = Counter(drawn[len(drawn) * i // buckets] for i in range(1, buckets)) if drawn else Counter()
    bounds = sorted(often)
    place = F.arrow_udf(_places(bounds, [often[x] for x in bounds], _key(first.doc_id, first.th) if n else ()), "bucket int, copy int, guests array<int>")
    placed = rows.withColumn("at", place("doc_id", "th"))
    own = F.array(F.struct(F.col("at.bucket").alias("bucket"), F.col("at.copy").alias("copy"), F.lit(False).alias("guest")))
    guest = F.transform("at.guests", lambda b: F.struct(b.alias("bucket"), F.lit(0).alias("copy"), F.lit(True).alias("guest")))
    dealt = placed.select("doc_id", "th", "text", F.explode(F.concat(own, guest)).alias("x")).select("x.*", "doc_id", "th", "text")
    parts = max(8, 2 * buckets)
    ordered = dealt.repartition(parts, "bucket", "copy").sortWithinPartitions("bucket", "copy", "guest", F.desc_nulls_last("doc_id"), F.desc("th"))
    kind = dict(docs.dtypes)["doc_id"]
    return ordered.select("bucket", "copy", "doc_id", "text", "guest").mapInArrow(
        _rows, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
