"""How far the word use of sources lies apart, exactly.

Counts of terms are levels. For a block of terms, indicator columns for each (source, level) make a
0/1 matrix; multiplied by its transpose, block by block, it holds for each two sources the joint
table of how many terms have one level here and another there. A divergence that depends on the two
levels alone is then priced once for each cell of a table instead of once for each term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from .scratch import written
from .words import column_bytes, pieces

LEAST_DOCUMENTS = 10
TERMS_A_BLOCK = 2048
TERMS_AT_ONCE = 256
COLUMNS_AT_ONCE = 1024
TOP = 10
_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
PIECE = 1 << 23


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (text, lang, source) -> for each piece of a batch (lang, source, term) with occurrences and documents."""
    for batch in batches:
        raw, offs = column_bytes(batch.column(0))
        labels = pa.StructArray.from_arrays([batch.column(1), batch.column(2)], ["lang", "source"])
        groups: dict[tuple, int] = {}
        group = np.array([groups.setdefault((x["lang"], x["source"]), len(groups)) for x in labels.to_pylist()], np.int64)
        names = list(groups)
        for lo, hi in pieces(offs, PIECE):
            part, at = raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            inside = _TERM[part]
            cut = np.zeros(len(part) + 1, bool)
            cut[at] = True
            start = inside.copy()
            start[1:] &= ~inside[:-1] | cut[1:-1]
            begins = np.flatnonzero(start)
            if not len(begins):
                continue
            # the terms' bytes one after the other, so that each distinct term is found by its bytes
            place = np.cumsum(inside) - 1
            sizes = np.append(place[begins], inside.sum()).astype(np.int64)
            data = pa.py_buffer(_LOWER[part[inside]].tobytes())
            terms = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(sizes.tobytes()), data]).dictionary_encode()
            term = terms.indices.to_numpy().astype(np.int64)
            row = np.searchsorted(at, begins, side="right") - 1
            n = len(terms.dictionary)
            once = np.unique(row * n + term)
            cells, documents = np.unique(group[lo + once // n] * n + once % n, return_counts=True)
            occurrences = np.bincount(np.searchsorted(cells, group[lo + row] * n + term), minlength=len(cells))
            owner = [names[g] for g in (cells // n).tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in owner], pa.string()),
                    pa.array([x[1] for x in owner], pa.string()),
                    pc.cast(terms.dictionary.take(pa.array(cells % n)), pa.binary()).cast(pa.string()),
                    pa.array(occurrences.astype(np.int64)),
                    pa.array(documents.astype(np.int64)),
                ],
                ["lang", "source", "term", "n", "documents"],
            )


def term_counts(docs: DataFrame) -> DataFrame:
    """``docs(text, lang, source)`` without nulls -> ``lang, source, term, n, documents``."""
    rows = docs.select("text", "lang", "source").mapInArrow(_counted, "lang string, source string, term string, n long, documents long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def price(n: int, total: int, kept: int) -> int:
    """A term's share in parts of 10**9, smoothed, from 1."""
    return 1 + 1_000_000_000 * (n + 2) // (total + 2 * kept)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whole part of (p - q)**2 / (p + q); p and q are at most 10**9 + 1, so 64 bits hold it."""
    return (p - q) ** 2 // (p + q)


def joint_values(counts: np.ndarray, totals: list[int], kept: int) -> np.ndarray:
    """``counts`` (terms x sources) -> for each two sources the divergences summed over the terms (sources x sources)."""
    width = counts.shape[1]
    out = np.zeros((width, width), np.int64)
    for at in range(0, len(counts), TERMS_AT_ONCE):
        block = counts[at : at + TERMS_AT_ONCE]
        # one indicator column for each level that a source has in this block
        columns, levels, owner = [], [], []
        for s in range(width):
            level, place = np.unique(block[:, s], return_inverse=True)
            columns.append(place + len(levels))
            levels += [price(int(x), totals[s], kept) for x in level]
            owner += [s] * len(level)
        prices, owner = np.array(levels, np.int64), np.array(owner)
        hot = np.zeros((len(block), len(levels)), np.float32)
        hot[np.arange(len(block))[:, None], np.stack(columns, 1)] = 1
        # sums of at most TERMS_AT_ONCE ones are exact in single precision
        for a in range(0, len(levels), COLUMNS_AT_ONCE):
            for b in range(a, len(levels), COLUMNS_AT_ONCE):
                tables = hot[:, a : a + COLUMNS_AT_ONCE].T @ hot[:, b : b + COLUMNS_AT_ONCE]
                i, j = np.nonzero(tables)
                value = divergence(prices[a + i], prices[b + j]) * tables[i, j].astype(np.int64)
                i, j = owner[a + i], owner[b + j]
                np.add.at(out, (i, j), value)
                if b > a:
                    np.add.at(out, (j, i), value)
    return out


def _block(key: tuple, terms: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """Sums of each two sources over a block of terms, and each source's best terms of the block."""
    lang = key[0]
    sources = sources.sort_values("source")
    names, totals, kept = sources["source"].tolist(), [int(x) for x in sources["total"]], int(sources["kept"].iloc[0]) if len(sources) else 0
    number = {s: i for i, s in enumerate(names)}
    counts = np.zeros((len(terms), len(names)), np.int64)
    for i, (source, n) in enumerate(zip(terms["sources"], terms["counts"])):
        counts[i, [number[s] for s in source]] = n
    values = joint_values(counts, totals, kept)
    out = [(lang, a, "pair", b, int(values[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i != j]
    if len(terms):
        words = terms["term"].tolist()
        whole = sum(totals)
        q = np.array([price(int(x), whole, kept) for x in counts.sum(axis=1)], np.int64)
        for i, a in enumerate(names):
            level, place = np.unique(counts[:, i], return_inverse=True)
            p = np.array([price(int(x), totals[i], kept) for x in level], np.int64)[place]
            more = np.flatnonzero((counts[:, i] > 0) & (p > q))
            value = divergence(p[more], q[more])
            # those above the tenth value, and all that equal it
            if len(value) > TOP:
                more = more[value >= np.partition(value, -TOP)[-TOP]]
                value = divergence(p[more], q[more])
            best = sorted(zip((-value).tolist(), (words[x].encode() for x in more.tolist())))[:TOP]
            out += [(lang, a, "term", word.decode(), -v) for v, word in best]
    return pd.DataFrame(out, columns=["lang", "source", "part", "item", "value"])


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``docs(text, lang, source)`` -> ``lang, source, part, item, value, rank``.

    A null text, lang or source is ''. Terms are runs of ASCII letters and of all characters beyond ASCII, A-Z lower-cased; a lang keeps those
    in at least ``least`` of its documents. Part ``pair`` has each other source of the lang, part ``term`` the ten terms that set a source apart
    from its lang most, the largest value first, equal ones by UTF-8. Every (lang, source) of a row counts, those without terms too: a lang
    without kept terms has pairs of value 0, a lang of one source no pairs. Repeated rows count each time; ids play no part, and other
    columns are ignored. An empty table gives no rows.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counted = term_counts(docs)
    terms = (
        counted.groupBy("lang", "term")
        .agg(F.sum("documents").alias("documents"), F.collect_list(F.struct("source", "n")).alias("by"))  # a row a source at most
        .where(F.col("documents") >= least)
        .select("lang", "term", F.col("by.source").alias("sources"), F.col("by.n").alias("counts"))
    )
    terms = written(terms, "divergence-terms")
    totals = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("total"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("kept"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("kept") / TERMS_A_BLOCK)).cast("int")
    groups = docs.groupBy("lang", "source").agg(F.count("*").alias("rows")).join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"))
    # every source of a lang meets every block of its terms
    groups = groups.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = terms.join(kept, "lang").select("lang", F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block"), "term", "sources", "counts")
    schema = "lang string, source string, part string, item string, value long"
    parts = placed.groupBy("lang", "block").cogroup(groups.groupBy("lang", "block")).applyInPandas(_block, schema)
    summed = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    pairs, words = (summed.where(F.col("part") == x).withColumn("rank", rank) for x in ("pair", "term"))
    return pairs.unionByName(words.where(F.col("rank") <= TOP))  # tasks cut the terms before they shuffle them
