"""Connected components of an undirected graph: local forests, then alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import written

#: Links of a partition that one task contracts before any are shuffled.
LOCAL_LINKS = 500_000


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(id, root)``, root the smallest id reachable.

    Each partition of at most about LOCAL_LINKS links is first contracted to stars by its own task; if there is but one, those are the components. Then large-star
    and small-star steps: each links the neighbours of a vertex to the smallest of them, so a hub's
    links are summed as a minimum before the shuffle and joined back, never gathered. Rounds grow with the logarithm of
    the longest path. Loops and repeated links are dropped; no edges give no rows.
    """
    links = written(edges.select("a", "b").where("a <> b"), "links")
    parts = max(1, -(-links.count() // LOCAL_LINKS))
    links = written(links.coalesce(parts).mapInArrow(_stars, "a long, b long"), "links")
    before = None
    for _ in range(most_rounds if parts > 1 else 0):
        links = written(_small(_large(links)), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
    else:
        if parts > 1:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # settled: every link goes from a vertex to its root
    return links.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    )


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition as stars around the smallest id of each of its components."""
    pairs = [np.stack([b.column(c).to_numpy() for c in ("a", "b")], 1) for b in batches]
    ids, at = np.unique(np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64), return_inverse=True)
    root = np.arange(len(ids))
    at = at.reshape(-1, 2)
    while len(at):
        low = np.minimum(root[at[:, 0]], root[at[:, 1]])
        for side in (0, 1):
            np.minimum.at(root, root[at[:, side]], low)
        while (jumped := root[root] != root).any():
            root[jumped] = root[root[jumped]]
        at = at[root[at[:, 0]] != root[at[:, 1]]]
    rest = np.flatnonzero(root != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[rest]), pa.array(ids[root[rest]])], ["a", "b"])


def _large(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is linked to the smallest of its neighbours and itself."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small(links: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    return (
        links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
    )
