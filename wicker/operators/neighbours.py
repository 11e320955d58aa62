"""Exact nearest neighbours with pruning (F5, G6): pivots cut the vectors into cells, and the triangle inequality of angles leaves most cells out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import cosine, unit
from ..functions.joins import joined
from ..session import saved
from .graph import basket_scores, top_k
from .represent import vector_sums

#: Vectors of a block at most, and how many blocks there are at least where each still holds ``FEWEST``.
BLOCK, BLOCKS, FEWEST = 32_768, 16, 1_024
MOST_PIVOTS = 1024
#: Room for rounding in comparisons of angles, in radians (an angle near 0 is known to about 1e-8).
SLACK = 1e-6
#: Queries of hybrid scores that meet a block of vectors in one piece.
A_PIECE = 20_000
#: Cosines that are taken in one product.
A_PRODUCT = 1 << 22


def _matrix(column) -> np.ndarray:
    """A column of vectors as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(x) @ _unit(y).T, -1, 1))


class Cells:
    """Pivots, each cell's smallest and largest angle and size, and which blocks it lies in: near cells lie in one block, large cells in several."""

    def __init__(self, poles: np.ndarray, stats: np.ndarray) -> None:
        self.poles, self.stats = poles, stats
        n = stats[:, 2].sum() if len(stats) else 0
        self.blocks = int(max(1, -(-n // BLOCK), min(BLOCKS, n // FEWEST)))
        self.lo, self.hi = np.zeros(len(poles), int), np.zeros(len(poles), int)
        angles, left, at = (_angles(poles, poles) if len(poles) else None), np.ones(len(poles), bool), 0
        before, share = 0, max(1.0, n / self.blocks)
        for _ in range(len(poles)):  # from each cell on to the nearest that is left
            left[at] = False
            after = before + stats[at, 2]
            self.lo[at] = min(self.blocks - 1, int(before // share))
            self.hi[at] = max(self.lo[at], min(self.blocks - 1, int(-(-after // share)) - 1))
            before = after
            if left.any():
                at = int(np.where(left, angles[at], np.inf).argmin())

    def block(self, cell: str, key: str):
        """The block of a row as a column."""
        if not len(self.poles):
            return F.lit(0)
        lo, hi = (F.element_at(F.array(*[F.lit(int(b)) for b in x]), F.col(cell) + 1) for x in (self.lo, self.hi))
        return lo + F.pmod(F.xxhash64(key), hi - lo + 1).cast("int")

    def near(self, angles: np.ndarray, reach: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Which of some cells may hold a vector within each query's reach."""
        least, most, n = self.stats[cells].T
        return (n > 0) & (angles - most <= reach[:, None] + SLACK) & (least - angles <= reach[:, None] + SLACK)


def _placed(rows: DataFrame, poles: np.ndarray) -> DataFrame:
    """Vectors with their nearest pivot and its angle, as a table."""
    key, kind = rows.dtypes[0]

    def nearest_pivot(batches):
        for batch in batches:
            if batch.num_rows:
                angles = _angles(_matrix(batch.column(1)), poles)
                cell = angles.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(cell)), cell])], [key, "vec", "cell", "angle"])

    return saved(rows.mapInArrow(nearest_pivot, f"{key} {kind}, vec array<double>, cell int, angle double"), "cells")


def _nonzero(vectors: DataFrame) -> DataFrame:
    return vectors.select("item_id", F.transform("vec", lambda x: x.cast("double")).alias("vec")).where(F.exists("vec", lambda x: x != 0))


def in_cells(vectors: DataFrame, pivots: int | None = None) -> tuple[DataFrame, Cells]:
    """``item_id, vec, cell, angle, block`` as a table, and the cells.

    Pivots are vectors drawn by hash, about the root of their number and at most ``MOST_PIVOTS``; a vector belongs to the nearest one. Zero vectors are left out.
    """
    rows = _nonzero(vectors)
    if pivots is None:
        pivots = int(min(MOST_PIVOTS, max(1, rows.count() ** 0.5)))
    drawn = [r.vec for r in rows.orderBy(F.xxhash64("item_id"), "item_id").limit(pivots).collect()]  # ``pivots`` rows at most
    poles = np.array(drawn, np.float64).reshape(len(drawn), -1 if drawn else 0)
    placed = _placed(rows, poles)
    stats = np.zeros((len(poles), 3))
    stats[:, 0] = np.inf
    for r in placed.groupBy("cell").agg(F.min("angle"), F.max("angle"), F.count("*")).collect():  # a row a pivot
        stats[r[0]] = r[1:]
    cells = Cells(poles, stats)
    return placed.withColumn("block", cells.block("cell", "item_id")), cells


class _Best:
    """The k best members of a block for each query: positions of members that ascend by id, and cosines to nine decimals. ``same``: the first member with a member's id, ``own``: that with the query's, or -1."""

    def __init__(self, queries: np.ndarray, members: np.ndarray, same: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> None:
        self.u, self.v, self.same, self.own, self.k = queries, members, same, own, k
        self.u32, self.v32 = queries.astype(np.float32), members.astype(np.float32)
        self.least = least.copy()
        self.cosine, self.at = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1)
        self.compared = np.zeros(len(queries), np.int64)
        #: What a product in single precision may be off by.
        self.off = 1e-9 + 1.2e-7 * (queries.shape[1] + 8)

    def meet(self, rows: np.ndarray, cols: np.ndarray) -> None:
        """Compare some queries with some members."""
        if not len(cols):
            return
        step = max(1, A_PRODUCT // len(cols))
        for i in range(0, len(rows), step):
            self._some(rows[i : i + step], cols)

    def _some(self, rows: np.ndarray, cols: np.ndarray) -> None:
        mine = (self.own[rows] >= 0) & np.isin(self.own[rows], self.same[cols])
        self.compared[rows] += len(cols) - mine
        row = col = None
        if (self.least[rows] > -1.5).all():  # a first look in single precision, what passes is compared in full
            row, col = np.nonzero(self.u32[rows] @ self.v32[cols].T >= (self.least[rows] - self.off).astype(np.float32)[:, None])
            if len(row) * 64 > len(rows) * len(cols) + 65_536:
                row = None
        if row is not None:
            cosine = np.round(np.einsum("ij,ij->i", self.u[rows[row]], self.v[cols[col]]), 9)
        else:
            every = np.round(self.u[rows] @ self.v[cols].T, 9)
            every[(self.own[rows][:, None] == self.same[cols]) | np.isnan(every)] = -np.inf
            k = min(self.k, len(cols))
            last = np.partition(every, len(cols) - k, axis=1)[:, len(cols) - k, None]
            tied = every == last
            row, col = np.nonzero((every > last) | (tied & (np.cumsum(tied, axis=1) <= k)))  # ties by position
            cosine = every[row, col]
        good = (cosine >= self.least[rows[row]]) & (cosine > -np.inf) & (self.same[cols[col]] != self.own[rows[row]])
        self._add(rows[row[good]], cols[col[good]], cosine[good])

    def _add(self, row: np.ndarray, at: np.ndarray, cosine: np.ndarray) -> None:
        if not len(row):
            return
        some = np.unique(row)
        row = np.concatenate([row, np.repeat(some, self.k)])
        at, cosine = np.concatenate([at, self.at[some].ravel()]), np.concatenate([cosine, self.cosine[some].ravel()])
        order = np.lexsort((at, -cosine, row))
        row, at, cosine = row[order], at[order], cosine[order]
        begin = np.searchsorted(row, some)
        take = begin[:, None] + np.arange(self.k)
        self.at[some], self.cosine[some] = at[take], cosine[take]
        self.least[some] = np.maximum(self.least[some], self.cosine[some, -1])

    def reach(self) -> np.ndarray:
        return np.where(self.least > -1.5, np.arccos(np.clip(self.least, -1, 1)), np.pi)


def _compared(k: int, schema: pa.Schema, cells: Cells, first: bool):
    """The k best of a block for each query of a piece, and on the first of these how many it was compared with. A cell that can't hold a better one is not compared."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (len(left) and len(right)):
            return schema.empty_table()
        right = right.sort_by("item_id")
        ids, names = right["item_id"].combine_chunks(), left["a"].combine_chunks()
        same, own = (pc.index_in(x, value_set=ids).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for x in (ids, names))  # the first row with that id
        cell = right["cell"].to_numpy()
        order = np.argsort(cell, kind="stable")
        here, begin = np.unique(cell[order], return_index=True)
        members = np.split(order, begin[1:])
        vectors = _matrix(left["v"])
        angles = _angles(vectors, cells.poles[here])
        best = _Best(_unit(vectors), _unit(_matrix(right["vec"])), same, own, left["least"].to_numpy(), k)
        done = np.zeros(angles.shape, bool)
        if first:  # the nearest cells that surely hold k others
            near, size = np.argsort(angles, axis=1, kind="stable"), np.array([len(m) for m in members])
            before = np.cumsum(size[near], axis=1) - size[near]
            np.put_along_axis(done, near, before < k + 1, axis=1)
            for c, m in enumerate(members):
                best.meet(np.flatnonzero(done[:, c]), m)
        for c in np.argsort(angles.mean(axis=0)):
            rows = np.flatnonzero(~done[:, c])
            reach = best.reach()[rows]
            best.meet(rows[cells.near(angles[rows][:, [c]], reach, here[[c]])[:, 0]], members[c])
        row, rank = np.nonzero(best.at >= 0)
        compared = np.where(rank == 0, best.compared[row], 0)
        out = pa.Table.from_arrays([names.take(pa.array(row)), ids.take(pa.array(best.at[row, rank])), pa.array(best.cosine[row, rank]), pa.array(compared)], schema=schema)
        # what was compared in vain counts as well
        vain = np.flatnonzero((best.at[:, 0] < 0) & (best.compared > 0))
        nobody = pa.nulls(len(vain), schema.field(1).type)
        return pa.concat_tables([out, pa.Table.from_arrays([names.take(pa.array(vain)), nobody, pa.nulls(len(vain), pa.float64()), pa.array(best.compared[vain])], schema=schema)])

    return run


def _visits(cells: Cells):
    """The blocks behind their own that may hold a neighbour within the reach of a piece's queries."""

    def run(batches):
        every = np.arange(len(cells.poles))
        for batch in batches:
            if not batch.num_rows:
                continue
            angles = _angles(_matrix(batch.column("v")), cells.poles)
            least = batch.column("least").to_numpy(zero_copy_only=False)
            near = cells.near(angles, np.where(least > -1.5, np.arccos(np.clip(least, -1, 1)), np.pi), every)
            go = np.stack([near[:, (cells.lo <= b) & (b <= cells.hi)].any(axis=1) for b in range(cells.blocks)], 1)
            go[np.arange(len(go)), batch.column("own").to_numpy()] = False
            row, block = np.nonzero(go)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("a", "v", "least", "piece")), pa.array(block.astype(np.int32))], ["a", "v", "least", "piece", "block"])

    return run


def pivot_neighbours(vectors: DataFrame, k: int, queries: DataFrame | None = None, pivots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The k nearest others of each query by cosine to nine decimals, ties by id, and the work it took. Tables: item_id, vec.

    Queries are dealt over pieces and vectors over blocks, near ones together. A piece first meets the block it lies in, then, with the reach known by then, the
    other blocks that may hold a neighbour; it meets a block's cells as products of matrices. So vectors are shuffled once for each piece or block, not for
    each cell, and no task holds more than a piece, a block and ``A_PRODUCT`` cosines.

    Neighbours: ``a, b, cosine, rank``. Work: ``a, compared``, how many vectors a query was compared with. Zero vectors have no neighbours and are none.
    """
    members, cells = in_cells(vectors, pivots)
    kind = dict(members.dtypes)["item_id"]
    ddl = f"a {kind}, b {kind}, cosine double, compared long"
    schema = to_arrow_schema(members.sparkSession.createDataFrame([], ddl).schema)
    asked, splits = members, 1
    if queries is not None:
        asked = _placed(_nonzero(queries), cells.poles) if len(cells.poles) else members
        splits = max(1, -(-asked.count() // (cells.blocks * BLOCK)))
        asked = asked.withColumn("block", cells.block("cell", "item_id"))
    split = F.pmod(F.xxhash64("item_id", F.lit(1)), F.lit(splits)).cast("int")
    asked = asked.select(F.col("item_id").alias("a"), F.col("vec").alias("v"), F.col("block").alias("own"), (F.col("block") * splits + split).alias("piece"))
    held = members.select("item_id", "vec", "cell", "block")

    def meet(rows: DataFrame, first: bool, pieces) -> DataFrame:
        met = held.withColumn("piece", F.explode(pieces))
        return rows.groupBy("piece", "block").cogroup(met.groupBy("piece", "block")).applyInArrow(_compared(k, schema, cells, first), ddl)

    own = asked.select("a", "v", F.lit(-2.0).alias("least"), "piece", F.col("own").alias("block"))
    first = saved(meet(own, True, F.sequence(F.col("block") * splits, F.col("block") * splits + (splits - 1))), "nearest")
    known = top_k(first.where("b is not null"), ["a"], "cosine", "b", k).groupBy("a").agg(F.when(F.count("*") >= k, F.min("cosine")).otherwise(-2.0).alias("least"))
    more = asked.join(known, "a", "left").select("a", "v", F.coalesce("least", F.lit(-2.0)).alias("least"), "own", "piece")
    more = more.mapInArrow(_visits(cells), f"a {kind}, v array<double>, least double, piece int, block int")
    both = saved(first.unionByName(meet(more, False, F.sequence(F.lit(0), F.lit(cells.blocks * splits - 1)))), "nearest") if cells.blocks > 1 else first
    near = top_k(both.where("b is not null"), ["a"], "cosine", "b", k).select("a", "b", "cosine", "rank")
    return near, both.groupBy("a").agg(F.sum("compared").alias("compared"))


def nearest(vectors: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """The k nearest neighbours of each query, itself excluded (F5): ``a, b, cosine, rank``."""
    return pivot_neighbours(vectors, k, queries)[0]


def mean_vectors(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """The mean direction of each query's items: ``query_id, items, v``; queries without a known vector have none."""
    known = vectors.select(F.col("item_id").alias("a"), unit("vec").alias("vec"))
    rows = joined(queries.select("query_id", F.explode("items").alias("a")), known, "a")
    return vector_sums(rows, ["query_id"]).join(queries.select("query_id", "items"), "query_id").select("query_id", "items", F.col("vec").alias("v"))


def hybrid_scores(queries: DataFrame, edges: DataFrame, vectors: DataFrame, beta: float = 0.5, least: float = -0.15, staples: DataFrame | None = None, blocks: int = 16) -> DataFrame:
    """Candidates for each basket by the sum of their edges to it and ``beta`` times the cosine with its mean direction (G11): ``query_id, item_id, score``.

    A stated query set meets every vector: few vectors are broadcast, more are dealt over ``blocks`` and queries over pieces of ``A_PIECE``, so that no task
    reads more than a piece and a block. Items of the basket and ``staples`` (item_id) are no candidates; an item without edges counts 0 for
    them, one without a vector 0 for the cosine.
    """
    vectors, queries = saved(vectors.select("item_id", "vec"), "vectors"), saved(queries.select("query_id", "items"), "queries")
    means = mean_vectors(queries, vectors)
    if vectors.count() <= FEWEST:
        met = means.crossJoin(F.broadcast(vectors))  # FEWEST rows at most
    else:
        pieces = max(1, -(-queries.count() // A_PIECE))
        part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        held = vectors.select("item_id", "vec", part("item_id", blocks).alias("block"), every(pieces).alias("piece"))
        met = means.withColumn("piece", part("query_id", pieces)).withColumn("block", every(blocks)).join(held, ["block", "piece"])
    near = met.where(~F.array_contains("items", F.col("item_id"))).select("query_id", "item_id", cosine("v", "vec").alias("cosine"))
    both = basket_scores(queries, edges, least).select("query_id", "item_id", F.col("score").alias("graph")).join(near, ["query_id", "item_id"], "full")
    if staples is not None:
        both = both.join(staples.select("item_id"), "item_id", "left_anti")
    return both.select("query_id", "item_id", F.round(F.coalesce("graph", F.lit(0.0)) + beta * F.coalesce("cosine", F.lit(0.0)), 6).alias("score"))
