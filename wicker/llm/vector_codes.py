"""Codes of vectors by product quantisation, with cover trees in place of exhaustive assignment.

Vectors become whole numbers and are cut into equal parts; each part position has a codebook that
Lloyd's rounds move. Blocks of vectors are turned into one cover tree for each part position, once:
a node stands for a range of the block's points in tree order, its centre is the first of them, and
sums over a range come from cumulative sums. In each round a node whose nearest entry is nearer by
more than the node's diameter goes to that entry with all its points; other nodes pass on the entries
that are still possible, and only points of leaves that stay ambiguous are compared one by one. The
trees only save comparisons: codes
and codebooks are those of the exhaustive rule.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
BLOCK = 8192
LEAF = 8
#: Whole numbers are held within these bounds, so that sums of squares fit 64 bits.
BOUND = 1 << 26


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each size, one after the other."""
    return np.repeat(begin - starts(sizes), sizes) + np.arange(sizes.sum())


class CoverTrees:
    """One tree for each part position of a block of vectors. A node's children are a net of its points at the largest power of two below its
    radius: each point lies within that of its child's centre, and centres of children lie farther apart.

    ``order`` lists the points (vector times PARTS plus part) in tree order; node i holds order[lo[i]:hi[i]] within ``radius[i]`` of its
    first point, and its children are the nodes child[i]:child[i + 1].
    """

    def __init__(self, points: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius: np.ndarray, child: np.ndarray, order: np.ndarray):
        self.points, self.lo, self.hi, self.radius, self.child, self.order = points, lo, hi, radius, child, order

    @classmethod
    def build(cls, vectors: np.ndarray) -> CoverTrees:
        n, width = vectors.shape
        points = vectors.reshape(n * PARTS, width // PARTS)
        order = np.arange(n * PARTS).reshape(n, PARTS).T.reshape(-1)
        points = points[order]
        lo, hi = [np.arange(PARTS) * n], [np.arange(1, PARTS + 1) * n]
        own = np.repeat(lo[0], n)
        far = squared(points, points[own])
        radius = [np.sqrt(np.maximum.reduceat(far, lo[0]).astype(np.float64))]
        child = []
        made = PARTS
        at, to, r = lo[0], hi[0], radius[0]
        while len(at):
            split = (to - at > LEAF) & (r > 0)
            scale = np.exp2(np.ceil(np.log2(r[split])) - 1)  # the largest power of two below the radius
            inside = np.zeros(len(points) + 1, np.int64)
            np.add.at(inside, at[split], 1)
            np.add.at(inside, to[split], -1)
            all_open = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
            all_node = np.searchsorted(at[split], all_open, side="right") - 1
            # the first point of a node that no centre covers becomes a centre, until all are covered
            centre = np.full(len(points), -1, np.int64)
            left, node = all_open, all_node
            while len(left):
                fresh = np.concatenate(([True], node[1:] != node[:-1]))
                head = left[fresh][np.cumsum(fresh) - 1]
                covered = squared(points[left], points[head]) <= scale[node] ** 2
                centre[left[covered]] = head[covered]
                left, node = left[~covered], node[~covered]
            rank = np.lexsort((all_open, centre[all_open], all_node))
            moved = all_open[rank]
            ids = centre[moved]
            points[all_open], order[all_open] = points[moved], order[moved]
            first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, np.int64)
            end = np.append(first[1:], len(ids)) if len(ids) else first
            count = np.zeros(len(at), np.int64)
            count[np.flatnonzero(split)] = np.bincount(all_node[first], minlength=int(split.sum())) if len(ids) else 0
            child.append(made + np.concatenate(([0], np.cumsum(count)))[:-1])
            if not len(ids):
                break
            at, to = all_open[first], all_open[end - 1] + 1
            far = squared(points[all_open], points[np.repeat(at, end - first)])
            r = np.sqrt(np.maximum.reduceat(far, first).astype(np.float64))
            lo.append(at)
            hi.append(to)
            radius.append(r)
            made += len(at)
        lo, hi, radius = np.concatenate(lo), np.concatenate(hi), np.concatenate(radius)
        return cls(points, lo, hi, radius, np.append(np.concatenate(child), made), order)

    @classmethod
    def read(cls, row: dict, width: int) -> CoverTrees:
        n = len(row["ids"])
        points = np.frombuffer(row["points"], np.int32).reshape(n * PARTS, width // PARTS).astype(np.int64)
        nodes = np.frombuffer(row["nodes"], np.int64).reshape(4, -1)
        return cls(points, nodes[0, :-1], nodes[1, :-1], nodes[2, :-1].view(np.float64), nodes[3], np.frombuffer(row["order"], np.int64))

    def bytes(self) -> tuple[bytes, bytes, bytes]:
        pad = lambda x: np.append(x, np.zeros(1, x.dtype)).view(np.int64)
        nodes = np.stack((pad(self.lo), pad(self.hi), pad(self.radius), self.child))
        return self.points.astype(np.int32).tobytes(), nodes.tobytes(), self.order.astype(np.int64).tobytes()

    def assign(self, books: np.ndarray) -> tuple[np.ndarray, int]:
        """The entry of each point in tree order, and how many distances to entries were taken."""
        entry = np.empty(len(self.points), np.int64)
        per = len(self.points) // PARTS
        nodes, compared = np.arange(PARTS), 0
        wanted, counts = np.tile(np.arange(books.shape[1]), PARTS), np.full(PARTS, books.shape[1])
        while len(nodes):
            at, radius = self.lo[nodes], self.radius[nodes]
            of = np.repeat(np.arange(len(nodes)), counts)
            d = squared(self.points[at][of], books[(at // per)[of], wanted])
            compared += len(d)
            least = np.minimum.reduceat(d, starts(counts))
            # by the triangle inequality, with room for rounding: no point of the node is nearest to an entry that fails this
            may = np.sqrt(d) <= (np.sqrt(least) * (1 + 1e-9) + 2 * radius + 1e-6)[of]
            may &= (radius > 0)[of] | (d == least[of])
            of, wanted = of[may], wanted[may]
            counts = np.bincount(of, minlength=len(nodes))
            whole = (counts == 1) | (radius == 0)
            only = wanted[starts(counts)[whole]]  # entries ascend, so the first of equals
            sizes = self.hi[nodes][whole] - at[whole]
            entry[ranges(at[whole], sizes)] = np.repeat(only, sizes)
            wanted, nodes, counts = wanted[~whole[of]], nodes[~whole], counts[~whole]
            children = self.child[nodes + 1] - self.child[nodes]
            leaf = children == 0
            # points of ambiguous leaves, each with the entries that are left
            points, sizes = self.lo[nodes[leaf]], (self.hi - self.lo)[nodes[leaf]]
            alone, among = ranges(points, sizes), np.repeat(counts[leaf], sizes)
            some = wanted[ranges(np.repeat(starts(counts)[leaf], sizes), among)]
            if len(alone):
                of = np.repeat(np.arange(len(alone)), among)
                d = squared(self.points[alone][of], books[(alone // per)[of], some])
                compared += len(d)
                best = np.flatnonzero(d == np.minimum.reduceat(d, starts(among))[of])
                first = np.concatenate(([True], of[best][1:] != of[best][:-1]))
                entry[alone] = some[best[first]]
            inner = ~leaf
            below = children[inner]
            wanted = wanted[ranges(np.repeat(starts(counts)[inner], below), np.repeat(counts[inner], below))]
            nodes, counts = ranges(self.child[nodes[inner]], below), np.repeat(counts[inner], below)
        return entry, compared

    def sums(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Points and component sums of each entry, from cumulative sums over runs of one entry."""
        entry, compared = self.assign(books)
        per, entries, width = len(self.points) // PARTS, books.shape[1], books.shape[2]
        slot = np.arange(len(entry)) // per * entries + entry
        begin = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        total = np.concatenate((np.zeros((1, width), np.int64), np.cumsum(self.points, axis=0)))
        end = np.append(begin[1:], len(slot))
        counts, sums = np.zeros(PARTS * entries, np.int64), np.zeros((PARTS * entries, width), np.int64)
        np.add.at(counts, slot[begin], end - begin)
        np.add.at(sums, slot[begin], total[end] - total[begin])
        return counts, sums, compared


def _build(names: tuple[str, ...], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block(rows: pa.Table) -> pa.RecordBatch:
            vectors = rows.column("vector").combine_chunks()
            trees = CoverTrees.build(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), -1))
            points, nodes, order = trees.bytes()
            lists = [pa.array([rows.column(c).to_pylist()], schema.field(at).type) for at, c in enumerate(names)]
            return pa.RecordBatch.from_arrays([*lists, *(pa.array([x], pa.binary()) for x in (points, nodes, order))], schema=schema)

        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) >= BLOCK:
                rows = pa.Table.from_batches(held)
                yield block(rows.slice(0, BLOCK))
                held = rows.slice(BLOCK).to_batches()
        if sum(map(len, held)):
            yield block(pa.Table.from_batches(held))

    return run


def _rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[dict, CoverTrees]]:
    for batch in batches:
        for row in batch.to_pylist():
            yield row, CoverTrees.read(row, width)


def _round(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, part = books.shape[1], books.shape[2]
        counts, sums, compared, points = np.zeros(PARTS * entries, object), np.zeros((PARTS * entries, part), object), 0, 0
        for _, trees in _rows(batches, PARTS * part):
            c, s, n = trees.sums(books)
            counts, sums, compared, points = counts + c, sums + s, compared + n, points + len(trees.points)
        if points:
            # position -1: how many points; slot -1: distances taken and points
            slot = [x for i in range(PARTS * entries) for x in [i] * (part + 1)] + [-1, -1]
            position = [x for _ in range(PARTS * entries) for x in range(-1, part)] + [-1, 0]
            value = [str(int(x)) for i in range(PARTS * entries) for x in (counts[i], *sums[i])] + [str(compared), str(points)]
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(position, pa.int32()), pa.array(value)], ["slot", "position", "value"])

    return run


def _codes(books: np.ndarray, types: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, trees in _rows(batches, PARTS * books.shape[2]):
            entry, _ = trees.assign(books)
            per = len(row["ids"])
            error = squared(trees.points, books[np.arange(len(entry)) // per, entry])
            code, total = np.empty(len(entry), np.uint8), np.zeros(per, np.int64)
            code[trees.order] = entry
            np.add.at(total, trees.order // PARTS, error)
            texts = code.tobytes().hex()
            texts = [texts[i : i + 2 * PARTS] for i in range(0, len(texts), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], types[0]), pa.array(row["labels"], types[1]), pa.array(texts), pa.array(total)], ["vec_id", "label", "code", "error"])

    return run


class Codebooks:
    """Trained codebooks (PARTS x entries x width), and what share of the comparisons of points with entries each round made."""

    def __init__(self, books: np.ndarray, shares: list[float]):
        self.books, self.shares = books, shares

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows that are coded, with ``vector`` as whole numbers: no null, no null or non-finite component, not empty."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(finite)
    whole = F.transform(vector, lambda x: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.floor(F.least(F.lit(2.0**40), F.greatest(F.lit(-(2.0**40)), x.cast("double"))) * 256))).cast("int"))
    return rows.withColumn(vector, whole)


def train(vectors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> tuple[Codebooks, DataFrame]:
    """Codebooks of ``vectors`` and the table of their trees (a row a block)."""
    spark = vectors.sparkSession
    rows = usable(vectors, vector).select(F.col(key).alias("ids"), F.col(label).alias("labels"), F.col(vector).alias("vector"))
    smallest = rows.select("ids", "vector").orderBy(F.asc_nulls_last("ids"), "vector")
    names = ("ids", "labels")
    kinds = dict(rows.dtypes)
    ddl = f"ids array<{kinds['ids']}>, labels array<{kinds['labels']}>, points binary, nodes binary, order binary"
    first = smallest.first()
    if first is None:
        return Codebooks(np.zeros((PARTS, 0, 0), np.int64), []), spark.createDataFrame([], ddl)
    width = len(first.vector)
    if width % PARTS:
        raise ValueError(f"vectors of {width} components cannot be cut into {PARTS} equal parts")
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark.createDataFrame([], ddl).schema)
    rows = rows.where(F.size("vector") == width)
    trees = written(rows.mapInArrow(_build(names, schema), ddl), "cover-trees")
    start = np.array([r.vector for r in smallest.where(F.size("vector") == width).limit(ENTRIES).collect()], np.int64)  # 64 rows at most
    books, shares = start.reshape(len(start), PARTS, width // PARTS).transpose(1, 0, 2).copy(), []
    for _ in range(ROUNDS):
        summed = trees.mapInArrow(_round(books), "slot int, position int, value string").groupBy("slot", "position").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
        got = {(r.slot, r.position): int(r.value) for r in summed.collect()}  # one value for each component of the codebooks
        shares.append(got[-1, -1] / (got[-1, 0] * len(start)))
        flat = books.reshape(PARTS * books.shape[1], -1)
        for slot in range(len(flat)):
            if n := got[slot, -1]:
                flat[slot] = [got[slot, j] // n for j in range(flat.shape[1])]
        books = flat.reshape(books.shape)
    return Codebooks(books, shares), trees


def vector_codes(vectors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """``vectors(key, vector, label)`` -> ``vec_id, code, error, label_error, codebooks_sha256``, one row for each usable row.

    Rows whose vector is null or empty or has a null or non-finite component are dropped, and those whose length is not that of the
    smallest key's vector; that length must be a multiple of 16. Components become floor(256 * x), held within 2**26 either way. Codebooks
    start from the 64 smallest keys of these (null keys last, equal keys by vector; fewer rows make fewer entries). Repeated rows get a row each,
    null labels are one label. An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    model, trees = train(vectors, key, label, vector)
    kinds = dict(vectors.dtypes)
    ddl = f"vec_id {kinds[key]}, label {kinds[label]}, code string, error long"
    from pyspark.sql.pandas.types import to_arrow_schema

    types = to_arrow_schema(spark.createDataFrame([], ddl).schema).types[:2]
    coded = written(trees.mapInArrow(_codes(model.books, types), ddl), "vector-codes") if model.books.size else spark.createDataFrame([], ddl)
    errors = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(errors, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(model.sha256).alias("codebooks_sha256"))
