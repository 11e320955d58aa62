"""Matrices that outgrow one machine: inverses of blocked tables, and singular vectors of sparse ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..functions.arrays import FAN_IN
from ..functions.columns import draw
from ..functions.ranges import places
from ..session import saved

#: Rows and columns of a block: two megabytes of numbers.
BLOCK = 512


def blocked(cells: DataFrame, items: DataFrame, diagonal: float = 0.0, size: int = BLOCK) -> tuple[DataFrame, DataFrame, int]:
    """A square matrix ``cells(a, b, value)`` over ``items(item_id)`` as dense blocks ``i, j, block``, with ``diagonal`` added; the items' places; blocks a side."""
    index = saved(places(items.select("item_id").distinct(), ["item_id"], "place").select("item_id", (F.col("place") - 1).alias("place")), "places")
    n = index.count()
    side = max(1, -(-n // size))
    a, b = (index.select(F.col("item_id").alias(c), F.col("place").alias(f"at_{c}")) for c in "ab")
    placed = cells.join(a, "a").join(b, "b").select(F.floor(F.col("at_a") / size).cast("int").alias("i"), F.floor(F.col("at_b") / size).cast("int").alias("j"), (F.col("at_a") % size).cast("int").alias("row"), (F.col("at_b") % size).cast("int").alias("col"), F.col("value").cast("double").alias("value"))
    grid = cells.sparkSession.range(side * side).select(F.floor(F.col("id") / side).cast("int").alias("i"), (F.col("id") % side).cast("int").alias("j"))

    def dense(cell: pa.Table, spot: pa.Table) -> pa.Table:
        i, j = spot["i"][0].as_py(), spot["j"][0].as_py()
        x = np.zeros((min(size, n - i * size), min(size, n - j * size)))
        np.add.at(x, (cell["row"].to_numpy(), cell["col"].to_numpy()), cell["value"].to_numpy())
        if i == j:
            x[np.diag_indices(len(x))] += diagonal
        return pa.table({"i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "block": pa.array([x.tobytes()], pa.binary())})

    return saved(placed.groupBy("i", "j").cogroup(grid.groupBy("i", "j")).applyInArrow(dense, "i int, j int, block binary"), "blocks"), index, side


def inverse(blocks: DataFrame, side: int) -> DataFrame:
    """The inverse of a positive definite matrix in blocks ``i, j, block``, by a step for each diagonal block (Gauss-Jordan; no pivots are needed).

    In a step every block meets its row's and its column's block of the step's panels; the blocks of a step are a table, so a lost executor costs a part of one step. Nothing
    passes through the driver.
    """
    for k in range(side):
        pivot = blocks.where((F.col("i") == k) & (F.col("j") == k)).select(F.col("block").alias("pivot"))
        left = blocks.where(F.col("j") == k).select("i", F.col("block").alias("left"))
        above = blocks.where(F.col("i") == k).select("j", F.col("block").alias("above"))

        def step(batches, k=k):
            for batch in batches:
                out = []
                for i, j, *parts in zip(*(batch.column(c).to_pylist() for c in range(6))):
                    x, p, c, r = (np.frombuffer(y) for y in parts)
                    p = np.linalg.inv(p.reshape(round(len(p) ** 0.5), -1))
                    m = len(p)
                    c, r = c.reshape(-1, m), r.reshape(m, -1)
                    if i == k:
                        y = p if j == k else p @ r
                    else:
                        y = -c @ p if j == k else x.reshape(len(c), -1) - c @ (p @ r)
                    out.append(y.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["i", "j", "block"])

        met = blocks.join(left, "i").join(above, "j").crossJoin(F.broadcast(pivot))  # one block
        blocks = saved(met.select("i", "j", "block", "pivot", "left", "above").mapInArrow(step, "i int, j int, block binary"), "blocks")
    return blocks


def autoencoder_cells(blocks: DataFrame, index: DataFrame, size: int = BLOCK) -> DataFrame:
    """Weights of the linear autoencoder from the inverse's blocks: ``a, b, weight``, each column over its negative diagonal, no diagonal."""

    def cells(batches):
        for batch in batches:
            for i, j, x, d in zip(*(batch.column(c).to_pylist() for c in range(4))):
                d = np.frombuffer(d)
                d = np.diag(d.reshape(round(len(d) ** 0.5), -1))
                x = np.frombuffer(x).reshape(-1, len(d)) / -d
                if i == j:
                    x = x.copy()
                    np.fill_diagonal(x, 0)
                row, col = np.nonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array(row + i * size), pa.array(col + j * size), pa.array(x[row, col])], ["at_a", "at_b", "weight"])

    diagonal = blocks.where("i = j").select("j", F.col("block").alias("diagonal"))
    rows = blocks.join(diagonal, "j").select("i", "j", "block", "diagonal").mapInArrow(cells, "at_a long, at_b long, weight double")
    a, b = (index.select(F.col("item_id").alias(c), F.col("place").alias(f"at_{c}")) for c in "ab")
    return rows.join(a, "at_a").join(b, "at_b").select("a", "b", "weight")


def _products(cells: DataFrame, vectors: DataFrame, on: str, to: str) -> DataFrame:
    """A sparse matrix, or its transpose, times a table of rows: sums of value * vec over ``on``, by ``to``; batches are summed before they are shuffled."""
    key = dict(cells.dtypes)[to]

    def local(batches):
        for batch in batches:
            if batch.num_rows:
                keys = batch.column(0).dictionary_encode()
                vec = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                sums = np.zeros((len(keys.dictionary), vec.shape[1]))
                np.add.at(sums, keys.indices.to_numpy(zero_copy_only=False), vec * batch.column(1).to_numpy(zero_copy_only=False)[:, None])
                yield pa.RecordBatch.from_arrays([keys.dictionary, pa.array(list(sums), pa.list_(pa.float64()))], [to, "vec"])

    met = cells.join(vectors, on).select(to, F.col("value").cast("double"), "vec").mapInArrow(local, f"`{to}` {key}, vec array<double>")
    parts = met.select(to, F.posexplode("vec").alias("i", "x")).groupBy(to, "i").agg(F.sum("x").alias("x"))
    return parts.groupBy(to).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p")).select(to, F.col("p.x").alias("vec"))


def triangular_factor(rows: DataFrame) -> np.ndarray:
    """R of the QR decomposition of all rows' ``vec``: each task factors its own, factors are stacked and factored again in rounds of fixed fan-in."""

    def factor(x: np.ndarray) -> pa.Array:
        return pa.array([np.linalg.qr(x, mode="r").tobytes()], pa.binary())

    width = len(rows.first().vec)

    def own(batches):
        r = np.zeros((0, width))
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                r = np.linalg.qr(np.vstack([r, x]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), factor(r)], ["slot", "r"])

    def stacked(group: pa.Table) -> pa.Table:
        return pa.table({"slot": group["slot"][:1], "r": factor(np.vstack([np.frombuffer(x).reshape(-1, width) for x in group["r"].to_pylist()]))})

    made = rows.select("vec").mapInArrow(own, "slot long, r binary")
    tasks = made.rdd.getNumPartitions()
    while tasks > FAN_IN:
        made = made.withColumn("slot", F.floor(F.col("slot") / FAN_IN)).groupBy("slot").applyInArrow(stacked, "slot long, r binary")
        tasks = -(-tasks // FAN_IN)
    return np.linalg.qr(np.vstack([np.frombuffer(x.r).reshape(-1, width) for x in made.select("r").collect()]), mode="r")  # FAN_IN small squares at most


def _times(rows: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
    """Each row's ``vec`` times a small matrix."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) @ matrix
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], [key, "vec"])

    return rows.select(key, "vec").mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, vec array<double>")


def _orthonormal(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose columns are an orthonormal basis of the columns' span; dependent columns go."""
    for _ in range(2):  # a second time for what rounding left
        _, s, v = np.linalg.svd(triangular_factor(rows), full_matrices=False)
        keep = s > 1e-11 * s[0]
        rows = saved(_times(rows, key, v[keep].T / s[keep]), "basis")
    return rows


def singular_vectors(cells: DataFrame, d: int, more: int = 16, sweeps: int = 12, within: float = 1e-9) -> tuple[DataFrame, np.ndarray]:
    """Left singular vectors of ``cells(a, b, value)`` and the ``d`` largest singular values: ``a, vec`` with unit columns.

    A random range of d + ``more`` columns, turned by the matrix and its transpose until the values move by less than ``within`` of the largest, or ``sweeps`` times. Only
    squares of d + ``more`` reach the driver. Fewer columns or a lower rank give fewer values; all zero cells give none.
    """
    cells = saved(cells.select("a", "b", "value").where("value <> 0"), "cells")
    seeds = F.transform(F.sequence(F.lit(1), F.lit(d + more)), lambda j: draw(F.concat_ws("-", "b", j.cast("string")), 61) - 0.5)
    right = cells.select("b").distinct().withColumn("vec", seeds)
    if right.first() is None:
        return cells.select("a", F.array().cast("array<double>").alias("vec")), np.zeros(0)
    before = None
    for _ in range(sweeps):
        left = _orthonormal(saved(_products(cells, right, "b", "a"), "left"), "a")
        turned = saved(_products(cells, left, "a", "b"), "right")
        _, s, v = np.linalg.svd(triangular_factor(turned), full_matrices=False)
        if before is not None and np.abs(s[:d] - before[:d]).max() <= within * s[0]:
            break
        before, right = s, _orthonormal(turned, "b")
    keep = int((s[:d] > 1e-11 * s[0]).sum())
    return _times(left, "a", v[:keep].T), s[:keep]
