"""Sums of arrays that tasks make, added by rounds of fixed fan-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Arrays that are added in one group.
FAN_IN = 16


def array_sums(rows: DataFrame, key: str, of: Callable[[pa.RecordBatch], dict[object, np.ndarray]]) -> DataFrame:
    """For each value of ``key`` the sum of arrays over all rows: ``key, sums array<double>``.

    ``of`` makes, from a batch of rows, an array for each key value in it; a task adds its own and passes on one for each key value. What is shuffled goes with
    tasks and key values, whatever the number of rows, and no group adds more than FAN_IN arrays.
    """
    schema = to_arrow_schema(rows.select(key, F.lit(0).cast("long").alias("slot"), F.array(F.lit(0.0)).alias("sums")).schema)
    ddl = f"`{key}` {dict(rows.dtypes)[key]}, slot long, sums array<double>"

    def table(keys: list, slot: int, sums: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, schema.field(0).type), pa.array([slot] * len(keys), pa.int64()), pa.array([x.tolist() for x in sums], pa.list_(pa.float64()))], names=[key, "slot", "sums"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[object, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for k, x in of(batch).items():
                    total[k] = x if k not in total else total[k] + x
        if total:
            yield table(list(total), TaskContext.get().partitionId(), list(total.values()))

    def add(group: pa.Table) -> pa.Table:
        values = group["sums"].combine_chunks()
        sums = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1).sum(axis=0)
        return pa.Table.from_batches([table(group[key][:1].to_pylist(), group["slot"][0].as_py(), [sums])])

    out, tasks = rows.mapInArrow(made, ddl), rows.rdd.getNumPartitions()
    while True:
        out = out.withColumn("slot", F.floor(F.col("slot") / FAN_IN)).groupBy(key, "slot").applyInArrow(add, ddl)
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            return out.select(key, "sums")
