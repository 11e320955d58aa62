"""Joins whose sides are counted, where the plan's estimate of a size is far from the rows that it makes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..session import saved

#: Rows of a table that is broadcast; with a larger one both sides are shuffled.
BROADCAST_ROWS = 200_000


def joined(rows: DataFrame, small: DataFrame, on: Sequence[str] | str, how: str = "inner") -> DataFrame:
    """``rows`` joined with a table that is small as a rule: it is run once and counted, and broadcast up to BROADCAST_ROWS rows.

    Behind explode or an aggregate a plan takes its rows for as few bytes as the files it reads, so that Spark may broadcast the large side through the driver,
    or shuffle it for a handful of keys. Rows are never broadcast here.
    """
    small = saved(small, "counted")
    return rows.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small.hint("merge"), on, how)


#: Rows that a task groups or sorts where groups go with the rows.
ROWS_A_TASK = 500_000


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``rows``, about ``n``, dealt by ``keys`` over a stated number of tasks: what a task holds stays the same, however many rows there are."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_A_TASK))
    return rows.repartition(tasks, *keys)
