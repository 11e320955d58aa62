"""Rows of one key met with each other, where some keys may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

#: Rows of one key that meet each other in one piece.
ROWS_A_PIECE = 2_000


def paired(rows: DataFrame, key: str, left: Sequence[str], right: Sequence[str], most: int = ROWS_A_PIECE) -> DataFrame:
    """A self-join on ``key`` (not null): columns ``left`` of one row and ``right`` of another or the same, named as the two lists say in the order of ``rows``' other columns.

    A key of more than ``most`` rows is heavy: its rows are cut into blocks, and the blocks met with each other are the cells of a grid, a join key each. So
    no task holds more than two blocks' rows of a heavy key; light keys are joined as they are.
    """
    columns = [c for c in rows.columns if c != key]
    rows = rows.where(F.col(key).isNotNull())
    heavy = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    blocks = F.coalesce(F.ceil(F.col("_n") / most), F.lit(1)).cast("int")
    placed = rows.join(heavy, key, "left").withColumn("_g", blocks).withColumn("_own", F.pmod(F.xxhash64(*columns), F.col("_g")).cast("int")).drop("_n")
    every = F.explode(F.sequence(F.lit(0), F.col("_g") - 1))
    one = placed.withColumn("_j", every).select(key, F.col("_own").alias("_i"), "_j", *[F.col(c).alias(n) for c, n in zip(columns, left)])
    two = placed.withColumn("_i", every).select(key, "_i", F.col("_own").alias("_j"), *[F.col(c).alias(n) for c, n in zip(columns, right)])
    return one.join(two, [key, "_i", "_j"]).drop("_i", "_j")
