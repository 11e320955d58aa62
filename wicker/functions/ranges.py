"""Running sums over any sort key, without a task that sees all keys.

Rows are dealt by sampled cuts into ranges of the key, written once so that both readers see the same
ranges, summed inside each range, and the sums of the ranges before are joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import saved

#: Rows that a range should hold.
ROWS_A_RANGE = 2_000_000


def in_ranges(rows: DataFrame, by: Sequence[str], keys: Sequence[Column], ranges: int | None = None) -> DataFrame:
    """``rows`` as a table with the number of their range, ``_range``: ranges follow the order of ``by`` and ``keys``, equal keys share one."""
    if ranges is None:
        ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_A_RANGE))
    return saved(rows.repartitionByRange(ranges, *by, *keys).withColumn("_range", F.spark_partition_id()), "ranges")


def sums_before(rows: DataFrame, key: str, values: Mapping[str, str], by: Sequence[str] = (), descending: bool = False, ranges: int | None = None) -> DataFrame:
    """``rows`` with new columns that sum others over all rows of the group that come before in the order of ``key`` (``values``: name to column).

    ``rows`` have one row for each group and key (sum them first). Null keys come first, last where ``descending``. The only windows over more than
    one range see a row a range.
    """
    order = F.desc(key) if descending else F.asc(key)
    placed = in_ranges(rows, by, [order], ranges)
    until = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    inside = until(W.partitionBy(*by, "_range").orderBy(order))
    totals = placed.groupBy(*by, "_range").agg(*[F.sum(v).alias(f"_total_{c}") for c, v in values.items()])
    earlier = until(W.partitionBy(*by).orderBy("_range"))  # a row for each range of a group
    totals = totals.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_range").alias("_of"), *[F.coalesce(F.sum(f"_total_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in values])
    same = F.col("_range") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    within = placed.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_inside_{c}") for c, v in values.items()])
    out = within.join(totals, same).withColumns({c: F.col(f"_inside_{c}") + F.col(f"_before_{c}") for c in values})
    return out.select(*rows.columns, *values)


def places(rows: DataFrame, order: Sequence[str], name: str = "r", ranges: int | None = None) -> DataFrame:
    """``rows`` numbered from 1 in the order of columns that tell them apart."""
    placed = in_ranges(rows, (), [F.col(c) for c in order], ranges)
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a range
    within = placed.withColumn("_i", F.row_number().over(W.partitionBy("_range").orderBy(*order)))
    return within.join(before, F.col("_range") == F.col("_of")).withColumn(name, F.col("_i") + F.col("_before")).select(*rows.columns, name)
