"""Data-quality and consistency jobs (Q operators): every job gives a table of violations or counts, not an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import item_set
from .baskets import frequencies


def vocabulary_alignment(one: DataFrame, two: DataFrame) -> DataFrame:
    """Q1: items whose id or name differs between two artefacts, or that one lacks. Tables: item_id, name."""
    both = one.select("item_id", F.col("name").alias("name_1")).join(two.select("item_id", F.col("name").alias("name_2")), "item_id", "full_outer")
    return both.where(~F.col("name_1").eqNullSafe(F.col("name_2")))


def verify_catalog(catalog: DataFrame, baskets: DataFrame) -> DataFrame:
    """Q2: ids are contiguous, slots, frequencies, sources and sets agree: ``check, violations``."""
    ids = catalog.agg((F.max("basket_id") - F.min("basket_id") + 1 - F.countDistinct("basket_id")).alias("v"))
    size = lambda df: df.agg(F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("s"))
    slots = size(catalog).crossJoin(F.broadcast(size(baskets).withColumnRenamed("s", "t"))).select(F.abs(F.col("s") - F.col("t")).alias("v"))  # one row each
    df = frequencies(catalog).join(frequencies(baskets).withColumnRenamed("df", "d2"), "item_id", "full_outer").agg(F.count_if(~F.col("df").eqNullSafe(F.col("d2"))).alias("v"))
    per = lambda t: t.groupBy("source").agg(F.count("*").alias("n"))
    source = per(catalog).join(per(baskets).withColumnRenamed("n", "m"), "source", "full_outer").agg(F.count_if(~F.col("n").eqNullSafe(F.col("m"))).alias("v"))
    sets = catalog.select("basket_id", "items").join(baskets.select("basket_id", F.col("items").alias("other")), "basket_id", "full_outer").agg(F.count_if(~F.col("items").eqNullSafe(F.col("other"))).alias("v"))
    out = None
    for name, t in (("id gaps", ids), ("slots", slots), ("frequencies", df), ("sources", source), ("sets", sets)):
        row = t.select(F.lit(name).alias("check"), F.col("v").cast("long").alias("violations"))
        out = row if out is None else out.unionAll(row)
    return out


def replay(again: DataFrame, stored: DataFrame) -> DataFrame:
    """Q3: baskets that come out differently when normalised again. Tables: basket_id, items."""
    both = again.select("basket_id", F.col("items").alias("now")).join(stored.select("basket_id", F.col("items").alias("then")), "basket_id", "full_outer")
    return both.where(~F.col("now").eqNullSafe(F.col("then")))


def export_difference(recomputed: DataFrame, exported: DataFrame) -> DataFrame:
    """Q4: rows on one side only."""
    a = recomputed.select(*exported.columns)
    return a.exceptAll(exported).withColumn("side", F.lit("missing")).unionByName(exported.exceptAll(a).withColumn("side", F.lit("surplus")))


def provenance(rows: DataFrame, value: str, status: str, source_status: str = "source_total") -> DataFrame:
    """Q5: values without a source status, statuses without a value, values that are not positive."""
    v, s = F.col(value), F.coalesce(F.col(status) == source_status, F.lit(False))
    return rows.agg(F.count("*").alias("n"), F.count_if(v.isNotNull() & ~s).alias("value_without_status"), F.count_if(v.isNull() & s).alias("status_without_value"), F.count_if(v <= 0).alias("not_positive"))


def index_bias(baskets: DataFrame) -> DataFrame:
    """Q6: does a place in the stored order say anything about an item? Correlation of item id and its mean relative place."""
    slot = baskets.where(F.size("items") >= 2).select(F.size("items").alias("n"), F.posexplode("items").alias("pos", "item_id"))
    per = slot.groupBy("item_id").agg(F.avg(F.col("pos") / (F.col("n") - 1)).alias("place"))
    return per.agg(F.count("*").alias("items"), F.round(F.corr("item_id", "place"), 6).alias("bias"))


def stream_alignment(reader: DataFrame, metadata: DataFrame) -> DataFrame:
    """Rows of two streams zipped by source and number: matched, missing on a side, keys that differ. Tables: source, row_no, key."""
    both = reader.select("source", "row_no", F.col("key").alias("k1"), F.lit(1).alias("in1")).join(metadata.select("source", "row_no", F.col("key").alias("k2"), F.lit(1).alias("in2")), ["source", "row_no"], "full_outer")
    here, there = F.col("in1").isNotNull(), F.col("in2").isNotNull()
    return both.groupBy("source").agg(
        F.count_if(here & there & F.col("k1").eqNullSafe(F.col("k2"))).alias("matched"), F.count_if(here & there & ~F.col("k1").eqNullSafe(F.col("k2"))).alias("differ"), F.count_if(here & ~there).alias("only_reader"), F.count_if(there & ~here).alias("only_metadata")
    )


def content_join(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of two tables with equal content in ``columns``; hashes find them, values confirm them, and a content that the right has in two versions counts as ambiguous."""
    fp = F.xxhash64(*[F.col(c) for c in columns])
    others = [c for c in right.columns if c not in columns]
    r = right.withColumn("fp", fp).groupBy("fp", *columns).agg(F.countDistinct(F.struct(*others)).alias("versions"), *[F.min(c).alias(c) for c in others])
    r = r.select("fp", *[F.col(c).alias(f"r_{c}") for c in columns], "versions", *[F.when(F.col("versions") == 1, F.col(c)).alias(f"right_{c}") for c in others])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    return left.withColumn("fp", fp).alias("l").join(r, ["fp"]).where(same).drop("fp", *[f"r_{c}" for c in columns]).withColumn("ambiguous", F.col("versions") > 1)


def public_checks(rows: DataFrame, shard_table: DataFrame, longest: int = 10_000) -> DataFrame:
    """Q8: status and link agree, sets are clean, texts are bounded, shards are contiguous: ``check, violations``.

    ``rows``: id, items, title, link, link_status; ``shard_table``: first_id, n.
    """
    linked = F.col("link_status").isin("source", "archive")
    a = rows.agg(
        F.count_if(linked != F.col("link").isNotNull()).alias("link_status"),
        F.count_if(F.col("items") != item_set("items")).alias("sets"),
        F.count_if(F.length("title") > longest).alias("long_titles"),
        (F.max("id") - F.min("id") + 1 - F.countDistinct("id")).alias("id_gaps"),
    ).unpivot([], ["link_status", "sets", "long_titles", "id_gaps"], "check", "violations")
    gaps = shard_table.alias("s").join(shard_table.select((F.col("first_id") + F.col("n")).alias("first_id"), F.lit(1).alias("ok")), "first_id", "left")
    least = shard_table.agg(F.min("first_id").alias("least"))
    b = gaps.crossJoin(F.broadcast(least)).agg(F.count_if(F.col("ok").isNull() & (F.col("first_id") > F.col("least"))).alias("violations")).select(F.lit("shards").alias("check"), "violations")  # one row
    return a.unionByName(b)
