"""Sinks and their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.columns import item_set


def write_baskets(baskets: DataFrame, path: str) -> None:
    """Checked sets, by source."""
    good = baskets.where(F.size("items") > 0).withColumn("items", item_set("items"))
    good.write.partitionBy("source").parquet(path)


def read_baskets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_dataset(rows: DataFrame, path: str, max_rows: int = 1_000_000) -> DataFrame:
    """Files of bounded length; the written rows are read again and counted: ``n, slots, nulls, equal``."""
    spark = rows.sparkSession
    rows.write.option("maxRecordsPerFile", max_rows).parquet(path)
    facts = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("slots"), F.count_if(F.col("items").isNull()).alias("nulls"))
    back, sent = facts(spark.read.parquet(path)), facts(rows)
    return back.crossJoin(F.broadcast(sent.select(F.struct("*").alias("sent")))).select("n", "slots", "nulls", (F.struct("n", "slots", "nulls") == F.col("sent")).alias("equal"))  # one row each


def shards(rows: DataFrame, id_col: str, size: int) -> DataFrame:
    """Ordered groups of ``size`` contiguous ids: ``shard, first_id, n, rows``."""
    others = [c for c in rows.columns if c != id_col]
    x = rows.withColumn("shard", F.floor(F.col(id_col) / size))
    return x.groupBy("shard").agg(F.min(id_col).alias("first_id"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(id_col, *others))).alias("rows"))


def write_shards(rows: DataFrame, id_col: str, size: int, path: str) -> None:
    shards(rows, id_col, size).write.option("compression", "gzip").json(path)


def write_catalog(catalog: DataFrame, path: str) -> None:
    """Range-sorted by id, so that readers can skip."""
    catalog.repartitionByRange("basket_id").sortWithinPartitions("basket_id").write.parquet(path)


def write_graph(edges: DataFrame, path: str, **meta) -> None:
    """Edges, and a one-row table of the thresholds that made them."""
    edges.write.parquet(f"{path}/edges")
    edges.sparkSession.createDataFrame([{k: str(v) for k, v in meta.items()} or {"note": ""}]).write.parquet(f"{path}/meta")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/meta").first().asDict()


def ranked_terms(terms: DataFrame, most: int = 1500) -> DataFrame:
    """Each language's terms by frequency, the ``most`` first ones. ``terms``: lang, term, n."""
    order = W.partitionBy("lang").orderBy(F.desc("n"), "term")
    return terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def write_terms(terms: DataFrame, path: str, most: int = 1500) -> None:
    ranked_terms(terms, most).write.partitionBy("lang").json(path)


def item_catalogue(items: DataFrame, degrees: DataFrame, subs: DataFrame, k: int = 3) -> DataFrame:
    """Each item with group, frequency, degree, votes and its first substitutes. ``items``: item_id, name, grp, df; ``subs``: a, b, votes."""
    order = W.partitionBy("a").orderBy(F.desc("votes"), "b")
    best = subs.withColumn("rank", F.row_number().over(order))
    names = items.select(F.col("item_id").alias("b"), F.col("name").alias("sub"))
    top = best.where(F.col("rank") <= k).join(names, "b").groupBy("a").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "sub"))), lambda x: x["sub"]), ", ").alias("substitutes"))
    votes = subs.groupBy("a").agg(F.sum("votes").alias("votes"))
    out = items.join(degrees, "item_id", "left").join(votes.withColumnRenamed("a", "item_id"), "item_id", "left").join(top.withColumnRenamed("a", "item_id"), "item_id", "left")
    return out.select("item_id", "name", "grp", "df", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("votes", F.lit(0)).alias("votes"), F.coalesce("substitutes", F.lit("")).alias("substitutes"))


def write_catalogue(catalogue: DataFrame, path: str) -> None:
    catalogue.write.parquet(f"{path}/parquet")
    catalogue.write.option("header", True).csv(f"{path}/csv")


def read_metrics(spark: SparkSession, glob: str) -> DataFrame:
    """A tree of flat metric files as one long table: ``run, metric, value``."""
    wide = spark.read.json(glob, multiLine=True)
    numbers = [c for c, t in wide.dtypes if t in ("double", "bigint")]
    runs = wide.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("run"), *[F.col(c).cast("double").alias(c) for c in numbers])
    return runs.unpivot(["run"], numbers, "metric", "value").where("value is not null")
