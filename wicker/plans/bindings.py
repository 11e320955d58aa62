"""The library's concepts over the given tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.joins import dealt, joined
from ..operators.baskets import baskets_from_rows
from ..session import saved, table


def items(spark: SparkSession, sf: str) -> DataFrame:
    """``item_id, name, df``-less vocabulary: distinct part names, numbered by name."""
    from pyspark.sql import Window as W

    names = table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    return names.withColumn("item_id", (F.row_number().over(W.orderBy("name")) - 1).cast("long"))  # a row for each item of the vocabulary


def slots_by_name(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name")).join(items(spark, sf), "name")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("basket_id"), "item_id")


def baskets(spark: SparkSession, sf: str) -> DataFrame:
    """Baskets of part names: ``basket_id, items, source, lang, total_minutes, servings``; unknown totals where the order is pending."""
    sets = baskets_from_rows(slots_by_name(spark, sf), "basket_id", "item_id")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("basket_id"), F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("status"), "o_totalprice", "o_custkey")
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("lang"))
    quantity = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("basket_id")).agg(F.sum("l_quantity").alias("q"))
    known = F.col("status") != "P"
    x = sets.join(orders, "basket_id").join(customer, "o_custkey").join(quantity, "basket_id")
    return x.select("basket_id", "items", "source", "lang", F.when(known, F.col("o_totalprice") / 1000).alias("total_minutes"), F.when(known, F.col("q")).alias("servings"))


def part_baskets(spark: SparkSession, sf: str) -> DataFrame:
    """Baskets of parts: a vocabulary that grows with the data."""
    return baskets_from_rows(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")


def item_attr(spark: SparkSession, sf: str) -> DataFrame:
    """Part names and the nations of their suppliers."""
    part = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name")).join(items(spark, sf), "name")
    rows = table(spark, sf, "lineitem").where("l_quantity <= 2").select("l_partkey", "l_suppkey").distinct().join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("item_id", F.col("s_nationkey").cast("long").alias("attr_id")).distinct()


def every_attr(spark: SparkSession, sf: str) -> DataFrame:
    """Part names and the nations of all suppliers that sell them, run once and kept as a table: at most names times nations."""
    part = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name")).join(items(spark, sf), "name").select("p_partkey", "item_id")
    nations = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("attr_id"))
    rows = joined(table(spark, sf, "lineitem").select("l_partkey", "l_suppkey"), nations, "l_suppkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return saved(rows.select("item_id", "attr_id").distinct(), "attributes")


def attrs(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("n_nationkey").cast("long").alias("attr_id"), F.col("r_name").alias("class"))


def subs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of parts of one type and size; votes are the suppliers that sell both."""
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_size")
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    sold = dealt(lines, lines.count(), "l_partkey", "l_suppkey").distinct().join(part, F.col("l_partkey") == F.col("p_partkey"))
    sold = saved(sold.select("l_partkey", "l_suppkey", "p_type", "p_size"), "sold")
    alike = ["l_suppkey", "p_type", "p_size"]
    made = sold.groupBy(*alike).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))).first()[0]
    sold = dealt(sold, made, *alike)
    a = sold.select(F.col("l_partkey").alias("a"), "l_suppkey", "p_type", "p_size")
    b = sold.select(F.col("l_partkey").alias("b"), "l_suppkey", "p_type", "p_size")
    return dealt(a.join(b, alike).where("a <> b").select("a", "b"), made, "a").groupBy("a", "b").agg(F.count("*").alias("votes"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "label")


ITEMS = "items as (select name, row_number() over (order by name) - 1 as item_id from (select distinct p_name as name from part))"
SLOTS = ITEMS + ", slots as (select distinct l_orderkey as basket_id, item_id from lineitem join part on l_partkey = p_partkey join items on name = p_name)"
BASKETS = (
    SLOTS
    + """, quantity as (select l_orderkey, sum(l_quantity) q from lineitem group by 1),
baskets as (select s.basket_id, s.items, o_orderpriority as source, c_mktsegment as lang, case when o_orderstatus <> 'P' then o_totalprice / 1000 end as total_minutes, case when o_orderstatus <> 'P' then q end as servings
  from (select basket_id, list(item_id order by item_id) items from slots group by 1) s join orders on o_orderkey = s.basket_id join customer on c_custkey = o_custkey join quantity on l_orderkey = s.basket_id)"""
)
DF = "df as (select item_id, count(*) df from slots group by 1)"
PAIRS = "pairs as (select a.item_id src, b.item_id dst, count(*) cnt from slots a join slots b on a.basket_id = b.basket_id and a.item_id < b.item_id group by 1, 2)"
EDGES = (
    SLOTS + ", " + DF + ", " + PAIRS + """, n as (select count(distinct basket_id)::double n from slots),
edges0 as (select src, dst, cnt, n, cnt / n p, ln(cnt / n * n * n / (x.df::double * y.df)) / -ln(cnt / n) npmi, ln(cnt::double * n / (x.df::double * y.df)) pmi from pairs join df x on x.item_id = src join df y on y.item_id = dst, n where cnt >= 2 and cnt < n),
edges as (select src, dst, cnt, npmi, pmi from edges0 where npmi >= -0.15),
both_ways as (select src a, dst b, npmi weight from edges union all select dst, src, npmi from edges)"""
)
_ATTR = ITEMS + ", item_attr as (select distinct item_id, s_nationkey::bigint attr_id from lineitem join part on l_partkey = p_partkey join items on name = p_name join supplier on s_suppkey = l_suppkey"
ATTR = _ATTR + " where l_quantity <= 2)"
EVERY_ATTR = _ATTR + ")"
SHARED = "shared as (select x.item_id i, y.item_id j, count(*) shared from item_attr x join item_attr y on x.attr_id = y.attr_id and x.item_id <> y.item_id group by 1, 2)"
SUBS = "sold as (select distinct l_partkey, l_suppkey, p_type, p_size from lineitem join part on l_partkey = p_partkey), subs as (select a.l_partkey a, b.l_partkey b, count(*) votes from sold a join sold b on a.l_suppkey = b.l_suppkey and a.p_type = b.p_type and a.p_size = b.p_size and a.l_partkey <> b.l_partkey group by 1, 2)"


def draw_sql(key: str, seed: int = 0) -> str:
    return f"(('0x' || substr(md5(({key})::varchar || ':{seed}'), 1, 8))::bigint / 4294967296.0::double)"


def fine_draw_sql(key: str, seed: str = "0") -> str:
    return f"(('0x' || substr(md5(({key})::varchar || ':' || {seed}), 1, 13))::bigint / 4503599627370496.0::double)"
