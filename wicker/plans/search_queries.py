"""Queries of constrained search and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import half_up
from ..functions.joins import joined
from ..operators import baskets as B, search as S
from ..session import saved, table
from . import bindings as X
from .registering import collector

QUERIES, ORACLE_SQL, query = collector()
D = DataFrame
P = SparkSession


def linked_baskets(spark: P, sf: str) -> D:
    """Baskets with the state of a link."""
    k = F.col("basket_id")
    return X.baskets(spark, sf).withColumn("link_status", F.when(k % 4 == 0, "offline").when(k % 2 == 0, "archive").when(k % 3 == 0, "source"))


def search_queries(spark: P, sf: str, every: int = 20) -> D:
    """A search for every so-many-th customer: pantry and bounds from the customer's key."""
    k = F.col("c_custkey")
    pantry = F.array_sort(F.array_distinct(F.array(*[(k * m + c) % 64 for m, c in ((7, 1), (11, 3), (13, 5), (17, 7), (19, 11), (23, 13))])))
    return table(spark, sf, "customer").where(k % every == 0).select(
        k.alias("query_id"), pantry.alias("available"), F.when(k % 300 == 0, F.array(k * 7 % 64 + 1 - F.when(k * 7 % 64 == 63, 64).otherwise(0))).alias("must_use"), F.array((k * 29 + 2) % 64).alias("exclude"),
        F.when(k % 200 == 0, F.lit(300.0)).alias("budget"), F.when(k % 340 != 0, F.lit(2)).alias("max_missing"), F.when(k % 500 == 0, F.lit(40.0)).alias("min_servings"), F.lit(None).cast("string").alias("language"), F.lit(10).alias("top_k"),
        F.when(k % 60 == 0, F.lit(True)).alias("require_link"),
    )


_Q = """q as (select c_custkey query_id, list_sort(list_distinct([(c_custkey * 7 + 1) % 64, (c_custkey * 11 + 3) % 64, (c_custkey * 13 + 5) % 64, (c_custkey * 17 + 7) % 64, (c_custkey * 19 + 11) % 64, (c_custkey * 23 + 13) % 64])) available,
  case when c_custkey % 300 = 0 then [c_custkey * 7 % 64 + 1 - case when c_custkey * 7 % 64 = 63 then 64 else 0 end] else [] end must_use, [(c_custkey * 29 + 2) % 64] as ex, case when c_custkey % 200 = 0 then 300.0::double end budget, case when c_custkey % 340 <> 0 then 2 end max_missing, c_custkey % 60 = 0 linked, case when c_custkey % 500 = 0 then 40.0 end min_servings from customer where c_custkey % 20 = 0),
qs as (select *, list_filter(list_distinct(list_concat(available, must_use)), lambda x: not list_contains(ex, x)) pantry from q)"""
_FOUND = _Q + """, hit as (select query_id, basket_id, count(*) overlap from (select query_id, unnest(pantry) item_id from qs) join slots using (item_id) group by 1, 2), cand as (select * from hit join qs using (query_id) join baskets using (basket_id)),
found as (select *, len(items) - overlap missing from cand where overlap > 0 and (max_missing is null or len(items) - overlap <= max_missing) and (not linked or basket_id % 2 <> 0 and basket_id % 3 = 0 or basket_id % 4 = 2) and (budget is null or total_minutes <= budget) and (min_servings is null or servings >= min_servings)
  and len(list_filter(must_use, lambda x: not list_contains(items, x))) = 0 and len(list_filter(items, lambda x: list_contains(ex, x))) = 0)"""


@query(f"with {X.ITEMS}, {_Q}, x as (select query_id, case when query_id % 700 = 0 then [999] else available end available, case when query_id % 400 = 0 then ex else must_use end must_use, ex, max_missing from q) select query_id, case when len(list_filter(list_concat(available, must_use, ex), lambda v: v >= n)) > 0 then 'unknown item' when len(list_intersect(must_use, ex)) > 0 then 'must use and exclude clash' end reason from x, (select count(*) n from items)")
def validate_queries(spark: P, sf: str) -> D:
    q = search_queries(spark, sf)
    k = F.col("query_id")
    q = q.withColumn("available", F.when(k % 700 == 0, F.array(F.lit(999).cast("long"))).otherwise(F.col("available"))).withColumn("must_use", F.when(k % 400 == 0, F.col("exclude")).otherwise(F.col("must_use")))
    return S.validate_queries(q, X.items(spark, sf)).select("query_id", "reason")


@query(f"with {X.BASKETS}, {_Q} select query_id, basket_id, count(*) overlap from (select query_id, unnest(pantry) item_id from qs) join slots using (item_id) group by 1, 2")
def candidates(spark: P, sf: str) -> D:
    return S.candidates(search_queries(spark, sf), X.baskets(spark, sf))


@query(f"with {X.BASKETS}, {_FOUND} select query_id, basket_id, overlap, missing from found")
def feasible(spark: P, sf: str) -> D:
    return S.feasible(search_queries(spark, sf), linked_baskets(spark, sf)).select("query_id", "basket_id", "overlap", "missing")


@query(
    f"with {X.BASKETS}, {_Q}, {X.DF}, p as (select basket_id, len(items) size, item_id, row_number() over (partition by basket_id order by df, item_id) - 1 place from slots join df using (item_id) join baskets using (basket_id)),"
    " a as (select query_id, count(distinct basket_id) sharing from qs, p where list_contains(pantry, item_id) group by 1),"
    " b as (select query_id, count(distinct basket_id) met from qs, p where list_contains(pantry, item_id) and (max_missing is null or place <= max_missing and floor(log2(size)) <= floor(log2(len(pantry) + max_missing))) group by 1)"
    " select query_id, sharing, coalesce(met, 0) met from a left join b using (query_id)"
)
def prefix_candidates(spark: P, sf: str) -> D:
    """Baskets that share an item with a query, and those that the prefix index lets it meet."""
    c = X.baskets(spark, sf)
    q, asked = S.asked_once(search_queries(spark, sf), ["pantry", "max_missing"])
    bounded, open_ = q.where(F.col("max_missing").isNotNull()), q.where(F.col("max_missing").isNull())
    met = S.found_by_prefix(bounded, S.prefix_index(c, 3)).unionByName(S.found_by_prefix(open_, S.prefix_index(c))).groupBy("query_id").agg(F.count("*").alias("met"))
    sharing = S.candidates(q, c).groupBy("query_id").agg(F.count("*").alias("sharing"))
    return S.answered(sharing.join(met, "query_id", "left").fillna(0, ["met"]), asked)


@query(
    f"with {X.BASKETS}, {_FOUND}, {X.DF}, z as (select count(*) n, avg(len(items)) mean from baskets), w as (select query_id, unnest(pantry) item_id from qs), s as (select query_id, basket_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(items) / mean))), 6) score from w join slots using (item_id) join df using (item_id) join baskets using (basket_id), z group by 1, 2),"
    " r as (select *, row_number() over (partition by query_id order by score desc, basket_id) as scan, count(*) over (partition by query_id) matched from s), f as (select r.*, row_number() over (partition by query_id order by scan) as rank, count(*) over (partition by query_id) fit from r semi join found using (query_id, basket_id) where scan <= 300)"
    " select query_id, basket_id, score, rank, matched > 300 or fit > 20 truncated from f where rank <= 20"
)
def bm25(spark: P, sf: str) -> D:
    return S.bm25(search_queries(spark, sf), linked_baskets(spark, sf), scan_limit=300, keep=20)


@query()
def scan_plan(spark: P, sf: str) -> D:
    """Blocks of postings that each search reads to seed its bounds, reads for what may be better, and skips."""
    c = X.baskets(spark, sf)
    q, asked = S.asked_once(search_queries(spark, sf), ["pantry"])
    plan, _ = S.scan_plan(q, c, S.posting_blocks(c), 301)
    return S.answered(plan.groupBy("query_id").pivot("role", ["seed", "essential", "skipped"]).agg(F.sum("n_blocks")).fillna(0), asked)


@query(f"with {X.SLOTS}, {X.DF}, n as (select count(distinct basket_id) n from slots) select item_id, df, round(1 + ln((1 + n) / (1 + df)::double), 6) idf from df, n")
def idf(spark: P, sf: str) -> D:
    return S.idf(X.baskets(spark, sf)).withColumn("idf", F.round("idf", 6))


_SCORED = _FOUND + f""", {X.DF}, nn as (select count(distinct basket_id) n from slots), w as (select item_id, (1 + ln((1 + n) / (1 + df)::double))::decimal(18, 9) idf from df, nn), nv as (select ln(1 + count(*)) lv from df),
sums as (select f.query_id, f.basket_id, sum(idf)::double ir, sum(case when list_contains(pantry, item_id) then idf else 0 end)::double io from (select query_id, basket_id, pantry, unnest(items) item_id from found) f join w using (item_id) group by 1, 2),
psum as (select query_id, sum(idf)::double ip from (select query_id, unnest(pantry) item_id from qs) join w using (item_id) group by 1),
ft as (select f.*, io, ir, ip, overlap::double o, len(items)::double r, len(pantry)::double p, lv from found f join sums using (query_id, basket_id) join psum using (query_id), nv),
fs as (select *, least(io / (ir + ip - io), 1) idf_jaccard, o / (r + p - o) jaccard, o / r basket_coverage, o / p pantry_coverage, (r - o) / r missing_share, case when r = o then 1.0 else 0.0 end fully_available,
  case when total_minutes is not null and budget is not null then 1 - least(total_minutes, budget) / budget else 0 end time_slack, least(ln(1 + o) / lv, 1) overlap_log, coalesce(ln(1 + least(total_minutes, 10080)) / ln(10081), 0) time_log from ft),
sc as (select *, round(3.0 * idf_jaccard + 2.0 * jaccard + 0.25 * basket_coverage + 0.25 * pantry_coverage - 0.5 * missing_share + 0.1 * fully_available + 0.025 * time_slack, 9) score from fs),
rk as (select *, row_number() over (partition by query_id order by score desc, basket_id) as rank from sc)"""


@query(f"with {X.BASKETS}, {_SCORED} select query_id, basket_id, round(idf_jaccard, 6) idf_jaccard, round(jaccard, 6) jaccard, round(overlap_log, 6) overlap_log, round(time_slack, 6) time_slack, round(time_log, 6) time_log, fully_available::double fully_available from sc")
def features(spark: P, sf: str) -> D:
    rows, asked = S.scored_features(search_queries(spark, sf), linked_baskets(spark, sf))
    return S.answered(rows.select("query_id", "basket_id", *[half_up(x, 6).alias(x) for x in ("idf_jaccard", "jaccard", "overlap_log", "time_slack", "time_log")], "fully_available"), asked)


@query(f"with {X.BASKETS}, {_SCORED} select query_id, basket_id, rank, round(score, 6) score from rk where rank <= 10")
def ranked(spark: P, sf: str) -> D:
    return S.ranked(search_queries(spark, sf), linked_baskets(spark, sf)).select("query_id", "basket_id", "rank", F.round("score", 6).alias("score"))


@query()
def ranked_learned(spark: P, sf: str) -> D:
    c = saved(linked_baskets(spark, sf), "baskets")  # searches may ask for a link
    q = S.pantries(c, "train").withColumn("top_k", F.lit(10))
    for name, kind in (("must_use", "array<bigint>"), ("exclude", "array<bigint>"), ("budget", "double"), ("min_servings", "double"), ("language", "string")):
        q = q.withColumn(name, F.lit(None).cast(kind))
    q = saved(q, "pantries")
    # every pantry against every basket that fits
    rows = joined(S.answered(*S.scored_features(q, c)), q.select("query_id", "source_items"), "query_id").withColumn("label", (F.col("items") == F.col("source_items")).cast("int"))
    model = S.train_ranker(saved(rows.select(*S.FEATURES, "label"), "training"), hidden=8)  # read by every step of the training
    return S.ranked(search_queries(spark, sf), c, model).select("query_id", "basket_id", "rank", F.round("score", 4).alias("score"))


@query(f"with {X.BASKETS}, {_SCORED} select query_id, basket_id, rank, len(list_filter(items, lambda x: list_contains(pantry, x))) n_matched, len(items) - overlap n_missing, len(pantry) - overlap n_unused, case when total_minutes is null then 1 else 0 end + case when servings is null then 1 else 0 end + case when len(items) > overlap then 1 else 0 end + 1 + case when basket_id % 7 < 2 then 1 else 0 end n_warnings from (select *, row_number() over (partition by query_id order by score desc, basket_id) rank2 from rk) where rank <= 10")
def result_cards(spark: P, sf: str) -> D:
    titles = table(spark, sf, "orders").select(F.col("o_orderkey").alias("basket_id"), F.col("o_orderpriority").alias("title"), F.get(F.array(F.lit("count_mismatch"), F.lit("values_without_units")), (F.col("o_orderkey") % 7).cast("int")).alias("quantity_status"))
    q = search_queries(spark, sf)
    cards = S.result_cards(S.ranked(q, linked_baskets(spark, sf)), titles, q)
    return cards.select("query_id", "basket_id", "rank", F.size("matched").alias("n_matched"), F.size("missing_items").alias("n_missing"), F.size("unused").alias("n_unused"), F.size("warnings").alias("n_warnings"))


@query(f"with {X.BASKETS}, h as (select basket_id, floor({X.draw_sql('array_to_string(items, chr(44))', 4)} * 10)::int part from baskets) select part, case when part < 8 then 'train' when part = 8 then 'valid' else 'test' end split, count(*) n from h group by 1, 2")
def content_split(spark: P, sf: str) -> D:
    b = X.baskets(spark, sf)
    return b.groupBy(S.content_split("items").alias("part"), S.split_name("items").alias("split")).agg(F.count("*").alias("n"))


@query()
def pantries(spark: P, sf: str) -> D:
    p = S.pantries(X.baskets(spark, sf), "test")
    return p.select("query_id", F.size("available").alias("n"), F.size(F.array_except("source_items", "available")).alias("hidden"), F.size(F.array_except("available", "source_items")).alias("noise"))


@query()
def shortlists(spark: P, sf: str) -> D:
    c = X.baskets(spark, sf)
    return S.shortlists(S.pantries(c, "test"), c.select("basket_id", "items")).groupBy("query_id").agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.max("missing").alias("missing"))


@query("with u as (select l_orderkey b from lineitem where l_linenumber <= 2), p as (select o_orderkey, count(b) n from orders left join u on b = o_orderkey group by 1) select count(*) filter (n = 0) unused, count(*) filter (n = 1) once, count(*) filter (n > 1) repeated, count(*) n from p")
def ledger(spark: P, sf: str) -> D:
    used = table(spark, sf, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("basket_id"))
    return S.ledger(used, table(spark, sf, "orders").select(F.col("o_orderkey").alias("basket_id")))


@query()
def search_report(spark: P, sf: str) -> D:
    c = saved(X.baskets(spark, sf), "baskets")
    e = S.evaluation_queries(c).withColumn("top_k", F.lit(10)).withColumn("min_servings", F.lit(None).cast("double")).withColumn("language", F.lit(None).cast("string"))
    e = saved(e, "queries")
    same = c.select("basket_id", "items").join(e.select("query_id", "items"), "items").select("query_id", "basket_id")
    q = e.drop("items")
    found = saved(S.ranked(q, c).select("query_id", "basket_id", "rank"), "found")
    return S.search_report(found, same, S.bm25(q, c), S.violations(found, q, c))


@query()
def evaluation_queries(spark: P, sf: str) -> D:
    e = S.evaluation_queries(X.baskets(spark, sf))
    return e.select("query_id", F.size("available").alias("n"), "max_missing", F.col("must_use")[0].alias("must"), F.get("exclude", F.lit(0)).alias("forbidden"), "budget")
