"""Queries of basket selection, accounting and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import item_set
from ..operators import baskets as B, graph as G, quality as Q
from ..session import saved, table
from ..sources import readers as R, sinks as S
from . import bindings as X
from .registering import collector

QUERIES, ORACLE_SQL, query = collector()
D = DataFrame
P = SparkSession


@query(f"with {X.BASKETS} select * exclude (total_minutes, servings, items), array_to_string(items, ',') items from baskets where basket_id % 7 = 3")
def select_baskets(spark: P, sf: str) -> D:
    ids = table(spark, sf, "orders").where("o_orderkey % 7 = 3").select(F.col("o_orderkey").alias("basket_id"))
    return B.select_baskets(X.baskets(spark, sf), ids).select("basket_id", "source", "lang", F.array_join("items", ",").alias("items"))


@query(f"with {X.BASKETS} select basket_id, len(items) size from baskets where lang = 'BUILDING' and source = '1-URGENT'")
def by_origin(spark: P, sf: str) -> D:
    return B.by_origin(X.baskets(spark, sf), lang="BUILDING", source="1-URGENT").select("basket_id", F.size("items").alias("size"))


@query(f"with {X.BASKETS} select basket_id, source from baskets where contains(source, 'HIGH') and len(items) >= 2 and list_contains(items, 5) order by {X.draw_sql('basket_id', 3)}, basket_id limit 10")
def browse(spark: P, sf: str) -> D:
    return B.browse(X.baskets(spark, sf), 10, "HIGH", min_size=2, item=5, seed=3).select("basket_id", "source")


@query(f"with {X.SLOTS} select basket_id, string_agg(name, ',' order by item_id) as names from slots join items using (item_id) group by 1")
def decode(spark: P, sf: str) -> D:
    b = B.baskets_from_rows(X.slots_by_name(spark, sf), "basket_id", "item_id")
    return B.decode(b, X.items(spark, sf)).select("basket_id", F.array_join("names", ",").alias("names"))


@query(f"with {X.BASKETS} select source, count(*) n from baskets where len(items) between 2 and 40 group by 1")
def of_size(spark: P, sf: str) -> D:
    return B.of_size(X.baskets(spark, sf)).groupBy("source").agg(F.count("*").alias("n"))


@query(f"with {X.SLOTS} select item_id, count(*) df from slots group by 1")
def frequencies(spark: P, sf: str) -> D:
    return B.frequencies(X.baskets(spark, sf).select("basket_id", "items"))


@query("with s as (select distinct l_orderkey o, l_partkey i from lineitem) select a.i src, b.i dst, count(*) as \"count\" from s a join s b on a.o = b.o and a.i < b.i group by 1, 2")
def pair_counts(spark: P, sf: str) -> D:
    return B.pair_counts(X.part_baskets(spark, sf))


@query(f"with {X.EDGES} select src, dst, cnt \"count\", round(npmi, 6) npmi, round(pmi, 6) pmi from edges")
def npmi_graph(spark: P, sf: str) -> D:
    b = B.baskets_from_rows(X.slots_by_name(spark, sf), "basket_id", "item_id")
    return B.npmi_graph(b).select("src", "dst", "count", F.round("npmi", 6).alias("npmi"), F.round("pmi", 6).alias("pmi"))


@query(
    "with s0 as (select distinct l_orderkey o, l_partkey i from lineitem), big as (select o from s0 group by 1 having count(*) >= 2), s as (select s0.* from s0 join big using (o)), df as (select i, count(*) df from s group by 1), n as (select count(*)::double n from big),"
    " p as (select a.i src, b.i dst, count(*) cnt from s a join s b on a.o = b.o and a.i < b.i group by 1, 2)"
    " select src, dst, cnt \"count\", round(ln(cnt / n * n * n / (x.df::double * y.df)) / -ln(cnt / n), 6) npmi from p join df x on x.i = src join df y on y.i = dst, n where cnt >= 2"
)
def npmi_paired_only(spark: P, sf: str) -> D:
    return B.npmi_graph(X.part_baskets(spark, sf), threshold=None, paired_only=True).select("src", "dst", "count", F.round("npmi", 6).alias("npmi"))


@query(f"with {X.EDGES}, g as (select m.m min_count, t.t threshold from (values (2), (20), (60)) m(m), (values (-0.15::double), (0.0), (0.05)) t(t)) select min_count, threshold, count(cnt) edges, abs(count(cnt) - 1000) off from g left join edges0 on cnt >= min_count and npmi >= threshold group by 1, 2")
def operating_points(spark: P, sf: str) -> D:
    edges = B.npmi_graph(X.baskets(spark, sf), threshold=None)
    return B.operating_points(edges, [2, 20, 60], [-0.15, 0.0, 0.05], 1000)


def _documents_marked(spark: P, sf: str) -> D:
    """Documents as raw records: lines are items, sources ranked by name."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", R.lines(F.col("text")).alias("items"))
    return B.deduplicate(d, B.fingerprint("items"), ["source", "doc_id"])


_DOC_LINES = "d as (select doc_id, source, lang, list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: trim(x, ' ')), lambda x: x <> '') items from documents), f as (select *, array_to_string(list_sort(list_transform(items, lambda x: lower(trim(x, ' ')))), chr(31)) fp from d), m as (select *, row_number() over (partition by fp order by source, doc_id) > 1 duplicate from f)"


@query(f"with {_DOC_LINES} select doc_id, duplicate from m")
def deduplicate(spark: P, sf: str) -> D:
    return _documents_marked(spark, sf).select("doc_id", "duplicate")


@query(f"with {_DOC_LINES} select source, count(*) scanned, count(*) filter (duplicate) duplicates, count(*) filter (not duplicate and len(items) = 0) as empty, count(*) filter (not duplicate and len(items) > 0) kept, coalesce(sum(len(items)) filter (not duplicate), 0)::bigint slots from m group by grouping sets ((source), ())")
def drop_waterfall(spark: P, sf: str) -> D:
    return B.drop_waterfall(_documents_marked(spark, sf))


@query(f"with {X.BASKETS} select count(*) baskets, sum(len(items))::bigint slots, min(len(items)) min_size, max(len(items)) max_size, round(avg(len(items)), 6) mean_size, count(distinct source) sources, count(distinct lang) langs, 0::bigint unsorted, 0::bigint out_of_range from baskets")
def coverage(spark: P, sf: str) -> D:
    return B.coverage(X.baskets(spark, sf), 64)


@query(f"with {X.BASKETS} select source, count(*) baskets, round(avg(len(items)), 6) mean_size, array_to_string(list_sort(list(distinct lang)), ',') langs from baskets group by 1")
def by_source(spark: P, sf: str) -> D:
    return B.by_source(X.baskets(spark, sf))


@query(f"with {X.SLOTS} select item_id, count(*) df, round(count(*) / (select count(*) from slots)::double, 6) share from slots group by 1 order by df desc, item_id limit 20")
def top_items(spark: P, sf: str) -> D:
    return B.top_items(X.baskets(spark, sf))


@query("with d as (select source, list_filter(regexp_extract_all(lower(text), '[a-zà-ÿ]+'), lambda w: length(w) >= 12) items from documents), g as (select source, count(*) n, count(*) filter (len(items) > 0) matched, round(avg(len(items)) filter (len(items) > 0), 6) mean_size, max(len(items)) largest from d group by 1), y as (select *, round(matched / n::double, 6) as yield from g) select source, n, matched, yield, mean_size, array_to_string(list_filter([case when yield < 0.9 then 'LOW YIELD' end, case when mean_size < 2.5 then 'THIN' end, case when largest > 40 then 'LONG' end], lambda x: x is not null), ',') flags from y")
def yield_audit(spark: P, sf: str) -> D:
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]+"), F.lit(0)), lambda w: F.length(w) >= 12)
    return B.yield_audit(table(spark, sf, "documents").select("source", words.alias("items")))


@query("with b as (select source as grp, case when contains(text, '!!') then 'shouting' when contains(text, ' | ') then 'table' when regexp_matches(text, '[#*$%&]{3}') then 'symbols' else 'other' end bucket from documents) select bucket, grp, count(*) n from b group by rollup (bucket, grp)")
def row_buckets(spark: P, sf: str) -> D:
    c = F.col("text")
    return B.row_buckets(table(spark, sf, "documents"), [("shouting", c.contains("!!")), ("table", c.contains(" | ")), ("symbols", c.rlike("[#*$%&]{3}"))], "source")


def _terms(spark: P, sf: str) -> D:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]+"), F.lit(0))
    return table(spark, sf, "documents").select("lang", F.col("doc_id").alias("basket_id"), F.explode(words).alias("term"))


_TERMS = "terms as (select lang, doc_id basket_id, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) term from documents)"


@query(f"with {_TERMS}, df as (select lang, term, count(distinct basket_id) df from terms where length(term) > 3 group by 1, 2 having count(distinct basket_id) >= 2), r as (select *, row_number() over (partition by lang order by df desc, term) as rank, sum(df) over (partition by lang) mass from df) select lang, term, df, rank, round(df / mass::double, 6) share from r where rank <= 500")
def unmapped_terms(spark: P, sf: str) -> D:
    t = _terms(spark, sf)
    return B.unmapped_terms(t, t.where(F.length("term") <= 3).select("lang", "term"))


@query(f"with {_TERMS}, c as (select lang, term, count(*) n from terms group by 1, 2), r as (select *, row_number() over (partition by lang order by n desc, term) as rank, sum(n) over (partition by lang order by n desc, term rows unbounded preceding) running, sum(n) over (partition by lang) total from c) select lang, term, n, rank, round(running / total::double, 6) covered from r where rank <= 400")
def frequent_forms(spark: P, sf: str) -> D:
    return B.frequent_forms(_terms(spark, sf))


@query(f"with {_TERMS}, x as (select lang, basket_id, term, row_number() over (partition by basket_id, term order by term) r from terms) select lang as source, case when length(term) > 6 then 'unrecognised' when r = 1 then 'kept' else 'duplicate' end cause, count(*) n from x group by 1, 2")
def line_coverage(spark: P, sf: str) -> D:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]+"), F.lit(0))
    rows = table(spark, sf, "documents").select(F.col("lang").alias("source"), F.col("doc_id").alias("basket_id"), F.posexplode(words).alias("line_no", "term"))
    return B.line_coverage(rows.withColumn("item_id", F.when(F.length("term") <= 6, F.col("term"))))


@query(
    f"with {_TERMS}, v as (select lang, basket_id, term, 'short' variant, case when length(term) <= 3 then term end item from terms union all select lang, basket_id, term, 'longer', case when length(term) <= 5 then term end from terms),"
    " g as (select lang, variant, round(count(item) / count(*)::double, 6) recall, round(count(distinct case when item is not null then basket_id || '-' || item end) / count(distinct basket_id)::double, 6) items_per_basket from v group by 1, 2)"
    " select g.lang, g.variant, g.recall, g.items_per_basket, round(g.recall - b.recall, 6) gain from g join g b on b.lang = g.lang and b.variant = 'short'"
)
def alias_gain(spark: P, sf: str) -> D:
    t = _terms(spark, sf)
    short = saved(t.where(F.length("term") <= 5).select("lang", "term").distinct(), "terms")
    alias = lambda n: short.where(F.length("term") <= n).select("lang", F.col("term").alias("surface"), F.col("term").alias("item_id"))
    return B.alias_gain(t.withColumnRenamed("term", "line"), [("short", alias(3)), ("longer", alias(5))])


@query("with k as (select source, dense_rank() over (order by source) - 1 source_rank, md5(text) as key from documents), f as (select key, min(source_rank) first_rank from k group by 1), u as (select distinct source, source_rank, key from k) select source, source_rank, count(*) unique_keys, count(*) filter (source_rank = first_rank) net_new from u join f using (key) group by 1, 2")
def net_new(spark: P, sf: str) -> D:
    from pyspark.sql import Window as W

    d = table(spark, sf, "documents")
    rank = d.select("source").distinct().withColumn("source_rank", F.row_number().over(W.orderBy("source")) - 1)  # a row for each source
    return B.net_new(d.select("source", F.md5("text").alias("key")).join(rank, "source"))


@query("with t(source, declared) as (values ('src0', 50::bigint), ('src1', 37), ('src99', 10)), f as (select source, count(*) found from documents group by 1) select source, coalesce(found, 0) found, declared, coalesce(found, 0) - declared delta, case when declared is null then 'undeclared' when coalesce(found, 0) = declared then 'equal' when found is null then 'missing' else 'differs' end status from f full join t using (source)")
def verify_counts(spark: P, sf: str) -> D:
    targets = spark.createDataFrame([("src0", 50), ("src1", 37), ("src99", 10)], "source string, declared long")
    return B.verify_counts(table(spark, sf, "documents"), targets)


@query(f"with {X.BASKETS} select array_to_string(items, ',') items, count(*) n, min(basket_id) first_basket from baskets where len(items) between 3 and 16 group by 1 having count(*) >= 2")
def recurring(spark: P, sf: str) -> D:
    return B.recurring(X.baskets(spark, sf), least=2).select(F.array_join("items", ",").alias("items"), "n", "first_basket")


@query(
    f"with {X.EDGES}, e as (select src, dst from edges where npmi >= 0.02), t as (select e.src, e.dst, c.item_id third, count(*) n from e join slots a on a.item_id = e.src join slots b on b.item_id = e.dst and b.basket_id = a.basket_id join slots c on c.basket_id = a.basket_id and c.item_id <> e.src and c.item_id <> e.dst group by 1, 2, 3),"
    " r as (select *, row_number() over (partition by src, dst order by n desc, third) as rank from t) select r.src, r.dst, cnt pair_count, third, rank, round_even(1000.0 * n / cnt, 0)::bigint permille from r join edges using (src, dst) where rank <= 10"
)
def pair_portrait(spark: P, sf: str) -> D:
    b = saved(B.baskets_from_rows(X.slots_by_name(spark, sf), "basket_id", "item_id"), "baskets")
    return B.pair_portrait(b, B.npmi_graph(b, threshold=0.02))


@query("with r as (select source, nullif(split_part(text, chr(10), 1), '') title, len(list_filter(string_split(text, chr(10))[2:], lambda x: trim(x, ' ') <> '')) > 0 and n_chars >= 500 good from documents) select source, count(*) n, count(title) titles, count(*) filter (regexp_matches(title, '\\p{L}')) usable_titles, count(*) filter (good) usable_steps from r group by grouping sets ((source), ())")
def content_coverage(spark: P, sf: str) -> D:
    lines = F.split("text", "\n")
    d = table(spark, sf, "documents").select("source", F.nullif(lines[0], F.lit("")).alias("title"), F.slice(lines, F.lit(2), F.size(lines)).alias("steps"), F.when(F.col("n_chars") < 500, "unparsed_steps").otherwise("ok").alias("status"))
    return B.content_coverage(d)


@query("with d as (select doc_id, split_part(text, chr(10), 1) title, string_split(text, chr(10)) steps from documents) select doc_id, trim(title, ' ') <> '' and len(list_filter(steps, lambda s: trim(s, ' ') <> '')) > 0 usable from d")
def usable_text(spark: P, sf: str) -> D:
    lines = F.split("text", "\n")
    return table(spark, sf, "documents").select("doc_id", B.usable_text(lines[0], lines, F.lit("ok")).alias("usable"))


@query(
    "with r as (select l_partkey fp, case when l_linenumber = 1 then l_quantity end total, case when l_linenumber = 2 then l_quantity end prep, case when l_linenumber = 3 then l_quantity end cook from lineitem),"
    " g as (select fp, count(distinct total) nt, count(distinct prep) np, count(distinct cook) nc, min(total) t, min(prep) p, min(cook) c from r group by 1), v as (select fp, nt, np, nc, case when nt <= 1 then t end total, case when np <= 1 then p end prep, case when nc <= 1 then c end cook from g),"
    " s as (select *, case when greatest(nt, np, nc) > 1 then 'ambiguous' when coalesce(greatest(prep, cook) > total + 1e-9, false) then 'inconsistent' when total is not null then 'source_total' else 'unknown' end time_status from v)"
    " select fp, case when time_status = 'source_total' then total end total, prep, cook, time_status, prep + cook derived_total from s"
)
def merge_metadata(spark: P, sf: str) -> D:
    l = table(spark, sf, "lineitem")
    at = lambda n, name: F.when(F.col("l_linenumber") == n, F.col("l_quantity")).alias(name)
    return B.merge_metadata(l.select(F.col("l_partkey").alias("fp"), at(1, "total"), at(2, "prep"), at(3, "cook")))


@query(f"with {X.EDGES}, e as (select src, dst from edges where npmi >= 0.03), d as (select item_id, count(*) n from (select src item_id from e union all select dst from e) group by 1) select items.item_id, coalesce(n, 0) degree from items left join d using (item_id)")
def degrees(spark: P, sf: str) -> D:
    return B.degrees(B.npmi_graph(X.baskets(spark, sf), threshold=0.03), X.items(spark, sf))


@query(f"with {X.BASKETS}, k as (select item_id from items where item_id % 3 <> 0), r as (select b.basket_id, b.source, count(*) n, count(k.item_id) k from baskets b join slots s using (basket_id) left join k using (item_id) group by 1, 2) select source, round(sum(k) / sum(n)::double, 6) token_coverage, round(sum(k * (k - 1) / 2) / nullif(sum(n * (n - 1) / 2), 0), 6) pair_coverage from r group by 1")
def attribute_coverage(spark: P, sf: str) -> D:
    return B.attribute_coverage(X.baskets(spark, sf), X.items(spark, sf).where("item_id % 3 <> 0"), "source")


@query("with h as (select o_orderkey k, ('0x' || substr(md5(concat_ws('|', o_orderkey, o_custkey, coalesce(o_orderstatus, 'null'), coalesce(o_orderpriority, 'null'))), 1, 15))::bigint h from orders) select count(*) n, min(k) least, max(k) largest, count(distinct k) as keys, sum(h)::varchar sum_hash, bit_xor(h) xor_hash from h")
def table_fingerprint(spark: P, sf: str) -> D:
    return B.table_fingerprint(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")


@query(f"with {X.SUBS}, t as (select a, b, tier from subs, (values (1), (2)) x(tier) where votes >= tier), g as (select tier, a, count(*) n from t group by 1, 2) select tier, sum(n)::bigint pairs, count(*) filter (n >= 3) anchors from g group by 1")
def label_tiers(spark: P, sf: str) -> D:
    return B.label_tiers(X.subs(spark, sf), (1, 2))


@query("with l as (select source, lang, doc_id % 50 item, doc_id % 3 = 0 miss from documents), x as (select source, lang, case when not miss then item end item_id from l) select source, lang, count(*) \"lines\", round(count(item_id) / count(*)::double, 6) match_rate, count(distinct item_id) seen, 60::bigint vocabulary, 60 - count(distinct item_id) unseen from x group by grouping sets ((source), (lang), ())")
def normalisation_audit(spark: P, sf: str) -> D:
    l = table(spark, sf, "documents").select("source", "lang", F.col("doc_id").alias("basket_id"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 50).alias("item_id"))
    return B.normalisation_audit(l, spark.range(60).withColumnRenamed("id", "item_id"))


# --- sinks ----------------------------------------------------------------------------------------


@query(f"with {X.SLOTS} select floor(item_id / 10)::bigint shard, min(item_id) first_id, count(*) n, string_agg(name, '|' order by item_id) names from items group by 1")
def shards(spark: P, sf: str) -> D:
    return S.shards(X.items(spark, sf).select("item_id", "name"), "item_id", 10).select("shard", "first_id", "n", F.array_join(F.transform("rows", lambda r: r["name"]), "|").alias("names"))


@query(f"with {_TERMS}, c as (select lang, term, count(*) n from terms group by 1, 2), r as (select *, row_number() over (partition by lang order by n desc, term) as rank from c) select lang, term, n, rank from r where rank <= 1500")
def ranked_terms(spark: P, sf: str) -> D:
    return S.ranked_terms(_terms(spark, sf).groupBy("lang", "term").agg(F.count("*").alias("n")))


@query(
    f"with {X.SUBS}, it as (select p_partkey item_id, p_name || ' ' || p_partkey as name, p_brand grp from part), dfs as (select l_partkey item_id, count(distinct l_orderkey) df from lineitem group by 1), v as (select a item_id, sum(votes)::bigint votes, count(*) degree from subs group by 1),"
    " t as (select a item_id, string_agg(name, ', ' order by r) substitutes from (select a, b, row_number() over (partition by a order by votes desc, b) r from subs) join it on it.item_id = b where r <= 3 group by 1)"
    " select it.item_id, name, grp, df, coalesce(degree, 0) degree, coalesce(votes, 0) votes, coalesce(substitutes, '') substitutes from it join dfs using (item_id) left join v using (item_id) left join t using (item_id)"
)
def item_catalogue(spark: P, sf: str) -> D:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.concat_ws(" ", "p_name", "p_partkey").alias("name"), F.col("p_brand").alias("grp"))
    items = part.join(B.frequencies(X.part_baskets(spark, sf)), "item_id")
    subs = X.subs(spark, sf)
    return S.item_catalogue(items, subs.groupBy(F.col("a").alias("item_id")).agg(F.count("*").alias("degree")), subs)


# --- data quality ---------------------------------------------------------------------------------


@query(f"with {X.ITEMS} select item_id, name name_1, case when item_id % 9 <> 0 then upper(name) end name_2 from items where item_id % 4 = 0 or item_id % 9 = 0")
def vocabulary_alignment(spark: P, sf: str) -> D:
    v = X.items(spark, sf)
    other = v.where("item_id % 9 <> 0").withColumn("name", F.when(F.col("item_id") % 4 == 0, F.upper("name")).otherwise(F.col("name")))
    return Q.vocabulary_alignment(v, other)


@query(f"with {X.BASKETS}, c as (select * from baskets where basket_id % 10 <> 0) select 'slots' as \"check\", (select sum(len(items)) from baskets) - (select sum(len(items)) from c) violations union all select 'sets', (select count(*) from baskets where basket_id % 10 = 0)")
def verify_catalog(spark: P, sf: str) -> D:
    b = X.baskets(spark, sf)
    return Q.verify_catalog(b.where("basket_id % 10 <> 0"), b).where(F.col("check").isin("slots", "sets"))


@query(f"with {X.BASKETS} select basket_id, array_to_string(list_filter(items, lambda x: x <> 5), ',') as now, array_to_string(items, ',') as \"then\" from baskets where list_contains(items, 5)")
def replay(spark: P, sf: str) -> D:
    b = X.baskets(spark, sf).select("basket_id", "items")
    return Q.replay(b.withColumn("items", F.array_remove("items", 5)), b).select("basket_id", F.array_join("now", ",").alias("now"), F.array_join("then", ",").alias("then"))


@query("with r as (select p_partkey id, lower(p_name) as name from part), x as (select p_partkey id, case when p_partkey % 100 = 0 then 'x' else p_name end as name from part) (select *, 'missing' side from r except all select *, 'missing' from x) union all (select *, 'surplus' from x except all select *, 'surplus' from r)")
def export_difference(spark: P, sf: str) -> D:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return Q.export_difference(p.withColumn("name", F.lower("name")), p.withColumn("name", F.when(F.col("id") % 100 == 0, "x").otherwise(F.col("name"))))


@query("select count(*) n, count(*) filter (o_orderstatus <> 'F') value_without_status, 0::bigint status_without_value, count(*) filter (o_totalprice <= 0) not_positive from orders")
def provenance(spark: P, sf: str) -> D:
    return Q.provenance(table(spark, sf, "orders"), "o_totalprice", "o_orderstatus", "F")


@query(f"with {X.SLOTS}, p as (select *, row_number() over (partition by basket_id order by item_id) - 1 pos, count(*) over (partition by basket_id) n from slots), m as (select item_id, avg(pos / (n - 1)::double) place from p where n >= 2 group by 1) select count(*) items, round(corr(item_id, place), 6) bias from m")
def index_bias(spark: P, sf: str) -> D:
    return Q.index_bias(X.baskets(spark, sf))


@query(
    "with a as (select l_orderkey source, l_linenumber row_no, l_partkey as key from lineitem), g as (select source, row_no, min(key) as key from a group by 1, 2), b as (select source, row_no, case when key % 5 = 0 then -1 else key end as key from g where key % 7 <> 0)"
    " select source, count(*) filter (b.key = g.key) matched, count(*) filter (b.key <> g.key) differ, count(*) filter (b.key is null) only_reader, 0::bigint only_metadata from g left join b using (source, row_no) group by 1"
)
def stream_alignment(spark: P, sf: str) -> D:
    a = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("row_no")).agg(F.min("l_partkey").alias("key"))
    b = a.where("key % 7 <> 0").withColumn("key", F.when(F.col("key") % 5 == 0, F.lit(-1)).otherwise(F.col("key")))
    return Q.stream_alignment(a, b)


@query("with g as (select lang, text, count(distinct source) versions, min(source) s from documents group by 1, 2) select doc_id, versions, case when versions = 1 then s end right_source, versions > 1 ambiguous from documents join g using (lang, text)")
def content_join(spark: P, sf: str) -> D:
    d = table(spark, sf, "documents")
    return Q.content_join(d.select("doc_id", "lang", "text"), d.select("lang", "text", "source"), ["lang", "text"]).select("doc_id", "versions", "right_source", "ambiguous")


@query(f"with {X.ITEMS}, s as (select floor(item_id / 10)::bigint sh, min(item_id) first_id, count(*) n from items group by 1) select 'link_status' as \"check\", count(*) filter (item_id % 5 = 0)::bigint violations from items union all select 'sets', 0 union all select 'long_titles', count(*) filter (length(name) > 8) from items union all select 'id_gaps', 0 union all select 'shards', 0")
def public_checks(spark: P, sf: str) -> D:
    v = X.items(spark, sf).select(F.col("item_id").alias("id"), F.array("item_id").alias("items"), F.col("name").alias("title"), F.when(F.col("item_id") % 5 != 0, "x").alias("link"), F.lit("source").alias("link_status"))
    return Q.public_checks(v, S.shards(v.select("id", "title"), "id", 10), longest=8)
