"""Queries of text normalisation, raw sources, and the streaming jobs on their static counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import normalise as N
from ..session import table
from ..sources import readers as R
from ..streaming import jobs as J
from . import bindings as X
from .registering import collector

QUERIES, ORACLE_SQL, query = collector()
D = DataFrame
P = SparkSession


def _alias(spark: P, sf: str) -> D:
    return N.alias_table(X.items(spark, sf))[0]


_ALIAS = f"""{X.ITEMS}, al0 as (select name surface, item_id, 0 prio from items union all select replace(name, '_', ' '), item_id, 1 from items),
al1 as (select * from al0 union all select case when regexp_matches(surface, '(s|x|z|ch|sh|o)$') then surface || 'es' when regexp_matches(surface, '[^aeiou]y$') then regexp_replace(surface, 'y$', '') || 'ies' else surface || 's' end, item_id, prio + 10 from al0 where prio > 0), alias as (select surface, arg_min(item_id, (prio, item_id)) item_id from al1 group by 1)"""


@query(f"with {_ALIAS} select * from alias")
def alias_table(spark: P, sf: str) -> D:
    return _alias(spark, sf)


def _lines(spark: P, sf: str) -> D:
    """Lines like those of recipes from line items: an amount and a name, sometimes plural."""
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    l = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    text = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" "), F.when(F.col("l_linenumber") % 3 == 0, "cups ").otherwise(""), F.col("p_name"), F.when(F.col("l_quantity") > 1, "s").otherwise(""))
    return l.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line_id"), F.col("l_orderkey").alias("basket_id"), text.alias("line"), "p_name").dropDuplicates(["line_id"])


_LINES = "ln as (select distinct on (line_id) * from (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) line_id, l_orderkey basket_id, l_quantity::int || ' ' || case when l_linenumber % 3 = 0 then 'cups ' else '' end || p_name || case when l_quantity > 1 then 's' else '' end line, p_name, l_quantity from lineitem join part on l_partkey = p_partkey))"


@query(f"with {_LINES} select distinct line_id, p_name || case when line like '%s' and not p_name like '%s' then 's' else '' end bare from ln where l_quantity > 1")
def strip_quantity(spark: P, sf: str) -> D:
    l = _lines(spark, sf).where(~F.col("line").startswith("1 "))
    return l.select("line_id", N.strip_quantity(F.col("line")).alias("bare"))


@query(f"with {_ALIAS}, {_LINES} select line_id, item_id from ln join items on name = p_name")
def match_exact(spark: P, sf: str) -> D:
    l = _lines(spark, sf).select("line_id", N.strip_quantity(F.col("line")).alias("line"))
    return N.match_exact(l, _alias(spark, sf), modifiers=("fresh",)).select("line_id", "item_id")


@query(f"with {_ALIAS}, {_LINES} select line_id, item_id, case when contains(line, 'cups ') then 2 else 1 end pos, 2 n from ln join items on name = p_name where not (l_quantity > 1 and p_name like '%o')")
def match_phrases(spark: P, sf: str) -> D:
    return N.match_phrases(_lines(spark, sf).select("line_id", "line"), _alias(spark, sf))


@query(f"with {_ALIAS}, p as (select p_partkey line_id, replace(p_name, ' ', '') || p_partkey line, p_name from part) select line_id, item_id from p join items on name = p_name")
def match_unspaced(spark: P, sf: str) -> D:
    alias = X.items(spark, sf).select(F.replace("name", F.lit(" "), F.lit("")).alias("surface"), "item_id")
    return N.match_unspaced(table(spark, sf, "part").select(F.col("p_partkey").alias("line_id"), F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.col("p_partkey").cast("string")).alias("line")), alias)


@query(f"with {X.ITEMS}, {_LINES} select basket_id, string_agg(distinct item_id, ',' order by item_id) items from ln join items on name = p_name group by 1")
def normalise_baskets(spark: P, sf: str) -> D:
    raw = _lines(spark, sf).groupBy("basket_id").agg(F.collect_list("line").alias("lines")).withColumn("lang", F.lit("en"))
    alias = _alias(spark, sf).withColumn("lang", F.lit("en"))
    return N.normalise_baskets(raw, alias).select("basket_id", F.array_join("items", ",").alias("items"))


@query(f"with {_LINES} select distinct line_id, p_name || case when l_quantity > 1 then 's' else '' end term from ln")
def clean_terms(spark: P, sf: str) -> D:
    l = _lines(spark, sf).withColumn("line", F.when(F.col("basket_id") % 2 == 0, F.concat(F.regexp_replace("line", "^[0-9]+ (cups )?", ""), F.lit(": 3 cups"))).otherwise(F.col("line")))
    return l.select("line_id", N.clean_terms(F.col("line")).alias("term"))


@query(f"with {X.ITEMS} select p_partkey text_id, item_id, 'bare' as way from part join items on name = p_name")
def resolve_names(spark: P, sf: str) -> D:
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("text_id"), F.concat(F.lit("Fresh "), F.col("p_name")).alias("text"))
    return N.resolve_names(t, X.items(spark, sf), _alias(spark, sf).where("false"), modifiers=("fresh",))


@query(f"with {_ALIAS}, {_LINES} select distinct line_id text_id, item_id, p_name || case when l_quantity > 1 then 's' else '' end surface from ln join items on name = p_name where not (l_quantity > 1 and p_name like '%o')")
def resolve_ngrams(spark: P, sf: str) -> D:
    return N.resolve_ngrams(_lines(spark, sf).select(F.col("line_id").alias("text_id"), F.col("line").alias("text")), X.items(spark, sf), _alias(spark, sf))


@query(f"with {X.ITEMS} select p_partkey name_id, item_id from part join items on name = p_name")
def match_loose(spark: P, sf: str) -> D:
    n = table(spark, sf, "part").select(F.col("p_partkey").alias("name_id"), F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit("S 1")).alias("name"))
    return N.match_loose(n, X.items(spark, sf))


@query()
def clean_card_text(spark: P, sf: str) -> D:
    footer = F.regexp_extract("html", r"(?s)<footer>(.*?)</footer>", 1)
    return table(spark, sf, "pages").select("page_id", N.clean_card_text(footer).alias("text"))


@query("with f as (select page_id, regexp_extract_all(html, '<li><a[^>]*>([^<]*)</a></li>', 1) x from pages) select page_id, array_to_string(list_filter(list_transform(x, lambda v: trim(regexp_replace(v, '\\s+', ' ', 'g'), ' ')), lambda v: v <> ''), '|') items from f")
def item_lines(spark: P, sf: str) -> D:
    menu = F.regexp_replace(F.regexp_extract("html", r"(?s)<nav>(.*?)</nav>", 1), "</?(?:a|ul)[^>]*>", "")
    return table(spark, sf, "pages").select("page_id", F.array_join(N.item_lines(menu), "|").alias("items"))


@query("with p as (select p_partkey id, p_name, p_size, p_partkey % 4 k from part) select id, 2 n_items, case k when 0 then 'complete' when 1 then 'values_without_units' when 2 then 'count_mismatch' else 'not_supplied' end quantity_status, case when id % 3 = 0 then 'unparsed_steps' else 'ok' end text_status from p")
def decode_lists(spark: P, sf: str) -> D:
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    items = F.when(k == 0, F.concat(F.lit('["'), "p_name", F.lit('", "salt"]'))).when(k == 1, F.concat(F.lit("['"), "p_name", F.lit("', 'salt']"))).otherwise(F.concat(F.lit('c("'), "p_name", F.lit('", "salt")')))
    q = F.when(k == 0, F.concat(F.lit('["'), size, F.lit(' g", "1 pinch"]'))).when(k == 1, F.concat(F.lit('c("'), size, F.lit('", NA)'))).when(k == 2, F.concat(F.lit('["'), size, F.lit('"]')))
    steps = F.when(F.col("p_partkey") % 3 == 0, F.lit("stir; serve")).otherwise(F.lit("['stir', 'serve']"))
    d = N.decode_lists(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), items.alias("items"), q.alias("quantities"), steps.alias("steps")))
    return d.select("id", F.size("items").alias("n_items"), "quantity_status", "text_status")


@query("with p as (select p_partkey id, p_size s, p_partkey % 6 k from part) select id, case k when 0 then s + 60.0 when 1 then s when 2 then 60.0 + s % 60 when 3 then s * 1440.0 end::double \"minutes\", case when k <= 3 then 'provided' when k = 4 then 'invalid' else 'missing' end status from p")
def durations(spark: P, sf: str) -> D:
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    value = F.when(k == 0, F.concat(F.lit("PT1H"), s, F.lit("M"))).when(k == 1, s).when(k == 2, F.concat(F.lit("1 hour "), (F.col("p_size") % 60).cast("string"), F.lit(" min"))).when(k == 3, F.concat(s, F.lit("天"))).when(k == 4, F.concat(s, F.lit("-60 min"))).otherwise(F.lit("n/a"))
    enc = F.when(k == 0, "iso8601").when(k == 1, "minutes").when(k == 3, "zh").otherwise("en")
    return N.durations(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), value.alias("value"), enc.alias("encoding"))).select("id", "d.*")


@query("with p as (select p_partkey id, p_size s, p_partkey % 4 k from part) select id, case when k <= 1 then s::double end n, case when k <= 1 then 'provided' when k = 2 then 'invalid' else 'missing' end status from p")
def counts(spark: P, sf: str) -> D:
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    value = F.when(k == 0, s).when(k == 1, F.concat(s, F.lit(" servings"))).when(k == 2, F.concat(s, F.lit("-99 servings")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), N.count_of(value, F.lit("en")).alias("c")).select("id", "c.*")


@query("with u as (select page_id, case page_id % 4 when 0 then url when 1 then regexp_replace(url, '^https?://', '') when 2 then url || '&token=abc' else regexp_replace(url, '://', '://me@') end u, page_id % 4 k, url from pages), x as (select *, case when k = 3 then 'user in host' when k = 2 and contains(url, '?') then 'sensitive query' end reason from u) select page_id, case when reason is null then case when k = 1 then 'http://' || u else u end end as url, reason from x")
def normal_urls(spark: P, sf: str) -> D:
    k = F.col("page_id") % 4
    u = F.when(k == 0, F.col("url")).when(k == 1, F.regexp_replace("url", "^https?://", "")).when(k == 2, F.concat("url", F.lit("&token=abc"))).otherwise(F.regexp_replace("url", "://", "://me@"))
    return table(spark, sf, "pages").select("page_id", N.normal_url(u).alias("x")).select("page_id", "x.*")


@query("with h as (select page_id id, url, regexp_extract(url, '://([^/:?#]+)', 1) host, regexp_extract(url, '://[^/]+/([a-z]+)/', 1) lang from pages) select id, host, case when host like 'm.%' then case when lang = 'en' then url when lang = 'de' then 'https://archive.example/' || url end end link, case when not host like 'm.%' then 'unmeasured' when lang = 'en' then 'source' when lang = 'de' then 'archive' else 'offline' end status from h")
def resolve_links(spark: P, sf: str) -> D:
    p = table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url", F.lit("A title").alias("title"))
    hosts = p.select(N.host_of(F.col("url")).alias("host")).distinct().where("host like 'm.%'")
    rules = hosts.select("host", F.explode(F.array(*[F.struct(F.lit(i).alias("rule_no"), F.lit(a).alias("prefix"), F.lit(s).alias("status"), F.lit(t).alias("template")) for i, (a, s, t) in enumerate((("/en/", "source", "{url}"), ("/de/", "archive", "https://archive.example/{url}"), ("/", "offline", "")))])).alias("r")).select("host", "r.*")
    return N.resolve_links(p, rules)


@query("select p_partkey id, case when contains(p_name, 'ring') or contains(p_name, 'gear') then 'round' when contains(p_name, 'bolt') then 'long' else 'other' end as class from part")
def first_class(spark: P, sf: str) -> D:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), N.first_class(F.col("p_name"), [("round", ["ring", "gear"]), ("long", ["bolt"])]).alias("class"))


@query("select distinct p_name as name, array_to_string(list_distinct([p_name || ' oil', p_name, replace(p_name, ' ', '_') || '_oil', replace(p_name, ' ', '') || 'oil', 'oil']), '|') as forms, 5 n from part where false union all select p_name, p_name || ' oil|' || p_name || '|' || replace(p_name, ' ', '_') || '_oil|' || replace(p_name, ' ', '') || 'oil|oil', 5 from (select distinct p_name from part)")
def entity_aliases(spark: P, sf: str) -> D:
    n = table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    forms = N.entity_aliases(F.concat("name", F.lit(" Oil (raw)")))
    return n.select("name", F.array_join(forms, "|").alias("forms"), F.size(forms).alias("n"))


@query("with l as (select p_name a, split_part(p_type, ' ', 1) b from part), v as (select lower(a) a, lower(b) b, count(*) votes from l where lower(a) <> lower(b) group by 1, 2) select a, b, votes, true a_known, false b_known from v")
def parse_substitutions(spark: P, sf: str) -> D:
    p = table(spark, sf, "part")
    return N.parse_substitutions(p.select(F.concat_ws(": ", "p_name", F.substring_index("p_type", " ", 1)).alias("line")), p.select(F.col("p_name").alias("name")))


@query("select item_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' ') as key from benchmark")
def title_keys(spark: P, sf: str) -> D:
    return table(spark, sf, "benchmark").select("item_id", N.title_key(F.col("text")).alias("key"))


@query(f"with {X.ITEMS}, t as (select split_part(name, ' ', 2) surface, min(item_id) item_id from items group by 1), f as (select name term, count(*) df from items join part on p_name = name group by 1), h as (select surface, item_id, term, df from t join f on contains(term, surface) and term <> surface) select surface, item_id, arg_max(term, (df, term)) inside, max(df) df from h group by 1, 2")
def alias_hazards(spark: P, sf: str) -> D:
    new = X.items(spark, sf).groupBy(F.substring_index("name", " ", -1).alias("surface")).agg(F.min("item_id").alias("item_id"))
    freq = table(spark, sf, "part").groupBy(F.col("p_name").alias("term")).agg(F.count("*").alias("df")).withColumn("item_id", F.lit(None).cast("long"))
    return N.alias_hazards(new, freq)


# --- sources --------------------------------------------------------------------------------------


@query("with r as (select source, doc_id, row_number() over (partition by source order by doc_id) n from documents) select source, doc_id row_no from r where n <= 5")
def first_rows(spark: P, sf: str) -> D:
    return R.first_rows(table(spark, sf, "documents").select("source", F.col("doc_id").alias("row_no")), 5)


@query("select doc_id, nullif(trim(lang, ' '), '') text_title, cast(null as varchar) text_url, nullif(trim(source, ' '), '') text_steps, cast(null as varchar) text_quantities from documents")
def declared_texts(spark: P, sf: str) -> D:
    return R.declared_texts(table(spark, sf, "documents").select("doc_id", "lang", "source"), {"title": ["headline", "lang"], "url": ["link"], "steps": ["source"]}).select("doc_id", "text_title", "text_url", "text_steps", "text_quantities")


@query("select doc_id, cast(n_chars as varchar) raw_total, 'minutes' total_encoding, 'not declared' prep_encoding from documents")
def declared_metadata(spark: P, sf: str) -> D:
    return R.declared_metadata(table(spark, sf, "documents"), {"total": ("n_chars", "minutes")}).select("doc_id", "raw_total", "total_encoding", "prep_encoding")


@query("select doc_id from documents where source = 'src3' order by doc_id limit 5")
def peek(spark: P, sf: str) -> D:
    return R.peek(table(spark, sf, "documents").withColumn("row_no", F.col("doc_id")), "src3").select("doc_id")


# --- continuous jobs, run over the events as a finite stream -----------------------------------------


def _events(spark: P, sf: str) -> D:
    return table(spark, sf, "events")


@query("select time_bucket(interval '1 day', ts) as start, event_type as source, count(*) scanned, count(*) filter (user_id % 5 = 0) as empty, sum(case when user_id % 5 = 0 then 0 else 2 end)::bigint slots from events group by 1, 2")
def stream_waterfall(spark: P, sf: str) -> D:
    e = _events(spark, sf).select("ts", F.col("event_type").alias("source"), F.when(F.col("user_id") % 5 != 0, F.array("event_type", "props")).alias("items"))
    return J.waterfall(e, "ts", "1 day", "1 hour")


@query("with g as (select *, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval '2 hours', true) as fresh from events), s as (select *, sum(fresh::int) over (partition by user_id order by ts) sid from g) select user_id, min(ts) as start, array_to_string(list_sort(list(distinct event_type)), ',') items, count(*) n from s group by user_id, sid")
def session_baskets(spark: P, sf: str) -> D:
    s = J.session_baskets(_events(spark, sf), "ts", "user_id", "event_type", "2 hours", "1 hour")
    return s.select("user_id", "start", F.array_join("items", ",").alias("items"), "n")


@query("with s as (select distinct user_id, event_type from events) select event_type item_id, count(*) df from s group by 1")
def stream_frequencies(spark: P, sf: str) -> D:
    b = _events(spark, sf).groupBy("user_id").agg(F.collect_set("event_type").alias("items"))
    return J.incremental_frequencies(b)


@query(f"with {X.EDGES}, s as (select basket_id, list(item_id) items from slots where basket_id % 20 = 0 group by 1), x as (select basket_id, items, unnest(items) a from s) select basket_id, b, sum(round(weight, 9)::decimal(18, 9))::double score from x join both_ways using (a) where not list_contains(items, b) group by 1, 2")
def stream_scores(spark: P, sf: str) -> D:
    from ..operators.graph import both_ways
    from .graph_queries import baskets_of, edges_of

    return J.scored(baskets_of(spark, sf).where("basket_id % 20 = 0"), both_ways(edges_of(spark, sf)))
