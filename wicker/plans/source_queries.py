"""Queries of sources and sinks: the given tables are written in a source's format, read back by its reader, and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import baskets as B, evaluate as E
from ..session import shared_path, table
from ..sources import readers as R, sinks as S
from ..streaming import jobs as J
from . import bindings as X
from .registering import collector

QUERIES, ORACLE_SQL, query = collector()
D = DataFrame
P = SparkSession


def _parts(spark: P, sf: str) -> D:
    """Parts as records; the first item of each is its key, so that rows can be told apart."""
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.array(F.col("p_partkey").cast("string"), "p_name", "p_brand", "p_type").alias("items"))


def _read(rows: D) -> D:
    return rows.select("source", "lang", F.array_join("items", "|").alias("items"))


def _sql(key: str, items: str = "concat_ws('|', p_partkey, p_name, p_brand, p_type)") -> str:
    return f"select '{key}' source, 'en' lang, {items} items from part"


def _written(rows: D, kind: str, name: str, **options) -> str:
    path = shared_path(rows.sparkSession, name)
    rows.write.format(kind).options(**options).save(path)
    return path


@query(_sql("csv"))
def read_csv(spark: P, sf: str) -> D:
    path = _written(_parts(spark, sf).select(F.array_join("items", ", ").alias("text"), F.lit('a "quoted", text').alias("other")), "csv", "csv", header=True, escape='"')
    return _read(R.read_source(spark, R.Source("csv", "en", "csv", path, "text", R.commas)))


@query(_sql("parquet"))
def read_parquet(spark: P, sf: str) -> D:
    path = _written(_parts(spark, sf), "parquet", "parquet")
    return _read(R.read_source(spark, R.Source("parquet", "en", "parquet", path, "items")))


@query(_sql("jsonl"))
def read_jsonl(spark: P, sf: str) -> D:
    good = F.to_json(F.struct("items"))
    rows = _parts(spark, sf).select(F.explode(F.array(good, F.concat(F.lit("{broken "), F.col("p_partkey").cast("string")))).alias("value"))
    return _read(R.read_source(spark, R.Source("jsonl", "en", "jsonl", _written(rows, "text", "jsonl"), "items")))


@query(_sql("json"))
def read_json(spark: P, sf: str) -> D:
    """A file for each thousand parts, one JSON document each."""
    docs = _parts(spark, sf).groupBy(F.floor(F.col("p_partkey") / 1000).alias("b")).agg(F.collect_list(F.struct("items")).alias("recipes")).select(F.to_json(F.struct("recipes")).alias("value"))
    path = _written(docs, "text", "json", maxRecordsPerFile=1)
    return _read(R.read_source(spark, R.Source("json", "en", "json", path, "items", options={"under": "recipes"})))


@query("select p_partkey id, concat_ws('|', lower(p_name), lower(p_brand)) keys from part where lower(p_name) <> lower(p_brand)")
def dict_keys(spark: P, sf: str) -> D:
    p = table(spark, sf, "part")
    text = F.concat(F.lit("{' "), "p_name", F.lit(" ': '2 cups', '"), F.upper("p_brand"), F.lit("': None}"))
    return p.select(F.col("p_partkey").alias("id"), F.array_join(R.dict_keys(text), "|").alias("keys"))


@query("with s as (select distinct l_orderkey o, p_name from lineitem join part on l_partkey = p_partkey) select 'long' source, 'en' lang, string_agg(p_name, '|' order by p_name) items, count(*) n from s group by o")
def read_long(spark: P, sf: str) -> D:
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.col("l_linenumber").alias("ingredient_number"), F.col("l_quantity").alias("Ingredient quantity"), F.col("p_name").alias("Ingredient name"))
    path = _written(rows, "csv", "long", header=True)
    return R.read_source(spark, R.Source("long", "en", "long", path, "l_orderkey")).select("source", "lang", F.array_join("items", "|").alias("items"), F.size("items").cast("long").alias("n"))


@query(_sql("graph"))
def read_linked_data(spark: P, sf: str) -> D:
    page = F.struct(F.lit("WebPage").alias("@type"), F.lit(None).cast("array<string>").alias("recipeIngredient"))
    recipe = F.struct(F.lit("Recipe").alias("@type"), F.col("items").alias("recipeIngredient"))
    rows = _parts(spark, sf).select(F.to_json(F.struct(F.array(page, recipe).alias("@graph"))).alias("value"))
    return _read(R.read_source(spark, R.Source("graph", "en", "graph", _written(rows, "text", "graph"))))


#: What follows a transcript's first line stands for its list of items.
_CHAT = (
    "with t as (select conv_id, string_agg(text, chr(10) order by turn) x from conversations where role = 'assistant' group by 1), l as (select conv_id, substr(x, 1, 60) b, string_split(x, chr(10))[2:] ls from t),"
    " e as (select *, coalesce(list_position(list_transform(ls, lambda v: trim(v, ' ' || chr(9) || chr(13)) = ''), true), 0) blank from l),"
    " s as (select conv_id, b, list_filter(list_transform(case when blank > 0 then ls[1:blank - 1] else ls end, lambda v: trim(ltrim(v, '-*•.0123456789 ' || chr(9) || chr(13)), ' ' || chr(9) || chr(13))), lambda v: length(v) between 2 and 79) items from e),"
    " k as (select * from s where len(items) >= 2), f as (select b, min(conv_id) conv_id from k group by 1)"
)


@query(_CHAT + " select conv_id, array_to_string(items, '|') items from k semi join f using (b, conv_id)")
def chat_items(spark: P, sf: str) -> D:
    return R.chat_items(table(spark, sf, "conversations"), headings=None).select("conv_id", F.array_join("items", "|").alias("items"))


@query(_CHAT + ", h as (select b, count(*) n from k group by 1) select array_to_string(items, '|') items from k semi join f using (b, conv_id) semi join (select b from h where n = 1) using (b)")
def read_chat(spark: P, sf: str) -> D:
    """Transcripts whose beginning is theirs alone: of equal ones a file's first stays, whose items may differ."""
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    whole = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("messages"))
    said = F.array_join(F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: m["content"]), "\n")
    alone = whole.withColumn("begin", F.substring(said, 1, 60))
    found = R.read_source(spark, R.Source("chat", "en", "chat", _written(alone.select("messages"), "json", "chat"), "messages", options={"headings": None}))
    once = R.chat_items(table(spark, sf, "conversations"), prefix=1 << 30, headings=None).join(alone.select("conv_id", "begin"), "conv_id").groupBy("begin").agg(F.count("*").alias("n"), F.first("items").alias("items")).where("n = 1")
    return found.select(F.array_join("items", "|").alias("items")).join(once.select(F.array_join("items", "|").alias("items")).distinct(), "items", "left_semi")


@query(_sql("cells", "case when p_partkey % 2 = 0 then concat_ws('|', p_partkey, p_name) else p_partkey || ': ' || p_size || '|' || p_name || ': ' || p_brand end"))
def read_cells(spark: P, sf: str) -> D:
    p = table(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    heads = F.concat(F.lit("<table><tr><th>"), key, F.lit("</th><th class='x'><b>"), "p_name", F.lit("</b></th></tr></table>"))
    row = lambda a, b: F.concat(F.lit("<tr><td>"), a, F.lit("</td> <td>"), b, F.lit("</td></tr>"))
    text = F.when(F.col("p_partkey") % 2 == 0, heads).otherwise(F.concat(row(key, F.col("p_size").cast("string")), row(F.col("p_name"), F.col("p_brand"))))
    return _read(R.read_source(spark, R.Source("cells", "en", "cells", _written(p.select(text.alias("html")), "csv", "cells", header=True, escape='"'), "html")))


@query(_sql("prompt", "concat_ws('|', p_partkey, p_name)"))
def read_prompt(spark: P, sf: str) -> D:
    p = table(spark, sf, "part")
    text = F.concat(F.lit("Cook something. Ingredients: ['"), F.col("p_partkey").cast("string"), F.lit("', '"), "p_name", F.lit("']"))
    return _read(R.read_source(spark, R.Source("prompt", "en", "prompt", _written(p.select(text.alias("text")), "csv", "prompt", header=True, escape='"'), "text")))


@query(_sql("dump"))
def read_dump(spark: P, sf: str) -> D:
    text = F.concat(F.lit("Title\nIngredients:\n"), F.array_join("items", "\n"), F.lit("\nDirections:\nstir\n"))
    rows = _parts(spark, sf).select(text.alias("value"))
    return _read(R.read_source(spark, R.Source("dump", "en", "dump", _written(rows, "text", "dump", lineSep="\n\n"))))


@query("select p_partkey id, concat_ws('|', lower(p_name), lower(p_brand)) items from part")
def entity_list(spark: P, sf: str) -> D:
    text = F.concat(F.lit("[\""), "p_name", F.lit("\", '"), "p_brand", F.lit(" ', \"\"]"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(R.entity_list(text), "|").alias("items"))


@query("select p_partkey id, case p_partkey % 4 when 3 then p_name else concat_ws('|', p_name, p_brand) end items from part")
def list_literals(spark: P, sf: str) -> D:
    """Lists of strings and of dicts, JSON and Python literals, and plain text."""
    k = F.col("p_partkey") % 4
    q = lambda a, b, c: F.concat(F.lit(a), "p_name", F.lit(b), "p_brand", F.lit(c))
    text = F.when(k == 0, q("[{'name': '", "', 'count': '1'}, {'ingredient': '", "'}]")).when(k == 1, q('[{"title": "', '"}, {"name": "', '"}]')).when(k == 2, q("['", "', '", "']")).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(R.list_literal(text), "|").alias("items"))


@query("select source, source_rank::int source_rank, count(*) n, sum(len(items))::bigint slots from (select 'a' source, 0 source_rank, [p_name, p_brand] items from part union all select 'b', 2, [p_name] from part where p_partkey % 2 = 0) group by 1, 2")
def read_all(spark: P, sf: str) -> D:
    """A registry table of three sources, of which two are read."""
    p = table(spark, sf, "part")
    a = _written(p.select(F.concat_ws(",", "p_name", "p_brand").alias("t")), "csv", "a", header=True, escape='"')
    b = _written(p.where("p_partkey % 2 = 0").select(F.array("p_name").alias("t")), "parquet", "b")
    entries = [{"key": "a", "lang": "en", "kind": "csv", "path": a, "column": "t", "splitter": "commas"}, {"key": "none", "lang": "en", "kind": "jsonl", "path": "/none"}, {"key": "b", "lang": "en", "kind": "parquet", "path": b, "column": "t"}]
    rows = R.read_all(spark, R.registry(entries), only=("a", "b"))
    return rows.groupBy("source", "source_rank").agg(F.count("*").alias("n"), F.sum(F.size("items")).alias("slots"))


# --- sinks ----------------------------------------------------------------------------------------


@query(f"with {X.BASKETS} select source, count(*) n, sum(len(items))::bigint slots from baskets group by 1")
def stored_baskets(spark: P, sf: str) -> D:
    """Baskets with nulls, repeats and empty ones, as read back from the store."""
    path = shared_path(spark, "baskets")
    b = X.baskets(spark, sf).select("basket_id", "source", F.concat(F.reverse("items"), "items", F.array(F.lit(None).cast("long"))).alias("items"))
    S.write_baskets(b.unionByName(b.withColumn("items", F.array().cast("array<bigint>"))), path)
    return S.read_baskets(spark, path).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.size("items")).alias("slots"))


@query(f"with {X.BASKETS} select count(*) n, sum(len(items))::bigint slots, 0::bigint nulls, true equal from baskets")
def exported_dataset(spark: P, sf: str) -> D:
    return S.export_dataset(X.baskets(spark, sf), shared_path(spark, "export"), max_rows=2000)


@query(f"with {X.BASKETS} select basket_id, array_to_string(items, ',') items, source from baskets")
def stored_catalog(spark: P, sf: str) -> D:
    path = shared_path(spark, "catalog")
    S.write_catalog(X.baskets(spark, sf).select("basket_id", "items", "source"), path)
    return spark.read.parquet(path).select("basket_id", F.array_join("items", ",").alias("items"), "source")


@query(f"with {X.EDGES} select src, dst, cnt as \"count\", '-0.15' threshold, '2' min_count from edges")
def stored_graph(spark: P, sf: str) -> D:
    path = shared_path(spark, "graph")
    edges = B.npmi_graph(B.baskets_from_rows(X.slots_by_name(spark, sf), "basket_id", "item_id"))
    S.write_graph(edges, path, threshold=-0.15, min_count=2)
    back, meta = S.read_graph(spark, path)
    return back.select("src", "dst", "count", *[F.lit(meta[k]).alias(k) for k in ("threshold", "min_count")])


@query("with r as (select o_orderpriority || '-' || o_orderstatus run, round(avg(o_totalprice), 4) price, count(*) n from orders group by 1) select 'run=' || run run, 'price' metric, price as value from r union all select 'run=' || run, 'n', n from r")
def read_metrics(spark: P, sf: str) -> D:
    """A metric file for each priority and status, read back as one long table."""
    path = shared_path(spark, "metrics")
    o = table(spark, sf, "orders").groupBy(F.concat_ws("-", "o_orderpriority", "o_orderstatus").alias("run")).agg(F.round(F.avg("o_totalprice"), 4).alias("price"), F.count("*").alias("n"), F.lit("text").alias("note"))
    o.write.partitionBy("run").json(path)
    return S.read_metrics(spark, f"{path}/*").withColumn("run", F.url_decode("run"))


# --- continuous jobs on their static counterparts, and the protocol check -----------------------------


@query(f"with {X.ITEMS}, l as (select l_orderkey, l_linenumber, item_id from lineitem join part on l_partkey = p_partkey join items on name = p_name) select l_orderkey basket_id, array_to_string(list_sort(list(distinct item_id)), ',') items from l group by 1")
def stream_normalised(spark: P, sf: str) -> D:
    part = table(spark, sf, "part").select("p_partkey", F.concat(F.lit(" "), F.upper("p_name")).alias("line"))
    rows = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    lines = rows.groupBy(F.col("l_orderkey").alias("basket_id")).agg(F.collect_list("line").alias("items"))
    done = J.normalised(lines, X.items(spark, sf).select(F.col("name").alias("surface"), "item_id"))
    return done.select("basket_id", F.array_join("items", ",").alias("items"))


@query("select event_type, count(*) n from (select distinct event_type, user_id from events) group by 1")
def stream_first_wins(spark: P, sf: str) -> D:
    """The events as a stream, read to its end; the state of all of them is inside the watermark."""
    e = table(spark, sf, "events")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = stream.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.array("event_type", F.col("user_id").cast("string")).alias("items"))
    path = shared_path(spark, "first-wins")
    J.first_wins(rows, "ts", "3650 days").writeStream.format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "with p as (select * from (values ('vectors', 'edge-holdout'), ('basket', 'edge-holdout'), ('graph', 'full'), ('graph', 'basket-holdout')) t(reads, split))"
    " select reads, split, reads in ('basket', 'graph') and split in ('edge-holdout', 'full') refused, case when reads in ('basket', 'graph') and split in ('edge-holdout', 'full') then 0 else (select count(*) from orders) end n from p"
)
def protocol_checked(spark: P, sf: str) -> D:
    """Orders that each protocol would score: none where the check refuses it."""
    rows = None
    for reads, split in (("vectors", "edge-holdout"), ("basket", "edge-holdout"), ("graph", "full"), ("graph", "basket-holdout")):
        try:
            E.check_protocol(reads, split)
            refused = False
        except ValueError:
            refused = True
        one = table(spark, sf, "orders").where(F.lit(not refused)).agg(F.count("*").alias("n")).select(F.lit(reads).alias("reads"), F.lit(split).alias("split"), F.lit(refused).alias("refused"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows
