"""Sources of raw records (A operators): every reader gives ``source, source_rank, row_no, lang, items``."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..operators.normalise import parse_list

# --- splitters (A13): text column -> array<string> -----------------------------------------------------


def split_by(pattern: str) -> Callable[[Column], Column]:
    """A splitter that cuts at a pattern, trims, and drops empty parts."""
    return lambda text: F.filter(F.transform(F.split(text, pattern), lambda x: F.trim(x)), lambda x: x != "")


lines = split_by(r"\r?\n")
commas = split_by(",")
dashes = split_by("--")
several = split_by(r"[,;|\n]|\s-\s")
japanese_commas = split_by("[、，・]")


def _as_json(text: Column) -> Column:
    """A Python literal of strings, lists and dicts as JSON."""
    quoted = F.regexp_replace(text, r"(?<=[{\[,:\s])'|'(?=\s*[:,}\]])", '"')
    return F.regexp_replace(quoted, r"\bNone\b", "null")


def dict_names(text: Column) -> Column:
    """The names in a list of dicts (or in one dict), JSON or Python literal: ``name``, else ``ingredient``, else ``title``; null for other text."""
    many = F.when(F.trim(text).startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    rows = F.from_json(_as_json(many), "array<struct<name:string,ingredient:string,title:string>>")
    names = F.transform(rows, lambda r: F.trim(F.coalesce(F.nullif(r["name"], F.lit("")), F.nullif(r["ingredient"], F.lit("")), r["title"])))
    return F.when(text.rlike(r"^\s*(\[\s*)?\{"), F.filter(names, lambda x: x != ""))


def list_literal(text: Column) -> Column:
    """JSON or Python list literals, of strings or of dicts with names; other text is one item."""
    return F.coalesce(dict_names(text), F.filter(parse_list(text), lambda x: F.trim(x) != ""), lines(text))


def recipe_block(text: Column) -> Column:
    """Lines between a heading that says ingredients and the next heading."""
    block = F.regexp_extract(text, r"(?is)ingredients\s*:?\s*\n(.*?)(?:\n\s*\n|\n\s*(?:directions|instructions|method|steps)\b|\z)", 1)
    return F.transform(lines(block), lambda x: F.regexp_replace(x, r"^[\s*•\-–0-9.)]+(?=\D)", ""))


#: Splitters by the names that a registry table uses.
SPLITTERS = {"lines": lines, "commas": commas, "dashes": dashes, "several": several, "japanese commas": japanese_commas, "list": list_literal, "recipe block": recipe_block}


@dataclass(frozen=True)
class Source:
    """One entry of the registry."""

    key: str
    lang: str
    kind: str  # csv, parquet, jsonl, json, long, graph, chat, cells, prompt, dump
    path: str | Sequence[str]
    column: str = ""
    splitter: Callable[[Column], Column] = lines
    options: dict = field(default_factory=dict)


def with_row_numbers(df: DataFrame) -> DataFrame:
    """Numbers that keep the reader's order: file, then place in it."""
    return df.withColumn("row_no", F.monotonically_increasing_id())


def records(df: DataFrame, source: Source, items: Column, rank: int = 0) -> DataFrame:
    """Rows with a list in ``items``; nulls and empty lists are dropped."""
    out = with_row_numbers(df).select(F.lit(source.key).alias("source"), F.lit(rank).alias("source_rank"), "row_no", F.lit(source.lang).alias("lang"), items.alias("items"))
    return out.where(F.col("items").isNotNull() & (F.size("items") > 0))


def _csv(spark: SparkSession, s: Source) -> DataFrame:
    options = {k: v for k, v in s.options.items() if k != "pattern"}
    return spark.read.csv(s.path, header=True, mode="DROPMALFORMED", multiLine=True, escape='"', **options)


def read_csv(spark: SparkSession, s: Source, rank: int = 0) -> DataFrame:
    """A1: all strings, malformed rows skipped."""
    return records(_csv(spark, s), s, s.splitter(F.col(s.column)), rank)


def read_parquet(spark: SparkSession, s: Source, rank: int = 0) -> DataFrame:
    """A2: one column of a glob of files; lists are taken as they are."""
    df = spark.read.parquet(*([s.path] if isinstance(s.path, str) else s.path)).select(s.column)
    c = F.col(s.column)
    return records(df, s, c if dict(df.dtypes)[s.column].startswith("array") else s.splitter(c), rank)


def read_jsonl(spark: SparkSession, s: Source, rank: int = 0) -> DataFrame:
    """A3: a JSON record a line, bad lines dropped."""
    text = spark.read.text(s.path)
    path = F.get_json_object("value", f"$.{s.column}")
    return records(text.where(F.try_parse_json("value").isNotNull()), s, F.coalesce(F.from_json(path, "array<string>"), s.splitter(path)), rank)


def read_json(spark: SparkSession, s: Source, rank: int = 0) -> DataFrame:
    """A4: a document that is one array, or an object with one under ``options['under']``."""
    df = spark.read.json(s.path, multiLine=True)
    if under := s.options.get("under"):
        df = df.select(F.explode(under).alias("r")).select("r.*")
    c = F.col(s.column)
    return records(df, s, c if dict(df.dtypes)[s.column].startswith("array") else s.splitter(c), rank)


def dict_keys(text: Column) -> Column:
    """A5: the keys of a dict literal, trimmed, in lower case."""
    return F.transform(F.map_keys(F.from_json(_as_json(text), "map<string,string>")), lambda k: F.lower(F.trim(k)))


#: Words in a column's name that say it numbers or measures items.
NOT_ITEMS = {"id", "ids", "idx", "index", "no", "nr", "num", "number", "count", "qty", "quantity", "amount", "unit", "units"}


def item_column(columns: Sequence[str], names: Sequence[str] = ("ingredient", "item", "name")) -> str | None:
    """The column that holds items' names: one named for items that says ``name``, else one that isn't named for numbers, by the order of ``names``."""
    words = {c: [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "_", c).lower()) if w] for c in columns}
    named = [c for n in names for c in columns if n in c.lower()]
    said = [c for c in named if "name" in words[c] and not NOT_ITEMS & {*words[c]}]
    plain = [c for c in named if not NOT_ITEMS & {*words[c]}]
    return next((c for n in names for c in said if n in c.lower()), next(iter(plain), None))


def read_long(spark: SparkSession, s: Source, rank: int = 0) -> DataFrame:
    """A row for each item; the item column is the one that ``item_column`` tells by its name, never one of numbers, ids or quantities."""
    df = spark.read.csv(s.path, header=True)
    names = s.options.get("item_columns", ("ingredient", "item", "name"))
    column = item_column([c for c in df.columns if c != s.column], names)
    if column is None:
        raise ValueError(f"{s.key}: no column of items named like {', '.join(names)}")
    grouped = df.where(F.trim(column) != "").groupBy(s.column).agg(F.array_sort(F.collect_set(F.trim(column))).alias("items"))
    return records(grouped, s, F.col("items"), rank)


def read_graph(spark: SparkSession, s: Source, rank: int = 0) -> DataFrame:
    """The first node of type Recipe of a linked-data graph, a record a line."""
    node = "struct<`@type`:string,recipeIngredient:array<string>>"
    text = spark.read.text(s.path)
    found = F.filter(F.from_json("value", f"struct<`@graph`:array<{node}>>")["@graph"], lambda n: n["@type"] == "Recipe")
    return records(text, s, F.get(found, F.lit(0))["recipeIngredient"], rank)


# Lengths of an item's line, and how much of a transcript's beginning tells it from others.
ITEM_LENGTH = (2, 79)
BEGINNING = 60
#: What a line that heads a list of items says, and the characters that mark its lines.
HEADINGS = ("ingredients", "you will need")
MARKERS = "-*•.0123456789 \t\r"


def listed(text: Column, headings: Sequence[str] | None = HEADINGS) -> Column:
    """The lines of the first list in a text: what follows the heading, on its line or below, to the next blank line. Without ``headings`` the first line is one."""
    lines = F.split(text, "\n")
    if headings is None:
        below, beside = F.slice(lines, F.lit(2), F.size(lines)), F.lit("")
    else:
        heads = lambda line: F.greatest(*[F.when(F.instr(F.lower(line), h) > 0, F.instr(F.lower(line), h) + len(h)).otherwise(0) for h in headings], F.lit(0))
        ends = F.transform(lines, heads)
        at = F.nullif(F.array_position(F.transform(ends, lambda e: e > 0), True), F.lit(0)).cast("int")
        line, end = F.try_element_at(lines, at), F.try_element_at(ends, at)
        below = F.slice(lines, at + 1, F.size(lines))
        beside = F.ltrim(F.substr(line, end), F.lit(": \t"))
    blank = F.array_position(F.transform(below, lambda x: F.trim(x, F.lit(" \t\r")) == ""), True)
    upto = F.when(blank > 0, F.slice(below, F.lit(1), (blank - 1).cast("int"))).otherwise(below)
    return F.concat(F.array(beside), upto)


def chat_items(turns: DataFrame, prefix: int = BEGINNING, headings: Sequence[str] | None = HEADINGS) -> DataFrame:
    """Items of chat transcripts: the list in the assistants' joined turns, a line an item without its marker, 2 items at least.

    ``turns``: conv_id, turn, role, text -> ``conv_id, items``. A transcript without a list is left out. Of transcripts with equal beginnings the first stays.
    """
    said = turns.where(F.col("role") == "assistant").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
    bare = F.transform(listed(F.col("text"), headings), lambda x: F.trim(F.ltrim(x, F.lit(MARKERS)), F.lit(" \t\r")))
    items = F.filter(bare, lambda x: F.length(x).between(*ITEM_LENGTH))
    rows = said.select("conv_id", F.substring("text", 1, prefix).alias("begin"), items.alias("items")).where(F.size("items") >= 2)
    first = rows.groupBy("begin").agg(F.min("conv_id").alias("conv_id"))
    return rows.join(first, ["begin", "conv_id"], "left_semi").select("conv_id", "items")


def read_chat(spark: SparkSession, s: Source, rank: int = 0) -> DataFrame:
    """A JSON record a line with its turns under ``s.column`` (role, content)."""
    df = with_row_numbers(spark.read.json(s.path)).select(F.col("row_no").alias("conv_id"), F.posexplode(s.column).alias("turn", "m"))
    found = chat_items(df.select("conv_id", "turn", "m.role", F.col("m.content").alias("text")), headings=s.options.get("headings", HEADINGS))
    return found.select(F.lit(s.key).alias("source"), F.lit(rank).alias("source_rank"), F.col("conv_id").alias("row_no"), F.lit(s.lang).alias("lang"), "items")


def html_cells(text: Column) -> Column:
    """Header cells, or table rows as "name: amount"."""
    heads = F.transform(F.regexp_extract_all(text, F.lit(r"(?is)<th[^>]*>(.*?)</th>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", "")))
    names = F.regexp_extract_all(text, F.lit(r"(?is)<tr[^>]*>\s*<td[^>]*>(.*?)</td>\s*<td[^>]*>.*?</td>"), F.lit(1))
    amounts = F.regexp_extract_all(text, F.lit(r"(?is)<tr[^>]*>\s*<td[^>]*>.*?</td>\s*<td[^>]*>(.*?)</td>"), F.lit(1))
    rows = F.zip_with(names, amounts, lambda n, a: F.concat_ws(": ", F.trim(F.regexp_replace(n, "<[^>]*>", "")), F.trim(F.regexp_replace(a, "<[^>]*>", ""))))
    return F.filter(F.when(F.size(heads) > 0, heads).otherwise(rows), lambda x: x != "")


PROMPT_LIST = r"(?is)ingredients?:\s*(.*?)(?:\n\n|$)"


def prompt_items(text: Column, pattern: str = PROMPT_LIST) -> Column:
    """A10: the list inside a prompt."""
    return several(F.regexp_extract(text, pattern, 1))


def read_cells(spark: SparkSession, s: Source, rank: int = 0) -> DataFrame:
    """HTML cells of a CSV column."""
    return records(_csv(spark, s), s, html_cells(F.col(s.column)), rank)


def read_prompt(spark: SparkSession, s: Source, rank: int = 0) -> DataFrame:
    """A10: the list inside the prompts of a CSV column, found by ``options['pattern']``."""
    text = F.regexp_extract(s.column, s.options.get("pattern", PROMPT_LIST), 1)
    return records(_csv(spark, s), s, F.coalesce(dict_names(text), parse_list(text), several(text)), rank)


def read_dump(spark: SparkSession, s: Source, rank: int = 0) -> DataFrame:
    """Lines of a text dump's records between two markers."""
    begin, end = s.options.get("between", ("Ingredients:", "Directions:"))
    text = spark.read.text(s.path, lineSep=s.options.get("record_sep", "\n\n"))
    block = F.substring_index(F.substring_index("value", begin, -1), end, 1)
    return records(text.where(F.col("value").contains(begin)), s, lines(block), rank)


def entity_list(text: Column) -> Column:
    """A list that was taken out of text before: quotes and brackets off, lower case."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(F.regexp_replace(x, r"[\[\]\"']", "")))), lambda x: x != "")


READERS = {"csv": read_csv, "parquet": read_parquet, "jsonl": read_jsonl, "json": read_json, "long": read_long, "graph": read_graph, "chat": read_chat, "cells": read_cells, "prompt": read_prompt, "dump": read_dump}


def registry(entries: Sequence[dict]) -> list[Source]:
    """The registry from a configuration table: ``key, lang, kind, path``, and ``column``, ``splitter`` (a name of SPLITTERS) and ``options`` where a kind needs them."""
    out = [Source(e["key"], e["lang"], e["kind"], e["path"], e.get("column", ""), SPLITTERS[e.get("splitter", "lines")], dict(e.get("options", {}))) for e in entries]
    twice = sorted({s.key for s in out if sum(t.key == s.key for t in out) > 1})
    unknown = sorted({s.kind for s in out} - READERS.keys())
    if twice or unknown:
        raise ValueError(f"keys given twice: {twice}; kinds without a reader: {unknown}")
    return out


def read_source(spark: SparkSession, s: Source, rank: int = 0) -> DataFrame:
    return READERS[s.kind](spark, s, rank)


def read_all(spark: SparkSession, registry: Sequence[Source], only: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """All sources in order, or those in ``only``; ``limit`` is the number of first rows of each source."""
    out = None
    for rank, s in enumerate(registry):
        if only is None or s.key in only:
            one = read_source(spark, s, rank)
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no source is left")
    return first_rows(out, limit) if limit is not None else out


def first_rows(rows: DataFrame, n: int) -> DataFrame:
    order = W.partitionBy("source").orderBy("row_no")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).drop("n")


def declared_texts(df: DataFrame, columns: dict[str, Sequence[str]]) -> DataFrame:
    """Title, url, steps and quantities by a declared column map; the first column with a value counts, and missing text stays null."""
    have = set(df.columns)
    pick = lambda names: F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in names if c in have], F.lit(None).cast("string"))
    return df.select("*", *[pick(columns.get(c, ())).alias(f"text_{c}") for c in ("title", "url", "steps", "quantities")])


def declared_metadata(df: DataFrame, columns: dict[str, tuple[str, str]], reason: str = "not declared") -> DataFrame:
    """Raw total, prep, cook and servings with their encodings, or why a source has none."""
    have = set(df.columns)
    out = df
    for name in ("total", "prep", "cook", "servings"):
        column, encoding = columns.get(name, ("", ""))
        known = column in have
        out = out.withColumn(f"raw_{name}", F.col(column).cast("string") if known else F.lit(None).cast("string")).withColumn(f"{name}_encoding", F.lit(encoding if known else reason))
    return out


def peek(rows: DataFrame, source: str, n: int = 5) -> DataFrame:
    """The first raw records of a source."""
    return rows.where(F.col("source") == source).orderBy("row_no").limit(n)


def text_of(texts: DataFrame, basket_id) -> DataFrame:
    return texts.where(F.col("basket_id") == basket_id)
