"""Text normalisation jobs (C operators): lines and names to items, durations, counts, links."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.joins import joined
from ..functions.patterns import occurrences
from ..session import saved

# --- aliases -------------------------------------------------------------------------------------


def alias_table(vocab: DataFrame, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Surface forms of items (C1): ``surface, item_id``, and the extra rows whose target is no item.

    ``vocab``: item_id, name; ``extra``: surface, name. A name, its spaced form, the extra forms and made-up plurals, in this order of
    right: the first writer of a surface wins, then the smaller id.
    """
    spaced = F.replace("name", F.lit("_"), F.lit(" "))
    rows = vocab.select(F.col("name").alias("surface"), "item_id", F.lit(0).alias("prio")).unionByName(vocab.select(spaced.alias("surface"), "item_id", F.lit(1).alias("prio")))
    rejected = None
    if extra is not None:
        rows = rows.unionByName(extra.join(vocab, "name").select("surface", "item_id", F.lit(2).alias("prio")))
        rejected = extra.join(vocab.select("name"), "name", "left_anti")
    s = F.col("surface")
    plural = F.when(s.rlike("(s|x|z|ch|sh|o)$"), F.concat(s, F.lit("es"))).when(s.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(s, "y$", ""), F.lit("ies"))).otherwise(F.concat(s, F.lit("s")))
    rows = rows.unionByName(rows.where("prio > 0").select(plural.alias("surface"), "item_id", (F.col("prio") + 10).alias("prio")))
    best = rows.groupBy("surface").agg(F.min(F.struct("prio", "item_id")).alias("b")).select("surface", F.col("b.item_id").alias("item_id"))
    return best, rejected if rejected is not None else vocab.sparkSession.createDataFrame([], "surface string, name string")


UNITS_EN = "cups? tablespoons? tbsps? teaspoons? tsps? ounces? oz pounds? lbs? grams? g kg ml l pinch(?:es)? cans? cloves? slices? packages? pieces?".split()
UNITS_ZH = "克 千克 公斤 斤 两 毫升 升 勺 匙 杯 个 只 片 根 块 瓣 颗 把 条".split()


def strip_quantity(line: Column, lang: str = "en") -> Column:
    """Leading number and unit off a line (C2); Chinese quantities only at an end of the line, and only with a measure word."""
    if lang == "zh":
        unit = "|".join(UNITS_ZH)
        q = rf"[0-9０-９一二三四五六七八九十半]+(?:[.．][0-9]+)?\s*(?:{unit})"
        return F.trim(F.regexp_replace(F.regexp_replace(F.trim(line), rf"^{q}", ""), rf"{q}$", ""))
    unit = "|".join(UNITS_EN)
    number = r"(?:[0-9]+(?:[ -]?[0-9]+/[0-9]+|[./][0-9]+)?|[¼½¾⅓⅔])"
    return F.trim(F.regexp_replace(F.trim(line), rf"(?i)^{number}(?:\s*-\s*{number})?\s+(?:(?:{unit})\.?\s+)?(?:of\s+)?", ""))


MODIFIERS = "fresh frozen dried chopped sliced diced minced grated large small medium ripe raw cooked old new hot cold red blue green".split()


def candidate_forms(line: Column, modifiers: Sequence[str] = MODIFIERS) -> Column:
    """Forms under which a line is looked up, the best first: as it is, with underscores, without leading modifiers, in the singular."""
    s = F.lower(F.trim(line))
    bare = F.regexp_replace(s, rf"^(?:(?:{'|'.join(modifiers)})\s+)+", "")
    one = lambda x: F.array(x, F.regexp_replace(x, "es$", ""), F.regexp_replace(x, "s$", ""), F.regexp_replace(x, "ies$", "y"))
    return F.array_distinct(F.concat(F.array(s, F.replace(s, F.lit(" "), F.lit("_")), bare), one(s), one(bare)))


def match_exact(lines: DataFrame, alias: DataFrame, modifiers: Sequence[str] = MODIFIERS) -> DataFrame:
    """Item of each line by its best known form (C3). ``lines``: line_id, line -> ``line_id, item_id, form``."""
    forms = lines.select("line_id", F.posexplode(candidate_forms(F.col("line"), modifiers)).alias("rank", "surface"))
    hit = forms.join(alias, "surface").groupBy("line_id").agg(F.min_by(F.struct("item_id", "surface"), "rank").alias("b"))
    return hit.select("line_id", F.col("b.item_id").alias("item_id"), F.col("b.surface").alias("form"))


def ngrams(text: Column, longest: int) -> Column:
    """``array<struct<pos, n, surface>>``: all runs of up to ``longest`` words, for joins with a table of phrases."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    one = lambda n: F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.struct(i.alias("pos"), F.lit(n).alias("n"), F.array_join(F.slice(words, i + 1, n), " ").alias("surface")))
    empty = F.array().cast("array<struct<pos:int,n:int,surface:string>>")
    return F.flatten(F.array(*[F.when(F.size(words) >= n, one(n)).otherwise(empty) for n in range(1, longest + 1)]))


def _left_to_right(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for line_id, hits in zip(frame.line_id, frame.hits):
            out += [(line_id, h["item_id"], h["pos"], h["n"]) for h in _chosen(hits)]
        yield pd.DataFrame(out, columns=["line_id", "item_id", "pos", "n"])


def _chosen(hits) -> list:
    """From the left the longest phrase at each place, then on behind it."""
    at: dict[int, dict] = {}
    for h in hits:
        if h["pos"] not in at or h["n"] > at[h["pos"]]["n"]:
            at[h["pos"]] = h
    out, free = [], 0
    for pos in sorted(at):
        if pos >= free:
            out.append(at[pos])
            free = pos + at[pos]["n"]
    return out


def match_phrases(lines: DataFrame, alias: DataFrame, longest: int = 4) -> DataFrame:
    """All phrases in each line, longest first from the left, none over another (C4): ``line_id, item_id, pos, n``. Equal lines are scanned once."""
    grams = lines.select("line").distinct().select("line", F.explode(ngrams(F.col("line"), longest)).alias("g")).select("line", "g.*")
    hits = joined(grams, alias.select("surface", "item_id"), "surface").groupBy("line").agg(F.collect_list(F.struct("pos", "n", "item_id")).alias("hits"))
    kind = dict(hits.select(F.col("hits")[0]["item_id"].alias("i")).dtypes)["i"]
    found = hits.select(F.col("line").alias("line_id"), "hits").mapInPandas(_left_to_right, f"line_id string, item_id {kind}, pos int, n int")
    found = found.groupBy(F.col("line_id").alias("line")).agg(F.collect_list(F.struct("item_id", "pos", "n")).alias("found"))  # a line's own phrases
    return joined(lines.select("line_id", "line").dropDuplicates(), found, "line").select("line_id", F.explode("found").alias("f")).select("line_id", "f.*")


def match_unspaced(texts: DataFrame, alias: DataFrame) -> DataFrame:
    """Longest-first substrings for scripts without spaces (C5): ``line_id, item_id``, each item once a line.

    All places of all surfaces are found by automata over shards of the aliases; from the left the longest surface at each place is taken, then on behind
    it. Of a surface given twice the smaller item counts.
    """
    items = alias.groupBy("surface").agg(F.min("item_id").alias("item_id"))
    hits = occurrences(texts.select(F.col("line").alias("text")), items).join(items, "surface")
    per = hits.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("pos", (-F.length("surface")).alias("n"), F.col("item_id").cast("bigint").alias("item_id")))).alias("hits"))
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<bigint>").alias("items"))
    behind = lambda s, h: F.struct((h["pos"] - h["n"]).alias("free"), F.array_append(s["items"], h["item_id"]).alias("items"))
    taken = F.aggregate("hits", start, lambda s, h: F.when(h["pos"] >= s["free"], behind(s, h)).otherwise(s), lambda s: F.array_distinct(s["items"]))
    return texts.select("line_id", F.col("line").alias("text")).join(per.select("text", taken.alias("items")), "text").select("line_id", F.explode("items").alias("item_id"))


def normalise_baskets(raw: DataFrame, alias: DataFrame, unspaced: Sequence[str] = ("zh", "ja", "th"), longest: int = 4) -> DataFrame:
    """Raw item lists to sets (C6): ``basket_id, items``. ``raw``: basket_id, lang, lines; ``alias``: lang, surface, item_id.

    Spaced languages by exact forms, then phrases; Latin-script foreign lines are scanned with the English aliases as well. Equal lines of a language are scanned once.
    """
    own = raw.select("basket_id", "lang", F.explode("lines").alias("line")).where("line is not null")
    own = own.withColumn("line_id", F.concat_ws("|", F.coalesce("lang", F.lit("\x02")), "line"))
    rows = own.select("line_id", "lang", "line").distinct()
    tongues = F.when(F.col("lang").isin(*unspaced) | (F.col("lang") == "en") | ~F.col("line").rlike("[A-Za-z]"), F.array("lang")).otherwise(F.array("lang", F.lit("en")))
    rows = saved(rows.withColumn("tongue", F.explode(tongues)), "lines")
    key = F.concat_ws("|", "tongue", "surface")
    keyed = alias.select(F.concat_ws("|", F.col("lang"), F.col("surface")).alias("surface"), "item_id")
    spaced = rows.where(~F.col("tongue").isin(*unspaced))
    forms = spaced.select("line_id", "tongue", F.posexplode(candidate_forms(strip_quantity(F.col("line")))).alias("rank", "surface")).withColumn("surface", key)
    exact = saved(joined(forms, keyed, "surface").groupBy("line_id", "tongue").agg(F.min_by("item_id", "rank").alias("item_id")), "exact")
    rest = joined(spaced, exact.select("line_id", "tongue"), ["line_id", "tongue"], "left_anti")
    grams = rest.select("line_id", "tongue", F.explode(ngrams(F.col("line"), longest)).alias("g")).select("line_id", "tongue", "g.*").withColumn("surface", key)
    hits = joined(grams, keyed, "surface").groupBy("line_id", "tongue").agg(F.collect_list(F.struct("pos", "n", "item_id")).alias("hits")).select("line_id", "hits")
    phrases = hits.mapInPandas(_left_to_right, "line_id string, item_id long, pos int, n int").select("line_id", "item_id")
    found = exact.select("line_id", F.col("item_id").cast("long").alias("item_id")).unionByName(phrases)
    for tongue in unspaced:
        some = alias.where(F.col("lang") == tongue)
        found = found.unionByName(match_unspaced(rows.where(F.col("tongue") == tongue).select("line_id", "line"), some).select("line_id", "item_id"))
    items = found.groupBy("line_id").agg(F.collect_set("item_id").alias("found"))
    return joined(own.select("basket_id", "line_id"), items, "line_id").groupBy("basket_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("items"))


def clean_terms(lines: Column) -> Column:
    """Terms of raw lines (C7): "name: amount" keeps the name, headings go, digits, punctuation and units are removed."""
    unit = "|".join(UNITS_EN)
    named = F.regexp_extract(lines, r"^\s*([^:]+):\s*\S", 1)
    text = F.when(named != "", named).otherwise(lines)
    text = F.regexp_replace(F.lower(text), rf"(?i)\b(?:{unit})\b", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\s]+", " "), r"\s+", " "))
    return F.when(lines.rlike(r":\s*$") | (text == ""), None).otherwise(text)


def resolve_names(texts: DataFrame, vocab: DataFrame, alias: DataFrame, modifiers: Sequence[str] = MODIFIERS) -> DataFrame:
    """Names to items by the first way that works (C8): key, alias, singular, head noun, without style words, the one item with the token.

    ``texts``: text_id, text; ``vocab``: item_id, name; ``alias``: surface, item_id -> ``text_id, item_id, way``.
    """
    s = F.lower(F.trim("text"))
    key = F.regexp_replace(s, r"[\s-]+", "_")
    bare = F.regexp_replace(s, rf"\b(?:{'|'.join(modifiers)})\b\s*", "")
    ways = F.array(key, s, F.regexp_replace(s, "(?<=..)s$", ""), F.element_at(F.split(s, r"\s+"), -1), F.trim(bare))
    names = ("key", "alias", "singular", "head", "bare")
    asks = texts.select("text").distinct()  # equal texts are resolved once
    forms = asks.select("text", F.posexplode(ways).alias("rank", "surface"))
    known = vocab.select(F.col("name").alias("surface"), "item_id").unionByName(alias.select("surface", "item_id")).unionByName(vocab.select(F.replace("name", F.lit("_"), F.lit(" ")).alias("surface"), "item_id")).groupBy("surface").agg(F.min("item_id").alias("item_id"))
    hit = saved(joined(forms, known, "surface").groupBy("text").agg(F.min(F.struct("rank", "item_id")).alias("b")), "hits")
    rest = joined(asks, hit.select("text"), "text", "left_anti").select("text", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("token"))
    tokens = vocab.select("item_id", F.explode(F.array_distinct(F.split("name", r"[_\s]+"))).alias("token")).where("token <> ''")
    unique = joined(rest, tokens, "token").groupBy("text").agg(F.min("item_id").alias("least"), F.max("item_id").alias("most"))
    empty = F.lit(None).cast(dict(hit.dtypes)["b"])
    ways_of = hit.withColumns({"least": F.lit(None).cast("long"), "most": F.lit(None).cast("long")}).unionByName(unique.select("text", empty.alias("b"), "least", "most"))
    per = joined(texts.select("text_id", "text"), ways_of, "text").groupBy("text_id").agg(F.min("b").alias("b"), F.min("least").alias("least"), F.max("most").alias("most"))
    per = per.where(F.col("b").isNotNull() | (F.col("least") == F.col("most")))
    way = F.when(F.col("b").isNull(), "token").otherwise(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("b.rank") + 1))
    return per.select("text_id", F.coalesce("b.item_id", "least").alias("item_id"), way.alias("way"))


def resolve_ngrams(texts: DataFrame, vocab: DataFrame, alias: DataFrame, longest: int = 4) -> DataFrame:
    """The longest run of words that resolves, the leftmost of equals (C9): ``text_id, item_id, surface``."""
    grams = texts.select("text").distinct().select("text", F.explode(ngrams(F.col("text"), longest)).alias("g")).select("text", "g.*")  # equal texts are scanned once
    known = vocab.select(F.replace("name", F.lit("_"), F.lit(" ")).alias("surface"), "item_id").unionByName(alias.select("surface", "item_id")).groupBy("surface").agg(F.min("item_id").alias("item_id"))
    best = joined(grams, known, "surface").groupBy("text").agg(F.min(F.struct((-F.col("n")).alias("n"), "pos", "item_id", "surface")).alias("b"))
    best = joined(texts.select("text_id", "text"), best, "text").groupBy("text_id").agg(F.min("b").alias("b"))
    return best.select("text_id", F.col("b.item_id").alias("item_id"), F.col("b.surface").alias("surface"))


def loose_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^\p{L}]", "")


def match_loose(names: DataFrame, vocab: DataFrame) -> DataFrame:
    """Names by their letters alone, with or without a final s (C10). ``names``: name_id, name."""
    v = vocab.groupBy(loose_key(F.col("name")).alias("k")).agg(F.min("item_id").alias("item_id"))
    n = names.select("name_id", loose_key(F.col("name")).alias("k1")).withColumn("k2", F.when(F.col("k1").endswith("s"), F.regexp_replace("k1", "s$", "")).otherwise(F.concat("k1", F.lit("s"))))
    both = n.join(v.select(F.col("k").alias("k1"), F.col("item_id").alias("i1")), "k1", "left").join(v.select(F.col("k").alias("k2"), F.col("item_id").alias("i2")), "k2", "left")
    return both.select("name_id", F.coalesce("i1", "i2").alias("item_id"))


# --- card text and lists ---------------------------------------------------------------------------

_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


@F.pandas_udf(T.StringType())
def decode_references(text: pd.Series) -> pd.Series:
    """Complete character references decoded, all others left as they are."""
    return text.map(lambda t: t if t is None else _REFERENCE.sub(lambda m: html.unescape(m[0]), t))


def clean_card_text(text: Column) -> Column:
    """References decoded, control characters and runs of white space to one space, null if nothing is left (C11)."""
    out = F.trim(F.regexp_replace(F.regexp_replace(decode_references(text), r"\p{Cc}", " "), r"\s+", " "))
    return F.when(out != "", out)


def item_lines(raw: Column, source: Column | None = None) -> Column:
    """One line for each item (C12): table rows to "name: amount", line breaks, and one-line lists split on `` ; `` or ``|``; null amounts go."""
    tables = F.regexp_replace(F.regexp_replace(raw, r"(?is)<tr[^>]*>\s*<t[dh][^>]*>(.*?)</t[dh]>\s*<td[^>]*>(.*?)</td>\s*</tr>", "$1: $2\n"), r"(?s)<[^>]*>", "\n")
    text = F.when(raw.rlike("(?i)<tr"), tables).otherwise(F.regexp_replace(raw, r"(?i)<br\s*/?>|</?(?:li|p|div)[^>]*>", "\n"))
    lines = F.split(text, r"\r?\n")
    lines = F.when((F.size(lines) == 1) & text.contains(" ; "), F.split(text, " ; ")).when((F.size(lines) == 1) & text.contains("|"), F.split(text, r"\|")).otherwise(lines)
    clean = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?i):\s*(?:null|none|nan|n/a)?\s*$", ""), r"\s+", " ")))
    return F.filter(clean, lambda x: x != "")


def parse_list(text: Column) -> Column:
    """A serialised list: JSON, a Python literal, or an R vector; null if it is none of them. ``NA`` keeps its place as a null."""
    strings = "array<string>"
    body = F.regexp_replace(F.trim(text), r"(?s)^c\((.*)\)$", "[$1]")
    body = F.regexp_replace(body, r"(?<=[\[,])\s*(?:NA|None)\s*(?=[,\]])", "null")
    single = F.regexp_replace(F.regexp_replace(body, r'"', r'\\\\"'), r"(?<=[\[,\s])'|'(?=\s*[,\]])", '"')
    known = F.trim(text).rlike(r"(?s)^(\[.*\]|c\(.*\))$")
    return F.when(known, F.coalesce(F.from_json(body, strings, {"mode": "PERMISSIVE"}), F.from_json(single, strings)))


def decode_lists(rows: DataFrame) -> DataFrame:
    """Items, quantities and steps of serialised columns, and how they stand to each other.

    ``rows``: id, items, quantities, steps (strings). quantity_status: complete, values_without_units, count_mismatch, not_supplied; text_status: ok or
    unparsed_steps, whose text is kept as one step.
    """
    i, q, s = (parse_list(F.col(c)) for c in ("items", "quantities", "steps"))
    x = rows.select("id", i.alias("items"), q.alias("quantities"), F.coalesce(s, F.when(F.trim("steps") != "", F.array("steps"))).alias("step_list"), (s.isNull() & (F.trim("steps") != "")).alias("raw_steps"))
    bare = F.forall("quantities", lambda v: v.isNull() | v.rlike(r"^\s*[0-9./ ]+\s*$"))
    status = F.when(F.col("quantities").isNull() | (F.size("quantities") == 0), "not_supplied").when(F.size("quantities") != F.size("items"), "count_mismatch").when(bare, "values_without_units").otherwise("complete")
    return x.select("id", "items", "quantities", F.col("step_list").alias("steps"), status.alias("quantity_status"), F.when(F.col("raw_steps"), "unparsed_steps").otherwise("ok").alias("text_status"))


# --- numbers ---------------------------------------------------------------------------------------

#: Minutes in each unit, by language.
MINUTES: dict[str, dict[str, float]] = {
    "en": {"days": 1440, "day": 1440, "hours": 60, "hour": 60, "hrs": 60, "hr": 60, "minutes": 1, "minute": 1, "mins": 1, "min": 1, "seconds": 1 / 60, "second": 1 / 60, "secs": 1 / 60, "sec": 1 / 60},
    "el": {"ημέρες": 1440, "ημέρα": 1440, "ώρες": 60, "ώρα": 60, "λεπτά": 1, "λεπτό": 1, "δευτερόλεπτα": 1 / 60},
    "ja": {"日": 1440, "時間": 60, "分": 1, "秒": 1 / 60},
    "ru": {"дней": 1440, "дня": 1440, "день": 1440, "часов": 60, "часа": 60, "час": 60, "минут": 1, "минуты": 1, "минута": 1, "секунд": 1 / 60, "секунды": 1 / 60, "секунда": 1 / 60},
    "zh": {"天": 1440, "小時": 60, "小时": 60, "分鐘": 1, "分钟": 1, "秒": 1 / 60},
}
#: What stands for no value.
_MISSING = ("", "na", "n/a", "null", "none")
#: Minutes in the parts of an ISO 8601 duration before and after its T, and the orders in which parts may stand.
_DATE_PARTS, _TIME_PARTS = {"W": 10080.0, "D": 1440.0}, {"H": 60.0, "M": 1.0, "S": 1 / 60}
_DATE_ORDERS, _TIME_ORDERS = ("W", "D"), ("H", "M", "S", "HM", "HS", "MS", "HMS")
#: Words that may follow a number of servings.
_SERVING_WORDS = {"en": ("serving", "servings", "people", "person", "persons"), "el": ("μερίδες", "μερίδα", "άτομα")}


def _is_missing(value: Column) -> Column:
    return value.isNull() | F.lower(F.trim(value)).isin(*_MISSING)


def _only(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "") == ""


def _decimal(text: Column) -> Column:
    """Digits with at most one point inside them, as a number; null for anything else."""
    inside = ~text.startswith(".") & ~text.endswith(".") & _only(text, "0123456789.")
    return F.when(inside, text.try_cast("double"))


def _plain_number(text: Column) -> Column:
    """An unsigned number, a fraction or an exponent allowed."""
    begins = F.substring(text, 1, 1)
    return F.when(_only(begins, "0123456789.") & _only(F.lower(text), "0123456789.e+-"), text.try_cast("double"))


def _lookup(table: dict[str, float], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda t, x: t + x)


def _let(x: Column, of) -> Column:
    """``of(x)`` with x taken once, however often ``of`` names it."""
    return F.get(F.transform(F.array(x), of), F.lit(0))


def _iso_side(side: Column, parts: dict[str, float], orders: tuple[str, ...]) -> Column:
    """One side of an ISO duration: ``struct<minutes, fraction, good>``, cut at its letters."""
    letters = F.filter(F.split(F.translate(side, "0123456789.,", ""), ""), lambda x: x != "")
    raw = F.filter(F.split(F.translate(side, ",", "."), "[A-Z]"), lambda x: x != "")

    def read(x: Column) -> Column:
        letters, raw, numbers = x["letters"], x["raw"], x["numbers"]
        minutes = _sum(F.zip_with(numbers, F.transform(letters, lambda x: _lookup(parts, x)), lambda n, m: F.coalesce(n * m, F.lit(0.0))))
        # only the last number may have a fraction
        whole = F.forall(F.slice(raw, F.lit(1), F.greatest(F.size(raw) - 1, F.lit(0))), lambda x: ~x.contains("."))
        good = F.array_join(letters, "").isin(*orders) & (F.size(letters) == F.size(raw)) & F.forall(numbers, lambda x: x.isNotNull()) & whole & side.rlike("[A-Z]$")
        return F.struct(minutes.alias("minutes"), F.try_element_at(raw, F.lit(-1)).contains(".").alias("fraction"), good.alias("good"))

    cut = lambda x: F.struct(x["letters"].alias("letters"), x["raw"].alias("raw"), F.transform(x["raw"], lambda n: _decimal(n)).alias("numbers"))
    return _let(_let(F.struct(letters.alias("letters"), raw.alias("raw")), cut), read)


def _iso_minutes(text: Column) -> Column:
    """Minutes of an ISO 8601 duration of weeks, or of days and a time; null if it is none."""
    halves = F.split(F.substr(text, F.lit(2)), "T")
    sides = lambda h: F.struct(h.alias("halves"), _iso_side(h[0], _DATE_PARTS, _DATE_ORDERS).alias("date"), _iso_side(F.get(h, F.lit(1)), _TIME_PARTS, _TIME_ORDERS).alias("time"))

    def read(x: Column) -> Column:
        halves, date, time = x["halves"], x["date"], x["time"]
        both = date["good"] & ~date["fraction"] & time["good"] & ~halves[0].contains("W")
        return (
            F.when((F.size(halves) == 1) & date["good"], date["minutes"])
            .when((F.size(halves) == 2) & (halves[0] == "") & time["good"], time["minutes"])
            .when((F.size(halves) == 2) & both, date["minutes"] + time["minutes"])
        )

    return F.when(text.startswith("P"), _let(_let(halves, sides), read))


def _unit_minutes(text: Column, units: dict[str, float]) -> Column:
    """Numbers with units, each smaller than the one before; null otherwise. The text is cut wherever numbers and words meet."""
    tokens = F.split(F.lower(F.trim(text)), r"(?<=[0-9.])\s*(?=[^0-9.\s])|(?<=[^0-9.\s])\s*(?=[0-9.])")

    def pairs(tokens: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.floor(F.size(tokens) / 2) - 1, F.lit(0)).cast("int"))
        numbers = F.transform(places, lambda i: _decimal(F.get(tokens, 2 * i)))
        minutes = F.transform(places, lambda i: _lookup({u: float(m) for u, m in units.items()}, F.get(tokens, 2 * i + 1)))
        return F.struct((F.size(tokens) % 2 == 0).alias("even"), numbers.alias("numbers"), minutes.alias("minutes"))

    def read(x: Column) -> Column:
        numbers, minutes = x["numbers"], x["minutes"]
        known = F.forall(F.zip_with(numbers, minutes, lambda n, m: n * m), lambda x: x.isNotNull())
        steps = F.zip_with(minutes, F.slice(minutes, F.lit(2), F.size(minutes)), lambda m, after: F.coalesce(m > after, F.lit(True)))
        return F.when(x["even"] & known & F.forall(steps, lambda x: x), _sum(F.zip_with(numbers, minutes, lambda n, m: n * m)))

    return _let(_let(tokens, pairs), read)


def duration(value: Column, encoding: Column, allow_zero: bool = False) -> Column:
    """``struct<minutes, status>`` of a declared duration field (C14): provided, missing or invalid; zero counts for components alone."""
    text = F.trim(value)
    number = F.when(encoding == "iso8601", _iso_minutes(text)).when(encoding == "minutes", _plain_number(text))
    for lang, units in MINUTES.items():
        number = F.when(encoding == lang, _unit_minutes(value, units)).otherwise(number)

    def read(number: Column) -> Column:
        good = number.isNotNull() & ~F.isnan(number) & (number < float("inf")) & ((number >= 0) if allow_zero else (number > 0))
        status = F.when(_is_missing(value), "missing").when(good, "provided").otherwise("invalid")
        return F.struct(F.when(status == "provided", number).alias("minutes"), status.alias("status"))

    return _let(number, read)


def durations(fields: DataFrame) -> DataFrame:
    """Declared fields with their ``duration`` as d; equal ones are read once. ``fields``: value, encoding and any others."""
    keyed = fields.withColumn("_key", F.to_json(F.struct("encoding", "value")))  # nulls are left out of it
    read = keyed.select("_key", "encoding", "value").distinct().select("_key", duration(F.col("value"), F.col("encoding")).alias("d"))
    return joined(keyed, read, "_key").drop("_key")


def count_of(value: Column, encoding: Column) -> Column:
    """``struct<n, status>`` of a servings field (C15): exact positive counts; ranges, yields and prose are invalid."""
    text = F.trim(value)
    parts = F.split(text, r"\s+")
    counted = F.lit(False)
    for lang, names in _SERVING_WORDS.items():
        counted = counted | ((encoding == lang) & F.lower(F.get(parts, F.lit(1))).isin(*names))
    number = F.when(F.size(parts) == 1, _plain_number(text)).when((F.size(parts) == 2) & counted, _decimal(parts[0]))
    good = F.coalesce((number > 0) & (number < float("inf")), F.lit(False))
    status = F.when(_is_missing(value), "missing").when(good, "provided").otherwise("invalid")
    return F.struct(F.when(status == "provided", number).alias("n"), status.alias("status"))


# --- links -----------------------------------------------------------------------------------------

_SENSITIVE = "token|access_token|auth|apikey|api_key|key|password|passwd|secret|session|sessionid|sid|signature|sig"


def normal_url(url: Column) -> Column:
    """``struct<url, reason>`` (C16): a scheme where none is given, a host with a dot, no user, no white space, no secret in the query; else null and why."""
    text = F.trim(url)
    full = F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), text).otherwise(F.concat(F.lit("http://"), F.regexp_replace(text, "^//", "")))
    authority = F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    reason = (
        F.when(text.isNull() | (text == ""), "missing")
        .when(~full.rlike("(?i)^https?://"), "scheme")
        .when(full.rlike(r"\s"), "white space")
        .when(authority.contains("@"), "user in host")
        .when(~F.regexp_replace(authority, ":[0-9]*$", "").rlike(r"[^.]\.[^.]"), "host")
        .when(full.rlike(rf"(?i)\?(?:[^#]*&)?(?:{_SENSITIVE})="), "sensitive query")
    )
    return F.struct(F.when(reason.isNull(), full).alias("url"), reason.alias("reason"))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def slug(title: Column) -> Column:
    """Lower-case words of a title joined by ``-``, marks and punctuation gone."""
    plain = F.translate(F.lower(title), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def resolve_links(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Where a link leads by its host's first matching path prefix (C17). ``urls``: id, url, title; ``rules``: host, rule_no, prefix, status, template.

    status: source, archive, offline, none; a host without rules is an ``unmeasured`` row. ``{url}`` and ``{slug}`` in the template are filled in.
    """
    u = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    hit = u.join(rules, "host", "left").where(F.col("prefix").isNull() | F.col("path").startswith(F.col("prefix")))
    best = hit.groupBy("id").agg(F.min_by(F.struct("status", "template"), F.coalesce("rule_no", F.lit(10**6))).alias("r"))
    known = rules.select("host").distinct().withColumn("known", F.lit(True))
    out = u.join(best, "id", "left").join(known, "host", "left")
    status = F.when(F.col("url").isNull(), "none").when(F.col("known").isNull(), "unmeasured").otherwise(F.coalesce("r.status", F.lit("none")))
    link = F.replace(F.replace(F.coalesce("r.template", F.lit("{url}")), F.lit("{url}"), F.col("url")), F.lit("{slug}"), F.coalesce(slug(F.col("title")), F.lit("")))
    return out.select("id", "host", F.when(status.isin("source", "archive"), link).alias("link"), status.alias("status"))


# --- classes and names -----------------------------------------------------------------------------


def first_class(text: Column, taxonomy: Sequence[tuple[str, Sequence[str]]], otherwise: str = "other") -> Column:
    """The first class one of whose keywords the text contains."""
    out = F.lit(otherwise)
    for name, words in reversed(list(taxonomy)):
        out = F.when(F.lower(text).rlike("|".join(re.escape(w) for w in words)), name).otherwise(out)
    return out


def entity_aliases(name: Column, suffixes: Sequence[str] = ("oil", "juice", "powder", "leaf", "seed")) -> Column:
    """Surface forms of an entity (C19): as it is, without trailing kind words, joined, head noun."""
    s = F.lower(F.trim(F.regexp_replace(name, r"\s*\(.*?\)", "")))
    bare = F.trim(F.regexp_replace(s, rf"\s+(?:{'|'.join(suffixes)})$", ""))
    forms = F.array(s, bare, F.regexp_replace(s, r"[\s-]+", "_"), F.regexp_replace(s, r"[\s-]+", ""), F.element_at(F.split(s, r"\s+"), -1))
    return F.array_distinct(F.filter(forms, lambda x: x != ""))


def parse_substitutions(lines: DataFrame, known: DataFrame) -> DataFrame:
    """``Item: a, b, c`` lines to votes (C20): ``a, b, votes, a_known, b_known``. ``lines``: line; ``known``: name."""
    rows = lines.select(F.lower(F.trim(F.regexp_extract("line", r"^([^:]+):", 1))).alias("a"), F.explode(F.split(F.regexp_extract("line", r":(.*)$", 1), ",")).alias("b")).withColumn("b", F.lower(F.trim("b")))
    votes = rows.where("a <> '' and b <> '' and a <> b").groupBy("a", "b").agg(F.count("*").alias("votes"))
    names = known.select("name").distinct().withColumn("k", F.lit(True))
    return votes.join(names.select(F.col("name").alias("a"), F.col("k").alias("ka")), "a", "left").join(names.select(F.col("name").alias("b"), F.col("k").alias("kb")), "b", "left").select("a", "b", "votes", F.coalesce("ka", F.lit(False)).alias("a_known"), F.coalesce("kb", F.lit(False)).alias("b_known"))


def title_key(title: Column) -> Column:
    """Lower case, everything but letters, digits and _ to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(title), r"(?U)\W+", " "))


def alias_hazards(new: DataFrame, frequent: DataFrame) -> DataFrame:
    """New aliases inside a frequent unmapped term that isn't bound to the same item (C23). ``new``: surface, item_id; ``frequent``: term, df, item_id or null.

    Every term is held against every alias, by automata over shards of the aliases.
    """
    inside = occurrences(frequent.select(F.col("term").alias("text")), new).select(F.col("text").alias("term"), "surface").where("term <> surface").distinct()
    hit = inside.join(new, "surface").join(frequent.select("term", "df", F.col("item_id").alias("bound_to")), "term")
    hit = hit.where(~F.coalesce(F.col("bound_to") == F.col("item_id"), F.lit(False)))
    return hit.groupBy("surface", "item_id").agg(F.max_by("term", F.struct("df", "term")).alias("inside"), F.max("df").alias("df"))
