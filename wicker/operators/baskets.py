"""Baskets, their slots, selection and accounting (B and E operators, D joins used by them)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import draw, item_set, npmi, pairs_of
from ..functions.joins import ROWS_A_TASK, dealt, joined
from ..session import saved


def baskets_from_rows(rows: DataFrame, basket: str, item: str, *carry: str) -> DataFrame:
    """Long rows grouped into one set a basket (A6): ``basket_id, items, *carry``; baskets without items are dropped."""
    kept = [F.min(c).alias(c) for c in carry]
    out = rows.where(F.col(item).isNotNull()).groupBy(F.col(basket).alias("basket_id")).agg(F.collect_set(item).alias("items"), *kept)
    return out.withColumn("items", F.array_sort("items")).where(F.size("items") > 0)


def slots(baskets: DataFrame) -> DataFrame:
    """One row for each basket and item."""
    return baskets.select("basket_id", F.explode("items").alias("item_id"))


def select_baskets(baskets: DataFrame, ids: DataFrame) -> DataFrame:
    """Baskets with an id in ``ids`` (B1)."""
    return baskets.join(ids.select("basket_id").distinct(), "basket_id", "left_semi")


def by_origin(baskets: DataFrame, lang: str | None = None, source: str | None = None) -> DataFrame:
    """Baskets of a language, of a source, or of both (B2)."""
    for name, value in (("lang", lang), ("source", source)):
        if value is not None:
            baskets = baskets.where(F.col(name) == value)
    return baskets


def browse(baskets: DataFrame, n: int, source_like: str = "", lang: str | None = None, min_size: int = 1, item: int | None = None, seed: int = 0) -> DataFrame:
    """n baskets drawn uniformly from those that match, by id."""
    match = F.col("source").contains(source_like) & (F.size("items") >= min_size)
    if lang is not None:
        match = match & (F.col("lang") == lang)
    if item is not None:
        match = match & F.array_contains("items", item)
    return baskets.where(match).orderBy(draw("basket_id", seed), "basket_id").limit(n).orderBy("basket_id")


def decode(baskets: DataFrame, items: DataFrame) -> DataFrame:
    """Item ids to names, in item order (B4); an unknown id is an error row with a null name."""
    rows = baskets.select("basket_id", F.posexplode("items").alias("pos", "item_id")).join(items.select("item_id", "name"), "item_id", "left")
    named = rows.groupBy("basket_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("x"))
    return named.select("basket_id", F.col("x.name").alias("names"))


def of_size(baskets: DataFrame, least: int = 2, most: int = 40) -> DataFrame:
    """Baskets of least..most items."""
    return baskets.where(F.size("items").between(least, most))


def frequencies(baskets: DataFrame) -> DataFrame:
    """Document frequency of every item."""
    return slots(baskets).groupBy("item_id").agg(F.count("*").alias("df"))


def pair_counts(baskets: DataFrame) -> DataFrame:
    """Co-occurrence counts of item pairs src < dst (E2). Pairs are made per row and summed before the shuffle.

    Where there may be more different pairs than a task should hold, they go with the baskets: they hardly repeat, and are dealt over a stated number of tasks before they are summed.
    """
    baskets = saved(baskets.select("items"), "baskets")  # counted, then paired
    slot = baskets.select((F.size("items") - 1).alias("others"), F.explode("items").alias("item_id"))
    made, vocabulary = slot.agg(F.coalesce(F.sum("others"), F.lit(0)), F.approx_count_distinct("item_id")).first()
    most = min(made // 2, vocabulary**2 // 2)
    pairs = baskets.select(F.explode(pairs_of("items")).alias("p")).select("p.src", "p.dst")
    return (dealt(pairs, most, "src", "dst") if most > ROWS_A_TASK else pairs).groupBy("src", "dst").agg(F.count("*").alias("count"))


def npmi_graph(baskets: DataFrame, min_count: int = 2, threshold: float | None = -0.15, paired_only: bool = False) -> DataFrame:
    """Item graph by NPMI (E3): ``src, dst, count, npmi, pmi``, thresholds inclusive.

    Probabilities are over all baskets, or over those of two items and more with ``paired_only`` (E4).
    A pair that is in every basket has no NPMI and is dropped.
    """
    base = baskets.where(F.size("items") >= 2) if paired_only else baskets
    base = saved(base.select("basket_id", "items"), "base") if "basket_id" in base.columns else base  # three readers
    n = base.agg(F.count("*").alias("n"))
    df = frequencies(base)
    counts = pair_counts(base).where(F.col("count") >= min_count)
    edges = counts.join(df.withColumnRenamed("item_id", "src").withColumnRenamed("df", "df_src"), "src").join(df.withColumnRenamed("item_id", "dst").withColumnRenamed("df", "df_dst"), "dst").crossJoin(F.broadcast(n))  # n is one row
    c = {x: F.col(x).cast("double") for x in ("count", "df_src", "df_dst", "n")}
    edges = edges.withColumn("npmi", npmi(c["count"], c["df_src"], c["df_dst"], c["n"])).withColumn("pmi", F.log(c["count"] * c["n"] / (c["df_src"] * c["df_dst"])))
    keep = F.col("npmi").isNotNull() if threshold is None else F.col("npmi") >= threshold
    return edges.where(keep).select("src", "dst", "count", "npmi", "pmi")


def operating_points(edges: DataFrame, min_counts: Sequence[int], thresholds: Sequence[float], target: int) -> DataFrame:
    """Edges that each pair of min_count and threshold leaves, and how far that is from the target (E5); nearest first."""
    sums = [F.count_if((F.col("count") >= m) & (F.col("npmi") >= t)).alias(f"c{i}_{j}") for i, m in enumerate(min_counts) for j, t in enumerate(thresholds)]
    cells = [F.struct(F.lit(m).alias("min_count"), F.lit(float(t)).alias("threshold"), F.col(f"c{i}_{j}").alias("edges")) for i, m in enumerate(min_counts) for j, t in enumerate(thresholds)]
    grid = edges.agg(*sums).select(F.explode(F.array(*cells)).alias("g")).select("g.*")
    return grid.withColumn("off", F.abs(F.col("edges") - target)).orderBy("off", "min_count", "threshold")


def fingerprint(items: Column | str, separator: str = "\x1f") -> Column:
    """Of a raw item list: trimmed, lower-cased, sorted and joined, hashed."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda x: F.lower(F.trim(x)))), separator), 256)


def deduplicate(raw: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """Exact duplicates by ``key``: the first in ``order`` stays (E6). The mark ``duplicate`` is set before emptiness is looked at.

    The first of each key is an aggregate, joined back, so that a key with very many rows is not one task's.
    """
    keyed = raw.withColumn("fp", key)
    first = keyed.groupBy("fp").agg(F.min(F.struct(*order)).alias("first"))
    return keyed.join(first, "fp").withColumn("duplicate", F.struct(*order) != F.col("first")).drop("first")


def drop_waterfall(marked: DataFrame) -> DataFrame:
    """Rows scanned, duplicate, empty and kept, and slots kept, in total and by source (E7): ``source`` null is the total.

    ``marked``: source, duplicate, items (normalised).
    """
    n = F.size(F.coalesce("items", F.array()))
    dup, empty = F.col("duplicate"), n == 0
    return marked.groupingSets([[F.col("source")], []], "source").agg(
        F.count("*").alias("scanned"),
        F.count_if(dup).alias("duplicates"),
        F.count_if(~dup & empty).alias("empty"),
        F.count_if(~dup & ~empty).alias("kept"),
        F.coalesce(F.sum(F.when(~dup, n)), F.lit(0)).alias("slots"),
    )


def coverage(baskets: DataFrame, n_items: int) -> DataFrame:
    """One row that proves the corpus (E8): counts, sizes, origins, order, vocabulary range."""
    n = F.size("items")
    return baskets.agg(
        F.count("*").alias("baskets"),
        F.sum(n).alias("slots"),
        F.min(n).alias("min_size"),
        F.max(n).alias("max_size"),
        F.round(F.avg(n), 6).alias("mean_size"),
        F.countDistinct("source").alias("sources"),
        F.countDistinct("lang").alias("langs"),
        F.count_if(F.col("items") != item_set("items")).alias("unsorted"),
        F.count_if(F.exists("items", lambda x: (x < 0) | (x >= n_items))).alias("out_of_range"),
    )


def by_source(baskets: DataFrame) -> DataFrame:
    """Count, mean size and languages of each source, largest first."""
    return (
        baskets.groupBy("source")
        .agg(F.count("*").alias("baskets"), F.round(F.avg(F.size("items")), 6).alias("mean_size"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))
        .orderBy(F.desc("baskets"), "source")
    )


def top_items(baskets: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent items and their share of all slots."""
    df = frequencies(baskets)
    total = df.agg(F.sum("df").alias("all_slots"))
    top = df.orderBy(F.desc("df"), "item_id").limit(n)
    return top.crossJoin(F.broadcast(total)).select("item_id", "df", F.round(F.col("df") / F.col("all_slots"), 6).alias("share"))  # total is one row


def yield_audit(lines: DataFrame) -> DataFrame:
    """What share of each source's rows gives a basket, and flags (E11). ``lines``: source, items."""
    n = F.size("items")
    out = lines.groupBy("source").agg(F.count("*").alias("n"), F.count_if(n > 0).alias("matched"), F.round(F.avg(F.when(n > 0, n)), 6).alias("mean_size"), F.max(n).alias("largest"))
    share = F.round(F.col("matched") / F.col("n"), 6)
    flags = F.array_compact(F.array(F.when(share < 0.9, "LOW YIELD"), F.when(F.col("mean_size") < 2.5, "THIN"), F.when(F.col("largest") > 40, "LONG")))
    return out.select("source", "n", "matched", share.alias("yield"), "mean_size", F.array_join(flags, ",").alias("flags"))


def row_buckets(rows: DataFrame, buckets: Sequence[tuple[str, Column]], group: str) -> DataFrame:
    """Rows by the first condition that holds, per group and in total (E12); buckets sum to the total."""
    name = F.lit("other")
    for label, holds in reversed(list(buckets)):
        name = F.when(holds, label).otherwise(name)
    tagged = rows.select(F.col(group).alias("grp"), name.alias("bucket"))
    return tagged.rollup("bucket", "grp").agg(F.count("*").alias("n")).where("bucket is not null or grp is null")


def line_coverage(lines: DataFrame) -> DataFrame:
    """Why lines give no slot (E13). ``lines``: source, basket_id, line_no, item_id (null: not recognised)."""
    first = F.row_number().over(W.partitionBy("basket_id", "item_id").orderBy("line_no")) == 1
    cause = F.when(F.col("item_id").isNull(), "unrecognised").when(first, "kept").otherwise("duplicate")
    return lines.withColumn("cause", cause).groupBy("source", "cause").agg(F.count("*").alias("n"))


def unmapped_terms(terms: DataFrame, known: DataFrame, min_df: int = 2, head: int = 500) -> DataFrame:
    """Terms of each language that no alias covers, by document frequency, with the head's share of the mass.

    ``terms``: lang, basket_id, term; ``known``: lang, term.
    """
    free = terms.join(known.select("lang", "term").distinct(), ["lang", "term"], "left_anti")
    df = free.groupBy("lang", "term").agg(F.countDistinct("basket_id").alias("df")).where(F.col("df") >= min_df)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("df"), "term"))
    mass = df.groupBy("lang").agg(F.sum("df").alias("mass"))
    return df.withColumn("rank", rank).join(mass, "lang").where(F.col("rank") <= head).select("lang", "term", "df", "rank", F.round(F.col("df") / F.col("mass"), 6).alias("share"))


def frequent_forms(terms: DataFrame, top: int = 400) -> DataFrame:
    """The most frequent surface forms of each language and how much they cover together."""
    counts = terms.groupBy("lang", "term").agg(F.count("*").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    order = W.partitionBy("lang").orderBy(F.desc("n"), "term")
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    ranked = ranked.withColumn("running", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return ranked.join(total, "lang").select("lang", "term", "n", "rank", F.round(F.col("running") / F.col("total"), 6).alias("covered"))


def alias_gain(lines: DataFrame, variants: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Line recall and items a basket under several alias tables on the same rows, and the gain over the first.

    ``lines``: lang, basket_id, line; a variant's table: lang, surface, item_id.
    """
    # a basket's equal lines once, for all variants
    lines = saved(lines.groupBy("lang", "basket_id", "line").agg(F.count("*").alias("c")), "lines")
    sizes = lines.groupBy("lang", "basket_id").agg(F.lit(1)).groupBy("lang").agg(F.count("basket_id").alias("baskets"))
    parts = []
    for name, alias in variants:
        hit = joined(lines, alias.select("lang", F.col("surface").alias("line"), "item_id"), ["lang", "line"], "left")
        per = hit.groupBy("lang", "basket_id", "item_id").agg(F.sum("c").alias("c"))
        known = F.col("item_id").isNotNull()
        sums = per.groupBy("lang").agg(F.coalesce(F.sum(F.when(known, F.col("c"))), F.lit(0)).alias("hit"), F.sum("c").alias("n"), F.count_if(known & F.col("basket_id").isNotNull()).alias("items"))
        one = joined(sums, sizes.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")))
        parts.append(saved(one.select("lang", F.round(F.col("hit") / F.col("n"), 6).alias("recall"), F.round(F.col("items") / F.nullif("baskets", F.lit(0)), 6).alias("items_per_basket"), F.lit(name).alias("variant")), "variant"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    base = parts[0].select("lang", F.col("recall").alias("base"))
    return out.join(base, "lang").withColumn("gain", F.round(F.col("recall") - F.col("base"), 6)).drop("base")


def net_new(keys: DataFrame) -> DataFrame:
    """Keys that each source brings first (E17). ``keys``: source, source_rank, key; rank 0 is the baseline."""
    first = keys.groupBy("key").agg(F.min("source_rank").alias("first_rank"))
    per = keys.select("source", "source_rank", "key").distinct().join(first, "key")
    return per.groupBy("source", "source_rank").agg(F.count("*").alias("unique_keys"), F.count_if(F.col("source_rank") == F.col("first_rank")).alias("net_new"))


def verify_counts(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of each source against declared targets (E18). ``targets``: source, declared."""
    found = rows.groupBy("source").agg(F.count("*").alias("found"))
    both = found.join(targets, "source", "full_outer").withColumn("found", F.coalesce("found", F.lit(0)))
    status = F.when(F.col("declared").isNull(), "undeclared").when(F.col("found") == F.col("declared"), "equal").when(F.col("found") == 0, "missing").otherwise("differs")
    return both.select("source", "found", "declared", (F.col("found") - F.col("declared")).alias("delta"), status.alias("status"))


def recurring(baskets: DataFrame, least: int = 3, sizes: tuple[int, int] = (3, 16)) -> DataFrame:
    """Identical sets that occur ``least`` times or more."""
    return baskets.where(F.size("items").between(*sizes)).groupBy("items").agg(F.count("*").alias("n"), F.min("basket_id").alias("first_basket")).where(F.col("n") >= least)


def pair_portrait(baskets: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """For each edge the items most often found with both ends, in permille of the pair."""
    # a pair's own end, counted with the thirds, counts the pair: its baskets are read once
    rows = joined(baskets.select(F.explode(pairs_of("items")).alias("p"), "items").select("p.src", "p.dst", "items"), edges.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
    found = rows.select("src", "dst", F.explode(F.array_remove("items", F.col("dst"))).alias("third")).groupBy("src", "dst", "third").agg(F.count("*").alias("n"))
    found = saved(found, "thirds")
    exact = found.where("third = src").select("src", "dst", F.col("n").alias("pair_count"))
    third = found.where("third <> src")
    rank = F.row_number().over(W.partitionBy("src", "dst").orderBy(F.desc("n"), "third"))
    best = third.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(exact, ["src", "dst"]).select("src", "dst", "pair_count", "third", "rank", F.bround(1000 * F.col("n") / F.col("pair_count"), 0).cast("long").alias("permille"))


def content_coverage(rows: DataFrame) -> DataFrame:
    """Stored and usable titles and steps, and text status, in total and by source (E21). ``rows``: source, title, steps, status."""
    letters = lambda c: F.coalesce(c.rlike(r"\p{L}"), F.lit(False))
    usable_steps = F.coalesce(F.exists("steps", lambda s: F.trim(s) != ""), F.lit(False)) & (F.col("status") != "unparsed_steps")
    return rows.groupingSets([[F.col("source")], []], "source").agg(
        F.count("*").alias("n"), F.count_if(F.col("title").isNotNull()).alias("titles"), F.count_if(letters(F.col("title"))).alias("usable_titles"), F.count_if(usable_steps).alias("usable_steps")
    )


def usable_text(title: Column, steps: Column, status: Column) -> Column:
    """A title, a step that is not blank, a status that says steps were parsed."""
    return F.coalesce((F.trim(title) != "") & F.exists(steps, lambda s: F.trim(s) != "") & (status != "unparsed_steps"), F.lit(False))


def merge_metadata(rows: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Copies of one content joined to one record (E22): ``fp, total, prep, cook, time_status, derived_total``.

    Copies that disagree make a value unknown (``ambiguous``); a part above the total is ``inconsistent``; the sum of the parts
    is kept apart from a source's own total. ``rows``: fp, total, prep, cook.
    """
    parts = ("total", "prep", "cook")
    one = rows.groupBy("fp").agg(*[F.countDistinct(c).alias(f"n_{c}") for c in parts], *[F.min(c).alias(c) for c in parts])
    for c in parts:
        one = one.withColumn(c, F.when(F.col(f"n_{c}") <= 1, F.col(c)))
    clash = F.greatest(*[F.col(f"n_{c}") for c in parts]) > 1
    over = F.coalesce(F.greatest("prep", "cook") > F.col("total") + tolerance, F.lit(False))
    status = F.when(clash, "ambiguous").when(over, "inconsistent").when(F.col("total").isNotNull(), "source_total").otherwise("unknown")
    return one.select("fp", F.when(status == "source_total", F.col("total")).alias("total"), "prep", "cook", status.alias("time_status"), (F.col("prep") + F.col("cook")).alias("derived_total"))


def degrees(edges: DataFrame, items: DataFrame) -> DataFrame:
    """Degree of every item, 0 for isolated ones."""
    ends = edges.select(F.col("src").alias("item_id")).unionAll(edges.select(F.col("dst").alias("item_id")))
    return items.select("item_id").join(ends.groupBy("item_id").agg(F.count("*").alias("degree")), "item_id", "left").fillna(0, ["degree"])


def attribute_coverage(baskets: DataFrame, attributed: DataFrame, group: str) -> DataFrame:
    """Share of slots, and of pairs, whose items have attributes, by group."""
    known = attributed.select("item_id").distinct().withColumn("has", F.lit(1))
    rows = baskets.select("basket_id", group, F.explode("items").alias("item_id")).join(known, "item_id", "left")
    per = rows.groupBy("basket_id", group).agg(F.count("*").alias("n"), F.count("has").alias("k"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    return per.groupBy(group).agg(F.round(F.sum("k") / F.sum("n"), 6).alias("token_coverage"), F.round(pairs("k") / F.when(pairs("n") > 0, pairs("n")), 6).alias("pair_coverage"))


def table_fingerprint(df: DataFrame, key: str) -> DataFrame:
    """Order-free identity of a table (E26): rows, key range, a sum and a xor of row hashes."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in df.columns])
    row = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return df.agg(F.count("*").alias("n"), F.min(key).alias("least"), F.max(key).alias("largest"), F.countDistinct(key).alias("keys"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("sum_hash"), F.bit_xor(row).alias("xor_hash"))


def label_tiers(subs: DataFrame, tiers: Sequence[int] = (1, 10), least: int = 3) -> DataFrame:
    """Directed pairs with enough votes, and anchors with enough substitutes, by tier (E27). ``subs``: a, b, votes."""
    pairs = subs.where("a <> b").groupBy("a", "b").agg(F.max("votes").alias("votes"))
    per = pairs.select("a", F.explode(F.array(*[F.when(F.col("votes") >= t, F.lit(t)) for t in tiers])).alias("tier")).where("tier is not null")
    anchors = per.groupBy("tier", "a").agg(F.count("*").alias("n"))
    return anchors.groupBy("tier").agg(F.sum("n").alias("pairs"), F.count_if(F.col("n") >= least).alias("anchors"))


def normalisation_audit(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Match rate and items a basket by source, by language and in total, with items never seen (E28). ``lines``: source, lang, basket_id, item_id."""
    out = lines.groupingSets([[F.col("source")], [F.col("lang")], []], "source", "lang").agg(
        F.count("*").alias("lines"), F.round(F.count("item_id") / F.count("*"), 6).alias("match_rate"), F.countDistinct("item_id").alias("seen")
    )
    size = items.agg(F.count("*").alias("vocabulary"))
    return out.crossJoin(F.broadcast(size)).withColumn("unseen", F.col("vocabulary") - F.col("seen"))  # one row
