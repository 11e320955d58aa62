"""Mixing sources to target weights along a curriculum that changes over training time.

A source's share of the mix is its target in words; its weight schedule over training time is a
line, early or late sources by their weight. Integrating the schedule gives the words demanded up
to any time; a document's place in its source, in words, is looked up in the inverse: that time is
its training position, and documents are range-sorted by it. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .quality import words
from .scratch import written

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_REPEATS = 2
ROWS_PER_BUCKET = 20_000


def sized(docs: DataFrame) -> DataFrame:
    """``size``: the number of words ``[^\\x20\\x09-\\x0D]+``; 0 for a null text."""
    return docs.withColumn("size", F.size(words(F.col("text"))).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sizes(source, size)`` -> a row for each source: ``source_size, n_docs, weight, target, slope``.

    Sources by code point, null last, weigh ``weights`` in turn and share 150 % of all sizes; a
    target stops at twice its source's size and the excess is shared again by weight. The end of
    that sharing is one level of words per weight: sources are capped in order of size to weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")).cast("long"))
    cap = MOST_REPEATS * F.col("source_size")
    order = W.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    to_share = SHARE_PERCENT * F.sum("source_size").over(W.partitionBy()) / 100.0 - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weight_left = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    level = to_share / weight_left
    # sources up to the last capped one are capped; the level after them is everyone else's
    per = per.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= cap)
    after = F.max(F.when(~F.col("full"), F.col("level"))).over(W.partitionBy())
    share = F.when(F.col("full"), cap.cast("double")).otherwise(F.least(cap.cast("double"), after * F.col("weight")))
    slope = 0.5 - (F.col("weight") - min(weights)) / float(max(max(weights) - min(weights), 1))
    return per.select("source", "source_size", "n_docs", "weight", share.alias("target"), slope.alias("slope"))


def _position(u: Column, slope: Column) -> Column:
    """The time t in 0..1 by which the part u of a source's words is demanded: t + slope (t^2 - t) = u."""
    root = F.sqrt(F.greatest((1 - slope) * (1 - slope) + 4 * slope * u, F.lit(0.0)))
    return 2 * u / (1 - slope + root)


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``docs(doc_id, text, source)`` -> ``doc_id, size, source_size, target, taken, first_taken, second_taken, position, second_position``, by position.

    Words of a source are laid end to end in an order drawn by hash, twice; its target is a stretch from the beginning.
    ``taken`` counts a document's words inside: at most twice its size, and a source's words sum to its
    target, rounded up. ``position`` is the training time of its first copy, ``second_position`` of its second
    (null where there is none). The order is that of the doc_ids' hashes, ties fall to doc_id and size; a null text or one without words has
    size 0 and is taken with 0 words; all sizes 0 give targets 0. Repeated rows count each. Reruns agree.
    """
    plan = _plan(docs, seed)
    return plan.orderBy("position", "h", "doc_id").drop("h")


def _plan(docs: DataFrame, seed: int, *row: str) -> DataFrame:
    """The rows of ``mix`` and ``h``, in no order; ``row`` names a column that tells rows apart, which is kept and settles the last ties."""
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f" {seed}"))
    if row:  # different texts without an id are dealt apart
        name = F.when(F.col("doc_id").isNull(), F.concat(F.lit(f" {seed} "), F.xxhash64("text").cast("string"))).otherwise(name)
    keyed = docs.select("doc_id", "source", "text", *row).withColumn("h", F.md5(name))
    ties = [F.xxhash64("text").alias("th"), *row] if row else []
    sizes = written(sized(keyed).select("doc_id", "source", "h", "size", *ties), "sizes")
    shares = written(targets(sizes), "targets")
    # running sums in two steps, so that no source is one task's: over buckets of the hash, then inside a bucket
    buckets = F.greatest(F.lit(16), F.ceil(F.col("n_docs") / ROWS_PER_BUCKET)).cast("long")
    null_safe = F.col("s.source").eqNullSafe(F.col("t.source"))
    placed = sizes.alias("s").join(shares.alias("t"), null_safe).select("s.*", "source_size", "target", "slope", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).alias("bucket"))
    inside = W.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", *(["th", *row] if row else [])).rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    over = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(over), F.lit(0)).alias("before"))
    both = placed.alias("p").join(sums.alias("b"), F.col("p.source").eqNullSafe(F.col("b.source")) & (F.col("p.bucket") == F.col("b.bucket"))).select("p.*", (F.col("inside") + F.col("before")).alias("at"))
    stretch = F.ceil("target")

    def part(begin: Column) -> Column:
        return F.least(F.greatest(stretch - begin, F.lit(0)), F.col("size")).cast("long")

    def when(begin: Column, words_: Column) -> Column:
        u = F.least(begin / F.greatest("target", F.lit(1.0)), F.lit(1.0))
        return F.when((words_ > 0) | (begin == F.col("at")), _position(u, F.col("slope")))

    both = both.withColumn("first_taken", part(F.col("at"))).withColumn("second_taken", part(F.col("at") + F.col("source_size")))
    both = both.withColumn("position", when(F.col("at"), F.col("first_taken"))).withColumn("second_position", when(F.col("at") + F.col("source_size"), F.col("second_taken")))
    return both.select("doc_id", "size", "source_size", "target", (F.col("first_taken") + F.col("second_taken")).alias("taken"), "first_taken", "second_taken", "position", "second_position", "h", *row)


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: columns of ``docs``, a row for each copy taken, by training position.

    The copy at the end of a target keeps only its first taken words, joined by one space. Documents without words are left out.
    Rows are told apart by a key of their own: repeated ids and null ids count and come out row by row; the order is that of the ids' hashes, of the texts' where there is no id.
    A null or empty text has no words and is left out; an empty table gives an empty table. Extra columns stay as they are.
    """
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    copies = F.array(F.struct(F.col("first_taken").alias("_taken"), F.col("position").alias("_position")), F.struct(F.col("second_taken").alias("_taken"), F.col("second_position").alias("_position")))
    plan = _plan(rows, seed, "_row").select("_row", F.col("size").alias("_size"), F.explode(copies).alias("x")).select("_row", "_size", "x.*").where("_taken > 0")
    text = F.when(F.col("_taken") < F.col("_size"), F.array_join(F.slice(words(F.col("text")), F.lit(1), F.col("_taken").cast("int")), " ")).otherwise(F.col("text"))
    rows = rows.join(plan, "_row").orderBy("_position", "doc_id", "_row").withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return rows.select(*docs.columns)
