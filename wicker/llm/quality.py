"""Quality rules whose thresholds adapt to each language and source.

Measures are columns over word arrays; their distributions per language and source are mergeable
quantile sketches; fences derived from the sketches replace fixed cutoffs and are joined back.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import written

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Sketch accuracy: ranks are off by one part in this many at most.
ACCURACY = 10000
#: The ranks at which a sketch is asked.
RANKS = (0.05, 0.25, 0.75, 0.95)
#: A fence lies so many interquartile ranges beyond the outer quartile, or at the outermost twentieth if that is farther ...
REACH = 4.0
#: ... and a little beyond it (in the measure's unit), so that a group without spread keeps what hardly differs.
MARGIN = {"symbol_ratio": 0.02, "dup_line_ratio": 0.05, "repeat_ratio": 0.05, "word_length": 0.5}


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def _doubled(h: str, step: int) -> Column:
    """Hashes of twice as many words, from those of ``step`` words."""
    m = F.greatest(F.size(h) - step, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), m), F.slice(h, F.lit(1 + step), m), lambda a, b: F.xxhash64(a, b))


def _with_repeat_words(base: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words of ``w`` in windows of eight words found twice or more.

    Every step is a column of its own: an expression that names an array twice would compute it twice.
    """
    rows = base.withColumn("h1", F.when(F.size("w") >= WINDOW, F.transform("w", lambda w: F.xxhash64(w))))
    rows = rows.withColumn("h2", _doubled("h1", 1)).withColumn("h4", _doubled("h2", 2)).withColumn("h8", _doubled("h4", 4))
    rows = rows.withColumn("some", F.size(F.array_distinct("h8")) < F.size("h8"))
    # only where a window is repeated: its places, in order
    rows = rows.withColumn("placed", F.when(F.col("some"), F.array_sort(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    after = F.slice("placed", F.lit(2), F.size("placed") - 1)
    rows = rows.withColumn("pairs", F.filter(F.zip_with("placed", after, lambda a, b: F.struct(a["i"].alias("i"), F.when(a["h"] == b["h"], b["i"]).alias("j"))), lambda x: x["j"].isNotNull()))
    rows = rows.withColumn("at", F.array_sort(F.array_union(F.col("pairs")["i"], F.col("pairs")["j"])))
    after = F.slice("at", F.lit(2), F.size("at") - 1)
    gaps = F.zip_with("at", after, lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda t, x: t + x), F.lit(0).cast("long")))


def measures(docs: DataFrame) -> DataFrame:
    """One row for each document: the base counts, as longs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "lang", "source", text.alias("text")).withColumn("w", words(F.col("text")))
    base = base.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return _with_repeat_words(base).select(
        "doc_id",
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        "n_repeat_words",
    )


def _ratios() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbol_ratio": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_ratio": F.col("n_repeat_words") / n,
        "word_length": F.col("word_chars") / n,
    }


def quality_rules(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang, source)`` -> counts, ``base_failed`` and ``kept``, one row for each row.

    A document fails the base rules with under 20 words, or with more than 30 % of its words in
    eight-word windows found twice or more. Of the others one is kept if each of its ratios
    (symbols to word characters, repeated lines to lines, repeated words to words, characters a
    word) lies inside the fences of its language and source, as told by a quantile sketch over all the group's documents
    that pass the base rules: the quartiles widened by REACH times their distance, or the first and the last twentieth
    where they are farther, and a MARGIN. A null text has no words; null languages and sources form groups of their own.
    Repeated rows count each; other columns are ignored.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    measured = written(measures(docs).withColumn("base_failed", failed), "measures").withColumns(_ratios())
    sketched = measured.where(~F.col("base_failed")).groupBy("lang", "source").agg(
        *[F.percentile_approx(c, list(RANKS), ACCURACY).alias(f"q_{c}") for c in MARGIN]
    )
    fences = sketched.select("lang", "source", *[_fence(c, margin) for c, margin in MARGIN.items()])
    m, f = measured.alias("m"), fences.alias("f")
    joined = m.join(f, F.col("m.lang").eqNullSafe(F.col("f.lang")) & F.col("m.source").eqNullSafe(F.col("f.source")), "left")
    inside = F.lit(True)
    for c in MARGIN:
        inside = inside & F.col(c).between(F.col(f"fence_{c}")[0], F.col(f"fence_{c}")[1])
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(inside, F.lit(True)))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def _fence(c: str, margin: float) -> Column:
    p5, q1, q3, p95 = (F.col(f"q_{c}")[i] for i in range(len(RANKS)))
    reach = REACH * (q3 - q1)
    return F.array(F.least(q1 - reach, p5) - margin, F.greatest(q3 + reach, p95) + margin).alias(f"fence_{c}")
