"""Column functions that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def draw(key: Column | str, seed: int = 0) -> Column:
    """A uniform number in [0, 1) that depends on the key and the seed alone; other engines can compute it too."""
    key = F.col(key) if isinstance(key, str) else key
    text = F.concat(key.cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def fine_draw(key: Column | str, seed: int = 0) -> Column:
    """As ``draw``, in steps of 2**-52: for picking among more things than ``draw`` can tell apart."""
    key = F.col(key) if isinstance(key, str) else key
    text = F.concat(key.cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def half_up(x: Column | str, digits: int) -> Column:
    """Rounded as SQL engines round doubles: scaled, to a whole number, and back. ``F.round`` goes by the shortest decimal that reads as x, which stands under a half where x is a half but for its last bit."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x * float(10**digits), 0) / float(10**digits)


def item_set(items: Column | str) -> Column:
    """Set hygiene (B10): ascending distinct items without nulls."""
    return F.array_sort(F.array_distinct(F.array_compact(items)))


def pairs_of(items: Column | str) -> Column:
    """All pairs src < dst inside one ascending set (D2), without a shuffle."""
    items = F.col(items) if isinstance(items, str) else items
    rest = lambda a, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda b: F.struct(a.alias("src"), b.alias("dst")))
    return F.flatten(F.transform(items, rest))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def unit(vec: Column | str) -> Column:
    """The vector at length 1; a zero vector stays."""
    vec = F.col(vec) if isinstance(vec, str) else vec
    size = norm(vec)
    return F.transform(vec, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(F.lit(0.0)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity (G6); null if one of the vectors is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Overlap of two sets over their union (F13); null for two empty sets."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both.cast("double"))


def npmi(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """Normalised pointwise mutual information; null where the pair is in every basket."""
    p = n_ab / n
    return F.when(p < 1, F.log(p * n * n / (n_a * n_b)) / -F.log(p))


def numbered(rows: DataFrame, u: Column, ties: Sequence[str], by: Sequence[str] = (), name: str = "r", buckets: int = 256) -> DataFrame:
    """``rows`` numbered from 1 in the order of ``u`` (uniform in 0..1) and ``ties``, in each group of ``by``.

    In two steps, so that no task numbers a whole group: inside buckets of u, and over the buckets' sizes.
    """
    placed = rows.withColumn("_u", u).withColumn("_b", F.floor(F.col("_u") * buckets).cast("int"))
    sizes = placed.groupBy(*by, "_b").agg(F.count("*").alias("_m"))
    before = F.sum("_m").over(W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))  # ``buckets`` rows a group
    sizes = sizes.select(*by, "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*by, "_b").orderBy("_u", *ties))
    return placed.withColumn("_i", inside).join(sizes, [*by, "_b"]).withColumn(name, F.col("_i") + F.col("_before")).drop("_u", "_b", "_i", "_before")
