"""Item graphs, attributes, similarity and near-duplicate names (F and G operators without training)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import cosine, jaccard
from ..functions.joins import joined
from ..functions.pairing import paired


def both_ways(edges: DataFrame, shift: bool = False) -> DataFrame:
    """Each undirected edge in both directions (F12); with ``shift`` weights are moved above 0 by the smallest."""
    weight = F.col("npmi")
    if shift:
        least = edges.agg(F.min("npmi").alias("least"))
        edges = edges.crossJoin(F.broadcast(least))  # one row
        weight = weight - F.col("least") + 1e-3
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), weight.alias("weight"))
    return out.unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def top_k(rows: DataFrame, group: Sequence[str], score: str, key: str, k: int) -> DataFrame:
    """Per group the k best by score, ties by ascending key (F3, F4). Spark cuts each task's groups before the shuffle."""
    order = W.partitionBy(*group).orderBy(F.desc(score), F.asc(key))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def head_by_frequency(items: DataFrame, k: int, keep_higher_id: bool = True) -> DataFrame:
    """The k most frequent items; ``keep_higher_id`` says which of equals comes first."""
    order = [F.desc("df"), F.desc("item_id") if keep_higher_id else F.asc("item_id")]
    return items.orderBy(*order).limit(k)


def shared_attributes(item_attr: DataFrame) -> DataFrame:
    """How many attributes two items share, both directions, no diagonal."""
    pairs = paired(item_attr.select("attr_id", "item_id").distinct(), "attr_id", ["i"], ["j"])
    return pairs.where("i <> j").groupBy("i", "j").agg(F.count("*").alias("shared"))


def attribute_similarity(item_attr: DataFrame) -> DataFrame:
    """Cosine and Jaccard of attribute sets."""
    sizes = item_attr.distinct().groupBy("item_id").agg(F.count("*").alias("n"))
    s = shared_attributes(item_attr).join(sizes.select(F.col("item_id").alias("i"), F.col("n").alias("n_i")), "i").join(sizes.select(F.col("item_id").alias("j"), F.col("n").alias("n_j")), "j")
    return s.select("i", "j", "shared", F.round(F.col("shared") / F.sqrt(F.col("n_i") * F.col("n_j")), 6).alias("cosine"), F.round(F.col("shared") / (F.col("n_i") + F.col("n_j") - F.col("shared")), 6).alias("jaccard"))


def stem(word: Column) -> Column:
    """Plural endings off: ies -> y, es, s, where enough of the word stays."""
    n = F.length(word)
    return (
        F.when(word.endswith("ies") & (n > 5), F.concat(F.substring(word, 1, 64).substr(F.lit(1), n - 3), F.lit("y")))
        .when(word.endswith("es") & (n > 4), word.substr(F.lit(1), n - 2))
        .when(word.endswith("s") & (n > 3), word.substr(F.lit(1), n - 1))
        .otherwise(word)
    )


def canonical_name(name: Column, form_words: Sequence[str], synonyms: dict[str, str] | None = None) -> Column:
    """A name without form words, stemmed, joined by ``_`` (C21); a name of form words alone keeps them."""
    if synonyms:
        name = F.coalesce(F.create_map(*[F.lit(x) for p in synonyms.items() for x in p])[name], name)
    parts = F.transform(F.filter(F.split(F.lower(name), r"[_\s\-]+"), lambda w: w != ""), stem)
    forms = F.array(*[F.lit(w) for w in form_words]) if form_words else F.array().cast("array<string>")
    core = F.filter(parts, lambda w: ~F.array_contains(forms, w))
    return F.array_join(F.when(F.size(core) > 0, core).otherwise(parts), "_")


def near_duplicate_names(items: DataFrame, form_words: Sequence[str], synonyms: dict[str, str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """Pairs of items whose names mean one thing (G4): ``a, b`` with a < b.

    Equal canonical names; or the tokens of one contain the other's, heads (last words) agree, and no qualifier is itself an
    item (``known``: names; the items' canonical names by default). Candidates share their head, so no cross join is needed.
    """
    named = items.select("item_id", canonical_name(F.col("name"), form_words, synonyms).alias("c"))
    named = named.withColumn("t", F.split("c", "_")).withColumn("head", F.element_at("t", -1))
    names = (known if known is not None else named.select(F.col("c").alias("name"))).distinct()
    columns = ("item_id", "c", "t")
    pairs = paired(named.select("head", *columns), "head", [f"a_{x}" for x in columns], [f"b_{x}" for x in columns]).where("a_item_id < b_item_id")
    inside = (F.size(F.array_except("a_t", "b_t")) == 0) | (F.size(F.array_except("b_t", "a_t")) == 0)
    pairs = pairs.where((F.col("a_c") == F.col("b_c")) | inside)
    extra = F.array_union(F.array_except("a_t", "b_t"), F.array_except("b_t", "a_t"))
    odd = pairs.where("a_c <> b_c").select("a_item_id", "b_item_id", F.explode(extra).alias("name")).join(names, "name").select("a_item_id", "b_item_id").distinct()
    return pairs.join(odd, ["a_item_id", "b_item_id"], "left_anti").select(F.col("a_item_id").alias("a"), F.col("b_item_id").alias("b"))


def trivial_pairs(items: DataFrame, item_attr: DataFrame, least: float = 0.9) -> DataFrame:
    """Pairs that say nothing (G5): one name's tokens contain the other's, or attribute Jaccard is high. ``a < b``."""
    tokens = items.select("item_id", F.split("name", r"[_\s\-]+").alias("t")).withColumn("w", F.explode("t"))
    named = paired(tokens.select("w", "item_id", "t"), "w", ["a", "s"], ["b", "u"]).where("a < b").where((F.size(F.array_except("s", "u")) == 0) | (F.size(F.array_except("u", "s")) == 0)).select("a", "b")
    same = attribute_similarity(item_attr).where((F.col("jaccard") >= least) & (F.col("i") < F.col("j"))).select(F.col("i").alias("a"), F.col("j").alias("b"))
    return named.union(same).distinct()


def bridges(edges: DataFrame, pairs: DataFrame, skip: DataFrame | None = None, k: int = 5) -> DataFrame:
    """Common neighbours of each pair by the weaker of their two edges (G7). ``pairs``: a, b; ``skip``: near duplicates a, b."""
    e = both_ways(edges)
    found = pairs.join(e.select("a", F.col("b").alias("c"), F.col("weight").alias("w1")), "a").join(e.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("weight").alias("w2")), ["b", "c"])
    found = found.select("a", "b", "c", F.least("w1", "w2").alias("strength"))
    if skip is not None:
        s = skip.select(F.col("a").alias("p"), F.col("b").alias("c")).union(skip.select("b", "a")).distinct()
        for end in ("a", "b"):
            found = found.join(s.withColumnRenamed("p", end), [end, "c"], "left_anti")
    return top_k(found.select("a", "b", "c", "strength"), ["a", "b"], "strength", "c", k)


def blended_neighbours(edges: DataFrame, cosines: DataFrame, k: int = 10, graph_share: float = 0.6) -> DataFrame:
    """Neighbours by graph and vectors together where both are there, by the vectors alone otherwise (G8). ``cosines``: a, b, cosine."""
    e = both_ways(edges)
    both = e.join(cosines, ["a", "b"], "full_outer")
    score = F.when(F.col("weight").isNotNull() & F.col("cosine").isNotNull(), graph_share * F.col("weight") + (1 - graph_share) * F.col("cosine")).otherwise(F.coalesce("cosine", "weight"))
    return top_k(both.select("a", "b", F.round(score, 6).alias("score")), ["a"], "score", "b", k)


def explain_pairs(pairs: DataFrame, witnesses: Sequence[tuple[str, DataFrame, float]]) -> DataFrame:
    """Weighted mean of the witnesses that know a pair, and how far they disagree (G9). A witness: name, table (a, b, value), weight."""
    out = pairs.select("a", "b")
    for name, t, _ in witnesses:
        out = out.join(t.select("a", "b", F.col("value").alias(name)), ["a", "b"], "left")
    weight = sum((F.when(F.col(n).isNotNull(), w).otherwise(0.0) for n, _, w in witnesses), F.lit(0.0))
    total = sum((F.coalesce(F.col(n) * w, F.lit(0.0)) for n, _, w in witnesses), F.lit(0.0))
    names = [F.col(n) for n, _, _ in witnesses]
    spread = F.greatest(*names) - F.least(*names)
    return out.withColumn("score", F.when(weight > 0, F.round(total / weight, 6))).withColumn("disagreement", F.round(spread, 6))


def percentile_in(value: Column, quantiles: Column) -> Column:
    """Position of a value in an empirical distribution given by evenly spaced quantiles, 0..100 (F8)."""
    below = F.size(F.filter(quantiles, lambda q: q < value))
    return F.when(value.isNotNull(), 100.0 * F.least(below, F.size(quantiles) - 1) / (F.size(quantiles) - 1))


def pair_verdict(pairs: DataFrame, levels: Sequence[tuple[float, str]] = ((80, "classic"), (60, "good"), (40, "fair"), (20, "odd"))) -> DataFrame:
    """One score of three percentile axes, blended with the evidence of baskets (G10). ``pairs``: a, b, p1, p2, p3, npmi_pct, count_pct, count.

    The axes weigh by order: 0.5 the highest, 0.3, 0.2. Known evidence takes 0.7; with 4,000 baskets the score is 70 at least.
    """
    axes = F.array_sort(F.array_compact(F.array("p1", "p2", "p3")))
    n = F.size(axes)
    chem = F.when(n == 3, 0.5 * axes[2] + 0.3 * axes[1] + 0.2 * axes[0]).when(n == 2, (0.5 * axes[1] + 0.3 * axes[0]) / 0.8).when(n == 1, axes[0])
    seen = F.col("npmi_pct").isNotNull()
    evidence = 0.5 * F.col("npmi_pct") + 0.5 * F.col("count_pct")
    score = F.when(seen & chem.isNotNull(), 0.7 * evidence + 0.3 * chem).when(seen, evidence).otherwise(chem)
    score = F.when(F.col("count") >= 4000, F.greatest(score, F.lit(70.0))).otherwise(score)
    label = F.lit("poor")
    for least, name in reversed(list(levels)):
        label = F.when(score >= least, name).otherwise(label)
    return pairs.withColumn("score", F.round(score, 4)).withColumn("label", F.when(score.isNull(), "unknown").otherwise(label))


def basket_scores(queries: DataFrame, edges: DataFrame, least: float = -0.15) -> DataFrame:
    """Candidates for each basket by the sum of their edges to its items (G11). ``queries``: query_id, items; items themselves are left out.

    Weights count to nine decimals and are summed exactly, so that the order of the rows doesn't matter.
    """
    rows = queries.select("query_id", "items", F.explode("items").alias("a"))
    found = joined(rows, both_ways(edges.where(F.col("npmi") >= least)), "a").where(~F.array_contains("items", F.col("b")))
    return found.groupBy("query_id", F.col("b").alias("item_id")).agg(F.sum(F.round("weight", 9).cast("decimal(18,9)")).cast("double").alias("score"), F.count("*").alias("edges"))


def best_addition(queries: DataFrame, scores: DataFrame) -> DataFrame:
    """The one item with the best mean pair score to a pantry (G12). ``scores``: a, b, score (both directions)."""
    rows = queries.select("query_id", "items", F.explode("items").alias("a")).join(scores, "a").where(~F.array_contains("items", F.col("b")))
    means = rows.groupBy("query_id", F.col("b").alias("item_id")).agg(F.round(F.avg("score"), 6).alias("score"))
    return top_k(means, ["query_id"], "score", "item_id", 1)


def similarities(vectors: DataFrame, queries: DataFrame | None = None, blocks: int = 16) -> DataFrame:
    """Cosine of every query vector with every other vector (G6): ``a, b, cosine``.

    A stated query set against all vectors, dealt over blocks: each query goes to each block once.
    """
    return block_cosines((queries if queries is not None else vectors).select(F.col("item_id").alias("a"), F.col("vec").alias("v")), vectors, blocks=blocks)


#: Queries that meet a block's vectors in one piece, and of these in one product.
QUERIES_A_PIECE, ROWS_A_PRODUCT = 8_192, 256
#: Vectors of a block, and cosines that are taken and passed on at once.
VECTORS_A_BLOCK, COSINES_A_BATCH = 32_768, 1 << 20


def _unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of length 1; those of zero vectors are not a number."""
    x = column.combine_chunks()
    x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1).astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def block_cosines(queries: DataFrame, vectors: DataFrame, k: int | None = None, own: str = "a", blocks: int = 16) -> DataFrame:
    """Cosine of each query (a key or more, and ``v``) with each vector (item_id, vec) but that of its own id: the key's columns, ``b, cosine``; null where one is zero.

    Vectors are dealt over ``blocks``, or more where these would hold over VECTORS_A_BLOCK, and queries over pieces; a piece meets a block as products of matrices, a few rows at a
    time, and each product's cosines are passed on before the next is taken. So a task holds a piece, a block and COSINES_A_BATCH cosines. With ``k`` a query passes on the k
    best of each block (to nine decimals, ties by id; zero vectors are none of them), for ``top_k`` to pick from. Rows whose vector is null meet none.
    """
    keys = [c for c in queries.columns if c != "v"]
    pieces = max(1, -(-queries.count() // QUERIES_A_PIECE))
    blocks = max(blocks, -(-vectors.count() // VECTORS_A_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    vec = lambda c: F.col(c).cast("array<double>").alias("vec")
    left = queries.where("v is not null").withColumn("piece", F.pmod(F.xxhash64(*keys), F.lit(pieces)).cast("int")).withColumn("block", every(blocks))
    right = vectors.where("vec is not null").select(F.col("item_id").alias("b"), "vec", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block")).withColumn("piece", every(pieces))
    kinds = dict(queries.dtypes) | {"b": dict(vectors.dtypes)["item_id"], "cosine": "double"}
    names = [*keys, "b", "cosine"]
    ddl = ", ".join(f"{c} {kinds[c]}" for c in names)
    schema = to_arrow_schema(queries.sparkSession.createDataFrame([], ddl).schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(list(batches))
        one, two = both.filter(both["asks"]), both.filter(pc.invert(both["asks"])).sort_by("b")
        if not (len(one) and len(two)):
            return
        u, v = _unit_rows(one["vec"]), _unit_rows(two["vec"])
        ids, mine = two["b"].combine_chunks(), one[own].combine_chunks()
        other = ids.to_numpy(zero_copy_only=False)
        step = max(1, min(ROWS_A_PRODUCT, COSINES_A_BATCH // len(v)))
        for lo in range(0, len(u), step):
            cosine = u[lo : lo + step] @ v.T
            keep = mine[lo : lo + step].to_numpy(zero_copy_only=False)[:, None] != other
            if k is not None:
                cosine = np.round(cosine, 9)
                keep &= ~np.isnan(cosine)
                order = np.argsort(np.where(keep, -cosine, np.inf), axis=1, kind="stable")[:, :k]  # ids ascend, so that ties do
                best = np.zeros(keep.shape, bool)
                np.put_along_axis(best, order, True, axis=1)
                keep &= best
            row, at = np.nonzero(keep)
            value = cosine[row, at]
            columns = [one[c].combine_chunks().take(pa.array(row + lo)) for c in keys]
            yield pa.RecordBatch.from_arrays([*columns, ids.take(pa.array(at)), pa.array(value, mask=np.isnan(value))], names).cast(schema)

    left = left.select("piece", "block", F.lit(True).alias("asks"), *keys, F.lit(None).cast(kinds["b"]).alias("b"), vec("v"))
    right = right.select("piece", "block", F.lit(False).alias("asks"), *[F.lit(None).cast(kinds[c]).alias(c) for c in keys], "b", vec("vec"))
    return left.unionByName(right).groupBy("piece", "block").applyInArrow(meet, ddl)


def neighbour_overlap(one: DataFrame, two: DataFrame) -> DataFrame:
    """Jaccard of the neighbour lists that two spaces give (G30). Tables: a, b."""
    lists = [t.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias(n)) for t, n in ((one, "x"), (two, "y"))]  # k neighbours each
    return lists[0].join(lists[1], "a").select("a", F.round(jaccard("x", "y"), 6).alias("overlap"))


def suppress_near_duplicates(ranked: DataFrame, near: DataFrame, k: int, bound: int) -> DataFrame:
    """Greedy: down each query's list, an item near to one kept before is dropped, until k are kept.

    ``ranked``: query_id, item_id, rank; at most ``bound`` a query are looked at. ``near``: a < b.
    """
    names = near.select("a", "b").unionAll(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.collect_set("b").alias("near"))
    rows = ranked.where(F.col("rank") <= bound).join(names.withColumnRenamed("a", "item_id"), "item_id", "left")
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", F.coalesce("near", F.array().cast("array<bigint>")).alias("near")))).alias("xs"))
    start = F.array().cast("array<bigint>")
    kept = F.aggregate("xs", start, lambda acc, x: F.when((F.size(acc) >= k) | F.arrays_overlap(acc, x["near"]), acc).otherwise(F.concat(acc, F.array(x["item_id"].cast("bigint")))))
    return lists.select("query_id", F.posexplode(kept).alias("pos", "item_id")).select("query_id", "item_id", (F.col("pos") + 1).alias("rank"))


def substitutes(subs: DataFrame, k: int = 3) -> DataFrame:
    """Each item's alternatives by votes (G33). ``subs``: a, b, votes."""
    return top_k(subs.where("a <> b"), ["a"], "votes", "b", k)


def shared_groups(pairs: DataFrame, membership: DataFrame, head: int = 8) -> DataFrame:
    """Groups that both ends of a pair belong to, flagged where both are among the group's first by proximity (G34). ``membership``: grp, item_id, proximity."""
    order = W.partitionBy("grp").orderBy(F.desc("proximity"), "item_id")
    m = membership.withColumn("top", F.row_number().over(order) <= head)
    x = m.select(F.col("item_id").alias("a"), "grp", F.col("top").alias("top_a"))
    y = m.select(F.col("item_id").alias("b"), "grp", F.col("top").alias("top_b"))
    return pairs.join(x, "a").join(y, ["b", "grp"]).select("a", "b", "grp", (F.col("top_a") & F.col("top_b")).alias("core"))


def shared_direction(pairs: DataFrame, vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends lie nearest to the same label vector (G35). ``labels``: label, vec; a small stated set."""
    rows = vectors.crossJoin(F.broadcast(labels.select("label", F.col("vec").alias("pole"))))  # labels: a row for each declared direction
    best = rows.groupBy("item_id").agg(F.max_by("label", F.struct(cosine("vec", "pole"), F.col("label"))).alias("label"))
    return pairs.join(best.select(F.col("item_id").alias("a"), "label"), "a").join(best.select(F.col("item_id").alias("b"), "label"), ["b", "label"]).select("a", "b", "label")


def pair_evidence(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """What a graph says of given pairs, in either order (D11): ``a, b, count, npmi``, nulls for pairs that never met."""
    key = pairs.select("a", "b", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    return key.join(edges.select("src", "dst", "count", "npmi"), ["src", "dst"], "left").select("a", "b", "count", "npmi")


def entity_attributes(entities: DataFrame, alias: DataFrame) -> DataFrame:
    """The item x attribute graph of described entities (G1): distinct ``item_id, attr_id``.

    ``entities``: entity_id, forms (surface forms, as ``entity_aliases`` gives them), attrs; ``alias``: surface, item_id. An entity may stand for several items and an
    item for several entities; an entity none of whose forms is known adds nothing.
    """
    form = entities.select("entity_id", F.explode("forms").alias("surface")).join(alias.select("surface", "item_id"), "surface")
    hits = form.select("entity_id", "item_id").distinct()
    return hits.join(entities.select("entity_id", F.explode("attrs").alias("attr_id")), "entity_id").select("item_id", "attr_id").distinct()
