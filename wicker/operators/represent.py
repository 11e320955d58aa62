"""Learned representations of items (G13 to G32) with ``pyspark.ml`` and Spark sums; only vocabulary-sized matrices reach the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import cosine, dot, draw, norm, numbered, unit
from ..functions.pairing import paired
from ..functions.ranges import sums_before
from ..session import saved
from .baskets import frequencies, pair_counts
from .graph import both_ways, top_k
from .matrices import BLOCK, autoencoder_cells, blocked, inverse, singular_vectors

#: The largest vocabulary for which a dense item-by-item matrix is solved on the driver (200 MB of doubles).
DENSE_ITEMS = 5_000


def linear_autoencoder(baskets: DataFrame, ridge: float = 300.0, block: int = BLOCK) -> DataFrame:
    """Item-to-item weights of the closed-form linear autoencoder (G13): ``a, b, weight``, zero diagonal.

    The Gram matrix is summed by Spark (E1, E2), cut into blocks and inverted block by block; no item-by-item matrix is on one machine.
    """
    df = frequencies(baskets)
    pairs = pair_counts(baskets).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("count").alias("value"))
    gram = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "value")).unionByName(df.select(F.col("item_id").alias("a"), F.col("item_id").alias("b"), F.col("df").alias("value")))
    blocks, index, side = blocked(gram, df, ridge, block)
    return autoencoder_cells(inverse(blocks, side), index, block)


def autoencoder_scores(instances: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum of the context's weights to each other item."""
    rows = instances.select("basket_id", "context", F.explode("context").alias("a")).join(weights, "a").where(~F.array_contains("context", F.col("b")))
    return rows.groupBy("basket_id", F.col("b").alias("item_id")).agg(F.sum("weight").alias("score"))


def symmetric_vectors(weights: DataFrame, d: int) -> tuple[DataFrame, float]:
    """Vectors from the top positive eigenpairs of the symmetrised weights, and the share of the positive spectrum they keep."""
    import pandas as pd

    n = weights.select("a").distinct().count()
    if n > DENSE_ITEMS:
        raise ValueError(f"{n} items: more than {DENSE_ITEMS} are not solved on the driver; use svd_vectors")
    w = weights.toPandas()  # DENSE_ITEMS squared at most
    ids = np.unique(np.concatenate([w.a, w.b]))
    m = np.zeros((len(ids), len(ids)))
    m[np.searchsorted(ids, w.a), np.searchsorted(ids, w.b)] = w.weight
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(d, int((values > 0).sum()))
    vec = vectors[:, :k] * np.sqrt(values[:k])
    out = weights.sparkSession.createDataFrame(pd.DataFrame({"item_id": ids, "vec": [v.tolist() for v in vec]}))
    return out, float(values[:k].sum() / max(values[values > 0].sum(), 1e-12))


def als_vectors(baskets: DataFrame, rank: int = 16, alpha: float = 40.0, iterations: int = 5, reg: float = 0.1, seed: int = 0) -> DataFrame:
    """Item factors of implicit alternating least squares."""
    from pyspark.ml.recommendation import ALS

    rows = baskets.select(F.col("basket_id").cast("int"), F.explode(F.transform("items", lambda x: x.cast("int"))).alias("item_id"), F.lit(1.0).alias("r"))
    model = ALS(rank=rank, maxIter=iterations, regParam=reg, alpha=alpha, implicitPrefs=True, userCol="basket_id", itemCol="item_id", ratingCol="r", seed=seed).fit(rows)
    return model.itemFactors.select(F.col("id").cast("long").alias("item_id"), F.transform("features", lambda x: x.cast("double")).alias("vec"))


def keep_probability(df: DataFrame, threshold: float = 1e-3) -> DataFrame:
    """How likely a slot of each item stays when frequent ones are thinned."""
    total = df.agg(F.sum("df").alias("total"))
    f = F.col("df") / F.col("total")
    return df.crossJoin(F.broadcast(total)).select("item_id", F.least(F.lit(1.0), (F.sqrt(f / threshold) + 1) * threshold / f).alias("keep"))  # one row


def item_word_vectors(baskets: DataFrame, size: int = 16, thin: float | None = None, seed: int = 1, iterations: int = 1) -> DataFrame:
    """Skip-gram over baskets without an order (G15): items are shuffled by hash and the window spans the basket."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    rows = baskets.where(F.size("items") >= 2)
    slot = rows.select("basket_id", F.explode("items").alias("item_id"))
    key = F.concat_ws("-", "basket_id", "item_id")
    if thin is not None:
        slot = slot.join(keep_probability(frequencies(rows), thin), "item_id").where(draw(key, seed + 1) < F.col("keep"))
    lists = slot.groupBy("basket_id").agg(F.array_sort(F.collect_list(F.struct(draw(key, seed).alias("u"), F.col("item_id").cast("string").alias("w")))).alias("x")).select(F.col("x.w").alias("words"))
    model = Word2Vec(vectorSize=size, windowSize=40, minCount=1, maxIter=iterations, seed=seed, inputCol="words", outputCol="v").fit(lists)
    return model.getVectors().select(F.col("word").cast("long").alias("item_id"), vector_to_array("vector").alias("vec"))


def ppmi(counts: DataFrame, shift: float = 0.0, smooth: float = 1.0) -> DataFrame:
    """Shifted positive PMI of pair counts, both directions (G17): ``a, b, value`` > 0; context counts to the power ``smooth``."""
    sym = counts.select(F.col("src").alias("a"), F.col("dst").alias("b"), "count").unionAll(counts.select("dst", "src", "count"))
    rows = sym.groupBy("a").agg(F.sum("count").alias("n_a"))
    ctx = sym.groupBy("b").agg(F.pow(F.sum("count"), F.lit(smooth)).alias("n_b"))
    total, mass = sym.agg(F.sum("count").alias("n")), ctx.agg(F.sum("n_b").alias("z"))
    x = sym.join(rows, "a").join(ctx, "b").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(mass))  # one row each
    value = F.log((F.col("count") / F.col("n")) / ((F.col("n_a") / F.col("n")) * (F.col("n_b") / F.col("z")))) - shift
    return x.withColumn("value", value).where(F.col("value") > 0).select("a", "b", "value")


def svd_vectors(cells: DataFrame, d: int) -> DataFrame:
    """U sqrt(s) of a sparse matrix given as ``a, b, value`` (G18); fewer than d columns, or a lower rank, give fewer dimensions."""
    left, s = singular_vectors(cells, d)
    root = F.array(*[F.lit(float(x)) for x in np.sqrt(s)])
    return left.select(F.col("a").alias("item_id"), F.zip_with("vec", root, lambda x, y: x * y).alias("vec"))


def truncated(vectors: DataFrame, ranks: Sequence[int]) -> DataFrame:
    """The first components of each vector for several ranks."""
    return vectors.withColumn("rank", F.explode(F.array(*[F.lit(r) for r in ranks]))).withColumn("vec", F.slice("vec", F.lit(1), F.col("rank")))


def vector_sums(rows: DataFrame, by: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Weighted sums of vectors by group, component by component: ``*by, vec``."""
    w = weight if weight is not None else F.lit(1.0)
    parts = rows.select(*by, F.posexplode("vec").alias("i", "x"), w.alias("w")).groupBy(*by, "i").agg(F.sum(F.col("x") * F.col("w")).alias("x"))
    return parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p")).select(*by, F.col("p.x").alias("vec"))


def propagate(edges: DataFrame, vectors: DataFrame, steps: int = 2, average: bool = False) -> DataFrame:
    """Vectors spread over the normalised graph with self-loops (G20): k steps, or the mean of all layers with ``average``."""
    e = both_ways(edges).select("a", "b").unionByName(vectors.select(F.col("item_id").alias("a"), F.col("item_id").alias("b"))).distinct()
    deg = e.groupBy("a").agg(F.count("*").alias("d"))
    e = e.join(deg, "a").join(deg.select(F.col("a").alias("b"), F.col("d").alias("d2")), "b").select("a", "b", (1 / F.sqrt(F.col("d") * F.col("d2"))).alias("weight"))
    layers = [vectors.select("item_id", "vec")]
    for _ in range(steps):
        moved = e.join(layers[-1].withColumnRenamed("item_id", "a"), "a")
        layers.append(vector_sums(moved.select(F.col("b").alias("item_id"), "vec", "weight"), ["item_id"], F.col("weight")))
    if not average:
        return layers[-1]
    both = layers[0]
    for x in layers[1:]:
        both = both.unionByName(x)
    return vector_sums(both, ["item_id"], F.lit(1.0 / len(layers)))


def random_walks(edges: DataFrame, per_item: int = 2, length: int = 8, seed: int = 0, start: str = "a") -> DataFrame:
    """Walks over weighted edges ``a, b, weight`` (G21): ``walk_id, walk``. Each step looks a drawn number up in the item's cumulated weights.

    An item's line of weights is cut into as many cells as it has edges, so that a step meets the edges of one cell and an item of many edges is
    many join keys. Edges are run once and kept as a table: the line, the sizes and every step read them.
    """
    edges = saved(edges, "edges")
    size = edges.groupBy("a").agg(F.sum("weight").alias("total"), F.count("*").alias("m"))
    line = sums_before(edges.select("a", "b", "weight"), "b", {"lo": "weight"}, ["a"]).join(size, "a")
    line = line.select("a", "b", "m", (F.col("lo") / F.col("total")).alias("lo"), ((F.col("lo") + F.col("weight")) / F.col("total")).alias("hi"))
    cell = lambda u: F.least(F.floor(u * F.col("m")), F.col("m") - 1)
    line = line.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi"))))).select(F.col("a").alias("at"), "b", "lo", "hi", "cell")
    size, line = saved(size.select(F.col("a").alias("at"), "m"), "degrees"), saved(line, "line")  # read by every step
    items = edges.select(F.col(start).alias("at")).distinct()
    walks = items.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(per_item)))).select(F.concat_ws("-", "at", "n").alias("walk_id"), "at", F.array("at").alias("walk"))
    for step in range(1, length):
        drawn = walks.withColumn("u", draw(F.col("walk_id"), 1000 * seed + step)).join(size, "at").withColumn("cell", cell(F.col("u")))
        walks = drawn.join(line, ["at", "cell"]).where("u >= lo and u < hi").select("walk_id", F.col("b").alias("at"), F.concat("walk", F.array("b")).alias("walk"))
    return walks.select("walk_id", "walk")


def typed_edges(item_attr: DataFrame, attrs: DataFrame, cls: str | None = None) -> DataFrame:
    """Item to item over shared attributes of one class (G21): ``a, b, weight``, the weight spread over each attribute's items."""
    rows = item_attr.join(attrs, "attr_id") if cls is None else item_attr.join(attrs.where(F.col("class") == cls), "attr_id")
    size = rows.groupBy("attr_id").agg(F.count("*").alias("n"))
    pairs = paired(rows.select("attr_id", "item_id"), "attr_id", ["a"], ["b"]).where("a <> b")
    return pairs.join(size, "attr_id").groupBy("a", "b").agg(F.sum(1 / F.col("n")).alias("weight"))


def walk_vectors(walks: DataFrame, size: int = 16, window: int = 7, seed: int = 1) -> DataFrame:
    """Skip-gram over walks."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    words = walks.select(F.transform("walk", lambda x: x.cast("string")).alias("words"))
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=1, maxIter=1, seed=seed, inputCol="words", outputCol="v").fit(words)
    return model.getVectors().select(F.col("word").cast("long").alias("item_id"), vector_to_array("vector").alias("vec"))


def concatenated(spaces: Sequence[tuple[DataFrame, float]], d: int | None = None) -> DataFrame:
    """Unit vectors of several spaces, weighted and joined end to end, reduced by PCA if d is given."""
    out = None
    for t, w in spaces:
        one = t.select("item_id", F.transform(unit("vec"), lambda x: x * w).alias("v"))
        out = one if out is None else out.join(one.withColumnRenamed("v", "v2"), "item_id").select("item_id", F.concat("v", "v2").alias("v"))
    out = out.withColumnRenamed("v", "vec")
    return out if d is None else principal_parts(out, d)


def _moments(batches):
    """Sums of products of the vectors' components, a one put before each vector."""
    total = None
    for batch in batches:
        if batch.num_rows:
            x = np.asarray(batch.column(0).flatten(), float).reshape(batch.num_rows, -1)
            x = np.hstack([np.ones((len(x), 1)), x])
            total = x.T @ x + (0 if total is None else total)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "x"])


def covariance(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and covariance of the vectors, summed by Spark; dimensions squared numbers reach the driver."""
    sums = vectors.select("vec").mapInArrow(_moments, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).toPandas()
    d = round(len(sums) ** 0.5)
    m = np.zeros(d * d)
    m[sums["cell"].to_numpy()] = sums["x"].to_numpy()
    m = m.reshape(d, d)
    n = m[0, 0]
    mean = m[0, 1:] / n
    return mean, (m[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1, 1), int(n)


def principal_directions(vectors: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    mean, cov, _ = covariance(vectors)
    values, directions = np.linalg.eigh(cov)
    return mean, directions[:, ::-1][:, :k]


def _linear(vec: Column, matrix: np.ndarray) -> Column:
    """Row vector times matrix, as a column of array functions."""
    cols = [F.aggregate(F.zip_with(vec, F.array(*[F.lit(float(x)) for x in c]), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x) for c in matrix.T]
    return F.array(*cols)


def project(vectors: DataFrame, directions: np.ndarray, mean: np.ndarray | None = None) -> DataFrame:
    """Coordinates along the directions, of the vectors less a mean where one is given."""
    vec = F.col("vec")
    if mean is not None:
        vec = F.zip_with("vec", F.array(*[F.lit(float(x)) for x in mean]), lambda a, b: a - b)
    return vectors.select("item_id", _linear(vec, directions).alias("vec"))


def principal_parts(vectors: DataFrame, k: int) -> DataFrame:
    """Centred coordinates along the first k principal directions."""
    mean, directions = principal_directions(vectors, k)
    return project(vectors, directions, mean)


def centred(vectors: DataFrame, remove: int = 0) -> DataFrame:
    """Vectors less their mean and less their first principal directions."""
    mean, directions = principal_directions(vectors, remove)
    x = F.zip_with("vec", F.array(*[F.lit(float(v)) for v in mean]), lambda a, b: a - b)
    if not remove:
        return vectors.select("item_id", x.alias("vec"))
    return vectors.select("item_id", _linear(x, np.eye(len(mean)) - directions @ directions.T).alias("vec"))


def ridge_map(x: DataFrame, y: DataFrame, ridge: float = 1.0) -> np.ndarray:
    """Ridge regression of one space on another from sums that Spark makes (G24, G25): a matrix from x to y."""
    both = x.select("item_id", F.col("vec").alias("x")).join(y.select("item_id", F.col("vec").alias("y")), "item_id")

    def products(a: str, b: str) -> np.ndarray:
        cells = both.select(F.posexplode(a).alias("i", "p"), F.col(b).alias("other")).select("i", "p", F.posexplode("other").alias("j", "q")).groupBy("i", "j").agg(F.sum(F.col("p") * F.col("q")).alias("s")).toPandas()  # dimensions squared
        out = np.zeros((cells.i.max() + 1, cells.j.max() + 1))
        out[cells.i, cells.j] = cells.s
        return out

    xx = products("x", "x")
    return np.linalg.solve(xx + ridge * np.eye(len(xx)), products("x", "y"))


def mapped(x: DataFrame, matrix: np.ndarray) -> DataFrame:
    return x.select("item_id", _linear(F.col("vec"), matrix).alias("vec"))


def map_quality(predicted: DataFrame, y: DataFrame) -> DataFrame:
    """Mean cosine and squared residual of mapped vectors."""
    both = predicted.select("item_id", F.col("vec").alias("p")).join(y.select("item_id", F.col("vec").alias("y")), "item_id")
    diff = F.aggregate(F.zip_with("p", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
    return both.agg(F.count("*").alias("n"), F.round(F.avg(cosine("p", "y")), 6).alias("mean_cosine"), F.round(F.avg(diff), 6).alias("residual"))


def with_residual(base: DataFrame, other: DataFrame, ridge: float = 1.0, weight: float = 1.0) -> DataFrame:
    """The base space with the unit residual of another space, which the base can't predict, appended."""
    predicted = mapped(base, ridge_map(base, other, ridge))
    r = other.select("item_id", F.col("vec").alias("o")).join(predicted, "item_id").select("item_id", unit(F.zip_with("o", "vec", lambda a, b: a - b)).alias("r"))
    return base.join(r, "item_id").select("item_id", F.concat(unit("vec"), F.transform("r", lambda x: x * weight)).alias("vec"))


def steered(queries: DataFrame, vectors: DataFrame, angles: Sequence[float], k: int = 5) -> DataFrame:
    """Unit vectors turned toward a pole by an angle, and what lies nearest then (G27). ``queries``: query_id, vec, pole."""
    u, p = unit("vec"), unit("pole")
    from ..functions.columns import dot

    q = queries.select("query_id", u.alias("u"), p.alias("p")).withColumn("c", dot("u", "p"))
    q = q.withColumn("o", unit(F.zip_with("p", "u", lambda a, b: a - b * F.col("c")))).withColumn("angle", F.explode(F.array(*[F.lit(float(a)) for a in angles])))
    turned = F.zip_with("u", "o", lambda a, b: a * F.cos(F.radians("angle")) + b * F.sin(F.radians("angle")))
    q = q.select("query_id", "angle", turned.alias("v"))
    from .graph import block_cosines

    found = block_cosines(q, vectors, k, own="query_id").select("query_id", "angle", F.col("b").alias("item_id"), "cosine")
    return top_k(found, ["query_id", "angle"], "cosine", "item_id", k)


def table_agreement(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Computed lists against expected rows: exact ranks and overlap by angle (G31). Tables: query_id, angle, item_id, rank."""
    both = expected.withColumnRenamed("rank", "want").join(found.select("query_id", "angle", "item_id", "rank"), ["query_id", "angle", "item_id"], "left")
    return both.groupBy("angle").agg(F.count("*").alias("n"), F.round(F.avg((F.coalesce("rank", F.lit(-1)) == F.col("want")).cast("double")), 6).alias("exact"), F.round(F.count("rank") / F.count("*"), 6).alias("overlap"))


def collinearity(directions: DataFrame, mean: np.ndarray | None = None) -> DataFrame:
    """Mean pairwise |cosine| of a small set of direction vectors, after removing a mean if given (G32). ``directions``: item_id, vec."""
    x = directions
    if mean is not None:
        x = directions.select("item_id", F.zip_with("vec", F.array(*[F.lit(float(v)) for v in mean]), lambda a, b: a - b).alias("vec"))
    from .graph import similarities

    return similarities(x, blocks=1).where("a < b").agg(F.count("*").alias("pairs"), F.round(F.avg(F.abs("cosine")), 6).alias("mean_abs_cosine"))


def coherence(groups: DataFrame, vectors: DataFrame, seed: int = 0) -> DataFrame:
    """Mean cosine of a group's members to its centroid, and to that of a drawn group of the same size (G28). ``groups``: grp, item_id.

    The mean pairwise cosine comes from the length of the summed unit vectors, so no pairs are made.
    """
    v = vectors.select("item_id", unit("vec").alias("vec"))
    size = groups.groupBy("grp").agg(F.count("*").alias("n"))
    deck = numbered(v.select("item_id"), draw("item_id", seed), ["item_id"])
    places = size.select("grp", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("r"))
    control = places.join(deck, "r").select(F.concat_ws("", F.lit("control-"), "grp").alias("grp"), "item_id")
    rows = groups.select(F.col("grp").cast("string").alias("grp"), "item_id").unionByName(control).join(v, "item_id")
    sums = vector_sums(rows, ["grp"])
    n = rows.groupBy("grp").agg(F.count("*").alias("n"))
    out = sums.join(n, "grp").withColumn("len", norm("vec"))
    pair = (F.col("len") * F.col("len") - F.col("n")) / (F.col("n") * (F.col("n") - 1))
    return out.select("grp", "n", F.round(F.when(F.col("n") > 1, pair), 6).alias("pairwise"), F.round(F.col("len") / F.col("n"), 6).alias("to_centroid"))


def cluster_nmi(vectors: DataFrame, labels: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Normalised mutual information of Gaussian mixture clusters and labels."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    x = vectors.join(labels, "item_id").select("label", array_to_vector("vec").alias("features"))
    model = GaussianMixture(k=k, seed=seed, maxIter=10).fit(x)
    return nmi(model.transform(x).select("label", F.col("prediction").alias("cluster")))


def nmi(rows: DataFrame) -> DataFrame:
    """NMI of two label columns ``label, cluster``."""
    cells = rows.groupBy("label", "cluster").agg(F.count("*").alias("c"))
    n = cells.agg(F.sum("c").alias("n"))
    a, b = (cells.groupBy(x).agg(F.sum("c").alias(f"n_{x}")) for x in ("label", "cluster"))
    j = cells.join(a, "label").join(b, "cluster").crossJoin(F.broadcast(n))  # one row
    mi = F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("n_label") * F.col("n_cluster"))))
    h = lambda t, x: t.crossJoin(F.broadcast(n)).agg((-F.sum(F.col(x) / F.col("n") * F.log(F.col(x) / F.col("n")))).alias(f"h_{x}"))
    out = j.agg(mi.alias("mi")).crossJoin(h(a, "n_label")).crossJoin(h(b, "n_cluster"))  # one row each
    mean = (F.col("h_n_label") + F.col("h_n_cluster")) / 2
    return out.select(F.round(F.when(mean > 0, F.col("mi") / mean), 6).alias("nmi"))


def participation_ratio(vectors: DataFrame) -> DataFrame:
    """(sum of eigenvalues)^2 over the sum of their squares (H9), by traces of the covariance."""
    _, cov, n = covariance(vectors)
    value = float(np.trace(cov) ** 2 / max(np.sum(cov * cov), 1e-300))
    return vectors.sparkSession.createDataFrame([(n, round(value, 6))], "n long, participation double")


def popularity_alignment(vectors: DataFrame, df: DataFrame, k: int = 3) -> DataFrame:
    """|corr| of the first principal components with log frequency."""
    scored = principal_parts(vectors, k).join(df, "item_id")
    parts = [F.round(F.abs(F.corr(F.col("vec")[i], F.log1p("df"))), 6).alias(f"pc{i + 1}") for i in range(k)]
    return scored.agg(*parts)


def popularity_overlap(vectors: DataFrame, df: DataFrame, k: int = 20) -> DataFrame:
    """How many of the ``k`` items with the highest mean cosine are among the ``k`` most frequent (H13): ``common, jaccard``; ties by id.

    The mean cosine of an item with all is its product with the mean direction, so no pair is made.
    """
    units = vectors.select("item_id", unit("vec").alias("vec"))
    n = units.agg(F.count("*").alias("n"))
    centre = vector_sums(units.withColumn("all", F.lit(1)), ["all"]).crossJoin(n).select(F.transform("vec", lambda x: x / F.col("n")).alias("centre"))
    scored = units.crossJoin(F.broadcast(centre)).select("item_id", F.round(dot("vec", "centre"), 9).alias("score"))  # one row
    first = lambda t, c: t.orderBy(F.desc(c), "item_id").limit(k).select("item_id")  # noqa: E731  a top k
    both = first(scored, "score").join(first(df, "df"), "item_id").agg(F.count("*").alias("common"))
    return both.select("common", F.round(F.col("common") / (2 * k - F.col("common")), 6).alias("jaccard"))


def noise_vectors(vectors: DataFrame, seed: int = 0, rank_one: bool = False) -> DataFrame:
    """Random vectors in place of the given ones (H14): Gaussian, or all on one line."""
    key = lambda i: F.concat_ws("-", "item_id", i)
    gauss = lambda k: F.sqrt(-2 * F.log(F.greatest(draw(k, seed), F.lit(1e-12)))) * F.cos(2 * F.pi() * draw(k, seed + 1))
    if rank_one:
        return vectors.select("item_id", F.transform("vec", lambda x, i: gauss(F.col("item_id")) * (i + 1)).alias("vec"))
    rows = vectors.select("item_id", F.posexplode("vec").alias("i", "x")).select("item_id", "i", gauss(key(F.col("i"))).alias("x"))
    return rows.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p")).select("item_id", F.col("p.x").alias("vec"))


def shuffled_rows(vectors: DataFrame, seed: int = 0) -> DataFrame:
    """The same vectors given to other items (H14's shuffle control)."""
    left = numbered(vectors.select("item_id"), draw("item_id", seed + 1), ["item_id"])
    right = numbered(vectors.select("item_id", "vec"), draw("item_id", seed), ["item_id"]).select("vec", "r")
    return left.join(right, "r").select("item_id", "vec")


def align_vectors(named: DataFrame, items: DataFrame) -> DataFrame:
    """Vectors by name for a whole vocabulary (B9): ``item_id, name, vec``. ``named``: name, vec; ``items``: item_id, name.

    Names given twice on either side, items without a vector, and values that aren't finite are errors.
    """
    twice = lambda df: df.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n"))
    odd = named.where(~F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))).agg(F.count("*").alias("n"))
    missing = items.join(named, "name", "left_anti").agg(F.count("*").alias("n"))
    for what, facts in (("names given twice among the vectors", twice(named)), ("items given twice", twice(items)), ("items without a vector", missing), ("vectors with values that aren't finite", odd)):
        if n := facts.first()[0]:
            raise ValueError(f"{n} {what}")
    return items.join(named, "name").select("item_id", "name", "vec")
