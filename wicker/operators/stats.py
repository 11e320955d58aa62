"""Pairing statistics against drawn baskets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import draw, fine_draw, numbered, pairs_of
from ..functions.joins import joined
from ..session import saved
from .evaluate import spearman


#: Whole baskets that a task draws for or pairs at most.
BASKETS_A_TASK = 50_000


def _dealt(baskets: DataFrame) -> DataFrame:
    """Whole baskets dealt over tasks by id, in a stated number: points and pairs are many times their bytes, by which Spark would put baskets together."""
    tasks = max(baskets.sparkSession.sparkContext.defaultParallelism, -(-baskets.count() // BASKETS_A_TASK))
    return baskets.repartition(tasks, "basket_id")


def sharing(baskets: DataFrame, shared: DataFrame, group: str) -> DataFrame:
    """Mean number of shared attributes over each basket's pairs. ``shared``: i, j, shared (both directions).

    Baskets are shuffled whole before their pairs are made, so that pairs are summed where they are made as long as ``shared`` can be broadcast.
    """
    rows = _dealt(baskets.select("basket_id", group, "items")).select("basket_id", group, F.size("items").alias("n"), F.explode(pairs_of("items")).alias("p"))
    rows = joined(rows.select("basket_id", group, "n", F.col("p.src").alias("i"), F.col("p.dst").alias("j")), shared.select("i", "j", "shared"), ["i", "j"], "left")
    return rows.groupBy("basket_id", group).agg(F.avg(F.coalesce("shared", F.lit(0))).alias("s"), F.first("n").alias("n"))


def null_baskets(baskets: DataFrame, group: str, replicate: int = 0) -> DataFrame:
    """For every basket one of the same size from its group's items, drawn without replacement by frequency (H24): ``basket_id, group, items``.

    A basket draws points on the line of its group's slots, 2n + 8 for n items; the first n different items are kept. That repeats are drawn again makes it
    the same as keys ln p - ln(-ln u) of the whole vocabulary ranked (Gumbel top-k), but rows go with the slots. The few baskets whose points
    hold too few different items take the rest by such keys. A group with fewer items than a basket gives all it has.
    """
    slot = baskets.select(group, F.explode("items").alias("item_id"))
    weights = saved(slot.groupBy(group, "item_id").agg(F.count("*").alias("f")), "weights")
    line = W.partitionBy(group).orderBy("item_id")  # a row for each item of a group's vocabulary
    line = weights.withColumn("hi", F.sum("f").over(line)).withColumn("lo", F.col("hi") - F.col("f"))
    size = weights.groupBy(group).agg(F.sum("f").alias("total"), F.count("*").alias("m")).withColumn("width", F.greatest(F.lit(1), F.floor(F.col("total") / F.col("m"))))
    # cells of the line, about as many as items, so that a point meets the one or two items of its cell
    cells = line.join(size, group).withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / F.col("width")), F.floor((F.col("hi") - 1) / F.col("width"))))).select(group, "cell", "item_id", "lo", "hi")
    # baskets are shuffled by id before their points are made: these stay where they are as long as the cells can be broadcast
    wanted = joined(_dealt(baskets.select("basket_id", group, F.size("items").alias("n"))), size, group).withColumn("n", F.least("n", F.col("m").cast("int")))
    points = wanted.withColumn("j", F.explode(F.sequence(F.lit(1), 2 * F.col("n") + 8)))
    at = F.floor(fine_draw(F.concat_ws("-", "basket_id", "j"), 100 + replicate) * F.col("total"))
    points = points.withColumn("at", at).withColumn("cell", F.floor(F.col("at") / F.col("width")))
    hit = joined(points.select("basket_id", group, "n", "j", "at", "cell"), cells, [group, "cell"]).where("at >= lo and at < hi")
    per = hit.groupBy("basket_id", group, "n").agg(F.array_sort(F.collect_list(F.struct("j", "item_id"))).alias("x"))  # a basket's own points
    drawn = saved(per.select("basket_id", group, "n", F.slice(F.array_distinct(F.col("x.item_id")), F.lit(1), F.col("n")).alias("items")), "drawn")
    short = joined(drawn.where(F.size("items") < F.col("n")), weights, group).where(~F.array_contains("items", F.col("item_id")))
    u = draw(F.concat_ws("-", "basket_id", "item_id"), 100 + replicate)
    order = W.partitionBy("basket_id").orderBy(F.desc(F.log("f") - F.log(-F.log(F.greatest(u, F.lit(1e-12))))), "item_id")
    rest = short.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("n") - F.size("items")).groupBy("basket_id").agg(F.collect_list("item_id").alias("rest"))
    out = joined(drawn, rest, "basket_id", "left")
    return out.select("basket_id", group, F.array_sort(F.concat("items", F.coalesce("rest", F.array()))).alias("items"))


def pairing_statistic(baskets: DataFrame, shared: DataFrame, group: str, replicate: int = 0) -> DataFrame:
    """Sharing of real baskets less that of drawn ones by group, with its standard error and 95 % interval."""
    baskets = saved(baskets.select("basket_id", group, "items"), "baskets")
    return _against(baskets, null_baskets(baskets, group, replicate), shared, group)


def _against(baskets: DataFrame, nulls: DataFrame, shared: DataFrame, group: str) -> DataFrame:
    """``pairing_statistic`` of baskets and of those drawn for them."""
    real = sharing(baskets, shared, group).select("basket_id", group, F.col("s").alias("real"))
    null = sharing(nulls, shared, group).select("basket_id", F.col("s").alias("null"))
    d = real.join(null, "basket_id")
    out = d.groupBy(group).agg(F.count("*").alias("n"), F.avg("real").alias("real"), F.avg("null").alias("null"), F.avg(F.col("real") - F.col("null")).alias("delta"), F.sqrt(F.var_samp(F.col("real") - F.col("null")) / F.count("*")).alias("se"))
    return out.select(group, "n", *[F.round(c, 6).alias(c) for c in ("real", "null", "delta", "se")], F.round(F.col("delta") - 1.96 * F.col("se"), 6).alias("low"), F.round(F.col("delta") + 1.96 * F.col("se"), 6).alias("high"), F.round(F.col("delta") / F.col("null"), 6).alias("relative"))


def pairing_z(baskets: DataFrame, shared: DataFrame, group: str, replicates: int = 4) -> DataFrame:
    """The older form: real mean against the scatter of null replicates."""
    baskets, shared = saved(baskets.select("basket_id", group, "items"), "baskets"), saved(shared, "shared")
    real = sharing(baskets, shared, group).groupBy(group).agg(F.avg("s").alias("real"))
    nulls = None
    for r in range(replicates):
        one = sharing(null_baskets(baskets, group, r), shared, group).groupBy(group).agg(F.avg("s").alias("m"))
        nulls = one if nulls is None else nulls.unionAll(one)
    scatter = nulls.groupBy(group).agg(F.avg("m").alias("null"), F.stddev_samp("m").alias("sd"))
    return real.join(scatter, group).select(group, F.round("real", 6).alias("real"), F.round("null", 6).alias("null"), F.round((F.col("real") - F.col("null")) / F.when(F.col("sd") > 0, F.col("sd")), 4).alias("z"))


def sign_score(deltas: DataFrame, predictions: DataFrame, group: str) -> DataFrame:
    """How many groups have the predicted sign, and how many intervals exclude 0 (H26). ``predictions``: group, sign."""
    rows = deltas.join(predictions, group)
    right = F.signum("delta") == F.col("sign")
    clear = (F.col("low") > 0) | (F.col("high") < 0)
    return rows.agg(F.count("*").alias("n"), F.count_if(right).alias("right"), F.count_if(clear).alias("clear"), F.count_if(clear & right).alias("clear_and_right"))


def masked_arms(baskets: DataFrame, shared: DataFrame, masked: DataFrame, group: str) -> DataFrame:
    """The statistic with and without masked pairs on identical draws (H26). ``masked``: a < b."""
    m = masked.select(F.col("a").alias("i"), F.col("b").alias("j"))
    m = m.unionByName(m.select(F.col("j").alias("i"), F.col("i").alias("j")))
    baskets, shared = saved(baskets.select("basket_id", group, "items"), "baskets"), saved(shared, "shared")
    nulls = null_baskets(baskets, group)
    arms = [("all", shared), ("masked", shared.join(m, ["i", "j"], "left_anti"))]
    out = None
    for name, s in arms:
        one = _against(baskets, nulls, s, group).select(F.lit(name).alias("arm"), group, "n", "delta", "se")
        out = one if out is None else out.unionAll(one)
    return out


def permutation_p(rows: DataFrame, x: str, y: str, key: str, replicates: int = 99) -> DataFrame:
    """P-value of a rank correlation by shuffling y (H27): each replicate pairs x with y in a drawn order, both numbered in buckets of the draw."""
    actual = spearman(rows, x, y).select(F.col("rho").alias("actual"), "n")
    reps = rows.select(key, x, y).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    one = numbered(rows.select(key, x), draw(key, 8), [key], name="pos").select(x, "pos")
    left = one.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    right = numbered(reps, draw(F.concat_ws("-", key, "rep"), 9), [key], by=["rep"], name="pos").select("rep", y, "pos")
    rhos = spearman(left.join(right, ["rep", "pos"]), x, y, ["rep"])
    out = rhos.crossJoin(F.broadcast(actual)).groupBy("actual", actual["n"]).agg(F.count_if(F.abs("rho") >= F.abs("actual")).alias("as_far"), F.count("*").alias("replicates"))  # one row
    return out.select("n", F.col("actual").alias("rho"), F.round((F.col("as_far") + 1) / (F.col("replicates") + 1), 6).alias("p"))


def pair_score_audit(scores: DataFrame) -> DataFrame:
    """Asymmetry of pair scores, drift and label changes over seeds (H28). ``scores``: seed, a, b, score, label."""
    turned = scores.select("seed", F.col("b").alias("a"), F.col("a").alias("b"), F.col("score").alias("back"))
    skew = scores.join(turned, ["seed", "a", "b"]).agg(F.round(F.max(F.abs(F.col("score") - F.col("back"))), 9).alias("asymmetry"), F.count("*").alias("pairs_both_ways"))
    per = scores.groupBy("a", "b").agg((F.max("score") - F.min("score")).alias("drift"), F.countDistinct("label").alias("labels"))
    drift = per.agg(F.round(F.max("drift"), 9).alias("largest_drift"), F.round(F.avg((F.col("labels") > 1).cast("double")), 6).alias("label_churn"))
    return skew.crossJoin(F.broadcast(drift))  # one row each


def monotonicity(rows: DataFrame, parts: list[str], combine: Callable[[list[Column]], Column], key: str, most: float = 100.0) -> DataFrame:
    """How often a combined score falls when one of its parts is raised (H28): ``tried, violations``; there should be none.

    Each row raises each part once, by a drawn step of up to a fifth of ``most`` (not beyond ``most``).
    """
    score = lambda values: combine(values)
    now = [F.col(c).cast("double") for c in parts]
    falls = []
    for i in range(len(parts)):
        raised = F.least(F.lit(most), now[i] + most * (0.001 + 0.199 * draw(key, 70 + i)))
        falls.append((score([raised if j == i else x for j, x in enumerate(now)]) < score(now) - 1e-9).cast("int"))
    return rows.agg((F.count("*") * len(parts)).alias("tried"), F.coalesce(F.sum(sum(falls, F.lit(0))), F.lit(0)).alias("violations"))


def ordered_blend(weights: Sequence[float]) -> Callable[[list[Column]], Column]:
    """A score that weighs the largest part first, then the next."""

    def combine(values: list[Column]) -> Column:
        ordered = F.sort_array(F.array(*values), asc=False)
        return sum((F.lit(float(w)) * ordered[i] for i, w in enumerate(weights)), F.lit(0.0))

    return combine
