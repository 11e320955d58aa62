"""Splits, ranks, metrics and their uncertainty (F1, F2, F6, F9, F11 and H operators)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.arrays import array_sums
from ..functions.columns import cosine, draw, pairs_of
from ..functions.ranges import places, sums_before
from ..session import saved
from .baskets import frequencies, npmi_graph
from .graph import both_ways, similarities, top_k

BASKET_READING = ("basket", "graph")


def hold_out_baskets(baskets: DataFrame, share: float = 0.3, seed: int = 0) -> DataFrame:
    """Baskets marked ``train`` or ``held`` by a draw of their id (H1)."""
    return baskets.withColumn("split", F.when(draw("basket_id", seed) < share, "held").otherwise("train"))


def held_out_edges(baskets: DataFrame, share: float = 0.3, seed: int = 0, **graph) -> DataFrame:
    """Edges of the full graph that the training baskets alone don't give (D3, H1)."""
    train = hold_out_baskets(baskets, share, seed).where("split = 'train'")
    return npmi_graph(baskets, **graph).join(npmi_graph(train, **graph).select("src", "dst"), ["src", "dst"], "left_anti")


def hold_out_edges(edges: DataFrame, share: float = 0.1, seed: int = 0) -> DataFrame:
    """Undirected edges marked ``train`` or ``held`` (H2); both directions of an edge fall on one side."""
    key = F.concat_ws("-", F.least("src", "dst"), F.greatest("src", "dst"))
    return edges.withColumn("split", F.when(draw(key, seed) < share, "held").otherwise("train"))


def check_protocol(reads: str, split: str) -> None:
    """A model that reads baskets has seen what an edge holdout hides (H3)."""
    if reads in BASKET_READING and split in ("edge-holdout", "full"):
        raise ValueError(f"a model that reads {reads}s can't be scored on the {split} split; hold out baskets")


def held_sample(baskets: DataFrame, train: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n held-out baskets: the complement of train, drawn uniformly."""
    return baskets.join(train.select("basket_id"), "basket_id", "left_anti").orderBy(draw("basket_id", seed), "basket_id").limit(n)


def partition_check(all_rows: DataFrame, parts: Sequence[DataFrame], key: str = "basket_id") -> DataFrame:
    """Rows in no part, and rows in more than one."""
    tagged = parts[0].select(key)
    for p in parts[1:]:
        tagged = tagged.unionAll(p.select(key))
    per = all_rows.select(key).join(tagged.groupBy(key).agg(F.count("*").alias("n")), key, "full_outer")
    return per.agg(F.count_if(F.col("n").isNull()).alias("in_none"), F.count_if(F.col("n") > 1).alias("in_several"), F.count("*").alias("n"))


def completion_instances(baskets: DataFrame, least: int = 3, seed: int = 0) -> DataFrame:
    """One hidden item a basket (H5): ``basket_id, target, context``."""
    pick = (1 + F.floor(draw("basket_id", seed) * F.size("items"))).cast("int")
    rows = baskets.where(F.size("items") >= least).withColumn("target", F.element_at("items", pick))
    return rows.select("basket_id", "target", F.array_except("items", F.array("target")).alias("context"))


def midranks(instances: DataFrame, scores: DataFrame, items: DataFrame) -> DataFrame:
    """Midrank of each target among all items outside its context (F1): better ones, then half of the equal ones.

    ``scores``: basket_id, item_id, score. Items without a score are last together; they are counted, not listed.
    """
    n = items.agg(F.count("*").alias("n_items"))
    inst = instances.crossJoin(F.broadcast(n))  # one row
    own = inst.join(scores.withColumnRenamed("item_id", "target").withColumnRenamed("score", "own"), ["basket_id", "target"], "left")
    rows = own.join(scores, "basket_id", "left").where(F.col("item_id").isNull() | ~F.array_contains("context", F.col("item_id")))
    per = rows.groupBy("basket_id", "target", "own", F.size("context").alias("k"), "n_items").agg(
        F.count_if(F.col("score") > F.col("own")).alias("better"), F.count_if(F.col("score") == F.col("own")).alias("equal"), F.count("score").alias("scored")
    )
    pool = F.col("n_items") - F.col("k")
    rank = F.when(F.col("own").isNotNull(), F.col("better") + 1 + (F.col("equal") - 1) / 2).otherwise(F.col("scored") + 1 + (pool - F.col("scored") - 1) / 2)
    return per.select("basket_id", "target", rank.cast("double").alias("rank"), pool.alias("pool"))


def optimistic_ranks(scores: DataFrame) -> DataFrame:
    """Rank by strictly better scores (F2)."""
    return scores.withColumn("rank", F.rank().over(W.partitionBy("basket_id").orderBy(F.desc("score"))))


def graph_scores(instances: DataFrame, edges: DataFrame) -> DataFrame:
    """A scorer: the sum of the edges from the context to each other item."""
    rows = instances.select("basket_id", "context", F.explode("context").alias("a")).join(both_ways(edges), "a").where(~F.array_contains("context", F.col("b")))
    return rows.groupBy("basket_id", F.col("b").alias("item_id")).agg(F.round(F.sum("weight"), 9).alias("score"))


def popularity_ranks(instances: DataFrame, df: DataFrame) -> DataFrame:
    """The optimistic rank of each target by document frequency among the items outside the context (D9, H15): ``basket_id, item_id, score, rank``.

    As many items are ahead as have a higher frequency, less those of the context: a histogram of frequencies and the context's own items tell, no instance
    meets the vocabulary.
    """
    hist = df.groupBy("df").agg(F.count("*").alias("m"))
    ahead = hist.select("df", F.coalesce(F.sum("m").over(W.orderBy(F.desc("df")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # a row for each distinct frequency
    target = instances.select("basket_id", "context", F.col("target").alias("item_id")).join(df.select("item_id", "df"), "item_id").join(ahead, "df")
    inside = target.select("basket_id", "df", F.explode("context").alias("c")).join(df.select(F.col("item_id").alias("c"), F.col("df").alias("d")), "c")
    inside = inside.groupBy("basket_id").agg(F.count_if(F.col("d") > F.col("df")).alias("inside"))
    rows = target.join(inside, "basket_id", "left")
    return rows.select("basket_id", "item_id", F.col("df").cast("double").alias("score"), (1 + F.col("ahead") - F.coalesce("inside", F.lit(0))).alias("rank"))


def popularity_scores(instances: DataFrame, df: DataFrame) -> DataFrame:
    """A scorer: document frequency of every item outside the context (D9, H15). The vocabulary is joined in blocks, each instance once a block."""
    blocks = 8
    i = instances.select("basket_id", "context", F.explode(F.array(*[F.lit(b) for b in range(blocks)])).alias("block"))
    v = df.select("item_id", F.col("df").cast("double").alias("score"), F.pmod(F.col("item_id"), F.lit(blocks)).cast("int").alias("block"))
    return i.join(v, "block").where(~F.array_contains("context", F.col("item_id"))).select("basket_id", "item_id", "score")


def completion_metrics(ranks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Recall at 10 and 50, MRR and median rank (H6), by group."""
    hit = lambda k: F.round(F.avg((F.col("rank") <= k).cast("double")), 6)
    return ranks.groupBy(*by).agg(F.count("*").alias("n"), hit(10).alias("recall_10"), hit(50).alias("recall_50"), F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"), F.round(F.percentile("rank", 0.5), 6).alias("median_rank"))


def macro_recall(ranks: DataFrame, k: int = 10) -> DataFrame:
    """Recall averaged over the targets seen."""
    per = ranks.groupBy("target").agg(F.avg((F.col("rank") <= k).cast("double")).alias("r"))
    return per.agg(F.count("*").alias("targets"), F.round(F.avg("r"), 6).alias("macro_recall"))


def backtest(scores: DataFrame, instances: DataFrame, df: DataFrame, staples: int = 50) -> DataFrame:
    """Scorers on the same instances, whole and without staple targets (H7). ``scores``: scorer, basket_id, item_id, score."""
    staple = df.orderBy(F.desc("df"), F.desc("item_id")).limit(staples).select(F.col("item_id").alias("target"), F.lit(True).alias("staple"))
    ranked = scores.withColumn("rank", F.rank().over(W.partitionBy("scorer", "basket_id").orderBy(F.desc("score"))))
    top = ranked.where(F.col("rank") <= 10).join(df.select("item_id", F.log("df").alias("lf")), "item_id").groupBy("scorer").agg(F.round(F.avg("lf"), 6).alias("mean_log_frequency"))
    names = scores.select("scorer").distinct()
    rows = instances.select("basket_id", "target").join(F.broadcast(names)).join(ranked.withColumnRenamed("item_id", "target"), ["scorer", "basket_id", "target"], "left").join(staple, "target", "left")  # a row for each scorer
    hit = (F.coalesce("rank", F.lit(10**9)) <= 10).cast("double")
    out = rows.groupBy("scorer").agg(F.round(F.avg(hit), 6).alias("recall_10"), F.round(F.avg(F.when(F.col("staple").isNull(), hit)), 6).alias("recall_10_non_staple"))
    return out.join(top, "scorer", "left")


def silent_instances(instances: DataFrame, edges: DataFrame) -> DataFrame:
    """Instances whose target has no edge to the context (H8)."""
    rows = instances.select("basket_id", "target", F.explode("context").alias("a")).join(both_ways(edges).withColumnRenamed("b", "target"), ["a", "target"])
    return instances.join(rows.select("basket_id").distinct(), "basket_id", "left_anti")


def triplet_accuracy(edges: DataFrame, vectors: DataFrame, seed: int = 0) -> DataFrame:
    """How often an edge's ends are closer than an end and a drawn item; ties half (H10). The draw picks an id out of the vocabulary's ranks."""
    ids = places(vectors.select("item_id"), ["item_id"])
    n = ids.agg(F.max("r").alias("n"))
    e = edges.select("src", "dst").crossJoin(F.broadcast(n)).withColumn("r", (1 + F.floor(draw(F.concat_ws("-", "src", "dst"), seed) * F.col("n"))).cast("int"))  # one row
    t = e.join(ids.withColumnRenamed("item_id", "other"), "r").where("other <> src and other <> dst")
    v = lambda name: vectors.select(F.col("item_id").alias(name), F.col("vec").alias(f"v_{name}"))
    from ..functions.columns import cosine

    t = t.join(v("src"), "src").join(v("dst"), "dst").join(v("other"), "other")
    near, far = F.round(cosine("v_src", "v_dst"), 9), F.round(cosine("v_src", "v_other"), 9)
    win = F.when(near > far, 1.0).when(near == far, 0.5).otherwise(0.0)
    return t.agg(F.count("*").alias("n"), F.round(F.avg(win), 6).alias("accuracy"), F.round(1.96 * F.stddev_samp(win) / F.sqrt(F.count("*")), 6).alias("half_width"))


def substitution_recall(neighbours: DataFrame, subs: DataFrame, k: int = 10, least: int = 3) -> DataFrame:
    """Share of an anchor's substitutes among its k nearest, over anchors with enough of them (H11). ``neighbours``: a, b, rank."""
    per = subs.where("a <> b").select("a", "b").distinct()
    anchors = per.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    hits = per.join(anchors, "a").join(neighbours.where(F.col("rank") <= k).select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left")
    return hits.groupBy("a", "n").agg(F.count("hit").alias("hits")).agg(F.count("*").alias("anchors"), F.round(F.avg(F.col("hits") / F.least(F.col("n"), F.lit(k))), 6).alias("recall"))


#: Draws that look for a non-edge before a whole band is searched.
DRAWS = 16


def degree_matched(edges: DataFrame, degrees: DataFrame, band: float = 0.1, seed: int = 5) -> DataFrame:
    """For each edge a non-edge whose end has nearly the same degree rank (D6): ``src, dst, other``.

    The first of ``DRAWS`` drawn ranks of the band that is no end and no edge; only edges whose draws all fail meet the whole band, cut into cells of
    its width, and take its smallest hash.
    """
    n = degrees.agg(F.count("*").alias("n"))
    ranked = places(degrees, ["degree", "item_id"]).crossJoin(F.broadcast(n)).withColumn("width", F.greatest(F.floor(F.col("n") * band), F.lit(1)))  # one row
    all_edges = both_ways(edges).select(F.col("a").alias("src"), F.col("b").alias("other"))
    own = edges.select("src", "dst").join(ranked.select(F.col("item_id").alias("dst"), "r", "width", "n"), "dst")
    low, high = F.greatest(F.col("r") - F.col("width"), F.lit(1)), F.least(F.col("r") + F.col("width"), F.col("n"))
    tries = own.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(DRAWS))))
    tries = tries.select("src", "dst", "j", (low + F.floor(draw(F.concat_ws("-", "src", "dst", "j"), seed) * (high - low + 1))).alias("r"))
    tries = tries.join(ranked.select(F.col("item_id").alias("other"), "r"), "r").where("other <> src and other <> dst").join(all_edges, ["src", "other"], "left_anti")
    drawn = tries.groupBy("src", "dst").agg(F.min_by("other", "j").alias("other"))
    cell = F.floor(F.col("r") / F.col("width"))
    near = ranked.select(F.col("item_id").alias("other"), F.col("r").alias("r2"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    rest = own.join(drawn, ["src", "dst"], "left_anti").withColumn("cell", cell).join(near, "cell").where("abs(r - r2) <= width and other <> src and other <> dst")
    rest = rest.join(all_edges, ["src", "other"], "left_anti")
    pick = F.min_by("other", F.struct(F.md5(F.concat_ws("-", "src", "dst", "other")), F.col("other")))
    return drawn.unionByName(rest.groupBy("src", "dst").agg(pick.alias("other")))


def auc(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Probability that a positive scores above a negative, ties half (H19, H12). ``rows``: label 0/1, score; without rows of both labels it is null.

    Distinct scores are summed first and their running sums taken by ranges of the score, so continuous scores are no single task.
    """
    per = rows.groupBy(*by, "score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    per = sums_before(per, "score", {"below": "neg"}, by)
    out = per.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("wins"), F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"))
    return out.withColumn("auc", F.round(F.when(F.col("n_pos") * F.col("n_neg") > 0, F.col("wins") / (F.col("n_pos") * F.col("n_neg"))), 6)).drop("wins")


def spearman(rows: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation with midranks for ties (H18); ranks come from running sums by ranges."""
    for c in (x, y):
        ties = rows.groupBy(*by, c).agg(F.count("*").alias("m"))
        ranks = sums_before(ties, c, {"before": "m"}, by).select(*by, c, (F.col("before") + (F.col("m") + 1) / 2).alias(f"rank_{c}"))
        rows = rows.join(ranks, [*by, c])
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.corr(f"rank_{x}", f"rank_{y}"), 6).alias("rho"))


def blend_sweep(rows: DataFrame, weights: Sequence[float]) -> DataFrame:
    """AUC of weight * p + (1 - weight) * q for each weight (H20). ``rows``: label, p, q."""
    grid = rows.withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    return auc(grid.withColumn("score", F.round(F.col("weight") * F.col("p") + (1 - F.col("weight")) * F.col("q"), 9)), ["weight"])


#: A prime below 2**31: what draws of replicates are counted by.
PRIME = 2_147_483_647


def _poisson_steps() -> np.ndarray:
    """Where the distribution function of Poisson(1) passes from one count to the next."""
    steps, mass, term = [], 0.0, 1.0 / 2.718281828459045
    for k in range(8):
        mass += term
        steps.append(mass)
        term /= k + 1
    return np.array(steps)


def _resampled(hits: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Each model's mean in each replicate: ``model, rep, m``. An instance draws once a replicate, for all models together.

    Three numbers that a hash of the instance gives make a quadratic modulo a prime whose values at 1, 2, ... are the replicates' draws, so any three
    replicates of an instance are independent. Rows make no rows: tasks sum arrays over replicates.
    """
    text = F.md5(F.concat(F.col("instance_id").cast("string"), F.lit(f":{seed}")))
    parts = [(F.conv(F.substring(text, 1 + 8 * i, 8), 16, 10).cast("long") % PRIME).alias(c) for i, c in enumerate("abc")]
    steps = _poisson_steps()

    def of(batch: pa.RecordBatch) -> dict[object, np.ndarray]:
        a, b, c = (batch.column(x).to_numpy(zero_copy_only=False)[:, None] for x in "abc")
        hit = np.nan_to_num(batch.column("hit").to_numpy(zero_copy_only=False).astype(float))
        models = batch.column("model").dictionary_encode()
        which, rep = models.indices.to_numpy(zero_copy_only=False), np.arange(1, replicates + 1, dtype=np.int64)
        sums = np.zeros((len(models.dictionary), 2, replicates))
        for lo in range(0, len(hit), 4096):
            part = slice(lo, lo + 4096)
            u = ((a[part] * (rep * rep) % PRIME + b[part] * rep + c[part]) % PRIME) / PRIME
            k = np.searchsorted(steps, u, side="right")
            one = np.zeros((len(models.dictionary), len(k)))
            one[which[part], np.arange(len(k))] = 1
            sums[:, 0] += (one * hit[part]) @ k
            sums[:, 1] += one @ k
        return {m: x.ravel() for m, x in zip(models.dictionary.to_pylist(), sums)}

    sums = array_sums(hits.select("model", *parts, F.col("hit").cast("double").alias("hit")), "model", of)
    pairs = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda r: F.struct(r.alias("rep"), F.element_at("sums", r).alias("s"), F.element_at("sums", r + replicates).alias("k")))
    return sums.select("model", F.inline(pairs)).where("k > 0").select("model", "rep", (F.col("s") / F.col("k")).alias("m"))


def bootstrap(hits: DataFrame, replicates: int = 200, baseline: str | None = None, seed: int = 0) -> DataFrame:
    """Means of each model's hits with 95 % intervals by paired Poisson resampling.

    ``hits``: model, instance_id, hit. One draw per replicate and instance, shared by all models. With a ``baseline``: difference,
    its interval and a two-sided p of 2 / replicates at least.
    """
    means = _resampled(hits, replicates, seed)
    point = hits.groupBy("model").agg(F.round(F.avg("hit"), 6).alias("mean"))
    bounds = means.groupBy("model").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    out = point.join(bounds, "model").select("model", "mean", F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))
    if baseline is None:
        return out
    base = means.where(F.col("model") == baseline).select("rep", F.col("m").alias("b"))
    diff = means.join(base, "rep").withColumn("d", F.col("m") - F.col("b"))
    tail = F.least(F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double")))
    diff = diff.groupBy("model").agg(F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.least(F.greatest(2 * tail, F.lit(2.0 / replicates)), F.lit(1.0)).alias("p"))
    return out.join(diff.select("model", F.round(F.col("q")[0], 6).alias("diff_low"), F.round(F.col("q")[1], 6).alias("diff_high"), F.round("p", 6).alias("p")), "model")


def promotes(hits: DataFrame, challenger: str, incumbent: str, **how) -> DataFrame:
    """The challenger replaces the incumbent only if the difference's lower bound is above 0."""
    out = bootstrap(hits.where(F.col("model").isin(challenger, incumbent)), baseline=incumbent, **how).where(F.col("model") == challenger)
    return out.withColumn("promote", F.col("diff_low") > 0)


def below_baseline(hits: DataFrame, baseline: str, replicates: int = 200, seed: int = 0) -> DataFrame:
    """How many models lie below the baseline, with an interval from draws that all models share."""
    means = _resampled(hits, replicates, seed)
    base = means.where(F.col("model") == baseline).select("rep", F.col("m").alias("b"))
    per = means.where(F.col("model") != baseline).join(base, "rep").groupBy("rep").agg(F.count_if(F.col("m") < F.col("b")).alias("below"))
    return per.agg(F.percentile("below", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q")).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high"))


def leaderboard(runs: DataFrame, baseline: str) -> DataFrame:
    """Best of native and raw for each model and its lift over the baseline, best first (F11). ``runs``: model, native, raw."""
    best = runs.withColumn("best", F.greatest("native", "raw"))
    base = best.where(F.col("model") == baseline).agg(F.max("best").alias("base"))
    return best.crossJoin(F.broadcast(base)).select("model", "best", F.round(F.col("best") / F.col("base"), 6).alias("lift")).orderBy(F.desc_nulls_last("best"), "model")  # one row


def rank_stability(runs: DataFrame, baseline: str | None = None) -> DataFrame:
    """Rank of each model per seed, its range and whether it never changes (F6); seeds in which it crosses the baseline. ``runs``: seed, model, value."""
    r = runs.withColumn("rank", F.row_number().over(W.partitionBy("seed").orderBy(F.desc("value"), "model")))
    out = r.groupBy("model").agg(F.min("rank").alias("best"), F.max("rank").alias("worst"), F.round(F.avg("rank"), 6).alias("mean_rank"), F.round(F.stddev_samp("value"), 6).alias("spread"))
    out = out.withColumn("invariant", F.col("best") == F.col("worst"))
    if baseline is not None:
        b = runs.where(F.col("model") == baseline).select("seed", F.col("value").alias("b"))
        below = runs.join(b, "seed").groupBy("model").agg(F.count_if(F.col("value") < F.col("b")).alias("seeds_below"))
        out = out.join(below, "model")
    return out


def seed_agreement(one: DataFrame, two: DataFrame) -> DataFrame:
    """Largest difference of two runs of the same models (H22). Tables: model, value."""
    both = one.join(two.withColumnRenamed("value", "other"), "model")
    return both.agg(F.count("*").alias("models"), F.round(F.max(F.abs(F.col("value") - F.col("other"))), 9).alias("largest"))


def compare_generations(runs: DataFrame, old: str, new: str) -> DataFrame:
    """Change of each shared model between two generations (H21). ``runs``: generation, model, value."""
    wide = runs.groupBy("model").pivot("generation", [old, new]).agg(F.max("value")).where(F.col(old).isNotNull() & F.col(new).isNotNull())
    return wide.select("model", F.col(old).alias("old"), F.col(new).alias("new"), F.round(F.col(new) - F.col(old), 6).alias("delta"))


def served_scores(runs: DataFrame, baseline: str) -> DataFrame:
    """Native score where there is one, raw where there isn't; how many models are below the baseline per seed (H36). ``runs``: seed, model, native, raw."""
    served = runs.withColumn("served", F.coalesce("native", "raw"))
    base = served.where(F.col("model") == baseline).select("seed", F.col("served").alias("base"))
    rows = served.join(base, "seed", "left")
    return rows.groupBy("seed").agg(F.count("*").alias("models"), F.count_if(F.col("served") < F.col("base")).alias("below"), F.bool_and(F.col("served").isNotNull() & F.col("base").isNotNull()).alias("complete"))


def expected_top1(rows: DataFrame) -> DataFrame:
    """Chance that the first of each list is right when ties are broken evenly, and the two extremes (H29). ``rows``: query_id, score, label."""
    w = W.partitionBy("query_id")
    best = rows.withColumn("top", F.max("score").over(w)).where(F.col("score") == F.col("top"))
    per = best.groupBy("query_id").agg(F.avg("label").alias("e"), F.max("label").alias("hi"), F.min("label").alias("lo"))
    return per.agg(F.count("*").alias("n"), F.round(F.avg("e"), 6).alias("expected"), F.round(F.avg("hi"), 6).alias("optimistic"), F.round(F.avg("lo"), 6).alias("pessimistic"))


def quantiles(rows: DataFrame, value: str, at: Sequence[float] = (0.5, 0.95), by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles of a metric."""
    names = [f"p{round(100 * p)}" for p in at]
    out = rows.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(p) for p in at])).alias("q"), F.count("*").alias("n"))
    return out.select(*by, "n", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(names)])


def verdicts(metrics: DataFrame, rules: Sequence[tuple[str, str, str, float]]) -> DataFrame:
    """Hypotheses decided by thresholds set beforehand (H32). ``metrics``: metric, value; a rule: name, metric, '>=' or '<=', threshold."""
    out = None
    for name, metric, sign, bound in rules:
        v = F.max(F.when(F.col("metric") == metric, F.col("value")))
        ok = v >= bound if sign == ">=" else v <= bound
        row = metrics.agg(v.alias("value"), F.when(v.isNull(), "untested").when(ok, "supported").otherwise("refuted").alias("verdict")).select(F.lit(name).alias("hypothesis"), "value", F.lit(bound).alias("bound"), "verdict")
        out = row if out is None else out.unionAll(row)
    return out


def calibration_set(edges: DataFrame, df: DataFrame, common: int, least_count: int, n: int, seed: int = 0) -> DataFrame:
    """Common strong pairs against common pairs never seen together (H33): ``a, b, label``. ``common``: how many frequent items take part, a fixed bound."""
    head = df.orderBy(F.desc("df"), "item_id").limit(common).select("item_id")
    ids = head.agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    pairs = ids.select(F.explode(pairs_of("items")).alias("p")).select("p.src", "p.dst")
    strong = edges.where(F.col("count") >= least_count).join(pairs, ["src", "dst"], "left_semi").select("src", "dst", F.lit(1).alias("label"))
    never = pairs.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("label", F.lit(0))
    rows = strong.unionByName(never)
    order = W.partitionBy("label").orderBy(draw(F.concat_ws("-", "src", "dst"), seed), "src", "dst")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).select(F.col("src").alias("a"), F.col("dst").alias("b"), "label")


def best_threshold(rows: DataFrame) -> DataFrame:
    """The score at which true less false positive rate is largest (H33). ``rows``: label, score."""
    per = rows.groupBy("score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    above = sums_before(per, "score", {"pos_above": "pos", "neg_above": "neg"}, descending=True)
    whole = rows.agg(F.sum("label").alias("all_pos"), F.sum(1 - F.col("label")).alias("all_neg"))
    share = lambda c: (F.col(f"{c}_above") + F.col(c)) / F.col(f"all_{c}")
    curve = above.crossJoin(F.broadcast(whole)).select("score", share("pos").alias("tpr"), share("neg").alias("fpr"))  # one row
    return curve.withColumn("gain", F.round(F.col("tpr") - F.col("fpr"), 9)).orderBy(F.desc("gain"), F.desc("score")).limit(1).select("score", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"), F.round("gain", 6).alias("gain"))


def rank_join(a: DataFrame, b: DataFrame, key: str = "instance_id") -> DataFrame:
    """Two models' ranks of the same instances side by side (D12): ``key, rank_a, rank_b, better``. Tables: key, rank; instances that one of them lacks are an error."""
    both = a.select(key, F.col("rank").alias("rank_a")).join(b.select(key, F.col("rank").alias("rank_b")), key, "full")
    alone = both.where("rank_a is null or rank_b is null").agg(F.count("*")).first()[0]
    if alone:
        raise ValueError(f"{alone} instances are ranked by one model only")
    better = F.when(F.col("rank_a") < F.col("rank_b"), "a").when(F.col("rank_b") < F.col("rank_a"), "b").otherwise("tie")
    return both.withColumn("better", better)


def graph_agreement(edges: DataFrame, vectors: DataFrame, least: int = 5, k: int = 100) -> DataFrame:
    """How well cosines of vectors follow a graph (H31): ``measure, n, value``. ``edges``: src, dst, count, npmi; ``vectors``: item_id, vec.

    Rank correlations of cosine and NPMI over all edges, over those of ``least`` baskets or more, and of cosine and log count over these; and the part of the ``k``
    edges of highest NPMI among these that are also the ``k`` of highest cosine (ties by src, dst).
    """
    u, v = (vectors.select(F.col("item_id").alias(c), F.col("vec").alias(f"v_{c}")) for c in ("src", "dst"))
    rows = edges.join(u, "src").join(v, "dst").select("src", "dst", "count", F.round("npmi", 9).alias("npmi"), F.round(cosine("v_src", "v_dst"), 9).alias("cosine"), F.round(F.log("count"), 9).alias("log_count"))
    rows = saved(rows, "agreement")  # six readers, and behind them a graph
    some = rows.where(F.col("count") >= least)
    out = None
    for name, part, x in (("npmi", rows, "npmi"), ("npmi, counted", some, "npmi"), ("log count, counted", some, "log_count")):
        one = spearman(part.select("cosine", x), "cosine", x).select(F.lit(name).alias("measure"), "n", F.col("rho").alias("value"))
        out = one if out is None else out.unionByName(one)
    first = lambda c: some.orderBy(F.desc(c), "src", "dst").limit(k).select("src", "dst")  # noqa: E731  a top k of edges
    common = first("npmi").join(first("cosine"), ["src", "dst"]).agg(F.count("*").alias("n"))
    return out.unionByName(common.select(F.lit("top overlap").alias("measure"), "n", F.round(F.col("n") / k, 6).alias("value")))
