"""Queries of graphs, similarity and representations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import jaccard, norm
from ..operators import baskets as B, graph as G, neighbours as N, represent as R
from ..operators.matrices import singular_vectors
from ..session import table
from . import bindings as X
from .registering import collector

QUERIES, ORACLE_SQL, query = collector()
D = DataFrame
P = SparkSession
FORMS = ("small", "large", "old", "new", "red", "blue", "green", "hot", "cold")


def edges_of(spark: P, sf: str, **how) -> D:
    return B.npmi_graph(B.baskets_from_rows(X.slots_by_name(spark, sf), "basket_id", "item_id"), **how)


def baskets_of(spark: P, sf: str) -> D:
    return B.baskets_from_rows(X.slots_by_name(spark, sf), "basket_id", "item_id")


@query(f"with {X.EDGES}, l as (select min(npmi) least from edges) select a, b, round(weight - least + 1e-3, 6) weight from both_ways, l")
def both_ways(spark: P, sf: str) -> D:
    return G.both_ways(edges_of(spark, sf), shift=True).select("a", "b", F.round("weight", 6).alias("weight"))


@query(f"with {X.EDGES}, r as (select a, b, round(weight, 9) weight, row_number() over (partition by a order by round(weight, 9) desc, b) as rank from both_ways) select a, b, rank from r where rank <= 5")
def top_neighbours(spark: P, sf: str) -> D:
    return G.top_k(G.both_ways(edges_of(spark, sf)).withColumn("weight", F.round("weight", 9)), ["a"], "weight", "b", 5).select("a", "b", "rank")


@query(f"with {X.SLOTS} select item_id, count(*) df from slots group by 1 order by df desc, item_id desc limit 15")
def head_by_frequency(spark: P, sf: str) -> D:
    return G.head_by_frequency(B.frequencies(baskets_of(spark, sf)), 15)


@query(f"with {X.ATTR}, {X.SHARED} select * from shared")
def shared_attributes(spark: P, sf: str) -> D:
    return G.shared_attributes(X.item_attr(spark, sf))


@query(f"with {X.ATTR}, {X.SHARED}, z as (select item_id, count(*) n from item_attr group by 1) select i, j, shared, round(shared / sqrt(x.n * y.n), 6) cosine, round(shared / (x.n + y.n - shared)::double, 6) jaccard from shared join z x on x.item_id = i join z y on y.item_id = j")
def attribute_similarity(spark: P, sf: str) -> D:
    return G.attribute_similarity(X.item_attr(spark, sf))


_CANON = f"""{X.ITEMS}, w as (select item_id, list_transform(string_split(lower(name), ' '), lambda x: case when x like '%ies' and length(x) > 5 then x[:-4] || 'y' when x like '%es' and length(x) > 4 then x[:-3] when x like '%s' and length(x) > 3 then x[:-2] else x end) t from items),
c as (select item_id, array_to_string(case when len(list_filter(t, lambda x: not list_contains([{', '.join(repr(f) for f in FORMS)}], x))) > 0 then list_filter(t, lambda x: not list_contains([{', '.join(repr(f) for f in FORMS)}], x)) else t end, '_') canon from w)"""


@query(f"with {_CANON} select item_id, canon from c")
def canonical_names(spark: P, sf: str) -> D:
    return X.items(spark, sf).select("item_id", G.canonical_name(F.col("name"), FORMS).alias("canon"))


@query(f"with {_CANON} select a.item_id a, b.item_id b from c a join c b on a.canon = b.canon and a.item_id < b.item_id")
def near_duplicate_names(spark: P, sf: str) -> D:
    return G.near_duplicate_names(X.items(spark, sf), FORMS)


@query(f"with {X.ATTR}, {X.SHARED}, z as (select item_id, count(*) n from item_attr group by 1), j as (select i a, j b from shared join z x on x.item_id = i join z y on y.item_id = j where i < j and shared / (x.n + y.n - shared)::double >= 0.9) select distinct * from j")
def trivial_pairs(spark: P, sf: str) -> D:
    return G.trivial_pairs(X.items(spark, sf), X.item_attr(spark, sf))


_SOME_PAIRS = "few as (select src a, dst b from edges)"


@query(f"with {X.EDGES}, {_SOME_PAIRS}, s as (select few.a, few.b, x.b c, round(least(x.weight, y.weight), 9) strength from few join both_ways x on x.a = few.a join both_ways y on y.a = few.b and y.b = x.b), r as (select *, row_number() over (partition by a, b order by strength desc, c) as rank from s) select a, b, c, rank from r where rank <= 5")
def bridges(spark: P, sf: str) -> D:
    e = edges_of(spark, sf).withColumn("npmi", F.round("npmi", 9))
    return G.bridges(e, e.select(F.col("src").alias("a"), F.col("dst").alias("b"))).select("a", "b", "c", "rank")


def _vocab_vectors(spark: P, sf: str) -> D:
    return X.vectors(spark, sf).join(X.items(spark, sf), "item_id", "left_semi").select("item_id", "vec")


_COS = "v as (select vec_id item_id, embedding::double[] vec, label from embeddings), cosines as (select a.item_id a, b.item_id b, list_cosine_similarity(a.vec, b.vec) cosine from v a join v b on a.item_id <> b.item_id)"


@query(f"with {X.EDGES}, v as (select vec_id item_id, embedding::double[] vec from embeddings semi join items on item_id = vec_id), cosines as (select a.item_id a, b.item_id b, list_cosine_similarity(a.vec, b.vec) cosine from v a join v b on a.item_id <> b.item_id), s as (select coalesce(e.a, c.a) a, coalesce(e.b, c.b) b, round(case when weight is not null and cosine is not null then 0.6 * weight + 0.4 * cosine else coalesce(cosine, weight) end, 6) score from both_ways e full join cosines c on e.a = c.a and e.b = c.b), r as (select *, row_number() over (partition by a order by score desc, b) as rank from s) select a, b, score, rank from r where rank <= 10")
def blended_neighbours(spark: P, sf: str) -> D:
    return G.blended_neighbours(edges_of(spark, sf), G.similarities(_vocab_vectors(spark, sf)))


@query(f"with {X.EDGES}, {X.ATTR[len(X.ITEMS) + 2:]}, {X.SHARED}, z as (select item_id, count(*) n from item_attr group by 1), jac as (select i, j, round(shared / (x.n + y.n - shared)::double, 6) value from shared join z x on x.item_id = i join z y on y.item_id = j), p as (select src a, dst b, round(npmi, 6) graph, j.value attribute from edges left join jac j on j.i = src and j.j = dst) select a, b, graph, attribute, case when true then round((graph * 0.6 + coalesce(attribute * 0.4, 0)) / (0.6 + case when attribute is null then 0.0 else 0.4 end), 6) end score, round(greatest(graph, attribute) - least(graph, attribute), 6) disagreement from p")
def explain_pairs(spark: P, sf: str) -> D:
    e = edges_of(spark, sf)
    graph = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.round("npmi", 6).alias("value"))
    attr = G.attribute_similarity(X.item_attr(spark, sf)).select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("jaccard").alias("value"))
    return G.explain_pairs(graph, [("graph", graph, 0.6), ("attribute", attr, 0.4)])


_QUANT = "q as (select quantile_cont(o_totalprice, [0.0, 0.25, 0.5, 0.75, 1.0]) q from orders)"


@query(f"with {_QUANT} select o_orderkey, 100.0 * least(len(list_filter(q, lambda x: x < o_totalprice)), 4) / 4 percentile from orders, q")
def percentile_in(spark: P, sf: str) -> D:
    o = table(spark, sf, "orders")
    q = o.agg(F.percentile("o_totalprice", F.array(*[F.lit(i / 4) for i in range(5)])).alias("q"))
    return o.crossJoin(F.broadcast(q)).select("o_orderkey", G.percentile_in(F.col("o_totalprice"), F.col("q")).alias("percentile"))  # one row


@query(f"with {X.EDGES}, p as (select src a, dst b, (src * 7 + dst) % 101::double p1, case when src % 2 = 0 then (src + dst * 3) % 101::double end p2, case when dst % 3 = 0 then (src * dst) % 101::double end p3, case when cnt % 2 = 0 then cnt % 101::double end npmi_pct, (cnt * 3) % 101::double count_pct, cnt * 40 cnt2 from edges), x as (select *, list_sort(list_filter([p1, p2, p3], lambda v: v is not null)) l from p), y as (select *, case len(l) when 3 then 0.5 * l[3] + 0.3 * l[2] + 0.2 * l[1] when 2 then (0.5 * l[2] + 0.3 * l[1]) / 0.8 else l[1] end chem from x), z as (select *, case when npmi_pct is not null then 0.7 * (0.5 * npmi_pct + 0.5 * count_pct) + 0.3 * chem else chem end s0 from y), s as (select a, b, case when cnt2 >= 4000 then greatest(s0, 70.0) else s0 end s from z) select a, b, round(s, 4) score, case when s >= 80 then 'classic' when s >= 60 then 'good' when s >= 40 then 'fair' when s >= 20 then 'odd' else 'poor' end as label from s")
def pair_verdict(spark: P, sf: str) -> D:
    e = edges_of(spark, sf)
    s, d, c = F.col("src"), F.col("dst"), F.col("count")
    pct = lambda x: (x % 101).cast("double")
    p = e.select(s.alias("a"), d.alias("b"), pct(s * 7 + d).alias("p1"), F.when(s % 2 == 0, pct(s + d * 3)).alias("p2"), F.when(d % 3 == 0, pct(s * d)).alias("p3"), F.when(c % 2 == 0, pct(c)).alias("npmi_pct"), pct(c * 3).alias("count_pct"), (c * 40).alias("count"))
    return G.pair_verdict(p).select("a", "b", "score", "label")


_QUERIES = "q as (select basket_id query_id, list(item_id order by item_id) items from slots where basket_id % 20 = 0 group by 1)"


@query(f"with {X.EDGES}, {_QUERIES}, x as (select query_id, items, unnest(items) a from q), s as (select query_id, b item_id, sum(round(weight, 9)::decimal(18, 9))::double score, count(*) n from x join both_ways using (a) where not list_contains(items, b) group by 1, 2) select query_id, item_id, score, n edges from s")
def basket_scores(spark: P, sf: str) -> D:
    q = baskets_of(spark, sf).where("basket_id % 20 = 0").withColumnRenamed("basket_id", "query_id")
    return G.basket_scores(q, edges_of(spark, sf))


@query(
    f"with {X.EDGES}, {_QUERIES}, v as (select vec_id item_id, embedding::double[] vec from embeddings semi join items on item_id = vec_id), u as (select item_id, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) un from v),"
    " x as (select query_id, items, unnest(items) a from q), g as (select query_id, b item_id, sum(round(weight, 9)::decimal(18, 9))::double score from x join both_ways using (a) where not list_contains(items, b) group by 1, 2),"
    " c as (select query_id, i, sum(un[i]) c from x join u on u.item_id = a, (select unnest(range(1, 65)) i) group by 1, 2), m as (select query_id, list(c order by i) v from c group by 1),"
    " nv as (select m.query_id, v.item_id, list_cosine_similarity(m.v, vec) cosine from m join q using (query_id), v where not list_contains(items, v.item_id)), st as (select item_id from slots group by 1 order by count(*) desc, item_id desc limit 5)"
    " select query_id, item_id, round(coalesce(score, 0) + 0.5 * coalesce(cosine, 0), 6) score from g full join nv using (query_id, item_id) where item_id not in (select item_id from st)"
)
def hybrid_scores(spark: P, sf: str) -> D:
    b = baskets_of(spark, sf)
    q = b.where("basket_id % 20 = 0").withColumnRenamed("basket_id", "query_id")
    return N.hybrid_scores(q, edges_of(spark, sf), _vocab_vectors(spark, sf), staples=G.head_by_frequency(B.frequencies(b), 5))


@query(f"with {X.EDGES}, {_QUERIES}, x as (select query_id, items, unnest(items) a from q), s as (select query_id, b item_id, round(avg(weight), 6) score from x join both_ways using (a) where not list_contains(items, b) group by 1, 2), r as (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from s) select query_id, item_id, score from r where rank = 1")
def best_addition(spark: P, sf: str) -> D:
    q = baskets_of(spark, sf).where("basket_id % 20 = 0").withColumnRenamed("basket_id", "query_id")
    s = G.both_ways(edges_of(spark, sf)).select("a", "b", F.col("weight").alias("score"))
    return G.best_addition(q, s).select("query_id", "item_id", "score")


@query(f"with {_COS} select a, b, round(cosine, 6) cosine from cosines where a % 20 = 0")
def similarities(spark: P, sf: str) -> D:
    v = X.vectors(spark, sf)
    return G.similarities(v, v.where("item_id % 20 = 0")).withColumn("cosine", F.round("cosine", 6))


@query(f"with {_COS}, r as (select a, b, row_number() over (partition by a order by round(cosine, 9) desc, b) as rank from cosines) select a, b, rank from r where rank <= 5")
def nearest(spark: P, sf: str) -> D:
    return N.nearest(X.vectors(spark, sf), 5).select("a", "b", "rank")


@query()
def nearest_work(spark: P, sf: str) -> D:
    """Which part of all pairs the pruned search compares."""
    v = X.vectors(spark, sf)
    _, work = N.pivot_neighbours(v, 5)
    return work.agg(F.sum("compared").alias("compared"), F.count("*").alias("n")).select("n", "compared", F.round(F.col("compared") / (F.col("n") * (F.col("n") - 1)), 6).alias("share"))


@query(f"with {_COS}, v2 as (select item_id, vec[1:32] vec from v), c2 as (select a.item_id a, b.item_id b, list_cosine_similarity(a.vec, b.vec) cosine from v2 a join v2 b on a.item_id <> b.item_id), x as (select a, list(b) l from (select a, b, row_number() over (partition by a order by round(cosine, 9) desc, b) r from cosines) where r <= 10 group by 1), y as (select a, list(b) m from (select a, b, row_number() over (partition by a order by round(cosine, 9) desc, b) r from c2) where r <= 10 group by 1) select a, round(len(list_intersect(l, m)) / (20 - len(list_intersect(l, m)))::double, 6) overlap from x join y using (a)")
def neighbour_overlap(spark: P, sf: str) -> D:
    v = X.vectors(spark, sf).select("item_id", "vec")
    return G.neighbour_overlap(N.nearest(v, 10), N.nearest(R.truncated(v, [32]).select("item_id", "vec"), 10))


@query(
    "with recursive "
    + f"{X.EDGES}, {_CANON.partition('w as (select item_id, list_transform')[1]}{_CANON.partition('w as (select item_id, list_transform')[2]}, {_QUERIES}, x as (select query_id, items, unnest(items) a from q), s as (select query_id, b item_id, sum(round(weight, 9)::decimal(18, 9))::double score from x join both_ways using (a) where not list_contains(items, b) group by 1, 2),"
    " nr as (select a.item_id, list(b.item_id) near from c a join c b on a.canon = b.canon and a.item_id <> b.item_id group by 1), l as (select query_id, s.item_id, coalesce(near, []) near, row_number() over (partition by query_id order by score desc, s.item_id) as rank from s left join nr using (item_id)),"
    " g(query_id, rank, kept) as (select distinct query_id, 0::bigint, []::bigint[] from l union all select g.query_id, l.rank, case when len(kept) >= 5 or len(list_intersect(kept, near)) > 0 then kept else list_append(kept, l.item_id) end from g join l on l.query_id = g.query_id and l.rank = g.rank + 1 where l.rank <= 30),"
    " e as (select query_id, arg_max(kept, rank) kept from g group by 1) select query_id, unnest(kept) item_id, unnest(generate_series(1, len(kept))) as rank from e"
)
def suppress_near_duplicates(spark: P, sf: str) -> D:
    q = baskets_of(spark, sf).where("basket_id % 20 = 0").withColumnRenamed("basket_id", "query_id")
    s = G.basket_scores(q, edges_of(spark, sf))
    return G.suppress_near_duplicates(G.top_k(s, ["query_id"], "score", "item_id", 30), G.near_duplicate_names(X.items(spark, sf), FORMS), k=5, bound=30)


@query(f"with {X.SUBS}, r as (select *, row_number() over (partition by a order by votes desc, b) as rank from subs) select a, b, votes, rank from r where rank <= 3")
def substitutes(spark: P, sf: str) -> D:
    return G.substitutes(X.subs(spark, sf))


@query(f"with {X.EDGES}, m as (select p_name as name, substr(p_brand, 1, 7) grp, count(*) proximity from part group by 1, 2), mi as (select item_id, grp, proximity, row_number() over (partition by grp order by proximity desc, item_id) <= 8 as top from m join items using (name)) select e.src a, e.dst b, x.grp, x.top and y.top core from edges e join mi x on x.item_id = e.src join mi y on y.item_id = e.dst and y.grp = x.grp")
def shared_groups(spark: P, sf: str) -> D:
    m = table(spark, sf, "part").groupBy(F.col("p_name").alias("name"), F.substring("p_brand", 1, 7).alias("grp")).agg(F.count("*").alias("proximity")).join(X.items(spark, sf), "name")
    return G.shared_groups(edges_of(spark, sf).select(F.col("src").alias("a"), F.col("dst").alias("b")), m)


@query("with v as (select vec_id item_id, embedding::double[] vec from embeddings), l as (select item_id as label, vec pole from v where item_id < 6), b as (select item_id, arg_max(label, list_cosine_similarity(vec, pole)) as label from v, l group by 1), p as (select vec_id a, vec_id + 1 b from embeddings) select p.a, p.b, x.label from p join b x on x.item_id = p.a join b y on y.item_id = p.b and y.label = x.label")
def shared_direction(spark: P, sf: str) -> D:
    v = X.vectors(spark, sf).select("item_id", "vec")
    pairs = v.select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"))
    return G.shared_direction(pairs, v, v.where("item_id < 6").select(F.col("item_id").alias("label"), "vec"))


@query(f"with {_COS}, r as (select a, b, row_number() over (partition by a order by round(cosine, 9) desc, b) as rank from cosines), x as (select a, list(b) l from r where rank <= 10 group by 1) select p.a, p.b, round(len(list_intersect(x.l, y.l)) / (20 - len(list_intersect(x.l, y.l)))::double, 6) overlap from (select a, a + 1 b from x) p join x on x.a = p.a join x y on y.a = p.b")
def list_overlap(spark: P, sf: str) -> D:
    x = N.nearest(X.vectors(spark, sf), 10).groupBy("a").agg(F.collect_list("b").alias("l"))
    y = x.select(F.col("a").alias("b"), F.col("l").alias("m"))
    return x.withColumn("b", F.col("a") + 1).join(y, "b").select("a", "b", F.round(jaccard("l", "m"), 6).alias("overlap"))


# --- representations ------------------------------------------------------------------------------


def _norms(vectors: D) -> D:
    from ..functions.columns import norm

    return vectors.select("item_id", F.size("vec").alias("d"), F.round(norm("vec"), 4).alias("length"))


@query()
def linear_autoencoder(spark: P, sf: str) -> D:
    return R.linear_autoencoder(baskets_of(spark, sf)).select("a", "b", F.round("weight", 6).alias("weight"))


@query(f"with {X.SLOTS} select distinct item_id a, 0.0::double residual from slots")
def autoencoder_residual(spark: P, sf: str) -> D:
    """What the weights must satisfy: each column of the Gram matrix is the weights' sum of the others, off the diagonal. The largest difference of each row."""
    b = baskets_of(spark, sf)
    w = R.linear_autoencoder(b).select(F.col("a").alias("c"), "b", "weight")
    pairs, df = B.pair_counts(b).select(F.col("src").alias("a"), F.col("dst").alias("c"), F.col("count").alias("value")), B.frequencies(b)
    gram = pairs.unionByName(pairs.select(F.col("c").alias("a"), F.col("a").alias("c"), "value")).unionByName(df.select(F.col("item_id").alias("a"), F.col("item_id").alias("c"), (F.col("df") + 300).alias("value")))
    sums = gram.join(w, "c").groupBy("a", "b").agg(F.sum(F.col("value") * F.col("weight")).alias("x"))
    rows = sums.join(gram.select("a", F.col("c").alias("b"), "value"), ["a", "b"], "full").where("a <> b")
    return rows.groupBy("a").agg(F.round(F.max(F.abs(F.coalesce("value", F.lit(0)) - F.coalesce("x", F.lit(0.0)))), 4).alias("residual"))


@query()
def autoencoder_vectors(spark: P, sf: str) -> D:
    return _norms(R.symmetric_vectors(R.linear_autoencoder(baskets_of(spark, sf)), 8)[0])


@query()
def als_vectors(spark: P, sf: str) -> D:
    return _norms(R.als_vectors(baskets_of(spark, sf), rank=8, iterations=3))


@query()
def item_word_vectors(spark: P, sf: str) -> D:
    return _norms(R.item_word_vectors(baskets_of(spark, sf), size=8, thin=0.02))


@query(f"with {X.SLOTS}, d as (select item_id, count(*) df from slots group by 1), t as (select sum(df)::double total from d) select item_id, round(least(1.0, (sqrt(df / total / 1e-3) + 1) * 1e-3 / (df / total)), 6) keep from d, t")
def keep_probability(spark: P, sf: str) -> D:
    return R.keep_probability(B.frequencies(baskets_of(spark, sf))).withColumn("keep", F.round("keep", 6))


_PPMI = (
    f"with {X.SLOTS}, {X.PAIRS}, s as (select src a, dst b, cnt from pairs union all select dst, src, cnt from pairs), ra as (select a, sum(cnt)::double na from s group by 1), cb as (select b, pow(sum(cnt), 0.75) nb from s group by 1), t as (select sum(cnt)::double n from s), z as (select sum(nb) z from cb), x as (select s.a, s.b, ln((cnt / n) / ((na / n) * (nb / z))) v from s join ra using (a) join cb using (b), t, z)"
)


@query(_PPMI + " select a, b, round(v, 6) as value from x where v > 0")
def ppmi(spark: P, sf: str) -> D:
    return R.ppmi(B.pair_counts(baskets_of(spark, sf)), smooth=0.75).withColumn("value", F.round("value", 6))


@query(_PPMI + ", y as (select a, sqrt(sum(v * v)) n, count(*) over () r from x where v > 0 group by a) select a, round(n, 5) norm from y")
def svd_rows(spark: P, sf: str) -> D:
    """With all singular vectors, a row of U s is as long as the row of the matrix."""
    cells = R.ppmi(B.pair_counts(baskets_of(spark, sf)), smooth=0.75)
    left, s = singular_vectors(cells, 80)
    scaled = F.zip_with("vec", F.array(*[F.lit(float(x)) for x in s]), lambda u, v: u * v)
    return left.select("a", F.round(norm(scaled), 5).alias("norm"))


@query(_PPMI + ", e as (select sum(v * v) e from x where v > 0) select round(e, 4) energy from e")
def svd_energy(spark: P, sf: str) -> D:
    """The squares of all singular values are those of the cells."""
    cells = R.ppmi(B.pair_counts(baskets_of(spark, sf)), smooth=0.75)
    left, s = singular_vectors(cells, 80)
    lengths = left.agg(*[F.sum(F.col("vec")[i] * F.col("vec")[i]).alias(f"u{i}") for i in range(len(s))])  # ones
    return lengths.select(F.round(sum((F.col(f"u{i}") * float(x * x) for i, x in enumerate(s)), F.lit(0.0)), 4).alias("energy"))


@query()
def svd_vectors(spark: P, sf: str) -> D:
    return _norms(R.svd_vectors(R.ppmi(B.pair_counts(baskets_of(spark, sf))), 8))


@query("with v as (select vec_id item_id, embedding from embeddings) select item_id, r as \"rank\", round(list_sum(list_transform(embedding[1:r], lambda x: x::double)), 5) s from v, (values (4), (16)) t(r)")
def truncated(spark: P, sf: str) -> D:
    return R.truncated(X.vectors(spark, sf), [4, 16]).select("item_id", "rank", F.round(F.aggregate("vec", F.lit(0.0), lambda t, x: t + x), 5).alias("s"))


@query(
    f"with {X.EDGES}, v as (select vec_id item_id, embedding::double[] vec from embeddings semi join items on item_id = vec_id), e as (select src a, dst b from edges where npmi >= 0.0 union all select dst, src from edges where npmi >= 0.0 union all select item_id, item_id from v), d as (select a, count(*) d from e group by 1), w as (select e.a, e.b, 1 / sqrt(x.d * y.d) w from e join d x on x.a = e.a join d y on y.a = e.b),"
    " l0 as (select item_id, unnest(vec) x, unnest(generate_series(1, 64)) i from v), l1 as (select b item_id, i, sum(w * x) x from w join l0 on l0.item_id = w.a group by 1, 2), l2 as (select b item_id, i, sum(w * x) x from w join l1 on l1.item_id = w.a group by 1, 2) select item_id, round(sum(x * x), 5) sq from l2 group by 1"
)
def propagate(spark: P, sf: str) -> D:
    v = R.propagate(edges_of(spark, sf, threshold=0.0), _vocab_vectors(spark, sf))
    return v.select("item_id", F.round(F.aggregate("vec", F.lit(0.0), lambda t, x: t + x * x), 5).alias("sq"))


def _walks(spark: P, sf: str) -> D:
    return R.random_walks(G.both_ways(edges_of(spark, sf), shift=True), per_item=3, length=6, seed=2)


@query(
    "with recursive "
    + f"{X.EDGES}, l as (select min(npmi) least from edges), w as (select a, b, weight - least + 1e-3 weight from both_ways, l), line as (select a, b, (sum(weight) over (partition by a order by b) - weight) / sum(weight) over (partition by a) lo, sum(weight) over (partition by a order by b) / sum(weight) over (partition by a) hi from w),"
    " s as (select a, n, a || '-' || n walk_id from (select distinct a from line), (values (1), (2), (3)) t(n)),"
    f" r as (select walk_id, a as pos, 1 as step, a::varchar walk from s union all select walk_id, b, step + 1, walk || ',' || b from r join line on line.a = r.pos and {X.draw_sql('walk_id', 0).replace(chr(58) + '0', chr(58) + chr(39) + ' || (2000 + step)::varchar || ' + chr(39))} >= lo and {X.draw_sql('walk_id', 0).replace(chr(58) + '0', chr(58) + chr(39) + ' || (2000 + step)::varchar || ' + chr(39))} < hi where step < 6) select walk_id, walk from r where step = 6"
)
def random_walks(spark: P, sf: str) -> D:
    return _walks(spark, sf).select("walk_id", F.array_join("walk", ",").alias("walk"))


@query(f"with {X.ATTR}, z as (select attr_id, count(*) n from item_attr join nation on n_nationkey = attr_id where n_regionkey = 2 group by 1) select x.item_id a, y.item_id b, round(sum(1.0::double / n), 6) weight from item_attr x join item_attr y using (attr_id) join z using (attr_id) where x.item_id <> y.item_id group by 1, 2")
def typed_edges(spark: P, sf: str) -> D:
    regions = table(spark, sf, "region").where("r_regionkey = 2").select(F.col("r_name").alias("class"))
    a = X.attrs(spark, sf).join(regions, "class")
    return R.typed_edges(X.item_attr(spark, sf), a).withColumn("weight", F.round("weight", 6))


@query()
def walk_vectors(spark: P, sf: str) -> D:
    return _norms(R.walk_vectors(_walks(spark, sf), size=8))


@query()
def concatenated(spark: P, sf: str) -> D:
    v = _vocab_vectors(spark, sf)
    return _norms(R.concatenated([(v, 1.0), (R.propagate(edges_of(spark, sf), v, 1), 0.5)], d=6))


@query()
def with_residual(spark: P, sf: str) -> D:
    v = _vocab_vectors(spark, sf)
    return _norms(R.with_residual(R.truncated(v, [8]).select("item_id", "vec"), R.propagate(edges_of(spark, sf), v, 1)))


@query()
def ridge_map(spark: P, sf: str) -> D:
    v = _vocab_vectors(spark, sf)
    x, y = R.truncated(v, [8]).select("item_id", "vec"), R.propagate(edges_of(spark, sf), v, 1)
    return R.map_quality(R.mapped(x, R.ridge_map(x, y)), y)


@query()
def centred(spark: P, sf: str) -> D:
    return _norms(R.centred(X.vectors(spark, sf).select("item_id", "vec"), remove=2))


_STEERED = """v as (select vec_id item_id, embedding::double[] vec from embeddings), nv as (select item_id, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) u from v), pole as (select u p from nv where item_id = 1),
q as (select item_id query_id, u, p, list_dot_product(u, p) c from nv, pole where item_id % 20 = 0), q2 as (select query_id, u, list_transform(list_zip(p, u), lambda z: z[1] - z[2] * c) w from q), q3 as (select query_id, u, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) o from q2),
t as (select query_id, angle, list_transform(list_zip(u, o), lambda z: z[1] * cos(radians(angle)) + z[2] * sin(radians(angle))) t from q3, (values (0.0::double), (30.0), (60.0)) a(angle)), f as (select query_id, angle, nv.item_id, round(list_cosine_similarity(t, nv.u), 9) cosine from t, nv where nv.item_id <> query_id),
r as (select *, row_number() over (partition by query_id, angle order by cosine desc, item_id) as rank from f)"""


@query(f"with {_STEERED} select query_id, angle, item_id, cosine, rank from r where rank <= 5")
def steered(spark: P, sf: str) -> D:
    v = X.vectors(spark, sf).select("item_id", "vec")
    pole = v.where("item_id = 1").select(F.col("vec").alias("pole"))
    q = v.where("item_id % 20 = 0").crossJoin(F.broadcast(pole)).select(F.col("item_id").alias("query_id"), "vec", "pole")  # one row
    return R.steered(q, v, [0.0, 30.0, 60.0])


@query(f"with {_STEERED}, w as (select query_id, angle, item_id + (rank = 3)::int item_id, rank want from r where rank <= 3), b as (select w.*, r.rank from w left join r on r.query_id = w.query_id and r.angle = w.angle and r.item_id = w.item_id and r.rank <= 5) select angle, count(*) n, round(avg((coalesce(rank, -1) = want)::int), 6) exact, round(count(rank) / count(*)::double, 6) overlap from b group by 1")
def table_agreement(spark: P, sf: str) -> D:
    found = steered(spark, sf)
    return R.table_agreement(found, found.where("rank <= 3").select("query_id", "angle", (F.col("item_id") + F.when(F.col("rank") == 3, 1).otherwise(0)).alias("item_id"), "rank"))


@query(f"with {X.ITEMS}, v as (select vec_id item_id, embedding::double[] vec from embeddings semi join items on item_id = vec_id) select count(*) pairs, round(avg(abs(list_cosine_similarity(a.vec, b.vec))), 6) mean_abs_cosine from v a join v b on a.item_id < b.item_id")
def collinearity(spark: P, sf: str) -> D:
    return R.collinearity(_vocab_vectors(spark, sf))


@query(
    "with v as (select vec_id item_id, label::varchar grp, list_transform(embedding::double[], lambda x: x / sqrt(list_sum(list_transform(embedding::double[], lambda y: y * y)))) vec from embeddings),"
    " x as (select grp, unnest(vec) x, unnest(generate_series(1, 64)) i from v), s as (select grp, i, sum(x) x from x group by 1, 2), l as (select grp, sum(x * x) sq from s group by 1), n as (select grp, count(*) n from v group by 1) select grp, n, round((sq - n) / (n * (n - 1)), 6) pairwise, round(sqrt(sq) / n, 6) to_centroid from l join n using (grp)"
)
def coherence(spark: P, sf: str) -> D:
    v = X.vectors(spark, sf)
    return R.coherence(v.select(F.col("label").alias("grp"), "item_id"), v.select("item_id", "vec")).where(~F.col("grp").startswith("control"))


@query("with c as (select (vec_id % 7) cl, label, count(*)::double c from embeddings group by 1, 2), n as (select sum(c) n from c), a as (select label, sum(c) na from c group by 1), b as (select cl, sum(c) nb from c group by 1), mi as (select sum(c / n * ln(c * n / (na * nb))) mi from c join a using (label) join b using (cl), n), ha as (select -sum(na / n * ln(na / n)) h from a, n), hb as (select -sum(nb / n * ln(nb / n)) h from b, n) select round(mi / ((ha.h + hb.h) / 2), 6) nmi from mi, ha, hb")
def nmi(spark: P, sf: str) -> D:
    return R.nmi(X.vectors(spark, sf).select("label", (F.col("item_id") % 7).alias("cluster")))


@query()
def cluster_nmi(spark: P, sf: str) -> D:
    v = X.vectors(spark, sf)
    reduced = R.principal_parts(v.select("item_id", "vec"), 4)
    return R.cluster_nmi(reduced, v.select("item_id", "label"), k=4)


@query("with v as (select vec_id item_id, embedding::double[] vec from embeddings), x as (select item_id, unnest(vec) x, unnest(generate_series(1, 64)) i from v), c as (select a.i, b.i j, covar_samp(a.x, b.x) c from x a join x b using (item_id) group by 1, 2) select (select count(*) from v) n, round(pow(sum(c) filter (i = j), 2) / sum(c * c), 6) participation from c")
def participation_ratio(spark: P, sf: str) -> D:
    return R.participation_ratio(X.vectors(spark, sf))


@query(
    f"with {X.SLOTS}, {X.DF}, v as (select vec_id item_id, embedding::double[] vec from embeddings semi join items on item_id = vec_id), u as (select item_id, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) un from v),"
    " c as (select list(s order by i) centre from (select i, avg(un[i]) s from u, (select unnest(range(1, 65)) i) group by 1)), a as (select item_id from u, c order by round(list_dot_product(un, centre), 9) desc, item_id limit 20), b as (select item_id from df order by df desc, item_id limit 20)"
    " select count(*) common, round(count(*) / (40 - count(*))::double, 6) jaccard from a semi join b using (item_id)"
)
def popularity_overlap(spark: P, sf: str) -> D:
    return R.popularity_overlap(_vocab_vectors(spark, sf), B.frequencies(baskets_of(spark, sf)))


@query()
def popularity_alignment(spark: P, sf: str) -> D:
    return R.popularity_alignment(_vocab_vectors(spark, sf), B.frequencies(baskets_of(spark, sf)))


@query(f"with {X.ITEMS}, v as (select name, embedding::double[] vec from embeddings join items on item_id = vec_id) select item_id, name, round(list_sum(list_transform(embedding, lambda x: x::double)), 5) s from embeddings join items on item_id = vec_id")
def aligned_vectors(spark: P, sf: str) -> D:
    v = X.items(spark, sf)
    named = X.vectors(spark, sf).join(v, "item_id").select("name", "vec")
    return R.align_vectors(named, v.select("item_id", "name")).select("item_id", "name", F.round(F.aggregate("vec", F.lit(0.0), lambda t, x: t + x), 5).alias("s"))


@query(f"with {X.EDGES}, p as (select p_partkey a, (p_partkey * 7 + 3) % 64 b from part where p_partkey % 64 = p_partkey union all select 64 + (select count(*) from items) a, 1) select a, b, cnt as \"count\", round(npmi, 6) npmi from p left join edges on src = least(a, b) and dst = greatest(a, b)")
def pair_evidence(spark: P, sf: str) -> D:
    v = X.items(spark, sf)
    n = v.agg((F.count("*") + 64).alias("a")).select("a", F.lit(1).cast("long").alias("b"))  # an item that isn't there
    pairs = table(spark, sf, "part").where("p_partkey % 64 = p_partkey").select(F.col("p_partkey").alias("a"), ((F.col("p_partkey") * 7 + 3) % 64).alias("b")).unionByName(n)
    return G.pair_evidence(pairs, edges_of(spark, sf)).withColumn("npmi", F.round("npmi", 6))


@query(f"with {X.ITEMS}, e as (select p_name, p_size::bigint attr_id from part union all select p_name, 1000 + try_cast(split_part(p_brand, '#', 2) as bigint) from part) select distinct item_id, attr_id from e join items on name = p_name where attr_id is not null")
def entity_attributes(spark: P, sf: str) -> D:
    """Parts as described entities: their names with a kind word, their sizes and brands as attributes."""
    from ..operators import normalise as N

    attrs = F.array_compact(F.array(F.col("p_size").cast("long"), 1000 + F.substring_index("p_brand", "#", -1).try_cast("long")))
    e = table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), N.entity_aliases(F.concat("p_name", F.lit(" Oil (raw)"))).alias("forms"), attrs.alias("attrs"))
    alias, _ = N.alias_table(X.items(spark, sf))
    return G.entity_attributes(e, alias)
