"""Queries of splits, metrics, uncertainty and pairing statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import cosine, draw
from ..operators import baskets as B, evaluate as E, graph as G, neighbours as N, represent as R, stats as T
from ..session import saved, table
from . import bindings as X
from .graph_queries import _CANON, FORMS, baskets_of, edges_of
from .registering import collector

QUERIES, ORACLE_SQL, query = collector()
D = DataFrame
P = SparkSession


@query(f"with {X.SLOTS}, b as (select distinct basket_id from slots) select basket_id, case when {X.draw_sql('basket_id', 1)} < 0.3 then 'held' else 'train' end split from b")
def hold_out_baskets(spark: P, sf: str) -> D:
    return E.hold_out_baskets(baskets_of(spark, sf), seed=1).select("basket_id", "split")


@query(
    "with s as (select distinct l_orderkey o, l_partkey i from lineitem), t as (select * from s where "
    + X.draw_sql("o", 0)
    + " >= 0.3), f as (select a.i src, b.i dst, count(*) c from s a join s b on a.o = b.o and a.i < b.i group by 1, 2 having count(*) >= 2), g as (select a.i src, b.i dst, count(*) c from t a join t b on a.o = b.o and a.i < b.i group by 1, 2 having count(*) >= 2) select src, dst, f.c as \"count\" from f anti join g using (src, dst)"
)
def held_out_edges(spark: P, sf: str) -> D:
    return E.held_out_edges(X.part_baskets(spark, sf), threshold=None).select("src", "dst", "count")


@query(f"with {X.EDGES} select src, dst, case when {X.draw_sql('src || chr(45) || dst', 0)} < 0.1 then 'held' else 'train' end split from edges")
def hold_out_edges(spark: P, sf: str) -> D:
    return E.hold_out_edges(edges_of(spark, sf)).select("src", "dst", "split")


@query(f"with {X.SLOTS}, b as (select distinct basket_id from slots) select basket_id from b where {X.draw_sql('basket_id', 0)} < 0.3 order by {X.draw_sql('basket_id', 5)}, basket_id limit 100")
def held_sample(spark: P, sf: str) -> D:
    b = E.hold_out_baskets(baskets_of(spark, sf))
    return E.held_sample(b, b.where("split = 'train'"), 100, seed=5).select("basket_id")


@query("select count(*) filter (o_orderkey % 11 = 0) in_none, count(*) filter (o_orderkey % 11 <> 0 and o_orderkey % 2 = 0 and o_orderkey % 3 = 0) in_several, count(*) n from orders where o_orderkey % 11 = 0 or o_orderkey % 2 = 0 or o_orderkey % 3 = 0")
def partition_check(spark: P, sf: str) -> D:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("basket_id")).where("basket_id % 11 = 0 or basket_id % 2 = 0 or basket_id % 3 = 0")
    left = o.where("basket_id % 11 <> 0")
    return E.partition_check(o, [left.where("basket_id % 2 = 0"), left.where("basket_id % 3 = 0")])


_INST = f"bl as (select basket_id, list(item_id order by item_id) items from slots group by 1), inst as (select basket_id, items[1 + floor({X.draw_sql('basket_id', 0)} * len(items))::int] target, items from bl where len(items) >= 3), ctx as (select basket_id, target, list_filter(items, lambda x: x <> target) context from inst)"


@query(f"with {X.SLOTS}, {_INST} select basket_id, target, array_to_string(context, ',') context from ctx")
def completion_instances(spark: P, sf: str) -> D:
    return E.completion_instances(baskets_of(spark, sf)).select("basket_id", "target", F.array_join("context", ",").alias("context"))


_RANKS = (
    f"{X.EDGES}, {_INST}, few as (select * from ctx where basket_id % 20 = 0), sc as (select basket_id, b item_id, round(sum(weight), 9) score from (select basket_id, context, unnest(context) a from few) x join both_ways using (a) where not list_contains(context, b) group by 1, 2),"
    " own as (select few.basket_id, target, len(context) k, score own from few left join sc on sc.basket_id = few.basket_id and sc.item_id = target),"
    " mid as (select own.basket_id, target, case when own is not null then count(*) filter (score > own) + 1 + (count(*) filter (score = own) - 1) / 2.0 else count(score) + 1 + ((select count(*) from items) - k - count(score) - 1) / 2.0 end::double as rank, (select count(*) from items) - k as pool from own left join sc using (basket_id) group by own.basket_id, target, own, k)"
)


def _ranks(spark: P, sf: str) -> D:
    inst = E.completion_instances(baskets_of(spark, sf)).where("basket_id % 20 = 0")
    scores = E.graph_scores(inst, edges_of(spark, sf))
    return E.midranks(inst, scores, X.items(spark, sf))


@query(f"with {_RANKS} select * from mid")
def midranks(spark: P, sf: str) -> D:
    return _ranks(spark, sf)


@query(f"with {_RANKS} select count(*) n, round(avg((rank <= 10)::int), 6) recall_10, round(avg((rank <= 50)::int), 6) recall_50, round(avg(1 / rank), 6) mrr, round(quantile_cont(rank, 0.5), 6) median_rank from mid")
def completion_metrics(spark: P, sf: str) -> D:
    return E.completion_metrics(_ranks(spark, sf))


@query(f"with {_RANKS} select o_orderpriority as source, count(*) n, round(avg((rank <= 10)::int), 6) recall_10, round(avg((rank <= 50)::int), 6) recall_50, round(avg(1 / rank), 6) mrr, round(quantile_cont(rank, 0.5), 6) median_rank from mid join orders on o_orderkey = basket_id group by 1")
def grouped_metrics(spark: P, sf: str) -> D:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("basket_id"), F.col("o_orderpriority").alias("source"))
    return E.completion_metrics(_ranks(spark, sf).join(o, "basket_id"), ["source"])


@query(f"with {_RANKS}, p as (select target, avg((rank <= 10)::int) r from mid group by 1) select count(*) targets, round(avg(r), 6) macro_recall from p")
def macro_recall(spark: P, sf: str) -> D:
    return E.macro_recall(_ranks(spark, sf))


_POP = f"{X.SLOTS}, {_INST}, {X.DF}, few as (select * from ctx where basket_id % 20 = 0), pop as (select basket_id, item_id, df::double score from few, df where not list_contains(context, item_id))"


@query(f"with {_POP}, r as (select *, rank() over (partition by basket_id order by score desc) as rank from pop) select r.basket_id, item_id, score, rank from r join few on few.basket_id = r.basket_id and target = item_id")
def popularity_ranks(spark: P, sf: str) -> D:
    b = baskets_of(spark, sf)
    inst = E.completion_instances(b).where("basket_id % 20 = 0")
    return E.popularity_ranks(inst, B.frequencies(b))


@query(
    f"with {_RANKS.replace('bl as', X.DF.replace('df as', 'df2 as') + ', bl as')}, pop as (select basket_id, item_id, df::double score from few, df2 where not list_contains(context, item_id)), both_s as (select 'graph' scorer, * from sc union all select 'popularity', * from pop), rk as (select *, rank() over (partition by scorer, basket_id order by score desc) as rank from both_s),"
    " st as (select item_id from df2 order by df desc, item_id desc limit 20), j as (select s.scorer, few.basket_id, target, coalesce(rank, 1000000) <= 10 hit, target in (select item_id from st) staple from few cross join (select distinct scorer from both_s) s left join rk on rk.scorer = s.scorer and rk.basket_id = few.basket_id and rk.item_id = target),"
    " lf as (select scorer, round(avg(ln(df)), 6) mean_log_frequency from rk join df2 using (item_id) where rank <= 10 group by 1) select scorer, round(avg(hit::int), 6) recall_10, round(avg(hit::int) filter (not staple), 6) recall_10_non_staple, mean_log_frequency from j join lf using (scorer) group by scorer, mean_log_frequency"
)
def backtest(spark: P, sf: str) -> D:
    b = baskets_of(spark, sf)
    inst = E.completion_instances(b).where("basket_id % 20 = 0")
    df = B.frequencies(b)
    s = E.graph_scores(inst, edges_of(spark, sf)).withColumn("scorer", F.lit("graph")).unionByName(E.popularity_scores(inst, df).withColumn("scorer", F.lit("popularity")))
    return E.backtest(s, inst, df, staples=20)


@query(f"with {X.EDGES}, {_INST}, e as (select * from both_ways where weight >= 0.05), x as (select distinct basket_id from (select basket_id, target, unnest(context) a from ctx) c join e on e.a = c.a and e.b = c.target) select basket_id, target from ctx where basket_id not in (select basket_id from x)")
def silent_instances(spark: P, sf: str) -> D:
    return E.silent_instances(E.completion_instances(baskets_of(spark, sf)), edges_of(spark, sf, threshold=0.05)).select("basket_id", "target")


def _vocab(spark: P, sf: str) -> D:
    return X.vectors(spark, sf).join(X.items(spark, sf), "item_id", "left_semi").select("item_id", "vec")


_V64 = "v as (select vec_id item_id, embedding::double[] vec from embeddings semi join items on item_id = vec_id)"


@query(
    f"with {X.EDGES}, {_V64}, t as (select src, dst, (1 + floor({X.draw_sql('src || chr(45) || dst', 0)} * (select count(*) from v)))::int - 1 other from edges), c as (select round(list_cosine_similarity(a.vec, b.vec), 9) near, round(list_cosine_similarity(a.vec, o.vec), 9) far from t join v a on a.item_id = src join v b on b.item_id = dst join v o on o.item_id = other where other <> src and other <> dst), w as (select case when near > far then 1.0 when near = far then 0.5 else 0.0 end::double w from c)"
    " select count(*) n, round(avg(w), 6) accuracy, round(1.96 * stddev_samp(w) / sqrt(count(*)), 6) half_width from w"
)
def triplet_accuracy(spark: P, sf: str) -> D:
    return E.triplet_accuracy(edges_of(spark, sf), _vocab(spark, sf))


@query()
def noise_control(spark: P, sf: str) -> D:
    v = _vocab(spark, sf)
    e = edges_of(spark, sf)
    out = E.triplet_accuracy(e, R.noise_vectors(v)).withColumn("arm", F.lit("gaussian"))
    for arm, n in (("one line", R.noise_vectors(v, rank_one=True)), ("shuffled", R.shuffled_rows(v))):
        out = out.unionByName(E.triplet_accuracy(e, n).withColumn("arm", F.lit(arm)))
    return out


@query(f"with v as (select vec_id item_id, embedding::double[] vec from embeddings), c as (select a.item_id a, b.item_id b, row_number() over (partition by a.item_id order by round(list_cosine_similarity(a.vec, b.vec), 9) desc, b.item_id) as rank from v a join v b on a.item_id <> b.item_id), {X.SUBS}, s as (select a, b from subs), n as (select a, count(*) n from s group by 1 having count(*) >= 2), h as (select s.a, n, count(c.b) hits from s join n using (a) left join c on c.a = s.a and c.b = s.b and rank <= 10 group by 1, 2) select count(*) anchors, round(avg(hits / least(n, 10)::double), 6) recall from h")
def substitution_recall(spark: P, sf: str) -> D:
    s = X.subs(spark, sf)
    return E.substitution_recall(N.nearest(X.vectors(spark, sf), 10), s, least=2)


_MATCHED = f"""{X.EDGES}, e as (select src, dst from edges where npmi >= 0.02), bw as (select src a, dst b from e union select dst, src from e), dg as (select item_id, count(b) degree from items left join bw on a = item_id group by 1), rk as (select item_id, row_number() over (order by degree, item_id) r, greatest(floor((select count(*) from dg) * 0.1), 1) w from dg),
c as (select e.src, e.dst, y.item_id other from e join rk x on x.item_id = e.dst join rk y on abs(x.r - y.r) <= x.w and y.item_id <> e.src and y.item_id <> e.dst and floor(y.r / y.w) between floor(x.r / x.w) - 1 and floor(x.r / x.w) + 1 where not exists (select 1 from bw where bw.a = e.src and bw.b = y.item_id)),
tr as (select e.src, e.dst, j, greatest(x.r - x.w, 1) + floor({X.draw_sql("e.src || '-' || e.dst || '-' || j", 5)} * (least(x.r + x.w, (select count(*) from dg)) - greatest(x.r - x.w, 1) + 1)) r from e join rk x on x.item_id = e.dst, (select unnest(range(1, 17)) j)),
dr as (select src, dst, arg_min(item_id, j) other from tr join rk using (r) where item_id <> src and item_id <> dst and not exists (select 1 from bw where bw.a = src and bw.b = item_id) group by 1, 2),
m as (select * from dr union all select src, dst, arg_min(other, md5(src || '-' || dst || '-' || other)) other from c where (src, dst) not in (select (src, dst) from dr) group by 1, 2)"""


@query(f"with {_MATCHED} select * from m")
def degree_matched(spark: P, sf: str) -> D:
    e = edges_of(spark, sf, threshold=0.02)
    return E.degree_matched(e, B.degrees(e, X.items(spark, sf)))


@query(f"with {_MATCHED}, {_V64}, s as (select 1 as label, src a, dst b from m union all select 0, src, other from m), cs as (select label, round(list_cosine_similarity(x.vec, y.vec), 9) score from s join v x on x.item_id = a join v y on y.item_id = b), p as (select * from cs where label = 1), q as (select * from cs where label = 0) select (select count(*) from p)::bigint n_pos, (select count(*) from q)::bigint n_neg, round(avg(case when p.score > q.score then 1.0 when p.score = q.score then 0.5 else 0.0 end), 6) auc from p, q")
def link_auc(spark: P, sf: str) -> D:
    e = edges_of(spark, sf, threshold=0.02)
    m = E.degree_matched(e, B.degrees(e, X.items(spark, sf)))
    v = _vocab(spark, sf)
    rows = m.select(F.lit(1).alias("label"), F.col("src").alias("a"), F.col("dst").alias("b")).unionAll(m.select(F.lit(0), "src", "other"))
    rows = rows.join(v.select(F.col("item_id").alias("a"), F.col("vec").alias("u")), "a").join(v.select(F.col("item_id").alias("b"), "vec"), "b")
    return E.auc(rows.select("label", F.round(cosine("u", "vec"), 9).alias("score")))


@query("with r as (select o_orderpriority grp, (o_orderstatus = 'F')::int as label, o_totalprice score from orders), p as (select grp, score, sum(label) p, sum(1 - label) n from r group by 1, 2), w as (select *, coalesce(sum(n) over (partition by grp order by score rows between unbounded preceding and 1 preceding), 0) below from p) select grp, sum(p)::bigint n_pos, sum(n)::bigint n_neg, round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) auc from w group by 1")
def grouped_auc(spark: P, sf: str) -> D:
    r = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("grp"), (F.col("o_orderstatus") == "F").cast("int").alias("label"), F.col("o_totalprice").alias("score"))
    return E.auc(r, ["grp"])


@query("with r as (select l_quantity x, l_extendedprice y from lineitem), a as (select *, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 ry from r) select count(*) n, round(corr(rx, ry), 6) rho from a")
def spearman(spark: P, sf: str) -> D:
    return E.spearman(table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")), "x", "y")


@query("with r as (select (o_orderstatus = 'F')::int as label, o_totalprice / 500000 p, (o_orderkey % 97) / 97.0::double q from orders), g as (select w::double weight, label, round(w::double * p + (1 - w::double) * q, 9) score from r, (values (0.0), (0.5), (1.0)) t(w)), a as (select weight, label, rank() over (partition by weight order by score) + (count(*) over (partition by weight, score) - 1) / 2.0 rk from g) select weight, sum(label)::bigint n_pos, sum(1 - label)::bigint n_neg, round((sum(rk * label) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)), 6) auc from a group by 1")
def blend_sweep(spark: P, sf: str) -> D:
    r = table(spark, sf, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("label"), (F.col("o_totalprice") / 500000).alias("p"), ((F.col("o_orderkey") % 97) / 97.0).alias("q"))
    return E.blend_sweep(r, [0.0, 0.5, 1.0])


def _hits(spark: P, sf: str) -> D:
    o = table(spark, sf, "orders")
    m = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), (draw("o_orderkey", s) < p).cast("double").alias("hit")) for n, s, p in (("a", 1, 0.5), ("b", 2, 0.55), ("popularity", 3, 0.45))]))
    return o.select(F.col("o_orderkey").alias("instance_id"), m.alias("m")).select("instance_id", "m.*")


def _hits_sql() -> str:
    part = " union all ".join(f"select o_orderkey id, '{n}' model, ({X.draw_sql('o_orderkey', s)} < {p})::int::double hit from orders" for n, s, p in (("a", 1, 0.5), ("b", 2, 0.55), ("popularity", 3, 0.45)))
    steps = []
    mass, term = 0.0, 1.0 / 2.718281828459045
    for k in range(8):
        mass += term
        steps.append(f"(u >= {mass!r}::double)::int")
        term /= k + 1
    parts = ", ".join(f"('0x' || substr(md5(id::varchar || ':0'), {1 + 8 * i}, 8))::bigint % {E.PRIME} {c}" for i, c in enumerate("abc"))
    return f"h as ({part}), hs as (select *, {parts} from h), r as (select model, hit, rep, ((a * rep * rep % {E.PRIME} + b * rep + c) % {E.PRIME}) / {E.PRIME}::double u from hs, (select unnest(generate_series(1, 50)) rep)), k as (select model, rep, hit, {' + '.join(steps)} k from r), m as (select model, rep, sum(k * hit) / sum(k) m from k where k > 0 group by 1, 2)"


@query(f"with {_hits_sql()}, pt as (select model, round(avg(hit), 6) mean from h group by 1), q as (select model, quantile_cont(m, [0.025, 0.975]) q from m group by 1), d as (select m.model, m.m - b.m d from m join m b on b.model = 'popularity' and b.rep = m.rep), dq as (select model, quantile_cont(d, [0.025, 0.975]) q, least(greatest(2 * least(avg((d <= 0)::int), avg((d >= 0)::int)), 2 / 50.0::double), 1) p from d group by 1) select model, mean, round(q.q[1], 6) low, round(q.q[2], 6) high, round(dq.q[1], 6) diff_low, round(dq.q[2], 6) diff_high, round(p, 6) p from pt join q using (model) join dq using (model)")
def bootstrap(spark: P, sf: str) -> D:
    return E.bootstrap(_hits(spark, sf), replicates=50, baseline="popularity")


@query(f"with {_hits_sql()}, d as (select m.rep, count(*) filter (m.m < b.m) below from m join m b on b.model = 'popularity' and b.rep = m.rep where m.model <> 'popularity' group by 1), q as (select quantile_cont(below, [0.025, 0.5, 0.975]) q from d) select q[1]::double low, q[2]::double median, q[3]::double high from q")
def below_baseline(spark: P, sf: str) -> D:
    return E.below_baseline(_hits(spark, sf), "popularity", replicates=50)


@query(f"with {_hits_sql()}, pt as (select model, round(avg(hit), 6) mean from h where model in ('a', 'b') group by 1), q as (select model, quantile_cont(m, [0.025, 0.975]) q from m group by 1), d as (select m.model, m.m - b.m d from m join m b on b.model = 'a' and b.rep = m.rep where m.model = 'b'), dq as (select model, quantile_cont(d, [0.025, 0.975]) q, least(greatest(2 * least(avg((d <= 0)::int), avg((d >= 0)::int)), 2 / 50.0::double), 1) p from d group by 1) select model, mean, round(q.q[1], 6) low, round(q.q[2], 6) high, round(dq.q[1], 6) diff_low, round(dq.q[2], 6) diff_high, round(p, 6) p, round(dq.q[1], 6) > 0 promote from pt join q using (model) join dq using (model)")
def promotes(spark: P, sf: str) -> D:
    return E.promotes(_hits(spark, sf), "b", "a", replicates=50)


def _runs(spark: P, sf: str) -> D:
    """Market segments as models, priorities as seeds, mean prices as values."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("o_orderpriority").alias("seed"), F.col("c_mktsegment").alias("model")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))


_RUNS = "runs as (select o_orderpriority seed, c_mktsegment model, round(avg(o_totalprice), 4) as value from orders join customer on o_custkey = c_custkey group by 1, 2)"


@query(f"with {_RUNS}, r as (select *, row_number() over (partition by seed order by value desc, model) rk from runs), s as (select runs.model, count(*) filter (runs.value < b.value) seeds_below from runs join runs b on b.seed = runs.seed and b.model = 'BUILDING' group by 1) select model, min(rk) best, max(rk) worst, round(avg(rk), 6) mean_rank, round(stddev_samp(value), 6) spread, min(rk) = max(rk) invariant, max(seeds_below) seeds_below from r join s using (model) group by 1")
def rank_stability(spark: P, sf: str) -> D:
    return E.rank_stability(_runs(spark, sf), "BUILDING")


@query(f"with {_RUNS}, l as (select model, max(case when seed = '1-URGENT' then value end) native, max(case when seed = '5-LOW' then value end) raw from runs group by 1), b as (select *, greatest(native, raw) best from l) select model, best, round(best / (select best from b where model = 'BUILDING'), 6) lift from b")
def leaderboard(spark: P, sf: str) -> D:
    pick = lambda s: F.max(F.when(F.col("seed") == s, F.col("value")))
    return E.leaderboard(_runs(spark, sf).groupBy("model").agg(pick("1-URGENT").alias("native"), pick("5-LOW").alias("raw")), "BUILDING")


@query(f"with {_RUNS} select count(*) models, round(max(abs(a.value - b.value)), 9) largest from runs a join runs b using (model) where a.seed = '1-URGENT' and b.seed = '2-HIGH'")
def seed_agreement(spark: P, sf: str) -> D:
    r = _runs(spark, sf)
    one = lambda s: r.where(F.col("seed") == s).select("model", "value")
    return E.seed_agreement(one("1-URGENT"), one("2-HIGH"))


@query(f"with {_RUNS} select a.model, a.value old, b.value as new, round(b.value - a.value, 6) delta from runs a join runs b using (model) where a.seed = '1-URGENT' and b.seed = '2-HIGH'")
def compare_generations(spark: P, sf: str) -> D:
    return E.compare_generations(_runs(spark, sf).withColumnRenamed("seed", "generation"), "1-URGENT", "2-HIGH")


@query(f"with {_RUNS}, s as (select seed, model, case when model <> 'MACHINERY' then value end native, value - 100 raw from runs), v as (select seed, model, coalesce(native, raw) served from s) select v.seed, count(*) models, count(*) filter (v.served < b.served) below, bool_and(v.served is not null) complete from v join v b on b.seed = v.seed and b.model = 'BUILDING' group by 1")
def served_scores(spark: P, sf: str) -> D:
    r = _runs(spark, sf).withColumn("native", F.when(F.col("model") != "MACHINERY", F.col("value"))).withColumn("raw", F.col("value") - 100)
    return E.served_scores(r, "BUILDING")


@query("with r as (select l_orderkey q, l_quantity s, (l_returnflag = 'R')::int as label from lineitem), b as (select q, label from (select *, max(s) over (partition by q) m from r) where s = m), p as (select q, avg(label) e, max(label) hi, min(label) lo from b group by 1) select count(*) n, round(avg(e), 6) expected, round(avg(hi), 6) optimistic, round(avg(lo), 6) pessimistic from p")
def expected_top1(spark: P, sf: str) -> D:
    return E.expected_top1(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label")))


@query("select event_type, count(*) n, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.95), 6) p95 from events group by 1")
def quantiles(spark: P, sf: str) -> D:
    return E.quantiles(table(spark, sf, "events"), "value", by=["event_type"])


@query("with m as (select event_type metric, avg(value) v from events group by 1) select 'clicks are cheap' hypothesis, v as value, 1000.0::double as bound, case when v <= 1000 then 'supported' else 'refuted' end verdict from m where metric = 'click' union all select 'purchases are dear', v, 1000.0, case when v >= 1000 then 'supported' else 'refuted' end from m where metric = 'purchase' union all select 'refunds', null, 1.0, 'untested'")
def verdicts(spark: P, sf: str) -> D:
    m = table(spark, sf, "events").groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return E.verdicts(m, [("clicks are cheap", "click", "<=", 1000.0), ("purchases are dear", "purchase", ">=", 1000.0), ("refunds", "refund", ">=", 1.0)])


_CALIB = f"""{X.SLOTS}, {X.PAIRS}, {X.DF}, hd as (select item_id from df order by df desc, item_id limit 40), pp as (select a.item_id src, b.item_id dst from hd a join hd b on a.item_id < b.item_id),
st as (select src, dst, 1 as label from pairs join pp using (src, dst) where cnt >= 60), nv as (select src, dst, 0 as label from pp anti join (select src, dst from pairs where cnt >= 50) x using (src, dst)), al as (select * from st union all select * from nv), cal as (select src a, dst b, label from (select *, row_number() over (partition by label order by {X.draw_sql('src || chr(45) || dst', 0)}, src, dst) n from al) where n <= 50)"""


@query(f"with {_CALIB} select * from cal")
def calibration_set(spark: P, sf: str) -> D:
    b = baskets_of(spark, sf)
    pairs = B.pair_counts(b)
    strong = pairs.where(F.col("count") >= 50)
    return E.calibration_set(strong, B.frequencies(b), 40, 60, 50)


@query("with r as (select (o_orderstatus = 'F')::int as label, o_totalprice score from orders), p as (select score, sum(label) p, sum(1 - label) n from r group by 1), c as (select score, sum(p) over (order by score desc) / sum(p) over () tpr, sum(n) over (order by score desc) / sum(n) over () fpr from p) select score, round(tpr, 6) tpr, round(fpr, 6) fpr, round(tpr - fpr, 6) gain from c order by round(tpr - fpr, 9) desc, score desc limit 1")
def best_threshold(spark: P, sf: str) -> D:
    return E.best_threshold(table(spark, sf, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("label"), F.col("o_totalprice").alias("score")))


# --- pairing statistics ---------------------------------------------------------------------------

def _drawn_sql(reps: str) -> str:
    """Points on the line of a group's slots, first different items kept; what is lacking by the largest keys."""
    return f"""sl as (select b.basket_id, lang, item_id, len(items) n from baskets b join slots using (basket_id)), fq as (select lang, item_id, count(*) f from sl group by 1, 2),
ln0 as (select *, sum(f) over (partition by lang order by item_id) hi, sum(f) over (partition by lang) total, count(*) over (partition by lang) m from fq),
pt as (select rep, basket_id, b.lang, least(len(items), m) n, unnest(range(1, 2 * least(len(items), m) + 9)) j, total from baskets b join (select distinct lang, total, m from ln0) g on g.lang = b.lang, (values {reps}) t(rep)),
ht as (select rep, basket_id, pt.lang, n, item_id, min(j) j from (select *, floor({X.fine_draw_sql("basket_id || '-' || j", "(100 + rep)")} * total) as at_ from pt) pt join ln0 on ln0.lang = pt.lang and at_ >= hi - f and at_ < hi group by all),
kp as (select rep, basket_id, lang, n, item_id from (select *, row_number() over (partition by rep, basket_id order by j) r from ht) where r <= n),
sh as (select rep, basket_id, lang, n, count(*) got from kp group by all having count(*) < n),
mo as (select rep, basket_id, lang, item_id, row_number() over (partition by rep, basket_id order by ln(f) - ln(-ln(greatest(('0x' || substr(md5(basket_id || '-' || item_id || ':' || (100 + rep)), 1, 8))::bigint / 4294967296.0::double, 1e-12))) desc, item_id) r, n - got lacks
  from (select sh.*, item_id, f from sh join fq using (lang)) z where not exists (select 1 from kp where kp.rep = z.rep and kp.basket_id = z.basket_id and kp.item_id = z.item_id)),
nb as (select rep, basket_id, lang, item_id from kp union all select rep, basket_id, lang, item_id from mo where r <= lacks)"""


_NULL = f"{X.BASKETS}, {_drawn_sql('(0)')}"


@query(f"with {_NULL} select basket_id, string_agg(item_id, ',' order by item_id) items from nb group by 1")
def null_baskets(spark: P, sf: str) -> D:
    return T.null_baskets(saved(X.baskets(spark, sf).select("basket_id", "lang", "items"), "baskets"), "lang").select("basket_id", F.array_join("items", ",").alias("items"))


_DELTA = _NULL + f""", {X.EVERY_ATTR[len(X.ITEMS) + 2:]}, {X.SHARED},
rp as (select a.basket_id, a.lang, avg(coalesce(shared, 0)) s from sl a join sl b on a.basket_id = b.basket_id and a.item_id < b.item_id left join shared on i = a.item_id and j = b.item_id group by 1, 2),
np as (select a.basket_id, avg(coalesce(shared, 0)) s from nb a join nb b on a.basket_id = b.basket_id and a.item_id < b.item_id left join shared on i = a.item_id and j = b.item_id group by 1),
dl as (select lang, count(*) n, avg(rp.s) r0, avg(np.s) n0, avg(rp.s - np.s) d0, sqrt(var_samp(rp.s - np.s) / count(*)) se0 from rp join np using (basket_id) group by 1)"""


@query(f"with {_DELTA} select lang, n, round(r0, 6) real, round(n0, 6) \"null\", round(d0, 6) delta, round(se0, 6) se, round(d0 - 1.96 * se0, 6) low, round(d0 + 1.96 * se0, 6) high, round(d0 / n0, 6) relative from dl")
def pairing_statistic(spark: P, sf: str) -> D:
    return T.pairing_statistic(X.baskets(spark, sf).select("basket_id", "lang", "items"), G.shared_attributes(X.every_attr(spark, sf)), "lang")


_MANY = _drawn_sql("(0), (1)")


@query(
    f"with {X.BASKETS}, {_MANY}, {X.EVERY_ATTR[len(X.ITEMS) + 2:]}, {X.SHARED}, rp as (select a.basket_id, a.lang, avg(coalesce(shared, 0)) s from sl a join sl b on a.basket_id = b.basket_id and a.item_id < b.item_id left join shared on i = a.item_id and j = b.item_id group by 1, 2),"
    " np as (select a.rep, a.basket_id, a.lang, avg(coalesce(shared, 0)) s from nb a join nb b on a.rep = b.rep and a.basket_id = b.basket_id and a.item_id < b.item_id left join shared on i = a.item_id and j = b.item_id group by 1, 2, 3),"
    " rm as (select lang, avg(s) r from rp group by 1), nm as (select rep, lang, avg(s) m from np group by 1, 2), sc as (select lang, avg(m) nl, stddev_samp(m) sd from nm group by 1) select lang, round(r, 6) real, round(nl, 6) \"null\", round((r - nl) / case when sd > 0 then sd end, 4) z from rm join sc using (lang)"
)
def pairing_z(spark: P, sf: str) -> D:
    return T.pairing_z(X.baskets(spark, sf).select("basket_id", "lang", "items"), G.shared_attributes(X.every_attr(spark, sf)), "lang", replicates=2)


@query(f"with {_DELTA}, p(lang, sign) as (values ('BUILDING', 1), ('MACHINERY', -1), ('HOUSEHOLD', 1)) select count(*) n, count(*) filter (sign(d0) = p.sign) \"right\", count(*) filter (round(d0 - 1.96 * se0, 6) > 0 or round(d0 + 1.96 * se0, 6) < 0) clear, count(*) filter ((round(d0 - 1.96 * se0, 6) > 0 or round(d0 + 1.96 * se0, 6) < 0) and sign(d0) = p.sign) clear_and_right from dl join p using (lang)")
def sign_score(spark: P, sf: str) -> D:
    p = spark.createDataFrame([("BUILDING", 1), ("MACHINERY", -1), ("HOUSEHOLD", 1)], "lang string, sign int")
    return T.sign_score(pairing_statistic(spark, sf), p, "lang")


def _arm_sql(name: str, shared: str) -> str:
    """One arm's statistic over one table of shared attributes."""
    mean = lambda t: f"select a.basket_id, a.lang, avg(coalesce(shared, 0)) s from {t} a join {t} b on a.basket_id = b.basket_id and a.item_id < b.item_id left join {shared} on i = a.item_id and j = b.item_id group by 1, 2"
    return f"select '{name}' arm, rp.lang, count(*) n, round(avg(rp.s - np.s), 6) delta, round(sqrt(var_samp(rp.s - np.s) / count(*)), 6) se from ({mean('sl')}) rp join ({mean('nb')}) np using (basket_id) group by rp.lang"


@query(f"with {_NULL}, {X.EVERY_ATTR[len(X.ITEMS) + 2:]}, {X.SHARED}, {_CANON[len(X.ITEMS) + 2:]}, nd as (select a.item_id i, b.item_id j from c a join c b on a.canon = b.canon and a.item_id <> b.item_id), shared_m as (select * from shared anti join nd using (i, j)) {_arm_sql('all', 'shared')} union all {_arm_sql('masked', 'shared_m')}")
def masked_arms(spark: P, sf: str) -> D:
    b = X.baskets(spark, sf).select("basket_id", "lang", "items")
    return T.masked_arms(b, G.shared_attributes(X.every_attr(spark, sf)), G.near_duplicate_names(X.items(spark, sf), FORMS), "lang")


_MID = lambda c, by: f"rank() over ({by} order by {c}) + (count(*) over (partition by {'rep, ' if by else ''}{c}) - 1) / 2.0"


@query(
    f"with s as (select s_suppkey k, s_nationkey::double x, s_acctbal y from supplier), l as (select x, row_number() over (order by {X.draw_sql('k', 8)}, k) pos from s), r as (select rep, y, row_number() over (partition by rep order by {X.draw_sql('k || chr(45) || rep', 9)}, k) pos from s, (select unnest(generate_series(1, 49)) rep)),"
    f" m as (select rep, {_MID('x', 'partition by rep')} p, {_MID('y', 'partition by rep')} q from l join r using (pos)), rh as (select rep, round(corr(p, q), 6) rho from m group by 1), act as (select count(*) n, round(corr(p, q), 6) a from (select {_MID('x', '')} p, {_MID('y', '')} q from s))"
    " select n, a rho, round((count(*) filter (abs(rho) >= abs(a)) + 1) / 50.0::double, 6) p from rh, act group by n, a"
)
def permutation_p(spark: P, sf: str) -> D:
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("x"), F.col("s_acctbal").alias("y"))
    return T.permutation_p(s, "x", "y", "s_suppkey", replicates=49)


@query("with s as (select o_orderstatus seed, o_custkey % 20 a, o_orderkey % 20 b, round(avg(o_totalprice), 3) score from orders group by 1, 2, 3), k as (select max(abs(x.score - y.score)) m, count(*) c from s x join s y on x.seed = y.seed and x.a = y.b and x.b = y.a), d as (select a, b, max(score) - min(score) d, count(distinct score > 200000) l from s group by 1, 2) select round(m, 9) asymmetry, c pairs_both_ways, round((select max(d) from d), 9) largest_drift, round((select avg((l > 1)::int) from d), 6) label_churn from k")
def pair_score_audit(spark: P, sf: str) -> D:
    s = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("seed"), (F.col("o_custkey") % 20).alias("a"), (F.col("o_orderkey") % 20).alias("b")).agg(F.round(F.avg("o_totalprice"), 3).alias("score"))
    return T.pair_score_audit(s.withColumn("label", F.col("score") > 200000))


@query(
    "with r as (select l_orderkey || '-' || l_linenumber k, l_quantity * 2 a, l_discount * 1000 b, l_tax * 1000 c from lineitem),"
    f" u as (select *, {', '.join('least(100.0, ' + c + ' + 100.0 * (0.001 + 0.199 * ' + X.draw_sql('k', 70 + i) + ')) ' + c + '2' for i, c in enumerate('abc'))} from r), s as (select unnest([list_reverse_sort([a, b, c]), list_reverse_sort([a, b, c]), list_reverse_sort([a, b, c])]) p, unnest([list_reverse_sort([a2, b, c]), list_reverse_sort([a, b2, c]), list_reverse_sort([a, b, c2])]) q from u)"
    " select count(*) tried, coalesce(sum((0.5 * q[1] + 0.3 * q[2] + 0.2 * q[3] < 0.5 * p[1] + 0.3 * p[2] + 0.2 * p[3] - 1e-9)::int), 0)::bigint violations from s"
)
def monotonicity(spark: P, sf: str) -> D:
    rows = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k"), (F.col("l_quantity") * 2).alias("a"), (F.col("l_discount") * 1000).alias("b"), (F.col("l_tax") * 1000).alias("c"))
    return T.monotonicity(rows, ["a", "b", "c"], T.ordered_blend([0.5, 0.3, 0.2]), "k")


@query("with a as (select o_orderkey instance_id, rank() over (partition by o_custkey order by o_totalprice desc) r from orders), b as (select o_orderkey instance_id, rank() over (partition by o_custkey order by o_orderdate) r from orders) select instance_id, a.r rank_a, b.r rank_b, case when a.r < b.r then 'a' when b.r < a.r then 'b' else 'tie' end better from a join b using (instance_id)")
def rank_join(spark: P, sf: str) -> D:
    from pyspark.sql import Window as W

    o = table(spark, sf, "orders")
    by = lambda c: o.select(F.col("o_orderkey").alias("instance_id"), F.rank().over(W.partitionBy("o_custkey").orderBy(c)).alias("rank"))  # noqa: E731  a customer's orders
    return E.rank_join(by(F.desc("o_totalprice")), by(F.col("o_orderdate")))


_AGREE = f"""{X.EDGES}, {_V64}, ec as (select src, dst, cnt, round(npmi, 9) npmi, round(list_cosine_similarity(a.vec, b.vec), 9) cosine, round(ln(cnt), 9) lc from edges join v a on a.item_id = src join v b on b.item_id = dst), es as (select * from ec where cnt >= 5)"""


def _rho_sql(name: str, rows: str, x: str) -> str:
    mid = lambda c: f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0"
    return f"select '{name}' measure, count(*) n, round(corr(p, q), 6) as value from (select {mid('cosine')} p, {mid(x)} q from {rows})"


@query(f"with {_AGREE} {_rho_sql('npmi', 'ec', 'npmi')} union all {_rho_sql('npmi, counted', 'es', 'npmi')} union all {_rho_sql('log count, counted', 'es', 'lc')} union all select 'top overlap', count(*), round(count(*) / 100.0::double, 6) from (select src, dst from es order by npmi desc, src, dst limit 100) semi join (select src, dst from es order by cosine desc, src, dst limit 100) using (src, dst)")
def graph_agreement(spark: P, sf: str) -> D:
    return E.graph_agreement(edges_of(spark, sf), _vocab(spark, sf))
