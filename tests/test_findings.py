"""What reviews found, each with the case that failed."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from wicker.functions import joins
from wicker.functions.columns import half_up
from wicker.llm import near_dedup
from wicker.llm.scratch import Tables
from wicker.operators import baskets, evaluate as E, graph as G, neighbours as N, normalise, represent as R, search as S, stats
from wicker.plans import bindings, registry

SF = "/root/testdata/sf0.001"


def test_auc_without_rows(spark):
    rows = spark.createDataFrame([], "label int, score double")
    assert tuple(E.auc(rows).select("n_pos", "n_neg", "auc").first()) == (0, 0, None)


def test_halves_round_up_as_in_sql(spark):
    x = 1 - 69.13455 / 300  # 0.7695515 but for its last bit
    got = spark.createDataFrame([(x,), (-0.25,), (2.0,), (None,)], "x double").select(half_up("x", 6)).collect()
    assert [r[0] for r in got] == [0.769552, -0.25, 2.0, None]


def test_learned_ranks_answer_searches_for_links(spark):
    got = registry.QUERIES["ranked_learned"](spark, SF).collect()
    assert got and all(1 <= r["rank"] <= 10 and 0 <= r.score <= 1 for r in got)


def test_hot_nodes_meet_their_sizes_by_chunks(spark):
    rows = [(i, 3, [7, 100 + i]) for i in range(500)] + [(1000, 2, [600, 601])]
    sets = spark.createDataFrame(rows, "key long, n_shingles long, nodes array<long>")
    with Tables():
        nodes = near_dedup._first_nodes(sets, 4)
    got = {tuple(r) for r in nodes.collect()}
    assert got == {(7, i, 3, 500) for i in range(500)}
    parts = near_dedup._chunked(sets.select(F.explode("nodes").alias("node"), "key", "n_shingles"), 4)
    assert parts.where("node = 7").count() == 4


def test_a_set_of_many_nodes_is_met_once(spark, tmp_path):
    rows = spark.createDataFrame([(n, k, n % 3 == 0) for n in range(40) for k in range(5)], "node long, key long, center boolean")
    full = spark.createDataFrame([(k, 10 * k) for k in range(4)], "key long, n long")
    got = near_dedup._met_once(rows, full)
    assert {(r.key, r.n, r.node, r.center) for r in got.collect()} == {(k, 10 * k, n, n % 3 == 0) for n in range(40) for k in range(4)}
    assert got.count() == 160
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join Inner")  # rows by node are made behind the join


def test_nodes_of_a_hot_group_are_compared_as_one(spark, monkeypatch):
    rng, met_once, met = random.Random(5), near_dedup._met_once, []
    monkeypatch.setattr(near_dedup, "_met_once", lambda rows, full: met.append(rows.count()) or met_once(rows, full))
    base, texts = [f"w{i}" for i in range(150)], []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randrange(2, 7)):
            w[rng.randrange(150)] = f"x{rng.randrange(10**7)}"
        texts.append(" ".join(w))
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert met and sum(met) <= 5 * len(texts)  # a row for each of a set's sixteen nodes, and more for centres, before
    sets = [{tuple(w[i : i + 5]) for i in range(146)} for w in map(str.split, texts)]
    root = list(range(300))
    for i in range(300):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if root[i] != root[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))


def test_equal_queries_are_answered_once(spark):
    catalog = spark.createDataFrame([(1, [1, 2], "en", 10.0, 2.0), (2, [2, 3], "en", None, 2.0), (3, [4], "en", 5.0, None)], "basket_id long, items array<long>, lang string, total_minutes double, servings double")
    bounds = (None, 1, None, None, 5)
    q = spark.createDataFrame([(7, [1, 2], None, [9], *bounds), (8, [2, 1], [], [9], *bounds), (9, [2, 1], None, [3], *bounds)], "query_id long, available array<long>, must_use array<long>, exclude array<long>, budget double, max_missing int, min_servings double, language string, top_k int")
    asks, asked = S.asked_once(q)
    assert sorted(r.query_id for r in asks.collect()) == [7, 9]
    assert sorted(map(tuple, asked.collect())) == [(7, 7), (8, 7), (9, 9)]
    assert S.asked_once(q, ["pantry"])[0].count() == 1
    for found in (S.feasible(q, catalog), S.ranked(q, catalog), S.bm25(q, catalog)):
        assert sorted((r.query_id, r.basket_id) for r in found.collect()) == [(7, 1), (7, 2), (8, 1), (8, 2), (9, 1)]
    assert sorted(map(tuple, S.candidates(q, catalog).collect())) == [(i, b, n) for i in (7, 8, 9) for b, n in ((1, 2), (2, 1))]
    found = {(r.query_id, r.basket_id): r for r in S.answered(*S.scored_features(q, catalog)).collect()}
    for r in S.idf_sums(S.feasible(q, catalog), S.idf(catalog)).collect():
        mine = found[r.query_id, r.basket_id]
        assert (mine.idf_overlap, mine.idf_basket, mine.idf_pantry) == (r.idf_overlap, r.idf_basket, r.idf_pantry)


def test_cosines_by_blocks_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(G, "QUERIES_A_PIECE", 3)
    monkeypatch.setattr(G, "ROWS_A_PRODUCT", 2)
    rows = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(20)] + [(20, [0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "item_id long, vec array<double>")
    queries = vectors.where("item_id % 2 = 0")
    cosine = lambda x, y: sum(p * q for p, q in zip(x, y)) / (sum(p * p for p in x) * sum(q * q for q in y)) ** 0.5
    want = {(a, b): cosine(x, y) if any(x) and any(y) else None for a, x in rows if a % 2 == 0 for b, y in rows if a != b}
    got = {(r.a, r.b): r.cosine for r in G.similarities(vectors, queries, blocks=4).collect()}
    assert got.keys() == want.keys()
    assert all(got[p] is None if w is None else abs(got[p] - w) < 1e-12 for p, w in want.items())
    best = G.top_k(G.block_cosines(queries.selectExpr("item_id a", "vec v"), vectors, 3, blocks=4), ["a"], "cosine", "b", 3)
    for a in {a for a, _ in want if a < 20}:
        first = sorted((-round(w, 9), b) for (p, b), w in want.items() if p == a and w is not None)[:3]
        assert [r.b for r in best.where(F.col("a") == a).orderBy("rank").collect()] == [b for _, b in first]


@pytest.mark.parametrize("given", [False, True])
def test_neighbours_meet_by_blocks(spark, monkeypatch, given):
    """Vectors without clusters, one of them many times, ids that repeat: a query goes to blocks, not to cells, and no neighbour is lost."""
    monkeypatch.setattr(N, "BLOCK", 60)
    monkeypatch.setattr(N, "A_PRODUCT", 500)
    rng = np.random.default_rng(3)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(240, 12)))]
    rows += [(300 + i, rows[5][1]) for i in range(40)] + [(9, rows[20][1])]
    vectors = spark.createDataFrame(rows, "item_id long, vec array<double>")
    _, cells = N.in_cells(vectors)
    assert cells.blocks == 5 and cells.lo.min() == 0 and cells.hi.max() == 4 and len(cells.poles) > 3 * cells.blocks
    asked = vectors.where("item_id % 3 = 0 and item_id <> 9") if given else None
    got = N.nearest(vectors.where("item_id <> 9"), 4, asked)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i != 9}
    want = {(a, b, n + 1) for a, u in unit.items() if not given or a % 3 == 0 for n, (_, b) in enumerate(sorted((-round(float(u @ w), 9), b) for b, w in unit.items() if b != a)[:4])}
    assert {(r.a, r.b, r["rank"]) for r in got.collect()} == want
    assert N.nearest(vectors, 3).where("a = 9 and b = 9").count() == 0


def test_equal_texts_are_read_once(spark, monkeypatch):
    """Rows are never what is broadcast, whatever the plan takes them for, and equal ones are scanned once."""
    from wicker.functions import joins

    vocab = spark.createDataFrame([(0, "red_rice"), (1, "oat"), (2, "plain_oat")], "item_id long, name string")
    alias = spark.createDataFrame([("groats", 1), ("rice", 0)], "surface string, item_id long")
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["Oats", "big groats", "some red thing", "plain", None, "none"] * 50)] + [(0, "rice")], "text_id long, text string")
    want = {**{i: (1, "singular") for i in range(0, 300, 6)}, **{i: (1, "head") for i in range(1, 300, 6)}, **{i: (0, "token") for i in range(2, 300, 6)}, **{i: (2, "token") for i in range(3, 300, 6)}}
    for most in (joins.BROADCAST_ROWS, 0):
        monkeypatch.setattr(joins, "BROADCAST_ROWS", most)
        got = normalise.resolve_names(texts, vocab, alias)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == (most > 0)
        found = {r.text_id: (r.item_id, r.way) for r in got.collect()}
        assert found.pop(0) == (0, "key")
        assert found == {i: w for i, w in want.items() if i}
        phrases = normalise.match_phrases(texts.select(F.col("text_id").alias("line_id"), F.col("text").alias("line")), alias)
        assert sorted(tuple(r) for r in phrases.collect()) == sorted([(i, 1, 1, 1) for i in range(1, 300, 6)] + [(0, 0, 0, 1)])
        fields = spark.createDataFrame([(1, "PT1H", "iso8601"), (2, None, "en"), (3, "PT1H", "iso8601"), (4, "2 hours", "en"), (5, "x", None)], "id int, value string, encoding string")
        assert {r.id: (r.d.minutes, r.d.status) for r in normalise.durations(fields).collect()} == {1: (60.0, "provided"), 2: (None, "missing"), 3: (60.0, "provided"), 4: (120.0, "provided"), 5: (None, "invalid")}


def test_points_and_pairs_stay_with_their_basket(spark):
    """Behind the shuffle of whole baskets neither the points of a draw nor the pairs of a basket are shuffled."""
    baskets = spark.createDataFrame([(i, "en" if i % 2 else "zh", [i % 5, 5 + i % 3, 8]) for i in range(60)], "basket_id long, lang string, items array<long>")
    shared = spark.createDataFrame([(i, j, 1) for i in range(9) for j in range(9) if i != j], "i long, j long, shared long")
    got = stats.sharing(baskets, shared, "lang")
    assert got.count() == 60 and got.where("s <> 1 or n <> 3").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "basket_id" in plan[plan.index("Exchange hashpartitioning") :].split("\n")[0]


def counted(spark, rows):
    """``rows``, and how many of them have been made."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return rows.mapInArrow(count, rows.schema), made


def test_equal_sets_are_scored_once(spark):
    c = spark.createDataFrame([(i, [1, 2 + i % 3], None, None, None) for i in range(60)], "basket_id long, items array<long>, lang string, total_minutes double, servings double")
    sets, members = S.equal_sets(c)
    assert sorted(tuple(r) for r in sets.select("basket_id", "items", "copies").collect()) == [(0, [1, 2], 20), (1, [1, 3], 20), (2, [1, 4], 20)]
    assert members.count() == 60
    none = F.lit(None)
    q = spark.createDataFrame([(1, [2])], "query_id long, available array<long>").select("*", *[none.cast(t).alias(n) for n, t in (("must_use", "array<bigint>"), ("exclude", "array<bigint>"), ("budget", "double"), ("max_missing", "int"), ("min_servings", "double"), ("language", "string"), ("top_k", "int"))])
    # the scan ends inside the copies of one set: those of the smallest ids are kept
    got = S.bm25(q, c, scan_limit=7, keep=5).orderBy("rank").collect()
    assert [(r.basket_id, r["rank"], r.truncated) for r in got] == [(3 * i, i + 1, True) for i in range(5)]


def test_graphs_are_run_once_for_walks_and_agreement(spark):
    rows = [(a, b, 1.0 + (a + b) % 3) for a in range(6) for b in range(6) if a != b]
    edges, made = counted(spark, spark.createDataFrame(rows, "a long, b long, weight double"))
    assert R.random_walks(edges, per_item=1, length=3).count() == 6 and made.value == len(rows)
    graph = [(a, b, 5 + a, (a * b % 7) / 10) for a in range(5) for b in range(a + 1, 6)]
    edges, made = counted(spark, spark.createDataFrame(graph, "src long, dst long, count long, npmi double"))
    vectors = spark.createDataFrame([(i, [1.0, float(i), float(i * i % 5)]) for i in range(6)], "item_id long, vec array<double>")
    assert E.graph_agreement(edges, vectors).count() == 4 and made.value == len(graph)


def test_baskets_are_run_once_for_shortlists_and_portraits(spark):
    c = spark.createDataFrame([(i, [i % 5, 5 + i % 7, 12 + i % 3]) for i in range(40)], "basket_id long, items array<long>")
    rows, made = counted(spark, c)
    q = c.selectExpr("basket_id query_id", "items available", "items source_items", "2 max_missing").where("query_id < 10")
    assert S.shortlists(q, rows).count() and made.value == 40
    rows, made = counted(spark, c)
    edges = spark.createDataFrame([(0, 12), (0, 5)], "src long, dst long")
    got = {(r.src, r.dst, r.pair_count) for r in baskets.pair_portrait(rows, edges).collect()}
    assert made.value == 40
    assert got == {(0, x, sum(i % 5 == 0 and x in (5 + i % 7, 12 + i % 3) for i in range(40))) for x in (12, 5)}


def test_pairs_that_do_not_repeat_are_dealt_over_more_tasks(spark, monkeypatch):
    for module in (baskets, joins):
        monkeypatch.setattr(module, "ROWS_A_TASK", 10)
    c = spark.createDataFrame([(i, list(range(3 * i, 3 * i + 3))) for i in range(50)], "basket_id long, items array<long>")
    got = baskets.pair_counts(c)
    assert got.rdd.getNumPartitions() == 15 and got.count() == 150
    pairs = bindings.subs(spark, SF)
    assert pairs.rdd.getNumPartitions() > 4


def test_hybrid_scores_of_many_vectors_meet_by_pieces(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [1.0 + i, 3.0 - i, i % 3 + 0.5]) for i in range(12)], "item_id long, vec array<double>")
    q = spark.createDataFrame([(i, [i % 12, (i + 5) % 12]) for i in range(9)], "query_id long, items array<long>")
    edges = spark.createDataFrame([(i, i + 1, 0.1 * i) for i in range(11)], "src long, dst long, npmi double")
    few = sorted(map(tuple, N.hybrid_scores(q, edges, vectors).collect()))
    monkeypatch.setattr(N, "FEWEST", 2)
    monkeypatch.setattr(N, "A_PIECE", 2)
    assert sorted(map(tuple, N.hybrid_scores(q, edges, vectors, blocks=3).collect())) == few and len(few) == 9 * 10


def test_a_baskets_equal_lines_are_met_once_by_aliases(spark):
    lines = spark.createDataFrame([("de", 1, "a")] * 3 + [("de", 1, "b"), ("de", 2, "c"), ("fr", 3, "x"), (None, 4, "a")], "lang string, basket_id long, line string")
    rows, made = counted(spark, lines)
    alias = spark.createDataFrame([("de", "a", 1), ("de", "b", 2)], "lang string, surface string, item_id long")
    got = {(r.lang, r.variant): (r.recall, r.items_per_basket, r.gain) for r in baskets.alias_gain(rows, [("one", alias.where("item_id = 1")), ("two", alias)]).collect()}
    assert got == {("de", "one"): (0.6, 0.5, 0.0), ("de", "two"): (0.8, 1.0, 0.2), ("fr", "one"): (0.0, 0.0, 0.0), ("fr", "two"): (0.0, 0.0, 0.0)}
    assert made.value == 7


@pytest.fixture(scope="module")
def large_quantities(tmp_path_factory):
    """The smallest tables with an eighth of the orders' lines, each of five pieces."""
    import duckdb

    folder = tmp_path_factory.mktemp("quantities")
    for path in Path(SF).iterdir():
        if path.name != "lineitem.parquet":
            (folder / path.name).symlink_to(path)
    duckdb.execute(f"copy (select * replace (5 as l_quantity) from '{SF}/lineitem.parquet' where l_orderkey % 8 = 0) to '{folder}/lineitem.parquet'")
    return str(folder)


@pytest.mark.parametrize("name, column", [("masked_arms", "delta"), ("pairing_statistic", "real"), ("pairing_z", "real"), ("sign_score", "right")])
def test_pairings_count_nations_of_every_line(spark, large_quantities, name, column):
    assert any(r[column] for r in registry.QUERIES[name](spark, large_quantities).collect())
    assert "l_quantity <=" not in registry.ORACLE_SQL[name]


@pytest.fixture
def no_small_tables(spark):
    """Joins as Spark plans them where no table is small enough to be broadcast unasked."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def searches(spark, rows):
    """``query_id, available, exclude, budget, max_missing`` as queries."""
    q = spark.createDataFrame(rows, "query_id long, available array<long>, exclude array<long>, budget double, max_missing int")
    none = F.lit(None)
    return q.select("*", *[none.cast(t).alias(n) for n, t in (("must_use", "array<bigint>"), ("min_servings", "double"), ("language", "string"), ("top_k", "int"))])


def catalogue(spark, sets):
    return spark.createDataFrame([(i, x, "en", float(i), None) for i, x in enumerate(sets)], "basket_id long, items array<long>, lang string, total_minutes double, servings double")


def test_answers_of_candidates_are_not_shuffled(spark, no_small_tables):
    q = searches(spark, [(i, [1, 2 + i % 2], [], None, 1) for i in range(50)])
    c = catalogue(spark, [[1, 2], [2, 3], [4], [1, 3, 4]])
    got = S.candidates(q, c)
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(i, b, n) for i in range(50) for b, n in (((0, 2), (1, 1), (3, 1)) if i % 2 == 0 else ((0, 1), (1, 1), (3, 2)))}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_answers_for_many_queries_are_joined(spark, monkeypatch):
    q = searches(spark, [(i, [1], [], None, 1) for i in range(9)])
    monkeypatch.setattr(S, "ASKED", 5)
    assert sorted(r.query_id for r in S.candidates(q, catalogue(spark, [[1, 2], [3]])).collect()) == list(range(9))


FIT_SETS = [[1, 2], [2, 3], [4], [1, 3, 4], [1, 2, 5], [2], [1, 2, 3, 6]]
FIT_QUERIES = [(i, [1, 2 + i % 2], [5 + i % 2], 4.5 if i % 3 == 0 else None, 1 if i % 4 else None) for i in range(24)]


def fits():
    """What FIT_QUERIES find in FIT_SETS, pair by pair."""
    for i, available, out, budget, most in FIT_QUERIES:
        for b, x in enumerate(FIT_SETS):
            pantry = set(available) - set(out)
            overlap = len(pantry & set(x))
            if overlap and not set(out) & set(x) and (most is None or len(x) - overlap <= most) and (budget is None or b <= budget):
                yield i, b, overlap, len(x) - overlap


@pytest.mark.parametrize("vocabulary", [4_096, 2])
def test_feasible_baskets_meet_pantries_once_and_are_not_shuffled(spark, no_small_tables, monkeypatch, vocabulary):
    monkeypatch.setattr(S, "VOCABULARY", vocabulary)
    got = S.feasible(searches(spark, FIT_QUERIES), catalogue(spark, FIT_SETS)).select("query_id", "basket_id", "overlap", "missing")
    assert sorted(map(tuple, got.collect())) == sorted(fits())
    if vocabulary > 6:
        assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("vocabulary", [4_096, 2])
def test_features_are_not_shuffled(spark, no_small_tables, monkeypatch, vocabulary):
    monkeypatch.setattr(S, "VOCABULARY", vocabulary)
    q, c = searches(spark, FIT_QUERIES), catalogue(spark, FIT_SETS)
    got = S.answered(*S.scored_features(q, c))
    if vocabulary > 6:
        assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    want = S.features(S.idf_sums(S.feasible(q, c), S.idf(c)), F.lit(6))
    rounded = lambda rows: sorted(tuple(r) for r in rows.select("query_id", "basket_id", *[F.round(x, 7) for x in S.FEATURES]).collect())
    rows = rounded(got)
    assert len(rows) == len(list(fits())) and rows == rounded(want)


def test_cosines_are_passed_on_by_batches(spark, monkeypatch):
    from pyspark.sql.group import GroupedData

    monkeypatch.setattr(G, "VECTORS_A_BLOCK", 8)
    monkeypatch.setattr(G, "COSINES_A_BATCH", 10)
    vectors = spark.createDataFrame([(i, [1.0 + i, 3.0 - i]) for i in range(40)], "item_id long, vec array<double>")
    apply, seen = GroupedData.applyInArrow, []
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda rows, of, ddl: seen.append((rows, of)) or apply(rows, of, ddl))
    assert G.similarities(vectors, blocks=2).count() == 40 * 39
    rows, of = seen[0]
    assert rows.agg(F.count_if("asks").alias("asks")).count() == 5  # blocks
    piece = rows._df.where("block = 0").drop("piece", "block").toArrow()
    made = [b.num_rows for b in of(iter(piece.to_batches()))]
    assert sum(made) > 100 and max(made) <= 10


def test_the_ranker_learns_from_every_pantry(spark, monkeypatch):
    learnt = []
    monkeypatch.setattr(S, "train_ranker", lambda rows, **_: learnt.append(rows.agg(F.count("*").alias("n"), F.sum("label").alias("right")).first()))
    assert registry.QUERIES["ranked_learned"](spark, SF).count()
    c = bindings.baskets(spark, SF)
    q = S.pantries(c, "train").select("query_id", "source_items")
    same = c.select("basket_id", "items").join(q.withColumnRenamed("source_items", "items"), "items")
    # a pantry's own basket lacks two items at most, and all baskets of the same set do
    assert learnt[0].right == same.count() and learnt[0].n > 10 * q.count()


def test_the_report_is_on_every_evaluation_query(spark):
    got = registry.QUERIES["search_report"](spark, SF).first()
    assert got.n == S.evaluation_queries(bindings.baskets(spark, SF)).count() and got.violations == 0
