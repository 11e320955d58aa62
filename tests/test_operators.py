"""Operators on hand-made fixtures."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from wicker.functions.columns import item_set, npmi, pairs_of
from wicker.operators import baskets as B, evaluate as E, graph as G, normalise as N, quality as Q, represent as R, search as S, stats as T
from wicker.sources import readers, sinks

BASKETS = "basket_id long, items array<long>, source string, lang string, total_minutes double, servings double"


@pytest.fixture(scope="module")
def catalog(spark):
    """Chicken 0, rice 1, broccoli 2, peanut 3, salt 4, pepper 5."""
    rows = [
        (0, [0, 1, 2], "a", "en", 30.0, 4.0),
        (1, [0, 1, 2], "a", "en", 90.0, 4.0),
        (2, [0, 1, 2], "b", "en", None, 4.0),
        (3, [0, 1, 3], "b", "en", 20.0, 4.0),
        (4, [0, 1, 2], "b", "de", 30.25, 2.0),
        (5, [0, 1, 2, 4, 5], "a", "en", 25.0, 4.0),
        (6, [0, 1], "a", "en", 25.0, None),
        (7, [4], "c", "en", 5.0, 1.0),
        (8, [2, 4, 5], "c", "fr", 15.0, 6.0),
    ]
    return spark.createDataFrame(rows, BASKETS)


def queries_of(spark, *rows):
    shape = "query_id long, available array<long>, must_use array<long>, exclude array<long>, budget double, max_missing int, min_servings double, language string, top_k int"
    return spark.createDataFrame(list(rows), shape)


def test_pairs_and_sets(spark):
    df = spark.createDataFrame([([3, 1, 1, None, 2],), ([5],), ([],)], "x array<long>").select(item_set("x").alias("s")).select("s", pairs_of("s").alias("p"))
    got = [(r.s, [tuple(p) for p in r.p]) for r in df.collect()]
    assert got == [([1, 2, 3], [(1, 2), (1, 3), (2, 3)]), ([5], []), ([], [])]


def test_npmi_of_a_pair_in_every_basket_is_dropped(spark):
    b = spark.createDataFrame([(1, [1, 2]), (2, [1, 2]), (3, [1, 2])], "basket_id long, items array<long>")
    assert B.npmi_graph(b).count() == 0
    b = spark.createDataFrame([(1, [1, 2]), (2, [1, 2]), (3, [1]), (4, [3])], "basket_id long, items array<long>")
    (r,) = B.npmi_graph(b).collect()
    assert (r.src, r["dst"], r["count"]) == (1, 2, 2)
    assert r.npmi == pytest.approx(math.log(0.5 / (0.75 * 0.5)) / -math.log(0.5))


def test_first_wins_and_waterfall(spark):
    rows = [(0, 0, "s1", ["Salt", " egg "]), (1, 0, "s2", ["egg", "salt"]), (1, 1, "s2", []), (1, 2, "s2", []), (0, 1, "s1", ["milk"])]
    raw = spark.createDataFrame(rows, "source_rank int, row_no int, source string, items array<string>")
    marked = B.deduplicate(raw, B.fingerprint("items"), ["source_rank", "row_no"])
    assert sorted((r.source, r.row_no) for r in marked.where("duplicate").collect()) == [("s2", 0), ("s2", 2)]
    total = {r.source: r for r in B.drop_waterfall(marked).collect()}
    assert (total[None].scanned, total[None].duplicates, total[None].empty, total[None].kept, total[None].slots) == (5, 2, 1, 2, 3)
    for r in total.values():
        assert r.scanned == r.duplicates + r.empty + r.kept


def test_search_constraints(spark, catalog):
    q = queries_of(
        spark,
        (1, [0, 1, 2], None, None, 30.0, 0, None, None, 10),
        (2, [0, 1], [2], [3], None, 1, None, None, 10),
        (3, [0, 1, 2, 4], None, [5], None, 2, 4.0, "en", 10),
        (4, [3], None, None, None, 5, None, None, 10),
    )
    got = {}
    for r in S.feasible(q, catalog).collect():
        got.setdefault(r.query_id, set()).add(r.basket_id)
    assert got == {1: {0, 6}, 2: {0, 1, 2, 4}, 3: {0, 1, 2, 3}, 4: {3}}
    best = {(r.query_id, r["rank"]): r.basket_id for r in S.ranked(q, catalog).collect()}
    assert best[1, 1] == 0
    cards = S.result_cards(S.ranked(q, catalog), catalog.select("basket_id", F.lit("t").alias("title"))).where("query_id = 2 and basket_id = 2").first()
    assert cards.warnings == ["time unknown"] and cards.missing_items == []


def test_features_of_an_exact_match(spark, catalog):
    q = queries_of(spark, (1, [0, 1, 2], None, None, 60.0, 0, None, None, 10))
    found = S.idf_sums(S.feasible(q, catalog), S.idf(catalog)).withColumn("n", F.lit(6))
    r = S.features(found, F.col("n")).where("basket_id = 0").first()
    assert r.exact_match == r.jaccard == r.idf_jaccard == r.fully_available == r.in_budget == 1.0
    assert r.time_share == 0.5 and r.time_slack == 0.5 and r.missing_share == 0.0
    assert r.overlap_log == pytest.approx(math.log1p(3) / math.log1p(6))


def test_invalid_queries(spark, catalog):
    items = spark.range(6).withColumnRenamed("id", "item_id")
    q = queries_of(spark, (1, [99], None, None, None, 0, None, None, 1), (2, [1], [2], [2], None, 0, None, None, 1), (3, [1], None, [1], None, 0, None, None, 1), (4, [1], None, None, -1.0, 0, None, None, 1), (5, [1], None, None, None, 0, None, None, 1))
    reasons = {r.query_id: r.reason for r in S.validate_queries(q, items).collect()}
    assert reasons == {1: "unknown item", 2: "must use and exclude clash", 3: "nothing to search by", 4: "bound out of range", 5: None}


def test_midranks_of_ties(spark):
    """All tied: the middle of the pool. A target without a score shares the last places."""
    items = spark.range(100).withColumnRenamed("id", "item_id")
    inst = spark.createDataFrame([(1, 5, [0, 1]), (2, 7, [0])], "basket_id long, target long, context array<long>")
    scores = spark.range(100).select(F.lit(1).cast("long").alias("basket_id"), F.col("id").alias("item_id"), F.lit(0.5).alias("score"))
    scores = scores.unionAll(spark.createDataFrame([(2, 1, 1.0), (2, 2, 0.5)], scores.schema))
    got = {r.basket_id: r["rank"] for r in E.midranks(inst, scores, items).collect()}
    assert got == {1: 49.5, 2: 3 + (97 - 1) / 2}


def test_auc_and_spearman_against_brute_force(spark):
    rng = random.Random(0)
    rows = [(rng.randint(0, 1), rng.randint(0, 9) / 10, rng.randint(0, 5)) for _ in range(200)]
    df = spark.createDataFrame(rows, "label int, score double, y int")
    pos, neg = [s for y, s, _ in rows if y], [s for y, s, _ in rows if not y]
    want = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg) / len(pos) / len(neg)
    assert E.auc(df.select("label", "score")).first().auc == pytest.approx(want, abs=1e-6)
    import pandas as pd

    p = pd.DataFrame(rows, columns=["l", "s", "y"])
    assert E.spearman(df, "score", "y").first().rho == pytest.approx(p.s.rank().corr(p.y.rank()), abs=1e-6)


def test_bootstrap_shares_its_draws(spark):
    rows = [(m, i, float((i * k) % 3 == 0)) for m, k in (("a", 1), ("twin", 1), ("base", 2)) for i in range(200)]
    got = {r.model: r for r in E.bootstrap(spark.createDataFrame(rows, "model string, instance_id long, hit double"), 100, baseline="a").collect()}
    assert got["twin"].diff_low == got["twin"].diff_high == 0.0
    assert got["a"].low <= got["a"]["mean"] <= got["a"].high


def test_leakage_guard():
    with pytest.raises(ValueError):
        E.check_protocol("basket", "edge-holdout")
    E.check_protocol("basket", "recipe-holdout")


def test_splits_partition(spark, catalog):
    s = E.hold_out_baskets(catalog)
    r = E.partition_check(catalog, [s.where("split = 'train'"), s.where("split = 'held'")]).first()
    assert (r.in_none, r.in_several, r.n) == (0, 0, 9)


NEAR = [("fresh_tomatoes", "tomato"), ("ground_beef", "beef"), ("brown_rice", "rice"), ("cheddar_cheese", "cheese"), ("green-onions", "green onion")]
FAR = [("peanut_butter", "butter"), ("rice_vinegar", "rice"), ("beef", "chicken"), ("egg", "eggplant")]
WORDS = ("fresh", "ground", "brown", "green")


@pytest.mark.parametrize("pair", NEAR + FAR)
def test_near_duplicate_names(spark, pair):
    items = spark.createDataFrame([(0, pair[0]), (1, pair[1])], "item_id long, name string")
    known = spark.createDataFrame([("peanut",), ("rice",), ("butter",), ("cheese",), ("beef",)], "name string")
    got = [(r.a, r.b) for r in G.near_duplicate_names(items, WORDS, known=known).collect()]
    assert got == ([(0, 1)] if pair in NEAR else [])


DURATIONS = [
    ("PT1H30M", "iso8601", 90.0), ("P1DT2H", "iso8601", 1560.0), ("P2W", "iso8601", 20160.0), ("PT1.5H", "iso8601", 90.0), ("PT0,5M", "iso8601", 0.5), ("P", "iso8601", None), ("PT", "iso8601", None), ("P1DT", "iso8601", None), ("PT1.5H30M", "iso8601", None), ("P1Y", "iso8601", None),
    ("45", "minutes", 45.0), ("1e2", "minutes", 100.0), ("0", "minutes", None), ("-5", "minutes", None), ("12 min", "minutes", None), ("1 hour 20 min", "en", 80.0), ("20 min 1 hour", "en", None), ("90 mins", "en", 90.0), ("1-2 hours", "en", None), ("about 1 hour", "en", None),
    ("1時間30分", "ja", 90.0), ("1 час 10 минут", "ru", 70.0), ("2小时", "zh", 120.0), ("1 ώρα", "el", 60.0), ("", "en", ""), ("N/A", "minutes", ""), (None, "en", ""),
]


def test_durations(spark):
    df = spark.createDataFrame([(i, v, e) for i, (v, e, _) in enumerate(DURATIONS)], "i int, v string, e string").select("i", "v", "e", N.duration(F.col("v"), F.col("e")).alias("d"))
    for r in df.collect():
        want = DURATIONS[r.i][2]
        if want == "":
            assert r.d.status == "missing", r
        elif want is None:
            assert r.d.status == "invalid" and r.d.minutes is None, r
        else:
            assert r.d.status == "provided" and r.d.minutes == pytest.approx(want), r


def test_counts(spark):
    cases = [("4", 4.0), ("2.5", 2.5), ("6 servings", 6.0), ("1 person", 1.0), ("4-6", None), ("0", None), ("makes 12", None), ("one", None)]
    df = spark.createDataFrame(cases, "v string, want double").select("v", "want", N.count_of(F.col("v"), F.lit("en")).alias("c"))
    for r in df.collect():
        assert r.c.n == r.want and r.c.status == ("provided" if r.want else "invalid"), r


def test_urls(spark):
    cases = [("example.com/a", "http://example.com/a", None), ("https://x.org", "https://x.org", None), ("http://localhost/x", None, "host"), ("ftp://a.b/c", None, "scheme"), ("http://me@a.b/", None, "user in host"), ("http://a.b/c d", None, "white space"), ("http://a.b/?token=1", None, "sensitive query"), ("http://a.b/?monkey=1", "http://a.b/?monkey=1", None), (None, None, "missing")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, u string").select("i", N.normal_url(F.col("u")).alias("x"))
    for r in df.collect():
        assert (r.x.url, r.x.reason) == cases[r.i][1:], cases[r.i]


def test_quantities_and_forms(spark):
    lines = [("2 cups fresh tomatoes", "fresh tomatoes"), ("1/2 tsp. salt", "salt"), ("3 eggs", "eggs"), ("½ lb beef", "beef"), ("salt", "salt"), ("7up", "7up")]
    df = spark.createDataFrame(lines, "l string, want string").select("want", N.strip_quantity(F.col("l")).alias("got"))
    assert all(r.want == r.got for r in df.collect())
    vocab = spark.createDataFrame([(0, "tomato"), (1, "green_onion"), (2, "berry")], "item_id long, name string")
    alias, rejected = N.alias_table(vocab, spark.createDataFrame([("scallion", "green_onion"), ("x", "nothing")], "surface string, name string"))
    assert [r.name for r in rejected.collect()] == ["nothing"]
    names = {r.surface: r.item_id for r in alias.collect()}
    assert names["tomatoes"] == 0 and names["scallions"] == 1 and names["berries"] == 2 and names["green onion"] == 1
    text = spark.createDataFrame([(0, "fresh tomatoes"), (1, "Scallions"), (2, "unknown thing")], "line_id long, line string")
    assert {r.line_id: r.item_id for r in N.match_exact(text, alias).collect()} == {0: 0, 1: 1}


def test_phrases_are_longest_first_and_apart(spark):
    alias = spark.createDataFrame([("green onion", 1), ("onion", 2), ("onion soup", 3), ("soup", 4)], "surface string, item_id long")
    text = spark.createDataFrame([(0, "Green onion soup, onion!")], "line_id long, line string")
    assert sorted((r.pos, r.n, r.item_id) for r in N.match_phrases(text, alias).collect()) == [(0, 2, 1), (2, 1, 4), (3, 1, 2)]


def test_unspaced_text(spark):
    alias = spark.createDataFrame([("葱", 1), ("洋葱", 2)], "surface string, item_id long")
    text = spark.createDataFrame([(0, "洋葱一个"), (1, "葱花"), (2, None)], "line_id long, line string")
    assert sorted((r.line_id, r.item_id) for r in N.match_unspaced(text, alias).collect()) == [(0, 2), (1, 1)]


def test_null_baskets_keep_sizes(spark, catalog):
    real = {r.basket_id: len(r["items"]) for r in catalog.collect()}
    null = {r.basket_id: r["items"] for r in T.null_baskets(catalog.select("basket_id", "source", "items"), "source").collect()}
    assert {k: len(v) for k, v in null.items()} == real
    assert all(len(set(v)) == len(v) for v in null.values())


def test_noise_vectors_are_at_chance(spark):
    rng = random.Random(1)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(80)], "item_id long, vec array<double>")
    edges = spark.createDataFrame([(i, j) for i in range(80) for j in range(i + 1, 80) if rng.random() < 0.5], "src long, dst long")
    r = E.triplet_accuracy(edges, R.noise_vectors(v)).first()
    assert abs(r.accuracy - 0.5) < 0.1


def test_centred_scores_don_t_move_with_the_origin(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(30)]
    one = spark.createDataFrame(rows, "item_id long, vec array<double>")
    moved = spark.createDataFrame([(i, [x + 7.5 for x in v]) for i, v in rows], "item_id long, vec array<double>")
    a, b = ({r.item_id: r.vec for r in R.centred(t).collect()} for t in (one, moved))
    assert all(x == pytest.approx(y, abs=1e-9) for k in a for x, y in zip(a[k], b[k]))


def test_autoencoder_has_no_diagonal_and_prefers_partners(spark):
    rows = [(i, [0, 1]) if i % 2 else (i, [2, 3]) for i in range(60)]
    w = {(r.a, r.b): r.weight for r in R.linear_autoencoder(spark.createDataFrame(rows, "basket_id long, items array<long>"), 1.0).collect()}
    assert all(a != b for a, b in w) and w[0, 1] > 0.5 and abs(w.get((0, 2), 0)) < 1e-9


def test_catalog_defects_are_found(spark, catalog):
    ok = {r["check"]: r.violations for r in Q.verify_catalog(catalog, catalog).collect()}
    assert set(ok.values()) == {0}
    broken = catalog.where("basket_id <> 3").withColumn("items", F.when(F.col("basket_id") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.col("items")))
    bad = {r["check"]: r.violations for r in Q.verify_catalog(broken, catalog).collect()}
    assert bad["id gaps"] == 1 and bad["slots"] == 5 and bad["sets"] == 2


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,list\nx,"salt\negg"\ny,\nz,"milk"\n')
    (tmp_path / "b.jsonl").write_text('{"list": ["a", "b"]}\nbroken\n{"list": []}\n')
    (tmp_path / "c.json").write_text('{"data": [{"list": ["p"]}, {"list": ["q", "r"]}]}')
    (tmp_path / "d.csv").write_text("recipe,the ingredient\n1,salt\n1,egg\n2,milk\n")
    (tmp_path / "e.jsonl").write_text('{"@graph": [{"@type": "Page"}, {"@type": "Recipe", "recipeIngredient": ["rice"]}]}\n')
    (tmp_path / "f.txt").write_text("One\nIngredients:\nsalt\nDirections:\nstir\n\nTwo\nnothing here")
    at = lambda n: str(tmp_path / n)
    registry = [
        readers.Source("csv", "en", "csv", at("a.csv"), "list"),
        readers.Source("jsonl", "en", "jsonl", at("b.jsonl"), "list"),
        readers.Source("json", "en", "json", at("c.json"), "list", options={"under": "data"}),
        readers.Source("long", "en", "long", at("d.csv"), "recipe"),
        readers.Source("graph", "en", "graph", at("e.jsonl")),
        readers.Source("dump", "en", "dump", at("f.txt")),
    ]
    got = {}
    for r in readers.read_all(spark, registry).collect():
        got.setdefault(r.source, []).append(r["items"])
    assert sorted(got["csv"]) == [["milk"], ["salt", "egg"]] and got["jsonl"] == [["a", "b"]] and got["json"] == [["p"], ["q", "r"]]
    assert sorted(got["long"]) == [["egg", "salt"], ["milk"]] and got["graph"] == [["rice"]] and got["dump"] == [["salt"]]
    assert readers.read_all(spark, registry, only=["json"], limit=1).count() == 1


def test_lists_and_literals(spark):
    rows = [(0, '["a", "b"]', '["1 g", "2"]', "['x']"), (1, "['a', 'it''s']", None, "loose text"), (2, 'c("a", "b", NA)', 'c("1", NA, "2")', "c(\"x\", \"y\")"), (3, '["a"]', '["1", "2"]', "")]
    got = {r.id: r for r in N.decode_lists(spark.createDataFrame(rows, "id int, items string, quantities string, steps string")).collect()}
    assert got[0]["items"] == ["a", "b"] and got[0].quantity_status == "complete"
    assert got[1].quantity_status == "not_supplied" and got[1].text_status == "unparsed_steps" and got[1].steps == ["loose text"]
    assert got[2]["items"] == ["a", "b", None] and got[2].quantity_status == "values_without_units" and got[2].steps == ["x", "y"]
    assert got[3].quantity_status == "count_mismatch"
    keys = spark.createDataFrame([("{'Salt ': 1, \"egg\": None}",)], "d string").select(readers.dict_keys(F.col("d")).alias("k")).first().k
    assert keys == ["salt", "egg"]


def test_html_cells_and_card_text(spark):
    html = "<table><tr><td><b>Salt</b></td><td>1 g</td></tr><tr><td>Egg</td><td></td></tr></table>"
    r = spark.createDataFrame([(html, "a &amp; b &copy c &#x41;\u0007 d")], "h string, t string").select(readers.html_cells(F.col("h")).alias("c"), N.item_lines(F.col("h")).alias("l"), N.clean_card_text(F.col("t")).alias("t")).first()
    assert r.c == ["Salt: 1 g", "Egg: "] and r.t == "a & b &copy c A d"


def test_sinks(spark, catalog, tmp_path):
    sinks.write_baskets(catalog, str(tmp_path / "b"))
    assert sinks.read_baskets(spark, str(tmp_path / "b")).count() == 9
    r = sinks.export_dataset(catalog.select("basket_id", "items"), str(tmp_path / "e"), max_rows=2).first()
    assert (r.n, r.slots, r.nulls, r["equal"]) == (9, 26, 0, True)
    edges = B.npmi_graph(catalog.select("basket_id", "items"))
    sinks.write_graph(edges, str(tmp_path / "g"), min_count=2)
    back, meta = sinks.read_graph(spark, str(tmp_path / "g"))
    assert back.count() == edges.count() and meta == {"min_count": "2"}
    (tmp_path / "runs" / "r1").mkdir(parents=True)
    (tmp_path / "runs" / "r1" / "metrics.json").write_text('{"recall": 0.5, "n": 3, "name": "x"}')
    got = {(r.run, r.metric): r["value"] for r in sinks.read_metrics(spark, str(tmp_path / "runs/*/metrics.json")).collect()}
    assert got == {("r1", "recall"): 0.5, ("r1", "n"): 3.0}
