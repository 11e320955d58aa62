"""Shared mechanisms and the operators that rest on them, against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wicker.functions.arrays import array_sums
from wicker.functions import patterns
from wicker.functions.pairing import paired
from wicker.functions.ranges import places, sums_before
from wicker.operators import evaluate as E, graph as G, matrices as M, neighbours as N, normalise as C, represent as R, search as S, stats as T
from wicker.sources.readers import Source, chat_items, item_column, listed, read_source

CATALOG = "basket_id long, items array<long>, lang string, total_minutes double, servings double, link_status string"
QUERIES = "query_id long, available array<long>, must_use array<long>, exclude array<long>, budget double, max_missing int, min_servings double, language string, top_k int, require_link boolean"


@pytest.fixture(scope="module")
def catalog():
    """Baskets of up to thirty items; some items are in nearly all."""
    rng = random.Random(1)
    rows = []
    for i in range(1500):
        n = rng.choice([1, 2, 3, 5, 8, 12, 20, 30])
        items = sorted({int(400 * rng.random() ** 3) for _ in range(n)})
        rows.append((i, items, rng.choice(["en", "de", None]), rng.choice([10.0, 50.0, None]), rng.choice([2.0, 4.0, None]), rng.choice(["source", "archive", "offline", None])))
    return rows


@pytest.fixture(scope="module")
def queries():
    rng = random.Random(2)
    rows = []
    for i in range(40):
        pantry = sorted({int(400 * rng.random() ** 3) for _ in range(12)})
        must, out = (pantry[:1] if i % 5 == 0 else None), [pantry[-1], 3] if i % 4 == 0 else []
        rows.append((i, pantry, must, out, 30.0 if i % 6 == 0 else None, None if i % 9 == 0 else i % 3, 3.0 if i % 7 == 0 else None, "en" if i % 8 == 0 else None, 5, True if i % 3 == 0 else None))
    return rows + [(90, [], None, None, None, 2, None, None, 5, None), (91, None, [5], [5], None, 2, None, None, 5, None)]


def fits(q, c):
    pantry = (set(q[1] or []) | set(q[2] or [])) - set(q[3] or [])
    items = set(c[1])
    missing = len(items - pantry)
    ok = items & pantry and set(q[2] or []) <= items and not items & set(q[3] or []) and (q[5] is None or missing <= q[5])
    ok = ok and (q[4] is None or c[3] is not None and c[3] <= q[4]) and (q[6] is None or c[4] is not None and c[4] >= q[6])
    return ok and (q[7] is None or c[2] == q[7]) and (not q[9] or c[5] in ("source", "archive"))


def test_feasible_by_prefixes(spark, catalog, queries):
    q, c = spark.createDataFrame(queries, QUERIES), spark.createDataFrame(catalog, CATALOG)
    got = S.feasible(q, c).select("query_id", "basket_id").collect()
    assert Counter(map(tuple, got)) == Counter((a[0], b[0]) for a in queries for b in catalog if fits(a, b))


def test_prefixes_meet_few_baskets(spark, catalog, queries):
    q, c = spark.createDataFrame([x for x in queries if x[5] == 1], QUERIES), spark.createDataFrame([x for x in catalog if len(x[1]) >= 8], CATALOG)
    met, sharing = S.found_by_prefix(q, S.prefix_index(c, 2)).count(), S.candidates(q, c).count()
    assert 0 < 10 * met <= sharing


def exhaustive_bm25(queries, catalog):
    df = Counter(x for c in catalog for x in c[1])
    mean = sum(len(c[1]) for c in catalog) / len(catalog)
    out = {}
    for q in queries:
        pantry = (set(q[1] or []) | set(q[2] or [])) - set(q[3] or [])
        scored = []
        for c in catalog:
            if both := pantry & set(c[1]):
                idf = sum(math.log(1 + (len(catalog) - df[x] + 0.5) / (df[x] + 0.5)) for x in both)
                scored.append((-round(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(c[1]) / mean)), 6), c[0]))
        out[q[0]] = sorted(scored)
    return out


@pytest.mark.parametrize("limit, keep", [(20, 5), (100, 2000), (50_000, 3)])
def test_bm25_by_blocks(spark, catalog, queries, limit, keep):
    q, c = spark.createDataFrame(queries, QUERIES), spark.createDataFrame(catalog, CATALOG)
    want = []
    by = {c[0]: c for c in catalog}
    for a in queries:
        scored = exhaustive_bm25([a], catalog)[a[0]]
        fit = [(s, b) for s, b in scored[:limit] if fits(a, by[b])]
        want += [(a[0], b, round(-s, 5), r + 1, len(scored) > limit or len(fit) > keep) for r, (s, b) in enumerate(fit[:keep])]
    got = [(r.query_id, r.basket_id, round(r.score, 5), r["rank"], r.truncated) for r in S.bm25(q, c, limit, keep).collect()]
    assert sorted(got) == sorted(want)


def test_blocks_are_skipped(spark, catalog, queries):
    q, c = spark.createDataFrame(queries, QUERIES), spark.createDataFrame(catalog, CATALOG)
    plan, _ = S.scan_plan(q, c, S.posting_blocks(c, 4), 21)
    n = {r.role: r.n for r in plan.groupBy("role").agg(F.sum("n_blocks").alias("n")).collect()}
    assert n["skipped"] > n["seed"] + n["essential"]


@pytest.mark.parametrize("descending", [False, True])
def test_sums_before(spark, descending):
    rng = random.Random(3)
    rows = [(g, k, rng.randint(1, 9)) for g in ("a", "b", None) for k in rng.sample(range(1000), 200 if g == "a" else 20)] + [("a", None, 4)]
    got = sums_before(spark.createDataFrame(rows, "g string, k int, v long"), "k", {"s": "v"}, ["g"], descending, ranges=7).collect()
    before = lambda x, y: (y is not None and (x is None or x < y)) if not descending else (x is not None and (y is None or x > y))
    assert Counter(map(tuple, got)) == Counter((g, k, v, sum(w for h, j, w in rows if h == g and before(j, k))) for g, k, v in rows)


def test_places(spark):
    rows = [(x * 7919 % 500, x % 3) for x in range(500)]
    got = places(spark.createDataFrame(rows, "a int, b int"), ["b", "a"], ranges=6).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.r)] == sorted(rows, key=lambda x: (x[1], x[0]))
    assert sorted(r.r for r in got) == list(range(1, 501))


def test_no_window_over_all_rows(spark):
    """The plans sort no rows in a single partition: only sums of ranges."""
    rows = spark.range(5000).select((F.col("id") % 2).alias("label"), F.sin("id").alias("score"))
    plan = E.auc(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") == 2
    for line in plan.splitlines():
        if "SinglePartition" in line:
            assert "score" not in line


def test_degree_matched_draws(spark):
    rng = random.Random(4)
    edges = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(200)} | {(0, j) for j in range(1, 60)})
    degree = Counter(x for e in edges for x in e)
    df = spark.createDataFrame([(a, b, 0.5) for a, b in edges], "src long, dst long, npmi double")
    got = E.degree_matched(df, spark.createDataFrame(list(degree.items()), "item_id long, degree long")).collect()
    r = {x: i + 1 for i, (_, x) in enumerate(sorted((d, x) for x, d in degree.items()))}
    free = lambda s, d, o: o not in (s, d) and abs(r[o] - r[d]) <= 6 and tuple(sorted((s, o))) not in edges
    assert all(free(x.src, x.dst, x.other) for x in got)
    assert {(x.src, x.dst) for x in got} == {(s, d) for s, d in edges if any(free(s, d, o) for o in degree)}


def brute_nearest(rows, k):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if any(v)}
    out = []
    for a, u in unit.items():
        best = sorted((-round(float(u @ w), 9), b) for b, w in unit.items() if b != a)[:k]
        out += [(a, b, -c, r + 1) for r, (c, b) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("pivots, block", [(None, 4096), (5, 40), (1, 4096)])
def test_pruned_neighbours(spark, monkeypatch, pivots, block):
    """Clusters, one of which holds a third of all, equal vectors, a zero vector."""
    monkeypatch.setattr(N, "BLOCK", block)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 3
    rows = [(i, (centres[0 if i % 3 == 0 else i % 12] + rng.normal(size=8) * 0.2).tolist()) for i in range(400)]
    rows += [(500 + i, rows[7][1]) for i in range(9)] + [(600, [0.0] * 8)]
    near, work = N.pivot_neighbours(spark.createDataFrame(rows, "item_id long, vec array<double>").repartition(3), 4, pivots=pivots)
    got = sorted((r.a, r.b, r.cosine, r["rank"]) for r in near.collect())
    assert [(x[0], x[1], x[3]) for x in got] == [(x[0], x[1], x[3]) for x in brute_nearest(rows, 4)]
    if pivots is None:
        assert sum(r.compared for r in work.collect()) < 0.35 * 409 * 408


def test_pruned_neighbours_of_few(spark):
    schema = "item_id long, vec array<double>"
    assert N.nearest(spark.createDataFrame([], schema), 3).collect() == []
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], schema)
    assert sorted((r.a, r.b) for r in N.nearest(two, 3).collect()) == [(1, 2), (2, 1)]
    assert [(r.a, r.b) for r in N.nearest(two, 3, two.where("item_id = 2")).collect()] == [(2, 1)]


def test_drawn_baskets_follow_the_frequencies(spark):
    """Pairs of items drawn without repeats against their exact chances, by a chi-square; sizes stay, a basket as large as its group takes all."""
    frequency = {0: 40, 1: 20, 2: 10, 3: 6, 4: 4}
    rows, at = [], 0
    for item, n in frequency.items():
        for _ in range(n):
            rows.append((at, "g", [item]))
            at += 1
    pairs = [(1000 + i, "g", [0, 1]) for i in range(3000)]
    # the pairs of the group add to its frequencies: 3,040 and 3,020 of all slots
    f = {**frequency, 0: 3040, 1: 3020, 2: 910, 3: 606, 4: 404}
    extra = [(10_000 + i, "g", [2]) for i in range(900)] + [(20_000 + i, "g", [3]) for i in range(600)] + [(30_000 + i, "g", [4]) for i in range(400)]
    baskets = spark.createDataFrame(rows + pairs + extra + [(1, "h", [7, 8, 9])], "basket_id long, g string, items array<long>").where("not (basket_id = 1 and g = 'g')")
    f[0] -= 1
    got = T.null_baskets(baskets, "g").collect()
    assert next(r["items"] for r in got if r.g == "h") == [7, 8, 9]
    seen = Counter(tuple(r["items"]) for r in got if 1000 <= r.basket_id < 4000)
    total = sum(f.values())
    want = {(a, b): 3000 * (f[a] / total * f[b] / (total - f[a]) + f[b] / total * f[a] / (total - f[b])) for a in f for b in f if a < b}
    assert set(seen) <= set(want) and sum(seen.values()) == 3000
    assert sum((seen[p] - w) ** 2 / w for p, w in want.items()) < 27.9  # 9 degrees of freedom, one in a thousand


def test_array_sums(spark):
    rows = [(["a", "b", None][i % 3], i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(40)
    of = lambda b: {k: np.array([sum(v for j, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if j == k), 1.0]) for k in set(b.column(0).to_pylist())}
    got = {r.k: r.sums for r in array_sums(df, "k", of).collect()}
    assert {k: x[0] for k, x in got.items()} == {k: sum(v for j, v in rows if j == k) for k in ("a", "b", None)}


def test_bootstrap_intervals_have_the_right_width(spark):
    rng = random.Random(6)
    rows = [("m", i, float(rng.random() < 0.3)) for i in range(2000)]
    got = E.bootstrap(spark.createDataFrame(rows, "model string, instance_id long, hit double"), replicates=400).first()
    mean = sum(r[2] for r in rows) / len(rows)
    half = 1.96 * math.sqrt(mean * (1 - mean) / len(rows))
    assert got["mean"] == pytest.approx(mean, abs=1e-6) and got.low < mean < got.high
    assert (got.high - got.low) / 2 == pytest.approx(half, rel=0.2)


def test_heavy_keys_are_met_in_pieces(spark):
    """Half of all rows share one key: every pair comes once, and no join key holds more than a few times the rows that one may."""
    rows = [("hot", i, f"x{i}") for i in range(300)] + [(f"k{i % 40}", 1000 + i, "y") for i in range(300)] + [(None, 5, "z")]
    df = spark.createDataFrame(rows, "k string, a int, t string")
    got = paired(df, "k", ["a", "s"], ["b", "u"], most=30).collect()
    assert Counter((r.k, r.a, r.s, r.b, r.u) for r in got) == Counter((k, a, s, b, u) for k, a, s in rows for j, b, u in rows if k is not None and j == k)
    plan = paired(df, "k", ["a", "s"], ["b", "u"], most=30)
    assert plan.columns == ["k", "a", "s", "b", "u"]
    sizes = Counter()
    for r in df.where("k = 'hot'").select(F.pmod(F.xxhash64("a", "t"), F.lit(10)).alias("own")).collect():
        sizes[r.own] += 1
    assert max(sizes.values()) < 3 * 30


def test_shared_attributes_with_a_common_one(spark):
    rows = [(i, 0) for i in range(0, 120, 2)] + [(i, 1 + i % 7) for i in range(120)]
    df = spark.createDataFrame(rows, "item_id long, attr_id long")
    of = {}
    for i, a in rows:
        of.setdefault(i, set()).add(a)
    want = {(i, j): len(of[i] & of[j]) for i in of for j in of if i != j and of[i] & of[j]}
    assert {(r.i, r.j): r.shared for r in G.shared_attributes(df).collect()} == want


def test_walks_follow_the_weights(spark):
    """From an item of many edges, targets are reached in proportion to their weights; every step is an edge."""
    edges = [(0, j, float(j)) for j in range(1, 31)] + [(j, 0, 1.0) for j in range(1, 31)]
    df = spark.createDataFrame(edges, "a long, b long, weight double")
    walks = [r.walk for r in R.random_walks(df, per_item=1200, length=4).collect()]
    assert len(walks) == 31 * 1200 and all(len(w) == 4 for w in walks)
    steps = Counter((x, y) for w in walks for x, y in zip(w, w[1:]))
    assert set(steps) <= {(a, b) for a, b, _ in edges}
    seen = Counter({b: n for (a, b), n in steps.items() if a == 0})
    total = sum(seen.values())
    assert sum((seen[j] - total * j / 465) ** 2 / (total * j / 465) for j in range(1, 31)) < 58.3  # 29 degrees of freedom, one in a thousand


def test_item_columns():
    """Numbers, ids and quantities are never the items."""
    assert item_column(["recipe_id", "ingredient_number", "ingredient_name"]) == "ingredient_name"
    assert item_column(["Ingredient quantity", "ingredient_id", "Ingredients"]) == "Ingredients"
    assert item_column(["id", "itemNumber", "itemName", "ingredient_note"]) == "itemName"
    assert item_column(["ingredient_no", "qty"]) is None
    assert item_column(["Name", "amount"]) == "Name"


def test_long_files_with_numbers(spark, tmp_path):
    (tmp_path / "long.csv").write_text("recipe,ingredient_number,ingredient_name\n1,1,egg\n1,2,salt\n2,1,milk\n")
    got = read_source(spark, Source("long", "en", "long", str(tmp_path / "long.csv"), "recipe")).collect()
    assert sorted(r["items"] for r in got) == [["egg", "salt"], ["milk"]]


@pytest.mark.parametrize("shard, block", [(100_000, 50_000), (3, 7)])
def test_many_patterns(spark, monkeypatch, shard, block):
    """Every place of every string, with overlaps; then aliases inside longer terms, and longest substrings from the left."""
    monkeypatch.setattr(patterns, "STRINGS_A_SHARD", shard)
    monkeypatch.setattr(patterns, "TEXTS_A_BLOCK", block)
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("ab面团") for _ in range(n))
    strings = sorted({word(rng.randint(1, 4)) for _ in range(25)})
    texts = sorted({word(rng.randint(1, 12)) for _ in range(60)})
    s = spark.createDataFrame([(x,) for x in [*strings, "", None, strings[0]]], "surface string")
    t = spark.createDataFrame([(x,) for x in [*texts, None, "", texts[0]]], "text string")
    want = {(x, y, i) for x in texts for y in strings for i in range(len(x)) if x.startswith(y, i)}
    got = patterns.occurrences(t, s).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want

    new = [(y, i) for i, y in enumerate(strings)]
    frequent = [(x, 10 + i, i % 5 if i % 2 else None) for i, x in enumerate(texts)]
    hazards = {}
    for y, i in new:
        held = [(d, x) for x, d, b in frequent if y in x and x != y and b != i]
        if held:
            hazards[y, i] = (max(held)[1], max(held)[0])
    rows = C.alias_hazards(spark.createDataFrame(new, "surface string, item_id long"), spark.createDataFrame(frequent, "term string, df long, item_id long")).collect()
    assert {(r.surface, r.item_id): (r.inside, r.df) for r in rows} == hazards

    regex = re.compile("|".join(sorted(map(re.escape, strings), key=len, reverse=True)))
    lines = [(i % 20, x) for i, x in enumerate(texts)]
    found = Counter((i, j) for i, x in lines for j in {strings.index(m) for m in regex.findall(x)})
    out = C.match_unspaced(spark.createDataFrame(lines, "line_id long, line string"), spark.createDataFrame(new, "surface string, item_id long")).collect()
    assert Counter((r.line_id, r.item_id) for r in out) == found


def test_lists_in_transcripts(spark):
    texts = {
        "Here it is.\nYou will need:\n- 2 eggs\n* salt\n3. milk \n\nThen cook.\n- not this": ["eggs", "salt", "milk"],
        "INGREDIENTS: flour\n• water": ["flour", "water"],
        "Ingredients\n\nnothing": [],
        "no list at all": None,
        "ingredients:\n" + "x" * 80 + "\n1. a\nok": ["ok"],
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    turns = df.select(F.monotonically_increasing_id().alias("conv_id"), F.lit(1).alias("turn"), F.lit("assistant").alias("role"), F.col("t").alias("text"))
    got = {tuple(r["items"]) for r in chat_items(turns).collect()}
    assert got == {tuple(x) for x in texts.values() if x and len(x) > 1}
    lines = {r.t: r.l for r in df.select("t", listed(F.col("t")).alias("l")).collect()}
    assert all((lines[t] is None) == (x is None) for t, x in texts.items())


@pytest.mark.parametrize("block", [7, 512])
def test_autoencoder_by_blocks(spark, block):
    """Equal to NumPy over 64 items, whatever the blocks."""
    rng = random.Random(8)
    rows = [(i, sorted({int(64 * rng.random() ** 2) for _ in range(6)})) for i in range(600)] + [(999, [100 + x for x in range(0, 64, 9)])]
    items = sorted({x for _, b in rows for x in b})
    x = np.zeros((len(rows), len(items)))
    for i, (_, b) in enumerate(rows):
        x[i, [items.index(y) for y in b]] = 1
    p = np.linalg.inv(x.T @ x + 10 * np.eye(len(items)))
    want = p / -np.diag(p)
    np.fill_diagonal(want, 0)
    got = np.zeros_like(want)
    for r in R.linear_autoencoder(spark.createDataFrame(rows, "basket_id long, items array<long>"), 10.0, block).collect():
        got[items.index(r.a), items.index(r.b)] = r.weight
    assert np.abs(got - want).max() < 1e-9


def test_singular_values(spark):
    """Within a millionth of NumPy's, vectors orthonormal, the matrix rebuilt from them; a matrix of rank 2; no cells."""
    rng = np.random.default_rng(9)
    full = (rng.normal(size=(90, 12)) * 3.0 ** -np.arange(12)) @ rng.normal(size=(12, 70))
    full[np.abs(full) < 0.05] = 0
    cells = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "a long, b long, value double").repartition(20)
    u, s = M.singular_vectors(cells(full), 6)
    want = np.linalg.svd(full, compute_uv=False)
    assert np.abs(s - want[:6]).max() < 1e-6 * want[0]
    x = np.zeros((90, 6))
    for r in u.collect():
        x[r.a] = r.vec
    assert np.abs(x.T @ x - np.eye(6)).max() < 1e-9
    assert np.abs(np.linalg.norm(x.T @ full, axis=1) - s).max() < 1e-6 * s[0]
    low = np.outer(np.arange(1, 9), np.ones(5)) + np.outer(np.ones(8), np.arange(5))
    assert len(M.singular_vectors(cells(low), 4)[1]) == 2
    assert np.abs(M.singular_vectors(cells(low), 4)[1] - np.linalg.svd(low, compute_uv=False)[:2]).max() < 1e-9
    assert M.singular_vectors(spark.createDataFrame([], "a long, b long, value double"), 3)[1].size == 0


def test_evaluation_queries_exclude_and_add(spark, catalog):
    """None of the added or forbidden items is the basket's; the forbidden one is not in the pantry; some queries have additions."""
    c = spark.createDataFrame(catalog, CATALOG)
    got = S.evaluation_queries(c).collect()
    assert got
    for r in got:
        kept = set(r.available) & set(r["items"])
        assert len(r["items"]) - len(kept) == r.max_missing and len(set(r.available) - kept) <= 2
        assert set(r.must_use) <= kept and len(r.exclude) == 1 and not set(r.exclude) & (set(r["items"]) | set(r.available))
    assert {len(set(r.available) - set(r["items"])) for r in got} == {0, 1, 2}


def test_cards_warn(spark):
    rows = spark.createDataFrame([(1, 10, 1, 0.5, [1, 2], [1], None, 2.0), (2, 11, 1, 0.4, [1], [1], 5.0, None)], "query_id long, basket_id long, rank int, score double, items array<long>, pantry array<long>, total_minutes double, servings double")
    texts = spark.createDataFrame([(10, "t", "count_mismatch"), (11, "u", None)], "basket_id long, title string, quantity_status string")
    queries = spark.createDataFrame([(1, [9]), (2, None)], "query_id long, exclude array<long>")
    scanned = spark.createDataFrame([(1, False), (2, True), (2, True)], "query_id long, truncated boolean")
    got = {r.query_id: r.warnings for r in S.result_cards(rows, texts, queries, scanned).collect()}
    assert got == {1: ["time unknown", "items missing", "exclusions are not allergen-safe", "quantities: count_mismatch"], 2: ["servings unknown", "search was truncated"]}
