"""Vector codes, token counts and source divergence against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from wicker.llm import divergence, token_counts, vector_codes

PATH = public_tokenizers.path("piece_bpe_32k.model")


# vector codes


def brute_codes(rows):
    """Rows of (id, vector, label) -> the rows of the contract, by exhaustive assignment."""
    rows = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    rows = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v], label) for i, v, label in rows]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1])
    rows = [r for r in rows if len(r[1]) == width]
    d = width // 16
    x = np.array([r[1] for r in rows], np.int64).reshape(len(rows), 16, d)
    books = x[:64].copy()

    def assign():
        dist = ((x[:, None] - books[None]) ** 2).sum(-1)
        return dist.argmin(1), dist.min(1)

    for _ in range(2):
        code, _ = assign()
        for p in range(16):
            for e in range(len(books)):
                if (mine := code[:, p] == e).any():
                    books[e, p] = x[mine, p].sum(0) // mine.sum()
    code, error = assign()
    sha = hashlib.sha256(",".join(str(v) for p in range(16) for e in range(len(books)) for v in books[e, p]).encode()).hexdigest()
    by = Counter()
    for r, e in zip(rows, error):
        by[r[2]] += int(e.sum())
    return Counter((r[0], "".join(f"{c:02x}" for c in cs), int(e.sum()), by[r[2]], sha) for r, cs, e in zip(rows, code, error))


def odd_vectors(n, seed=3, width=32):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, 0.3, width).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    for i in range(0, n, 7):  # equal vectors, and many small values, so that distances tie
        rows[i] = (i, np.round(np.array(rows[i][1]) * 4).tolist(), rows[i][2])
    for i in range(0, n, 11):
        rows[i] = (i, rows[0][1], None)
    bad = list(rows[0][1])
    rows += [rows[2], (None, rows[4][1], 1), (3, rows[5][1], None), (n + 1, None, 1), (n + 2, [], 2), (-5, [None, *bad[1:]], 1)]
    rows += [(-6, [float("nan"), *bad[1:]], 1), (-7, [float("inf"), *bad[1:]], 1), (2, bad[:16], 1), (n + 4, [-700.0] * width, 1)]
    return rows


@pytest.mark.parametrize("n", [6, 400])
def test_vector_codes(spark, monkeypatch, n):
    monkeypatch.setattr(vector_codes, "BLOCK", 64)
    rows = odd_vectors(n)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    df = df.withColumns({c: F.lit(1) for c in ("ids", "labels", "code", "of", "points", "value")})
    got = vector_codes.vector_codes(df).collect()
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == brute_codes(rows)


def test_trees_save_distances():
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (40, 64))
    x = centres[rng.integers(0, 40, 4000)] + rng.integers(-3, 4, (4000, 64))
    trees = vector_codes.CoverTrees.build(x)
    books = np.stack([centres[:, p * 4 : p * 4 + 4] for p in range(16)])
    entry, taken = trees.assign(books)
    parts = x.reshape(4000 * 16, 4)[trees.order]
    assert (parts == trees.points).all()
    want = vector_codes.squared(parts[:, None], books[np.arange(len(parts)) // 4000]).argmin(1)
    assert (entry == want).all()
    assert taken < 0.2 * len(parts) * 40


def test_tree_is_a_cover_tree():
    x = np.random.default_rng(2).integers(-100, 100, (700, 32))
    t = vector_codes.CoverTrees.build(x)
    for i in range(len(t.lo)):
        points = t.points[t.lo[i] : t.hi[i]]
        assert np.sqrt(vector_codes.squared(points, points[0]).max()) == t.radius[i]
        children = range(t.child[i], t.child[i + 1])
        if children:
            scale = 2.0 ** (np.ceil(np.log2(t.radius[i])) - 1)
            assert t.lo[children[0]] == t.lo[i] and t.hi[children[-1]] == t.hi[i]
            assert all(t.hi[a] == t.lo[a + 1] for a in children[:-1])
            assert all(t.radius[a] <= scale for a in children)
            centres = t.points[t.lo[list(children)]]
            assert all(vector_codes.squared(centres[a + 1 :], centres[a]).min(initial=1e9) > scale * scale for a in range(len(centres)))


def test_vector_codes_need_equal_parts(spark):
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1.0] * 17, 0)], "vec_id long, embedding array<float>, label int"))


# token counts


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts():
    rng = random.Random(5)
    alphabet = "abcdefghij klmnopqrstuvwxyz \n ABC 012é漢🤯▁"
    texts = ["", " ", "  ", "   a", "a   ", "hello  world <s> <0x0A> \n x\ty ▁▁ é 漢 ", "a" * 5000, "ab" * 3000, " " * 3001, "▁" * 77, "\0a\0", "x́" * 300, "🤯" * 100]
    texts += ["</s><unk>", "thequickbrownfoxjumpsoverthelazydog" * 300, "ſﬁÅ", "\r\n\x0b\x85　"]
    return texts + ["".join(rng.choice(alphabet[:k]) for _ in range(rng.randint(1, 400))) for k in (3, 5, 9, 12, 20, 40) for _ in range(60)]


def test_token_counts(spark, model):
    texts = [*odd_texts(), None]
    rows = [(None if i == 3 else i, t) for i, t in enumerate(texts)] + [(5, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in ("id", "n_tokens", "n_bytes")})
    got = token_counts.token_counts(df, PATH, limit=500).collect()
    want = Counter((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 500) for i, t in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def counted(transducer, texts):
    parts = [t.encode() for t in texts]
    offs = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64)
    return transducer.counts(np.frombuffer(b"".join(parts), np.uint8), offs).tolist()


@pytest.mark.parametrize("chunk, most", [(3, 10**6), (64, 50)])
def test_chunks_and_forgotten_states(model, monkeypatch, chunk, most):
    """Maps of very short chunks compose; states are forgotten between batches without a change."""
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    monkeypatch.setattr(token_counts, "MOST_STATES", most)
    transducer = token_counts._transducer(PATH)
    texts = odd_texts()[:60]
    for part in (texts[:30], texts[30:], texts):
        assert counted(transducer, part) == [len(model.encode(t)) for t in part]


def test_long_texts_by_slab(model, monkeypatch):
    monkeypatch.setattr(token_counts, "SLAB", 1000)
    transducer = token_counts._transducer(PATH)
    rng = random.Random(2)
    for text in ("".join(rng.choice("ab cdé漢🤯 \n") for _ in range(20000)), "a" * 50_001, " a" * 9000):
        assert counted(transducer, [text]) == [len(model.encode(text))]


def test_last_tokens_follow_from_neighbours():
    """The rule on which the states rest, against merging itself, on a small model with equal scores."""
    pieces = ["▁", "a", "b", "c", "ab", "ba", "abc", "aa", "aab", "bb", "cab", "▁a", "▁ab"]
    transducer = token_counts.Transducer({p: -float(i // 2) for i, p in enumerate(pieces)})
    rng = random.Random(4)
    texts = ["".join(rng.choice("aabbc ") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    assert counted(transducer, texts) == [len(transducer.merged("▁" + t.replace(" ", "▁"))) for t in texts]


# source divergence


def brute_divergence(rows, least):
    terms = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for text, lang, source in rows]
    documents, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, c in terms:
        documents[lang].update(c.keys())
        counts[lang, source].update(c)
        sources[lang].add(source)
    out = []
    for lang, names in sources.items():
        kept = [t for t, n in documents[lang].items() if n >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in names}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 2) // (total[s] + 2 * len(kept)) for t in kept} for s in names}
        q = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in names) + 2) // (sum(total.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in names:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in names if o != s]
            words = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", words, 10)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, o, v, i + 1) for i, (o, v) in enumerate(items[:most])]
    return Counter(out)


@pytest.mark.parametrize("at_once, a_block", [(256, 2048), (7, 20)])
def test_source_divergence(spark, monkeypatch, at_once, a_block):
    monkeypatch.setattr(divergence, "TERMS_AT_ONCE", at_once)
    monkeypatch.setattr(divergence, "COLUMNS_AT_ONCE", 3 * at_once)
    monkeypatch.setattr(divergence, "TERMS_A_BLOCK", a_block)
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 4))) for _ in range(90)] + ["ABC", "É", "don't", "x1y"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for _ in range(400):
        source = rng.choice(["s0", "s0", "s0", "s1", "é", "", None])
        shift = 5 if source == "s1" else 0
        text = " ".join(rng.choices(words[shift:] + words[:shift], weights, k=rng.randint(0, 40)))
        rows.append((text, rng.choice(["en", "de", None]), source))
    rows += [rows[0]] * 30 + [(None, "en", "s1"), ("only here", "xx", "alone"), ("", "yy", "a"), ("12 34", "yy", "b"), ("same\n" * 20_000, "en", "s0")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    df = df.withColumns({c: F.lit(1) for c in ("term", "n", "documents", "block", "kept", "total", "rank")})
    got = divergence.source_divergence(df).collect()
    assert Counter(tuple(r) for r in got) == brute_divergence(rows, 10)


def test_prices_of_large_counts():
    """Counts beyond 64 bits once multiplied."""
    assert divergence.price(10**13, 2 * 10**13, 5) == 1 + 10**9 * (10**13 + 2) // (2 * 10**13 + 10)
    counts = np.array([[10**13, 5], [7, 10**12]])
    totals = [10**13 + 7, 10**12 + 5]
    p = [[divergence.price(int(counts[t, s]), totals[s], 2) for s in (0, 1)] for t in (0, 1)]
    assert divergence.joint_values(counts, totals, 2)[0, 1] == sum((a - b) ** 2 // (a + b) for a, b in p)


def test_empty_tables(spark):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_codes.vector_codes(vectors).collect() == []
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert token_counts.token_counts(docs, PATH).collect() == []
    assert divergence.source_divergence(docs).collect() == []
