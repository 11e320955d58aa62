"""Operators over documents against brute force, and their edge cases."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from wicker.llm import bpe, components, fingerprints, hidden_markov, lm_scoring, mixing, near_dedup, quality, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]


def made_texts(n=80, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeiourst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    for i in range(0, n, 6):  # near copies
        w = texts[i].split()
        for _ in range(max(1, len(w) // 50)):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    passage = " ".join(rng.choice(vocabulary) for _ in range(50))
    texts += [f"{t}\n{passage} {t[:20]}" for t in texts[:12]]
    return texts + texts[:5] + [None, "", "  \n\t ", "one", "Two words", "ONE", "é ü 漢字 x y z", passage.upper(), "a b " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", "S3", None][i % 4], len(t or "")) for i, t in enumerate(made_texts())]
    rows += [rows[3], (None, rows[4][1], "en", "s1", 1)]  # a repeated row and one without an id
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def odd(docs):
    """Extra columns with names that the operators use themselves."""
    return docs.withColumns({c: F.lit(1) for c in ("key", "th", "size", "h", "bucket", "label", "node", "chunk", "w", "position", "row", "score")})


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(docs, rows):
    sets = [shingles(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    want = Counter((r.doc_id, len(sets[i]), least.get(find(i))) for i, r in enumerate(rows))
    got = near_dedup.near_duplicates(odd(docs)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def odd_ids(spark):
    """Null ids, one id with two texts, a repeated row, copies, and empty documents with labels."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (1, b), (None, c), (None, d), (2, a), (None, b), (3, d + " end"), (3, d + " end"), (4, ""), (None, None), (None, " "), (4, "")]
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3), (a, b, c, d)


def test_without_near_duplicates_drops_only_duplicates(spark):
    docs, (a, b, c, d) = odd_ids(spark)
    out = near_dedup.without_near_duplicates(odd(docs))
    assert out.columns == odd(docs).columns
    want = [(1, a), (1, b), (None, c), (3, d + " end"), (4, ""), (4, ""), (None, None), (None, " ")]
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(want)


@pytest.mark.parametrize("local", [3, 500_000])
def test_components(spark, monkeypatch, local):
    """With local forests of a few links each and alternating stars, and with one local forest."""
    monkeypatch.setattr(components, "LOCAL_LINKS", local)
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 130)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7), (500, 400), (400, 500)]
    root = {v: v for e in edges if e[0] != e[1] for v in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    got = [tuple(r) for r in components.connected_components(df).collect()]
    assert len(got) == len(root) and dict(got) == root
    assert components.connected_components(df.where("false")).collect() == []


@pytest.mark.parametrize("deepest", [1, 8])
def test_near_duplicates_in_large_nodes(spark, monkeypatch, deepest):
    """Small leaves force centres, contraction and deep branches (or, at once, all the groups of centres); the links stay whole."""
    for name, value in (("LEAF", 2), ("CENTERS", 4), ("BLOCK_SETS", 8), ("DEEPEST", deepest)):
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    texts = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w + [f"y{i}{j}" for j in range((i % 3) * 30)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    sets = [shingles(t) for t in texts]
    root = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(60):
                if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    assert got == dict(enumerate(root))


def test_substring_dedup(docs, rows):
    counts = Counter()
    for r in rows:
        w = words(r.text)
        counts.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = Counter()
    for r in rows:
        w = words(r.text)
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if counts[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        want[r.doc_id, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()] += 1
    got = substring_dedup.remove_repeated(odd(docs), digests=True).collect()
    assert Counter(tuple(r) for r in got) == want
    assert sum(r.n_removed for r in got) > 0


def test_substring_dedup_keeps_columns(docs):
    out = substring_dedup.without_repeated(docs)
    assert out.columns == docs.columns
    assert out.count() == docs.count()


def test_fingerprints(docs, rows):
    got = fingerprints.fingerprint_neighbours(odd(docs), rows_per_bucket=7).collect()
    assert len(got) == len(rows)
    known = sorted((r for r in rows if r.doc_id is not None), key=lambda r: -r.doc_id)
    by_id = {r.doc_id: r for r in got}
    for r, after in zip(known, known[1:]):
        text, later = r.text or "", after.text or ""
        if r.doc_id == after.doc_id:
            continue
        third = len(text) // 3
        edited = text[: len(text) - third] + later[:third]
        mine = by_id[r.doc_id]
        assert mine.n_chars == len(text)
        if r.doc_id != 3 and after.doc_id != 3:
            assert mine.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert mine.near_edited == pytest.approx(fingerprints.likeness(fingerprints.winnow(text)[0], fingerprints.winnow(edited)[0]))
    same = {}
    for r in rows:
        same.setdefault(r.text or "", set()).add(by_id[r.doc_id].fingerprint if r.doc_id in by_id else None)
    assert all(len(x) == 1 for x in same.values())


def test_winnow_guarantee():
    rng = random.Random(5)
    for _ in range(50):
        common = "".join(rng.choice("abcdef ") for _ in range(fingerprints.WINDOW + fingerprints.K - 1))
        texts = ["".join(rng.choice("ghijkl") for _ in range(rng.randint(0, 200))) + common + "".join(rng.choice("mnop") for _ in range(rng.randint(0, 200))) for _ in range(2)]
        a, b = (set(fingerprints.winnow(t)[0].tolist()) for t in texts)
        assert a & b


def test_short_texts_know_their_edited_copies():
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz äöü漢字"
    made = lambda n: "".join(rng.choice(letters) for _ in range(n))
    winnow, alike = fingerprints.winnow, fingerprints.likeness
    for n in [*range(1, 140), 200, 399]:
        for after in (made(n), made(n // 6), "", made(300)):
            text = made(n)
            edited = text[: n - n // 3] + after[: n // 3]
            near = alike(winnow(text)[0], winnow(edited)[0])
            assert near > 0, n
            assert n < 12 or near > alike(winnow(text)[0], winnow(after)[0]), n


def test_winnow_takes_rightmost_of_equal():
    hashes, where = fingerprints.winnow("a" * 200)
    assert len(set(hashes.tolist())) == 1
    n = 200 - fingerprints.K + 1
    assert where.tolist() == list(range(fingerprints.WINDOW - 1, n))


def test_quality(docs, rows):
    got = Counter(tuple(r)[:7] for r in quality.quality_rules(odd(docs)).collect())
    want = Counter()
    for r in rows:
        t = r.text or ""
        w = words(t)
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = set()
        for i in range(len(w) - 7):
            if c[tuple(w[i : i + 8])] > 1:
                covered |= set(range(i, i + 8))
        lines = [x for x in t.split("\n") if words(x)]
        want[r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)] += 1
    assert got == want


def test_quality_fences(spark):
    good = [(i, " ".join(f"word{(i * 31 + j) % 97}" for j in range(40)), "en", "s", 1) for i in range(60)]
    bad = [(100, " ".join(f"wo{j} ###" for j in range(40)), "en", "s", 1), (101, "x " * 8, "en", "s", 1)]
    kept = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(good + bad, SCHEMA)).collect()}
    assert all(kept[i] for i in range(60)) and not kept[100] and not kept[101]


def test_quality_fence_on_repeats(spark):
    """Where nobody repeats, a text with a quarter of its words repeated passes the base rule and fails the fence."""
    good = [(i, " ".join(f"word{(i * 31 + j) % 997}" for j in range(80)), "en", "s", 1) for i in range(60)]
    repeats = " ".join([f"w{j}" for j in range(60)] + [f"w{j}" for j in range(10)])
    rows = spark.createDataFrame([*good, (100, repeats, "en", "s", 1)], SCHEMA)
    got = {r.doc_id: r for r in quality.quality_rules(rows).collect()}
    assert not got[100].base_failed and 0.25 < got[100].n_repeat_words / got[100].n_words < 0.3
    assert not got[100].kept and all(got[i].kept for i in range(60))


def water_fill(sizes, weights):
    total, caps = 1.5 * sum(sizes), [2 * s for s in sizes]
    targets = [0.0] * len(sizes)
    free, left = set(range(len(sizes))), total
    while free:
        level = left / sum(weights[i] for i in free)
        over = [i for i in free if level * weights[i] > caps[i]]
        if not over:
            for i in free:
                targets[i] = level * weights[i]
            break
        for i in over:
            targets[i] = caps[i]
            left -= caps[i]
            free.discard(i)
    return targets


def test_mixing(docs, rows):
    got = mixing.mix(odd(docs)).collect()
    size = Counter()
    for r in rows:
        size[r.source] += len(words(r.text))
    names = sorted((s for s in size if s is not None)) + [None]
    want = dict(zip(names, water_fill([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    source = {r.doc_id: r.source for r in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in names)
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert [r.position for r in got] == sorted(r.position for r in got)


def test_mixed_documents(docs):
    one = docs.dropDuplicates(["doc_id"]).where("doc_id is not null")
    plan = {r.doc_id: r for r in mixing.mix(one).collect()}
    copies = Counter()
    for r in mixing.mixed_documents(one).collect():
        copies[r.doc_id] += len(words(r.text))
    assert {k: v for k, v in copies.items()} == {k: r.taken for k, r in plan.items() if r.taken}


def test_mixed_documents_by_row(spark):
    """Words taken are words given, for null and repeated ids too."""
    docs, texts = odd_ids(spark)
    taken = sum(r.taken for r in mixing.mix(docs).collect())
    got = mixing.mixed_documents(odd(docs)).collect()
    assert sum(len(words(r.text)) for r in got) == taken == math.ceil(1.5 * sum(len(words(r.text)) for r in docs.collect()))
    # one source at 150 %: each row has a first copy
    first = Counter((r.doc_id, r.text) for r in docs.collect() if words(r.text))
    assert not first - Counter((r.doc_id, r.text) for r in got)


@pytest.fixture(scope="module")
def encoding():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, rows, encoding):
    got = bpe.encode(odd(docs), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == Counter((r.doc_id, tuple(encoding.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in rows)
    for r in got[:20]:
        pieces = [encoding.decode_single_token_bytes(i) for i in r.ids]
        assert r.offsets == np.cumsum([0, *map(len, pieces)])[:-1].tolist()


def thue_morse():
    """Two texts of one word each of 1,024 letters: a polynomial modulo 2**64 gives both one hash, whatever its base."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse(spark, encoding):
    one, two = thue_morse()
    rows = [(0, one), (1, two), (2, f"{one} {'x ' * 34}"), (3, f"{two} {'x ' * 34}"), (4, f"{one} {'x ' * 34}")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).coalesce(1)
    got = {r.doc_id: r for r in bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    assert all(list(got[i].ids) == encoding.encode_ordinary(t) and bytes(got[i].decoded) == t.encode() for i, t in rows)
    groups = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert groups == {0: 0, 1: 1, 2: 2, 3: 3, 4: 2}
    removed = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeated(docs, digests=True).collect()}
    assert removed == {0: 0, 1: 0, 2: 35, 3: 0, 4: 35}
    known = {r.doc_id: r.n_known for r in lm_scoring.score(docs.where("doc_id < 2"), F.col("doc_id") == 1).collect()}
    assert known == {0: 2, 1: 1}


def test_equal_hashes_of_unequal_slices(encoding, monkeypatch):
    """Slices that share a hash are told apart by their bytes."""
    monkeypatch.setattr(bpe, "byte_hashes", lambda raw, starts, ends: ((ends - starts) % 2).astype(np.uint64))
    merger = bpe.Merger(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for text in ("the cat and the dog", "one, two; three", "the cat"):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert merger.encode(raw, np.array([0, len(raw)]))[0].tolist() == encoding.encode_ordinary(text)


def test_bpe_on_odd_texts(encoding):
    merger = bpe.Merger(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(2)
    letters = "'strevmlld  \n\t\r  aZ9٣éß漢🙂#.,́-ſ½\x1c\x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    texts += ["'re've'll'r'v'lx", "'s'sabc", "x''s", "  'll  \n a", "a \n", "   ", "", "'" * 5 + "re", "'l'l", "'vE", "\n's", "<|endoftext|>"]
    raw = [t.encode() for t in texts]
    ids, _, of = merger.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [ids[of[i] : of[i + 1]].tolist() for i in range(len(texts))] == [encoding.encode_ordinary(t) for t in texts]


def test_lm_scores(docs, rows):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    got = lm_scoring.score(odd(docs), held).collect()
    assert len(got) == len(rows)
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    train = [r for r in rows if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    c = Counter(w for r in train for w in [*words(low(r.text)), ""])
    n, v = sum(c.values()), len(c)
    text = {r.doc_id: r.text for r in rows}
    for r in got:
        w = [*words(low(text[r.doc_id])), ""]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert math.isfinite(r.score) and r.score < 0


def test_lm_score_is_the_models(spark, monkeypatch):
    """The returned score: the forward recursion in plain Python over the trained model, shared symbols drawn by their counts plus one."""
    monkeypatch.setattr(lm_scoring, "OWN", 3)
    monkeypatch.setattr(lm_scoring, "HELD", 5)
    kept = []
    train = lm_scoring.train
    monkeypatch.setattr(lm_scoring, "train", lambda *a: kept.append(train(*a)) or kept[-1])
    texts = ["a b c a b d", "a a b c ed ed", "", "zz a b fed", "bed a c c", "new a words here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.score for r in lm_scoring.score(docs, F.col("doc_id") == 5).collect()}
    c = Counter(w for t in texts[:5] for w in t.split())
    _, lexicon, _ = lm_scoring.learn_lexicon(docs.where("doc_id <> 5").select(F.col("text").cast("binary").alias("text")))
    model = kept[0]
    for i, t in enumerate(texts):
        raw, offs = lm_scoring.column_bytes(lm_scoring.pa.array([t.encode()], lm_scoring.pa.binary()))
        ((_, _, words_),) = lm_scoring.words_of(raw, offs, 1 << 30)
        symbols, _, _, _, shared = lm_scoring._sequences(words_, lexicon)
        p = model.first * model.emits[symbols[0]]
        for s in symbols[1:]:
            p = p @ model.moves * model.emits[s]
        want = math.log10(p.sum())
        for j, (w, s) in enumerate(zip(t.split(), symbols)):
            if j in shared:
                want += math.log10((c[w] + 1) / lexicon.shared_mass[s - lexicon.own])
        assert got[i] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("lane", [1, 2, 3, 512])
def test_forward_recursion_is_exact(lane):
    rng = np.random.default_rng(1)
    k, m = 3, 6
    norm = lambda x: x / x.sum(-1, keepdims=True)
    model = hidden_markov.Model(norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((k, m))).T)
    symbols = rng.integers(0, m, 9)
    of = np.array([0, 4, 9])
    got = hidden_markov.log10_likelihood(symbols, of, model, lane)
    for i in range(2):
        seq = symbols[of[i] : of[i + 1]]
        total = 0.0
        for path in np.ndindex(*[k] * len(seq)):
            p = model.first[path[0]] * model.emits[seq[0], path[0]]
            for a, b, s in zip(path, path[1:], seq[1:]):
                p *= model.moves[a, b] * model.emits[s, b]
            total += p
        assert got[i] == pytest.approx(math.log10(total))


@pytest.mark.parametrize("lane", [1, 2, 3, 512])
def test_forward_backward_counts(lane):
    rng = np.random.default_rng(2)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    k, m = 2, 4
    model = hidden_markov.Model(norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((k, m))).T.astype(np.float32))
    symbols, of = rng.integers(0, m, 7), np.array([0, 3, 7])
    first, moved, emitted = hidden_markov.forward_backward(symbols, of, model, lane)
    want_first, want_moved, want_emitted = np.zeros(k), np.zeros((k, k)), np.zeros((m, k))
    for i in range(2):
        seq = symbols[of[i] : of[i + 1]]
        paths = {}
        for path in np.ndindex(*[k] * len(seq)):
            p = model.first[path[0]] * model.emits[seq[0], path[0]]
            for a, b, s in zip(path, path[1:], seq[1:]):
                p *= model.moves[a, b] * model.emits[s, b]
            paths[path] = p
        z = sum(paths.values())
        for path, p in paths.items():
            want_first[path[0]] += p / z
            for a, b in zip(path, path[1:]):
                want_moved[a, b] += p / z
            for s, a in zip(seq, path):
                want_emitted[s, a] += p / z
    np.testing.assert_allclose(first, want_first, rtol=1e-4)
    np.testing.assert_allclose(moved, want_moved, rtol=1e-4)
    np.testing.assert_allclose(emitted, want_emitted, rtol=1e-4)


def test_lm_training_covers_whole_texts(spark, monkeypatch):
    """Every sweep is over every text, however many or long: the model is that of sweeps done here, over texts in one piece."""
    monkeypatch.setattr(lm_scoring, "SWEEPS", 3)
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n)) for n in (0, 1, 5, 127, 128, 129, 400, 6000)]
    docs = spark.createDataFrame([(i, t, t.encode(), False) for i, t in enumerate(texts)], "doc_id long, whole string, text binary, held_out boolean").repartition(3)
    _, lexicon, shares = lm_scoring.learn_lexicon(docs.select("text"))
    shape = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, drawn double, rare array<long>, symbols binary"
    encoded = docs.select("doc_id", "held_out", "text").mapInArrow(lm_scoring._encode(spark.sparkContext.broadcast(lexicon)), shape)
    got = lm_scoring.train(encoded, shares)
    raw, offs = lm_scoring.column_bytes(lm_scoring.pa.array([t.encode() for t in texts], lm_scoring.pa.binary()))
    ((_, _, words_),) = lm_scoring.words_of(raw, offs, 1 << 30)
    symbols, of, *_ = lm_scoring._sequences(words_, lexicon)
    n = lexicon.end_symbol + 1
    unigram = np.bincount(symbols, minlength=n) + 0.01
    unigram /= unigram.sum()
    np.testing.assert_allclose(shares, unigram)
    want = lm_scoring._start(unigram)
    for _ in range(3):
        first, moved, emitted = hidden_markov.forward_backward(symbols, of, want, 1 << 20)
        assert moved.sum() == pytest.approx(len(symbols) - len(texts), rel=1e-4) and first.sum() == pytest.approx(len(texts), rel=1e-4)
        want = lm_scoring._maximise(np.vstack([emitted, moved, first]), unigram, lm_scoring.STATES)
    np.testing.assert_allclose(got.first, want.first, rtol=1e-3)
    np.testing.assert_allclose(got.moves, want.moves, rtol=1e-3)
    np.testing.assert_allclose(got.emits, want.emits, rtol=2e-3)


def test_toxicity(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeiourst") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    bad = ["vilescum", "rottenfool", "grubbler"]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, "."), rows[0]], "doc_id long, text string")
    taught = spark.createDataFrame([*labels[:400], (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(odd(docs), taught).collect()}
    assert len(got) == 603
    wrong = sum(got[i].predicted != y for i, y in labels[400:])
    assert wrong <= 4
    assert all(got[i].predicted == 0 for i in (1000, 1001, 1002))
    assert all(0 <= r.score <= 1 for r in got.values())
    clean = toxicity.without_toxic(docs, taught)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if r.predicted == 0}
    elsewhere = spark.createDataFrame([(5000, 1), (5001, 0)], "doc_id long, toxic int")
    assert all(r.predicted == 0 for r in toxicity.toxicity(docs, elsewhere).collect())
    none = toxicity.toxicity(docs, taught.where("false")).collect()
    assert len(none) == docs.count() and all(r.predicted == 0 for r in none)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for out in (
        near_dedup.near_duplicates(empty),
        substring_dedup.remove_repeated(empty),
        fingerprints.fingerprint_neighbours(empty),
        quality.quality_rules(empty),
        mixing.mix(empty),
        bpe.encode(empty, path),
        lm_scoring.score(empty, F.lit(False)),
        toxicity.toxicity(empty, labels),
    ):
        assert out.collect() == []


def test_very_long_texts(spark):
    """A text of more bytes than the operators take at a time, and one that differs in its end."""
    n = 250_000
    long = " ".join([f"w{i}" for i in range(n)])
    assert len(long) > 1 << 20
    rows = [(1, long, "en", "a", len(long)), (2, "a short one", "en", "b", 11), (3, long + " tail", "en", "a", len(long) + 5)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    by_id = lambda df: {r.doc_id: r for r in df.collect()}
    near = by_id(near_dedup.near_duplicates(docs))
    assert {i: (r.n_shingles, r.component_id) for i, r in near.items()} == {1: (n - 4, 1), 2: (1, 2), 3: (n - 3, 1)}
    kept = by_id(substring_dedup.remove_repeated(docs))
    assert (kept[1].n_removed, kept[1].text, kept[3].n_removed, kept[3].text, kept[2].text) == (n, "", n, "tail", "a short one")
    assert {i: r.n_words for i, r in by_id(quality.quality_rules(docs)).items()} == {1: n, 2: 3, 3: n + 1}
    mixed = by_id(mixing.mix(docs))
    assert all(r.taken <= 2 * r.size for r in mixed.values()) and mixed[1].size == n
    scored = by_id(lm_scoring.score(docs, F.col("doc_id") == 2))
    assert {i: r.n_tokens for i, r in scored.items()} == {1: n + 1, 2: 4, 3: n + 2} and all(math.isfinite(r.score) for r in scored.values())
    prints = by_id(fingerprints.fingerprint_neighbours(docs))
    assert prints[3].near_edited > 0.5 and prints[1].n_chars == len(long)
    tokens = by_id(bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), digests=True))
    assert {i: r.decoded_sha256 for i, r in tokens.items()} == {r[0]: hashlib.sha256(r[1].encode()).hexdigest() for r in rows}
    assert len(toxicity.toxicity(docs, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")).collect()) == 3


def test_without_toxic_keeps_odd_rows(spark):
    """Null ids, one id with two texts, repeated rows and clashing columns: rows stay or go by their own text."""
    docs, (a, b, c, d) = odd_ids(spark)
    labels = spark.createDataFrame([(1, 0), (2, 0), (None, 1)], "doc_id long, toxic int")
    out = toxicity.without_toxic(odd(docs), labels)
    assert out.columns == odd(docs).columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((r.doc_id, r.text) for r in docs.collect())
    assert toxicity.without_toxic(docs.where("false"), labels).collect() == []


def test_winnowing_against_brute_force():
    """Selected positions by the definition: of every window of grams the smallest hash, of equal ones the rightmost."""
    rng = random.Random(11)
    for size in (100, 150, 400):
        text = "".join(rng.choice("abc") for _ in range(size))
        hashes, where = fingerprints.winnow(text)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        n = size - fingerprints.K + 1
        grams = [int(fingerprints.span_hashes(points, np.array([i]), np.array([i + fingerprints.K]))[0] >> np.uint64(32)) for i in range(n)]
        want = {min(range(s, s + fingerprints.WINDOW), key=lambda i: (grams[i], -i)) for s in range(n - fingerprints.WINDOW + 1)}
        assert where.tolist() == sorted(want) and hashes.tolist() == [grams[i] for i in sorted(want)]


@pytest.mark.parametrize("tasks", [1, 16, 17, 700])
def test_arrays_are_added_in_rounds(spark, tasks):
    """No group adds more than FAN_IN arrays, however many tasks there are."""
    rows = [(i, np.array([i, 1.0]).tobytes()) for i in range(tasks) if i % 5]
    sums = toxicity.added(spark.createDataFrame(rows, "slot long, sums binary"), tasks)
    assert np.array_equal(sums + np.zeros(2), [sum(i for i, _ in rows), len(rows)])
