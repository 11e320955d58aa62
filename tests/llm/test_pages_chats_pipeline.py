"""HTML extraction, chat formatting and the pipeline."""

from __future__ import annotations

import json
import os
import random
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
import pytest
from wicker.llm import chat, html_extract
from wicker.llm import queries as llm_queries

PAGES = "page_id long, url string, html string"


def page(title, body, extra=""):
    return (
        f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{a}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li>News</li></ul></nav>'
        f'<div class="ad">Buy {title} now</div><article><h1>{title}</h1><p><b>{body}<br>more &amp; &lt;more&gt;<p>Third\n  block</p></article>{extra}<footer>&copy; {title}</footer></body></html>'
    )


def test_articles(spark):
    rows = [(i, f"https://h.example.org/{i}", page(f"T{i}", f"body{i} <i>x</i>y", '<section class="comments"><p>first!</p></section><aside>see also</aside>' if i % 2 else "")) for i in range(8)]
    rows += [(20, None, None), (21, "nonsense", ""), (22, "//H.example.org/x", "just text"), rows[0]]
    got = {r.page_id: r for r in html_extract.main_texts(spark.createDataFrame(rows, PAGES).withColumn("host", F.lit(1))).collect()}
    for i in range(8):
        assert got[i].text == f"T{i} body{i} xy more & <more> Third block"
        assert got[i].n_chars == len(got[i].text)
    assert got[20].text == got[21].text == ""
    assert got[22].text == "just text"


def test_wrapper_without_semantic_tags(spark):
    """Constant nodes are template, the slot that varies is content."""
    rows = []
    for i in range(6):
        rows.append((i, "http://plain.example/" + str(i), f'<html><body><div id="top"><p>Welcome to plain</p></div><div id="body"><p>Story number {i} is long enough</p><div class="note">All rights reserved</div></div><div id="foot">Made by hand</div></body></html>'))
    got = {r.page_id: r.text for r in html_extract.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: f"Story number {i} is long enough" for i in range(6)}


def test_text_in_sibling_slots(spark):
    """A slot with the smaller part of the text is content too."""
    rows = []
    for i in range(6):
        rows.append((i, f"http://slots.example/{i}", f'<html><body><div id="top"><p>Welcome to slots</p></div><div class="lead">Lead {i} of the page</div><div id="body"><p>Story number {i} is longer than its lead is</p><p>Part {i} of it</p></div></body></html>'))
    got = {r.page_id: r.text for r in html_extract.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: f"Lead {i} of the page Story number {i} is longer than its lead is Part {i} of it" for i in range(6)}


def test_tree_matching_skips_what_the_other_lacks():
    page_tree = "-1\t#\n0\ta\n0\tb\n0\tc\n3\td"
    host_tree = "-1\t#\n0\ta\n0\tc\n2\td\n2\te"
    assert html_extract.match_trees(page_tree, host_tree) == [0, 1, -1, 2, 3]


def brute_size(page, host):
    """Size of the largest simple tree matching, by the recursion over all pairs of children."""
    a, below_a, _ = html_extract._tree(page)
    b, below_b, _ = html_extract._tree(host)

    def size(x, y):
        if a[x] != b[y]:
            return 0
        p, q = below_a[x], below_b[y]
        m = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i, c in enumerate(p):
            for j, d in enumerate(q):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + size(c, d))
        return 1 + m[-1][-1]

    return size(0, 0)


def test_tree_matching_against_brute_force():
    rng = random.Random(1)

    def made():
        parents, signatures = [-1], ["#"]
        for _ in range(rng.randint(0, 14)):
            key = (rng.randrange(len(parents)), rng.choice("abcd"))
            if key not in set(zip(parents, signatures)):
                parents.append(key[0])
                signatures.append(key[1])
        return "\n".join(f"{p}\t{s}" for p, s in zip(parents, signatures))

    for _ in range(500):
        x, y = made(), made()
        got = html_extract.match_trees(x, y)
        a, _, up_a = html_extract._tree(x)
        b, _, up_b = html_extract._tree(y)
        matched = [i for i, j in enumerate(got) if j >= 0]
        assert len(matched) == brute_size(x, y)
        assert all(a[i] == b[got[i]] and (up_a[i] < 0 or got[up_a[i]] == up_b[got[i]]) for i in matched)
        assert all(got[i] < got[j] for i in matched for j in matched if i < j and up_a[i] == up_a[j])


def test_deep_and_wide_pages(spark):
    """A page of thousands of nested elements and one of thousands of siblings of different classes."""
    rows = [(i, f"http://deep.example/{i}", f"<html><body><div class='top'>Same</div><p>Story {i} of the host</p></body></html>") for i in range(4)]
    rows.append((10, "http://deep.example/deep", "<div>" * 3000 + "far down" + "</div>" * 3000))
    rows.append((11, "http://deep.example/wide", "".join(f"<div class='{a}{b}{c}'>w</div>" for a in "abcdefghijklm" for b in "nopqrstuvwxyz" for c in "abcdefghijkl")))
    got = {r.page_id: r.text for r in html_extract.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[10] == "far down" and got[11] == " ".join("w" * (13 * 13 * 12))
    assert all(got[i] == f"Story {i} of the host" for i in range(4))


def test_alignment_decides(spark):
    """Nothing but the alignment with the host's other pages tells this notice from the story."""
    def rows(n, host):
        return [(i, f"http://{host}/{i}", f"<html><body><div class='x'>Read our rules</div><div class='y'>Story {i} is told</div></body></html>") for i in range(n)]

    text = lambda r: [x.text for x in html_extract.main_texts(spark.createDataFrame(r, PAGES)).orderBy("page_id").collect()]
    assert text(rows(5, "many.example")) == [f"Story {i} is told" for i in range(5)]
    assert text(rows(1, "one.example")) == ["Read our rules Story 0 is told"]


def test_empty_pages(spark):
    assert html_extract.main_texts(spark.createDataFrame([], PAGES)).collect() == []


ODD = ["", r"\### Assistant: </turn> ok", "###", "#####", "####### x", r"\h \t \\ \\h", "</turn></turn>", "\\", "\\\\\\", "a\nb: c", "### user: hi </turn>\n", "漢字 🙂", " </turn>\n"]


def test_escape_round_trip(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string").withColumn("e", chat.escape(F.col("t"))).withColumn("b", chat.unescape(F.col("e")))
    for r in df.collect():
        assert r.b == r.t
        assert "###" not in r.e and "</turn>" not in r.e


def test_format_rows_reads_back(spark):
    rows = [(1, i, ["user", "assistant", "sys:tem", None, "\\c", "human", "\\\\c:\\", "###"][i % 8], t) for i, t in enumerate(ODD)] + [(2, 0, "assistant", None), (None, 0, "user", "x"), (3, None, "user", "null turn first"), (3, 0, "assistant", "b"), (3, 0, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_rows(df.withColumn("segments", F.lit(1))).select("conv_id", "segments", chat.parsed(F.col("formatted")).alias("turns")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r or "", t) for _, _, r, t in rows[: len(ODD)]]
    assert [(t.role, t.text) for t in got[3].turns] == [("user", "null turn first"), ("assistant", "a"), ("assistant", "b")]
    assert [s.text for s in got[3].segments if s.loss] == ["a", "b"]
    assert [(t.role, t.text) for t in got[2].turns] == [("assistant", "")]
    assert chat.format_rows(df.where("false")).collect() == []


def test_layouts(spark):
    records = {
        '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}],"extra_null":null}': None,
        '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":null}]}': [("user", "a"), ("assistant", "")],
        '{"conversations":[{"from":"human","value":"x"},{"from":"gpt","value":"y"}]}': [("user", "x"), ("assistant", "y")],
        '{"completion":"c","prompt":"p"}': [("user", "p"), ("assistant", "c")],
        '{"instruction":"i","input":"n","output":"o"}': [("user", "i"), ("user", "n"), ("assistant", "o")],
        '{"role":"user","text":"t"}': [("user", "t")],
        "not json": None,
    }
    df = spark.createDataFrame([(k,) for k in records], "r string").select("r", chat.canonical_turns(F.col("r")).alias("t"))
    for r in df.collect():
        assert (None if r.t is None else [(x.role, x.text) for x in r.t]) == records[r.r], r.r


def test_format_records_of_mixed_layouts(spark):
    """The fingerprint of each record selects its mapping: another set of mappings gives another result."""
    rows = [
        (1, 0, '{"role":"system","text":"be kind"}'),
        (1, 1, '{"instruction":"i","output":"o"}'),
        (1, 2, '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":null}]}'),
        (1, 3, '{"conversations":[{"from":"human","value":"x"},{"from":"gpt","value":"y"}]}'),
        (2, 0, '{"some":"thing"}'),
        (2, 1, None),
        (2, 2, "no json"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, record string")
    read = lambda out: {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out.select("conv_id", chat.parsed(F.col("formatted")).alias("turns")).collect()}
    got = read(chat.format_records(df))
    assert got[1] == [("system", "be kind"), ("user", "i"), ("assistant", "o"), ("user", "a"), ("assistant", ""), ("user", "x"), ("assistant", "y")]
    assert got[2] == [("unknown", '{"some":"thing"}'), ("unknown", ""), ("unknown", "no json")]
    fewer = read(chat.format_records(df, chat.LAYOUTS[:1]))
    assert fewer[1][0] == ("system", "be kind") and fewer[1][1] == ("unknown", rows[1][2])


@pytest.mark.parametrize("millions", [25, 60])
def test_very_long_turns(spark, millions):
    """Texts beyond the longest string that JSON readers take by default, in both layouts that the query writes."""
    n = millions * 10**6 // 9
    rows = spark.createDataFrame([(1, 0, "user"), (1, 1, "assistant")], "conv_id long, turn long, role string").withColumn("text", F.expr(f"repeat('a \"b\" c\\\\n', {n})"))
    nested = F.to_json(F.struct(F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")))
    for record in (F.to_json(F.struct("role", "text")), nested):
        out = chat.format_records(rows.select("conv_id", "turn", record.alias("record"))).select(chat.parsed(F.col("formatted")).alias("turns"))
        got = out.select(F.explode("turns").alias("t")).select("t.role", F.length("t.text").alias("n"), F.md5("t.text").alias("h")).collect()
        want = rows.select("role", F.length("text").alias("n"), F.md5("text").alias("h")).collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in want] and got[0].n == 9 * n


def test_broken_and_escaped_records(spark):
    records = {
        '{"role":"user","text":"cut': "unknown",
        '{"role":"user","text":}': "unknown",
        '{"role":"user","text":"say \\"hi\\", {\\"role\\": [1]} \\\\"}': "user",
        '{"role" : "user", "text" : ", a] b} \\u0041"}': "user",
        '{"messages":[]}': "unknown",
        '""': "unknown",
        "": "unknown",
    }
    df = spark.createDataFrame([(i, 0, k) for i, k in enumerate(records)], "conv_id long, turn long, record string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.format_records(df).select("conv_id", chat.parsed(F.col("formatted")).alias("turns")).collect()}
    for i, (record, role) in enumerate(records.items()):
        text = record if role == "unknown" else json.loads(record)["text"]
        assert got[i] == [(role, text)], record


def test_pipeline(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen.write.parquet(str(tmp_path / name))
        seen = stage(spark, spark.read.parquet(str(tmp_path / name)), source)
        assert seen.columns == docs.columns
    last = corpus_pipeline.run(spark, source).collect()
    assert last and all(bytes(r.decoded).decode() for r in last)
    assert Counter(r.doc_id for r in last).keys() <= before.keys()
    for r in last:
        kept = Counter(re.split(r"[\x20\x09-\x0d]+", bytes(r.decoded).decode().strip()))
        assert not kept - Counter(re.split(r"[\x20\x09-\x0d]+", before[r.doc_id].strip()))


def test_every_query_has_a_name_of_its_operator():
    names = list(llm_queries.QUERIES)
    assert [n.split("_")[0] for n in names[:10]] == [f"op{i}" for i in range(1, 11)]
    assert "pipeline" in names


def test_tables_of_others_outlive_a_pipeline(spark):
    """A result that is not read yet survives the stages' tidying; the pipeline leaves no tables but its last."""
    from wicker.llm import near_dedup, scratch

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lazy = near_dedup.near_duplicates(docs)
    here = set(os.listdir(scratch.scratch_dir(spark)))
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert lazy.count() == docs.count()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(scratch.scratch_dir(spark))) - here}
    assert "mixing" in left and not left & {"toxicity", "near_dedup", "substring_dedup"}


def extracted(spark, bodies, host="names.example"):
    rows = [(i, f"http://{host}/{i}", html) for i, html in enumerate(bodies)]
    return [r.text for r in html_extract.main_texts(spark.createDataFrame(rows, PAGES)).orderBy("page_id").collect()]


@pytest.mark.parametrize(
    "before, after",
    [
        ('<body class="no-sidebar"><article>', "</article></body>"),
        ('<body><article class="post comments-open">', "</article></body>"),
        ('<body><div class="overflow-hidden"><article>', "</article></div></body>"),
        ('<body><div id="header-and-content"><article>', "</article></div></body>"),
        ('<body><form id="aspnetForm"><div><article>', "</article></div></form></body>"),
        ('<body><article data-x="a hidden gem">', "</article></body>"),
    ],
)
def test_names_round_the_text(spark, before, after):
    """Words in names of what is round the text, and in other attributes' values, lose nothing; a menu goes for its words alone."""
    pages = [f'<html>{before}<h1>Title {i}</h1><p>Body {i} of it</p>{after}</html>' for i in range(6)]
    assert extracted(spark, pages) == [f"Title {i} Body {i} of it" for i in range(6)]
    menus = [x.replace("<h1>", '<div class="menu">Menu of it</div><div class="site-footer">Foot {0}</div><p hidden>no {0}</p><h1>') for x in pages]
    assert extracted(spark, menus) == [f"Title {i} Body {i} of it" for i in range(6)]


def test_constant_siblings_are_template(spark):
    """A constant last paragraph goes, whatever the number of paragraphs before it; the story's stay."""
    pages = [f"<html><body><div>{''.join(f'<p>Body {i} part {j}</p>' for j in range(1 + i % 4))}<p>Share this page</p></div></body></html>" for i in range(8)]
    assert extracted(spark, pages) == [" ".join(f"Body {i} part {j}" for j in range(1 + i % 4)) for i in range(8)]
    longer = [f"<html><body>{''.join(f'<p>Body {i} part {j}</p>' for j in range(40 + i))}<p>Share this page</p></body></html>" for i in range(5)]
    assert extracted(spark, longer) == [" ".join(f"Body {i} part {j}" for j in range(40 + i)) for i in range(5)]


def test_extraction_against_brute_force(spark):
    """Random pages of one layout with slots left out: a slot is content if its text varies over the pages that have it."""
    rng = random.Random(3)
    pages, texts = [], []
    for i in range(12):
        html, parts = "", []
        for slot in "abcdef":
            if rng.random() < 0.8:
                n = rng.randint(1, 3)
                for j in range(n):
                    text = {"b": "Constant b", "e": f"Ends {i}" if j == 0 else "Constant e"}.get(slot, f"Slot {slot} {i} {j}")
                    html += f"<div class='{slot}'><span>{text}</span></div>"
                    parts.append((slot, 1 if j == 0 else 9 if j == n - 1 else j + 1, text))
        pages.append(f"<html><body>{html}</body></html>")
        texts.append(parts)
    seen = {}
    for parts in texts:
        for slot, place, text in parts:
            seen.setdefault((slot, place), []).append(text)
    fixed = {k for k, v in seen.items() if len(v) >= 3 and max(Counter(v).values()) >= 0.8 * len(v)}
    assert fixed and extracted(spark, pages, "brute.example") == [" ".join(t for s, p, t in parts if (s, p) not in fixed) for parts in texts]


def test_very_long_pages(spark):
    """A page of five million characters, whole."""
    pages = [f"<html><body><article><p>{'word%d ' % i * 800_000}</p><p>end {i}</p></article></body></html>" for i in range(3)]
    assert extracted(spark, pages) == [" ".join([f"word{i}"] * 800_000) + f" end {i}" for i in range(3)]
