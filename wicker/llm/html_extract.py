"""Main text of web pages by wrapper induction.

A page's DOM is summed up as a guide tree: a node for each path of tags and classes, and of siblings alike, outside articles, one for each of the first few, one for
the last and one for those between. Pages of a host are aligned with the host's most common tree by simple tree matching. A node whose text hardly changes over the
host's pages is template; the others are slots, and all of them hold content. Adverts and readers' comments vary as content does:
nodes that are menus, notices, adverts and the like by their element or by a name of their own are never content. Only on a host with too few pages to tell
slots from template do a page's articles, or else main elements, stand for the slots.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import written

#: A node is template if so many distinct pages of the host have text in it and such a share of them the same.
LEAST_PAGES, SAME_SHARE = 3, 0.8
#: Wrappers of up to this many rows are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 5000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes svg math select object canvas audio video".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"}}
_NOT_MAIN = frozenset("head nav header footer aside form menu dialog button fieldset address figcaption".split()) - {"address", "figcaption"}
_NOT_MAIN_WORDS = frozenset(
    "ad ads adv advert adverts advertisement adsense banner banners promo promotion sponsor sponsored sidebar side menu nav navbar navigation footer header masthead cookie cookies"
    " consent gdpr notice notices alert newsletter subscribe subscription signup login popup modal overlay comment comments disqus discussion reply replies respond related recommended share sharing social"
    " breadcrumb breadcrumbs pagination pager widget toolbar skip hidden complementary contentinfo search disclaimer paywall tags meta legal".split()
)
#: Elements whose names tell nothing of what is in them, and words that say a name is of something else.
_WHOLE = frozenset("# html body article main".split())
_OTHERWISE = frozenset("no not without has with and by open overflow content article body post story text".split())
_COMMENTS = frozenset("comment comments disqus discussion reply replies respond".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Siblings alike that are nodes of their own, from the first; the last is one too. What sets a node's place apart in its signature.
FIRST, _PLACE = 8, "\x1f"


def _tag(signature: str) -> str:
    return signature.partition(_PLACE)[0].partition(".")[0]


@lru_cache(100_000)
def _says(name: str) -> frozenset[str]:
    """The words by which a class, id or role says that its element is boilerplate: the whole name, or its first or last word where no other says otherwise."""
    if name.lower() in _NOT_MAIN_WORDS:
        return frozenset([name.lower()])
    words = [w.lower() for w in _WORD.findall(name)]
    return frozenset() if _OTHERWISE & {*words} else frozenset({*words[:1], *words[-1:]} & _NOT_MAIN_WORDS)


def _own_words(signature: str) -> frozenset[str]:
    tag, _, names = signature.partition(_PLACE)[0].partition(".")
    return frozenset() if tag in _WHOLE else frozenset().union(*(_says(n) for n in names.split()))


def _boilerplate(signature: str) -> bool:
    return _tag(signature) in _NOT_MAIN or bool(_own_words(signature))


@lru_cache(100_000)
def _signature(tag: str, attributes: str) -> str:
    names = []
    for m in _ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind in ("class", "id", "role"):
            names.append(re.sub(r"\d+", "", value))
        elif kind == "hidden" or kind == "aria-hidden" and value == "true" or kind == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            names.append("hidden")
    names = " ".join(" ".join(names).split())
    return f"{tag}.{names}" if names else tag


def _guide(parents: list[int], signatures: list[str]) -> tuple[list[str], list[int], list[int]]:
    """Elements (parents first) to a guide tree: signature and parent of each node, and the node of each element.

    Inside an article siblings alike share a node: they are paragraphs of one text, and a sentence that many articles have is still theirs.
    """
    alike = Counter(zip(parents, signatures))
    seen: Counter = Counter()
    ids: dict[tuple[int, str], int] = {}
    names, above, node, article = ["#"], [-1], [0], [False]
    for key in zip(parents[1:], signatures[1:]):
        article.append(article[key[0]] or _tag(signatures[key[0]]) == "article")
        seen[key] += 1
        i, n = seen[key], alike[key]
        place = "" if i == 1 or article[-1] else "last" if i == n else str(i) if i <= FIRST else "more"
        at = (node[key[0]], f"{key[1]}{_PLACE}{place}" if place else key[1])
        if at not in ids:
            ids[at] = len(names)
            names.append(at[1])
            above.append(at[0])
        node.append(ids[at])
    return names, above, node


def page_blocks(html: str) -> tuple[list[str], list[int], list[tuple[int, str]]]:
    """Guide tree (signature and parent of each node) and the text blocks, each with its node, in page order."""
    signatures, parents = ["#"], [-1]  # of elements
    stack: list[tuple[str, int]] = [("#", 0)]
    blocks: list[tuple[int, str]] = []
    text: list[str] = []

    def flush() -> None:
        if text:
            whole = "".join(text)
            text.clear()
            if "&" in whole:
                whole = unescape(whole)
            whole = " ".join(whole.split())
            if whole:
                blocks.append((stack[-1][1], whole))

    at, end = 0, len(html)
    while True:
        m = _TOKEN.search(html, at)
        if m is None:
            text.append(html[at:])
            break
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _INLINE:
            # an inline element that says that it is boilerplate is a node of its own, as a block is
            if m[1] or not m[3] or tag in _VOID or m[3].endswith("/"):
                if not (m[1] and any(t == tag for t, _ in stack[1:])):
                    continue
            elif not _boilerplate(_signature(tag, m[3])):
                continue
        flush()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    break
            continue
        if tag in _VOID:
            continue
        if tag in _RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = close.end() if close else end
            continue
        if stack[-1][0] == "p":
            stack.pop()
        while stack[-1][0] in _CLOSES.get(tag, ()):
            stack.pop()
        parents.append(stack[-1][1])
        stack.append((tag, len(signatures)))
        signatures.append(_signature(tag, m[3]) if m[3] else tag)
    flush()
    names, above, node = _guide(parents, signatures)
    return names, above, [(node[i], block) for i, block in blocks]


def _host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", url or "")
    return m[1].lower() if m else ""


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shape = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string())]))
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            urls, pages = part.column("url").to_pylist(), part.column("html").to_pylist()
            rows: dict[str, list] = {c: [] for c in ("host", "tree", "page_hash", "hashes", "sizes", "blocks")}
            for url, html in zip(urls, pages):
                signatures, parents, blocks = page_blocks(html or "")
                n = len(signatures)
                hashes, sizes = [0] * n, [0] * n
                for node, block in blocks:
                    hashes[node] = crc32(block.encode(), hashes[node] + 1 & 0xFFFFFFFF)
                    sizes[node] += len(block)
                rows["host"].append(_host(url))
                rows["tree"].append("\n".join([f"{p}\t{s}" for p, s in zip(parents, signatures)]))
                rows["page_hash"].append(hash(tuple(hashes)))
                rows["hashes"].append(hashes)
                rows["sizes"].append(sizes)
                rows["blocks"].append([{"node": a, "text": b} for a, b in blocks])
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url")]
                + [pa.array(rows[c], t) for c, t in (("host", pa.string()), ("tree", pa.string()), ("page_hash", pa.int64()), ("hashes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("blocks", shape))],
                ["page_id", "url", *rows],
            )


def _tree(text: str) -> tuple[list[str], list[list[int]], list[int]]:
    parents, signatures = zip(*((int(p), s) for p, _, s in (line.partition("\t") for line in text.split("\n"))))
    children: list[list[int]] = [[] for _ in signatures]
    for i, p in enumerate(parents):
        if p >= 0:
            children[p].append(i)
    return list(signatures), children, list(parents)


def _heaviest(places: list[int], weights: list[int]) -> tuple[int, list[int]]:
    """The heaviest run of items whose places increase: its weight and the items."""
    order = {p: r for r, p in enumerate(sorted(places))}
    best: list[tuple[int, int]] = [(0, -1)] * (len(order) + 1)  # a Fenwick tree of maxima: weight, last item
    before = [-1] * len(places)
    for i, p in enumerate(places):
        r, top = order[p], (0, -1)
        while r:
            top = max(top, best[r])
            r &= r - 1
        before[i] = top[1]
        mine, r = (top[0] + weights[i], i), order[p] + 1
        while r <= len(order):
            best[r] = max(best[r], mine)
            r += r & -r
    total, i, r = 0, -1, len(order)
    while r:
        if best[r][0] > total:
            total, i = best[r]
        r &= r - 1
    out = []
    while i >= 0:
        out.append(i)
        i = before[i]
    return total, out[::-1]


def match_trees(page: str, host: str) -> list[int]:
    """Simple tree matching of two guide trees: for each node of the page's the host's node, or -1.

    Children match in order, the largest matching wins. Siblings of a guide tree differ in their
    signatures, so a node has one possible partner, and the best matching of two nodes' children is their heaviest
    increasing run: no recursion, and n log n for n nodes, however deep or wide the trees.
    """
    a, below, parents = _tree(page)
    if page == host:
        return list(range(len(a)))
    b, _, parents_b = _tree(host)
    child = {(p, s): j for j, (p, s) in enumerate(zip(parents_b, b))}
    partner = [child.get((-1, a[0]), -1)]
    for i in range(1, len(a)):  # parents come before children
        p = partner[parents[i]]
        partner.append(child.get((p, a[i]), -1) if p >= 0 else -1)
    weight, chosen = [1] * len(a), [[]] * len(a)
    for x in reversed(range(len(a))):
        kids = [i for i in below[x] if partner[i] >= 0]
        if kids:
            inner, best = _heaviest([partner[i] for i in kids], [weight[i] for i in kids])
            weight[x], chosen[x] = 1 + inner, [kids[i] for i in best]
    out = [-1] * len(a)
    todo = [0] if partner[0] >= 0 else []
    while todo:
        x = todo.pop()
        out[x] = partner[x]
        todo += chosen[x]
    return out


def _aligned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"host": frame.host, "tree": frame.tree, "nodes": [match_trees(t, r) for t, r in zip(frame.tree, frame.reference)]})


def keep_nodes(tree: str, nodes: list[int], template: set[int], voted: bool) -> list[bool]:
    """Which nodes of a page's tree are content: the slots that vary over the host's pages, but for those that call themselves boilerplate.

    Where too few pages have ``voted`` to tell slots from template, the page's own articles, else its mains, else all stand for the slots.
    """
    signatures, _, parents = _tree(tree)
    n = len(signatures)
    tags = [_tag(s) for s in signatures]
    below, holds = [1] * n, [tags[i] in ("article", "main") for i in range(n)]
    for i in range(n - 1, 0, -1):  # parents come before children
        below[parents[i]] += below[i]
        holds[parents[i]] = holds[parents[i]] or holds[i]
    out = [False] * n
    for i in range(n):
        says = _boilerplate(signatures[i])
        if says and 2 * below[i] > n and (tags[i] == "form" or tags[i] not in _NOT_MAIN and holds[i] and not _COMMENTS & _own_words(signatures[i])):
            says = False  # it is round the page
        out[i] = says or parents[i] >= 0 and out[parents[i]]
    free = [not x for x in out]
    if voted:
        return [free[i] and nodes[i] not in template for i in range(n)]
    roots = [0]
    for wanted in ("article", "main"):
        found = [i for i in range(n) if free[i] and (tags[i] == wanted or wanted == "main" and re.search(r"\.(.* )?main( |$)", signatures[i].partition(_PLACE)[0]))]
        if found:
            roots = found
            break
    inside = [False] * n
    for r in roots:
        inside[r] = True
    for i in range(n):
        inside[i] = inside[i] or parents[i] >= 0 and inside[parents[i]]
    return [inside[i] and free[i] for i in range(n)]


def _wrappers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        keep = []
        for tree, nodes, stats in zip(frame.tree, frame.nodes, frame.stats):
            stats = list(stats) if stats is not None else []
            template = {s["node"] for s in stats if s["template"]}
            keep.append(keep_nodes(tree, list(nodes), template, any(s["n"] >= LEAST_PAGES for s in stats)))
        yield pd.DataFrame({"host": frame.host, "tree": frame.tree, "keep": keep})


def main_texts(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``page_id, url, text, n_chars``, one row for each row of ``pages``.

    Blocks of content in page order, each with its white space turned into single spaces, joined by one space; character references are decoded.
    Hosts are compared without regard to case; null or odd urls form one host. Copies of a page count once when a host's template is told. A
    null or empty html, or one without content, gives an empty text. Repeated rows get a row each; other columns are ignored.
    """
    kind = dict(pages.dtypes)["page_id"]
    read = written(
        pages.select("page_id", "url", "html").mapInArrow(
            _read, f"page_id {kind}, url string, host string, tree string, page_hash long, hashes array<long>, sizes array<long>, blocks array<struct<node:int,text:string>>"
        ),
        "pages",
    )
    trees = read.groupBy("host", "tree").agg(F.count("*").alias("n"))
    common = trees.groupBy("host").agg(F.max(F.struct("n", F.col("tree"))).alias("m")).select("host", F.col("m.tree").alias("reference"))
    aligned = written(trees.join(common, "host").select("host", "tree", "reference").mapInPandas(_aligned, "host string, tree string, nodes array<int>"), "aligned")
    few = aligned.count() <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda df: df)
    # each distinct page of a host votes once on every node of the host's tree
    votes = read.join(small(aligned), ["host", "tree"]).select("host", "page_hash", F.explode(F.arrays_zip("nodes", "hashes", "sizes")).alias("x")).where("x.nodes >= 0 and x.sizes > 0")
    votes = votes.select("host", "page_hash", F.col("x.nodes").alias("node"), F.col("x.hashes").alias("h")).distinct()
    votes = votes.groupBy("host", "node", "h").agg(F.count("*").alias("n"))
    stats = votes.groupBy("host", "node").agg(F.sum("n").alias("n"), F.max("n").alias("same"))
    stats = stats.withColumn("template", (F.col("n") >= LEAST_PAGES) & (F.col("same") >= SAME_SHARE * F.col("n")))
    by_host = stats.groupBy("host").agg(F.collect_list(F.struct("node", "template", "n")).alias("stats"))
    wrappers = written(aligned.join(by_host, "host", "left").select("host", "tree", "nodes", "stats").mapInPandas(_wrappers, "host string, tree string, keep array<boolean>"), "wrappers")
    texts = read.join(small(wrappers), ["host", "tree"], "left")
    text = F.array_join(F.transform(F.filter("blocks", lambda b: F.get("keep", b["node"])), lambda b: b["text"]), " ")
    return texts.select("page_id", "url", F.coalesce(text, F.lit("")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
