"""Near-duplicate documents: a set similarity join along chosen paths.

A document is the set of its five-word shingles. Independent random trees branch the sets by their
own minwise tokens: a tree's first nodes are named by two of them, so that sets of Jaccard similarity
s share one with probability s^2; every node below offers three branches of two tokens each, chosen
by the node. Small first nodes are compared exhaustively. In a large node all sets are compared with
some centres, and what is found connected is contracted: if at most ``CENTERS`` sets then lie outside
the node's largest component, or so few that their blocks have fewer rows than branches would, those are
compared with all its sets, which is exhaustive as far as components go; else the node branches. At the
deepest level all is compared. A hot group is in nodes of every tree, under one commonest label: they
are compared as one node where that makes fewer rows than each for itself.
A pair of similarity 0.75 is missed by all sixteen trees with probability 2e-6 where its nodes are
small at once or by contraction (nearly all are), with 3e-5 where it must go ever deeper.

Every candidate pair is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import connected_components
from .scratch import written
from .words import U, column_bytes, mix, words_of

TREES = 16
#: Branches of any node but a root, and tokens that name each branch.
BRANCHES, TOKENS = 3, 2
COORDINATES = 128
#: Of 128 coordinates so many must agree before a pair is confirmed in full; a pair of similarity 0.75 agrees on fewer with probability 2e-6.
AGREE = 73
#: A first node of so many sets is compared exhaustively.
LEAF = 32
#: A node with so many sets outside its largest component is always compared exhaustively; one with more may first meet half as many centres.
CENTERS = 256
#: A node is dealt over blocks of about so many members, as many centres, and bytes of each.
BLOCK_SETS, BLOCK_BYTES = 512, 16 << 20
DEEPEST = 8
#: A node's sets are gathered in chunks of so many, were all sets in it.
CHUNK_SETS = 4096
#: The keys of up to so many texts (24 bytes each) are broadcast to pick them; those of more are joined by a shuffle.
BROADCAST_KEYS = 200_000
_SEEDS = np.random.default_rng(77).integers(1, 2**63, (COORDINATES, 2), dtype=np.uint64) * U(2) + U(1)
_LONGS = COORDINATES // 8
_SKETCH = [f"s{i}" for i in range(_LONGS)]


def shingle_sets(raw: np.ndarray, offs: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For texts lo..hi: the distinct shingles of each (sorted, one after another) and their ranges."""
    for lo, hi, words in words_of(raw, offs):
        hashes = words.hashes(lower=True)
        counts = words.counts
        windows, of = words.windows(hashes, k)
        sets = []
        for i in range(hi - lo):
            if counts[i] >= k:
                sets.append(np.unique(windows[of[i] : of[i + 1]]))
            elif counts[i]:  # the whole sequence is the one shingle
                h = hashes[words.of[i] : words.of[i + 1]]
                sets.append(mix(np.array([np.sum(h * _SEEDS[: len(h), 0], dtype=np.uint64) + U(len(h))], np.uint64)))
            else:
                sets.append(np.zeros(0, np.uint64))
        sizes = np.array([len(s) for s in sets], np.int64)
        yield lo, hi, np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes)))


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = column_bytes(batch.column("text"))
            for lo, hi, flat, of in shingle_sets(raw, offs, k):
                n = np.diff(of)
                full = np.flatnonzero(n)
                keys = np.zeros(hi - lo, np.uint64)
                least = np.zeros((COORDINATES, hi - lo), np.uint64)
                if len(full):
                    at = of[:-1][full]
                    keys[full] = mix(np.add.reduceat(mix(flat ^ _SEEDS[0, 1]), at) + U(3) * np.bitwise_xor.reduceat(flat * _SEEDS[1, 1], at) + n[full].astype(np.uint64))
                    for c in range(COORDINATES):
                        v = (flat ^ _SEEDS[c, 0]) * _SEEDS[c, 1]
                        v ^= v >> U(29)
                        v *= _SEEDS[c, 0]
                        v ^= v >> U(32)
                        least[c, full] = np.minimum.reduceat(v, at)
                sketch = np.ascontiguousarray(mix(least.copy()).astype(np.uint8).T).view(np.int64)
                paths = mix(least[: TREES * TOKENS : TOKENS] * U(3) + least[1 : TREES * TOKENS : TOKENS] * _SEEDS[:TREES, :1])
                paths = np.ascontiguousarray(paths.T).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("th").slice(lo, hi - lo), pa.array(n), pa.array(keys.view(np.int64))]
                    + [pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(_LONGS)]
                    + [pa.ListArray.from_arrays(pa.array(np.arange(0, len(paths) + 1, TREES, dtype=np.int32)), pa.array(paths))],
                    ["doc_id", "th", "n_shingles", "key", *_SKETCH, "nodes"],
                )

    return run


def _full_sets(k: int):
    """Texts to their whole shingle sets, as bytes of sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = column_bytes(batch.column("text"))
            rest = batch.schema.names[:-1]
            for lo, hi, flat, of in shingle_sets(raw, offs, k):
                sets = [flat[of[i] : of[i + 1]].tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in rest), pa.array(sets, pa.binary())], [*rest, "set"])

    return run


def _confirm(percent: int):
    """The pairs of sets that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in ("set_a", "set_b"):
                raw, offs = column_bytes(batch.column(c))
                sides.append((raw.view(np.uint64) if len(raw) else np.zeros(0, np.uint64), offs // 8))
            (a, at), (b, bt) = sides
            good = []
            for i in range(batch.num_rows):
                p, q = a[at[i] : at[i + 1]], b[bt[i] : bt[i + 1]]
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _compare(percent: int):
    """One block: its sets against its centres. The labels of similar ones are linked."""

    def run(table: pa.Table) -> pa.Table:
        label, n = (table.column(c).to_numpy() for c in ("label", "n_shingles"))
        sketch = np.ascontiguousarray(np.stack([table.column(c).to_numpy() for c in _SKETCH], 1)).view(np.uint8).reshape(len(label), COORDINATES)
        raw, offs = column_bytes(table.column("set"))
        flat, of = raw.view(np.uint64), offs // 8
        center = table.column("center").to_numpy()
        members = np.flatnonzero(table.column("member").to_numpy())
        _, root = np.unique(label, return_inverse=True)
        a, b = [], []
        for i in np.flatnonzero(center):
            likely = members[root[members] != root[i]]
            likely = likely[100 * np.minimum(n[likely], n[i]) >= percent * np.maximum(n[likely], n[i])]
            likely = likely[(sketch[likely] == sketch[i]).sum(1) >= AGREE]
            if not len(likely):
                continue
            own = flat[of[i] : of[i + 1]]
            sizes = n[likely]
            begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            elements = flat[np.repeat(of[:-1][likely] - begin, sizes) + np.arange(int(sizes.sum()))]
            hit = own[np.minimum(np.searchsorted(own, elements), len(own) - 1)] == elements
            both = np.add.reduceat(hit, begin, dtype=np.int64)
            for j in likely[100 * both >= percent * (sizes + n[i] - both)]:
                if root[j] != root[i]:
                    a.append(label[i])
                    b.append(label[j])
                    root[root == root[j]] = root[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _agree(p: str, q: str) -> Column:
    """On how many coordinates two sketches agree."""
    total = F.lit(COORDINATES)
    for i in range(_LONGS):
        x = F.col(f"{p}.s{i}").bitwiseXOR(F.col(f"{q}.s{i}"))
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def _likely(p: str, q: str, percent: int) -> Column:
    """Sizes that allow the similarity, and sketches that look like it."""
    n, m = F.col(f"{p}.n_shingles"), F.col(f"{q}.n_shingles")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (_agree(p, q) >= AGREE)


def _byte(at: Column) -> Column:
    """One coordinate of a sketch."""
    long = F.element_at(F.array(*_SKETCH), (at / 8).cast("int") + 1)
    return F.call_function("shiftrightunsigned", long, (8 * (at % 8)).cast("int")).bitwiseAND(F.lit(255))


def _children(members: DataFrame) -> DataFrame:
    """Each set follows every branch by its minwise tokens at the coordinates that the node chooses for it."""
    rows = members.withColumn("branch", F.explode(F.array(*[F.lit(i) for i in range(BRANCHES)]))).withColumn("c", F.xxhash64("node", "branch"))
    picks = [F.pmod(F.shiftrightunsigned("c", 16 * i), F.lit(COORDINATES)).cast("int") for i in range(TOKENS)]
    return rows.select(F.xxhash64("node", "branch", *[_byte(p) for p in picks]).alias("node"), "key", "n_shingles")


def similar_sets(sets: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Components ``(key, root)`` of the keys of ``sets`` that are linked with another."""
    chunks = max(1, -(-sets.count() // CHUNK_SETS))
    nodes = written(_first_nodes(sets, chunks), "nodes")
    pairs = written(_exhaustive(nodes.where(F.col("size") <= LEAF).join(sets.select("key", *_SKETCH), "key"), percent), "pairs")
    nodes = nodes.where(F.col("size") > LEAF).select("node", "key", "n_shingles")
    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).unionByName(nodes.select("key")).distinct()
    full = _picked(wanted, sets, texts, k)
    a, b = (full.select(F.col("key").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    links = pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long")
    known = _components(links)
    for depth in range(DEEPEST):
        state = _planned(_labelled(nodes, known), chunks, last=depth == DEEPEST - 1)
        if state.isEmpty():
            break
        links = written(_with_centers(state, full, percent, chunks), "links")
        open_ = state.where("not final").select("node", "key", "n_shingles", "label")
        if not links.isEmpty():
            merged = _components(links)
            known = _relabelled(known, merged)
            # the labels that were merged are few: rows get their new ones by label
            open_ = open_.join(merged.select(F.col("key").alias("label"), F.col("root").alias("new")), "label", "left").withColumn("label", F.coalesce("new", "label")).drop("new")
        if open_.isEmpty():
            break
        # what contraction has made small stays a node, the others branch
        open_ = _planned(open_, chunks, last=False)
        again = open_.where("final").select("node", "key", "n_shingles")
        nodes = again.unionByName(_children(_met_once(open_.where("not final").select("node", "key", "n_shingles"), full.select("key", *_SKETCH))))
    return known


def _chunked(rows: DataFrame, chunks: int) -> DataFrame:
    """The rows of each node gathered in chunks, so that a hot node meets what is known of it as a row for each chunk: ``node, chunk, s``."""
    rest = [c for c in rows.columns if c != "node"]
    return rows.groupBy("node", F.pmod("key", F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct(*rest)).alias("s"))  # about CHUNK_SETS rows at most


def _met_once(rows: DataFrame, full: DataFrame) -> DataFrame:
    """``rows`` with what ``full`` has of their keys: a set is in many nodes, so its rows are gathered before it is met, and it is met once."""
    at = F.struct(*[c for c in rows.columns if c != "key"])
    met = rows.groupBy("key").agg(F.collect_list(at).alias("at")).join(full, "key")  # a set's own nodes and chunks
    return met.select("key", *[c for c in full.columns if c != "key"], F.explode("at").alias("at")).select("*", "at.*").drop("at")


def _first_nodes(sets: DataFrame, chunks: int) -> DataFrame:
    """The sets of every first node that holds more than one: ``node, key, n_shingles, size``."""
    parts = written(_chunked(sets.select(F.explode("nodes").alias("node"), "key", "n_shingles"), chunks), "chunks")
    sizes = parts.groupBy("node").agg(F.sum(F.size("s")).alias("size")).where("size > 1")
    return parts.join(sizes, "node").select("node", F.explode("s").alias("s"), "size").select("node", "s.*", "size")


def _components(links: DataFrame) -> DataFrame:
    return written(connected_components(links).withColumnRenamed("id", "key"), "known")


def _relabelled(known: DataFrame, merged: DataFrame) -> DataFrame:
    """``known(key, root)`` after its labels have been merged; a label that is no key yet is a set of its own."""
    merged = merged.select(F.col("key").alias("root"), F.col("root").alias("new"))
    both = known.join(merged, "root", "full").select(F.coalesce("key", "root").alias("key"), F.coalesce("new", "root").alias("root"))
    return written(both, "known")


def _exhaustive(nodes: DataFrame, percent: int) -> DataFrame:
    """All likely pairs of small nodes, each once."""
    leaves = nodes.groupBy("node").agg(F.collect_list(F.struct("key", "n_shingles", *_SKETCH)).alias("xs"))
    pairs = leaves.select("xs", F.explode("xs").alias("x")).select("x", F.explode(F.filter("xs", lambda y: y["key"] > F.col("x.key"))).alias("y"))
    return pairs.where(_likely("x", "y", percent)).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()


def _labelled(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Sets of nodes with their labels, once for the sums and the rows that ``_mixed`` takes."""
    return written(nodes.join(known, "key", "left").select("node", "key", "n_shingles", F.coalesce("root", "key").alias("label")), "labelled")


def _mixed(rows: DataFrame, chunks: int, last: bool) -> DataFrame:
    """Sets of nodes that hold several labels: ``others``: how many lie outside the commonest; ``final``: whether those can be compared with all."""
    # sums for each label first, so that a hot node is one row for each of its labels
    per = rows.groupBy("node", "label").agg(F.count("*").alias("c"))
    stats = per.groupBy("node").agg(F.sum("c").alias("size"), F.max(F.struct("c", "label")).alias("m"))
    stats = stats.where("size > m.c").select("node", "size", F.col("m.label").alias("common"), (F.col("size") - F.col("m.c")).alias("others"))
    final = F.lit(True) if last else (F.col("others") <= CENTERS) | (_block_rows("size", "others") <= BRANCHES * F.col("size"))
    parts = _chunked(rows, chunks).join(stats.withColumn("final", final), "node")
    return parts.withColumn("s", F.explode("s")).select("s.*", *[c for c in parts.columns if c not in ("chunk", "s")])


def _block_rows(members: str, centers: str) -> Column:
    """How many rows the blocks have in which so many members meet so many centres."""
    m, c = F.col(members), F.col(centers)
    return m * F.ceil(c / BLOCK_SETS) + c * F.ceil(m / BLOCK_SETS)


def _together(state: DataFrame) -> DataFrame:
    """The commonest labels whose nodes make fewer rows compared as one than each for itself, be it by blocks or by branches: ``common, together``."""
    own = F.when(F.col("final"), _block_rows("size", "others")).otherwise(BRANCHES * F.col("size"))
    per = state.groupBy("common", "key").agg(F.max(F.col("label") != F.col("common")).alias("other"), F.sum(own / F.col("size")).alias("apart"))
    sums = per.groupBy("common").agg(F.count("*").alias("sets"), F.count_if("other").alias("outside"), F.sum("apart").alias("apart"))
    return sums.where(_block_rows("sets", "outside") + 0.5 < F.col("apart")).select("common", F.lit(True).alias("together"))


def _planned(rows: DataFrame, chunks: int, last: bool) -> DataFrame:
    """``_mixed`` with ``together``: whether a node is compared as one with those of its commonest label, which is final."""
    state = written(_mixed(rows, chunks, last), "state")
    labels = written(_together(state), "together")
    labels = F.broadcast(labels) if labels.count() <= BROADCAST_KEYS else labels
    state = state.join(labels, "common", "left").withColumn("together", F.col("together").isNotNull())
    return state.withColumn("final", F.col("final") | F.col("together"))


def _alike(state: DataFrame) -> DataFrame:
    """The nodes of a hot group hold much the same sets under the same commonest label; they are one here: ``node, key, n_shingles, label, is_center``, once for each set.

    A set that is a centre of one of them meets the sets of all, so that nothing is compared less.
    """
    drawn = F.pmod(F.xxhash64("key", "node"), F.col("size")) * 2 < CENTERS
    center = F.when(F.col("final"), F.col("label") != F.col("common")).otherwise(drawn)
    one = F.when(F.col("together"), F.xxhash64("common")).otherwise(F.col("node")).alias("node")
    return state.groupBy(one, "key").agg(F.first("n_shingles").alias("n_shingles"), F.first("label").alias("label"), F.max(center).alias("is_center"))


def _blocks(state: DataFrame, chunks: int) -> DataFrame:
    """Sets by blocks of a chunk of members and a group of centres: the sets outside the commonest label where they are few, else some drawn by hash."""
    rows = written(_alike(state), "alike")
    center_n = F.when(F.col("is_center"), F.col("n_shingles"))
    stats = rows.groupBy("node").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("n"), F.count(center_n).alias("centers"), F.sum(center_n).alias("center_n"))
    dealt = lambda size, n: F.greatest(F.lit(1), F.ceil(F.col(size) / BLOCK_SETS), F.ceil(F.coalesce(n, F.lit(0)) * 8 / BLOCK_BYTES)).cast("int")
    stats = stats.where("centers > 0").select("node", dealt("size", F.col("n")).alias("chunks"), dealt("centers", F.col("center_n")).alias("groups"))
    parts = _chunked(rows, chunks).join(stats, "node").withColumn("s", F.explode("s")).select("node", "s.*", "chunks", "groups")
    hashed = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    parts = parts.withColumns({"its_chunk": hashed(F.col("chunks")), "its_group": hashed(F.col("groups"))})
    spread = lambda n: F.sequence(F.lit(0), n - 1)
    # a centre is one row in the block in which it is a member too
    members = parts.withColumn("group", F.explode(spread(F.col("groups")))).withColumn("chunk", F.col("its_chunk"))
    members = members.withColumns({"member": F.lit(True), "center": F.col("is_center") & (F.col("group") == F.col("its_group"))})
    centers = parts.where("is_center").withColumn("chunk", F.explode(spread(F.col("chunks")))).where("chunk <> its_chunk").withColumn("group", F.col("its_group"))
    both = members.unionByName(centers.withColumns({"member": F.lit(False), "center": F.lit(True)}))
    return both.select(F.xxhash64("node", "chunk", "group").alias("block"), "key", "label", "member", "center")


def _with_centers(state: DataFrame, full: DataFrame, percent: int, chunks: int) -> DataFrame:
    """Links between the labels of each node's sets and of its centres."""
    return _met_once(_blocks(state, chunks), full).groupBy("block").applyInArrow(_compare(percent), "a long, b long")


def _picked(wanted: DataFrame, sets: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The wanted sets in full, with their sketches: ``key, n_shingles, s.., set``."""
    wanted = written(sets.select("key", F.col("doc_id").alias("its_id"), "th").join(wanted, "key"), "wanted")
    few = wanted.count() <= BROADCAST_KEYS
    text = texts.join(F.broadcast(wanted) if few else wanted, "th").where(F.col("doc_id").eqNullSafe(F.col("its_id"))).groupBy("key").agg(F.first("text").alias("text"))
    rows = text.join(sets.select("key", "n_shingles", *_SKETCH), "key").select("key", "n_shingles", *_SKETCH, "text")
    return written(rows.mapInArrow(_full_sets(k), f"key long, n_shingles long, {', '.join(f'{c} long' for c in _SKETCH)}, set binary"), "full")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_shingles, component_id, kept``, one row for each row of ``docs``.

    Linked are documents whose sets of k-word shingles (A-Z lower-cased; a shorter text is one
    shingle) have ``100 * intersection >= percent * union``. A component's id is its smallest
    doc_id; that document is kept. Texts that are null, empty or without words have no shingles,
    link with nothing and are kept. Repeated rows get one row each. A null doc_id counts as the
    largest; a component of such rows alone has a null id. Other columns are ignored.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    texts = base.withColumn("th", F.xxhash64("text"))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, th long, n_shingles long, key long, {', '.join(f'{c} long' for c in _SKETCH)}, nodes array<long>"
    sketched = written(texts.select("doc_id", "th", "text").mapInArrow(_sketches(k), schema), "sketched")
    # rows with one set are one vertex: its smallest document stands for it
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th"))
    few = sketched.where("n_shingles > 0").groupBy("key").agg(one.alias("r")).select("key", F.col("r.doc_id").alias("first_id"), F.col("r.th").alias("first_th"))
    sets = written(
        sketched.join(few, "key").where(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("th") == F.col("first_th"))).drop("first_id", "first_th").dropDuplicates(["key"]),
        "sets",
    )
    roots = similar_sets(sets, texts, k, percent)
    groups = sets.select("key", "doc_id").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = groups.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_key = groups.join(least, "root").select("key", "component_id")
    out = sketched.where("n_shingles > 0").select("doc_id", "n_shingles", "key").join(of_key, "key").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(sketched.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """One row of ``docs`` for each component, that of its smallest doc_id (null is the largest); all columns stay as they are.

    Rows are told apart by a key of their own, not by doc_id: different texts under one id or without an id
    are different documents, and every row without shingles (null or empty texts) stays; of repeated rows one stays. An empty table
    gives an empty table.
    """
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")
    kept = near_duplicates(rows.select(key.alias("doc_id"), "text"), k, percent).where("kept").select("doc_id._row")
    return rows.join(kept, "_row", "left_semi").select(*docs.columns)
