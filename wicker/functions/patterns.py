"""All places at which any of many strings stands in any of many texts."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Strings in one automaton, and texts that it is built for at a time.
STRINGS_A_SHARD = 100_000
TEXTS_A_BLOCK = 50_000


def _scanned(left: pa.Table, right: pa.Table) -> pa.Table:
    """The texts of a block against the automaton of a shard's strings."""
    automaton = ahocorasick.Automaton()
    for s in right["surface"].to_pylist():
        automaton.add_word(s, s)
    keys, surfaces, places = [], [], []
    if len(automaton):
        automaton.make_automaton()
        for key, text in zip(left["key"].to_pylist(), left["text"].to_pylist()):
            for end, s in automaton.iter(text):
                keys.append(key)
                surfaces.append(s)
                places.append(end + 1 - len(s))
    return pa.table({"key": pa.array(keys, pa.string()), "surface": pa.array(surfaces, pa.string()), "pos": pa.array(places, pa.int32())})


def occurrences(texts: DataFrame, strings: DataFrame) -> DataFrame:
    """``texts(text)``, ``strings(surface)`` -> ``text, surface, pos``: every place, from 0, of every string in every distinct text.

    Strings are dealt over shards, each an Aho-Corasick automaton, and texts over blocks; a block meets each shard. Nulls and empty strings are nowhere.
    """
    some = strings.select("surface").where("surface <> ''").distinct()
    those = texts.select("text").where("text is not null").distinct().select(F.sha2("text", 256).alias("key"), "text")
    shards = max(1, -(-some.count() // STRINGS_A_SHARD))
    blocks = max(1, -(-those.count() // TEXTS_A_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = those.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))
    right = some.withColumn("shard", F.pmod(F.xxhash64("surface"), F.lit(shards)).cast("int")).withColumn("block", every(blocks))
    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(_scanned, "key string, surface string, pos int")
    return found.join(those, "key").select("text", "surface", "pos")
