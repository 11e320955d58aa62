"""Continuous versions of the corpus jobs (T operators) on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.columns import item_set, pairs_of
from ..operators.baskets import fingerprint


#: Surfaces that a stream carries along with every task.
MOST_SURFACES = 50_000


def normalised(records: DataFrame, alias: DataFrame, lines: str = "items") -> DataFrame:
    """Arriving records to sets by a static alias table, without state. ``alias``: surface, item_id; a surface may stand for several items, a null one for none.

    The table goes with every task, so it has ``MOST_SURFACES`` surfaces at most; ``normalised_slots`` joins a larger one.
    """
    of = alias.where("surface is not null").groupBy("surface").agg(F.array_sort(F.collect_set("item_id")).alias("of"))
    n = of.count()
    if n > MOST_SURFACES:
        raise ValueError(f"{n} surfaces: more than {MOST_SURFACES} are joined, by normalised_slots")
    table = of.agg(F.map_from_entries(F.collect_list(F.struct("surface", "of"))).alias("alias"))
    hits = F.flatten(F.array_compact(F.transform(lines, lambda x: F.try_element_at(F.col("alias"), F.lower(F.trim(x))))))
    return records.crossJoin(F.broadcast(table)).withColumn("items", F.array_sort(F.array_distinct(hits))).drop("alias")  # one row


def normalised_slots(records: DataFrame, alias: DataFrame, lines: str = "items") -> DataFrame:
    """T1 for alias tables of any size: the columns of ``records`` but ``lines``, and ``item_id``, a row for each line and item; a stream-static join."""
    rows = records.withColumn("surface", F.explode(lines)).withColumn("surface", F.lower(F.trim("surface"))).drop(lines)
    return rows.join(alias.select("surface", "item_id").distinct(), "surface").drop("surface")


def first_wins(records: DataFrame, time: str, delay: str, items: str = "items") -> DataFrame:
    """Exact duplicates dropped while their first copy is inside the watermark; later ones pass."""
    return records.withColumn("fp", fingerprint(F.col(items))).withWatermark(time, delay).dropDuplicatesWithinWatermark(["fp"])


class _Best(StatefulProcessor):
    """The best copy of a fingerprint: held until its time is up, then passed on once; copies that come while it is remembered are dropped."""

    def __init__(self, schema: StructType, rank: str, time: str, hold_ms: int, keep_ms: int) -> None:
        self.schema, self.rank, self.time, self.hold_ms, self.keep_ms = schema, rank, time, hold_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "rank long, at long, row binary")
        self.gone = handle.getValueState("gone", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import pickle

        best = self.best.get() if self.best.exists() else None
        for frame in rows:
            if self.gone.exists():
                continue
            for row in frame.to_dict("records"):
                at = int(pd.Timestamp(row[self.time]).timestamp() * 1000)
                if best is None:
                    self.handle.registerTimer(at + self.hold_ms)
                if best is None or (row[self.rank], at) < tuple(best[:2]):
                    best = (row[self.rank], at, pickle.dumps(row))
        if best is not None:
            self.best.update(tuple(best))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        import pickle

        if not self.best.exists():
            self.gone.clear()
            return
        row = pickle.loads(self.best.get()[2])
        self.best.clear()
        self.gone.update((expiredTimerInfo.getExpiryTimeInMs(),))
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.keep_ms)
        yield pd.DataFrame([[row[c] for c in self.schema.names]], columns=self.schema.names)


def first_wins_by_source(records: DataFrame, time: str, delay: str, hold: int, keep: int, rank: str = "source_rank", items: str = "items") -> DataFrame:
    """T2 by the sources' order: of equal sets that arrive within ``hold`` seconds of the first, the one of the smallest ``rank`` (then the earliest) passes.

    It passes when the watermark is ``hold`` behind the first copy; later copies are dropped for ``keep`` seconds more, then state and timers are gone. Needs a state store that
    takes timers (RocksDB).
    """
    rows = records.withColumn("fp", fingerprint(F.col(items))).withWatermark(time, delay)
    schema = records.schema
    return rows.groupBy("fp").transformWithStateInPandas(_Best(schema, rank, time, hold * 1000, keep * 1000), schema, "append", "EventTime")


def waterfall(records: DataFrame, time: str, window: str, delay: str, items: str = "items") -> DataFrame:
    """Rows, empty ones and slots of each source and tumbling window."""
    n = F.size(F.coalesce(F.col(items), F.array()))
    return (
        records.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), "source")
        .agg(F.count("*").alias("scanned"), F.count_if(n == 0).alias("empty"), F.sum(n).alias("slots"))
        .select(F.col("w.start").alias("start"), "source", "scanned", "empty", "slots")
    )


def incremental_frequencies(baskets: DataFrame) -> DataFrame:
    """T4: running document frequencies (complete or update mode)."""
    return baskets.select(F.explode("items").alias("item_id")).groupBy("item_id").agg(F.count("*").alias("df"))


def incremental_pairs(baskets: DataFrame) -> DataFrame:
    """T4: running counts of pairs src < dst inside baskets (complete or update mode)."""
    return baskets.select(F.explode(pairs_of(item_set("items"))).alias("p")).groupBy("p.src", "p.dst").agg(F.count("*").alias("count"))


class CountTable:
    """T4: a table of counts that batches add to, for ``foreachBatch``: exactly once for each batch, with few parts.

    A batch's counts are a part named by the batch, so a repeated batch writes the same part. Every ``most_parts`` batches the parts and the base before them are
    summed into a new base named by its last batch; batches up to it count no more when they come again. Readers take the last base that is whole and the parts
    behind it, so a stop at any time loses nothing; what is summed into a base goes when the next one is whole.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], count: str = "n", most_parts: int = 16) -> None:
        self.spark, self.path, self.keys, self.count, self.most_parts = spark, path.rstrip("/"), list(keys), count, most_parts

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _whole(self, kind: str) -> list[int]:
        """The numbers of the parts or bases that are written to their end."""
        fs, at = self._fs(f"{self.path}/{kind}")
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(self._fs(f"{self.path}/{kind}/{n}/_SUCCESS")[1]))

    def _sum(self, frames: list[DataFrame]) -> DataFrame:
        rows = frames[0]
        for f in frames[1:]:
            rows = rows.unionByName(f)
        return rows.groupBy(*self.keys).agg(F.sum(self.count).alias(self.count))

    def _frames(self) -> tuple[list[DataFrame], list[int]]:
        base = self._whole("base")[-1:]
        parts = [n for n in self._whole("part") if not base or n > base[0]]
        return [self.spark.read.parquet(f"{self.path}/base/{n}") for n in base] + [self.spark.read.parquet(f"{self.path}/part/{n}") for n in parts], parts

    def write(self, batch: DataFrame, epoch: int) -> None:
        """Add the counts of a batch: rows of the keys and the count."""
        base = self._whole("base")[-1:]
        if base and epoch <= base[0]:
            return
        self._sum([batch.select(*self.keys, self.count)]).write.mode("overwrite").parquet(f"{self.path}/part/{epoch}")
        frames, parts = self._frames()
        if len(parts) >= self.most_parts:
            self._sum(frames).write.mode("overwrite").parquet(f"{self.path}/base/{parts[-1]}")
            for kind, old in (("base", base), ("part", [n for n in self._whole("part") if base and n <= base[0]])):
                for n in old:
                    fs, at = self._fs(f"{self.path}/{kind}/{n}")
                    fs.delete(at, True)

    def read(self) -> DataFrame:
        """The counts so far."""
        return self._sum(self._frames()[0])


def session_baskets(events: DataFrame, time: str, user: str, item: str, gap: str, delay: str) -> DataFrame:
    """T5: baskets assembled from a stream of events: a user's events with no gap between them."""
    s = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), user).agg(F.collect_set(item).alias("items"), F.count("*").alias("n"))
    return s.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.array_sort("items").alias("items"), "n")


def scored(baskets: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates of each arriving basket by the sum of its items' edges in a static graph ``a, b, weight``; the sum is inside the row's own key.

    Weights count to nine decimals and are summed exactly, so that the order of the rows doesn't matter.
    """
    rows = baskets.select("basket_id", "items", F.explode("items").alias("a")).join(edges, "a").where(~F.array_contains("items", F.col("b")))
    return rows.groupBy("basket_id", "b").agg(F.sum(F.round("weight", 9).cast("decimal(18,9)")).cast("double").alias("score"))
