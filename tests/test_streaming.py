"""The continuous jobs on small file streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wicker.streaming import jobs as J

SHAPE = "ts timestamp, source string, items array<string>"


def stream(spark, tmp_path, name, rows, shape=SHAPE):
    df = spark.createDataFrame(rows, shape.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts")) if "ts timestamp" in shape else spark.createDataFrame(rows, shape)
    df.coalesce(1).write.parquet(str(tmp_path / name))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / name))


def drained(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
        return df.sparkSession.table(name).collect()
    finally:
        q.stop()


ROWS = [("2024-01-01 00:00:00", "a", ["Salt", "egg"]), ("2024-01-01 00:05:00", "b", ["egg ", "salt"]), ("2024-01-01 01:00:00", "a", []), ("2024-01-01 01:01:00", "a", ["milk"])]


def test_normalised_and_first_wins(spark, tmp_path):
    alias = spark.createDataFrame([("salt", 1), ("egg", 2)], "surface string, item_id long")
    got = drained(J.normalised(stream(spark, tmp_path, "n", ROWS), alias).select("ts", F.col("items").alias("ids")), "normalised", "append")
    assert sorted(r.ids for r in got) == [[], [], [1, 2], [1, 2]]
    kept = drained(J.first_wins(stream(spark, tmp_path, "f", ROWS), "ts", "1 hour").select("source", "items"), "first_wins", "append")
    assert len(kept) == 3


def test_waterfall_and_sessions(spark, tmp_path):
    got = drained(J.waterfall(stream(spark, tmp_path, "w", ROWS), "ts", "1 hour", "1 hour"), "waterfall", "update")
    assert sorted((r.start.hour, r.source, r.scanned, r["empty"], r.slots) for r in got) == [(0, "a", 1, 0, 2), (0, "b", 1, 0, 2), (1, "a", 2, 1, 1)]
    events = [("2024-01-01 00:00:00", 1, "x"), ("2024-01-01 00:10:00", 1, "y"), ("2024-01-01 05:00:00", 1, "x"), ("2024-01-02 00:00:00", 2, "z")]
    s = J.session_baskets(stream(spark, tmp_path, "s", events, "ts timestamp, user_id long, item string"), "ts", "user_id", "item", "1 hour", "1 hour")
    assert [(r.user_id, r["items"], r.n) for r in drained(s, "sessions", "append") if r.user_id == 1] == [(1, ["x", "y"], 2), (1, ["x"], 1)]


def test_counts_merge_once_per_batch(spark, tmp_path):
    table = J.CountTable(spark, str(tmp_path / "counts"), ["item_id"], most_parts=3)
    batch = spark.createDataFrame([(1, 2), (1, 3), (2, 1)], "item_id long, n long")
    table.write(batch, 0)
    table.write(batch, 0)
    table.write(batch, 1)
    assert {r.item_id: r.n for r in table.read().collect()} == {1: 10, 2: 2}


def test_counts_are_compacted(spark, tmp_path):
    """Twenty batches, some of them twice and late: each counts once, parts stay few, a half-written base is passed over."""
    table = J.CountTable(spark, str(tmp_path / "counts"), ["src", "dst"], "count", most_parts=4)
    batch = spark.createDataFrame([(1, 2, 1), (1, 3, 2)], "src long, dst long, count long")
    for epoch in range(20):
        table.write(batch, epoch)
        if epoch % 3 == 2:
            J.CountTable(spark, str(tmp_path / "counts"), ["src", "dst"], "count", most_parts=4).write(batch, epoch - 1)
        assert len(table._whole("part")) <= 8 and len(table._whole("base")) <= 2
    (tmp_path / "counts" / "base" / "99").mkdir()
    assert {(r.src, r.dst): r["count"] for r in table.read().collect()} == {(1, 2): 20, (1, 3): 40}


def test_a_restarted_stream_counts_once(spark, tmp_path):
    """A stream that stops and goes on from its checkpoint, over the batch path, pairs counted by table."""
    files, state = tmp_path / "in", str(tmp_path / "state")
    table = J.CountTable(spark, str(tmp_path / "pairs"), ["src", "dst"], "count", most_parts=2)

    def count(batch, epoch):
        table.write(J.incremental_pairs(batch), epoch)

    total = {}
    for n, items in enumerate(([3, 1, 2], [1, 2], [2, 1, 1], [5])):
        spark.createDataFrame([(items,)], "items array<long>").coalesce(1).write.mode("append").parquet(str(files))
        source = spark.readStream.schema("items array<long>").parquet(str(files))
        q = source.writeStream.foreachBatch(count).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        total[n] = {(r.src, r.dst): r["count"] for r in table.read().collect()}
    assert total == {0: {(1, 2): 1, (1, 3): 1, (2, 3): 1}, 1: {(1, 2): 2, (1, 3): 1, (2, 3): 1}, 2: {(1, 2): 3, (1, 3): 1, (2, 3): 1}, 3: {(1, 2): 3, (1, 3): 1, (2, 3): 1}}


def test_first_wins_by_source(spark, tmp_path):
    """The copy of the best source passes, once, though it came second; after the time it is remembered an equal set passes again."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    shape = "ts timestamp, source_rank long, items array<string>"
    batches = [
        [("2024-01-01 00:00:00", 2, ["a", "b"]), ("2024-01-01 00:00:10", 3, ["c"])],
        [("2024-01-01 00:01:00", 1, ["b", "a"])],
        [("2024-01-01 01:00:00", 9, ["x"])],
        [("2024-01-01 01:00:01", 0, ["a", "b"])],
        [("2024-01-01 03:00:00", 9, ["y"])],
        [("2024-01-01 03:00:10", 5, ["a", "b"])],
        [("2024-01-01 05:00:00", 9, ["z"])],
        [("2024-01-01 05:00:01", 9, ["z"])],
    ]
    try:
        for i, rows in enumerate(batches):
            df = spark.createDataFrame(rows, shape.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            source = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
            best = J.first_wins_by_source(source, "ts", "0 seconds", hold=600, keep=3600)
            best.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        got = sorted((str(r.ts), r.source_rank, sorted(r["items"])) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert [x for x in got if x[2] == ["a", "b"]] == [("2024-01-01 00:01:00", 1, ["a", "b"]), ("2024-01-01 03:00:10", 5, ["a", "b"])]
        assert [x[1] for x in got if x[2] == ["c"]] == [3]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_aliases_given_twice_and_many(spark, tmp_path, monkeypatch):
    alias = spark.createDataFrame([("salt", 1), ("salt", 7), ("egg", 2), ("egg", 2), (None, 3)], "surface string, item_id long")
    got = drained(J.normalised(stream(spark, tmp_path, "n2", ROWS), alias).select("ts", "items"), "normalised2", "append")
    assert sorted(r["items"] for r in got) == [[], [], [1, 2, 7], [1, 2, 7]]
    slots = drained(J.normalised_slots(stream(spark, tmp_path, "n3", ROWS), alias).select("source", "item_id"), "slots", "append")
    assert sorted((r.source, r.item_id) for r in slots) == [(s, i) for s in "ab" for i in (1, 2, 7)]
    monkeypatch.setattr(J, "MOST_SURFACES", 1)
    with pytest.raises(ValueError, match="normalised_slots"):
        J.normalised(stream(spark, tmp_path, "n4", ROWS), alias)


def test_scores_against_a_static_graph(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.5), (1, 3, 0.2), (2, 3, 0.4)], "a long, b long, weight double")
    baskets = stream(spark, tmp_path, "b", [(7, [1, 2])], "basket_id long, items array<long>")
    got = drained(J.scored(baskets, edges), "scored", "update")
    assert [(r.basket_id, r.b, r.score) for r in got] == [(7, 3, 0.6)]
