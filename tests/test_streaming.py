"""The message plane: worked cases, and streams against their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.streaming import messages as M

SCHEMA = "seq long, type string, name string, uuid string, props map<string, string>, client int, sender int"


def plane(spark, rows):
    return spark.createDataFrame([(i, t, n, None, p, 0, s) for i, (t, n, p, s) in enumerate(rows)], SCHEMA)


def keyed(df):
    return df.withColumn("key", M.redundancy_key(F.col("type"), F.col("name"), F.col("uuid"), F.col("props")))


def test_compaction_and_collection(spark):
    m = keyed(plane(spark, [("create", "k", {"v": "1"}, 1), ("create", "k", {"v": "2"}, 1), ("remove", "k", None, 1), ("create", "k", {"v": "3"}, 1)]))
    left = M.compacted(m, ["key"]).collect()
    assert len(left) == 1 and left[0]["props"] == {"v": "3"}
    m = keyed(plane(spark, [("create", "k", None, 1), ("update", "k", {"a": "1"}, 1), ("remove", "k", None, 1)]))
    left = M.compacted(m, ["key"])
    assert left.filter("type = 'remove'").count() == 1 and M.collected(left).count() == 0
    m = keyed(plane(spark, [("remove", "k", None, 1), ("create", "k", None, 1)]))
    assert M.collected(m).count() == 1
    ab, ba = (F.create_map(*map(F.lit, x)) for x in (("a", "1", "b", "2"), ("b", "1", "a", "2")))
    orders = keyed(plane(spark, [("update", "k", None, 1), ("update", "k", None, 1)]).withColumn("props", F.when(F.col("seq") == 0, ab).otherwise(ba)))
    assert orders.select("key").distinct().count() == 2


def test_filters_groups_and_windows(spark):
    m = plane(spark, [("create", "a", None, 1), ("create", "b", None, 2), ("create", "c", None, None)])
    assert [r["name"] for r in M.others_than(m, 1).orderBy("seq").collect()] == ["b", "c"]
    assert M.without(m, F.col("name") == "a").count() == 2
    g = plane(spark, [("x", "a", None, 1), ("atomic_start", None, None, 1), ("x", "b", None, 1), ("atomic_end", None, None, 1), ("atomic_start", None, None, 1), ("x", "c", None, 1)])
    assert [r["name"] for r in M.closed_groups(g).orderBy("seq").collect()] == ["a", "b"]
    t = spark.createDataFrame([(0, i, i * 0.001 + (5 if i >= 200 else 0)) for i in range(250)], "client int, seq long, time double")
    sizes = [r["count"] for r in M.micro_batches(t).groupBy("window").count().orderBy("window").collect()]
    assert sizes == [128, 72, 50]
    c = spark.createDataFrame([(1, 0, "connect"), (1, 5, "disconnect"), (2, 3, "connect")], "client int, seq long, event string")
    assert sorted(tuple(r) for r in M.sessions(c).fillna(-1).collect()) == [(1, 0, 5), (2, 3, -1)]
    assert M.replay(keyed(m).limit(0), keyed(m), ["key"], 2).count() == 3
    r = spark.createDataFrame([(0, 0, "sleep", 0.5), (0, 1, "x", None), (0, 2, "sleep", 0.25), (0, 3, "y", None)], "recording int, seq long, type string, seconds double")
    assert [(x["time"], x["frame"]) for x in M.recorded(r, F.lit(True), 4).orderBy("seq").collect()] == [(0.5, 2), (0.75, 3)]
    typed = M.typed(spark.createDataFrame([('{"a": 1}',)], "p string"), "p", "a double").first()
    assert typed["p"]["a"] == 1.0


def test_transfers(spark):
    files = spark.createDataFrame([("u", bytearray(range(256)) * 10), ("e", bytearray())], "uuid string, content binary")
    parts = M.split_transfer(files, 1000)
    assert parts.count() == 4
    whole = {r["uuid"]: bytes(r["content"]) for r in M.reassembled(parts.unionByName(parts).repartition(3)).collect()}
    assert whole == {"u": bytes(range(256)) * 10, "e": b""}
    assert M.reassembled(parts.filter("part != 1")).count() == 1
    acked = M.acknowledged(parts.filter("uuid = 'u'").withColumn("seq", F.col("part"))).orderBy("seq").collect()
    assert [r["received"] for r in acked] == [1000, 2000, 2560]


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i % 5, i, f"p{i}") for i in range(40)]
    schema = "key long, seq long, payload string"
    for n in range(2):
        spark.createDataFrame(rows[n * 20 : n * 20 + 20], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    M.compact_stream(stream(), ["key"], f"{tmp_path}/state", f"{tmp_path}/c1").awaitTermination()
    want = sorted(tuple(r) for r in M.compacted(spark.createDataFrame(rows, schema), ["key"]).collect())
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/state/v=1").select("key", "seq", "payload").collect()) == want
    query = M.stateful_compaction(stream(), "key").writeStream.format("memory").queryName("newest").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(tuple(r) for r in M.compacted(spark.table("newest"), ["key"]).select("key", "seq", "payload").collect()) == want
    seen = []
    M.dispatched(stream().withColumn("type", F.when(F.col("key") == 0, "zero").otherwise("other")), {"zero": lambda df, n: seen.append(df.count())}, f"{tmp_path}/c3").awaitTermination()
    assert sum(seen) == 8
