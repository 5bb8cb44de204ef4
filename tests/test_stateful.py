"""Streams with states against their batch twins, over restarts and past their end."""

from __future__ import annotations

import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.streaming import messages as M
from plumbline.streaming import stateful as S

BEGIN = datetime(2024, 1, 1)


def at(seconds: float) -> datetime:
    return BEGIN + timedelta(seconds=seconds)


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, S.STORE)
    yield
    spark.conf.set(name, before)


class Feed:
    """A folder of files that a stream reads, a file a micro-batch; every run starts from the checkpoint of the one before."""

    def __init__(self, spark, path, schema: str, operator):
        self.spark, self.path, self.schema, self.operator = spark, path, schema, operator

    def add(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def run(self) -> list:
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")
        if "time" in stream.columns:
            stream = stream.withWatermark("time", "0 seconds")
        out = self.operator(stream)
        query = out.writeStream.format("parquet").option("path", f"{self.path}/out").option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return self.spark.read.schema(out.schema).parquet(f"{self.path}/out").collect()

    def state(self, name: str) -> int:
        return self.spark.read.format("statestore").option("stateVarName", name).load(f"{self.path}/checkpoint").count()


GROUPS = "client long, seq long, type string, payload string, time timestamp"


def test_groups_are_released_when_they_end_or_dropped(spark, store, tmp_path):
    feed = Feed(spark, tmp_path, GROUPS, lambda s: S.released_groups(s, 30))
    first = [(1, 0, "x", "a", at(0)), (1, 1, S.START, None, at(1)), (1, 2, "x", "b", at(1)), (1, 3, S.START, None, at(1)), (2, 0, "x", "p", at(1)), (2, 1, S.START, None, at(1)), (2, 2, "x", "lost", at(2))]
    second = [(1, 4, "x", "c", at(3)), (1, 5, S.END, None, at(3)), (1, 6, "x", "d", at(3)), (1, 7, S.END, None, at(4)), (1, 8, "x", "e", at(4))]
    feed.add(first)
    assert Counter(r["payload"] for r in feed.run()) == {"a": 1, "p": 1}
    assert feed.state("held") == 2
    feed.add(second)
    got = feed.run()
    want = M.closed_groups(spark.createDataFrame(first + second, GROUPS)).select("client", "seq", "type", "payload").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))
    for late in (100, 101, 200):  # the watermark passes what client 2 never ended
        feed.add([(3, late, "x", str(late), at(late))])
    assert "lost" not in {r["payload"] for r in feed.run()}
    assert feed.state("held") == feed.state("level") == feed.state("due") == 0


ROOMS = "room string, seq long, type string, client long, key string, payload string, time timestamp"


def test_late_joiners_get_the_compacted_past(spark, store, tmp_path):
    rows = [("r", i, "message", None, f"k{i % 3}", f"v{i}", at(i)) for i in range(12)]
    rows[5:5] = [("r", 5, "join", 7, None, None, at(5))]
    rows = [(r, i, *rest) for i, (r, _, *rest) in enumerate(rows)] + [("r", 13, "join", 8, None, None, at(13)), ("r", 14, "leave", 7, None, None, at(13)), ("r", 15, "message", None, "k0", "last", at(14))]
    feed = Feed(spark, tmp_path, ROOMS, lambda s: S.sent_to_clients(s, 60))
    for a, b in ((0, 4), (4, 9)):
        feed.add(rows[a:b])
    feed.run()
    feed.add(rows[9:])
    got = Counter((r["client"], r["seq"], r["key"], r["payload"]) for r in feed.run())
    messages = spark.createDataFrame([r for r in rows if r[2] == "message"], ROOMS).select("key", "seq", "payload")
    want = Counter()
    for client, joined, left in ((7, 5, 14), (8, 13, 99)):
        want += Counter((client, r["seq"], r["key"], r["payload"]) for r in M.replay(messages.limit(0), messages, ["key"], joined).collect() if r["seq"] < left)
    assert got == want
    assert feed.state("latest") == 3
    for late in (300, 301):
        feed.add([("other", late, "leave", 1, None, None, at(late))])
    feed.run()
    assert feed.state("clients") == 0 and feed.state("latest") == 0


PARTS = "uuid string, seq long, part int, total long, chunk binary, time timestamp"


def test_transfers_complete_or_expire(spark, store, tmp_path):
    files = spark.createDataFrame([("u", bytearray(range(250))), ("half", bytearray(100)), ("w", bytearray(b"xyz"))], "uuid string, content binary")
    parts = M.split_transfer(files, 50).withColumn("seq", F.col("part").cast("long")).withColumn("time", F.lit(BEGIN)).select("uuid", "seq", "part", "total", "chunk", "time").collect()
    feed = Feed(spark, tmp_path, PARTS, lambda s: S.reassembled_stream(s, 30))
    of = lambda uuid, when: [(*tuple(r)[:-1], at(when)) for r in parts if r["uuid"] == uuid]
    u = of("u", 0)
    feed.add([u[4], u[1], u[1], of("half", 0)[0]])
    feed.add([of("u", 1)[0], *of("w", 1)])
    feed.run()
    u = of("u", 2)
    feed.add([u[3], u[2], u[4]])
    feed.add([of("u", 3)[0]])
    got = feed.run()
    assert {r["uuid"]: bytes(r["content"]) for r in got if r["content"] is not None} == {"u": bytes(range(250)), "w": b"xyz"}
    assert sorted(r["received"] for r in got if r["uuid"] == "u") == [100, 150, 250]
    assert feed.state("parts") == 1
    for late in (100, 200):
        feed.add([("end", late, 0, 1, bytearray(b"."), at(late))])
    feed.run()
    assert feed.state("parts") == 0 and feed.state("done") <= 1


def test_repeated_values_are_passed_over(spark, store, tmp_path):
    kind = "key string, seq long, value string"
    rows = [(k, i, v) for k in "ab" for i, v in enumerate(["x", "x", None, None, "y", "x", "x"])]
    feed = Feed(spark, tmp_path, kind, lambda s: S.changed_stream(s))
    feed.add([r for r in rows if r[1] < 4])
    feed.run()
    feed.add([r for r in rows if r[1] >= 4])
    want = M.changed(spark.createDataFrame(rows, kind), ["key"], "value").collect()
    assert Counter(map(tuple, feed.run())) == Counter(map(tuple, want))


def test_a_value_is_forgotten_after_its_time(spark, store, tmp_path):
    kind = "key string, seq long, value string"
    spark.createDataFrame([("a", 0, "x"), ("a", 1, "x")], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = S.changed_stream(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), 1.0)
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="500 milliseconds").start()
    seen = lambda: sorted(r["seq"] for r in spark.read.schema(kind).parquet(f"{tmp_path}/out").collect()) if (tmp_path / "out").exists() else []
    try:
        for seqs in ([0], [0, 2]):
            for _ in range(40):
                if seen() == seqs:
                    break
                time.sleep(0.5)
            assert seen() == seqs
            time.sleep(2.5)
            if seqs == [0]:
                spark.createDataFrame([("a", 2, "x")], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    finally:
        query.stop()
