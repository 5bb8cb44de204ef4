"""Keyed scene messages ``(seq, type, name, uuid, props map<string, string>, group_id, sender)``.

Every operator takes a batch; those marked so also take a stream, or are what a stream's
foreachBatch applies to each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Types that create a node, remove it, or update it; create and remove share a key.
REMOVE = "remove"

#: The most messages of a micro-batch, and its longest wait in seconds.
WINDOW_MESSAGES, WINDOW_SECONDS = 128, 1 / 60


def redundancy_key(kind: Column, name: Column, uuid: Column, props: Column | None = None, index: Column | None = None, part: Column | None = None) -> Column:
    """The key by which a later message replaces an earlier one.

    Create and remove of a node share ``node``. Updates append their properties' names in the order
    in which they were set, so {a, b} and {b, a} stay apart. Bones append an index, transfers a part.
    """
    base = F.when(kind.isin("create", REMOVE), F.lit("node")).otherwise(kind)
    parts = [base, F.coalesce(name, uuid, F.lit(""))]
    if props is not None:
        parts.append(F.when(kind == "update", F.array_join(F.map_keys(props), ",")))
    parts += [x.cast("string") for x in (index, part) if x is not None]
    return F.concat_ws("|", *parts)


def compacted(messages: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """The last message of each key."""
    rest = [c for c in messages.columns if c not in keys]
    return messages.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("m")).select(*keys, *(F.col(f"m.{c}").alias(c) for c in rest))


def collected(messages: DataFrame, node: str = "name", seq: str = "seq", removed: Column | None = None) -> DataFrame:
    """Drops removals, and messages of a node older than its last removal."""
    gone = removed if removed is not None else F.col("type") == REMOVE
    last = messages.filter(gone).groupBy(node).agg(F.max(seq).alias("_removed"))
    kept = messages.filter(~gone).join(last, node, "left")
    return kept.filter(F.col("_removed").isNull() | (F.col(seq) > F.col("_removed"))).drop("_removed")


def without(messages: DataFrame, predicate: Column) -> DataFrame:
    """Deletes messages that fit."""
    return messages.filter(~F.coalesce(predicate, F.lit(False)))


def others_than(messages: DataFrame, client: int) -> DataFrame:
    """Messages that the client didn't send itself."""
    return messages.filter(F.col("sender").isNull() | (F.col("sender") != client))


def changed(messages: DataFrame, keys: Sequence[str], value: str, seq: str = "seq") -> DataFrame:
    """Messages whose value differs from the one before of the same key."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(seq))
    first = F.row_number().over(W.partitionBy(*keys).orderBy(seq)) == 1
    return messages.withColumn("_same", F.col(value).eqNullSafe(before) & ~first).filter("NOT _same").drop("_same")


def merged_updates(state: DataFrame, updates: DataFrame) -> DataFrame:
    """Property lookup by key: updates of unknown handles are ignored."""
    return updates.join(state.select("uuid"), "uuid", "left_semi")


def micro_batches(messages: DataFrame, size: int = WINDOW_MESSAGES, seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Numbers windows of at most ``size`` messages and ``seconds``: a pause starts a new one. Needs (client, seq, time)."""
    w = W.partitionBy("client").orderBy("seq")
    start = (F.coalesce(F.col("time") - F.lag("time").over(w), F.lit(0.0)) > seconds).cast("int")
    runs = messages.withColumn("_run", F.sum(start).over(w))
    place = F.row_number().over(W.partitionBy("client", "_run").orderBy("seq")) - 1
    runs = runs.withColumn("_part", F.floor(place / size))
    return runs.withColumn("window", F.dense_rank().over(W.partitionBy("client").orderBy("_run", "_part"))).drop("_run", "_part")


def closed_groups(messages: DataFrame) -> DataFrame:
    """Messages outside of groups and those of groups that have ended: ``atomic_end`` closes as many as ``atomic_start`` opened."""
    level = F.sum(F.when(F.col("type") == "atomic_start", 1).when(F.col("type") == "atomic_end", -1).otherwise(0)).over(W.partitionBy("client").orderBy("seq"))
    marked = messages.withColumn("_level", level)
    last = F.last(F.when(F.col("_level") == 0, F.col("seq")), True).over(W.partitionBy("client").orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return marked.withColumn("_last", last).filter((F.col("seq") <= F.col("_last")) & ~F.col("type").isin("atomic_start", "atomic_end")).drop("_level", "_last")


def replay(snapshot: DataFrame, changes: DataFrame, keys: Sequence[str], joined_at: int, persistent: bool = True) -> DataFrame:
    """What a client that joins at a sequence number gets: the compacted state before (if persistent), then the changes."""
    later = changes.filter(F.col("seq") >= joined_at)
    before = compacted(changes.filter(F.col("seq") < joined_at).unionByName(snapshot), keys)
    return before.unionByName(later.select(*before.columns)) if persistent else later


def split_transfer(files: DataFrame, size: int = 1 << 20) -> DataFrame:
    """``(uuid, content binary)`` in parts: (uuid, part, total, chunk)."""
    n = F.greatest(F.ceil(F.octet_length("content") / size), F.lit(1)).cast("int")
    parts = files.select("uuid", "content", n.alias("parts"), F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    return parts.select("uuid", "part", "parts", F.octet_length("content").alias("total"), F.substring("content", F.col("part") * size + 1, F.lit(size)).alias("chunk"))


def reassembled(parts: DataFrame) -> DataFrame:
    """Complete transfers from parts in any order: (uuid, content). Parts sent twice count once."""
    once = parts.dropDuplicates(["uuid", "part"])
    whole = once.groupBy("uuid").agg(F.array_sort(F.collect_list(F.struct("part", "chunk"))).alias("p"), F.sum(F.octet_length("chunk")).alias("n"), F.max("total").alias("total"))
    return whole.filter("n = total").select("uuid", F.aggregate("p", F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["chunk"])).alias("content"))


def acknowledged(parts: DataFrame) -> DataFrame:
    """Bytes received so far after each part."""
    w = W.partitionBy("uuid").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return parts.withColumn("received", F.sum(F.octet_length("chunk")).over(w))


def typed(messages: DataFrame, payload: str, schema: str) -> DataFrame:
    """Parses a JSON payload with coercion to the declared types; what doesn't parse is null."""
    return messages.withColumn(payload, F.from_json(payload, schema))


def sessions(connections: DataFrame) -> DataFrame:
    """``(client, seq, event connect/disconnect)``: (client, connected, disconnected), open ones with null."""
    w = W.partitionBy("client").orderBy("seq")
    return connections.withColumn("_next", F.lead("seq").over(w)).filter("event = 'connect'").select("client", F.col("seq").alias("connected"), F.col("_next").alias("disconnected"))


def recorded(messages: DataFrame, keep: Column, fps: float) -> DataFrame:
    """A recording's messages with their virtual time: waits add up, other messages take none."""
    wait = F.when(F.col("type") == "sleep", F.col("seconds")).otherwise(F.lit(0.0))
    clock = F.sum(wait).over(W.partitionBy("recording").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    return messages.withColumn("time", clock).filter(keep & (F.col("type") != "sleep")).withColumn("frame", F.floor(F.col("time") * fps).cast("long"))


# streams


def compact_stream(stream: DataFrame, keys: Sequence[str], table: str, checkpoint: str, seq: str = "seq") -> StreamingQuery:
    """Keeps the compacted state of a stream in a folder of snapshots, one a micro-batch: ``table/v=<batch>``.

    A batch that runs again writes the same snapshot again. The last one is the state.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number:
            rows = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{table}/v={number - 1}"))
        compacted(rows, keys, seq).select(*batch.columns).write.mode("overwrite").parquet(f"{table}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stateful_compaction(stream: DataFrame, key: str, seq: str = "seq", payload: str = "payload") -> DataFrame:
    """Last-write-wins with one state a key: emits (key, seq, payload) when a newer message comes in."""

    def newest(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        have = state.get[0] if state.exists else None
        best = None
        for pdf in batches:
            row = pdf.loc[pdf[seq].idxmax()]
            if best is None or row[seq] > best[0]:
                best = (int(row[seq]), row[payload])
        if best is not None and (have is None or best[0] > have):
            state.update((best[0],))
            yield pd.DataFrame({key: [k[0]], seq: [best[0]], payload: [best[1]]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(newest, f"{key} {kind}, {seq} long, {payload} string", f"{seq} long", "append", "NoTimeout")


def dispatched(stream: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, kind: str = "type") -> StreamingQuery:
    """Sends the messages of each type in a micro-batch to its handler; others are passed over."""

    def route(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for name, handle in handlers.items():
                handle(batch.filter(F.col(kind) == name), number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flush(query: StreamingQuery) -> None:
    """Waits until all that has come in is through."""
    query.processAllAvailable()


def shut_down(queries: Sequence[StreamingQuery]) -> None:
    for query in queries:
        if query.isActive:
            query.stop()


# extensions: event time, which the message plane itself has not


def tumbling(events: DataFrame, time: str, width: str, by: Sequence[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def sliding(events: DataFrame, time: str, width: str, step: str, by: Sequence[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width, step), *by).agg(F.count("*").alias("n"))


def session(events: DataFrame, time: str, gap: str, by: Sequence[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))
