"""The message plane as streams with a state for each key: list, map and value states, timers and time to live.

Keys are spread by Spark, each with its state in a RocksDB store (the session's
``spark.sql.streaming.stateStore.providerClass`` must name it). Streams need a watermark on ``time``:
what never ends expires once the watermark has passed its last message by ``patience`` seconds, so no
state outlives its use. Messages of a key must come with ascending ``seq`` from one micro-batch to
the next; within one they are sorted. As in any stream with a watermark, rows at or before it are late
and left out, so its delay has to allow for how far messages come out of the order of their times.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

START, END = "atomic_start", "atomic_end"

#: The state store that list states, map states and timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _sorted(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    frames = [pdf for pdf in rows if len(pdf)]
    return pd.concat(frames).sort_values("seq", kind="stable") if frames else pd.DataFrame()


def _millis(times: pd.Series) -> int:
    last = times.max()
    return 0 if pd.isna(last) else int(last.timestamp() * 1000)


class _Expiring(StatefulProcessor):
    """A state that is cleared ``patience`` milliseconds after its key's last message."""

    def __init__(self, patience: float):
        self.patience = int(patience * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "ms long")

    def extend(self, last: int) -> None:
        """Moves the key's one timer to after its last message."""
        have = self.due.get()[0] if self.due.exists() else None
        due = max(last + self.patience, have or 0)
        if due != have:
            if have is not None:
                self.handle.deleteTimer(have)
            self.handle.registerTimer(due)
            self.due.update((due,))

    def settle(self) -> None:
        """Nothing is kept any more: no timer either."""
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()

    def forget(self) -> None:
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.due.exists() and self.due.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.due.clear()
            self.forget()
        return iter(())

    def close(self) -> None:
        pass


class AtomicGroups(_Expiring):
    """Lets messages through, but holds back those of a group until it ends."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.level = handle.getValueState("level", "n int")
        self.held = handle.getListState("held", "seq long, type string, payload string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _sorted(rows)
        if not len(pdf):
            return
        level, out, held = self.level.get()[0] if self.level.exists() else 0, [], []
        for seq, kind, payload in zip(pdf["seq"], pdf["type"], pdf["payload"], strict=True):
            if kind == START:
                level += 1
            elif kind == END:
                level -= 1
                if level == 0:
                    out += [*(self.held.get() if self.held.exists() else ()), *held]
                    self.held.clear()
                    held = []
            else:
                (held if level else out).append((int(seq), kind, payload))
        if held:
            self.held.appendList(held)
        if level:
            self.level.update((level,))
            self.extend(_millis(pdf["time"]))
        else:
            self.level.clear()
            self.settle()
        if out:
            found = pd.DataFrame(out, columns=["seq", "type", "payload"])
            found.insert(0, "client", key[0])
            yield found

    def forget(self) -> None:
        self.held.clear()
        self.level.clear()


class LateJoiners(_Expiring):
    """Sends every client of a room its messages, and one that joins first the last message of each key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.latest = handle.getMapState("latest", "key string", "seq long, payload string")
        self.clients = handle.getMapState("clients", "client long", "joined long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _sorted(rows)
        if not len(pdf):
            return
        clients = {k[0] for k in self.clients.keys()} if self.clients.exists() else set()
        out = []
        for seq, kind, client, name, payload in zip(pdf["seq"], pdf["type"], pdf["client"], pdf["key"], pdf["payload"], strict=True):
            if kind == "join":
                clients.add(int(client))
                self.clients.updateValue((int(client),), (int(seq),))
                out += [(int(client), v[0], k[0], v[1]) for k, v in (self.latest.iterator() if self.latest.exists() else ())]
            elif kind == "leave":
                clients.discard(int(client))
                self.clients.removeKey((int(client),))
            else:
                self.latest.updateValue((name,), (int(seq), payload))
                out += [(c, int(seq), name, payload) for c in clients]
        self.extend(_millis(pdf["time"]))
        if out:
            found = pd.DataFrame(out, columns=["client", "seq", "key", "payload"])
            found.insert(0, "room", key[0])
            yield found

    def forget(self) -> None:
        self.latest.clear()
        self.clients.clear()


class Transfers(_Expiring):
    """Puts parts in any order together; each micro-batch acknowledges the bytes that are there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.parts = handle.getMapState("parts", "part int", "chunk binary")
        self.received = handle.getValueState("received", "bytes long")
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _sorted(rows)
        if not len(pdf) or self.done.exists():
            return
        n = self.received.get()[0] if self.received.exists() else 0
        for part, chunk in zip(pdf["part"], pdf["chunk"], strict=True):
            if not self.parts.containsKey((int(part),)):
                self.parts.updateValue((int(part),), (bytes(chunk),))
                n += len(chunk)
        total, content = int(pdf["total"].iloc[0]), None
        if n == total:
            content = b"".join(bytes(v[0]) for _, v in sorted(self.parts.iterator(), key=lambda x: x[0][0]))
            self.parts.clear()
            self.received.clear()
            self.done.update((True,))  # parts that come again are passed over until this expires
        else:
            self.received.update((n,))
        self.extend(_millis(pdf["time"]))
        yield pd.DataFrame({"uuid": [key[0]], "received": [n], "total": [total], "content": [content]})

    def forget(self) -> None:
        self.parts.clear()
        self.received.clear()
        self.done.clear()


class Changes(StatefulProcessor):
    """Messages whose value differs from the last of their key; a value is forgotten after its time to live."""

    def __init__(self, live: float | None):
        self.live = None if live is None else int(live * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value string", self.live)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _sorted(rows)
        if not len(pdf):
            return
        known, last, out = self.last.exists(), self.last.get()[0] if self.last.exists() else None, []
        for seq, value in zip(pdf["seq"], pdf["value"], strict=True):
            value = None if pd.isna(value) else value
            if not known or value != last:
                out.append((int(seq), value))
                known, last = True, value
        if out:
            self.last.update((last,))
            found = pd.DataFrame(out, columns=["seq", "value"])
            found.insert(0, "key", key[0])
            yield found

    def close(self) -> None:
        pass


def _kind(stream: DataFrame, column: str) -> str:
    return dict(stream.dtypes)[column]


def released_groups(stream: DataFrame, patience: float = 60.0) -> DataFrame:
    """``(client, seq, type, payload, time)`` without group marks; a group's messages come when as many marks have ended as begun.

    A group that hasn't ended ``patience`` seconds after its last message is dropped.
    """
    return stream.groupBy("client").transformWithStateInPandas(AtomicGroups(patience), f"client {_kind(stream, 'client')}, seq long, type string, payload string", "Append", "EventTime")


def sent_to_clients(stream: DataFrame, patience: float = 3600.0) -> DataFrame:
    """``(room, seq, type, client, key, payload, time)`` to (room, client, seq, key, payload): what each client gets.

    ``join`` and ``leave`` rows name a client; all others are messages with a key. A room without
    any row for ``patience`` seconds is forgotten, its clients and last messages with it.
    """
    return stream.groupBy("room").transformWithStateInPandas(LateJoiners(patience), f"room {_kind(stream, 'room')}, client long, seq long, key string, payload string", "Append", "EventTime")


def reassembled_stream(stream: DataFrame, patience: float = 600.0) -> DataFrame:
    """``(uuid, seq, part, total, chunk, time)`` to (uuid, received, total, content): an acknowledgement a micro-batch, with the content once it is whole.

    Parts sent twice count once. A transfer without a new part for ``patience`` seconds is forgotten.
    """
    return stream.groupBy("uuid").transformWithStateInPandas(Transfers(patience), f"uuid {_kind(stream, 'uuid')}, received long, total long, content binary", "Append", "EventTime")


def changed_stream(stream: DataFrame, live: float | None = None) -> DataFrame:
    """``(key, seq, value string)`` without messages that repeat their key's last value.

    ``live`` is for how many seconds a value is remembered. It runs on the clock, which makes
    micro-batches without an end: give such a stream a processing-time trigger.
    """
    return stream.groupBy("key").transformWithStateInPandas(Changes(live), f"key {_kind(stream, 'key')}, seq long, value string", "Append", "None" if live is None else "ProcessingTime")
