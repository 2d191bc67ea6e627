"""Sentences of live sessions, matched against commands: arbitrary state with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .matcher import find_command

OUT = "session string, kind string, first_seq long, last_seq long, command string, score double, sentence string"
_NAMES = [f.split()[0] for f in OUT.split(", ")]


class Sentences(StatefulProcessor):
    """Per session: the pieces of the sentence so far (a list), the last seq taken (a value), and a timer.

    A piece goes on the sentence; when the sentence comes to hold a command, a row of kind ``command`` tells it and the
    sentence starts afresh.  Of a sentence the last pieces that a command could still need are kept.  Pieces that were taken before
    (seq no larger than the last) are ignored.  A session without pieces for ``idle_ms`` is closed by its timer: kind
    ``idle`` tells what is left of its sentence, and its state goes.  ``event_time`` names the column by which idleness is
    told; without it the clock tells."""

    def __init__(self, commands: list[str], threshold: float = 0.35, window: int = 64, idle_ms: int = 60_000, event_time: str | None = None):
        self.commands, self.threshold, self.idle_ms, self.event_time = commands, threshold, idle_ms, event_time
        self.keep = max(window, max(map(len, commands), default=0) + 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", "seq long, text string")
        self.last = handle.getValueState("last", "seq long")

    def _rows(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(rows, columns=_NAMES).astype({"first_seq": "Int64", "last_seq": "Int64", "score": "float64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        held = [(int(p[0]), p[1]) for p in self.pieces.get()] if self.pieces.exists() else []
        parts, out = list(rows), []
        for seq, text in sorted((r for part in parts for r in zip(part["seq"], part["text"], strict=True)), key=lambda r: r[0]):
            if last is not None and seq <= last:
                continue
            last = int(seq)
            held.append((last, text or ""))
            recent = "".join(t for _, t in held)[-self.keep - len(text or "") :]
            command, score = find_command(recent, self.commands, self.threshold)
            if command is not None:
                out.append((key[0], "command", held[0][0], last, command, score, "".join(t for _, t in held)))
                held = []
            while held and sum(len(t) for _, t in held[1:]) >= self.keep:
                held = held[1:]
        if last is not None:
            self.last.update((last,))
        self.pieces.put(held) if held else self.pieces.clear()
        if self.event_time:
            now = max(int(part[self.event_time].max().timestamp() * 1000) for part in parts)
        else:
            now = timerValues.getCurrentProcessingTimeInMs()
        timers = list(self.handle.listTimers())
        until = max([now + self.idle_ms, *timers])
        for timer in timers:
            if timer != until:
                self.handle.deleteTimer(timer)
        if until not in timers:
            self.handle.registerTimer(until)
        yield from self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [(int(p[0]), p[1]) for p in self.pieces.get()] if self.pieces.exists() else []
        self.pieces.clear()
        self.last.clear()
        yield from self._rows([(key[0], "idle", held[0][0] if held else None, held[-1][0] if held else None, None, None, "".join(t for _, t in held))])

    def close(self) -> None:
        pass


def sentence_events(pieces: DataFrame, commands: list[str], *, event_time: str | None = None, **options) -> DataFrame:
    """The events of all sessions of a streaming frame (session, seq, text).

    With ``event_time``, a column with a watermark, a session is idle when the watermark has passed its last piece by ``idle_ms``;
    else by the clock (such a query goes on running empty batches, so it needs a trigger that does).  The session's state
    store must be RocksDB (``use_rocksdb``)."""
    rows = pieces.withColumn("session", pieces["session"].cast("string")).select("session", "seq", "text", *([event_time] if event_time else []))
    return rows.groupBy("session").transformWithStateInPandas(Sentences(commands, event_time=event_time, **options), OUT, "append", "eventTime" if event_time else "processingTime")


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
