"""Stateful command matching over a stream of recognised pieces."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..workspace import as_pattern, scratch

_STRIP = str.maketrans("", "", "，。、？！?!,. ")


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        best = [i]
        for j, d in enumerate(b, 1):
            best.append(min(row[j] + 1, best[-1] + 1, row[j - 1] + (c != d)))
        row = best
    return row[-1]


def match(text: str, commands: list[str], threshold: float) -> tuple[str | None, float]:
    """The command nearest to a window of about its length; None above the threshold."""
    body, best = text.translate(_STRIP), (1.0, None)
    for command in commands if body else ():
        for n in (len(command) - 1, len(command), len(command) + 1):
            for i in range(max(1, len(body) - n + 1)) if n >= 1 else ():
                part = body[i : i + n]
                score = edit_distance(part, command) / max(len(part), len(command))
                if score < best[0]:
                    best = (score, command)
    return (best[1] if best[0] <= threshold else None), best[0]


#: Distances of windows are kept, as the same few characters come up in many pieces.
_distance = lru_cache(1 << 16)(edit_distance)


def find_command(text: str, commands: list[str], threshold: float) -> tuple[str | None, float]:
    """What ``match`` finds up to the threshold, else (None, 1.0).

    Within k edits one of k + 1 pieces of a command is whole in a window, no farther than k from its place: only windows
    around a piece are held against the command."""
    body, best = text.translate(_STRIP), (1.0, None)
    for command in commands:
        m = len(command)
        edits = int(threshold * (m + 1) + 1e-9)
        cut = [m * i // (edits + 1) for i in range(edits + 2)]
        last = max(0, len(body) - max(1, m - 1))
        starts: set[int] = set()
        for a, b in zip(cut, cut[1:], strict=False):
            if a == b:  # more edits than characters: any window may do
                starts.update(range(last + 1) if body else ())
                break
            at = body.find(command[a:b])
            while at >= 0:
                starts.update(range(max(0, at - a - edits), min(last, at - a + edits) + 1))
                at = body.find(command[a:b], at + 1)
        for i in starts:
            for n in (m - 1, m, m + 1):
                if n >= 1 and i <= max(0, len(body) - n):
                    part = body[i : i + n]
                    score = _distance(part, command) / max(len(part), m)
                    if score < best[0]:
                        best = (score, command)
    return (best[1], best[0]) if best[0] <= threshold else (None, 1.0)


def match_stream(pieces: DataFrame, commands: list[str], *, threshold: float = 0.35, window: int = 64) -> DataFrame:
    """(session, seq, command, score) whenever a session's sentence, grown piece by piece, comes to hold a command; the
    sentence then starts afresh.  Of a sentence the last ``window`` characters are kept (more than any command needs).

    ``pieces``: a streaming or batch frame (session, seq, text).  Within a micro-batch a session's pieces are taken in order
    of seq; state is the sentence so far."""
    longest = max(map(len, commands), default=0) + 1
    keep = max(window, longest)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sentence = state.get[0] if state.exists else ""
        rows = []
        for seq, text in sorted((r for p in parts for r in zip(p["seq"], p["text"], strict=True)), key=lambda r: r[0]):
            sentence += text or ""
            command, score = find_command(sentence[-keep - len(text or "") :], commands, threshold)
            if command is not None:
                rows.append((key[0], seq, command, score))
                sentence = ""
        state.update((sentence[-keep:],))
        yield pd.DataFrame(rows, columns=["session", "seq", "command", "score"]).astype({"session": "int64", "seq": "int64", "score": "float64"})

    return pieces.select("session", "seq", "text").groupBy("session").applyInPandasWithState(step, "session long, seq long, command string, score double", "sentence string", "append", GroupStateTimeout.NoTimeout)


def run_once(spark: SparkSession, path: str, columns: dict[str, str], commands: list[str], **options) -> DataFrame:
    """Stream the Parquet table at ``path`` through the matcher until it is used up; the results as a table."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(as_pattern(path)).selectExpr(*[f"{src} AS {dst}" for dst, src in columns.items()])
    out = scratch(spark, "matches")
    matched = match_stream(stream, commands, **options)
    query = matched.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(matched.schema).parquet(out)
