"""Streams: conversations by thread, status moves in their own order however they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues


def conversation_stream(messages: DataFrame) -> DataFrame:
    """Per thread the first user message's title and the last turn; update or complete mode."""
    user = F.when(F.col("role") == "user", F.struct("turn", "text"))
    return messages.groupBy("conv_id").agg(F.substring(F.min(user)["text"], 1, 50).alias("title"), F.max("turn").alias("last_turn"))


#: What a stream of moves says of each: an illegal one, or one that came after its turn.
MOVES = "entity long, event_id long, from_status string, to_status string, problem string"


class Moves(StatefulProcessor):
    """Per entity: moves wait until the watermark has passed them, then are judged in their own order, (time, number)."""

    def __init__(self, allowed: set[tuple[str, str]], initial: str):
        self.allowed, self.initial = allowed, initial

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string")
        self.waiting = handle.getListState("waiting", "at long, event_id long, status string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows))
        at = came["at"].astype("datetime64[us]").astype("int64")
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        on_time = at > passed
        late = came[~on_time]
        if on_time.any():
            held = self.waiting.exists()
            first = min([int(at[on_time].min()), *([min(w[0] for w in self.waiting.get())] if held else [])])
            self.waiting.appendList([(int(t), int(e), s) for t, e, s in zip(at[on_time], came["event_id"][on_time], came["status"][on_time], strict=True)])
            self.handle.registerTimer(first // 1000 + 1)
        yield pd.DataFrame({"entity": key[0], "event_id": late["event_id"], "from_status": None, "to_status": late["status"], "problem": "late"})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        moves = sorted(self.waiting.get()) if self.waiting.exists() else []
        left = [m for m in moves if m[0] > passed]
        last, bad = self.last.get()[0] if self.last.exists() else None, []
        for _, event, now in moves[: len(moves) - len(left)]:
            if now != last:
                if now != self.initial if last is None else (last, now) not in self.allowed:
                    bad.append((key[0], event, last, now, "illegal"))
                last = now
        if last is not None:
            self.last.update((last,))
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(left[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        yield pd.DataFrame(bad, columns=["entity", "event_id", "from_status", "to_status", "problem"])


def transition_stream(events: DataFrame, allowed: set[tuple[str, str]], initial: str, delay: str = "10 minutes", entity: str = "entity", status: str = "status", at: str = "ts", order: str = "event_id") -> DataFrame:
    """Illegal moves, each judged once the watermark, `delay` behind the latest event, has passed it; moves later than that are told as late.

    So an entity's events may come in any order and in any batch. State, the last status and what waits, is kept by
    RocksDB, which the session's setting of the state store's provider must name.
    """
    moves = events.select(F.col(entity).cast("long").alias("entity"), F.col(at).cast("timestamp").alias("at"), F.col(order).cast("long").alias("event_id"), F.col(status).alias("status")).withWatermark("at", delay)
    return moves.groupBy("entity").transformWithStateInPandas(Moves(allowed, initial), MOVES, "append", "eventtime")
