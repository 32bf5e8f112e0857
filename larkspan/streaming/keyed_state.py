"""State by key that ends by itself: sign-in locks, cached answers and a latched notice, as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .attempts import LOCK, PAUSE_MIN

PAUSE_US = PAUSE_MIN * 60_000_000


class Attempts(StatefulProcessor):
    """A user's open islands of attempts: those between which less than PAUSE_MIN minutes pass are one; exactly that pause parts them.

    State is first, last and number of each island that may still grow, so a flood of attempts is one row, and attempts may come in any order.
    A timer puts an island out and forgets it when the watermark has passed its pause.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("islands", "first array<long>, last array<long>, n array<long>")

    def _held(self) -> list[tuple[int, int, int]]:
        return list(zip(*self.state.get(), strict=True)) if self.state.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found: list[tuple[int, int, int]] = []
        for first, last, n in sorted([*self._held(), *((t, t, 1) for batch in rows for t in batch["us"].tolist())]):
            if found and first - found[-1][1] < PAUSE_US:
                found[-1] = (found[-1][0], max(last, found[-1][1]), found[-1][2] + n)
            else:
                found.append((first, last, n))
        self.state.update(tuple(list(x) for x in zip(*found, strict=True)))
        due = {(last + PAUSE_US + 999) // 1000 for _, last, _ in found}
        for timer in set(self.handle.listTimers()) - due:
            self.handle.deleteTimer(timer)
        for timer in due:
            self.handle.registerTimer(timer)
        yield self._out(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, held = timerValues.getCurrentWatermarkInMs() * 1000, self._held()
        open_ = [x for x in held if x[1] + PAUSE_US > now]
        if open_:
            self.state.update(tuple(list(x) for x in zip(*open_, strict=True)))
        else:
            self.state.clear()
        yield self._out(key, [x for x in held if x[1] + PAUSE_US <= now])

    @staticmethod
    def _out(key, islands: list[tuple[int, int, int]]) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [key[0]] * len(islands), "first": [a for a, _, _ in islands], "last": [b for _, b, _ in islands], "n": [n for *_, n in islands]}, columns=["user_id", "first", "last", "n"])

    def close(self) -> None:
        pass


def attempt_locks(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """user_id, first, last, n, locked of a stream of attempts (user_id, ts): the islands of `attempt_islands`, each once it has ended.

    An island ends when the watermark has passed its pause. Attempts later than `late` are not counted.
    """
    rows = stream.filter("user_id is not null and ts is not null").withWatermark("ts", late).select("user_id", "ts", F.unix_micros("ts").alias("us"))
    kind = rows.schema["user_id"].dataType.simpleString()
    found = rows.groupBy("user_id").transformWithStateInPandas(Attempts(), f"user_id {kind}, first long, last long, n long", "append", "eventTime")
    at = lambda c: F.timestamp_micros(c).alias(c)
    return found.select("user_id", at("first"), at("last"), "n", (F.col("n") >= LOCK).alias("locked"))


class Latch(StatefulProcessor):
    """Says once that a queue has reached its limit, and again only after it has fallen below."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latch", "pending long, us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = sorted((t, n) for batch in rows for t, n in zip(batch["us"].tolist(), batch["pending"].tolist(), strict=True))
        before, newest = self.state.get() if self.state.exists() else (0, -(1 << 62))
        said = []
        for t, n in seen:
            if t < newest:
                continue
            if before < self.limit <= n:
                said.append((t, n))
            before, newest = n, t
        self.state.update((before, newest))
        yield pd.DataFrame({"queue": [key[0]] * len(said), "us": [t for t, _ in said], "pending": [n for _, n in said]}, columns=["queue", "us", "pending"])

    def close(self) -> None:
        pass


def queue_alerts(stream: DataFrame, limit: int = 250) -> DataFrame:
    """queue, ts, pending: each time a queue's length (queue, ts, pending) has come from below the limit to it or above."""
    rows = stream.filter("queue is not null and ts is not null and pending is not null").select("queue", F.unix_micros("ts").alias("us"), F.col("pending").cast("long").alias("pending"))
    kind = rows.schema["queue"].dataType.simpleString()
    found = rows.groupBy("queue").transformWithStateInPandas(Latch(limit), f"queue {kind}, us long, pending long", "append", "None")
    return found.select("queue", F.timestamp_micros("us").alias("ts"), "pending")


class Recent(StatefulProcessor):
    """Keeps a question's answer for a time to live, and says which questions must be asked."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("asked", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = self.state.get()[0] if self.state.exists() else None
        out = []
        for t in sorted(t for batch in rows for t in batch["us"].tolist()):
            if asked is None or t - asked >= self.seconds * 1_000_000:
                asked = t
                out.append(t)
        self.state.update((asked,))
        yield pd.DataFrame({"question": [key[0]] * len(out), "us": out}, columns=["question", "us"])

    def close(self) -> None:
        pass


def to_ask(stream: DataFrame, seconds: int) -> DataFrame:
    """question, ts: those of a stream of questions (question, ts) whose answer is not younger than `seconds`, by the questions' own times."""
    rows = stream.filter("question is not null and ts is not null").select("question", F.unix_micros("ts").alias("us"))
    found = rows.groupBy("question").transformWithStateInPandas(Recent(seconds), "question string, us long", "append", "None")
    return found.select("question", F.timestamp_micros("us").alias("ts"))
