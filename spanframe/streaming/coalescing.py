"""Requests of a stream answered together: a batch closes when it holds enough of them or its first has waited long enough.

Requests wait in keyed state, dealt over shards by their id; a processing-time timer runs from a batch's first
request. A batch's items go to one call, and the answers are split by request again. State and timers
are in the state store, so a lost executor loses no request: its batch is put together again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_REQUEST = StructType([StructField("request", StringType()), StructField("items", ArrayType(StringType()))])
_ANSWER = StructType([StructField("shard", LongType()), StructField("batch", LongType()), StructField("size", LongType()), StructField("request", StringType()), StructField("answers", ArrayType(StringType()))])


class Waiting(StatefulProcessor):
    """A shard's waiting requests, at most `most - 1` between two calls."""

    def __init__(self, answer: Callable[[list[str]], list[str | None]], most: int, seconds: float):
        self.answer, self.most, self.wait = answer, most, int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _REQUEST)
        self.number = handle.getValueState("batches", StructType([StructField("n", LongType())]))
        self.due = handle.getValueState("due", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = [(r[0], list(r[1] or [])) for r in self.waiting.get()] if self.waiting.exists() else []
        was_waiting = bool(held)
        for r in rows:
            held.append((r["request"], list(r["items"] or [])))
            if len(held) == self.most:
                yield from self._answered(key[0], held)
                held, was_waiting = [], False
        self.waiting.clear()
        if held:
            self.waiting.put([Row(request=q, items=i) for q, i in held])
        if not was_waiting:
            self._settle()
            if held:
                at = timerValues.getCurrentProcessingTimeInMs() + self.wait
                self.handle.registerTimer(at)
                self.due.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = [(r[0], list(r[1] or [])) for r in self.waiting.get()] if self.waiting.exists() else []
        self.waiting.clear()
        self.due.clear()
        if held:
            yield from self._answered(key[0], held)

    def close(self) -> None:
        pass

    def _settle(self) -> None:
        """The timer of a batch that was full before it ran out."""
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()

    def _answered(self, shard: int, held: list[tuple[str, list[str]]]) -> Iterator[Row]:
        number = self.number.get()[0] + 1 if self.number.exists() else 0
        self.number.update((number,))
        flat = [item for _, items in held for item in items]
        said = self.answer(flat) if flat else []
        if len(said) != len(flat):
            raise ValueError(f"{len(flat)} items, {len(said)} answers")
        at = 0
        for request, items in held:
            yield Row(shard=shard, batch=number, size=len(held), request=request, answers=list(said[at : at + len(items)]))
            at += len(items)


def answered_together(requests: DataFrame, answer: Callable[[list[str]], list[str | None]], most: int, seconds: float, shards: int = 1) -> DataFrame:
    """(shard, batch, size, request, answers) of a stream of requests (request, items array<string>).

    A batch holds `most` requests of a shard, or those that came within `seconds` of its first. answer is called once
    a batch, with all its items in order, and gives as many answers. Requests without items have none; ones
    alike are answered each. The session's state store must be STATE_STORE.
    """
    dealt = requests.select(F.pmod(F.xxhash64("request"), F.lit(shards)).alias("shard"), "request", "items")
    return dealt.groupBy("shard").transformWithState(Waiting(answer, most, seconds), _ANSWER, "Append", "ProcessingTime")
