"""Operators that depend on order, on streams, as keyed state: what waits for a batch, and the last number, are kept in the state store."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.batch import FixedBatchSize
from ..operators.cache import EndCaching, StartCaching
from ..operators.fields import EnumerateField
from ..plans.core import FieldError, Operator, Pipeline

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PART, BATCH = "__part", "batch"


def _in_order(rows: Iterator[Row], order: tuple[str, ...]) -> Iterator[Row]:
    """The rows of one key and micro-batch by order, nulls first; as they come without one."""
    return iter(sorted(rows, key=lambda r: [(r[c] is not None, r[c]) for c in order])) if order else rows


class _Batches(StatefulProcessor):
    """Holds the rows of a key that fill no batch (fewer than size), and the number of batches made."""

    def __init__(self, size: int, names: tuple[str, ...], keys: tuple[str, ...], kind: T.StructType, order: tuple[str, ...], wait: int | None):
        self.size, self.names, self.keys, self.kind, self.order, self.wait = size, names, keys, kind, order, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.kind)
        self.made = handle.getValueState("made", "n long")

    def _batch(self, key: tuple, rows: list[tuple]) -> Row:
        n = self.made.get()[0] if self.made.exists() else 0
        self.made.update((n + 1,))
        columns = [[r[i] for r in rows] for i in range(len(self.names))]
        return Row(**dict(zip((*self.keys, PART, BATCH, *self.names), (*key, n, *columns), strict=True)))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = list(self.waiting.get()) if self.waiting.exists() else []
        for r in _in_order(rows, self.order):
            held.append(tuple(r[c] for c in self.names))
            if len(held) == self.size:
                yield self._batch(key, held)
                held = []
        self._keep(held)
        if self.wait is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if held:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)

    def _keep(self, held: list[tuple]) -> None:
        if held:
            self.waiting.put(held)
        else:
            self.waiting.clear()

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.waiting.exists():
            yield self._batch(key, list(self.waiting.get()))
            self.waiting.clear()

    def close(self) -> None:
        """Nothing is held outside the state store."""


class _Numbers(StatefulProcessor):
    """Holds how many rows of a key have a number."""

    def __init__(self, to: str, parts: int, names: tuple[str, ...], order: tuple[str, ...]):
        self.to, self.parts, self.names, self.order = to, parts, names, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        n = self.count.get()[0] if self.count.exists() else 0
        for r in _in_order(rows, self.order):
            yield Row(**{c: r[c] for c in self.names if c != self.to}, **{self.to: n * self.parts + r[PART]})
            n += 1
        self.count.update((n,))

    def close(self) -> None:
        """Nothing is held outside the state store."""


def use_state_store(spark: SparkSession) -> None:
    """Keyed state needs the store on disk; set for the session, whose checkpoints then belong to it."""
    spark.conf.set(_STORE, _ROCKS)


def keyed_stream(pipeline: Pipeline | Operator, stream: DataFrame, key: tuple[str, ...], order_by: tuple[str, ...] = (), rest_after_ms: int | None = None, parts: int = 1) -> DataFrame:
    """The pipeline on a stream, where its one operator that depends on order sees the rows of each value of key by themselves; a streaming DataFrame for any sink.

    FixedBatchSize: rows of a value are batched in the order in which micro-batches bring them, in a micro-batch by order_by; a batch has the fields as lists, the
    key, and the batch's number in its key. What fills no batch waits in the state store; rest_after_ms after the last row of its key it comes as a shorter batch (never, if
    missing: it stays until more rows come); its clock needs a trigger that goes on, as availableNow doesn't end while timers may be set. EnumerateField(same_id_for_repeated=False): the rows of a value are numbered 0, 1, 2, ...
    State is a key's waiting rows (fewer than batch_size) or one number; no group of all rows, no reading of earlier rows.
    parts splits each value by a hash of the row, for values that hold much of the stream: batches are then those of a part (field __part), and numbers are distinct with gaps.
    With order_by, a task holds the rows that one micro-batch has of one value (and part), so the trigger's rate and parts bound it.
    Fields named __part or batch are errors, null keys are one value, an empty stream gives nothing.
    """
    pipeline = Pipeline(pipeline)
    at = [k for k, o in enumerate(pipeline.operators) if o.kind in "BS"]
    if any(isinstance(o, (StartCaching, EndCaching)) for o in pipeline.operators):
        raise ValueError("streams can't be kept")
    if len(at) != 1:
        raise ValueError("keyed streams take one operator that depends on order")
    first = pipeline[at[0]]
    numbers = isinstance(first, EnumerateField) and not first.same_id_for_repeated
    if not numbers and not (isinstance(first, FixedBatchSize) and first.batch_size != "max"):
        raise ValueError(f"{first.name} has no keyed form")
    if numbers and rest_after_ms is not None:
        raise ValueError("only batches have a rest")
    if parts < 1:
        raise ValueError("parts is a positive number")
    before, after = pipeline.operators[: at[0]], pipeline.operators[at[0] + 1 :]
    rows = Pipeline(*before).map(stream) if before else stream
    if missing := [c for c in (*key, *order_by) if c not in rows.columns]:
        raise FieldError(f"no {missing[0]}; there are {', '.join(rows.columns)}")
    if clash := [c for c in (PART, BATCH) if c in rows.columns]:
        raise FieldError(f"{clash[0]} is taken")
    use_state_store(stream.sparkSession)
    kind, names = rows.schema, tuple(c for c in rows.columns if numbers or c not in key)
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int") if parts > 1 else F.lit(0)
    groups = rows.withColumn(PART, part).groupBy(*key, PART)
    if numbers:
        to = first.destination_field or first.field
        out = T.StructType([*[f for f in kind if f.name != to], T.StructField(to, T.LongType())])
        made = groups.transformWithState(_Numbers(to, parts, names, tuple(order_by)), out, "append", "none")
    else:
        lists = [T.StructField(c, T.ArrayType(kind[c].dataType)) for c in names]
        out = T.StructType([*[kind[c] for c in key], T.StructField(PART, T.IntegerType()), T.StructField(BATCH, T.LongType()), *lists])
        held = T.StructType([kind[c] for c in names])
        made = groups.transformWithState(_Batches(first.batch_size, names, tuple(key), held, tuple(order_by), rest_after_ms), out, "append", "none" if rest_after_ms is None else "processingTime")
        made = made if parts > 1 else made.drop(PART)
    return Pipeline(*after).map(made) if after else made
