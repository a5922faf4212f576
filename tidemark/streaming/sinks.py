"""Sinks: workers that read the log from a durable offset and deliver, at least once and in order."""

from __future__ import annotations

import time
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import RetryableSinkError, SequenceExpired, SinkError
from ..files import files_of
from ..operators import cache
from ..operators.log_store import LogStore, State
from ..plans import Stream
from .consumers import SINK_PREFIX


class Sink(ABC):
    """deliver() raises RetryableSinkError to be called again with the same events, SinkError to give up.

    A sink with more than one run takes so many batches at once, as a table in no order with the number of the batch (__batch).
    """

    runs = 1

    @abstractmethod
    def deliver(self, events: DataFrame) -> None: ...


class KeyValue(ABC):
    """A cache; apply() takes (kind, key, value, ttl_seconds) in order, all or none."""

    @abstractmethod
    def apply(self, mutations: list[tuple[str, str, str | None, int | None]]) -> None: ...


class MemoryKeyValue(KeyValue):
    def __init__(self) -> None:
        self.data: dict[str, tuple[str, int | None]] = {}

    def apply(self, mutations):
        for kind, key, value, ttl in mutations:
            if kind == "del":
                self.data.pop(key, None)
            else:
                self.data[key] = (value, ttl)


class TableKeyValue(KeyValue):
    """A cache as a table that executors write and read; the driver handles a name for each batch.

    A batch leaves one row for each of its keys, the last mutation, in a folder of its own, and is there once a record names it. Of a key,
    the latest batch counts. Batches are never merged.
    """

    ROWS = "key string, kind string, value string, ttl_seconds long, batch long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, files_of(spark, path)
        self.files.make(f"{path}/_batches")

    def _names(self) -> list[str]:
        return [x for x in self.files.names(f"{self.path}/_batches") if not x.startswith(".")]

    def apply(self, mutations):
        rows = [(i, 0, 0, *m) for i, m in enumerate(mutations)]
        self.apply_table(self.spark.createDataFrame(rows, "sequence long, rule_index int, pos int, kind string, key string, value string, ttl_seconds long"))

    def apply_table(self, mutations: DataFrame) -> None:
        """Mutations (sequence, rule_index, pos, kind, key, value, ttl_seconds) in whatever order: all or none."""
        number, folder = len(self._names()), f"{self.path}/data/{uuid.uuid4().hex}"
        last = cache.last_mutations(mutations).select("key", "kind", "value", "ttl_seconds", F.lit(number).cast("long").alias("batch"))
        last.write.parquet(folder)
        if not self.files.publish(f"{self.path}/_batches/{number:020d}", folder):
            raise SinkError("another worker writes to this cache")

    def table(self) -> DataFrame:
        """What the cache holds: key, value, ttl_seconds."""
        folders = [self.files.read(f"{self.path}/_batches/{x}") for x in self._names()]
        rows = self.spark.read.schema(self.ROWS).parquet(*folders) if folders else self.spark.createDataFrame([], self.ROWS)
        last = rows.groupBy("key").agg(F.max_by(F.struct("kind", "value", "ttl_seconds"), "batch").alias("x"))
        return last.filter("x.kind = 'set'").select("key", "x.value", "x.ttl_seconds")


#: Batches that go to a table at once: each still has max_commands at most, but what a Spark job costs besides its rows is paid once.
RUNS = 256


class CacheSink(Sink):
    """Events mapped by rules to mutations; an event that no rule can map stops the sink before anything is written."""

    def __init__(self, rules: list[cache.Rule], target: KeyValue, max_commands: int = 10_000):
        self.rules, self.target, self.max_commands = rules, target, max_commands
        self.runs = RUNS if isinstance(target, TableKeyValue) else 1

    def deliver(self, events: DataFrame) -> None:
        flat = events.select("sequence", F.col("schema").alias("schema_name"), F.col("table").alias("table_name"), "operation", F.col("key").alias("key_json"), F.col("before").alias("before_json"), F.col("after").alias("after_json"), (F.col("__batch") if self.runs > 1 else F.lit(0).cast("long")).alias("__batch"))
        mapped = cache.map_events(flat, self.rules)
        if self.runs == 1:
            mapped = mapped.persist()
        try:
            per = mapped.groupBy("__batch").agg(F.min(F.when(F.col("error").isNotNull(), F.struct("sequence", "error"))).alias("bad"), F.sum(F.when(F.col("error").isNull(), F.size("mutations"))).alias("n"))
            found = per.agg(F.min("bad").alias("bad"), F.max("n").alias("n")).first()
            if found["bad"]:
                raise SinkError(f"event {found['bad']['sequence']}: {found['bad']['error']}")
            if (found["n"] or 0) > self.max_commands:
                raise SinkError(f"a batch has more than {self.max_commands} commands")
            rows = cache.mutations(mapped)
            if self.runs > 1:
                self.target.apply_table(rows)
            else:  # commands that the driver sends: bounded by max_commands
                self.target.apply([(r["kind"], r["key"], r["value"], r["ttl_seconds"]) for r in rows.orderBy("sequence", "rule_index", "pos").collect()])
        finally:
            mapped.unpersist()


class SinkWorker:
    """Reads batches of sequences, delivers the stream's events, and moves on to the last sequence read."""

    def __init__(self, store: LogStore, name: str, stream: Stream, sink: Sink, batch: int = 500, initial_ms: int = 250, max_ms: int = 15_000, sleep: Callable[[float], None] = time.sleep):
        self.store, self.stream, self.sink, self.batch = store, stream, sink, batch
        self.key, self.initial_ms, self.max_ms, self.sleep = f"{stream.name}\x1f{SINK_PREFIX}{name}", initial_ms, max_ms, sleep

    def offset(self) -> int:
        state = self.store.state()
        first = state.first_sequence
        return state.consumer_offsets.get(self.key, first - 1 if first is not None else 0)

    def run_once(self) -> bool:
        """Whether there was something to read."""
        state, at = self.store.state(), self.offset()
        if at >= state.high_watermark:
            return False
        if at + 1 < state.retention_floor:
            raise SequenceExpired(at + 1, state.retention_floor)
        try:
            upto = self._read(state, at, self.sink.runs)
        except SinkError:
            if self.sink.runs == 1:
                raise
            upto = self._read(state, at, 1)  # batches before the one that fails are delivered
        self.store.set_consumer_offset(self.key, upto, only_forward=True)
        return True

    def _read(self, state: State, at: int, runs: int) -> int:
        upto = min(at + self.batch * runs, state.high_watermark)
        rows = self.store.log(at + 1, state).filter(F.col("sequence") <= upto).filter(self.stream.column())
        if not rows.isEmpty():
            many = self.sink.runs > 1
            self._deliver(rows.withColumn("__batch", F.expr(f"(sequence - {at + 1}) div {self.batch}")) if many else rows.orderBy("sequence"))
        return upto

    def _deliver(self, rows: DataFrame) -> None:
        delay = self.initial_ms
        while True:
            try:
                return self.sink.deliver(rows)
            except RetryableSinkError:
                self.sleep(delay / 1000)
                delay = min(delay * 2, self.max_ms)

    def drain(self) -> None:
        while self.run_once():
            pass
