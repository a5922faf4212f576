"""Capture: a stream of frames or captured rows into the log, exactly once.

Each micro-batch holds whole transactions and becomes one commit. The stream commits its
offsets only after the log has committed, which is the acknowledgement upstream; a batch
that comes again after a crash is at or below the stored position, or known by its
markers, and is dropped. Sequences are assigned inside the commit, so a replayed batch
leaves no gap. Only the first batches after a start compare markers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import lsn
from ..errors import DataSafetyError, TidemarkError
from ..functions import parse_lsn
from ..model import CAPTURED
from ..operators.log_store import PERSISTED, LogStore
from ..plans import CapturePlan
from ..sources.pgoutput import FRAMES, decode_stream


def read_captured(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Captured rows from files of whole transactions; the files of a batch bound what is in flight."""
    return spark.readStream.schema(CAPTURED).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def read_frames(spark: SparkSession, path: str, plan: CapturePlan, files_per_batch: int = 1) -> DataFrame:
    frames = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return decode_stream(frames, plan)


class Capture:
    """The foreachBatch function."""

    def __init__(self, store: LogStore, source_name: str, plan: CapturePlan, on_commit: Callable[[int], None] | None = None, stop_after: int | None = None):
        self.store, self.source_name, self.plan, self.on_commit, self.stop_after = store, source_name, plan, on_commit, stop_after
        self.reconciled = store.state().source_offsets.get(source_name) is None
        self.begin, self.query = store.state().high_watermark, None

    def rows(self, batch: DataFrame) -> DataFrame:
        """Rows of the plan; a transaction that keeps none still moves the position."""
        mine = batch.filter(F.col("source_name") == self.source_name)
        keep = self.plan.column() & F.col("operation").isNotNull()
        marks = mine.groupBy("source_name", "end_lsn").agg(F.min("wal_pos").alias("wal_pos"), F.min("wal_start").alias("wal_start"), F.count_if(keep).alias("kept"))
        empty = marks.filter("kept = 0").select([F.col(c).alias(c) if c in ("source_name", "end_lsn", "wal_pos", "wal_start") else F.lit(None).cast(CAPTURED[c].dataType).alias(c) for c in CAPTURED.names])
        return mine.filter(keep).select(CAPTURED.names).unionByName(empty)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = self.rows(batch)
        if rows.isEmpty():
            return
        if self.reconciled:
            done = self.store.persist(rows, self.source_name)
        else:
            done = self._reconcile(rows)
        if self.on_commit:
            self.on_commit(batch_id)
        if self.stop_after is not None and done == PERSISTED and self.store.state().high_watermark - self.begin >= self.stop_after and self.query:
            self.query.stop()

    def _reconcile(self, rows: DataFrame) -> str:
        """After a restart: drop transactions that are at or below the position or have a marker, persist the rest."""
        from ..functions import marker

        durable = self.store.state().source_offsets[self.source_name]
        rows = rows.filter(parse_lsn(F.col("end_lsn")) > F.lit(str(lsn.position(durable))).cast("decimal(20,0)"))
        rows = rows.withColumn("marker", marker(F.lit(self.source_name), F.col("end_lsn"))).join(self.store.markers().select("marker"), "marker", "left_anti").drop("marker")
        if rows.isEmpty():
            return "replayed"
        done = self.store.persist(rows, self.source_name, check_replay=True)
        self.reconciled = self.reconciled or done == PERSISTED
        return done


def start(captured: DataFrame, capture: Capture, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Without an interval the query takes what is there and ends."""
    writer = captured.writeStream.foreachBatch(capture).option("checkpointLocation", checkpoint)
    query = (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
    capture.query = query
    return query


#: What a failure's text says when the same input may work later: lost machines and stores that do not answer.
PASSING = ("ConnectException", "SocketTimeoutException", "SocketException", "UnknownHostException", "ExecutorLost", "FetchFailed", "Job aborted due to stage failure: ResultStage", "(SQLSTATE 08", "(SQLSTATE 53", "(SQLSTATE 57P0", "(SQLSTATE 55006)")


def may_pass(e: Exception) -> bool:
    """Whether a failed stream is worth starting again. Failures of data safety, also those that executors report by name, are not."""
    text = str(e)
    return not isinstance(e, TidemarkError) and not any(c.__name__ in text for c in fatal()) and any(x in text for x in PASSING)


def fatal() -> list[type]:
    kinds = [DataSafetyError]
    for k in kinds:
        kinds += k.__subclasses__()
    return kinds


def stop(query: StreamingQuery, timeout_s: int = 30) -> bool:
    """End between micro-batches, which are whole transactions."""
    query.stop()
    return query.awaitTermination(timeout_s)
