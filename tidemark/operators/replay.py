"""Ordered reads of the log: ranges, bounded prefixes, tails, views and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import SequenceExpired
from .capture import RANGE, running_before


def check_floor(first: int, floor: int) -> None:
    if first < floor:
        raise SequenceExpired(first, floor)


def replay(log: DataFrame, first: int, limit: int | None = None, floor: int = 0) -> DataFrame:
    """Events from a sequence on, ascending; a limit becomes a top-k, not a sort of the log."""
    check_floor(first, floor)
    out = log.filter(F.col("sequence") >= first).orderBy("sequence")
    return out if limit is None else out.limit(limit)


def replay_bounded(log: DataFrame, first: int, limit: int, max_bytes: int, floor: int = 0) -> DataFrame:
    """At most limit events and max_bytes of payload, but one event at least."""
    rows = replay(log, first, limit, floor)  # limit bounds the window's one group
    running = F.sum("payload_bytes").over(Window.orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0))
    rank = F.row_number().over(Window.orderBy("sequence"))
    return rows.withColumn("__b", running).withColumn("__r", rank).filter((F.col("__r") == 1) | (F.col("__b") <= max_bytes)).drop("__b", "__r")


def replay_stream(log: DataFrame, stream: Column, first: int, limit: int | None, floor: int = 0) -> DataFrame:
    """The limit counts events of the stream."""
    return replay(log.filter(stream), first, limit, floor)


def recent(log: DataFrame, n: int, last: int, floor: int = 0) -> DataFrame:
    """The last n events, ascending; an error where they would reach below the floor."""
    first = max(1, last - (n - 1)) if n else last + 1
    check_floor(first, floor)
    return log.filter(F.col("sequence").between(first, last)).orderBy("sequence")


def latest(log: DataFrame, n: int) -> DataFrame:
    """The last n events of a log whose end is not known, ascending: a top-k of one pass."""
    return log.orderBy(F.desc("sequence")).limit(n).orderBy("sequence")


def lookup(log: DataFrame, sequence: int) -> DataFrame:
    return log.filter(F.col("sequence") == sequence)


def bounded_run(events: DataFrame, by: list[str], order: str, target: int, width: int = RANGE) -> DataFrame:
    """Whole transactions until target events are reached."""
    sizes = events.groupBy(*by, order).agg(F.count(F.lit(1)).alias("__n"))
    kept = running_before(sizes, by, order, "__n", "__before", width).filter(F.col("__before") < target).select(*by, order)
    return events.join(kept, [*by, order], "left_semi")
