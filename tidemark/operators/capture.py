"""From filtered row changes to sequenced events: ordinals, sequences, transactions, batches, segments.

Sums that run over all transactions have two levels: a range of positions in the log
first, then the few rows that stand for the ranges. So have the greedy folds (batches,
segments), though each step depends on the last: where a group ends depends only on where
it begins, so each range tells for every entry where a chain of groups leaves it, in runs
of entries that leave alike, and one row for each run goes to the task that chains ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import marker, payload_bytes

#: Positions of the log in one range of a running sum; ranges are what one task adds up.
RANGE = 1 << 30


def running_before(df: DataFrame, by: list[str], order: str, value: str, out: str, width: int = RANGE, of: Callable = F.sum) -> DataFrame:
    """The sum (or maximum, then null before the first) of value over rows that come earlier by a numeric order, within by."""
    none, both = (F.lit(0), lambda a, b: a + b) if of is F.sum else (F.lit(None), F.greatest)
    ranged = df.withColumn("__range", F.floor(F.col(order) / width).cast("long"))
    totals = ranged.groupBy(*by, "__range").agg(of(value).alias("__total"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*by, "__range", F.coalesce(of("__total").over(earlier), none).alias("__base"))
    within = Window.partitionBy(*by, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("__within", F.coalesce(of(value).over(within), none))
    return summed.join(bases, [*by, "__range"]).withColumn(out, both(F.col("__base"), F.col("__within"))).drop("__range", "__base", "__within")


def ordinals(changes: DataFrame, transaction: list[str], position: str = "wal_pos", out: str = "ordinal") -> DataFrame:
    """The number of an event in its transaction, from 1. Filter before: only captured events count."""
    return changes.withColumn(out, F.row_number().over(Window.partitionBy(*transaction).orderBy(position)))


def sequences(events: DataFrame, by: list[str], order: str, high_watermark: int = 0, width: int = RANGE) -> DataFrame:
    """Global sequence without gaps: watermark, events of earlier transactions, ordinal."""
    sizes = events.groupBy(*by, order).agg(F.count(F.lit(1)).alias("__n"))
    starts = running_before(sizes, by, order, "__n", "__before", width).select(*by, order, "__before")
    return events.join(starts, [*by, order]).withColumn("sequence", (F.lit(high_watermark) + F.col("__before") + F.col("ordinal")).cast("long")).drop("__before")


def transaction_stats(events: DataFrame, by: list[str], images: Iterable[str] = ("key_json", "before_json", "after_json"), overhead: int = 0, memory: int | None = None) -> DataFrame:
    """Events and decoded bytes of each transaction; overhead is counted for each event. Staged: above memory."""
    size = payload_bytes(*[F.col(c) for c in images]) + F.lit(overhead)
    out = events.groupBy(*by).agg(F.count(F.lit(1)).alias("event_count"), F.sum(size).alias("decoded_bytes"))
    return out if memory is None else out.withColumn("is_staged", F.col("decoded_bytes") > memory)


#: Bytes that a staged transaction has before its events, and each event before its JSON. Fixed values.
STAGED_HEADER, STAGED_RECORD = 12, 8


def staged_stats(events: DataFrame, by: list[str], line: Column) -> DataFrame:
    """Events and the bytes of each transaction as it is staged: a header, then each event's JSON with its length."""
    size = F.sum(F.octet_length(line) + F.lit(STAGED_RECORD)) + F.lit(STAGED_HEADER)
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("event_count"), size.cast("long").alias("staged_bytes"))


def limit_violations(stats: DataFrame, max_events: int, max_bytes: int) -> DataFrame:
    """Transactions over a limit; reaching it is allowed."""
    reason = F.when(F.col("event_count") > max_events, "event_limit").when(F.col("decoded_bytes") > max_bytes, "byte_limit")
    return stats.withColumn("violation", reason).filter("violation is not null")


def with_marker(transactions: DataFrame, source: Column, end_lsn: str = "end_lsn") -> DataFrame:
    return transactions.withColumn("marker", marker(source, F.col(end_lsn)))


def not_replayed(events: DataFrame, markers: DataFrame) -> DataFrame:
    """Events of transactions that no marker names."""
    return events.join(markers.select("marker"), "marker", "left_anti")


def duplicate_counts(events: DataFrame, markers: DataFrame, event_ids: DataFrame, transaction: str = "end_lsn") -> DataFrame:
    """One row: duplicate transactions and events. A transaction counts by its marker, or by all of its event ids."""
    marked = events.join(markers.select("marker").distinct().withColumn("__m", F.lit(1)), "marker", "left")
    known = marked.join(event_ids.select("event_id").distinct().withColumn("__e", F.lit(1)), "event_id", "left")
    per = known.groupBy(transaction).agg(F.count(F.lit(1)).alias("n"), F.max("__m").alias("m"), F.count("__e").alias("e"))
    whole = F.col("m").isNotNull() | (F.col("e") == F.col("n"))
    return per.agg(
        F.count(F.lit(1)).alias("transactions"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("events"),
        F.count_if(whole).alias("duplicate_transactions"),
        F.coalesce(F.sum(F.when(whole, F.col("n")).otherwise(F.col("e"))), F.lit(0)).alias("duplicate_events"),
    )


@dataclass(frozen=True)
class BatchLimits:
    transactions: int = 100
    events: int = 1000
    bytes: int = 4 << 20
    delay_ms: int = 20


@dataclass(frozen=True)
class SegmentLimits:
    events: int = 1_000_000
    bytes: int = 256 << 20
    age_ms: int = 900_000


#: Rows of one range of a fold, at least as many as a group can have.
FOLD = 1 << 18


def _passed(sizes: np.ndarray, limit: int) -> np.ndarray:
    """For a group that begins at each row: the first later row that would take it over a limit, or that comes when it is reached."""
    upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    over, full = np.searchsorted(upto, upto[:-1] + limit, "right") - 1, np.searchsorted(upto, upto[:-1] + limit, "left")
    return np.maximum(np.minimum(over, full), np.arange(1, len(upto)))


def _aged(times: np.ndarray, limit: int) -> np.ndarray:
    """The first later row that comes when a group is as old as the limit. Times do not fall; one that does counts as the last."""
    times = np.maximum.accumulate(times)
    return np.maximum(np.searchsorted(times, times + limit, "left"), np.arange(1, len(times) + 1))


def batch_ends(rows: pd.DataFrame, limits: BatchLimits) -> np.ndarray:
    """Where a batch that begins at each row ends: one row at least, before a limit is passed, when one is reached, and after its delay."""
    ends = [_passed(np.ones(len(rows), np.int64), limits.transactions), _passed(rows["events"].to_numpy(), limits.events), _passed(rows["bytes"].to_numpy(), limits.bytes)]
    return np.minimum.reduce([*ends, _aged(rows["time"].to_numpy(), limits.delay_ms)])


def segment_ends(rows: pd.DataFrame, limits: SegmentLimits) -> np.ndarray:
    """Where a segment that begins at each batch is sealed: before it would pass a limit, after it reaches one, and before it is too old."""
    ends = [_passed(rows["events"].to_numpy(), limits.events), _passed(rows["bytes"].to_numpy(), limits.bytes)]
    return np.minimum.reduce([*ends, _aged(rows["time"].to_numpy(), limits.age_ms)])


def _chains(ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the first n rows: where a chain of groups that begins there leaves them, and how many groups it has."""
    leaves, groups = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in range(n - 1, -1, -1):
        e = ends[i]
        leaves[i], groups[i] = (e, 1) if e >= n else (leaves[e], groups[e] + 1)
    return leaves, groups


def greedy(rows: DataFrame, source: str, order: str, ends: Callable[[pd.DataFrame], np.ndarray], reach: int, out: str, width: int = FOLD) -> DataFrame:
    """rows (source, order, events, bytes, time) with the number of their group, from 1: ends() tells where groups end that begin anywhere.

    reach: rows that a group can have at most. A range sees so many rows after its own.
    """
    width = max(width, reach)
    numbered = running_before(rows.withColumn("__one", F.lit(1)), [source], order, "__one", "__i").withColumn("__r", F.expr(f"__i div {width}")).drop("__one")
    # The first rows of a range also end the one before.
    seen = numbered.withColumn("__for", F.explode(F.expr(f"if(__r > 0 and __i % {width} < {reach}, array(__r, __r - 1), array(__r))")))

    def tell(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__i", kind="stable")
        n = int((part["__r"] == part["__for"]).sum())
        leaves, groups = _chains(ends(part), n)
        new = np.ones(n, bool)
        new[1:] = (leaves[1:] != leaves[:-1]) | (groups[1:] != groups[:-1])
        at = np.flatnonzero(new)
        base = int(part["__i"].iloc[0])
        return pd.DataFrame({source: part[source].iloc[0], "__r": part["__for"].iloc[0], "entry": base + at, "until": base + np.append(at[1:], n), "leaves": base + leaves[at], "groups": groups[at]})

    def chain(runs: pd.DataFrame) -> pd.DataFrame:
        runs = runs.sort_values("entry", kind="stable")
        entry, until, leaves, groups, r = (runs[c].to_numpy() for c in ("entry", "until", "leaves", "groups", "__r"))
        at, number, got = 0, 1, []
        while (k := int(np.searchsorted(entry, at, "right")) - 1) < len(entry) and at < until[k]:
            got.append((runs[source].iloc[0], int(r[k]), at, number))
            at, number = int(leaves[k]), number + int(groups[k])
        return pd.DataFrame(got, columns=[source, "__r", "entry", "number"])

    def number(key: tuple, part: pd.DataFrame, begins: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__i", kind="stable").reset_index(drop=True)
        own, base = part[part["__r"] == part["__for"]], int(part["__i"].iloc[0])
        stop, of = ends(part), np.zeros(len(part), np.int64)
        # Rows before the range's entry belong to the last group of an earlier one.
        at, group = (int(begins["entry"].iloc[0]) - base, int(begins["number"].iloc[0])) if len(begins) else (len(part), 0)
        while at < len(own):
            of[at : stop[at]] = group
            at, group = int(stop[at]), group + 1
        # What reaches over the end is told by this range, too.
        return part.assign(**{out: of})[lambda x: x[out] > 0][[source, order, "events", "bytes", "time", out]]

    keys = f"{source} string, __r long"
    told = seen.groupBy(source, "__for").applyInPandas(tell, f"{keys}, entry long, until long, leaves long, groups long")
    begins = told.groupBy(source).applyInPandas(chain, f"{keys}, entry long, number long").withColumnRenamed("__r", "__for")
    schema = f"{source} string, {order} long, events long, bytes long, time long, {out} long"
    return seen.groupBy(source, "__for").cogroup(begins.groupBy(source, "__for")).applyInPandas(number, schema)


def batches(transactions: DataFrame, source: str, order: str, limits: BatchLimits, time: str | None = None, width: int = FOLD) -> DataFrame:
    """transactions (one row each, with event_count and decoded_bytes, unique in order) with a batch_id for each source.

    time: a column of milliseconds in which they came; without it no batch waits, and delay_ms ends none.
    """
    rows = transactions.select(source, order, F.col("event_count").cast("long").alias("events"), F.col("decoded_bytes").cast("long").alias("bytes"), _time(time))
    found = greedy(rows, source, order, lambda part: batch_ends(part, limits), limits.transactions, "batch_id", width)
    return found.select(source, order, F.col("events").alias("event_count"), F.col("bytes").alias("decoded_bytes"), *([F.col("time").alias(time)] if time else []), "batch_id")


def _time(column: str | None) -> Column:
    return (F.lit(0).cast("long") if column is None else F.col(column).cast("long")).alias("time")


def batch_totals(batched: DataFrame, source: str, time: str | None = None) -> DataFrame:
    """What each batch holds; with a time column, when its last transaction came."""
    last = [F.max(time).alias(time)] if time else []
    return batched.groupBy(source, "batch_id").agg(F.count(F.lit(1)).alias("transactions"), F.sum("event_count").alias("events"), F.sum("decoded_bytes").alias("bytes"), *last)


def segments(totals: DataFrame, source: str, limits: SegmentLimits, time: str | None = None, width: int = FOLD) -> DataFrame:
    """Batches (batch_id, events, bytes; one event at least) with the segment that each goes to.

    time: a column of milliseconds in which they are written; without it no segment is too old.
    """
    rows = totals.select(source, "batch_id", F.col("events").cast("long"), F.col("bytes").cast("long"), _time(time))
    found = greedy(rows, source, "batch_id", lambda part: segment_ends(part, limits), limits.events, "segment_id", width)
    return found.select(source, "batch_id", "events", "bytes", *([F.col("time").alias(time)] if time else []), "segment_id")
