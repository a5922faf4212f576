"""What the log says about itself: segments, retention, lag, latency, throughput."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import LATENCY_BOUNDS, divide, saturating_sub
from .capture import RANGE, running_before


def segment_statistics(events: DataFrame) -> DataFrame:
    return events.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sum("payload_bytes").alias("stored_bytes"),
        F.min("sequence").alias("first_sequence"),
        F.max("sequence").alias("last_sequence"),
        F.max("sequence").alias("high_watermark"),
        F.min("commit_timestamp_ms").alias("first_timestamp_ms"),
        F.max("commit_timestamp_ms").alias("last_timestamp_ms"),
    )


def store_stats(segments: DataFrame, markers: DataFrame, source_offsets: DataFrame, consumer_offsets: DataFrame) -> DataFrame:
    """One row; the newest segment is the active one."""
    s = segments.agg(
        F.coalesce(F.sum("event_count"), F.lit(0)).alias("event_count"), F.count(F.lit(1)).alias("segments"), F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("sealed_segments")
    )
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    # Each side is one row by construction.
    return s.crossJoin(one(markers, "replay_ids")).crossJoin(one(source_offsets, "source_offsets")).crossJoin(one(consumer_offsets, "consumer_offsets"))


def retention_candidates(
    segments: DataFrame, max_events: int | None = None, max_bytes: int | None = None, max_age_ms: int | None = None, now_ms: int | Column = 0, delete_batch: int | None = None
) -> DataFrame:
    """The oldest sealed segments that a limit condemns, up to the first that none does.

    segments is the catalog: a row for each segment. Totals include the active segment; a segment without a time never ages out;
    with delete_batch, whole segments are taken until so many events are selected.
    """
    if delete_batch == 0:
        raise ValueError("delete_batch must be positive")
    order = Window.orderBy("segment_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = segments.withColumn("__e", F.coalesce(F.sum("event_count").over(before), F.lit(0))).withColumn("__b", F.coalesce(F.sum("stored_bytes").over(before), F.lit(0)))
    every = Window.partitionBy()
    left_e, left_b = F.sum("event_count").over(every) - F.col("__e"), F.sum("stored_bytes").over(every) - F.col("__b")
    tests = [F.lit(False)]
    tests += [left_e > max_events] if max_events is not None else []
    tests += [left_b > max_bytes] if max_bytes is not None else []
    tests += [F.col("last_timestamp_ms") <= now_ms - max_age_ms] if max_age_ms is not None else []
    condemned = F.coalesce(reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), tests), F.lit(False))
    s = s.withColumn("__c", condemned & (F.col("segment_id") < F.max("segment_id").over(every)))
    s = s.withColumn("__all", F.min(F.col("__c").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = (F.col("__all") == 1) & ((F.col("__e") < delete_batch) if delete_batch is not None else F.lit(True))
    return s.filter(kept).select(*segments.columns)


def retention_outcome(segments: DataFrame, condemned: DataFrame) -> DataFrame:
    """One row: what goes, and where the log then begins."""
    gone = condemned.agg(
        F.count(F.lit(1)).alias("deleted_segments"), F.coalesce(F.sum("event_count"), F.lit(0)).alias("deleted_events"), F.coalesce(F.sum("stored_bytes"), F.lit(0)).alias("deleted_bytes")
    )
    kept = segments.join(condemned.select("segment_id"), "segment_id", "left_anti").agg(F.min("first_sequence").alias("first_retained"))
    high = segments.agg(F.max("high_watermark").alias("high_watermark"))
    out = gone.crossJoin(kept).crossJoin(high)  # one row each
    return out.withColumn("first_retained", F.coalesce("first_retained", F.col("high_watermark") + 1))


def consumer_lag(offsets: DataFrame, high_watermark: Column) -> DataFrame:
    return offsets.withColumn("lag", saturating_sub(high_watermark, F.col("sequence")))


def latency_histogram(values: DataFrame, seconds: str) -> DataFrame:
    """(le, n): values up to each bound, cumulated."""
    counts = values.agg(*[F.count_if(F.col(seconds) <= b).alias(f"b{i}") for i, b in enumerate(LATENCY_BOUNDS[:-1])], F.count(F.lit(1)).alias(f"b{len(LATENCY_BOUNDS) - 1}"))
    bounds = ["+Inf" if b == float("inf") else f"{b:g}" for b in LATENCY_BOUNDS]
    return counts.select(F.explode(F.array(*[F.struct(F.lit(i).alias("bucket"), F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)])).alias("x")).select("x.*")


def throughput(events: DataFrame, time_ms: str, interval_ms: int, commit: str) -> DataFrame:
    """Per interval: events, commits and bytes, and their rates."""
    start = (F.floor(F.col(time_ms) / interval_ms) * interval_ms).cast("long")
    per = events.groupBy(start.alias("interval_start_ms")).agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct(commit).alias("commits"), F.sum("payload_bytes").alias("bytes")
    )
    seconds = interval_ms / 1000.0
    return per.select(
        "*",
        (F.col("events") / F.lit(seconds)).alias("events_per_second"),
        (F.col("bytes") / F.lit(seconds)).alias("bytes_per_second"),
        divide(F.col("events"), F.col("commits")).alias("events_per_commit"),
    )


def latency_samples(delivered: DataFrame, commit_ms: str, now_ms: str) -> DataFrame:
    """One row: samples, those of a clock that runs ahead, those without a time, and the sum of the others."""
    late = F.col(now_ms) - F.col(commit_ms)
    return delivered.agg(
        F.count_if(late >= 0).alias("samples"),
        F.count_if(late < 0).alias("clock_skew"),
        F.count_if(late.isNull()).alias("missing"),
        F.coalesce(F.sum(F.when(late >= 0, late)), F.lit(0)).alias("latency_ms"),
    )


def quantiles(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Exact p50, p95, p99 and the maximum. Equal values are counted first, so that a hot group sends each once."""
    counted = values.groupBy(*by, column).agg(F.count(F.lit(1)).alias("__n"))
    p = lambda q: F.percentile(column, F.lit(q), F.col("__n"))
    return counted.groupBy(*by).agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.max(column).alias("max"))


def redeliveries(delivered: DataFrame, consumer: str, order: str, width: int = RANGE) -> DataFrame:
    """Per consumer: new events and those at or below a sequence delivered before. The running maximum has two levels."""
    marked = running_before(delivered, [consumer], order, "sequence", "__before", width, F.max)
    return marked.withColumn("__again", F.coalesce(F.col("sequence") <= F.col("__before"), F.lit(False))).groupBy(consumer).agg(
        F.count_if(~F.col("__again")).alias("new_events"), F.count_if("__again").alias("redelivered")
    )
