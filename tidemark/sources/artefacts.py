"""Readers of benchmark artefacts: key=value files, JSON lines, load generator logs and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import divide

#: The columns of the summary.
SUMMARY = (
    "name", "generated", "captured", "consumed", "converged", "target_rate", "actual_tps", "seconds", "events_per_second", "persist_p50_ms", "persist_p95_ms",
    "persist_p99_ms", "persist_max_ms", "latency_p50_ms", "latency_p95_ms", "latency_p99_ms", "latency_max_ms", "events_per_commit", "redelivered", "clock_skew",
    "max_retained_wal_bytes", "stored_bytes",
)


def processed_transactions(line: Column) -> Column:
    found = F.regexp_extract(line, r"^number of transactions actually processed: ([0-9,]+)", 1)
    return F.when(found != "", F.regexp_replace(found, ",", "").cast("long"))


def actual_tps(line: Column) -> Column:
    found = F.regexp_extract(line, r"^tps = ([0-9.]+) \(", 1)
    return F.when(found != "", found.cast("double"))


def read_environment(spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.text(path).filter(F.contains("value", F.lit("=")))
    return parts.select(F.split_part("value", F.lit("="), F.lit(1)).alias("key"), F.expr("substring(value, locate('=', value) + 1)").alias("value"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path)
    return rows.agg(F.max(processed_transactions(F.col("value"))).alias("processed"), F.max(actual_tps(F.col("value"))).alias("actual_tps"))


def read_json_lines(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """One row: the largest value of each JSON path."""
    rows = spark.read.text(path)
    return rows.agg(*[F.max(F.get_json_object("value", p).cast("double")).alias(n) for n, p in fields.items()])


def max_retained_wal(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True)
    return rows.agg(F.max(F.col(rows.columns[3]).try_cast("long")).alias("max_retained_wal_bytes"))


def summary(parts: DataFrame) -> DataFrame:
    """Summary rows; what a run has not measured is 0, rates of nothing too."""
    have = set(parts.columns)
    rows = parts.withColumn("captured", F.greatest(F.coalesce("captured", F.lit(0)), F.coalesce("consumed", F.lit(0))))
    made = {"converged": (F.col("generated") == F.col("captured")) & (F.col("captured") == F.col("consumed")), "events_per_second": divide(F.col("captured"), F.col("seconds"))}
    return rows.select(*[made[c].alias(c) if c in made else (F.coalesce(c, F.lit(0)).alias(c) if c != "name" else F.col(c)) if c in have else F.lit(0).alias(c) for c in SUMMARY])


def write_summary(parts: DataFrame, path: str) -> None:
    summary(parts).write.csv(path, header=True)
