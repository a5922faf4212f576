"""Checks as tables of violations: empty means sound."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import ResumeGap
from ..functions import parse_lsn
from ..plans import CapturePlan


def integrity_violations(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """(segment_id, violation): events against the catalog's counts, and sequences without gaps.

    Contiguity is checked within segments in parallel; across segments only the catalog's rows are compared.
    """
    real = events.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("payload_bytes").alias("b"), F.min("sequence").alias("lo"), F.max("sequence").alias("hi"), F.count_distinct("sequence").alias("d")
    )
    both = catalog.join(real, "segment_id", "full")
    tests = {
        "event count": ~F.col("n").eqNullSafe(F.col("event_count")),
        "stored bytes": ~F.col("b").eqNullSafe(F.col("stored_bytes")),
        "first sequence": ~F.col("lo").eqNullSafe(F.col("first_sequence")),
        "last sequence": ~F.col("hi").eqNullSafe(F.col("last_sequence")),
        "not contiguous": (F.col("hi") - F.col("lo") + 1 != F.col("d")) | (F.col("n") != F.col("d")),
    }
    found = both.select("segment_id", F.explode(F.array_compact(F.array(*[F.when(t, name) for name, t in tests.items()]))).alias("violation"))
    before = F.lag("hi").over(Window.orderBy("segment_id"))
    gaps = real.withColumn("p", before).filter(F.col("lo") != F.col("p") + 1).select("segment_id", F.lit("gap between segments").alias("violation"))
    return found.union(gaps)


def catalog_violations(catalog: DataFrame) -> DataFrame:
    """(segment_id, violation) over catalog rows with sealed, first_sequence, last_sequence."""
    order = Window.orderBy("segment_id", "first_sequence")
    c = catalog.withColumn("p", F.lag("last_sequence").over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("segment_id")))
    c = c.withColumn("newest", F.max("segment_id").over(Window.partitionBy()))
    tests = {"duplicate id": F.col("n") > 1, "overlap": F.col("first_sequence") <= F.col("p"), "unsealed before the last": ~F.col("sealed") & (F.col("segment_id") < F.col("newest"))}
    return c.select("segment_id", F.explode(F.array_compact(F.array(*[F.when(t, name) for name, t in tests.items()]))).alias("violation")).distinct()


def missing_tables(required: DataFrame, published: DataFrame) -> DataFrame:
    return required.select("schema_name", "table_name").subtract(published.select("schema_name", "table_name"))


def restricted_tables(required: DataFrame, published: DataFrame) -> DataFrame:
    """Required tables that are published with a row or column filter."""
    return required.select("schema_name", "table_name").intersect(published.filter("has_row_filter or has_column_filter").select("schema_name", "table_name"))


def unnecessary_tables(published: DataFrame, plan: CapturePlan) -> DataFrame:
    return published.filter(~plan.column(F.col("schema_name"), F.col("table_name"))).select("schema_name", "table_name")


def source_violations(settings: DataFrame, required: DataFrame, published: DataFrame, tables: DataFrame) -> DataFrame:
    """(subject, violation) of a source.

    settings: one row of wal_level, can_replicate, is_superuser, publishes_all, slot_type, plugin, slot_database,
    database, two_phase, publish_via_root. tables: schema_name, table_name, relkind, is_partition, identity,
    has_usable_identity, has_generated.
    """
    rules = {
        "wal_level is not logical": F.col("wal_level") != "logical",
        "role may not replicate": ~(F.col("can_replicate") | F.col("is_superuser")),
        "publication does not publish all operations": ~F.col("publishes_all"),
        "slot is not logical": F.col("slot_type") != "logical",
        "slot uses another plugin": F.col("plugin") != "pgoutput",
        "slot belongs to another database": F.col("slot_database") != F.col("database"),
        "slot is two-phase": F.col("two_phase"),
    }
    # Missing settings count as violations.
    fired = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(True)), name) for name, t in rules.items()]))
    out = [settings.select(F.lit("source").alias("subject"), F.explode(fired).alias("violation"))]
    name = F.concat_ws(".", "schema_name", "table_name").alias("subject")
    out.append(missing_tables(required, published).select(name, F.lit("not published").alias("violation")))
    out.append(restricted_tables(required, published).select(name, F.lit("published with a filter").alias("violation")))
    mine = tables.join(required, ["schema_name", "table_name"], "left_semi").join(F.broadcast(settings.select("publish_via_root")))
    routed = {
        "partition is published through its root": F.col("is_partition") & F.col("publish_via_root"),
        "partitioned table is published by its leaves": (F.col("relkind") == "p") & ~F.col("publish_via_root"),
        "no usable replica identity": ~F.col("has_usable_identity"),
        "generated columns": F.col("has_generated"),
    }
    out.append(mine.select(name, F.explode(F.array_compact(F.array(*[F.when(t, v) for v, t in routed.items()]))).alias("violation")))
    return reduce(lambda a, b: a.union(b), out)


def resume_gaps(pairs: DataFrame) -> DataFrame:
    """Rows (local_lsn, confirmed_lsn) whose source has gone past what is stored here."""
    return pairs.filter(parse_lsn(F.col("confirmed_lsn")) > parse_lsn(F.col("local_lsn")))


def check_resume(local: str | None, confirmed: str | None) -> None:
    from ..lsn import position

    if local is None or confirmed is None:
        return
    a, b = position(local), position(confirmed)
    if a is None or b is None or b > a:
        raise ResumeGap(f"the source has confirmed {confirmed}, the log ends at {local}")
