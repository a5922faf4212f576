"""The change event: a fixed envelope around row images that are JSON text."""

from __future__ import annotations

from pyspark.sql import types as T

OPERATIONS = ("insert", "update", "delete", "truncate")
#: Numbers of operations on the wire; 0 is unspecified. Fixed values.
OPERATION_CODES = {"insert": 1, "update": 2, "delete": 3, "truncate": 4}

SOURCE = T.StructType([T.StructField("database", T.StringType()), T.StructField("slot", T.StringType()), T.StructField("lsn", T.StringType())])
TRANSACTION = T.StructType([T.StructField("transaction_id", T.LongType()), T.StructField("begin_lsn", T.StringType()), T.StructField("commit_lsn", T.StringType())])
CHANGE_EVENT = T.StructType(
    [
        T.StructField("sequence", T.LongType(), False),
        T.StructField("event_id", T.StringType(), False),
        T.StructField("source", SOURCE, False),
        T.StructField("transaction", TRANSACTION),
        T.StructField("schema", T.StringType(), False),
        T.StructField("table", T.StringType(), False),
        T.StructField("operation", T.StringType(), False),
        T.StructField("key", T.StringType()),
        T.StructField("before", T.StringType()),
        T.StructField("after", T.StringType()),
        T.StructField("commit_timestamp_ms", T.LongType()),
    ]
)
#: What the log stores beside the event.
STORED = T.StructType([*CHANGE_EVENT.fields, T.StructField("end_lsn", T.StringType()), T.StructField("payload_bytes", T.LongType())])
#: What capture takes: events without a sequence, with their place in the write-ahead log.
CAPTURED = T.StructType(
    [
        T.StructField("source_name", T.StringType(), False),
        T.StructField("wal_pos", T.LongType(), False),
        T.StructField("wal_start", T.StringType(), False),
        T.StructField("xid", T.LongType()),
        T.StructField("commit_lsn", T.StringType()),
        T.StructField("end_lsn", T.StringType(), False),
        T.StructField("schema", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("operation", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("before", T.StringType()),
        T.StructField("after", T.StringType()),
        T.StructField("commit_timestamp_ms", T.LongType()),
    ]
)
