"""What the operators of this package share: table access and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of the documents for the operators that split on ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is named, a temporary one in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if named is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
        own = spark.sparkContext.getCheckpointDir()
    return own


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hash60(text: Column) -> Column:
    """The first 60 bits of the MD5 of a string as a long; SQL engines agree on it."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    mapped = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(mapped)  # ASCII texts have a fast path


#: What a table may have in rows and in bytes of its values to be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def _width(field: T.StructField) -> Column:
    """About how many bytes a value takes: texts and arrays by their length, all else as a long."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType):
        return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)) + 16
    return F.lit(8)


def broadcast_checked(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A broadcast hint only where the rows and bytes of a (written) table, both measured, are within the limits; beyond them Spark shuffles.

    rows: their number, where it is known.
    """
    if rows is not None and rows > BROADCAST_ROWS:
        return df
    widths = [_width(f) for f in df.schema.fields]
    got = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(sum(widths[1:], widths[0]).cast("long")), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if got["rows"] <= BROADCAST_ROWS and got["bytes"] <= BROADCAST_BYTES else df
