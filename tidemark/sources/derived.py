"""Change logs derived from tables: each row of `events` or `orders` becomes row changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATABASE, SLOT, SOURCE_NAME = "shop", "main", "primary"

#: Seven rows a transaction; positions and times rise with the row number.
EVENT_CHANGES = (
    "event_id as wal_pos",
    "event_id div 7 as txn",
    "concat(hex(event_id div 16777216), '/', hex((event_id * 256) % 4294967296)) as lsn",
    "concat('0/', hex((event_id div 7 + 1) * 1792 - 128)) as end_lsn",
    "(event_id div 7 + 1) * 1792 - 128 as end_lsn_num",
    "1000 + event_id div 7 as xid",
    "'public' as schema_name",
    "case when event_type in ('click', 'view') then 'clicks' when event_type = 'purchase' then 'orders' else 'users' end as table_name",
    "case event_type when 'signup' then 'insert' when 'error' then 'delete' else 'update' end as operation",
    """concat('{"id":"', user_id, '"}') as key_json""",
    """case when event_type <> 'signup' then concat('{"id":"', user_id, '","status":"old"}') end as before_json""",
    """case when event_type <> 'error' then concat('{"id":"', user_id, '","k":"', get_json_object(props, '$.k'), '","status":"', event_type, '"}') end as after_json""",
    "unix_millis(cast(ts as timestamp)) as commit_timestamp_ms",
)


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*EVENT_CHANGES)


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An insert of each order as open, and an update where its status is another."""
    orders, time = spark.read.parquet(f"{sf_dir}/orders.parquet"), "unix_millis(cast(o_orderdate as timestamp)) as commit_timestamp_ms"
    inserts = orders.selectExpr("o_orderkey * 2 as wal_pos", "'insert' as operation", "o_orderkey as k", "cast(null as string) as before_status", "'O' as after_status", time)
    updates = orders.filter("o_orderstatus <> 'O'").selectExpr("o_orderkey * 2 + 1 as wal_pos", "'update' as operation", "o_orderkey as k", "'O' as before_status", "o_orderstatus as after_status", time)
    return inserts.union(updates)


def captured(changes: DataFrame, source_name: str = SOURCE_NAME) -> DataFrame:
    """Derived changes with the columns of model.CAPTURED."""
    return changes.selectExpr(
        f"'{source_name}' as source_name", "wal_pos", "lsn as wal_start", "xid", "end_lsn as commit_lsn", "end_lsn", "schema_name as `schema`",
        "table_name as `table`", "operation", "key_json as key", "before_json as before", "after_json as after", "commit_timestamp_ms",
    )


#: The columns of every relation of the derived frames, and the relations' numbers.
FRAME_COLUMNS, RELATIONS = ("id", "k", "status"), {"users": 1, "orders": 2, "clicks": 3}


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived changes as replication frames (pgoutput.FRAMES): 16 positions a transaction, relations again every 50 transactions."""
    rows = event_changes(spark, sf_dir)
    # The columns of the images, each made once: images of JSON text would be parsed again for every use of a field.
    fields = [c for c in EVENT_CHANGES if c.rsplit(" ", 1)[-1] in ("wal_pos", "txn", "table_name", "operation")]
    values = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*fields, "cast(user_id as string) as id", "get_json_object(props, '$.k') as k", "event_type as status", "'old' as old")
    text = lambda c: f"coalesce(concat(X'74', unhex(lpad(hex(octet_length({c})), 8, '0')), encode({c}, 'UTF-8')), X'6E')"
    number = "unhex(lpad(hex(case table_name " + " ".join(f"when '{t}' then {n}" for t, n in RELATIONS.items()) + " end), 8, '0'))"
    values = values.selectExpr("wal_pos", "txn", "operation", f"{number} as number", *[f"{text(c)} as {c}" for c in ("id", "k", "status", "old")])
    before, after = "concat(X'0003', id, X'6E', old)", "concat(X'0003', id, k, status)"
    data = values.selectExpr(
        "txn * 16 + 4 + wal_pos % 7 as pos", "'data' as event", "wal_pos * 256 as wal_start",
        f"""case operation when 'insert' then concat(X'49', number, X'4E', {after})
            when 'update' then concat(X'55', number, X'4F', {before}, X'4E', {after})
            else concat(X'44', number, X'4F', {before}) end as payload""",
    )
    whole = rows.groupBy("txn").agg(F.min("xid").alias("xid"), F.min("end_lsn_num").alias("end"), F.min("commit_timestamp_ms").alias("ms"))
    begin = whole.selectExpr("txn * 16 as pos", "'begin' as event", "end - 1024 as wal_start", "xid", "end - 8 as final_lsn", "(ms - 946684800000) * 1000 as commit_micros")
    commit = whole.selectExpr("txn * 16 + 15 as pos", "'commit' as event", "end - 8 as wal_start", "end as end_lsn")
    hexed = lambda t: "".join(f"{b:02X}" for b in t.encode() + b"\0")
    columns = f"{len(FRAME_COLUMNS):04X}" + "".join(f"00{hexed(c)}00000019FFFFFFFF" for c in FRAME_COLUMNS)
    known = [(n - 1, bytes.fromhex(f"52{n:08X}{hexed('public')}{hexed(t)}66{columns}")) for t, n in RELATIONS.items()]
    named = whole.filter("txn % 50 = 0").withColumn("r", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(bytearray(x)).alias("payload")) for i, x in known])))
    relations = named.selectExpr("txn * 16 + 1 + r.i as pos", "'data' as event", "end - 1024 as wal_start", "r.payload as payload")
    out = data.unionByName(relations, True).unionByName(begin, True).unionByName(commit, True)
    return out.selectExpr(f"'{SOURCE_NAME}' as source_name", "pos", "event", "wal_start", "payload", "xid", "final_lsn", "end_lsn", "commit_micros", "cast(null as string) as prefix")
