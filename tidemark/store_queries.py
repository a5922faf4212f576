"""Registered queries that write a log and read it again: decoding, commits, replays, retention, consumers, sinks, backups.

The changes come as frames in three parts of whole transactions, each a commit and, as a segment takes one event at
least, a segment. Logs lie in the shared folder; one that queries only read is made once for a session and data folder.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cache_rules, config, maintenance, workspace
from .errors import ApiError, DuplicateEvent, PartiallyPersisted
from .operators.capture import SegmentLimits
from .operators.log_store import Limits, LogStore, Retention
from .plans import CapturePlan, Stream
from .sources import artefacts, derived
from .sources.pgoutput import decode_frames
from .streaming import capture as capturing
from .streaming.consumers import ApiLimits, Authorizer, Consumers, Principal
from .streaming.sinks import CacheSink, SinkWorker, TableKeyValue

SOURCE, PARTS, WIDTH = derived.SOURCE_NAME, 3, 1 << 14
USERS = Stream("people", SOURCE, ("public.users",))
PLAN = CapturePlan.of(SOURCE, [USERS, Stream("sales", SOURCE, ("public.orders",))])
EVERY_COMMIT = Limits(SegmentLimits(events=1))


_FRAMES: dict[tuple[str, str], str] = {}


def frames(spark: SparkSession, d: str) -> DataFrame:
    """The frames as files, as a source leaves them: made once for a session and data folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _FRAMES:
        path = workspace.folder(spark, "frames")
        derived.event_frames(spark, d).write.parquet(path)
        _FRAMES[key] = path
    return spark.read.parquet(_FRAMES[key])


def decoded(spark: SparkSession, d: str) -> DataFrame:
    return decode_frames(frames(spark, d), PLAN, WIDTH)


def parts(spark: SparkSession, d: str) -> list[DataFrame]:
    """Thirds of the transactions."""
    rows = decoded(spark, d)
    last = spark.read.parquet(f"{d}/events.parquet").agg(F.expr("max(event_id) div 7")).first()[0] or 0
    number = F.expr(f"(xid - 1000) * {PARTS} div {last + 1}")
    rows = rows.withColumn("__part", number).persist()
    return [rows.filter(F.col("__part") == k).drop("__part") for k in range(PARTS)]


def new_store(spark: SparkSession, limits: Limits = EVERY_COMMIT) -> LogStore:
    return LogStore(spark, workspace.folder(spark, "log"), derived.DATABASE, derived.SLOT, limits)


_BUILT: dict[tuple[str, str], LogStore] = {}


def store(spark: SparkSession, d: str) -> LogStore:
    """The log of all three parts, for queries that only read it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        made = new_store(spark)
        for rows in parts(spark, d):
            made.persist(rows, SOURCE)
        _BUILT[key] = made
    return _BUILT[key]


def decoded_frames(spark, d):
    """Begin, relation, insert, update, delete and commit messages, to captured rows."""
    return decoded(spark, d).select("xid", "wal_start", "commit_lsn", "end_lsn", F.col("schema").alias("schema_name"), F.col("table").alias("table_name"), "operation", "key", "before", "after", "commit_timestamp_ms").filter("operation is not null")


def decoded_empty_transactions(spark, d):
    """Transactions of which the plan keeps nothing: they move the position only."""
    return decoded(spark, d).filter("operation is null").select("xid", "end_lsn")


def log_stream_view(spark, d):
    """The whole path: frames, decoding, filter, sequences, a commit, log, view."""
    made = new_store(spark)
    made.persist(decoded(spark, d), SOURCE)
    return made.replay(1, stream=USERS.column()).select("sequence", "event_id", F.col("schema").alias("schema_name"), F.col("table").alias("table_name"), "operation")


def log_roundtrip(spark, d):
    return store(spark, d).log().select("sequence", "event_id", "segment_id", "source.lsn", "transaction.transaction_id", "payload_bytes", "end_lsn")


def log_catalog(spark, d):
    return store(spark, d).catalog().filter("event_count > 0").select("segment_id", "sealed", "event_count", "marker_count", "stored_bytes", "first_sequence", "last_sequence")


def log_markers(spark, d):
    return store(spark, d).markers().select("marker", "segment_id")


def log_verified(spark, d):
    """The integrity report of an undamaged log."""
    report = store(spark, d).verify()
    return spark.createDataFrame([(report["events"], report["markers"], report["segments"], report["sealed_segments"], report["high_watermark"])], "events long, markers long, segments long, sealed_segments long, high_watermark long")


def log_replay_decisions(spark, d):
    """What persist() decides of a part that comes again, of one that is partly known, and of transactions without events."""
    made, (one, two, three), out = new_store(spark), parts(spark, d), []

    def step(name: str, rows: DataFrame, check: bool) -> None:
        try:
            got = made.persist(rows, SOURCE, check)
        except PartiallyPersisted:
            got = "partially_persisted"
        out.append((len(out), name, got, made.state().high_watermark))

    step("first part", one, False)
    step("first part again", one, False)
    step("second part", two, True)
    step("second and third part", two.unionByName(three), True)
    step("third part", three, True)
    position = made.state().source_offsets[SOURCE]
    step("all parts", one.unionByName(two).unionByName(three), True)
    beyond = f"{position.split('/')[0]}/{int(position.split('/')[1], 16) + 16:X}"
    step("no events", three.limit(1).select(*[F.lit(beyond).alias(c) if c == "end_lsn" else F.lit(None).cast("string").alias(c) if c == "operation" else F.col(c) for c in three.columns]), True)
    return spark.createDataFrame(out, "step int, name string, outcome string, high_watermark long")


def log_retention(spark, d):
    """A policy of 2500 events: whole segments go, in as many sweeps as it takes, the floor follows, what is left can be read."""
    made = new_store(spark)
    for rows in parts(spark, d):
        made.persist(rows, SOURCE)
    outcome = made.retain(Retention(max_events=2500))
    made.vacuum()
    left = made.log().agg(F.count(F.lit(1))).first()[0]
    floor = made.state().retention_floor
    return spark.createDataFrame([(outcome["deleted_segments"], outcome["deleted_events"], outcome["deleted_bytes"], outcome["first_retained"], outcome["high_watermark"], floor, left)], "deleted_segments long, deleted_events long, deleted_bytes long, first_retained long, high_watermark long, floor long, events_left long")


def log_backup_restore(spark, d):
    """Events of a log restored from a backup."""
    backup = workspace.folder(spark, "backup")
    maintenance.backup(store(spark, d), backup, SOURCE)
    return maintenance.restore(spark, backup, workspace.folder(spark, "restored")).log().select("sequence", "event_id", "segment_id")


def log_migrated(spark, d):
    """Events of a log whose record is of format 1, without identities and markers by segment."""
    old, path = store(spark, d), workspace.folder(spark, "format1")
    state = old.state()
    old.files.copy(f"{old.path}/data", f"{path}/data")
    record = {k: v for k, v in asdict(state).items() if k != "identities"} | {"version": 0, "format_version": 1, "removed": []}
    record["segments"] = [{k: v for k, v in s.items() if k not in ("marker_files", "marker_count")} for s in record["segments"]]
    old.files.make(f"{path}/_commits")
    old.files.publish(f"{path}/_commits/{0:020d}.json", json.dumps(record))
    made = LogStore(spark, path, derived.DATABASE, derived.SLOT)
    return made.log().select("sequence", "event_id", "segment_id").withColumn("format_version", F.lit(made.state().format_version))


def log_append_event(spark, d):
    """Single events: the first two of the changes, and the first again."""
    made, out = new_store(spark), []
    rows = [r.asDict() for r in decoded(spark, d).filter("operation is not null").orderBy("wal_pos").limit(2).collect()]
    for k, row in enumerate([{**rows[0], "end_lsn": "0/10"}, {**rows[1], "end_lsn": "0/20"}, {**rows[0], "end_lsn": "0/30"}]):
        try:
            out.append((k, made.append_event(row, SOURCE), "appended"))
        except DuplicateEvent:
            out.append((k, made.state().high_watermark, "duplicate"))
    return spark.createDataFrame(out, "step int, sequence long, outcome string")


def log_offsets(spark, d):
    """Positions of the source after the parts, by the store."""
    return spark.createDataFrame(sorted(store(spark, d).state().source_offsets.items()), "source_name string, durable_lsn string")


def captured_stream(spark, d):
    """The parts as files of a stream, captured by micro-batches, one of them twice."""
    made, folder = new_store(spark), workspace.folder(spark, "captured")
    for k, rows in enumerate(parts(spark, d)):
        rows.coalesce(1).write.parquet(f"{folder}/{k}")
    for checkpoint in ("first", "lost"):  # without its checkpoint the stream brings everything again
        step = capturing.Capture(made, SOURCE, PLAN)
        capturing.start(capturing.read_captured(spark, f"{folder}/*"), step, f"{folder}-{checkpoint}").awaitTermination()
    return made.log().select("sequence", "event_id", "segment_id")


def consumer_deliveries(spark, d):
    """What a subscription of users gets first."""
    rows = Consumers(store(spark, d), {"people": USERS}, ApiLimits(batch=64, read=500)).subscribe("people", "c", limit=300)
    return spark.createDataFrame([(r["sequence"], r["event_id"], r["operation"]) for r in rows], "sequence long, event_id string, operation string")


def consumer_offsets_walk(spark, d):
    """Offsets of a consumer that subscribes, acknowledges and seeks."""
    made = new_store(spark)
    for rows in parts(spark, d):
        made.persist(rows, SOURCE)
    c, out = Consumers(made, {"people": USERS}), []
    note = lambda name, offset: out.append((len(out), name, offset))
    note("earliest", c.offset("people", "a"))
    got = [r["sequence"] for r in c.subscribe("people", "a", limit=40)]
    note("acknowledged", c.ack("people", "a", got[29]))
    note("acknowledged an older one", c.ack("people", "a", got[9]))
    note("resumed", next(iter(c.subscribe("people", "a", limit=1)))["sequence"])
    note("latest", c.seek("people", "a", "latest"))
    note("sequence", c.seek("people", "a", "sequence", 4))
    note("back", c.seek("people", "a", "earliest"))
    made.retain(Retention(max_events=0))
    note("earliest of an empty log", c.earliest())
    return spark.createDataFrame(out, "step int, name string, offset long")


def sink_cache_state(spark, d):
    """A cache that a sink worker has filled from the log, delivered twice."""
    made = new_store(spark)
    for rows in parts(spark, d):
        made.persist(rows, SOURCE)
    target = TableKeyValue(spark, workspace.folder(spark, "cache"))
    worker = SinkWorker(made, "cache", Stream("all", SOURCE, ("*",)), CacheSink(cache_rules.RULES, target, max_commands=1 << 17), batch=1 << 16)
    worker.drain()
    made.set_consumer_offset(worker.key, 0, only_forward=False)
    worker.drain()
    return target.table()


def benchmark_summary(spark, d):
    """Runs by nation, summarised, written as CSV and read again."""
    n = spark.read.parquet(f"{d}/nation.parquet")
    runs = n.select(F.col("n_name").alias("name"), (F.col("n_nationkey") * 100).alias("generated"), (F.col("n_nationkey") * 100 - F.col("n_nationkey") % 3).alias("captured"), (F.col("n_nationkey") * 100 - F.col("n_nationkey") % 2).alias("consumed"), (F.col("n_nationkey") % 4).alias("seconds"))
    path = workspace.folder(spark, "summary")
    artefacts.write_summary(runs, path)
    types = ", ".join(f"{c} {'string' if c == 'name' else 'boolean' if c == 'converged' else 'double' if c.endswith(('_ms', '_per_second', '_tps')) else 'long'}" for c in artefacts.SUMMARY)
    return spark.read.schema(types).csv(path, header=True).select("name", "generated", "captured", "consumed", "converged", "seconds", "events_per_second", "stored_bytes")


def benchmark_artefacts(spark, d):
    """The other files of a run, written from nations and read again."""
    n, top = spark.read.parquet(f"{d}/nation.parquet"), workspace.folder(spark, "artefacts")
    n.select(F.concat("n_name", F.lit("="), "n_nationkey", F.lit("=x"))).write.text(f"{top}/environment")
    n.select(F.to_json(F.struct(F.struct(F.col("n_nationkey").alias("p99")).alias("latency")))).write.text(f"{top}/lines")
    n.select(F.lit("t").alias("timestamp_ms"), F.lit("a").alias("current"), F.lit("b").alias("confirmed"), F.when(F.col("n_nationkey") % 5 != 4, F.col("n_nationkey") * 7).alias("retained")).write.csv(f"{top}/postgres", header=True)
    env = artefacts.read_environment(spark, f"{top}/environment").select(F.concat(F.lit("environment "), "key").alias("name"), "value")
    lines = artefacts.read_json_lines(spark, f"{top}/lines", {"p99": "$.latency.p99"}).select(F.lit("p99").alias("name"), F.col("p99").cast("long").cast("string").alias("value"))
    wal = artefacts.max_retained_wal(spark, f"{top}/postgres").select(F.lit("wal").alias("name"), F.col("max_retained_wal_bytes").cast("string").alias("value"))
    return env.union(lines).union(wal)


def connection_quoting(spark, d):
    """Values of connection parameters as the source's client library wants them."""
    def quoted(batches):
        for x in batches:
            yield x.assign(quoted=[config.quote(v) for v in x["value"]])[["n_nationkey", "quoted"]]

    rows = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.concat("n_name", F.lit("'s \\ "), "n_name").alias("value"))
    return rows.mapInPandas(quoted, f"n_nationkey {rows.schema['n_nationkey'].dataType.simpleString()}, quoted string")


def consumer_names(spark, d):
    """What becomes of names of consumers and streams."""
    def judged(batches):
        c = Consumers(None, {"people": USERS})
        for x in batches:
            out = []
            for stream, name in zip(x["stream"], x["name"]):
                try:
                    out.append(c._key(stream, name).replace("\x1f", "/"))
                except ApiError as e:
                    out.append(e.code)
            yield x.assign(verdict=out)[["n_nationkey", "verdict"]]

    name = F.when(F.col("n_nationkey") % 5 == 0, "").when(F.col("n_nationkey") % 5 == 1, F.concat(F.lit("sink:"), "n_name")).when(F.col("n_nationkey") % 5 == 2, F.repeat("n_name", 22)).otherwise(F.col("n_name"))
    rows = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.when(F.col("n_nationkey") % 4 == 3, "other").otherwise("people").alias("stream"), name.alias("name"))
    return rows.mapInPandas(judged, f"n_nationkey {rows.schema['n_nationkey'].dataType.simpleString()}, verdict string")


def principal_permissions(spark, d):
    """Who may read and seek which stream."""
    def judged(batches):
        a = Authorizer((Principal("all", "t0", ("*",), True), Principal("one", "t1", ("a",)), Principal("none", "t2", ())))
        for x in batches:
            out = []
            for token, stream, seek in zip(x["token"], x["stream"], x["seek"]):
                try:
                    a.check(token, stream, bool(seek))
                    out.append("allowed")
                except ApiError as e:
                    out.append(e.code)
            yield x.assign(verdict=out)[["n_nationkey", "verdict"]]

    k = F.col("n_nationkey")
    rows = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.concat(F.lit("t"), (k % 4).cast("string")).alias("token"), F.when(k % 2 == 0, "a").when(k % 3 == 0, "a").otherwise("b").alias("stream"), (k % 5 == 0).alias("seek"))
    return rows.mapInPandas(judged, f"n_nationkey {rows.schema['n_nationkey'].dataType.simpleString()}, verdict string")


NAMES = (
    "decoded_frames", "decoded_empty_transactions", "log_stream_view", "log_roundtrip", "log_catalog", "log_markers", "log_verified", "log_replay_decisions", "log_retention", "log_backup_restore",
    "log_migrated", "log_append_event", "log_offsets", "captured_stream", "consumer_deliveries", "consumer_offsets_walk", "sink_cache_state", "benchmark_summary", "benchmark_artefacts",
    "connection_quoting", "consumer_names", "principal_permissions",
)


def queries() -> dict:
    return {name: globals()[name] for name in NAMES}
