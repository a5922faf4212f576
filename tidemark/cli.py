"""python -m tidemark.cli COMMAND CONFIG ...: capture, run, replay, inspect, check, backup, restore, serve."""

from __future__ import annotations

import argparse
import sys
import threading

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config as configuration
from . import maintenance
from .errors import TidemarkError
from .functions import human_bytes, shorten
from .metrics import Metrics
from .operators.capture import SegmentLimits
from .operators.log_store import Limits, LogStore, Retention
from .streaming import capture as capturing
from .streaming.consumers import ApiLimits, Authorizer, Consumers
from .streaming.sinks import CacheSink, MemoryKeyValue, SinkWorker
from .streaming.supervisor import Supervisor


def session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def open_store(spark: SparkSession, c: configuration.Config) -> LogStore:
    r = c.runtime
    limits = Limits(SegmentLimits(r.segment_events, r.segment_bytes, r.segment_age_ms), r.transaction_events, r.transaction_bytes, r.storage_bytes, r.storage_reserve_bytes, r.max_consumers)
    return LogStore(spark, r.data_dir, c.source.database, c.source.slot, limits)


def consumers(store: LogStore, c: configuration.Config) -> Consumers:
    r = c.runtime
    limits = ApiLimits(r.max_name_bytes, r.max_event_bytes, r.max_subscriptions, r.replay_batch, r.replay_bytes)
    return Consumers(store, {s.name: s for s in c.streams}, limits, Authorizer(c.principals))


def event_lines(rows):
    """Events as JSON, row images as nested objects."""
    parsed = [F.try_parse_json(x).alias(x) for x in ("key", "before", "after")]
    line = F.to_json(F.struct("sequence", "event_id", "source", "transaction", "schema", "table", "operation", *parsed, "commit_timestamp_ms"), {"ignoreNullFields": "false"})
    return rows.select("sequence", line.alias("line")).orderBy("sequence").select("line")


def capture(spark, c, args) -> None:
    """Supervised: it starts again after failures that may pass, and a signal ends it between batches."""
    store, metrics, r = open_store(spark, c), Metrics(), c.runtime

    def connect():
        step = capturing.Capture(store, c.source.name, c.plan(), on_commit=lambda batch: metrics.add("commits"), stop_after=args.stop_after_events)
        return capturing.start(capturing.read_frames(spark, r.frames_dir, c.plan()), step, f"{r.data_dir}/_stream", args.interval)

    supervisor = Supervisor(connect, metrics, capturing.may_pass)
    if threading.current_thread() is threading.main_thread():
        supervisor.install_signals()
    supervisor.run()
    outcome = store.prune(Retention(r.retention_events, r.retention_bytes, r.retention_age_ms, r.retention_delete_batch))
    metrics.pruned(outcome, store.now_ms())
    store.vacuum()


def run(spark, c, args) -> None:
    """Capture, then the sinks."""
    capture(spark, c, args)
    store, streams = open_store(spark, c), {s.name: s for s in c.streams}
    for s in c.sinks:
        SinkWorker(store, s.name, streams[s.stream], CacheSink(list(s.rules), MemoryKeyValue(), s.max_commands), s.batch, s.retry_initial_ms, s.retry_max_ms).drain()


def replay(spark, c, args) -> None:
    streams = {s.name: s for s in c.streams}
    if args.stream is not None and args.stream not in streams:
        raise TidemarkError(f"stream {args.stream} is not defined")
    rows = open_store(spark, c).replay(args.first, args.limit, stream=None if args.stream is None else streams[args.stream].column())
    for r in event_lines(rows).toLocalIterator():
        print(r["line"])


def inspect(spark, c, args) -> None:
    store = open_store(spark, c)
    if args.sequence is not None:
        row = event_lines(store.log(args.sequence).filter(F.col("sequence") == args.sequence)).first()
        if row is None:
            raise TidemarkError(f"the log has no event {args.sequence}")
        print(row["line"])
        return
    state = store.state()
    sizes = spark.createDataFrame([(store.files.size(store.path),)], "n long")
    print(store.stats(), "size", sizes.select(human_bytes(F.col("n"))).first()[0])
    print("sources", state.source_offsets)
    for key, at in sorted(state.consumer_offsets.items()):
        print("consumer", *key.split("\x1f"), "offset", at, "lag", max(0, state.high_watermark - at))
    recent = store.recent(min(args.limit, state.high_watermark - max(0, state.retention_floor - 1)) if state.high_watermark else 0)
    recent.select("sequence", shorten(F.concat_ws(".", "schema", "table"), 32).alias("table"), "operation", "commit_timestamp_ms").show(args.limit, truncate=False)


def check(spark, c, args) -> None:
    print(open_store(spark, c).verify())


def backup(spark, c, args) -> None:
    print(len(maintenance.backup(open_store(spark, c), args.output, c.source.name)["files"]), "files")


def restore(spark, c, args) -> None:
    print(maintenance.restore(spark, args.input, c.runtime.data_dir).stats())


def serve(spark, c, args) -> None:
    """Print a subscription: the stand-in for a network service, which is not part of this engine."""
    store = open_store(spark, c)
    print(Metrics().render(Metrics().sample(store)))
    for row in consumers(store, c).subscribe(args.stream, args.consumer, args.limit):
        print(row.asDict(recursive=True))


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    for f in (capture, run, replay, inspect, check, backup, restore, serve):
        p = commands.add_parser(f.__name__)
        p.add_argument("config")
        p.set_defaults(run=f)
        if f in (capture, run):
            p.add_argument("--stop-after-events", type=int)
            p.add_argument("--interval")
        if f is replay:
            p.add_argument("--from", dest="first", type=int, default=1)
            p.add_argument("--stream")
        if f in (replay, inspect, serve):
            p.add_argument("--limit", type=int, default=None if f is replay else 10)
        if f is inspect:
            p.add_argument("--sequence", type=int)
        if f is backup:
            p.add_argument("output")
        if f is restore:
            p.add_argument("input")
        if f is serve:
            p.add_argument("--stream", default="all")
            p.add_argument("--consumer", default="cli")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 for a failure, 2 for a bad command line, 10 for configuration, 20 where data would be at risk."""
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        c = configuration.load(args.config)
        args.run(spark or session(), c, args)
        return 0
    except TidemarkError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return e.exit_code


if __name__ == "__main__":
    sys.exit(main())
