"""The event log: Parquet segments and a log of commits.

A commit is one JSON record, written aside and published under the next version's name,
which fails if that name exists: whoever comes second has to look again. A record names
the files, offsets and marks that it adds, so that events, replay markers and the
source's position become visible together or not at all. Readers fold the records, from
the last snapshot on, and read only the files these name; files of an interrupted write
are never seen, and vacuum() removes them. Events stay on the executors throughout: the
driver handles a row for each commit or segment. The path may be in any store that Spark
reads (see files.py). Rows of a commit are written by ranges of their sequence, so that
each file holds a range of its own and its statistics tell readers which.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lsn
from ..errors import (
    ByteLimitExceeded, DuplicateEvent, DuplicateMarker, DuplicateSequence, EventLimitExceeded, IdentityMismatch, IntegrityError, PartiallyPersisted, ResourceLimit,
    SequenceExpired, TidemarkError, UnsupportedFormat,
)
from ..files import Files, files_of
from ..functions import marker, parse_lsn, payload_bytes, source_event_id
from ..model import CAPTURED, CHANGE_EVENT, STORED
from . import capture, replay, validate

FORMAT = 2
#: What a file of events holds at most, about.
FILE_BYTES, FILE_EVENTS = 128 << 20, 1 << 20
#: Room that a batch needs beside its bytes.
HEADROOM = 16 << 20
SNAPSHOT_EVERY = 20
MARKERS = "marker string, segment_id long"


@dataclass(frozen=True)
class Segment:
    id: int
    created_ms: int
    sealed: bool = False
    files: tuple[str, ...] = ()
    marker_files: tuple[str, ...] = ()
    event_count: int = 0
    marker_count: int = 0
    stored_bytes: int = 0
    first_sequence: int | None = None
    last_sequence: int | None = None
    first_timestamp_ms: int | None = None
    last_timestamp_ms: int | None = None


@dataclass(frozen=True)
class State:
    version: int = -1
    format_version: int = FORMAT
    high_watermark: int = 0
    retention_floor: int = 0
    segments: tuple[Segment, ...] = ()
    source_offsets: dict = field(default_factory=dict)
    consumer_offsets: dict = field(default_factory=dict)
    identities: dict = field(default_factory=dict)

    @property
    def next_sequence(self) -> int:
        return self.high_watermark + 1

    @property
    def first_sequence(self) -> int | None:
        return min((s.first_sequence for s in self.segments if s.first_sequence is not None), default=None)


@dataclass(frozen=True)
class Limits:
    segment: capture.SegmentLimits = capture.SegmentLimits()
    transaction_events: int = 1_000_000
    transaction_bytes: int = 1 << 30
    storage_bytes: int = 100 << 30
    reserve_bytes: int = 1 << 30
    consumers: int = 10_000
    headroom_bytes: int = HEADROOM


@dataclass(frozen=True)
class Retention:
    max_events: int | None = None
    max_bytes: int | None = None
    max_age_ms: int | None = None
    delete_batch: int = 100_000

    @property
    def enabled(self) -> bool:
        return any(x is not None for x in (self.max_events, self.max_bytes, self.max_age_ms))


PERSISTED, ALREADY = "persisted", "already_persisted"


class LogStore:
    """One writer; any number of readers."""

    def __init__(self, spark: SparkSession, path: str, database: str = "shop", slot: str = "main", limits: Limits = Limits(), clock: Callable[[], int] | None = None):
        self.spark, self.path, self.database, self.slot, self.limits = spark, path, database, slot, limits
        self.now_ms = clock or (lambda: int(time.time() * 1000))
        self._cached = State()
        self.files: Files = files_of(spark, path)
        self.files.make(f"{path}/_commits")
        self.files.make(f"{path}/data")
        #: Woken by every commit of this process; other processes are seen by looking again.
        self.committed = threading.Condition()
        if self.state().version < 0:
            self._commit(lambda s: replace(s, segments=(Segment(1, self.now_ms()),)))

    # Commits

    def _file(self, version: int) -> str:
        return f"{self.path}/_commits/{version:020d}.json"

    def state(self) -> State:
        """The latest state; only records after the one known are read."""
        s = self._cached
        if s.version < 0:
            known = sorted(f for f in self.files.names(f"{self.path}/_commits") if f.endswith(".snapshot"))
            if known:
                s = _load(self.files.read(f"{self.path}/_commits/{known[-1]}"))
        while self.files.exists(self._file(s.version + 1)):
            s = _load(self.files.read(self._file(s.version + 1)), s)
        self._cached = s
        return s

    def _commit(self, change: Callable[[State], State], attempts: int = 20) -> State:
        """Publish the state that change makes of the latest; on losing a race, look again and repeat."""
        for _ in range(attempts):
            old = self.state()
            new = replace(change(old), version=old.version + 1)
            if not self.files.publish(self._file(new.version), _dump(new, old)):
                continue
            self._cached = new
            if new.version % SNAPSHOT_EVERY == SNAPSHOT_EVERY - 1:
                self.files.write(f"{self._file(new.version)[:-5]}.snapshot", _dump(new, None))
            with self.committed:
                self.committed.notify_all()
            return new
        raise TidemarkError("other writers keep publishing")

    # Reads

    def log(self, first: int = 0, state: State | None = None) -> DataFrame:
        """Events of the segments that reach to a sequence; files are pruned by the catalog, rows by Parquet statistics."""
        state = state or self.state()
        files = [f"{self.path}/data/{f}" for s in state.segments if s.last_sequence is not None and s.last_sequence >= first for f in s.files]
        if not files:
            return self.spark.createDataFrame([], STORED).withColumn("segment_id", F.lit(0).cast("long"))
        rows = self.spark.read.schema(STORED).option("basePath", f"{self.path}/data").parquet(*files)
        ids = F.regexp_extract(F.input_file_name(), r"segment-(\d{20})", 1).cast("long")
        return rows.withColumn("segment_id", ids).filter(F.col("sequence") >= first)

    def replay(self, first: int, limit: int | None = None, max_bytes: int | None = None, stream=None) -> DataFrame:
        state = self.state()
        if first < state.retention_floor:
            raise SequenceExpired(first, state.retention_floor)
        rows = self.log(first, state)
        rows = rows if stream is None else rows.filter(stream)
        return replay.replay(rows, first, limit) if max_bytes is None else replay.replay_bounded(rows, first, limit or 256, max_bytes)

    def recent(self, n: int) -> DataFrame:
        state = self.state()
        return replay.recent(self.log(0, state), n, state.high_watermark, state.retention_floor)

    def markers(self, state: State | None = None) -> DataFrame:
        files = [f"{self.path}/data/{f}" for s in (state or self.state()).segments for f in s.marker_files]
        return self.spark.read.schema(MARKERS).parquet(*files) if files else self.spark.createDataFrame([], MARKERS)

    def catalog(self, state: State | None = None) -> DataFrame:
        rows = [
            (s.id, s.sealed, s.event_count, s.marker_count, s.stored_bytes, s.first_sequence, s.last_sequence, s.last_sequence, s.first_timestamp_ms, s.last_timestamp_ms)
            for s in (state or self.state()).segments
        ]
        return self.spark.createDataFrame(
            rows, "segment_id long, sealed boolean, event_count long, marker_count long, stored_bytes long, first_sequence long, last_sequence long, high_watermark long, first_timestamp_ms long, last_timestamp_ms long"
        )

    def stats(self) -> dict:
        s = self.state()
        return {
            "event_count": sum(x.event_count for x in s.segments), "replay_ids": sum(x.marker_count for x in s.segments), "segments": len(s.segments),
            "sealed_segments": sum(x.sealed for x in s.segments), "source_offsets": len(s.source_offsets), "consumer_offsets": len(s.consumer_offsets),
        }

    # Writes

    def persist(self, rows: DataFrame, source_name: str, check_replay: bool = False, before_commit: Callable[[], None] | None = None) -> str:
        """Captured rows of whole transactions, atomically. Rows without an operation are transactions without events.

        The order of checks: nothing to persist; at or below the source's position; replayed as a whole or in part;
        limits; markers and sequences; then one commit of events, markers and position.
        """
        state = self.state()
        rows = rows.withColumn("payload_bytes", payload_bytes(F.col("key"), F.col("before"), F.col("after"))).persist()
        try:
            last = rows.agg(F.max_by("end_lsn", F.coalesce(parse_lsn(F.col("end_lsn")), F.lit(-1).cast("decimal(20,0)"))).alias("x"), F.count("operation").alias("n")).first()
            if last["x"] is None:
                raise TidemarkError("an empty batch cannot be persisted")
            durable = state.source_offsets.get(source_name)
            if durable is not None and lsn.at_or_before(last["x"], durable):
                return ALREADY
            events = rows.filter("operation is not null").withColumn("lsn_number", parse_lsn(F.col("end_lsn")).cast("long"))
            events = capture.ordinals(events, ["source_name", "lsn_number"])  # the keys of sequences(), so that rows are shuffled once for both
            events = events.withColumn("event_id", source_event_id(F.lit(self.database), F.lit(self.slot), F.col("xid"), F.col("wal_start"), F.col("ordinal")))
            events = events.withColumn("marker", marker(F.lit(source_name), F.col("end_lsn")))
            if last["n"] and check_replay and durable is not None:
                known = self.log(0, state).select("event_id")
                c = capture.duplicate_counts(events, self.markers(state), known).first()
                if c["transactions"] and c["duplicate_transactions"] == c["transactions"]:
                    self._commit(lambda s: replace(s, source_offsets={**s.source_offsets, source_name: last["x"]}))
                    return ALREADY
                if c["duplicate_transactions"] or c["duplicate_events"]:
                    raise PartiallyPersisted(c["duplicate_events"], c["events"])
            if not last["n"]:
                self.checkpoint(source_name, last["x"])
                return PERSISTED
            return self._write(events, source_name, last["x"], before_commit)
        finally:
            rows.unpersist()

    def append_event(self, row: dict, source_name: str) -> int:
        """One captured event as a transaction of its own; its id must be new to all segments. Returns its sequence."""
        state = self.state()
        one = self.spark.createDataFrame([tuple({**row, "source_name": source_name}.get(f) for f in CAPTURED.names)], CAPTURED)
        own = source_event_id(F.lit(self.database), F.lit(self.slot), F.col("xid"), F.col("wal_start"), F.lit(1))
        if not self.log(0, state).select("event_id").join(F.broadcast(one.select(own.alias("event_id"))), "event_id", "left_semi").isEmpty():  # one row
            raise DuplicateEvent("an event with this id is in the log")
        self.persist(one, source_name)
        return self.state().high_watermark

    def adopt(self, events: DataFrame, source_offsets: dict[str, str]) -> int:
        """Make the events of a store of one file, sequences and all, the sealed first segment of an empty log. Returns their number.

        Such a store kept no markers: replays of its transactions are told by the position and by event ids.
        """
        if self.state().high_watermark or self.state().source_offsets:
            raise TidemarkError("only an empty log can adopt events")
        bad = [f"position of {k}" for k, v in source_offsets.items() if not k or lsn.position(v) is None]
        has = set(events.columns)
        bad += [f"no column {f.name}" for f in CHANGE_EVENT.fields if f.name not in has]
        if bad:
            raise IntegrityError("; ".join(bad))
        kept = events.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CHANGE_EVENT.fields], F.col("end_lsn") if "end_lsn" in has else F.col("source.lsn").alias("end_lsn"))
        kept = kept.withColumn("payload_bytes", payload_bytes(F.col("key"), F.col("before"), F.col("after")).cast("long"))
        total = kept.agg(F.count(F.lit(1)).alias("n"), F.sum("payload_bytes").alias("b")).first()
        if not total["n"]:
            self._commit(lambda s: replace(s, source_offsets=dict(source_offsets)))
            return 0
        self._capacity(total["b"])
        folder = f"segment-{self.state().segments[-1].id:020d}/{uuid.uuid4().hex}"
        parts = max(1, -(-total["b"] // FILE_BYTES), -(-total["n"] // FILE_EVENTS))
        kept.repartitionByRange(parts, "sequence").sortWithinPartitions("sequence").write.parquet(f"{self.path}/data/{folder}/events")
        # What was written is checked before a commit names it.
        stored = self.spark.read.schema(STORED).parquet(f"{self.path}/data/{folder}/events")
        got = stored.agg(
            F.count(F.lit(1)).alias("n"), F.sum("payload_bytes").alias("b"), F.min("sequence").alias("lo"), F.max("sequence").alias("hi"),
            F.min("commit_timestamp_ms").alias("t0"), F.max("commit_timestamp_ms").alias("t1"), F.count_if(F.coalesce("event_id", F.lit("")) == "").alias("unnamed"),
        ).first()
        twice = {c: not stored.groupBy(c).count().filter("count > 1").isEmpty() for c in ("sequence", "event_id")}
        tests = {
            "sequences are missing": got["lo"] is None or got["lo"] < 1 or got["hi"] - got["lo"] + 1 != got["n"], "sequences repeat": twice["sequence"],
            "events have no id": got["unnamed"], "event ids repeat": twice["event_id"],
        }
        if any(tests.values()):
            raise IntegrityError("; ".join(name for name, fired in tests.items() if fired))

        def change(s: State) -> State:
            if s.high_watermark or s.source_offsets:
                raise DuplicateSequence("another writer has appended")
            one = replace(
                s.segments[-1], files=(f"{folder}/events",), event_count=got["n"], stored_bytes=got["b"], first_sequence=got["lo"], last_sequence=got["hi"],
                first_timestamp_ms=got["t0"], last_timestamp_ms=got["t1"],
            )
            floor = got["lo"] if got["lo"] > 1 else s.retention_floor
            return self._sealed(replace(s, segments=(*s.segments[:-1], one), high_watermark=got["hi"], retention_floor=floor, source_offsets=dict(source_offsets)))

        self._commit(change)
        return got["n"]

    def wait(self, after: int, seconds: float) -> bool:
        """Whether there are events after a sequence, at once or within some seconds: a commit of this process wakes it."""
        with self.committed:
            if self.state().high_watermark <= after:
                self.committed.wait(seconds)
        return self.state().high_watermark > after

    def _write(self, events: DataFrame, source_name: str, end_lsn: str, before_commit: Callable[[], None] | None) -> str:
        per = events.groupBy("end_lsn").agg(F.count(F.lit(1)).alias("n"), F.sum("payload_bytes").alias("b"))
        top = per.agg(F.max("n").alias("n"), F.max("b").alias("b"), F.sum("n").alias("all_n"), F.sum("b").alias("all_b"), F.count(F.lit(1)).alias("t")).first()
        if top["n"] > self.limits.transaction_events:
            raise EventLimitExceeded(f"a transaction has {top['n']} events")
        if top["b"] > self.limits.transaction_bytes:
            raise ByteLimitExceeded(f"a transaction has {top['b']} bytes")
        self._capacity(top["all_b"])
        state = self._rotated(self.state(), top["all_n"], top["all_b"])
        active = state.segments[-1]
        high = state.high_watermark
        sequenced = capture.sequences(events.select(*events.columns), ["source_name"], "lsn_number", high)
        if active.marker_files:
            here = self.spark.read.schema(MARKERS).parquet(*[f"{self.path}/data/{f}" for f in active.marker_files])
            if not events.select("marker").distinct().join(here, "marker", "left_semi").isEmpty():
                raise DuplicateMarker("a transaction is already in the active segment")
        folder = f"segment-{active.id:020d}/{uuid.uuid4().hex}"
        out = sequenced.select(
            "sequence", "event_id", F.struct(F.lit(self.database).alias("database"), F.lit(self.slot).alias("slot"), F.col("wal_start").alias("lsn")).alias("source"),
            F.struct(F.col("xid").alias("transaction_id"), F.lit(None).cast("string").alias("begin_lsn"), "commit_lsn").alias("transaction"),
            "schema", "table", "operation", "key", "before", "after", "commit_timestamp_ms", "end_lsn", "payload_bytes",
        )
        parts = max(1, -(-top["all_b"] // FILE_BYTES), -(-top["all_n"] // FILE_EVENTS))
        # Sequences have no gaps, so where each file begins is known: no sample of the rows is taken for the ranges.
        range_ = F.expr(f"cast((sequence - {high + 1}) div {-(-top['all_n'] // parts)} as int)")
        out.repartitionById(parts, range_).sortWithinPartitions("sequence").write.parquet(f"{self.path}/data/{folder}/events")
        events.select("marker").distinct().withColumn("segment_id", F.lit(active.id).cast("long")).write.parquet(f"{self.path}/data/{folder}/markers")
        got = self.spark.read.schema(STORED).parquet(f"{self.path}/data/{folder}/events").agg(
            F.count(F.lit(1)).alias("n"), F.sum("payload_bytes").alias("b"), F.min("sequence").alias("lo"), F.max("sequence").alias("hi"),
            F.count_distinct("sequence").alias("d"), F.min("commit_timestamp_ms").alias("t0"), F.max("commit_timestamp_ms").alias("t1"),
        ).first()
        if got["lo"] != high + 1 or got["hi"] != high + got["n"] or got["d"] != got["n"]:
            raise DuplicateSequence(f"sequences {got['lo']} to {got['hi']} do not follow {high}")
        if before_commit:
            before_commit()
        least = lambda a, b: b if a is None else a if b is None else min(a, b)
        most = lambda a, b: b if a is None else a if b is None else max(a, b)

        def change(s: State) -> State:
            if s.high_watermark != high:
                raise DuplicateSequence("another writer has appended")
            s = self._rotated(s, top["all_n"], top["all_b"])
            a = s.segments[-1]
            a = replace(
                a, files=(*a.files, f"{folder}/events"), marker_files=(*a.marker_files, f"{folder}/markers"), event_count=a.event_count + got["n"],
                marker_count=a.marker_count + top["t"], stored_bytes=a.stored_bytes + got["b"], first_sequence=a.first_sequence or got["lo"], last_sequence=got["hi"],
                first_timestamp_ms=least(a.first_timestamp_ms, got["t0"]), last_timestamp_ms=most(a.last_timestamp_ms, got["t1"]),
            )
            s = replace(s, segments=(*s.segments[:-1], a), high_watermark=got["hi"], source_offsets={**s.source_offsets, source_name: end_lsn})
            m = self.limits.segment
            full = a.event_count >= m.events or a.stored_bytes >= m.bytes or self.now_ms() - a.created_ms >= m.age_ms
            return self._sealed(s) if full else s

        self._commit(change)
        return PERSISTED

    def _capacity(self, needed: int) -> None:
        used, free = self.files.size(self.path), self.files.free(self.path)
        if used + needed + self.limits.headroom_bytes > self.limits.storage_bytes or free < self.limits.reserve_bytes + needed + self.limits.headroom_bytes:
            raise ResourceLimit("the log has no room for this batch")

    def _rotated(self, s: State, events: int, size: int) -> State:
        a, m = s.segments[-1], self.limits.segment
        if a.event_count and (a.event_count + events > m.events or a.stored_bytes + size > m.bytes or self.now_ms() - a.created_ms >= m.age_ms):
            return self._sealed(s)
        return s

    def _sealed(self, s: State) -> State:
        a = s.segments[-1]
        return replace(s, segments=(*s.segments[:-1], replace(a, sealed=True), Segment(a.id + 1, self.now_ms())))

    def checkpoint(self, source_name: str, position: str) -> None:
        """Only the source's position: no event, no marker."""
        self._commit(lambda s: replace(s, source_offsets={**s.source_offsets, source_name: position}))

    def bind_identity(self, source_name: str, system_identifier: str, database_oid: int) -> None:
        """The first binding holds for good."""

        def change(s: State) -> State:
            new = {"system_identifier": system_identifier, "database_oid": database_oid}
            old = s.identities.get(source_name)
            if old is not None and old != new:
                raise IdentityMismatch(f"the log belongs to {old}, the source is {new}")
            return replace(s, identities={**s.identities, source_name: new})

        self._commit(change)

    def set_consumer_offset(self, key: str, sequence: int, only_forward: bool) -> int:
        def change(s: State) -> State:
            if key not in s.consumer_offsets and len(s.consumer_offsets) >= self.limits.consumers:
                raise ResourceLimit("too many consumers")
            value = max(sequence, s.consumer_offsets.get(key, 0)) if only_forward else sequence
            return replace(s, consumer_offsets={**s.consumer_offsets, key: value})

        return self._commit(change).consumer_offsets[key]

    # Maintenance

    def prune(self, policy: Retention, now_ms: int | None = None) -> dict:
        """Drop the oldest sealed segments that the policy condemns, whole, stopping at the first that it spares."""
        now = self.now_ms() if now_ms is None else now_ms
        if policy.delete_batch <= 0:
            raise ValueError("delete_batch must be positive")
        gone: list[Segment] = []

        def change(s: State) -> State:
            gone.clear()
            a = s.segments[-1]
            if a.event_count and now - a.created_ms >= self.limits.segment.age_ms:
                s = self._sealed(s)
            events, size = sum(x.event_count for x in s.segments), sum(x.stored_bytes for x in s.segments)
            for x in s.segments[:-1]:
                old = policy.max_age_ms is not None and x.last_timestamp_ms is not None and x.last_timestamp_ms <= now - policy.max_age_ms
                over = (policy.max_events is not None and events > policy.max_events) or (policy.max_bytes is not None and size > policy.max_bytes)
                if not (old or over) or sum(y.event_count for y in gone) >= policy.delete_batch:
                    break
                gone.append(x)
                events, size = events - x.event_count, size - x.stored_bytes
            left = s.segments[len(gone) :]
            first = min((x.first_sequence for x in left if x.first_sequence is not None), default=s.high_watermark + 1)
            return replace(s, segments=left, retention_floor=max(s.retention_floor, first) if gone else s.retention_floor)

        s = self._commit(change) if policy.enabled else self.state()
        return {
            "deleted_segments": len(gone), "deleted_events": sum(x.event_count for x in gone), "deleted_markers": sum(x.marker_count for x in gone),
            "deleted_bytes": sum(x.stored_bytes for x in gone), "first_retained": s.first_sequence or s.high_watermark + 1, "high_watermark": s.high_watermark,
        }

    def retain(self, policy: Retention, now_ms: int | None = None) -> dict:
        """Sweep until the policy condemns nothing more: prune() stops each time that its batch is full. Returns the sums of the sweeps."""
        now = self.now_ms() if now_ms is None else now_ms
        got = self.prune(policy, now)
        out = dict(got)
        while got["deleted_events"] >= policy.delete_batch:
            got = self.prune(policy, now)
            out = {k: out[k] + v if k.startswith("deleted_") else v for k, v in got.items()}
        return out

    def vacuum(self) -> list[str]:
        """Remove what no commit names: pruned segments and interrupted writes. Call it from the writer."""
        known = {f.rsplit("/", 1)[0] for s in self.state().segments for f in s.files}
        out = []
        for segment in self.files.names(f"{self.path}/data"):
            for part in self.files.names(f"{self.path}/data/{segment}"):
                if f"{segment}/{part}" not in known:
                    self.files.delete(f"{self.path}/data/{segment}/{part}")
                    out.append(f"{segment}/{part}")
            if not self.files.names(f"{self.path}/data/{segment}"):
                self.files.delete(f"{self.path}/data/{segment}")
        return out

    def violations(self) -> DataFrame:
        state = self.state()
        catalog = self.catalog(state).filter("event_count > 0")
        return validate.integrity_violations(self.log(0, state), catalog).union(validate.catalog_violations(catalog))

    def verify(self) -> dict:
        """The integrity report, or an error that names violations."""
        bad = self.violations().take(20)
        state = self.state()
        ids = self.log(0, state).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_id") == "").alias("empty")).first()
        markers = self.markers(state).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("marker") == "").alias("empty")).first()
        more = [f"empty {k}" for k, x in (("event id", ids["empty"]), ("marker", markers["empty"])) if x]
        more += ["marker count"] if markers["n"] != sum(s.marker_count for s in state.segments) else []
        more += [f"offset of {k}" for k, v in state.source_offsets.items() if not k or lsn.position(v) is None]
        more += [f"identity of {k}" for k, v in state.identities.items() if not v.get("system_identifier") or v.get("database_oid") is None]
        if bad or more:
            raise IntegrityError("; ".join([*(f"segment {r['segment_id']}: {r['violation']}" for r in bad), *more]))
        return {**self.stats(), "first_sequence": state.first_sequence, "high_watermark": state.high_watermark, "events": ids["n"], "markers": markers["n"]}


def _dump(new: State, old: State | None) -> str:
    """A record: what differs from the last state, segments by id; without one, all."""
    out = asdict(new)
    out["segments"] = [asdict(s) for s in new.segments if old is None or s not in old.segments]
    out["removed"] = [] if old is None else [s.id for s in old.segments if s.id not in {x.id for x in new.segments}]
    if old is not None:
        for k in ("source_offsets", "consumer_offsets", "identities"):
            out[k] = {a: b for a, b in getattr(new, k).items() if getattr(old, k).get(a) != b}
    return json.dumps(out)


def _load(text: str, old: State = State()) -> State:
    x = json.loads(text)
    if x["format_version"] > FORMAT:
        raise UnsupportedFormat(f"format {x['format_version']} is newer than {FORMAT}")
    x = migrate(x)
    removed = set(x.pop("removed", []))
    segments = {s.id: s for s in old.segments if s.id not in removed}
    for s in x.pop("segments"):
        segments[s["id"]] = Segment(**{**s, "files": tuple(s["files"]), "marker_files": tuple(s["marker_files"])})
    for k in ("source_offsets", "consumer_offsets", "identities"):
        x[k] = {**getattr(old, k), **x[k]}
    return State(**{**x, "segments": tuple(segments[k] for k in sorted(segments))})


def migrate(record: dict) -> dict:
    """Records of format 1 had no identities and no markers by segment."""
    if record["format_version"] == 1:
        record = {**record, "format_version": FORMAT, "identities": record.get("identities", {})}
        record["segments"] = [{"marker_files": [], "marker_count": 0, **s} for s in record["segments"]]
    return record
