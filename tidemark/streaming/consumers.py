"""Named consumers of streams: subscribe, acknowledge, seek."""

from __future__ import annotations

import hmac
import threading
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..errors import ApiError, ResourceLimit, SequenceExpired
from ..functions import event_size
from ..operators.log_store import LogStore
from ..plans import Stream

SINK_PREFIX = "sink:"


@dataclass(frozen=True)
class Principal:
    name: str
    token: str
    streams: tuple[str, ...] = ("*",)
    may_seek: bool = False


@dataclass
class Authorizer:
    """Tokens are compared in constant time; without principals everyone may do everything."""

    principals: tuple[Principal, ...] = ()

    def check(self, token: str | None, stream: str, seek: bool = False) -> None:
        if not self.principals:
            return
        found = None
        for p in self.principals:
            if hmac.compare_digest(p.token.encode(), (token or "").encode()):
                found = p
        if found is None:
            raise ApiError("unauthenticated")
        if not ({"*", stream} & set(found.streams)) or (seek and not found.may_seek):
            raise ApiError("permission_denied")


@dataclass(frozen=True)
class ApiLimits:
    name_bytes: int = 128
    event_bytes: int = 16 << 20
    subscriptions: int = 1024
    #: Events and bytes of them that the driver holds at once for a subscription, and sequences whose sizes it looks at.
    batch: int = 4096
    batch_bytes: int = 64 << 20
    read: int = 1 << 16


@dataclass
class Consumers:
    store: LogStore
    streams: dict[str, Stream]
    limits: ApiLimits = ApiLimits()
    authorizer: Authorizer = field(default_factory=Authorizer)
    #: The highest sequence delivered to each consumer; forgotten on a restart, as acknowledgements are then refused until delivery.
    delivered: dict = field(default_factory=dict)
    active: set = field(default_factory=set)
    lock: threading.Lock = field(default_factory=threading.Lock)

    def _key(self, stream: str, consumer: str) -> str:
        if not consumer or len(consumer.encode()) > self.limits.name_bytes or consumer.startswith(SINK_PREFIX):
            raise ApiError("invalid_argument", "consumer name")
        if not stream or len(stream.encode()) > self.limits.name_bytes:
            raise ApiError("invalid_argument", "stream name")
        if stream not in self.streams:
            raise ApiError("not_found", stream)
        return f"{stream}\x1f{consumer}"

    def earliest(self) -> int:
        state = self.store.state()
        return state.first_sequence - 1 if state.first_sequence is not None else state.high_watermark

    def _claim(self, key: str) -> None:
        with self.lock:
            if key in self.active:
                raise ApiError("already_exists", "the consumer has a subscription")
            if len(self.active) >= self.limits.subscriptions:
                raise ApiError("resource_exhausted", "subscriptions")
            self.active.add(key)

    def offset(self, stream: str, consumer: str) -> int:
        return self.store.state().consumer_offsets.get(self._key(stream, consumer), self.earliest())

    def read(self, stream: str, consumer: str, limit: int | None = None) -> DataFrame:
        """What a subscription would begin with, as a table."""
        return self.store.replay(self.offset(stream, consumer) + 1, limit, stream=self.streams[stream].column())

    def subscribe(self, stream: str, consumer: str, limit: int = 0, token: str | None = None, follow: bool = False, poll_s: float = 0.2, stop: threading.Event | None = None) -> Iterator[Row]:
        """Events after the offset in order, in bounded batches; limit counts events of the stream, 0 is no limit."""
        self.authorizer.check(token, stream)
        key = self._key(stream, consumer)
        self._claim(key)
        return self._events(key, stream, limit, follow, poll_s, stop)

    def _events(self, key: str, stream: str, limit: int, follow: bool, poll_s: float, stop: threading.Event | None) -> Iterator[Row]:
        try:
            at, sent = self.store.state().consumer_offsets.get(key, self.earliest()), 0
            view = self.streams[stream].column()
            while not (stop and stop.is_set()):
                state = self.store.state()
                if at >= state.high_watermark:
                    if not follow:
                        return
                    self.store.wait(at, poll_s)
                    continue
                if at + 1 < state.retention_floor:
                    raise SequenceExpired(at + 1, state.retention_floor)
                upto = min(at + self.limits.read, state.high_watermark)
                rows = self.store.log(at + 1, state).filter(F.col("sequence") <= upto)
                parts = ("event_id", "schema", "table", "source.database", "source.slot", "source.lsn", "key", "before", "after")
                rows = rows.filter(view).withColumn("__size", event_size(*[F.col(c) for c in parts]))
                for row in self._bounded(rows):
                    if row["__size"] > self.limits.event_bytes:
                        raise ApiError("resource_exhausted", f"event {row['sequence']} has {row['__size']} bytes")
                    self.delivered[key] = max(self.delivered.get(key, 0), row["sequence"])
                    yield row
                    sent += 1
                    if limit and sent >= limit:
                        return
                at = upto
        finally:
            with self.lock:
                self.active.discard(key)

    def _bounded(self, rows: DataFrame) -> Iterator[Row]:
        """A range of sequences in order. The driver holds batch events and about batch_bytes of them at once, one event at least."""
        sizes = [(r["sequence"], r["__size"]) for r in rows.select("sequence", "__size").orderBy("sequence").collect()]
        begin = 0
        while begin < len(sizes):
            end, held = begin, 0
            while end < len(sizes) and (end == begin or (end - begin < self.limits.batch and held + sizes[end][1] <= self.limits.batch_bytes)):
                held, end = held + sizes[end][1], end + 1
            if end == len(sizes) and begin == 0:
                yield from rows.orderBy("sequence").collect()
            else:
                yield from rows.filter(F.col("sequence").between(sizes[begin][0], sizes[end - 1][0])).orderBy("sequence").collect()
            begin = end

    def ack(self, stream: str, consumer: str, sequence: int, token: str | None = None) -> int:
        """The offset only moves forward, and not beyond what was delivered."""
        self.authorizer.check(token, stream)
        key = self._key(stream, consumer)
        if sequence == 0:
            raise ApiError("invalid_argument", "sequence 0")
        if key not in self.delivered:
            raise ApiError("failed_precondition", "nothing was delivered")
        if sequence > self.delivered[key]:
            raise ApiError("out_of_range", f"{self.delivered[key]} was delivered last")
        return self._set(key, sequence, True)

    def seek(self, stream: str, consumer: str, position: str, sequence: int | None = None, token: str | None = None) -> int:
        """To "earliest", "latest" or "sequence"; not while a subscription is active."""
        self.authorizer.check(token, stream, seek=True)
        key = self._key(stream, consumer)
        self._claim(key)
        try:
            if position not in ("earliest", "latest", "sequence") or (position == "sequence" and sequence is None):
                raise ApiError("invalid_argument", "position")
            to = self.earliest() if position == "earliest" else self.store.state().high_watermark if position == "latest" else sequence
            out = self._set(key, to, False)
            self.delivered.pop(key, None)
            return out
        finally:
            with self.lock:
                self.active.discard(key)

    def _set(self, key: str, sequence: int, only_forward: bool) -> int:
        try:
            return self.store.set_consumer_offset(key, sequence, only_forward)
        except ResourceLimit as e:
            raise ApiError("resource_exhausted", str(e)) from e
