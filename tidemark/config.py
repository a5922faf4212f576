"""Configuration: a TOML file to dataclasses, checked before anything starts."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields

from .errors import ConfigError, PlanError
from .operators.cache import Rule
from .functions import compile_template
from .plans import CapturePlan, Stream
from .streaming.consumers import SINK_PREFIX, Principal


@dataclass(frozen=True)
class Secret:
    """A literal, an environment variable or a file: exactly one."""

    literal: str | None = None
    env: str | None = None
    file: str | None = None

    def resolve(self) -> str:
        given = [x for x in (self.literal, self.env, self.file) if x is not None]
        if len(given) != 1:
            raise ConfigError("give a secret as exactly one of a literal, an environment variable or a file")
        if self.literal is not None:
            return self.literal
        if self.env is not None:
            if self.env not in os.environ:
                raise ConfigError(f"the environment has no {self.env}")
            return os.environ[self.env]
        try:
            with open(self.file) as f:
                return f.read().rstrip("\r\n")
        except OSError as e:
            raise ConfigError(f"cannot read {self.file}") from e


@dataclass(frozen=True)
class Source:
    name: str = "primary"
    host: str = "localhost"
    port: int = 5432
    database: str = "shop"
    user: str = "replicator"
    slot: str = "main"
    publication: str = "main"
    password: str | None = None
    password_env: str | None = None
    password_file: str | None = None
    heartbeat_interval_ms: int = 10_000

    def secret(self) -> Secret:
        return Secret(self.password, self.password_env, self.password_file)

    def connection(self) -> str:
        """Parameters in the form of the source's client library."""
        parts = {"host": self.host, "port": self.port, "dbname": self.database, "user": self.user, "password": self.secret().resolve()}
        return " ".join(f"{k}={quote(str(v))}" for k, v in parts.items())


def quote(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Runtime:
    data_dir: str = "data"
    frames_dir: str = "frames"
    batch_transactions: int = 100
    batch_events: int = 1000
    batch_bytes: int = 4 << 20
    batch_delay_ms: int = 20
    segment_events: int = 1_000_000
    segment_bytes: int = 256 << 20
    segment_age_ms: int = 900_000
    retention_events: int | None = None
    retention_bytes: int | None = None
    retention_age_ms: int | None = None
    retention_check_ms: int = 1000
    retention_delete_batch: int = 100_000
    transaction_memory_bytes: int = 16 << 20
    transaction_bytes: int = 1 << 30
    transaction_events: int = 1_000_000
    replay_batch: int = 256
    replay_bytes: int = 64 << 20
    max_consumers: int = 10_000
    max_subscriptions: int = 1024
    max_name_bytes: int = 128
    max_event_bytes: int = 16 << 20
    storage_bytes: int = 100 << 30
    storage_reserve_bytes: int = 1 << 30
    shutdown_timeout_ms: int = 30_000


@dataclass(frozen=True)
class SinkConfig:
    name: str
    stream: str
    rules: tuple[Rule, ...]
    batch: int = 500
    batch_bytes: int = 16 << 20
    retry_initial_ms: int = 250
    retry_max_ms: int = 15_000
    max_commands: int = 10_000


@dataclass(frozen=True)
class Config:
    source: Source = Source()
    runtime: Runtime = Runtime()
    streams: tuple[Stream, ...] = ()
    sinks: tuple[SinkConfig, ...] = ()
    principals: tuple[Principal, ...] = field(default=())
    log_level: str = "info"
    metrics_interval_ms: int = 1000

    def plan(self) -> CapturePlan:
        return CapturePlan.of(self.source.name, self.streams)


def _take(kind, table: dict, where: str):
    names = {f.name for f in fields(kind)}
    if unknown := sorted(set(table) - names):
        raise ConfigError(f"{where} has unknown settings: {', '.join(unknown)}")
    try:
        return kind(**table)
    except TypeError as e:
        raise ConfigError(f"{where}: {e}") from e


def parse(text: str) -> Config:
    try:
        t = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    source = _take(Source, t.get("source", {}), "source")
    streams = tuple(Stream(s.get("name", ""), s.get("source", source.name), tuple(s.get("tables", ()))) for s in t.get("streams", [{"name": "all", "tables": ["*"]}]))
    sinks = []
    for s in t.get("sinks", []):
        s = {**s, "rules": tuple(_take(Rule, r, "a rule") for r in s.get("rules", ()))}
        sinks.append(_take(SinkConfig, s, "a sink"))
    principals = tuple(_take(Principal, {**p, "streams": tuple(p.get("streams", ("*",)))}, "a principal") for p in t.get("api", {}).get("principals", []))
    config = Config(source, _take(Runtime, t.get("runtime", {}), "runtime"), streams, tuple(sinks), principals, t.get("logging", {}).get("level", "info"), t.get("observability", {}).get("interval_ms", 1000))
    validate(config)
    return config


def load(path: str) -> Config:
    try:
        with open(path) as f:
            return parse(f.read())
    except OSError as e:
        raise ConfigError(f"cannot read {path}") from e


def validate(c: Config) -> None:
    """Source, secret, plan, runtime, API, observability, sinks: in this order."""
    for name in ("name", "host", "database", "user", "slot", "publication"):
        if not getattr(c.source, name).strip():
            raise ConfigError(f"source.{name} is empty")
    if sum(x is not None for x in (c.source.password, c.source.password_env, c.source.password_file)) > 1:
        raise ConfigError("source has several passwords")
    try:
        c.plan()
    except PlanError as e:
        raise ConfigError(str(e)) from e
    for f in fields(Runtime):
        value = getattr(c.runtime, f.name)
        if isinstance(value, int) and value <= 0:
            raise ConfigError(f"runtime.{f.name} must be positive")
    r = c.runtime
    for small, large in (("transaction_memory_bytes", "transaction_bytes"), ("storage_reserve_bytes", "storage_bytes"), ("transaction_bytes", "storage_bytes"), ("max_event_bytes", "replay_bytes")):
        if getattr(r, small) > getattr(r, large):
            raise ConfigError(f"runtime.{small} is over runtime.{large}")
    for s in c.streams:
        if len(s.name.encode()) > r.max_name_bytes:
            raise ConfigError(f"the name of stream {s.name} is too long")
    if len({p.token for p in c.principals}) < len(c.principals) or any(not p.token or not p.name for p in c.principals):
        raise ConfigError("principals need names and tokens of their own")
    if c.source.heartbeat_interval_ms <= 0 or c.metrics_interval_ms <= 0:
        raise ConfigError("intervals must be positive")
    known, seen = {s.name for s in c.streams}, set()
    for s in c.sinks:
        if not s.name.strip() or s.name in seen or len(f"{SINK_PREFIX}{s.name}".encode()) > r.max_name_bytes:
            raise ConfigError(f"the sink name {s.name!r} is empty, taken or too long")
        seen.add(s.name)
        if s.stream not in known:
            raise ConfigError(f"sink {s.name} reads the unknown stream {s.stream}")
        if min(s.batch, s.batch_bytes, s.retry_initial_ms, s.retry_max_ms, s.max_commands) <= 0 or s.retry_initial_ms > s.retry_max_ms:
            raise ConfigError(f"the limits of sink {s.name} are not positive or not in order")
        if not s.rules:
            raise ConfigError(f"sink {s.name} has no rule")
        for rule in s.rules:
            if rule.mode not in ("upsert", "invalidate") or (rule.ttl_seconds is not None and rule.ttl_seconds <= 0):
                raise ConfigError(f"a rule of sink {s.name} has a bad mode or time to live")
            try:
                if not any(field for field, _ in compile_template(rule.key)):
                    raise ValueError(f"{rule.key!r} names no field")
            except ValueError as e:
                raise ConfigError(f"sink {s.name}: {e}") from e
