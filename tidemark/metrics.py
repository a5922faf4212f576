"""Runtime states, capture reports and the text of a metrics endpoint."""

from __future__ import annotations

import json
import threading
import time
from dataclasses import dataclass, field
from enum import Enum

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import LATENCY_BOUNDS
from .operators.log_store import LogStore

PREFIX = "tidemark"


class RuntimeState(Enum):
    STARTING = "starting"
    CAPTURING = "capturing"
    RETRYING = "retrying"
    DEGRADED = "degraded"
    DRAINING = "draining"
    FAILED = "failed"


def storage_ready(sampled, healthy, used, limit, free, reserve):
    """Of numbers or of columns."""
    return sampled & healthy & (used < limit) & (free > reserve)


def readiness(samples: DataFrame, lane: str, order: str, healthy: str, used: Column, limit: Column, free: Column, reserve: Column) -> DataFrame:
    """storage_ready() for samples of storage: within a lane, one unhealthy sample makes all later ones not ready."""
    so_far = F.min(F.col(healthy).cast("int")).over(Window.partitionBy(lane).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) == 1
    return samples.withColumn("__healthy", so_far).withColumn("ready", storage_ready(F.lit(True), F.col("__healthy"), used, limit, free, reserve)).drop("__healthy")


#: Counters that a process keeps, beside what a commit counts.
COUNTERS = (
    "transactions", "events", "commits", "decoded_bytes", "staged_bytes", "staged_transactions", "reconnects", "replayed", "heartbeats",
    "retention_sweeps", "retention_deleted_events", "retention_deleted_bytes", "retention_errors",
    "consumer_limit_rejections", "subscription_limit_rejections", "subscription_waits", "delivered_events", "acknowledgements", "seeks", "replay_errors",
    "storage_samples", "storage_sample_errors", "sink_deliveries", "sink_retries", "sink_failures",
)
#: Gauges that something sets, beside those of a storage sample.
GAUGES = ("active_subscriptions", "last_commit_timestamp_ms", "last_batch_events", "last_batch_bytes", "retention_last_sweep_ms", "sink_offset", "source_wal_end")


@dataclass
class Metrics:
    """Counters and gauges of a process; unhealthy storage stays so."""

    state: RuntimeState = RuntimeState.STARTING
    storage_healthy: bool = True
    counts: dict = field(default_factory=lambda: dict.fromkeys(COUNTERS, 0))
    gauges: dict = field(default_factory=lambda: dict.fromkeys(GAUGES, 0))
    last_sample: dict | None = None
    buckets: list = field(default_factory=lambda: [0] * len(LATENCY_BOUNDS))
    latency_sum: float = 0.0
    lock: threading.Lock = field(default_factory=threading.Lock)

    def add(self, counter: str, n: int = 1) -> None:
        with self.lock:
            self.counts[counter] += n

    def set(self, gauge: str, value: int) -> None:
        if gauge not in self.gauges:
            raise KeyError(gauge)
        self.gauges[gauge] = value

    @property
    def commits(self) -> int:
        return self.counts["commits"]

    def committed(self, transactions: int, events: int, size: int, seconds: float, staged: int = 0, staged_bytes: int = 0) -> None:
        with self.lock:
            for k, n in (("transactions", transactions), ("events", events), ("commits", 1), ("decoded_bytes", size), ("staged_transactions", staged), ("staged_bytes", staged_bytes)):
                self.counts[k] += n
            self.gauges["last_batch_events"], self.gauges["last_batch_bytes"] = events, size
            self.latency_sum += seconds
            for i, bound in enumerate(LATENCY_BOUNDS):
                self.buckets[i] += seconds <= bound

    def pruned(self, outcome: dict, now_ms: int) -> None:
        """What LogStore.prune() returns."""
        with self.lock:
            self.counts["retention_sweeps"] += 1
            self.counts["retention_deleted_events"] += outcome["deleted_events"]
            self.counts["retention_deleted_bytes"] += outcome["deleted_bytes"]
            self.gauges["retention_last_sweep_ms"] = now_ms

    def sample(self, store: LogStore, wal_end: int | None = None) -> dict:
        from . import lsn

        s = store.state()
        lags = {k: max(0, s.high_watermark - v) for k, v in s.consumer_offsets.items()}
        durable = max((lsn.position(v) or 0 for v in s.source_offsets.values()), default=0)
        return {
            "storage_bytes": store.files.size(store.path), "retained_events": sum(x.event_count for x in s.segments), "segments": len(s.segments),
            "first_sequence": s.first_sequence or 0, "high_watermark": s.high_watermark, "retained_span": max(0, s.high_watermark - (s.first_sequence or 0) + (s.high_watermark > 0)),
            "retention_floor": s.retention_floor, "consumers": len(lags), "max_consumer_lag": max(lags.values(), default=0), "durable_position": durable,
            "wal_lag_bytes": max(0, (wal_end or durable) - durable), "source_offsets": len(s.source_offsets), "replay_markers": sum(x.marker_count for x in s.segments),
            "sealed_segments": sum(x.sealed for x in s.segments), "stored_bytes": sum(x.stored_bytes for x in s.segments), "storage_free_bytes": store.files.free(store.path),
            "storage_limit_bytes": store.limits.storage_bytes, "storage_reserve_bytes": store.limits.reserve_bytes,
        }

    def render(self, sample: dict, version: str = "0.1.0") -> str:
        """Metric families in the text exposition format."""
        out = [f"# TYPE {PREFIX}_build_info gauge", f'{PREFIX}_build_info{{version="{version}"}} 1', f"# TYPE {PREFIX}_runtime_state gauge"]
        out += [f'{PREFIX}_runtime_state{{state="{s.value}"}} {int(s is self.state)}' for s in RuntimeState]
        with self.lock:
            counters, gauges = dict(self.counts), dict(self.gauges)
            buckets, total, count = list(self.buckets), self.latency_sum, self.commits
        for k, v in counters.items():
            out += [f"# TYPE {PREFIX}_{k}_total counter", f"{PREFIX}_{k}_total {v}"]
        ready = storage_ready(True, self.storage_healthy, sample["storage_bytes"], sample["storage_limit_bytes"], sample["storage_free_bytes"], sample["storage_reserve_bytes"])
        for k, v in {**sample, **gauges, "storage_healthy": int(self.storage_healthy), "storage_ready": int(ready)}.items():
            out += [f"# TYPE {PREFIX}_{k} gauge", f"{PREFIX}_{k} {v}"]
        name = f"{PREFIX}_commit_seconds"
        out.append(f"# TYPE {name} histogram")
        for bound, n in zip(LATENCY_BOUNDS, buckets):
            out.append(f'{name}_bucket{{le="{"+Inf" if bound == float("inf") else f"{bound:g}"}"}} {n}')
        return "\n".join([*out, f"{name}_sum {total:g}", f"{name}_count {count}"]) + "\n"


class Reporter:
    """One JSON line for each interval: counts, rates and exact quantiles of commit latencies. A full buffer drops samples."""

    def __init__(self, path: str, capacity: int = 100_000):
        self.path, self.capacity, self.dropped = path, capacity, 0
        self.samples: list[tuple[int, int, int, float]] = []
        self.totals = [0, 0, 0, 0]

    def record(self, transactions: int, events: int, size: int, seconds: float) -> None:
        if len(self.samples) >= self.capacity:
            self.dropped += 1
            return
        self.samples.append((transactions, events, size, seconds))

    def report(self, elapsed_s: float, interval_s: float) -> dict:
        rows, self.samples = self.samples, []
        sums = [sum(r[i] for r in rows) for i in range(3)]
        self.totals = [a + b for a, b in zip(self.totals, [*sums, len(rows)])]
        ms = np.array([r[3] * 1000 for r in rows])
        rate = lambda x: x / interval_s if interval_s else 0.0
        per = lambda x: x / len(rows) if rows else 0.0
        line = {
            "elapsed_seconds": elapsed_s, "interval_seconds": interval_s, "total_transactions": self.totals[0], "total_events": self.totals[1], "total_bytes": self.totals[2],
            "total_commits": self.totals[3], "transactions_per_second": rate(sums[0]), "events_per_second": rate(sums[1]), "bytes_per_second": rate(sums[2]),
            "commits_per_second": rate(len(rows)), "transactions_per_commit": per(sums[0]), "events_per_commit": per(sums[1]), "bytes_per_commit": per(sums[2]),
            **{f"persist_{n}_ms": float(np.quantile(ms, q)) if rows else 0.0 for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99), ("max", 1.0))}, "dropped_samples": self.dropped,
        }
        with open(self.path, "a") as f:
            f.write(json.dumps(line) + "\n")
        return line


class ConsumerReporter:
    """One JSON line for each interval of a consumer: totals, rates and exact quantiles of latencies in milliseconds."""

    def __init__(self, path: str, clock=time.time):
        self.path, self.clock = path, clock
        self.started = self.last_report = clock()
        self.events = self.payload_bytes = self.acknowledgements = self.redeliveries = self.last_sequence = 0
        self.missing_commit_timestamps = self.clock_skew = self.interval_events = self.interval_bytes = 0
        self.end_to_end: list[float] = []
        self.acknowledged: list[float] = []

    def event(self, sequence: int, payload_bytes: int, commit_timestamp_ms: int | None) -> None:
        """A delivered event; one that is not after the last one is a redelivery and counts as nothing else."""
        if sequence <= self.last_sequence:
            self.redeliveries += 1
            return
        self.events, self.interval_events, self.last_sequence = self.events + 1, self.interval_events + 1, sequence
        self.payload_bytes, self.interval_bytes = self.payload_bytes + payload_bytes, self.interval_bytes + payload_bytes
        if commit_timestamp_ms is None:
            self.missing_commit_timestamps += 1
            return
        latency = int(self.clock() * 1000) - commit_timestamp_ms
        if latency < 0:
            self.clock_skew += 1
        else:
            self.end_to_end.append(float(latency))

    def acknowledgement(self, seconds: float) -> None:
        self.acknowledgements += 1
        self.acknowledged.append(seconds * 1000)

    def report(self, final: bool = False) -> dict:
        def latency(ms: list[float]) -> dict:
            return {"samples": len(ms), **{n: float(np.quantile(ms, q)) if ms else 0.0 for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99), ("max", 1.0))}}

        now = self.clock()
        interval = max(now - self.last_report, 1e-6)
        line = {
            "timestamp_ms": int(now * 1000), "elapsed_seconds": now - self.started, "interval_seconds": interval, "final": final,
            "events_per_second": self.interval_events / interval, "payload_bytes_per_second": self.interval_bytes / interval, "events_total": self.events,
            "payload_bytes_total": self.payload_bytes, "acknowledgements_total": self.acknowledgements, "redeliveries_total": self.redeliveries,
            "last_sequence": self.last_sequence, "missing_commit_timestamps_total": self.missing_commit_timestamps, "clock_skew_samples_total": self.clock_skew,
            "end_to_end_latency_ms": latency(self.end_to_end), "acknowledgement_latency_ms": latency(self.acknowledged),
        }
        with open(self.path, "a") as f:
            f.write(json.dumps(line) + "\n")
        self.interval_events = self.interval_bytes = 0
        self.end_to_end, self.acknowledged, self.last_report = [], [], now
        return line
