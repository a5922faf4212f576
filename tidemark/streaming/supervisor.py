"""Keeping a capture alive: reconnects with backoff, state changes, heartbeats, storage samples and an orderly end."""

from __future__ import annotations

import random
import signal
import threading
import time
from collections.abc import Callable

from ..errors import DataSafetyError
from ..metrics import Metrics, RuntimeState
from ..operators.log_store import LogStore

#: Milliseconds of the first delay and of the longest one. Fixed values.
FIRST_MS, LONGEST_MS = 250, 15_000


def reconnect_delay_ms(attempt: int, fraction: float) -> int:
    """Doubling from FIRST_MS, plus a fraction of a quarter of it, at most LONGEST_MS."""
    base = min(LONGEST_MS, FIRST_MS << min(attempt, 16))
    return min(LONGEST_MS, base + int(fraction * max(1, base // 4)))


class Every:
    """Calls a function at once or after a first interval, then at intervals, until it is stopped. A failure is passed to on_error."""

    def __init__(self, seconds: float, call: Callable[[], None], on_error: Callable[[Exception], None] = lambda e: None, at_once: bool = False):
        if seconds <= 0:
            raise ValueError("an interval must be positive")
        self.seconds, self.call, self.on_error, self.stopped = seconds, call, on_error, threading.Event()
        if at_once:
            self._once()
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()

    def _once(self) -> None:
        try:
            self.call()
        except Exception as e:
            self.on_error(e)

    def _run(self) -> None:
        while not self.stopped.wait(self.seconds):
            self._once()

    def stop(self) -> None:
        self.stopped.set()
        self.thread.join(self.seconds + 5)


def storage_sampler(store: LogStore, metrics: Metrics, seconds: float) -> Every:
    """A sample before it returns, then one at each interval; one that fails makes storage unhealthy for good."""

    def sample() -> None:
        metrics.last_sample = metrics.sample(store)
        metrics.add("storage_samples")

    def failed(e: Exception) -> None:
        metrics.add("storage_sample_errors")
        metrics.storage_healthy = False

    return Every(seconds, sample, failed, at_once=True)


class Supervisor:
    """Runs a capture again whenever it fails in a way that may pass.

    connect() gives something with awaitTermination(seconds), which tells whether it has ended or raises, and stop(); a streaming
    query is one. retryable() judges failures; those of data safety are never retried. Delays start anew once a capture has
    committed something. heartbeat(), where given, is called at intervals while the capture runs: a transaction without events,
    by which the position of an idle source moves on.
    """

    def __init__(
        self, connect: Callable[[], object], metrics: Metrics, retryable: Callable[[Exception], bool], heartbeat: Callable[[], None] | None = None, heartbeat_s: float = 10.0,
        poll_s: float = 0.2, drain_s: float = 30.0, fraction: Callable[[], float] = random.random,
    ):
        self.connect, self.metrics, self.retryable, self.heartbeat, self.heartbeat_s = connect, metrics, retryable, heartbeat, heartbeat_s
        self.poll_s, self.drain_s, self.fraction, self.stopping, self.delays = poll_s, drain_s, fraction, threading.Event(), []

    def stop(self, *_) -> None:
        """Ends after the micro-batch that runs: batches are whole transactions."""
        self.stopping.set()

    def install_signals(self) -> None:
        """SIGINT and SIGTERM stop it; a second one does what it did before."""
        for s in (signal.SIGINT, signal.SIGTERM):
            before = signal.getsignal(s)

            def handle(number, frame, before=before):
                signal.signal(number, before)
                self.stop()

            signal.signal(s, handle)

    def run(self) -> None:
        attempt = 0
        self.metrics.state = RuntimeState.STARTING
        while not self.stopping.is_set():
            commits = self.metrics.commits
            try:
                if self._capture():
                    return
            except Exception as e:
                if isinstance(e, DataSafetyError) or not self.retryable(e):
                    self.metrics.state = RuntimeState.FAILED
                    raise
                attempt = 0 if self.metrics.commits > commits else attempt
                delay = reconnect_delay_ms(attempt, self.fraction())
                attempt += 1
                self.delays.append(delay)
                self.metrics.add("reconnects")
                self.metrics.state = RuntimeState.RETRYING
                self.stopping.wait(delay / 1000)
        self.metrics.state = RuntimeState.DRAINING

    def _capture(self) -> bool:
        """Whether it ended by itself or was asked to."""
        query = self.connect()
        failures: list[Exception] = []
        beats = Every(self.heartbeat_s, self._beat, failures.append) if self.heartbeat else None
        self.metrics.state = RuntimeState.CAPTURING if self.metrics.storage_healthy else RuntimeState.DEGRADED
        try:
            while not self.stopping.is_set():
                if failures and (isinstance(failures[0], DataSafetyError) or not self.retryable(failures[0])):
                    raise failures[0]
                failures.clear()
                if query.awaitTermination(self.poll_s):
                    return True
            self.metrics.state = RuntimeState.DRAINING
            return True
        finally:
            if beats:
                beats.stop()
            query.stop()
            query.awaitTermination(self.drain_s)

    def _beat(self) -> None:
        self.heartbeat()
        self.metrics.add("heartbeats")
