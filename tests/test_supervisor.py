import signal
import socketserver
import threading
import time

import pytest
from tidemark.errors import DecodeError, RetryableSinkError, SinkError
from tidemark.metrics import COUNTERS, GAUGES, Metrics, RuntimeState
from tidemark.operators.log_store import LogStore
from tidemark.streaming.resp import RespKeyValue
from tidemark.streaming.supervisor import Every, Supervisor, reconnect_delay_ms, storage_sampler


class Query:
    """Ends, fails or runs on, as its script says."""

    def __init__(self, script):
        self.script, self.stopped = script, False

    def awaitTermination(self, seconds):
        if self.stopped:
            return True
        time.sleep(0.001)
        x = self.script.pop(0) if self.script else False
        if isinstance(x, Exception):
            raise x
        return x

    def stop(self):
        self.stopped = True


def test_delays():
    assert [reconnect_delay_ms(n, 0.0) for n in range(8)] == [250, 500, 1000, 2000, 4000, 8000, 15000, 15000]
    assert reconnect_delay_ms(0, 0.999) < 250 + 63 and reconnect_delay_ms(99, 0.9) == 15000


def test_retries_until_it_ends_and_delays_start_anew_after_a_commit(monkeypatch):
    m, scripts, states = Metrics(), [[OSError()], [OSError()], [OSError()], [True]], []

    def connect():
        states.append(m.state)
        if len(scripts) == 2:
            m.committed(1, 1, 1, 0.1)
        return Query(scripts.pop(0))

    s = Supervisor(connect, m, lambda e: isinstance(e, OSError), fraction=lambda: 0.0)
    monkeypatch.setattr(s.stopping, "wait", lambda seconds: None)
    s.run()
    assert s.delays == [250, 500, 250] and m.counts["reconnects"] == 3
    assert states == [RuntimeState.STARTING] + [RuntimeState.RETRYING] * 3


def test_fatal_failures_end_it():
    for failure in (DecodeError("x"), ValueError("x")):
        m = Metrics()
        with pytest.raises(type(failure)):
            Supervisor(lambda: Query([failure]), m, lambda e: not isinstance(e, ValueError)).run()
        assert m.state is RuntimeState.FAILED


def test_heartbeats_and_an_orderly_stop():
    m, query = Metrics(), Query([])
    beats = []
    s = Supervisor(lambda: query, m, lambda e: True, heartbeat=lambda: beats.append(1), heartbeat_s=0.01)
    s.install_signals()
    threading.Timer(0.2, lambda: signal.raise_signal(signal.SIGTERM)).start()
    before = signal.getsignal(signal.SIGINT)
    s.run()
    signal.signal(signal.SIGINT, signal.default_int_handler)
    assert before is not None and query.stopped and len(beats) > 3 and m.counts["heartbeats"] == len(beats) and m.state is RuntimeState.DRAINING
    with pytest.raises(ValueError):
        Every(0, print)


def test_storage_samples_latch(spark, tmp_path):
    m, store = Metrics(), LogStore(spark, str(tmp_path / "log"))
    every = storage_sampler(store, m, 0.01)
    assert m.last_sample["segments"] == 1 and m.counts["storage_samples"] >= 1
    store.files.size = lambda path: 1 / 0
    time.sleep(0.2)
    every.stop()
    assert not m.storage_healthy and m.counts["storage_sample_errors"] >= 1
    text = m.render(m.last_sample)
    assert all(f"tidemark_{c}_total" in text for c in COUNTERS) and all(f"tidemark_{g} " in text for g in GAUGES)
    assert "tidemark_storage_ready 0" in text and text.count("# TYPE") >= 47


class Server(socketserver.ThreadingTCPServer):
    allow_reuse_address, daemon_threads = True, True

    def __init__(self):
        self.data, self.fail, self.drop = {}, None, 0
        super().__init__(("127.0.0.1", 0), Handler)


class Handler(socketserver.StreamRequestHandler):
    def handle(self):
        queued = None
        while line := self.rfile.readline():
            parts = []
            for _ in range(int(line[1:])):
                n = int(self.rfile.readline()[1:])
                parts.append(self.rfile.read(n + 2)[:-2].decode())
            if self.server.drop:
                self.server.drop -= 1
                return
            if parts[0] == "MULTI":
                queued, out = [], b"+OK\r\n"
            elif parts[0] == "EXEC":
                for c in queued:
                    self.server.data.pop(c[1], None) if c[0] == "DEL" else self.server.data.__setitem__(c[1], c[2:])
                out, queued = b"*%d\r\n" % len(queued) + b"".join(b":1\r\n" if c[0] == "DEL" else b"$2\r\nOK\r\n" for c in queued), None
            elif self.server.fail:
                out = f"-{self.server.fail}\r\n".encode()
            else:
                queued.append(parts)
                out = b"+QUEUED\r\n"
            self.wfile.write(out)


def test_resp_target():
    with Server() as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        kv = RespKeyValue(*server.server_address, timeout_s=2)
        kv.apply([])
        kv.apply([("set", "a", "é\r\n", 60), ("set", "b", "2", None), ("del", "a", None, None), ("set", "c", "{}", 5)])
        assert server.data == {"b": ["2"], "c": ["{}", "EX", "5"]}
        server.fail = "LOADING it starts"
        with pytest.raises(RetryableSinkError):
            kv.apply([("set", "x", "1", None)])
        assert kv.stream is None
        server.fail = "WRONGTYPE no"
        with pytest.raises(SinkError):
            kv.apply([("set", "x", "1", None)])
        server.fail, server.drop = None, 1
        with pytest.raises(RetryableSinkError):
            kv.apply([("set", "x", "1", None)])
        kv.apply([("set", "x", "1", None)])
        assert server.data["x"] == ["1"]
        kv.close()
        server.shutdown()
    with pytest.raises(RetryableSinkError):
        RespKeyValue(*server.server_address, timeout_s=1).apply([("del", "x", None, None)])
