import json

import helpers as h
import pytest
from tidemark import cli, config
from tidemark import errors as e
from tidemark.metrics import Metrics, Reporter, RuntimeState, storage_ready
from tidemark.operators.cache import Rule, map_events, mutations
from tidemark.operators.capture import SegmentLimits
from tidemark.operators.log_store import Limits, LogStore, Retention
from tidemark.plans import CapturePlan, Stream
from tidemark.sources.pgoutput import FRAMES
from tidemark.streaming import capture as capturing
from tidemark.streaming.consumers import ApiLimits, Authorizer, Consumers, Principal
from tidemark.streaming.sinks import CacheSink, MemoryKeyValue, Sink, SinkWorker, TableKeyValue

ALL, ITEMS = Stream("all", "primary", ("*",)), Stream("items", "primary", ("public.items",))


def filled(spark, path, segment=3, consumers=10):
    s = LogStore(spark, str(path), limits=Limits(SegmentLimits(segment, 1 << 30, 10**9), consumers=consumers), clock=lambda: 0)
    s.persist(h.captured(spark, [2]), "primary")
    s.persist(h.captured(spark, [2], first=2, table="items"), "primary")
    s.persist(h.captured(spark, [2], first=3), "primary")
    return s


def code(f, *args, **kwargs):
    with pytest.raises(e.ApiError) as x:
        f(*args, **kwargs)
    return x.value.code


def seqs(rows):
    return [r["sequence"] for r in rows]


def test_subscribe_ack_seek(spark, tmp_path):
    s = filled(spark, tmp_path)
    c = Consumers(s, {"all": ALL, "items": ITEMS})
    assert code(c.ack, "all", "a", 1) == "failed_precondition"
    assert seqs(c.subscribe("all", "a", limit=3)) == [1, 2, 3]
    assert code(c.ack, "all", "a", 0) == "invalid_argument" and code(c.ack, "all", "a", 4) == "out_of_range"
    assert c.ack("all", "a", 2) == 2 and c.ack("all", "a", 1) == 2
    assert seqs(c.subscribe("all", "a")) == [3, 4, 5, 6]
    assert seqs(c.subscribe("items", "a", limit=1)) == [3] and seqs(c.subscribe("items", "a")) == [3, 4]
    assert c.seek("all", "a", "latest") == 6 and seqs(c.subscribe("all", "a")) == []
    assert code(c.ack, "all", "a", 1) == "failed_precondition"
    assert c.seek("all", "a", "earliest") == 0 and c.seek("all", "new", "sequence", 4) == 4
    assert seqs(c.subscribe("all", "new")) == [5, 6] and c.read("all", "new").count() == 2
    assert Consumers(s, {"all": ALL}).offset("all", "new") == 4


def test_one_subscription_for_a_consumer(spark, tmp_path):
    c = Consumers(filled(spark, tmp_path), {"all": ALL}, ApiLimits(subscriptions=2))
    first = c.subscribe("all", "a")
    next(first)
    assert code(lambda: list(c.subscribe("all", "a"))) == "already_exists" and code(c.seek, "all", "a", "latest") == "already_exists"
    other = c.subscribe("all", "b")
    next(other)
    assert code(lambda: list(c.subscribe("all", "c"))) == "resource_exhausted"
    first.close()
    assert seqs(c.subscribe("all", "a", limit=1)) == [1]


def test_names_and_limits(spark, tmp_path):
    c = Consumers(filled(spark, tmp_path, consumers=1), {"all": ALL}, ApiLimits(event_bytes=10))
    for bad in ("", "sink:x", "é" * 65):
        assert code(c.offset, "all", bad) == "invalid_argument"
    assert code(c.offset, "none", "a") == "not_found"
    assert code(lambda: list(c.subscribe("all", "a"))) == "resource_exhausted"
    assert c.seek("all", "a", "latest") == 6 and code(c.seek, "all", "b", "latest") == "resource_exhausted" and c.seek("all", "a", "earliest") == 0


def test_expired_offsets(spark, tmp_path):
    s = filled(spark, tmp_path, segment=2)
    c = Consumers(s, {"all": ALL})
    c.seek("all", "slow", "sequence", 1)
    s.prune(Retention(max_events=2))
    with pytest.raises(e.SequenceExpired):
        list(c.subscribe("all", "slow"))
    assert seqs(c.subscribe("all", "new")) == [5, 6] and c.earliest() == 4


def test_authorization(spark, tmp_path):
    auth = Authorizer((Principal("p", "secret", ("all",)), Principal("q", "other", ("*",), True)))
    c = Consumers(filled(spark, tmp_path), {"all": ALL, "items": ITEMS}, authorizer=auth)
    assert code(c.subscribe, "all", "a") == "unauthenticated" and code(c.subscribe, "items", "a", token="secret") == "permission_denied"
    assert code(c.seek, "all", "a", "latest", token="secret") == "permission_denied" and c.seek("items", "a", "latest", token="other") == 6


def change(seq, op, key=None, before=None, after=None):
    return (seq, "public", "orders", op, *(None if x is None else json.dumps(x) for x in (key, before, after)))


CHANGES = "sequence long, schema_name string, table_name string, operation string, key_json string, before_json string, after_json string"


def test_cache_rules(spark):
    rows = [
        change(1, "insert", after={"t": "a", "id": 1}), change(2, "update", before={"t": "a", "id": 1}, after={"t": "a", "id": 1, "s": 2}),
        change(3, "update", before={"t": "a", "id": 1}, after={"t": "b", "id": 1}), change(4, "delete", before={"t": "b", "id": 1}), change(5, "update", after={"t": "a", "id": 1}),
        change(6, "insert", after={"t": "a"}), change(7, "truncate"), change(8, "update", key={"t": "a", "id": 9}, after={"t": "a", "id": {"__unchanged_toast": True}}), change(9, "delete"),
    ]
    df = spark.createDataFrame(rows, CHANGES)
    mapped = map_events(df, [Rule("public.orders", "{t}:{id}", "upsert", 60), Rule("public.none", "{x}", "invalidate")])
    errors = {r["sequence"]: r["error"] for r in mapped.collect()}
    assert errors == {1: None, 2: None, 3: None, 4: None, 5: "no old key", 6: "no key", 7: "truncate", 8: "unchanged value", 9: "no key"}
    got = [(r["sequence"], r["kind"], r["key"], r["ttl_seconds"]) for r in mutations(mapped).orderBy("sequence", "pos").collect()]
    assert got == [(1, "set", "a:1", 60), (2, "set", "a:1", 60), (3, "del", "a:1", None), (3, "set", "b:1", 60), (4, "del", "b:1", None)]
    inval = mutations(map_events(df.filter("sequence = 3"), [Rule("public.orders", "{t}", "invalidate")])).orderBy("pos").collect()
    assert [(r["kind"], r["key"]) for r in inval] == [("del", "a"), ("del", "b")]


def test_sink_worker_moves_past_what_it_read(spark, tmp_path):
    s, kv = filled(spark, tmp_path), MemoryKeyValue()
    w = SinkWorker(s, "cache", ITEMS, CacheSink([Rule("public.items", "item:{id}")], kv), batch=2)
    assert w.run_once() and w.offset() == 2 and kv.data == {}
    w.drain()
    assert w.offset() == 6 and not w.run_once() and sorted(kv.data) == ["item:200", "item:201"]
    s.set_consumer_offset(w.key, 0, only_forward=False)
    before = dict(kv.data)
    w.drain()  # a second delivery changes nothing
    assert kv.data == before


def test_table_of_a_sink_equals_a_cache_in_memory(spark, tmp_path, monkeypatch):
    """Sets, deletes and other sets of keys, over several batches, delivered again: mutations stay on the executors."""
    changes = [("set", "a", "1", 60), ("del", "b", None, None), ("set", "b", "2", None), ("set", "a", "3", None), ("del", "a", None, None), ("set", "c", "4", 5), ("set", "a", "5", 7)]
    memory, table = MemoryKeyValue(), TableKeyValue(spark, str(tmp_path / "kv"))
    assert table.table().count() == 0
    for upto in ([0, 1, 2], [3, 4], [5], [0, 1, 2], [3, 4]):
        for target in (memory, table):
            target.apply([changes[i] for i in upto])
        assert {r["key"]: (r["value"], r["ttl_seconds"]) for r in table.table().collect()} == memory.data
    assert memory.data and TableKeyValue(spark, str(tmp_path / "kv")).table().count() == len(memory.data)
    s, kv, rules = filled(spark, tmp_path / "log"), TableKeyValue(spark, str(tmp_path / "cache")), [Rule("public.items", "item:{id}")]
    monkeypatch.setattr(kv, "apply", None)  # what would take mutations from the driver
    SinkWorker(s, "cache", ITEMS, CacheSink(rules, kv), batch=2).drain()
    assert sorted(r["key"] for r in kv.table().collect()) == ["item:200", "item:201"]
    with pytest.raises(e.SinkError, match="commands"):
        SinkWorker(s, "m", ALL, CacheSink(rules, kv, max_commands=1)).drain()
    # Limits are of a batch, though many go at once; and those before a batch that fails are delivered.
    SinkWorker(s, "one", ALL, CacheSink(rules, kv, max_commands=1), batch=1).drain()
    bad = SinkWorker(s, "bad", ALL, CacheSink([Rule("public.items", "{nothing}")], kv), batch=1)
    with pytest.raises(e.SinkError, match="no key"):
        bad.drain()
    assert bad.offset() == min(r["sequence"] for r in s.log().filter("table = 'items'").collect()) - 1 > 0


def test_sink_retries_and_fails(spark, tmp_path):
    s, slept = filled(spark, tmp_path), []

    class Flaky(Sink):
        calls = 0

        def deliver(self, events):
            Flaky.calls += 1
            if Flaky.calls < 4:
                raise e.RetryableSinkError

    w = SinkWorker(s, "f", ALL, Flaky(), initial_ms=250, max_ms=600, sleep=slept.append)
    w.drain()
    assert slept == [0.25, 0.5, 0.6] and w.offset() == 6
    bad = SinkWorker(s, "b", ALL, CacheSink([Rule("public.items", "{nothing}")], MemoryKeyValue()))
    with pytest.raises(e.SinkError):
        bad.drain()
    assert bad.offset() == 0
    with pytest.raises(e.SinkError):
        SinkWorker(s, "m", ALL, CacheSink([Rule("public.items", "{id}")], MemoryKeyValue(), max_commands=1)).drain()


def test_streaming_capture_restarts_exactly(spark, tmp_path):
    orders = h.relation(7, "public", "orders", ["id"])
    parts = [h.frames([orders, h.insert(7, "1"), h.insert(7, "2")], [h.insert(7, "3")]), h.frames([h.insert(7, "4")], start=8), h.frames([h.insert(7, "5")], start=20)]
    plan = CapturePlan.of("primary", [ALL])
    s = LogStore(spark, str(tmp_path / "log"))

    def files(n):
        for i in range(n):
            if not (tmp_path / "frames" / f"f{i}").exists():
                spark.createDataFrame(parts[i], FRAMES).coalesce(1).write.parquet(str(tmp_path / "frames" / f"f{i}"))

    def go(checkpoint, store):
        step = capturing.Capture(store, "primary", plan)
        stream = capturing.decode_stream(spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "frames" / "*")), plan)
        capturing.start(stream, step, str(tmp_path / checkpoint)).awaitTermination()

    files(2)
    go("c1", s)
    assert seqs(s.log().orderBy("sequence").collect()) == [1, 2, 3, 4]
    files(3)
    go("c1", LogStore(spark, str(tmp_path / "log")))  # relations come from the state
    assert [json.loads(r["after"])["id"] for r in s.log().orderBy("sequence").collect()] == ["1", "2", "3", "4", "5"]
    go("c2", LogStore(spark, str(tmp_path / "log")))  # a lost checkpoint: all frames come again
    assert seqs(s.log().orderBy("sequence").collect()) == [1, 2, 3, 4, 5]
    s.verify()


GOOD = """
[source]
name = "primary"
password_env = "NOPE"
[runtime]
data_dir = "{dir}/log"
[[streams]]
name = "all"
tables = ["*"]
[[sinks]]
name = "cache"
stream = "all"
rules = [{{table = "public.items", key = "item:{{id}}", ttl_seconds = 60}}]
"""


def test_config(tmp_path, monkeypatch):
    c = config.parse(GOOD.format(dir=tmp_path))
    assert c.runtime.batch_transactions == 100 and c.sinks[0].rules[0].ttl_seconds == 60 and c.plan().matches("a", "b")
    with pytest.raises(e.ConfigError):
        c.source.secret().resolve()
    monkeypatch.setenv("NOPE", "it's\\")
    assert "password='it\\'s\\\\'" in c.source.connection()
    (tmp_path / "pw").write_text("x\r\n")
    assert config.Secret(file=str(tmp_path / "pw")).resolve() == "x"
    assert config.parse("").streams[0].tables == ("*",)


@pytest.mark.parametrize(
    "text",
    ["[source]\nslot = ' '", "[runtime]\nbatch_events = 0", "[runtime]\nnothing = 1", "[[streams]]\nname = 'a'\ntables = ['x']", "[[streams]]\nname = 'a'\ntables = []",
     "[[sinks]]\nname = 's'\nstream = 'none'\nrules = [{table = 'a.b', key = '{id}'}]", "[[sinks]]\nname = 's'\nstream = 'all'\nrules = [{table = 'a.b', key = 'x'}]",
     "[[sinks]]\nname = 's'\nstream = 'all'\nrules = []", "not toml", "[source]\npassword = 'a'\npassword_env = 'b'", "[runtime]\ntransaction_bytes = 1\ntransaction_memory_bytes = 2"],
)
def test_bad_config(text):
    with pytest.raises(e.ConfigError):
        config.parse(text)


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "c.toml"
    path.write_text(GOOD.format(dir=tmp_path))
    filled(spark, tmp_path / "log")
    assert cli.main(["replay", str(path), "--from", "3", "--limit", "2"], spark) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [x["sequence"] for x in lines] == [3, 4] and lines[0]["after"] == {"id": "200"} and lines[0]["before"] is None
    assert cli.main(["inspect", str(path)], spark) == 0 and cli.main(["check", str(path)], spark) == 0
    assert cli.main(["inspect", str(path), "--sequence", "99"], spark) == 1
    assert cli.main(["backup", str(path), str(tmp_path / "b")], spark) == 0
    assert cli.main(["serve", str(path), "--limit", "2"], spark) == 0 and "tidemark_high_watermark 6" in capsys.readouterr().out
    assert cli.main(["replay", str(tmp_path / "none")], spark) == 10 and cli.main(["nonsense"], spark) == 2


def test_supervised_capture_by_command_line(spark, tmp_path):
    path = tmp_path / "c.toml"
    path.write_text(GOOD.format(dir=tmp_path).replace('[[streams]]', f'frames_dir = "{tmp_path}/frames"\n[[streams]]', 1))
    c = config.load(str(path))
    orders = h.relation(7, "public", "orders", ["id"])
    rows = h.frames([orders, h.insert(7, "1"), h.insert(7, "2")], [h.insert(7, "3")], source=c.source.name)
    spark.createDataFrame(rows, FRAMES).coalesce(1).write.parquet(c.runtime.frames_dir)
    assert cli.main(["capture", str(path)], spark) == 0
    got = cli.open_store(spark, c).log().orderBy("sequence").collect()
    assert [json.loads(r["after"])["id"] for r in got] == ["1", "2", "3"]


def test_what_may_pass():
    assert capturing.may_pass(Exception("java.net.ConnectException: refused")) and capturing.may_pass(Exception("x (SQLSTATE 57P01)"))
    assert not capturing.may_pass(Exception("tidemark.errors.DecodeError: ConnectException")) and not capturing.may_pass(e.DecodeError("ConnectException")) and not capturing.may_pass(Exception("else"))


def test_metrics(spark, tmp_path):
    m = Metrics(state=RuntimeState.CAPTURING)
    m.committed(2, 10, 100, 0.003)
    text = m.render(m.sample(filled(spark, tmp_path), wal_end=500))
    for line in ('tidemark_runtime_state{state="capturing"} 1', 'tidemark_commit_seconds_bucket{le="0.0025"} 0', 'tidemark_commit_seconds_bucket{le="0.005"} 1', "tidemark_retained_span 6", "tidemark_wal_lag_bytes 444"):
        assert line in text.splitlines()
    assert storage_ready(True, True, 1, 2, 3, 2) and not storage_ready(True, False, 1, 2, 3, 2) and not storage_ready(True, True, 2, 2, 3, 2)


def test_reports(tmp_path):
    r = Reporter(str(tmp_path / "r.jsonl"), capacity=2)
    assert r.report(1, 1)["events_per_commit"] == 0.0
    for _ in range(3):
        r.record(1, 5, 10, 0.002)
    line = r.report(2, 1)
    assert line["events_per_second"] == 10 and line["dropped_samples"] == 1 and line["persist_max_ms"] == 2.0
    assert len((tmp_path / "r.jsonl").read_text().splitlines()) == 2
