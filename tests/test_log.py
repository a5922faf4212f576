import json
import os
import random

import helpers as h
import pytest
from pyspark.sql import functions as F
from tidemark import errors as e
from tidemark import maintenance
from tidemark.model import CHANGE_EVENT
from tidemark.operators import capture, log_store, stats
from tidemark.operators.capture import BatchLimits, SegmentLimits
from tidemark.operators.log_store import ALREADY, PERSISTED, Limits, LogStore, Retention
from tidemark.operators.validate import check_resume


def store(spark, path, **limits):
    return LogStore(spark, str(path), limits=Limits(SegmentLimits(limits.pop("events", 10**6), limits.pop("bytes", 1 << 30), limits.pop("age", 10**9)), **limits), clock=lambda: 1000)


def sequences(s):
    return [r["sequence"] for r in s.log().orderBy("sequence").select("sequence").collect()]


def test_transactions_are_sequenced_in_commit_order(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.persist(h.captured(spark, [2, 3, 1]), "primary") == PERSISTED
    rows = s.log().orderBy("sequence").collect()
    assert [r["sequence"] for r in rows] == [1, 2, 3, 4, 5, 6]
    assert [r["event_id"].rsplit(":", 1)[1] for r in rows] == ["1", "2", "1", "2", "3", "1"]
    assert rows[0]["event_id"] == "postgres:shop:main:1:0/10:1" and len({r["event_id"] for r in rows}) == 6
    assert s.state().source_offsets == {"primary": "0/38"} and s.markers().count() == 3
    assert s.persist(h.captured(spark, [2], first=4), "primary") == PERSISTED and sequences(s)[-1] == 8


def test_nothing_is_visible_before_the_commit(spark, tmp_path):
    s = store(spark, tmp_path)

    def crash():
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        s.persist(h.captured(spark, [3]), "primary", before_commit=crash)
    again = store(spark, tmp_path)
    assert sequences(again) == [] and again.state().source_offsets == {}
    assert len(again.vacuum()) == 1
    assert again.persist(h.captured(spark, [3]), "primary") == PERSISTED and sequences(again) == [1, 2, 3]
    assert again.vacuum() == []


def test_replays(spark, tmp_path):
    s = store(spark, tmp_path)
    rows = h.captured(spark, [2, 2])
    s.persist(rows, "primary")
    assert s.persist(rows, "primary") == ALREADY
    s.checkpoint("primary", "0/1")  # the position is lost, the markers are not
    assert s.persist(rows, "primary", check_replay=True) == ALREADY and s.state().source_offsets["primary"] == "0/28"
    s.checkpoint("primary", "0/1")
    with pytest.raises(e.PartiallyPersisted) as x:
        s.persist(h.captured(spark, [2, 2, 1]), "primary", check_replay=True)
    assert (x.value.duplicates, x.value.events) == (4, 5) and sequences(s) == [1, 2, 3, 4]
    with pytest.raises(e.DuplicateMarker):
        s.persist(h.captured(spark, [2, 2, 1]), "primary")


def test_replays_are_found_in_older_segments(spark, tmp_path):
    s = store(spark, tmp_path, events=2)
    for i in range(1, 4):
        s.persist(h.captured(spark, [2], first=i), "primary")
    s.checkpoint("primary", "0/1")
    assert s.persist(h.captured(spark, [2, 2, 2]), "primary", check_replay=True) == ALREADY


def test_eventless_transactions_move_the_position_only(spark, tmp_path):
    s = store(spark, tmp_path)
    s.persist(h.captured(spark, [1, 0]), "primary")
    assert s.state().source_offsets == {"primary": "0/28"} and s.markers().count() == 1
    s.persist(h.captured(spark, [0], first=3), "primary")
    assert s.state().source_offsets == {"primary": "0/38"} and s.state().high_watermark == 1 and s.markers().count() == 1


def test_limits_persist_nothing(spark, tmp_path):
    with pytest.raises(e.EventLimitExceeded):
        store(spark, tmp_path / "a", transaction_events=2).persist(h.captured(spark, [1, 3]), "primary")
    assert store(spark, tmp_path / "b", transaction_events=3).persist(h.captured(spark, [1, 3]), "primary") == PERSISTED
    with pytest.raises(e.ByteLimitExceeded):
        store(spark, tmp_path / "c", transaction_bytes=5).persist(h.captured(spark, [1]), "primary")
    with pytest.raises(e.ResourceLimit):
        store(spark, tmp_path / "d", storage_bytes=5).persist(h.captured(spark, [1]), "primary")
    with pytest.raises(e.TidemarkError):
        store(spark, tmp_path / "e").persist(h.captured(spark, []), "primary")


def test_rotation_keeps_transactions_whole(spark, tmp_path):
    s = store(spark, tmp_path, events=2)
    for i, n in enumerate([1, 1, 1, 1, 1], 1):
        s.persist(h.captured(spark, [n], first=i), "primary")
    x = s.state().segments
    assert [y.event_count for y in x] == [2, 2, 1] and [y.sealed for y in x] == [True, True, False]
    s.persist(h.captured(spark, [7], first=6), "primary")
    assert [y.event_count for y in s.state().segments] == [2, 2, 1, 7, 0] and sequences(s) == list(range(1, 13))
    assert s.verify()["events"] == 12


def test_retention_by_count_bytes_and_age(spark, tmp_path):
    s = store(spark, tmp_path, events=1)
    for i in range(1, 11):
        s.persist(h.captured(spark, [1], first=i, ms=0), "primary")
    assert s.prune(Retention())["deleted_events"] == 0
    got = s.prune(Retention(max_events=3))
    assert (got["deleted_events"], got["first_retained"], got["high_watermark"]) == (7, 8, 10) and sequences(s) == [8, 9, 10]
    s.persist(h.captured(spark, [1], first=11, ms=0), "primary")
    assert sequences(s) == [8, 9, 10, 11]
    with pytest.raises(e.SequenceExpired) as x:
        s.replay(7)
    assert (x.value.requested, x.value.first_available) == (7, 8)
    with pytest.raises(e.SequenceExpired):
        s.recent(10)
    assert [r["sequence"] for r in s.recent(2).collect()] == [10, 11]
    assert s.prune(Retention(max_bytes=sum(x.stored_bytes for x in s.state().segments[1:])))["first_retained"] == 9
    assert s.prune(Retention(max_age_ms=100), now_ms=1100)["first_retained"] == 11  # times are 900, 1000, 1100
    assert s.prune(Retention(max_age_ms=1), now_ms=10**6)["first_retained"] == 12
    assert (s.state().high_watermark, s.state().next_sequence) == (11, 12) and sequences(s) == []
    assert len(s.vacuum()) == 11 and s.state().retention_floor == 12
    with pytest.raises(ValueError):
        s.prune(Retention(max_events=1, delete_batch=0))


def test_retention_delete_batch_takes_whole_segments(spark, tmp_path):
    s = store(spark, tmp_path, events=2)
    for i in range(1, 6):
        s.persist(h.captured(spark, [2], first=i), "primary")
    assert s.prune(Retention(max_events=1, delete_batch=3))["deleted_events"] == 4


def test_retain_sweeps_until_the_policy_is_met(spark, tmp_path):
    s = store(spark, tmp_path, events=2)
    for i in range(1, 6):
        s.persist(h.captured(spark, [2], first=i), "primary")
    got = s.retain(Retention(max_events=3, delete_batch=3))
    assert (got["deleted_segments"], got["deleted_events"], got["first_retained"], got["high_watermark"]) == (4, 8, 9, 10) and sequences(s) == [9, 10]
    assert got["deleted_markers"] == 4 and s.state().retention_floor == 9
    assert s.retain(Retention(max_events=0, delete_batch=2))["first_retained"] == 11 and s.retain(Retention())["deleted_events"] == 0


def test_files_of_a_commit_hold_ranges_without_a_sample(spark, tmp_path, monkeypatch):
    """Where files begin is known from the sequences: a sample for the ranges would make every row twice."""
    monkeypatch.setattr(log_store, "FILE_EVENTS", 4)
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.repartitionByRange", None)
    s = store(spark, tmp_path)
    s.persist(h.captured(spark, [3, 3, 3, 1]), "primary")
    s.persist(h.captured(spark, [5], first=5), "primary")
    files = s.log().withColumn("f", F.input_file_name()).groupBy("f").agg(F.min("sequence").alias("lo"), F.max("sequence").alias("hi"), F.count("*").alias("n")).collect()
    assert all(r["hi"] - r["lo"] + 1 == r["n"] <= 4 for r in files) and len(files) == 5 and sequences(s) == list(range(1, 16)) and s.verify()["events"] == 15


def test_bounded_replay(spark, tmp_path):
    s = store(spark, tmp_path, events=3)
    for i in range(1, 5):
        s.persist(h.captured(spark, [2], first=i), "primary")
    seq = lambda df: [r["sequence"] for r in df.collect()]
    assert seq(s.replay(3, 4)) == [3, 4, 5, 6] and seq(s.replay(3, 0)) == [] and seq(s.replay(9)) == []
    assert seq(s.replay(2, 10, max_bytes=1)) == [2]
    size = s.log().first()["payload_bytes"]
    assert seq(s.replay(2, 10, max_bytes=3 * size)) == [2, 3, 4]
    assert seq(s.replay(1, 2, stream=F.col("sequence") % 3 == 0)) == [3, 6]


def test_identity_binds_once(spark, tmp_path):
    s = store(spark, tmp_path)
    s.bind_identity("primary", "a", 1)
    s.bind_identity("primary", "a", 1)
    with pytest.raises(e.IdentityMismatch):
        s.bind_identity("primary", "b", 1)
    assert s.state().identities == {"primary": {"system_identifier": "a", "database_oid": 1}}


def test_resume_gap():
    check_resume(None, "0/1"), check_resume("0/1", None), check_resume("0/5", "0/5"), check_resume("0/6", "0/5")
    with pytest.raises(e.ResumeGap):
        check_resume("0/5", "0/6")


def test_racing_commits(spark, tmp_path):
    a, b = store(spark, tmp_path), store(spark, tmp_path)
    a.checkpoint("x", "0/1")
    b.checkpoint("y", "0/2")
    assert a.state().source_offsets == {"x": "0/1", "y": "0/2"} == LogStore(spark, str(tmp_path)).state().source_offsets


def test_snapshots_and_formats(spark, tmp_path):
    s = store(spark, tmp_path)
    for i in range(45):
        s.checkpoint("primary", f"0/{i:X}")
    assert sum(f.endswith(".snapshot") for f in os.listdir(tmp_path / "_commits")) == 2
    again = LogStore(spark, str(tmp_path))
    assert again.state() == s.state()
    last = tmp_path / "_commits" / f"{s.state().version + 1:020d}.json"
    last.write_text(json.dumps({"format_version": 99}))
    with pytest.raises(e.UnsupportedFormat):
        again.state()
    last.unlink()


def test_format_1_is_migrated(spark, tmp_path):
    s = store(spark, tmp_path)
    record = tmp_path / "_commits" / f"{s.state().version + 1:020d}.json"
    seg = {"id": 1, "created_ms": 5, "sealed": False, "files": [], "event_count": 0, "stored_bytes": 0, "first_sequence": None, "last_sequence": None, "first_timestamp_ms": None, "last_timestamp_ms": None}
    record.write_text(json.dumps({"version": s.state().version + 1, "format_version": 1, "high_watermark": 0, "retention_floor": 0, "segments": [seg], "removed": [], "source_offsets": {"p": "0/9"}, "consumer_offsets": {}}))
    assert s.state().source_offsets == {"p": "0/9"} and s.state().format_version == 2


def test_a_store_of_one_file_is_adopted(spark, tmp_path):
    old = store(spark, tmp_path / "old")
    old.persist(h.captured(spark, [2, 1, 3]), "primary")
    file = str(tmp_path / "events.parquet")
    old.log(3).select([f.name for f in CHANGE_EVENT.fields]).coalesce(1).write.parquet(file)
    events, offsets = spark.read.parquet(file), old.state().source_offsets

    s = store(spark, tmp_path / "new")
    for broken, match in (
        (events.filter("sequence <> 4"), "sequences are missing"), (events.union(events.filter("sequence = 4")), "sequences repeat"),
        (events.withColumn("event_id", F.lit("x")), "event ids repeat"), (events.withColumn("event_id", F.lit("")), "no id"), (events.drop("table"), "no column table"),
    ):
        with pytest.raises(e.IntegrityError, match=match):
            s.adopt(broken, offsets)
    with pytest.raises(e.IntegrityError, match="position of primary"):
        s.adopt(events, {"primary": "nowhere"})
    assert s.state().high_watermark == 0 and sequences(s) == []

    assert s.adopt(events, offsets) == 4
    state = s.state()
    assert sequences(s) == [3, 4, 5, 6] and [x.sealed for x in state.segments] == [True, False] and state.retention_floor == 3
    assert s.verify()["events"] == 4 and state.source_offsets == offsets
    with pytest.raises(e.SequenceExpired):
        s.replay(1)
    images = lambda x: sorted(map(str, x.log(3).select("sequence", "event_id", "key", "before", "after", "payload_bytes").collect()))
    assert images(s) == images(old)
    assert s.persist(h.captured(spark, [2, 1, 3]), "primary", check_replay=True) == ALREADY
    assert s.persist(h.captured(spark, [2], first=9), "primary") == PERSISTED and sequences(s) == [3, 4, 5, 6, 7, 8]
    assert s.verify()["events"] == 6 and len(s.vacuum()) == 4
    with pytest.raises(e.TidemarkError, match="empty log"):
        s.adopt(events, offsets)

    nothing = store(spark, tmp_path / "nothing")
    assert nothing.adopt(events.limit(0), offsets) == 0 and nothing.state().source_offsets == offsets


def test_damage_is_reported(spark, tmp_path):
    s = store(spark, tmp_path, events=2)
    for i in range(1, 4):
        s.persist(h.captured(spark, [2], first=i), "primary")
    s.verify()
    folder = tmp_path / "data" / s.state().segments[1].files[0]
    rows = spark.read.parquet(str(folder)).filter("sequence <> 3").toPandas()
    spark.createDataFrame(rows, spark.read.parquet(str(folder)).schema).write.mode("overwrite").parquet(str(folder))
    with pytest.raises(e.IntegrityError, match="segment 2: event count"):
        s.verify()


def test_backup_and_restore(spark, tmp_path):
    s = store(spark, tmp_path / "log", events=2)
    for i in range(1, 4):
        s.persist(h.captured(spark, [2], first=i), "primary")
    s.bind_identity("primary", "a", 1)
    maintenance.backup(s, str(tmp_path / "b"), "primary")
    with pytest.raises(e.TidemarkError):
        maintenance.backup(s, str(tmp_path / "b"), "primary")
    with pytest.raises(e.TidemarkError):
        maintenance.backup(s, str(tmp_path / "log" / "inside"), "primary")
    back = maintenance.restore(spark, str(tmp_path / "b"), str(tmp_path / "new"))
    assert sequences(back) == sequences(s) and back.state() == s.state()
    with pytest.raises(e.TidemarkError):
        maintenance.restore(spark, str(tmp_path / "b"), str(tmp_path / "new"))
    victim = next(p for p in (tmp_path / "b" / "log" / "data").rglob("*.parquet"))
    victim.chmod(0o644)
    victim.write_bytes(victim.read_bytes() + b"x")
    with pytest.raises(e.DataSafetyError):
        maintenance.restore(spark, str(tmp_path / "b"), str(tmp_path / "other"))
    assert not (tmp_path / "other").exists()


def batch_numbers(events, sizes, limits, times=None):
    """The batch of each transaction by the rules: it takes one at least; it ends before a limit is passed, when one is reached, and after its delay."""
    out, batch, n, e, b, began = [], 1, 0, 0, 0, 0
    for count, size, now in zip(events, sizes, times or [0] * len(events)):
        if n and (n + 1 > limits.transactions or e + count > limits.events or b + size > limits.bytes or (times and now - began >= limits.delay_ms)):
            batch, n, e, b = batch + 1, 0, 0, 0
        began = began if n else now
        n, e, b = n + 1, e + count, b + size
        out.append(batch)
        if n >= limits.transactions or e >= limits.events or b >= limits.bytes:
            batch, n, e, b = batch + 1, 0, 0, 0
    return out


def folded(spark, events, sizes, limits, times=None, width=1 << 18, f=capture.batches):
    column, order = ("event_count", "decoded_bytes", "o"), "o"
    if f is capture.segments:
        column = ("events", "bytes", "batch_id")
        order = "batch_id"
    rows = [("s", i * 3 + 5, e, b, t) for i, (e, b, t) in enumerate(zip(events, sizes, times or [0] * len(events)))]
    df = spark.createDataFrame(rows, f"src string, {order} long, {column[0]} long, {column[1]} long, t long").repartition(3)
    args = (df, "src", limits) if f is capture.segments else (df, "src", "o", limits)
    got = f(*args, time="t" if times else None, width=width)
    return [r[got.columns[-1]] for r in got.orderBy(order).collect()]


def test_batches(spark):
    b = lambda *a: folded(spark, *a)
    assert b([1] * 5, [1] * 5, BatchLimits(2, 100, 100)) == [1, 1, 2, 2, 3]
    assert b([3, 3, 9, 1], [1] * 4, BatchLimits(100, 5, 100)) == [1, 2, 3, 4]
    assert b([1, 1, 1], [60, 50, 40], BatchLimits(100, 100, 100)) == [1, 2, 2]
    assert b([1, 1], [100, 1], BatchLimits(100, 100, 100)) == [1, 2]
    assert b([], [], BatchLimits()) == []
    assert b([1] * 4, [1] * 4, BatchLimits(9, 99, 99, 10), [0, 9, 10, 25]) == [1, 1, 2, 3]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_batches_over_ranges_equal_the_rules(spark, seed):
    rng = random.Random(seed)
    n = 300
    events, sizes, times = [rng.randrange(1, 6) for _ in range(n)], [rng.randrange(50) for _ in range(n)], sorted(rng.randrange(900) for _ in range(n))
    for limits, t in ((BatchLimits(7, 12, 90, 15), times), (BatchLimits(5, 100, 10**6, 4), times), (BatchLimits(9, 9, 60), None)):
        want = batch_numbers(events, sizes, limits, t)
        for width in (1, 20, 1 << 18):
            assert folded(spark, events, sizes, limits, t, width) == want


def test_segments(spark):
    b = lambda *a: folded(spark, *a, f=capture.segments)
    assert b([2, 2, 2], [1] * 3, SegmentLimits(4, 100)) == [1, 1, 2]
    assert b([3, 3], [1] * 2, SegmentLimits(4, 100)) == [1, 2]
    assert b([9, 1], [1] * 2, SegmentLimits(4, 100)) == [1, 2]
    assert b([1, 1, 1], [1] * 3, SegmentLimits(100, 100, 10), [0, 5, 20]) == [1, 1, 2]
    assert folded(spark, [1] * 50, [3] * 50, SegmentLimits(7, 100, 5), list(range(50)), 9, capture.segments) == [i // 5 + 1 for i in range(50)]


def test_running_sums_over_many_ranges(spark):
    df = spark.range(1, 500).selectExpr("id * 7 as pos", "id % 5 as v", "id % 2 as g")
    got = {r["pos"]: r["s"] for r in capture.running_before(df, ["g"], "pos", "v", "s", width=100).collect()}
    sums = {0: 0, 1: 0}
    for i in range(1, 500):
        assert got[i * 7] == sums[i % 2]
        sums[i % 2] += i % 5


def test_retention_catalog_stops_at_the_first_that_stays(spark):
    rows = [(1, 10, 100, 1, 10, 10, 5, 5), (2, 10, 100, 11, 20, 20, None, None), (3, 10, 100, 21, 30, 30, 6, 6), (4, 10, 100, 31, 40, 40, 7, 7)]
    c = spark.createDataFrame(rows, "segment_id long, event_count long, stored_bytes long, first_sequence long, last_sequence long, high_watermark long, first_timestamp_ms long, last_timestamp_ms long")
    ids = lambda **k: sorted(r["segment_id"] for r in stats.retention_candidates(c, **k).collect())
    assert ids(max_age_ms=1, now_ms=1000) == [1] and ids(max_events=20) == [1, 2] and ids(max_bytes=100) == [1, 2, 3] and ids() == [] and ids(max_events=0, delete_batch=15) == [1, 2]
    assert stats.retention_outcome(c, stats.retention_candidates(c, max_events=20)).first().asDict() == {"deleted_segments": 2, "deleted_events": 20, "deleted_bytes": 200, "first_retained": 21, "high_watermark": 40}
