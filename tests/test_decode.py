import json
import random
import struct

import helpers as h
import pytest
from tidemark.errors import DecodeError, StreamStateError
from tidemark.plans import CapturePlan, Stream
from tidemark.sources import derived
from tidemark.sources.pgoutput import FRAMES, HEARTBEAT_PREFIX, Decoder, TransactionReader, decode_frames, unix_ms

ALL = CapturePlan.of("primary", [Stream("all", "primary", ("*",))])
ORDERS = h.relation(7, "public", "orders", ["status", "id"])


def decoder():
    d = Decoder()
    d.decode(ORDERS)
    return d


def test_row_images():
    d = decoder()
    (c,) = d.decode(h.insert(7, None, "1"))
    assert (c.operation, c.schema, c.table, c.key, c.before, c.after) == ("insert", "public", "orders", None, None, '{"id":"1","status":null}')
    (c,) = d.decode(h.insert(7, ..., b"\x00\xff"))
    assert json.loads(c.after) == {"status": {"__unchanged_toast": True}, "id": {"__binary_hex": "00ff"}}
    (c,) = d.decode(h.update(7, ["paid", "1"], old=["new", "1"]))
    assert c.key is None and json.loads(c.before)["status"] == "new" and json.loads(c.after)["status"] == "paid"
    (c,) = d.decode(h.update(7, ["paid", "2"], key=[None, "1"]))
    assert c.before is None and json.loads(c.key)["id"] == "1"
    (c,) = d.decode(h.update(7, ["paid", "2"]))
    assert c.key is None and c.before is None
    (c,) = d.decode(h.delete(7, key=[None, "1"]))
    assert c.after is None and c.before is None and c.key
    (c,) = d.decode(h.delete(7, old=["x", "1"]))
    assert c.key is None and c.before


def test_relations_are_replaced():
    d = decoder()
    d.decode(h.relation(7, "public", "orders", ["status", "id", "priority"]))
    (c,) = d.decode(h.insert(7, "a", "1", "high"))
    assert json.loads(c.after)["priority"] == "high"


def test_truncate_names_each_relation():
    d = decoder()
    d.decode(h.relation(8, "public", "items", ["id"]))
    assert [c.table for c in d.decode(h.truncate(7, 8))] == ["orders", "items"]


@pytest.mark.parametrize(
    "payload",
    [b"Z", h.insert(9, "a"), h.insert(7, "a"), b"I" + struct.pack(">I", 7) + b"X", b"I" + struct.pack(">I", 7) + b"N" + struct.pack(">H", 2) + b"q", ORDERS[:-3],
     b"I\0\0", b"D" + struct.pack(">I", 7) + b"N", b"I" + struct.pack(">I", 7) + b"N" + struct.pack(">H", 2) + b"t" + struct.pack(">i", 2) + b"\xff\xfe" + b"n"],
)
def test_malformed(payload):
    with pytest.raises(DecodeError):
        decoder().decode(payload)


def test_origins_and_types_are_passed_over():
    assert decoder().decode(b"Oanything") == [] == decoder().decode(b"Y")


def read(plan, rows):
    names, out, reader = [x.split()[0] for x in FRAMES.split(", ")], [], TransactionReader("primary", plan)
    for r in rows:
        out += reader.feed(dict(zip(names, r)))
    return out, reader


def test_transactions_and_filter():
    plan = CapturePlan.of("primary", [Stream("o", "primary", ("public.orders",))])
    other = h.relation(8, "public", "other", ["id"])
    out, reader = read(plan, h.frames([ORDERS, other, h.insert(8, "1"), h.insert(7, "a", "1"), h.insert(7, "b", "2")], [h.insert(8, "2")]))
    assert [r.get("operation") for r in out] == ["insert", "insert", None]
    assert out[0]["xid"] == 700 and out[0]["end_lsn"] == f"0/{1950:X}" and out[0]["commit_lsn"] == f"0/{1900:X}"
    assert out[0]["wal_start"] == out[1]["wal_start"] and out[0]["wal_pos"] < out[1]["wal_pos"]
    assert reader.begin is None


def test_uncommitted_rows_stay_out():
    out, reader = read(ALL, h.frames([ORDERS, h.insert(7, "a", "1")])[:-1])
    assert out == [] and len(reader.rows) == 1


def test_state_errors():
    begin, commit = h.frames([])[0], h.frames([])[1]
    for rows in ([begin, begin], [commit], [h.frames([ORDERS, h.insert(7, "a", "1")])[1], h.frames([ORDERS, h.insert(7, "a", "1")])[2]]):
        with pytest.raises(StreamStateError):
            read(ALL, rows)


def test_heartbeats_move_the_position_and_foreign_messages_fail():
    out, _ = read(ALL, h.frames([HEARTBEAT_PREFIX]))
    assert [r.get("operation") for r in out] == [None] and out[0]["end_lsn"]
    with pytest.raises(StreamStateError):
        read(ALL, h.frames(["someone.else"]))


def test_keepalives_are_no_checkpoint():
    out, reader = read(ALL, [("primary", 0, "keepalive", 500, None, None, None, None, None, None)])
    assert out == [] and reader.latest_wal_end == 500


def test_clock():
    assert unix_ms(-1999) == unix_ms(0) - 1


def test_decode_in_spark_by_source(spark):
    rows = h.frames([ORDERS, h.insert(7, "a", "1")], [h.update(7, ["b", "1"], old=["a", "1"]), h.delete(7, old=["b", "1"])]) + h.frames([h.relation(7, "s", "t", ["x"]), h.insert(7, "q")], source="second")
    got = decode_frames(spark.createDataFrame(rows, FRAMES).repartition(5), ALL).orderBy("source_name", "wal_pos").collect()
    assert [(r["source_name"], r["table"], r["operation"]) for r in got] == [("primary", "orders", "insert"), ("primary", "orders", "update"), ("primary", "orders", "delete"), ("second", "t", "insert")]


@pytest.mark.parametrize("width", [1, 3, 7, 1 << 16])
def test_ranges_decode_like_one_reader(spark, width):
    """Relations that change, transactions over several ranges, empty and unfinished ones."""
    rng, transactions = random.Random(width), []
    plan = CapturePlan.of("primary", [Stream("o", "primary", ("public.orders",))])
    for i in range(40):
        payloads = [ORDERS, h.relation(8, "public", "other", ["id"])] if i % 9 == 0 else [h.relation(7, "public", "orders", ["id", "status"])] if i % 9 == 4 else []
        for _ in range(rng.choice([0, 1, 2, 12])):
            payloads.append(rng.choice([h.insert(7, f"a{i}", str(i)), h.insert(8, "x"), h.truncate(7, 8), h.update(7, ["b", ...], key=[None, "1"]), HEARTBEAT_PREFIX]))
        transactions.append(payloads)
    rows = h.frames(*transactions)
    rows += [("primary", len(rows), "keepalive", 9, None, None, None, None, None, None)] + h.frames([h.insert(7, "z", "9")], start=len(rows) + 1)[:-1]
    want, _ = read(plan, rows)
    got = decode_frames(spark.createDataFrame(rows, FRAMES).repartition(5), plan, width).orderBy("wal_pos").collect()
    assert [r.asDict() for r in got] == [{f: r.get(f) for f in got[0].asDict()} for r in want]


def test_images_have_names_in_order_and_the_last_of_equal_ones():
    d = Decoder()
    d.decode(h.relation(7, "public", "t", ["b", 'a"', "b", "é"]))
    assert d.decode(h.insert(7, "1", "x\n\x01\u2028", b"\x00\xff", None))[0].after == json.dumps({'a"': "x\n\x01\u2028", "b": {"__binary_hex": "00ff"}, "é": None}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    with pytest.raises(DecodeError):
        d.decode(h.insert(7, "1", "2", "3", "4")[:-3])


def test_derived_frames_parse_a_row_once(spark, tmp_path):
    """A field of an image is made once, not once for each use of it; decoding brings no second shuffle of the frames."""
    spark.sql("select 0L as event_id, timestamp'2024-01-01' as ts, 5L as user_id, 'view' as event_type, '{}' as props").write.parquet(str(tmp_path / "events.parquet"))
    made = derived.event_frames(spark, str(tmp_path))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(made).count("get_json_object") <= 2
    joins = [line for line in plan(decode_frames(spark.createDataFrame([], FRAMES), ALL)).splitlines() if "LeftOuter" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins)
    rows = decode_frames(made, ALL).collect()
    assert [(r["before"], r["after"]) for r in rows] == [('{"id":"5","k":null,"status":"old"}', '{"id":"5","k":null,"status":"view"}')]


def test_state_errors_in_spark(spark):
    begin, commit = h.frames([])
    lone = h.frames([ORDERS, h.insert(7, "a", "1")])[1:3]
    later = lambda f, pos: (f[0], pos, *f[2:])
    for rows, text in (([begin, later(begin, 5)], "inside another"), ([commit], "without a begin"), (lone, "outside of a transaction")):
        with pytest.raises(Exception, match=text):
            decode_frames(spark.createDataFrame(rows, FRAMES), ALL, 2).collect()


def test_frame_source_offsets_and_acknowledgement(tmp_path):
    from tidemark.sources.frames import FrameReader, write_frames

    path, rows = str(tmp_path / "f"), h.frames([ORDERS, h.insert(7, "a", "1")], [h.insert(7, "b", "2")])
    write_frames(path, "a", rows[:4])
    reader = FrameReader(path)
    start, end = reader.initialOffset(), reader.latestOffset()
    got = [x for p in reader.partitions(start, end) for x in reader.read(p)]
    assert [x[1] for x in got] == [0, 1, 2, 3] and got[1][4] == ORDERS and reader.partitions(end, end) == []
    write_frames(path, "b", rows[4:])
    more = [x[1] for p in reader.partitions(end, reader.latestOffset()) for x in reader.read(p)]
    assert more == [4, 5, 6]
    paced = FrameReader(path, 3)
    assert paced.latestOffset() == {"next": 4}  # a file at least
    assert len(paced.partitions({"next": 0}, {"next": 4})) == 1 and paced.latestOffset() == {"next": 7} == FrameReader(path, 3).latestOffset()
    write_frames(path, "none", [])
    reader.commit(end)
    assert (tmp_path / "f" / "acknowledged").read_text() == "4"
