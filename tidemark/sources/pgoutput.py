"""Logical replication frames to captured rows.

A frame's payload is a tagged message: relations (R), which later rows refer to by number,
inserts, updates, deletes and truncates; origins (O) and types (Y) are passed over. Rows
between a begin and a commit frame are one transaction. Decoding a row depends on its
transaction and on the relations before it, and on nothing else: in a batch, ranges of
positions are decoded side by side, each with the relations known where it begins and with
its transactions whole; in a stream the relations and the open transaction are state.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from json.encoder import encode_basestring

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import lsn
from ..errors import DecodeError, StreamStateError
from ..functions import EPOCH_2000_MS
from ..model import CAPTURED
from ..operators.capture import running_before
from ..plans import CapturePlan

FRAMES = "source_name string, pos long, event string, wal_start long, payload binary, xid long, final_lsn long, end_lsn long, commit_micros long, prefix string"
FIELDS = [x.split()[0] for x in FRAMES.split(", ")]
#: Messages with this prefix only move the checkpoint on.
HEARTBEAT_PREFIX = "tidemark.heartbeat"


class Reader:
    """Big-endian fields of a message."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise DecodeError("a message ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, code: str) -> int:
        """A byte (B), a half word (H) or a word (I; i with a sign)."""
        return int.from_bytes(self.take({"B": 1, "H": 2}.get(code, 4)), "big", signed=code == "i")

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise DecodeError("a string has no end")
        out = self.take(end - self.at)
        self.at += 1
        return self._utf8(out)

    def _utf8(self, raw: bytes) -> str:
        try:
            return raw.decode()
        except UnicodeDecodeError as e:
            raise DecodeError("a string is not UTF-8") from e


@dataclass
class Column:
    flags: int
    name: str
    type_oid: int
    type_modifier: int


@dataclass
class Relation:
    id: int
    schema: str
    table: str
    identity: int
    columns: list[Column]

    @cached_property
    def layout(self) -> list[tuple[str, int]]:
        """What stands before each value of a row image, and which column it is: names in order, of equal ones the last."""
        of = {c.name: i for i, c in enumerate(self.columns)}
        return [(("," if k else "{") + encode_basestring(n) + ":", of[n]) for k, n in enumerate(sorted(of))]


@dataclass
class Change:
    operation: str
    schema: str
    table: str
    key: str | None = None
    before: str | None = None
    after: str | None = None


def render_tuples(rows: DataFrame, key: str, value: str, names: list[str], out: str) -> DataFrame:
    """Tuples of columns by these names, as they come in messages, to row images: (key, out). Rows keep their places, nothing is shuffled."""
    of = Relation(0, "", "", 0, [Column(0, n, 25, -1) for n in names])

    def render(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({key: part[key], out: [Decoder()._tuple(Reader(bytes(x)), of) for x in part[value]]})

    return rows.select(key, value).mapInPandas(render, f"{key} {rows.schema[key].dataType.simpleString()}, {out} string")


@dataclass
class Decoder:
    relations: dict[int, Relation] = field(default_factory=dict)

    def decode(self, payload: bytes) -> list[Change]:
        r = Reader(payload)
        tag = chr(r.number("B"))
        if tag in "OY":
            return []
        if tag == "I":
            return self._insert(r)
        if tag == "U":
            return self._update(r)
        if tag == "D":
            return self._delete(r)
        if tag == "R":
            return self._relation(r)
        if tag == "T":
            return self._truncate(r)
        raise DecodeError(f"unsupported message {tag!r}")

    def _relation(self, r: Reader) -> list[Change]:
        number, schema, table, identity = r.number("I"), r.text(), r.text(), r.number("B")
        columns = [Column(r.number("B"), r.text(), r.number("I"), r.number("i")) for _ in range(r.number("H"))]
        self.relations[number] = Relation(number, schema, table, identity, columns)
        return []

    def _of(self, r: Reader) -> Relation:
        number = r.number("I")
        if number not in self.relations:
            raise DecodeError(f"relation {number} is unknown")
        return self.relations[number]

    def _insert(self, r: Reader) -> list[Change]:
        rel = self._of(r)
        self._expect(r, "N")
        return [Change("insert", rel.schema, rel.table, after=self._tuple(r, rel))]

    def _update(self, r: Reader) -> list[Change]:
        rel = self._of(r)
        out, kind = Change("update", rel.schema, rel.table), chr(r.number("B"))
        if kind in "KO":
            image = self._tuple(r, rel)
            out.key, out.before = (image, None) if kind == "K" else (None, image)
            kind = chr(r.number("B"))
        if kind != "N":
            raise DecodeError(f"unexpected tuple {kind!r}")
        out.after = self._tuple(r, rel)
        return [out]

    def _delete(self, r: Reader) -> list[Change]:
        rel, kind = self._of(r), chr(r.number("B"))
        if kind not in "KO":
            raise DecodeError(f"unexpected tuple {kind!r}")
        image = self._tuple(r, rel)
        return [Change("delete", rel.schema, rel.table, key=image if kind == "K" else None, before=image if kind == "O" else None)]

    def _truncate(self, r: Reader) -> list[Change]:
        n, _ = r.number("I"), r.number("B")
        return [Change("truncate", rel.schema, rel.table) for rel in [self._of(r) for _ in range(n)]]

    def _expect(self, r: Reader, tag: str) -> None:
        if (got := chr(r.number("B"))) != tag:
            raise DecodeError(f"expected {tag!r}, found {got!r}")

    def _tuple(self, r: Reader, rel: Relation) -> str:
        n = r.number("H")
        if n != len(rel.columns):
            raise DecodeError(f"{rel.schema}.{rel.table} has {len(rel.columns)} columns, the row {n}")
        # One loop over the bytes: a tuple is what most of the log's bytes are.
        data, at, end, values = r.data, r.at, len(r.data), []
        for _ in range(n):
            if at >= end:
                raise DecodeError("a message ends early")
            kind = data[at]
            at += 1
            if kind == _TEXT or kind == _BINARY:
                stop = at + 4 + int.from_bytes(data[at : at + 4], "big", signed=True)
                if not at + 4 <= stop <= end:
                    raise DecodeError("a message ends early")
                raw, at = data[at + 4 : stop], stop
                values.append(encode_basestring(r._utf8(raw)) if kind == _TEXT else f'{{"__binary_hex":"{raw.hex()}"}}')
            elif kind == _NULL:
                values.append("null")
            elif kind == _UNCHANGED:
                values.append('{"__unchanged_toast":true}')
            else:
                raise DecodeError(f"unsupported value {chr(kind)!r}")
        r.at = at
        return "".join([before + values[i] for before, i in rel.layout]) + "}" if n else "{}"


_TEXT, _BINARY, _NULL, _UNCHANGED = b"tbnu"


def unix_ms(micros: int) -> int:
    """Truncates toward zero."""
    return EPOCH_2000_MS + (abs(micros) // 1000) * (1 if micros >= 0 else -1)


@dataclass
class TransactionReader:
    """Frames to captured rows; a transaction's rows come out with its commit.

    A transaction of which the plan keeps nothing comes out as one row without an operation: it moves the checkpoint.
    """

    source_name: str
    plan: CapturePlan
    decoder: Decoder = field(default_factory=Decoder)
    begin: dict | None = None
    rows: list[dict] = field(default_factory=list)
    #: The farthest position seen; never a checkpoint.
    latest_wal_end: int = 0
    #: Whether the plan keeps a table.
    kept: dict = field(default_factory=dict)

    def feed(self, frame: dict) -> list[dict]:
        event = frame["event"]
        if event == "keepalive":
            self.latest_wal_end = max(self.latest_wal_end, int(frame["wal_start"] or 0))
            return []
        if event == "message":
            if frame["prefix"] != HEARTBEAT_PREFIX:
                raise StreamStateError(f"a message with the prefix {frame['prefix']!r} belongs to something else")
            return []
        if event == "begin":
            if self.begin is not None:
                raise StreamStateError("a transaction begins inside another")
            self.begin, self.rows = frame, []
            return []
        if event == "data":
            self.data(int(frame["pos"]), frame["wal_start"], bytes(frame["payload"]))
            return []
        if event != "commit":
            raise StreamStateError(f"unknown frame {event!r}")
        if self.begin is None:
            raise StreamStateError("a commit comes without a begin")
        of = {
            "source_name": self.source_name, "xid": int(self.begin["xid"]), "commit_lsn": lsn.text(int(self.begin["final_lsn"])),
            "end_lsn": lsn.text(int(frame["end_lsn"])), "commit_timestamp_ms": unix_ms(int(self.begin["commit_micros"])),
        }
        empty = [{"wal_pos": int(frame["pos"]) * 1_000_000, "wal_start": lsn.text(int(frame["wal_start"] or 0))}]
        out = [{**of, **row} for row in self.rows or empty]
        self.begin, self.rows = None, []
        return out

    def data(self, pos: int, wal_start: int, payload: bytes) -> None:
        changes = self.decoder.decode(payload)
        if changes and self.begin is None:
            raise StreamStateError("a row comes outside of a transaction")
        for c in changes:
            name = (c.schema, c.table)
            if name not in self.kept:
                self.kept[name] = self.plan.matches(*name)
            if self.kept[name]:
                self.rows.append({"wal_pos": pos * 1_000_000 + len(self.rows), "wal_start": lsn.text(int(wal_start)), **vars(c)})


def _frame(rows: list[dict]) -> pd.DataFrame:
    names = [f.name for f in CAPTURED.fields]
    out = pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names}, columns=names)
    for n in ("wal_pos", "xid", "commit_timestamp_ms"):
        out[n] = out[n].astype("Int64")
    return out


#: Positions of a range that is decoded by one task.
WIDTH = 1 << 16


def _grouped(frames: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Frames with the range in which their transaction begins (__g), and for each range the relations known in it.

    Only begins and commits are numbered, by two-level sums; frames that come into a range within a transaction go back to its first range.
    """
    marks = frames.filter("event in ('begin', 'commit')").select("source_name", "pos", "event", F.expr("if(event = 'begin', 4294967296L, 1L)").alias("__code"))
    marks = running_before(marks, ["source_name"], "pos", "__code", "__before", width)
    begins, commits, wrong = F.expr("shiftright(__before, 32)"), F.expr("__before & 4294967295L"), lambda text: F.raise_error(F.lit(text)).cast("long")
    number = F.when(F.col("event") == "begin", F.when(begins == commits, begins).otherwise(wrong("a transaction begins inside another")))
    marks = marks.withColumn("n", number.otherwise(F.when(begins == commits + 1, commits).otherwise(wrong("a commit comes without a begin"))))
    spans = marks.groupBy("source_name", "n").agg(F.min(F.expr("if(event = 'begin', pos, null)")).alias("begin"), F.max(F.expr("if(event = 'commit', pos, null)")).alias("commit"))
    last = F.broadcast(frames.groupBy("source_name").agg(F.max("pos").alias("last")))  # a row for each source
    spans = spans.join(last, "source_name").select("source_name", F.expr(f"begin div {width}").alias("__from"), F.coalesce("commit", "last").alias("__until"))
    # One row for each range that begins within a transaction.
    inside = spans.filter(f"__until div {width} > __from").withColumn("__r", F.explode(F.expr(f"sequence(__from + 1, __until div {width})")))
    placed = frames.withColumn("__r", F.expr(f"pos div {width}")).join(F.broadcast(inside), ["source_name", "__r"], "left").withColumn("__g", F.expr("if(pos <= __until, __from, __r)"))
    known = frames.filter("event = 'data' and substring(payload, 1, 1) = X'52'").select("source_name", "pos", "payload", F.hex(F.substring("payload", 2, 4)).alias("id"))
    known = known.withColumn("next", F.lead("pos").over(Window.partitionBy("source_name", "id").orderBy("pos"))).join(last, "source_name")
    known = known.withColumn("__g", F.explode(F.expr(f"sequence(pos div {width}, coalesce(next, last) div {width})"))).select(*[F.col(c).alias(c) for c in ("source_name", "__g", "pos", "payload")])  # names of their own
    return placed.select("__g", *frames.columns), known


def _feed(reader: TransactionReader, rows: list[tuple], relations: list[tuple[int, bytes]] = ()) -> list[dict]:
    """What frames, sorted by position, bring; relations known beforehand are read before the frames behind them. Only frames that are no data become dictionaries."""
    out, at = [], 0
    for row in rows:
        while at < len(relations) and relations[at][0] < row[_POS]:
            reader.decoder.decode(relations[at][1])
            at += 1
        if row[_EVENT] == "data":
            reader.data(row[_POS], row[_WAL], bytes(row[_PAYLOAD]))
        else:
            out += reader.feed(dict(zip(FIELDS, row)))
    return out


_POS, _EVENT, _WAL, _PAYLOAD = (FIELDS.index(c) for c in ("pos", "event", "wal_start", "payload"))


def decode_frames(frames: DataFrame, plan: CapturePlan, width: int = WIDTH) -> DataFrame:
    """Frames of whole sources to captured rows; an unfinished transaction stays out. A transaction is decoded by one task."""
    types = {"string": pa.string(), "bigint": pa.int64()}
    schema = pa.schema([pa.field(f.name, types[f.dataType.simpleString()], f.nullable) for f in CAPTURED.fields])

    def fold(rows: pa.Table, known: pa.Table) -> pa.Table:
        out: list[dict] = []
        if rows.num_rows:
            listed = sorted(zip(*[rows[c].to_pylist() for c in FIELDS]), key=lambda x: x[_POS])
            out = _feed(TransactionReader(listed[0][0], plan), listed, sorted(zip(known["pos"].to_pylist(), known["payload"].to_pylist())))
        return pa.table([pa.array([r.get(f.name) for r in out], f.type) for f in schema], schema=schema)

    placed, known = _grouped(frames, width)
    return placed.groupBy("source_name", "__g").cogroup(known.groupBy("source_name", "__g")).applyInArrow(fold, CAPTURED)


def decode_stream(frames: DataFrame, plan: CapturePlan) -> DataFrame:
    """The same over a stream: relations and the open transaction are state, so a restart goes on where it was."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        reader = pickle.loads(state.get[0]) if state.exists else TransactionReader(key[0], plan)
        rows = pd.concat(list(parts))[FIELDS].sort_values("pos")
        out = _feed(reader, list(zip(*[rows[c].tolist() for c in FIELDS])))
        state.update((pickle.dumps(reader),))
        yield _frame(out)

    return frames.groupBy("source_name").applyInPandasWithState(fold, CAPTURED, "state binary", "append", "NoTimeout")
