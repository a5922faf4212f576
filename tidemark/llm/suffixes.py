"""Suffix-array dedup of bytes with a logarithmic index family (see windows.py for the stages).

Within a bucket, packed strings come in batches by their smallest document. A batch gets
a suffix array: the starts of its windows in its text, in the order of the bytes that
follow, to the window's length. It is merge-scanned against the existing levels: a window
found there started in an earlier document, and windows found one after another are a
long match. New windows become a level of their own (their text, their places in it and
the first document of each), and levels of about equal size merge, so that each window is
merged a logarithmic number of times and a scan meets a logarithmic number of levels.
Scans and merges hold BLOCK windows of a level at a time; a level itself holds 13 bytes
for each window.

dedup() makes a family for each bucket of what the table's documents share. Index keeps
families in a folder, a table for each level, with all windows of all documents, so that
batches can come later: add() removes from a batch what it or an earlier batch has
already, and merges levels of equal size.

Cases: a null text counts as empty; texts under 50 bytes have no window; very long texts
are taken whole; a null id counts as larger than all others; rows that share an id do not
remove each other's bytes, unless they come in different batches; repeated rows have
equal results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buffers, windows
from .common import cut

WINDOW, GRAM = 50, 20
#: Windows of a batch, and windows of a level that a scan or merge holds at once.
BATCH, BLOCK = 1 << 16, 1 << 15


class Level:
    """A suffix array of distinct windows: a text, their starts in it in the order of the bytes that follow, and the first document of each."""

    def __init__(self, text: np.ndarray, at: np.ndarray, first: np.ndarray, window: int):
        self.text, self.at, self.first, self.window = text, at, first, window
        self.ends = self.keys(np.append(np.arange(BLOCK - 1, len(at), BLOCK), len(at) - 1)) if len(at) else np.empty(0, f"S{window}")

    def __len__(self) -> int:
        return len(self.at)

    def keys(self, which) -> np.ndarray:
        views = np.lib.stride_tricks.sliding_window_view(self.text, self.window)
        return np.ascontiguousarray(views[self.at[which]]).view(f"S{self.window}").ravel()

    def upto(self, key: bytes) -> int:
        """How many windows are not larger."""
        block = int(np.searchsorted(self.ends, key, "left"))
        lo = min(block * BLOCK, len(self))
        return lo + int(np.searchsorted(self.keys(slice(lo, lo + BLOCK)), key, "right")) if lo < len(self) else lo

    def scan(self, keys: np.ndarray) -> np.ndarray:
        """keys: sorted and distinct. The first document of each, or windows.LAST, by merging blocks of the level with the keys between their ends."""
        out, begin = np.full(len(keys), windows.LAST), 0
        for k in range(-(-len(self) // BLOCK)):
            end = int(np.searchsorted(keys, self.ends[k], "right"))
            if begin < end:
                block = self.keys(slice(k * BLOCK, (k + 1) * BLOCK))
                both = np.concatenate([block, keys[begin:end]])
                order = np.argsort(both, kind="stable")  # two sorted runs: a merge
                here = np.flatnonzero(both[order][1:] == both[order][:-1])
                out[begin + order[here + 1] - len(block)] = self.first[k * BLOCK + order[here]]
            begin = end
        return out

    def merged(self, other: Level) -> Level:
        """Both in one, block by block. No window is in both."""
        at, first, begin = [], [], 0
        for lo in range(0, len(self), BLOCK):
            hi = min(lo + BLOCK, len(self))
            end = len(other) if hi == len(self) else max(begin, other.upto(self.ends[lo // BLOCK]))
            keys = np.concatenate([self.keys(slice(lo, hi)), other.keys(slice(begin, end))])
            order = np.argsort(keys, kind="stable")
            at.append(np.concatenate([self.at[lo:hi], other.at[begin:end] + len(self.text)])[order])
            first.append(np.concatenate([self.first[lo:hi], other.first[begin:end]])[order])
            begin = end
        return Level(np.concatenate([self.text, other.text]), np.concatenate(at), np.concatenate(first), self.window) if len(self) else other

    def packed(self) -> bytes:
        return buffers.packed(self.text, self.at, self.first)

    @classmethod
    def unpacked(cls, blob: bytes, window: int) -> Level:
        return cls(*buffers.unpacked(blob, np.uint8, np.int64, np.int64), window)


class Family:
    """Levels of geometrically growing size, the smallest last."""

    def __init__(self, levels: list[Level] | None = None):
        self.levels = sorted(levels or [], key=len, reverse=True)

    def scan(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), windows.LAST)
        for level in self.levels:
            out = np.minimum(out, level.scan(keys))
        return out

    def add(self, level: Level) -> None:
        while self.levels and len(self.levels[-1]) <= 2 * len(level):
            level = self.levels.pop().merged(level)
        if len(level):
            self.levels.append(level)


def add_batch(family: Family, strings: list[bytes], n: np.ndarray, least: np.ndarray, window: int) -> np.ndarray:
    """The smallest id of each window of a batch, which joins the family."""
    text = np.frombuffer(b"".join(strings), np.uint8)
    first, ends = np.concatenate([[0], np.cumsum(n + window - 1)[:-1]]), np.cumsum(n)
    at = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(first, n)
    views = np.lib.stride_tricks.sliding_window_view(text, window)
    keys = np.ascontiguousarray(views[at]).view(f"S{window}").ravel()
    suffixes = np.argsort(keys, kind="stable")
    keys = keys[suffixes]
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    heads = np.flatnonzero(head)
    here = np.minimum.reduceat(np.repeat(least, n)[suffixes], heads)
    before = family.scan(keys[heads])
    low = np.empty(len(head), np.int64)
    low[suffixes] = np.minimum(here, before)[np.cumsum(head) - 1]
    new = before == windows.LAST
    family.add(Level(text, at[suffixes[heads[new]]], here[new], window))
    return low


def family_windows(strings: list[bytes], n: np.ndarray, least: np.ndarray, window: int, family: Family | None = None) -> list[np.ndarray]:
    """The smallest id of each window of each string, in batches of whole strings by their smallest id."""
    out: list[np.ndarray] = [None] * len(strings)  # type: ignore[list-item]
    order = np.argsort(least, kind="stable")
    family, upto = family or Family(), np.cumsum(n[order])
    begin = 0
    while begin < len(order):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + BATCH, "right")))
        part = order[begin:end]
        low = add_batch(family, [strings[i] for i in part], n[part], least[part], window)
        for i, x in zip(part, np.split(low, np.cumsum(n[part])[:-1])):
            out[i] = x
        begin = end
    return out


def _plan(buckets: int, asks: int = 8, window: int = WINDOW, gram: int = GRAM) -> windows.Plan:
    return windows.Plan(windows.byte_units, window, gram, family_windows, buckets, asks)


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Columns: doc_id, n_units, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    return windows.shared(docs, lambda buckets, asks: _plan(buckets, asks, window, gram))


#: The id that windows of earlier batches count with.
EARLIER = -(2**63)
_FOUND = pa.schema([("bucket", pa.int32()), ("pid", pa.int32()), ("blob", pa.binary())])


def _grow(plan: windows.Plan) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A bucket's new strings against its levels: hits by pack, and the new windows as a level (pid -1)."""

    def run(sent: pa.Table, levels: pa.Table) -> pa.Table:
        if not sent.num_rows:
            return _FOUND.empty_table()
        bucket, b = sent.column("bucket")[0].as_py(), windows.bucket_of(sent)
        known = [Level.unpacked(x, plan.window) for x in levels.column("level").to_pylist()]
        for level in known:
            level.first = np.full(len(level), EARLIER)
        family = Family(known)
        held = {id(x) for x in known}
        # Known levels are only scanned here; merging them is a step of its own.
        family.add = lambda level: _add_new(family, level, held)  # type: ignore[method-assign]
        answer = windows.answered(b, family_windows(b.strings, b.n, b.least, plan.window, family))
        new = [x for x in family.levels if id(x) not in held and len(x)]
        blobs = [x.packed() for x in new]
        return pa.table(
            [
                pa.array([bucket] * (answer.num_rows + len(blobs)), pa.int32()), pa.array([*answer.column("pid").to_pylist(), *[-1] * len(blobs)], pa.int32()),
                pa.array([*answer.column("hits").to_pylist(), *blobs], pa.binary()),
            ],
            schema=_FOUND,
        )

    return run


def _add_new(family: Family, level: Level, held: set[int]) -> None:
    """Levels of the batch become one; those held stay as they are."""
    own = [x for x in family.levels if id(x) not in held]
    for x in own:
        level = x.merged(level) if len(x) >= len(level) else level.merged(x)
    family.levels = [x for x in family.levels if id(x) in held] + ([level] if len(level) else [])


def _merge(window: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        out = Family()
        for blob in t.column("level").to_pylist():
            level = Level.unpacked(blob, window)
            _add_new(out, level, set())
        return pa.table({"bucket": t.column("bucket")[:1], "windows": pa.array([len(x) for x in out.levels], pa.int64()), "level": pa.array([x.packed() for x in out.levels], pa.binary())})

    return run


LEVEL = "bucket int, windows long, level binary"


class Index:
    """Families of all windows of batches that are added one after another, by minimiser, in a folder that Spark reads and writes.

    buckets is fixed with the folder: choose it for the size that the index is to reach, since a task holds the levels of one.
    One writer at a time; a version's list of levels is written last, so that an interrupted add() leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, window: int = WINDOW, gram: int = GRAM):
        self.spark, self.path, self.plan = spark, path, _plan(buckets, window=window, gram=gram)
        self.version, self.levels = 0, []  # (folder, windows), the largest first

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        """The index as its last add() left it."""
        row = spark.read.schema("version long, state string").json(f"{path}/versions").orderBy(F.desc("version")).first()
        x = json.loads(row["state"])
        out = cls(spark, path, x["buckets"], x["window"], x["gram"])
        out.version, out.levels = row["version"], [tuple(y) for y in x["levels"]]
        return out

    def _read(self, folders: list[str]) -> DataFrame:
        rows = [self.spark.read.schema(LEVEL).parquet(f"{self.path}/{x}") for x in folders]
        out = self.spark.createDataFrame([], LEVEL)
        for x in rows:
            out = out.union(x)
        return out

    def _write(self, rows: DataFrame) -> tuple[str, int]:
        folder = f"levels/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder, self._read([folder]).agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]

    def add(self, docs: DataFrame) -> DataFrame:
        """dedup() of a batch, as if all earlier batches' documents had smaller ids."""
        texts = windows.packs(docs, windows.pack_count(docs))
        sent = texts.groupBy("pid").applyInArrow(windows.send_all(self.plan), "bucket int, pid int, strings binary")
        levels = self._read([x for x, _ in self.levels])
        found = cut(sent.groupBy("bucket").cogroup(levels.groupBy("bucket")).applyInArrow(_grow(self.plan), "bucket int, pid int, blob binary"))
        window = self.plan.window
        new = found.filter("pid < 0").select("bucket", F.col("blob").alias("level")).groupBy("bucket").applyInArrow(_merge(window), LEVEL)
        folder, n = self._write(new)
        kept = [*self.levels]
        while kept and n and kept[-1][1] <= 2 * n:
            folder, n = self._write(self._read([kept.pop()[0], folder]).select("bucket", "level").groupBy("bucket").applyInArrow(_merge(window), LEVEL))
        self.levels, self.version = [*kept, (folder, n)] if n else kept, self.version + 1
        state = json.dumps({"buckets": self.plan.buckets, "window": window, "gram": self.plan.gram, "levels": self.levels})
        self.spark.createDataFrame([(self.version, state)], "version long, state string").coalesce(1).write.mode("append").json(f"{self.path}/versions")
        hits = found.filter("pid >= 0").select("pid", F.col("blob").alias("hits"))
        return texts.groupBy("pid").cogroup(hits.groupBy("pid")).applyInArrow(windows.cover(self.plan), windows.OUT)


def op7(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return dedup(docs).selectExpr("doc_id", "n_units as n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLE = """
with b as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
p as (select doc_id, j, substr(h, 1024 * j + 1, 1122) as p from (select doc_id, h, unnest(range((length(h) // 2 + 462) // 512)) as j from b where length(h) >= 100)),
g as (select doc_id, 512 * j + o as i, substr(p, 2 * o + 1, 100) as t from (select doc_id, j, p, unnest(range(least(512, length(p) // 2 - 49))) as o from p)),
m as (select t, min(doc_id) as first from g group by t having min(doc_id) < max(doc_id)),
hit as (select g.doc_id, g.i from g join m on m.t = g.t and m.first < g.doc_id),
run as (select *, i > coalesce(lag(i) over (partition by doc_id order by i) + 50, -1) as new from hit),
spans as (select doc_id, r, min(i) as lo, max(i) + 50 as hi from (select *, sum(cast(new as int)) over (partition by doc_id order by i rows unbounded preceding) as r from run) group by doc_id, r),
gaps as (
  select doc_id, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as a, lo as z from spans
  union all select doc_id, max(hi), null from spans group by doc_id
),
kept as (select gaps.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(z, length(h) // 2) - a)), '' order by a) as k from gaps join b on b.doc_id = gaps.doc_id group by gaps.doc_id),
per as (select doc_id, sum(hi - lo) as n, count(*) as c from spans group by doc_id)
select b.doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(n, 0) as bigint) as n_removed, coalesce(c, 0) as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256
from b left join per on per.doc_id = b.doc_id left join kept on kept.doc_id = b.doc_id
"""
