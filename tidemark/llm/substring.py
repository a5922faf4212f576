"""Substring dedup of words by super-k-mer partitioning (see windows.py for the stages).

A window is 50 consecutive words. Super-k-mers travel as packed strings to the bucket of
their minimiser; there words get numbers, every window is a row of numbers, and sorting
the rows brings equal windows together, so that the smallest document of each is exact.
A minimiser with many windows is sorted in classes of a hash of the window.

Cases: a null text or one without words has no window and keeps nothing to remove; very
long texts are taken whole; a null id counts as larger than all others; rows that share
an id do not remove each other's words; repeated rows have equal results; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import windows

WINDOW, GRAM = 50, 16


def sort_windows(strings: list[bytes], n: np.ndarray, least: np.ndarray, window: int) -> list[np.ndarray]:
    """The smallest id of each window of each string, by sorting all windows."""
    numbers: dict[bytes, int] = {}
    units = np.concatenate([np.array([numbers.setdefault(w, len(numbers)) for w in s.split(b" ")], np.uint32) for s in strings])
    first = np.concatenate([[0], np.cumsum(n + window - 1)])
    ends = np.cumsum(n)
    at = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(first[:-1], n)
    views = np.lib.stride_tricks.sliding_window_view(units, window)
    ids, out = np.repeat(least, n), np.empty(len(at), np.int64)
    classes = -(-len(at) // windows.TOGETHER)
    of = windows.Sums(units.astype(np.uint64) + np.uint64(1)).every(window)[at] % np.uint64(classes) if classes > 1 else None
    for c in range(classes):
        some = np.arange(len(at)) if of is None else np.flatnonzero(of == c)
        if not len(some):
            continue
        rows = np.ascontiguousarray(views[at[some]]).view(f"S{4 * window}").ravel()
        order = np.argsort(rows, kind="stable")
        head = np.ones(len(rows), bool)
        head[1:] = rows[order][1:] != rows[order][:-1]
        low = np.minimum.reduceat(ids[some][order], np.flatnonzero(head))
        out[some[order]] = low[np.cumsum(head) - 1]
    return np.split(out, ends[:-1])


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Columns: doc_id, n_units, n_removed, n_spans, kept_sha256, kept (the remaining words, joined by one space)."""
    return windows.shared(docs, lambda buckets, asks: windows.Plan(windows.word_units, window, gram, sort_windows, buckets, asks))


def op6(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return dedup(docs).selectExpr("doc_id", "n_units as n_words", "n_removed", "kept_sha256")


ORACLE = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), g as (
  select doc_id, i, array_to_string(w[i + 1 : i + 50], ' ') as t from (select doc_id, w, unnest(range(len(w) - 49)) as i from w where len(w) >= 50)
), m as (select t, min(doc_id) as first from g group by t having min(doc_id) < max(doc_id)),
gone as (select distinct g.doc_id, unnest(range(i, i + 50)) as p from g join m on m.t = g.t and m.first < g.doc_id),
per as (select doc_id, count(*) as n, list(p) as ps from gone group by doc_id),
word as (select doc_id, unnest(w) as x, unnest(range(len(w))) as p from w),
kept as (
  select word.doc_id, string_agg(word.x, ' ' order by word.p) as t from word left join gone on gone.doc_id = word.doc_id and gone.p = word.p
  where gone.p is null group by word.doc_id
)
select w.doc_id, cast(len(w.w) as bigint) as n_words, cast(coalesce(per.n, 0) as bigint) as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256
from w left join per on per.doc_id = w.doc_id left join kept on kept.doc_id = w.doc_id
"""
