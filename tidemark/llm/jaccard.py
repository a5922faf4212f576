"""N-gram Jaccard join by T-occurrence search over inverted lists.

A document is its set of word shingles (64-bit hashes). A partner of a set of n must
share T = ceil(share * n) of its shingles. DivideSkip with the T - 1 longest lists set
aside leaves the n - T + 1 rarest shingles, whose lists are short: a partner is in at
least one of them. Short lists are merged by sorted shingle; what they yield is probed
by binary search in the sorted set, which stands for all long lists at once, and kept
when the overlap reaches the share.

Rarity: shingles are counted over all documents, in cells of a hash space of about two
cells for each shingle, so that a count travels as the gap between sorted cells. Lists
are ordered by count, then hash. Any total order is exact, and cells that collide only
cost work; this order keeps what several documents have out of the short lists.

1  Packs of documents (see windows.py) find the links within the pack and send each of
   its groups once for each shingle of a short list.
2  Buckets of shingles make stars of their lists, by size; the pairs are probed.
3  Lists whose documents are then still in several components are opened: documents
   outside the largest one are searched among the documents of the others, in blocks.
   Only links come out, never candidates.

So no list yields all its pairs, and yet no link between components is missed. The
smallest id that links reach names a component. Text travels by pack once; probing
shuffles documents of candidate pairs, and the text of a star's middle once for every pack
that holds others of the star, by a join that Spark splits where a middle has many.

Cases: a null text or one without words has an empty set and no link; a text of fewer
words than a shingle is one shingle; very long texts are taken whole; rows that share an
id are one node, with a row each; a row without an id has no links and a null component;
ties of counts go by hash, of components by the smallest id; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buffers, windows
from .common import broadcast_checked, cut
from .components import components
from .windows import LAST, PACK_BYTES, Sums, _bucketed, _sorted_texts, mixed, pack_count, pack_of, packs, word_units

SHINGLE, SHARE = 4, 85
#: Cells of the hash space for each document.
CELLS = 1024
_U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass(frozen=True)
class Join:
    shingle: int = SHINGLE
    #: Per cent that an intersection must have of the union.
    share: int = SHARE
    #: Buckets of lists, and of cells, which are counted.
    buckets: int = 8
    asks: int = 8
    #: Cells are the first bits of a hash.
    bits: int = 28

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether two sorted sets are: the smaller is probed in the larger."""
        if len(a) > len(b):
            a, b = b, a
        if 100 * len(a) < self.share * len(b):
            return False
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        both = int((b[at] == a).sum())
        return 100 * both >= self.share * (len(a) + len(b) - both)

    def short(self, n: np.ndarray) -> np.ndarray:
        """How many of n lists are short."""
        return n - (self.share * n + 99) // 100 + 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted shingles of each text, and where each text's begin."""
    u = word_units(LOWER[data], offsets)
    rows = len(offsets) - 1
    count = np.diff(u.first)
    row = np.repeat(np.arange(rows), count)
    sums = Sums(u.hashes)
    few = np.flatnonzero((count > 0) & (count < n))
    tokens, of = [sums.of(u.first[few], u.first[few + 1])], [few]
    if len(u.hashes) >= n:
        whole = row[: len(row) - n + 1] == row[n - 1 :]
        tokens.append(sums.every(n)[whole])
        of.append(row[: len(row) - n + 1][whole])
    token, row = np.concatenate(tokens), np.concatenate(of)
    order = np.lexsort((token, row))
    token, row = token[order], row[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
    return token[new], np.searchsorted(row[new], np.arange(rows + 1))


def _cells(token: np.ndarray, join: Join) -> np.ndarray:
    return token >> _U(64 - join.bits)


def _width(join: Join) -> int:
    """Cells of a bucket."""
    return -(-(1 << join.bits) // join.asks)


def tell(join: Join) -> Callable[[pa.Table], pa.Table]:
    """(bucket, pid, cells): the cells of a pack's shingles, sorted, as gaps in planes of bytes, and how often each comes."""

    def run(t: pa.Table) -> pa.Table:
        _, data, offsets, t = _sorted_texts(t)
        cell, n = np.unique(_cells(shingle_sets(data, offsets, join.shingle)[0], join), return_counts=True)
        n = np.minimum(n, 255).astype(np.uint8)
        b, edges = np.unique(cell // _U(_width(join)), return_index=True)
        edges = np.append(edges, len(cell))
        blobs = []
        for i in range(len(b)):
            part = slice(edges[i], edges[i + 1])
            blobs.append(buffers.packed(np.diff(cell[part], prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.copy(), n[part]))
        pid = t.column("pid")[0].as_py()
        return pa.table({"bucket": pa.array(b.astype(np.int32)), "pid": pa.array([pid] * len(b), pa.int32()), "cells": pa.array(blobs, pa.binary())})

    return run


def count(t: pa.Table) -> pa.Table:
    """(pid, bucket, counts): how many shingles a cell has, in the order that a pack told its cells, 255 for more."""
    pids, cells, times = t.column("pid"), [], []
    for blob in t.column("cells").to_pylist():
        gaps, n = buffers.unpacked(blob, np.uint8, np.uint8)
        cells.append(np.cumsum(gaps.reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64))
        times.append(n)
    _, which = np.unique(np.concatenate(cells), return_inverse=True)
    n = np.minimum(np.bincount(which, np.concatenate(times)), 255).astype(np.uint8)[which]
    ends = np.cumsum([len(c) for c in cells])
    return pa.table({"pid": pids, "bucket": t.column("bucket"), "counts": pa.array([buffers.packed(x) for x in np.split(n, ends[:-1])], pa.binary())})


class Groups:
    """Union-find over the rows of a pack."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return int(i)

    def join(self, i: int, j: int) -> None:
        i, j = sorted((self.top(i), self.top(j)))
        self.up[j] = i

    def all(self) -> np.ndarray:
        return np.array([self.top(i) for i in range(len(self.up))], np.int64)


def _lists(token: np.ndarray, member: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct lists of two or more members; equal lists once."""
    order = np.lexsort((member, token))
    token, member = token[order], member[order]
    head = np.ones(len(token), bool)
    head[1:] = token[1:] != token[:-1]
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, len(token)))
    if not (size > 1).any():
        return
    name = np.add.reduceat(mixed(member.astype(np.uint64) + _U(0x9E3779B97F4A7C15)), at)
    on = np.flatnonzero(size > 1)
    _, first = np.unique(np.stack([name[on], size[on].astype(np.uint64)]), axis=1, return_index=True)
    for i in on[first]:
        yield member[at[i] : at[i] + size[i]]


def short_lists(token: np.ndarray, first: np.ndarray, counts: np.ndarray, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, row) of the short lists of each row, without those that no other row is in."""
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    order = np.argsort(row * 256 + counts, kind="stable")
    place = np.arange(len(token)) - np.repeat(first[:-1], n)
    on = (place < np.repeat(join.short(n), n)) & (counts[order] > 1)
    return token[order][on], row[on]


OUT = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("pid", pa.int32()), ("blob", pa.binary())])
ENTRIES, LINKS, SIZES = 0, 1, 2


def search_pack(join: Join) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """1: entries of short lists by bucket, links within the pack, and the sizes of sets."""

    def run(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows:
            return OUT.empty_table()
        did, data, offsets, t = _sorted_texts(t)
        pid = t.column("pid")[0].as_py()
        token, first = shingle_sets(data, offsets, join.shingle)
        parts = [buffers.unpacked(b, np.uint8)[0] for b in told.sort_by("bucket").column("counts").to_pylist()]
        counts = np.concatenate([np.empty(0, np.uint8), *parts]).astype(np.int64)[np.unique(_cells(token, join), return_inverse=True)[1]]
        n = np.diff(first)
        groups = Groups(len(n))
        for i in np.flatnonzero((did[1:] == did[:-1]) & (did[1:] != LAST)):
            groups.join(int(i), int(i) + 1)
        key, row = short_lists(token, first, counts, join)
        key, row = key[did[row] != LAST], row[did[row] != LAST]
        for rows in _lists(key, row):
            tops = np.array([groups.top(int(i)) for i in rows])
            if (tops == tops[0]).all():
                continue
            for j, b in enumerate(rows.tolist()):
                for a in rows[:j].tolist():
                    if groups.top(a) != groups.top(b) and join.linked(token[first[a] : first[a + 1]], token[first[b] : first[b + 1]]):
                        groups.join(a, b)
        top = groups.all()
        # A group goes by its member with the smallest share of shingles of its own: of edited copies the least edited.
        own = np.add.reduceat(np.append(counts == 1, False), np.minimum(first[:-1], len(counts)), dtype=np.int64) * (n > 0)
        own = 1000 * own // np.maximum(n, 1)
        order = np.lexsort((np.arange(len(n)), own, n == 0, top))
        top = order[np.searchsorted(top[order], top)]
        # It is one entry of a list; its sizes bound those of its members.
        low, high = np.full(len(n), LAST), np.zeros(len(n), np.int64)
        np.minimum.at(low, top, np.where(n > 0, n, LAST))
        np.maximum.at(high, top, n)
        group = top[row]
        order = np.lexsort((group, key))
        key, group = key[order], group[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        key, group = key[new], group[new]
        bucket = _bucketed(key, join.buckets)
        order = np.argsort(bucket, kind="stable")
        key, group = key[order], group[order]
        b, edges = np.unique(bucket[order], return_index=True)
        edges = np.append(edges, len(order))
        blobs = []
        for i in range(len(b)):
            part = slice(edges[i], edges[i + 1])
            blobs.append(buffers.packed(key[part], did[group[part]], low[group[part]].astype(np.uint32), high[group[part]].astype(np.uint32), own[group[part]].astype(np.uint16)))
        member = np.flatnonzero((n > 0) & (did != LAST))
        links = buffers.packed(did[top[member]], did[member], n[member])
        null = np.array([x is None for x in t.column("doc_id").to_pylist()], np.uint8)
        sizes = buffers.packed(did, null, n)
        return pa.table(
            [
                pa.array([ENTRIES] * len(b) + [LINKS, SIZES], pa.int32()), pa.array([*b.tolist(), -1, -1], pa.int32()),
                pa.array([pid] * (len(b) + 2), pa.int32()), pa.array([*blobs, links, sizes], pa.binary()),
            ],
            schema=OUT,
        )

    return run


def stars(join: Join) -> Callable[[pa.Table], pa.Table]:
    """2: (list, did): distinct lists of two or more groups, and (a, b) pairs that make stars of them, a the middle."""

    def run(t: pa.Table) -> pa.Table:
        parts = [buffers.unpacked(b, np.uint64, np.int64, np.uint32, np.uint32, np.uint16) for b in t.column("blob").to_pylist()]
        key, did, low, high, own = (np.concatenate(x) for x in zip(*parts))
        names, which = np.unique(did, return_inverse=True)
        lows, highs, owns = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        lows[which], highs[which], owns[which] = low, high, own
        number, members, a, b = [], [], [], []
        for k, rows in enumerate(_lists(key, which)):
            number.append(np.full(len(rows), k))
            members.append(names[rows])
            rows = rows[np.lexsort((names[rows], owns[rows]))]
            while len(rows) > 1:
                pivot = rows[0]
                near = (join.share * lows[rows] <= 100 * highs[pivot]) & (join.share * lows[pivot] <= 100 * highs[rows])
                others = rows[near][1:]
                a.append(np.full(len(others), names[pivot]))
                b.append(names[others])
                rows = rows[~near]
        none = np.empty(0, np.int64)
        number, members, a, b = (np.concatenate([none, *x]) for x in (number, members, a, b))
        pairs = np.unique(np.stack([a, b]), axis=1) if len(a) else np.empty((2, 0), np.int64)
        bucket = t.column("bucket")[0].as_py()
        number = number * join.buckets + bucket
        return pa.table(
            {
                "list": pa.concat_arrays([pa.array(number, pa.int64()), pa.nulls(pairs.shape[1], pa.int64())]),
                "a": pa.array(np.concatenate([members, pairs[0]]), pa.int64()),
                "b": pa.concat_arrays([pa.nulls(len(members), pa.int64()), pa.array(pairs[1], pa.int64())]),
            }
        )

    return run


def _unpack_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            a, b, n = buffers.unpacked(blob, np.int64, np.int64, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n"])


def _unpack_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            did, null, n = buffers.unpacked(blob, np.int64, np.uint8, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(did, mask=null.astype(bool)), pa.array(n)], names=["doc_id", "n_shingles"])


def probe(join: Join) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Links among the pairs: sets of lent texts are probed in those of the pack."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(t: pa.Table, lent: pa.Table) -> pa.Table:
        if not t.num_rows or not lent.num_rows:
            return schema.empty_table()
        partners = lent.column("bs").to_pylist()
        did, data, offsets, t = _sorted_texts(t.filter(pa.array(np.isin(t.column("did").to_numpy(), np.concatenate(partners)))))
        token, first = shingle_sets(data, offsets, join.shingle)
        theirs_data, theirs_at = buffers.utf8(lent.column("text"))
        out, a = [], lent.column("a").to_pylist()
        for lo, hi in buffers.runs(theirs_at, PACK_BYTES):
            theirs, begin = shingle_sets(theirs_data[theirs_at[lo] : theirs_at[hi]], theirs_at[lo : hi + 1] - theirs_at[lo], join.shingle)
            for i in range(hi - lo):
                mine = theirs[begin[i] : begin[i + 1]]
                for b in partners[lo + i]:
                    for row in range(*np.searchsorted(did, [b, b + 1])):
                        if len(mine) and first[row] < first[row + 1] and join.linked(mine, token[first[row] : first[row + 1]]):
                            out.append((a[lo + i], b))
                            break
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return run


def probed(docs: DataFrame, pairs: DataFrame, join: Join, n_packs: int) -> DataFrame:
    """The links among (a, b). Only documents of pairs are shuffled."""
    others = cut(pairs.select(F.col("b").alias("doc_id")).distinct())
    texts = packs(docs.join(broadcast_checked(others), "doc_id", "left_semi"), n_packs, together=True)
    middles = cut(pairs.select(F.col("a").alias("doc_id")).distinct())
    middle = docs.join(broadcast_checked(middles), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.coalesce("text", F.lit("")).alias("text"))
    asked = pairs.groupBy(pack_of(F.col("b"), n_packs).alias("pid"), "a").agg(F.collect_list("b").alias("bs"))
    lent = asked.join(middle.hint("merge"), "a").select("pid", "a", "text", "bs")
    return texts.groupBy("pid").cogroup(lent.groupBy("pid")).applyInArrow(probe(join), "a long, b long")


#: Documents and queries of a cell of the last search.
BLOCK = 512


def search_cell(join: Join) -> Callable[[pa.Table], pa.Table]:
    """3: links of a cell's queries with its documents of other components, by T-occurrence search."""

    def run(t: pa.Table) -> pa.Table:
        data, offsets = buffers.utf8(t.column("text"))
        query, comp, doc = (t.column(c).to_numpy() for c in ("query", "comp", "doc"))
        token, first = shingle_sets(data, offsets, join.shingle)
        n = np.diff(first)
        row = np.repeat(np.arange(len(n)), n)
        order = np.argsort(np.where(query[row] == 0, token, _U(0)), kind="stable")
        order = order[query[row[order]] == 0]
        names, begin = np.unique(token[order], return_index=True)
        end, members = np.append(begin[1:], len(order)), row[order]
        a, b = [], []
        for r in np.flatnonzero((query == 1) & (n > 0)).tolist():
            mine = token[first[r] : first[r + 1]]
            at = np.minimum(np.searchsorted(names, mine), max(0, len(names) - 1))
            at = at[names[at] == mine] if len(names) else at[:0]
            need = -(-join.share * len(mine) // 100)
            if len(at) < need:
                continue
            # The longest lists are set aside: who reaches the rest of the need in the others is probed.
            aside = need // 16
            at = at[np.argsort(end[at] - begin[at], kind="stable")][: len(at) - aside]
            merged = np.concatenate([members[begin[i] : end[i]] for i in at.tolist()])
            for x in np.flatnonzero(np.bincount(merged, minlength=len(n)) >= need - aside).tolist():
                if comp[x] != comp[r] and doc[x] != doc[r] and join.linked(mine, token[first[x] : first[x + 1]]):
                    a.append(doc[r])
                    b.append(doc[x])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _opened_links(docs: DataFrame, lists: DataFrame, members: DataFrame, comps: DataFrame, join: Join) -> DataFrame:
    """3: links between documents of different components that share a list.

    Documents of lists with the same largest component are searched together: those outside of it, as queries,
    against all. Blocks of queries meet blocks of documents, so that a cell is bounded.
    """
    named = cut(lists.join(comps, F.col("did") == F.col("node"), "left").select("list", "did", F.coalesce("comp", "did").alias("comp")))
    several = named.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("list")
    opened = cut(named.join(several, "list"))
    sizes = opened.groupBy("list", "comp").agg(F.count(F.lit(1)).alias("docs"))
    largest = cut(sizes.groupBy("list").agg(F.max(F.struct("docs", F.col("comp").alias("most"))).alias("x")).select("list", F.col("x.most").alias("most")))
    groups = cut(opened.join(largest, "list").select("most", "comp", "did").distinct())
    each = cut(groups.join(members.select(F.col("rep").alias("did"), F.col("did").alias("doc")), "did").select("most", "comp", "doc").distinct())
    blocks = each.groupBy("most").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("nd"), F.ceil(F.count_if(F.col("comp") != F.col("most")) / BLOCK).alias("nq"))
    placed = cut(each.join(cut(blocks), "most"))
    part, every = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    documents = placed.select("most", "comp", "doc", part("nd").alias("db"), every("nq").alias("qb"), F.lit(0).alias("query"))
    queries = placed.filter("comp <> most").select("most", "comp", "doc", every("nd").alias("db"), part("nq").alias("qb"), F.lit(1).alias("query"))
    ids = cut(each.select("doc").distinct())
    some = docs.join(broadcast_checked(ids), F.col("doc_id") == F.col("doc"), "left_semi")
    rows = documents.union(queries).join(some, F.col("doc") == F.col("doc_id")).select("most", "db", "qb", "query", "comp", "doc", F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("most", "db", "qb").applyInArrow(search_cell(join), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """For each row: doc_id, n_shingles, component_id."""
    docs = docs.select("doc_id", "text")
    n_packs = pack_count(docs)
    bits = min(48, max(20, (n_packs * windows.PACK * CELLS - 1).bit_length()))
    join = Join(shingle, share, n_packs // 4 + 8, n_packs // 16 + 8, bits)
    texts = packs(docs, n_packs, together=True)
    told = texts.groupBy("pid").applyInArrow(tell(join), "bucket int, pid int, cells binary")
    counted = told.groupBy("bucket").applyInArrow(count, "pid int, bucket int, counts binary")
    found = texts.groupBy("pid").cogroup(counted.groupBy("pid")).applyInArrow(search_pack(join), "kind int, bucket int, pid int, blob binary")
    found = cut(found)
    members = cut(found.filter(f"kind = {LINKS}").select("blob").mapInArrow(_unpack_links, "a long, b long, n long")).toDF("rep", "did", "n")
    starred = cut(found.filter(f"kind = {ENTRIES}").select("bucket", "blob").groupBy("bucket").applyInArrow(stars(join), "list long, a long, b long"))
    lists = starred.filter("list is not null").select("list", F.col("a").alias("did"))
    pairs = cut(starred.filter("list is null").select("a", "b").distinct())
    within = members.filter("rep <> did").select(F.col("rep").alias("a"), F.col("did").alias("b"))
    links = cut(within.union(probed(docs, pairs, join, n_packs)))
    comps = components(links)
    more = cut(_opened_links(docs, lists, members, comps, join).distinct())
    if not more.isEmpty():
        comps = components(links.union(more))
    sizes = found.filter(f"kind = {SIZES}").select("blob").mapInArrow(_unpack_sizes, "doc_id long, n_shingles long")
    return sizes.join(comps, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))


def op10(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, array_to_string(w[i + 1 : i + 4], ' ') as t from (select doc_id, w, unnest(range(greatest(1, len(w) - 3))) as i from w where len(w) > 0)
), n as (select doc_id, count(*) as n from s group by doc_id),
same as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from same join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared)),
e as (select a, b from link union all select b, a from link),
reach(a, b) as (select a, b from e union select reach.a, e.b from reach join e on e.a = reach.b),
c as (select a, least(a, min(b)) as comp from reach group by a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.comp, w.doc_id) as component_id
from w left join n on n.doc_id = w.doc_id left join c on c.a = w.doc_id
"""
