"""Windows that repeat across documents, found through minimisers.

Units are the bytes or the words of a text. A window is `window` consecutive units; its
minimiser is the smallest hash among the runs of `gram` units in it. Consecutive windows
that share a minimiser are a super-k-mer. Equal windows have equal minimisers, so:

A  packs of documents send the distinct minimisers that they have to buckets,
B  buckets answer each pack with those that other documents have too,
C  packs send the distinct strings of super-k-mers of such minimisers to the minimiser's
   bucket, each once, packed, with the smallest and largest id that have it in the pack,
D  buckets compare windows exactly and answer each string with the smallest id that has
   each of its windows, in runs,
E  packs find their strings again and cover units by the windows that also start in a
   document with a smaller id.

Packs hold about PACK documents or PACK_BYTES by a hash of id and text, buckets a share of
all minimisers: both numbers follow the input, neither is a key of the data. What every
document has costs a bucket one entry for each pack: minima are folded in the pack, and
places of occurrence never travel. The text is shuffled once, for A, C and E.
A text is one row of a pack, so that its length is bounded by what a row may have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buffers

PACK, PACK_BYTES = 500, 2 << 20
#: Windows in one packed string at most; longer runs are cut.
RUN = 256
LAST = np.iinfo(np.int64).max
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


@lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of hashes and of its inverse modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(1 << bits, _U(base))
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(16, int(n).bit_length()))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(29)
    return x


class Sums:
    """Hashes of any run of units, from prefix sums."""

    def __init__(self, units: np.ndarray):
        p, self.inverse = powers(len(units) + 1)
        self.upto = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * p[: len(units)], out=self.upto[1:])

    def every(self, n: int) -> np.ndarray:
        """Of the run of n from each unit on."""
        return mixed((self.upto[n:] - self.upto[:-n]) * self.inverse[: len(self.upto) - n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.upto[end] - self.upto[start]) * self.inverse[start] + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


BYTES = (np.arange(256, dtype=np.uint64) + _U(1)) * _U(0xD6E8FEB86659FD93)


@dataclass
class Units:
    """The units of a pack's texts: where each lies in the bytes, its hash, the first of each text."""

    data: np.ndarray
    start: np.ndarray | None
    end: np.ndarray | None
    hashes: np.ndarray
    first: np.ndarray


def byte_units(data: np.ndarray, offsets: np.ndarray) -> Units:
    return Units(data, None, None, BYTES[data], offsets)


def word_units(data: np.ndarray, offsets: np.ndarray) -> Units:
    on = np.zeros(len(data) + 2, bool)
    on[1:-1] = ~SPACE[data]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins, ends = on[1:-1] & ~on[:-2], on[1:-1] & ~on[2:]
    begins[inner] |= on[1:-1][inner]
    ends[inner - 1] |= on[1:-1][inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = Sums(BYTES[data]).of(start, end) if len(start) else np.empty(0, np.uint64)
    return Units(data, start, end, hashes, np.searchsorted(start, offsets))


@dataclass
class Skmers:
    at: np.ndarray  # the first unit
    n: np.ndarray  # windows
    key: np.ndarray  # the minimiser
    row: np.ndarray  # the text
    sums: Sums


def skmers(u: Units, window: int, gram: int) -> Skmers:
    total = len(u.hashes)
    none = np.empty(0, np.int64)
    if total < window:
        return Skmers(none, none, np.empty(0, np.uint64), none, Sums(u.hashes))
    sums = Sums(u.hashes)
    s, w, k = sums.every(gram), window - gram + 1, 1
    while k * 2 <= w:
        s = np.minimum(s[:-k], s[k:])
        k *= 2
    if k < w:
        s = np.minimum(s[: len(s) - (w - k)], s[w - k :])
    row = np.repeat(np.arange(len(u.first) - 1), np.diff(u.first))
    n = total - window + 1
    whole = row[:n] == row[window - 1 :]
    new = np.ones(n, bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:n] != row[: n - 1])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, n))
    if (length > RUN).any():
        since = np.arange(n) - np.repeat(begin, length)
        new |= since % RUN == 0
        begin = np.flatnonzero(new)
    counted = np.concatenate([[0], np.cumsum(whole)])
    length = np.diff(counted[np.append(begin, n)])
    on = length > 0
    begin = begin[on]
    return Skmers(begin, length[on], s[begin], row[begin], sums)


@dataclass(frozen=True)
class Plan:
    units: Callable[[np.ndarray, np.ndarray], Units]
    window: int
    gram: int
    #: All strings of a bucket: strings, keys and smallest ids to the smallest id of each of their windows.
    compare: Callable[[list[bytes], np.ndarray, np.ndarray, int], list[np.ndarray]]
    #: Buckets of strings, and of minimisers, which are much less.
    buckets: int = 8
    asks: int = 8


def _sorted_texts(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """A pack's texts in an order that does not depend on how they arrived."""
    t = t.sort_by([("did", "ascending"), ("tv", "ascending")])
    data, offsets = buffers.utf8(t.column("text"))
    return t.column("did").to_numpy(), data, offsets, t


def _bucketed(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> _U(16)) % _U(n)).astype(np.int64)


def ask(plan: Plan) -> Callable[[pa.Table], pa.Table]:
    """A: (bucket, pid, keys); the low bit of a key tells that several documents of the pack have it."""

    def run(t: pa.Table) -> pa.Table:
        _, data, offsets, t = _sorted_texts(t)
        k = skmers(plan.units(data, offsets), plan.window, plan.gram)
        key = (k.key >> _U(16)) << _U(16)
        order = np.lexsort((k.row, key))
        key, row = key[order], k.row[order]
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(head)
        last = np.append(at[1:], len(key)) - 1
        flags = (row[at] != row[last]).astype(np.uint8) if len(at) else np.empty(0, np.uint8)
        key = key[at]
        bucket = _bucketed(key, plan.asks)
        order = np.argsort(bucket, kind="stable")
        b, edges = np.unique(bucket[order], return_index=True)
        edges = np.append(edges, len(order))
        blobs = []
        for i in range(len(b)):
            part = order[edges[i] : edges[i + 1]]
            # 48 bits of a key tell it apart.
            blobs.append(buffers.packed(key[part].view(np.uint8).reshape(-1, 8)[:, 2:].copy(), np.packbits(flags[part])))
        pid = t.column("pid")[0].as_py()
        return pa.table({"bucket": pa.array(b, pa.int32()), "pid": pa.array([pid] * len(b), pa.int32()), "keys": pa.array(blobs, pa.binary())})

    return run


def _keys48(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = raw.reshape(-1, 6)
    return out.view(np.uint64).ravel()


def answer(t: pa.Table) -> pa.Table:
    """B: for each pack of the bucket the keys that are not of one document alone."""
    pids, keys, flags = t.column("pid").to_pylist(), [], []
    for blob in t.column("keys").to_pylist():
        raw, bits = buffers.unpacked(blob, np.uint8, np.uint8)
        keys.append(_keys48(raw))
        flags.append(np.unpackbits(bits, count=len(keys[-1])).astype(bool))
    key, flag = np.concatenate(keys), np.concatenate(flags)
    of = np.repeat(np.arange(len(pids)), [len(k) for k in keys])
    order = np.argsort(key, kind="stable")
    key, flag, of = key[order], flag[order], of[order]
    same = key[1:] == key[:-1]
    shared = flag.copy()
    shared[1:] |= same
    shared[:-1] |= same
    key, of = key[shared], of[shared]
    order = np.argsort(of, kind="stable")
    key, of = key[order], of[order]
    who, edges = np.unique(of, return_index=True)
    edges = np.append(edges, len(of))
    blobs = [buffers.packed(key[edges[i] : edges[i + 1]].view(np.uint8).reshape(-1, 8)[:, 2:].copy()) for i in range(len(who))]
    return pa.table({"pid": pa.array([pids[i] for i in who], pa.int32()), "keys": pa.array(blobs, pa.binary())})


@dataclass
class Strings:
    """Super-k-mers of a pack by minimiser and content: the occurrences in that order, and the distinct strings."""

    begin: np.ndarray
    n: np.ndarray
    row: np.ndarray
    key: np.ndarray
    string: np.ndarray  # of each occurrence
    head: np.ndarray  # an occurrence of each string
    ordinal: np.ndarray  # of each string among those of its minimiser


def _differ(u: Units, begin: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether runs of units differ from others of the same length: bytes, or hashes of words."""
    values, out = (u.data if u.start is None else u.hashes), np.zeros(len(begin), bool)
    for lo, hi in buffers.runs(np.concatenate([[0], np.cumsum(length)]), 1 << 18):
        first = np.concatenate([[0], np.cumsum(length[lo:hi])])
        inner = np.arange(first[-1]) - np.repeat(first[:-1], length[lo:hi])
        unlike = values[np.repeat(begin[lo:hi], length[lo:hi]) + inner] != values[np.repeat(other[lo:hi], length[lo:hi]) + inner]
        out[lo:hi] = np.logical_or.reduceat(unlike, first[:-1])
    return out


def strings_of(plan: Plan, u: Units, k: Skmers, on: np.ndarray) -> Strings:
    """The super-k-mers `on`, all of each minimiser. Those that a hash takes for equal are compared, and told apart where they are not."""
    begin, n, row, key = k.at[on], k.n[on], k.row[on], (k.key[on] >> _U(16)) << _U(16)
    identity = k.sums.of(begin, begin + n + plan.window - 1)
    while True:
        order = np.lexsort((n, identity, key))
        same = np.zeros(len(order), bool)
        same[1:] = (n[order][1:] == n[order][:-1]) & (identity[order][1:] == identity[order][:-1]) & (key[order][1:] == key[order][:-1])
        head = order[~same][np.cumsum(~same) - 1]
        unlike = same.copy()
        unlike[same] = _differ(u, begin[order[same]], begin[head[same]], n[order[same]] + plan.window - 1)
        if not unlike.any():
            break
        identity[order[unlike]] = mixed(identity[order[unlike]] + _U(1))
    begin, n, row, key = begin[order], n[order], row[order], key[order]
    heads = np.flatnonzero(~same)
    of_key = np.ones(len(heads), bool)
    of_key[1:] = key[heads][1:] != key[heads][:-1]
    at = np.flatnonzero(of_key)
    ordinal = np.arange(len(heads)) - np.repeat(at, np.diff(np.append(at, len(heads))))
    return Strings(begin, n, row, key, np.cumsum(~same) - 1, heads, ordinal)


def _texts(plan: Plan, u: Units, begin: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Strings as bytes; words are joined by one space."""
    if u.start is None:
        mem = u.data.tobytes()
        return [mem[a:b] for a, b in zip(begin.tolist(), (begin + n + plan.window - 1).tolist())]
    mem = np.where(SPACE[u.data], np.uint8(0x20), u.data).tobytes()
    lo, hi = u.start[begin], u.end[begin + n + plan.window - 2]
    return [mem[a:b] if b"  " not in mem[a:b] else b" ".join(mem[a:b].split()) for a, b in zip(lo.tolist(), hi.tolist())]


SENT = pa.schema([("bucket", pa.int32()), ("pid", pa.int32()), ("strings", pa.binary())])


def packed_strings(plan: Plan, t: pa.Table, u: Units, did: np.ndarray, s: Strings) -> pa.Table:
    """(bucket, pid, strings): minimiser, windows, bytes, smallest and largest id of each string of the pack."""
    heads = s.head
    if not len(heads):
        return SENT.empty_table()
    least, most = np.minimum.reduceat(did[s.row], heads), np.maximum.reduceat(did[s.row], heads)
    order = np.argsort(_bucketed(s.key[heads], plan.buckets), kind="stable")
    heads, least, most = heads[order], least[order], most[order]
    texts = _texts(plan, u, s.begin[heads], s.n[heads])
    size = np.array([len(x) for x in texts], np.uint32)
    b, edges = np.unique(_bucketed(s.key[heads], plan.buckets), return_index=True)
    blobs = []
    for lo, hi in zip(edges, np.append(edges[1:], len(heads))):
        raw = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
        blobs.append(buffers.packed(s.key[heads[lo:hi]], s.n[heads[lo:hi]].astype(np.uint16), size[lo:hi], raw, least[lo:hi], most[lo:hi]))
    pid = t.column("pid")[0].as_py()
    return pa.table({"bucket": pa.array(b, pa.int32()), "pid": pa.array([pid] * len(b), pa.int32()), "strings": pa.array(blobs, pa.binary())})


def send(plan: Plan) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """C: the pack's strings of minimisers that others have too."""

    def run(t: pa.Table, asked: pa.Table) -> pa.Table:
        if not t.num_rows or not asked.num_rows:
            return SENT.empty_table()
        did, data, offsets, t = _sorted_texts(t)
        shared = np.sort(np.concatenate([_keys48(buffers.unpacked(b, np.uint8)[0]) for b in asked.column("keys").to_pylist()]))
        u = plan.units(data, offsets)
        k = skmers(u, plan.window, plan.gram)
        return packed_strings(plan, t, u, did, strings_of(plan, u, k, np.flatnonzero(_among(k.key, shared))))

    return run


def send_all(plan: Plan) -> Callable[[pa.Table], pa.Table]:
    """The same of all minimisers."""

    def run(t: pa.Table) -> pa.Table:
        did, data, offsets, t = _sorted_texts(t)
        u = plan.units(data, offsets)
        k = skmers(u, plan.window, plan.gram)
        return packed_strings(plan, t, u, did, strings_of(plan, u, k, np.arange(len(k.at))))

    return run


def _among(key: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the first 48 bits of hashes are among sorted keys."""
    key = (key >> _U(16)) << _U(16)
    return keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key if len(keys) else np.zeros(len(key), bool)


@dataclass
class Bucket:
    """Strings of a bucket, those of several packs once, and the entries of the packs."""

    pids: list[int]
    strings: list[bytes]
    key: np.ndarray
    n: np.ndarray
    least: np.ndarray
    pack: np.ndarray  # of each entry, by number in pids
    of: np.ndarray  # its string
    ordinal: np.ndarray
    most: np.ndarray


def bucket_of(t: pa.Table) -> Bucket:
    ids: dict[tuple[int, bytes], int] = {}
    keys, sizes, entries = [], [], []
    for i, blob in enumerate(t.column("strings").to_pylist()):
        key, n, size, raw, low, high = buffers.unpacked(blob, np.uint64, np.uint16, np.uint32, np.uint8, np.int64, np.int64)
        mem, ends = raw.tobytes(), np.cumsum(size).tolist()
        local, begin = np.empty(len(size), np.int64), 0
        for j, (k, end) in enumerate(zip(key.tolist(), ends)):
            name = (k, mem[begin:end])
            x = ids.get(name)
            if x is None:
                x = ids[name] = len(ids)
                keys.append(k)
                sizes.append(n[j])
            local[j] = x
            begin = end
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(first)
        entries.append((np.full(len(key), i), local, np.arange(len(key)) - np.repeat(at, np.diff(np.append(at, len(key)))), low, high))
    pack, of, ordinal, low, most = (np.concatenate(x) for x in zip(*entries))
    least = np.full(len(ids), LAST)
    np.minimum.at(least, of, low)
    return Bucket(t.column("pid").to_pylist(), [s for _, s in ids], np.array(keys, np.uint64), np.array(sizes, np.int64), least, pack, of, ordinal, most)


ANSWERED = pa.schema([("pid", pa.int32()), ("hits", pa.binary())])


def answered(b: Bucket, lows: list[np.ndarray]) -> pa.Table:
    """(pid, hits): for each string of a pack the runs of windows that some id has which is smaller than the pack's largest with it."""
    flat = np.concatenate([np.empty(0, np.int64), *lows])
    first = np.concatenate([[0], np.cumsum([len(x) for x in lows])]).astype(np.int64)
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[first[:-1]] = True
    begin = np.flatnonzero(new)
    runs = np.searchsorted(begin, first)  # of each string
    string = np.repeat(np.arange(len(lows)), np.diff(runs))
    length, at, low = np.diff(np.append(begin, len(flat))), begin - first[string], flat[begin]
    parts = []
    for lo, hi in buffers.runs(np.concatenate([[0], np.cumsum(np.diff(runs)[b.of])]), 1 << 20):
        n = np.diff(runs)[b.of[lo:hi]]
        entry = np.repeat(np.arange(lo, hi), n)
        run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + runs[b.of[entry]]
        on = low[run] < b.most[entry]
        parts.append((entry[on], run[on]))
    entry, run = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64),) * 2
    who, edges = np.unique(b.pack[entry], return_index=True)
    blobs = []
    for i, j in zip(edges, np.append(edges[1:], len(entry))):
        e, r = entry[i:j], run[i:j]
        blobs.append(buffers.packed(b.key[b.of[e]], b.ordinal[e].astype(np.uint32), at[r].astype(np.uint16), length[r].astype(np.uint16), low[r]))
    return pa.table([pa.array([b.pids[i] for i in who], pa.int32()), pa.array(blobs, pa.binary())], schema=ANSWERED)


def compare(plan: Plan) -> Callable[[pa.Table], pa.Table]:
    """D: strings of a minimiser that has several are compared window by window; all windows of a lone one start first where it does."""

    def run(t: pa.Table) -> pa.Table:
        b = bucket_of(t)
        order = np.argsort(b.key, kind="stable")
        same = np.zeros(len(b.key) + 1, bool)
        same[1:-1] = b.key[order][1:] == b.key[order][:-1]
        several = same[1:] | same[:-1]
        lows: list[np.ndarray] = [None if x else np.full(b.n[i], b.least[i]) for i, x in zip(order.tolist(), several)]  # type: ignore[list-item]
        which = np.flatnonzero(several)
        part_of, upto = order[which], np.cumsum(b.n[order[which]])
        # Minimisers are compared together up to so many windows, since windows of different ones are never equal.
        edge, begin = np.append(np.flatnonzero(b.key[part_of][1:] != b.key[part_of][:-1]) + 1, len(which)), 0
        while begin < len(which):
            fit = edge[upto[edge - 1] <= (upto[begin - 1] if begin else 0) + TOGETHER]
            end = int(max(fit[-1] if len(fit) else 0, edge[np.searchsorted(edge, begin, "right")]))
            part = part_of[begin:end]
            for i, x in zip(which[begin:end].tolist(), plan.compare([b.strings[i] for i in part], b.n[part], b.least[part], plan.window)):
                lows[i] = x
            begin = end
        by_string: list[np.ndarray] = [None] * len(lows)  # type: ignore[list-item]
        for i, x in zip(order.tolist(), lows):
            by_string[i] = x
        return answered(b, by_string)

    return run


#: Windows that are compared together, unless one minimiser has more.
TOGETHER = 1 << 18


def _covered(plan: Plan, u: Units, did: np.ndarray, hits: list[bytes]) -> np.ndarray:
    """Whether each unit lies in a window that a document with a smaller id has."""
    step = np.zeros(len(u.hashes) + 1, np.int64)
    if hits:
        key, ordinal, at, n, low = (np.concatenate(x) for x in zip(*[buffers.unpacked(b, np.uint64, np.uint32, np.uint16, np.uint16, np.int64) for b in hits]))
        k = skmers(u, plan.window, plan.gram)
        s = strings_of(plan, u, k, np.flatnonzero(_among(k.key, np.unique(key))))
        order = np.lexsort((at, ordinal, key))
        key, ordinal, at, n, low = (x[order] for x in (key, ordinal, at, n, low))
        # Strings are named by the number of their minimiser and by their number under it.
        names, number = np.unique(key, return_inverse=True)
        name = (number << 32) + ordinal.astype(np.int64)
        mine = (np.searchsorted(names, s.key[s.head]) << 32) + s.ordinal
        first, last = np.searchsorted(name, mine, "left"), np.searchsorted(name, mine, "right")
        size = (last - first)[s.string]
        for lo, hi in buffers.runs(np.concatenate([[0], np.cumsum(size)]), 1 << 20):
            occurrence = np.repeat(np.arange(lo, hi), size[lo:hi])
            inner = np.arange(len(occurrence)) - np.repeat(np.cumsum(size[lo:hi]) - size[lo:hi], size[lo:hi])
            run = first[s.string[occurrence]] + inner
            on = low[run] < did[s.row[occurrence]]
            begin, length = s.begin[occurrence[on]] + at[run[on]], n[run[on]].astype(np.int64)
            np.add.at(step, begin, 1)
            np.add.at(step, begin + length + (plan.window - 1), -1)
    return np.cumsum(step[:-1]) > 0


def cover(plan: Plan) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """E: for each text its units, removed units and runs, and the digest of what is kept."""

    def run(t: pa.Table, hits: pa.Table) -> pa.Table:
        if not t.num_rows:
            return SCHEMA.empty_table()
        did, data, offsets, t = _sorted_texts(t)
        u = plan.units(data, offsets)
        gone = _covered(plan, u, did, hits.column("hits").to_pylist())
        rows = np.arange(len(u.first) - 1)
        of = np.repeat(rows, np.diff(u.first))
        removed = np.bincount(of[gone], minlength=len(rows))
        edge = gone.copy()
        edge[1:] &= ~gone[:-1] | (of[1:] != of[:-1])
        spans = np.bincount(of[edge], minlength=len(rows))
        out, keep = data, None
        if u.start is None:
            keep = ~gone
        else:
            # A kept word that another follows keeps the separator after it, written as a space.
            kept = np.flatnonzero(~gone)
            more = np.zeros(len(kept), bool)
            more[:-1] = of[kept[1:]] == of[kept[:-1]]
            step = np.zeros(len(data) + 2, np.int8)
            step[u.start[kept]] += 1
            np.add.at(step, u.end[kept] + more, -1)
            keep = np.cumsum(step[: len(data)], dtype=np.int8) > 0
            out = data.copy()
            out[u.end[kept][more]] = 0x20
        upto = np.concatenate([[0], np.cumsum(keep)])[offsets]
        mem = out[keep].tobytes()
        texts = [mem[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
        return pa.table(
            {
                "doc_id": t.column("doc_id"), "n_units": pa.array(np.diff(u.first)), "n_removed": pa.array(removed), "n_spans": pa.array(spans),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts]), "kept": pa.array(texts, pa.binary()),
            }
        ).cast(SCHEMA)

    return run


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
OUT = "doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def pack_count(docs: DataFrame) -> int:
    got = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    return max(1, -(-got["n"] // PACK), -(-got["b"] // PACK_BYTES))


def pack_of(did, n_packs: int):
    return F.pmod(F.xxhash64(did), F.lit(n_packs)).cast("int")


def packs(docs: DataFrame, n_packs: int, together: bool = False) -> DataFrame:
    """(pid, did, tv, doc_id, text): did orders documents, a null id last. together: rows that share an id lie in one pack, unless it is null."""
    did, tv = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))), F.xxhash64("text")
    spread = F.when(F.col("doc_id").isNotNull(), pack_of(did, n_packs)).otherwise(pack_of(tv, n_packs)) if together else F.pmod(F.xxhash64(did, tv), F.lit(n_packs)).cast("int")
    return docs.select(spread.alias("pid"), did.alias("did"), tv.alias("tv"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def shared(docs: DataFrame, plan_of: Callable[[int, int], Plan]) -> DataFrame:
    """For each document what is left when windows that a document with a smaller id has are removed."""
    n_packs = pack_count(docs)
    plan = plan_of(n_packs // 4 + 8, n_packs // 32 + 8)
    texts = packs(docs, n_packs)
    asked = texts.groupBy("pid").applyInArrow(ask(plan), "bucket int, pid int, keys binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "pid int, keys binary")
    sent = texts.groupBy("pid").cogroup(answers.groupBy("pid")).applyInArrow(send(plan), "bucket int, pid int, strings binary")
    hits = sent.groupBy("bucket").applyInArrow(compare(plan), "pid int, hits binary")
    return texts.groupBy("pid").cogroup(hits.groupBy("pid")).applyInArrow(cover(plan), OUT)
