import hashlib
import random

import brute
import numpy as np
from tidemark.llm import substring, suffixes, windows

WORDS = ["ab", "the", "x" * 9, "é", "of", "and", "zz", "q1", "lorem", "ipsum"]


def texts_with_repeats(seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(20, 150))) for _ in range(12)]
    out = [*brute.ODD_TEXTS, "ab" * 400, "ab" * 300 + "c", "a b " * 200]
    for _ in range(60):
        w = rng.choice(base).split(" ")
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append(rng.choice([" ", "\n", "  "]).join(w[rng.randrange(5) :]) + " " + " ".join(rng.choice(base).split(" ")[:70]))
    return out


def test_bytes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(windows, "PACK", 9)
    monkeypatch.setattr(suffixes, "BATCH", 500)
    texts = texts_with_repeats(1)
    got = {r.doc_id: r for r in suffixes.op7(spark, brute.with_more_columns(brute.documents(spark, texts))).collect()}
    units = {i: (t or "").encode() for i, t in enumerate(texts)}
    for i, gone in brute.shared_windows(units, 50).items():
        runs = sum(x and not (j and gone[j - 1]) for j, x in enumerate(gone))
        kept = hashlib.sha256(bytes(b for b, x in zip(units[i], gone) if not x)).hexdigest()
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(gone), sum(gone), runs, kept)


def test_words_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(windows, "PACK", 9)
    texts = texts_with_repeats(2)
    got = {r.doc_id: r for r in substring.op6(spark, brute.with_more_columns(brute.documents(spark, texts))).collect()}
    units = {i: tuple(brute.words(t)) for i, t in enumerate(texts)}
    for i, gone in brute.shared_windows(units, 50).items():
        kept = brute.sha(" ".join(w for w, x in zip(units[i], gone) if not x))
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(gone), sum(gone), kept)


def test_ids_null_and_repeated(spark):
    text = "one two three " * 30
    docs = brute.documents(spark, [text, text, text, None], ids=[5, 5, None, None])
    rows = sorted((str(r.doc_id), r.n_removed) for r in suffixes.op7(spark, docs).collect())
    assert rows == [("5", 0), ("5", 0), ("None", 0), ("None", len(text))]
    assert suffixes.op7(spark, brute.documents(spark, [])).collect() == []
    assert substring.op6(spark, brute.documents(spark, [])).collect() == []


def level(rng, n, window=8):
    text = rng.integers(97, 100, n + window - 1).astype(np.uint8)
    keys = np.lib.stride_tricks.sliding_window_view(text, window)
    _, at = np.unique(np.ascontiguousarray(keys).view(f"S{window}").ravel(), return_index=True)
    return text, at


def test_family_levels_grow_geometrically(monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 7)
    rng = np.random.default_rng(0)
    family, seen = suffixes.Family(), {}
    for d in range(64):
        text, at = level(rng, 30)
        new = suffixes.Level(text, at, np.full(len(at), d), 8)
        keys = new.keys(slice(None))
        got = family.scan(keys)
        assert got.tolist() == [seen.get(k, windows.LAST) for k in keys.tolist()]
        on = got == windows.LAST
        seen |= {k: d for k in keys[on].tolist()}
        family.add(suffixes.Level(text, at[on], np.full(int(on.sum()), d), 8))
        assert all(x.upto(k) == int((x.keys(slice(None)) <= k).sum()) for x in family.levels for k in keys[:3])
    sizes = [len(x) for x in family.levels]
    assert len(sizes) <= 9 and all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    for x in family.levels:
        keys = x.keys(slice(None))
        assert (keys[1:] > keys[:-1]).all() and [seen[k] for k in keys.tolist()] == x.first.tolist()
        back = suffixes.Level.unpacked(x.packed(), 8)
        assert (back.keys(slice(None)) == keys).all()


def test_batches_added_to_an_index_equal_brute_force(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(windows, "PACK", 9)
    monkeypatch.setattr(suffixes, "BATCH", 500)
    texts = texts_with_repeats(5)
    units = {i: (t or "").encode() for i, t in enumerate(texts)}
    want = brute.shared_windows(units, 50)
    index, got, most = suffixes.Index(spark, str(tmp_path / "index"), buckets=5), {}, 0
    for lo in range(0, len(texts), 13):
        ids = list(range(lo, min(lo + 13, len(texts))))
        got |= {r.doc_id: r for r in index.add(brute.documents(spark, [texts[i] for i in ids], ids=ids)).collect()}
        index = suffixes.Index.open(spark, str(tmp_path / "index"))
        most = max(most, len(index.levels))
    assert 1 < most <= 4 and all(a > 2 * b for (_, a), (_, b) in zip(index.levels, index.levels[1:]))
    assert sum(n for _, n in index.levels) == len({u[i : i + 50] for u in units.values() for i in range(len(u) - 49)})
    for i, gone in want.items():
        kept = hashlib.sha256(bytes(b for b, x in zip(units[i], gone) if not x)).hexdigest()
        assert (got[i].n_units, got[i].n_removed, got[i].kept_sha256) == (len(gone), sum(gone), kept)


def test_one_passage_in_every_document(spark, monkeypatch):
    """A hot minimiser: its windows are many and in all packs, in several strings."""
    monkeypatch.setattr(windows, "PACK", 5)
    monkeypatch.setattr(windows, "TOGETHER", 30)
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(70))
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(40))) + f" {passage} " + " ".join(rng.choice(WORDS) for _ in range(rng.randrange(40))) for _ in range(80)]
    texts += ["a" * 300] * 9 + ["a" * 200 + "b"] * 3
    for op, of, join in ((substring.op6, lambda t: tuple(brute.words(t)), lambda x: " ".join(x).encode()), (suffixes.op7, str.encode, bytes)):
        got = {r.doc_id: r for r in op(spark, brute.documents(spark, texts)).collect()}
        units = {i: of(t) for i, t in enumerate(texts)}
        for i, gone in brute.shared_windows(units, 50).items():
            kept = hashlib.sha256(join([x for x, y in zip(units[i], gone) if not y])).hexdigest()
            assert (got[i].n_removed, got[i].kept_sha256) == (sum(gone), kept)


def test_equal_hashes_of_unlike_strings_are_told_apart(monkeypatch):
    monkeypatch.setattr(windows.Sums, "of", lambda self, start, end: np.zeros(len(start), np.uint64))
    raw = [b"a" * 60, b"a" * 59 + b"b", b"a" * 60, b"c" * 60]
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.arange(5) * 60
    u = windows.byte_units(data, ends)
    k = windows.skmers(u, 50, 20)
    s = windows.strings_of(suffixes._plan(1), u, k, np.arange(len(k.at)))
    texts = [data[a : a + n + 49].tobytes() for a, n in zip(s.begin, s.n)]
    assert [texts[h] for h in s.head[s.string]] == texts
    assert len({(x, y) for x, y in zip(s.key[s.head].tolist(), (texts[h] for h in s.head))}) == len(s.head)


def test_very_long_text(spark):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000))
    rows = substring.op6(spark, brute.documents(spark, [long, "x " + long, None])).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed) for r in rows] == [(200_000, 0), (200_001, 200_000), (0, 0)]
    rows = suffixes.op7(spark, brute.documents(spark, [long, "x " + long, None])).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed) for r in rows] == [(len(long), 0), (len(long) + 2, len(long)), (0, 0)]
