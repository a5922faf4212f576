"""Plain Python versions of the operators, straight from their contracts."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Texts for the edge cases that every operator has to take.
ODD_TEXTS = [None, "", " \t\n", "x", "é", "12345 67890", "a " * 400, "中文字符", "word " * 30 + "\x0bend\x0c", "A" * 300, "\x00nul\x00 byte"]


def documents(spark, texts, langs=None, sources=None, ids=None):
    rows = [
        (ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", None if t is None else len(t))
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS)


def with_more_columns(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(7) for c in ("size", "slot", "shard", "target", "spans", "words", "n", "h", "pid", "block", "start", "key", "score", "k", "t")})


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def luhn(d: str) -> bool:
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def pii(text: str | None):
    text = text or ""
    out = []
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m, d: 14 <= len(d) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 10 <= len(d) <= 15),
    ]
    for k, (kind, pattern, good) in enumerate(rules):
        for m in re.finditer(pattern, text):
            if good(m[0], re.sub("[^0-9]", "", m[0])):
                out.append((m.start(), k, m.end(), kind))
    out.sort()
    n = [sum(x[3] == r[0] for x in out) for r in rules]
    return *n, sha(",".join(f"{kind}:{s}:{e}" for s, _, e, kind in out))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def decontaminate(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = bench_words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(item)
    lengths = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w, hit, found = bench_words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[x]
        out[doc] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
    return out


def shared_windows(units: dict, n: int):
    """units: id -> sequence. The positions of each that a window of n covers which also starts in a smaller id."""
    first = {}
    for d in sorted(units):
        for i in range(len(units[d]) - n + 1):
            first.setdefault(units[d][i : i + n], d)
    out = {}
    for d, u in units.items():
        gone = [False] * len(u)
        for i in range(len(u) - n + 1):
            if first[u[i : i + n]] < d:
                gone[i : i + n] = [True] * n
        out[d] = gone
    return out


def shingles(text, n=4):
    w = words(ascii_lower(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(ids, links):
    parent = {d: d for d in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {d: top(d) for d in ids}


def jaccard_components(docs, share=85):
    sets = {d: shingles(t) for d, t in docs}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])]
    comp = components(ids, links)
    return {d: (len(sets[d]), comp[d]) for d in ids}
