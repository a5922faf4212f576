"""Language identification of spans.

Words are runs of letters. The ranges of a word's characters give its script, and the
script the languages that can have it: those whose training words have that script in a
share of at least SCRIPT_SHARE. A word's score for a language is the sum of the log
probabilities of its byte trigrams, with the word's ends, under the language. Viterbi
over the words of a text, with a penalty for each change of language, labels spans; a
text's language is that of most of its words, its score their share.

Training counts trigrams of at most SAMPLE texts of each language, chosen by a hash of
the id, on the executors; the table sent to tasks is bounded by languages x 65536.

Trigrams are scored SLICE bytes at a time, also within a text: slices end between words,
and the sums of a word longer than a slice are added up. What stays for a whole text is
one byte for each of its bytes and a row of scores for each of its words.

Cases: a text that is null or has no letter is `und` with score 0; a text whose words
have only scripts of no learned language gets the most frequent language with score 0;
rows without a language train nothing; a null id is held in (no remainder); without any
training row every text is `und`; ties go to the language that sorts first; any number
of languages; very long texts are scored whole; repeated rows give repeated results; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buffers

SAMPLE = 2000
SWITCH = 20.0
SCRIPT_SHARE = 0.005
GRAMS = 1 << 16
#: Bytes handled at once: scoring, and Viterbi.
SLICE, BATCH = 1 << 18, 1 << 21

#: Script classes by first byte of a character: Latin, Greek, Cyrillic, ... Fixed values.
SCRIPTS = np.zeros(256, np.uint8)
SCRIPTS[0x41:0x5B] = SCRIPTS[0x61:0x7B] = SCRIPTS[0xC3:0xCD] = 1
SCRIPTS[0xCD:0xD0], SCRIPTS[0xD0:0xD4], SCRIPTS[0xD4:0xD6] = 2, 3, 4
SCRIPTS[0xD6:0xD8], SCRIPTS[0xD8:0xDC], SCRIPTS[0xDC:0xE0] = 5, 6, 7
SCRIPTS[0xE0], SCRIPTS[0xE1], SCRIPTS[0xE3] = 8, 9, 10
SCRIPTS[0xE4:0xEA], SCRIPTS[0xEA:0xEE], SCRIPTS[0xEE:0xF0], SCRIPTS[0xF0:] = 11, 12, 13, 14
N_SCRIPTS = 18
LETTER = (SCRIPTS > 0) | ((np.arange(256) >= 0x80) & (np.arange(256) < 0xC0))
LETTER[0xE2] = True
#: Script classes of U+2000 to U+2FFF: the letters from U+2C00 to U+2DFF (Glagolitic, Latin, Coptic, Georgian, Tifinagh, Ethiopic, Cyrillic), 0 for signs.
SCRIPTS_E2 = np.zeros(0x1000, np.uint8)
SCRIPTS_E2[0xC00:0xC60], SCRIPTS_E2[0xC60:0xC80], SCRIPTS_E2[0xC80:0xD00], SCRIPTS_E2[0xD00:0xD30] = 15, 1, 16, 9
SCRIPTS_E2[0xD30:0xD80], SCRIPTS_E2[0xD80:0xDE0], SCRIPTS_E2[0xDE0:0xE00] = 17, 9, 3
SCRIPTS_E2[[k for k in range(0xC00, 0xE00) if unicodedata.category(chr(0x2000 + k))[0] in "PSN"]] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _scripts_e2(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Script classes of the characters at the places of 0xE2."""
    second, third = (data[np.minimum(at + k, len(data) - 1)].astype(np.int64) & 0x3F for k in (1, 2))
    return SCRIPTS_E2[second << 6 | third]


def letters(data: np.ndarray) -> np.ndarray:
    """Bytes in lower case (A-Z and the Latin letters of two bytes from U+00C0 on), zero where no letter is."""
    out = np.where(LETTER[data], LOWER[data], np.uint8(0))
    if len(data) and (data >= 0x80).any():
        big = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1
        out[big] += 32
        # Signs, not letters: U+0080 to U+00BF, U+2000 to U+2FFF but for the scripts from U+2C00 to U+2DFF, emoji.
        for lead, length in ((0xC2, 2), (0xE2, 3)):
            at = np.flatnonzero(data == lead)
            if lead == 0xE2:
                at = at[_scripts_e2(data, at) == 0]
            for k in range(length):
                out[np.minimum(at + k, len(data) - 1)] = 0
        at = np.flatnonzero((data[:-1] == 0xF0) & (data[1:] == 0x9F))
        for k in range(4):
            out[np.minimum(at + k, len(data) - 1)] = 0
    return out


def word_bounds(x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of letters x begin and end; none goes over the border of a text."""
    on = np.zeros(len(x) + 2, bool)
    on[1:-1] = x != 0
    begins = on[1:-1] & ~on[:-2]
    inner = offsets[1:-1]
    inner = inner[inner < len(x)]
    begins[inner] |= on[1:-1][inner]
    start = np.flatnonzero(begins)
    last = on[1:-1] & ~on[2:]
    cut_ = inner[(inner > 0)]
    last[cut_ - 1] |= on[1:-1][cut_ - 1]
    return start, np.flatnonzero(last) + 1


def codes(x: np.ndarray, start: np.ndarray, end: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Numbers of the trigrams around the letters of x[lo:hi]; start and end: the words that reach into it."""
    before, after = np.zeros(hi - lo, np.uint32), np.zeros(hi - lo, np.uint32)
    before[lo == 0 :], after[: hi - lo - (hi == len(x))] = x[max(0, lo - 1) : hi - 1], x[lo + 1 : hi + 1]
    before[start[start >= lo] - lo], after[end[end <= hi] - 1 - lo] = 0, 0
    code = (before << np.uint32(16)) | (x[lo:hi].astype(np.uint32) << np.uint32(8)) | after
    return ((code * np.uint32(2654435761)) >> np.uint32(16))[x[lo:hi] != 0]


def slices(start: np.ndarray, end: np.ndarray, most: int) -> Iterator[tuple[int, int, int, int]]:
    """(lo, hi, first word, end of words): ranges of bytes of about `most`, which only cut words that are longer themselves."""
    w, n = 0, len(start)
    while w < n:
        lo = int(start[w])
        until = max(w + 1, int(np.searchsorted(end, lo + most, "right")))
        hi = int(end[until - 1])
        for a in range(lo, hi, most) if until == w + 1 else [lo]:
            yield a, min(hi, a + most) if until == w + 1 else hi, w, until
        w = until


def word_scripts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.empty(0, np.uint8)
    of, at = SCRIPTS[data], np.flatnonzero(data == 0xE2)
    of[at] = _scripts_e2(data, at)
    return np.maximum.reduceat(of, start)


def counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) to (lang, gram, n); grams from GRAMS on count words by script."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        data, offsets = buffers.utf8(batch.column(0))
        for row, lang in enumerate(batch.column(1).to_pylist()):
            raw = data[offsets[row] : offsets[row + 1]]
            x = letters(raw)
            start, end = word_bounds(x, np.array([0, len(raw)]))
            got = totals.setdefault(lang, np.zeros(GRAMS + N_SCRIPTS, np.int64))
            for lo, hi, a, b in slices(start, end, SLICE):
                got[:GRAMS] += np.bincount(codes(x, start[a:b], end[a:b], lo, hi), minlength=GRAMS)
            if len(start):
                got[GRAMS:] += np.bincount(word_scripts(np.where(x > 0, raw, 0), start, start), minlength=N_SCRIPTS)
    for lang, got in totals.items():
        on = np.flatnonzero(got)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(on), pa.string()), "gram": pa.array(on.astype(np.int32)), "n": pa.array(got[on])})


class Model:
    """langs, log probabilities (langs x GRAMS), and which scripts a language has."""

    def __init__(self, langs: list[str], counts: np.ndarray, frequent: int, switch: float = SWITCH):
        self.langs, self.frequent, self.switch = langs, frequent, switch
        of = counts[:, :GRAMS].astype(np.float64)
        self.logs = np.log((of + 0.5) / (of.sum(axis=1, keepdims=True) + 0.5 * GRAMS)).astype(np.float32)
        words = counts[:, GRAMS:].astype(np.float64)
        self.has = words / np.maximum(1, words.sum(axis=1, keepdims=True)) >= SCRIPT_SHARE

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: where it begins, its scores by language, and whether any language has its script."""
        x = letters(data)
        start, end = word_bounds(x, offsets)
        out = np.zeros((len(start), len(self.langs)), np.float32)
        if not len(start):
            return start, out, np.empty(0, bool)
        for lo, hi, a, b in slices(start, end, SLICE):
            code = codes(x, start[a:b], end[a:b], lo, hi)
            size = np.minimum(end[a:b], hi) - np.maximum(start[a:b], lo)
            at = np.concatenate([[0], np.cumsum(size)[:-1]])
            for k, log in enumerate(self.logs):
                out[a:b, k] += np.add.reduceat(log[code], at)
        can = self.has[:, word_scripts(np.where(x > 0, data, 0), start, start)].T
        known = can.any(axis=1)
        np.copyto(out, np.float32(-1e4), where=~can)
        out[~known] = 0
        return start, out, known


def label_type(n: int) -> np.dtype:
    """What holds the numbers of n languages."""
    return np.min_scalar_type(max(0, n - 1))


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word; first: the first word of each text, and the end. All texts advance together."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begin, n = first[:-1][order], n[order]
    steps = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(1, steps + 1), "right") if steps else []
    best_before = np.zeros(len(scores), label_type(scores.shape[1]))
    stays = np.ones(scores.shape, bool)
    ends = np.zeros(len(n), label_type(scores.shape[1]))
    now = None
    for t in range(steps):
        k = live[t]
        at = begin[:k] + t
        if t:
            now = now[:k]
            top = now.argmax(axis=1)
            best = now[np.arange(k), top][:, None] - np.float32(switch)
            best_before[at] = top
            stays[at] = now >= best
            now = np.maximum(now, best) + scores[at]
            now -= now.max(axis=1, keepdims=True)
        else:
            now = scores[at].copy()
        low = live[t + 1] if t + 1 < steps else 0
        if low < k:
            ends[low:k] = now[low:].argmax(axis=1)
    out = np.zeros(len(scores), label_type(scores.shape[1]))
    if steps:
        state = ends.copy()
        for t in range(steps - 1, -1, -1):
            k = live[t]
            at = begin[:k] + t
            s = state[:k]
            out[at] = s
            if t:
                state[:k] = np.where(stays[at, s], s, best_before[at])
    return out


def label_words(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """viterbi(), but only for texts that a change of language can gain anything.

    Against a text's best language B, let no run of words gain over a penalty by another language: a path with k
    runs outside B and a word of B gains at most k penalties and pays at least k changes. Let also the words' best
    gains, summed over the text, be no more than 0: a path without a word of B gains nothing. Then B is best.
    """
    n = np.diff(first)
    sums = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0, dtype=np.float64)])
    best = (sums[first[1:]] - sums[first[:-1]]).argmax(axis=1)
    text_of = np.repeat(np.arange(len(n)), n)
    own = scores[np.arange(len(scores)), best[text_of]]
    gain, most = np.zeros(len(n)), np.full(len(scores), -np.inf)
    on = np.flatnonzero(n)
    for k in range(scores.shape[1]):
        d = scores[:, k] - own
        most = np.maximum(most, np.where(best[text_of] == k, -np.inf, d))
        upto = np.cumsum(d, dtype=np.float64)
        # A running minimum that starts anew with each text: every text lies lower than all before it.
        lower = text_of * (2.0 * np.abs(upto).max(initial=0.0) + 1.0)
        low = np.minimum.accumulate(upto - d - lower)
        rise = upto - lower - low
        if len(on):
            gain[on] = np.maximum(gain[on], np.maximum.reduceat(rise, first[on]))
    out = best.astype(label_type(scores.shape[1]))[text_of]
    if scores.shape[1] > 1 and len(on):
        gain[on] = np.where(np.add.reduceat(most, first[on], dtype=np.float64) > 0, np.inf, gain[on])
    mixed = np.flatnonzero(gain > switch)
    if len(mixed):
        words = np.concatenate([np.arange(first[i], first[i + 1]) for i in mixed])
        out[words] = viterbi(scores[words], np.concatenate([[0], np.cumsum(n[mixed])]), switch)
    return out


def _labels(model: Model, data: np.ndarray, offsets: np.ndarray):
    """Word starts, labels, known words, and the first word of each text."""
    starts, scores, known = [], [], []
    for i, j in buffers.runs(offsets, SLICE):
        lo = offsets[i]
        s, c, k = model.scores(data[lo : offsets[j]], offsets[i : j + 1] - lo)
        starts.append(s + lo), scores.append(c), known.append(k)
    start = np.concatenate(starts) if starts else np.empty(0, np.int64)
    score = np.concatenate(scores) if scores else np.empty((0, len(model.langs)), np.float32)
    known = np.concatenate(known) if known else np.empty(0, bool)
    first = np.searchsorted(start, offsets)
    return start, label_words(score, first, model.switch), known, first


def _has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def predict(model: Model | None, column) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of an Arrow column."""
    all_data, all_offsets = buffers.utf8(column)
    pred, score = [], [np.empty(0)]
    for i, j in buffers.runs(all_offsets, BATCH):
        lo = all_offsets[i]
        data, offsets = all_data[lo : all_offsets[j]], all_offsets[i : j + 1] - lo
        if model is None:
            pred += ["und"] * (j - i)
            score.append(np.zeros(j - i))
            continue
        _, label, known, first = _labels(model, data, offsets)
        text_of = np.repeat(np.arange(j - i), np.diff(first))
        n = np.bincount(text_of[known] * len(model.langs) + label[known].astype(np.int64), minlength=(j - i) * len(model.langs)).reshape(j - i, -1)
        best, total = n.argmax(axis=1), n.sum(axis=1)
        ascii_ = np.concatenate([[0], np.cumsum((SCRIPTS[data] == 1) & (data < 0x80), dtype=np.int32)])[offsets]
        names = np.where(total > 0, np.array(model.langs, object)[best], model.langs[model.frequent])
        for row in np.flatnonzero(np.diff(ascii_) == 0):
            if not _has_letter(data[offsets[row] : offsets[row + 1]].tobytes()):
                names[row] = "und"
                n[row] = 0
        pred += names.tolist()
        score.append(n.max(axis=1) / np.maximum(1, n.sum(axis=1)))
    return pred, np.concatenate(score)


def predictor(model: Model | None):
    """(doc_id, text, held_out) to (doc_id, held_out, lang_pred, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = predict(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def keeper(model: Model | None):
    """Whole rows of documents that have a language; a missing lang is the predicted one. Without a model no row goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                yield batch
                continue
            text, lang = batch.schema.get_field_index("text"), batch.schema.get_field_index("lang")
            # Rows go out in parts, so that a batch is not held twice.
            for i, j in buffers.runs(buffers.utf8(batch.column(text))[1], BATCH):
                part = batch.slice(i, j - i)
                pred = pa.array(predict(model, part.column(text))[0], pa.string())
                part = part.set_column(lang, batch.schema.field(lang), pc.coalesce(part.column(lang), pred.cast(batch.schema.field(lang).type)))
                yield part.filter(pc.not_equal(pred, "und"))
            pa.default_memory_pool().release_unused()

    return run


def span_finder(model: Model):
    """(id, text) to (id, at, length, lang): byte ranges of spans of one language, from word to word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers.utf8(batch.column(1))
            start, label, _, first = _labels(model, data, offsets)
            text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
            new = np.ones(len(start), bool)
            new[1:] = (label[1:] != label[:-1]) | (text_of[1:] != text_of[:-1])
            at = np.flatnonzero(new)
            ends = np.append(start[at[1:]], offsets[-1]) if len(at) else start[at]
            ends = np.minimum(ends, offsets[text_of[at] + 1])
            begins = start[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(text_of[at])), pa.array((begins - offsets[text_of[at]]).astype(np.int64)), pa.array((ends - begins).astype(np.int64)), pa.array([model.langs[k] for k in label[at]], pa.string())],
                names=["doc_id", "at", "length", "lang"],
            )

    return run


def train(docs: DataFrame, may_train: Column, sample: int = SAMPLE, switch: float = SWITCH) -> Model | None:
    rows = docs.select("doc_id", "text", "lang").filter(may_train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    share = F.lit(0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1 << 20, -(-sample * (1 << 20) // sizes[lang])))).otherwise(share)
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) < share).select("text", "lang")
    counted = chosen.mapInArrow(counter, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(langs), GRAMS + N_SCRIPTS), np.int64)
    counts[counted["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy(np.int64), counted["gram"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    return Model(langs, counts, max(range(len(langs)), key=lambda i: (sizes[langs[i]], -i)), switch)


def identify(docs: DataFrame, model: Model | None, held_out: Column) -> DataFrame:
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return rows.mapInArrow(predictor(model), "doc_id long, held_out boolean, lang_pred string, score double")


def spans(docs: DataFrame, model: Model) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(span_finder(model), "doc_id long, at long, length long, lang string")


def remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op8(spark: SparkSession, docs: DataFrame) -> DataFrame:
    model = train(docs, remainder(4) != 2)
    return identify(docs, model, F.coalesce(remainder(4) == 2, F.lit(False)))
