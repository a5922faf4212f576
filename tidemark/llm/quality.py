"""Quality classifier: a byte-level convolutional network in numpy.

WIDTH consecutive bytes meet FILTERS learned filters. A filter's response at a place is a
sum of table entries, one for each byte of the window, so that embedding and convolution
are one lookup. A text is covered by chunks of CHUNK places (chunks overlap by WIDTH - 1
bytes, so that no window is lost); each chunk keeps the largest response of each filter.
The largest and the mean of its chunks' responses, through tanh, give one probability.

Training takes at most SAMPLE labelled texts, chosen by a hash of the id, on the driver,
one text of each id: gradients reach only the places that won the pooling, so a step is
small. Scoring is one pass over the Arrow buffers of all
texts, whole: responses are made and pooled BLOCK chunks at a time, also within a text,
so that a text of any length costs two bytes for each of its own.

Cases: an empty or null text gets the probability of no response at all; a null id is
not held out and trains nothing; of several labels of an id the highest counts, of
several texts of an id the smallest; without labels every score is 0.5; a score of
exactly THRESHOLD is predicted 1; very long texts are scored whole; repeated rows give
repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buffers
from .language import remainder

WIDTH, FILTERS, CHUNK = 5, 8, 256
SAMPLE, EPOCHS, RATE, THRESHOLD = 2000, 6, 0.15, 0.3
#: Bytes of texts handled together, and chunks whose responses are held at once.
SLICE, BLOCK = 1 << 15, 128


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.out = rng.normal(0, 0.3, 2 * FILTERS)
        self.bias = 0.0

    def chunks(self, data: np.ndarray, offsets: np.ndarray, places: bool = False):
        """Pooled responses of all chunks of the texts, the first chunk of each text, and where in the padded bytes each maximum was."""
        size = np.diff(offsets)
        # Zeros that a text's last windows read belong to its last chunk.
        n = np.where(size > 0, -(-(size + WIDTH - 1) // CHUNK), 0)
        first = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        total = int(first[-1]) * CHUNK
        if not total:
            return np.empty((0, FILTERS), np.float32), first, None
        padded = np.zeros(total + WIDTH, np.uint8)
        texts = [(int(f) * CHUNK, int(o), int(k)) for f, o, k in zip(first, offsets, size) if k]
        for to, at, k in texts:
            padded[to : to + k] = data[at : at + k]
        # Where a text's bytes end in its chunks; what follows has no response.
        ends = np.clip(np.repeat(size, n) - (np.arange(first[-1]) - np.repeat(first[:-1], n)) * CHUNK, 0, CHUNK)
        pooled, at = np.empty((int(first[-1]), FILTERS), np.float32), np.empty((int(first[-1]), FILTERS), np.int64) if places else None
        for lo in range(0, int(first[-1]), BLOCK):
            hi = min(int(first[-1]), lo + BLOCK)
            index = padded[lo * CHUNK : hi * CHUNK + WIDTH].astype(np.intp)
            z, more = np.empty(((hi - lo) * CHUNK, FILTERS), np.float32), np.empty(((hi - lo) * CHUNK, FILTERS), np.float32)
            np.take(self.table[0], index[: len(z)], axis=0, out=z, mode="clip")
            for w in range(1, WIDTH):
                np.take(self.table[w], index[w : len(z) + w], axis=0, out=more, mode="clip")
                z += more
            z = z.reshape(-1, CHUNK, FILTERS)
            for c in np.flatnonzero(ends[lo:hi] < CHUNK):
                z[c, ends[lo + c] :] = -1e9
            if places:
                at[lo:hi] = z.argmax(axis=1)
                pooled[lo:hi] = np.take_along_axis(z, at[lo:hi, None, :], 1)[:, 0, :]
            else:
                pooled[lo:hi] = z.max(axis=1)
        # The last chunk of a text may hold only those zeros: it is none.
        real = -(-size // CHUNK)
        kept = np.arange(len(pooled)) - np.repeat(first[:-1], n) < np.repeat(real, n)
        where = ((at + np.arange(len(pooled))[:, None] * CHUNK)[kept], padded) if places else None
        return pooled[kept], np.concatenate([[0], np.cumsum(real)]).astype(np.int64), where

    def features(self, pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.zeros((len(first) - 1, 2 * FILTERS))
        on = np.flatnonzero(np.diff(first))
        if len(on):
            out[on, :FILTERS] = np.maximum.reduceat(pooled, first[on], axis=0)
            out[on, FILTERS:] = np.add.reduceat(pooled, first[on], axis=0) / np.diff(first)[on, None]
        return np.tanh(out)

    def probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        pooled, first, _ = self.chunks(data, offsets)
        return 1 / (1 + np.exp(-(self.features(pooled, first) @ self.out + self.bias)))

    def fit(self, texts: list[bytes], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> Network:
        """Adagrad, a text at a time; classes weigh the same."""
        rng = np.random.default_rng(seed)
        labels = np.asarray(labels)
        weight = {y: len(labels) / (2 * max(1, int((labels == y).sum()))) for y in (0, 1)}
        seen_t, seen_o, seen_b = np.full(self.table.shape, 1e-3, np.float32), np.full(2 * FILTERS, 1e-3), 1e-3
        raw = [np.frombuffer(t, np.uint8) for t in texts]
        for _ in range(epochs):
            for i in rng.permutation(len(raw)):
                pooled, first, where = self.chunks(raw[i], np.array([0, len(raw[i])]), places=True)
                h = self.features(pooled, first)[0]
                error = (1 / (1 + np.exp(-(h @ self.out + self.bias))) - labels[i]) * weight[labels[i]]
                back = error * self.out * (1 - h * h)
                go, gb = error * h, error
                if len(pooled):
                    # A chunk's maximum takes the mean's share, the text's largest also the maximum's.
                    to = np.repeat(back[None, FILTERS:] / len(pooled), len(pooled), axis=0)
                    to[pooled.argmax(axis=0), np.arange(FILTERS)] += back[:FILTERS]
                    at, padded = where
                    begin = at.ravel()
                    f, g = np.tile(np.arange(FILTERS), len(pooled)), to.ravel()
                    for w in range(WIDTH):
                        grad = np.bincount(padded[begin + w].astype(np.int64) * FILTERS + f, g, 256 * FILTERS).reshape(256, FILTERS).astype(np.float32)
                        seen_t[w] += grad * grad
                        self.table[w] -= np.float32(rate) * grad / np.sqrt(seen_t[w])
                seen_o += go * go
                seen_b += gb * gb
                self.out -= rate * go / np.sqrt(seen_o)
                self.bias -= rate * gb / np.sqrt(seen_b)
        return self


def scorer(network: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers.utf8(batch.column(1))
            got = [np.empty(0)]
            for i, j in buffers.runs(offsets, SLICE):
                lo = offsets[i]
                got.append(np.full(j - i, 0.5) if network is None else network.probability(data[lo : offsets[j]], offsets[i : j + 1] - lo))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(got))], names=["doc_id", "held_out", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, may_train: Column, label: str = "quality", sample: int = SAMPLE) -> Network | None:
    marked = labels.select("doc_id", F.col(label).alias("y")).filter(may_train & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    share = F.lit(0)
    for y, n in sizes.items():
        share = F.when(F.col("y") == y, F.lit(min(1 << 20, -(-(sample // 2) * (1 << 20) // n)))).otherwise(share)
    chosen = marked.filter(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20)) < share)
    # The sample is bounded: the side that is broadcast has about `sample` ids, what comes back a text for each.
    texts = docs.select("doc_id", "text").filter(may_train).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    rows = texts.toPandas().sort_values("doc_id")
    return Network().fit([(t or "").encode() for t in rows["text"]], rows["y"].tolist()) if len(rows) else None


def score(docs: DataFrame, network: Network | None, held_out: Column) -> DataFrame:
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    out = rows.mapInArrow(scorer(network), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op5(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    network = train(docs, labels, remainder(5) != 0)
    return score(docs, network, F.coalesce(remainder(5) == 0, F.lit(False)))
