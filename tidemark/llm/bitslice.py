"""Exact top-k search over a bit-sliced index.

Components are quantised to integers. A block of vectors, sorted by id, is turned into
bit slices: for each dimension and bit, a bitmap over the block's rows. A query's inner
product is a sum of slices shifted by the set bits of its components (a negative
component takes complemented slices and a constant), added for all rows at once with
carry-save adders. Rows are chosen from the most significant slice of the sum downward:
rows with the bit set go ahead while they are no more than k, else only they stay in the
race. Rows still level after the last slice have equal scores; the smallest ids win.

The index of a block is a few megabytes and is built once; blocks of queries meet blocks
of the index in cells of a bounded size, and the k best of each cell meet by query. Query
blocks are as large as index blocks where there are many queries, since the index travels
once for each, and smaller where there would be fewer than CELLS cells.

Cases: vectors that are null or hold null or non-finite components, and rows without an
id, take no part; of rows that share an id the smallest vector counts; a shorter vector
counts as padded with zeros; components and sums are exact whatever their size, and a score
that no long can hold is an error; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_ROWS, BLOCK_QUERIES, FEWEST_QUERIES, CELLS = 65536, 8192, 512, 64


def pack(bits: np.ndarray) -> np.ndarray:
    """Bits by row to little-endian words of 64 rows, the last one padded."""
    n = bits.shape[-1]
    padded = np.zeros((*bits.shape[:-1], -(-n // 64) * 64), np.uint8)
    padded[..., :n] = bits
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)


def build(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """values: rows by dimensions. Slices, the first slice of each dimension (and the end), and what each has less."""
    low = values.min(axis=0)
    above = values - low
    bits = [int(x).bit_length() for x in above.max(axis=0)]
    first = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)
    slices = [pack((above[:, d] >> b & 1).astype(np.uint8)) for d, n in enumerate(bits) for b in range(n)]
    return np.array(slices, np.uint64).reshape(len(slices), -(-len(values) // 64)), first, low


def add(slices: np.ndarray, levels: list[list[int]]) -> list[np.ndarray]:
    """The sum of slices, each counted at its levels, as slices from the least significant one up."""
    out, carried, level = [], [], 0
    while level < len(levels) or carried:
        rows = [slices[levels[level]]] if level < len(levels) and levels[level] else []
        rows, carried = np.concatenate(rows + carried) if rows or carried else None, []
        while rows is not None and len(rows) > 1:
            k = len(rows) // 3
            if k:
                a, b, c = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k]
                half = a ^ b
                carried.append((a & b) | (half & c))
                rows = np.concatenate([half ^ c, rows[3 * k :]])
            else:
                carried.append(rows[:1] & rows[1:2])
                rows = rows[:1] ^ rows[1:2]
        out.append(np.zeros(slices.shape[1], np.uint64) if rows is None else rows[0])
        level += 1
    return out


def select(total: list[np.ndarray], race: np.ndarray, k: int) -> np.ndarray:
    """The rows of the k largest sums among those in race; ties to the smaller row."""
    ahead = np.zeros_like(race)
    count = lambda x: int(np.bitwise_count(x).sum())
    if count(race) > k:
        for s in reversed(total):
            up = ahead | (race & s)
            n = count(up)
            if n > k:
                race = race & s
            else:
                ahead, race = up, race & ~s
                if n == k:
                    race = np.zeros_like(race)
                    break
    rows = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    first = rows(ahead)
    return np.concatenate([first, rows(race)[: k - len(first)]])


def search(slices: np.ndarray, first: np.ndarray, low: list[int], n: int, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores of the k best of a block; own: the query's row in it, or -1. slices: followed by their complements."""
    half, levels, constant = len(slices) // 2, [], 0
    for d, q in enumerate(query[: len(low)]):
        q = int(q)
        constant += q * int(low[d])
        bits = int(first[d + 1] - first[d])
        if q < 0:
            constant += q * ((1 << bits) - 1)
        at, q = int(first[d]) + (half if q < 0 else 0), abs(q)
        for j in range(q.bit_length()):
            if q >> j & 1:
                while len(levels) < j + bits:
                    levels.append([])
                for b in range(bits):
                    levels[j + b].append(at + b)
    total = add(slices, levels)
    every = np.zeros(slices.shape[1] * 64, np.uint8)
    every[:n] = 1
    if own >= 0:
        every[own] = 0
    got = select(total, np.packbits(every, bitorder="little").view(np.uint64), k)
    scores = [constant] * len(got)
    for level, s in enumerate(total):
        for i in np.flatnonzero(s[got >> 6] >> (got & 63).astype(np.uint64) & np.uint64(1)):
            scores[i] += 1 << level
    if any(not -(2**63) <= x < 2**63 for x in scores):
        raise OverflowError("a score of op3 does not fit a long")
    return got, np.array(scores, np.int64)


def _matrix(arrays: pd.Series) -> np.ndarray:
    """Rows of whole numbers: longs, or Python's integers where the range of a block could leave a long."""
    out = np.zeros((len(arrays), max(map(len, arrays), default=0)))
    for i, a in enumerate(arrays):
        out[i, : len(a)] = a
    if np.abs(out).max(initial=0.0) < 2.0**61:
        return out.astype(np.int64)
    return np.array([[int(x) for x in row] for row in out.tolist()], object)


def _build_block(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("vec_id", kind="stable")
    slices, first, low = build(_matrix(rows["q"]))
    ids = rows["vec_id"].to_numpy(np.int64)
    return pd.DataFrame({"rb": [rows["rb"].iloc[0]], "ids": [ids.tobytes()], "slices": [slices.tobytes()], "first": [first.tobytes()], "low": [" ".join(map(str, low.tolist())).encode()]})


def _searcher(k: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [(np.empty(0, np.int64),) * 3]
        if len(index) and len(queries):
            x = index.iloc[0]
            ids, first = (np.frombuffer(x[c], np.int64) for c in ("ids", "first"))
            low = [int(v) for v in x["low"].split()]
            slices = np.frombuffer(x["slices"], np.uint64).reshape(int(first[-1]), -(-len(ids) // 64))
            slices = np.concatenate([slices, ~slices])
            for query_id, q in zip(queries["vec_id"], queries["q"]):
                at = int(np.searchsorted(ids, query_id))
                own = at if at < len(ids) and ids[at] == query_id else -1
                rows, scores = search(slices, first, low, len(ids), q, own, k)
                out.append((np.full(len(rows), query_id), ids[rows], scores))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    return run


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """Rows (vec_id, q) of the vectors that take part."""
    x = vectors.select("vec_id", "embedding").filter("vec_id is not null and embedding is not null")
    x = x.filter("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    # Whole numbers as doubles, which hold any component exactly; from 2**53 on every double is whole.
    y = f"({scale}D * cast(x as double))"
    q = F.expr(f"transform(embedding, x -> if(abs({y}) < {2**53}D, cast(floor({y}) as double), {y}))")
    return x.select("vec_id", q.alias("q")).groupBy("vec_id").agg(F.min("q").alias("q"))


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The k best other vectors of each query: query_id, rank, vec_id, score."""
    rows = quantised(vectors, scale)
    total = vectors.count()
    asked, nr = vectors.filter(is_query).count(), max(1, -(-total // block_rows))
    nq = max(1, -(-asked // block_queries), min(-(-asked // FEWEST_QUERIES), -(-CELLS // nr)))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    index = rows.withColumn("rb", part(nr)).groupBy("rb").applyInPandas(_build_block, "rb int, ids binary, slices binary, first binary, low binary")
    index = index.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    queries = rows.filter(is_query).withColumn("qb", part(nq)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(nr - 1))))
    found = index.groupBy("rb", "qb").cogroup(queries.groupBy("rb", "qb")).applyInPandas(_searcher(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    return top_k(vectors, F.col("vec_id") % 20 == 0)


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as double)) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as query_id, b.vec_id, cast(list_inner_product(a.q, b.q) as bigint) as score
  from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20
"""
