"""Mixing sources to target weights.

The words of a source, its documents in a fixed order, are packed into blocks of a fixed
number of words. A source takes a number of slots in the mix that gives it its target of
words. Then, step by step:

1  draw(): every output shard draws how many of its slots each source gets, from the
   multinomial law conditioned on the sources' totals: the sources' tickets are dealt to
   shards by a pseudorandom permutation, and counted. (Unconditioned draws would leave
   small sources off their targets by the square root of their slots.)
2  slots(): a source's slots are numbered through the shards by those counts. Slot j is
   mapped through the source's own pseudorandom permutation of block numbers, so that
   each pass over a source takes every block once; a shard's slots are put in an order of
   their own by a permutation of the shard.
3  Slots join blocks by number: mixed_blocks() is the mix itself, block after block with
   its text, mix_documents() counts what it takes of each document, mixed_documents()
   repeats documents by pass.

The permutations are swap-or-not shuffles: each round reflects an index and swaps the pair
or not by a hashed bit, which permutes any range without tables.

Targets: all sizes are shared by weight; a source's target stops at CAP times its size
and the excess is reshared by weight, which is a water level found from sums over
sources sorted by the level at which they fill.

Prefix sums have two levels: (source, chunk of hashed rows), then chunks of a source; and
(source, run of shards), then runs of a source. A hot source is spread over as many chunks
as its table's rows ask for, CHUNKS at least. Windows without a partition run over one row
for each source only.

Cases: a null text or one without words has size 0 and takes nothing; the null source is
a source, last in order; documents of a chunk (by id and bytes) are in the order of id, size and a hash of
the text, so that ties are between equal rows only, which take the same words in either
order; repeated rows, also of one id, are documents of their own; very long texts are cut
at the borders of blocks like all others; an empty table gives an empty result; other
columns are not read, but for mixed_documents(), which hands them on.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, hash60


@dataclass(frozen=True)
class Mix:
    block_words: int = 256
    shard_slots: int = 1024
    weights: tuple[int, ...] = (1, 2, 3)
    cap: int = 3
    #: Chunks of a source at least, and rows of a table for each chunk where it has more.
    chunks: int = 1024
    chunk_rows: int = 1 << 18
    rounds: int = 8
    #: Slots made by one row (longer runs of slots are split over rows first), and shards of a run.
    run: int = 8192
    shard_run: int = 4096

    def fit(self, docs: DataFrame) -> Mix:
        """With as many chunks as the rows of docs ask for."""
        return replace(self, chunks=max(self.chunks, -(-docs.count() // self.chunk_rows)))


def _shuffle(seed: str, n: str, x: str, rounds: int, back: bool = False) -> str:
    """SQL: a permutation of [0, n) applied to x, or its inverse."""
    order = f"sequence({rounds - 1}, 0)" if back else f"sequence(0, {rounds - 1})"
    k = f"cast(conv(substring(md5(concat({seed}, ':', r)), 1, 15), 16, 10) as bigint) % {n}"
    return f"""aggregate({order}, cast({x} as bigint), (x, r) ->
      if(ascii(md5(concat({seed}, ':', r, ':', greatest(x, pmod({k} - x, {n}))))) % 2 = 1, pmod({k} - x, {n}), x))"""


def _sized(docs: DataFrame, mix: Mix, keep: list[str]) -> DataFrame:
    """Each document with its size, source key, a hash of the text and its chunk."""
    tv = F.coalesce(F.md5("text"), F.lit(""))
    chunk = hash60(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), "tv"), "bytes")) % mix.chunks
    keep = [*keep, *(c for c in docs.columns if c == "__tie")]
    sized = docs.select(
        "doc_id",
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col("source").isNull().cast("int").alias("snull"),
        F.coalesce("source", F.lit("")).alias("src"),
        tv.alias("tv"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("string").alias("bytes"),
        *keep,
    )
    return sized.withColumn("chunk", chunk.cast("int")).drop("bytes")


def _keyed(docs: DataFrame, mix: Mix, keep: list[str]) -> DataFrame:
    """Each document with its number within the chunk and the words before it in the chunk."""
    sized = _sized(docs, mix, keep)
    within = Window.partitionBy("snull", "src", "chunk").orderBy("doc_id", "size", "tv", *(c for c in sized.columns if c == "__tie"))
    return sized.withColumn("rn", F.row_number().over(within)).withColumn("before", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))


def _chunks(docs: DataFrame, mix: Mix) -> DataFrame:
    """One row for each source and chunk: its words."""
    return _sized(docs, mix, []).groupBy("snull", "src", "chunk").agg(F.sum("size").alias("words"))


def _sources(chunks: DataFrame, mix: Mix) -> DataFrame:
    """One row for each source: its size, target and slots."""
    total, b = Window.partitionBy(), mix.block_words
    s = chunks.groupBy("snull", "src").agg(F.sum("words").alias("n"))
    weights = F.array(*[F.lit(w) for w in mix.weights])
    s = s.withColumn("w", F.element_at(weights, (F.row_number().over(Window.orderBy("snull", "src")) - 1) % len(mix.weights) + 1))
    s = s.withColumn("all_words", F.sum("n").over(total)).withColumn("fills", F.col("n") * float(mix.cap) / F.col("w"))
    level = Window.orderBy("fills", "snull", "src")
    s = s.withColumn("filled", F.coalesce(F.sum(F.col("n") * mix.cap).over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("open", F.sum("w").over(level.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("all_words") - F.col("filled")) / F.col("open").cast("double"))
    s = s.withColumn("water", F.min(F.when(F.col("level") <= F.col("fills"), F.struct("fills", "snull", "src", "level"))).over(total)["level"])
    s = s.withColumn("target", F.coalesce(F.least(F.col("n") * float(mix.cap), F.col("w") * F.col("water")), F.lit(0.0)))
    s = s.withColumn("take", F.least(F.round("target").cast("long"), F.col("n") * mix.cap))
    s = s.withColumn("blocks", F.expr(f"(n + {b - 1}) div {b}")).withColumn("last_words", F.expr(f"n - (blocks - 1) * {b}"))
    s = s.withColumn("passes", F.expr("if(n = 0, 0, take div n)")).withColumn("rest", F.expr("take - passes * n"))
    s = s.withColumn("last_at", F.expr(f"if(n = 0, 0, {_shuffle(_SEED, 'greatest(blocks, 1)', 'greatest(blocks - 1, 0)', mix.rounds, back=True)})"))
    # Slots of the unfinished pass: those that begin before its words are complete.
    s = s.withColumn("rest_slots", F.expr(f"if(rest = 0, 0, if(last_at < (rest + {b - 1}) div {b}, (rest + {b} - last_words + {b - 1}) div {b}, (rest + {b - 1}) div {b}))"))
    s = s.withColumn("rest_slots", F.expr("least(rest_slots, blocks)")).withColumn("slots", F.expr("passes * blocks + rest_slots"))
    before = Window.orderBy("snull", "src").rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("slots_before", F.coalesce(F.sum("slots").over(before), F.lit(0))).withColumn("all_slots", F.sum("slots").over(total))


_SEED = "concat('source:', snull, ':', src)"


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """A stated number of partitions, which Spark does not merge: a few rows are small, what they unfold to is not."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _unfolded(sources: DataFrame, n: str, keys: list[str], mix: Mix) -> DataFrame:
    """A row j for each of the first n numbers; sources with many are split over rows first."""
    runs = sources.filter(f"{n} > 0").withColumn("first", F.expr(f"explode(sequence(0, ({n} - 1) div {mix.run}))"))
    return _spread(runs, *keys, "first").withColumn("j", F.expr(f"explode(sequence(first * {mix.run}, least({n}, (first + 1) * {mix.run}) - 1))"))


def draw(sources: DataFrame, mix: Mix) -> DataFrame:
    """Rows (snull, src, shard, draws): how many slots of a shard a source gets."""
    ticket = F.expr(f"{_shuffle(repr('mix'), 'all_slots', 'slots_before + j', mix.rounds)} div {mix.shard_slots}")
    tickets = _unfolded(sources.select("snull", "src", "slots", "slots_before", "all_slots"), "slots", ["snull", "src"], mix)
    return tickets.groupBy("snull", "src", ticket.alias("shard")).agg(F.count(F.lit(1)).alias("draws"))


def slots(sources: DataFrame, mix: Mix) -> DataFrame:
    """The mix: a row for each slot with its output shard and position, source, pass, block and words taken."""
    b, run = mix.block_words, f"shard div {mix.shard_run}"
    drawn = draw(sources, mix).withColumn("run", F.expr(run))
    # A source's slots before a shard, and a shard's slots before a source: sums of runs, then within.
    by_run = Window.partitionBy("snull", "src").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    runs = drawn.groupBy("snull", "src", "run").agg(F.sum("draws").alias("all")).withColumn("run_start", F.sum("all").over(by_run) - F.col("all")).drop("all")
    within = Window.partitionBy("snull", "src", "run").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    beside = Window.partitionBy("shard").orderBy("snull", "src").rowsBetween(Window.unboundedPreceding, 0)
    drawn = drawn.withColumn("upto", F.sum("draws").over(within) - F.col("draws")).withColumn("at", F.sum("draws").over(beside) - F.col("draws"))
    drawn = drawn.join(runs.hint("merge"), ["snull", "src", "run"]).withColumn("from", F.expr("run_start + upto"))
    drawn = drawn.join(sources.select("snull", "src", "blocks", "last_words", "passes", "rest", "last_at", "all_slots"), ["snull", "src"])
    j = _spread(drawn, "snull", "src", "shard").withColumn("k", F.expr("explode(sequence(0L, draws - 1))")).withColumn("j", F.expr("`from` + k"))
    j = j.withColumn("pass", F.expr("j div blocks")).withColumn("i", F.expr("j % blocks"))
    j = j.withColumn("block", F.expr(_shuffle(_SEED, "blocks", "i", mix.rounds)))
    j = j.withColumn("block_size", F.expr(f"if(block = blocks - 1, last_words, {b})"))
    j = j.withColumn("had", F.expr(f"i * {b} - if(last_at < i, {b} - last_words, 0)"))
    j = j.withColumn("words", F.expr("if(pass < passes, block_size, greatest(0, least(block_size, rest - had)))"))
    size = f"least({mix.shard_slots}, all_slots - shard * {mix.shard_slots})"
    j = j.withColumn("position", F.expr(f"shard * {mix.shard_slots} + " + _shuffle("concat('shard:', shard)", f"({size})", "at + k", mix.rounds)))
    return j.select("snull", "src", "pass", "passes", "block", "block_size", "words", "position", "shard")


def _placed(docs: DataFrame, mix: Mix, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sources, and documents with the words before them in their source."""
    # Both are small and read often: a row for each chunk, a row for each source.
    chunks = cut(_chunks(docs, mix))
    sources = cut(_sources(chunks, mix))
    prefix = Window.partitionBy("snull", "src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    starts = chunks.withColumn("chunk_start", F.sum("words").over(prefix) - F.col("words")).drop("words")
    starts = starts.join(sources.select("snull", "src", F.col("n").alias("source_size"), "target", "passes"), ["snull", "src"])
    return sources, _keyed(docs, mix, keep).join(starts.hint("merge"), ["snull", "src", "chunk"]).withColumn("start", F.expr("chunk_start + before"))


def _pieces(docs: DataFrame, mix: Mix) -> DataFrame:
    """Documents cut at the borders of their source's blocks and joined with the slots that take them."""
    b = mix.block_words
    sources, placed = _placed(docs, mix, [])
    cutup = placed.withColumn("block", F.expr(f"explode_outer(if(size > 0, sequence(start div {b}, (start + size - 1) div {b}), cast(null as array<bigint>)))"))
    cutup = cutup.withColumn("lo", F.expr(f"greatest(start, block * {b}) - block * {b}")).withColumn("len", F.expr(f"least(start + size, (block + 1) * {b}) - greatest(start, block * {b})"))
    taken = slots(sources, mix).groupBy("snull", "src", "block").agg(
        F.coalesce(F.sum(F.when(F.col("words") == F.col("block_size"), 1)), F.lit(0)).alias("whole"),
        F.max(F.when(F.col("words") < F.col("block_size"), F.col("words")).otherwise(0)).alias("cut"),
        F.min("shard").alias("first_shard"),
        F.max(F.when(F.col("pass") == F.col("passes"), F.col("words")).otherwise(0)).alias("rest_words"),
    )
    # Estimates of unfolded rows are far too low: without the hint, what grows with the corpus would be broadcast.
    return cutup.join(taken.hint("merge"), ["snull", "src", "block"], "left")


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """For each document: its size, its source's size and target, the words that the mix takes from it, and the first shard that has some, or -1."""
    mix = mix.fit(docs)
    p = _pieces(docs.select("doc_id", "text", "source"), mix)
    words = F.expr("whole * len + greatest(0, least(cut, lo + len) - lo)")
    out = p.groupBy("snull", "src", "chunk", "rn", "doc_id", "size", "source_size", "target").agg(
        F.coalesce(F.sum(words), F.lit(0)).alias("taken"), F.coalesce(F.min("first_shard"), F.lit(-1)).alias("first_shard")
    )
    return out.select("doc_id", "size", "source_size", "target", "taken", "first_shard")


def op2(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mix_documents(docs)


def mixed_blocks(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: (shard, position, source, pass, words, text), a row for each slot, its words joined by one space."""
    b, mix = mix.block_words, mix.fit(docs)
    sources, placed = _placed(docs.select("doc_id", "text", "source"), mix, ["text"])
    found, blocks = f"regexp_extract_all(text, '{WORD}', 0)".replace("\\", "\\\\"), f"sequence(start div {b}, (start + size - 1) div {b})"
    # A document's words are found once, then sliced into the pieces of its blocks.
    piece = f"struct(k as block, chunk, rn, slice(w, cast(greatest(start, k * {b}) - start as int) + 1, cast(least(start + size, (k + 1) * {b}) - greatest(start, k * {b}) as int)) as piece)"
    pieces = placed.filter("size > 0").select("snull", "src", F.expr(f"inline(transform(array({found}), w -> transform({blocks}, k -> {piece}))[0])"))
    parts = pieces.groupBy("snull", "src", "block").agg(F.array_sort(F.collect_list(F.struct("chunk", "rn", "piece"))).alias("parts"))
    texts = parts.select("snull", "src", "block", F.expr("flatten(transform(parts, x -> x.piece))").alias("w"))
    out = slots(sources, mix).join(texts.hint("merge"), ["snull", "src", "block"])
    return out.select("shard", "position", F.expr("if(snull = 1, cast(null as string), src)").alias("source"), "pass", "words", F.expr("array_join(slice(w, 1, cast(words as int)), ' ')").alias("text"))


def write_blocks(docs: DataFrame, path: str, mix: Mix = Mix()) -> None:
    """mixed_blocks() as files in the order of positions, so that reading them in turn reads the mix."""
    mixed_blocks(docs, mix).repartitionByRange("position").sortWithinPartitions("position").write.parquet(path)


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix as rows of documents: each document once for every whole pass over its source, and once more,
    with the words that the unfinished pass takes, where that pass takes any. Columns are those of docs."""
    mix = mix.fit(docs)
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    # Rows with equal texts may differ elsewhere: a hash of the whole row orders them.
    row = docs.select("doc_id", "text", "source", F.xxhash64(F.to_json(row)).alias("__tie"), row.alias("__row"))
    p = _pieces(row.drop("__row"), mix)
    part = F.expr("struct(cast(lo + block * {b} - start as int) as at, cast(greatest(0, least(coalesce(rest_words, 0), lo + len) - lo) as int) as n)".format(b=mix.block_words))
    p = p.filter("size > 0").withColumn("part", part)
    parts = p.groupBy("snull", "src", "chunk", "rn", "passes", "size").agg(F.array_sort(F.collect_list(F.when(F.col("part.n") > 0, F.col("part")))).alias("parts"))
    joined = _keyed(row, mix, ["__row"]).drop("size", "before", "tv", "__tie").join(parts.hint("merge"), ["snull", "src", "chunk", "rn"])
    rest = F.expr("aggregate(parts, 0, (t, x) -> t + x.n)")
    some = F.expr(
        "case when rest = size then __row.text else array_join(flatten(transform(parts, x -> slice(words, x.at + 1, x.n))), ' ') end"
    )
    joined = joined.withColumn("rest", rest)
    words = F.when((F.col("rest") > 0) & (F.col("rest") < F.col("size")), F.expr(f"regexp_extract_all(__row.text, '{WORD}', 0)".replace("\\", "\\\\")))
    joined = joined.withColumn("words", words).withColumn("some", F.when(F.col("rest") > 0, some))
    texts = F.expr("concat(array_repeat(__row.text, cast(passes as int)), if(some is null, array(), array(some)))")
    out = joined.withColumn("__text", F.explode(texts))
    new = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return out.select(*[(new[c] if c in new else F.col(f"__row.`{c}`")).alias(c) for c in names])


def oracle(mix: Mix = Mix()) -> str:
    b = mix.block_words
    h = lambda t: f"cast(('0x' || substr(md5({t}), 1, 15)) as bigint)"

    def rounds(source: str, seed: str, n: str, x: str, out: str, back: bool = False) -> str:
        inner = f"(select *, cast({x} as bigint) as x from {source})"
        for r in reversed(range(mix.rounds)) if back else range(mix.rounds):
            y = f"((({h(f'{seed} || chr(58) || {r}')} % {n}) - x) % {n} + {n}) % {n}"
            inner = f"(select * exclude (y) replace (case when ascii(md5({seed} || ':{r}:' || greatest(x, y))) % 2 = 1 then y else x end as x) from (select *, {y} as y from {inner}))"
        return f"(select * exclude (x), x as {out} from {inner})"

    seed = "'source:' || snull || ':' || src"
    return f"""
with d as (
  select doc_id, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
         cast(source is null as integer) as snull, coalesce(source, '') as src, coalesce(md5(text), '') as tv, {h("coalesce(cast(doc_id as varchar), md5(text), '') || ':' || coalesce(strlen(text), 0)")} % {mix.chunks} as chunk
  from documents
), p as (
  select *, cast(sum(size) over (partition by snull, src order by chunk, doc_id, size, tv rows unbounded preceding) as bigint) - size as start,
         row_number() over (partition by snull, src order by chunk, doc_id, size, tv) as rn
  from d
), s0 as (
  select snull, src, cast(sum(size) as bigint) as n, [{", ".join(map(str, mix.weights))}][(row_number() over (order by snull, src) - 1) % {len(mix.weights)} + 1] as w from d group by snull, src
), s1 as (
  select *, n * {float(mix.cap)} / w as fills, cast(sum(n) over () as bigint) as all_words from s0
), s2 as (
  select *, (all_words - coalesce(sum(n * {mix.cap}) over (order by fills, snull, src rows between unbounded preceding and 1 preceding), 0))
            / cast(sum(w) over (order by fills, snull, src rows between current row and unbounded following) as double) as level from s1
), s3 as (
  select *, coalesce(least(n * {float(mix.cap)}, w * (select arg_min(level, (fills, snull, src)) from s2 where level <= fills)), 0.0) as target from s2
), s4 as (
  select snull, src, cast(n as bigint) as n, target, least(cast(round(target) as bigint), cast(n * {mix.cap} as bigint)) as take, cast((n + {b - 1}) // {b} as bigint) as blocks from s3
), s5 as (
  select *, n - (blocks - 1) * {b} as last_words, case when n = 0 then 0 else take // n end as passes from s4
), s6 as (select *, take - passes * n as rest from s5),
s7 as (select * from {rounds("s6 where n > 0", seed, "blocks", "blocks - 1", "last_at", back=True)}),
slot as (
  select *, j // blocks as pass, j % blocks as i from (select *, unnest(range((passes + 1) * blocks)) as j from s7)
), slot1 as (select * from {rounds("slot", seed, "blocks", "i", "block")}),
slot2 as (
  select *, case when block = blocks - 1 then last_words else {b} end as block_size, i * {b} - case when last_at < i then {b} - last_words else 0 end as had from slot1
), slot3 as (
  select *, case when pass < passes then block_size else greatest(0, least(block_size, rest - had)) end as words from slot2
), slot4 as (select *, row_number() over (order by snull, src, j) - 1 as q, count(*) over () as all_slots from slot3 where words > 0),
ticket as (select snull, src, position // {mix.shard_slots} as shard from {rounds("slot4", "'mix'", "all_slots", "q", "position")}),
drawn as (
  select *, sum(draws) over (partition by snull, src order by shard rows unbounded preceding) - draws as before from (select snull, src, shard, count(*) as draws from ticket group by all)
), slot5 as (
  select s.*, d.shard from slot4 s join drawn d on d.snull = s.snull and d.src = s.src and s.j >= d.before and s.j < d.before + d.draws
), t as (
  select snull, src, block, count(*) filter (words = block_size) as whole, max(case when words < block_size then words else 0 end) as cut, min(shard) as first_shard from slot5 group by all
), piece as (
  select *, greatest(start, block * {b}) - block * {b} as lo, least(start + size, (block + 1) * {b}) - greatest(start, block * {b}) as len
  from (select *, unnest(range(start // {b}, (start + greatest(size, 1) - 1) // {b} + 1)) as block from p)
), got as (
  select p.snull, p.src, p.rn, sum(t.whole * p.len + greatest(0, least(t.cut, p.lo + p.len) - p.lo)) as taken, min(t.first_shard) filter (p.len > 0) as first_shard
  from piece p left join t on t.snull = p.snull and t.src = p.src and t.block = p.block group by all
)
select p.doc_id, p.size, s.n as source_size, s.target, cast(coalesce(g.taken, 0) as bigint) as taken, cast(coalesce(g.first_shard, -1) as bigint) as first_shard
from p join s4 s on s.snull = p.snull and s.src = p.src join got g on g.snull = p.snull and g.src = p.src and g.rn = p.rn
"""
