"""Benchmark decontamination by a distributed positional inverted index.

A window is WINDOW consecutive words of an item, or all words of a shorter item. A first
scan counts the benchmark's terms over all documents; every window then names the LISTS
terms that are rarest in the corpus. A second scan writes the index, postings (term,
document, position) of all those terms, to the shared folder. Each posting is shifted by
the term's offset in the window and the lists meet by (window, document, start): where
all of them give the same start, the window may occur. Those places are compared word
for word with the document, so that phrases are exact; proximity() keeps places where
the rarest terms lie within a distance in any order. Both read the same index.

The benchmark's tables (windows, terms, items) are measured, and broadcast only within a
limit of rows and bytes; beyond it the same joins shuffle. So are the documents with
possible windows. Lists are as short as the corpus allows, because the most frequent
terms of a window are never read; no list is collected to one task, and what a task has
of a place is combined before the shuffle.

Cases: a null text has no words; a text of any length is one row whose words are
unfolded, never collected again; an item without words has no window; a null item id is
written "null"; items with equal texts are all found; repeated rows and rows that share
an id keep their own results (rows are told apart by id and a hash of the text); empty
tables give empty or clean results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_checked, cut, hash60, lower_ascii, table

#: Words of a window, and lists of a window that are intersected.
WINDOW, LISTS = 10, 3
#: What parts words once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS, -1), lambda w: w != "")


def id_key(df: DataFrame) -> list[Column]:
    return [F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("did"), F.xxhash64("text").alias("tv")]


def _wid(terms: Column) -> Column:
    return hash60(F.array_join(terms, " "))


def windows(items: DataFrame, n: int) -> DataFrame:
    """Rows (wid, terms, item): a row for each distinct window of an item."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    w = w.withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - n))))
    w = w.select("item", F.slice("w", F.col("i") + 1, F.lit(n)).alias("terms"))
    return w.select(_wid(F.col("terms")).alias("wid"), "terms", "item").distinct()


def rarest(docs: DataFrame, wins: DataFrame, lists: int) -> DataFrame:
    """Rows (wid, n, need, bit, term, off): the rarest terms of each window that can occur at all, a bit for each."""
    each = wins.select("wid", F.size("terms").alias("n"), F.posexplode("terms").alias("off", "term")).distinct()
    terms = cut(each.select("term").distinct())
    tokens = docs.select(F.explode(words(F.col("text"))).alias("term"))
    counts = cut(tokens.join(broadcast_checked(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    # A window with a term that no document has drops out of this join, as its rows are too few.
    known = each.join(counts, "term").groupBy("wid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "off", "term"))).alias("by_df"))
    known = known.filter(F.size("by_df") == F.col("n")).withColumn("need", F.least(F.lit(lists), F.col("n")))
    picked = known.select("wid", "n", "need", F.posexplode(F.slice("by_df", F.lit(1), F.col("need"))).alias("at", "x"))
    return cut(picked.select("wid", "n", "need", F.expr("shiftleft(1, at)").alias("bit"), F.col("x.term").alias("term"), F.col("x.off").alias("off")))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: (term, did, tv, pos, n_words) for the given terms, over all documents, written to the shared folder."""
    tokens = docs.select(*id_key(docs), words(F.col("text")).alias("w"))
    tokens = tokens.select("did", "tv", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "term"))
    return cut(tokens.join(broadcast_checked(cut(terms.distinct())), "term"))


def places(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """Rows (did, tv, wid, n, start) where all lists of a window give the same start."""
    lists = index.join(broadcast_checked(anchors), "term")
    shifted = lists.withColumn("start", F.col("pos") - F.col("off")).filter((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words")))
    # Repeated rows share did and tv and put each list in once a copy, so lists are counted by their bits.
    met = shifted.groupBy("did", "tv", "wid", "n", "need", "start").agg(F.bit_or("bit").alias("bits"))
    return met.filter(F.col("bits") == F.expr("shiftleft(1, need) - 1")).select("did", "tv", "wid", "n", "start")


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, lists: int = LISTS) -> tuple[DataFrame, DataFrame]:
    """docs with __did and __tv, which tell rows apart, __n_words and __found, the places (start, n, wid) of windows by start; and the windows."""
    texts = docs.select("doc_id", "text")
    wins = cut(windows(items, window))
    anchors = rarest(texts, wins, lists)
    maybe = places(postings(texts, anchors.select("term")), anchors).groupBy("did", "tv").agg(F.array_sort(F.collect_list(F.struct("start", "n", "wid"))).alias("__maybe"))
    maybe = cut(maybe.withColumnsRenamed({"did": "__did", "tv": "__tv"}))
    did, tv = id_key(docs)
    keyed = docs.withColumns({"__did": did, "__tv": tv}).join(broadcast_checked(maybe), ["__did", "__tv"], "left")
    keyed = keyed.withColumn("__w", words(F.col("text")))
    none = "cast(array() as array<struct<start:int,n:int,wid:bigint>>)"
    same = f"coalesce(filter(__maybe, c -> cast(conv(substring(md5(array_join(slice(__w, c.start + 1, c.n), ' ')), 1, 15), 16, 10) as bigint) = c.wid), {none})"
    return keyed.select(*[F.col(f"`{c}`") for c in docs.columns], "__did", "__tv", F.size("__w").cast("long").alias("__n_words"), F.expr(same).alias("__found")), wins


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, lists: int = LISTS) -> DataFrame:
    """For each document: words, hit words, items found and their digest."""
    found, wins = matches(docs.select("doc_id", "text"), items, window, lists)
    covered = F.expr(
        """aggregate(__found, struct(0 as upto, 0L as n), (a, c) -> struct(
             greatest(a.upto, c.start + c.n) as upto, a.n + greatest(0, c.start + c.n - greatest(a.upto, c.start)) as n), a -> a.n)"""
    )
    wids = F.array_distinct(F.transform("__found", lambda c: c["wid"]))
    rows = cut(found.select("doc_id", "__did", "__tv", F.col("__n_words").alias("n_words"), covered.alias("n_hit"), wids.alias("wids")))
    of = cut(wins.select("wid", "item").distinct())
    each = rows.filter("n_hit > 0").select("__did", "__tv", F.explode("wids").alias("wid"))
    named = each.join(broadcast_checked(of), "wid").groupBy("__did", "__tv").agg(F.array_sort(F.collect_set("item")).alias("items"))
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(named, ["__did", "__tv"], "left").select(
        "doc_id", "n_words", "n_hit", F.size(items_).cast("long").alias("n_items"), F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def proximity(docs: DataFrame, items: DataFrame, within: int, window: int = WINDOW, lists: int = LISTS) -> DataFrame:
    """Rows (doc_id, item, start): the rarest terms of a window lie within a number of words, in any order."""
    docs = docs.select("doc_id", "text")
    wins = cut(windows(items, window))
    anchors = rarest(docs, wins, lists)
    lists_ = postings(docs, anchors.select("term")).join(broadcast_checked(anchors), "term")
    # The postings of a window fall into cells of the distance; each is also put into the cell before its own.
    cells = lists_.withColumn("cell", F.explode(F.array(F.expr(f"pos div {within}"), F.expr(f"pos div {within} - 1"))))
    near = cells.groupBy("did", "tv", "wid", "need", "cell").agg(
        F.count_distinct("off").alias("offs"), F.array_sort(F.collect_set(F.struct("pos", "off"))).alias("p")
    )
    # From some posting on, all lists have one within the distance.
    firsts = F.expr(f"transform(filter(p, a -> size(array_distinct(transform(filter(p, b -> b.pos between a.pos and a.pos + {within} - 1), b -> b.off))) >= need), a -> a.pos)")
    got = near.filter(F.col("offs") >= F.col("need")).withColumn("start", F.explode(firsts)).select("did", "tv", "wid", "start").distinct()
    named = got.join(broadcast_checked(cut(wins.select("wid", "item").distinct())), "wid")
    out = named.groupBy("did", "tv", "item").agg(F.min("start").alias("start"))
    return docs.select("doc_id", *id_key(docs)).join(out, ["did", "tv"]).select("doc_id", "item", "start")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
with d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents
), b as (
  select cast(item_id as varchar) as item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark
), win as (
  select distinct item, least(len(w), 10) as n, array_to_string(w[i + 1 : i + 10], ' ') as t
  from (select *, unnest(range(greatest(1, len(w) - 9))) as i from b where len(w) > 0)
), lens as (select distinct n from win),
g as (
  select doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') as t
  from (select doc_id, w, n, unnest(range(len(w) - n + 1)) as i from d, lens where len(w) >= n)
), m as (select g.doc_id, g.i, g.n, win.item from g join win on win.n = g.n and win.t = g.t),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from m) group by doc_id),
k as (select doc_id, count(distinct item) as n_items, sha256(string_agg(item, ',' order by item)) as s from (select distinct doc_id, item from m) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       coalesce(k.s, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h on h.doc_id = d.doc_id left join k on k.doc_id = d.doc_id
"""
