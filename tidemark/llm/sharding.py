"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: it starts
at an offset and advances by a skip, both hashed from the shard's name, so that its
order visits every slot once. Shards take turns; at its turn a shard claims the first
slot of its order that is still free. A row's key hashes to a slot, the slot names the
shard: placement is one lookup in a table whose size is a parameter, never the data's.
Adding or removing a shard moves few keys, and no shard holds over one slot more than
another.

Cases: a null key is placed as the key "\\0null"; a key of any length is hashed whole;
equal keys, and so repeated rows, go to the same shard; an empty table gives an empty
result; other columns are kept as they are, one with the name of a new column as
"input_" and that name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash60

#: Shards and slots of the registered query; the slots are prime and over 100 to a shard.
SHARDS = 32
SLOTS = 4093
NULL_KEY = "\0null"


def _hash60(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def preference(shard: int, slots: int) -> tuple[int, int]:
    return _hash60(f"{shard}:offset") % slots, _hash60(f"{shard}:skip") % (slots - 1) + 1


def fill(shards: int, slots: int) -> list[int]:
    """The slot table: for each slot the shard that claimed it."""
    if shards < 1 or slots < shards or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime of at least the number of shards")
    orders = [preference(s, slots) for s in range(shards)]
    turn_of, table, claimed = [0] * shards, [-1] * slots, 0
    while True:
        for shard, (offset, skip) in enumerate(orders):
            slot = (offset + turn_of[shard] * skip) % slots
            while table[slot] >= 0:
                turn_of[shard] += 1
                slot = (offset + turn_of[shard] * skip) % slots
            table[slot] = shard
            turn_of[shard] += 1
            claimed += 1
            if claimed == slots:
                return table


def slot_table(spark: SparkSession, shards: int, slots: int) -> DataFrame:
    """The filled table as rows (slot, shard)."""
    values = ",".join(map(str, fill(shards, slots)))
    return spark.sql(f"select posexplode(from_json('[{values}]', 'array<int>')) as (slot, shard)")


def slot_of(key: Column, slots: int) -> Column:
    return (hash60(F.coalesce(key.cast("string"), F.lit(NULL_KEY))) % slots).cast("int")


def assign(df: DataFrame, key: str, shards: int = SHARDS, slots: int = SLOTS, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """df with the columns slot and shard; a column of df that has one of these names goes on as input_slot or input_shard."""
    places = slot_table(df.sparkSession, shards, slots).toDF("__slot", "__shard")
    out = df.withColumn("__place", slot_of(F.col(key), slots)).join(F.broadcast(places), F.col("__place") == F.col("__slot"))
    kept = [F.col(f"`{c}`").alias(f"input_{c}" if c in (slot, shard) else c) for c in df.columns]
    return out.select(*kept, F.col("__slot").alias(slot), F.col("__shard").alias(shard))


def write_shards(df: DataFrame, key: str, path: str, shards: int = SHARDS, slots: int = SLOTS, files_per_shard: int = 8) -> None:
    """Write one folder for each shard; a salt spreads a shard over several tasks and files."""
    out = assign(df, key, shards, slots, shard="shard")
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in out.columns]), F.lit(files_per_shard))
    out.repartition(F.col("shard"), salt).write.partitionBy("shard").mode("errorifexists").parquet(path)


def op1(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return assign(docs.select("doc_id"), "doc_id")


def oracle(shards: int = SHARDS, slots: int = SLOTS) -> str:
    """The same fill as a recursive query: one claim for each step."""
    h = lambda text: f"cast(('0x' || substr(md5({text}), 1, 15)) as bigint)"
    return f"""
with recursive pref as (
  select list({h("s || ':offset'")} % {slots} order by s) as offs, list({h("s || ':skip'")} % {slots - 1} + 1 order by s) as skips
  from (select cast(range as integer) as s from range({shards}))
), fill(t, slot, taken, nxt) as (
  select 0, cast(-1 as bigint), list_transform(range({slots}), lambda x: false), list_transform(range({shards}), lambda x: cast(0 as bigint))
  union all
  select t + 1, (o + j * k) % {slots},
         list_concat(list_concat(taken[1:(o + j * k) % {slots}], [true]), taken[(o + j * k) % {slots} + 2:]),
         list_concat(list_concat(nxt[1:t % {shards}], [j + 1]), nxt[t % {shards} + 2:])
  from (
    select t, taken, nxt, offs[t % {shards} + 1] as o, skips[t % {shards} + 1] as k,
           list_filter(range(nxt[t % {shards} + 1], {slots}), lambda j: not taken[(offs[t % {shards} + 1] + j * skips[t % {shards} + 1]) % {slots} + 1])[1] as j
    from fill, pref where t < {slots}
  )
), places as (select cast(slot as integer) as slot, cast((t - 1) % {shards} as integer) as shard from fill where t > 0)
select d.doc_id, p.slot, p.shard
from documents d join places p on p.slot = {h("coalesce(cast(d.doc_id as varchar), chr(0) || 'null')")} % {slots}
"""
