"""Change events to mutations of a keyed cache, and the state that these leave."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import contains_unchanged, parsed_object, render_parsed

MUTATION = "array<struct<kind:string,key:string,value:string,ttl_seconds:bigint>>"


@dataclass(frozen=True)
class Rule:
    """mode: "invalidate" deletes keys; "upsert" writes the new row image under its key."""

    table: str
    key: str
    mode: str = "upsert"
    ttl_seconds: int | None = None


def _mutation(kind: str, key, value=None, ttl: int | None = None):
    return F.struct(
        F.lit(kind).alias("kind"), key.alias("key"), (F.lit(None).cast("string") if value is None else value).alias("value"), F.lit(ttl).cast("long").alias("ttl_seconds")
    )


IMAGES = ("key_json", "before_json", "after_json")


def _mapped(rule: Rule, index: int):
    """A struct (rule_index, error, mutations) from a row with parsed images."""
    keys = {c: render_parsed(rule.key, F.col(f"__{c}")) for c in IMAGES}
    some = lambda *c: F.array_distinct(F.array_compact(F.array(*[keys[x] for x in c])))
    none = F.lit(None).cast(MUTATION)
    deletes = lambda found: F.transform(found, lambda k: _mutation("del", k)).cast(MUTATION)
    drop = (F.col("operation") == "delete") if rule.mode == "upsert" else F.lit(True)
    # Keys of the images are made once for each rule and event, and only for events of the rule's table.
    made = F.struct(some(*IMAGES).alias("every"), some("key_json", "before_json").alias("old"), keys["after_json"].alias("target"))

    def out(k):
        error = (
            F.when(F.col("operation") == "truncate", "truncate")
            .when(F.col("__bad"), "image is no object")
            .when(drop & (F.size(k["every"]) == 0), "no key")
            .when(drop, None)
            .when(F.col("after_json").isNull(), "no new image")
            .when(contains_unchanged(F.col("after_json")), "unchanged value")
            .when(k["target"].isNull(), "no key")
            .when((F.col("operation") == "update") & (F.size(k["old"]) == 0), "no old key")
        )
        sets = F.concat(deletes(F.filter(k["old"], lambda x: x != k["target"])), F.array(_mutation("set", k["target"], F.col("after_json"), rule.ttl_seconds)).cast(MUTATION))
        found = lambda e: F.when(e.isNotNull(), none).when(drop, deletes(k["every"])).otherwise(sets)
        one = F.transform(F.array(error), lambda e: F.struct(F.lit(index).alias("rule_index"), e.alias("error"), found(e).alias("mutations")))
        return F.element_at(one, 1)

    return F.element_at(F.transform(F.array(made), out), 1)


def map_events(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """events (with schema_name, table_name, key_json, ...) once for each rule of their table, with rule_index and mutations, or an error.

    One pass: each image is parsed once, whatever the number of rules.
    """
    if not rules:
        return events.filter(F.lit(False)).withColumns({"rule_index": F.lit(0), "error": F.lit(None).cast("string"), "mutations": F.lit(None).cast(MUTATION)})
    name = F.concat_ws(".", "schema_name", "table_name")
    rows = events.filter(name.isin(*{r.table for r in rules})).withColumn("__name", name)
    rows = rows.withColumns({f"__{c}": parsed_object(F.col(c)) for c in IMAGES})
    rows = rows.withColumn("__bad", reduce(lambda a, b: a | b, [F.col(c).isNotNull() & F.col(f"__{c}").isNull() for c in IMAGES]))
    found = F.array_compact(F.array(*[F.when(F.col("__name") == r.table, _mapped(r, i)) for i, r in enumerate(rules)]))
    rows = rows.withColumn("__m", F.explode(found))
    return rows.select(*events.columns, F.col("__m.rule_index").alias("rule_index"), F.col("__m.error").alias("error"), F.col("__m.mutations").alias("mutations"))


def mutations(mapped: DataFrame) -> DataFrame:
    """A row for each mutation, in the order (sequence, rule_index, pos)."""
    return mapped.filter("error is null").select("sequence", "rule_index", F.posexplode("mutations").alias("pos", "m")).select("sequence", "rule_index", "pos", "m.*")


def last_mutations(changes: DataFrame) -> DataFrame:
    """The last mutation of each key (key, kind, value, ttl_seconds, sequence). A hot key is combined before the shuffle."""
    last = changes.groupBy("key").agg(F.max_by(F.struct("kind", "value", "ttl_seconds", "sequence"), F.struct("sequence", "rule_index", "pos")).alias("x"))
    return last.select("key", "x.*")


def final_state(changes: DataFrame) -> DataFrame:
    """The last mutation of each key, where it is a write."""
    return last_mutations(changes).filter("kind = 'set'").select("key", "value", "ttl_seconds", "sequence")
