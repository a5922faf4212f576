"""A corpus pipeline from raw documents to a sharded training mix.

Each stage takes (spark, docs, sf_dir) and returns what it kept, written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, jaccard, language, mixing, sharding
from tidemark.llm.common import broadcast_checked, checkpoint_dir, cut, table

#: The near-duplicate stage compares shingles of five words and links from a similarity of 0.8.
SHINGLE, SHARE = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, no letter) go; a missing lang is filled in."""
    model = language.train(docs, language.remainder(4) != 2)
    return docs.mapInArrow(language.keeper(model), docs.schema)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id stays. Rows that share an id are told apart by
    their text, so that each counts with its own; of rows that share both one stays."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    twice = cut(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    n = twice.count()
    keyed = docs.withColumn("__node", F.col("doc_id"))
    if n:
        many = broadcast_checked(twice.withColumn("__many", F.lit(True)), n)
        keyed = docs.join(many, "doc_id", "left").withColumn("__node", F.expr("if(__many, xxhash64(doc_id, text), doc_id)"))
    found = cut(jaccard.near_duplicates(keyed.select(F.col("__node").alias("doc_id"), "text"), SHINGLE, SHARE)).withColumnRenamed("doc_id", "__node")
    if not n:
        gone = found.filter("component_id <> __node").select("__node").distinct()
        return keyed.join(broadcast_checked(gone, gone.count()), "__node", "left_anti").select(names)
    ids = keyed.filter("__node is not null").select("__node", "doc_id").distinct()
    linked = cut(found.filter("__node is not null").select("__node", "component_id").distinct().join(ids, "__node"))
    best = linked.groupBy("component_id").agg(F.min(F.struct("doc_id", "__node")).alias("best"), F.count(F.lit(1)).alias("size"))
    best = cut(best.filter("size > 1").select("component_id", F.col("best.__node").alias("stays")))
    gone = cut(linked.join(broadcast_checked(best, best.count()), "component_id").filter("__node <> stays").select("__node"))
    kept = keyed.join(broadcast_checked(gone, gone.count()), "__node", "left_anti")
    one = kept.filter("__many").select("__node", F.struct(*names).alias("__row")).groupBy("__node").agg(F.min("__row").alias("__row")).select("__row.*")
    return kept.filter("__many is null").select(names).union(one.select(names))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found, _ = decontamination.matches(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("__found") == 0).select([F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes once for each pass that the mix makes over it, the unfinished pass with the words it takes."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign(docs, "doc_id")


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]

#: Language ID learns a model that SQL can't express; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, to = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{to}/{k}")
        docs = spark.read.parquet(f"{to}/{k}")
    return docs
