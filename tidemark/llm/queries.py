"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bitslice, decontamination, jaccard, language, mixing, pii, quality, sharding, substring, suffixes
from .common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda f: lambda spark, d: f(spark, table(spark, d, "documents"))
    return {
        "op1_sharding": docs(sharding.op1),
        "op2_mixing": docs(mixing.op2),
        "op3_bitslice_topk": lambda spark, d: bitslice.op3(spark, table(spark, d, "embeddings")),
        "op4_decontamination": decontamination.op4,
        "op5_quality": lambda spark, d: quality.op5(spark, table(spark, d, "documents"), table(spark, d, "labels")),
        "op6_substring_dedup": docs(substring.op6),
        "op7_suffix_dedup": docs(suffixes.op7),
        "op8_language": docs(language.op8),
        "op9_pii": docs(pii.op9),
        "op10_jaccard_join": docs(jaccard.op10),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_sharding": sharding.oracle(),
        "op2_mixing": mixing.oracle(),
        "op3_bitslice_topk": bitslice.ORACLE,
        "op4_decontamination": decontamination.ORACLE,
        "op6_substring_dedup": substring.ORACLE,
        "op7_suffix_dedup": suffixes.ORACLE,
        "op9_pii": pii.oracle(),
        "op10_jaccard_join": jaccard.ORACLE,
    }
