"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chroma, classify, fertility, licenses, mixing, neardup, packing, pii, substrings
from .common import table


def _documents(operator: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": lambda spark, d: classify.quality(table(spark, d, "documents"), table(spark, d, "labels")),
        "op2_toxicity": lambda spark, d: classify.toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
        "op3_mixing": _documents(mixing.query),
        "op4_fertility": _documents(fertility.judge),
        "op5_suffix_array": _documents(substrings.remove_repeats),
        "op6_best_fit": _documents(packing.best_fit),
        "op7_licenses": _documents(licenses.scan),
        "op8_chroma": lambda spark, d: chroma.query(table(spark, d, "conversations")),
        "op9_pii": _documents(pii.scan),
        "op10_jaccard_join": _documents(neardup.linked),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.query_oracle(), "op7_licenses": licenses.oracle()}
