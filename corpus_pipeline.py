"""A training corpus from raw documents, stage by stage; part of the llm subpackage.

Quality rules drop documents, the n-gram Jaccard join leaves one of each group, personal data is masked, sources are mixed to
target weights (documents of short leaves come again, those of long leaves fall to the budget), and what is left is packed.
Every stage gives an empty table for an empty one, takes texts of any length and columns of any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm import fertility, mixing, neardup, packing, pii
from quarrylight.llm.common import discard, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the rules pass, with all their columns; null and empty texts go. Repeated rows are judged one by one."""
    return fertility.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, with all its columns; texts without words stay, once for each doc_id."""
    return neardup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in text replaced by its kind; a null text stays null, n_chars follows."""
    return pii.mask(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their leaf's budget takes them, with all their columns; a null lang or source is a leaf of its own."""
    return mixing.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document; null and empty texts give one piece."""
    return packing.best_fit(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("sequences", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every other stage's rows are written and read again, and deleted when the next ones are there."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenisers and Python parsers are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None
