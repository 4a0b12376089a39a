"""From raw documents to training sequences: stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; the last returns the packed pieces.

Nulls, empty and very long texts, ties, repeated rows, empty tables and further columns are treated as each stage says;
no stage fails on them. When a stage begins, what it reads is written, so the tables that the stage before worked with
are deleted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tallywick.llm.common import cut, delete, tracked
from tallywick.llm.exact_dedup import drop_exact_copies
from tallywick.llm.mixing import mixed_rows
from tallywick.llm.near_dedup import drop_near_copies
from tallywick.llm.packing import pack
from tallywick.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_tables: list[str] = []


def _tidy(first: bool = False) -> Callable[[Stage], Stage]:
    """A stage that begins by deleting the tables of the one before; the first leaves those of an earlier run alone."""

    def around(stage: Stage) -> Stage:
        @wraps(stage)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            _tables.clear() if first else delete(spark, _tables)
            with tracked(_tables):
                return stage(spark, docs, sf_dir)

        return run_stage

    return around


@_tidy(first=True)
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject, as learned from those of docs that labels marks.

    Each row is judged by its text alone, so repeated rows stay or go together; null, empty and blank texts are judged by
    the bias alone; without labels of both classes, or for an empty table, all rows stay.
    """
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_tidy()
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the most code points, then with the smallest id.

    Null texts count as empty, and empty texts are one group. Of rows that repeat an id and a text, one stays. A null id
    comes last. An empty table stays empty.
    """
    return drop_exact_copies(docs)


@_tidy()
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Null, empty and blank texts and null ids are no copies and stay. Rows that repeat an id stay or go together. An empty
    table stays empty.
    """
    return drop_near_copies(docs)


@_tidy()
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, so that the sources meet their targets.

    A null source is a source of its own; null ids and repeated ids are rows of their own; texts without words are taken
    with their block. An empty table, or one without words, gives no rows.
    """
    return mixed_rows(docs)


@_tidy()
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences: a row per piece. Null and empty texts are the end id alone; each copy of a
    document is packed by itself. An empty table gives no rows."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixed),
    ("packing", packed),
]

#: Neither the classifier nor the mix is expressible in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result is kept in the shared folder until the next one's is."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        made: list[str] = []
        result = stage(spark, docs, sf_dir)
        with tracked(made):
            docs = cut(result, name)
        delete(spark, held)
        held = made
    return STAGES[-1][1](spark, docs, sf_dir)
