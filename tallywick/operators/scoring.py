"""Detected spans against labels: which overlap, and which lie inside one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Offsets are cut into cells of this many characters; a span and a label that overlap share one.
CELL = 256


def _cells(df: DataFrame, page: list[str], prefix: str) -> DataFrame:
    """df under a prefix, with a row for each cell that [start, end) touches."""
    named = df.select(*page, *[F.col(c).alias(prefix + c) for c in df.columns if c not in page])
    first, last = (F.floor(F.col(prefix + c) / CELL) for c in ("start", "end"))
    return named.withColumn("_cell", F.explode(F.sequence(first, F.greatest(first, last))))


def overlaps(spans: DataFrame, labels: DataFrame, page: tuple[str, ...] = ("doc_id",), inside: bool = False) -> DataFrame:
    """Pairs of a span and a label of one page that overlap, or with ``inside`` whose span lies in the label.

    Both have start and end. They meet by page and cell, so that a page with many of either is no single group; a pair
    that shares several cells counts in the first of them only.
    """
    keys = list(page)
    both = _cells(spans, keys, "s_").join(_cells(labels, keys, "l_"), [*keys, "_cell"])
    meets: Column = (F.col("l_start") <= F.col("s_start")) & (F.col("s_end") <= F.col("l_end")) if inside else (F.col("s_start") < F.col("l_end")) & (F.col("l_start") < F.col("s_end"))
    once = F.col("_cell") == F.floor(F.greatest("s_start", "l_start") / CELL)
    return both.filter(meets & once).drop("_cell")
