"""Text files about runs: JSON lines, allow lists, and tables within Markdown."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(spark: SparkSession, path: str, schema: T.StructType, key: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Rows of JSON lines; blank lines are none, a line that is no JSON is an error. With a key, the last row of each by
    ``order`` stays, as in an append-only log of answers."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if not key:
        return rows
    kept = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), order).alias("row"))
    return kept.select("row.*")


def allow_list(spark: SparkSession, path: str) -> DataFrame:
    """Terms, one per line; blank lines and those that begin with # are none."""
    lines = spark.read.text(path).select(F.btrim("value").alias("term"))
    return lines.filter("term <> '' AND NOT startswith(term, '#')")


def marked_tables(texts: DataFrame) -> DataFrame:
    """Cells of the Markdown tables that stand between ``<!-- name:start -->`` and ``<!-- name:end -->`` in ``text``: name,
    row, col, cell. Rows are lines that begin with a bar, counted from 0 with the head and the rule below it."""
    block = r"(?s)<!-- ([a-z-]+):start -->\n(.*?)<!-- \1:end -->"
    names, bodies = (F.regexp_extract_all("text", F.lit(block), F.lit(k)) for k in (1, 2))
    tables = texts.select(F.explode(F.arrays_zip(names.alias("name"), bodies.alias("body"))).alias("t")).select("t.name", "t.body")
    lines = F.filter(F.split("body", "\n"), lambda x: x.startswith("|"))
    rows = tables.select("name", F.posexplode(lines).alias("row", "line"))
    cells = F.split(F.btrim(F.btrim("line"), F.lit("|")), r"\|")
    return rows.select("name", "row", F.posexplode(cells).alias("col", "cell")).withColumn("cell", F.btrim("cell"))


def figure(tables: DataFrame, name: str, row: int, col: int) -> str:
    """One cell; a missing one is an error."""
    found = tables.filter((F.col("name") == name) & (F.col("row") == row) & (F.col("col") == col)).first()
    if found is None:
        raise ValueError(f"there is no cell {name}[{row}][{col}]")
    return found["cell"]


def kept(df: DataFrame) -> DataFrame:
    """The frame, computed once and written to the folder that spark.checkpoint.dir names, for what reads it several times:
    a lost executor then costs its tasks and not the frame. Where the setting is unset, a folder of this machine serves a
    session that runs on this machine alone; elsewhere that is an error."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="tallywick-"))
    return df.checkpoint()
