"""Dated price lists as a flat dimension, US dollars per million tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "list_date string, vendor string, model string, input double, output double, cache_read double, cache_write double, batch_multiplier double, above_tokens long, long_input double, long_output double, long_cache_read double, long_cache_write double"

# An example price dimension with a missing rate, a missing batch multiplier, a long-prompt tier and an unpriced model.
PRICES: list[tuple] = [
    (d, v, f"m{i}-{j}{suffix}", 1.0 + i + j + bump, 3.0 + 2 * i + j + bump, None if j == 2 else 0.1 * (i + 1), 1.25 * (1 + i), None if i == 2 else 0.5, 400 if j == 1 else None, *((2.0 + i + bump, 5.0 + i, 0.2 * (i + 1), 2.5) if j == 1 else (None,) * 4))
    for d, bump in (("2023-12-01", 0.0), ("2024-01-10", 0.5), ("2024-01-20", 1.0))
    for i, v in enumerate(("vendor-a", "vendor-b", "vendor-c"))
    for j in (0, 1, 2)
    for suffix in ("", "-r")
    if not (i == 1 and j == 2 and suffix == "-r") and not (i == 2 and j == 0)
]


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, SCHEMA)


def latest(price_rows: DataFrame) -> DataFrame:
    """The newest list's rows; every row carries its list's date."""
    newest = price_rows.agg({"list_date": "max"}).first()[0]
    return price_rows.filter(price_rows["list_date"] == newest)


def _sql(x: object) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else f"CAST({x} AS BIGINT)"


PRICES_SQL = "prices AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_sql, row)) + ")" for row in PRICES) + ") AS t(" + ", ".join(c.split()[0] for c in SCHEMA.split(", ")) + "))"
