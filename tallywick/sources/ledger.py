"""Ledger rows: the schema, readers, and the projection of the events table that stands in for a ledger here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
#: One row per model call. ``call_uid`` is the key; a null data class, residency or cost is a claim of its own.
LEDGER_SCHEMA = T.StructType(
    [T.StructField(n, _S) for n in ("call_uid", "ts_utc", "env", "engine_version", "project", "purpose", "run_id", "mode", "provider", "alias", "model_requested", "model_returned", "region", "residency", "price_list", "price_sha256", "error_type", "request_sha256", "response_sha256", "trace_id", "span_id", "raw_path", "batch_id", "data_class", "cache_source")]
    + [T.StructField(n, _L) for n in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "retries")]
    + [T.StructField("http_status", T.IntegerType())]
    + [T.StructField(n, _D) for n in ("cost_usd", "latency_ms", "ttft_ms", "cache_similarity")]
    + [T.StructField(n, _B) for n in ("costed", "cached", "redacted", "injection")]
)

# The projection, once for both engines: what differs between the dialects stands in braces.
_COLUMNS: list[tuple[str, str]] = [
    ("call_uid", "{uid}"),
    ("ts_utc", "{ts_utc}"),
    ("env", "CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 3 = 0 THEN 'prod' ELSE 'dev' END"),
    ("project", "concat('team-', CAST(user_id % 5 AS {str}))"),
    ("run_id", "concat('run-', CAST(event_id % 50 AS {str}))"),
    ("provider", "CASE user_id % 4 WHEN 0 THEN 'vendor-a' WHEN 1 THEN 'vendor-b' WHEN 2 THEN 'vendor-c' ELSE 'selfhost' END"),
    ("region", "CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 13 = 1 THEN '' WHEN user_id % 2 = 0 THEN 'ca-central-1' ELSE 'eu-west-1' END"),
    ("residency", "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'global' WHEN 2 THEN 'geo' WHEN 3 THEN 'planetary' ELSE 'single-region' END"),
    ("model_requested", "concat('m', CAST(user_id % 4 AS {str}), '-', CAST(event_id % 3 AS {str}))"),
    ("model_returned", "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 5 = 0 THEN concat('m', CAST(user_id % 4 AS {str}), '-', CAST(event_id % 3 AS {str}), '-r') ELSE concat('m', CAST(user_id % 4 AS {str}), '-', CAST(event_id % 3 AS {str})) END"),
    ("data_class", "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'public' WHEN 2 THEN 'internal' WHEN 3 THEN 'personal' ELSE 'sensitive' END"),
    ("input_tokens", "CAST(coalesce({k}, 0) * 10 + event_id % 700 AS BIGINT)"),
    ("output_tokens", "CAST(event_id % 300 AS BIGINT)"),
    ("cache_read_tokens", "CAST(CASE WHEN event_id % 4 = 0 THEN event_id % 500 ELSE 0 END AS BIGINT)"),
    ("cache_write_tokens", "CAST(CASE WHEN event_id % 9 = 0 THEN 50 ELSE 0 END AS BIGINT)"),
    ("batch", "event_id % 8 = 3"),
    ("cached", "event_type = 'click' AND event_id % 3 = 0"),
    ("error_type", "CASE WHEN event_id % 97 = 0 THEN 'in_flight' WHEN event_type = 'error' THEN 'http_500' WHEN event_type = 'signup' AND event_id % 10 = 0 THEN 'policy_refused' WHEN event_type = 'signup' AND event_id % 10 = 1 THEN 'redaction_refused' END"),
    ("http_status", "CAST(CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_type = 'error' THEN 500 WHEN event_type = 'signup' AND event_id % 10 < 2 THEN NULL WHEN event_id % 53 = 0 THEN 404 ELSE 200 END AS INT)"),
    ("latency_ms", "CASE WHEN event_id % 41 = 0 THEN NULL ELSE round(abs(value), 2) END"),
    ("streamed", "event_id % 2 = 0"),
    ("usage_known", "event_id % 29 <> 0"),
    ("event_id", "event_id"),
]
_SPARK = {"uid": "sha2(CAST(event_id AS STRING), 256)", "ts_utc": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")", "str": "STRING", "k": "CAST(get_json_object(props, '$.k') AS BIGINT)"}
_DUCK = {"uid": "sha256(CAST(event_id AS VARCHAR))", "ts_utc": "strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')", "str": "VARCHAR", "k": "CAST(json_extract_string(props, '$.k') AS BIGINT)"}


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a ledger. Narrow expressions only, so that column pruning and filters reach the scan."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(*[F.expr(sql.format(**_SPARK)).alias(name) for name, sql in _COLUMNS])


#: The same projection as a DuckDB common table expression named ``ledger``.
LEDGER_SQL = "ledger AS (SELECT " + ", ".join(f"{sql.format(**_DUCK)} AS {name}" for name, sql in _COLUMNS) + " FROM events)"


def read_ledgers(spark: SparkSession, *paths: str) -> DataFrame:
    """Ledger files of any older version under one schema: columns that a file lacks are null, unknown ones are an error."""
    known = set(LEDGER_SCHEMA.fieldNames())
    out = spark.createDataFrame([], LEDGER_SCHEMA)
    for path in paths:
        part = spark.read.parquet(path)
        if extra := sorted(set(part.columns) - known):
            raise ValueError(f"{path} has columns this version does not know: {', '.join(extra)}")
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def rows_after(rows: DataFrame, watermark: int, id_col: str = "event_id") -> DataFrame:
    """Rows beyond the last one seen; the filter reaches the scan."""
    return rows.filter(F.col(id_col) > watermark)


def rows_for_batch(rows: DataFrame, batch_id: str, order: str = "event_id") -> DataFrame:
    """One batch's rows in the order in which they were submitted."""
    return rows.filter(F.col("batch_id") == batch_id).orderBy(order)
