"""Rates with intervals, quantiles and estimator errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywick.functions import statistics as st
from tallywick.operators import bootstrap
from tallywick.operators.reports import linear_quantiles, ranked_quantiles, values_at
from tallywick.plans.registry import query, table


def _graded(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.length("text").alias("chars")).join(labels, "doc_id")


_WILSON = """CASE WHEN {n} = 0 THEN 0 WHEN {h} = 0 THEN 0 ELSE greatest(0, (({h} / {n}) + 1.96 * 1.96 / (2 * {n})) / (1 + 1.96 * 1.96 / {n}) - 1.96 * sqrt(({h} / {n}) * (1 - {h} / {n}) / {n} + 1.96 * 1.96 / (4 * {n} * {n})) / (1 + 1.96 * 1.96 / {n})) END"""
_WILSON_UP = """CASE WHEN {n} = 0 THEN 0 WHEN {h} = {n} THEN 1 ELSE least(1, (({h} / {n}) + 1.96 * 1.96 / (2 * {n})) / (1 + 1.96 * 1.96 / {n}) + 1.96 * sqrt(({h} / {n}) * (1 - {h} / {n}) / {n} + 1.96 * 1.96 / (4 * {n} * {n})) / (1 + 1.96 * 1.96 / {n})) END"""
_G = "g AS (SELECT doc_id, lang, source, length(text) AS chars, quality, toxic FROM documents JOIN labels USING (doc_id))"


@query("wilson_by_lang", f"WITH {_G}, c AS (SELECT lang, CAST(sum(toxic) AS DOUBLE) AS hits, CAST(count(*) AS DOUBLE) AS n FROM g GROUP BY 1) SELECT lang, CAST(hits AS BIGINT) AS hits, CAST(n AS BIGINT) AS n, round({_WILSON.format(h='hits', n='n')}, 9) AS low, round({_WILSON_UP.format(h='hits', n='n')}, 9) AS high FROM c")
def wilson_by_lang(spark, sf_dir):
    counts = _graded(spark, sf_dir).groupBy("lang").agg(F.sum("toxic").alias("hits"), F.count(F.lit(1)).alias("n"))
    low, high = st.wilson(F.col("hits"), F.col("n"))
    return counts.select("lang", "hits", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("newcombe_lang_pairs", f"""WITH {_G}, c AS (SELECT lang, CAST(sum(quality) AS DOUBLE) AS h, CAST(count(*) AS DOUBLE) AS n FROM g GROUP BY 1), w AS (SELECT lang, h / n AS p, {_WILSON.format(h='h', n='n')} AS l, {_WILSON_UP.format(h='h', n='n')} AS u FROM c)
SELECT a.lang AS lang_1, b.lang AS lang_2, round(a.p - b.p, 9) AS difference, round(a.p - b.p - sqrt((a.p - a.l) ** 2 + (b.u - b.p) ** 2), 9) AS low, round(a.p - b.p + sqrt((a.u - a.p) ** 2 + (b.p - b.l) ** 2), 9) AS high FROM w a JOIN w b ON a.lang < b.lang""")
def newcombe_lang_pairs(spark, sf_dir):
    c = _graded(spark, sf_dir).groupBy("lang").agg(F.sum("quality").alias("h"), F.count(F.lit(1)).alias("n"))
    a, b = (c.select(*[F.col(x).alias(f"{x}_{i}") for x in c.columns]) for i in (1, 2))
    d, low, high = st.newcombe(F.col("h_1"), F.col("n_1"), F.col("h_2"), F.col("n_2"))
    return a.join(b, F.col("lang_1") < F.col("lang_2")).select("lang_1", "lang_2", F.round(d, 9).alias("difference"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("paired_newcombe_labels", f"""WITH {_G}, c AS (SELECT source, CAST(count(*) FILTER (quality = 1 AND toxic = 1) AS DOUBLE) e, CAST(count(*) FILTER (quality = 1 AND toxic = 0) AS DOUBLE) f, CAST(count(*) FILTER (quality = 0 AND toxic = 1) AS DOUBLE) k, CAST(count(*) FILTER (quality = 0 AND toxic = 0) AS DOUBLE) h FROM g GROUP BY 1),
m AS (SELECT *, e + f + k + h AS n, e + f AS h1, e + k AS h2, CASE WHEN (e + f) * (k + h) * (e + k) * (f + h) = 0 THEN 0 ELSE (e * h - f * k) / sqrt((e + f) * (k + h) * (e + k) * (f + h)) END AS phi FROM c),
w AS (SELECT *, h1 / n AS p1, h2 / n AS p2, {_WILSON.format(h='h1', n='n')} AS l1, {_WILSON_UP.format(h='h1', n='n')} AS u1, {_WILSON.format(h='h2', n='n')} AS l2, {_WILSON_UP.format(h='h2', n='n')} AS u2 FROM m)
SELECT source, round(p2 - p1, 9) AS difference, round(p2 - p1 - sqrt(greatest(0, (p2 - l2) ** 2 - 2 * phi * (p2 - l2) * (u1 - p1) + (u1 - p1) ** 2)), 9) AS low, round(p2 - p1 + sqrt(greatest(0, (u2 - p2) ** 2 - 2 * phi * (u2 - p2) * (p1 - l1) + (p1 - l1) ** 2)), 9) AS high FROM w""")
def paired_newcombe_labels(spark, sf_dir):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    n = lambda c: F.count(F.when(c, 1))
    c = _graded(spark, sf_dir).groupBy("source").agg(n(q & t).alias("e"), n(q & ~t).alias("f"), n(~q & t).alias("g"), n(~q & ~t).alias("h"))
    d, low, high = st.newcombe_paired(*map(F.col, "efgh"))
    return c.select("source", F.round(d, 9).alias("difference"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("micro_average", f"WITH {_G} SELECT lang, round(sum(toxic * chars) / sum(chars), 9) AS toxic_share FROM g GROUP BY 1")
def micro_average(spark, sf_dir):
    return _graded(spark, sf_dir).groupBy("lang").agg(F.round(F.sum(F.col("toxic") * F.col("chars")) / F.sum("chars"), 9).alias("toxic_share"))


@query("nearest_rank", """WITH g AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT event_type, v[1 + CAST(round_even(0.5 * (len(v) - 1), 0) AS BIGINT)] AS p50, v[1 + CAST(round_even(0.95 * (len(v) - 1), 0) AS BIGINT)] AS p95, v[1 + CAST(round_even(0.99 * (len(v) - 1), 0) AS BIGINT)] AS p99 FROM g""")
def nearest_rank(spark, sf_dir):
    return ranked_quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("upper_median", "SELECT event_type, list_sort(list(value))[1 + count(*) // 2] AS upper_median FROM events WHERE value IS NOT NULL GROUP BY 1")
def upper_median(spark, sf_dir):
    counted = table(spark, sf_dir, "events").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("k"))
    return values_at(counted, ["event_type"], "value", "k", {"upper_median": lambda n: F.floor(n / 2)}).drop("_n")


@query("linear_quantile", "SELECT event_type, round(quantile_cont(value, 0.025), 9) AS low, round(quantile_cont(value, 0.5), 9) AS median, round(quantile_cont(value, 0.975), 9) AS high, round(avg(CAST(value AS DECIMAL(18, 6))), 6) AS mean FROM events GROUP BY 1")
def linear_quantile(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    at = linear_quantiles(events, ["event_type"], "value", {"low": 0.025, "median": 0.5, "high": 0.975})
    means = events.groupBy("event_type").agg(F.round(F.avg(F.col("value").cast("decimal(18,6)")).cast("double"), 6).alias("mean"))
    return at.select("event_type", *[F.round(c, 9).alias(c) for c in ("low", "median", "high")]).join(means, "event_type")


@query("token_estimates", r"""WITH t AS (SELECT doc_id, length(text) / 4.0 AS chars4, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) * 1.3 AS words13, length(text) / 3.5 AS actual FROM documents),
e AS (SELECT 'chars/4' AS estimator, chars4 AS est, actual FROM t UNION ALL SELECT 'words*1.3', words13, actual FROM t), r AS (SELECT estimator, (est - actual) / actual AS err FROM e WHERE actual > 0)
SELECT estimator, count(*) AS n, round(median(err), 6) AS median_error, round(max(abs(err)), 6) AS worst, round(count(*) FILTER (abs(err) <= 0.1) / count(*), 6) AS within_10 FROM r GROUP BY 1""")
def token_estimates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chars, words = F.length("text"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    one = F.explode(F.array(F.struct(F.lit("chars/4").alias("estimator"), (F.col("chars") / 4).alias("est")), F.struct(F.lit("words*1.3").alias("estimator"), (F.col("words") * 1.3).cast("double").alias("est"))))
    rows = docs.select(chars.alias("chars"), words.alias("words")).select((F.col("chars") / 3.5).cast("double").alias("actual"), one.alias("e")).filter("actual > 0")
    err = rows.select("e.estimator", ((F.col("e.est") - F.col("actual")) / F.col("actual")).alias("err"))
    whole = err.groupBy("estimator").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.abs("err")), 6).alias("worst"), F.round(F.count(F.when(F.abs("err") <= 0.1, 1)) / F.count(F.lit(1)), 6).alias("within_10"))
    middle = linear_quantiles(err, ["estimator"], "err", {"median_error": 0.5})
    return whole.join(middle.select("estimator", F.round("median_error", 6).alias("median_error")), "estimator")


@query(
    "value_summary",
    """WITH e AS (SELECT event_type, value, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r FROM events WHERE value IS NOT NULL)
SELECT event_type, any_value(n) AS n, round(avg(value), 6) AS mean, true AS p50_near, true AS p95_near, true AS within FROM e GROUP BY 1""",
)
def value_summary(spark, sf_dir):
    """Every event's value by type: the mean, and whether the histogram's quantiles and intervals agree with the sorted ones."""
    events = table(spark, sf_dir, "events")
    told = bootstrap.overhead_summary(events, ["event_type"], "event_id", "value", draws=200)
    exact = events.groupBy("event_type").agg(F.percentile("value", 0.5).alias("a"), F.percentile("value", 0.95).alias("b"))
    near = lambda x, y: F.abs(x - y) <= 0.02 * F.abs(y)
    inside = [F.col(f"{m}_low") <= F.col(f"{m}_estimate") for m in ("p50", "p95", "mean")] + [F.col(f"{m}_estimate") <= F.col(f"{m}_high") for m in ("p50", "p95", "mean")]
    return told.join(exact, "event_type").select("event_type", "n", F.round("mean_estimate", 6).alias("mean"), near(F.col("p50_estimate"), F.col("a")).alias("p50_near"), near(F.col("p95_estimate"), F.col("b")).alias("p95_near"), (inside[0] & inside[1] & inside[2] & inside[3] & inside[4] & inside[5]).alias("within"))
