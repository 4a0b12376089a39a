"""Queries whose rows depend on those before them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywick.operators import caps
from tallywick.operators import ordered as op
from tallywick.plans.registry import query, table


def _requests(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).cast("double").alias("ms")).withColumn("at", F.col("ms") / 1000).drop("ms")


@query("quota_sliding", """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_ms(ts) / 1000.0::DOUBLE AS at, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM events),
q AS (SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS event_id, CAST(0 AS DOUBLE) AS at, true AS allowed, CAST([] AS DOUBLE[]) AS held FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT e.user_id, e.n, e.event_id, e.at, len(list_filter(q.held, lambda x: x > e.at - 86400)) < 2, CASE WHEN len(list_filter(q.held, lambda x: x > e.at - 86400)) < 2 THEN list_append(list_filter(q.held, lambda x: x > e.at - 86400), e.at) ELSE list_filter(q.held, lambda x: x > e.at - 86400) END FROM q JOIN e ON e.user_id = q.user_id AND e.n = q.n + 1)
SELECT event_id, user_id, allowed FROM q WHERE n > 0""")
def quota_sliding(spark, sf_dir):
    return op.sliding_quota(_requests(spark, sf_dir), "user_id", "at", "event_id", limit=2, window=86400.0).select("event_id", "user_id", "allowed")


@query("cap_admission", """WITH RECURSIVE e AS (SELECT event_id, user_id % 3 AS grp, concat('team-', CAST(user_id % 5 AS VARCHAR)) AS project, CAST(event_id % 90 + 10 AS DOUBLE) AS estimate, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
q AS (SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS event_id, CAST(NULL AS VARCHAR) AS refused_by, CAST(0 AS DOUBLE) AS spent FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN e.project = 'team-1' AND q.spent + e.estimate > 500 THEN 'project' WHEN q.spent + e.estimate > 800 THEN 'portfolio' END, CASE WHEN (e.project = 'team-1' AND q.spent + e.estimate > 500) OR q.spent + e.estimate > 800 THEN q.spent ELSE q.spent + e.estimate END FROM q JOIN e ON e.user_id = q.user_id AND e.n = q.n + 1)
SELECT event_id, refused_by FROM q WHERE n > 0""")
def cap_admission(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select("event_id", "user_id", F.concat(F.lit("team-"), (F.col("user_id") % 5).cast("string")).alias("project"), (F.col("event_id") % 90 + 10).cast("double").alias("estimate"))
    return op.cap_admission(calls, "user_id", "event_id", {"team-1": 500.0}, 800.0).select("event_id", "refused_by")


@query(
    "cache_replay",
    """
WITH RECURSIVE v AS (
    SELECT vec_id, vec_id % 3 AS scope, label, vec_id % 7 <> 0 AS storable, vec_id % 11 <> 0 AS marked, vec_id % 211 AS question, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, row_number() OVER (PARTITION BY vec_id % 3 ORDER BY vec_id) AS nr FROM embeddings
), sims AS (
    SELECT a.scope, a.nr, b.nr AS other, b.label, a.question = b.question AS same, round(list_inner_product(a.v, b.v), 9) AS sim FROM v a JOIN v b ON a.scope = b.scope AND b.nr < a.nr
), r AS (
    SELECT DISTINCT scope, 0::BIGINT AS nr, []::BIGINT[] AS held, NULL::VARCHAR AS outcome, NULL::DOUBLE AS similarity FROM v
    UNION ALL
    SELECT scope, nr, CASE WHEN outcome = 'miss' AND storable THEN list_append(held, nr) ELSE held END, outcome, CASE outcome WHEN 'exact' THEN 1.0 WHEN 'out' THEN NULL ELSE sim END
    FROM (
        SELECT *, CASE WHEN NOT marked THEN 'out' WHEN exact THEN 'exact' WHEN sim >= 0.3 THEN CASE WHEN near_label = label THEN 'semantic' ELSE 'false' END ELSE 'miss' END AS outcome
        FROM (
            SELECT r.scope, v.nr, r.held, any_value(v.storable) AS storable, any_value(v.marked) AS marked, any_value(v.label) AS label, coalesce(bool_or(s.same), false) AS exact, max(s.sim) AS sim, arg_max(s.label, (s.sim, -s.other)) AS near_label
            FROM r JOIN v ON v.scope = r.scope AND v.nr = r.nr + 1 LEFT JOIN sims s ON s.scope = r.scope AND s.nr = v.nr AND list_contains(r.held, s.other)
            GROUP BY r.scope, v.nr, r.held
        )
    )
)
SELECT v.vec_id, v.scope, outcome, round(similarity, 6) AS similarity FROM r JOIN v USING (scope, nr)
""",
)
def cache_replay(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    calls = v.select("vec_id", (F.col("vec_id") % 3).alias("scope"), F.concat(F.lit("q"), (F.col("vec_id") % 211).cast("string")).alias("question"), F.col("label").alias("family"), (F.col("vec_id") % 7 != 0).alias("storable"), (F.col("vec_id") % 11 != 0).alias("marked"), F.col("embedding").alias("v"))
    return op.cache_replay(calls, "scope", ["vec_id"], 0.3).select("vec_id", "scope", "outcome", F.round("similarity", 6).alias("similarity"))


_CHUNKS = "c AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant')"


def chunks(spark, sf_dir):
    """Assistant turns as event streams: a delta per word, usage and end at the last, cut into chunks of 37 characters."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"), F.split("text", " ").alias("w"))
    delta = F.transform("w", lambda x, i: F.concat(F.lit("data: "), F.to_json(F.struct(F.when(i == 0, x).otherwise(F.concat(F.lit(" "), x)).alias("delta"))), F.lit("\n\n")))
    body = F.concat(F.lit(': hello\n\ndata: {"role":"assistant","delta":""}\n\n'), F.array_join(delta, ""), F.lit('data: {"usage":'), F.size("w").cast("string"), F.lit("}\n\ndata: [DONE]\n\n"))
    cut = turns.select("stream_id", body.alias("b")).select("stream_id", "b", F.explode(F.sequence(F.lit(0), F.floor((F.length("b") - 1) / 37).cast("int"))).alias("seq"))
    return cut.select("stream_id", F.col("seq").cast("long").alias("seq"), F.expr("substring(b, seq * 37 + 1, 37)").alias("body"), (F.lit(100) + 10 * F.col("seq")).cast("long").alias("arrival_ms"))


@query("stream_text", f"WITH {_CHUNKS} SELECT conv_id * 1000 + turn AS stream_id, text, CAST(len(string_split(text, ' ')) AS BIGINT) AS usage, true AS done FROM c")
def stream_text(spark, sf_dir):
    return op.assemble(op.decode_events(chunks(spark, sf_dir))).select("stream_id", "text", "usage", "done")


# The end of the first event that has text: the opening, the events before it, its own JSON, and a blank line.
@query(
    "sse_first_token",
    f"""WITH {_CHUNKS}, w AS (SELECT conv_id * 1000 + turn AS stream_id, string_split(text, ' ') AS w FROM c WHERE text IS NOT NULL),
e AS (SELECT stream_id, unnest(list_transform(w, lambda x, i: CASE WHEN i = 1 THEN x ELSE ' ' || x END)) AS delta, generate_subscripts(w, 1) AS place FROM w),
p AS (SELECT *, 48 + sum(18 + length(CAST(to_json(delta) AS VARCHAR))) OVER (PARTITION BY stream_id ORDER BY place) AS upto FROM e)
SELECT stream_id, CAST(100 + 10 * min((upto - 1) // 37) AS BIGINT) AS first_token_ms FROM p WHERE delta <> '' GROUP BY 1""",
)
def sse_first_token(spark, sf_dir):
    return op.assemble(op.decode_events(chunks(spark, sf_dir))).select("stream_id", "first_token_ms")


@query("event_windows", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DOUBLE) AS value FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("value")).select("event_type", F.col("w.start").alias("hour"), "events", "value")


@query("page_text")
def page_text(spark, sf_dir):
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("text"))


@query(
    "coupled_caps",
    """WITH RECURSIVE e AS (SELECT event_id, ts, user_id % 30 AS portfolio, user_id % 7 AS project, CASE WHEN event_id % 4 > 0 THEN event_id % 9 END AS run, CAST(event_id % 5 + 1 AS DOUBLE) AS usd, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS day,
    row_number() OVER (PARTITION BY user_id % 30 ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT DISTINCT portfolio, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::VARCHAR AS refused_by, []::STRUCT(project BIGINT, run BIGINT, usd DOUBLE, month VARCHAR, day VARCHAR)[] AS held FROM e
    UNION ALL
    SELECT portfolio, n, event_id, why, CASE WHEN why IS NULL THEN list_append(held, {'project': project, 'run': run, 'usd': usd, 'month': month, 'day': day}) ELSE held END FROM (
        SELECT r.portfolio, e.n, e.event_id, e.project, e.run, e.usd, e.month, e.day, r.held,
            CASE WHEN coalesce(list_sum(list_transform(list_filter(r.held, lambda h: h.project = e.project AND h.month = e.month), lambda h: h.usd)), 0) + e.usd > 300 THEN 'project'
                 WHEN e.project <> 3 AND coalesce(list_sum(list_transform(list_filter(r.held, lambda h: h.project = e.project AND h.day = e.day), lambda h: h.usd)), 0) + e.usd > 12 THEN 'day'
                 WHEN e.run IS NOT NULL AND coalesce(list_sum(list_transform(list_filter(r.held, lambda h: h.project = e.project AND h.run = e.run), lambda h: h.usd)), 0) + e.usd > 40 THEN 'run'
                 WHEN coalesce(list_sum(list_transform(list_filter(r.held, lambda h: h.month = e.month), lambda h: h.usd)), 0) + e.usd > 700 THEN 'portfolio' END AS why
        FROM r JOIN e ON e.portfolio = r.portfolio AND e.n = r.n + 1))
SELECT event_id, refused_by FROM r WHERE n > 0""",
)
def coupled_caps(spark, sf_dir):
    """Every event as a call: seven projects under a portfolio, each with a month's, a day's and a run's cap."""
    i, user = F.col("event_id"), F.col("user_id")
    cap = lambda x: F.lit(float(x))
    calls = table(spark, sf_dir, "events").select(i, (user % 30).alias("portfolio"), (user % 7).cast("string").alias("project"), F.when(i % 4 > 0, i % 9).cast("string").alias("run"), (i % 5 + 1).cast("double").alias("estimate"), F.col("ts").cast("timestamp").alias("at"), cap(300).alias("project_monthly_usd"), F.when(user % 7 != 3, cap(12)).alias("project_daily_usd"), cap(40).alias("per_run_usd"), cap(700).alias("portfolio_monthly_usd"))
    return caps.coupled_caps(calls, "portfolio", ["at", "event_id"]).select("event_id", "refused_by")
