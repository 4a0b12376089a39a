"""Queries about single requests, answers and names, over conversations, orders and the ledger projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywick.functions import gateway as fn
from tallywick.functions.text import finish
from tallywick.operators import requests as op
from tallywick.operators import scoring
from tallywick.plans.registry import query, table
from tallywick.sources.ledger import LEDGER_SCHEMA, LEDGER_SQL, ledger, rows_after, rows_for_batch

_QUOTED = lambda s: "'" + s.replace("'", "''") + "'"


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


_IMAGE_BODY = """concat('{{"data": "', repeat('QUJD', {n}), '", "b": "x;base64,', repeat('+/', {n}), '=", "text": "', text, '"}}')"""


@query("image_aware_lengths", f"""WITH b AS (SELECT conv_id, turn, {_IMAGE_BODY.format(n='CAST(turn * 170 AS BIGINT)')} AS body FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, strlen(body) + CAST(coalesce(list_sum(list_transform(regexp_extract_all(body, {_QUOTED(fn.INLINE_IMAGE)}, 1), lambda i: 28000 - len(i))), 0) AS BIGINT) AS length FROM b""")
def image_aware_lengths(spark, sf_dir):
    body = F.expr(_IMAGE_BODY.format(n="CAST(turn * 170 AS INT)"))
    return turns(spark, sf_dir).filter("text IS NOT NULL").select("conv_id", "turn", fn.image_aware_length(body).alias("length"))


@query("legacy_uids", f"""WITH {LEDGER_SQL}, h AS (SELECT event_id, sha1(unhex('{fn.LEGACY_NAMESPACE}') || encode(concat(event_id, '|', ts_utc, '|', project, '|', run_id, '|', coalesce(region, 'None')))) AS h FROM ledger)
SELECT event_id, concat(h[1:12], '5', h[14:16], substr('89ab', (strpos('0123456789abcdef', h[17]) - 1) % 4 + 1, 1), h[18:32]) AS uid FROM h""")
def legacy_uids(spark, sf_dir):
    parts = [F.col(c) for c in ("event_id", "ts_utc", "project", "run_id", "region")]
    return ledger(spark, sf_dir).select("event_id", fn.legacy_uid(*parts).alias("uid"))


_WORDS = "w AS (SELECT DISTINCT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word FROM conversations), n AS (SELECT word, regexp_replace(word, '\\P{L}+', '', 'g') AS letters FROM w)"


@query("name_shapes", f"WITH {_WORDS} SELECT word, len(letters) >= 2 AND regexp_matches(letters, '^\\p{{Lu}}') AND (len(letters) > 2 OR regexp_matches(letters, '[^\\p{{Lu}}]')) AS is_name FROM n")
def name_shapes(spark, sf_dir):
    words = turns(spark, sf_dir).select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("word")).distinct()
    return words.select("word", fn.name_shaped(F.col("word")).alias("is_name"))


_NAMED = "concat('Dr. ', replace(substr(text, 1, 40), ' of ', '-'), ' Mrs')"
_TITLES = ", ".join(map(_QUOTED, fn.HONORIFICS))


@query("name_parts", f"""WITH n AS (SELECT conv_id, turn, {_NAMED} AS name FROM conversations WHERE text IS NOT NULL), p AS (SELECT conv_id, turn, list_transform(regexp_split_to_array(replace(name, '-', ' '), '\\s+'), lambda x: trim(x, {_QUOTED(fn.NAME_SIGNS)})) AS p FROM n)
SELECT conv_id, turn, array_to_string(list_filter(p, lambda x: len(x) >= 2 AND lower(x) NOT IN ({_TITLES})), '|') AS parts FROM p""")
def name_parts(spark, sf_dir):
    return turns(spark, sf_dir).filter("text IS NOT NULL").select("conv_id", "turn", F.array_join(fn.name_parts(F.expr(_NAMED)), "|").alias("parts"))


_ANSWERS = "CASE turn % 4 WHEN 0 THEN concat('The document does not say. ', text) WHEN 1 THEN concat('There is no information on that. ', text) WHEN 2 THEN concat('I cannot answer this: ', text) ELSE text END"


@query("declined_answers", f"WITH a AS (SELECT conv_id, turn, {_ANSWERS} AS a FROM conversations) SELECT conv_id, turn, regexp_matches(coalesce(a, ''), {_QUOTED(fn.DECLINE)}, 'i') AS declined, regexp_matches(coalesce(a, ''), {_QUOTED(fn.DECLINE + '|' + fn.DECLINE_MORE)}, 'i') AS declined_wide FROM a")
def declined_answers(spark, sf_dir):
    said = F.expr(_ANSWERS)
    return turns(spark, sf_dir).select("conv_id", "turn", fn.declines(said).alias("declined"), fn.declines(said, extended=True).alias("declined_wide"))


@query("addressed_answers", "WITH a AS (SELECT *, regexp_split_to_array(trim(text), '\\s+')[2] AS word FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn, contains(text, concat(word, ' Roe')) OR list_contains(regexp_split_to_array(text, '[^A-Za-z0-9_]+'), word) AS addressed FROM a WHERE regexp_full_match(word, '[A-Za-z]+')")
def addressed_answers(spark, sf_dir):
    word = F.get(F.split(F.btrim("text"), r"\s+"), F.lit(1))
    own = turns(spark, sf_dir).filter("text IS NOT NULL").withColumn("word", word).filter(F.col("word").rlike("^[A-Za-z]+$"))
    return own.select("conv_id", "turn", fn.addresses(F.col("text"), F.concat("word", F.lit(" Roe"))).alias("addressed"))


_FIGURE = "CASE o_orderkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN concat(CAST(o_custkey AS {s}), '% (', CAST(o_orderkey AS {s}), '.5% to +', CAST(o_custkey AS {s}), '%)') ELSE concat('about ', CAST(o_custkey AS {s}), ' (-', CAST(o_orderkey AS {s}), ' to ', CAST(o_custkey AS {s}), '.25)') END"


@query("parsed_intervals", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_custkey AS DOUBLE) END AS value, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN o_orderkey + 0.5::DOUBLE ELSE CAST(-o_orderkey AS DOUBLE) END AS low, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST(o_custkey AS DOUBLE) ELSE o_custkey + 0.25::DOUBLE END AS high FROM orders")
def parsed_intervals(spark, sf_dir):
    found = fn.interval(F.expr(_FIGURE.format(s="STRING")))
    return table(spark, sf_dir, "orders").select("o_orderkey", found["value"].alias("value"), found["low"].alias("low"), found["high"].alias("high"))


_HEADER = "CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN ' Public' WHEN 3 THEN upper(env) ELSE concat(coalesce(data_class, ''), ' ') END"


@query("declared_classes", f"WITH {LEDGER_SQL}, h AS (SELECT event_id, lower(trim({_HEADER})) AS h FROM ledger) SELECT event_id, CASE WHEN h IS NULL OR h = '' THEN 'personal' WHEN h IN ('public', 'internal', 'personal', 'sensitive') THEN h END AS declared FROM h")
def declared_classes(spark, sf_dir):
    return ledger(spark, sf_dir).select("event_id", fn.data_class(F.expr(_HEADER)).alias("declared"))


@query("cap_reset_times", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN date_trunc('day', ts) + INTERVAL 1 DAY WHEN 1 THEN date_trunc('month', ts) + INTERVAL 1 MONTH END::TIMESTAMP AS resets FROM events")
def cap_reset_times(spark, sf_dir):
    scope = F.expr("CASE event_id % 3 WHEN 0 THEN 'day' WHEN 1 THEN 'month' ELSE 'run' END")
    resets = fn.cap_resets(scope, F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", resets.cast("timestamp_ntz").alias("resets"))


@query("formatted_figures", "WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 1000000 ELSE o_totalprice END AS v, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS ms FROM orders) SELECT o_orderkey, 'US$' || CASE WHEN v < 1 THEN format('{:,.4f}', v) ELSE format('{:,.2f}', v) END AS dollars, coalesce(format('{:,.0f}', ms), '-') AS ms FROM v")
def formatted_figures(spark, sf_dir):
    v = F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 1000000 ELSE o_totalprice END")
    ms = F.expr("CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END")
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.dollars(v).alias("dollars"), fn.milliseconds(ms).alias("ms"))


@query("short_models", f"WITH {LEDGER_SQL} SELECT DISTINCT provider, regexp_extract(concat(provider, '/', model_requested), '[^/]*$') AS short FROM ledger")
def short_models(spark, sf_dir):
    return ledger(spark, sf_dir).select("provider", fn.short_model(F.concat_ws("/", "provider", "model_requested")).alias("short")).distinct()


# A vault of each conversation's answers' first words; the caller said what its own turns say.
@query("scoped_vaults", "WITH said AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS said FROM conversations WHERE role = 'user' GROUP BY 1), v AS (SELECT conv_id, turn, string_split(text, ' ')[1] AS word FROM conversations WHERE role = 'assistant' AND text IS NOT NULL) SELECT v.conv_id, count(*) AS held, count(*) FILTER (contains(said, word)) AS kept FROM v JOIN said ON v.conv_id = said.conv_id GROUP BY 1")
def scoped_vaults(spark, sf_dir):
    own = turns(spark, sf_dir).filter("text IS NOT NULL")
    in_order = lambda role, what: F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", what.alias("x")))))
    per = own.groupBy("conv_id").agg(in_order("user", F.col("text")).alias("said"), in_order("assistant", F.split("text", " ")[0]).alias("vault"))
    per = per.select("conv_id", F.array_join(F.transform("said", lambda s: s["x"]), "\n").alias("said"), F.map_from_entries(F.transform("vault", lambda s: F.struct(s["turn"], s["x"]))).alias("vault"))
    return per.filter("said <> '' AND cardinality(vault) > 0").select("conv_id", F.size("vault").cast("long").alias("held"), F.size(fn.caller_scoped(F.col("vault"), F.col("said"))).cast("long").alias("kept"))


_FINISH = "CASE event_id % 6 WHEN 0 THEN 'end_turn' WHEN 1 THEN 'STOP' WHEN 2 THEN 'max_tokens' WHEN 3 THEN 'stop_sequence' WHEN 4 THEN NULL ELSE 'tool_use' END"


@query("whole_answers", f"WITH {LEDGER_SQL} SELECT event_id, coalesce(http_status BETWEEN 200 AND 299, false) AND coalesce(env, '') <> '' AND event_id % 6 IN (0, 1, 3) AS whole FROM ledger")
def whole_answers(spark, sf_dir):
    return ledger(spark, sf_dir).select("event_id", fn.whole_answer(F.col("http_status"), F.col("env"), finish(F.expr(_FINISH))).alias("whole"))


_ASKED = "CASE event_id % 6 WHEN 0 THEN concat(provider, '/', model_requested) WHEN 1 THEN 'fast' WHEN 2 THEN 'smart' WHEN 3 THEN 'nowhere/m1' WHEN 4 THEN '/m' ELSE model_requested END"


@query("routed_requests", f"""WITH {LEDGER_SQL}, r AS (SELECT event_id, provider, {_ASKED} AS model FROM ledger), routes AS (SELECT * FROM (VALUES ('fast', 'vendor-a', 'm0-1', NULL), ('smart', 'vendor-b', 'x/m9', 'r9'), ('m1-2', 'selfhost', 'm1', NULL)) AS t(alias, provider, model, region)),
homes AS (SELECT * FROM (VALUES ('vendor-a', 'r1'), ('vendor-b', 'r2'), ('vendor-c', NULL), ('selfhost', 'home')) AS t(provider, region))
SELECT event_id, model, split_part(model, '/', 1) AS provider, regexp_replace(model, '^[^/]*/', '') AS target, h.region, NULL AS problem FROM r JOIN homes h ON split_part(model, '/', 1) = h.provider WHERE contains(model, '/') AND NOT starts_with(model, '/')
UNION ALL SELECT event_id, model, NULL, NULL, NULL, CASE WHEN starts_with(model, '/') THEN 'malformed' ELSE 'unknown provider' END FROM r WHERE contains(model, '/') AND split_part(model, '/', 1) NOT IN (SELECT provider FROM homes)
UNION ALL SELECT event_id, r.model, t.provider, t.model, CASE WHEN t.alias IS NOT NULL THEN coalesce(t.region, h.region) END, CASE WHEN t.alias IS NULL THEN 'unknown alias' END FROM r LEFT JOIN routes t ON r.model = t.alias LEFT JOIN homes h ON t.provider = h.provider WHERE NOT contains(r.model, '/')""")
def routed_requests(spark, sf_dir):
    asked = ledger(spark, sf_dir).select("event_id", F.expr(_ASKED).alias("model"))
    routes = spark.createDataFrame([("fast", "vendor-a", "m0-1", None), ("smart", "vendor-b", "x/m9", "r9"), ("m1-2", "selfhost", "m1", None)], "alias string, provider string, model string, region string")
    homes = spark.createDataFrame([("vendor-a", "r1"), ("vendor-b", "r2"), ("vendor-c", None), ("selfhost", "home")], "provider string, region string")
    return op.resolve_routes(asked, routes, homes)


@query("team_limited", f"""WITH {LEDGER_SQL}, r AS (SELECT event_id, project AS team, model_requested AS model, concat(provider, '/', model_requested) AS explicit, CASE WHEN event_id % 3 > 0 THEN output_tokens END AS max_tokens FROM ledger),
j AS (SELECT *, CASE team WHEN 'team-1' THEN model IN ('m0-1', 'm1-1') OR explicit IN ('vendor-c/m2-0', 'm0-1', 'm1-1') ELSE true END AS listed, CASE team WHEN 'team-1' THEN NULL WHEN 'team-2' THEN 100 END AS most FROM r),
k AS (SELECT *, CASE WHEN NOT listed THEN 'model_not_allowed' WHEN max_tokens > most THEN 'max_tokens_too_large' END AS refused FROM j) SELECT event_id, team, model, explicit, max_tokens, CASE WHEN refused IS NULL THEN coalesce(max_tokens, most) END AS allowed_tokens, refused FROM k""")
def team_limited(spark, sf_dir):
    asked = ledger(spark, sf_dir).select("event_id", F.col("project").alias("team"), F.col("model_requested").alias("model"), F.concat_ws("/", "provider", "model_requested").alias("explicit"), F.expr("CASE WHEN event_id % 3 > 0 THEN output_tokens END").alias("max_tokens"))
    teams = spark.createDataFrame([("team-1", ["m0-1", "m1-1", "vendor-c/m2-0"], None), ("team-2", None, 100)], "team string, models array<string>, limit long")
    return op.team_limits(asked, teams)


@query("misplaced_prices", f"""WITH {LEDGER_SQL}, p AS (SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN 'vendors' ELSE 'own' END AS list, event_id % 2 = 1 AS own, CASE WHEN user_id % 4 = 1 THEN 'typo' ELSE provider END AS provider FROM (SELECT l.*, e.user_id FROM ledger l JOIN events e USING (event_id)))
SELECT list, provider, CASE WHEN NOT own THEN 'self-hosted in the vendor list' WHEN provider = 'typo' THEN 'unknown provider' ELSE 'vendor in a self-hosted list' END AS problem FROM p WHERE own <> (provider = 'selfhost') AND (own OR provider = 'selfhost')""")
def misplaced_prices(spark, sf_dir):
    rows = ledger(spark, sf_dir).select(F.expr("CASE WHEN event_id % 2 = 0 THEN 'vendors' ELSE 'own' END").alias("list"), (F.col("event_id") % 2 == 1).alias("own"), F.when(F.col("provider") == "vendor-b", "typo").otherwise(F.col("provider")).alias("provider"))
    homes = spark.createDataFrame([("vendor-a", False), ("vendor-c", False), ("selfhost", True)], "provider string, self_hosted boolean")
    return op.price_placement(rows, homes)


_KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}
_HELD = {"call_uid", "ts_utc", "env", "project", "run_id", "provider", "region", "residency", "model_requested", "model_returned", "data_class", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "cached", "error_type", "http_status", "latency_ms"}
_SEAL = "call_uid ts_utc env engine_version project purpose run_id mode provider alias model_requested model_returned region residency data_class input_tokens output_tokens cache_read_tokens cache_write_tokens price_list price_sha256 cost_usd costed cached latency_ms http_status error_type retries request_sha256 response_sha256 batch_id ttft_ms redacted injection".split()
_SEAL_SQL = ", ".join(c if c in _HELD else f"CAST(NULL AS {_KINDS[LEDGER_SCHEMA[c].dataType.simpleString()]}) AS {c}" for c in _SEAL)


@query("sealed_rows", f"WITH {LEDGER_SQL} SELECT {_SEAL_SQL} FROM ledger")
def sealed_rows(spark, sf_dir):
    return op.sealed(ledger(spark, sf_dir), 3)


_STORE = "s AS (SELECT sha256(concat('POST', chr(10), '/v1/', provider, chr(10), model_requested, region)) AS key, event_id, http_status AS status, project AS body FROM ledger)"


@query("stored_answers", f"WITH {LEDGER_SQL}, {_STORE}, kept AS (SELECT key, max_by(status, event_id) AS status, max_by(body, event_id) AS body FROM s WHERE event_id % 2 = 0 AND status BETWEEN 200 AND 299 GROUP BY 1) SELECT s.event_id, kept.status AS hit_status, kept.body AS hit_body FROM s LEFT JOIN kept ON s.key = kept.key WHERE s.event_id % 2 = 1")
def stored_answers(spark, sf_dir):
    key = fn.cache_key(F.lit("POST"), F.concat(F.lit("/v1/"), "provider"), F.concat("model_requested", F.coalesce("region", F.lit(""))))
    calls = ledger(spark, sf_dir).select(key.alias("key"), F.col("event_id").alias("at"), F.col("http_status").alias("status"), F.col("project").alias("body"))
    asked = calls.filter("at % 2 = 1").select("key", F.col("at").alias("event_id"))
    return op.cache_get(asked, op.cache_put(calls.filter("at % 2 = 0"))).drop("key")


@query("turn_families", "SELECT concat(conv_id, '-', turn) AS id, CASE WHEN role = 'assistant' AND turn > 0 THEN concat(conv_id, '-', turn - 1) ELSE concat(conv_id, '-', turn) END AS family FROM conversations")
def turn_families(spark, sf_dir):
    parent = F.when((F.col("role") == "assistant") & (F.col("turn") > 0), F.concat_ws("-", "conv_id", F.col("turn") - 1)).otherwise(F.lit(""))
    return op.families(turns(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("id"), parent.alias("parent_id")))


@query("unsealed_calls", f"WITH {LEDGER_SQL} SELECT event_id, call_uid FROM ledger WHERE error_type IS NULL AND NOT (event_id % 7 = 2 OR event_id % 11 = 5)")
def unsealed_calls(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    sealed = rows.filter("event_id % 7 = 2").select("call_uid").union(rows.filter("event_id % 11 = 5").select("call_uid"))
    return op.missing(rows.filter("error_type IS NULL").select("event_id", "call_uid"), sealed, "call_uid")


@query("token_rollup", f"WITH {LEDGER_SQL}, f AS (SELECT provider, concat(region, ':', count(*)) AS f, region FROM ledger WHERE region IS NOT NULL GROUP BY provider, region) SELECT provider, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, (SELECT string_agg(f, ',' ORDER BY region) FROM f WHERE f.provider = l.provider) AS forms FROM ledger l GROUP BY provider")
def token_rollup(spark, sf_dir):
    calls = ledger(spark, sf_dir).withColumn("forms", F.when(F.col("region").isNotNull(), F.create_map("region", F.lit(1).cast("long"))))
    out = op.rolled_up(calls, ["provider"], ["input_tokens", "output_tokens"], "forms")
    told = F.array_join(F.transform(F.array_sort(F.map_entries("forms")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return out.withColumn("forms", told)


@query("record_loss", f"""WITH {LEDGER_SQL}, c AS (SELECT provider AS arm, call_uid, event_id, error_type FROM ledger) SELECT arm, count(*) AS calls, count(*) FILTER (event_id % 17 > 0) AS rows, count(*) FILTER (event_id % 17 > 0 AND coalesce(error_type, '') = 'in_flight') AS in_flight, count(*) FILTER (event_id % 17 = 0) AS missing, count(*) FILTER (event_id % 19 = 4) AS uncapped FROM c GROUP BY 1""")
def record_loss(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    calls = rows.select(F.col("provider").alias("arm"), "call_uid", (F.col("event_id") % 19 != 4).alias("capped"))
    return op.record_loss(calls, rows.filter("event_id % 17 > 0").select("call_uid", "error_type"))


_CAPS = "user_id % 9 * 10.0 AS spent_usd, value / 10 AS estimate_usd, 50.0 AS cap_usd"


@query("caps_and_fidelity", f"WITH c AS (SELECT event_type AS arm, event_id, {_CAPS} FROM events) SELECT arm, count(*) FILTER (spent_usd + estimate_usd > cap_usd) AS over_cap, count(*) FILTER (spent_usd + estimate_usd > cap_usd AND event_id % 40 = 1) AS over_cap_reached, count(*) FILTER (event_id % 3 > 0) AS identical, count(*) AS calls FROM c GROUP BY 1")
def caps_and_fidelity(spark, sf_dir):
    shas = [F.sha2("props", 256).alias("sent_sha"), F.sha2(F.when(F.col("event_id") % 3 > 0, F.col("props")).otherwise(F.concat("props", F.lit(" "))), 256).alias("got_sha")]
    own = table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), (F.col("event_id") % 40 == 1).alias("reached"), *[F.expr(x) for x in _CAPS.split(", ")], *shas)
    return op.caps_and_fidelity(own)


@query("judge_counts", "WITH s AS (SELECT doc_id % 4 AS part, quality = 1 AS truth, CASE WHEN doc_id % 7 = 3 THEN quality = 0 ELSE quality = 1 END AS said FROM labels), c AS (SELECT part, count(*) FILTER (truth AND said) AS tp, count(*) FILTER (truth AND NOT said) AS fn, count(*) FILTER (NOT truth AND said) AS fp, count(*) FILTER (NOT truth AND NOT said) AS tn FROM s GROUP BY 1) SELECT *, tp / nullif(tp + fn, 0) AS sensitivity, tn / nullif(tn + fp, 0) AS specificity FROM c")
def judge_counts(spark, sf_dir):
    good = F.col("quality") == 1
    rows = table(spark, sf_dir, "labels").select((F.col("doc_id") % 4).alias("part"), good.alias("truth"), F.when(F.col("doc_id") % 7 == 3, ~good).otherwise(good).alias("said"))
    return op.judge_calibration(rows, "part")


_SPANS = "SELECT user_id AS doc_id, event_id AS id, event_id * 37 % 3000 AS start, event_id * 37 % 3000 + 1 + event_id % 400 AS {e} FROM events WHERE event_id % 3 {op} 0"


def _spans_and_labels(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("_scored_events")
    return [spark.sql(_SPANS.format(e="end", op=o).replace("FROM events", "FROM _scored_events")) for o in (">", "=")]


_MEET = f"WITH s AS ({_SPANS.format(e='stop', op='>')}), l AS ({_SPANS.format(e='stop', op='=')}) SELECT doc_id, s.id AS s_id, l.id AS l_id FROM s JOIN l USING (doc_id) WHERE "


@query("span_label_overlaps", _MEET + "s.start < l.stop AND l.start < s.stop")
def span_label_overlaps(spark, sf_dir):
    return scoring.overlaps(*_spans_and_labels(spark, sf_dir)).select("doc_id", "s_id", "l_id")


@query("spans_inside_labels", _MEET + "l.start <= s.start AND s.stop <= l.stop")
def spans_inside_labels(spark, sf_dir):
    return scoring.overlaps(*_spans_and_labels(spark, sf_dir), inside=True).select("doc_id", "s_id", "l_id")


@query("ledger_after", f"WITH {LEDGER_SQL} SELECT event_id, call_uid FROM ledger WHERE event_id > 400")
def ledger_after(spark, sf_dir):
    return rows_after(ledger(spark, sf_dir), 400).select("event_id", "call_uid")


@query("ledger_batch", f"WITH {LEDGER_SQL} SELECT event_id, call_uid FROM ledger WHERE batch AND run_id = 'run-3'")
def ledger_batch(spark, sf_dir):
    rows = ledger(spark, sf_dir).withColumn("batch_id", F.when(F.col("batch"), F.col("run_id")))
    return rows_for_batch(rows, "run-3").select("event_id", "call_uid")


@query("unresolved_answers", f"WITH {LEDGER_SQL} SELECT provider AS arm, count(*) AS answers, count(*) FILTER (event_id % 5 = 0 OR event_id % 5 = 1) AS unresolved FROM ledger GROUP BY 1")
def unresolved_answers(spark, sf_dir):
    # Of each five answers two hold a placeholder that their caller's scoped vault lacks.
    said = F.expr("CASE event_id % 5 WHEN 0 THEN 'for <PERSON_2>' WHEN 1 THEN 'to <ID_LIKE_10> of x' WHEN 2 THEN 'a < b_1 >' ELSE 'done <person_1>' END")
    return op.rehydration_cost(ledger(spark, sf_dir).select(F.col("provider").alias("arm"), said.alias("restored")))
