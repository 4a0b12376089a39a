"""Vendors' bodies, made of whole conversations and parsed again: answers of three shapes, requests and their refusals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywick.plans.registry import query, table
from tallywick.sources import wire

_BODIES = """
WITH given AS (
    SELECT conv_id, turn, coalesce(text, '') AS text, (conv_id + turn) % 3 AS kind, turn % 2 = 0 AS plain, length(coalesce(text, '')) AS n FROM conversations
), made AS (
    SELECT conv_id, turn, kind, CASE kind
        WHEN 0 THEN to_json({'model': 'm-' || turn, 'choices': [{'message': {'content': CASE WHEN plain THEN to_json(text) ELSE to_json([{'type': 'image', 'text': ''}, {'type': 'text', 'text': text}]) END}, 'finish_reason': 'STOP'}], 'usage': {'prompt_tokens': n, 'completion_tokens': n // 3, 'prompt_tokens_details': {'cached_tokens': n // 2}}})
        WHEN 1 THEN to_json({'type': CASE WHEN turn % 5 = 4 THEN 'error' ELSE 'message' END, 'model': 'n', 'content': [{'type': 'thinking', 'text': '-'}, {'type': 'text', 'text': text}], 'stop_reason': 'end_turn', 'usage': {'input_tokens': n, 'output_tokens': 2, 'cache_read_input_tokens': 5}})
        ELSE to_json({'modelVersion': 'g', 'candidates': [{'content': {'parts': [{'text': '-', 'thought': true}, {'text': text, 'thought': false}]}, 'finishReason': 'MAX_TOKENS'}], 'usageMetadata': {'promptTokenCount': n, 'cachedContentTokenCount': 40, 'candidatesTokenCount': 2, 'thoughtsTokenCount': 4}}) END AS whole
    FROM given
), b AS (
    SELECT conv_id, turn, kind, CASE WHEN turn % 7 = 6 THEN left(CAST(whole AS VARCHAR), 9) ELSE CAST(whole AS VARCHAR) END AS body FROM made
)
"""

ANSWERS_SQL = (
    _BODIES
    + r"""
, j AS (
    SELECT conv_id, turn, kind, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS v FROM b
), r AS (
    SELECT *, CASE WHEN v IS NULL THEN 'json' WHEN kind = 1 AND coalesce(v->>'$.type', '') <> 'message' THEN 'shape' END AS error,
           CASE kind WHEN 0 THEN json_extract(v, '$.choices[0].message.content') WHEN 1 THEN json_extract(v, '$.content') ELSE json_extract(v, '$.candidates[0].content.parts') END AS content,
           CASE kind WHEN 0 THEN v->'$.usage' WHEN 1 THEN v->'$.usage' ELSE v->'$.usageMetadata' END AS u FROM j
)
SELECT conv_id, turn, error,
       CASE WHEN error IS NULL THEN md5(CASE WHEN json_type(content) = 'VARCHAR' THEN content->>'$' ELSE list_filter(CAST(content AS JSON[]), lambda x: coalesce(x->>'$.type', 'text') = 'text' AND coalesce(x->>'$.thought', 'false') = 'false')[1]->>'$.text' END) END AS text_md5,
       CASE WHEN error IS NULL THEN lower(CASE kind WHEN 0 THEN v->>'$.choices[0].finish_reason' WHEN 1 THEN v->>'$.stop_reason' ELSE v->>'$.candidates[0].finishReason' END) END AS finish_reason,
       CASE WHEN error IS NULL THEN coalesce(v->>'$.model', v->>'$.modelVersion') END AS model_returned,
       CASE WHEN error IS NULL THEN CASE kind WHEN 0 THEN CAST(u->>'$.prompt_tokens' AS BIGINT) - CAST(u->>'$.prompt_tokens_details.cached_tokens' AS BIGINT) WHEN 1 THEN CAST(u->>'$.input_tokens' AS BIGINT) ELSE greatest(CAST(u->>'$.promptTokenCount' AS BIGINT) - CAST(u->>'$.cachedContentTokenCount' AS BIGINT), 0) END END AS input_tokens,
       CASE WHEN error IS NULL THEN CASE kind WHEN 0 THEN CAST(u->>'$.completion_tokens' AS BIGINT) WHEN 1 THEN CAST(u->>'$.output_tokens' AS BIGINT) ELSE CAST(u->>'$.candidatesTokenCount' AS BIGINT) + CAST(u->>'$.thoughtsTokenCount' AS BIGINT) END END AS output_tokens
FROM r
"""
)


def _lit(x):
    return F.lit(x)


def bodies(spark, sf_dir):
    """A body for each turn, of the shape that its number says; some are cut off, some are errors."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", _lit("")).alias("text"))
    n, turn, kind = F.length("text"), F.col("turn"), (F.col("conv_id") + F.col("turn")) % 3
    part = lambda kind_, text: F.struct(_lit(kind_).alias("type"), text.alias("text"))
    string = lambda text: F.to_json(F.array(text)).substr(_lit(2), F.length(F.to_json(F.array(text))) - 2)
    content = F.when(turn % 2 == 0, string(F.col("text"))).otherwise(F.to_json(F.array(part("image", _lit("")), part("text", F.col("text")))))
    usage = F.to_json(F.struct(n.alias("prompt_tokens"), F.floor(n / 3).alias("completion_tokens"), F.struct(F.floor(n / 2).alias("cached_tokens")).alias("prompt_tokens_details")))
    chat = F.concat(_lit('{"model":"m-'), turn.cast("string"), _lit('","choices":[{"message":{"content":'), content, _lit('},"finish_reason":"STOP"}],"usage":'), usage, _lit("}"))
    blocks = F.to_json(F.struct(F.when(turn % 5 == 4, "error").otherwise("message").alias("type"), _lit("n").alias("model"), F.array(part("thinking", _lit("-")), part("text", F.col("text"))).alias("content"), _lit("end_turn").alias("stop_reason"), F.struct(n.alias("input_tokens"), _lit(2).alias("output_tokens"), _lit(5).alias("cache_read_input_tokens")).alias("usage")))
    given = lambda text, thought: F.struct(text.alias("text"), _lit(thought).alias("thought"))
    candidate = F.struct(F.struct(F.array(given(_lit("-"), True), given(F.col("text"), False)).alias("parts")).alias("content"), _lit("MAX_TOKENS").alias("finishReason"))
    parts = F.to_json(F.struct(_lit("g").alias("modelVersion"), F.array(candidate).alias("candidates"), F.struct(n.alias("promptTokenCount"), _lit(40).alias("cachedContentTokenCount"), _lit(2).alias("candidatesTokenCount"), _lit(4).alias("thoughtsTokenCount")).alias("usageMetadata")))
    body = F.when(kind == 0, chat).when(kind == 1, blocks).otherwise(parts)
    shape = F.when(kind == 0, wire.CHAT).when(kind == 1, wire.BLOCKS).otherwise(wire.PARTS)
    return rows.select("conv_id", "turn", F.when(turn % 7 == 6, F.substring(body, 1, 9)).otherwise(body).alias("body"), shape.alias("shape"))


@query("wire_answers", ANSWERS_SQL)
def wire_answers(spark, sf_dir):
    told = wire.read_answers(bodies(spark, sf_dir))
    return told.select("conv_id", "turn", "error", F.md5("text").alias("text_md5"), "finish_reason", "model_returned", "input_tokens", "output_tokens")


REQUESTS_SQL = r"""
WITH c AS (
    SELECT conv_id, list({'role': role, 'content': coalesce(text, '')} ORDER BY turn) AS messages FROM conversations GROUP BY conv_id
), b AS (
    SELECT conv_id, CAST(CASE WHEN conv_id % 4 = 0 THEN to_json({'model': 'm', 'messages': messages, 'top_k': conv_id % 5}) WHEN conv_id % 4 = 1 THEN to_json({'model': 'm', 'messages': messages, 'temperature': 0.5}) WHEN conv_id % 4 = 2 THEN to_json({'model': '', 'messages': messages}) ELSE to_json({'model': 'm', 'messages': messages, 'max_tokens': 'ten'}) END AS JSON) AS v FROM c
), m AS (
    SELECT conv_id, v, unnest(CAST(v->'$.messages' AS JSON[])) AS m, generate_subscripts(CAST(v->'$.messages' AS JSON[]), 1) AS place FROM b
), t AS (
    SELECT conv_id, any_value(v) AS v, count(*) FILTER (WHERE m->>'$.role' <> 'system') AS n_messages, md5(last(m->>'$.content' ORDER BY place) FILTER (WHERE m->>'$.role' = 'system')) AS system_md5, sum(length(m->>'$.content')) FILTER (WHERE m->>'$.role' <> 'system') AS chars,
           min(place) FILTER (WHERE m->>'$.role' <> 'system') AS talk, max(place) FILTER (WHERE m->>'$.role' = 'system') AS told FROM m GROUP BY conv_id
)
SELECT conv_id, n_messages, system_md5, CAST(chars AS BIGINT) AS chars, list_sort(list_filter(json_keys(v), lambda k: k NOT IN ('model', 'messages')))[1] AS extra,
       CASE WHEN conv_id % 4 = 0 THEN 'top_k: unsupported' WHEN v->>'$.model' = '' THEN 'model: required' WHEN talk IS NOT NULL AND told > talk THEN 'messages: system after the conversation began' WHEN talk IS NULL THEN 'messages: no user or assistant' WHEN json_type(v->'$.max_tokens') = 'VARCHAR' THEN 'max_tokens: not an integer' END AS refused
FROM t
"""


@query("wire_requests", REQUESTS_SQL)
def wire_requests(spark, sf_dir):
    """Each conversation as one request: what it is rebuilt to, what else it carries, and why it would be refused."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", _lit("")).alias("content")))).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")
    i = F.col("conv_id")
    body = F.when(i % 4 == 0, F.to_json(F.struct(_lit("m").alias("model"), messages, (i % 5).alias("top_k")))).when(i % 4 == 1, F.to_json(F.struct(_lit("m").alias("model"), messages, _lit(0.5).alias("temperature"))))
    body = body.when(i % 4 == 2, F.to_json(F.struct(_lit("").alias("model"), messages))).otherwise(F.to_json(F.struct(_lit("m").alias("model"), messages, _lit("ten").alias("max_tokens"))))
    told = turns.select("conv_id", body.alias("body")).select("conv_id", wire.request(F.col("body"), _lit(wire.CHAT)).alias("r"), wire.refusal(F.col("body")).alias("refused"))
    chars = F.aggregate("r.messages", _lit(0).cast("long"), lambda s, m: s + F.length(m["content"]))
    return told.select("conv_id", F.size("r.messages").cast("long").alias("n_messages"), F.md5("r.system").alias("system_md5"), F.when(F.size("r.messages") > 0, chars).alias("chars"), F.get(F.array_sort(F.map_keys("r.extra")), _lit(0)).alias("extra"), "refused")
