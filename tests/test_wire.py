"""Bodies of three shapes, with odd and broken ones."""

import json

import pytest
from pyspark.sql import functions as F

from tallywick.sources import wire

ANSWERS = [
    ("chat", {"model": "m", "choices": [{"message": {"content": "hi"}, "finish_reason": "STOP"}], "usage": {"prompt_tokens": 10, "completion_tokens": 3, "prompt_tokens_details": {"cached_tokens": 4}}}, ("hi", "stop", "m", 6, 3, 4, 0, None)),
    ("chat", {"choices": [{"message": {"content": [{"type": "image"}, {"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}}]}, ("a", None, None, 0, 0, 0, 0, None)),
    ("chat", {"choices": [], "usage": None}, (None, None, None, 0, 0, 0, 0, None)),
    ("chat", {"error": "x"}, (None,) * 7 + ("shape",)),
    ("chat", "{broken", (None,) * 7 + ("json",)),
    ("chat", [1, 2], (None,) * 7 + ("shape",)),
    ("blocks", {"type": "message", "model": "n", "content": [{"type": "thinking", "thinking": "…"}, {"type": "text", "text": "yes"}], "stop_reason": "end_turn", "usage": {"input_tokens": 7, "output_tokens": 2, "cache_read_input_tokens": 5, "cache_creation_input_tokens": 1}}, ("yes", "end_turn", "n", 7, 2, 5, 1, None)),
    ("blocks", {"type": "error"}, (None,) * 7 + ("shape",)),
    ("parts", {"modelVersion": "g", "candidates": [{"content": {"parts": [{"text": "hm", "thought": True}, {"text": "ok"}]}, "finishReason": "MAX_TOKENS"}], "usageMetadata": {"promptTokenCount": 3, "cachedContentTokenCount": 5, "candidatesTokenCount": 2, "thoughtsTokenCount": 4}}, ("ok", "max_tokens", "g", 0, 6, 5, 0, None)),
    ("parts", {"promptFeedback": {"blockReason": "SAFETY"}, "modelVersion": "g"}, (None, "blocked", "g", 0, 0, 0, 0, None)),
]


def test_answers(spark):
    rows = [(i, s, b if isinstance(b, str) else json.dumps(b)) for i, (s, b, _) in enumerate(ANSWERS)] + [(99, "chat", None)]
    out = {r[0]: tuple(r)[3:] for r in wire.read_answers(spark.createDataFrame(rows, "id int, shape string, body string")).collect()}
    assert out == {i: want for i, (_, _, want) in enumerate(ANSWERS)} | {99: (None,) * 7 + ("json",)}


def test_requests_keep_what_they_do_not_know(spark):
    chat = {"model": "m", "messages": [{"role": "system", "content": "be brief"}, {"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}], "top_k": 4, "tools": [{"x": 1}]}
    blocks = {"model": "n", "system": [{"type": "text", "text": "S"}], "messages": [{"role": "user", "content": "q"}]}
    parts = {"contents": [{"role": "user", "parts": [{"text": "q"}]}, {"role": "model", "parts": [{"text": "r"}]}], "systemInstruction": {"parts": [{"text": "S"}]}, "generationConfig": {"n": 1}}
    df = spark.createDataFrame([(i, s, json.dumps(b)) for i, (s, b) in enumerate([("chat", chat), ("blocks", blocks), ("parts", parts), ("chat", [1])])], "id int, shape string, body string")
    out = {r["id"]: r["r"] for r in df.select("id", wire.request(F.col("body"), F.col("shape")).alias("r")).collect()}
    assert (out[0]["model"], out[0]["system"], [tuple(m) for m in out[0]["messages"]], out[0]["extra"]) == ("m", "be brief", [("user", "ab")], {"top_k": "4", "tools": '[{"x":1}]'})
    assert (out[1]["system"], out[1]["extra"]) == ("S", {}) and (out[2]["system"], [tuple(m) for m in out[2]["messages"]], out[2]["extra"]) == ("S", [("user", "q"), ("assistant", "r")], {"generationConfig": '{"n":1}'})
    assert out[3]["model"] is None and out[3]["messages"] is None


USER = {"role": "user", "content": "q"}


@pytest.mark.parametrize(
    ("body", "why"),
    [
        ({"model": "m", "messages": [USER]}, None), ({"model": "m", "messages": [USER], "stream": True, "stream_options": {"include_usage": True}, "stop": ["a"], "temperature": 0.5, "max_tokens": 3, "n": 1}, None),
        ("[]", "body: not a JSON object"), ("{", "body: not a JSON object"), ({"model": "m", "messages": [USER], "tools": [], "logprobs": 1}, "logprobs: unsupported"), ({"messages": [USER]}, "model: required"), ({"model": "m", "messages": [USER], "n": 2}, "n: must be 1"),
        ({"model": "m", "messages": []}, "messages: required"), ({"model": "m", "messages": [1]}, "messages: not an object"), ({"model": "m", "messages": [USER, {"role": "user", "content": "x", "name": "n"}]}, "messages[1].name: unsupported"),
        ({"model": "m", "messages": [USER, {"role": "system", "content": "x"}]}, "messages: system after the conversation began"), ({"model": "m", "messages": [{"role": "tool", "content": "x"}]}, "messages[0].role: unsupported"),
        ({"model": "m", "messages": [{"role": "user", "content": [{"type": "image"}]}]}, "messages[0]: content is no text"), ({"model": "m", "messages": [{"role": "developer", "content": "x"}]}, "messages: no user or assistant"),
        ({"model": "m", "messages": [USER], "max_tokens": 1, "max_completion_tokens": 1}, "max_completion_tokens: given twice"), ({"model": "m", "messages": [USER], "max_tokens": "9"}, "max_tokens: not an integer"), ({"model": "m", "messages": [USER], "temperature": "hot"}, "temperature: not a number"),
        ({"model": "m", "messages": [USER], "stop": [1]}, "stop: no strings"), ({"model": "m", "messages": [USER], "stream": 1}, "stream: not a boolean"), ({"model": "m", "messages": [USER], "stream_options": {}}, "stream_options: without stream"),
    ],
)
def test_refusals(spark, body, why):
    text = body if isinstance(body, str) else json.dumps(body)
    assert spark.createDataFrame([(text,)], "body string").select(wire.refusal(F.col("body"))).first()[0] == why


def test_an_answer_goes_back_as_a_completion(spark):
    shape, body, _ = ANSWERS[6]
    df = spark.createDataFrame([(shape, json.dumps(body))], "shape string, body string")
    out = json.loads(df.select(wire.completion(wire.answer(F.col("body"), F.col("shape")), F.lit("u1"), F.lit(5)).alias("c")).first()["c"])
    assert out["id"] == "chatcmpl-u1" and out["choices"][0]["message"]["content"] == "yes" and out["choices"][0]["finish_reason"] == "stop"
    assert out["usage"] == {"prompt_tokens": 13, "completion_tokens": 2, "total_tokens": 15, "prompt_tokens_details": {"cached_tokens": 5, "cache_write_tokens": 1}}
