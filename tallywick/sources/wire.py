"""Vendors' requests and answers, read from their JSON bodies as variants: three shapes, known fields as columns, all else
kept. Nothing here raises on a body: what is broken or of another shape says so in a column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shapes of bodies: chat completions, messages with content blocks, and contents with parts.
CHAT, BLOCKS, PARTS = "chat", "blocks", "parts"
# The fields that a chat request may have, its roles, and the vendors' words for why an answer ended.
ACCEPTED = ["model", "messages", "max_tokens", "max_completion_tokens", "temperature", "stop", "stream", "stream_options", "n", "user"]
SYSTEM_ROLES, ROLES = ["system", "developer"], ["user", "assistant"]
FINISH = {"end_turn": "stop", "stop_sequence": "stop", "max_tokens": "length", "safety": "content_filter", "blocked": "content_filter", "refusal": "content_filter", "recitation": "content_filter"}


def parsed(body: Column) -> Column:
    """The body as a variant; null where it is no JSON."""
    return F.try_parse_json(body)


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("NONE"))


def _is(v: Column, kind: str) -> Column:
    return F.startswith(_kind(v), F.lit(kind))


def _string(v: Column, path: str = "$") -> Column:
    """The string at a path; null where there is something else."""
    return F.when(_is(_at(v, path), "STRING"), F.try_variant_get(v, path, "string"))


def _list(v: Column, path: str = "$") -> Column:
    return F.when(_is(_at(v, path), "ARRAY"), F.try_variant_get(v, path, "array<variant>"))


def _number(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "long"), F.lit(0).cast("long"))


def _first_text(parts: Column, wanted) -> Column:
    return F.get(F.transform(F.filter(parts, wanted), lambda p: F.coalesce(_string(p, "$.text"), F.try_variant_get(p, "$.text", "string"), F.lit(""))), F.lit(0))


def text_of(content: Column, joined: bool = True) -> Column:
    """The text of a message's content: a string, or its text parts, joined or the first of them."""
    typed = lambda p: _string(p, "$.type") == "text"
    parts = _list(content)
    many = F.array_join(F.transform(F.filter(parts, lambda p: _at(p, "$.text").isNotNull()), lambda p: F.coalesce(_string(p, "$.text"), F.lit(""))), "") if joined else _first_text(parts, typed)
    return F.coalesce(_string(content), many)


def answer(body: Column, shape: Column) -> Column:
    """A struct of an answer's body: text (its first), finish_reason (lower case), model_returned, the token counts, and
    error: ``json`` for what is none, ``shape`` for an object that is no answer of that shape.

    Fresh input is the prompt less what came from a cache or was written to one, not below 0; thoughts are output.
    """
    v = parsed(body)
    chat, blocks, parts = (shape == s for s in (CHAT, BLOCKS, PARTS))
    blocked = _at(v, "$.candidates").isNull() & _at(v, "$.promptFeedback").isNotNull()
    whole = F.when(chat, _list(v, "$.choices").isNotNull()).when(blocks, F.coalesce(_string(v, "$.type") == "message", F.lit(False))).when(parts, _list(v, "$.candidates").isNotNull() | blocked)
    error = F.when(v.isNull(), "json").when(~F.coalesce(whole, F.lit(False)), "shape")
    thought = lambda p: _at(p, "$.text").isNotNull() & ~F.coalesce(F.try_variant_get(p, "$.thought", "boolean"), F.lit(False))
    text = (
        F.when(chat, text_of(_at(v, "$.choices[0].message.content"), joined=False))
        .when(blocks, _first_text(_list(v, "$.content"), lambda p: _string(p, "$.type") == "text"))
        .when(parts, _first_text(_list(v, "$.candidates[0].content.parts"), thought))
    )
    finish = F.when(chat, F.try_variant_get(v, "$.choices[0].finish_reason", "string")).when(blocks, F.try_variant_get(v, "$.stop_reason", "string")).otherwise(F.when(blocked, "blocked").otherwise(F.try_variant_get(v, "$.candidates[0].finishReason", "string")))
    model = F.when(parts, _string(v, "$.modelVersion")).otherwise(_string(v, "$.model"))
    read = F.when(chat, _number(v, "$.usage.prompt_tokens_details.cached_tokens")).when(blocks, _number(v, "$.usage.cache_read_input_tokens")).otherwise(_number(v, "$.usageMetadata.cachedContentTokenCount"))
    written = F.when(chat, _number(v, "$.usage.prompt_tokens_details.cache_write_tokens")).when(blocks, _number(v, "$.usage.cache_creation_input_tokens")).otherwise(F.lit(0).cast("long"))
    prompt = F.when(chat, _number(v, "$.usage.prompt_tokens")).otherwise(_number(v, "$.usageMetadata.promptTokenCount"))
    fresh = F.when(blocks, _number(v, "$.usage.input_tokens")).otherwise(F.greatest(prompt - read - written, F.lit(0)))
    out = F.when(chat, _number(v, "$.usage.completion_tokens")).when(blocks, _number(v, "$.usage.output_tokens")).otherwise(_number(v, "$.usageMetadata.candidatesTokenCount") + _number(v, "$.usageMetadata.thoughtsTokenCount"))
    fields = {"text": text, "finish_reason": F.lower(finish), "model_returned": model, "input_tokens": fresh, "output_tokens": out, "cache_read_tokens": read, "cache_write_tokens": written}
    return F.struct(*[F.when(error.isNull(), c).alias(k) for k, c in fields.items()], error.alias("error"))


def read_answers(rows: DataFrame, body: str = "body", shape: str = "shape") -> DataFrame:
    """rows with the columns of ``answer()``."""
    return rows.withColumn("_answer", answer(F.col(body), F.col(shape))).select(*rows.columns, "_answer.*")


MESSAGES = "array<struct<role:string,content:string>>"


def request(body: Column, shape: Column) -> Column:
    """A struct of a request's body: model, system, messages (role, content), and extra, every other field as JSON text."""
    v = parsed(body)
    parts = shape == PARTS
    message = lambda m: F.struct(F.coalesce(_string(m, "$.role"), F.lit("")).alias("role"), F.coalesce(text_of(_at(m, "$.content")), F.lit("")).alias("content"))
    content = lambda m: F.struct(F.when(_string(m, "$.role") == "user", "user").otherwise("assistant").alias("role"), F.coalesce(text_of(_at(m, "$.parts")), F.lit("")).alias("content"))
    messages = F.when(parts, F.transform(_list(v, "$.contents"), content)).otherwise(F.transform(_list(v, "$.messages"), message))
    systems = F.filter(messages, lambda m: m["role"] == "system")
    system = F.when(parts, text_of(_at(v, "$.systemInstruction.parts"))).otherwise(F.coalesce(text_of(_at(v, "$.system")), F.get(F.transform(systems, lambda m: m["content"]), F.size(systems) - 1)))
    known = F.when(parts, F.array(*map(F.lit, ["model", "contents", "systemInstruction"]))).otherwise(F.array(*map(F.lit, ["model", "messages", "system"])))
    fields = F.when(_is(v, "OBJECT"), F.try_variant_get(v, "$", "map<string,variant>"))
    extra = F.transform_values(F.map_filter(fields, lambda k, _: ~F.array_contains(known, k)), lambda _, x: F.to_json(x))
    return F.struct(_string(v, "$.model").alias("model"), system.alias("system"), F.filter(messages, lambda m: m["role"] != "system").alias("messages"), extra.alias("extra"))


def refusal(body: Column) -> Column:
    """Why a chat request is refused, the first reason as ``parameter: reason``; null where it is not. A field that would
    have to be dropped is refused, so that no caller believes that it was honoured."""
    v = parsed(body)
    fields = F.array_sort(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))
    unknown = F.get(F.filter(fields, lambda k: ~k.isin(ACCEPTED)), F.lit(0))
    messages = _list(v, "$.messages")
    role = lambda m: F.coalesce(_string(m, "$.role"), F.lit(""))
    is_system = lambda m: role(m).isin(SYSTEM_ROLES)
    text = lambda m: _is(_at(m, "$.content"), "STRING") | F.coalesce(F.forall(_list(m, "$.content"), lambda p: F.coalesce((_string(p, "$.type") == "text") & _is(_at(p, "$.text"), "STRING"), F.lit(False))), F.lit(False))
    keys = lambda m: F.map_keys(F.try_variant_get(m, "$", "map<string,variant>"))

    def fault(m: Column, i: Column) -> Column:
        where = F.concat(F.lit("messages["), i.cast("string"), F.lit("]"))
        more = F.get(F.array_sort(F.filter(keys(m), lambda k: ~k.isin("role", "content"))), F.lit(0))
        talk = F.slice(messages, 1, F.greatest(i, F.lit(0)))
        late = is_system(m) & F.exists(talk, lambda x: ~is_system(x))
        return (
            F.when(~_is(m, "OBJECT"), F.lit("messages: not an object")).when(more.isNotNull(), F.concat(where, F.lit("."), more, F.lit(": unsupported")))
            .when(late, F.lit("messages: system after the conversation began")).when(~role(m).isin([*SYSTEM_ROLES, *ROLES]), F.concat(where, F.lit(".role: unsupported")))
            .when(~text(m), F.concat(where, F.lit(": content is no text")))
        )

    first = F.get(F.array_compact(F.transform(messages, fault)), F.lit(0))
    limit = F.coalesce(_at(v, "$.max_completion_tokens"), _at(v, "$.max_tokens"))
    given = lambda x: x.isNotNull() & ~_is(x, "VOID") & ~_is(x, "NONE")
    stop, temperature, stream, options, n = (_at(v, f"$.{f}") for f in ("stop", "temperature", "stream", "stream_options", "n"))
    numbers = lambda x: _is(x, "BIGINT") | _is(x, "DECIMAL") | _is(x, "DOUBLE")
    rules = [
        (v.isNull() | ~_is(v, "OBJECT"), F.lit("body: not a JSON object")),
        (unknown.isNotNull(), F.concat(unknown, F.lit(": unsupported"))),
        (F.coalesce(_string(v, "$.model"), F.lit("")) == "", F.lit("model: required")),
        (given(n) & ~F.coalesce(F.try_variant_get(v, "$.n", "long") == 1, F.lit(False)), F.lit("n: must be 1")),
        (messages.isNull() | (F.size(messages) == 0), F.lit("messages: required")),
        (first.isNotNull(), first),
        (F.forall(messages, is_system), F.lit("messages: no user or assistant")),
        (_at(v, "$.max_tokens").isNotNull() & _at(v, "$.max_completion_tokens").isNotNull(), F.lit("max_completion_tokens: given twice")),
        (given(limit) & ~_is(limit, "BIGINT"), F.lit("max_tokens: not an integer")),
        (given(temperature) & ~numbers(temperature), F.lit("temperature: not a number")),
        (given(stop) & ~_is(stop, "STRING") & ~F.coalesce(F.forall(_list(v, "$.stop"), lambda s: _is(s, "STRING")), F.lit(False)), F.lit("stop: no strings")),
        (stream.isNotNull() & ~_is(stream, "BOOLEAN"), F.lit("stream: not a boolean")),
        (given(options) & ~F.coalesce(F.try_variant_get(v, "$.stream", "boolean"), F.lit(False)), F.lit("stream_options: without stream")),
    ]
    return reduce(lambda rest, rule: F.when(F.coalesce(rule[0], F.lit(False)), rule[1]).otherwise(rest), reversed(rules), F.lit(None).cast("string"))


def finish(word: Column) -> Column:
    """The standard word for why an answer ended; one that isn't known passes through."""
    return F.coalesce(F.get(F.transform(F.array(word), lambda w: F.element_at(F.create_map(*[F.lit(x) for pair in FINISH.items() for x in pair]), w)), F.lit(0)), word)


def completion(answer_: Column, call_uid: Column, created: Column) -> Column:
    """An answer as the JSON of a chat completion. Cached input counts as part of the prompt there."""
    a = lambda f: answer_.getField(f)
    prompt = a("input_tokens") + a("cache_read_tokens") + a("cache_write_tokens")
    usage = F.struct(prompt.alias("prompt_tokens"), a("output_tokens").alias("completion_tokens"), (prompt + a("output_tokens")).alias("total_tokens"), F.struct(a("cache_read_tokens").alias("cached_tokens"), a("cache_write_tokens").alias("cache_write_tokens")).alias("prompt_tokens_details"))
    choice = F.struct(F.lit(0).alias("index"), F.struct(F.lit("assistant").alias("role"), F.coalesce(a("text"), F.lit("")).alias("content")).alias("message"), finish(a("finish_reason")).alias("finish_reason"))
    return F.to_json(F.struct(F.concat(F.lit("chatcmpl-"), F.coalesce(call_uid, F.lit("unrecorded"))).alias("id"), F.lit("chat.completion").alias("object"), created.alias("created"), a("model_returned").alias("model"), F.array(choice).alias("choices"), usage.alias("usage")))
