"""Rules about single requests, answers and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an inline image counts as, the namespace of old rows' identifiers, titles, signs about names, and
# the closed list of data classes.
IMAGE_CHARS = 28_000
INLINE_IMAGE = r'(?:;base64,|"data"\s*:\s*")([A-Za-z0-9+/]{1000,}={0,2})'
LEGACY_NAMESPACE = "b0f1d2c34a5b6c7d8e9f0a1b2c3d4e5f"
HONORIFICS = ["mr", "mrs", "ms", "mx", "miss", "dr", "prof", "hon", "sir", "madam", "rev", "sgt", "cst"]
NAME_SIGNS = ".,;:'’"
DATA_CLASSES = ["public", "internal", "personal", "sensitive"]
DECLINE = (
    r"\b(?:document|passage|text|page|source)\b[^.]{0,60}?\b(?:does\s*n[o']t|doesn['’]t|do\s+not|did\s+not|isn['’]t|is\s+not|makes?\s+no|contains?\s+no|"
    r"provides?\s+no|gives?\s+no|offers?\s+no|has\s+no|only)\b|\b(?:not|no)\s+(?:specified|stated|mentioned|covered|addressed|provided|included|found|"
    r"information)\b[^.]{0,40}\b(?:document|passage|text)\b|\bcannot\s+(?:answer|determine|find)\b|\bcan['’]t\s+(?:answer|determine|find)\b|"
    r"\bunable\s+to\s+(?:answer|determine|find)\b"
)
DECLINE_MORE = r"\bthere\s+(?:is|are)\s+no\s+(?:information|mention|details?|data)\b|\bno\s+information\s+(?:about|on|regarding)\b"
INTERVAL = r"(-?[0-9.]+%?) \((-?[0-9.+]+%?) to (-?[0-9.+]+%?)\)"


def image_aware_length(body: Column) -> Column:
    """Bytes of a request body, each inline base64 image counted as IMAGE_CHARS instead of its own length."""
    images = F.regexp_extract_all(body, F.lit(INLINE_IMAGE), F.lit(1))
    return F.aggregate(images, F.octet_length(body).cast("long"), lambda n, i: n + IMAGE_CHARS - F.length(i))


def legacy_uid(*parts: Column) -> Column:
    """The name-based UUID (version 5) of a row's parts, as 32 hex digits; a null part is spelled None."""
    key = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    h = F.sha1(F.concat(F.unhex(F.lit(LEGACY_NAMESPACE)), F.encode(key, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("long").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))


def name_shaped(token: Column) -> Column:
    """Whether case alone says that a word may be part of a name: two letters or more, the first a capital, and three
    where all are capitals. Scripts without case never are."""
    letters = F.regexp_replace(token, r"\P{L}+", "")
    return letters.rlike(r"^\p{Lu}\p{L}") & ((F.length(letters) > 2) | ~letters.rlike(r"^\p{Lu}+$"))


def name_parts(name: Column) -> Column:
    """The parts of a name at spaces and hyphens, without signs at their ends, single letters and titles."""
    parts = F.transform(F.split(F.replace(name, F.lit("-"), F.lit(" ")), r"\s+"), lambda p: F.btrim(p, F.lit(NAME_SIGNS)))
    return F.filter(parts, lambda p: (F.length(p) >= 2) & ~F.lower(p).isin(HONORIFICS))


def declines(text: Column, extended: bool = False) -> Column:
    """Whether an answer says that its source does not cover the question."""
    said = F.coalesce(text, F.lit(""))
    plain = said.rlike(f"(?iU){DECLINE}")
    return plain | said.rlike(f"(?iU){DECLINE_MORE}") if extended else plain


def addresses(text: Column, name: Column) -> Column:
    """Whether an answer has a name, or its first word as a word."""
    first = F.regexp_replace(F.split(name, r"\s+")[0], r"([\\\[\](){}.*+?^$|])", r"\\$1")
    return F.contains(text, name) | F.regexp_like(text, F.concat(F.lit(r"(?U)\b"), first, F.lit(r"\b")))


def interval(text: Column) -> Column:
    """``v (lo to hi)`` of a text as three numbers; null where there is none."""
    number = lambda k: F.rtrim(F.regexp_extract(text, INTERVAL, k), F.lit("%")).try_cast("double")
    return F.when(text.rlike(INTERVAL), F.struct(number(1).alias("value"), number(2).alias("low"), number(3).alias("high")))


def data_class(header: Column) -> Column:
    """The class that a header declares: personal where absent or blank; null where it is none of the closed list."""
    given = F.lower(F.btrim(header))
    return F.when(F.coalesce(given, F.lit("")) == "", "personal").when(given.isin(DATA_CLASSES), given)


def cap_resets(scope: Column, now: Column) -> Column:
    """When a cap counts anew: the next day's or month's first instant; never for a run."""
    day = F.date_trunc("DAY", now) + F.expr("INTERVAL 1 DAY")
    return F.when(scope == "day", day).when(scope == "month", F.date_trunc("MONTH", F.add_months(now, 1)))


def dollars(v: Column) -> Column:
    """Four decimals below a dollar, else two."""
    return F.concat(F.lit("US$"), F.when(v < 1, F.format_number(v, 4)).otherwise(F.format_number(v, 2)))


def milliseconds(v: Column) -> Column:
    return F.coalesce(F.format_number(v, 0), F.lit("-"))


def short_model(model: Column) -> Column:
    return F.substring_index(model, "/", -1)


def caller_scoped(vault: Column, said: Column) -> Column:
    """A vault's entries whose value the caller's own messages have."""
    return F.map_filter(vault, lambda _, v: F.contains(said, v))


def whole_answer(status: Column, text: Column, finish: Column) -> Column:
    """Whether an answer may be kept: a 2xx, not empty, ended by itself. ``finish`` is in the standard words."""
    return F.coalesce(status.between(200, 299) & (text != "") & (finish == "stop"), F.lit(False))


def cache_key(method: Column, url: Column, body: Column) -> Column:
    return F.sha2(F.concat(method, F.lit("\n"), url, F.lit("\n"), body), 256)


def with_route_extra(route: Column, caller: Column) -> Column:
    """A route's fixed fields under the caller's own, which win."""
    none = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(route, none), F.coalesce(caller, none), lambda _, r, c: F.coalesce(c, r))
