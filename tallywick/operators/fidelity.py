"""What became of placeholders in a model's answers: read back exactly, read back though changed, not readable, given a
title, or lost; and which ways of changing one still read back."""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywick.operators.redact import _PLACEHOLDER, restored

# The kinds of placeholders, those that an answer is asked for, and titles.
KINDS = ["PERSON", "NAME_LIKE", "ID_LIKE", "ORGANISATION", "LOCATION", "ADDRESS", "EMAIL", "PHONE", "POSTAL_CODE", "SIN", "HEALTH_NUMBER", "DATE_OF_BIRTH", "FILE_NUMBER", "EMPLOYEE_ID"]
ASKED = frozenset({"NAME_LIKE", "PERSON", "ORGANISATION", "LOCATION", "ADDRESS", "EMAIL", "PHONE", "FILE_NUMBER"})
_TITLE = re.compile(r"\b(?:Mr|Mrs|Ms|Miss|Mx|Dr|Sir|Madam)\.?\s+\Z")
_NAMES = "|".join(k.replace("_", r"[ _\-]?") for k in sorted(KINDS, key=len, reverse=True))
#: What was a placeholder once: a kind in brackets, with or without a number, a kind with a number, or one that nobody
#: writes by accident, with its underscore.
_BROKEN = re.compile(rf"[<\[]\s*(?:{_NAMES})(?:[ _\-]?\d+)?\s*[>\]]|\b(?i:{_NAMES})[ _\-]\d+\b|\b(?:{'|'.join(k for k in KINDS if '_' in k)})\b")
_WRAPS = {"[]": "square brackets", "()": "round brackets", "**": "asterisks", "``": "backticks"}

FORMS = {
    "as written": lambda k, n: F.concat(F.lit("<"), k, F.lit("_"), n, F.lit(">")),
    "lower case": lambda k, n: F.concat(F.lit("<"), F.lower(k), F.lit("_"), n, F.lit(">")),
    "capitalised": lambda k, n: F.concat(F.lit("<"), F.initcap(k), F.lit("_"), n, F.lit(">")),
    "hyphen": lambda k, n: F.concat(F.lit("<"), k, F.lit("-"), n, F.lit(">")),
    "space": lambda k, n: F.concat(F.lit("<"), k, F.lit(" "), n, F.lit(">")),
    "line break": lambda k, n: F.concat(F.lit("<"), k, F.lit("\n"), n, F.lit(">")),
    "spaces inside": lambda k, n: F.concat(F.lit("< "), k, F.lit("_"), n, F.lit(" >")),
    "all separators": lambda k, n: F.concat(F.lit("<"), F.replace(k, F.lit("_"), F.lit(" ")), F.lit("-"), n, F.lit(">")),
    "leading zero": lambda k, n: F.concat(F.lit("<"), k, F.lit("_0"), n, F.lit(">")),
    "no brackets": lambda k, n: F.concat(k, F.lit("_"), n),
    "square brackets": lambda k, n: F.concat(F.lit("["), k, F.lit("_"), n, F.lit("]")),
    "asterisks": lambda k, n: F.concat(F.lit("**"), k, F.lit("_"), n, F.lit("**")),
    "bare lower case": lambda k, n: F.concat(F.lower(k), F.lit("_"), n),
    "bare with space": lambda k, n: F.concat(k, F.lit(" "), n),
    "no number": lambda k, n: F.concat(F.lit("<"), k, F.lit(">")),
    "invented": lambda k, n: F.concat(F.lit("<"), k, F.lit("_9"), F.lpad(n, 8, "0"), F.lit(">")),
}


def _canonical(m: re.Match[str]) -> str:
    kind, number = (m[1], m[2]) if m[1] else (m[3], m[4])
    whole, *part = number.split(".")
    return f"<{re.sub(r'[_\-\s]+', '_', kind).upper()}_{'.'.join([str(int(whole)), *part])}>"


def changes(written: str, canonical: str, before: str = "", after: str = "") -> str:
    """How a placeholder that still reads differs from the one that was handed out: all differences, in a fixed order."""
    bare, inner = not written.startswith("<"), written.strip("<>")
    out = [_WRAPS.get(before + after, "no brackets")] if bare else []
    if inner != inner.strip():
        out.append("spaces inside")
    if inner != inner.upper():
        out.append("case")
    if re.search(r"[\s\-]", inner.strip()):
        out.append("separator")
    if re.search(r"[_\-\s]0\d", inner):
        out.append("leading zero")
    return " and ".join(out) or "other"


def found(text: str, known: set[str]) -> list[tuple[str, str, str]]:
    """What a text has of placeholders, in order: class (exact, tolerated, unresolved or degraded), the placeholder that it
    stands for, and how it was changed. What doesn't read counts as degraded where no placeholder that reads lies."""
    read = [(m.start(), m.end(), _canonical(m), m.group()) for m in _PLACEHOLDER.finditer(text)]
    starts, ends = [r[0] for r in read], [r[1] for r in read]
    out = []
    for start, end, own, written in read:
        kind = "unresolved" if own not in known else "exact" if written == own else "tolerated"
        out.append((start, kind, own, changes(written, own, text[max(0, start - 1) : start], text[end : end + 1]) if kind == "tolerated" else ""))
    for m in _BROKEN.finditer(text):
        if bisect.bisect_left(starts, m.end()) == bisect.bisect_right(ends, m.start()):
            out.append((m.start(), "degraded", "", ""))
    return [x[1:] for x in sorted(out)]


def titled(text: str) -> set[str]:
    """Placeholders behind a title."""
    return {_canonical(m) for m in _PLACEHOLDER.finditer(text) if _TITLE.search(text, max(0, m.start() - 12), m.start())}


def judge(answer: str | None, page: str | None, known: Iterable[str]) -> dict:
    """Counts of an answer's placeholders by class, the forms of those that were changed, and of the page's what is kept.
    ``titled`` are those that the answer gives a title and the page doesn't; titles guess at what was masked."""
    told = found(answer or "", set(known))
    n = Counter(kind for kind, _, _ in told)
    back = {own for kind, own, _ in told if kind in ("exact", "tolerated")}
    wanted = {own for own in map(_canonical, _PLACEHOLDER.finditer(page or "")) if own[1:-1].rsplit("_", 1)[0] in ASKED}
    n |= Counter(titled=len(titled(answer or "") - titled(page or "")), expected=len(wanted), kept=len(wanted & back))
    return {c: n[c] for c in COUNTS} | {"forms": dict(Counter(how for *_, how in told if how))}


COUNTS = ["exact", "tolerated", "unresolved", "degraded", "titled", "expected", "kept"]
_JUDGED = T.StructType([*[T.StructField(c, T.IntegerType()) for c in COUNTS], T.StructField("forms", T.MapType(T.StringType(), T.IntegerType()))])


@F.pandas_udf(_JUDGED)
def judged(answer: pd.Series, page: pd.Series, known: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([judge(a, p, k if k is not None else ()) for a, p, k in zip(answer, page, known, strict=True)], columns=[*COUNTS, "forms"])


def fidelity(answers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Answers (answer, page, vault) to the sums of their counts per group, and three rates: ``mutation``, placeholders that
    are not exact; ``unrecoverable``, those that can't be read; ``loss``, asked ones of the page that are not in the answer.
    Null answers and pages count as empty, a null vault as one without placeholders."""
    told = answers.select(*(by or []), judged("answer", "page", F.map_keys("vault")).alias("j"))
    sums = told.groupBy(*(by or [])).agg(*[F.coalesce(F.sum(f"j.{c}"), F.lit(0)).alias(c) for c in COUNTS])
    tokens = F.col("exact") + F.col("tolerated") + F.col("unresolved") + F.col("degraded")
    rate = lambda hits, of: F.when(of > 0, F.round(hits / of, 6))
    return sums.withColumns({"mutation": rate(tokens - F.col("exact"), tokens), "unrecoverable": rate(F.col("unresolved") + F.col("degraded"), tokens), "loss": rate(F.col("expected") - F.col("kept"), F.col("expected"))})


def forms_that_read(vaults: DataFrame) -> DataFrame:
    """Every placeholder of the vaults (column ``vault``) in each of the FORMS: form, placeholders, resolved. An invented
    one, or one without its number, must resolve to nothing."""
    own = vaults.select("vault", F.explode("vault").alias("placeholder", "value"))
    kind, number = F.regexp_extract("placeholder", r"^<(.+)_([\d.]+)>$", 1), F.regexp_extract("placeholder", r"^<(.+)_([\d.]+)>$", 2)
    tried = own.select("vault", "value", F.inline(F.array(*[F.struct(F.lit(f).alias("form"), _within(make(kind, number)).alias("text")) for f, make in FORMS.items()])))
    back = F.contains(restored("text", "vault"), F.concat(F.lit("| "), F.col("value"), F.lit(" |"))) | F.contains(restored("text", "vault"), F.concat(F.lit("|**"), F.col("value"), F.lit("**|"))) | F.contains(restored("text", "vault"), F.concat(F.lit("| ["), F.col("value"), F.lit("] |")))
    return tried.groupBy("form").agg(F.count(F.lit(1)).alias("placeholders"), F.count(F.when(back, 1)).alias("resolved"))


def _within(form: Column) -> Column:
    return F.when(F.startswith(form, F.lit("**")), F.concat(F.lit("|"), form, F.lit("|"))).otherwise(F.concat(F.lit("| "), form, F.lit(" |")))
