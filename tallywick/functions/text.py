"""Small text functions, as expressions and as helpers of the vectorised functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luhn(digits: Column) -> Column:
    """Whether a string of digits carries a valid Luhn check digit."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return (F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10) == 0


def luhn_digits(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def identifier_shaped(token: Column) -> Column:
    """Five digits or more, or at least one letter and two digits."""
    digits, letters = F.regexp_count(token, F.lit(r"[0-9]")), F.regexp_count(token, F.lit(r"\p{L}"))
    return (digits >= 5) | ((letters > 0) & (digits >= 2))


def excerpt(text: Column, n: int = 300) -> Column:
    return F.when(F.length(text) <= 2 * n, text).otherwise(F.concat(F.left(text, F.lit(n)), F.lit(" ... "), F.right(text, F.lit(n))))


def finish(word: Column) -> Column:
    """A vendor's finish reason in the standard words; unknown ones stay."""
    known = {"end_turn": "stop", "stop_sequence": "stop", "max_tokens": "length", "tool_use": "tool_calls", "safety": "content_filter"}
    lowered = F.lower(word)
    out = lowered
    for theirs, ours in known.items():
        out = F.when(lowered == theirs, ours).otherwise(out)
    return out


def backoff(attempt: Column, base: float = 0.5, most: float = 30.0) -> Column:
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt - 1))
