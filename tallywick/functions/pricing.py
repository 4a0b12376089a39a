"""Cost and estimate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_KINDS = [("input_tokens", "input"), ("output_tokens", "output"), ("cache_read_tokens", "cache_read"), ("cache_write_tokens", "cache_write")]


def tiered(rate: str) -> Column:
    """A rate, or that of long prompts where fresh, read and written tokens together exceed the tier's threshold."""
    prompt = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")
    return F.when(prompt > F.col("above_tokens"), F.col(f"long_{rate}")).otherwise(F.col(rate))


def cost() -> Column:
    """Tokens times rates per million. A kind of tokens that occurs but has no rate, or a batch without a multiplier, has no cost."""
    total = F.lit(0.0)
    missing = F.lit(False)
    for tokens, rate in _KINDS:
        n, r = F.col(tokens), tiered(rate)
        total = total + F.when(n > 0, n / F.lit(1e6) * F.coalesce(r, F.lit(0.0))).otherwise(0.0)
        missing = missing | ((n > 0) & r.isNull())
    missing = missing | (F.col("batch") & F.col("batch_multiplier").isNull())
    total = F.when(F.col("batch"), total * F.col("batch_multiplier")).otherwise(total)
    return F.when(~missing & F.col("input").isNotNull(), F.bround(total, 10))


def estimate(chars: Column, max_tokens: Column) -> Column:
    """What a call may cost at most: 3.5 characters a token and the full answer; the long tier from half its threshold on."""
    tokens = chars / 3.5
    long = tokens * 2 > F.col("above_tokens")
    rate_in = F.when(long, F.col("long_input")).otherwise(F.col("input"))
    rate_out = F.when(long, F.col("long_output")).otherwise(F.col("output"))
    return F.bround(tokens / F.lit(1e6) * rate_in + max_tokens / F.lit(1e6) * rate_out, 10)
