"""The injection screen: rules over what users wrote, reported by name and place, never by text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywick.functions.patterns import RULE_NAMES, SCREEN, java


def rules_fired(text: Column) -> Column:
    """The rules that match, each once, in order of definition. Matching stays in the JVM."""
    hit = lambda name: [text.rlike(java(flags, pattern)) for n, flags, pattern in SCREEN if n == name]
    named = []
    for name in RULE_NAMES:
        any_ = F.lit(False)
        for one in hit(name):
            any_ = any_ | one
        named.append(F.when(F.coalesce(any_, F.lit(False)), name))
    return F.array_compact(F.array(*named))


def screen_turns(turns: DataFrame) -> DataFrame:
    """The user turns of conversations, with the rules that fired on each."""
    return turns.filter("role = 'user'").withColumn("rules", rules_fired(F.col("text")))


def findings(turns: DataFrame) -> DataFrame:
    """Every match as rule and offsets (conv_id, turn, rule, start, end): offsets need Python's matcher, and so only the
    turns that some rule matches reach it."""
    compiled = [(name, re.compile(pattern, sum({"i": re.I, "m": re.M}[f] for f in flags))) for name, flags, pattern in SCREEN]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(c, t, name, m.start(), m.end()) for c, t, text in zip(batch["conv_id"], batch["turn"], batch["text"], strict=True) for name, p in compiled for m in p.finditer(text)]
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "rule", "start", "end"])

    flagged = screen_turns(turns).filter(F.size("rules") > 0).select("conv_id", "turn", "text")
    return flagged.mapInPandas(find, "conv_id long, turn long, rule string, start int, end int")


def rule_counts(screened: DataFrame) -> DataFrame:
    return screened.select(F.explode("rules").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("requests"))
