"""Personal data in documents: detection, reversible masking, checks and restoring.

A document is masked as a whole, since one placeholder stands for a value wherever it occurs. Detection and masking need
offsets, and so run in Python over Arrow batches, a document at a time; everything that counts or joins is DataFrame work.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywick.functions.patterns import HEALTH_LABEL, HEALTH_LABELLED, HEALTH_WINDOW, RECOGNISERS
from tallywick.functions.text import luhn_digits
from tallywick.operators.chain import dealt

SPAN = "struct<start:int,end:int,entity_type:string,score:double,recogniser:string>"
_COMPILED = [(name, kind, re.compile(p, re.I if "i" in flags else 0), group, score) for name, kind, flags, p, group, score in RECOGNISERS]
# The types that an allow list may release.
RELEASABLE = frozenset({"LOCATION", "ORGANISATION"})
_PRIORITY = {name: i for i, (name, *_) in enumerate(_COMPILED)}
_HEALTH = re.compile(HEALTH_LABEL, re.I)
_DIGIT = re.compile(r"\d")
#: What a second pass masks wherever it stands: tokens shaped like an identifier, and addresses no recogniser took.
_TOKEN = re.compile(r"[^\W_][\w/.\-]*[^\W_]")
#: A placeholder in brackets, in any case, with a few spaces, hyphens and leading zeros; or bare, as it was written.
_KIND = r"[A-Za-z]{1,24}(?:[_\-\s]{1,4}[A-Za-z]{1,24}){0,3}"
_NUMBER = r"\d{1,9}(?:\.\d{1,3})?"
_PLACEHOLDER = re.compile(rf"<\s{{0,4}}({_KIND})[_\-\s]{{1,4}}0{{0,8}}({_NUMBER})\s{{0,4}}>|(?<![A-Za-z0-9_])([A-Z]{{1,24}}(?:_[A-Z]{{1,24}}){{0,3}})_({_NUMBER})(?![A-Za-z0-9_])")
#: No placeholder is longer. What may yet become one, at the end of a text: an open bracket, or a word in capitals.
LONGEST = 160
_UNFINISHED = re.compile(r"<[\sA-Za-z0-9_.\-]*\Z|(?<![A-Za-z0-9_])[A-Z][A-Z0-9_.]*\Z")


def detect(text: str) -> list[tuple[int, int, str, float, str]]:
    """All recognisers' spans: start, end, type, score, recogniser. A span ends at its first line break."""
    out = []
    # Addresses have an @, everything else has a digit; most texts have neither.
    able = {True: "@" in text, False: bool(_DIGIT.search(text))}
    for name, kind, pattern, group, score in _COMPILED:
        if not able[name == "email"]:
            continue
        for m in pattern.finditer(text):
            start, end = m.span(group)
            if name == "sin" and not luhn_digits(re.sub(r"\D", "", m.group())):
                continue
            own = HEALTH_LABELLED if name == "health-number" and _HEALTH.search(text, max(0, start - HEALTH_WINDOW), start) else score
            end = start + len(re.split(r"[\r\n]", text[start:end], maxsplit=1)[0].rstrip())
            if end > start:
                out.append((start, end, kind, own, name))
    return out


def resolve(spans: list[tuple]) -> list[tuple]:
    """One span per stretch of text. A span strictly inside another one goes, whatever its score. Of those that overlap
    then, the best stays: by score, then length, then the recogniser's place in the list, then position.

    One sweep by start finds what is contained, since the furthest end so far tells; the others are in order of both
    ends, so what a span overlaps are its neighbours, and taking the best first needs a look at the nearest kept ones.
    """
    outer, reach = [], (-1, 0)
    for s in sorted(spans, key=lambda s: (s[0], -s[1])):
        if s[1] > reach[1] or (s[0], s[1]) == reach:
            outer.append(s)
            reach = (s[0], s[1])
    kept: list[tuple] = []
    starts: list[int] = []
    for s in sorted(outer, key=lambda s: (-s[3], s[0] - s[1], _PRIORITY.get(s[4], len(_PRIORITY)), s[0])):
        at = bisect.bisect_left(starts, s[1])
        if at == 0 or kept[at - 1][1] <= s[0]:
            at = bisect.bisect_left(starts, s[0])
            starts.insert(at, s[0])
            kept.insert(at, s)
    return kept


def _kind(placeholder: str) -> str:
    return placeholder[1:-1].rsplit("_", 1)[0]


def _identifier(token: str) -> bool:
    digits, letters = sum(c.isdigit() for c in token), sum(c.isalpha() for c in token)
    return digits >= 5 or (letters > 0 and digits >= 2)


def mask(text: str, allow: frozenset[str] = frozenset(), carried: dict[str, str] | None = None) -> tuple[str, dict[str, str], list[tuple]]:
    """Masked text, vault (placeholder to value) and spans. Placeholders are numbered per type by first mention; equal
    values, but for case and spacing, share one. Placeholder-shaped text of the document itself is masked too, so that
    nothing in it can be mistaken for one of ours. What is allowed releases places and organisations, and tokens that only
    look like an identifier; never a value that a recogniser took for a person's. A carried vault's values keep their placeholders and are masked wherever
    they stand; new ones are numbered after them."""
    spans = [s for s in resolve(detect(text)) if s[2] not in RELEASABLE or text[s[0] : s[1]].casefold() not in allow]
    foreign = [(m.start(), m.end(), "ID_LIKE", 0.5, "placeholder") for m in _PLACEHOLDER.finditer(text)]
    taken = [(s, e) for s, e, *_ in spans]
    taken.sort()

    def clear(s: int, e: int) -> bool:
        at = bisect.bisect_left(taken, (e, -1))
        return at == 0 or taken[at - 1][1] <= s

    for s in foreign:
        if clear(s[0], s[1]):
            spans.append(s)
            bisect.insort(taken, s[:2])
    # A value that was recognised once is masked wherever else it stands, also where its surroundings hid it.
    known = {v.casefold(): (0, 0, _kind(p), 0.95, "carried") for p, v in (carried or {}).items()}
    known |= {text[s[0] : s[1]].casefold(): s for s in spans}
    if known:
        for m in re.finditer("|".join(re.escape(v) for v in sorted(known, key=len, reverse=True)), text, re.I):
            if clear(*m.span()) and m.group().casefold() in known:
                spans.append((*m.span(), *known[m.group().casefold()][2:]))
                bisect.insort(taken, m.span())
    at = 0
    for lo, hi in [*taken, (len(text), len(text))]:
        for m in _TOKEN.finditer(text, at, lo):
            if _identifier(m.group()) and m.group().casefold() not in allow:
                spans.append((*m.span(), "EMAIL" if "@" in m.group() else "ID_LIKE", 0.5, "second-pass"))
        at = hi
    spans.sort()
    vault, names, counts, out, at = dict(carried or {}), {}, {}, [], 0
    for placeholder, value in vault.items():
        kind = _kind(placeholder)
        key = kind, " ".join(value.casefold().split())
        names[(kind, value, "as written") if key in names else key] = placeholder
        counts[kind] = max(counts.get(kind, 0), int(placeholder[1:-1].rsplit("_", 1)[1].split(".")[0]))
    for start, end, kind, _, _ in spans:
        value = text[start:end]
        key = kind, " ".join(value.casefold().split())
        if key not in names:
            counts[kind] = counts.get(kind, 0) + 1
            names[key] = f"<{kind}_{counts[kind]}>"
            vault[names[key]] = value
        elif vault[names[key]] != value:
            # The same value written otherwise gets a placeholder of its own, or restoring would not give the text back.
            other = kind, value, "as written"
            if other not in names:
                counts[kind] = counts.get(kind, 0) + 1
                names[other] = f"<{kind}_{counts[kind]}>"
                vault[names[other]] = value
            key = other
        out += [text[at:start], names[key]]
        at = end
    return "".join([*out, text[at:]]), vault, spans


def restore(text: str, vault: dict[str, str]) -> str:
    """Values back for placeholders, tolerant of case, spaces, hyphens and leading zeros inside the brackets. Without
    brackets a placeholder must be as it was written, and a word of its own."""

    def one(m: re.Match[str]) -> str:
        kind, number = (m[1], m[2]) if m[1] else (m[3], m[4])
        whole, *part = number.split(".")
        return vault.get(f"<{re.sub(r'[_\-\s]+', '_', kind).upper()}_{'.'.join([str(int(whole)), *part])}>", m[0])

    return _PLACEHOLDER.sub(one, text)


def unresolved(text: str, vault: dict[str, str]) -> list[str]:
    return [m[0] for m in _PLACEHOLDER.finditer(text) if restore(m[0], vault) == m[0]]


#: Without a digit of any kind or an @ a text holds nothing that a recogniser or the second pass takes, nor a placeholder.
_ABLE = r"[\p{N}@]"
REDACTED = f"doc_id long, masked string, vault map<string,string>, spans array<{SPAN}>, clashes int"
#: Texts that a Python worker holds beside their results; an Arrow batch, which has up to 10,000, is cut into these.
SLICE = 32
_ARROW_VAULT = pa.map_(pa.string(), pa.string())
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("entity_type", pa.string()), ("score", pa.float64()), ("recogniser", pa.string())]))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: list[str] | None = None) -> DataFrame:
    """doc_id, masked, vault, spans of every document, and how many of the placeholders used its text had already; null
    text stays null. Documents that can hold nothing are told apart by one pattern and never leave the JVM."""
    allowed = frozenset(a.casefold() for a in allow or ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                texts = some.column(1).to_pylist()
                masked, vaults, spans = zip(*[mask(t, allowed) for t in texts], strict=True)
                told = [[dict(zip(("start", "end", "entity_type", "score", "recogniser"), s, strict=True)) for s in own] for own in spans]
                clashes = [sum(p in t for p in v) for t, v in zip(texts, vaults, strict=True)]
                columns = [some.column(0), pa.array(masked, pa.string()), pa.array([list(v.items()) for v in vaults], _ARROW_VAULT), pa.array(told, _ARROW_SPANS), pa.array(clashes, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "masked", "vault", "spans", "clashes"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    able = F.coalesce(F.col("text").rlike(_ABLE), F.lit(False))
    empty = [F.create_map().cast("map<string,string>").alias("vault"), F.array().cast(f"array<{SPAN}>").alias("spans"), F.lit(0).alias("clashes")]
    return own.filter(able).mapInArrow(run, REDACTED).union(own.filter(~able).select("doc_id", F.col("text").alias("masked"), *empty))


def redact_requests(turns: DataFrame, by: str = "conv_id", order: str = "turn", text_col: str = "text", allow: list[str] | None = None) -> DataFrame:
    """Requests of several messages, each request under one vault: by, order, masked, vault.

    First the messages of each request stream by in order and the vault grows; then every message is masked with the whole
    vault, so that a value is masked also in messages before the one that told what it is. Only messages that can hold
    something take part in the first pass, and the second has no order.
    """
    allowed = frozenset(a.casefold() for a in allow or ())

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, vault = None, {}
        for batch in batches:
            done = []
            for key, text in zip(batch["key"], batch["text"], strict=True):
                if key != at:
                    if vault:
                        done.append((at, vault))
                    at, vault = key, {}
                vault = mask(text, allowed, vault)[1]
            yield pd.DataFrame(done, columns=["key", "vault"])
        if vault:
            yield pd.DataFrame([(at, vault)], columns=["key", "vault"])

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            masked = [mask(t, allowed, dict(v))[0] for t, v in zip(batch["text"], batch["vault"], strict=True)]
            yield pd.DataFrame({"key": batch["key"], "place": batch["place"], "masked": masked, "vault": batch["vault"]})

    own = turns.select(F.col(by).cast("long").alias("key"), F.col(order).cast("long").alias("place"), F.col(text_col).alias("text"))
    told = own.filter(F.col("text").rlike(_ABLE)).repartition("key").sortWithinPartitions("key", "place")
    vaults = told.mapInPandas(grow, "key long, vault map<string,string>")
    both = own.join(vaults, "key", "left")
    able = F.col("vault").isNotNull() & F.col("text").isNotNull()
    masked = both.filter(able).mapInPandas(cover, "key long, place long, masked string, vault map<string,string>")
    rest = both.filter(~able).select("key", "place", F.col("text").alias("masked"), F.coalesce("vault", F.create_map().cast("map<string,string>")).alias("vault"))
    return masked.union(rest).toDF(by, order, "masked", "vault")


def outbound(redacted: DataFrame, allow: list[str] | None = None) -> DataFrame:
    """What may be sent of masked documents: doc_id, masked (null where refused) and refusals, a count by kind.

    Refused is what the guard finds of values and shapes, and a text that had, before it was masked, one of the
    placeholders that were then used for something else. Digits of a value alone are reported by leaks(), and refuse
    nothing: three digits in a row may be anyone's."""
    found = leaks(redacted, allow).filter("kind <> 'digits'").groupBy("doc_id", "kind").agg(F.sum("leaked").alias("n"))
    clashes = redacted.filter("clashes > 0").select("doc_id", F.lit("placeholder").alias("kind"), F.col("clashes").cast("long").alias("n"))
    told = found.union(clashes).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("refusals"))
    both = redacted.select("doc_id", "masked").join(told, "doc_id", "left")
    return both.select("doc_id", F.when(F.col("refusals").isNull(), F.col("masked")).alias("masked"), "refusals")


class StreamRestorer:
    """Values back for placeholders in a text that arrives in pieces: its end waits as long as it may be the beginning of
    a placeholder, so the pieces together are the whole text restored, wherever they are cut."""

    def __init__(self, vault: dict[str, str]):
        self.vault, self.rest, self.within = vault, "", ""

    def _told(self, text: str, end: int) -> str:
        """What is handed on of a text; ``within`` stands for a word that was handed on up to its middle."""
        out = restore(self.within + text[:end], self.vault)[len(self.within) :]
        if end:
            self.within = "x" if text[end - 1].isascii() and (text[end - 1].isalnum() or text[end - 1] == "_") else ""
        self.rest = text[end:]
        return out

    def feed(self, piece: str) -> str:
        text = self.rest + piece
        known = self.within + text
        waits = _UNFINISHED.search(known, max(0, len(known) - LONGEST))
        return self._told(text, waits.start() - len(self.within) if waits else len(text))

    def finish(self) -> str:
        return self._told(self.rest, len(self.rest))


def restore_streams(pieces: DataFrame, vaults: DataFrame) -> DataFrame:
    """Pieces (stream_id, seq, text) of answers with their vaults (stream_id, vault) to stream_id, seq, text, the pieces in
    which the restored text may be handed on. A stream's pieces are joined one after the other; its rest is one more. Its
    vault comes once, before its pieces, and not with each of them, so that what is sorted is little more than the pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last, restorer = None, 0, None
        for batch in batches:
            rows = []
            for stream_id, seq, text, vault in zip(batch["stream_id"], batch["seq"], batch["text"], batch["vault"], strict=True):
                if restorer is None or stream_id != at:
                    if restorer is not None:
                        rows.append((at, last + 1, restorer.finish()))
                    at, restorer = stream_id, StreamRestorer({})
                if vault is not None:
                    restorer.vault, last = dict(vault), 0
                    continue
                rows.append((stream_id, seq, restorer.feed(text or "")))
                last = seq
            yield pd.DataFrame(rows, columns=["stream_id", "seq", "text"])
        if restorer is not None:
            yield pd.DataFrame([(at, last + 1, restorer.finish())], columns=["stream_id", "seq", "text"])

    first = vaults.filter("stream_id IS NOT NULL AND vault IS NOT NULL").select("stream_id", F.lit(0).cast("long").alias("seq"), F.lit(None).cast("string").alias("text"), "vault")
    own = pieces.select("stream_id", "seq", "text", F.lit(None).cast("map<string,string>").alias("vault")).unionByName(first)
    ordered = own.repartition(dealt("stream_id")).sortWithinPartitions("stream_id", F.col("vault").isNull(), "seq")
    return ordered.mapInPandas(run, "stream_id long, seq long, text string").filter("text <> ''")


@F.arrow_udf(T.StringType())
def _restored(masked: pa.Array, vault: pa.Array) -> pa.Array:
    return pa.array((restore(m.as_py(), dict(v.as_py())) if m.is_valid else None for m, v in zip(masked, vault, strict=True)), pa.string())


def restored(masked: Column | str, vault: Column | str) -> Column:
    """Values back for placeholders: see restore. A text whose vault is empty is as it was, and never leaves the JVM."""
    text, values = (F.col(c) if isinstance(c, str) else c for c in (masked, vault))
    some = F.size(values) > 0
    return F.when(some, _restored(F.when(some, text), F.when(some, values))).otherwise(text)


def leaks(redacted: DataFrame, allow: list[str] | None = None) -> DataFrame:
    """What a guard would refuse masked texts for, counts only: doc_id, kind, entity_type, leaked.

    Kinds are ``value`` (a value of the vault), ``digits`` (of a value that isn't there whole, a run of three or more of
    its digits) and ``shape`` (what a recogniser or the second pass would mask). Placeholders are cut out first. A run may
    also be in the text by chance; it is reported, since a guard can't tell."""
    bare = F.regexp_replace("masked", r"<[A-Z_]+_\d+(\.\d+)?>", "\n")
    values = redacted.select("doc_id", bare.alias("bare"), F.explode("vault").alias("placeholder", "value"))
    runs = F.regexp_extract_all(F.replace("value", F.lit(" ")), F.lit(r"([0-9]{3,})"), F.lit(1))
    kind = F.when(F.instr(F.lower("bare"), F.lower(F.col("value"))) > 0, "value").when(F.exists(runs, lambda r: F.col("bare").contains(r)), "digits")
    known = values.select("doc_id", kind.alias("kind"), F.regexp_extract("placeholder", r"<(.+)_\d+(?:\.\d+)?>", 1).alias("entity_type")).filter("kind IS NOT NULL")
    allowed = frozenset(a.casefold() for a in allow or ())

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def shapes(texts: pd.Series) -> pd.Series:
        return pd.Series([[s[2] for s in mask(t, allowed)[2]] if t is not None else [] for t in texts])

    able = redacted.select("doc_id", bare.alias("bare")).filter(F.col("bare").rlike(_ABLE))
    left = able.select("doc_id", F.lit("shape").alias("kind"), F.explode(shapes("bare")).alias("entity_type"))
    return known.unionByName(left).groupBy("doc_id", "kind", "entity_type").agg(F.count(F.lit(1)).alias("leaked"))


def survives(value: Column, output: Column, background: Column) -> Column:
    """Whether a value, or a run of three or more of its digits that the background lacks, is in an output."""
    runs = F.regexp_extract_all(value, F.lit(r"([0-9]{3,})"), F.lit(1))
    return (F.instr(output, value) > 0) | F.exists(runs, lambda r: output.contains(r) & ~background.contains(r))
