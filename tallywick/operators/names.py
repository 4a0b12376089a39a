"""People's names in documents: from a detector's spans to all mentions, to placeholders for people and parts of names.

What a detector found on one page holds for the whole document, so a document's pages are one unit: its spans are
gathered beside its pages, and each document is read once, in Arrow batches of documents.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywick.functions.gateway import HONORIFICS, NAME_SIGNS
from tallywick.operators.redact import RELEASABLE, _identifier, _PLACEHOLDER, detect, resolve

PERSON, NAME_LIKE, ID_LIKE = "PERSON", "NAME_LIKE", "ID_LIKE"
#: Recogniser of spans that the sweep adds; those that it calls a person anew keep theirs behind it.
SWEEP = "sweep"
#: Kinds that a bare name is mistaken for.
RETYPED = ("LOCATION", "ORGANISATION", NAME_LIKE)
# Words within a name, between two of its parts.
PARTICLES = frozenset("van der den de del della di da das dos du von zu ter ten le la bin ibn al el née nee".split())
# Initials that stand for no person.
INITIALISMS = frozenset("uk us usa eu un ussr am pm eg ie nb ad bc phd llb llm ba ma bsc msc qc kc mp cv op".split())
#: Digits that a number in several pieces has, to be somebody's; with letters its shape decides.
GROUPED_DIGITS = 8

#: Values of so many first words are looked for word by word; of more, every word of a text is looked up.
FEW = 16

_PIECE = re.compile(r"[^\W_]+|[\W_]+")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_CODE = re.compile(r"[A-Za-z0-9/()\-]+")
_ADDRESS = re.compile(r"[^\W_][\w.%+\-]*@[^\W_][\w\-]*(?:\.[^\W_][\w\-]*)+")
_TOKEN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9/\-]*[A-Za-z0-9])?")
_JOINED = re.compile(r"[ \t]+|-")


def shaped(word: str) -> bool:
    """Whether case alone says that a word may be part of a name: see functions.gateway.name_shaped."""
    letters = [c for c in word if c.isalpha()]
    return len(letters) > 1 and letters[0].isupper() and (len(letters) > 2 or not all(c.isupper() for c in letters))


def parts(name: str) -> list[str]:
    """The parts of a name at spaces and hyphens, without signs at their ends, single letters and titles."""
    bare = (p.strip(NAME_SIGNS) for p in name.replace("-", " ").split())
    return [p for p in bare if len(p) > 1 and p.casefold() not in HONORIFICS]


class Lexicon:
    """A trie over the pieces of values, words and what stands between them: finds the longest value at each word, whole
    words only, in one pass whatever the number of values."""

    def __init__(self, fold: bool):
        self.fold, self.root = fold, {}

    def _key(self, piece: str) -> str:
        return piece.casefold() if self.fold else piece

    def add(self, value: str, what) -> None:
        node, pieces = self.root, _PIECE.findall(value)
        for own in (0, -1):
            if pieces and not pieces[own][0].isalnum():
                pieces.pop(own)
        for piece in pieces:
            node = node.setdefault(self._key(piece), {})
        if pieces:
            node[None] = what

    def _starts(self, text: str) -> list[int]:
        """Where a text has a whole word that begins a value."""
        low = text.casefold() if self.fold else text
        if len(low) != len(text) or len(self.root) > FEW or (self.fold and "\u0345" in text):
            # Folding has moved the offsets or made a letter of what is none, or the values are many: look up every word.
            pieces = _PIECE.findall(text)
            ends = accumulate(map(len, pieces))
            return [e - len(p) for p, e in zip(pieces, ends, strict=True) if self._key(p) in self.root]
        out = []
        for word in self.root:
            at = low.find(word)
            while at >= 0:
                end = at + len(word)
                if not text[at - 1 : at].isalnum() and not text[end : end + 1].isalnum() and text[at:end].isalnum():
                    out.append(at)
                at = low.find(word, at + 1)
        return sorted(out)

    def find(self, text: str) -> list[tuple[int, int, object]]:
        out, done = [], 0
        for start in self._starts(text) if self.root else ():
            if start < done:
                continue
            node, last, at = self.root, None, start
            while (m := _PIECE.match(text, at)) and (node := node.get(self._key(m.group()))) is not None:
                at = m.end()
                if None in node:
                    last = at, node[None]
            if last:
                out.append((start, *last))
                done = last[0]
        return out


class Claims:
    """Stretches of a text that are taken; a later claim must be clear of all earlier ones."""

    def __init__(self):
        self.held: list[tuple[int, int, object]] = []
        self.starts: list[int] = []

    def clear(self, start: int, end: int) -> bool:
        at = bisect.bisect_left(self.starts, end)
        return at == 0 or self.held[at - 1][1] <= start

    def take(self, start: int, end: int, what) -> bool:
        if end <= start or not self.clear(start, end):
            return False
        at = bisect.bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.held.insert(at, (start, end, what))
        return True

    def gaps(self, end: int) -> Iterator[tuple[int, int]]:
        at = 0
        for s, e, _ in [*self.held, (end, end, None)]:
            if s > at:
                yield at, s
            at = e


# a span here: (page, start, end, entity type, score, recogniser) ----------------------------------------------------


def licensed(pages: dict[int, str], spans: Iterable[tuple], refused: frozenset[str] = frozenset()) -> dict[str, float]:
    """Parts of the names of detected people, as they are written, with the best score that says so. Words that are
    refused, casefolded, and parts that aren't shaped like a name license nothing."""
    out: dict[str, float] = {}
    for page, start, end, kind, score, _ in spans:
        if kind == PERSON:
            for part in parts(pages[page][start:end]):
                if part.casefold() not in refused and shaped(part):
                    out[part] = max(out.get(part, 0.0), score)
    return out


def _mentions(text: str, known: Lexicon) -> list[tuple[int, int, float]]:
    """Runs of licensed parts that only spaces, tabs or one hyphen part, with the lowest score among them."""
    out: list[tuple[int, int, float]] = []
    for start, end, score in known.find(text):
        if out and _JOINED.fullmatch(text[out[-1][1] : start]):
            out[-1] = out[-1][0], end, min(out[-1][2], score)
        else:
            out.append((start, end, score))
    return out


def sweep(pages: dict[int, str], spans: list[tuple], refused: frozenset[str] = frozenset(), retype: Iterable[str] = RETYPED) -> list[tuple]:
    """The spans, those that are nothing but a detected person's parts called a person, and every other mention of the
    parts on any page, as far as no span covers it. In the order of pages and offsets."""
    known = Lexicon(fold=False)
    for part, score in licensed(pages, spans, refused).items():
        known.add(part, score)
    out, by_page = [], {}
    for page, start, end, kind, score, by in spans:
        value = pages[page][start:end]
        if kind in retype and [m[:2] for m in _mentions(value, known)] == [(0, len(value))]:
            kind, by = PERSON, f"{SWEEP}:{by}"
        out.append((page, start, end, kind, score, by))
        by_page.setdefault(page, Claims()).take(start, end, None)
    for page, text in pages.items():
        taken = by_page.get(page, Claims())
        out += [(page, s, e, PERSON, score, SWEEP) for s, e, score in _mentions(text, known) if taken.clear(s, e)]
    return sorted(out)


def _classes(text: str, low: int, high: int, words: frozenset[str]) -> tuple[str, list[tuple[int, int]]]:
    """The words of a stretch as letters of what they may be in a name: T title, I initial, N name, P particle, - other;
    a bar stands before a word that doesn't follow closely. With each letter goes the place of its word, a bar's is empty."""
    out, places, end, last = [], [], -1, ""
    for m in _WORD.finditer(text, low, high):
        s, e, word = m.start(), m.end(), m.group()
        gap = text[end:s] if end >= 0 else "|"
        close = bool(re.fullmatch(r"[ \t]+" if last not in "TI" or not last else r"\.?[ \t]+" if last == "T" else r"\.[ \t]*|[ \t]+", gap))
        coded = text[s - 1 : s].isdigit() or text[e : e + 1].isdigit()
        if coded:
            kind = "-"
        elif word.casefold() in HONORIFICS:
            kind = "T"
        elif len(word) == 1 and word.isupper() and (text[e : e + 1] == "." or (last == "T" and close)):
            kind = "I"
        elif shaped(word) and word.casefold() not in words:
            kind = "N"
        else:
            kind = "P" if word in PARTICLES else "-"
        if not close:
            out.append("|")
            places.append((s, s))
        out.append(kind)
        places.append((s, e))
        end, last = e, kind
    return "".join(out), places


_NAME = re.compile(r"(T?)([NI](?:P*[NI])*)")


def name_runs(text: str, low: int, high: int, words: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """Stretches that are written like a name: names and initials, with particles between them. Initials alone are one
    behind a title, or as two and more that are no common initialism. A word that ``words`` has, casefolded, breaks one."""
    classes, places = _classes(text, low, high, words)
    out = []
    for m in _NAME.finditer(classes):
        title, run = m.groups()
        letters = "".join(text[places[i][0]] for i in range(m.start(2), m.end(2))).casefold() if set(run) == {"I"} else ""
        if "N" in run or title or (len(letters) > 1 and letters not in INITIALISMS and letters not in words):
            out.append((places[m.start(2)][0], places[m.end(2) - 1][1]))
    return out


def code_runs(text: str, low: int, high: int, words: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """Numbers and codes in several pieces that one space or dot parts: with letters as their shape decides, of digits
    alone from GROUPED_DIGITS on. A piece without a digit ends one, and one that ``words`` has excuses it."""
    groups: list[list[re.Match[str]]] = []
    for m in _CODE.finditer(text, low, high):
        if any(c.isdigit() for c in m.group()):
            close = groups and groups[-1][-1].end() + 1 == m.start() and text[m.start() - 1] in " ."
            if close:
                groups[-1].append(m)
            else:
                groups.append([m])
    out = []
    for group in groups:
        start, end = group[0].start(), group[-1].end()
        run = text[start:end]
        end -= len(run) - len(run.rstrip("-/.()"))
        run = text[start:end]
        digits = sum(c.isdigit() for c in run)
        whole = _identifier(run) if any(c.isalpha() for c in run) else digits >= GROUPED_DIGITS
        if len(group) > 1 and whole and not any(m.group().casefold() in words for m in group):
            out.append((start, end))
    return out


class People:
    """The placeholders of a document: its values by kind in the order of their first mention, and parts of names under
    the person whose they are. A part that several people share is a value of its own."""

    def __init__(self, pages: dict[int, str], spans: list[tuple], words: frozenset[str] = frozenset(), allow: frozenset[str] = frozenset()):
        self.pages, self.words, self.vault, self._named, self._n = pages, words | allow, {}, {}, {}
        own = [(*s, pages[s[0]][s[1] : s[2]]) for s in sorted(spans, key=lambda s: (s[0], s[1], s[1] - s[2]))]
        own = [s for s in own if s[3] not in RELEASABLE or re.sub(r"^(?:the|an?)\s+", "", s[6], flags=re.I).casefold() not in allow]
        longer = {p.casefold() for s in own if s[3] == PERSON and len(s[6].split()) > 1 for p in parts(s[6])}
        self.values, self.parts, owners = Lexicon(fold=True), Lexicon(fold=False), {}
        for *_, kind, _, _, value in own:
            if kind == PERSON and len(value.split()) == 1 and value.casefold() in longer:
                continue
            self.values.add(value, (kind, self.mint(kind, value)))
            for part in parts(value) if kind == PERSON else ():
                if part.casefold() not in self.words and shaped(part):
                    owners.setdefault(part, {})[self.mint(kind, value)] = None
        for part, of in owners.items():
            if (PERSON, part.casefold()) in self._named:
                continue
            if len(of) == 1:
                stem = next(iter(of))[:-1]
                placeholder = f"{stem}.{1 + sum(p.startswith(stem + '.') for p in self.vault)}>"
                self.vault[placeholder] = part
            else:
                placeholder = self.mint(PERSON, part)
            self.parts.add(part, placeholder)

    def mint(self, kind: str, value: str) -> str:
        key = kind, " ".join(value.casefold().split())
        placeholder = self._named.get(key)
        if placeholder is not None and self.vault[placeholder] == value:
            return placeholder
        key = key if placeholder is None else (kind, value, "as written")
        if key not in self._named:
            self._n[kind] = self._n.get(kind, 0) + 1
            self._named[key] = f"<{kind}_{self._n[kind]}>"
            self.vault[self._named[key]] = value
        return self._named[key]

    def mask(self, text: str, shapes: bool = True) -> str:
        """A text of the document with placeholders: values in any case, parts as written, placeholders that were there
        already, and with ``shapes`` what is written like an address, a code or a name. Each only where nothing before it
        stands, so that restoring gives the text back."""
        claims = Claims()
        for start, end, (kind, _) in self.values.find(text):
            claims.take(start, end, kind)
        for start, end, placeholder in self.parts.find(text):
            claims.take(start, end, (placeholder,))
        for m in _PLACEHOLDER.finditer(text):
            claims.take(*m.span(), ID_LIKE)
        if shapes:
            for find in (self._addresses, code_runs, self._identifiers):
                for low, high in list(claims.gaps(len(text))):
                    for start, end in find(text, low, high, self.words):
                        claims.take(start, end, "EMAIL" if find == self._addresses else ID_LIKE)
            for low, high in list(claims.gaps(len(text))):
                for start, end in name_runs(text, low, high, self.words):
                    claims.take(start, end, NAME_LIKE)
        out, at = [], 0
        for start, end, what in claims.held:
            out += [text[at:start], what[0] if isinstance(what, tuple) else self.mint(what, text[start:end])]
            at = end
        return "".join([*out, text[at:]])

    @staticmethod
    def _addresses(text: str, low: int, high: int, words: frozenset[str]) -> list[tuple[int, int]]:
        return [m.span() for m in _ADDRESS.finditer(text, low, high)]

    @staticmethod
    def _identifiers(text: str, low: int, high: int, words: frozenset[str]) -> list[tuple[int, int]]:
        return [m.span() for m in _TOKEN.finditer(text, low, high) if _identifier(m.group()) and m.group().casefold() not in words]

    def leaks(self, masked: str) -> list[str]:
        """Kinds of the values and parts that a masked text still has, placeholders aside."""
        bare = _PLACEHOLDER.sub("\n", masked)
        return [what[0] for *_, what in self.values.find(bare)] + [PERSON for _ in self.parts.find(bare)]


SPAN = "struct<page:int,start:int,end:int,entity_type:string,score:double,recogniser:string>"


def _documents(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, pages and spans of each document, as arrays. Spans of pages that aren't there are left out."""
    texts = pages.select("doc_id", F.col("page").cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    known = spans.select("doc_id", F.struct(F.col("page").cast("int").alias("page"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "entity_type", "score", "recogniser").alias("span"))
    found = known.groupBy("doc_id").agg(F.collect_set("span").alias("spans"))
    held = texts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("pages"))
    return held.join(found, "doc_id", "left")


def _read(pages, spans) -> tuple[dict[int, str], list[tuple]]:
    texts = {p["page"]: p["text"] for p in pages}
    own = [(s["page"], s["start"], s["end"], s["entity_type"], s["score"], s["recogniser"]) for s in (spans if spans is not None else ())]
    return texts, sorted(s for s in own if s[0] in texts and 0 <= s[1] < s[2] <= len(texts[s[0]]))


def sweep_documents(pages: DataFrame, spans: DataFrame, refused: Iterable[str] = (), retype: Iterable[str] = RETYPED) -> DataFrame:
    """Spans of documents after the sweep: doc_id, page, start, end, entity_type, score, recogniser.

    pages has doc_id, page, text; spans a detector's doc_id, page, start, end, entity_type, score, recogniser, with
    offsets in code points. A null text is empty. Words of ``refused`` are never spread over a document.
    """
    words, kinds = frozenset(w.casefold() for w in refused), tuple(retype)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(doc_id, *s) for doc_id, p, s in zip(batch["doc_id"], batch["pages"], batch["spans"], strict=True) for s in sweep(*_read(p, s), words, kinds)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "start", "end", "entity_type", "score", "recogniser"])

    # A document without a detected person has nothing to sweep, and never leaves the JVM.
    docs = _documents(pages, spans)
    named = F.coalesce(F.exists("spans", lambda s: s["entity_type"] == PERSON), F.lit(False))
    swept = docs.filter(named).mapInPandas(run, "doc_id long, page int, start int, end int, entity_type string, score double, recogniser string")
    return swept.union(docs.filter(~named).select("doc_id", F.inline(F.coalesce("spans", F.array().cast(f"array<{SPAN}>")))))


def provenance(spans: DataFrame) -> DataFrame:
    """Spans with what the sweep did, ``swept``, ``retyped`` or ``found``, and the recogniser that fired."""
    by = F.col("recogniser")
    how = F.when(by == SWEEP, "swept").when(F.startswith(by, F.lit(f"{SWEEP}:")), "retyped").otherwise("found")
    return spans.withColumns({"how": how, "recogniser": F.regexp_replace(by, f"^{SWEEP}:", "")})


def mask_people(pages: DataFrame, spans: DataFrame, words: Iterable[str] = (), allow: Iterable[str] = (), shapes: bool = True) -> DataFrame:
    """Pages of documents with placeholders for what a detector and the recognisers found: doc_id, page, masked, vault.

    A value is masked wherever the document has it, a part of a detected person's name as ``<PERSON_1.2>``; with
    ``shapes`` also what is written like an address, a code or a name. ``words`` never are, ``allow`` also releases places
    and organisations. The vault is the document's.
    """
    plain, known = frozenset(w.casefold() for w in words), frozenset(w.casefold() for w in allow)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, p, s in zip(batch["doc_id"], batch["pages"], batch["spans"], strict=True):
                texts, given = _read(p, s)
                own = []
                for page, text in texts.items():
                    both = [(a, b, kind, score, by) for q, a, b, kind, score, by in given if q == page] + detect(text)
                    own += [(page, *x) for x in resolve(both)]
                people = People(texts, own, plain, known)
                masked = {page: people.mask(text, shapes) for page, text in texts.items()}
                rows += [(doc_id, page, text, people.vault) for page, text in masked.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "masked", "vault"])

    return _documents(pages, spans).mapInPandas(run, "doc_id long, page int, masked string, vault map<string,string>")
