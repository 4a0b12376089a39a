"""Annotated corpora against plain character arrays."""

import json
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tallywick.operators import annotated as an

TEXT = "Ann Bell of Gander wrote to Mr Dray, 12 May; Ann asked Gander's office."


def made(seed, docs=12):
    rng, texts, mentions, masked = random.Random(seed), [], [], []
    for d in range(docs):
        text = " ".join(rng.choice(["Ann", "Bell", "é", "the", "x1", "Gander's", "-", "of,"]) for _ in range(rng.randrange(0, 30)))
        texts.append((f"d{d}", text if d else None))
        n = len(text) if d else 0
        for _ in range(rng.randrange(0, 9) if n else 0):
            s = rng.randrange(n)
            mentions.append((f"d{d}", rng.choice("ab"), f"e{rng.randrange(4)}", rng.choice(["DIRECT", "QUASI", "NO_MASK"]), s, min(n, s + rng.randrange(1, 9))))
        for _ in range(rng.randrange(0, 6) if n else 0):
            s = rng.randrange(n)
            masked.append((f"d{d}", s, min(n, s + rng.randrange(1, 12))))
    return texts, mentions, masked


def frames(spark, texts, mentions, masked):
    return spark.createDataFrame(texts, "doc_id string, text string"), spark.createDataFrame(mentions, "doc_id string, annotator string, entity_id string, identifier_type string, start int, end int"), spark.createDataFrame(masked, "doc_id string, start int, end int")


def plain(texts, mentions, masked):
    out = []
    for doc, text in texts:
        text = text or ""
        words = [m.span() for m in re.finditer(r"[^\W_]+", text)]
        lit = np.zeros(len(text), bool)
        for d, s, e in masked:
            if d == doc:
                lit[s:e] = True
        own = sorted({m for m in mentions if m[0] == doc})
        # a word belongs to a mention by its end
        inside = lambda m: [w for w in words if m[4] < w[1] <= m[5]]
        entities = {}
        for m in own:
            if m[3] != "NO_MASK":
                kind, ok = entities.get(m[1:3], ("ZZ", True))
                entities[m[1:3]] = min(kind, m[3]), ok and all(lit[s:e].all() for s, e in inside(m))
        safe = [m for m in own if m[3] == "NO_MASK"]
        readers = {m[1] for m in own}
        precise = judged = 0
        for a in readers:
            needs = np.zeros(len(text), bool)
            for m in own:
                if m[1] == a and m[3] != "NO_MASK":
                    needs[m[4] : m[5]] = True
            for s, e in words:
                if lit[s:e].any():
                    judged += 1
                    precise += bool(needs[s:e].all())
        count = lambda k, ok: sum(x == k and (y or not ok) for x, y in entities.values())
        out.append((doc, count("DIRECT", True), count("DIRECT", False), count("QUASI", True), count("QUASI", False), precise, judged, sum(any(lit[s:e].any() for s, e in inside(m)) for m in safe), len(safe), int(lit.sum()), len(text)))
    return sorted(out)


def test_scores_equal_plain_version(spark):
    for seed in range(3):
        given = made(seed)
        assert sorted(map(tuple, an.score_corpus(*frames(spark, *given)).collect())) == plain(*given)


def test_rates_and_bootstrap(spark):
    given = made(7, 60)
    scores = an.score_corpus(*frames(spark, *given)).cache()
    rates = {r["measure"]: r for r in an.corpus_rates(scores).collect()}
    want = plain(*given)
    assert rates["masked"]["hits"] == sum(r[9] for r in want) and rates["precision"]["total"] == sum(r[6] for r in want)
    found = an.document_bootstrap(scores, "precise", "judged", draws=400).first()
    hits, total = np.array([r[5] for r in want], float), np.array([r[6] for r in want], float)
    times = np.random.default_rng(1).poisson(1, (4000, len(hits)))
    low, high = np.quantile((times @ hits) / np.maximum(times @ total, 1), [0.025, 0.975])
    assert abs(found["rate"] - hits.sum() / total.sum()) < 1e-9
    assert abs(found["low"] - low) < 0.25 * (high - low) and abs(found["high"] - high) < 0.25 * (high - low)


def test_corpus_is_read_with_its_offsets_checked(spark, tmp_path):
    mention = lambda s, e, t, kind: {"entity_id": "e1", "entity_type": "PERSON", "identifier_type": kind, "start_offset": s, "end_offset": e, "span_text": t}
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps([{"doc_id": "1", "text": TEXT, "annotations": {"a": {"entity_mentions": [mention(0, 8, "Ann Bell", "DIRECT"), mention(1, 8, "Ann Bell", "QUASI")]}, "b": {"entity_mentions": []}}}, {"doc_id": "2", "text": None, "annotations": {}}]))
    docs, mentions = an.read_corpus(spark, str(path))
    assert docs.count() == 2
    assert sorted((r["start"], r["agrees"]) for r in mentions.collect()) == [(0, True), (1, False)]
    masked = spark.createDataFrame([("1", 0, 8)], "doc_id string, start int, end int")
    row = {r["doc_id"]: r for r in an.score_corpus(docs, mentions.filter("agrees"), masked).collect()}["1"]
    assert (row["direct"], row["direct_total"], row["precise"], row["judged"]) == (1, 1, 2, 2)


def test_allow_lists(spark):
    rows = [("d1", 1, "Court of Appeal"), ("d1", 2, "Court"), ("d2", 1, "Ref 12"), ("d2", 2, "Ref 12"), ("d3", 1, "A"), ("d3", 2, "A")]
    pages = an.allow_from_pages(spark.createDataFrame(rows, "doc_id string, page int, phrase string"))
    assert {r["phrase"]: r["pages"] for r in pages.collect()} == {"Court": 2, "Ref": 2}
    texts = [("d1", "Oslo and Ann; May"), ("d2", "Oslo and Bob; May"), ("d3", "Ann alone")]
    mentions = [("d1", "a", "e", "NO_MASK", 0, 4), ("d2", "a", "e", "NO_MASK", 0, 4), ("d1", "a", "f", "DIRECT", 9, 12), ("d2", "a", "f", "DIRECT", 9, 12)]
    docs, told, _ = frames(spark, texts, mentions, [("d1", 0, 1)])
    assert {r["phrase"]: r["documents"] for r in an.allow_from_mentions(docs, told).collect()} == {"Oslo": 2, "May": 2}
    assert [r["phrase"] for r in an.allow_from_mentions(docs, told, words=False).collect()] == ["Oslo"]
    assert docs.filter(F.col("doc_id") == "none").count() == 0


def test_words_are_handed_on_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(an, "PIECE", 7)
    texts = [("d1", "a-b " * 10), ("d2", None), ("d3", "É x²_y")]
    docs, *_ = frames(spark, texts, [("d1", "a", "e", "DIRECT", 0, 1)], [("d1", 0, 1)])
    want = sorted((d, i, m.group(), *m.span()) for d, t in texts for i, m in enumerate(re.finditer(r"[^\W_]+", t or "")))
    assert sorted(map(tuple, an.tokens(docs).collect())) == want


def test_scores_shuffle_documents_and_spans_only(spark):
    plan = an.score_corpus(*frames(spark, *made(1)))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("MapInArrow") == 1


def test_mentions_without_a_place_or_kind(spark):
    texts = [("d1", "Oslo and Ann"), ("d2", "Oslo and Bob")]
    mentions = [("d1", "a", "e", None, 0, 4), ("d2", "a", "e", None, 0, 4), ("d1", "a", "f", "DIRECT", None, 3), ("d1", "b", "g", "DIRECT", 9, 12)]
    docs, told, masked = frames(spark, texts, mentions, [("d1", 9, 12), ("d2", None, 3)])
    rows = {r["doc_id"]: r for r in an.score_corpus(docs, told, masked).collect()}
    assert [rows["d1"][c] for c in ("direct", "direct_total", "precise", "judged")] == [1, 1, 1, 2] and rows["d2"]["masked_chars"] == 0
    assert an.allow_from_mentions(docs, told, words=False).count() == 0
