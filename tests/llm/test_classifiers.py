import zlib

import numpy as np
import pytest

from tallywick.llm import quality, toxicity

GOOD = ["river", "stone", "garden", "letter", "window", "market", "winter", "bread", "music", "harbour"]
BAD = ["vilegrub", "snotrag", "filthpot"]


def corpus(n=260, seed=3):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(GOOD, int(rng.integers(8, 60))))
        toxic = int(i % 4 == 0)
        if toxic:
            words[int(rng.integers(0, len(words)))] = str(rng.choice(BAD))
        good = int(i % 3 != 0)
        text = " ".join(words) if good else "### ".join(words)
        rows.append((i, text))
        labels.append((i, good, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark, docs_of):
    rows, labels = corpus()
    return docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize(("module", "column", "n", "rest", "cut"), [(toxicity, 2, 5, 0, 0.5), (quality, 1, 4, 2, 0.7)])
def test_held_out_rows_are_learned(fitted, module, column, n, rest, cut):
    docs, labels, truth = fitted
    out = {r["doc_id"]: r for r in module.score_documents(docs, labels).collect()}
    assert len(out) == len(truth)
    held = [t for t in truth if zlib.crc32(str(t[0]).encode()) % n == rest]
    assert {t[0] for t in held} == {k for k, r in out.items() if r["held_out"]}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) for r in out.values())
    right = np.mean([out[t[0]]["predicted"] == t[column] for t in held])
    assert right >= 0.9


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows_and_no_labels(spark, docs_of, odd_rows, fitted, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = module.score_documents(docs_of(odd_rows), none).collect()
    assert len(out) == len(odd_rows)
    assert {r["predicted"] for r in out} == {0 if module is toxicity else 1}
    out = module.score_documents(docs_of(odd_rows), spark.createDataFrame([(4, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(odd_rows) and all(r["score"] is not None for r in out)
    assert module.score_documents(docs_of([]), none).count() == 0


def test_features_do_not_depend_on_pieces(monkeypatch):
    text = " ".join(f"Word{i % 91},{'!' * (i % 5)}\n" for i in range(3000))
    whole = quality.text_features([text, None, ""])
    monkeypatch.setattr("tallywick.llm.common.SEGMENT", 5000)
    # What only neighbours tell (lines, repeated words) may differ at the seams between pieces.
    np.testing.assert_allclose(quality.text_features([text, None, ""]), whole, atol=0.01)


def test_scores_do_not_depend_on_company():
    rows, labels = corpus(120)
    texts = [t for _, t in rows]
    model = toxicity.train(texts, np.array([t for _, _, t in labels]), epochs=3)
    alone = [model.scores([t])[0] for t in texts[:20]]
    np.testing.assert_allclose(model.scores(texts)[:20], alone, rtol=1e-5)


def test_thresholds_are_set_by_guessed_language():
    texts = ["the house and the garden of it", "der Hund und die Katze ist nicht", "le chat et la maison dans une", "el perro y la casa en los", "zzz qqq"]
    assert toxicity.Features(texts).languages().tolist() == [0, 2, 1, 3, 4]


def test_drop_toxic_keeps_columns(fitted):
    docs, labels, truth = fitted
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    clean = {t[0] for t in truth if not t[2]}
    assert len(clean - ids) <= 0.05 * len(clean) and len(ids - clean) <= 0.1 * len(truth)


def plain_words(text):
    """Lower-cased words as bytes, without up to four signs at either end where letters remain."""
    out = []
    for word in text.translate({c: c + 32 for c in range(65, 91)}).encode().split():
        for _ in range(4):
            if len(word) > 1 and toxicity._SIGN[word[-1]]:
                word = word[:-1]
            if len(word) > 1 and toxicity._SIGN[word[0]]:
                word = word[1:]
        out.append(word)
    return out


def plain_toxicity(model, text):
    """The forward pass, one word, window and filter at a time."""
    words = plain_words(text)
    hash_of = lambda w: int(toxicity._hash_text(w.decode("utf-8", "surrogateescape")))
    bucket = [hash_of(w) % toxicity.BUCKETS for w in words]
    head = [int(toxicity.mix(np.array([hash_of(w[: toxicity.PREFIX]) + 1 & (1 << 64) - 1], np.uint64))[0]) % toxicity.BUCKETS for w in words]
    total, at = float(model.out_bias), 0
    for w, n in toxicity.FILTERS.items():
        for f in range(n):
            windows = [sum(float(model.tables[w][j][bucket[i + j]][f]) + float(model.tables[w][j][head[i + j]][f]) for j in range(w)) + float(model.bias[w][f]) for i in range(len(words) - w + 1)]
            total += max(0.0, *windows, 0.0) * float(model.out[at])
            at += 1
    hits = [sum(w.decode() in names.split() for w in words) for names in toxicity.FUNCTION_WORDS.values()]
    total -= model.threshold[int(np.argmax(hits)) if sum(hits) else len(hits)]
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def test_toxicity_scores_match_a_plain_forward_pass():
    rows, labels = corpus(120)
    texts = [t for _, t in rows]
    model = toxicity.train(texts, np.array([t for _, _, t in labels]), epochs=3)
    model.threshold = np.arange(len(toxicity.LANGUAGES)) * 0.3
    sample = [*texts[:25], "", "der die das vilegrub!", "((The)) river, of-the 'x' ... é"]
    np.testing.assert_allclose(model.scores(sample), [plain_toxicity(model, t) for t in sample], rtol=1e-4)


def test_quality_scores_match_plain_lookups():
    rows, labels = corpus(200)
    x = quality.text_features([t for _, t in rows])
    model = quality.train(x, np.array([q for _, q, _ in labels], float))
    assert len(model.pairs) > 0
    for row, score in zip(x[:30], model.scores(x[:30]), strict=True):
        at = [sum(float(edge) <= float(v) for edge in edges) for edges, v in zip(model.edges, row, strict=True)]
        total = model.base + sum(float(model.single[k][b]) for k, b in enumerate(at))
        total += sum(float(grid[at[a] * quality.PAIR_BINS // quality.BINS][at[b] * quality.PAIR_BINS // quality.BINS]) for (a, b), grid in zip(model.pairs, model.grids, strict=True))
        assert score == pytest.approx(1 / (1 + np.exp(-total)), rel=1e-6)


def test_thresholds_differ_by_language_and_shrink():
    model = toxicity.train([], np.zeros(0))
    lang = np.array([0] * 40 + [1] * 40)
    logits = np.concatenate([np.arange(40) / 10, np.arange(40) / 10 + 3])
    toxic = np.array([i >= 30 for i in range(40)] * 2).astype(int)
    toxicity.set_thresholds(model, lang, logits, toxic, np.full(80, 50))
    assert model.threshold[0] == pytest.approx(2.95, abs=0.1) and model.threshold[1] == pytest.approx(5.95, abs=0.1)
    toxicity.set_thresholds(model, lang, logits, toxic, np.ones(80, int))
    assert 2.95 < model.threshold[0] < model.threshold[4] or model.threshold[0] < model.threshold[1] < 5.95


def test_repeated_ids_and_long_texts_train_alike(spark, docs_of, fitted):
    _, labels, _ = fitted
    rows = [(i, t) for i, t in corpus()[0]]
    rows += [(i, "harbour " + t) for i, t in rows[:50]] + [(3, "stone river " * 20_000)]
    one, two = (sorted((r["doc_id"], r["score"]) for r in toxicity.score_documents(docs_of(rs), labels).collect()) for rs in (rows, rows[::-1]))
    np.testing.assert_allclose(one, two, rtol=1e-6)


def test_drop_toxic_keeps_odd_rows_and_empty_tables(spark, docs_of, odd_rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of(odd_rows)
    assert toxicity.drop_toxic(docs, none).count() == len(odd_rows)
    assert toxicity.drop_toxic(docs_of([]), none).count() == 0
