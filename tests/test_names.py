"""People's names: sweep, placeholders for parts, runs of names and codes, and streams that restore what the whole does."""

import random

import pytest

from tallywick.operators import names, redact

WORDS = frozenset("the of in on at team ref order part item year friday then later met k4 rows may she said letter notice lives form".split())


def people(text, *values, words=WORDS, allow=frozenset(), kind="PERSON"):
    spans = [(1, text.index(v), text.index(v) + len(v), kind, 0.9, "test") for v in values]
    return names.People({1: text}, spans, words, allow)


def masked(text, *values, **options):
    own = people(text, *values, **options)
    out = own.mask(text)
    assert redact.restore(out, own.vault) == text
    return out


def test_parts_of_a_name_stand_for_their_person():
    assert masked("Nora Kestrel came first. On Friday only Nora stayed; Kestrel's desk was empty.", "Nora Kestrel") == "<PERSON_1> came first. On Friday only <PERSON_1.1> stayed; <PERSON_1.2>'s desk was empty."


def test_a_shared_part_stands_for_itself():
    out = masked("Nora Kestrel; Nora Lindqvist; then Nora by herself, and Kestrel", "Nora Kestrel", "Nora Lindqvist")
    assert out == "<PERSON_1>; <PERSON_2>; then <PERSON_3> by herself, and <PERSON_1.1>"


def test_parts_are_case_sensitive_and_titles_and_plain_words_are_none():
    assert masked("Prof. May Rivers rivers may run. Prof. Rivers left.", "Prof. May Rivers") == "<PERSON_1> rivers may run. Prof. <PERSON_1.1> left."


def test_a_first_name_found_alone_is_the_same_person():
    text = "Nora Kestrel / Nora"
    own = names.People({1: text}, [(1, 0, 12, "PERSON", 0.9, "t"), (1, 15, 19, "PERSON", 0.9, "t")])
    assert own.mask(text) == "<PERSON_1> / <PERSON_1.1>"


def test_whole_words_only():
    own = people("La Vern governs", "La Vern")
    assert own.mask("La Vern governs") == "<PERSON_1> governs"
    assert own.mask("taverns, caverne") == "taverns, caverne"
    assert own.mask("Vern's hat") == "<PERSON_1.2>'s hat"


def test_what_no_detector_found_is_masked_by_its_shape():
    text = "Nora Kestrel rang Oskar Lindqvist at Velmora Friday. Ref ZX-1987-4420, item 8800123456, part 12, 5th year, 1987 rows. OSKAR too."
    assert masked(text, "Nora Kestrel") == "<PERSON_1> rang <NAME_LIKE_1> at <NAME_LIKE_2> Friday. Ref <ID_LIKE_1>, item <ID_LIKE_2>, part 12, 5th year, 1987 rows. <NAME_LIKE_3> too."
    assert masked("звонил Орлов") == "звонил <NAME_LIKE_1>"


@pytest.mark.parametrize(("text", "want"), [("code K7M 9Q4", "code <ID_LIKE_1>"), ("no 314 159 265 358", "no <ID_LIKE_1>"), ("dial 271.828.1828", "dial <ID_LIKE_1>"), ("at (161) 803-3988 or so", "at <ID_LIKE_1> or so"), ("see QRS-1999-0042 there", "see <ID_LIKE_1> there")])
def test_a_value_in_pieces_is_masked_whole(text, want):
    assert masked(text) == want


@pytest.mark.parametrize("text", ["rows 7, 8 and 9; 3 of 21", "from 1987 to 1991", "K4 1991 rows", "flat 6C", "part 12(3)(b)", "5th year", "30 40 50"])
def test_small_numbers_stay(text):
    assert masked(text) == text


@pytest.mark.parametrize(("text", "gone"), [("then Mr P. Zalewski spoke", ["P.", "Zalewski"]), ("read W.H. Osborne on it", ["W", "H", "Osborne"]), ("she asked Dr K about it", [" K "]), ("so Ms T. left", ["T."]), ("the case of C.D. was closed", ["C.D"]), ("Pieter van den Berg sang", ["Pieter", "van den", "Berg"]), ("Inés Moreno del Valle came", ["Moreno del Valle"])])
def test_initials_and_particles_belong_to_a_name(text, gone):
    assert not [g for g in gone if g in masked(text)]


@pytest.mark.parametrize(("text", "kept"), [("as in table B. there", "B."), ("within the E.U. it", "E.U."), ("the von of it", " von "), ("a la carte", " la ")])
def test_a_lone_initial_and_a_stray_particle_stay(text, kept):
    assert kept in masked(text)


def test_plain_words_break_a_run_and_masked_text_stays():
    own = people("Nora Kestrel Team Velmora", "Nora Kestrel")
    out = own.mask("Nora Kestrel Team Velmora")
    assert out == "<PERSON_1> Team <NAME_LIKE_1>"
    assert own.leaks(out) == [] and own.leaks("Kestrel and nora kestrel") == ["PERSON", "PERSON"]


def test_foreign_placeholders_are_masked_whole():
    assert masked("She said <PERSON_4> lives in Velmora.") == "She said <ID_LIKE_1> lives in <NAME_LIKE_1>."
    assert masked("as PERSON_7 and PERSON_7.2 say") == "as <ID_LIKE_1> and <ID_LIKE_2> say"


def test_places_are_released_and_people_never():
    text = "then to the House of Tides at Brightport"
    at = lambda v: (text.index(v), text.index(v) + len(v))
    spans = [(1, *at("the House of Tides"), "ORGANISATION", 0.8, "t"), (1, *at("Brightport"), "LOCATION", 0.8, "t")]
    words = frozenset("house tides".split())
    assert names.People({1: text}, spans, words, frozenset({"house of tides", "brightport"})).mask(text) == text
    assert "Brightport" not in masked("so Mr Brightport spoke", "Brightport", allow=frozenset({"brightport"}))


# the sweep


def swept(pages, *spans, **options):
    pages = dict(enumerate(pages, 1))
    own = [(page, pages[page].index(v), pages[page].index(v) + len(v), kind, score, by) for page, v, kind, score, by in spans]
    return [(page, pages[page][s:e], kind, score, by) for page, s, e, kind, score, by in names.sweep(pages, own, **options)]


def test_the_sweep_finds_parts_on_every_page_and_joins_them():
    found = swept(["Nora La Vern came.", "So La Vern governs; Nora-La and taverns. Nora\nVern"], (1, "Nora La Vern", "PERSON", 0.7, "d"))
    assert found == [(1, "Nora La Vern", "PERSON", 0.7, "d"), (2, "La Vern", "PERSON", 0.7, "sweep"), (2, "Nora-La", "PERSON", 0.7, "sweep"), (2, "Nora", "PERSON", 0.7, "sweep"), (2, "Vern", "PERSON", 0.7, "sweep")]


def test_the_sweep_calls_bare_names_people_and_nothing_looser():
    pages = ["Philippa Castellane signed.", "It says Castellane. Philippa nodded. Castellane Bridge"]
    spans = [(1, "Philippa Castellane", "PERSON", 0.85, "d"), (2, "Castellane", "LOCATION", 0.8, "d"), (2, "Castellane Bridge", "LOCATION", 0.8, "d")]
    found = swept(pages, *spans)
    assert [x[1:3] + x[4:] for x in found if x[0] == 2] == [("Castellane", "PERSON", "sweep:d"), ("Philippa", "PERSON", "sweep"), ("Castellane Bridge", "LOCATION", "d")]
    assert [x[2] for x in swept(pages, *spans, retype=()) if x[0] == 2] == ["LOCATION", "PERSON", "LOCATION"]


def test_the_sweep_spreads_no_plain_word_and_keeps_the_lowest_score():
    assert swept(["Final Notice", "the Notice came"], (1, "Final Notice", "PERSON", 0.6, "d"), refused=frozenset({"final", "notice"})) == [(1, "Final Notice", "PERSON", 0.6, "d")]
    found = swept(["Ann Bell. Cleo Dray.", "Ann Dray"], (1, "Ann Bell", "PERSON", 0.9, "d"), (1, "Cleo Dray", "PERSON", 0.5, "d"))
    assert found[-1] == (2, "Ann Dray", "PERSON", 0.5, "sweep")


def test_frames_do_as_documents_do(spark):
    pages = spark.createDataFrame([(1, 1, "Ann Bell wrote."), (1, 2, "Then Bell called; mail a@b.co."), (2, 1, None), (3, 1, "no one")], "doc_id long, page int, text string")
    spans = spark.createDataFrame([(1, 1, 0, 8, "PERSON", 0.9, "d"), (1, 9, 0, 3, "PERSON", 0.9, "d"), (3, 1, 0, 2, "LOCATION", 0.4, "d")], "doc_id long, page int, start int, end int, entity_type string, score double, recogniser string")
    out = names.provenance(names.sweep_documents(pages, spans)).collect()
    assert sorted((r["doc_id"], r["page"], r["start"], r["end"], r["how"], r["recogniser"]) for r in out) == [(1, 1, 0, 8, "found", "d"), (1, 2, 5, 9, "swept", "sweep"), (1, 9, 0, 3, "found", "d")][:2] + [(3, 1, 0, 2, "found", "d")]
    told = {(r["doc_id"], r["page"]): r for r in names.mask_people(pages, spans, words=["then", "wrote"]).collect()}
    assert told[1, 2]["masked"] == "Then <PERSON_1.2> called; mail <EMAIL_1>." and told[2, 1]["masked"] == ""
    assert told[1, 1]["vault"]["<PERSON_1>"] == "Ann Bell"
    assert names.mask_people(pages.filter("doc_id > 9"), spans).count() == 0


# placeholders


@pytest.mark.parametrize(("form", "value"), [("PERSON_1", "Ann Bell"), ("<PERSON_1.2>", "Bell"), ("PERSON_1.2", "Bell"), ("<person 01.2>", "Bell"), ("<Person-1>", "Ann Bell"), ("xPERSON_1", "xPERSON_1"), ("PERSON_1x", "PERSON_1x"), ("person_1", "person_1"), ("PERSON_1.", "Ann Bell."), ("<PERSON_1.9>", "<PERSON_1.9>"), ("<" + " " * 70 + "PERSON_1>", "<" + " " * 70 + "Ann Bell>")])
def test_placeholder_forms(form, value):
    assert redact.restore(form, {"<PERSON_1>": "Ann Bell", "<PERSON_1.2>": "Bell"}) == value


@pytest.mark.parametrize("seed", range(60))
def test_a_stream_restores_what_the_whole_text_does(seed):
    rng = random.Random(seed)
    vault = {"<PERSON_1>": "Ann", "<PERSON_1.2>": "Bell", "<NAME_LIKE_12>": "Gander", "<EMAIL_3>": "a@b.co"}
    bits = ["<", ">", "PERSON", "PERSON_1", "<PERSON_1>", "<PERSON_1.2>", "PERSON_1.2", "<name like 12>", "NAME_LIKE_12", " ", "_", ".", "1", "2", "-", "x", "\n", "<EMAIL-03>", " " * 80, "A" * 170, "é"]
    text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 60)))
    own, got, at = redact.StreamRestorer(vault), [], 0
    while at < len(text):
        n = rng.choice([1, 1, 2, 5, 40])
        got.append(own.feed(text[at : at + n]))
        at += n
    assert "".join(got) + own.finish() == redact.restore(text, vault)


def test_values_are_looked_for_and_not_every_word_looked_up(monkeypatch):
    known = names.Lexicon(fold=True)
    for value in ("Ann Bell", "Ann", "É"):
        known.add(value, value)
    want = [(0, 3, "Ann"), (10, 18, "Ann Bell"), (20, 21, "É")]
    assert known.find("ann Annie ANN bell, é.") == want
    # A letter that folds to two, and a mark that folds to a letter, move or make words.
    assert known.find("ß ann") == [(2, 5, "Ann")] and known.find("ann\u0345") == [(0, 3, "Ann")]
    monkeypatch.setattr(names, "FEW", 0)
    assert known.find("ann Annie ANN bell, é.") == want
    monkeypatch.undo()
    calls = []
    monkeypatch.setattr(names.Lexicon, "_key", lambda self, piece: calls.append(piece) or piece.casefold())
    assert len(known.find("word " * 1000 + "Ann")) == 1 and len(calls) < 10
