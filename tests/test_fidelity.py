"""Classes of placeholders in answers, and the forms that still read."""

import pytest

from tallywick.operators import fidelity as fd

VAULT = {"<PERSON_1>": "Ann Bell", "<NAME_LIKE_2>": "Gander", "<EMAIL_3>": "a@b.co", "<SIN_1>": "046 454 286"}


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ("<PERSON_1> and <EMAIL_3>", {"exact": 2}), ("<person_1>", {"tolerated": 1, "forms": {"case": 1}}), ("[PERSON_1] (PERSON_1) `PERSON_1` PERSON_1", {"tolerated": 4, "forms": {"square brackets": 1, "round brackets": 1, "backticks": 1, "no brackets": 1}}),
        ("< PERSON_1 >", {"tolerated": 1, "forms": {"spaces inside": 1}}), ("<Name Like-02>", {"tolerated": 1, "forms": {"case and separator and leading zero": 1}}), ("<PERSON_7> <OTHER_1>", {"unresolved": 2}),
        ("<PERSON> and [NAME LIKE 2] and Person 1 and NAME_LIKE", {"degraded": 4}), ("SIN: <SIN_1>, no person here", {"exact": 1}), ("Mr. <PERSON_1> and Dr <NAME_LIKE_2>", {"exact": 2, "titled": 2}), (None, {}),
    ],
)
def test_classes(answer, want):
    told = fd.judge(answer, "", VAULT)
    assert {k: v for k, v in told.items() if v} == want


def test_titles_of_the_page_and_loss():
    told = fd.judge("Mr <PERSON_1> wrote.", "Mr <PERSON_1>, <EMAIL_3>, <SIN_1>", VAULT)
    assert (told["titled"], told["expected"], told["kept"]) == (0, 2, 1)


def test_rates(spark):
    rows = [("g", "<PERSON_1> person 1", "<PERSON_1> <EMAIL_3>", VAULT), ("g", None, None, None), ("h", "<person-1>", "<PERSON_1>", VAULT)]
    out = {r["g"]: r for r in fd.fidelity(spark.createDataFrame(rows, "g string, answer string, page string, vault map<string,string>"), ["g"]).collect()}
    assert (out["g"]["exact"], out["g"]["degraded"], out["g"]["mutation"], out["g"]["unrecoverable"], out["g"]["loss"]) == (1, 1, 0.5, 0.5, 0.5)
    assert (out["h"]["tolerated"], out["h"]["loss"]) == (1, 0.0)


def test_forms(spark):
    out = {r["form"]: (r["placeholders"], r["resolved"]) for r in fd.forms_that_read(spark.createDataFrame([(VAULT,)], "vault map<string,string>")).collect()}
    unread = {"bare lower case", "bare with space", "no number", "invented"}
    assert set(out) == set(fd.FORMS) and len(out) == 16
    assert out == {f: (4, 0 if f in unread else 4) for f in fd.FORMS}
