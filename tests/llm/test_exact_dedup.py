import hashlib
import re

from tallywick.llm.exact_dedup import drop_exact_copies, exact_groups


def brute(rows):
    bare = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for (i, _), b in zip(rows, bare, strict=True):
        group = [(-len(t or ""), k is None, k or 0, k) for (k, t), c in zip(rows, bare, strict=True) if c == b]
        keep = min(group, key=lambda g: g[:3])[3]
        out.append((i, keep, len(group), i == keep, hashlib.sha256(b.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_odd_rows_match_brute_force(docs_of, odd_rows):
    assert sorted(map(tuple, exact_groups(docs_of(odd_rows)).collect()), key=repr) == brute(odd_rows)


def test_more_rounds_give_the_same(docs_of):
    rows = [(i, "abc" if i % 3 else f"t{i % 40} {i % 7}") for i in range(400)]
    for fan_in in (2, 3, 4, 64):
        assert sorted(map(tuple, exact_groups(docs_of(rows), fan_in=fan_in).collect()), key=repr) == brute(rows)


def test_empty_table(docs_of):
    assert exact_groups(docs_of([])).count() == 0
    assert drop_exact_copies(docs_of([])).count() == 0


def test_no_python_in_the_plan(docs_of):
    plan = exact_groups(docs_of([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_drop_keeps_columns_and_one_of_each(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    bare = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in kept.collect()]
    assert sorted(bare) == sorted({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in odd_rows})


def test_each_round_merges_sorted_runs(docs_of):
    plan = exact_groups(docs_of([(1, "a")]), fan_in=2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 3  # 8 nodes: three rounds after the runs, which are written
