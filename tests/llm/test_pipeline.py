import re

import corpus_pipeline
from tallywick.llm import queries


def test_stages_take_effect_in_order(spark, docs_of, tmp_path):
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(i, f"{base} " + " ".join(f"t{i}x{j}" for j in range(30)), f"s{i % 3}") for i in range(90)]
    rows += [(200, rows[3][1].replace(" ", "  ")), (201, rows[3][1]), (202, rows[5][1] + " extra words")]
    rows = [(r[0], r[1], r[2] if len(r) > 2 else "s0") for r in rows]
    toxic = [(500 + i, f"{base} vilegrub snotrag {i} " + " ".join(f"k{i}y{j}" for j in range(20)), "s1") for i in range(40)]
    labels = [(r[0], 1, 0) for r in rows[:90]] + [(t[0], 1, 1) for t in toxic[:30]]
    docs_of(rows + toxic).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], str(tmp_path)).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
        if k < 4:
            assert seen[-1].columns == docs.columns
    ids = [sorted(r["doc_id"] for r in s.select("doc_id").collect()) for s in seen]
    assert len(set(ids[1]) & {t[0] for t in toxic}) <= 6 and set(range(90)) | {200, 201, 202} <= set(ids[1])
    assert 200 in ids[2] and 3 not in ids[2] and 201 not in ids[2]  # equal texts: the one with the most characters stays
    assert 202 not in ids[3] and 5 in ids[3]
    assert set(ids[4]) <= set(ids[3])
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in seen[3].collect()}
    assert abs(sum(words[i] for i in ids[4]) - sum(words.values())) <= 3 * 60
    assert set(ids[5]) == set(ids[4])


def test_run_takes_odd_rows_and_empty_tables(spark, docs_of, odd_rows, tmp_path):
    for name, rows in (("odd", odd_rows), ("none", [])):
        at = tmp_path / name
        docs_of(rows).write.parquet(str(at / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(at)).collect()
        assert sorted({r["doc_id"] for r in out if r["length"] > 1 and r["doc_id"]}) == ([6, 7, 8, 9] if rows else [])
        for r in out:
            assert r["offset"] + r["length"] <= 4096


def test_queries_are_registered():
    assert sorted(int(m[1]) for n in queries.QUERIES if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
