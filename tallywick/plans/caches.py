"""Cache queries over embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywick.functions.text import normalised
from tallywick.operators import cache_eval as ce
from tallywick.operators import vectors as op
from tallywick.plans.registry import query, table

_NEAR = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, s.vec_id, q.label = s.label AS correct, round(list_inner_product(q.v, s.v), 9) AS similarity FROM v q JOIN v s ON q.vec_id % 2 = 1 AND s.vec_id % 2 = 0),
near AS (SELECT query_id, vec_id, correct, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS n FROM p) WHERE n = 1)"""
_CURVE = f"{_NEAR}, grid AS (SELECT CAST(range AS INT) AS step FROM range(70, 100)), curve AS (SELECT round(step / 100, 2) AS threshold, (SELECT count(*) FROM near) AS queries, count(*) FILTER (correct AND similarity * 100 + 1e-9 >= step) AS correct, count(*) FILTER (NOT correct AND similarity * 100 + 1e-9 >= step) AS wrong FROM grid, near GROUP BY step)"


def near(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit("all").alias("scope"), F.col("embedding").alias("v"), "label")
    found = op.nearest(vectors.filter("id % 2 = 1"), vectors.filter("id % 2 = 0"))
    label = vectors.select("id", "label")
    out = found.join(label.toDF("query_id", "own"), "query_id").join(label.toDF("vec_id", "other"), "vec_id")
    return out.select("query_id", "vec_id", (F.col("own") == F.col("other")).alias("correct"), "similarity")


@query("vector_nearest", f"WITH {_NEAR} SELECT query_id, vec_id, round(similarity, 6) AS similarity FROM near")
def vector_nearest(spark, sf_dir):
    return near(spark, sf_dir).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query("vector_hits_at", f"WITH {_NEAR} SELECT correct, count(*) AS hits FROM near WHERE similarity >= 0.3 GROUP BY 1")
def vector_hits_at(spark, sf_dir):
    return near(spark, sf_dir).filter("similarity >= 0.3").groupBy("correct").agg(F.count(F.lit(1)).alias("hits"))


@query("vector_curve", f"WITH {_CURVE} SELECT *, round(correct / queries, 9) AS hit_rate, CASE WHEN correct + wrong > 0 THEN round(wrong / (correct + wrong), 9) END AS false_rate FROM curve")
def vector_curve(spark, sf_dir):
    return op.curve(near(spark, sf_dir))


@query("vector_threshold_choice", f"WITH {_CURVE} SELECT min(threshold) AS threshold FROM curve WHERE correct + wrong > 0 AND wrong / (correct + wrong) <= 0.02")
def vector_threshold_choice(spark, sf_dir):
    return op.smallest_threshold(op.curve(near(spark, sf_dir)))


@query("vector_pair_similarity", "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT a.label, count(*) AS pairs, round(avg(round(list_inner_product(a.v, b.v), 9)), 6) AS mean_similarity FROM v a JOIN v b ON a.label = b.label AND b.vec_id = a.vec_id + 10 GROUP BY 1")
def vector_pair_similarity(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    other = v.select((F.col("vec_id") - 10).alias("vec_id"), "label", F.col("embedding").alias("other"))
    return v.join(other, ["vec_id", "label"]).groupBy("label").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.round(op.dot(F.col("embedding"), F.col("other")), 9)), 6).alias("mean_similarity"))


@query("cache_exact_hits", """WITH t AS (SELECT conv_id, turn, role, sha256(lower(split_part(text, ' ', 1))) AS question_hash, conv_id % 3 AS scope FROM conversations WHERE role = 'user'), s AS (SELECT scope, question_hash, min(conv_id * 1000 + turn) AS hit_id FROM t WHERE conv_id % 2 = 0 GROUP BY 1, 2)
SELECT t.conv_id, t.turn, s.hit_id FROM t JOIN s USING (scope, question_hash) WHERE t.conv_id % 2 = 1""")
def cache_exact_hits(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'")
    normal = F.lower(F.split_part("text", F.lit(" "), F.lit(1)))
    rows = asked.select("conv_id", "turn", F.sha2(normal, 256).alias("question_hash"), (F.col("conv_id") % 3).alias("scope"))
    store = rows.filter("conv_id % 2 = 0").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return op.exact_hits(rows.filter("conv_id % 2 = 1"), store).select("conv_id", "turn", "hit_id")


@query("cache_question_hits", r"""WITH t AS (SELECT conv_id, turn, sha256(lower(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')))) AS question_hash, conv_id % 3 AS scope FROM conversations WHERE role = 'user'), f AS (SELECT *, first_value(conv_id) OVER w AS c, first_value(turn) OVER w AS n FROM t WINDOW w AS (PARTITION BY scope, question_hash ORDER BY conv_id, turn)), h AS (SELECT *, question_hash IS NOT NULL AND (c < conv_id OR n < turn) AS hit FROM f)
SELECT conv_id, turn, CASE WHEN hit THEN c END AS hit_conv, CASE WHEN hit THEN n END AS hit_turn FROM h""")
def cache_question_hits(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'")
    rows = asked.select(F.struct("conv_id", "turn").alias("id"), F.sha2(normalised(F.col("text")), 256).alias("question_hash"), (F.col("conv_id") % 3).alias("scope"))
    return op.earlier_hits(rows).select("id.conv_id", "id.turn", F.col("hit_id.conv_id").alias("hit_conv"), F.col("hit_id.turn").alias("hit_turn"))


_OTHERS = _NEAR.replace("q.vec_id % 2 = 1 AND s.vec_id % 2 = 0", "q.vec_id <> s.vec_id")


def near_others(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit("all").alias("scope"), F.col("embedding").alias("v"), "label")
    label = vectors.select("id", "label")
    out = op.nearest(vectors, vectors, others=True).join(label.toDF("query_id", "own"), "query_id").join(label.toDF("vec_id", "other"), "vec_id")
    return out.select("query_id", "vec_id", (F.col("own") == F.col("other")).alias("correct"), "similarity")


@query("vector_nearest_other", f"WITH {_OTHERS} SELECT query_id, vec_id, round(similarity, 6) AS similarity FROM near")
def vector_nearest_other(spark, sf_dir):
    return near_others(spark, sf_dir).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query("vector_curve_others", f"WITH {_CURVE.replace(_NEAR, _OTHERS)} SELECT *, round(correct / queries, 9) AS hit_rate, CASE WHEN correct + wrong > 0 THEN round(wrong / (correct + wrong), 9) END AS false_rate FROM curve")
def vector_curve_others(spark, sf_dir):
    return op.curve(near_others(spark, sf_dir))


@query("vector_pair_matrix", "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT a.label, b.label AS other_label, count(*) AS pairs, round(avg(round(list_inner_product(a.v, b.v), 9)), 6) AS mean_similarity FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY 1, 2")
def vector_pair_matrix(spark, sf_dir):
    return op.pair_matrix(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v")))


GRID = [0.2, 0.25, 0.3, 0.35, 0.4]

# Every call in turn, at every threshold, with the list of what that threshold's cache holds.
_REPLAY = """
WITH RECURSIVE v AS (
    SELECT vec_id, vec_id % 20 AS scope, label, vec_id % 7 <> 0 AS storable, vec_id % 11 <> 0 AS marked, vec_id % 20 * 1000 + vec_id % 160 // 20 * 3 AS question, (vec_id % 13) / 100.0 AS cost, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v,
           row_number() OVER (PARTITION BY vec_id % 20 ORDER BY vec_id) AS nr FROM embeddings
), sims AS (
    SELECT a.scope, a.nr, b.nr AS other, b.label, b.vec_id AS source, a.question = b.question AS same, round(list_inner_product(a.v, b.v), 9) AS sim FROM v a JOIN v b ON a.scope = b.scope AND b.nr < a.nr
), t AS (
    SELECT unnest([0.2, 0.25, 0.3, 0.35, 0.4])::DOUBLE AS threshold
), r AS (
    SELECT DISTINCT scope, threshold, 0::BIGINT AS nr, []::BIGINT[] AS held, NULL::VARCHAR AS outcome, NULL::DOUBLE AS similarity, NULL::BIGINT AS source FROM v, t
    UNION ALL
    SELECT scope, threshold, nr, CASE WHEN outcome = 'miss' AND storable THEN list_append(held, nr) ELSE held END, outcome, CASE outcome WHEN 'exact' THEN 1.0 WHEN 'out' THEN NULL ELSE sim END, CASE outcome WHEN 'exact' THEN exact WHEN 'semantic' THEN near WHEN 'false' THEN near END
    FROM (
        SELECT scope, threshold, nr, held, storable, exact, near, sim, CASE WHEN NOT marked THEN 'out' WHEN exact IS NOT NULL THEN 'exact' WHEN sim >= threshold THEN CASE WHEN near_label = label THEN 'semantic' ELSE 'false' END ELSE 'miss' END AS outcome
        FROM (
            SELECT r.scope, r.threshold, v.nr, r.held, any_value(v.storable) AS storable, any_value(v.marked) AS marked, any_value(v.label) AS label,
                   arg_min(s.source, s.other) FILTER (WHERE s.same) AS exact, max(s.sim) AS sim, arg_max(s.source, (s.sim, -s.other)) AS near, arg_max(s.label, (s.sim, -s.other)) AS near_label
            FROM r JOIN v ON v.scope = r.scope AND v.nr = r.nr + 1 LEFT JOIN sims s ON s.scope = r.scope AND s.nr = v.nr AND list_contains(r.held, s.other)
            GROUP BY r.scope, r.threshold, v.nr, r.held
        )
    )
), o AS (
    SELECT v.vec_id, v.question, v.cost, r.* EXCLUDE (held) FROM r JOIN v USING (scope, nr)
)
"""


def replayed(spark, sf_dir):
    """Every vector as a call, in order within its scope: some repeat a question, some aren't marked or can't be stored."""
    i = F.col("vec_id")
    question = (i % 20 * 1000 + F.floor(i % 160 / 20) * 3).cast("string")
    calls = table(spark, sf_dir, "embeddings").select(i.alias("id"), (i % 20).alias("scope"), question.alias("question"), F.col("label").alias("family"), (i % 7 != 0).alias("storable"), (i % 11 != 0).alias("marked"), ((i % 13) / 100).alias("cost_usd"), F.col("embedding").alias("v"))
    return ce.replay_grid(calls, "scope", ["id"], GRID)


@query("cache_replay_grid", _REPLAY + "SELECT vec_id AS id, threshold, outcome, round(similarity, 6) AS similarity, source FROM o")
def cache_replay_grid(spark, sf_dir):
    return ce.by_threshold(replayed(spark, sf_dir)).select("id", "threshold", "outcome", F.round("similarity", 6).alias("similarity"), "source")


@query(
    "cache_replay_summary",
    _REPLAY
    + """, p AS (SELECT threshold, count(*) AS pairs, sum(f) AS pairs_false FROM (SELECT threshold, question, source, max(CASE WHEN outcome = 'false' THEN 1 ELSE 0 END) AS f FROM o WHERE outcome IN ('semantic', 'false') GROUP BY ALL) GROUP BY 1),
s AS (SELECT threshold, count(*) AS calls, count(*) FILTER (outcome <> 'out') AS looked_up, count(*) FILTER (outcome IN ('exact', 'semantic', 'false')) AS hits, count(*) FILTER (outcome = 'exact') AS exact_hits, count(*) FILTER (outcome IN ('semantic', 'false')) AS semantic_hits, count(*) FILTER (outcome = 'false') AS semantic_false,
round(sum(cost), 6) AS spend_usd, round(sum(cost) FILTER (outcome IN ('exact', 'semantic', 'false')), 6) AS saved_usd FROM o GROUP BY 1)
SELECT s.*, coalesce(pairs, 0) AS pairs, CAST(coalesce(pairs_false, 0) AS BIGINT) AS pairs_false, round(hits / looked_up, 6) AS hit_rate, round(saved_usd / spend_usd, 6) AS saved_share FROM s LEFT JOIN p USING (threshold)""",
)
def cache_replay_summary(spark, sf_dir):
    told = ce.replay_summary(ce.by_threshold(replayed(spark, sf_dir)))
    return told.drop("saved_semantic_usd", "uncosted_hits", "false_of_semantic", "pairs_low", "pairs_high")


_EVALUATED = """
WITH v AS (SELECT vec_id, label, vec_id % 3 AS scope, CASE WHEN vec_id % 2 = 1 THEN 'odd' ELSE 'even' END AS split, CASE WHEN vec_id % 5 = 0 THEN 'persona' ELSE 'paraphrase' END AS kind, vec_id % 4 < 2 AS stored, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
n AS (SELECT q.scope, q.split, q.kind, arg_max(s.label = q.label, (round(list_inner_product(q.v, s.v), 9), -s.vec_id)) AS correct, max(round(list_inner_product(q.v, s.v), 9)) AS sim FROM v q JOIN v s ON s.stored AND NOT q.stored AND q.scope = s.scope AND q.split = s.split GROUP BY q.vec_id, q.scope, q.split, q.kind),
p AS (SELECT scope, split, kind, threshold, count(*) AS queries, count(*) FILTER (correct AND sim + 1e-9 >= threshold) AS correct, count(*) FILTER (NOT correct AND sim + 1e-9 >= threshold) AS wrong FROM n, (SELECT unnest([0.2, 0.25, 0.3, 0.35, 0.4])::DOUBLE AS threshold) GROUP BY ALL),
c AS (SELECT scope, min(CASE WHEN correct + wrong > 0 AND wrong <= 0.9 * (correct + wrong) THEN threshold END) AS chosen FROM p WHERE split = 'odd' AND kind = 'paraphrase' GROUP BY 1)
SELECT p.*, round(correct / queries, 6) AS hit_rate, CASE WHEN correct + wrong > 0 THEN round(wrong / (correct + wrong), 6) END AS false_rate, chosen FROM p LEFT JOIN c USING (scope)
"""


@query("cache_evaluation", _EVALUATED)
def cache_evaluation(spark, sf_dir):
    """Two halves, two kinds of query and three scopes; half of each half is stored, and the odd half chooses."""
    i = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(i.alias("id"), (i % 3).alias("scope"), ce.half(i).alias("split"), F.when(i % 5 == 0, "persona").otherwise("paraphrase").alias("kind"), (i % 4 < 2).alias("stored"), F.col("label").alias("family"), F.col("embedding").alias("v"))
    return ce.evaluate(rows.filter("NOT stored"), rows.filter("stored"), GRID, most_false=0.9)


@query("cache_hit_rows", _REPLAY + "SELECT vec_id AS call_id, threshold, 0.0::DOUBLE AS cost_usd, 'cached' AS served, round(similarity, 6) AS cache_similarity, source AS source_id FROM o WHERE outcome IN ('exact', 'semantic', 'false')")
def cache_hit_rows(spark, sf_dir):
    return ce.hit_rows(ce.by_threshold(replayed(spark, sf_dir)))
