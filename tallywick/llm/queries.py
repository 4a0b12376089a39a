"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywick.llm import conversations, exact_dedup, licenses, line_dedup, mixing, near_dedup, packing, phrases, quality, topk_search, toxicity, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op2_licences", licenses.oracle_sql())
def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licences(_table(spark, sf_dir, "documents"))


@_query("licence_notices", licenses.notices_sql())
def licence_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_notices(_table(spark, sf_dir, "documents"))


@_query("op3_mixing")
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


@_query("op4_near_dedup")
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"))


@_query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


@_query("op6_url_filter")
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


TOPK_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@_query("op7_exact_top_k", TOPK_SQL)
def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


WARC_SQL = """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), h AS (
    SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p
), d AS (
    SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(floor(CAST('0x' || substr(hex, 1 + CAST(i // 4 * 5 AS INT), 5) AS INT) / power(32, 3 - i % 4)) AS BIGINT) % 32, 1)), '') AS payload_digest FROM h
), r AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM r
"""


@_query("op8_warc", WARC_SQL)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


EXACT_SQL = r"""
WITH texts AS (
    SELECT doc_id, length(coalesce(text, '')) AS n_points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
    FROM documents
), ranked AS (
    SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY text_sha256) AS group_size
    FROM texts
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
"""


@_query("op9_exact_dedup", EXACT_SQL)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


@_query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


LINES_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS nr, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), keyed AS (
    SELECT nr, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM docs
), keys AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM keyed
), gone AS (
    SELECT key FROM (SELECT DISTINCT nr, key FROM keys WHERE key <> '') GROUP BY key HAVING count(*) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(gone.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE gone.key IS NULL), '')) AS kept_sha256
FROM keys LEFT JOIN gone USING (key)
GROUP BY nr, doc_id
"""


@_query("op11_line_dedup", LINES_SQL)
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.kept_lines(_table(spark, sf_dir, "documents"))


REPAIR_SQL = r"""
WITH RECURSIVE given AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS UBIGINT)) AS bytes
    FROM conversations
), coded AS (
    SELECT *, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, _: xor(x >> 1, (x & 1) * 3988292384::UBIGINT)))) % 20 AS kind
    FROM given
), after AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM coded WHERE kind <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS nr, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
    FROM after
), faulty AS (
    SELECT *, left(role, 1) AS initial,
           CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nr) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM placed
), gaps(before, next, ins) AS (
    VALUES ('', 's', 0), ('', 'u', 0), ('', 'a', 1), ('s', 'u', 0), ('s', 'a', 1), ('u', 'u', 1), ('u', 'a', 0), ('a', 'u', 0), ('a', 'a', 1)
), ways AS (
    SELECT conv_id, nr, before, before AS state, 4 AS cost, 'D' AS edit FROM faulty, (VALUES (''), ('s'), ('u'), ('a')) b(before)
    UNION ALL
    SELECT conv_id, nr, before, next, 3 * ins + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END + CASE WHEN initial = next THEN 0 ELSE 3 END, repeat('I', ins) || CASE WHEN initial = next THEN 'K' ELSE 'R' END
    FROM faulty, gaps WHERE fault NOT IN ('blank', 'duplicate') AND (initial = next OR next <> 's')
), solved AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS nr, '' AS state, '000000000000' AS best FROM conversations
    UNION ALL
    SELECT s.conv_id, w.nr, w.state, min(printf('%012d', CAST(left(s.best, 12) AS BIGINT) + w.cost) || substr(s.best, 13) || w.edit)
    FROM solved s JOIN ways w ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND w.nr = s.nr + 1 AND w.before = s.state
    GROUP BY s.conv_id, w.nr, w.state
), ended AS (
    SELECT s.conv_id, min(printf('%012d', CAST(left(best, 12) AS BIGINT) + 3 * e.ins) || substr(best, 13) || repeat('I', e.ins)) AS best
    FROM solved s JOIN (VALUES ('', 0), ('s', 2), ('u', 1), ('a', 0)) e(state, ins) USING (state)
    WHERE s.nr = (SELECT count(*) FROM faulty f WHERE f.conv_id IS NOT DISTINCT FROM s.conv_id)
    GROUP BY s.conv_id
), edits AS (
    SELECT conv_id, unnest(string_split(substr(best, 13), '')) AS edit, generate_subscripts(string_split(substr(best, 13), ''), 1) AS place FROM ended WHERE length(best) > 12
), rows_ AS (
    SELECT *, sum(CASE WHEN edit = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY place) AS nr FROM edits
), kept AS (
    SELECT r.conv_id, r.place, r.edit, f.role, CASE WHEN r.edit = 'I' THEN '' ELSE f.text END AS text,
           row_number() OVER (PARTITION BY r.conv_id ORDER BY r.place) - 1 AS nth,
           max(CASE WHEN r.edit = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY r.conv_id) AS led
    FROM rows_ r LEFT JOIN faulty f ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.nr = f.nr AND r.edit <> 'I'
    WHERE r.edit <> 'D'
), lines AS (
    SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - led) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place) AS told FROM kept GROUP BY conv_id
), counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
           count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY nr) || initial AS pair FROM faulty) GROUP BY conv_id
)
SELECT c.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal,
       CAST(left(e.best, 12) AS BIGINT) AS cost, substr(e.best, 13) AS audit, sha256(coalesce(l.told, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN ended e ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN counts n ON c.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN lines l ON c.conv_id IS NOT DISTINCT FROM l.conv_id
"""


@_query("op12_conversation_repair", REPAIR_SQL)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(_table(spark, sf_dir, "conversations"))


PHRASES_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL
), numbered AS (
    SELECT row_number() OVER () AS nr, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), worded AS (
    SELECT nr, lang, unnest(w) AS w1, generate_subscripts(w, 1) AS place FROM numbered
), followed AS (
    SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM worded WINDOW o AS (PARTITION BY nr ORDER BY place)
), grams AS (
    SELECT lang, 1 AS size, w1 AS phrase FROM followed
    UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM followed WHERE w2 IS NOT NULL
    UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM followed WHERE w3 IS NOT NULL
), counts AS (
    SELECT lang, size, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, size, phrase
), words AS (
    SELECT lang, sum(f) AS n FROM counts WHERE size = 1 GROUP BY lang
), candidates AS (
    SELECT * FROM counts WHERE size > 1 AND f >= 10
), cuts AS (
    SELECT lang, phrase, f AS a, w, unnest(range(1, size)) AS k FROM candidates
), keyed AS (
    SELECT lang || ' ' || phrase AS key, f FROM counts
), parts AS (
    SELECT *, lang || ' ' || array_to_string(w[1:k], ' ') AS l_key, lang || ' ' || array_to_string(w[k + 1:], ' ') AS r_key FROM cuts
), scored AS (
    SELECT p.lang, p.phrase, p.a, p.k, l.f AS l, r.f AS r, (1000000::HUGEINT * p.a * p.a) // (l.f::HUGEINT * r.f) AS score
    FROM parts p JOIN keyed l ON l.key = p.l_key JOIN keyed r ON r.key = p.r_key
), best AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
    SELECT lang, phrase, max(f) AS around FROM (
        SELECT lang, f, w[1] || ' ' || w[2] AS phrase FROM candidates WHERE size = 3
        UNION ALL SELECT lang, f, w[2] || ' ' || w[3] FROM candidates WHERE size = 3
    ) GROUP BY lang, phrase
), kept AS (
    SELECT b.* FROM best b LEFT JOIN inside i USING (lang, phrase) WHERE i.around IS NULL OR 100 * i.around < 50 * b.a
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY k.score DESC, k.a DESC, encode(k.phrase)) AS rank, k.phrase, k.a, k.l, k.r, CAST(w.n AS BIGINT) AS n, CAST(k.score AS BIGINT) AS score
FROM kept k JOIN words w USING (lang)
QUALIFY rank <= 2000
"""


@_query("op13_collocations", PHRASES_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))
