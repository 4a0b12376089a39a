"""Chain queries over the ledger projection: a chain per user, its records in order of the event."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywick.operators import chain as op
from tallywick.plans.registry import query, table
from tallywick.sources.files import kept

_BODY = """concat('{{"id":', CAST(event_id AS {s}), ',"kind":"call","type":"', event_type, '"}}')"""
_BODIES = f"bodies AS (SELECT user_id AS chain, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, {_BODY.format(s='VARCHAR')} AS body FROM events)"
_CHAIN = f"""{_BODIES}, built AS (SELECT chain, seq, body, repeat('0', 64) AS prev_hash, sha256(unhex(repeat('0', 64)) || encode(body)) AS record_hash FROM bodies WHERE seq = 1
  UNION ALL SELECT b.chain, b.seq, b.body, c.record_hash, sha256(unhex(c.record_hash) || encode(b.body)) FROM bodies b JOIN built c ON b.chain = c.chain AND b.seq = c.seq + 1)"""


def bodies(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    # Of a repeated id the type decides, so that the order is the same whenever it is made.
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id", "event_type")).cast("long")
    return events.select(F.col("user_id").alias("chain"), seq.alias("seq"), F.expr(_BODY.format(s="STRING")).alias("body"))


def built(spark, sf_dir, often: bool = True):
    """The records of all chains; where they are read often, folded once and kept."""
    records = op.build(bodies(spark, sf_dir))
    return kept(records) if often else records


@query("chain_links", f"WITH RECURSIVE {_CHAIN} SELECT * FROM built")
def chain_links(spark, sf_dir):
    return built(spark, sf_dir, often=False)


# Breaks by the rule of a log that is read from its start: its order, the hash stored before, the body's own hash and form.
_BREAKS = """v AS (SELECT *, coalesce(lag(seq) OVER w, 0) + 1 AS next, coalesce(lag(record_hash) OVER w, repeat('0', 64)) AS expected FROM t WINDOW w AS (PARTITION BY chain ORDER BY seq, record_hash))
SELECT chain, seq, 'sequence' AS kind FROM v WHERE seq <> next UNION ALL SELECT chain, seq, 'link' FROM v WHERE prev_hash <> expected UNION ALL SELECT chain, seq, 'hash' FROM v WHERE record_hash <> sha256(unhex(prev_hash) || encode(body)) UNION ALL SELECT chain, seq, 'body' FROM v WHERE NOT json_valid(body)"""


@query("chain_verify", f"WITH RECURSIVE {_CHAIN}, t AS (SELECT * FROM built UNION ALL SELECT * FROM built WHERE (chain + seq) % 97 = 5), b AS ({'WITH ' + _BREAKS}) SELECT (SELECT count(*) FROM b) AS breaks, (SELECT count(*) FROM t) AS records")
def chain_verify(spark, sf_dir):
    # The log with some of its records written twice.
    records = built(spark, sf_dir)
    records = records.unionByName(records.filter("(chain + seq) % 97 = 5"))
    return op.verify(records).agg(F.count(F.lit(1)).alias("breaks")).crossJoin(records.agg(F.count(F.lit(1)).alias("records")))


@query("chain_append", f"WITH RECURSIVE {_CHAIN} SELECT * FROM built WHERE seq > 5")
def chain_append(spark, sf_dir):
    every = bodies(spark, sf_dir)
    later = every.filter("seq > 5").withColumn("seq", F.col("seq") - 5)
    return op.append(op.build(every.filter("seq <= 5")), later)


@query("chain_importable", f"WITH RECURSIVE {_CHAIN} SELECT chain FROM built GROUP BY chain HAVING chain % 5 <> 2 AND (chain % 3 <> 1 OR max(seq) < 4)")
def chain_importable(spark, sf_dir):
    # Of each third chain record 4 is edited; of each fifth something is held already.
    records = built(spark, sf_dir)
    edited = F.when((F.col("chain") % 3 == 1) & (F.col("seq") == 4), F.concat("body", F.lit(" "))).otherwise(F.col("body"))
    return op.importable(records.withColumn("body", edited), records.filter("chain % 5 = 2 AND seq = 1"))


@query("chain_heads", f"WITH RECURSIVE {_CHAIN} SELECT chain, max(seq) AS seq, max_by(record_hash, seq) AS head FROM built GROUP BY 1")
def chain_heads(spark, sf_dir):
    return op.heads(built(spark, sf_dir, often=False))


# Edits that keep the record's hash, edits that renew it, and deletions, at records of their own.
_TAMPER = "CASE WHEN (chain * 31 + seq) % 101 = 7 THEN 'edit' WHEN (chain * 31 + seq) % 101 = 47 THEN 'rehash' WHEN (chain * 31 + seq) % 101 = 83 THEN 'delete' END"


@query("chain_tampered", f"""WITH RECURSIVE {_CHAIN}, marked AS (SELECT *, {_TAMPER} AS how FROM built), t AS (SELECT chain, seq, prev_hash, CASE WHEN how IN ('edit', 'rehash') THEN body || 'x' ELSE body END AS body,
  CASE WHEN how = 'rehash' THEN sha256(unhex(prev_hash) || encode(body || 'x')) ELSE record_hash END AS record_hash FROM marked WHERE coalesce(how, '') <> 'delete'),
{_BREAKS}""")
def chain_tampered(spark, sf_dir):
    marked = built(spark, sf_dir, often=False).withColumn("how", F.expr(_TAMPER)).filter("coalesce(how, '') <> 'delete'")
    body = F.when(F.col("how").isin("edit", "rehash"), F.concat("body", F.lit("x"))).otherwise(F.col("body"))
    edited = marked.withColumn("body", body).withColumn("record_hash", F.when(F.col("how") == "rehash", op.link(F.col("prev_hash"), F.col("body"))).otherwise(F.col("record_hash")))
    return op.verify(edited.drop("how"))


@query("anchors_check", f"""WITH RECURSIVE {_CHAIN}, anchors AS (SELECT chain, seq, CASE WHEN chain % 10 = 3 THEN repeat('f', 64) ELSE record_hash END AS head FROM built WHERE seq % 20 = 0 UNION ALL SELECT chain, max(seq) + 5, repeat('a', 64) FROM built WHERE chain % 10 = 4 GROUP BY 1),
ends AS (SELECT chain, max(seq) AS last FROM built GROUP BY 1)
SELECT a.chain, a.seq, CASE WHEN a.seq > last THEN 'truncated' ELSE 'anchor' END AS kind FROM anchors a JOIN ends USING (chain) LEFT JOIN built b ON a.chain = b.chain AND a.seq = b.seq WHERE a.seq > last OR b.record_hash <> a.head""")
def anchors_check(spark, sf_dir):
    records = built(spark, sf_dir)
    told = records.filter("seq % 20 = 0").select("chain", "seq", F.when(F.col("chain") % 10 == 3, F.repeat(F.lit("f"), F.lit(64))).otherwise(F.col("record_hash")).alias("head"))
    past = records.filter("chain % 10 = 4").groupBy("chain").agg((F.max("seq") + 5).alias("seq")).withColumn("head", F.repeat(F.lit("a"), F.lit(64)))
    return op.check_anchors(records, told.union(past))


_SEALED = "s AS (SELECT CAST(event_id AS VARCHAR) AS call_uid, concat(event_type, CASE WHEN event_id % 50 = 1 THEN '!' ELSE '' END) AS body, CASE WHEN event_id % 9 = 0 THEN 'in_flight' END AS error_type FROM events WHERE event_id % 11 <> 0), l AS (SELECT CAST(event_id AS VARCHAR) AS call_uid, CASE WHEN event_id % 9 = 0 THEN 'done' ELSE event_type END AS body, CAST(NULL AS VARCHAR) AS error_type FROM events WHERE event_id % 13 <> 0)"


@query("ledger_chain_diff", f"""WITH {_SEALED} SELECT coalesce(s.call_uid, l.call_uid) AS call_uid, CASE WHEN s.call_uid IS NULL THEN 'unsealed' WHEN l.call_uid IS NULL THEN 'ledger_missing' WHEN s.body = l.body THEN 'sealed' WHEN s.error_type = 'in_flight' THEN 'resealable' ELSE 'ledger_changed' END AS state FROM s FULL JOIN l ON s.call_uid = l.call_uid""")
def ledger_chain_diff(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("call_uid"), "event_id", "event_type")
    flying = F.col("event_id") % 9 == 0
    sealed = events.filter("event_id % 11 <> 0").select("call_uid", F.concat("event_type", F.when(F.col("event_id") % 50 == 1, "!").otherwise("")).alias("body"), F.when(flying, "in_flight").alias("error_type"), F.col("event_id").alias("seq"))
    held = events.filter("event_id % 13 <> 0").select("call_uid", F.when(flying, "done").otherwise(F.col("event_type")).alias("body"), F.lit(None).cast("string").alias("error_type"))
    return op.against_ledger(sealed, held)


@query("canonical_bodies")
def canonical_bodies(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select("event_id", "props")
    return raw.select("event_id", op.canonical_json("props").alias("body"), (op.canonical_json("props") == F.col("props")).alias("is_canonical"))


_KINDS = "CASE chain % 7 WHEN 0 THEN 'edit' WHEN 1 THEN 'edit_both' WHEN 2 THEN 'delete_both' WHEN 3 THEN 'insert_both' WHEN 4 THEN 'swap_both' WHEN 5 THEN 'truncate_both' ELSE 'replace_both' END"


# What must be found, by reasoning: a record at or after the first changed one has another hash, and an anchor there tells.
@query("tamper_measure", f"""WITH n AS (SELECT user_id AS chain, count(*) AS n FROM events GROUP BY 1), t AS (SELECT chain, n, 1 + chain * 7 % n AS spot, {_KINDS} AS kind, n // 20 * 20 AS anchored FROM n),
first AS (SELECT *, CASE kind WHEN 'insert_both' THEN spot + 1 WHEN 'truncate_both' THEN spot + 1 WHEN 'replace_both' THEN 1 WHEN 'swap_both' THEN CASE WHEN spot < n THEN spot END ELSE spot END AS changed FROM t)
SELECT kind, count(*) AS chains, CAST(0 AS BIGINT) AS by_chain, count(*) FILTER (anchored > 0 AND anchored >= changed) AS by_anchor, count(*) FILTER (kind = 'edit') AS by_ledger FROM first GROUP BY 1""")
def tamper_measure(spark, sf_dir):
    rows = bodies(spark, sf_dir)
    targets = rows.groupBy("chain").agg(F.count(F.lit(1)).alias("n")).select("chain", F.expr(_KINDS).alias("kind"), F.expr("1 + chain * 7 % n").alias("at"))
    return op.tamper_measure(rows, targets)
