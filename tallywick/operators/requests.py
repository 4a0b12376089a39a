"""Requests against routes, teams, price lists and stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywick.sources.ledger import LEDGER_SCHEMA

# What a sealed record of schema 1 does not hold of a ledger row, and what later schemas add.
_NOT_SEALED = {"trace_id", "span_id", "raw_path"}
_ADDED = {2: ["redacted"], 3: ["injection"], 4: ["cache_similarity", "cache_source"]}


def resolve_routes(requests: DataFrame, routes: DataFrame, providers: DataFrame, passthrough: bool = False) -> DataFrame:
    """Adds provider, target, region and problem to requests (with ``model``).

    ``provider/model`` goes to that provider as it is; else the model is an alias of routes (alias, provider, model,
    region), which a pass-through refuses. A route's region stands over its provider's (provider, region). Routes and
    providers are configuration, a row each.
    """
    at = F.instr("model", "/")
    explicit = at > 0
    named = requests.withColumns({"_own": F.when(explicit, F.substring_index("model", "/", 1)), "_id": F.when(explicit, F.expr("substring(model, instr(model, '/') + 1)"))})
    known = routes.select(F.col("alias").alias("_alias"), F.col("provider").alias("_route"), F.col("model").alias("_model"), F.col("region").alias("_region"))
    found = named.join(F.broadcast(known), ~explicit & (F.col("model") == F.col("_alias")), "left").withColumn("provider", F.coalesce("_own", "_route"))
    homes = providers.select(F.col("provider").alias("_home"), F.col("region").alias("_default"))
    found = found.join(F.broadcast(homes), F.col("provider") == F.col("_home"), "left")
    problem = (
        F.when(explicit & ((F.col("_own") == "") | (F.col("_id") == "")), "malformed")
        .when(explicit & F.col("_home").isNull(), "unknown provider")
        .when(~explicit & F.lit(passthrough), "alias in pass-through")
        .when(~explicit & F.col("_alias").isNull(), "unknown alias")
    )
    fine = problem.isNull()
    return found.select(
        *requests.columns,
        F.when(fine, F.col("provider")).alias("provider"),
        F.when(fine, F.coalesce("_id", "_model")).alias("target"),
        F.when(fine, F.coalesce("_region", "_default")).alias("region"),
        problem.alias("problem"),
    )


def team_limits(requests: DataFrame, teams: DataFrame) -> DataFrame:
    """Requests (team, model, explicit, max_tokens) against their team's models and answer length: adds allowed_tokens, the
    length to ask for, and refused. Teams (team, models, limit) are configuration; null models allow all, a null limit any."""
    own = requests.join(F.broadcast(teams), "team", "left")
    listed = F.col("models").isNull() | F.array_contains("models", F.col("model")) | F.array_contains("models", F.col("explicit"))
    refused = F.when(~listed, "model_not_allowed").when(F.col("max_tokens") > F.col("limit"), "max_tokens_too_large")
    return own.select(*requests.columns, F.when(refused.isNull(), F.coalesce("max_tokens", "limit")).alias("allowed_tokens"), refused.alias("refused"))


def price_placement(prices: DataFrame, providers: DataFrame) -> DataFrame:
    """Rates in a list that has no business with them: prices (list, own, provider), where own says that the list is of
    self-hosted rates; providers (provider, self_hosted). Returns list, provider, problem."""
    known = prices.select("list", "own", "provider").distinct().join(F.broadcast(providers), "provider", "left")
    problem = F.when(~F.col("own") & F.col("self_hosted"), "self-hosted in the vendor list").when(F.col("own") & F.col("self_hosted").isNull(), "unknown provider").when(F.col("own") & ~F.col("self_hosted"), "vendor in a self-hosted list")
    return known.select("list", "provider", problem.alias("problem")).filter("problem IS NOT NULL")


def sealed_columns(schema: int) -> list[str]:
    """The ledger columns that a record of a schema from 1 to 4 seals."""
    if schema not in (1, 2, 3, 4):
        raise ValueError(f"no record schema {schema}")
    later = {c for k, cs in _ADDED.items() for c in cs if k > schema}
    return [f.name for f in LEDGER_SCHEMA if f.name not in _NOT_SEALED | later]


def sealed(ledger: DataFrame, schema: int = 4) -> DataFrame:
    """The sealed part of ledger rows; a column that an older ledger lacks is null."""
    return ledger.select(*[F.col(c) if c in ledger.columns else F.lit(None).cast(LEDGER_SCHEMA[c].dataType).alias(c) for c in sealed_columns(schema)])


def cache_put(answers: DataFrame) -> DataFrame:
    """What a store of whole answers keeps of (key, at, status, body): the last 2xx per key."""
    good = answers.filter(F.col("status").between(200, 299))
    return good.groupBy("key").agg(F.max_by(F.struct("status", "body"), "at").alias("kept")).select("key", "kept.*")


def cache_get(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Requests (with ``key``) and the stored status and body, null on a miss."""
    return requests.join(store.withColumns({"hit_status": F.col("status"), "hit_body": F.col("body")}).select("key", "hit_status", "hit_body"), "key", "left")


def families(items: DataFrame) -> DataFrame:
    """id and family: an item's parent where it has one, else itself."""
    return items.select("id", F.coalesce(F.when(F.col("parent_id") != "", F.col("parent_id")), F.col("id")).alias("family"))


def missing(wanted: DataFrame, present: DataFrame, *keys: str) -> DataFrame:
    """Rows that are wanted and not present, by keys."""
    return wanted.join(present.select(*keys).distinct(), list(keys), "left_anti")


def rolled_up(calls: DataFrame, by: list[str], counters: list[str], forms: str) -> DataFrame:
    """Counters and a map of counts per form, added component by component."""
    plain = calls.groupBy(*by).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in counters])
    each = calls.select(*by, F.explode(forms).alias("_form", "_n")).groupBy(*by, "_form").agg(F.sum("_n").alias("_n"))
    maps = each.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_form", "_n")))).alias(forms))
    both = plain.alias("p").join(maps.alias("m"), [F.col(f"p.{c}").eqNullSafe(F.col(f"m.{c}")) for c in by], "left")
    return both.select(*[f"p.{c}" for c in by], *[f"p.{c}" for c in counters], F.coalesce(f"m.{forms}", F.create_map().cast(calls.schema[forms].dataType)).alias(forms))


def record_loss(calls: DataFrame, rows: DataFrame) -> DataFrame:
    """Per arm: calls made, calls with a row, rows still in flight, calls without one, and those that no cap has seen.

    calls (arm, call_uid, capped) are what was sent, rows (call_uid, error_type) what the ledger holds."""
    held = rows.groupBy("call_uid").agg(F.min(F.col("error_type").eqNullSafe("in_flight")).alias("flying"))
    both = calls.join(held, "call_uid", "left")
    count = lambda c: F.count(F.when(c, 1))
    lost = F.col("flying").isNull()
    return both.groupBy("arm").agg(F.count(F.lit(1)).alias("calls"), count(~lost).alias("rows"), count(F.col("flying")).alias("in_flight"), count(lost).alias("missing"), count(~F.col("capped")).alias("uncapped"))


def caps_and_fidelity(calls: DataFrame) -> DataFrame:
    """Per arm: calls attempted beyond a cap, of those the ones that reached upstream, and the share of identical answers."""
    over = F.col("spent_usd") + F.col("estimate_usd") > F.col("cap_usd")
    return calls.groupBy("arm").agg(
        F.count(F.when(over, 1)).alias("over_cap"), F.count(F.when(over & F.col("reached"), 1)).alias("over_cap_reached"),
        F.count(F.when(F.col("sent_sha") == F.col("got_sha"), 1)).alias("identical"), F.count(F.lit(1)).alias("calls"),
    )


def judge_calibration(verdicts: DataFrame, *by: str) -> DataFrame:
    """A judge against people: verdicts (truth, said) to tp, fn, fp, tn, sensitivity and specificity."""
    count = lambda t, s: F.count(F.when((F.col("truth") == t) & (F.col("said") == s), 1))
    share = lambda hit, miss: F.when(F.col(hit) + F.col(miss) > 0, F.col(hit) / (F.col(hit) + F.col(miss)))
    sums = verdicts.groupBy(*by).agg(count(True, True).alias("tp"), count(True, False).alias("fn"), count(False, True).alias("fp"), count(False, False).alias("tn"))
    return sums.withColumns({"sensitivity": share("tp", "fn"), "specificity": share("tn", "fp")})


def rehydration_cost(answers: DataFrame) -> DataFrame:
    """Per arm: answers, and those that still hold a placeholder once they are restored for their caller."""
    left = F.col("restored").rlike(r"<[A-Z_]+_[0-9]+>")
    return answers.groupBy("arm").agg(F.count(F.lit(1)).alias("answers"), F.count(F.when(left, 1)).alias("unresolved"))


def run_merge(runs: list[DataFrame]) -> DataFrame:
    """Stored runs as one, if each is over the same pages and seed, and if a run's rows agree on their fingerprint."""
    seen = {(r["pages"], r["seed"]) for run in runs for r in run.select("pages", "seed").distinct().limit(2).collect()}
    if len(seen) > 1:
        raise ValueError("runs over different pages or seeds cannot be scored together")
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out


def same_fingerprint(stored: DataFrame, fingerprint: Column) -> DataFrame:
    """Stored rows, or an error in the first task that meets one of another fingerprint."""
    told = F.assert_true(F.col("fingerprint") == fingerprint, F.lit("a stored run has another fingerprint"))
    return stored.filter(told.isNull())
