"""Reports over a ledger: spend, residency, dashboards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNDECLARED = "undeclared"
# Data classes, residencies by reach, and the errors that count as refusals.
DATA_CLASSES = ["public", "internal", "personal", "sensitive"]
RESIDENCIES = ["single-region", "geo", "global"]
REFUSALS = ["policy_refused", "redaction_refused", "injection_blocked"]
IN_FLIGHT = "in_flight"


def label(value: Column) -> Column:
    """A class or residency as printed: null is undeclared, everything else, the empty text included, as stored."""
    return F.coalesce(value, F.lit(UNDECLARED))


def dash(value: Column) -> Column:
    """A key as printed in groups: null and empty become a dash."""
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit("-"))


def in_month(month: str) -> Column:
    """A month as a prefix of the time, which reaches the scan as a range."""
    return F.col("ts_utc").startswith(month)


def in_days(first: str, after: str) -> Column:
    return (F.col("ts_utc") >= first) & (F.col("ts_utc") < after)


def of_class(wanted: str | None) -> Column:
    """No filter, undeclared (null), or exactly one class."""
    if wanted is None:
        return F.lit(True)
    return F.col("data_class").isNull() if wanted == UNDECLARED else F.coalesce(F.col("data_class") == wanted, F.lit(False))


def check_class(rows: DataFrame, wanted: str) -> str:
    """Refuse a class that is neither known nor present: an empty report would read as an answer."""
    if wanted != UNDECLARED and wanted not in DATA_CLASSES and rows.filter(F.col("data_class") == wanted).isEmpty():
        raise ValueError(f"data class {wanted!r} is neither known nor in this ledger")
    return wanted


def reach(residency: Column) -> Column:
    """How far a residency lets a request travel: 0 to 2, and 3 for null and unknown ones."""
    out = F.lit(len(RESIDENCIES))
    for rank, name in enumerate(RESIDENCIES):
        out = F.when(residency == name, rank).otherwise(out)
    return out


def uncosted() -> Column:
    """An answered call without a price."""
    return ~F.col("costed") & F.col("error_type").isNull() & F.coalesce(F.col("http_status").between(200, 299), F.lit(False))


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def usd(condition: Column | None = None) -> Column:
    """A sum of costs. Costs have ten places, so it is taken in decimals and does not depend on the order of rows."""
    cost = F.col("cost_usd").cast("decimal(20,10)")
    return F.coalesce(F.sum(cost if condition is None else F.when(condition, cost)).cast("double"), F.lit(0.0))


def spend_report(rows: DataFrame, total: bool = True) -> DataFrame:
    """Calls, errors, uncosted calls, tokens and cost by month, environment, project, class and model; and a grand total,
    whose uncosted count uses the stricter definition. One pass over the rows through grouping sets."""
    keyed = rows.select(
        F.substring("ts_utc", 1, 7).alias("month"), F.coalesce("env", F.lit("-")).alias("env"), "project", label(F.col("data_class")).alias("data_class"), "model_requested",
        "error_type", "costed", "http_status", "input_tokens", "output_tokens", "cost_usd",
    )
    failed = F.coalesce(F.col("error_type") != "", F.lit(False))
    keys = [F.col(c) for c in ("month", "env", "project", "data_class", "model_requested")]
    sets = [keys, []] if total else [keys]
    out = keyed.groupingSets(sets, *keys).agg(
        F.grouping("month").alias("is_total"), F.count(F.lit(1)).alias("calls"), _n(failed).alias("errors"), _n(~failed & ~F.col("costed")).alias("loose"), _n(uncosted()).alias("strict"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), usd(F.col("costed")).alias("cost_usd"),
    )
    whole = F.col("is_total") == 1
    named = [F.when(whole, "total" if c == "month" else "").otherwise(F.col(c)).alias(c) for c in ("month", "env", "project", "data_class", "model_requested")]
    return out.select(*named, "calls", "errors", F.when(whole, F.col("strict")).otherwise(F.col("loose")).alias("uncosted"), "input_tokens", "output_tokens", "cost_usd")


def residency_report(rows: DataFrame) -> DataFrame:
    """Where calls went and how far they may have travelled: by provider, region and residency, widest first."""
    grouped = rows.groupBy("provider", dash(F.col("region")).alias("region"), label(F.col("residency")).alias("residency")).agg(
        F.count(F.lit(1)).alias("calls"), _n(F.col("cached")).alias("cached"), _n(F.coalesce(F.col("error_type") != "", F.lit(False))).alias("errors"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.array_join(F.sort_array(F.collect_set("model_requested")), ",").alias("models"),
    )
    return grouped.withColumn("reach", reach(F.nullif(F.col("residency"), F.lit(UNDECLARED)))).withColumn("sent", F.col("calls") - F.col("cached")).orderBy(F.desc("reach"), "provider", "region", "residency")


def residency_violations(report: DataFrame, limit: str) -> DataFrame:
    """Groups that reach beyond a limit and did send something."""
    return report.filter((F.col("reach") > RESIDENCIES.index(limit)) & (F.col("sent") > 0))


def _cell(value: Column) -> Column:
    """A coarse place of a number that never falls as the number grows; cells are about a 1,400th of their values wide, for
    small values as for large ones, and zero has one of its own."""
    v = value.cast("double")
    far = F.floor((F.least(F.greatest(F.log2(F.abs(v)), F.lit(-1100.0)), F.lit(1100.0)) + 1101) * 1024)
    return F.when(F.isnan(v), F.lit(1 << 40)).when(v == 0, F.lit(0).cast("long")).when(v < 0, -far).otherwise(far)


def values_at(counted: DataFrame, keys: list[str], value: str, weight: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Per group, the values at some ranks (from 0) of those that occur ``weight`` times each: keys, _n, and a column per
    rank, which is a function of how many there are.

    Groups are never sorted whole: a histogram of cells says which cell holds a rank, and only the values of that cell are
    ordered. So a group with most of the rows is many tasks' work, and neither an array nor a sort holds it.
    """
    held = counted.filter(F.col(value).isNotNull() & (F.col(weight) > 0)).withColumn("_cell", _cell(F.col(value)))
    cells = held.groupBy(*keys, "_cell").agg(F.sum(weight).alias("_in"))
    of_group = Window.partitionBy(*keys)
    ahead = F.coalesce(F.sum("_in").over(of_group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumns({"_ahead": ahead, "_n": F.sum("_in").over(of_group)})
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), at(F.col("_n")).cast("long").alias("at")) for name, at in ranks.items()]))
    wanted = cells.select(*keys, "_cell", "_n", "_ahead", "_in", each.alias("_w")).filter("_w.at >= _ahead AND _w.at < _ahead + _in")
    wanted = wanted.select(*keys, "_cell", "_n", F.col("_w.name").alias("_name"), (F.col("_w.at") - F.col("_ahead")).alias("_at"))
    upto = F.sum(weight).over(Window.partitionBy(*keys, "_cell", "_name").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    found = held.join(wanted, [*keys, "_cell"]).withColumn("_upto", upto).filter((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col(weight) <= F.col("_at")))
    return found.groupBy(*keys).agg(F.max("_n").alias("_n"), *[F.max(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in ranks])


def nearest(q: float) -> Callable[[Column], Column]:
    """The nearest rank of a quantile: round-half-even of q * (n - 1)."""
    return lambda n: F.bround(q * (n - 1), 0)


def ranked_quantiles(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Nearest-rank quantiles per group, for groups of any size."""
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_k"))
    return values_at(counted, keys, value, "_k", {name: nearest(q) for name, q in quantiles.items()}).drop("_n")


def linear_quantiles(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Quantiles per group with linear interpolation between neighbours, for groups of any size; keys, a column each."""
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_k"))
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, q in quantiles.items():
        ranks[f"{name}_below"] = lambda n, q=q: F.floor(q * (n - 1))
        ranks[f"{name}_above"] = lambda n, q=q: F.ceil(q * (n - 1))
    at = values_at(counted, keys, value, "_k", ranks)
    part = lambda q: q * (F.col("_n") - 1) - F.floor(q * (F.col("_n") - 1))
    return at.select(*keys, *[(F.col(f"{name}_below") + (F.col(f"{name}_above") - F.col(f"{name}_below")) * part(q)).alias(name) for name, q in quantiles.items()])


def dashboard(rows: DataFrame, keys: list[str], since: str | None = None) -> DataFrame:
    """Calls by outcome, cost and latency by any keys; ``day`` is one derived from the time. Latency is that of answered,
    uncached calls, at the nearest rank.

    Rows are read and costed once: they are first summed by keys and latency, and both the sums and the ranks come from
    that."""
    rows = rows if since is None else rows.filter(F.coalesce(F.col("ts_utc"), F.lit("")) >= since)
    rows = rows.withColumn("day", F.substring("ts_utc", 1, 10))
    failed = F.coalesce(F.col("error_type") != "", F.lit(False))
    timed = ~failed & ~F.col("cached") & F.col("latency_ms").isNotNull()
    named = [dash(F.col(k)).alias(k) if k != "day" else F.col(k) for k in keys]
    rows = rows.select(*named, "error_type", "cached", "costed", "http_status", "cost_usd", F.when(timed, F.col("latency_ms")).alias("_ms"))
    refused = F.coalesce(F.col("error_type").isin(REFUSALS), F.lit(False))
    flying = F.coalesce(F.col("error_type") == IN_FLIGHT, F.lit(False))
    counts = {"calls": F.lit(True), "errors": failed & ~refused & ~flying, "refused": refused, "in_flight": flying, "cached": F.col("cached"), "uncosted": uncosted()}
    cost = F.sum(F.when(F.col("costed"), F.col("cost_usd")).cast("decimal(20,10)"))
    base = rows.groupBy(*keys, "_ms").agg(*[_n(c).alias(name) for name, c in counts.items()], cost.alias("cost_usd"))
    sums = base.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in counts], F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("double").alias("cost_usd"))
    ranks = values_at(base.select(*keys, "_ms", "calls"), keys, "_ms", "calls", {"p50_ms": nearest(0.5), "p95_ms": nearest(0.95)})
    return sums.join(ranks.drop("_n"), keys, "left")


def top_with_rest(groups: DataFrame, name: str, value: str, k: int) -> DataFrame:
    """The k largest positive groups, and all others together as one row "N more". The limit runs before any full sort."""
    able = groups.filter(F.col(value) > 0)
    top = able.orderBy(F.desc(value), name).limit(k).select(name, value)
    rest = able.join(top.select(F.col(name).alias("_top")), F.col(name) == F.col("_top"), "left_anti")
    rest = rest.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias(value)).filter("n > 0")
    return top.union(rest.select(F.concat(F.col("n").cast("string"), F.lit(" more")), value))


def spend(rows: DataFrame, *keys: Column) -> DataFrame:
    """Spend by keys; calls in flight count at their estimate, uncosted ones not at all."""
    return rows.groupBy(*keys).agg(usd().alias("spend_usd"))
