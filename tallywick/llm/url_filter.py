"""URL filters: host rules, and a tree of path templates per host judged by smoothed labelled purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywick.llm.common import cut

# Fixed values: (verdict, rule); a rule is a host, which stands for its subdomains too, and the start of a path.
RULES: list[tuple[str, str]] = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Siblings whose block rates differ by less than so many standard errors are merged into the wildcard beside them.
MERGE_Z = 1.96
#: A template is rejected if (blocked + PRIOR * what is known beforehand) / (labelled + PRIOR) is above this.
PURITY = 0.5
#: Labelled pages that what is known beforehand counts as; a branch with fewer pages than this has no verdict of its own.
PRIOR = 4.0
WILD = "*"
#: Stands for a node's rare children until the end; apart from WILD, which the form of a segment gives.
RARE = "\0rare"
RARE_NAME = "*rare"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; null or without ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for judged, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = text.find("/")
        own, start = (text[:at], text[at:]) if at >= 0 else (text, "")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, judged).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """The path's segments, those that vary by their form as a wildcard; an extension is kept."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.regexp_replace(s, r"^(?=[^.]*[0-9])[^.]+", WILD))


def _same_rate(hits: Column, n: Column, all_hits: Column, all_n: Column) -> Column:
    """Whether a child's share of hits is that of its siblings together, within MERGE_Z standard errors; both are smoothed."""
    others, other_hits = all_n - n, all_hits - hits
    rate = (all_hits + 1) / (all_n + 2)
    error = F.sqrt(rate * (1 - rate) * (1 / (n + 1) + 1 / (others + 1)))
    return F.abs((hits + rate) / (n + 1) - (other_hits + rate) / (others + 1)) < MERGE_Z * error


SUMS = ("pages", "labelled", "blocked")


def _branches(tree: DataFrame, segments: str) -> DataFrame:
    """A row per segment of each row of tree: its place, and the branches that lead up to it and through it, as hashes."""
    grow = lambda sofar, s: F.concat(sofar, F.array(F.xxhash64(F.element_at(sofar, -1), s)))
    chain = F.aggregate(F.col(segments), F.array(F.lit(0).cast("long")), grow)
    return tree.withColumn("_chain", chain).select(
        "*", F.posexplode(segments).alias("place", "segment"), F.get("_chain", F.col("place")).alias("parent"), F.get("_chain", F.col("place") + 1).alias("branch")
    ).drop("_chain")


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS])


def _rare(nodes: DataFrame, siblings: list[str], sampled: bool) -> DataFrame:
    """Nodes with too few pages for a verdict of their own, which become one wildcard among their siblings."""
    rare = nodes.filter((F.col("pages") < PRIOR) & (F.col("segment") != WILD))
    if not sampled:
        return rare.filter("labelled = 0")
    sums = _sums(rare, *siblings).select(*siblings, F.col("pages").alias("all_pages"), F.col("labelled").alias("all"), F.col("blocked").alias("bad"))
    like_others = _same_rate(F.col("labelled"), F.col("pages"), F.col("all"), F.col("all_pages")) & _same_rate(F.col("blocked"), F.col("labelled"), F.col("bad"), F.col("all"))
    return rare.join(sums, siblings).filter(like_others)


def _generalised(counts: DataFrame, sampled: bool) -> DataFrame:
    """counts with ``template``: each shape with its variable segments as RARE.

    Of a shape's branches from the root, the first rare one is variable. What follows it is not told apart by its
    value: segments at the same distance behind the same branch are counted together, and are variable if rare there.
    """
    rows = _branches(counts, "shape")
    rare = _rare(_sums(rows, "host", "parent", "branch", "segment"), ["host", "parent"], sampled)
    marked = rows.join(rare.select("host", "branch", F.lit(True).alias("rare")), ["host", "branch"], "left")
    first = F.min(F.when(F.col("rare"), F.struct("place", "parent"))).over(Window.partitionBy("host", "shape"))
    marked = marked.withColumn("first", first).withColumn("behind", F.greatest(F.lit(0), F.col("place") - F.col("first.place"))).withColumn("anchor", F.col("first.parent"))
    tail = ["host", "anchor", "behind", "segment"]
    odd = _rare(_sums(marked.filter("behind > 0"), *tail), tail[:3], sampled).select(*tail, F.lit(True).alias("odd"))
    named = F.when((F.col("place") == F.col("first.place")) | F.col("odd"), RARE).otherwise(F.col("segment"))
    segments = F.transform(F.array_sort(F.collect_list(F.struct("place", named.alias("s")))), lambda x: x["s"])
    made = marked.join(odd, tail, "left").groupBy("host", "shape").agg(segments.alias("template"))
    whole = counts.join(made, ["host", "shape"], "left")
    return whole.withColumn("template", F.coalesce("template", F.array().cast("array<string>")))


def _merged(templates: DataFrame) -> DataFrame:
    """(host, template) to ``final``: branches whose block rate is that of their siblings together become the wildcard.

    Not if the wildcard beside them differs, and only between branches with labels, as those without say nothing for or
    against others, and may have their verdicts from other hosts. The pooled rare ones take the wildcard where it is free.
    """
    rows = _branches(_sums(templates, "host", "template"), "template")
    nodes = _sums(rows, "host", "parent", "branch", "segment")
    all_of = Window.partitionBy("host", "parent")
    nodes = nodes.withColumns({"all": F.sum("labelled").over(all_of), "bad": F.sum("blocked").over(all_of)})
    nodes = nodes.withColumn("alike", (F.col("labelled") > 0) & (F.col("all") > F.col("labelled")) & _same_rate(F.col("blocked"), F.col("labelled"), F.col("bad"), F.col("all")))
    wild = F.col("segment") == WILD
    nodes = nodes.withColumns({"clash": F.max(wild & ~F.col("alike")).over(all_of), "taken": F.max(wild | F.col("alike")).over(all_of)})
    takes = nodes.filter((F.col("alike") & ~F.col("clash")) | ((F.col("segment") == RARE) & ~F.col("taken"))).select("host", "branch", F.lit(True).alias("takes"))
    named = F.when(F.col("takes"), WILD).otherwise(F.col("segment"))
    segments = F.transform(F.array_sort(F.collect_list(F.struct("place", named.alias("s")))), lambda x: x["s"])
    made = rows.join(takes, ["host", "branch"], "left").groupBy("host", "template").agg(segments.alias("final"))
    return templates.join(made, ["host", "template"], "left").withColumn("final", F.coalesce("final", F.array().cast("array<string>")))


def template_tree(counts: DataFrame, sampled: bool = False) -> DataFrame:
    """From (host, shape, pages, labelled, blocked), what each shape generalises to and its verdict: host, shape, template,
    learned.

    In a host's tree of paths, a node's rare children become one: those with fewer than PRIOR pages, which no verdict of
    their own could rest on. Frequent children stay, however many there are. Labels that a rule gave name their branch
    and say nothing of others, so rare children join only where none has any; of ``sampled`` labels, a rare child joins
    if its labelled share and its block rate are those of the other rare ones. Then children whose block rate is that of
    their siblings together join them. What is left are templates. A template is rejected by its labelled pages' blocked
    share, smoothed by that of the same template on all hosts, which is smoothed by the share of all of its host's pages
    that are known to be blocked, and this by that of all pages. All steps are grouped sums over rows that count pages,
    far fewer than pages; paths may have any depth.
    """
    tree = cut(_merged(cut(_generalised(counts, sampled), "generalised")), "tree")
    own = _sums(tree, "host", "final")
    base = _sums(own).select(((F.col("blocked") + 1) / (F.col("pages") + PRIOR)).alias("base"))
    hosts = _sums(own, "host").crossJoin(F.broadcast(base)).select("host", ((F.col("blocked") + PRIOR * F.col("base")) / (F.col("pages") + PRIOR)).alias("of_host"))
    everywhere = _sums(own, "final").select("final", F.col("labelled").alias("all"), F.col("blocked").alias("bad"))
    rates = own.join(hosts, "host").join(everywhere, "final")
    before = (F.col("bad") + PRIOR * F.col("of_host")) / (F.col("all") + PRIOR)
    rate = (F.col("blocked") + PRIOR * before) / (F.col("labelled") + PRIOR)
    judged = rates.select("host", "final", F.when(rate > PURITY, "block").otherwise("allow").alias("learned"))
    return tree.join(judged, ["host", "final"]).select("host", "shape", F.col("final").alias("template"), "learned")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The verdict on every url: its longest rule's, else that of its path template.

    ``labels`` are (url, blocked) pairs to learn purity from; without them, the pages that rules decide are the labelled
    ones, so that a template mostly blocked by rules blocks pages of the same form too. A template without labelled pages
    on its host goes by those of other hosts, and without any by the share of its host's pages that are known blocked.

    Returns page_id, host, path, rule, verdict, template. A null url, or one without ``://``, has an empty host and path
    and no rule, and is judged as a host of its own. Of two rules of equal length that fit, the later by code point holds.
    A path of any length is read whole. Repeated rows each give a row and count as pages each; an empty table gives none;
    further columns of pages play no part. A host with a third of all pages is counted before any shuffle; its pages meet
    its templates in a join whose page side Spark can split.
    """
    rules = RULES if rules is None else rules
    host, path = url_parts(F.col(url_col))
    own = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = own.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), shape(F.col("path")).alias("shape"))
    counted = own.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("pages"), F.count("ruled").alias("labelled"), F.coalesce(F.sum((F.col("ruled") == "block").cast("long")), F.lit(0)).alias("blocked")
    )
    if labels is not None:
        host, path = url_parts(F.col("url"))
        given = labels.select(host.alias("host"), shape(path).alias("shape"), F.col("blocked").cast("boolean").alias("bad")).groupBy("host", "shape").agg(F.count("bad").alias("labelled"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("blocked"))
        counted = counted.select("host", "shape", "pages").join(given, ["host", "shape"], "full").na.fill(0, list(SUMS))
        counted = counted.withColumn("pages", F.greatest("pages", "labelled"))
    learned = template_tree(cut(counted, "shapes"), sampled=labels is not None)
    out = own.join(learned, ["host", "shape"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "learned", F.lit("allow")).alias("verdict"), F.concat(F.lit("/"), F.array_join(F.transform("template", lambda s: F.when(s == RARE, RARE_NAME).otherwise(s)), "/")).alias("template"))
