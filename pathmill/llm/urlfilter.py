"""URL filter on a path-template tree, in DataFrame operations only.

Per host the paths' segments form a tree. At each node, segments that hold under MIN_SHARE or MIN_PAGES of its pages are
variable and become one wildcard; the remaining siblings, at most 1 / MIN_SHARE and the wildcard, are ordered by their
share of bad labels, and each is merged with those before it while its share differs, by a two-proportion test, neither
from theirs together nor from the first one's; siblings without labels are a cluster of their own. The tree grows as
long as some node with MIN_PAGES pages has a further segment. A template is rejected if its labelled purity (share of good labels, smoothed
towards its host's, which is smoothed towards all pages') is under MIN_PURITY. Rules for hosts and path prefixes come
first; the longest that fits wins.

A label is bad if its quality is 0 or it is toxic; of repeated labels of a page any bad one counts, a null is not bad.
Defined results: a null url or one without `://` has an empty host and path and is judged as a page of that host;
repeated rows and ids stay separate rows; without labels every template is allowed; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathmill.llm.common import keep, materialize, scratch, table

#: (host, path prefix, verdict); a rule also fits the host's subdomains.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
MIN_SHARE = 0.05
MIN_PAGES = 3
MERGE_Z = 1.96
SMOOTHING = 4.0
MIN_PURITY = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits as a struct of its text and verdict, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _apart(l1: Column, b1: Column, l2: Column, b2: Column) -> Column:
    """Whether two shares of bad labels differ by a two-proportion test."""
    pooled, gap = (b1 + b2) / (l1 + l2), b1 / l1 - b2 / l2
    return gap * gap > MERGE_Z * MERGE_Z * pooled * (1 - pooled) * (1 / l1 + 1 / l2)


def _clusters(siblings: Column) -> Column:
    """Arrays of the segments of labelled siblings, given by their share of bad labels, that are merged.

    A sibling starts a new cluster if it differs from the running one as a whole or from its first sibling, so that
    small steps do not join ends that differ.
    """
    start = F.struct(
        F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("own"),
        *[F.lit(0).cast("long").alias(c) for c in ("labelled", "bad", "first_labelled", "first_bad")],
    )

    def add(s: Column, x: Column) -> Column:
        n, bad = x.labelled.cast("long"), x.bad.cast("long")
        new = (F.size(s.own) == 0) | _apart(s.labelled, s.bad, n, bad) | _apart(s.first_labelled, s.first_bad, n, bad)
        new = F.coalesce(new, F.lit(True))
        return F.struct(
            F.when(new & (F.size(s.own) > 0), F.concat(s.done, F.array(s.own))).otherwise(s.done).alias("done"),
            F.when(new, F.array(x.fixed)).otherwise(F.concat(s.own, F.array(x.fixed))).alias("own"),
            F.when(new, n).otherwise(s.labelled + n).alias("labelled"),
            F.when(new, bad).otherwise(s.bad + bad).alias("bad"),
            F.when(new, n).otherwise(s.first_labelled).alias("first_labelled"),
            F.when(new, bad).otherwise(s.first_bad).alias("first_bad"),
        )

    return F.aggregate(siblings, start, add, lambda s: F.when(F.size(s.own) > 0, F.concat(s.done, F.array(s.own))).otherwise(s.done))


def _names(longer: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """(host, template, names) for each of ``nodes`` (host, template, total): the templates' names of the segments at
    ``depth`` that are not variable; all others are a wildcard.

    Each join here is of two written tables and is written itself before the next shuffle, so that adaptive execution
    can split a node with very many children; what is grouped by a node is at most 1 / MIN_SHARE siblings and a wildcard.
    """
    node = ["host", "template"]
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    children = materialize(longer.groupBy(*node, F.element_at("segments", depth + 1).alias("seg")).agg(*sums))
    shared = materialize(children.join(nodes, node).withColumn("fixed", F.when((F.col("n") >= MIN_SHARE * F.col("total")) & (F.col("n") >= MIN_PAGES), F.col("seg"))).drop("seg"))
    siblings = shared.groupBy(*node, "fixed").agg(*sums)  # combined before the shuffle
    rate = (F.col("bad") + 1) / (F.col("labelled") + 2)
    sibling = F.struct(rate.alias("rate"), F.coalesce("fixed", F.lit("")).alias("order"), "fixed", "labelled", "bad")
    rows = siblings.groupBy(*node).agg(F.sort_array(F.collect_list(sibling)).alias("all"))
    unknown = F.filter("all", lambda x: x.labelled == 0)
    rows = rows.withColumn("clusters", _clusters(F.filter("all", lambda x: x.labelled > 0))).withColumn("unknown", F.transform(unknown, lambda x: x.fixed))
    groups = F.when(F.size("unknown") > 0, F.concat("clusters", F.array("unknown"))).otherwise(F.col("clusters"))
    members, wild = F.filter("members", lambda x: x.isNotNull()), F.exists("members", lambda x: x.isNull())
    names = rows.select(*node, F.explode(groups).alias("members")).select(*node, members.alias("members"), wild.alias("wild"))
    own = F.array_join(F.sort_array(F.transform("members", lambda x: F.concat(F.lit("="), x))), "|")
    names = names.withColumn("name", F.when(F.col("wild"), F.lit("*")).otherwise(own))
    entries = F.flatten(F.collect_list(F.transform("members", lambda x: F.struct(x.alias("seg"), F.col("name").alias("name")))))
    return materialize(names.groupBy(*node).agg(F.map_from_entries(entries).alias("names")))


def _grown(paths: DataFrame) -> DataFrame:
    """``paths`` with their whole templates.

    A node of under MIN_PAGES pages has wildcards only, and one that a single path reaches has that path's segments only;
    their paths are named to the end at once, so that a round is needed only where paths of a node may still differ.
    """
    node, named, depth = ["host", "template"], [], 0
    while True:
        size = F.size("segments")
        rest = F.slice("segments", depth + 1, F.greatest(size - depth, F.lit(0)))
        named.append(paths.where(size <= depth))
        longer = paths.where(size > depth)
        nodes = materialize(longer.groupBy(*node).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("paths")).where(F.col("total") >= MIN_PAGES))
        wide = nodes.where("paths > 1").select(*node, "total")
        grows = not wide.isEmpty()
        kinds = nodes.select(*node, (F.col("paths") > 1).alias("wide"))
        if grows:
            kinds = kinds.join(_names(longer, wide, depth), node, "left")
        else:
            kinds = kinds.withColumn("names", F.lit(None).cast("map<string,string>"))
        joined = materialize(longer.join(materialize(kinds), node, "left"))
        tail = F.when(F.col("wide").isNotNull(), F.array_join(F.transform(rest, lambda x: F.concat(F.lit("/="), x)), "")).otherwise(F.repeat(F.lit("/*"), size - depth))
        named.append(joined.where("wide is null or not wide").withColumn("template", F.concat("template", tail)).select(*paths.columns))
        if not grows:
            break
        name = F.coalesce(F.element_at("names", F.element_at("segments", depth + 1)), F.lit("*"))
        paths = joined.where("wide").withColumn("template", F.concat("template", F.lit("/"), name)).select(*paths.columns)
        depth += 1
    return reduce(DataFrame.unionByName, named)


def templates(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, path, template, purity) for every distinct host and path of ``pages`` (page_id, host, path)."""
    bad = ((F.col("quality") == 0) | (F.col("toxic") > 0)).cast("int")
    judged = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.coalesce(bad, F.lit(0))).alias("bad"))
    joined = pages.join(judged, F.col("page_id") == F.col("_id"), "left")
    paths = joined.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad")
    )
    segments = F.split(F.substr(F.col("path"), F.lit(2)), "/")
    paths = materialize(paths.withColumn("segments", F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(segments)).withColumn("template", F.lit("")))
    with scratch(pages.sparkSession):
        paths = keep(_grown(paths).drop("segments"))
    prior = paths.agg(((F.sum("labelled") - F.sum("bad") + 1) / (F.sum("labelled") + 2)).alias("prior"))
    per_host = paths.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("bad").alias("hb")).crossJoin(F.broadcast(prior))  # one row
    host_purity = (F.col("hl") - F.col("hb") + SMOOTHING * F.col("prior")) / (F.col("hl") + SMOOTHING)
    per_host = per_host.select("host", host_purity.alias("host_purity"))
    per_template = paths.groupBy("host", "template").agg(F.sum("labelled").alias("tl"), F.sum("bad").alias("tb")).join(per_host, "host")
    purity = (F.col("tl") - F.col("tb") + SMOOTHING * F.col("host_purity")) / (F.col("tl") + SMOOTHING)
    per_template = materialize(per_template.select("host", "template", purity.alias("purity")))  # so that the join can be split
    return paths.select("host", "path", "template").join(per_template, ["host", "template"])


def filter_urls(pages: DataFrame, labels: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for every row of ``pages``."""
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    found = templates(rows, labels)
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("purity") < MIN_PURITY, F.lit("block")).otherwise(F.lit("allow")))
    return rows.join(found, ["host", "path"]).withColumn("_rule", rule).select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")


def op9_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
