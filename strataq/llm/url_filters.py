"""URL filters by a path-template tree.

Each host has a tree of path segments. Variable segments (numbers, hex ids) become wildcards at once, and
so do words too rare below their parent to be a branch. Then, from the deepest level up, branches whose children and labels
look like those of all their siblings together are merged into one wildcard; a branch with too few labelled urls
never is, as nothing then shows it to be similar. What is left are templates. A template is rejected if its smoothed
share of blocked urls among labelled ones is high and it has enough of those itself: smoothing alone, towards the share of the
whole table, rejects nothing. Labels come from the rules, whose own urls they decide.

All counts are grouped sums with partial aggregation, so a host with a third of all pages is no hot spot; counts return
to their urls through equi-joins that adaptive execution can split. Each level that the paths have, ``depth`` at most, is
one step of the tree; segments below that are part of the template as they are, numbers and ids as wildcards.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule; repeated rows
count as often as they occur; an empty table gives an empty result; columns besides page_id and url are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.tables import written


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, and all paths that start so."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))


@dataclass(frozen=True)
class TreeLimits:
    min_support: int = 8  # urls that make a word a branch
    min_share: float = 0.01  # of its parent's urls
    min_labels: int = 8  # labelled urls that a branch needs to be compared, and a template to be rejected
    max_distance: float = 0.25  # between child distributions of a branch and of all siblings
    max_z: float = 2.0  # between their blocked shares
    smoothing: float = 4.0  # labelled urls that the overall share counts for
    purity: float = 0.9  # blocked share from which a template is rejected
    depth: int = 16  # levels of the tree; deeper segments are neither compared nor merged


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def shape(segment: Column) -> Column:
    """Numbers and ids as wildcards; words stay."""
    return (
        F.when(segment.rlike(r"^[0-9]+$"), F.lit("{num}"))
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z0-9]+$"), F.concat(F.lit("{num}."), F.regexp_extract(segment, r"([^.]*)$", 1)))
        .when(segment.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), F.lit("{id}"))
        .otherwise(segment)
    )


def merged_at(tree: DataFrame, level: int, limits: TreeLimits) -> DataFrame:
    """``tree`` (host, parts, n, labelled, blocked, wild) with the similar branches of one level as ``{branch}``.

    Compared are the branches of one parent, by what follows below them and by their share of blocked urls, with all
    of the parent's branches together. A branch that ends there has nothing below and stays.
    """
    parent = F.array_join(F.slice("wild", 1, level - 1), "/")
    segment = lambda k: F.coalesce(F.get("wild", F.lit(k)), F.lit(""))
    rows = tree.withColumns({"parent": parent, "branch": segment(level - 1)})
    counts = ("n", "labelled", "blocked")
    by = rows.where(F.size("wild") > level).groupBy("host", "parent", "branch", segment(level).alias("child")).agg(*(F.sum(c).alias(c) for c in counts))
    sums = lambda name, *keys: by.groupBy("host", "parent", *keys).agg(*(F.sum(c).alias(f"{name}_{c}") for c in counts))
    several = by.groupBy("host", "parent").agg(F.min("branch").alias("low"), F.max("branch").alias("high")).where("low != high").select("host", "parent")
    near = by.join(several, ["host", "parent"], "left_semi").join(sums("all", "child").select("host", "parent", "child", "all_n"), ["host", "parent", "child"])
    near = near.join(sums("pool"), ["host", "parent"]).join(sums("own", "branch"), ["host", "parent", "branch"])
    share = F.col("pool_blocked") / F.nullif("pool_labelled", F.lit(0))
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(0.01)) / F.col("own_labelled"))
    like = (F.col("own_labelled") >= limits.min_labels) & (F.abs(F.col("own_blocked") / F.nullif("own_labelled", F.lit(0)) - share) <= limits.max_z * error)
    overlap = F.sum(F.least(F.col("n") / F.col("own_n"), F.col("all_n") / F.col("pool_n")))
    merged = near.where(like).groupBy("host", "parent", "branch").agg(overlap.alias("overlap")).where(F.col("overlap") >= 1 - limits.max_distance)
    rows = rows.join(merged.select("host", "parent", "branch", F.lit(True).alias("merge")), ["host", "parent", "branch"], "left")
    wild = F.when(F.col("merge") & (F.size("wild") > level), F.transform("wild", lambda w, i: F.when(i == level - 1, "{branch}").otherwise(w))).otherwise(F.col("wild"))
    return rows.select("host", "parts", *counts, wild.alias("wild"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, limits: TreeLimits = TreeLimits()) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every page."""
    host, path = split_url(F.col("url"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "ruled": ruled, "parts": F.transform(parts, shape)})
    depth = F.lit(limits.depth)
    prefixes = lambda c: F.transform(F.sequence(F.lit(0), F.least(F.size(c), depth)), lambda i: F.array_join(F.slice(c, F.lit(1), i), "/"))

    # one row for each host and distinct shaped path: pages beyond that only count
    blocked = F.count_if(F.col("ruled") == "block")
    paths = written(urls.groupBy("host", "parts").agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), blocked.alias("blocked")), "url-paths")

    # 1. words that are rare below their parent become wildcards
    nodes = paths.select("host", "n", F.posexplode(prefixes(F.col("parts"))).alias("depth", "prefix")).groupBy("host", "depth", "prefix").agg(F.sum("n").alias("n"))
    above = nodes.select("host", (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"), F.col("n").alias("parent_n"))
    children = nodes.where("depth > 0").withColumn("parent", F.expr("array_join(slice(split(prefix, '/'), 1, depth - 1), '/')"))
    rare = children.join(above, ["host", "depth", "parent"]).where((F.col("n") < limits.min_support) | (F.col("n") < limits.min_share * F.col("parent_n")))
    rare = rare.where(~F.element_at(F.split("prefix", "/"), -1).startswith("{")).select("host", F.col("depth").alias("d"), "prefix")
    at = paths.select("host", "parts", F.posexplode(prefixes(F.col("parts"))).alias("d", "prefix")).where("d > 0")
    flags = at.join(rare.withColumn("rare", F.lit(True)), ["host", "d", "prefix"], "left").groupBy("host", "parts").agg(F.sort_array(F.collect_list(F.struct("d", F.coalesce("rare", F.lit(False)).alias("rare")))).alias("flags"))
    named = paths.join(flags, ["host", "parts"], "left")
    wild = F.zip_with("parts", F.coalesce("flags", F.array().cast("array<struct<d:int,rare:boolean>>")), lambda s, f: F.when(f["rare"], F.lit("{word}")).otherwise(s))
    tree = written(named.select("host", "parts", "n", "labelled", "blocked", wild.alias("wild")), "url-wild")

    # 2. branches that look like all their siblings together are merged, level by level from below
    levels = tree.agg(F.max(F.least(F.size("wild"), depth))).first()[0] or 0
    for level in range(levels, 0, -1):
        tree = written(merged_at(tree, level, limits), "url-tree")
    tree = tree.select("host", "parts", "labelled", "blocked", F.concat(F.lit("/"), F.array_join("wild", "/")).alias("template"))

    # 3. smoothed purity of each template; the overall share is one row
    overall = paths.agg(F.coalesce(F.sum("blocked") / F.sum("labelled"), F.lit(0.0)).alias("prior"))
    purity = (F.sum("blocked") + limits.smoothing * F.first("prior")) / (F.sum("labelled") + limits.smoothing)
    pure = tree.crossJoin(F.broadcast(overall)).groupBy("host", "template").agg(purity.alias("purity"), F.sum("labelled").alias("labels"))
    verdicts = tree.select("host", "parts", "template").join(pure, ["host", "template"])
    verdict = F.coalesce("ruled", F.when((F.col("purity") >= limits.purity) & (F.col("labels") >= limits.min_labels), F.lit("block")).otherwise(F.lit("allow")))
    return urls.join(verdicts, ["host", "parts"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
