"""Urls judged by rules and, where none fits, by a tree of path templates per host.

Every url a rule decides is a label.  Per host the paths form a tree of
segments.  Segments that vary become wildcards: numbers and long hex strings
by their look, rare ones by their share of the node above, and branches whose
labels and whose share of urls that end there do not differ from the rest of
their node by more than chance (Hoeffding's bound) are merged.  A template is
rejected when the share of good labels below it, smoothed towards its host and
the host towards all urls, is small.  DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import settle

DEPTH = 4               # levels of the tree; what lies deeper shares one wildcard
SHARE = 50              # a branch of less than one in SHARE of its node's urls varies
LEAST_ROWS = 10         # and so does one of fewer urls than this
CHANCE = 0.05           # risk of keeping two branches apart that are alike
WEIGHT = 10.0           # labels that the level above counts for
LEAST_PURITY = 0.25     # share of good labels below which a template goes

BOUND = math.sqrt(math.log(2 / CHANCE) / 2)
# Neither stands in a path, so a template never mixes with a literal segment.
VARIED = "#"
MERGED = "?"


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Name and verdict of the longest rule that fits, else NULL; of equally long ones the first by name."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        here = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        fits = F.when(here, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(fits)
    return fits


def shape_of(path: Column) -> Column:
    """The first segments of a path with numbers and long hex strings as wildcards."""
    varied = F.regexp_replace(F.regexp_replace(path, "[0-9A-Fa-f]{16,}", VARIED), "[0-9]+", VARIED)
    segments = F.split(varied, "/")
    tail = F.when(F.size(segments) > DEPTH + 1, F.lit(f"/{MERGED}")).otherwise("")
    return F.concat(F.array_join(F.slice(segments, 1, DEPTH + 1), "/"), tail)


def _differs(part: str, whole: str) -> Column:
    """Whether two shares differ by more than chance; without a count on either side they do not."""
    share = F.abs(F.col(f"{part}") / F.col(f"{whole}") - F.col(f"node_{part}") / F.col(f"node_{whole}"))
    far = share > BOUND * (1 / F.sqrt(F.col(whole)) + 1 / F.sqrt(F.col(f"node_{whole}")))
    return F.when(F.col(whole) > 0, far).otherwise(False)


_SUMS = ("urls", "labelled", "bad", "ending")


def _deepened(leaves: DataFrame, level: int) -> DataFrame:
    """Adds the segment of one level, or a wildcard, to the template of every leaf that reaches it."""
    segments = F.split("shape", "/")
    here = leaves.withColumn("segment", F.when(F.size(segments) > level, F.element_at(segments, level + 1)))
    ends = F.when(F.size(segments) == level + 1, F.col("urls")).otherwise(0)
    node = ["host", "template"]
    sums = [F.sum(c).alias(c) for c in _SUMS]
    branches = here.filter("segment is not null").withColumn("ending", ends).groupBy(*node, "segment").agg(*sums)
    nodes = branches.groupBy(*node).agg(*[F.sum(c).alias(f"node_{c}") for c in _SUMS])
    usual = (F.col("urls") >= LEAST_ROWS) & (F.col("urls") * SHARE >= F.col("node_urls"))
    apart = usual & (_differs("bad", "labelled") | _differs("ending", "urls"))
    literal = branches.join(nodes, node).filter(apart).select(*node, "segment", F.col("segment").alias("literal"))
    longer = F.concat("template", F.lit("/"), F.coalesce("literal", F.lit(MERGED)))
    merged = here.join(literal, [*node, "segment"], "left")
    return merged.select("host", "shape", F.when(F.col("segment").isNull(), F.col("template")).otherwise(longer).alias("template"), "urls", "labelled", "bad")


def templates(urls: DataFrame) -> DataFrame:
    """(host, shape, template, purity) for frames of ``host, shape, bad``; ``bad`` is 1, 0 or NULL (no label)."""
    leaves = settle(
        urls.groupBy("host", "shape").agg(
            F.count(F.lit(1)).alias("urls"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
        ).withColumn("template", F.lit(""))
    )
    for level in range(1, DEPTH + 1):
        leaves = settle(_deepened(leaves, level))
    hosts = leaves.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("bad").alias("host_bad"))
    labelled, bad = hosts.agg(F.sum("host_labelled"), F.sum("host_bad")).first()
    overall = (bad or 0) / labelled if labelled else 0.0
    host_share = (F.col("host_bad") + F.lit(WEIGHT) * F.lit(overall)) / (F.col("host_labelled") + WEIGHT)
    share = (F.col("bad") + F.lit(WEIGHT) * host_share) / (F.col("labelled") + WEIGHT)
    found = leaves.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    pure = found.join(hosts, "host").select("host", "template", (1 - share).alias("purity"))
    return settle(leaves.select("host", "shape", "template").join(pure, ["host", "template"]))


def judged(pages: DataFrame, keep: Sequence[str] = (), url: str = "url", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Columns ``keep`` and, per row, ``host, path, rule, verdict, template, purity``.

    Null urls and urls without ``://`` have an empty host and path; copies of
    a url count as often as they occur; an empty table gives no rows; columns
    not in ``keep`` are ignored, so their names cannot clash.  Paths deeper
    than ``DEPTH`` share the template of their first segments.  The join of
    rows with templates is left to Spark: its skew join splits a hot host.
    """
    clash = {"host", "path", "rule", "verdict", "template", "purity"} & {k.lower() for k in keep}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are results")
    parsed = pages.select(*[F.col(f"`{k}`") for k in keep], host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    ruled = parsed.withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("shape", shape_of(F.col("path")))
    verdict = F.col("_rule.verdict")
    known = templates(ruled.select("host", "shape", F.when(verdict == "block", 1).when(verdict == "allow", 0).alias("bad")))
    own = F.when(F.col("purity") < LEAST_PURITY, "block").otherwise("allow")
    return ruled.join(known, ["host", "shape"], "left").select(
        *[F.col(f"`{k}`") for k in keep], "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(verdict, own).alias("verdict"), "template", "purity",
    )
