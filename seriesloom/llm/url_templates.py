"""URL filter: fixed host and path rules, then a per-host tree of path templates judged by labelled purity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"),
         UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*", 0)
    return F.when(at > 0, F.translate(host, UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[UrlRule], value) -> Column:
    """`value` of the longest rule that fits, else null."""
    chain = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        chain = F.when(fits, F.lit(value(r))).otherwise(chain)
    return chain


def shape_of(path: Column, depth: int) -> Column:
    """Path segments with digit runs and long hexadecimal strings made wildcards, below `depth` joined to one tail."""
    plain = F.regexp_replace(F.regexp_replace(path, r"(?<=/)[0-9a-fA-F-]{16,}(?=/|$)", "{h}"), "[0-9]+", "{n}")
    parts = F.split(F.regexp_replace(plain, "^/", ""), "/")
    tail = F.when(F.size(parts) > depth, F.array(F.lit("**"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.slice(parts, 1, depth), tail)


def _differs(part: Column, n: Column, whole: Column, total: Column, z: float) -> Column:
    """Whether a share of a branch differs from the share of its siblings together, by a two-proportion test."""
    others, rest = whole - part, total - n
    pooled = whole / total
    error = F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / F.greatest(rest, F.lit(1))))
    gap = F.abs(part / n - others / F.greatest(rest, F.lit(1)))
    return (rest > 0) & (error > 0) & (gap > z * error)


def template_tree(paths: DataFrame, depth: int, many: int = 20, z: float = 2.0) -> DataFrame:
    """host, shape -> template. `paths` has host, shape, n, blocked, allowed, one row per distinct shape.

    Level by level each node is summed from its branches. A node with more than `many` branches, none repeated often on
    average, is a variable segment: all become one wildcard. Otherwise branches whose blocked and allowed shares do not
    differ from their siblings' merge into one wildcard, and those that do differ stay. Parents and branches meet in
    equi-joins on (host, template so far), which split when a host is hot.
    """
    at = paths.select("host", "shape", "n", "blocked", "allowed", F.lit("").alias("template"))
    for level in range(1, depth + 2):
        segment = F.get("shape", F.lit(level - 1))
        at = at.withColumn("segment", segment)
        open_rows = at.where(F.col("segment").isNotNull())
        branch = open_rows.groupBy("host", "template", "segment").agg(F.sum("n").alias("bn"), F.sum("blocked").alias("bb"), F.sum("allowed").alias("ba"))
        node = branch.groupBy("host", "template").agg(F.sum("bn").alias("tn"), F.sum("bb").alias("tb"), F.sum("ba").alias("ta"), F.count("*").alias("branches"))
        both = branch.join(node, ["host", "template"])
        variable = (F.col("branches") > many) & (F.col("branches") * 3 > F.col("tn"))
        odd = _differs(F.col("bb"), F.col("bn"), F.col("tb"), F.col("tn"), z) | _differs(F.col("ba"), F.col("bn"), F.col("ta"), F.col("tn"), z)
        name = F.when(F.col("branches") == 1, F.col("segment")).when(variable | ~odd, "*").otherwise(F.col("segment"))
        named = both.select("host", "template", "segment", name.alias("name"))
        at = at.join(named, ["host", "template", "segment"], "left").select(
            "host", "shape", "n", "blocked", "allowed",
            F.when(F.col("name").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "name")).alias("template"))
        at = stored(at, "url-level")
    return at


def url_verdicts(pages: DataFrame, rules: Sequence[UrlRule] = RULES, depth: int = 3, prior: float = 0.5, strength: float = 4.0,
                 purity: float = 0.8, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, template, block_share, verdict for every row.

    Urls that a rule fits are the labelled ones. A template is rejected when its blocked share of labelled urls,
    smoothed by `strength` urls of share `prior`, reaches `purity`; a template without labels stays at the prior. A null
    url or one without `://` has an empty host and path and is judged like any other template. Repeated pages are
    judged each; an empty table gives no rows.
    """
    base = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    base = base.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    judged = base.select("*", rule_of(F.col("host"), F.col("path"), rules, lambda r: r.name).alias("rule"),
                         rule_of(F.col("host"), F.col("path"), rules, lambda r: r.verdict).alias("ruled"),
                         shape_of(F.col("path"), depth).alias("shape"))
    paths = stored(judged.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "block").alias("blocked"),
                                                       F.count_if(F.col("ruled") == "allow").alias("allowed")), "url-shapes")
    tree = template_tree(paths, depth)
    leaves = tree.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"))
    share = (F.col("b") + strength * prior) / (F.col("b") + F.col("a") + strength)
    scored = stored(tree.join(leaves, ["host", "template"]).select("host", "shape", "template", share.alias("block_share")), "url-templates")
    verdict = F.coalesce("ruled", F.when(F.col("block_share") >= purity, "block").otherwise("allow"))
    return judged.join(scored, ["host", "shape"]).select("page_id", "host", "path", "rule", "template", "block_share", verdict.alias("verdict"))
