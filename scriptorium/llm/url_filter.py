"""URL filter: exact rules first, then a path-template tree per host.

Per host the paths form a tree of segments. Level by level a segment becomes a
wildcard when it is lexically variable (digits, hashes, dates) or when its parent has many rare children;
branches with labels enough whose shares of bad ones cannot be told apart
(two-proportion test on smoothed shares) merge into one. A template's labelled purity is smoothed
by ``strength`` pseudo-labels towards that of the branch above it, and the host's
towards ``prior``, so a branch without labels is judged as its host is and one
with labels by its own. Templates whose purity reaches ``reject_at`` are rejected.

All steps are DataFrame expressions. Paths are first folded to lexical shapes
and counted, so a hot host is pre-aggregated before each shuffle; nothing is
broadcast by hand. Null URLs and URLs without ``://`` have an empty host and
path and form a template of their own; repeated rows count as often as they
occur; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TreeParams:
    """``depth`` levels are told apart, deeper segments are one rest; a parent with
    more than ``fan_out`` children makes those below ``rare_share`` variable."""

    depth: int = 4
    fan_out: int = 12
    rare_share: float = 0.05
    z: float = 1.96
    prior: float = 0.2
    strength: float = 4.0
    reject_at: float = 0.75


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def rule_columns(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict (null where none fits)."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        rule = F.when(_fits(r, host, path), r.text).otherwise(rule)
        verdict = F.when(_fits(r, host, path), r.verdict).otherwise(verdict)
    return rule, verdict


def shape(path: Column, depth: int) -> Column:
    """Segments with lexically variable ones as ``*``; those beyond ``depth`` are joined."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    folded = F.transform(segments, lambda s: F.when(s.rlike(r"^[0-9]+(\.[A-Za-z0-9]+)?$|^[0-9a-fA-F-]{16,}$|^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), F.lit("*")).otherwise(s))
    rest = F.when(F.size(folded) > depth, F.array(F.lit("**"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.slice(folded, 1, depth), rest)


def _smooth(bad: Column, labelled: Column, towards: Column, p: TreeParams) -> Column:
    return (bad + towards * p.strength) / (labelled + p.strength)


def _alike(node: DataFrame, share: Callable[[str, str], Column], p: TreeParams) -> DataFrame:
    """Runs of branches, ordered by their share of bad labels, in which each is like the one before (two-proportion test).

    Branches are pooled by thousandths of that share first, so a parent has at most 1,001 rows here, however many branches.
    """
    pooled = node.where("bucket IS NOT NULL").groupBy("host", "template", "bucket").agg(F.sum("c_lab").alias("lab"), F.sum("c_bad").alias("bad"), F.count("*").alias("branches"))
    row = W.partitionBy("host", "template").orderBy("bucket")
    pooled = pooled.withColumn("lab0", F.lag("lab").over(row)).withColumn("bad0", F.lag("bad").over(row))
    both = pooled.withColumn("lab2", F.col("lab") + F.col("lab0")).withColumn("bad2", F.col("bad") + F.col("bad0"))
    one = share("bad2", "lab2")
    spread = F.sqrt(one * (1 - one) * (1 / (F.col("lab") + p.strength) + 1 / (F.col("lab0") + p.strength)))
    apart = F.coalesce(F.abs(share("bad", "lab") - share("bad0", "lab0")) > p.z * spread, F.lit(True))
    runs = both.withColumn("kind", F.sum(apart.cast("int")).over(row))
    return runs.select("host", "template", "bucket", "kind", F.sum("branches").over(W.partitionBy("host", "template", "kind")).alias("kin"))


def templates(urls: DataFrame, p: TreeParams = TreeParams()) -> DataFrame:
    """(host, shape) -> template, purity, from rows of (host, shape, label 0/1/null)."""
    tree = urls.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("label").alias("lab"), F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0)).alias("bad"))
    tree = materialise(tree, "url-tree")
    hosts = tree.groupBy("host").agg(_smooth(F.sum("bad"), F.sum("lab"), F.lit(p.prior), p).alias("purity"))
    deepest = tree.agg(F.max(F.size("shape"))).first()[0]
    tree = materialise(tree.join(hosts, "host").withColumn("template", F.lit("")), "url-tree")
    for level in range(0 if deepest is None else deepest + 1):
        ended = F.size("shape") < level  # the template was complete before
        tree = tree.withColumn("seg", F.when(ended, None).when(F.size("shape") > level, F.get("shape", F.lit(level))).otherwise(""))  # no segment is empty
        child = tree.where("seg IS NOT NULL").groupBy("host", "template", "seg").agg(*[F.sum(c).alias(f"c_{c}") for c in ("n", "lab", "bad")])
        parent = child.groupBy("host", "template").agg(F.sum("c_n").alias("p_n"), F.sum((F.col("seg") != "").cast("int")).alias("fan"))
        node = child.join(parent, ["host", "template"])
        rare = (F.col("fan") > p.fan_out) & (F.col("c_n") < p.rare_share * F.col("p_n"))
        share = lambda bad, lab: _smooth(F.col(bad), F.col(lab), F.lit(p.prior), p)
        known = (F.col("seg") != "") & ~rare & (F.col("c_lab") >= p.strength)
        node = node.withColumn("rare", rare).withColumn("bucket", F.when(known, F.floor(1000 * share("c_bad", "c_lab"))))
        node = node.join(_alike(node, share, p), ["host", "template", "bucket"], "left")
        step = F.when(F.col("seg") == "", F.lit("")).when(F.col("rare"), F.lit("/*")).when(F.col("kin") > 1, F.concat(F.lit("/*"), F.col("kind"))).otherwise(F.concat(F.lit("/"), F.col("seg")))
        node = node.select("host", "template", "seg", "c_lab", "c_bad", F.concat("template", step).alias("longer"), (F.col("seg") == "").alias("last"))
        told = node.groupBy("host", "longer", "last").agg(F.sum("c_bad").alias("t_bad"), F.sum("c_lab").alias("t_lab"))
        node = node.join(told, ["host", "longer", "last"]).select("host", "template", "seg", "longer", "t_bad", "t_lab")
        purity = F.when(F.col("longer").isNull(), F.col("purity")).otherwise(_smooth(F.col("t_bad"), F.col("t_lab"), F.col("purity"), p))
        tree = tree.join(node, ["host", "template", "seg"], "left").select("host", "shape", "n", "lab", "bad", F.coalesce("longer", "template").alias("template"), purity.alias("purity"))
        tree = materialise(tree, "url-tree")
    return tree.select("host", "shape", "template", "purity")


def judge(pages: DataFrame, url: str, rules: list[Rule], p: TreeParams = TreeParams()) -> DataFrame:
    """Adds host, path, rule, verdict, template and purity, which replace columns of these names; rule verdicts are the labelled examples."""
    made = ("host", "path", "rule", "verdict", "template", "purity")
    kept = [F.col(f"`{c}`").alias(f"_in{k}") for k, c in enumerate(pages.columns)]
    names = dict(zip((f"_in{k}" for k in range(len(kept))), pages.columns, strict=True))
    parsed = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, given = rule_columns(rules, F.col("host"), F.col("path"))
    parsed = parsed.withColumn("rule", rule).withColumn("given", given).withColumn("shape", shape(F.col("path"), p.depth))
    tree = templates(parsed.select("host", "shape", F.when(F.col("given") == "block", 1).when(F.col("given") == "allow", 0).alias("label")), p)
    learned = F.when(F.col("purity") >= p.reject_at, "block").otherwise("allow")
    out = parsed.join(tree, ["host", "shape"], "left").withColumn("verdict", F.coalesce("given", learned))
    return out.select(*[F.col(k).alias(c) for k, c in names.items() if c not in made], *made)
