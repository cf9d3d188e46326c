"""URL filters: rules, and for urls that no rule decides a tree of path templates for each host.

A path is a list of segments. Numbers, hexadecimal ids and dates become wildcards at once; then, level by level, a node with many
different children that have few pages each gets one wildcard child. Sibling templates (same host, same path but for its first
segment) whose labelled share of blocked pages doesn't differ significantly from their pool's are merged. A
template is rejected if its blocked share among labelled pages, smoothed towards the host's and the corpus's, is
``reject_at`` or more.

Labels are pages with a known verdict; here, those that a rule decides.

Defined cases: a null url, or one without ``://``, has an empty host and path; it fits no rule. An empty path has the template
``/``. Repeated rows count as pages and get the same verdict. Without labels nothing is rejected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MANY, FEW = 20, 3.0
"""A node with MANY different children or more, and fewer than FEW pages for each, gets a wildcard."""
DEPTH = 8
"""Levels that are generalised; segments further down stay in one piece, and become a wildcard together."""
SMOOTHING = 5.0
SIGNIFICANT = 1.96
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> F.Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: str) -> F.Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(rules: Sequence[tuple[str, str]], host: str = "host", path: str = "path") -> F.Column:
    """Struct (verdict, rule) of the longest fitting rule; of equally long ones the first; else null."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        own = (F.col(host) == name) | F.endswith(F.col(host), F.lit("." + name))
        fits.append(F.when(own & F.startswith(F.col(path), F.lit(slash + rest)), F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<verdict:string,rule:string>")


def segments(path: str) -> F.Column:
    """The path's segments, with numbers and ids as wildcards (an extension stays)."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.regexp_replace(s, r"(?i)^(?:[0-9]+|[0-9a-f]{8,}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9]{4}-[0-9]{2}-[0-9]{2})(\.[a-z0-9]{1,5})?$", "*$1"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, shape, template): for each host and list of segments of ``pages`` (host, shape) the generalised path."""
    shapes = pages.groupBy("host", "shape").agg(F.count("*").alias("pages"))
    now = shapes.withColumn("template", F.lit(""))
    deepest = min(DEPTH, shapes.agg(F.max(F.size("shape"))).first()[0] or 0)
    for level in range(deepest):
        part = F.when(F.size("shape") > level, F.when(F.lit(level == DEPTH - 1), F.array_join(F.slice("shape", level + 1, F.greatest(F.size("shape"), F.lit(1))), "/")).otherwise(F.get("shape", F.lit(level))))
        now = now.withColumn("part", part)
        kids = now.where(F.col("part").isNotNull()).groupBy("host", "template", "part").agg(F.sum("pages").alias("n"))
        nodes = kids.groupBy("host", "template").agg(F.count("*").alias("kids"), F.sum("n").alias("n"))
        wild = nodes.where((F.col("kids") >= MANY) & (F.col("n") < FEW * F.col("kids"))).select("host", "template", F.lit(True).alias("wild"))
        step = F.when(F.col("part").isNull(), "").when(F.col("wild"), "/*").otherwise(F.concat(F.lit("/"), "part"))
        now = now.join(wild, ["host", "template"], "left").select("host", "shape", "pages", F.concat("template", step).alias("template"))
    return now.select("host", "shape", F.when(F.col("template") == "", "/").otherwise(F.col("template")).alias("template"))


def purity(labelled: DataFrame) -> DataFrame:
    """(host, template, purity) from (host, template, blocked, known), counts of each template's labelled pages."""
    pool = F.regexp_replace("template", r"^/[^/]*", "/+")
    own = labelled.withColumn("pool", pool)
    pools = own.groupBy("host", "pool").agg(F.sum("blocked").alias("pb"), F.sum("known").alias("pn"))
    near = own.join(pools, ["host", "pool"])
    share = F.col("pb") / F.greatest("pn", F.lit(1))
    far = F.abs(F.col("blocked") - F.col("known") * share) > SIGNIFICANT * F.sqrt(F.col("known") * share * (1 - share)) + 1e-9
    near = near.withColumn("apart", far)
    merged = near.where(~F.col("apart")).groupBy("host", "pool").agg(F.sum("blocked").alias("mb"), F.sum("known").alias("mn"))
    hosts = labelled.groupBy("host").agg(F.sum("blocked").alias("hb"), F.sum("known").alias("hn"))
    totals = labelled.agg(F.coalesce(F.sum("blocked"), F.lit(0)).alias("tb"), F.coalesce(F.sum("known"), F.lit(0)).alias("tn"))
    used = near.join(merged, ["host", "pool"], "left").join(hosts, "host").join(F.broadcast(totals))  # one row
    b = F.when(F.col("apart"), F.col("blocked")).otherwise(F.col("mb"))
    n = F.when(F.col("apart"), F.col("known")).otherwise(F.col("mn"))
    everywhere = F.col("tb") / F.greatest("tn", F.lit(1))
    at_host = (F.col("hb") + SMOOTHING * everywhere) / (F.col("hn") + SMOOTHING)
    return used.select("host", "template", ((b + SMOOTHING * at_host) / (n + SMOOTHING)).alias("purity"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], reject_at: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, template, purity and verdict."""
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "template", "purity", "shape")]
    placed = pages.select(*(F.col(f"`{c}`") for c in names), host_of("url").alias("host"), path_of("url").alias("path"))
    placed = placed.withColumn("_rule", fitting_rule(rules)).withColumn("shape", segments("path"))
    made = templates(placed.select("host", "shape"))
    counts = placed.groupBy("host", "shape").agg(F.count(F.when(F.col("_rule.verdict") == "block", 1)).alias("blocked"), F.count("_rule.verdict").alias("known"))
    judged = purity(counts.join(made, ["host", "shape"]).groupBy("host", "template").agg(F.sum("blocked").alias("blocked"), F.sum("known").alias("known")))
    found = made.join(judged, ["host", "template"])
    own = F.when(F.col("purity") >= reject_at, "block").otherwise("allow")
    return placed.join(found, ["host", "shape"], "left").select(*(f"`{c}`" for c in names), "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", own).alias("verdict"), "template", "purity")
