"""URL rules by hashed host-suffix and path-prefix expressions, in DataFrame functions only.

A rule (host, path) fits a url whose host is the rule's host or a subdomain of
it and whose path starts with the rule's path.  Each distinct (host, path) is
expanded into the expressions ``suffix + prefix`` of the shapes that rules
have: a shape is a pair of host length and path length, so the expansion is
bounded by the number of shapes and not by the number of rules.  Expressions
meet rules in an equi-join on the first 8 hex digits of their SHA-256; the full
digest then confirms the hit, and the longest rule wins (of two rules whose
strings have the same length, block goes before allow, then the greater string).

The rule table is joined like any table: Spark broadcasts it only below its
own size threshold, and shuffles both sides otherwise.  Only distinct
(host, path) pairs are expanded, after map-side aggregation, so a hot host or
url costs one row; the way back to the rows is an equi-join that adaptive
execution may split.

Cases: a null url, or one without ``://``, has empty host and path, meets no
rule and gets the default verdict; an empty path starts with no rule path but
the empty one; repeated rows are kept; extra columns of the input are carried
along, those named like an added column are replaced; rules with a null host or
path are ignored, a rule given twice counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the digest that the equi-join looks at.
SHORT = 8


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(rules: DataFrame) -> DataFrame:
    """rules: (host, path, verdict) -> one row a rule string, with digests."""
    made = rules.where("host is not null and path is not null").select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.coalesce("verdict", F.lit(ALLOW)).alias("rule_verdict"))
    one = made.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))
    rule = F.concat("rule_host", "rule_path")
    return one.select("rule_host", "rule_path", "rule_verdict", rule.alias("rule"), F.sha2(rule, 256).alias("rule_digest"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW) -> DataFrame:
    """Add host, path, rule and verdict to every row."""
    base = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url]).withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    table = rule_table(rules)
    shapes = table.select(F.coalesce(F.collect_set(F.struct(F.length("rule_host").alias("h"), F.length("rule_path").alias("p"))), F.array())).scalar()
    distinct = base.where("host <> '' or path <> ''").select("host", "path").distinct()
    wide = distinct.select("host", "path", F.explode(shapes).alias("s"))
    suffix, prefix = F.expr("right(host, s.h)"), F.expr("left(path, s.p)")
    whole = F.expr("length(host) = s.h or (length(host) > s.h and (s.h = 0 or substring(host, length(host) - s.h, 1) = '.'))")
    expressions = wide.where(whole & F.expr("length(path) >= s.p")).select("host", "path", F.sha2(F.concat(suffix, prefix), 256).alias("digest"), suffix.alias("suffix"))
    near = table.withColumn("short", F.substring("rule_digest", 1, SHORT))
    hits = expressions.withColumn("short", F.substring("digest", 1, SHORT)).join(near, "short").where("digest = rule_digest and suffix = rule_host")
    order = F.struct(F.length("rule"), (F.col("rule_verdict") == BLOCK).cast("int"), F.col("rule"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), order).alias("won"))
    out = base.join(best, ["host", "path"], "left")
    kept = [F.col(f"`{c}`") for c in base.columns if c not in ("host", "path")]
    return out.select(*kept, "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.rule_verdict", F.lit(default)).alias("verdict"))
