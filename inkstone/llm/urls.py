"""URL rules by a sort-merge range join: keys of reversed hosts, rules as intervals of keys, one sorted sweep.

A rule (host, path) covers the keys that begin with `reversed host + path`, an interval. Intervals nest or are
disjoint, so a sweep over the sorted keys needs a stack only: a rule's opening row puts it on top and its closing row
puts back the rule that it was nested in. The rule for a key is what is on top there. A url has one key for its host
and one for each domain above it, as rules hold for subdomains.

Edge cases: a null url, or one without `://`, has an empty host and path and the default verdict. No rule holds
for a url with an empty path, not even one with an empty path itself. Rules that repeat a
host and path count once, as block if any of them blocks. Repeated rows stay; extra columns pass through; null ids are
ids like others. Of rules from different domains above a host the one with the longest text wins, then the longer host.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

RULES_SCHEMA = "host string, path string, verdict string"
#: The rules of the registered query.
EXAMPLE_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """Host, in small letters, and path of a url; both empty if it is null or has no `://`."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    return _lower(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1)), F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _key(host: Column, path: Column) -> Column:
    """Labels from the top domain down, each with a dot, then the path; as bytes, which sort alike everywhere."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."), path).cast("binary")


def classify(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, url: str = "url", default: str = "allow", salts: int = 128) -> DataFrame:
    """`pages` with host, path, rule (host + path of the rule that holds, else null) and verdict.

    The sweep runs in groups of one domain and one of `salts` shares of its urls; each share gets the domain's rules,
    so a domain with most of all rows is spread over that many groups. Urls of domains without rules don't enter it.
    """
    spark = pages.sparkSession
    rules = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), RULES_SCHEMA)
    rules = rules.select(_lower("host").alias("domain"), F.col("path"), "verdict").where("domain is not null and path is not null")
    rules = rules.groupBy("domain", "path").agg(F.when(F.bool_or(F.col("verdict") == "block"), "block").otherwise("allow").alias("verdict"))
    top = F.struct(F.length(F.concat("domain", "path")).alias("size"), F.length("domain").alias("host_size"), F.concat("domain", "path").alias("rule"), "verdict")
    rules = rules.select("domain", "path", _key(F.col("domain"), F.col("path")).alias("key"), top.alias("top"))

    # The rule that a rule is nested in: the longest of its own proper prefixes that is a rule of the same domain.
    prefixes = rules.select("domain", F.col("path").alias("inner"), F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n")).where(F.col("n") < F.length("inner"))
    prefixes = prefixes.select("domain", "inner", F.expr("substring(inner, 1, n)").alias("path")).join(rules.select("domain", "path", "top"), ["domain", "path"])
    below = prefixes.groupBy("domain", F.col("inner").alias("path")).agg(F.max("top").alias("below"))
    opens = rules.select("domain", "key", F.lit(0).alias("kind"), F.struct(F.lit(True).alias("set"), "top").alias("event"))
    closes = rules.join(below, ["domain", "path"], "left").select("domain", F.concat("key", F.lit(b"\xff")).alias("key"), F.lit(0).alias("kind"), F.struct(F.lit(True).alias("set"), F.col("below").alias("top")).alias("event"))
    events = opens.union(closes).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("_u_host", F.lit("")).withColumn("_u_path", F.lit(""))

    pages = pages.withColumns(dict(zip(("_u_host", "_u_path"), parts(F.col(url)), strict=True)))
    urls = pages.select("_u_host", "_u_path").where("_u_host <> '' and _u_path <> ''").distinct()
    labels = F.split("_u_host", r"\.")
    points = urls.withColumn("domain", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    points = points.join(rules.select("domain").distinct(), "domain", "left_semi")
    points = points.select("domain", _key(F.col("domain"), F.col("_u_path")).alias("key"), F.lit(1).alias("kind"), F.lit(None).cast(events.schema["event"].dataType).alias("event"), F.pmod(F.xxhash64("_u_host", "_u_path"), F.lit(salts)).cast("int").alias("salt"), "_u_host", "_u_path")
    sweep = Window.partitionBy("domain", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.unionByName(points).withColumn("top", F.last("event", ignorenulls=True).over(sweep)["top"]).where("kind = 1 and top is not null")
    found = swept.groupBy("_u_host", "_u_path").agg(F.max("top").alias("_u_top"))
    out = pages.join(found, ["_u_host", "_u_path"], "left")
    kept = [c for c in pages.columns if c not in ("_u_host", "_u_path", "host", "path", "rule", "verdict")]
    return out.select(*kept, F.col("_u_host").alias("host"), F.col("_u_path").alias("path"), F.col("_u_top.rule").alias("rule"), F.coalesce("_u_top.verdict", F.lit(default)).alias("verdict"))
