"""URL filter by rules of host and path, looked up through short hash prefixes.

A rule (host, path, verdict) fits a URL if the host is the rule's or a subdomain of it and the path starts with
the rule's. Each URL is expanded into its expressions, host suffix + path prefix, which hold every rule that can
fit; an expression's SHA-256 digest is looked up by its first ``PREFIX`` hex digits in an equality join,
then the whole digests are compared. Of several rules the longest (host and path together, then host) wins;
of equal ones with both verdicts, block.

Only what the rules can match is expanded: host suffixes of as many labels as the longest rule host,
path prefixes that end at a slash up to the deepest rule path, and the lengths of rule paths that end elsewhere.
So an expansion stays small for URLs of any length, and no rule is missed. Different (host, path) pairs are
expanded once, however many rows hold them; no hint forces a broadcast, so rules of any number are joined, and
what they decide comes back to the rows by a join that adaptive execution may split where one URL is very common.

Host and path: the host is what follows the first ``://``, up to ``/``, ``?``, ``#`` or the end, A-Z in lower
case; the path follows up to ``?``, ``#`` or the end. Odd rows: a null URL or one without ``://`` has both empty and fits no
rule; a URL without rule gets the verdict ``otherwise``. A rule without host fits nothing, a null path is empty and
fits every path, a rule without verdict is left out. Rows repeat as in the input; columns of ``df`` that are called like
a result are replaced, others pass through. Empty rules give every URL the verdict ``otherwise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = 8
BLOCK, ALLOW = "block", "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda n: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", n), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _clean(rules: DataFrame) -> DataFrame:
    """One row per host and path, with its digest."""
    host = F.translate(F.col("host"), _UPPER, _LOWER)
    return (
        rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .where((F.length("host") > 0) & F.col("verdict").isNotNull())
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # of allow and block, block
        .select("host", "path", "verdict", _digest(F.col("host"), F.col("path")).alias("digest"))
    )


def expressions(host: Column, path: Column, labels: int, depth: int, lengths: list[int]) -> Column:
    """Structs (host, path) that rules of these sizes can equal; each once."""
    parts = F.size(F.split(host, r"\.", -1))
    # the last label, the last two ... ; a suffix that is the whole host comes once
    hosts = F.transform(F.sequence(F.lit(1), F.least(parts, F.lit(labels))), lambda n: F.call_function("substring_index", host, F.lit("."), -n))
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    deepest = F.least(slashes, F.lit(depth))
    none = F.array().cast("array<string>")
    ended = F.when(deepest > 0, F.transform(F.sequence(F.lit(1), deepest), lambda n: F.concat(
        F.call_function("substring_index", path, F.lit("/"), n), F.lit("/")))).otherwise(none)
    cut = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(path)),
                      lambda n: F.substring(path, F.lit(1), n))
    paths = F.array_distinct(F.concat(ended, cut))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(h.alias("host"), p.alias("path")))))


def judge(df: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = ALLOW, prefix: int = PREFIX) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` (host and path, null without one) and ``verdict``."""
    rules = _clean(rules)
    ends = F.col("path").endswith("/")
    sizes = rules.agg(
        F.coalesce(F.max(F.size(F.split("host", r"\.", -1))), F.lit(0)).alias("labels"),
        F.coalesce(F.max(F.when(ends, F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))))), F.lit(0)).alias("depth"),
        F.sort_array(F.collect_set(F.when(~ends, F.length("path")))).alias("lengths")).first()
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host.alias("host"), path.alias("path"))
    if not sizes["labels"]:
        decided = rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
        return decided.select("row.*", "host", "path", "rule", "verdict")
    looked_up = (
        rows.where(F.length("host") > 0).select("host", "path").distinct()
        .withColumn("e", F.explode(expressions(F.col("host"), F.col("path"), sizes["labels"], sizes["depth"], sizes["lengths"])))
        .withColumn("digest", _digest(F.col("e.host"), F.col("e.path")))
        .withColumn("short", F.substring("digest", 1, prefix))
    )
    known = rules.select(F.substring("digest", 1, prefix).alias("short"), F.col("digest").alias("full"), "verdict")
    rule = F.concat("e.host", "e.path")
    found = looked_up.join(known, "short").where(F.col("digest") == F.col("full")).groupBy("host", "path").agg(
        F.max(F.struct(F.length(rule).alias("n"), F.length("e.host").alias("h"), rule.alias("rule"), "verdict")).alias("best"))
    decided = rows.join(found, ["host", "path"], "left")
    return decided.select("row.*", "host", "path", F.col("best.rule").alias("rule"),
                          F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
