"""URL rules matched by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"
PREFIX_DIGITS = 8


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """What lies between ``://`` and the first ``/ ? #``, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    """The path from its ``/`` up to ``?`` or ``#``; else empty."""
    return F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def host_suffixes(name: Column) -> Column:
    """``a.b.org`` → ``a.b.org``, ``b.org``, ``org``; empty for an empty host."""
    labels = F.split(name, r"\.")
    parts = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    return F.when(name == "", F.array().cast("array<string>")).otherwise(parts)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """Judge every distinct url by ``rules(host, path, verdict)``.

    A rule fits its host and all subdomains where the url's path starts with
    the rule's path.  Each url is expanded into host suffix × path prefix (of
    the lengths that rules have); the expressions meet the rules on the first
    eight hex digits of their SHA-256, and whole digests confirm.  The longest
    rule wins; of one rule with two verdicts, ``block``.  Without a rule the
    verdict is ``default``.

    Returns ``url, host, path, rule, verdict``, one row for each distinct url,
    null included (no host, no path, no rule).  A hot host costs nothing: rows
    meet only by url, after ``distinct``; rules are repeated for no one.
    """
    digest = F.sha2("expression", 256)
    listed = (
        rules.where("host is not null and path is not null")
        .select(F.concat("host", "path").alias("expression"), F.length("path").alias("at"), "verdict")
        .groupBy("expression", "at")
        .agg(F.max("verdict").alias("verdict"))
        .select("at", digest.alias("digest"), "verdict")
        .withColumn("key", F.substring("digest", 1, PREFIX_DIGITS))
    )
    # as many as there are different path lengths among the rules: at most a url's length
    lengths = sorted(r.at for r in listed.select("at").distinct().collect())
    lengths = F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")
    seen = pages.select(F.col(url).alias("url")).distinct()
    seen = seen.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    expressions = (
        seen.select("url", F.explode(host_suffixes(F.col("host"))).alias("suffix"), "path")
        .select("url", "suffix", "path", F.explode(lengths).alias("at"))
        .where(F.length("path") >= F.col("at"))
        .select("url", F.expr("concat(suffix, left(path, at))").alias("expression"), "at")
        .withColumn("digest", digest)
        .withColumn("key", F.substring("digest", 1, PREFIX_DIGITS))
    )
    fits = expressions.join(
        listed.withColumnsRenamed({"digest": "full", "at": "rule_at"}), "key"
    ).where("digest = full and at = rule_at")
    best = fits.groupBy("url").agg(
        F.max(F.struct(F.length("expression").alias("n"), "verdict", "expression")).alias("best")
    )
    return seen.join(best, "url", "left").select(
        "url",
        "host",
        "path",
        F.col("best.expression").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
