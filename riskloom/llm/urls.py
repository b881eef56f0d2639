"""URL filters by expression expansion and hash prefixes, in DataFrame operations only.

A rule is a host with an optional path, such as ``example.com/en/``. It fits a url whose host
is the rule's or a subdomain of it and whose path starts with the rule's path; the longest
fitting rule wins (ties: the longer host, then block before allow, then the text of the rule).

Each distinct (host, path) is expanded into host-suffix x path-prefix expressions; these meet
the rules by an equi-join on the first digits of their SHA-256 digests, the full digests are
compared, and precedence is one aggregate. Only suffixes and prefixes as deep as the deepest
rule are made (a fact of the rules, two numbers), which loses none.

Defined results: a null url or one without ``://`` has an empty host and path and gets the
default verdict; repeated rows are judged each; null rules are left out; columns of the input
stay, but for those named like the four added ones, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import A_Z, a_z, boxed, unboxed

ADDED = ["host", "path", "rule", "verdict"]
PREFIX_DIGITS = 8


def url_host(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), A_Z, a_z), F.lit(""))


def url_path(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rules(rules: DataFrame) -> DataFrame:
    """Host, path, expression and digest of each rule (columns ``rule``, ``verdict``)."""
    df = rules.select("rule", "verdict").where("rule IS NOT NULL AND verdict IS NOT NULL").distinct()
    host = F.translate(F.substring_index("rule", "/", 1), A_Z, a_z)
    df = df.select("rule", F.col("verdict").alias("says"), host.alias("rule_host"),
                   F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("rule_path"))
    full = F.sha2(F.concat("rule_host", "rule_path"), 256)
    return df.select("*", full.alias("rule_digest"), F.substring(full, 1, PREFIX_DIGITS).alias("short"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` plus ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``."""
    ruled = _rules(rules)
    deep = ruled.agg(
        F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(1)).alias("labels"),
        F.coalesce(F.max(F.size(F.split("rule_path", "/")) - 1), F.lit(1)).alias("slashes"),
        # lengths of rule paths that don't end at a slash: at most one number per length
        F.collect_set(F.when(~F.col("rule_path").endswith("/"), F.length("rule_path"))).alias("lengths"),
    ).first()

    df = boxed(pages)
    df = df.select("row_in", url_host(F.col(f"row_in.`{url}`")).alias("host"), url_path(F.col(f"row_in.`{url}`")).alias("path"))
    sites = df.where("host <> '' OR path <> ''").select("host", "path").distinct()

    labels = F.split("host", r"\.")
    suffixes = F.expr(f"transform(sequence(greatest(1, size(labels) - {deep.labels - 1}), size(labels)), "
                      "i -> array_join(slice(labels, i, size(labels)), '.'))")
    slashed = F.expr(f"CASE WHEN size(parts) > 1 THEN transform(sequence(1, least(size(parts) - 1, {deep.slashes})), "
                     "i -> concat(array_join(slice(parts, 1, i), '/'), '/')) ELSE cast(array() AS array<string>) END")
    open_ended = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(deep.lengths)]
    prefixes = F.array_distinct(F.concat(F.col("slashed"), F.array_compact(F.array(F.lit(""), *open_ended))))
    made = (sites.select("*", labels.alias("labels"), F.split("path", "/").alias("parts"))
            .select("host", "path", F.explode(suffixes).alias("suffix"), slashed.alias("slashed"))
            .select("host", "path", "suffix", F.explode(prefixes).alias("prefix"))
            .select("host", "path", F.sha2(F.concat("suffix", "prefix"), 256).alias("digest"))
            .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS)))
    fits = made.join(ruled, "short").where("digest = rule_digest")
    rank = F.struct(F.length("rule").alias("a"), F.length("rule_host").alias("b"),
                    (F.col("says") == "block").alias("c"), F.col("rule").alias("rule"), F.col("says").alias("says"))
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    out = (df.join(best, ["host", "path"], "left")
           .withColumn("rule", F.col("best.rule"))
           .withColumn("verdict", F.coalesce("best.says", F.lit(default))))
    return unboxed(out, ADDED)
