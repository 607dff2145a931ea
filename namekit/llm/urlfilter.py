"""URL rules by hashed host-suffix and path-prefix expressions, in DataFrame operations only.

Every distinct (host, path) is expanded into the expressions that a rule could have: a suffix of
whole host labels and a prefix of the path. Only those numbers of labels and lengths of prefixes
occur that some rule has, so an endless host or path makes no more expressions than the rules allow.
Expressions meet the rules in an equi-join on the first 32 bits of their digests; a pair counts only
if the full digests agree, and of a url's rules the longest decides.

Defined results: the host stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with
A-Z lower-cased, the path from there up to ``?``, ``#`` or the end; a null url, or one without
``://``, has neither. A rule fits its host and all subdomains if the path starts with the rule's.
The longest rule (host and path together) wins, then the longer host, then block over allow. A url
without a rule is allowed. Null hosts, paths or verdicts in the rules are ignored. Equal rows give
equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_VERDICT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), r"^([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\x00"), path).cast("binary"), 256)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every row. ``rules``: host, path (with its leading
    slash), verdict (allow or block). The sets of label counts and path lengths are bounded by the
    longest rule."""
    rules = (rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null")
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))  # block over allow
    labels = F.size(F.split("host", r"\."))
    shapes = rules.select(labels.alias("n"), F.length("path").alias("m")).distinct().orderBy("n", "m").collect()
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    if not shapes:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
                           F.lit(DEFAULT_VERDICT).alias("verdict"))
    # expressions of every distinct place; a place without so many labels or characters has fewer
    by_labels = F.size(F.split("host", r"\."))
    expressions = F.filter(
        F.array(*[F.when((by_labels >= s.n) & (F.length("path") >= s.m),
                         F.struct(F.substring_index("host", ".", -s.n).alias("h"),
                                  F.substring("path", 1, s.m).alias("p"))) for s in shapes]),
        lambda x: x.isNotNull())
    full = _digest(F.col("e.h"), F.col("e.p"))
    expanded = (rows.select("host", "path").distinct()
                .select("host", "path", F.explode(expressions).alias("e"))
                .select("host", "path", full.alias("full"), F.substring(full, 1, 8).alias("short")))
    table = rules.select(_digest(F.col("host"), F.col("path")).alias("rule_full"),
                         F.concat("host", "path").alias("rule"), F.length("host").alias("host_chars"), "verdict")
    table = table.withColumn("short", F.substring("rule_full", 1, 8))
    order = F.struct(F.length("rule"), "host_chars", "verdict", "rule")
    best = (expanded.join(table, "short").where(F.col("full") == F.col("rule_full"))
            .groupBy("host", "path").agg(F.max(order).alias("best"))
            .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict")))
    return (rows.join(best, ["host", "path"], "left")
            .select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(DEFAULT_VERDICT)).alias("verdict")))
