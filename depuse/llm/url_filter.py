"""URL filters: host-suffix and path-prefix expressions against hashed rules.

A url is expanded into expressions ``host suffix + path prefix``; a rule is
one such expression plus the rest of its path.  Expressions meet rules in an
equi-join on a short hash prefix, the full digest confirms the hit, and the
longest confirmed rule decides.

Defined results:

* host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
  lower-cased; path: from there up to ``?`` or ``#``.  A null url, or one
  without ``://``, has an empty host and path and fits no rule with a host.
* A rule fits its host and all subdomains when the url's path starts with the
  rule's path (plain text prefix).  The longest rule (host plus path) wins,
  then the longer host, then ``block`` before ``allow``.
* No rule: ``default`` is the verdict and ``rule`` is null.  Repeated rows and
  null ids are judged row by row; an empty table gives no rows.  Rules with a
  null host, path or verdict are ignored.  Columns of the input whose names
  clash with the result's are replaced.
* Very long urls cost no more than the rules ask for: only suffixes of as many
  labels, and prefixes as long, as some rule has are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depuse.operators.skew import salted_join

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PREFIX_HEX = 8  # hex digits of the digest that the join uses (4 bytes)
# A rule table up to this many rows and characters is broadcast; a larger one
# is joined by shuffle with hot expressions salted.
BROADCAST_RULES = 50_000
BROADCAST_CHARS = 8_000_000
RESULT = ("host", "path", "rule", "verdict")


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substring(url, at + 3, F.length(url)), "^[^/?#]*", 0)
    return F.coalesce(F.when(at > 0, F.translate(host, _UPPER, _UPPER.lower())), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.regexp_replace(F.substring(url, at + 3, F.length(url)), "^[^/?#]*", "")
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, "^[^?#]*", 0)), F.lit(""))


def host_suffixes(host: Column, most_labels: int) -> Column:
    """The last 1, 2, ... labels of ``host``, at most ``most_labels``."""
    labels = F.split(host, r"\.")
    count = F.least(F.size(labels), F.lit(most_labels))
    return F.transform(
        F.sequence(F.lit(1), count), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")
    )


def path_prefixes(path: Column, most_chars: int) -> Column:
    """The empty prefix and all that end in ``/``, up to ``most_chars`` long."""
    count = F.least(F.length(path), F.lit(most_chars))
    ends = F.filter(F.sequence(F.lit(0), count), lambda n: (n == 0) | (F.substring(path, n, F.lit(1)) == "/"))
    return F.transform(ends, lambda n: F.substring(path, F.lit(1), n))


def _digests(expression: Column) -> list[Column]:
    digest = F.sha2(expression, 256)
    return [F.conv(F.substring(digest, 1, PREFIX_HEX), 16, 10).cast("long").alias("_prefix"), digest.alias("_digest")]


def hashed_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) keyed by their anchor expression: the host
    and the longest prefix of the path that is empty or ends in ``/``."""
    anchor = F.regexp_extract("path", "^(.*/)?", 0)
    return (
        rules.select("host", "path", "verdict").dropna().distinct()
        .withColumn("host", F.translate("host", _UPPER, _UPPER.lower()))
        .select("*", *_digests(F.concat("host", anchor)), F.length(anchor).alias("_chars"))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (see above)."""
    keyed = hashed_rules(rules)
    most = keyed.agg(
        F.count(F.lit(1)).alias("rules"),
        F.sum(F.length("host") + F.length("path")).alias("chars"),
        F.max(F.size(F.split("host", r"\."))).alias("labels"),
        F.max("_chars").alias("prefix"),
    ).first()
    parts = pages.drop(*(c for c in RESULT if c != url)).withColumns(
        {"host": host_of(F.col(url)), "path": path_of(F.col(url))}
    )
    if not most["rules"]:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    # each distinct (host, path) is expanded once, however many rows share it
    expressions = (
        parts.select("host", "path").distinct()
        .select("host", "path", F.explode(host_suffixes(F.col("host"), most["labels"])).alias("_suffix"))
        .select("host", "path", "_suffix", F.explode(path_prefixes(F.col("path"), most["prefix"])).alias("_start"))
        .select("host", "path", *_digests(F.concat("_suffix", "_start")))
    )
    named = keyed.select(
        "_prefix", F.col("_digest").alias("_rule_digest"), F.col("host").alias("_rule_host"),
        F.col("path").alias("_rule_path"), F.col("verdict").alias("_rule_verdict"),
    )
    if most["rules"] <= BROADCAST_RULES and most["chars"] <= BROADCAST_CHARS:
        met = expressions.join(F.broadcast(named), "_prefix")
    else:
        met = salted_join(expressions, named, ["_prefix"])
    fits = met.filter((F.col("_digest") == F.col("_rule_digest")) & F.col("path").startswith(F.col("_rule_path")))
    rank = F.struct(
        F.length("_rule_host") + F.length("_rule_path"), F.length("_rule_host"), F.col("_rule_verdict") == "block"
    )
    best = fits.groupBy("host", "path").agg(
        F.max_by(F.concat("_rule_host", "_rule_path"), rank).alias("rule"),
        F.max_by("_rule_verdict", rank).alias("verdict"),
    )
    return salted_join(parts, best, ["host", "path"], "left").withColumn(
        "verdict", F.coalesce("verdict", F.lit(default))
    )
