"""Judge urls by rules on a host and the start of a path.

A url is expanded into expressions, host suffix plus path prefix. Expressions meet rules by an
equi-join on the first characters of their digest; full digests confirm, the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litvec.runtime import small_side, stage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHORT = 8  # hex digits of a digest that the join compares
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def prepare_rules(rules: DataFrame) -> DataFrame:
    """``rules`` (host, path, verdict) with their digests.

    Rules without a host or a verdict are left out, a null path counts as empty, and of equal
    rules with both verdicts ``block`` stays.
    """
    return (
        rules.where("host <> '' and verdict is not null")
        .select(
            F.translate("host", UPPER, UPPER.lower()).alias("rule_host"),
            F.coalesce("path", F.lit("")).alias("rule_path"),
            "verdict",
        )
        .groupBy("rule_host", "rule_path")
        .agg(F.max("verdict").alias("rule_verdict"))
        .select(
            F.concat("rule_host", "rule_path").alias("rule_text"),
            F.size(F.split("rule_host", r"\.")).alias("labels"),
            F.length("rule_path").alias("chars"),
            F.length("rule_host").alias("host_chars"),
            "rule_verdict",
            F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256).alias("rule_digest"),
        )
        .withColumn("rule_short", F.substring("rule_digest", 1, SHORT))
    )


def _expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Digests of a url's expressions, one for each shape of a rule that the url is long enough for."""
    labels = F.split(host, r"\.")

    def one(labels_wanted: int, chars: int) -> Column:
        suffix = F.array_join(F.slice(labels, -labels_wanted, labels_wanted), ".")
        fits = (F.size(labels) >= labels_wanted) & (F.length(path) >= chars)
        return F.when(fits, F.sha2(F.concat_ws("\n", suffix, F.substring(path, 1, chars)), 256))

    return F.array_compact(F.array(*[one(*shape) for shape in shapes]))


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` and ``verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's path. The longest
    rule text wins, then the longer host. Without a rule the verdict is ``default`` and the rule
    null; a null url, or one without ``://``, has an empty host and path and so fits none. Equal
    rows stay as often as they come. Columns of the caller that have one of the four new names
    are replaced; an empty table gives an empty one, and no rules give ``default`` everywhere.

    Urls of one host are not gathered anywhere: the expressions of distinct urls meet the rules,
    which are broadcast only if counted small, and only the matches are aggregated by url.
    """
    rules = small_side(prepare_rules(rules), "rules")
    # The distinct (labels, characters) of rules: at most 127 labels by the length of a host name.
    shapes = sorted((r.labels, r.chars) for r in rules.select("labels", "chars").distinct().collect())
    host, path = host_of(F.col(url)), path_of(F.col(url))
    parts = df.select(F.struct("*").alias("own"), host.alias("host"), path.alias("path"))
    mine = ("host", "path", "rule", "verdict")
    own = [F.col("own").getField(c).alias(c) for c in df.columns if c.lower() not in mine]
    if not shapes:
        none = F.lit(None).cast("string")
        return parts.select(*own, "host", "path", none.alias("rule"), F.lit(default).alias("verdict"))
    matches = (
        parts.select(F.col("host").alias("m_host"), F.col("path").alias("m_path"))
        .distinct()
        .select("m_host", "m_path", F.explode(_expressions(F.col("m_host"), F.col("m_path"), shapes)).alias("digest"))
        .join(rules, F.substring("digest", 1, SHORT) == F.col("rule_short"))
        .where("digest = rule_digest")
        .groupBy("m_host", "m_path")
        .agg(F.max(F.struct(F.length("rule_text"), "host_chars", "rule_text", "rule_verdict")).alias("best"))
    )
    matches = stage(matches, "matches")  # so that Spark can split a url that many rows share
    on = (F.col("host") == F.col("m_host")) & (F.col("path") == F.col("m_path"))
    return parts.join(matches, on, "left").select(
        *own,
        "host",
        "path",
        F.col("best.rule_text").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )
