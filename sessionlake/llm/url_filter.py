"""URL filters: block and allow rules on hosts and paths.

A rule such as ``example.net/en/`` names a host and the start of a path. It fits its
host and all subdomains, where the url's path starts with the rule's. Every url is
expanded into expressions, one for each suffix of its host that has as many labels as
some rule's host and each beginning of its path that is as long as some rule's path. Expressions and rules meet in an equi-join on
the first four bytes of a SHA-256, the full digest confirms, and the longest rule wins.

Urls are first reduced to distinct pairs of host and path, so that a hot url is expanded
once; only the join back sees all rows, and Spark splits a hot key there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.common import beside, lower_ascii, restored, text_of

#: The longest path a rule may have; bounds the expressions of one host suffix.
MAX_RULE_PATH = 2048

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return lower_ascii(F.regexp_extract(text_of(url), _PARTS, 1))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(text_of(url), _PARTS, 2)


def _digested(expression: Column) -> list[Column]:
    digest = F.sha2(expression, 256)
    return [digest.alias("_digest"), F.substring(digest, 1, 8).alias("_short")]


def _labels(host: str) -> Column:
    """How many parts between dots."""
    return F.length(host) - F.length(F.replace(F.col(host), F.lit("."), F.lit(""))) + 1


def _expressions(urls: DataFrame, labels: list[int], lengths: list[int]) -> DataFrame:
    known = F.filter(F.array(*map(F.lit, labels)), lambda n: n <= _labels("host"))
    suffixes = F.transform(known, lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    fitting = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))
    starts = F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))
    return (
        urls.where(F.col("host") != "")
        .select("host", "path", F.explode(suffixes).alias("_suffix"))
        .select("host", "path", "_suffix", F.explode(starts.alias("s")).alias("_start"))
        .select("host", "path", *_digested(F.concat("_suffix", "_start")))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``rule`` (host, slash, start of a path) and ``action`` (``block`` or
    ``allow``). The longest rule wins; of equally long ones that with the longer host,
    then a block. Without a rule ``rule`` is null and the verdict ``default``. A null url,
    or one without ``://``, has empty host and path and no rule. Rules that are null or
    have no slash or no host fit nothing. All rows are kept, repeated ones too. Columns of
    ``pages`` with the names of the four new ones are replaced.
    """
    rules = rules.where(F.instr("rule", "/") > 1).select(
        lower_ascii(F.substring_index("rule", "/", 1)).alias("_rule_host"),
        F.expr("substring(rule, instr(rule, '/'))").alias("_rule_path"),
        "rule",
        "action",
    )
    lengths = sorted(r[0] for r in rules.select(F.length("_rule_path")).distinct().limit(MAX_RULE_PATH + 1).collect())
    if lengths and lengths[-1] > MAX_RULE_PATH:
        raise ValueError(f"a rule's path has more than {MAX_RULE_PATH} characters")
    labels = sorted(r[0] for r in rules.select(_labels("_rule_host")).distinct().collect())
    parsed = beside(pages, host=host_of(F.col(url)), path=path_of(F.col(url)))
    made = ("host", "path", "rule", "verdict")
    if not lengths:
        return restored(parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)}), *made)
    confirmed = rules.select("rule", "action", "_rule_host", *_digested(F.concat("_rule_host", "_rule_path")))
    hits = (
        _expressions(parsed.select("host", "path").distinct(), labels, lengths)
        .join(confirmed.withColumnRenamed("_digest", "_full"), "_short")
        .where(F.col("_digest") == F.col("_full"))
    )
    precedence = F.struct(
        F.length("rule").alias("size"),
        F.length("_rule_host").alias("host_size"),
        (F.col("action") == "block").alias("blocks"),
        "rule",
        "action",
    )
    best = hits.groupBy("host", "path").agg(F.max(precedence).alias("_best"))
    judged = parsed.join(best, ["host", "path"], "left").withColumns(
        {"rule": F.col("_best.rule"), "verdict": F.coalesce("_best.action", F.lit(default))}
    )
    return restored(judged, *made)
