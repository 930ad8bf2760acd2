"""Data checks. Each returns a report of one row; ``enforce`` turns one into an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.times import parse_play_time
from sessionlake.sources.readers import MALFORMED


class QualityError(AssertionError):
    """A check did not hold in strict mode."""


def enforce(report: DataFrame, *flags: str) -> None:
    """Raises :class:`QualityError` with the report's row unless all ``flags`` are true."""
    row = report.first()
    for flag in flags:
        if row is None or not row[flag]:
            raise QualityError(f"{flag} does not hold: {row.asDict() if row else 'empty report'}")


def schema_report(df: DataFrame, expected: list[str], ts: str = "timestamp") -> DataFrame:
    """Are the columns the expected ones, in order, and is ``ts`` a timestamp?

    Also counts the rows and those without a time. A missing ``ts`` is reported,
    not raised.
    """
    kinds = dict(df.dtypes)
    times = F.count(ts) if ts in kinds else F.lit(0)
    return df.agg(
        F.lit(df.columns == list(expected)).alias("columns_match"),
        F.lit(kinds.get(ts, "").startswith("timestamp")).alias("time_is_timestamp"),
        F.count("*").alias("total_rows"),
        (F.count("*") - times).alias("rows_without_time"),
    )


def rejected_rows(raw: DataFrame, text: str = "timestamp") -> DataFrame:
    """How many time texts are missing, and how many cannot be parsed."""
    missing = F.col(text).isNull()
    unparseable = ~missing & parse_play_time(F.col(text)).isNull()
    return raw.agg(
        F.count("*").alias("total_rows"),
        F.count_if(missing).alias("missing"),
        F.count_if(unparseable).alias("unparseable"),
    )


def malformed_lines(log: DataFrame, text: str = MALFORMED, user: str = "userid") -> DataFrame:
    """How many lines of a log, read with that column, have too few or too many fields, or no user."""
    return log.agg(
        F.count("*").alias("total_rows"),
        F.count(text).alias("malformed"),
        F.count_if(F.col(user).isNull()).alias("rows_without_user"),
    )


def _ids_by_side(fact: DataFrame, user: str, dimension: DataFrame, key: str) -> DataFrame:
    """One row per distinct id of either side; a null id is an id.

    Each side is reduced to its distinct ids before the shuffle, and grouping
    needs no join, so repeated ids cost nothing.
    """
    sides = fact.select(
        F.col(user).alias("id"), F.lit(True).alias("in_fact"), F.lit(False).alias("in_dimension")
    ).unionByName(
        dimension.select(
            F.col(key).alias("id"),
            F.lit(False).alias("in_fact"),
            F.lit(True).alias("in_dimension"),
        )
    )
    return sides.groupBy("id").agg(
        F.max("in_fact").alias("in_fact"), F.max("in_dimension").alias("in_dimension")
    )


def user_coverage(
    fact: DataFrame, dimension: DataFrame, user: str = "userid", key: str = "#id"
) -> DataFrame:
    """Do both sides have the same number of users, and the same users?

    ``counts_match`` compares the numbers only. Equal numbers can hide different
    users, hence ``fact_only``, ``dimension_only`` and ``sets_match``.
    """
    fact_only = F.count_if(F.col("in_fact") & ~F.col("in_dimension"))
    dimension_only = F.count_if(F.col("in_dimension") & ~F.col("in_fact"))
    return (
        _ids_by_side(fact, user, dimension, key)
        .agg(
            F.count_if("in_fact").alias("fact_users"),
            F.count_if("in_dimension").alias("dimension_users"),
            fact_only.alias("fact_only"),
            dimension_only.alias("dimension_only"),
        )
        .withColumn("counts_match", F.col("fact_users") == F.col("dimension_users"))
        .withColumn("sets_match", (F.col("fact_only") == 0) & (F.col("dimension_only") == 0))
    )


def orphans(
    fact: DataFrame, dimension: DataFrame, user: str = "userid", key: str = "#id"
) -> DataFrame:
    """The ids that only one side has: id, side."""
    return (
        _ids_by_side(fact, user, dimension, key)
        .where(F.col("in_fact") != F.col("in_dimension"))
        .select("id", F.when(F.col("in_fact"), "fact").otherwise("dimension").alias("side"))
    )


def distinct_users(plays: DataFrame, user: str = "userid") -> DataFrame:
    """One row: the number of distinct users, a null user included."""
    return plays.select(user).distinct().agg(F.count("*").alias("users"))


def expected_cardinality(plays: DataFrame, expected: int, user: str = "userid") -> DataFrame:
    """Is the number of distinct users the known one?"""
    return distinct_users(plays, user).select(
        "users",
        F.lit(expected).cast("bigint").alias("expected"),
        (F.col("users") == expected).alias("matches"),
    )
