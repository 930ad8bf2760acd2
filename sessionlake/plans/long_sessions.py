"""Which sessions are long, and what share of users had one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from sessionlake.operators import quality
from sessionlake.operators.quantiles import at_ranks, discrete_rank, quantile_of
from sessionlake.operators.sampling import first_n_per_user
from sessionlake.operators.sessions import DEFAULT_GAP, session_summary
from sessionlake.session import freeze
from sessionlake.sources import readers, sinks

DEFAULT_QUANTILE = 0.9
CALIBRATION_TOLERANCE = 0.001


def long_threshold(
    sessions: DataFrame, quantile: float = DEFAULT_QUANTILE, error: float = 0.0
) -> DataFrame:
    """One row, long_session_threshold: the duration from which a session is long."""
    return quantile_of(sessions, "session_duration", quantile, error, "long_session_threshold", whole=True)


def split_at(sessions: DataFrame, threshold: Column | float) -> DataFrame:
    """One row: sessions below the threshold and from it on. Null durations are neither."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    duration = F.col("session_duration")
    return sessions.agg(
        F.count_if(duration < limit).alias("total_short_sessions"),
        F.count_if(duration >= limit).alias("total_long_sessions"),
    )


def long_sessions(sessions: DataFrame, threshold: Column | float) -> DataFrame:
    """The sessions from the threshold on, the threshold included."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return sessions.where(F.col("session_duration") >= limit)


def long_session_users(
    sessions: DataFrame,
    quantile: float = DEFAULT_QUANTILE,
    user: str = "userid",
    error: float = 0.0,
) -> DataFrame:
    """The users with at least one long session.

    The threshold enters as a scalar subquery of the same plan, and the sessions
    are still partitioned by user, so that finding the distinct ones needs no
    further shuffle.
    """
    threshold = long_threshold(sessions, quantile, error).scalar()
    return long_sessions(sessions, threshold).select(user).distinct()


def _result(counts: DataFrame) -> DataFrame:
    """The result row, its shares computed from the counts."""
    short, long = F.col("total_short_sessions"), F.col("total_long_sessions")
    return counts.select(
        "users_with_long_session_count",
        "total_users",
        F.try_divide("users_with_long_session_count", "total_users").alias(
            "proportion_with_long_sessions"
        ),
        "long_session_threshold",
        "total_short_sessions",
        "total_long_sessions",
        F.try_divide(long, short + long).alias("long_session_ratio"),
    )


def summarize_at(
    sessions: DataFrame, threshold: Column | float, user: str = "userid"
) -> DataFrame:
    """The whole result, one row, for a threshold found in any other way.

    Such as a known one, or ``interpolated_quantile(...).scalar()``.
    """
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    duration = F.col("session_duration")
    users = sessions.groupBy(user).agg(
        F.max(duration).alias("longest"),
        F.count_if(duration < limit).alias("short"),
        F.count_if(duration >= limit).alias("long"),
    )
    counts = users.agg(
        F.count_if(F.col("longest") >= limit).alias("users_with_long_session_count"),
        F.count("*").alias("total_users"),
        F.coalesce(F.sum("short"), F.lit(0)).alias("total_short_sessions"),
        F.coalesce(F.sum("long"), F.lit(0)).alias("total_long_sessions"),
    )
    return _result(counts.withColumn("long_session_threshold", limit.cast("double")))


def summarize_sessions(
    sessions: DataFrame,
    quantile: float = DEFAULT_QUANTILE,
    user: str = "userid",
    error: float = 0.0,
) -> DataFrame:
    """The whole result, one row, in a single pass over the sessions.

    Every session counts once in a histogram of durations, and every user once, at
    the duration of the longest session. The threshold's row in the cumulative
    histogram then gives all the counts: sessions below it are short, and users
    counted below it have no long session. Always one row, also for no sessions
    (zero counts, null threshold and shares).

    An ``error`` above 0 takes the threshold from a sketch with that rank error.
    """
    if error:
        return summarize_at(sessions, long_threshold(sessions, quantile, error).scalar(), user)
    longest_first = Window.partitionBy(user).orderBy(F.col("session_duration").desc_nulls_last())
    counted = (
        sessions.withColumn("longest", F.row_number().over(longest_first) == 1)
        .groupBy(F.col("session_duration").alias("value"))
        .agg(F.count("session_duration").alias("n"), F.count_if("longest").alias("users"))
    )
    # One row or, for no sessions at all, none: the aggregate makes that one row.
    cut = at_ranks(counted, discrete_rank(quantile), counters=("n", "users"), whole=True)
    has_long = F.col("n_total") > 0
    return _result(
        cut.agg(
            F.max(F.when(has_long, F.col("users_total") - F.col("users_below"))).alias("with_long"),
            F.max("users_total").alias("users"),
            F.max("value").cast("double").alias("long_session_threshold"),
            F.max("n_below").alias("short"),
            F.max(F.col("n_total") - F.col("n_below")).alias("long"),
        ).select(
            F.coalesce("with_long", F.lit(0)).alias("users_with_long_session_count"),
            F.coalesce("users", F.lit(0)).alias("total_users"),
            "long_session_threshold",
            F.coalesce("short", F.lit(0)).alias("total_short_sessions"),
            F.coalesce("long", F.lit(0)).alias("total_long_sessions"),
        )
    )


def session_split(
    sessions: DataFrame, quantile: float = DEFAULT_QUANTILE, user: str = "userid"
) -> DataFrame:
    """One row: how many sessions are short and long, and their shares."""
    short, long = F.col("total_short_sessions"), F.col("total_long_sessions")
    return summarize_sessions(sessions, quantile, user).select(
        "total_short_sessions",
        "total_long_sessions",
        F.try_divide(short, short + long).alias("short_session_ratio"),
        "long_session_ratio",
    )


def calibration_report(
    sessions: DataFrame,
    quantile: float = DEFAULT_QUANTILE,
    user: str = "userid",
    tolerance: float = CALIBRATION_TOLERANCE,
) -> DataFrame:
    """Is the share of short sessions within ``tolerance`` of the quantile?

    It is not where few sessions, or many of equal duration, leave no such cut.
    """
    off = F.abs(F.col("short_session_ratio") - F.lit(float(quantile)))
    return session_split(sessions, quantile, user).select(
        "short_session_ratio",
        "long_session_ratio",
        off.alias("deviation"),
        F.coalesce(off < tolerance, F.lit(False)).alias("within_tolerance"),
    )


def long_session_share(
    plays: DataFrame,
    gap: float = DEFAULT_GAP,
    quantile: float = DEFAULT_QUANTILE,
    user: str = "userid",
    ts: str = "timestamp",
    drop_null_ts: bool = False,
    error: float = 0.0,
) -> DataFrame:
    """From plays to the one-row answer, as a single lazy plan."""
    sessions = session_summary(plays, user, ts, gap, drop_null_ts)
    return summarize_sessions(sessions, quantile, user, error)


def _check_columns(raw: DataFrame) -> None:
    if [c for c in raw.columns if c != readers.MALFORMED] != readers.PLAY_COLUMNS:
        raise quality.QualityError(f"unexpected columns {raw.columns}")


def _observed(raw: DataFrame) -> tuple[DataFrame, Observation]:
    """``raw`` without the column of malformed lines, which are counted as the rows go by."""
    seen = Observation()
    malformed = F.count(readers.MALFORMED) if readers.MALFORMED in raw.columns else F.count_if(F.lit(False))
    return raw.observe(seen, malformed.alias("malformed")).drop(readers.MALFORMED), seen


def _check_lines(seen: Observation) -> None:
    if seen.get["malformed"]:
        raise quality.QualityError(f"{seen.get['malformed']} lines have too few or too many fields")


def prepare_plays(raw: DataFrame, profiles: DataFrame, strict: bool = True) -> DataFrame:
    """The play log with parsed times; ``strict`` checks columns, lines and users.

    The strict one reads the log once: the parsed plays are written to the shared folder when this
    is called, malformed lines (of a log read with :data:`readers.MALFORMED`) are counted on the
    way, and the users are those of what was written.
    """
    if not strict:
        return readers.parse_plays(raw.drop(readers.MALFORMED))
    _check_columns(raw)
    watched, seen = _observed(raw)
    plays = freeze(readers.parse_plays(watched))
    _check_lines(seen)
    quality.enforce(quality.user_coverage(plays, profiles), "counts_match")
    return plays


def run_job(
    spark: SparkSession,
    play_log: str,
    profiles: str,
    result: str,
    gap: float = DEFAULT_GAP,
    quantile: float = DEFAULT_QUANTILE,
    strict: bool = True,
    quote: str = '"',
    drop_null_ts: bool = False,
    error: float = 0.0,
) -> DataFrame:
    """Reads the two files, checks and summarizes them, and writes the result row.

    Returns the written row, read back. ``strict`` counts lines with too few or too many
    fields while the log is read, and on the finished row, before it replaces an earlier
    result, checks that there were none, the number of users against the profiles, and the
    calibration. The log is read once.
    """
    options = {"malformed": readers.MALFORMED} if strict else {}
    raw = readers.load(spark, "track_sessions", play_log, quote=quote, **options)
    users = readers.load(spark, "userid_profiles", profiles, quote=quote)
    if strict:
        _check_columns(raw)
        raw, seen = _observed(raw)
    summary = long_session_share(
        readers.parse_plays(raw), gap, quantile, drop_null_ts=drop_null_ts, error=error
    )
    if strict:
        summary = freeze(summary)
        _check_lines(seen)
        known = quality.distinct_users(users, readers.PROFILE_ID).scalar()
        off = F.abs(1 - F.col("long_session_ratio") - F.lit(float(quantile)))
        checked = summary.withColumn("counts_match", F.col("total_users") == known).withColumn(
            "within_tolerance", F.coalesce(off < CALIBRATION_TOLERANCE, F.lit(False))
        )
        quality.enforce(checked, "counts_match", "within_tolerance")
    return sinks.write_summary(summary, result)


def sample_job(
    spark: SparkSession,
    play_log: str,
    result: str,
    n: int = 30,
    quote: str = '"',
    tie_breakers: tuple[str, ...] = (),
) -> DataFrame:
    """Writes each user's first ``n`` plays as a headed TSV and returns it, read back.

    Which of several plays at the same time are kept is open unless ``tie_breakers`` name
    columns for it.
    """
    plays = readers.read_positional(spark, play_log, quote=quote)
    return sinks.write_sample(first_n_per_user(plays, n, tie_breakers=tie_breakers), result)
