"""The operators as queries over the test tables, each with SQL for a second engine.

``events`` plays the part of the play log (users ``user_id``, times ``ts``), and
``orders`` that of a log with tied times. The SQL spells every query out with plain
windows over whole users, so it shares no method with the Spark side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.functions.times import epoch_second
from sessionlake.operators import quality
from sessionlake.operators.numbering import number_globally, number_sessions
from sessionlake.operators.quantiles import exact_quantile, interpolated_quantile
from sessionlake.operators.sampling import first_n_per_user
from sessionlake.operators.sessions import number_within_user, session_summary, sessionize
from sessionlake.plans import long_sessions as plans
from sessionlake.session import fresh_path
from sessionlake.sources import readers, sinks

GAP = 21600
QUANTILE = 0.9
ORDER_GAP = 30 * 86400
EVENT = {"user": "user_id", "ts": "ts", "gap": GAP}
# The known number of users of events, at scale factor 0.01.
EXPECTED_USERS = 150
SESSION_COLUMNS = ["user_id", "session_id", "start_time", "end_time", "session_duration", "plays"]
EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def sessions(spark: SparkSession, sf_dir: str, gap: int = GAP) -> DataFrame:
    return session_summary(events(spark, sf_dir), **{**EVENT, "gap": gap})


def _iso(ts: str):
    return F.concat(F.translate(F.substring(F.col(ts).cast("string"), 1, 19), " ", "T"), F.lit("Z"))


def _damaged(time, event_type):
    """Times as text: those of errors are missing, those of signups malformed."""
    return F.when(event_type == "signup", F.replace(time, F.lit("T"), F.lit(" "))).when(
        event_type != "error", time
    )


def _log_file(spark: SparkSession, sf_dir: str, damaged: bool = False) -> str:
    """All events as a header-less TSV in the play log's six columns."""
    time = _iso("ts")
    log = events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("userid"),
        (_damaged(time, F.col("event_type")) if damaged else time).alias("timestamp"),
        F.col("event_id").cast("string").alias("artistid"),
        F.col("event_type").alias("artistname"),
        F.col("value").cast("string").alias("traid"),
        F.col("props").alias("traname"),
    )
    path = fresh_path(spark, "play-log")
    log.write.csv(path, sep="\t")
    return path


def _user_file(spark: SparkSession, sf_dir: str) -> str:
    """The distinct users of events as a headed TSV, as the profile file is."""
    path = fresh_path(spark, "profiles")
    users = events(spark, sf_dir).select(F.col("user_id").cast("string").alias(readers.PROFILE_ID))
    users.distinct().write.csv(path, sep="\t", header=True)
    return path


def _customer_file(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "customers")
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", readers.PROFILE_ID)
    customers.write.csv(path, sep="\t", header=True)
    return path


def _schema_file(spark: SparkSession) -> str:
    """The play log's schema as a JSON schema file."""
    path = fresh_path(spark, "schema")
    spark.createDataFrame([(readers.PLAY_SCHEMA.json(),)], "value string").coalesce(1).write.text(path)
    return path


def _order_log(spark: SparkSession, sf_dir: str) -> str:
    """All orders as a play log: customers are users, and many orders share a time."""
    path = fresh_path(spark, "order-log")
    table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("userid"),
        _iso("o_orderdate").alias("timestamp"),
        F.col("o_orderkey").cast("string").alias("artistid"),
        F.col("o_orderstatus").alias("artistname"),
        F.col("o_totalprice").cast("string").alias("traid"),
        F.col("o_orderpriority").alias("traname"),
    ).write.csv(path, sep="\t")
    return path


def _log_rows(log: DataFrame) -> DataFrame:
    """A parsed log with its times as whole seconds."""
    return log.select(
        "userid",
        epoch_second(F.col("timestamp")).alias("played_at"),
        "artistid",
        "artistname",
        F.col("traid").cast("double").alias("traid"),
        "traname",
    )


# -- sources and sinks ---------------------------------------------------------


def scan_schema_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log read under the schema that a schema file declares."""
    schema = readers.schema_from_json(spark, _schema_file(spark))
    log = readers.load(spark, "track_sessions", _log_file(spark, sf_dir), schema=schema)
    return _log_rows(readers.parse_plays(log))


def prepared_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with its columns and users checked against the profiles, and its times parsed."""
    log = readers.load(spark, "track_sessions", _log_file(spark, sf_dir))
    profiles = readers.load(spark, "userid_profiles", _user_file(spark, sf_dir))
    return _log_rows(plans.prepare_plays(log, profiles))


def scan_positional_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = readers.read_positional(spark, _log_file(spark, sf_dir))
    return _log_rows(readers.parse_plays(log))


def scan_header_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = readers.load(spark, "userid_profiles", _customer_file(spark, sf_dir))
    return profiles.select(
        F.col(readers.PROFILE_ID).alias("id"),
        "c_name",
        "c_nationkey",
        F.col("c_acctbal").cast("double").alias("c_acctbal"),
        "c_mktsegment",
    )


def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rejected_rows(readers.read_play_log(spark, _log_file(spark, sf_dir, damaged=True)))


def malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in which the lines of errors end after two fields and those of signups have a seventh."""
    fields = ["user_id", "ts", "event_id", "event_type", "value", "props"]
    texts = [_iso(c) if c == "ts" else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]
    line = (
        F.when(F.col("event_type") == "error", F.concat_ws("\t", *texts[:2]))
        .when(F.col("event_type") == "signup", F.concat_ws("\t", *texts, F.lit("more")))
        .otherwise(F.concat_ws("\t", *texts))
    )
    path = fresh_path(spark, "damaged-log")
    events(spark, sf_dir).select(line).write.text(path)
    log = readers.load(spark, "track_sessions", path, quote="", malformed=readers.MALFORMED)
    return quality.malformed_lines(log)


def tsv_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to result file: both inputs read, checked, summarized, written."""
    return plans.run_job(
        spark,
        _log_file(spark, sf_dir),
        _user_file(spark, sf_dir),
        fresh_path(spark, "result"),
        GAP,
        QUANTILE,
    )


def sample_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File to sample file: the first 30 plays of every user, ties broken by the id's text."""
    path = fresh_path(spark, "sample")
    sample = plans.sample_job(spark, _log_file(spark, sf_dir), path, tie_breakers=("artistid",))
    return _log_rows(readers.parse_plays(sample))


def sample_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 3 orders of every customer, where equal times fall on the cut."""
    path = fresh_path(spark, "sample")
    sample = plans.sample_job(spark, _order_log(spark, sf_dir), path, 3, tie_breakers=("artistid",))
    return _log_rows(readers.parse_plays(sample))


def summary_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.write_summary(long_session_share(spark, sf_dir), fresh_path(spark, "summary"))


def summary_sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "summary")
    return sinks.write_summary(long_session_share(spark, sf_dir), path, "csv")


# -- plays and sessions --------------------------------------------------------


def _sessionized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionize(events(spark, sf_dir), **EVENT)


def _as_double(df: DataFrame, column: str) -> DataFrame:
    """Whole seconds that may be null, as doubles: the same in every client library."""
    return df.withColumn(column, F.col(column).cast("double"))


def play_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = _sessionized(spark, sf_dir).select("event_id", "user_id", "ts", "time_diff")
    return _as_double(gaps, "time_diff")


def session_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessionized(spark, sf_dir).select("event_id", "user_id", "is_new_session")


def session_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessionized(spark, sf_dir).select("event_id", "user_id", "session_id")


def _damaged_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn(
        "ts", F.when(~F.col("event_type").isin("error", "signup"), F.col("ts"))
    )


def sessionize_missing_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sessionize(_damaged_plays(spark, sf_dir), **EVENT).select(
        "event_id", "user_id", "previous_time", "time_diff", "is_new_session", "session_id"
    )
    return _as_double(placed, "time_diff")


def sessions_missing_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_double(session_summary(_damaged_plays(spark, sf_dir), **EVENT), "session_duration")


def sessions_timed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_summary(_damaged_plays(spark, sf_dir), **EVENT, drop_null_ts=True)


def session_global_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = number_sessions(sessions(spark, sf_dir), "user_id")
    return numbered.select("user_id", "session_id", "unique_session_id")


def order_global_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return number_globally(orders, ["o_custkey", "o_orderdate", "o_orderkey"], "order_number")


def session_user_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = number_within_user(sessions(spark, sf_dir), "user_id")
    return numbered.select("user_id", "session_id", "user_session_number")


def session_user_number_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with a gap of a minute, for which a user's history is scanned in blocks."""
    found = sessions(spark, sf_dir, 60)
    return number_within_user(found, "user_id", 60).select(*SESSION_COLUMNS, "user_session_number")


def ordered_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).orderBy("user_id", "session_id")


def session_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_sessions(spark, sf_dir).limit(100)


def order_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return session_summary(orders, "o_custkey", "o_orderdate", ORDER_GAP)


def order_session_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    placed = sessionize(orders, "o_custkey", "o_orderdate", ORDER_GAP)
    return placed.select("o_orderkey", "o_custkey", "session_id")


def first_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_n_per_user(events(spark, sf_dir), 30, "user_id", "ts", ("event_id",))


def first_plays_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 orders of each priority: more than Spark limits before it shuffles."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return first_n_per_user(orders, 2000, "o_orderpriority", "o_orderdate", ("o_orderkey",))


# -- thresholds and results ----------------------------------------------------


def long_threshold_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.long_threshold(sessions(spark, sf_dir), QUANTILE).select(
        F.col("long_session_threshold").cast("bigint").alias("long_session_threshold")
    )


def long_threshold_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = interpolated_quantile(sessions(spark, sf_dir), "session_duration", QUANTILE, whole=True)
    return found.select(F.round("threshold", 6).alias("long_session_threshold"))


def long_threshold_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact thresholds at the ends of the error asked for; is the approximate one between?"""
    found, error = sessions(spark, sf_dir), 0.001
    column = "session_duration"
    approximate = plans.long_threshold(found, QUANTILE, error).scalar()
    ends = exact_quantile(found, column, QUANTILE - error, "lower").withColumn(
        "upper", exact_quantile(found, column, QUANTILE + error, "upper").scalar()
    )
    return ends.withColumn("within_bracket", approximate.between(F.col("lower"), F.col("upper")))


def approx_threshold_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the approximate threshold's rank lie within the error asked for?"""
    found, error = sessions(spark, sf_dir), 0.001
    threshold = plans.long_threshold(found, QUANTILE, error).scalar()
    duration, total = F.col("session_duration"), F.count("session_duration")
    return found.agg(
        total.alias("sessions"),
        (
            (F.count_if(duration < threshold) <= (QUANTILE + error) * total)
            & (F.count_if(duration <= threshold) >= (QUANTILE - error) * total)
        ).alias("within_error"),
    )


def session_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.session_split(sessions(spark, sf_dir), QUANTILE, "user_id")


def session_split_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions(spark, sf_dir)
    return plans.split_at(found, plans.long_threshold(found, QUANTILE).scalar())


def long_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions(spark, sf_dir)
    return plans.long_sessions(found, plans.long_threshold(found, QUANTILE).scalar())


def long_session_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.long_session_users(sessions(spark, sf_dir), QUANTILE, "user_id")


def long_session_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.long_session_share(events(spark, sf_dir), quantile=QUANTILE, **EVENT)


def long_session_share_quarter_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.summarize_sessions(sessions(spark, sf_dir, 900), QUANTILE, "user_id")


def long_session_share_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cross-check: the same result around the interpolated threshold."""
    found = sessions(spark, sf_dir)
    threshold = interpolated_quantile(found, "session_duration", QUANTILE).scalar()
    result = plans.summarize_at(found, threshold, "user_id")
    return result.withColumn("long_session_threshold", F.round("long_session_threshold", 6))


def long_session_share_missing_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.long_session_share(_damaged_plays(spark, sf_dir), quantile=QUANTILE, **EVENT)


# -- checks --------------------------------------------------------------------


def distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.distinct_users(events(spark, sf_dir), "user_id")


def user_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return quality.user_coverage(orders, customers, "o_custkey", "c_custkey")


def user_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    return quality.orphans(events(spark, sf_dir), customers, "user_id", "c_custkey")


def calibration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = plans.calibration_report(sessions(spark, sf_dir), QUANTILE, "user_id")
    return report.withColumn("deviation", F.round("deviation", 9))


def schema_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.schema_report(events(spark, sf_dir), EVENT_COLUMNS, "ts")


def expected_cardinality(spark: SparkSession, sf_dir: str, expected: int = EXPECTED_USERS) -> DataFrame:
    """Are there as many users of events as are known to be?"""
    return quality.expected_cardinality(events(spark, sf_dir), expected, "user_id")


def queries() -> dict[str, Query]:
    listed = [
        scan_schema_tsv, scan_positional_tsv, scan_header_tsv, rejected_rows, malformed_lines, prepared_plays,
        tsv_job, sample_sink, sample_ties, summary_sink, summary_sink_csv,
        play_gaps, session_flags, session_ids, sessionize_missing_times,
        sessions_missing_times, sessions_timed_only,
        session_global_number, order_global_number, session_user_number, session_user_number_minute, ordered_sessions, session_preview,
        order_sessions, order_session_ids,
        long_threshold_exact, long_threshold_interpolated, long_threshold_approx,
        approx_threshold_error,
        session_split, session_split_at, long_sessions, long_session_users,
        long_session_share, long_session_share_quarter_hour, long_session_share_interpolated,
        long_session_share_missing_times,
        distinct_users, user_coverage, user_orphans, calibration_report, schema_report,
        expected_cardinality,
    ]
    named = {query.__name__: query for query in listed}
    return {**named, "session_summary": sessions, "first_n_per_user": first_plays, "first_n_many": first_plays_many}


# -- the same in SQL -----------------------------------------------------------

DAMAGED = """(SELECT event_id, user_id,
  CASE WHEN event_type NOT IN ('error', 'signup') THEN ts END AS ts FROM events)"""


def _plays_sql(source: str = "events", user: str = "user_id", ts: str = "ts", gap: int = GAP) -> str:
    """CTEs: gaps, flags, plays with session ids, and sessions."""
    return f"""WITH gaps AS (
  SELECT *, lag({ts}) OVER (PARTITION BY {user} ORDER BY {ts} NULLS FIRST) AS previous_time
  FROM {source}),
diffs AS (
  SELECT *, date_diff('second', previous_time, {ts}) AS time_diff FROM gaps),
flags AS (
  SELECT *, CASE WHEN time_diff > {gap} OR time_diff IS NULL THEN 1 ELSE 0 END AS is_new_session
  FROM diffs),
ids AS (
  SELECT *, CAST(sum(is_new_session) OVER (
    PARTITION BY {user} ORDER BY {ts} NULLS FIRST
    RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_id
  FROM flags),
sessions AS (
  SELECT {user}, session_id, min({ts}) AS start_time, max({ts}) AS end_time,
    date_diff('second', min({ts}), max({ts})) AS session_duration, count(*) AS plays
  FROM ids GROUP BY {user}, session_id)
"""


def _share_sql(**source) -> str:
    return f"""{_plays_sql(**source)},
cut AS (
  SELECT quantile_disc(session_duration, {QUANTILE}) AS threshold FROM sessions),
split AS (
  SELECT CAST(count(*) FILTER (WHERE session_duration < threshold) AS BIGINT) AS short,
    CAST(count(*) FILTER (WHERE session_duration >= threshold) AS BIGINT) AS long,
    CAST(max(threshold) AS DOUBLE) AS threshold
  FROM sessions, cut),
users AS (
  SELECT (SELECT count(*) FROM (
      SELECT DISTINCT user_id FROM sessions, cut WHERE session_duration >= threshold)) AS with_long,
    (SELECT count(*) FROM (SELECT DISTINCT user_id FROM sessions)) AS total)
"""


RESULT_SQL = """SELECT with_long AS users_with_long_session_count, total AS total_users,
  with_long / total AS proportion_with_long_sessions, threshold AS long_session_threshold,
  short AS total_short_sessions, long AS total_long_sessions,
  long / (short + long) AS long_session_ratio
FROM split, users"""

# Times of a log file have no fraction.
WHOLE_SECONDS = "(SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)"

LOG_SQL = """SELECT CAST(user_id AS VARCHAR) AS userid,
  CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS played_at,
  CAST(event_id AS VARCHAR) AS artistid, event_type AS artistname, value AS traid, props AS traname
FROM events"""


def oracle_sql() -> dict[str, str]:
    plays = _plays_sql()
    share = _share_sql()
    columns = ", ".join(SESSION_COLUMNS)
    result = share + RESULT_SQL
    first = """SELECT * EXCLUDE (place) FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events)
WHERE place <= 30"""
    orders = _plays_sql("orders", "o_custkey", "o_orderdate", ORDER_GAP)
    return {
        "scan_schema_tsv": LOG_SQL,
        "scan_positional_tsv": LOG_SQL,
        "prepared_plays": LOG_SQL,
        "scan_header_tsv": """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name,
  CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_acctbal, c_mktsegment FROM customer""",
        "rejected_rows": """SELECT count(*) AS total_rows,
  count(*) FILTER (WHERE event_type = 'error') AS missing,
  count(*) FILTER (WHERE event_type = 'signup') AS unparseable FROM events""",
        "malformed_lines": """SELECT count(*) AS total_rows,
  count(*) FILTER (WHERE event_type IN ('error', 'signup')) AS malformed,
  count(*) FILTER (WHERE user_id IS NULL) AS rows_without_user FROM events""",
        "tsv_job": _share_sql(source=WHOLE_SECONDS) + RESULT_SQL,
        "sample_sink": f"""SELECT * EXCLUDE (place) FROM (
  SELECT *, row_number() OVER (PARTITION BY userid ORDER BY played_at, artistid) AS place
  FROM ({LOG_SQL}))
WHERE place <= 30""",
        "sample_ties": """SELECT * EXCLUDE (place) FROM (
  SELECT *, row_number() OVER (PARTITION BY userid ORDER BY played_at, artistid) AS place
  FROM (
    SELECT CAST(o_custkey AS VARCHAR) AS userid,
      CAST(epoch(date_trunc('second', o_orderdate)) AS BIGINT) AS played_at,
      CAST(o_orderkey AS VARCHAR) AS artistid, o_orderstatus AS artistname,
      o_totalprice AS traid, o_orderpriority AS traname
    FROM orders))
WHERE place <= 3""",
        "summary_sink": result,
        "summary_sink_csv": result,
        "play_gaps": plays + "SELECT event_id, user_id, ts, CAST(time_diff AS DOUBLE) AS time_diff FROM diffs",
        "session_flags": plays + "SELECT event_id, user_id, is_new_session FROM flags",
        "session_ids": plays + "SELECT event_id, user_id, session_id FROM ids",
        "sessionize_missing_times": _plays_sql(DAMAGED)
        + """SELECT event_id, user_id, previous_time, CAST(time_diff AS DOUBLE) AS time_diff,
  is_new_session, session_id FROM ids""",
        "sessions_missing_times": _plays_sql(DAMAGED)
        + """SELECT user_id, session_id, start_time, end_time,
  CAST(session_duration AS DOUBLE) AS session_duration, plays FROM sessions""",
        "sessions_timed_only": _plays_sql(f"(SELECT * FROM {DAMAGED} WHERE ts IS NOT NULL)")
        + f"SELECT {columns} FROM sessions",
        "session_summary": plays + f"SELECT {columns} FROM sessions",
        "session_global_number": plays
        + """SELECT user_id, session_id,
  row_number() OVER (ORDER BY user_id, session_id) AS unique_session_id FROM sessions""",
        "order_global_number": """SELECT o_custkey, o_orderdate, o_orderkey,
  row_number() OVER (ORDER BY o_custkey, o_orderdate, o_orderkey) AS order_number FROM orders""",
        "session_user_number": plays
        + """SELECT user_id, session_id,
  row_number() OVER (PARTITION BY user_id ORDER BY session_id) AS user_session_number
FROM sessions""",
        "session_user_number_minute": _plays_sql(gap=60)
        + f"""SELECT {columns},
  row_number() OVER (PARTITION BY user_id ORDER BY session_id) AS user_session_number
FROM sessions""",
        "ordered_sessions": plays + f"SELECT {columns} FROM sessions ORDER BY user_id, session_id",
        "session_preview": plays
        + f"SELECT {columns} FROM sessions ORDER BY user_id, session_id LIMIT 100",
        "order_sessions": orders
        + "SELECT o_custkey, session_id, start_time, end_time, session_duration, plays FROM sessions",
        "order_session_ids": orders + "SELECT o_orderkey, o_custkey, session_id FROM ids",
        "first_n_per_user": first,
        "first_n_many": """SELECT * EXCLUDE (place) FROM (
  SELECT o_orderkey, o_orderpriority, o_orderdate,
    row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS place FROM orders)
WHERE place <= 2000""",
        "long_threshold_exact": share
        + "SELECT CAST(threshold AS BIGINT) AS long_session_threshold FROM cut",
        "long_threshold_interpolated": plays
        + f"""SELECT round(quantile_cont(session_duration, {QUANTILE}), 6) AS long_session_threshold
FROM sessions""",
        "long_threshold_approx": plays
        + f"""SELECT CAST(lower AS DOUBLE) AS lower, CAST(upper AS DOUBLE) AS upper,
  exact BETWEEN lower AND upper AS within_bracket
FROM (SELECT quantile_disc(session_duration, {QUANTILE - 0.001}) AS lower,
  quantile_disc(session_duration, {QUANTILE}) AS exact,
  quantile_disc(session_duration, {QUANTILE + 0.001}) AS upper FROM sessions)""",
        "approx_threshold_error": share
        + f"""SELECT count(session_duration) AS sessions,
  count(*) FILTER (WHERE session_duration < threshold) <= {QUANTILE + 0.001} * count(session_duration)
  AND count(*) FILTER (WHERE session_duration <= threshold) >= {QUANTILE - 0.001} * count(session_duration)
  AS within_error FROM sessions, cut""",
        "session_split": share
        + """SELECT short AS total_short_sessions, long AS total_long_sessions,
  short / (short + long) AS short_session_ratio, long / (short + long) AS long_session_ratio
FROM split""",
        "session_split_at": share
        + "SELECT short AS total_short_sessions, long AS total_long_sessions FROM split",
        "long_sessions": share
        + f"SELECT {columns} FROM sessions, cut WHERE session_duration >= threshold",
        "long_session_users": share
        + "SELECT DISTINCT user_id FROM sessions, cut WHERE session_duration >= threshold",
        "long_session_share": result,
        "long_session_share_quarter_hour": _share_sql(gap=900) + RESULT_SQL,
        "long_session_share_interpolated": share.replace("quantile_disc", "quantile_cont")
        + RESULT_SQL.replace("threshold AS", "round(threshold, 6) AS"),
        "long_session_share_missing_times": _share_sql(source=DAMAGED) + RESULT_SQL,
        "distinct_users": "SELECT count(*) AS users FROM (SELECT DISTINCT user_id FROM events)",
        "user_coverage": """WITH f AS (SELECT DISTINCT o_custkey AS id FROM orders),
d AS (SELECT DISTINCT c_custkey AS id FROM customer),
counts AS (
  SELECT (SELECT count(*) FROM f) AS fact_users, (SELECT count(*) FROM d) AS dimension_users,
    (SELECT count(*) FROM f ANTI JOIN d USING (id)) AS fact_only,
    (SELECT count(*) FROM d ANTI JOIN f USING (id)) AS dimension_only)
SELECT *, fact_users = dimension_users AS counts_match,
  fact_only = 0 AND dimension_only = 0 AS sets_match FROM counts""",
        "user_orphans": """SELECT user_id AS id, 'fact' AS side FROM (SELECT DISTINCT user_id FROM events)
WHERE user_id NOT IN (SELECT c_custkey FROM customer)
UNION ALL
SELECT c_custkey, 'dimension' FROM (SELECT DISTINCT c_custkey FROM customer)
WHERE c_custkey NOT IN (SELECT user_id FROM events)""",
        "calibration_report": share
        + f"""SELECT short / (short + long) AS short_session_ratio,
  long / (short + long) AS long_session_ratio,
  round(abs(short / (short + long) - {QUANTILE}), 9) AS deviation,
  abs(short / (short + long) - {QUANTILE}) < 0.001 AS within_tolerance
FROM split""",
        "schema_report": """SELECT
  (SELECT string_agg(column_name, ',') FROM (DESCRIBE SELECT * FROM events))
    = 'event_id,ts,user_id,event_type,value,props' AS columns_match,
  (SELECT column_type FROM (DESCRIBE SELECT * FROM events) WHERE column_name = 'ts')
    = 'TIMESTAMP' AS time_is_timestamp,
  count(*) AS total_rows, count(*) FILTER (WHERE ts IS NULL) AS rows_without_time FROM events""",
        "expected_cardinality": f"""SELECT users, expected, users = expected AS matches FROM (
  SELECT (SELECT count(*) FROM (SELECT DISTINCT user_id FROM events)) AS users,
    CAST({EXPECTED_USERS} AS BIGINT) AS expected)""",
    }
