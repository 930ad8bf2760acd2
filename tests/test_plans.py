"""What the plans look like when no side is small: with broadcasts by size switched off."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from sessionlake.operators import quality
from sessionlake.operators.numbering import number_globally, number_sessions
from sessionlake.operators.quantiles import interpolated_quantile
from sessionlake.operators.sampling import first_n_per_user
from sessionlake.operators.sessions import number_within_user, session_summary, sessionize
from sessionlake.plans import long_sessions as plans

EVENTS = "/root/testdata/sf0.01/events.parquet"
BY_SIZE = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]


@pytest.fixture
def events(spark):
    before = {key: spark.conf.get(key, None) for key in BY_SIZE}
    for key in BY_SIZE:
        spark.conf.set(key, "-1")
    yield spark.read.parquet(EVENTS)
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def final_plan(df):
    df.collect()
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    # The main plan and its subqueries, each without the plan it started from.
    lines, skip = [], None
    for line in text.getvalue().splitlines():
        depth = len(line) - len(line.lstrip(" :|+-"))
        if skip is not None and (not line.strip() or depth >= skip):
            continue
        skip = depth if "Initial Plan" in line else None
        if skip is None:
            lines.append(re.sub(r"(ReusedExchange \[.*?\]).*", r"\1", line))
    plan = "\n".join(lines)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "Python" not in plan and "Arrow" not in plan
    return plan


def scans(plan):
    return re.findall(r"FileScan parquet \[(.*?)\]", plan)


def columns(scan):
    return {c.split("#")[0] for c in scan.split(",")}


SESSIONS = dict(user="user_id", ts="ts", gap=21600)


def test_summary_shuffles_tiles_then_users(events):
    plan = final_plan(session_summary(events, **SESSIONS))
    assert [columns(s) for s in scans(plan)] == [{"user_id", "ts"}]
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2
    # What reaches the first shuffle is already combined per user and tile.
    below = plan[plan.index("Exchange hashpartitioning(user_id", plan.index("ShuffleQueryStage 0")):]
    assert "partial_min" in below.splitlines()[1]


def test_numbering_within_users_adds_no_shuffle(events):
    plan = final_plan(number_within_user(session_summary(events, **SESSIONS), "user_id"))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2


@pytest.mark.parametrize(
    "query",
    [
        lambda s: plans.summarize_sessions(s, 0.9, "user_id"),
        lambda s: plans.long_session_users(s, 0.9, "user_id"),
        lambda s: plans.calibration_report(s, 0.9, "user_id"),
        lambda s: plans.long_threshold(s, 0.9),
        lambda s: interpolated_quantile(s, "session_duration", 0.9),
        lambda s: plans.summarize_sessions(s, 0.9, "user_id", error=0.01),
        lambda s: plans.split_at(s, plans.long_threshold(s, 0.9).scalar()),
    ],
    ids=["summary", "users", "calibration", "threshold", "interpolated", "approximate", "split"],
)
def test_plays_are_read_and_shuffled_once(events, query):
    plan = final_plan(query(session_summary(events, **SESSIONS)))
    assert [columns(s) for s in scans(plan)] == [{"user_id", "ts"}]
    assert len(re.findall(r"Exchange hashpartitioning\(user_id#\d+L, \d", plan)) == 1
    # Only bins and one-row partial results may meet in one task.
    for below in re.findall(r"Exchange SinglePartition.*\n(.*)", plan):
        assert "bin#" in below or "keys=[]" in below


def test_users_with_long_sessions_are_distinct_without_a_shuffle(events):
    plan = final_plan(plans.long_session_users(session_summary(events, **SESSIONS), 0.9, "user_id"))
    outer = plan[: plan.index("Subquery")]
    assert "Exchange" not in outer


def test_plays_move_once(events):
    plan = final_plan(sessionize(events, **SESSIONS))
    # The tiles were read before; here the plays are read once, and the written tiles.
    assert plan.count(EVENTS) == 1
    assert len(scans(plan)) == 2
    # Above the plays: one shuffle, and a merge join that sorts no play again.
    wide = next(s for s in scans(plan) if "event_type" in s)
    above = plan[plan.index("SortMergeJoin"): plan.index(wide)]
    assert len(re.findall(r"Exchange hashpartitioning", above)) == 1
    assert len(re.findall(r"Sort \[", above)) == 1


@pytest.mark.parametrize("columns_", [["event_id", "time_diff"], ["event_id", "is_new_session"], ["session_id"]])
def test_plays_are_read_once_whatever_is_selected(events, columns_):
    plan = final_plan(sessionize(events, **SESSIONS).select(*columns_))
    assert plan.count(EVENTS) == 1
    assert not any("value" in columns(s) for s in scans(plan))


def test_session_ids_alone_need_no_window_over_plays(events):
    plan = final_plan(sessionize(events, **SESSIONS).select("event_id", "session_id"))
    assert "_earlier" not in plan


def largest_share(found):
    """Of the rows that one task puts out."""
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) / sum(sizes)


@pytest.fixture
def more_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_crowded_tile_is_spread(spark, events, more_partitions):
    crowd = spark.range(3000).select(
        F.lit("a").alias("userid"), F.timestamp_seconds(F.col("id") % 600).alias("timestamp")
    )
    found = sessionize(crowd, hot_tile=100)
    assert found.agg(F.max("session_id"), F.sum("time_diff"), F.count("*")).first()[:] == (1, 599, 3000)
    assert largest_share(found) < 0.25


def test_plays_at_one_moment_are_spread(spark, events, more_partitions):
    moment = spark.range(0, 40_000, 1, 32).select(
        F.lit("a").alias("userid"), F.timestamp_seconds(F.lit(7)).alias("timestamp"), "id"
    )
    found = sessionize(moment, hot_tile=1000)
    assert found.agg(F.sum("is_new_session"), F.max("session_id"), F.count("*")).first()[:] == (1, 1, 40_000)
    assert largest_share(found) < 0.3


def test_untimed_plays_of_one_user_are_spread(spark, events, more_partitions):
    number = F.col("id")
    plays = spark.range(0, 60_000, 1, 32).select(
        F.when(number % 3 == 0, "a").otherwise(F.concat(F.lit("u"), number % 999)).alias("userid"),
        F.when(number % 3 != 0, F.timestamp_seconds(number * 7)).alias("timestamp"),
    )
    found = sessionize(plays)
    assert largest_share(found.where("timestamp IS NULL")) < 0.3
    assert found.count() == 60_000
    assert found.where("timestamp IS NULL").agg(F.min("session_id"), F.max("session_id")).first()[:] == (20_000, 20_000)


def test_names_of_results_are_refused(events):
    with pytest.raises(ValueError, match="session_id"):
        sessionize(events.withColumnRenamed("value", "session_id"), **SESSIONS)
    odd = events.withColumnsRenamed({"value": "_tile", "props": "_time", "event_type": "previous_end"})
    assert sessionize(odd, **SESSIONS).where("_tile IS NOT NULL").count() == events.count()


def test_sampling_limits_before_both_shuffles(events):
    plan = final_plan(first_n_per_user(events, 30, "user_id", "ts", ("event_id",)))
    assert len(re.findall(r"WindowGroupLimit .*Partial", plan)) == 2
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2


def test_global_numbers_use_no_global_window(events):
    numbered = number_globally(session_summary(events, **SESSIONS), ["user_id", "session_id"])
    plan = final_plan(numbered.select("user_id", "session_id", "unique_session_id"))
    assert "frozen-" in plan
    assert [columns(s) for s in scans(plan)] == [{"user_id", "session_id", "_mark"}, {"_mark"}]
    assert "Window [row_number" not in plan


def test_numbering_sessions_moves_no_session(events):
    plan = final_plan(number_sessions(session_summary(events, **SESSIONS), "user_id"))
    assert "rangepartitioning" not in plan
    # Tiles, then users' tiles; all else that moves is one row per user or partition.
    assert len(re.findall(r"Exchange hashpartitioning\(user_id", plan)) == 3
    assert plan.count(EVENTS) == 1


def test_coverage_combines_before_its_only_keyed_shuffle(spark, events):
    customers = spark.read.parquet(EVENTS.replace("events", "customer"))
    plan = final_plan(quality.user_coverage(events, customers, "user_id", "c_custkey"))
    assert [columns(s) for s in scans(plan)] == [{"user_id"}, {"c_custkey"}]
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert "Join" not in plan
