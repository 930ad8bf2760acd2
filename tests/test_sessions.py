"""Hand-checked cases, random timelines against plain Python, and invariants."""

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

import brute
from sessionlake.operators import sessions
from sessionlake.operators.numbering import number_globally, number_sessions
from sessionlake.operators.quantiles import interpolated_quantile
from sessionlake.operators.sessions import number_within_user, session_summary, sessionize
from sessionlake.plans.long_sessions import (
    long_session_share,
    long_session_users,
    long_sessions,
    split_at,
    summarize_at,
    summarize_sessions,
)
from sessionlake.sources.readers import parse_plays

pytestmark = pytest.mark.usefixtures("fixed_plans")

EPOCH = datetime(1970, 1, 1)


def log(spark, rows):
    return spark.createDataFrame(rows, "userid string, timestamp string")


def timeline(spark, plays, parts=3):
    """A frame of plays given as (user, microseconds or None)."""
    rows = [(u, None if t is None else EPOCH + timedelta(microseconds=t)) for u, t in plays]
    return spark.createDataFrame(rows, "userid string, timestamp timestamp_ntz").repartition(parts)


def micros(time):
    return None if time is None else (time - EPOCH) // timedelta(microseconds=1)


def clock(time):
    return None if time is None else time.strftime("%H:%M:%S")


def by_text(rows):
    return sorted(rows, key=repr)


E1 = [
    ("A", "2009-01-01T00:00:00Z"),
    ("A", "2009-01-01T00:15:00Z"),
    ("A", "2009-01-01T00:30:01Z"),
    ("A", "2009-01-01T00:30:01Z"),
    ("B", "2009-01-01T12:00:00Z"),
    ("C", "2009-01-01T23:55:00Z"),
    ("C", "2009-01-02T00:05:00Z"),
]

E2 = [
    ("a", "bad"),
    ("a", None),
    ("a", "1970-01-01T00:01:40Z"),
    ("a", "1970-01-01T00:01:40Z"),
    ("a", "1970-01-01T00:08:20Z"),
    ("a", "1970-01-01T00:33:20Z"),
    ("b", "bad"),
]


def test_boundaries_and_ties(spark):
    found = session_summary(parse_plays(log(spark, E1))).orderBy("userid", "session_id").collect()
    assert [
        (r.userid, r.session_id, clock(r.start_time), clock(r.end_time), r.plays, r.session_duration)
        for r in found
    ] == [
        ("A", 1, "00:00:00", "00:15:00", 2, 900),
        ("A", 2, "00:30:01", "00:30:01", 2, 0),
        ("B", 1, "12:00:00", "12:00:00", 1, 0),
        ("C", 1, "23:55:00", "00:05:00", 2, 600),
    ]


def test_boundaries_result(spark):
    plays = parse_plays(log(spark, E1))
    assert tuple(long_session_share(plays).first()) == (1, 3, 1 / 3, 900.0, 3, 1, 0.25)
    assert [r.userid for r in long_session_users(session_summary(plays)).collect()] == ["A"]


@pytest.mark.parametrize("drop", [False, True])
def test_missing_and_malformed_times(spark, drop):
    plays = parse_plays(log(spark, E2))
    found = session_summary(plays, drop_null_ts=drop).orderBy("userid", "session_id").collect()
    first = 1 if drop else 3
    timed = [
        ("a", first, "00:01:40", "00:08:20", 3, 400),
        ("a", first + 1, "00:33:20", "00:33:20", 1, 0),
    ]
    untimed = [] if drop else [("a", 2, None, None, 2, None), ("b", 1, None, None, 1, None)]
    assert [
        (r.userid, r.session_id, clock(r.start_time), clock(r.end_time), r.plays, r.session_duration)
        for r in found
    ] == sorted(timed + untimed, key=lambda r: r[:2])
    assert sessionize(plays, drop_null_ts=drop).count() == (4 if drop else 7)


@pytest.mark.parametrize("zone", ["UTC", "Europe/London", "Asia/Kolkata"])
def test_results_do_not_depend_on_the_session_zone(spark, zone):
    rows = [("z", "2009-03-29T00:55:00Z"), ("z", "2009-03-29T02:05:00Z")]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        plays = parse_plays(log(spark, rows))
        assert [r.time_diff for r in sessionize(plays).orderBy("time_diff").collect()] == [None, 4200]
        assert [r.session_duration for r in session_summary(plays).collect()] == [0, 0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_fractions_are_cut_off_before_subtracting(spark):
    plays = timeline(
        spark, [("p", 900_000), ("p", 901_100_000), ("q", 100_000), ("q", 900_900_000)]
    )
    found = session_summary(plays).orderBy("userid", "session_id").collect()
    assert [(r.userid, r.session_duration) for r in found] == [("p", 0), ("p", 0), ("q", 900)]


def test_no_plays(spark):
    plays = timeline(spark, [])
    assert session_summary(plays).count() == 0
    assert tuple(long_session_share(plays).first()) == (0, 0, None, None, 0, 0, None)
    assert long_session_users(session_summary(plays)).count() == 0


def test_only_missing_times(spark):
    plays = timeline(spark, [("a", None), ("a", None), (None, None)])
    assert tuple(long_session_share(plays).first()) == (0, 2, 0.0, None, 0, 0, None)


def test_null_user_is_a_user(spark):
    plays = timeline(spark, [(None, 0), (None, 10_000_000), ("a", 0), ("a", None)])
    assert long_session_share(plays).first().total_users == 2
    found = sessionize(plays).select("userid", "time_diff", "session_id").collect()
    assert by_text(map(tuple, found)) == by_text(
        [(None, None, 1), (None, 10, 1), ("a", None, 2), ("a", None, 1)]
    )


def test_bad_gap(spark):
    with pytest.raises(ValueError):
        session_summary(timeline(spark, []), gap=-1)


def random_plays(seed, users=12, plays=400, gap=900):
    """Runs of close plays, gaps right at the limit, ties, missing users and times."""
    rng = random.Random(seed)
    names = [None, *(f"u{i}" for i in range(users))]
    out = []
    for _ in range(plays // 8):
        # One user has a third of everything.
        user = names[1] if rng.random() < 1 / 3 else rng.choice(names)
        time = rng.randrange(-5_000_000, 5_000_000) * 100_000
        for _ in range(8):
            out.append((user, None if rng.random() < 0.05 else time))
            step = rng.choice([0, 1, gap - 1, gap, gap + 1, rng.randrange(3 * gap)])
            time += step * 1_000_000 + rng.choice([0, 0, 300_000, 999_999])
    return out


@pytest.mark.parametrize("seed,gap", [(1, 900), (2, 900), (3, 60), (4, 0), (5, 21600)])
def test_summary_and_share_match_plain_python(spark, seed, gap):
    plays = random_plays(seed, gap=max(gap, 5))
    frame = timeline(spark, plays)
    found = [
        (r.userid, r.session_id, micros(r.start_time), micros(r.end_time), r.session_duration, r.plays)
        for r in session_summary(frame, gap=gap).collect()
    ]
    assert by_text(found) == by_text(brute.summarized(plays, gap))
    assert tuple(long_session_share(frame, gap=gap).first()) == brute.share(plays, gap, 0.9)


@pytest.mark.parametrize("hot_tile", [None, 1, 2, 5, 1_000_000])
@pytest.mark.parametrize("gap", [900, 21600])
def test_sessionize_matches_plain_python(spark, gap, hot_tile):
    plays = random_plays(11, gap=gap)
    found = [
        (r.userid, micros(r.timestamp), micros(r.previous_time), r.time_diff, r.is_new_session, r.session_id)
        for r in sessionize(timeline(spark, plays), gap=gap, hot_tile=hot_tile).collect()
    ]
    assert by_text(found) == by_text(brute.sessionized(plays, gap))


def test_slices_may_change_when_plays_are_read_again(spark, monkeypatch):
    """As after a shuffle whose partitions differ between jobs: here every reading deals anew."""
    monkeypatch.setattr(sessions, "_slice_of_task", lambda: F.floor(F.rand() * sessions.SLICES).cast("int"))
    plays = [("a", 10**12 + max(0, i - 300) * 5 * 10**9) for i in range(600)] + [("b", 7), ("b", 7), ("a", None)] * 20
    found = [
        (r.userid, micros(r.timestamp), micros(r.previous_time), r.time_diff, r.is_new_session, r.session_id)
        for r in sessionize(timeline(spark, plays, 4), hot_tile=10).collect()
    ]
    assert by_text(found) == by_text(brute.sessionized(plays, 900))


@pytest.mark.parametrize("hot_tile", [100])
def test_crowded_moments_behind_a_shuffle(spark, hot_tile):
    """The input's partitions differ from job to job: they follow from the columns that a job needs."""
    keys = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
        "spark.sql.shuffle.partitions": "64",
    }
    before = {key: spark.conf.get(key) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        number = F.col("id")
        moment = F.when(number < 5000, F.lit(10**9)).otherwise(F.lit(10**9) + 5000 * (number - 5000))
        plays = spark.range(0, 20_000, 1, 8).select(
            F.lit("a").alias("userid"), F.timestamp_seconds(moment).alias("timestamp"),
            F.repeat(F.sha2(number.cast("string"), 512), (number % 7).cast("int")).alias("wide"), (number % 400).alias("k"), number.alias("n"),
        )
        row = F.row_number().over(Window.partitionBy("k").orderBy(F.col("n").desc()))
        shuffled = plays.withColumn("row", row).where("row > 0")
        found = sessionize(shuffled, hot_tile=hot_tile)
        wide = F.sum(F.length("wide"))
        row = found.agg(F.sum("is_new_session"), F.max("session_id"), F.count("*"), F.count("time_diff"), wide).first()
        # The tied plays are one session, all others one each; only the very first has no predecessor.
        assert tuple(row)[:4] == (15_000, 15_000, 20_000, 19_999)
        gaps = found.groupBy("time_diff").count().collect()
        assert {r.time_diff: r["count"] for r in gaps} == {None: 1, 0: 5000, 5000: 14_999}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_sessionize_without_untimed_plays_matches_plain_python(spark):
    plays = random_plays(12)
    found = [
        (r.userid, micros(r.timestamp), micros(r.previous_time), r.time_diff, r.is_new_session, r.session_id)
        for r in sessionize(timeline(spark, plays), drop_null_ts=True).collect()
    ]
    timed = [p for p in plays if p[1] is not None]
    assert len(timed) < len(plays)
    assert by_text(found) == by_text(brute.sessionized(timed, 900))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    plays=st.lists(
        st.tuples(
            st.sampled_from([None, "a", "b"]),
            st.none() | st.integers(-4_000, 4_000).map(lambda s: s * 1_000_000),
        ),
        max_size=25,
    ),
    gap=st.integers(0, 1000),
)
def test_any_plays_match_plain_python(spark, plays, gap):
    frame = timeline(spark, plays, parts=2)
    assert tuple(long_session_share(frame, gap=gap).first()) == brute.share(plays, gap, 0.9)


def test_sessionize_keeps_other_columns_in_place(spark):
    plays = spark.createDataFrame(
        [("x", EPOCH, "u")], "track string, timestamp timestamp_ntz, userid string"
    )
    assert sessionize(plays).columns == [
        "track", "timestamp", "userid", "previous_time", "time_diff", "is_new_session", "session_id",
    ]
    assert tuple(sessionize(plays).first()) == ("x", EPOCH, "u", None, None, 1, 1)


def test_invariants(spark):
    gap = 900
    plays = random_plays(21)
    frame = timeline(spark, plays)
    sessions = session_summary(frame, gap=gap).cache()
    assert sessions.agg(F.sum("plays")).first()[0] == len(plays)

    history = Window.partitionBy("userid").orderBy("start_time")
    timed = sessions.where("start_time IS NOT NULL")
    pauses = timed.select(
        (F.unix_timestamp("start_time") - F.unix_timestamp(F.lag("end_time").over(history))).alias("p")
    ).where("p IS NOT NULL")
    assert pauses.count() > 0
    assert pauses.where(F.col("p") <= gap).count() == 0

    inner = sessionize(frame, gap=gap).where("is_new_session = 0")
    assert inner.where(F.col("time_diff") > gap).count() == 0

    row = long_session_share(frame, gap=gap).first()
    assert row.total_short_sessions + row.total_long_sessions == timed.count()
    split = split_at(sessions, row.long_session_threshold).first()
    assert tuple(split) == (row.total_short_sessions, row.total_long_sessions)


def test_order_and_partitions_of_the_input_do_not_matter(spark):
    plays = random_plays(31)
    rows = [
        by_text(map(tuple, session_summary(timeline(spark, given, parts)).collect()))
        for given, parts in [(plays, 1), (plays[::-1], 7)]
    ]
    assert rows[0] == rows[1]


def test_agrees_with_session_window(spark):
    """Spark's own session windows, on whole seconds and timed plays."""
    plays = [(u, t // 1_000_000 * 1_000_000) for u, t in random_plays(41) if u and t is not None]
    frame = timeline(spark, plays)
    ours = session_summary(frame).select("userid", "start_time", "end_time", "plays")
    theirs = frame.groupBy("userid", F.session_window("timestamp", "900 seconds")).agg(
        F.min("timestamp"), F.max("timestamp"), F.count("*")
    )
    theirs = theirs.drop("session_window")
    assert by_text(map(tuple, ours.collect())) == by_text(map(tuple, theirs.collect()))


def test_numbers(spark):
    sessions = session_summary(timeline(spark, random_plays(51)))
    by_user = number_sessions(sessions).withColumnRenamed("unique_session_id", "by_user")
    rows = number_globally(number_within_user(by_user), ["userid", "session_id"]).collect()
    assert all(r.by_user == r.unique_session_id for r in rows)
    in_order = sorted(rows, key=lambda r: (brute.order_key(r.userid), r.session_id))
    assert [r.unique_session_id for r in in_order] == list(range(1, len(rows) + 1))
    for user in {r.userid for r in rows}:
        own = [r.user_session_number for r in in_order if r.userid == user]
        assert own == list(range(1, len(own) + 1))


def test_result_at_another_threshold(spark):
    plays = random_plays(71)
    sessions = session_summary(timeline(spark, plays)).cache()
    exact = summarize_sessions(sessions).first()
    assert summarize_at(sessions, exact.long_session_threshold).first() == exact
    # So fine a sketch is exact here.
    assert summarize_sessions(sessions, error=0.0001).first() == exact

    between = interpolated_quantile(sessions, "session_duration", 0.9)
    row = summarize_at(sessions, between.scalar()).first()
    durations = [s[4] for s in brute.summarized(plays, 900) if s[4] is not None]
    cut = between.first().threshold
    assert row.long_session_threshold == cut
    assert row.total_long_sessions == sum(d >= cut for d in durations)
    assert long_sessions(sessions, cut).count() == row.total_long_sessions

    nobody = summarize_at(sessions.where("false"), 900).first()
    assert tuple(nobody) == (0, 0, None, 900.0, 0, 0, None)


def busy_history(seed):
    """One user active nearly every second, others with a few plays, some without a time, a null user."""
    draw = random.Random(seed)
    plays = [("hot", 1_000_000 * s + draw.randrange(1_000_000)) for s in range(-300, 900) if draw.random() < 0.8]
    plays += [("hot", None)] * 3 + [("late", None), (None, 5_000_000), (None, None), (None, 6_000_000)]
    return plays + [(draw.choice("ab"), draw.randrange(-50, 400) * 1_000_000) for _ in range(150)]


@pytest.mark.parametrize("gap, block", [(0, 1), (0, 64), (1, 3), (7, 64)])
def test_histories_in_blocks(spark, monkeypatch, gap, block):
    plays = busy_history(gap)
    monkeypatch.setattr(sessions, "BLOCK", block)
    df = timeline(spark, plays)
    got = [(r.userid, micros(r.timestamp), micros(r.previous_time), r.time_diff, r.is_new_session, r.session_id)
           for r in sessionize(df, gap=gap).collect()]
    assert by_text(got) == by_text(brute.sessionized(plays, gap))
    summary = session_summary(df, gap=gap)
    got = [(r.userid, r.session_id, micros(r.start_time), micros(r.end_time), r.session_duration, r.plays)
           for r in summary.collect()]
    assert by_text(got) == by_text(brute.summarized(plays, gap))
    whole = number_within_user(summary).collect()
    assert by_text(number_within_user(summary, gap=gap).collect()) == by_text(whole)


def test_no_block_is_larger_than_said(spark, monkeypatch):
    """A user active every second for long: no window of tiles gets more than a block."""
    monkeypatch.setattr(sessions, "BLOCK", 1000)
    seconds = spark.range(20_000).select(F.lit("hot").alias("userid"), F.timestamp_seconds("id").alias("timestamp"))
    seen = []
    scanned = sessions._scanned

    def watched(tiles, group, gap):
        seen.append(tiles.groupBy(group).count().agg(F.max("count")).first()[0])
        return scanned(tiles, group, gap)

    monkeypatch.setattr(sessions, "_scanned", watched)
    summary = session_summary(seconds, gap=0)
    assert seen == [1000]
    assert summary.agg(F.count("*"), F.max("session_id"), F.countDistinct("session_id")).first() == (20_000, 20_000, 20_000)
