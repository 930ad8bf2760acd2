import random

import pytest
from pyspark.sql import functions as F

import brute
from sessionlake.operators import quantiles
from sessionlake.operators.quantiles import (
    BIN_OF,
    BINS,
    PART_OF,
    at_ranks,
    discrete_rank,
    histogram,
    exact_quantile,
    interpolated_quantile,
    quantile_of,
)
from sessionlake.plans.long_sessions import calibration_report, session_split, summarize_sessions


pytestmark = pytest.mark.usefixtures("fixed_plans")


def numbers(spark, values):
    return spark.createDataFrame([(v,) for v in values], "d bigint")


def one(df):
    return df.first()["threshold"]


@pytest.mark.parametrize(
    "values,discrete,interpolated",
    [
        (range(1, 11), 9, 9.1),
        (range(1, 12), 10, 10),
        ([7], 7, 7),
        ([None, 1, 2], 2, 1.9),
        ([], None, None),
        ([None], None, None),
        ([0] * 20, 0, 0),
    ],
)
def test_hand_checked(spark, values, discrete, interpolated):
    df = numbers(spark, values)
    assert one(exact_quantile(df, "d", 0.9)) == discrete
    assert one(interpolated_quantile(df, "d", 0.9)) == (
        None if interpolated is None else pytest.approx(interpolated)
    )


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.9, 0.999, 1.0])
def test_matches_the_built_in_functions(spark, q):
    rng = random.Random(7)
    # Neighbours on both sides of bin borders, far apart bins, negative values, many ties.
    values = [rng.choice([0, 1, BINS - 1, BINS, BINS + 1, -1, -BINS, rng.randrange(10**7)]) for _ in range(999)]
    df = numbers(spark, values).cache()
    built_in = df.agg(
        F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY d)"), F.percentile("d", q)
    ).first()
    assert one(exact_quantile(df, "d", q)) == built_in[0] == brute.discrete(values, q)
    assert one(exact_quantile(df, "d", q)) == df.approxQuantile("d", [q], 0)[0]
    assert one(interpolated_quantile(df, "d", q)) == pytest.approx(built_in[1])


def test_fractional_values(spark):
    df = spark.createDataFrame([(x / 8,) for x in range(-40, 41)], "d double")
    assert one(exact_quantile(df, "d", 0.5)) == 0.0
    assert one(interpolated_quantile(df, "d", 0.25)) == -2.5


@pytest.mark.parametrize(
    "column", ["id / 200000D", "id * 1000000", "-(id * id)", "IF(id = 7, 1000000000000000, id)", "1e300D * id"]
)
def test_any_range_of_values_is_spread_over_bins(spark, column):
    """The window over values sees the rows of one bin, and that over bins a bounded number."""
    df = spark.range(200_000).selectExpr(f"{column} AS d")
    values = histogram(df, "d")
    found = at_ranks(values, discrete_rank(0.9), whole=True).collect()
    assert len(found) == 1
    assert found[0].value == brute.discrete([r.d for r in df.collect()], 0.9)
    sizes = values.where("value <> 0 AND abs(value) > 1e-300").selectExpr(f"{BIN_OF} AS b").groupBy("b").count()
    most, bins = sizes.agg(F.max("count"), F.count("*")).first()
    assert (most or 0) <= 200 and bins <= 20 * BINS


@pytest.mark.parametrize("column", ["-5 - id / 1e12D", "1000000000000 + id", "id % 3"])
def test_a_crowded_bin_is_cut_into_parts(spark, column, monkeypatch):
    """All values agree in their bin, or nearly; the parts of it are gone through one after the other."""
    monkeypatch.setattr(quantiles, "IN_BIN", 100)
    df = spark.range(0, 20_000, 1, 2).selectExpr(f"{column} AS d")
    values = sorted(r.d for r in df.collect())
    counted = histogram(df, "d").selectExpr("value", "n", "2 * n AS more")
    row = at_ranks(counted, discrete_rank(0.31), ("n", "more")).first()
    below = sum(v < row.value for v in values)
    assert (row.value, row.n_below, row.n_total) == (brute.discrete(values, 0.31), below, 20_000)
    assert (row.more_below, row.more_total) == (2 * below, 40_000)
    assert one(interpolated_quantile(df, "d", 0.9)) == pytest.approx(df.agg(F.percentile("d", 0.9)).first()[0])


def test_bins_rise_with_the_value(spark):
    rng = random.Random(5)
    near = [2.0**e * (1 + d) for e in range(-60, 61) for d in (-2**-52, 0, 2**-52, 2**-12, rng.random())]
    values = [*near, *(-v for v in near), 0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "value double")
    rows = df.selectExpr("value", f"{BIN_OF} AS b", f"{PART_OF} AS p").orderBy("value").collect()
    assert [(r.b, r.p) for r in rows] == sorted((r.b, r.p) for r in rows)


def test_rank_error_of_the_sketch(spark):
    rng = random.Random(3)
    values = sorted(rng.randrange(10**6) for _ in range(20_000))
    df = numbers(spark, values).repartition(8)
    for error in (0.01, 0.001):
        found = one(quantile_of(df, "d", 0.9, error))
        rank = sum(v <= found for v in values)
        assert abs(rank - 0.9 * len(values)) <= error * len(values) + 1
    assert one(quantile_of(df, "d", 0.9, 0)) == brute.discrete(values, 0.9)


def test_bad_arguments(spark):
    df = numbers(spark, [1])
    for call in (
        lambda: exact_quantile(df, "d", 1.1),
        lambda: interpolated_quantile(df, "d", -0.1),
        lambda: quantile_of(df, "d", 0.9, 1.5),
    ):
        with pytest.raises(ValueError):
            call()


def sessions(spark, durations):
    rows = [(f"u{i % 7}", i, d) for i, d in enumerate(durations)]
    return spark.createDataFrame(rows, "userid string, session_id bigint, session_duration bigint")


def test_split_and_calibration(spark):
    even = sessions(spark, range(1000))
    assert tuple(session_split(even).first()) == (899, 101, 0.899, 0.101)
    off = calibration_report(even).first()
    assert off.deviation == pytest.approx(0.001)
    assert calibration_report(even, tolerance=0.002).first().within_tolerance

    # 0.8 is used for the threshold and for the check alike.
    assert calibration_report(even, 0.8, tolerance=0.002).first().within_tolerance


def test_all_durations_equal(spark):
    row = summarize_sessions(sessions(spark, [0] * 50)).first()
    assert (row.total_short_sessions, row.total_long_sessions, row.long_session_threshold) == (0, 50, 0)
    assert row.users_with_long_session_count == row.total_users == 7
    assert not calibration_report(sessions(spark, [0] * 50)).first().within_tolerance


def test_no_sessions_are_not_calibrated(spark):
    row = calibration_report(sessions(spark, [])).first()
    assert row.short_session_ratio is None and row.within_tolerance is False
