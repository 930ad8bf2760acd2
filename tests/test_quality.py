import pytest

from sessionlake.operators import quality
from sessionlake.plans.long_sessions import prepare_plays
from sessionlake.sources.readers import PLAY_COLUMNS, parse_plays


pytestmark = pytest.mark.usefixtures("fixed_plans")


def plays(spark, users, columns=PLAY_COLUMNS):
    rows = [tuple(u if c == "userid" else "2009-01-01T00:00:00Z" for c in columns) for u in users]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


def profiles(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "`#id` string")


def test_schema(spark):
    good = quality.schema_report(parse_plays(plays(spark, ["a"])), PLAY_COLUMNS).first()
    assert tuple(good) == (True, True, 1, 0)
    text = quality.schema_report(plays(spark, ["a"]), PLAY_COLUMNS).first()
    assert text.columns_match and not text.time_is_timestamp
    for columns in (PLAY_COLUMNS[::-1], PLAY_COLUMNS[:-1], ["userid"]):
        assert not quality.schema_report(plays(spark, ["a"], columns), PLAY_COLUMNS).first()[0]


def test_equal_counts_of_different_users(spark):
    fact, dimension = plays(spark, ["a", "c", "c"]), profiles(spark, ["a", "b"])
    row = quality.user_coverage(fact, dimension).first()
    assert (row.fact_users, row.dimension_users, row.counts_match) == (2, 2, True)
    assert (row.fact_only, row.dimension_only, row.sets_match) == (1, 1, False)
    found = quality.orphans(fact, dimension).collect()
    assert sorted(map(tuple, found)) == [("b", "dimension"), ("c", "fact")]


def test_null_users_count_as_one(spark):
    fact = plays(spark, ["a", None, None])
    assert quality.distinct_users(fact).first().users == 2
    assert quality.expected_cardinality(fact, 2).first().matches
    assert not quality.expected_cardinality(fact, 1).first().matches
    row = quality.user_coverage(fact, profiles(spark, ["a", None])).first()
    assert row.counts_match and row.sets_match


def test_rejected_rows(spark):
    texts = ["bad", None, "2009-01-01T00:00:00Z", "2009-01-01 00:00:00", "2009-13-01T00:00:00Z",
             "2009-01-01T00:00:00+01", "2009-01-01T00:00:00.5Z", ""]
    raw = spark.createDataFrame([(t,) for t in texts], "timestamp string")
    assert tuple(quality.rejected_rows(raw).first()) == (8, 1, 6)


def test_strict_mode(spark):
    fact = plays(spark, ["a", "b"])
    assert prepare_plays(fact, profiles(spark, ["x", "y"])).schema["timestamp"].dataType.typeName() == "timestamp"
    with pytest.raises(quality.QualityError, match="counts_match"):
        prepare_plays(fact, profiles(spark, ["a"]))
    prepare_plays(fact, profiles(spark, ["a"]), strict=False)
    with pytest.raises(quality.QualityError, match="columns"):
        prepare_plays(plays(spark, ["a"], PLAY_COLUMNS[::-1]), profiles(spark, ["a"]))
    empty = quality.distinct_users(fact).where("users < 0")
    with pytest.raises(quality.QualityError, match="empty"):
        quality.enforce(empty, "users")
