"""Readers, writers and the two jobs, on files."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

import brute
from sessionlake.operators import quality, sampling
from sessionlake.operators.quality import QualityError
from sessionlake.operators.sampling import first_n_per_user
from sessionlake.plans.long_sessions import prepare_plays, run_job, sample_job
from sessionlake.session import fresh_path, freeze
from sessionlake.sources import readers, sinks
from test_sessions import E1, EPOCH, log, random_plays, timeline

pytestmark = pytest.mark.usefixtures("fixed_plans")

ODD = 'u1\t2009-01-01T00:00:00Z\ta\t"Weird\tb\tT1\nu2\t2009-01-01T00:00:00Z\n'


@pytest.fixture
def folder(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    write.path = tmp_path
    return write


def lines(rows):
    return "".join("\t".join([*row, "a", "an", "t", "tn"]) + "\n" for row in rows)


def test_quotes_and_short_lines(spark, folder):
    path = folder("odd.tsv", ODD)
    quoted = sorted(map(tuple, readers.read_play_log(spark, path).collect()))
    assert quoted[0][2:] == ("a", "Weird\tb\tT1", None, None)
    assert quoted[1] == ("u2", "2009-01-01T00:00:00Z", None, None, None, None)
    plain = sorted(map(tuple, readers.read_play_log(spark, path, quote="").collect()))
    assert plain[0][2:] == ("a", '"Weird', "b", "T1")
    assert plain[1] == quoted[1]
    positional = readers.read_positional(spark, path, quote="")
    assert positional.columns == readers.PLAY_COLUMNS
    assert sorted(map(tuple, positional.collect())) == plain


def test_schema_file(spark, folder):
    path = folder("schema.json", readers.PLAY_SCHEMA.json())
    assert readers.schema_from_json(spark, path) == readers.PLAY_SCHEMA
    assert all(f.nullable and f.dataType.typeName() == "string" for f in readers.PLAY_SCHEMA)


def test_named_datasets(spark, folder):
    path = folder("profiles.tsv", "#id\tgender\tage\nuser_1\tm\t\nuser_2\t\t30\n")
    profiles = readers.load(spark, "userid_profiles", path)
    assert profiles.columns == ["#id", "gender", "age"]
    assert sorted(map(tuple, profiles.collect())) == [("user_1", "m", None), ("user_2", None, "30")]
    assert readers.load(spark, "track_sessions", folder("log.tsv", lines(E1))).count() == len(E1)
    with pytest.raises(KeyError, match="track_sessions"):
        readers.load(spark, "unknown", path)


def test_summary_sink_replaces(spark, tmp_path):
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        for value in (1, 2):
            frame = spark.createDataFrame([(value, 0.5, None)], "n bigint, share double, t double")
            assert sinks.write_summary(frame, path, fmt).collect() == frame.collect()
    with pytest.raises(ValueError):
        sinks.write_summary(frame, path, "xlsx")


def test_job(spark, folder):
    log_file = folder("log.tsv", lines(E1))
    users = folder("users.tsv", "#id\tx\nA\t1\nB\t2\nC\t3\n")
    result = str(folder.path / "result")
    # Four sessions cannot be cut at nine tenths.
    with pytest.raises(QualityError, match="within_tolerance"):
        run_job(spark, log_file, users, result)
    assert not (folder.path / "result").exists()
    row = run_job(spark, log_file, users, result, strict=False).first()
    assert tuple(row) == (1, 3, 1 / 3, 900.0, 3, 1, 0.25)
    # Three quarters of them are short at quantile 0.75.
    assert run_job(spark, log_file, users, result, quantile=0.7500001).first() == row
    assert spark.read.parquet(result).first() == row
    few = folder("few.tsv", "#id\tx\nA\t1\n")
    with pytest.raises(QualityError, match="counts_match"):
        run_job(spark, log_file, few, result)


def test_wrong_profiles_leave_no_result(spark, folder):
    log_file, result = folder("log.tsv", lines(E1)), str(folder.path / "none")
    nobody = folder("users.tsv", "#id\tx\nnobody\t1\n")
    with pytest.raises(QualityError, match="counts_match"):
        run_job(spark, log_file, nobody, result, quantile=0.7500001)
    assert not (folder.path / "none").exists()


def test_job_options(spark, folder):
    log_file = folder("log.tsv", ODD + "u3\t\ta\tb\tc\td\n")
    users = folder("users.tsv", "#id\tx\nA\t1\n")
    for untimed, total in ((False, 3), (True, 2)):
        row = run_job(
            spark, log_file, users, str(folder.path / "r"), strict=False, quote="", drop_null_ts=untimed, error=0.01
        ).first()
        assert row.total_users == total


@pytest.mark.parametrize("n", [1, 30, 150, 5000])
@pytest.mark.parametrize("as_text", [False, True])
def test_any_n_matches_plain_python(spark, n, as_text, monkeypatch):
    """By counts of hours and seconds, whatever n is; with ties, untimed plays and a null user."""
    monkeypatch.setattr(sampling, "LIMIT_SETTING", "sessionlake.none")
    plays = [(u, t, i) for i, (u, t) in enumerate(random_plays(81, plays=2400) + [("u0", 5 * 10**12)] * 200)]
    rows = [(u, None if t is None else EPOCH + timedelta(microseconds=t), i) for u, t, i in plays]
    frame = spark.createDataFrame(rows, "userid string, timestamp timestamp_ntz, _order int").repartition(5)
    if as_text:
        frame = frame.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    spark.conf.set("sessionlake.none", "0")
    try:
        found = first_n_per_user(frame, n, tie_breakers=("_order",))
        assert found.columns == frame.columns
        kept = sorted(r["_order"] for r in found.collect())
    finally:
        spark.conf.unset("sessionlake.none")
    want = []
    for user in {u for u, _, _ in plays}:
        own = sorted((brute.order_key(t), i) for u, t, i in plays if u == user)
        want += [i for _, i in own[:n]]
    assert kept == sorted(want)


def test_malformed_lines(spark, folder):
    path = folder("odd.tsv", ODD + lines(E1) + "u\t2009-01-01T00:00:00Z\ta\tb\tc\td\te\n")
    options = {"malformed": readers.MALFORMED, "quote": ""}
    log_rows = readers.load(spark, "track_sessions", path, **options)
    assert tuple(quality.malformed_lines(log_rows).first()) == (len(E1) + 3, 2, 0)
    assert sorted(r[0] for r in log_rows.select(readers.MALFORMED, "userid").dropna().collect()) == [
        "u\t2009-01-01T00:00:00Z\ta\tb\tc\td\te",
        "u2\t2009-01-01T00:00:00Z",
    ]
    # The rows are those that come without the column.
    assert sorted(map(str, log_rows.drop(readers.MALFORMED).collect())) == sorted(
        map(str, readers.read_play_log(spark, path, quote="").collect())
    )


def test_strict_jobs_notice_malformed_lines(spark, folder):
    rows = [(f"u{i % 7}", f"2009-01-{1 + i % 28:02d}T00:{i % 60:02d}:00Z") for i in range(40)]
    users = folder("users.tsv", "#id\tx\n" + "".join(f"u{i}\t1\n" for i in range(7)))
    result = folder.path / "result"
    five = folder("five.tsv", "".join("\t".join([*r, "a", "b", "c"]) + "\n" for r in rows))
    for path, count in ((five, 40), (folder("one.tsv", lines(rows) + "u1\t2009-01-01T00:00:00Z\n"), 1)):
        with pytest.raises(QualityError, match=f"^{count} lines"):
            run_job(spark, path, users, str(result))
        raw = readers.load(spark, "track_sessions", path, malformed=readers.MALFORMED)
        with pytest.raises(QualityError, match=f"^{count} lines"):
            prepare_plays(raw, readers.load(spark, "userid_profiles", users))
        assert prepare_plays(raw, raw, strict=False).columns == readers.PLAY_COLUMNS
    assert not result.exists()
    fine = readers.load(spark, "track_sessions", folder("fine.tsv", lines(rows)), malformed=readers.MALFORMED)
    plays = prepare_plays(fine, readers.load(spark, "userid_profiles", users))
    assert plays.columns == readers.PLAY_COLUMNS and plays.count() == 40
    # What comes back was written on the only reading of the log.
    assert not any("fine.tsv" in f for f in plays.inputFiles())


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_a_failing_write_leaves_the_result(spark, tmp_path, fmt):
    path = str(tmp_path / "result")
    frame = spark.createDataFrame([(1,), (2,)], "n bigint")
    sinks.write_summary(frame.limit(1), path, fmt)
    broken = frame.repartition(2).selectExpr("n div (n - 2) AS n")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|zero"):
        sinks.write_summary(broken, path, fmt)
    assert [r.n for r in spark.read.schema("n bigint").options(header=True).format(fmt).load(path).collect()] == [1]
    sinks.write_summary(frame, path, fmt)
    assert spark.read.schema("n bigint").options(header=True).format(fmt).load(path).count() == 2
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["result"]


def test_sample_job(spark, folder):
    rows = [(u, f"2009-01-01T00:{m:02d}:00Z") for u in "ab" for m in range(50)] + [("c", "2009-01-01T00:00:00Z")]
    sample = sample_job(spark, folder("log.tsv", lines(rows[::-1])), str(folder.path / "sample"))
    assert sample.columns == readers.PLAY_COLUMNS
    kept = sorted((r.userid, r.timestamp) for r in sample.collect())
    assert kept == sorted(r for r in rows if int(r[1][14:16]) < 30)
    headers = [
        p.read_text().splitlines()[0] for p in (folder.path / "sample").glob("part-*") if p.stat().st_size
    ]
    assert headers and set(headers) == {"\t".join(readers.PLAY_COLUMNS)}


@pytest.mark.parametrize("parts", [1, 9, 80])
def test_first_n_matches_plain_python(spark, parts):
    plays = [(u, t) for u, t in random_plays(61, plays=800)]
    frame = timeline(spark, plays, parts)
    expected = []
    for user in {u for u, _ in plays}:
        own = sorted((t for u, t in plays if u == user), key=brute.order_key)
        expected += [(user, t) for t in own[:5]]
    found = first_n_per_user(frame, 5).collect()
    micros = [
        (r.userid, None if r.timestamp is None else round((r.timestamp - EPOCH).total_seconds() * 1e6))
        for r in found
    ]
    assert sorted(micros, key=repr) == sorted(expected, key=repr)


def test_ties_in_the_sample(spark):
    frame = log(spark, [("a", "t1"), ("a", "t1"), ("a", "t0")]).selectExpr(
        "*", "row_number() over (order by timestamp) as play"
    )
    kept = first_n_per_user(frame, 2, tie_breakers=("play",)).collect()
    assert sorted((r.timestamp, r.play) for r in kept) == [("t0", 1), ("t1", 2)]


def test_shared_folder(spark):
    path = fresh_path(spark, "x")
    assert path != fresh_path(spark, "x")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir", None) or "/tmp")
    frozen = freeze(spark.range(10))
    assert frozen.dtypes == spark.range(1).dtypes
    assert frozen.count() == 10
