from plain import quality_stats
from pyspark.sql import functions as F

from sessionlake.llm import quality_rules
from sessionlake.llm.common import table

ROWS = [
    (1, "a b c d e f g h " * 3),
    (2, "a b c d e f g h x a b c d e f g h"),
    (3, None),
    (4, ""),
    (5, "same line\n same line\nsame line\n\n \nother"),
    (6, "é ß 🙂 #*$ %&|<> a|b"),
    (7, "\t\x0b\x0c\r\n"),
    (8, "word " * 5000),
    (9, " ".join(f"w{i % 11}" for i in range(60))),
    (9, "no-break space is no separator"),
]
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_measures(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("quality", F.lit("mine"))
    got = quality_rules.judge_quality(rows).collect()
    assert sorted(tuple(r[c] for c in BASE) for r in got) == sorted(quality_stats(t) for _, t in ROWS)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_empty_table(spark):
    assert quality_rules.judge_quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_agrees_with_labels(spark):
    """The rules have seen no label. Texts that fail the base limits are not the method's doing."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    labels = table(spark, "/root/testdata/sf0.01", "labels").withColumnRenamed("quality", "label")
    judged = quality_rules.judge_quality(docs, drop=("text",)).where("NOT base_failed").join(labels, "doc_id")
    n = {(r.label, r.kept): r["count"] for r in judged.groupBy("label", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[1, True]
    assert n.get((0, True), 0) <= 0.1 * n[0, False]


def test_estimation_recovers_accuracies(spark):
    """Votes drawn from known accuracies, which the estimation gets near to."""
    import random

    draw = random.Random(1)
    names = list(quality_rules.RULES)
    rows = []
    for _ in range(4000):
        good = draw.random() < 0.7
        rows.append(
            tuple(
                quality_rules.GOOD
                if draw.random() < (0.95 if good else 0.4)
                else quality_rules.BAD
                if draw.random() < (0.2 if good else 0.9)
                else quality_rules.ABSTAIN
                for _ in names
            )
        )
    frame = spark.createDataFrame(rows, ", ".join(f"vote_{n} int" for n in names))
    patterns = frame.groupBy(*frame.columns).agg(F.count("*").alias("n"))
    found = quality_rules.estimate(patterns)
    assert abs(found["good"] - 0.7) < 0.03
    for name in names:
        assert abs(found["rules"][name][True][0] - 0.95) < 0.03
        assert abs(found["rules"][name][False][1] - 0.54) < 0.05
