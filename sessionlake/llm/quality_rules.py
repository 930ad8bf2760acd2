"""Quality rules under weak supervision.

Each rule votes a text good, votes it bad, or abstains. No rule decides alone: how often
each rule votes which way on good and on bad texts is estimated by expectation-maximisation
from the votes of all texts, without labels, and a text is kept if the posterior probability
that it is good is at least a half. Texts that fail the base limits go in any case.

The votes of a text are one of at most 3 ** (number of rules) patterns, so the estimation
runs on a table of pattern counts that stays small whatever the corpus; only the parameters,
a few numbers per rule, pass through the driver between rounds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.common import WORD, beside, restored, text_of, words
from sessionlake.session import freeze

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
#: Rounds at most, and the change of a parameter below which no more are needed.
ROUNDS = 25
SETTLED = 1e-4

ABSTAIN, GOOD, BAD = 0, 1, 2

#: name: (measure, good at or below, bad above). Between the two the rule abstains.
RULES = {
    "symbols": ("n_symbols / n_words", 0.02, 0.1),
    "exclamations": ("n_exclamations / n_words", 0.05, 0.2),
    "capitals": ("n_capitals / word_chars", 0.15, 0.3),
    "marks": ("n_marks / n_words", 0.05, 0.2),
    "bare_words": ("n_bare_words / n_words", 0.05, 0.2),
    "letters": ("1 - n_letters / word_chars", 0.08, 0.12),
    "repeated_words": ("n_repeat_words / n_words", 0.05, 0.2),
    "repeated_lines": ("n_dup_lines / n_lines", 0.1, 0.3),
    "same_words": ("1 - n_distinct_words / n_words", 0.7, 0.85),
    "word_length": ("word_chars / n_words", 10.0, 14.0),
}

#: What the estimation starts from, and how many imagined texts keep it near there: the
#: share of good texts, and a rule's votes (good, bad, abstain) on good and on bad texts.
START_GOOD = 0.85
START = {True: (0.93, 0.01, 0.06), False: (0.62, 0.25, 0.13)}
PRIOR_TEXTS = 20.0

STATS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_exclamations",
    "n_capitals",
    "n_marks",
    "n_letters",
    "n_bare_words",
    "n_distinct_words",
)


#: Runs of two or more marks, and words of marks only.
MARKS = r"[^\x20\x09-\x0D\p{L}\p{N}]{2,}"
BARE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}\p{N}]+(?![^\x20\x09-\x0D])"


def _count(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` as ``row``, with the measures of the whole text. A null text counts as empty.

    A word is repeated if it lies in a window of eight words that the text has twice or
    more. Windows are compared by 64-bit hashes. The helper columns are projected step by
    step, since a lambda evaluates anything but a column anew for each element.
    """
    content = F.col("content")
    spread = F.length(content) - F.length(F.regexp_replace(content, WORD, ""))
    n = F.size("_w")
    repeated = F.size(F.array_distinct("_h")) < F.size("_h")
    nothing = F.expr("cast(array() as array<struct<hash:bigint,at:int>>)")
    pairs = F.arrays_zip(F.col("_h").alias("hash"), F.sequence(F.lit(1), F.size("_h")).alias("at"))
    starts = F.filter(
        F.transform(
            "_s",
            lambda x, i: F.when(
                (x["hash"] == F.get("_s", i - 1)["hash"]) | (x["hash"] == F.get("_s", i + 1)["hash"]), x["at"]
            ),
        ),
        lambda at: at.isNotNull(),
    )
    covered = F.aggregate(
        F.transform("_p", lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", i + 1) - at, F.lit(WINDOW)))),
        F.lit(0),
        lambda total, size: total + size,
    )
    helpers = ["content", "_w", "_l", "_h", "_s", "_p"]
    return (
        beside(docs, content=text_of(text)).withColumns({"_w": words(content), "_l": F.filter(F.split(content, "\n"), lambda x: x.rlike(WORD))})
        .withColumn(
            "_h",
            F.when(
                n >= WINDOW,
                F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, WINDOW))),
            ).otherwise(F.expr("cast(array() as array<bigint>)")),
        )
        .withColumn("_s", F.when(repeated, F.sort_array(pairs)).otherwise(nothing))
        .withColumn("_p", F.sort_array(starts))
        .withColumns(
            {
                "n_words": n.cast("long"),
                "word_chars": spread.cast("long"),
                "n_symbols": (F.length(content) - F.length(F.translate(content, "#*$%&|<>", ""))).cast("long"),
                "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
                "n_repeat_words": covered.cast("long"),
                "n_lines": F.size("_l").cast("long"),
                "n_exclamations": (F.length(content) - F.length(F.translate(content, "!", ""))).cast("long"),
                "n_capitals": _count(content, r"\p{Lu}+"),
                "n_letters": _count(content, r"\p{L}+"),
                "n_marks": F.regexp_count(content, F.lit(MARKS)).cast("long"),
                "n_bare_words": F.regexp_count(content, F.lit(BARE)).cast("long"),
                "n_distinct_words": F.size(F.array_distinct("_w")).cast("long"),
            }
        )
        .drop(*helpers)
    )


def base_failed() -> Column:
    few = F.col("n_words") < LEAST_WORDS
    return few | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def votes() -> list[Column]:
    """One small integer per rule. A text without words gets abstentions only."""
    cast = []
    for name, (measure, good, bad) in RULES.items():
        value = F.expr(measure.replace("/", "/ nullif(") + ", 0)" if "/" in measure else measure)
        cast.append(
            F.when(value <= good, GOOD).when(value > bad, BAD).otherwise(ABSTAIN).cast("int").alias(f"vote_{name}")
        )
    return cast


def _start() -> dict:
    return {"good": START_GOOD, "rules": {name: {side: START[side] for side in START} for name in RULES}}


def posterior(parameters: dict) -> str:
    """SQL for the probability that a text is good, given its votes.

    An abstention tells something too.
    """
    terms = [repr(math.log(parameters["good"] / (1 - parameters["good"])))]
    for name in RULES:
        good, bad = (parameters["rules"][name][side] for side in (True, False))
        yes, no, none = (repr(math.log(g / b)) for g, b in zip(good, bad))
        terms.append(f"CASE vote_{name} WHEN {GOOD} THEN {yes}D WHEN {BAD} THEN {no}D ELSE {none}D END")
    return f"1 / (1 + exp(-({terms[0]}D + {' + '.join(terms[1:])})))"


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> dict:
    """Parameters after up to ``rounds`` of expectation-maximisation over a table of vote patterns.

    ``patterns`` has a vote column per rule and ``n``. Without any text the start remains.
    """
    parameters = _start()
    sums = ["sum(n * p) AS good", "sum(n * (1 - p)) AS bad"] + [
        f"sum(IF(vote_{name} = {vote}, n * {share}, 0D)) AS {side}_{name}_{vote}"
        for name in RULES
        for vote in (GOOD, BAD)
        for side, share in (("good", "p"), ("bad", "(1 - p)"))
    ]
    for _ in range(rounds):
        earlier = parameters
        row = patterns.selectExpr("*", f"{posterior(parameters)} AS p").selectExpr(*sums).first()
        if row["good"] is None:
            break
        mass = {True: row["good"], False: row["bad"]}
        parameters = {
            "good": (mass[True] + PRIOR_TEXTS * START_GOOD) / (mass[True] + mass[False] + PRIOR_TEXTS),
            "rules": {},
        }
        for name in RULES:
            parameters["rules"][name] = {}
            for side, label in ((True, "good"), (False, "bad")):
                whole = mass[side] + PRIOR_TEXTS
                yes, no = (
                    (row[f"{label}_{name}_{vote}"] + PRIOR_TEXTS * START[side][at]) / whole
                    for at, vote in enumerate((GOOD, BAD))
                )
                parameters["rules"][name][side] = (yes, no, max(1 - yes - no, 1e-9))
        moves = [abs(parameters["good"] - earlier["good"])] + [
            abs(a - b)
            for name in RULES
            for side in (True, False)
            for a, b in zip(parameters["rules"][name][side], earlier["rules"][name][side])
        ]
        if max(moves) < SETTLED:
            break
    return parameters


def judge_quality(docs: DataFrame, text: str = "text", drop: tuple[str, ...] = (), rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with measures, votes, ``base_failed``, ``quality`` and ``kept``.

    The columns named in ``drop`` are not carried on, columns with the names of new ones are
    replaced. Repeated rows are judged alike and all kept in the result; a null text has no
    words and fails the base limits. Measures are written once to the shared folder, so texts
    are measured once.
    """
    measured = with_stats(docs, text).select("*", *votes(), base_failed().alias("base_failed"))
    measured = freeze(measured.withColumn("row", F.col("row").dropFields(*drop)) if drop else measured)
    patterns = freeze(
        measured.where(~F.col("base_failed")).groupBy(*(f"vote_{name}" for name in RULES)).agg(F.count("*").alias("n"))
    )
    parameters = estimate(patterns, rounds)
    judged = measured.withColumn("quality", F.expr(posterior(parameters))).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)
    )
    return restored(judged, *STATS, *(f"vote_{name}" for name in RULES), "base_failed", "quality", "kept")
