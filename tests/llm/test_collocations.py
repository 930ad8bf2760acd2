"""Collocations against plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionlake.llm import collocations


def plain(rows, least, most, inside, best):
    """(group, rank, phrase, a, l, r, n, score) of (text, group) rows."""
    counts, totals = defaultdict(Counter), Counter()
    for text, group in rows:
        group = "und" if group is None else group
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            totals[group] += len(words)
            for k in range(1, most + 1):
                counts[group].update(zip(*(words[i:] for i in range(k))))
    found = []
    for group, count in counts.items():
        count = {p: a for p, a in count.items() if a >= least}
        longest = Counter()
        for p, a in count.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longest[p[i : i + k]] = max(longest[p[i : i + k]], a)
        scored = []
        for p, a in count.items():
            if len(p) > 1 and 100 * longest[p] < inside * a or len(p) > 1 and p not in longest:
                cuts = [(count[p[:k]], count[p[k:]], k) for k in range(1, len(p))]
                score, _, l, r = min((1_000_000 * a * a // (l * r), k, l, r) for l, r, k in cuts)
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:best], 1):
            found.append((group, rank, p.decode(), -a, l, r, totals[group], -score))
    return sorted(found)


def found(spark, rows, schema="text string, lang string", **options):
    docs = spark.createDataFrame(rows, schema)
    return sorted(map(tuple, collocations.collocations(docs, **options).collect()))


def some_rows(seed, n=120):
    rng = np.random.default_rng(seed)
    vocabulary = ["the", "The", "a", "ÉTÉ", "été", "x-y", "don't", "\x00", "of", "it", "was", "b"]
    weight = 1 / np.arange(1, len(vocabulary) + 1)
    joins = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", "\r\n", " ; ", " "]
    rows = []
    for i in range(n):
        words = rng.choice(vocabulary, rng.integers(0, 60), p=weight / weight.sum())
        text = "".join(w + joins[j] for w, j in zip(words, rng.integers(0, len(joins), len(words))))
        rows.append((text, [None, "und", "en", "", "a,b"][i % 5]))
    return rows + [(None, "en"), ("", None), (" ,;", "xx"), ("one two " * 40, "en")]


@pytest.mark.parametrize("options", [(10, 3, 50, 2000), (3, 4, 80, 7), (1, 2, 50, 5), (2, 3, 101, 40)])
def test_as_plain(spark, options):
    rows = some_rows(options[0])
    least, most, inside, best = options
    assert found(spark, rows, least=least, most=most, inside=inside, best=best) == plain(rows, *options)


def test_small_blocks_parts_and_filter(spark, monkeypatch):
    """Summaries that really have to drop keys, a crowded filter, texts in slices, many partitions."""
    rows = some_rows(5, 400)
    want = plain(rows, 10, 3, 50, 25)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(23)
    monkeypatch.setattr(collocations, "FILTER_BITS", 8)
    spark.conf.set("spark.sql.shuffle.partitions", "70")
    try:
        assert sorted(map(tuple, collocations.collocations(docs, best=25).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_slices():
    text = b"a b, c d. e f\ng " * 50
    old, collocations.BLOCK = collocations.BLOCK, 40
    try:
        slices = list(collocations._slices(text))
    finally:
        collocations.BLOCK = old
    assert len(slices) > 10
    whole, parts = collocations.Counted([text], ["x"], 3), collocations.Counted(slices, ["x"] * len(slices), 3)
    for a, b in zip(whole.phrases, parts.phrases):
        assert [x.tolist() for x in a] == [x.tolist() for x in b]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=60), max_size=8), st.integers(1, 12))
def test_summaries_keep_the_frequent(blocks, least):
    """Whatever the order and the blocks: every key with ``least`` occurrences survives."""
    exact = Counter(k for b in blocks for k in b)
    summary = collocations.MisraGries(sum(exact.values()) // least)
    for b in blocks:
        keys, counts = np.unique(np.array(b, np.uint32), return_counts=True)
        summary.merge(keys, counts)
        assert len(summary.keys) <= summary.capacity
    assert summary.taken < least
    kept = set(summary.at_least(least).tolist())
    assert {k for k, n in exact.items() if n >= least} <= kept <= set(exact)
    for key, n in zip(summary.keys.tolist(), summary.counts.tolist()):
        assert n <= exact[key] <= n + summary.taken


def test_scores_beyond_64_bits(spark):
    """The product of counts of a large corpus, and a quotient just below a whole number."""
    a, l, r = 9_999_999_999_989, 9_999_999_999_990, 9_999_999_999_999
    row = spark.sql(f"SELECT {a}L AS a, {l}L AS l, {r}L AS r").select(collocations._score("a", "l", "r")).first()
    assert row[0] == 1_000_000 * a * a // (l * r)
    row = spark.sql("SELECT 10L AS a, 10L AS l, 10L AS r").select(collocations._score("a", "l", "r")).first()
    assert row[0] == 1_000_000


def test_odd_tables(spark):
    rows = [("b c " * 12, "en", "x", 1), (None, None, "y", 2)] * 2
    got = found(spark, rows, "text string, lang string, phrase string, rank int")
    assert got == plain([(t, g) for t, g, _, _ in rows], 10, 3, 50, 2000)
    assert found(spark, [], "text string, lang string") == []
    assert collocations.collocations(spark.createDataFrame([], "body string, src int"), text="body", group="src").columns == [
        "src", "rank", "phrase", "a", "l", "r", "n", "score",
    ]
