import math
import random
from itertools import combinations

from plain import best_stretch, tokens
from pyspark.sql import functions as F

from sessionlake.llm import decontaminate

DRAW = random.Random(2)


def sentence(n):
    return [DRAW.choice("bcdfgklmnprst") + DRAW.choice("aeiou") + DRAW.choice("bdfgk") + str(DRAW.randrange(30)) for _ in range(n)]


ITEMS = {0: sentence(30), 1: sentence(12), 2: sentence(5), 3: sentence(45), 4: [], 5: sentence(10), 6: sentence(1)}


def changed(words, every, offset=0):
    return [w if (i + offset) % every else "Other" for i, w in enumerate(words)]


def docs():
    clean = lambda n: sentence(n)
    found = [
        clean(40) + ITEMS[0] + clean(9),
        ITEMS[0],
        clean(20) + changed(ITEMS[0], 5, 2) + clean(3),
        clean(20) + changed(ITEMS[3], 5, 4),
        clean(20) + changed(ITEMS[0], 2) + clean(3),
        clean(11) + ITEMS[3][:30],
        clean(11) + ITEMS[3][:20],
        clean(4) + ITEMS[1] + ITEMS[2] + ITEMS[5],
        clean(30) + changed(ITEMS[2], 3),
        clean(3000) + ITEMS[3] * 3,
        clean(500),
        ITEMS[6],
        [],
    ]
    return {i: ", ".join(w.upper() if i % 2 else w for w in words) for i, words in enumerate(found)} | {99: None}


def frames(spark, texts, items):
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("found", F.lit(1))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(50, None)], "item_id long, text string")
    return rows, bench


def expected(texts, items):
    found = set()
    for d, text in texts.items():
        for i, item in items.items():
            score = best_stretch(tokens(text), tokens(" ".join(item))) if item else 0
            if item and score >= max(-(-6 * len(item) // 10), min(decontaminate.LEAST, len(item))):
                found.add((d, i, score))
    return found


def test_equals_brute_force(spark, monkeypatch):
    texts = docs()
    for limit in (decontaminate.BROADCAST_WORDS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", limit)
        rows, bench = frames(spark, texts, ITEMS)
        got = {(r.doc_id, r.item_id, r.matched) for r in decontaminate.overlaps(rows, bench).collect()}
        assert got == expected(texts, ITEMS)
        assert {d for d, _, _ in got} == {0, 1, 2, 3, 5, 7, 9, 11}


def test_clean_documents_stay(spark):
    rows, bench = frames(spark, docs(), ITEMS)
    kept = decontaminate.without_overlaps(rows, bench)
    assert kept.columns == ["doc_id", "text", "found"]
    assert {r.doc_id for r in kept.collect()} == {4, 6, 8, 10, 12, 99}


def test_odd_tables(spark):
    rows, bench = frames(spark, docs(), {})
    assert decontaminate.overlaps(rows, bench).isEmpty()
    assert decontaminate.overlaps(rows.limit(0), frames(spark, docs(), ITEMS)[1]).isEmpty()
    ids = spark.createDataFrame([(None, " ".join(ITEMS[0])), (None, "clean"), (1, "clean")], "doc_id long, text string")
    kept = decontaminate.without_overlaps(ids, frames(spark, docs(), ITEMS)[1])
    assert [r.doc_id for r in kept.collect()] == [1]


def best_alignment(words, item):
    """Smith and Waterman: an equal word counts one, every edit takes one away."""
    above, best = [0] * (len(item) + 1), 0
    for word in words:
        row = [0]
        for j, other in enumerate(item):
            row.append(max(0, above[j] + (1 if word == other else -1), above[j + 1] - 1, row[j] - 1))
        above, best = row, max(best, *row)
    return best


def found(spark, texts, items):
    rows, bench = frames(spark, {i: " ".join(t) for i, t in texts.items()}, items)
    return {(r.doc_id, r.item_id): r.matched for r in decontaminate.overlaps(rows, bench).collect()}


def edited(item, *inserted, missing=()):
    """The item with a word before each place of ``inserted`` and without the ``missing`` ones."""
    words = [[*(["added"] if i in inserted else []), *([] if i in missing else [w])] for i, w in enumerate(item)]
    return [w for part in words for w in part]


def test_added_and_missing_words(spark, monkeypatch):
    items = {0: sentence(40), 1: sentence(30)}
    texts = {
        0: sentence(50) + edited(items[0], 20) + sentence(9),
        1: edited(items[0], missing=[20]),
        2: sentence(9) + edited(items[1], 10, 20) + sentence(5),
        3: edited(items[1], 11, missing=[19]),
        4: sentence(100) + edited(items[0], 8, 16, 24, 32) + sentence(700),
        5: items[0][:15] + sentence(60) + items[0][15:30],
    }
    want = {(0, 0): 39, (1, 0): 38, (2, 1): 28, (3, 1): 27, (4, 0): 36}
    for limit in (decontaminate.BROADCAST_WORDS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", limit)
        assert found(spark, texts, items) == want


def test_long_quotations(spark):
    items = {0: sentence(45), 1: sentence(59), 2: sentence(200)}
    texts = {0: items[0][9:35], 1: sentence(40) + items[1][:34], 2: items[2][50:150], 3: items[2][:24]}
    assert found(spark, texts, items) == {(0, 0): 26, (1, 1): 34, (2, 2): 100}


def test_random_substitutions(spark):
    """Up to a fifth of the words, anywhere, against brute force."""
    items = {n: sentence(n) for n in range(8, 31)}
    texts = {}
    for n, item in items.items():
        for k in range(6):
            at = set(DRAW.sample(range(n), n // 5))
            texts[100 * n + k] = sentence(7) + ["other" if i in at else w for i, w in enumerate(item)] + sentence(5)
    texts[1] = [w if i % 4 < 3 else "other" for i, w in enumerate(items[15])]
    texts[2] = [w if i % 3 < 2 else "other" for i, w in enumerate(items[30])]
    scores = {(d, i): best_alignment(text, item) for d, text in texts.items() for i, item in items.items()}
    want = {(d, i): s for (d, i), s in scores.items() if s >= max(-(-6 * i // 10), decontaminate.LEAST)}
    assert want.keys() == {(d, d // 100) for d in texts if d > 2} | {(1, 15)}
    assert found(spark, texts, items) == want


def test_substitutions_cannot_hide_an_item_from_its_mask():
    """Against all ways to substitute words of short items; in longer ones more are needed than allowed."""
    for mask in decontaminate.MASKS:
        found = decontaminate.fewest(mask, 60)
        for n in range(1, 12):
            places = [{at + o for o in mask} for at in range(n - mask[-1])]
            hides = [k for k in range(n + 1) if any(all(p & set(c) for p in places) for c in combinations(range(n), k))]
            assert found[n] == min(hides)
    for share, least in ((0.6, 6), (0.8, 3), (0.4, 6)):
        numbers = decontaminate.mask_numbers(share, least)
        for n in range(1, 181):
            mask = decontaminate.MASKS[numbers[min(n, decontaminate.LONG)]]
            edits = (n - max(math.ceil(share * n), min(least, n))) // 2
            assert decontaminate.fewest(mask, n)[n] > edits
    numbers = decontaminate.mask_numbers(decontaminate.SHARE, decontaminate.LEAST)
    assert all(len(decontaminate.MASKS[k]) == 5 for k in numbers[22:])


def test_both_joins_give_equal_rows_and_columns(spark, monkeypatch):
    """Also for different texts of one id, repeated rows and items that share an id or a text."""
    texts = [*docs().items(), (0, " ".join(ITEMS[3])), (0, " ".join(ITEMS[3])), (None, " ".join(ITEMS[0])), (5, "clean")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    bench = [(i, " ".join(w)) for i, w in ITEMS.items()]
    bench = spark.createDataFrame([*bench, (60, bench[0][1]), (0, bench[1][1]), (None, bench[5][1])], "item_id long, text string")
    results = []
    for limit in (decontaminate.BROADCAST_WORDS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", limit)
        found = decontaminate.alignments(rows, bench)
        results.append((found.columns, sorted(map(str, found.collect()))))
    assert results[0] == results[1]
    assert len(results[0][1]) > 12


def test_a_very_long_item(spark, monkeypatch):
    items = {0: sentence(20_000), 1: sentence(30)}
    texts = {0: sentence(30) + items[0][9000:9040] + sentence(30), 1: sentence(400), 2: items[1]}
    for limit in (decontaminate.BROADCAST_WORDS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", limit)
        got = found(spark, texts, items)
        assert got.keys() == {(0, 0), (2, 1)}
        assert got[0, 0] == best_alignment(texts[0], items[0])
