"""Ranked search against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sessionlake.llm import lexical_search as lexical

PATTERN = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def plain_terms(text):
    return re.findall(PATTERN, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, best):
    """(item, rank, id, score)."""
    held = [(id, Counter(plain_terms(text))) for id, text in docs]
    held = [(id, c) for id, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    found = []
    for item, text in items:
        scores = []
        for id, c in held:
            m = 100 - 50 + 50 * sum(c.values()) * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
                for t in set(plain_terms(text))
                if t in c
            )
            if score > 0:
                scores.append((-score, id is None, id or 0, id))
        ranked = sorted(scores, key=lambda s: s[:3])[:best]
        found += [(item, rank, id, -score) for rank, (score, _, _, id) in enumerate(ranked, 1)]
    return sorted(found, key=repr)


def some(seed, n, most=60):
    rng = np.random.default_rng(seed)
    vocabulary = ["the", "The", "a", "ÉTÉ", "été", "x", "don", "t", "12", "b4", "東京", "q_r"] + [f"w{i}" for i in range(80)]
    weight = 1 / np.arange(1, len(vocabulary) + 1)
    return [
        "-., \n\x00"[i % 6].join(rng.choice(vocabulary, rng.integers(0, most), p=weight / weight.sum())) for i in range(n)
    ]


def found(spark, docs, items, best, partitions=3):
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(partitions))
    rows = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), best).collect()
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("leaf,step,shard,best", [(64, 4, 16_000_000, 50), (1, 1, 500, 3), (3, 2, 2_000, 10)])
def test_as_plain(spark, monkeypatch, leaf, step, shard, best):
    """Ties, copies, repeated and null ids, texts without terms, very long ones, unknown terms."""
    texts = some(1, 150)
    docs = list(enumerate(texts)) + [(1000 - i, texts[i]) for i in range(60)] + [(7, texts[7]), (None, texts[7])]
    docs += [(500, None), (501, " -.,"), (502, "the w1 " * 5000)]
    items = list(enumerate(some(2, 12, 20))) + [(3, "the x été"), (None, "12 b4 12"), (90, None), (91, ""), (92, "zzz")]
    for name, value in (("LEAF", leaf), ("STEP", step), ("SHARD", shard), ("AT_ONCE", 300), ("WIDTH", 50)):
        monkeypatch.setattr(lexical, name, value)
    index = lexical._shards(iter([batch(docs)]))
    shards = [{c: b.column(c)[0] for c in b.schema.names} for b in index]
    assert len(shards) > (2 if shard < 16_000_000 else 0)
    vocabulary = sorted({t for _, text in items for t in plain_terms(text)})
    place = {t: i for i, t in enumerate(vocabulary)}
    documents, occurrences = (sum(s[c].as_py() for s in shards) for c in ("documents", "occurrences"))
    rows = [
        {c: v.values if c in ("ids", "terms") else v.as_py() for c, v in s.items()} for s in shards
    ]
    lists = [lexical.Shard(r, pa.array(vocabulary), documents, occurrences) for r in rows]
    df = sum(np.diff(s.starts) for s in lists)
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()])
    sets = [np.array([place[t] for t in sorted(set(plain_terms(text)))], int) for _, text in items]
    search = lexical.Search(sets, weights, best)
    for s in lists:
        search.look_in(s)
    got, seen = [], Counter()
    for item, score, id, no_id in zip(*search.kept):
        seen[item] += 1
        got.append((items[item][0], seen[item], None if no_id else int(id), int(score)))
    assert sorted(got, key=repr) == plain(docs, items, best)


def batch(docs):
    ids, texts = zip(*docs)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([t or "" for t in texts])], ["id", "text"])


def test_in_spark(spark, monkeypatch):
    texts = some(3, 90)
    docs = list(enumerate(texts)) + [(i, texts[0]) for i in range(200, 260)] + [(None, texts[1]), (4, texts[4])]
    items = list(enumerate(some(4, 9, 25))) + [(3, "the x été"), (None, "12 b4"), (90, None)]
    want = plain(docs, items, 8)
    assert found(spark, docs, items, 8) == want
    monkeypatch.setattr(lexical, "QUERIES", 40)
    spark.conf.set("spark.sql.shuffle.partitions", "70")
    try:
        assert found(spark, docs, items, 8, 11) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_pruning():
    """A common term alone is not worth looking at where a rare one decides."""
    docs = [(i, "common " * (i % 5 + 1) + ("rare" if i % 100 == 0 else f"w{i}")) for i in range(4000)]
    row = next(lexical._shards(iter([batch(docs)])))
    values = {c: row.column(c)[0].values if c in ("ids", "terms") else row.column(c)[0].as_py() for c in row.schema.names}
    shard = lexical.Shard(values, pa.array(["common", "rare"]), 4000, 16_000)
    search = lexical.Search([np.arange(2)], np.array([1, 4000]), 5)
    search.look_in(shard)
    assert search.kept[2].tolist() == [0, 100, 200, 300, 400]
    assert search.scored + search.looked < 400


def test_odd_tables(spark):
    """No rows on either side, columns with the names of results, ids of another type."""
    docs = spark.createDataFrame([(1, "a b", 5), (2, "b", 6)], "doc_id long, text string, score int")
    items = spark.createDataFrame([("x", "B", 1)], "item_id string, text string, rank int")
    index = lexical.build_index(docs)
    got = lexical.search(index, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert [(r.item_id, r["rank"], r.doc_id) for r in got.collect()] == [("x", 1, 2), ("x", 2, 1)]
    assert lexical.search(index, items.limit(0)).count() == 0
    assert lexical.search(lexical.build_index(docs.limit(0)), items).count() == 0
