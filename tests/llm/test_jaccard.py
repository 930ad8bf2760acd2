import random
import time

import numpy as np
import pyarrow as pa
import pytest
from plain import jaccard_classes

from sessionlake.llm import blocks, common, components, ngram_jaccard


def corpus(seed, groups=12, copies=9):
    """Texts in groups of near copies of all degrees, with exact copies and odd texts among them."""
    draw = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = [draw.choice("abcdefghijklmnopqrst") + str(draw.randrange(90)) for _ in range(draw.randrange(8, 90))]
        for _ in range(draw.randrange(1, copies)):
            words = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 6])):
                words[draw.randrange(len(words))] = f"new{draw.randrange(5)}"
            texts.append(draw.choice([" ", "\n", "\t "]).join(words))
            base = draw.choice([base, words])
    texts += ["", None, " \n", "one two", "One  two", "a b c", "É é", "é É", "x" * 50_000, "w " * 3000]
    return dict(enumerate(texts))


def check(spark, docs, n, num, den, **options):
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    got = ngram_jaccard.jaccard_join(frame, n, num, den, **options).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == jaccard_classes(docs, n, num, den)
    assert len(got) == len(docs)


@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 4, 5)])
def test_equals_brute_force(spark, n, num, den):
    check(spark, corpus(n), n, num, den)


def test_regions_are_split_by_pivots(spark):
    check(spark, corpus(3, groups=4, copies=40), 4, 85, 100, limit=6)


def test_regions_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "DEPTH", 0)
    check(spark, corpus(4, groups=3, copies=40), 4, 85, 100, limit=6)


def test_large_regions_of_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "SMALL", 2)
    monkeypatch.setattr(ngram_jaccard, "CHUNK", 300)
    check(spark, corpus(5, groups=5, copies=25), 4, 85, 100)


def test_no_pair_is_lost_where_parts_are_empty(spark, monkeypatch):
    """Few elements in many parts: the seeds run out, and empty parts count as parts."""
    monkeypatch.setattr(ngram_jaccard, "SEEDS", 2)
    draw = random.Random(8)
    docs = {}
    for g in range(20):
        base = [f"{g}w{draw.randrange(10**6)}" for _ in range(16)]
        for _ in range(4):
            docs[len(docs)] = " ".join(base[: draw.randrange(13, 17)])
    check(spark, docs, 4, 85, 100)


def test_empty_table_and_odd_ids(spark):
    assert ngram_jaccard.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, None), (9, "")]
    got = ngram_jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(
        [(None, 2, 7), (7, 2, 7), (7, 2, 7), (None, 0, None), (9, 0, 9)], key=str
    )


def test_one_of_each_group_stays(spark):
    docs = corpus(6)
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id long, text string, kept string")
    kept = ngram_jaccard.keep_one(frame, n=5, num=4, den=5)
    assert kept.columns == ["doc_id", "text", "kept"]
    assert {r.doc_id for r in kept.collect()} == {c for _, c, _ in jaccard_classes(docs, 5, 4, 5).values()}


def plain_components(edges):
    """By repeated minima over all edges."""
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    while True:
        before = dict(label)
        for x, y in edges:
            if x != y:
                label[x] = label[y] = min(label[x], label[y])
        if label == before:
            return label


@pytest.mark.parametrize("task", [10, 60, 10**6])
def test_components_equal_plain_ones_in_any_number_of_rounds(spark, task):
    """A chain, a hub, random edges, loops and repeated edges."""
    draw = random.Random(task)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1002, 1001), (5, 5), (7777, 7777), (5, 6)]
    edges += [(2000, 2001 + i) for i in range(200)]
    edges += [(3000 + draw.randrange(300), 3000 + draw.randrange(300)) for _ in range(140)]
    draw.shuffle(edges)
    found = components.components(spark.createDataFrame(edges, "a long, b long").repartition(6), task).collect()
    assert {r.node: r.component for r in found} == plain_components(edges)
    assert len(found) == len({r.node for r in found})


def test_components_of_binary_nodes_and_of_no_edges(spark):
    edges = [(bytes([200, i]), bytes([200, i + 1])) for i in range(40)] + [(b"", bytes([255]))]
    for task in (8, 1000):
        found = components.components(spark.createDataFrame(edges, "a binary, b binary"), task).collect()
        assert {bytes(r.node): bytes(r.component) for r in found} == plain_components(edges)
    none = components.components(spark.createDataFrame([], "a long, b long"))
    assert none.columns == ["node", "component"] and none.count() == 0


def test_overlaps_of_common_and_rare_elements(monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "COLUMNS", 7)
    monkeypatch.setattr(ngram_jaccard, "STRIP", 11)
    draw = np.random.default_rng(5)
    base = draw.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.append(draw.permutation(base)[:50], draw.integers(0, 40, 8).astype(np.uint64))) for _ in range(70)]
    sets += [np.array([i], np.uint64) for i in range(10)]
    found = list(ngram_jaccard.overlaps(sets))
    assert [f.tolist() for f in found] == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]


def test_region_of_near_copies_takes_no_step_per_pair():
    """600 texts, each linked with each: 180,000 links."""
    draw = np.random.default_rng(6)
    base = np.sort(draw.integers(0, 2**63, 1_000).astype(np.uint64))
    rows = []
    for i in range(600):
        grams = np.delete(base, draw.integers(0, 1_000, 10))
        rows.append((1, -1, True, bytes([i // 256, i % 256]), grams.tobytes()))
    began = time.process_time()
    (found,) = ngram_jaccard._join_region(85, 100)(iter([ngram_jaccard._row_batch(rows)]))
    took = time.process_time() - began
    assert found.column("links").to_pylist() == [599] * 600
    assert set(found.column("lead").to_pylist()) == {bytes([0, 0])}
    # 7.6 seconds when every link was a step of its own and every common element a list; 0.2 since.
    assert took < 1.5


def test_batches_are_cut_by_bytes(monkeypatch):
    """However many texts come at once, a worker holds the words of about a block."""
    held = []
    monkeypatch.setattr(blocks, "BLOCK", 40_000)
    monkeypatch.setattr(ngram_jaccard.in_blocks, "__defaults__", (40_000,))
    monkeypatch.setattr(ngram_jaccard, "ngram_sets", lambda t, n, f=ngram_jaccard.ngram_sets: held.append(t.nbytes) or f(t, n))
    texts = [f"text {i} of some words " * 50 for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(texts)], ["id", "text"])
    made = list(ngram_jaccard._pack(5, 4, 5, 8)(iter([batch])))
    assert sum(np.frombuffer(p, ngram_jaccard.DOC).size for b in made for k, p in zip(b["kind"].to_pylist(), b["packed"].to_pylist()) if k == ngram_jaccard.DOCS) == 400
    assert len(held) > 5 and max(held) < 50_000


def test_batches_for_python_are_small_unless_the_user_says_otherwise(spark):
    spark.conf.unset(blocks.BATCH_LIMIT)
    blocks.small_batches(spark)
    assert spark.conf.get(blocks.BATCH_LIMIT) == str(blocks.BATCH_BYTES)
    spark.conf.set(blocks.BATCH_LIMIT, "20m")
    blocks.small_batches(spark)
    assert spark.conf.get(blocks.BATCH_LIMIT) == "20m"
    spark.conf.unset(blocks.BATCH_LIMIT)


def test_types_are_known_without_workers(spark):
    """A frame made of rows of Python starts a second family of workers in every executor."""
    edges = spark.range(9).selectExpr("cast(string(id) AS binary) AS a", "array(named_struct('x', id)) AS b", "cast(id AS decimal(9, 2)) AS `c.d`")
    want = pa.binary(), pa.list_(pa.field("element", pa.struct({"x": pa.int64()}))), pa.decimal128(9, 2)
    context = spark.sparkContext
    context.setJobGroup("types", "")
    found = [common.arrow_type(edges, c) for c in edges.columns]
    context.setLocalProperty("spark.jobGroup.id", None)
    assert [str(f).replace(" not null", "") for f in found] == [str(w) for w in want]
    jobs = context.statusTracker().getJobIdsForGroup("types")
    tracker = context.statusTracker()
    assert not any(tracker.getStageInfo(s) and tracker.getStageInfo(s).numTasks for j in jobs for s in tracker.getJobInfo(j).stageIds)
