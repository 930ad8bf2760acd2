import math
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from plain import split

from sessionlake.llm import blocks, gru_lm

HELD_OUT = "crc32(CAST(doc_id AS string)) % 7 = 2"


def plain_base(docs):
    """id: (held out, tokens, known tokens, tokens in training, base score). The end is a token of its own."""
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    counts = Counter()
    for i, text in docs:
        if not held[i]:
            counts.update([*split(text), None])
    total, distinct = sum(counts.values()), len(counts)
    found = {}
    for i, text in docs:
        tokens = [*split(text), None]
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens)
        found[i] = (held[i], len(tokens), sum(counts[t] > 0 for t in tokens), total, base)
    return found


def scores(spark, docs, **options):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    return gru_lm.score_corpus(frame, HELD_OUT, **options).collect()


@pytest.mark.parametrize("block", [100, 12_000_000])
def test_base_scores(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK", block)
    docs = [(i, f"the word{i % 7} Word{i % 7} w{i} ÉCOLE École\t\x0b") for i in range(60)]
    docs += [(60, ""), (61, None), (62, "x " * 3000), (63, "\n"), (64, "nowhere else " * 3)]
    got = scores(spark, docs, rounds=1)
    want = plain_base(docs)
    assert len(got) == len(docs)
    for r in got:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base)
        assert math.isfinite(r.score) and r.score < 0


def test_odd_tables(spark):
    assert scores(spark, []) == []
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = scores(spark, [(i, "a b") for i in held])
    assert [(r.n_known, r.train_tokens) for r in got] == [(0, 0)] * 3
    got = scores(spark, [(None, "a b"), (None, "a b"), (1, "a b")])
    assert [r.held_out for r in got if r.doc_id is None] == [False, False]


def model():
    draw = np.random.default_rng(3)
    m = gru_lm.start_model(draw.integers(1, 50, gru_lm.SYMBOLS).astype(float))
    for k in ("classes", "words"):
        m[k] = draw.standard_normal(m[k].shape) * 0.3
    return {k: v.astype(np.float64) for k, v in m.items()}


def test_probabilities_sum_to_one():
    """Over all words of the model and all classes of other words."""
    m, state = model(), np.random.default_rng(4).standard_normal((1, gru_lm.WIDTH))
    every = np.arange(gru_lm.SYMBOLS)
    found = gru_lm.log_probabilities(m, np.repeat(state, len(every), 0), every)
    assert np.exp(found).sum() == pytest.approx(1)


def test_gradients():
    m, draw = model(), np.random.default_rng(5)
    inputs = draw.integers(0, gru_lm.SYMBOLS, (5, 3))
    targets = draw.integers(0, gru_lm.SYMBOLS, (5, 3))
    live = draw.random((5, 3)) < 0.8
    h = np.zeros((3, gru_lm.WIDTH))

    def loss():
        states = gru_lm.run_states(m, inputs, h, False)[0].astype(np.float64)
        where = np.flatnonzero(live.ravel())
        return -gru_lm.log_probabilities(m, states.reshape(-1, gru_lm.WIDTH)[where], targets.ravel()[where]).mean()

    g, _ = gru_lm.gradients(m, inputs, targets, live, h)
    for k, v in m.items():
        flat, slope = v.ravel(), g[k].ravel()
        at = int(np.abs(slope).argmax())
        old, step = flat[at], 1e-2
        flat[at] = old + step
        up = loss()
        flat[at] = old - step
        down = loss()
        flat[at] = old
        assert (up - down) / (2 * step) == pytest.approx(slope[at], rel=0.05, abs=1e-4), k


def test_state_is_carried_across_windows():
    """A text scored alone, in one window or many, scores as among others."""
    m, draw = model(), np.random.default_rng(6)
    counts = np.array([3, 50, 1, 33, 16, 17])
    flat = draw.integers(0, gru_lm.SYMBOLS, counts.sum())
    together = gru_lm.score_texts(m, flat, counts)
    starts = np.cumsum(counts) - counts
    for a, n, score in zip(starts, counts, together):
        inputs = np.concatenate([[gru_lm.END], flat[a : a + n - 1]])[:, None]
        states, _ = gru_lm.run_states(m, inputs, np.zeros((1, gru_lm.WIDTH)), False)
        alone = gru_lm.log_probabilities(m, states[:, 0].astype(np.float64), flat[a : a + n]).sum()
        assert score == pytest.approx(alone, rel=1e-5)


def test_beats_the_base_on_texts_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = gru_lm.score_corpus(docs, HELD_OUT).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert got[0] > 0.95 * got[1]


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_every_training_text_is_trained_on_once(monkeypatch, rounds):
    """Texts are told apart by their one symbol; the held-out ones train nothing."""
    seen = []
    monkeypatch.setattr(gru_lm, "train_on", lambda m, flat, counts: seen.extend(flat.tolist()) or m)
    n, held = 500, np.arange(500) % 7 == 2
    block = pa.RecordBatch.from_pydict(
        {
            "ids": pa.array([list(range(n - 1)) + [None]], pa.list_(pa.int64())),
            "held": [held.astype(np.uint8).tobytes()],
            "counts": [blocks.packed(np.ones(n))],
            "trained": [blocks.packed(np.arange(n))],
        }
    )
    for turn in range(rounds):
        options = {} if rounds == 2 else {"rounds": rounds}
        list(gru_lm._trainer(model(), turn, **options)(iter([block])))
    assert sorted(seen) == np.flatnonzero(~held).tolist()


def test_batches_for_workers_are_small(spark):
    spark.conf.unset(blocks.BATCH_LIMIT)
    got = gru_lm.score_corpus(spark.createDataFrame([(1, "a b a")], "doc_id long, text string"), "false").collect()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(1, 4)]
    assert spark.conf.get(blocks.BATCH_LIMIT) == str(blocks.BATCH_BYTES)
    spark.conf.unset(blocks.BATCH_LIMIT)


def plain_gradients(m, inputs, targets, h):
    """A row for each lane and every class of words on its own, all targets counting."""
    w, x, states, gates = gru_lm.WIDTH, (m["embed"] @ m["into"] + m["bias"])[inputs], [], []
    for t in range(len(inputs)):
        u = h @ m["again"]
        zr = 0.5 * np.tanh(0.5 * (x[t, :, : 2 * w] + u[:, : 2 * w])) + 0.5
        z, r = zr[:, :w], zr[:, w:]
        n = np.tanh(x[t, :, 2 * w :] + r * u[:, 2 * w :])
        gates.append((h, z, r, n, u[:, 2 * w :]))
        h = n + z * (h - n)
        states.append(h)
    g = {k: np.zeros_like(v) for k, v in m.items()}
    s, y = np.concatenate(states), targets.ravel()

    def back(s, bias, weights, chosen):
        e = s @ weights + bias
        e = np.exp(e - e.max(1, keepdims=True))
        e /= e.sum(1, keepdims=True)
        e[np.arange(len(s)), chosen] -= 1
        e /= len(y)
        return s.T @ e, e.sum(0), e @ weights.T

    g["classes"], g["class_bias"], ds = back(s, m["class_bias"], m["classes"], gru_lm.class_of(y))
    for c in range(gru_lm.CLASSES):
        at = np.flatnonzero((y < gru_lm.SHORTLIST) & (y // gru_lm.PER_CLASS == c))
        if len(at):
            g["words"][c], g["word_bias"][c], d = back(s[at], m["word_bias"][c], m["words"][c], y[at] % gru_lm.PER_CLASS)
            ds[at] += d
    dh, ds = np.zeros_like(h), ds.reshape(*inputs.shape, w)
    for t in range(len(inputs) - 1, -1, -1):
        before, z, r, n, un = gates[t]
        dh = dh + ds[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz, dr = dh * (before - n) * z * (1 - z), dn * un * r * (1 - r)
        du, dx = np.concatenate([dz, dr, dn * r], 1), np.concatenate([dz, dr, dn], 1)
        g["again"] += before.T @ du
        g["into"] += m["embed"][inputs[t]].T @ dx
        g["bias"] += dx.sum(0)
        np.add.at(g["embed"], inputs[t], dx @ m["into"].T)
        dh = dh * z + du @ m["again"].T
    return g, states[-1]


def test_gradients_as_plain_in_less_time():
    m, draw = {k: v.astype(np.float32) for k, v in model().items()}, np.random.default_rng(8)
    shape = gru_lm.WINDOW, gru_lm.TRAIN_LANES
    inputs, targets = (draw.zipf(1.2, shape) % gru_lm.SYMBOLS for _ in range(2))
    h, live = draw.standard_normal((shape[1], gru_lm.WIDTH)).astype(np.float32), np.ones(shape, bool)
    ours, plain = [], []
    for _ in range(30):
        t = time.thread_time()
        g, last = gru_lm.gradients(m, inputs, targets, live, h)
        ours.append(time.thread_time() - t)
        t = time.thread_time()
        want, state = plain_gradients(m, inputs, targets, h)
        plain.append(time.thread_time() - t)
    assert last == pytest.approx(state, abs=1e-5)
    for k in m:
        assert g[k] == pytest.approx(want[k], rel=1e-3, abs=1e-6), k
    assert min(ours) < 0.75 * min(plain)


def test_blocks_have_names_of_their_own(spark):
    """Whole numbers, not long strings beside each of their words."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, 5)
    docs = spark.range(60, numPartitions=3).selectExpr("id", "false AS held", "concat('some words ', id) AS text")
    names = [r["block"] for r in docs.mapInArrow(gru_lm._to_blocks, gru_lm.BLOCK).collect()]
    spark.conf.unset(batch)
    assert len(set(names)) == len(names) == 12
    assert all(isinstance(n, int) for n in names)
