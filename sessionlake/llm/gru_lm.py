"""Language-model scoring with a gated recurrent network and a class-factored softmax.

Texts are gathered into blocks with lists of their distinct words. Word counts come from all
training texts: blocks count their own words, counts meet per word, and every block gets the
counts of its words back. The commonest ``SHORTLIST`` words, and the end of a text, are words of
the model, dealt into classes by frequency. Every other word has the class of its count's
magnitude, within which its probability is its share of the class's occurrences; all words
that training texts don't have are one word, with a class of its own. So

    P(word | history) = P(class | state) * P(word | class, state)

is a distribution over all words. The first factor, and the second for words of the model, are
softmax layers over the state of a gated recurrent unit.

Training is truncated backpropagation in numpy: the state goes on from window to window, the
gradient does not. A window is longer where few texts are that long. In each round every block
trains on its share of texts from the same start, and the results are averaged, weighted by
tokens, in groups before they reach the driver; what the driver holds depends on the size of the
model alone. The rounds together train on every training text once. Scoring carries the state through the
whole of every text.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.blocks import by_frequency, in_blocks, lean, packed, small_batches, unpacked
from sessionlake.llm.common import text_of
from sessionlake.llm.ngram_jaccard import by_group, split_words
from sessionlake.session import freeze

#: Words of the model; how many share a class.
SHORTLIST = 1024
PER_CLASS = 32
CLASSES = SHORTLIST // PER_CLASS
#: Classes of other words by the magnitude of their count, and the one of unknown words.
MAGNITUDES = 40
UNKNOWN = SHORTLIST + MAGNITUDES
SYMBOLS = UNKNOWN + 1
OUTPUTS = CLASSES + MAGNITUDES + 1
END = 0

WIDTH = 16
WINDOW = 16
TRAIN_LANES = 128
SCORE_LANES = 512
#: Targets whose probabilities are computed at once.
AT_ONCE = 4096
RATE = 0.01
#: A text trains in the round that its hash modulo the number of rounds names, so each trains once.
ROUNDS = 2
#: Groups in which the models of blocks are summed.
GROUPS = 64

BLOCK = "block long, ids array<long>, held binary, counts binary, places binary, words array<string>"


def _to_blocks(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for made, batch in enumerate(in_blocks(source, "text")):
        places, distinct, counts = split_words(batch.column("text"))
        places, order = by_frequency(places, len(distinct))
        yield pa.RecordBatch.from_arrays(
            [
                # Written once, so the task and a number within it name the block.
                pa.array([task << 32 | made], pa.int64()),
                pa.array([batch.column("id").to_pylist()], pa.list_(pa.int64())),
                pa.array([batch.column("held").to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()], pa.binary()),
                pa.array([packed(counts)], pa.binary()),
                pa.array([packed(places)], pa.binary()),
                pa.array([distinct.take(pa.array(order)).to_pylist()], pa.list_(pa.string())),
            ],
            ["block", "ids", "held", "counts", "places", "words"],
        )


def _occurrences(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every distinct word of a block with its place and its count in training texts; the end is null."""
    for batch in source:
        for row in range(batch.num_rows):
            counts = unpacked(batch.column("counts")[row].as_py())
            places = unpacked(batch.column("places")[row].as_py())
            trains = np.frombuffer(batch.column("held")[row].as_py(), np.uint8) == 0
            words = batch.column("words")[row].values
            n = np.bincount(places[np.repeat(trains, counts)], minlength=len(words)).astype(np.int64)
            name = batch.column("block")[row].as_py()
            for a in range(0, len(words), 50_000):
                some = words.slice(a, 50_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(some), name)),
                        pa.array(np.arange(a, a + len(some), dtype=np.int32)),
                        some.cast(pa.string()),
                        pa.array(n[a : a + len(some)]),
                    ],
                    ["block", "place", "word", "n"],
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array([name], pa.int64()), pa.array([-1], pa.int32()), pa.nulls(1, pa.string()), pa.array([int(trains.sum())])],
                ["block", "place", "word", "n"],
            )


CODED = (
    "ids array<long>, held binary, counts binary, symbols binary, trained binary, "
    "base array<double>, within array<double>, known array<long>"
)


def _coder(total: int, distinct: int, masses: dict[int, int]) -> Callable:
    """Blocks as symbols of the model, with what does not depend on the model summed per text."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = np.zeros(SYMBOLS)
        for symbol, mass in masses.items():
            share[symbol] = math.log10(mass)
        for batch in source:
            for row in range(batch.num_rows):
                counts = unpacked(batch.column("counts")[row].as_py()).astype(np.int64)
                places = unpacked(batch.column("places")[row].as_py()).astype(np.int64)
                table = batch.column("lexicon")[row].values
                at = table.field("place").to_numpy()
                c, symbol = np.zeros(len(at), np.int64), np.full(len(at), UNKNOWN, np.int64)
                # The end has place -1, so it comes last in both.
                c[at] = table.field("c").fill_null(0).to_numpy(zero_copy_only=False)
                symbol[at] = table.field("symbol").fill_null(UNKNOWN).to_numpy(zero_copy_only=False)
                last = np.cumsum(counts + 1) - 1
                tokens = np.full(len(places) + len(counts), -1, np.int64)
                body = np.ones(len(tokens), bool)
                body[last] = False
                tokens[body] = places
                base = np.log10((c + 1) / (total + distinct + 1))
                tail = (symbol >= SHORTLIST) & (symbol < UNKNOWN)
                inside = np.where(tail, np.log10(np.maximum(c, 1)) - share[symbol], 0.0)
                starts = last - counts
                symbols = symbol[tokens]
                # A word seen once stands for an unknown one every other time.
                once = np.flatnonzero(c[tokens] == 1)[::2]
                trained = symbols.copy()
                trained[once[symbols[once] >= SHORTLIST]] = UNKNOWN
                summed = [np.add.reduceat(x[tokens], starts) for x in (base, inside, (c > 0).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("ids").slice(row, 1),
                        batch.column("held").slice(row, 1),
                        pa.array([packed(counts + 1)], pa.binary()),
                        pa.array([packed(symbols)], pa.binary()),
                        pa.array([packed(trained)], pa.binary()),
                        *(pa.array([s.tolist()], t) for s, t in zip(summed, (pa.list_(pa.float64()),) * 2 + (pa.list_(pa.int64()),))),
                    ],
                    ["ids", "held", "counts", "symbols", "trained", "base", "within", "known"],
                )

    return batches


def class_of(symbols: np.ndarray) -> np.ndarray:
    return np.where(symbols < SHORTLIST, symbols // PER_CLASS, symbols - SHORTLIST + CLASSES)


def start_model(weights: np.ndarray) -> dict[str, np.ndarray]:
    """Small random weights; the biases already give the symbols' shares in the training texts."""
    draw = np.random.default_rng(7)

    def small(*shape: int) -> np.ndarray:
        return (draw.standard_normal(shape) * 0.1).astype(np.float32)

    weights = weights + 1e-3
    mass = np.bincount(class_of(np.arange(SYMBOLS)), weights, minlength=OUTPUTS)
    return {
        "embed": small(SYMBOLS, WIDTH),
        "into": small(WIDTH, 3 * WIDTH),
        "bias": np.zeros(3 * WIDTH, np.float32),
        "again": small(WIDTH, 3 * WIDTH),
        "classes": np.zeros((WIDTH, OUTPUTS), np.float32),
        "class_bias": np.log(mass / mass.sum()).astype(np.float32),
        "words": np.zeros((CLASSES, WIDTH, PER_CLASS), np.float32),
        "word_bias": np.log(weights[:SHORTLIST]).reshape(CLASSES, PER_CLASS).astype(np.float32),
    }


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Of each column, in place; returns the logarithm of what it was divided by."""
    top = logits.max(0)
    logits -= top
    np.exp(logits, out=logits)
    z = logits.sum(0)
    logits /= z
    return top + np.log(z)


def _with_ones(columns: np.ndarray) -> np.ndarray:
    """One more row, so that a bias is one more row of the weights."""
    return np.concatenate([columns, np.ones((1, columns.shape[1]), columns.dtype)])


def run_states(m: dict, inputs: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, tuple]:
    """States after each input; ``inputs`` is (time, lane), states are (time, lane, feature).

    If asked for, also what ``gradients`` needs: what the inputs bring, states before, gates, new
    contents and the recurrent part of these, each (time, feature, lane), as they lie in memory.
    """
    w, steps, kind = WIDTH, len(inputs), m["again"].dtype
    # sigmoid(x) = (tanh(x / 2) + 1) / 2
    half = np.repeat(np.array([0.5, 0.5, 1], kind), w)
    brought = m["embed"].take(inputs, 0).transpose(0, 2, 1)
    x = np.matmul((m["into"] * half).T, brought)
    x += (m["bias"] * half)[:, None]
    again, h = (m["again"] * half).T, h.T
    lanes = inputs.shape[1]
    states = np.empty((steps + 1, w, lanes), kind)
    states[0] = h
    u = np.empty((steps if keep else 1, 3 * w, lanes), kind)
    for t in range(steps):
        now = u[t if keep else 0]
        np.matmul(again, states[t], out=now)
        zr, n, s = x[t, : 2 * w], x[t, 2 * w :], states[t + 1]
        zr += now[: 2 * w]
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        np.multiply(zr[w:], now[2 * w :], out=s)
        n += s
        np.tanh(n, out=n)
        np.subtract(states[t], n, out=s)
        s *= zr[:w]
        s += n
    kept = (brought, states[:-1], x[:, : 2 * w], x[:, 2 * w :], u[:, 2 * w :]) if keep else ()
    return states[1:].transpose(0, 2, 1), kept


def live_states(states: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states that count, a column each, and their places."""
    where = np.flatnonzero(live.ravel())
    columns = states.transpose(2, 0, 1).reshape(WIDTH, -1)
    return columns if len(where) == live.size else columns.take(where, 1), where


def word_groups(targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Where the words of the model are in ``targets``, by class; the word within it; class and range of each."""
    at = np.flatnonzero(targets < SHORTLIST)
    cls = (targets[at] // PER_CLASS).astype(np.uint8 if CLASSES <= 256 else np.int64)
    at = at[np.argsort(cls, kind="stable")]
    ends = np.cumsum(np.bincount(cls, minlength=CLASSES)).tolist()
    ranges = [(c, a, b) for c, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]
    return at, targets[at] % PER_CLASS, ranges


def log_probabilities(m: dict, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural logarithms; of words outside the model, that of their class. ``states`` has a row for each target."""
    columns = _with_ones(states.T)
    classes, words = _with_biases(m)
    logits = classes.T @ columns
    found = logits[class_of(targets), np.arange(len(targets))]
    found -= _softmax(logits)
    at, word, ranges = word_groups(targets)
    mine, inner = columns.take(at, 1), np.empty((PER_CLASS, len(at)), columns.dtype)
    for c, a, b in ranges:
        np.matmul(words[c].T, mine[:, a:b], out=inner[:, a:b])
    chosen = inner[word, np.arange(len(at))]
    found[at] += chosen - _softmax(inner)
    return found


def _with_biases(m: dict) -> tuple[np.ndarray, np.ndarray]:
    """The weights of the classes and of the words in each class, with a row of biases."""
    return (
        np.concatenate([m["classes"], m["class_bias"][None]]),
        np.concatenate([m["words"], m["word_bias"][:, None]], 1),
    )


def gradients(m: dict, inputs: np.ndarray, targets: np.ndarray, live: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
    """Of the mean loss in one window, and the last state. ``live`` marks the (time, lane) that count."""
    w, kind = WIDTH, m["again"].dtype
    states, (brought, before, zr, n, un) = run_states(m, inputs, h, True)
    columns, where = live_states(states, live)
    columns, y = _with_ones(columns), targets.ravel()[where]
    scale = kind.type(1 / max(1, len(where)))
    classes, words = _with_biases(m)
    p = classes.T @ columns
    _softmax(p)
    p[class_of(y), np.arange(len(y))] -= 1
    p *= scale
    g_classes = columns @ p.T
    ds = m["classes"] @ p
    at, word, ranges = word_groups(y)
    mine, q = columns.take(at, 1), np.empty((PER_CLASS, len(at)), kind)
    for c, a, b in ranges:
        np.matmul(words[c].T, mine[:, a:b], out=q[:, a:b])
    _softmax(q)
    q[word, np.arange(len(at))] -= 1
    q *= scale
    g_words, inner = np.zeros_like(words), np.empty((w, len(at)), kind)
    for c, a, b in ranges:
        np.matmul(mine[:, a:b], q[:, a:b].T, out=g_words[c])
        np.matmul(m["words"][c], q[:, a:b], out=inner[:, a:b])
    ds[:, at] += inner
    if len(where) < live.size:
        d_states = np.zeros((w, live.size), kind)
        d_states[:, where] = ds
    else:
        d_states = ds
    d_states = d_states.reshape(w, *inputs.shape).transpose(1, 0, 2)
    z, r = zr[:, :w], zr[:, w:]
    to_n = (1 - z) * (1 - n * n)
    to_z = (before - n) * z * (1 - z)
    to_r = un * r * (1 - r)
    d, dn = np.empty((len(inputs), 3 * w, inputs.shape[1]), kind), np.empty_like(to_n)
    dh, back = np.zeros((w, inputs.shape[1]), kind), np.empty((w, inputs.shape[1]), kind)
    for t in range(len(inputs) - 1, -1, -1):
        dh += d_states[t]
        np.multiply(dh, to_n[t], out=dn[t])
        np.multiply(dh, to_z[t], out=d[t, :w])
        np.multiply(dn[t], to_r[t], out=d[t, w : 2 * w])
        np.multiply(dn[t], r[t], out=d[t, 2 * w :])
        dh *= z[t]
        dh += np.matmul(m["again"], d[t], out=back)
    g_again = np.matmul(before, d.transpose(0, 2, 1)).sum(0)
    d[:, 2 * w :] = dn
    entered = np.matmul(d.transpose(0, 2, 1), m["into"].T).reshape(-1, w)
    symbols = inputs.ravel().astype(np.int16 if SYMBOLS < 2**15 else np.int64)
    order = np.argsort(symbols, kind="stable")
    symbols = symbols[order]
    starts = np.concatenate([[0], np.flatnonzero(symbols[1:] != symbols[:-1]) + 1])
    g_embed = np.zeros_like(m["embed"])
    g_embed[symbols[starts]] = np.add.reduceat(entered.take(order, 0), starts)
    g = {
        "embed": g_embed,
        "into": np.matmul(brought, d.transpose(0, 2, 1)).sum(0),
        "bias": d.sum(2).sum(0),
        "again": g_again,
        "classes": g_classes[:w],
        "class_bias": g_classes[w],
        "words": g_words[:, :w],
        "word_bias": g_words[:, w],
    }
    return g, states[-1]


def lanes(counts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Groups of up to ``width`` texts of about one length, the longest first in each."""
    order = np.argsort(-counts, kind="stable")
    for a in range(0, len(order), width):
        group = order[a : a + width]
        if counts[group[0]]:
            yield group


def _windows(flat: np.ndarray, counts: np.ndarray, group: np.ndarray, tokens: int, most: int) -> Iterator[tuple]:
    """Of each window: the texts that reach into it, the symbols before the targets, the targets, which count.

    A window has ``WINDOW`` steps, and where few texts are left up to ``most``, so that it has
    about ``tokens`` targets.
    """
    starts, t = np.cumsum(counts) - counts, 0
    while t < counts[group[0]]:
        active = group[: int(np.searchsorted(-counts[group], -t, "left"))]
        steps = min(most, max(WINDOW, tokens // len(active)))
        yield active, *_window(flat, starts, counts, active, t, steps)
        t += steps


def _window(
    flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, active: np.ndarray, t: int, steps: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = t + np.arange(min(steps, int(counts[active[0]]) - t))[:, None]
    live = at < counts[active][None, :]
    place = starts[active][None, :] + np.minimum(at, counts[active][None, :] - 1)
    targets = flat[place]
    # Before the first token stands the end of an earlier text.
    inputs = np.where(at > 0, flat[np.maximum(place - 1, 0)], END)
    return inputs, targets, live


def train_on(m: dict, flat: np.ndarray, counts: np.ndarray) -> dict:
    """The model after one pass over some texts, with Adam."""
    # One array for all weights, of which the model's are views.
    whole = _flattened(m)
    m = _shaped(m, whole)
    mean, square, move = np.zeros_like(whole), np.zeros_like(whole), np.empty_like(whole)
    step, groups = 0, list(lanes(counts, TRAIN_LANES))
    np.random.default_rng(11).shuffle(groups)
    for group in groups:
        h = np.zeros((len(group), WIDTH), np.float32)
        for active, inputs, targets, live in _windows(flat, counts, group, TRAIN_LANES * WINDOW, 4 * WINDOW):
            g, h = gradients(m, inputs, targets, live, h[: len(active)])
            slope = _flattened({k: g[k] for k in m})
            step += 1
            size = RATE * math.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            np.subtract(slope, mean, out=move)
            move *= 0.1
            mean += move
            slope *= slope
            slope -= square
            slope *= 0.01
            square += slope
            np.sqrt(square, out=move)
            move += 1e-8
            np.divide(mean, move, out=move)
            move *= size
            whole -= move
    return m


def score_texts(m: dict, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Natural log-probability of every text as symbols; the state goes through all windows."""
    scores = np.zeros(len(counts))
    for group in lanes(counts, SCORE_LANES):
        h = np.zeros((len(group), WIDTH), np.float32)
        for active, inputs, targets, live in _windows(flat, counts, group, SCORE_LANES * WINDOW, SCORE_LANES * WINDOW):
            states, _ = run_states(m, inputs, h[: len(active)], False)
            h = states[-1]
            columns, where = live_states(states, live)
            targets, lane = targets.ravel()[where], where % len(active)
            for a in range(0, len(where), AT_ONCE):
                found = log_probabilities(m, columns[:, a : a + AT_ONCE].T, targets[a : a + AT_ONCE])
                scores[active] += np.bincount(lane[a : a + AT_ONCE], found.astype(np.float64), minlength=len(active))
    return scores


def _flattened(m: dict) -> np.ndarray:
    return np.concatenate([v.ravel() for v in m.values()])


def _shaped(m: dict, flat: np.ndarray) -> dict:
    ends = np.cumsum([v.size for v in m.values()])
    return {
        k: part.reshape(v.shape).astype(np.float32, copy=False) for (k, v), part in zip(m.items(), np.split(flat, ends[:-1]))
    }


def _mixed(ids: list, salt: int) -> np.ndarray:
    x = np.array([salt if i is None else i for i in ids], np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(31))


def _trainer(m: dict, turn: int, rounds: int = ROUNDS) -> Callable:
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in range(batch.num_rows):
                ids = batch.column("ids")[row].as_py()
                counts = unpacked(batch.column("counts")[row].as_py()).astype(np.int64)
                held = np.frombuffer(batch.column("held")[row].as_py(), np.uint8) == 1
                mine = ~held & (_mixed(ids, len(ids)) % np.uint64(rounds) == turn)
                if not mine.any():
                    continue
                flat = unpacked(batch.column("trained")[row].as_py()).astype(np.int64)[np.repeat(mine, counts)]
                after = _flattened(train_on(m, flat, counts[mine])).astype(np.float64) * len(flat)
                group = int(_mixed([ids[0]], 0)[0] % np.uint64(GROUPS))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group]), pa.array([float(len(flat))]), pa.array([after.tobytes()], pa.binary())],
                    ["group", "weight", "model"],
                )

    return batches


def _summed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per group; models are added up as they come."""
    total: dict[int, list] = {}
    for batch in source:
        for group, weight, model in zip(*(batch.column(c).to_pylist() for c in ("group", "weight", "model"))):
            values = np.frombuffer(model)
            if group in total:
                total[group][0] += weight
                total[group][1] += values
            else:
                total[group] = [weight, values.copy()]
    if total:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(total), pa.int64()),
                pa.array([w for w, _ in total.values()]),
                pa.array([v.tobytes() for _, v in total.values()], pa.binary()),
            ],
            ["group", "weight", "model"],
        )


MODEL = "group long, weight double, model binary"


def train(coded: DataFrame, m: dict, rounds: int = ROUNDS) -> dict:
    for turn in range(rounds):
        trained = coded.select("ids", "held", "counts", "trained").mapInArrow(lean(_trainer(m, turn, rounds)), MODEL)
        # At most ``GROUPS`` models come to the driver.
        sums = trained.mapInArrow(_summed, MODEL).repartition("group").mapInArrow(_summed, MODEL).collect()
        weight = sum(r["weight"] for r in sums)
        if weight:
            m = _shaped(m, sum(np.frombuffer(r["model"]) for r in sums) / weight)
    return m


SCORES = "id long, held boolean, n_tokens long, n_known long, base_score double, score double"


def _scorer(m: dict) -> Callable:
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in range(batch.num_rows):
                counts = unpacked(batch.column("counts")[row].as_py()).astype(np.int64)
                flat = unpacked(batch.column("symbols")[row].as_py()).astype(np.int64)
                score = score_texts(m, flat, counts) / math.log(10)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("ids")[row].values,
                        pa.array(np.frombuffer(batch.column("held")[row].as_py(), np.uint8) == 1),
                        pa.array(counts),
                        batch.column("known")[row].values,
                        batch.column("base")[row].values,
                        pa.array(score + batch.column("within")[row].values.to_numpy()),
                    ],
                    ["id", "held", "n_tokens", "n_known", "base_score", "score"],
                )

    return batches


def score_corpus(docs: DataFrame, held_out: str, id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs``: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``held_out`` is an SQL condition; rows for which it is true train nothing, a null one
    counts as false. Scores are log10 probabilities of the words, A-Z in lower case, and one
    end. A null text is empty: one end. Without training texts every token is unknown.
    Repeated rows train and are scored each.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id).cast("long").alias("id"),
        F.coalesce(F.expr(held_out), F.lit(False)).alias("held"),
        text_of(text).alias("text"),
    )
    blocks = freeze(rows.mapInArrow(lean(_to_blocks), BLOCK))
    found = blocks.select("block", "held", "counts", "places", "words").mapInArrow(
        lean(_occurrences), "block long, place int, word string, n long"
    )
    totals = freeze(found.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"))
    whole = totals.agg(F.sum("c").alias("tokens"), F.count("*").alias("distinct")).first()
    total, distinct = whole["tokens"] or 0, whole["distinct"]
    # The end first, then the commonest words; a list of the size of the model.
    common = totals.where("word IS NOT NULL").orderBy(F.desc("c"), "word").limit(SHORTLIST - 1).collect()
    short = [(r["word"], i + 1) for i, r in enumerate(common)]
    symbols = F.broadcast(docs.sparkSession.createDataFrame(short, "word string, short int"))
    magnitude = F.least(F.floor(F.log2("c")), F.lit(MAGNITUDES - 1)).cast("int")
    lexicon = totals.join(symbols, "word", "left").select(
        "word",
        "c",
        F.when(F.col("word").isNull(), END).otherwise(F.coalesce("short", SHORTLIST + magnitude)).alias("symbol"),
    )
    # One row per symbol.
    masses = {r["symbol"]: r["mass"] for r in lexicon.groupBy("symbol").agg(F.sum("c").alias("mass")).collect()}
    looked_up = (
        found.select("block", "place", "word")
        # Hashing the distinct words of a partition takes less than sorting all that blocks hold of them.
        .join(lexicon.withColumnRenamed("word", "_word").hint("shuffle_hash"), F.col("word").eqNullSafe(F.col("_word")), "left")
        .groupBy("block")
        .agg(F.collect_list(F.struct("place", "c", "symbol")).alias("lexicon"))
    )
    coded = freeze(
        blocks.drop("words").join(looked_up, "block").mapInArrow(lean(_coder(total, distinct, masses)), CODED)
    )
    weights = np.zeros(SYMBOLS)
    for symbol, mass in masses.items():
        weights[symbol] = mass
    weights[UNKNOWN] = weights[SHORTLIST] / 2
    weights[SHORTLIST] -= weights[UNKNOWN]
    m = train(coded, start_model(weights), rounds)
    return coded.drop("trained").mapInArrow(lean(_scorer(m)), SCORES).select(
        F.col("id").alias(id),
        F.col("held").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
