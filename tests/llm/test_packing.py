"""Packing against the tokenizer itself and a plain version of the sum of squares."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sessionlake.llm import packing, queries

DATA = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True
WORDS = packing.WordIds(PATH)

TEXTS = [
    None,
    "",
    " \t\n",
    "It's HERE. It's 'S, don't; WE'LL \"go\")... a.b.c 12,5 x?!",
    "naïve CAFÉ, Ärger. ÉTÉ.",
    "J̌ T̈ é. ́x ≠, ≮. İ İ",
    "İİ. ſ ß ẞ ΣΑΣ Σ.",
    "a b　c\u0085d\x1ce f —, —. ’s ‘t",
    "<|endoftext|> <|startoftext|>. </w> a</w>",
    "東京タワー 🙂👍🏽. 한국어ᅡ ½ ² Ⅷ",
    "\x00\x01 a\x00.",
    "q" * 3000,
]


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]


def whole(rows, capacity=4096):
    """Documents by pieces and by sequence, after checking that both are without gaps."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length > 0 and 4 * r.length == len(r.ids)
        docs[r.doc_id].append((r.start, r.length, r.ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        ends = 0
        for offset, length in sorted(pieces):
            assert offset == ends
            ends += length
        assert ends <= capacity
    return docs, {s: sum(length for _, length in p) for s, p in sequences.items()}


def test_ids_as_the_library(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found, _ = whole(packing.pack(docs, PATH).collect())
    for i, text in enumerate(TEXTS):
        assert np.frombuffer(b"".join(p[2] for p in sorted(found[i])), "<u4").tolist() == ids_of(text), text


ALPHABET = "aAbBzZ'sStT\"., \n09éÉßİſ́̌̈—’ǅΣ½ 　"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(ALPHABET), max_size=20), max_size=5))
def test_words_as_the_library(texts):
    found = [ids.tolist() for ids in WORDS.of_texts([t.encode() for t in texts])]
    assert found == [ids_of(t)[:-1] for t in texts]


def test_long_texts_in_steps(monkeypatch):
    text = ("Some words, it's them. Été　x " * 300).strip()
    monkeypatch.setattr(packing, "AT_ONCE", 100)
    assert packing.WordIds(PATH).of_long(text.encode()).tolist() == ids_of(text)[:-1]


def test_forgetting_changes_nothing(monkeypatch):
    words = packing.WordIds(PATH)
    before = [w.tolist() for w in words.of_texts([b"one two three", b"two 3"])]
    monkeypatch.setattr(packing, "REMEMBERED", 1)
    assert [w.tolist() for w in words.of_texts([b"one two three", b"two 3"])] == before


def plain_levels(sizes, capacity, free):
    """Where each document goes by trying all levels, and the counts of levels after it."""
    counts, placed = Counter(), []

    def total(c):
        return sum(n * n for level, n in c.items() if level not in free and level != capacity)

    for size in sizes:
        size %= capacity
        if not size:
            continue
        best = None
        for level in range(capacity - size, -1, -1):
            if level and not counts[level]:
                continue
            trial = counts.copy()
            if level:
                trial[level] -= 1
            if level + size < capacity:
                trial[level + size] += 1
            if best is None or total(trial) < best[0]:
                best = (total(trial), level, trial)
        placed.append(best[1])
        counts = best[2]
    return placed, +counts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.sampled_from([[], [1, 2, 4, 8, 16], [5]]))
def test_levels_as_by_trying_all(sizes, free):
    windows, placed = packing.Windows(16, free, 10**9), []
    real = windows.level_for
    windows.level_for = lambda size: placed.append(real(size)) or placed[-1]
    for i, size in enumerate(sizes):
        windows.add(i, np.full(size, i, "<u4"))
    assert (placed, {k: len(w) for k, w in enumerate(windows.at) if w}) == plain_levels(sizes, 16, free)
    windows.close()
    lengths = [sum(len(p[2]) // 4 for p in w) for w in windows.done]
    assert sum(lengths) == sum(sizes) and all(0 < n <= 16 for n in lengths)
    # At most one sequence needs padding, none where 1 does not.
    assert sum(n != 16 and n not in free for n in lengths) <= (0 if 1 in free else 1)
    got = defaultdict(dict)
    for w in windows.done:
        for doc, start, ids, total in w:
            assert total == sizes[doc] and set(np.frombuffer(ids, "<u4")) == {doc}
            got[doc] |= dict.fromkeys(range(start, start + len(ids) // 4))
    assert {d: len(v) for d, v in got.items()} == dict(enumerate(sizes))


def test_few_open_windows():
    """Sizes of which no two fit together: windows are closed on the way, without padding."""
    windows = packing.Windows(4096, packing.powers_of_two(4096), 50)
    for i in range(1000):
        windows.add(i, np.zeros(2049 + i % 7, "<u4"))
        assert windows.open <= 50
    windows.close()
    lengths = Counter(sum(len(p[2]) // 4 for p in w) for w in windows.done)
    assert sum(n * c for n, c in lengths.items()) == sum(2049 + i % 7 for i in range(1000))
    assert all(n & (n - 1) == 0 for n in lengths)


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op13_pack(spark, DATA).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
    lengths = [sum(n for _, n in p) for p in sequences.values()]
    assert all(n <= 4096 and n & (n - 1) == 0 for n in lengths)
    assert set(pieces) == set(docs)
    for i, text in docs.items():
        ids, at = ids_of(text), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_odd_tables(spark):
    """Null and repeated ids, ids of another type, columns named as results, no rows."""
    rows = [(None, "a b", 1), ("x", "a b", 2), ("x", "a b", 3), ("y", None, 4)]
    docs = spark.createDataFrame(rows, "doc string, text string, start int")
    got = packing.pack(docs, PATH, id="doc").collect()
    assert sorted((r.doc or "", r.doc_tokens) for r in got if r.start == 0) == [("", 3), ("x", 3), ("x", 3), ("y", 1)]
    empty = packing.pack(docs.limit(0), PATH, id="doc")
    assert empty.columns == ["doc", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    assert empty.count() == 0


@pytest.mark.parametrize("partitions", [1, 7])
def test_sequences_of_tasks_differ(spark, partitions):
    docs = spark.range(500).selectExpr("id AS doc_id", "repeat('word ', int(id % 90)) AS text").repartition(partitions)
    found, lengths = whole(packing.pack(docs, PATH, capacity=64).collect(), 64)
    assert len(found) == 500 and sum(lengths.values()) == sum(i % 90 + 1 for i in range(500))
    assert len({s >> 32 for s in lengths}) == partitions
