"""Ranked lexical search over posting lists with range-maximum tables.

The index has one row per shard, some megabytes of texts: ids and lengths of its documents, and
for every term the documents that hold it and how often. Documents of a shard are numbered by
length, so that neighbours have similar impacts.

A search goes through the shards with a block of items. For each item the candidates are intervals
of document numbers. A sparse table over each posting list gives the largest impact of a term
within an interval; the sum over the item's terms bounds every score there. The interval with the
best bound comes first: the document with the largest single impact in it is scored, and splits it
in two. Intervals whose bound is below the item's worst kept score are dropped, small ones are
scored outright. Many items and intervals are handled at once in arrays.

Impacts need the number of documents and terms, and how many documents hold a term; these
are summed over all shards first. All of the score is whole numbers, so results do not depend on
shards or on the order of work.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.blocks import in_chunks, packed, unpacked
from sessionlake.llm.common import arrow_type, best_rows, text_of
from sessionlake.session import freeze

#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD = 16_000_000
#: Bytes of text that are split into terms at once.
AT_ONCE = 4_000_000
#: Bytes of items that are searched for together.
QUERIES = 1_000_000
#: Intervals of at most so many documents are scored outright.
LEAF = 64
#: Intervals of an item that are looked at in one step, and terms of intervals in all.
STEP, WIDTH = 4, 400_000

#: Bytes of terms: digits, letters with A-Z lowered, and all beyond ASCII. All others separate.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c) in string.digits + string.ascii_lowercase else 32
    for c in range(256)
)
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_NO_ID = np.iinfo(np.int64).max

INDEX = (
    "ids array<bigint>, documents bigint, occurrences bigint, lengths binary, terms array<string>, "
    "sizes binary, docs binary, counts binary"
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[bytes], list[int]]]:
    """Texts of some megabytes together, with the place of each; a longer one comes in slices."""
    some, places, size = [], [], 0
    for place, text in enumerate(texts):
        at = 0
        while at < len(text):
            gap = _GAP.search(text, at + AT_ONCE)
            end = gap.start() if gap else len(text)
            some.append(text[at:end])
            places.append(place)
            size += end - at
            at = end
            if size >= AT_ONCE:
                yield some, places
                some, places, size = [], [], 0
    if some:
        yield some, places


def _counted(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms in each text; the distinct terms; by term and text: sizes of the lists, texts, counts."""
    lengths = np.zeros(len(texts), np.int64)
    vocabularies, found, size = [], [], 0
    for some, places in _pieces(texts):
        words: list[bytes] = []
        each = []
        for text in some:
            before = len(words)
            words += terms_of(text)
            each.append(len(words) - before)
        np.add.at(lengths, places, each)
        coded = pa.array(words, pa.binary()).dictionary_encode()
        del words
        pair = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(texts) + np.repeat(places, each)
        pair, counts = np.unique(pair, return_counts=True)
        found.append((pair + size * len(texts), counts))
        vocabularies.append(coded.dictionary)
        size += len(coded.dictionary)
    if not found:
        none = np.empty(0, np.int64)
        return lengths, pa.array([], pa.binary()), none, none, none
    whole = pa.concat_arrays(vocabularies).dictionary_encode()
    term, text = np.divmod(np.concatenate([p for p, _ in found]), len(texts))
    pair = whole.indices.to_numpy(zero_copy_only=False).astype(np.int64)[term] * len(texts) + text
    del term, text
    order = np.argsort(pair, kind="stable")
    pair, counts = pair[order], np.concatenate([c for _, c in found])[order]
    starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    term, text = np.divmod(pair[starts], len(texts))
    sizes = np.bincount(term, minlength=len(whole.dictionary))
    return lengths, whole.dictionary, sizes, text, np.add.reduceat(counts, starts)


def _shards(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        bytes_of = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        for a, b in in_chunks(bytes_of, SHARD):
            texts = [t.encode() for t in batch.column("text").slice(a, b - a).to_pylist()]
            lengths, terms, sizes, docs, counts = _counted(texts)
            del texts
            # Documents without a term can never be found.
            held = np.flatnonzero(lengths)
            order = held[np.argsort(lengths[held], kind="stable")]
            number = np.zeros(len(lengths), np.int64)
            number[order] = np.arange(len(order))
            term = np.repeat(np.arange(len(sizes)), sizes)
            docs = number[docs]
            by = np.argsort(term * max(len(order), 1) + docs, kind="stable")
            ids = batch.column("id").slice(a, b - a).take(pa.array(order))
            row = (
                [ids.to_pylist()],
                [len(order)],
                [int(lengths.sum())],
                [packed(lengths[order])],
                [terms.cast(pa.string()).to_pylist()],
                [packed(sizes)],
                [packed(docs[by])],
                [packed(counts[by])],
            )
            kinds = [pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()), *[pa.binary()] * 3]
            names = [c.split()[0] for c in INDEX.split(", ")]
            if len(order):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], names)
            del row, docs, counts, term, by
            pa.default_memory_pool().release_unused()


def build_index(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per shard, written to the shared folder when called. Whole texts, nothing shuffled."""
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), text_of(F.col(f"`{text}`")).alias("text"))
    return freeze(rows.mapInArrow(_shards, INDEX))


class Shard:
    """Posting lists of a shard for the terms of some items, with their range-maximum table."""

    def __init__(self, row: dict[str, pa.Array], vocabulary: pa.Array, documents: int, occurrences: int):
        lengths = unpacked(row["lengths"]).astype(np.int64)
        self.size = len(lengths)
        ids = row["ids"]
        self.ids = pc.fill_null(ids, _NO_ID).to_numpy(zero_copy_only=False)
        self.no_id = pc.is_null(ids).to_numpy(zero_copy_only=False)
        sizes = unpacked(row["sizes"]).astype(np.int64)
        ends = np.cumsum(sizes)
        place = pc.index_in(vocabulary, row["terms"])
        here = place.is_valid().to_numpy(zero_copy_only=False)
        place = pc.fill_null(place, 0).to_numpy(zero_copy_only=False)
        sizes = np.where(here, sizes[place], 0) if len(sizes) else np.zeros(len(vocabulary), np.int64)
        #: Where the list of each term of the vocabulary starts; they lie one after the other.
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        jump = np.repeat((ends[place] if len(ends) else sizes) - sizes - self.starts[:-1], sizes)
        at = jump + np.arange(self.starts[-1])
        self.docs = unpacked(row["docs"])[at].astype(np.int64)
        counts = unpacked(row["counts"])[at].astype(np.int64)
        m = 100 - 50 + 50 * lengths * documents // occurrences
        self.impact = 1_000_000_000 * counts // (1000 * counts + 20 * m[self.docs])
        self.keys = np.repeat(np.arange(len(vocabulary)), sizes) * self.size + self.docs
        # At [j][i] the place of the largest of 2 ** j impacts from i on. Ranges that are asked for
        # lie within one list, so the table can go across all lists.
        self.table = [np.arange(len(at), dtype=np.int32)]
        while 2 << (len(self.table) - 1) <= sizes.max(initial=0):
            last, step = self.table[-1], 1 << (len(self.table) - 1)
            a, b = last[: len(last) - step], last[step:]
            self.table.append(np.where(self.impact[a] >= self.impact[b], a, b))
        longest = max((len(t) for t in self.table), default=0)
        self.flat = np.zeros((len(self.table), longest), np.int32)
        for j, t in enumerate(self.table):
            self.flat[j, : len(t)] = t
        del self.table

    def largest(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest impact at the places from ``a`` to before ``b``, and its place; 0 if there is none."""
        some = b > a
        level = np.frexp(np.maximum(b - a, 1))[1] - 1
        left = np.where(some, a, 0)
        right = np.where(some, b - (1 << level), 0)
        if not self.flat.size:
            return np.zeros(a.shape, np.int64), left
        x, y = self.flat[level, left], self.flat[level, right]
        best = np.where(self.impact[x] >= self.impact[y], x, y)
        return np.where(some, self.impact[best], 0), best

    def find(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The place of a document in the list of a term, or where it would be."""
        return np.searchsorted(self.keys, terms * self.size + docs)


class Search:
    """The best documents of some items so far, and the search for more in a shard."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, best: int):
        #: Terms of each item, filled up with a term of no weight.
        self.most = max(map(len, items), default=0)
        self.terms = np.zeros((len(items), self.most), np.int64)
        self.weights = np.zeros((len(items), self.most), np.int64)
        for i, item in enumerate(items):
            self.terms[i, : len(item)] = item
            self.weights[i, : len(item)] = weights[item]
        self.best = best
        none = np.empty(0, np.int64)
        #: Of the documents kept: item, score, id, whether there is no id. Sorted by item, best first.
        self.kept = (none, none, none, none.astype(bool))
        self.worst = np.zeros(len(items), np.int64)
        self.steps = self.looked = self.scored = 0

    def _keep(self, item: np.ndarray, score: np.ndarray, id: np.ndarray, no_id: np.ndarray) -> None:
        good = (score > 0) & (score >= self.worst[item])
        columns = [np.concatenate([a, b[good]]) for a, b in zip(self.kept, (item, score, id, no_id))]
        order = np.lexsort((columns[2], columns[3], -columns[1], columns[0]))
        columns = [c[order] for c in columns]
        item = columns[0]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        columns = [c[rank < self.best] for c in columns]
        self.kept = tuple(columns)
        last = np.flatnonzero(rank[rank < self.best] == self.best - 1)
        self.worst[columns[0][last]] = columns[1][last]

    def look_in(self, shard: Shard) -> None:
        """Best first through all intervals of the shard that may hold a document to keep."""
        items = np.arange(len(self.terms))
        whole = np.zeros(len(items), np.int64)
        bounds = self._bounds(shard, items, whole, whole + shard.size)
        waiting = np.array([items, whole, whole + shard.size, bounds])
        while True:
            item, bound = waiting[0], waiting[3]
            waiting = waiting[:, (bound > 0) & (bound >= self.worst[item])]
            if not waiting.shape[1]:
                return
            self.steps += 1
            waiting = waiting[:, np.lexsort((-waiting[3], waiting[0]))]
            item = waiting[0]
            rank = np.arange(len(item)) - np.searchsorted(item, item)
            now = rank < STEP
            some, waiting = waiting[:, now], waiting[:, ~now]
            made = [waiting]
            width = max(1, WIDTH // max(self.most, 1))
            for a in range(0, some.shape[1], width):
                made += self._look_at(shard, *some[:3, a : a + width])
            waiting = np.concatenate(made, axis=1)

    def _bounds(self, shard: Shard, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        found = []
        width = max(1, WIDTH // max(self.most, 1))
        for a in range(0, len(item), width):
            part = slice(a, a + width)
            terms = self.terms[item[part]]
            places = [shard.find(terms, at[part][:, None]) for at in (low, high)]
            found.append((shard.largest(*places)[0] * self.weights[item[part]]).sum(axis=1))
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def _look_at(self, shard: Shard, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
        """Scores documents of the intervals; the smaller intervals that are left, with their bounds."""
        self.looked += len(item)
        small = high - low <= LEAF
        if small.any():
            self._score_all(shard, item[small], low[small], high[small])
        item, low, high = item[~small], low[~small], high[~small]
        if not len(item):
            return []
        terms, weights = self.terms[item], self.weights[item]
        first, end = shard.find(terms, low[:, None]), shard.find(terms, high[:, None])
        impact, place = shard.largest(first, end)
        one = np.argmax(impact * weights, axis=1)
        doc = shard.docs[np.take_along_axis(place, one[:, None], 1)[:, 0]]
        key = terms * shard.size + doc[:, None]
        at = np.searchsorted(shard.keys, key)
        hit = shard.keys[np.minimum(at, len(shard.keys) - 1)] == key
        hit &= at < len(shard.keys)
        found = np.where(hit, shard.impact[np.minimum(at, len(shard.keys) - 1)], 0)
        self._keep(item, (found * weights).sum(axis=1), shard.ids[doc], shard.no_id[doc])
        left = (shard.largest(first, at)[0] * weights).sum(axis=1)
        right = (shard.largest(at + hit, end)[0] * weights).sum(axis=1)
        return [np.array([item, low, doc, left]), np.array([item, doc + 1, high, right])]

    def _score_all(self, shard: Shard, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Scores of all documents of small intervals."""
        terms, weights = self.terms[item], self.weights[item]
        first = shard.find(terms, low[:, None])
        size = shard.find(terms, high[:, None]) - first
        size[weights == 0] = 0
        flat = size.ravel()
        at = np.repeat(first.ravel() - (np.cumsum(flat) - flat), flat) + np.arange(flat.sum())
        of = np.repeat(np.repeat(np.arange(len(item)), size.shape[1]), flat)
        place = of * LEAF + shard.docs[at] - low[of]
        scores = np.zeros(len(item) * LEAF, np.int64)
        # Whole numbers far below 2 ** 53, so sums of doubles are exact.
        scores[:] = np.bincount(place, shard.impact[at] * np.repeat(weights.ravel(), flat), len(scores))
        hit = np.flatnonzero(scores)
        self.scored += len(hit)
        doc = low[hit // LEAF] + hit % LEAF
        self._keep(item[hit // LEAF], scores[hit], shard.ids[doc], shard.no_id[doc])


def _rows(source: Iterator[pa.RecordBatch], *arrays: str) -> Iterator[dict]:
    """The rows of an index; the named columns as Arrow arrays, the rest as values."""
    for batch in source:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].values if c in arrays else batch.column(c)[i].as_py() for c in batch.schema.names}


def _holding(vocabulary: list[str]) -> Callable:
    """How many documents of a task's shards hold each term."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, total = pa.array(vocabulary, pa.string()), np.zeros(len(vocabulary), np.int64)
        for row in _rows(source, "terms"):
            place = pc.index_in(row["terms"], terms)
            here = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
            total[place.to_numpy(zero_copy_only=False)[here].astype(np.int64)] += unpacked(row["sizes"])[here]
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], ["term", "n"])

    return batches


def _searched(
    items: list[np.ndarray], vocabulary: list[str], weights: np.ndarray, documents: int, occurrences: int, best: int
) -> Callable:
    """The best documents of a task's shards for each item."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, terms = Search(items, weights, best), pa.array(vocabulary, pa.string())
        for row in _rows(source, "ids", "terms"):
            search.look_in(Shard(row, terms, documents, occurrences))
            pa.default_memory_pool().release_unused()
        item, score, id, no_id = search.kept
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(id, mask=no_id), pa.array(score)], ["item", "doc", "score"]
        )

    return batches


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Items in blocks of bounded size; only one block is on the driver at a time."""
    block, size = [], 0
    for item in items.toLocalIterator():
        terms = sorted(set(terms_of(item.text.encode())))
        if terms:
            block.append((item.item, terms))
            size += len(item.text)
            if size >= QUERIES:
                yield block
                block, size = [], 0
    if block:
        yield block


def search(
    index: DataFrame,
    items: DataFrame,
    best: int = 50,
    item: str = "item_id",
    text: str = "text",
    id: str = "doc_id",
) -> DataFrame:
    """The ``best`` documents of the index for each item: ``item``, ``rank``, ``id``, ``score``.

    Only scores above 0; equal ones by ascending id, without an id last. Every row of ``items`` is an
    item of its own, also if an id is null or repeated; one without terms has no results. Repeated
    documents are documents of their own. Items go through all shards in blocks of ``QUERIES`` bytes;
    the results of each block are in the shared folder when this returns.
    """
    rows = items.select(F.col(f"`{item}`").alias("item"), text_of(F.col(f"`{text}`")).alias("text"))
    kind, arrow = rows.schema["item"].dataType.simpleString(), arrow_type(rows, "item")
    spark = index.sparkSession
    documents, occurrences = index.agg(F.sum("documents"), F.sum("occurrences")).first()
    done = spark.createDataFrame([], f"item {kind}, rank int, doc bigint, score bigint")
    for block in _blocks(rows) if documents else ():
        vocabulary = sorted({t for _, terms in block for t in terms})
        place = {t: i for i, t in enumerate(vocabulary)}
        names = [t.decode() for t in vocabulary]
        holding = np.zeros(len(names), np.int64)
        held = index.select("terms", "sizes").mapInArrow(_holding(names), "term bigint, n bigint")
        for term, n in held.groupBy("term").agg(F.sum("n")).collect():
            holding[term] = n
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in holding.tolist()])
        sets = [np.array([place[t] for t in terms]) for _, terms in block]
        found = index.drop("documents", "occurrences").mapInArrow(
            _searched(sets, names, weights, documents, occurrences, best), "item bigint, doc bigint, score bigint"
        )
        order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
        ranked = best_rows(found, best, ["item"], order, F.xxhash64("doc", "score"))
        ids = [i for i, _ in block]

        def named(source: Iterator[pa.RecordBatch], ids: list = ids) -> Iterator[pa.RecordBatch]:
            values = pa.array(ids, arrow)
            for batch in source:
                columns = [values.take(batch.column("item")), *(batch.column(c) for c in ("rank", "doc", "score"))]
                yield pa.RecordBatch.from_arrays(columns, ["item", "rank", "doc", "score"])

        ranked = ranked.mapInArrow(named, done.schema)
        done = done.unionByName(freeze(ranked))
    return done.select(F.col("item").alias(item), "rank", F.col("doc").alias(id), "score")
