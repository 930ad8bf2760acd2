"""Phrases whose words stand together more often than their parts suggest.

Texts are cut into pieces and words, and every run of one to ``most`` words within a piece is an
occurrence. Counting them all in one table would hold mostly phrases that occur once. Instead:

1. *Summaries.* Phrases are dealt by hash into parts. Each block of texts makes a summary per
   part, hash keys with their counts; summaries of a part are merged into one Misra-Gries summary
   (Agarwal and others, "Mergeable summaries"). It has more counters than the part's occurrences
   divided by ``least``, so what it takes off a count, in all, stays below ``least``, and every
   phrase with at least ``least`` occurrences is still in it at the end.
2. *Exact counts.* A second pass over the texts counts only phrases whose hash has survived, by
   their words. Hashes that collide, and phrases below ``least``, fall away here.

Parts of a frequent phrase are at least as frequent, so the counts of single words and of parts
of phrases come from the same table.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.blocks import in_blocks, packed, unpacked
from sessionlake.llm.common import best_rows, text_of
from sessionlake.session import freeze

#: Bytes of text whose phrases are counted together.
BLOCK = 3_000_000
#: Occurrences that a part is meant to have; its summary has a counter for every ``least`` of them.
PART = 16_000_000
MOST_PARTS = 65_536
#: The filter of surviving hashes has 16 bits for each of them, but at most 2 ** 27 (16 MB).
FILTER_BITS = 27

#: What ends a piece, as text and as a regular expression's class.
PIECE_ENDS = ".,;:!?\n\v\f\r"
#: Pieces end in a comma here, which no word can hold, and words in a space.
_TABLE = bytes.maketrans(
    (string.ascii_uppercase + PIECE_ENDS + "\t").encode(),
    (string.ascii_lowercase + "," * len(PIECE_ENDS) + " ").encode(),
)
_ENDS = re.compile(b"[" + re.escape(PIECE_ENDS.encode()) + b"]")


def _slices(text: bytes) -> Iterator[bytes]:
    """A text in slices of about the size of a block, cut where pieces end."""
    at = 0
    while at < len(text):
        gap = _ENDS.search(text, at + BLOCK)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


class Counted:
    """The phrases of some texts, counted: for each length the words' places, the count and a hash."""

    def __init__(self, texts: list[bytes], groups: list[str], most: int):
        words: list[bytes] = []
        sizes = []
        for text in texts:
            before = len(words)
            words += text.translate(_TABLE).replace(b",", b" , ").split()
            words.append(b",")
            sizes.append(len(words) - before)
        self.groups, group = np.unique(np.array(groups, object), return_inverse=True)
        coded = pa.array(words, pa.binary()).dictionary_encode()
        del words
        place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        stop = pc.index(coded.dictionary, pa.scalar(b",", pa.binary())).as_py()
        inside = place != stop
        place += np.repeat(group, sizes) * len(coded.dictionary)
        # A word of one group is another word than that of another group.
        pairs, first = np.unique(place, return_inverse=True)
        group_of, word_of = np.divmod(pairs, len(coded.dictionary))
        self.word_group = group_of
        self.words = coded.dictionary.take(pa.array(word_of))
        del place
        names = [g.encode() + b"\x00" for g in self.groups]
        hashes = np.fromiter(
            (xxhash.xxh3_64_intdigest(names[g] + w) for g, w in zip(group_of.tolist(), self.words.to_pylist())),
            np.uint64,
            len(pairs),
        )
        #: By length from 1: (places of the words, counts, hashes) of the distinct phrases.
        self.phrases = []
        at = np.flatnonzero(inside)
        run, ids, columns, hashed = first, np.arange(len(pairs)), np.empty((0, len(pairs)), np.int64), None
        for length in range(1, most + 1):
            if length > 1:
                at = at[inside[np.minimum(at + length - 1, len(inside) - 1)] & (at + length - 1 < len(inside))]
            key = first[at] if length == 1 else run[at] * len(pairs) + first[at + length - 1]
            ids, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
            before, last = np.divmod(ids, len(pairs))
            columns = ids[None] if length == 1 else np.vstack([columns[:, before], last])
            hashed = hashes[ids] if length == 1 else _mixed(hashed[before], hashes[last])
            self.phrases.append((columns, counts, hashed))
            run = np.zeros(len(first), np.int64)
            run[at] = inverse

    def of(self, columns: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Group and text of phrases."""
        texts = [self.words.take(pa.array(c)) for c in columns]
        joined = texts[0] if len(texts) == 1 else pc.binary_join_element_wise(*texts, pa.scalar(b" ", pa.binary()))
        return pa.array(self.groups[self.word_group[columns[0]]].tolist(), pa.string()), joined.cast(pa.string())


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of a phrase from those of its beginning and its last word."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class MisraGries:
    """Counters for at most ``capacity`` keys; summaries of other data can be merged in.

    ``taken`` is what any key's count can be short of at most. It stays below
    (sum of all counts) / (capacity + 1), as each time a number is taken off, it is taken off at
    least ``capacity + 1`` counters.
    """

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
        self.keys, self.counts = keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts
        over = len(self.keys) - self.capacity
        if over > 0:
            less = int(np.partition(self.counts, over - 1)[over - 1])
            self.taken += less
            left = self.counts > less
            self.keys, self.counts = self.keys[left], self.counts[left] - less

    def at_least(self, least: int) -> np.ndarray:
        """Keys, sorted, among them all with ``least`` occurrences or more if ``taken`` is below ``least``."""
        return self.keys[self.counts + self.taken >= least]


def _keys(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of a hash, its first ``bits`` bits, and the key within the part, the 32 after them."""
    part = (hashes >> np.uint64(64 - bits)) if bits else np.zeros(len(hashes), np.uint64)
    return part, (hashes >> np.uint64(32 - bits)).astype(np.uint32)


def _blocks(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[str]]]:
    for batch in in_blocks(source, "text", BLOCK):
        texts = [t.encode() for t in batch.column("text").to_pylist()]
        groups = batch.column("group").to_pylist()
        if len(texts) == 1 and len(texts[0]) > BLOCK:
            yield from (([part], groups) for part in _slices(texts[0]))
        else:
            yield texts, groups


def _summaries(most: int, bits: int) -> Callable:
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, groups in _blocks(source):
            found = Counted(texts, groups, most).phrases
            hashes = np.concatenate([h for _, _, h in found])
            counts = np.concatenate([c for _, c, _ in found])
            del found
            order = np.argsort(hashes)
            part, keys = _keys(hashes[order], bits)
            counts = counts[order]
            del hashes, order
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
            rows = []
            for a, b in zip(starts, [*starts[1:], len(part)]):
                n, k = counts[a:b], keys[a:b].astype(np.int64)
                # Counts above 32 bits do not occur in a block.
                rows.append((int(part[a]), 0, int(n.sum()), None, None))
                rows.append((int(part[a]), 1, None, packed(np.diff(k, prepend=0)), packed(n)))
            if rows:
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                names = ["part", "kind", "mass", "keys", "counts"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
            del part, keys, counts, rows
            pa.default_memory_pool().release_unused()

    return batches


def _merged(least: int) -> Callable:
    """Per part its surviving keys. Its occurrences come first, so its summary's size is known."""

    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in source:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group in groupby(rows(source), key=lambda r: r[0]):
            mass, summary, waiting, size = 0, None, [], 0
            for _, kind, count, keys, counts in group:
                if kind == 0:
                    mass += count
                    continue
                if summary is None:
                    summary = MisraGries(mass // least)
                waiting.append((np.cumsum(unpacked(keys), dtype=np.int64).astype(np.uint32), unpacked(counts).astype(np.int64)))
                size += len(waiting[-1][0])
                if size > max(summary.capacity, 100_000):
                    summary.merge(*map(np.concatenate, zip(*waiting)))
                    waiting, size = [], 0
            if waiting:
                summary.merge(*map(np.concatenate, zip(*waiting)))
            assert summary.taken < least
            keys = summary.at_least(least).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([len(keys)], pa.int64()),
                    pa.array([packed(np.diff(keys, prepend=0))], pa.binary()),
                ],
                ["part", "n", "keys"],
            )

    return batches


def _filter(survivors: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """A bit for each beginning of a hash that has survived; its size is bounded by ``FILTER_BITS``.

    Each part has its own stretch of the filter, so tasks make stretches and the driver only puts
    them one after the other.
    """
    total = survivors.agg(F.sum("n")).first()[0] or 0
    size = max(bits + 3, min(FILTER_BITS, max(16, (16 * total).bit_length())))

    def stretches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            made = []
            for keys in batch.column("keys").to_pylist():
                at = np.cumsum(unpacked(keys), dtype=np.int64) >> (32 - (size - bits))
                stretch = np.zeros(1 << (size - bits), bool)
                stretch[at] = True
                made.append(np.packbits(stretch).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(made, pa.binary())], ["part", "bits"])

    whole = np.zeros(1 << (size - 3), np.uint8)
    width = 1 << (size - bits - 3)
    for row in survivors.select("part", "keys").mapInArrow(stretches, "part int, bits binary").toLocalIterator():
        whole[row.part * width : (row.part + 1) * width] = np.frombuffer(row.bits, np.uint8)
    return whole, size


def _occurrences(most: int, seen: np.ndarray, size: int) -> Callable:
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, groups in _blocks(source):
            block = Counted(texts, groups, most)
            # All words of a group, as a phrase of no words.
            columns, counts, _ = block.phrases[0]
            words = np.bincount(block.word_group[columns[0]], counts, len(block.groups)).astype(np.int64)
            made = [(pa.array(block.groups.tolist(), pa.string()), pa.array([""] * len(words)), 0, words)]
            for length, (columns, counts, hashes) in enumerate(block.phrases, 1):
                at = (hashes >> np.uint64(64 - size)).astype(np.int64)
                kept = (seen[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 != 0
                made.append((*block.of(columns[:, kept]), length, counts[kept]))
            del block
            for group, phrase, length, counts in made:
                for a in range(0, len(counts), 100_000):
                    n = counts[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [group.slice(a, len(n)), phrase.slice(a, len(n)), pa.array([length] * len(n), pa.int32()), pa.array(n)],
                        ["group", "phrase", "length", "a"],
                    )
            del made
            pa.default_memory_pool().release_unused()

    return batches


def frequent_phrases(docs: DataFrame, least: int, most: int, group: str = "lang", text: str = "text") -> DataFrame:
    """``group``, ``phrase``, ``length`` in words and ``a``, its occurrences: phrases with ``least`` at least.

    Besides, one row per group with the phrase of length 0 and all occurrences of words as ``a``.
    A null group is ``und``. Made when called, in the shared folder; the texts are read twice.
    """
    if least < 1 or most < 1:
        raise ValueError("least and most must be at least 1")
    rows = docs.select(
        text_of(F.col(f"`{text}`")).alias("text"),
        F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("und")).alias("group"),
    ).where("text <> ''")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # At the least, words of five letters; and some parts for each task.
    parts = max(4 * partitions, most * size // 6 // PART)
    bits = min((parts - 1).bit_length(), (MOST_PARTS - 1).bit_length())
    summaries = rows.mapInArrow(_summaries(most, bits), "part int, kind int, mass long, keys binary, counts binary")
    survivors = freeze(
        summaries.repartition(partitions, "part")
        .sortWithinPartitions("part", "kind")
        .mapInArrow(_merged(least), "part int, n long, keys binary")
    )
    seen, filter_bits = _filter(survivors, bits)
    found = rows.mapInArrow(_occurrences(most, seen, filter_bits), "group string, phrase string, length int, a long")
    counted = found.groupBy("group", "phrase", "length").agg(F.sum("a").alias("a"))
    return freeze(counted.where((F.col("a") >= least) | (F.col("length") == 0)))


def _score(a: str, l: str, r: str) -> Column:
    """1,000,000 a a / (l r), rounded down; exact for counts below 10 ** 13."""
    a, l, r = (f"CAST({c} AS DECIMAL(13, 0))" for c in (a, l, r))
    return F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * ({a} * {a})) DIV ({l} * {r})")


def collocations(
    docs: DataFrame,
    least: int = 10,
    most: int = 3,
    inside: int = 50,
    best: int = 2000,
    group: str = "lang",
    text: str = "text",
) -> DataFrame:
    """The ``best`` phrases of two to ``most`` words of each group, by how firmly they hold together.

    Columns ``group``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``. A phrase needs
    ``least`` occurrences. Its score is the lowest over its cuts into two parts of 1,000,000 a a /
    (l r), with l and r the occurrences of the parts (ties: the first cut). A phrase that stands
    inside a longer one with ``inside`` percent of its occurrences is left out. n is the number of
    words of the group. Order: score, then a, both descending, then the bytes of the phrase.

    Null and empty texts have no words, a null group is ``und``; repeated rows count each time.
    Other columns are left out. No rows give no phrases. A piece without any punctuation or line
    end is held whole.
    """
    counts = frequent_phrases(docs, least, most, group, text)
    known = counts.select("group", F.col("phrase").alias("part"), F.col("a").alias("f"))
    phrases = counts.where("length >= 2").withColumn("words", F.split("phrase", " "))

    def span(start: str, length: str) -> str:
        return f"array_join(slice(words, {start}, {length}), ' ')"

    cuts = phrases.select(
        "group", "phrase", "length", "a",
        F.expr(f"""inline(transform(sequence(1, length - 1), k ->
            struct(k, {span('1', 'k')} AS left, {span('k + 1', 'length - k')} AS right)))"""),
    )
    both = cuts.join(known.select("group", F.col("part").alias("left"), F.col("f").alias("l")), ["group", "left"]).join(
        known.select("group", F.col("part").alias("right"), F.col("f").alias("r")), ["group", "right"]
    )
    lowest = F.min(F.struct(_score("a", "l", "r").alias("score"), "k", "l", "r"))
    scored = both.groupBy("group", "phrase", "length", "a").agg(lowest.alias("cut"))
    if most > 2:
        shorter = phrases.where("length >= 3").select(
            "group",
            F.col("a").alias("longer"),
            F.expr(f"""explode(flatten(transform(sequence(2, length - 1), m ->
                transform(sequence(1, length - m + 1), i -> {span('i', 'm')})))) AS phrase"""),
        )
        holding = shorter.groupBy("group", "phrase").agg(F.max("longer").alias("longer"))
        scored = scored.join(holding, ["group", "phrase"], "left").where(
            f"longer IS NULL OR 100 * longer < {int(inside)} * a"
        )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    scored = scored.select("group", "phrase", "a", "cut.l", "cut.r", "cut.score")
    ranked = best_rows(scored, best, ["group"], order, F.xxhash64("phrase"))
    # One row per group on this side.
    totals = counts.where("length = 0").select("group", F.col("a").alias("n"))
    return ranked.join(totals, "group").select(
        F.col("group").alias(group), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
