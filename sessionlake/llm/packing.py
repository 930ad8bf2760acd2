"""Packing documents into training sequences by the sum of squares.

Every task packs its own documents as they come. A level array holds how many partially filled
windows there are at each fill level. A document goes into the window at that level, or into a
new one, which makes the sum of the squared counts smallest; so no level piles up, and windows
that fit one another are at hand. Levels that need no padding (in the contract: powers of two)
count as full in that sum, but stay open to further documents.

Documents of a window or more give up whole windows first. Windows that are still partially
filled at the end, or when over ``open_windows`` of them are open, are closed: the emptiest are
cut up to fill the gaps of the fullest, and what is left of the last one is cut into lengths
that need no padding.

Numbers of sequences are those of the task, times 2 ** 32, and a running number, so that a task
which is run again over the same rows makes the same sequences.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sessionlake.llm.blocks import in_blocks, strung
from sessionlake.llm.common import arrow_type, text_of

CAPACITY = 4096
#: Windows that a task keeps open, each with up to ``CAPACITY`` ids in memory.
OPEN_WINDOWS = 2048
#: Words that a worker remembers with their ids, in each of two generations.
REMEMBERED = 300_000
#: Bytes of a long text that are split into words at once, and of ids in a batch of pieces.
AT_ONCE = 4_000_000

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Between a letter or digit and punctuation after it tokens always end; apostrophes are no such punctuation.
_END = re.compile(rb"(?<=[A-Za-z0-9])(?=[.,;:!?)\]}\"])")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: In UTF-8 every combining mark that changes an ASCII letter begins so.
_MARKS = (b"\xcc", b"\xcd")
#: Words that are one run of lower-case letters, which no normalizing changes.
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


def powers_of_two(capacity: int) -> list[int]:
    return [1 << i for i in range(capacity.bit_length()) if 1 << i <= capacity]


def cut_words(text: bytes) -> list[bytes]:
    """The text at white space, and where else no token can span; ASCII in lower case where that is safe.

    Normalizing composes letters with marks before it lowers them, so a text with marks is left as it is.
    """
    if not any(m in text for m in _MARKS):
        text = text.translate(_LOWER)
    return _END.sub(b" ", text).split()


class WordIds:
    """Token ids of words between white space, each distinct word encoded once while remembered.

    For tokenizers that lower all text, let no token span white space and end each run of letters
    with a token that occurs nowhere else (``</w>``).
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        # Strings like "<|endoftext|>" in a text are ordinary text.
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _coded(self, texts: list[str]) -> list[np.ndarray]:
        return [
            np.array(c.ids, "<u4") for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ]

    def _learn(self, words: list[bytes]) -> None:
        plain, other = [], []
        for word in words:
            text = word.decode()
            (plain if _LETTERS.fullmatch(text) else other).append(text)
        # Runs of letters go in together, and come back one after the other.
        for a in range(0, len(plain), 10_000):
            some = plain[a : a + 10_000]
            ids = self._coded([" ".join(some)])[0]
            at = (np.flatnonzero(self.ends[ids]) + 1) * 4
            flat = ids.tobytes()
            self.known |= {w.encode(): flat[x:y] for w, x, y in zip(some, [0, *at.tolist()], at.tolist())}
            if len(at) != len(some):
                raise ValueError("the tokenizer does not end each run of letters with one token")
        for a in range(0, len(other), 10_000):
            some = other[a : a + 10_000]
            self.known |= {w.encode(): ids.tobytes() for w, ids in zip(some, self._coded(some))}

    def of(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of some distinct words."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        new = []
        for word in words:
            if word not in self.known:
                ids = self.older.get(word)
                if ids is None:
                    new.append(word)
                else:
                    self.known[word] = ids
        self._learn(new)
        return [self.known[w] for w in words]

    def of_texts(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        words: list[bytes] = []
        ends = [0]
        for text in texts:
            words += cut_words(text)
            ends.append(len(words))
        coded = pa.array(words, pa.binary()).dictionary_encode()
        del words
        ids = self.of(coded.dictionary.to_pylist())
        lengths = np.array([len(i) // 4 for i in ids], np.int64)
        places = coded.indices.to_numpy(zero_copy_only=False)
        flat = strung(np.frombuffer(b"".join(ids), "<u4"), np.cumsum(lengths) - lengths, lengths, places)
        at = np.concatenate([[0], np.cumsum(lengths[places])])[ends]
        return (flat[a:b] for a, b in zip(at, at[1:]))

    def of_long(self, text: bytes) -> np.ndarray:
        """The ids of one text, in steps that end at white space."""
        found, at = [np.empty(0, "<u4")], 0
        while at < len(text):
            gap = _SPACE.search(text, at + AT_ONCE)
            end = gap.start() if gap else len(text)
            found += self.of_texts([text[at:end]])
            at = end
        return np.concatenate(found)


@functools.cache
def word_ids(path: str) -> WordIds:
    """One for all tasks that a Python worker runs."""
    return WordIds(path)


#: doc, start of the piece in its document, its ids, ids of the whole document.
Piece = tuple[int, int, bytes, int]


class Windows:
    """Partially filled windows by fill level, and the sequences that are done."""

    def __init__(self, capacity: int, free: Iterable[int], open_windows: int):
        self.capacity, self.most = capacity, open_windows
        self.free = np.zeros(capacity + 1, bool)
        self.free[[capacity, *free]] = True
        self.at: list[list[list[Piece]]] = [[] for _ in range(capacity + 1)]
        # What the sum of squares changes by when a window leaves a level, or comes to it.
        self.leave = np.full(capacity + 1, np.inf)
        self.come = np.where(self.free, 0.0, 1.0)
        self.open = 0
        self.done: list[list[Piece]] = []

    def _count(self, level: int) -> None:
        n = len(self.at[level])
        self.leave[level] = np.inf if not n else 0 if self.free[level] else 1 - 2 * n
        self.come[level] = 0 if self.free[level] else 2 * n + 1

    def _put(self, window: list[Piece], level: int) -> None:
        if level == self.capacity:
            self.done.append(window)
        else:
            self.at[level].append(window)
            self._count(level)
            self.open += 1

    def _take(self, level: int) -> list[Piece]:
        window = self.at[level].pop()
        self._count(level)
        self.open -= 1
        return window

    def level_for(self, size: int) -> int:
        """The level to place ``size`` ids at; 0 is a new window. Of equals the fullest."""
        last = self.capacity - size
        change = self.leave[last:0:-1] + self.come[self.capacity : size : -1]
        best = int(np.argmin(change)) if len(change) else 0
        return last - best if len(change) and change[best] <= self.come[size] else 0

    def add(self, doc: int, ids: np.ndarray) -> None:
        total, whole = len(ids), len(ids) // self.capacity * self.capacity
        for a in range(0, whole, self.capacity):
            self.done.append([(doc, a, ids[a : a + self.capacity].tobytes(), total)])
        if whole < total:
            level = self.level_for(total - whole)
            window = self._take(level) if level else []
            window.append((doc, whole, ids[whole:].tobytes(), total))
            self._put(window, level + total - whole)
            if self.open > self.most:
                self.close()

    def close(self) -> None:
        """No window stays open, and none needs padding as long as 1 needs none."""
        self.done += [w for level in np.flatnonzero(self.free[:-1]).tolist() for w in self.at[level]]
        partial = [(level, w) for level in np.flatnonzero(~self.free).tolist() for w in self.at[level]]
        first, last = 0, len(partial) - 1
        rest: list[Piece] = []
        while first <= last or rest:
            if first > last:
                size = sum(len(p[2]) // 4 for p in rest)
                length = int(np.flatnonzero(self.free[: size + 1])[-1]) if self.free[: size + 1].any() else size
                taken, rest = cut(rest, length)
                self.done.append(taken)
            elif not rest:
                rest, first = partial[first][1], first + 1
            else:
                level, window = partial[last]
                taken, rest = cut(rest, self.capacity - level)
                window += taken
                level += sum(len(p[2]) // 4 for p in taken)
                if level == self.capacity:
                    self.done.append(window)
                    last -= 1
                else:
                    partial[last] = (level, window)
        for level in range(self.capacity):
            self.at[level] = []
            self._count(level)
        self.open = 0


def cut(pieces: list[Piece], size: int) -> tuple[list[Piece], list[Piece]]:
    """The first ``size`` ids of some pieces, and the rest."""
    taken, rest = [], []
    for piece in pieces:
        doc, start, ids, total = piece
        length = len(ids) // 4
        if length <= size:
            taken.append(piece)
        elif size:
            taken.append((doc, start, ids[: 4 * size], total))
            rest.append((doc, start + size, ids[4 * size :], total))
        else:
            rest.append(piece)
        size -= min(size, length)
    return taken, rest


def _packed(path: str, end: int, capacity: int, free: list[int], open_windows: int, kind: pa.DataType) -> Callable:
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, windows = word_ids(path), Windows(capacity, free, open_windows)
        number = TaskContext.get().partitionId() << 32
        docs: dict[int, object] = {}  # of pieces that are not yet given out, by a running number
        left: dict[int, int] = {}
        seen = 0

        def given() -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows, size = [], 0
            done, windows.done = windows.done, []
            for window in done:
                offset = 0
                for doc, start, ids, total in window:
                    length = len(ids) // 4
                    rows.append((docs[doc], start, length, ids, total, number, offset))
                    offset += length
                    size += len(ids)
                    left[doc] -= length
                    if not left[doc]:
                        del left[doc], docs[doc]
                number += 1
                if size > AT_ONCE:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in in_blocks(source, "text"):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            long = len(texts) == 1 and len(texts[0]) > AT_ONCE
            coded = [words.of_long(texts[0])] if long else words.of_texts(texts)
            for doc, ids in zip(batch.column("doc").to_pylist(), coded):
                docs[seen], left[seen] = doc, len(ids) + 1
                windows.add(seen, np.append(ids, np.array([end], "<u4")))
                seen += 1
            yield from given()
        windows.close()
        yield from given()

    return batches


def pack(
    docs: DataFrame,
    path: str,
    end: int = 2,
    id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    free: Iterable[int] | None = None,
    open_windows: int = OPEN_WINDOWS,
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` ids.

    One row per piece: the id, ``start`` (ids of its document before it), ``length``, ``ids``
    (little-endian unsigned 32-bit), ``doc_tokens`` (ids of the document, with ``end``),
    ``sequence_id`` and ``offset`` (its place there; a sequence is filled from 0 without gaps).
    ``path`` names a tokenizer whose tokens never span white space. ``free`` are the fill levels
    that need no padding, powers of two by default; ``capacity`` is always among them.

    A null or empty text has the id ``end`` alone. Rows with a null id and repeated rows are
    packed as any other. Other columns are left out. No rows give no pieces. A text of any length
    is tokenized whole, in steps that end at white space. Nothing is shuffled; what a task has in
    memory is bounded by ``open_windows``, a block of texts and the longest text.
    """
    free = powers_of_two(capacity) if free is None else sorted(free)
    rows = docs.select(F.col(f"`{id}`").alias("doc"), text_of(F.col(f"`{text}`")).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    packed = rows.mapInArrow(_packed(path, end, capacity, free, open_windows, arrow_type(rows, "doc")), schema)
    return packed.withColumnRenamed("doc", id)
