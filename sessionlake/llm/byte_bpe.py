"""Byte-level BPE: encoding by ranked merges, and decoding.

Texts are cut by the tokenizer's pattern and gathered into blocks with a list of their
distinct words. Blocks ask for the ids of their words, in compressed requests dealt out by the
hash of the word, so that words meet and every distinct word is encoded once. Spark's
higher-order functions fold the merges over the bytes of each distinct word: in every step the
pair of neighbours with the lowest rank, the leftmost of equals, becomes one piece, until no
pair has a rank. Ranks are a literal in the plan, a hash table of small maps, since Spark looks
a key up in a map by going through it. The answers go back to the blocks, where the ids are
strung together along each text. Occurrences of words are never shuffled one by one.

Bytes are held as hex digits, two a byte, so that a piece is a string and joining is ``concat``.
The fold takes time with the square of a word's length; words of more than ``LONG`` bytes are
merged by a heap in the task instead, with the same result.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm.blocks import by_frequency, give_back, in_chunks, lean, packed, small_batches, strung, unpacked
from sessionlake.llm.common import text_of

LONG = 64
#: Words in a block at most, unless one text has more.
BLOCK_WORDS = 1_000_000
#: Bytes of token ids that a task has unpacked at once.
AT_ONCE = 1_000_000
#: Before the number of a bucket; no block has such a name.
BUCKET = "bucket "
#: Characters of a plan's description.
PLAN_STRING, PLAN_TEXT = "spark.sql.maxPlanStringLength", 20_000
#: What Spark has where no limit is set, the longest array less 15.
NO_LIMIT = str(2**31 - 16)
#: Small maps of the literal rank table.
SLOTS = 16_384
#: Distinct words and requested words that a row of a bucket holds, unless one request has more.
ROW_WORDS, ROW_ASKED = 100_000, 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 piece and its rank on each line. Its size bounds the literal."""
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}


def literal(ranks: dict[bytes, int]) -> Column:
    """The rank table: an array of maps, each for the pieces with one hash."""
    slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    for piece, rank in ranks.items():
        name = piece.hex().upper()
        slots[zlib.crc32(name.encode()) % SLOTS][name] = rank
    return F.from_json(F.lit(json.dumps(slots, separators=(",", ":"))), "array<map<string,int>>")


def _short_plans(spark: SparkSession) -> None:
    """Without a limit of the user's own, Spark's descriptions of plans get one: the driver would keep
    the whole rank table as text for every plan and stage."""
    if spark.conf.get(PLAN_STRING).rstrip("b") == NO_LIMIT:
        spark.conf.set(PLAN_STRING, str(PLAN_TEXT))


def _rank(piece: str) -> str:
    return f"ranks[cast(crc32({piece}) % {SLOTS} AS int)][{piece}]"


def fold(word: str) -> str:
    """SQL for the ids of a word given in hex, over a column ``ranks``.

    The state is the pieces ``p`` and the ranks ``r`` of neighbouring pairs. ``i`` is the place
    of the lowest rank, counted from one.
    """
    single = f"transform(sequence(1, length({word}) - 1, 2), j -> substr({word}, j, 2))"
    pairs = "transform(sequence(1, size(p) - 1), j -> concat(p[j - 1], p[j]))"
    start = (
        f"element_at(transform(array({single}), p -> named_struct('p', p, 'r', "
        f"IF(size(p) > 1, transform({pairs}, x -> {_rank('x')}), CAST(array() AS array<int>)))), 1)"
    )
    around = f"""transform(filter(array(
        IF(i > 1, concat(s.p[i - 2], s.p[i - 1], s.p[i]), ''),
        IF(i + 1 < size(s.p), concat(s.p[i - 1], s.p[i], s.p[i + 1]), '')), x -> x <> ''), x -> {_rank('x')})"""
    merged = f"""named_struct(
        'p', concat(slice(s.p, 1, i - 1), array(concat(s.p[i - 1], s.p[i])), slice(s.p, i + 2, size(s.p))),
        'r', concat(slice(s.r, 1, greatest(i - 2, 0)), {around}, slice(s.r, i + 2, size(s.r) + 1)))"""
    step = f"""element_at(transform(array(CAST(array_position(s.r, array_min(s.r)) AS int)),
        i -> IF(i IS NULL, s, {merged})), 1)"""
    folded = f"aggregate(sequence(1, length({word}) div 2), {start}, (s, k) -> {step}, s -> transform(s.p, x -> {_rank('x')}))"
    return f"IF({_rank(word)} IS NOT NULL, array({_rank(word)}), {folded})"


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of pairs; for words of any length."""
    left, right = list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
    piece: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    heap: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        j = right[i]
        if i >= 0 and j < len(word):
            pair = piece[i] + piece[j]
            if pair in ranks:
                heapq.heappush(heap, (ranks[pair], i, pair))

    for i in range(len(word)):
        offer(i)
    while heap:
        _, i, pair = heapq.heappop(heap)
        if piece[i] is None or right[i] >= len(word) or piece[i] + piece[right[i]] != pair:
            continue
        j = right[i]
        piece[i], piece[j] = pair, None
        right[i] = right[j]
        if right[i] < len(word):
            left[right[i]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [ranks[p] for p in piece if p is not None]


#: One shuffle takes two kinds of rows to their ``target``: blocks, and requests of blocks to
#: buckets of words.
SENT = (
    "target string NOT NULL, block string, ids array<long>, counts binary, places binary, answered binary, "
    "lengths binary, size long, text binary"
)


def _dealt(words: list[bytes], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its words), bucket by bucket."""
    hashes = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
    order = np.argsort(hashes, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(hashes[order])) + 1) if len(order) else []:
        yield int(hashes[places[0]]), places


def _to_blocks(buckets: int) -> Callable:
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SENT.split(", ")]
        task, made = TaskContext.get().partitionId(), 0
        types = [pa.string(), pa.string(), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.int64(), pa.binary()]
        for whole in source:
            sizes = np.diff(whole.column("words").offsets.to_numpy())
            for a, b in in_chunks(sizes, BLOCK_WORDS):
                batch = whole.slice(a, b - a)
                coded = batch.column("words").flatten().dictionary_encode()
                places, order = by_frequency(coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary))
                counts, places = packed(sizes[a:b]), packed(places)
                words = [w.encode() for w in coded.dictionary.take(pa.array(order)).to_pylist()]
                ids = batch.column("id").to_pylist()
                # The same if the block is made again; blocks of other tasks may have the same content.
                made += 1
                content = xxhash.xxh128(repr(ids).encode() + counts + places + b"\n".join(words)).hexdigest()
                name = f"{task}-{made}-{content}"
                # Answers come bucket by bucket: where among them that for each word is.
                dealt = list(_dealt(words, buckets))
                answered = np.zeros(len(words), np.int64)
                answered[np.concatenate([at for _, at in dealt] or [np.empty(0, np.int64)])] = np.arange(len(words))
                rows = [(name, None, ids, counts, places, packed(answered), None, None, None)]
                for bucket, at in dealt:
                    asked = [words[i] for i in at.tolist()]
                    text = b"".join(asked)
                    lengths = packed(np.array([len(w) for w in asked]))
                    zipped = pa.compress(text, codec="zstd", asbytes=True)
                    rows.append((f"{BUCKET}{bucket}", name, None, None, None, None, lengths, len(text), zipped))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                del batch, coded, places, words, rows
            # An idle worker would keep what it took while Spark needs the memory.
            del whole
            give_back()

    return batches


def _distinct(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of a bucket, and the blocks with the places of the words they asked for.

    One row per bucket, or several where the bucket's words or requests are many; a word is
    then encoded once per row.
    """

    def requests() -> Iterator[dict]:
        for batch in source:
            asked = batch.select(["target", "block", "lengths", "size", "text"])
            asked = asked.filter(pc.is_valid(asked.column("block")))
            for row in range(asked.num_rows):
                yield from asked.slice(row, 1).to_pylist()

    def row(target: str, blocks: list[str], asked: list[bytes], place: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([int(target.removeprefix(BUCKET))], pa.int32()),
                pa.array([blocks], pa.list_(pa.string())),
                pa.array([asked], pa.list_(pa.binary())),
                pa.array([[w.decode() for w in place]], pa.list_(pa.string())),
            ],
            ["bucket", "blocks", "asked", "words"],
        )

    for target, group in groupby(requests(), key=lambda r: r["target"]):
        place: dict[bytes, int] = {}
        blocks, asked, held = [], [], 0
        for r in group:
            text = pa.decompress(r["text"], decompressed_size=r["size"], codec="zstd", asbytes=True)
            ends = np.cumsum(unpacked(r["lengths"]), dtype=np.int64).tolist()
            if blocks and (len(place) > ROW_WORDS or held + len(ends) > ROW_ASKED):
                yield row(target, blocks, asked, place)
                place, blocks, asked, held = {}, [], [], 0
            held += len(ends)
            blocks.append(r["block"])
            asked.append(
                packed(np.array([place.setdefault(text[a:b], len(place)) for a, b in zip([0, *ends], ends)]))
            )
        yield row(target, blocks, asked, place)


def _answers(ranks: dict[bytes, int]) -> Callable:
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in range(batch.num_rows):
                lists = batch.column("tokens")[row].values
                lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                tokens = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
                starts = np.cumsum(lengths) - lengths
                rest = batch.column("long_words")[row].as_py()
                if rest:
                    extra = [np.array(merge_long(w.encode(), ranks), "<u4") for w in rest]
                    at = np.flatnonzero(lengths == 0)
                    lengths[at] = [len(e) for e in extra]
                    starts[at] = len(tokens) + np.cumsum(lengths[at]) - lengths[at]
                    tokens = np.concatenate([tokens, *extra])
                blocks = batch.column("blocks")[row].as_py()
                places = [unpacked(a) for a in batch.column("asked")[row].as_py()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(blocks),
                        pa.array([batch.column("bucket")[row].as_py()] * len(blocks), pa.int32()),
                        pa.array([packed(lengths[p]) for p in places], pa.binary()),
                        pa.array([packed(strung(tokens, starts, lengths, p)) for p in places], pa.binary()),
                    ],
                    ["name", "bucket", "lengths", "tokens"],
                )

    return batches


def _string(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of every text, from its block and the answers the block got."""
    for batch in source:
        for row in np.flatnonzero(batch.column("ids").is_valid().to_numpy(zero_copy_only=False)).tolist():
            pa.default_memory_pool().release_unused()
            answers = sorted(batch.column("answers")[row].as_py() or [], key=lambda a: a["bucket"])
            none = [np.empty(0, "<u4")]
            lengths = np.concatenate([unpacked(a["lengths"]) for a in answers] or none).astype(np.int64)
            tokens = np.concatenate([unpacked(a["tokens"]) for a in answers] or none)
            answered = unpacked(batch.column("answered")[row].as_py())
            starts = (np.cumsum(lengths) - lengths)[answered]
            lengths = lengths[answered]
            ids = batch.column("ids")[row].values
            counts = unpacked(batch.column("counts")[row].as_py()).astype(np.int64)
            places = unpacked(batch.column("places")[row].as_py())
            ends = np.concatenate([[0], np.cumsum(counts)])
            for a, b in in_chunks(counts, AT_ONCE // 16):
                mine = places[ends[a] : ends[b]]
                flat = strung(tokens, starts, lengths, mine)
                inner = np.concatenate([[0], np.cumsum(lengths[mine])])[ends[a : b + 1] - ends[a]]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        pa.array([flat[x:y].tobytes() for x, y in zip(inner, inner[1:])], pa.binary()),
                    ],
                    ["id", "packed"],
                )


def _answered(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id: str, text: str) -> DataFrame:
    """The blocks, each with the ids of its words."""
    # In Java's patterns \\s means ASCII white space unless (?U) says all of Unicode's.
    small_batches(docs.sparkSession)
    words = F.regexp_extract_all(text_of(text), F.lit("(?U)" + pattern), F.lit(0))
    number = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(256, 4 * number)
    # Both uses below take this one shuffle.
    sent = (
        docs.select(F.col(id).cast("long").alias("id"), words.alias("words"))
        .mapInArrow(lean(_to_blocks(buckets)), SENT)
        .repartition(number, "target")
    )
    _short_plans(docs.sparkSession)
    asked = sent.sortWithinPartitions("target").mapInArrow(
        lean(_distinct), "bucket int, blocks array<string>, asked array<binary>, words array<string>"
    )
    short = f"octet_length(w) <= {LONG}"
    none = "CAST(array() AS array<int>)"
    # Bound to a variable, the table occurs once in the plan. Spark would copy a column of literals
    # to every place that names it, and describes each to the listeners whenever a plan changes.
    tokens = f"transform(transform(words, w -> IF({short}, hex(w), '')), h -> IF(h = '', {none}, {fold('h')}))"
    folded = asked.withColumn("tables", F.array(literal(ranks))).select(
        "bucket",
        "blocks",
        "asked",
        F.expr(f"element_at(transform(tables, ranks -> {tokens}), 1)").alias("tokens"),
        F.expr(f"filter(words, w -> NOT {short})").alias("long_words"),
    )
    answers = (
        folded.mapInArrow(lean(_answers(ranks)), "name string, bucket int, lengths binary, tokens binary")
        .groupBy("name")
        .agg(F.collect_list(F.struct("bucket", "lengths", "tokens")).alias("answers"))
    )
    return (
        sent.join(answers, F.col("target") == F.col("name"), "left")
        # Requests are done with. On both sides, or Spark would filter below the shuffle and make
        # two of it.
        .where("ids IS NOT NULL OR answers IS NOT NULL")
    )


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its id and ``packed``, the token ids as little-endian unsigned 32-bit integers.

    A null or empty text has no tokens. No special tokens are recognised: their strings are
    ordinary text. Rows with a null id and repeated rows are encoded as any other.
    """
    blocks = _answered(docs, ranks, pattern, id, text)
    return blocks.mapInArrow(lean(_string), "id long, packed binary").withColumnRenamed("id", id)


def round_trip(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``decode(encode(docs))``, with the ids decoded in the worker that strung them together.

    A task then has one Python worker instead of two, and the ids don't go through the JVM between.
    """
    back = _decoder(ranks, "id")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return back(_string(source))

    blocks = _answered(docs, ranks, pattern, id, text)
    return blocks.mapInArrow(lean(batches), "id long, packed binary, decoded binary").withColumnRenamed("id", id)


def _decoder(ranks: dict[bytes, int], id: str) -> Callable:
    pieces = sorted(ranks.items(), key=lambda item: item[1])
    if [rank for _, rank in pieces] != list(range(len(pieces))):
        raise ValueError("ranks must be 0, 1, 2 and so on")
    flat = np.frombuffer(b"".join(p for p, _ in pieces), np.uint8)
    lengths = np.array([len(p) for p, _ in pieces])
    starts = np.cumsum(lengths) - lengths

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in source:
            sizes = pc.binary_length(whole.column("packed")).to_numpy(zero_copy_only=False)
            for a, b in in_chunks(sizes, AT_ONCE):
                pa.default_memory_pool().release_unused()
                batch = whole.slice(a, b - a)
                texts = [
                    strung(flat, starts, lengths, np.frombuffer(p, "<u4")).tobytes()
                    for p in batch.column("packed").to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id), batch.column("packed"), pa.array(texts, pa.binary())], [id, "packed", "decoded"]
                )

    return batches


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` with ``decoded``, the pieces of all ids put together. Its columns are an id and ``packed``."""
    id = next(c for c in encoded.columns if c != "packed")
    made = f"`{id}` long, packed binary, decoded binary"
    return encoded.select(id, "packed").mapInArrow(lean(_decoder(ranks, id)), made)
