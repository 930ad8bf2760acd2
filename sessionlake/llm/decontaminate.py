"""Benchmark decontamination by spaced seeds and local alignment.

A mask picks some of a few neighbouring words and ignores the others. What the masks pick at every
place of every text meets, on a hash, what they pick at every place of the benchmark items. The
region of the text around each hit is aligned with the whole item: an equal word counts one, a
different, an added or a missing one takes one away, and the best alignment of a part of the region
with a part of the item must reach ``SHARE`` of the item's length, or ``RUN``. So an item with up to
a fifth of its words substituted is found, likewise one cut up by added or missing words, an
unchanged part of three fifths, and any quotation of ``RUN`` words however long the item.

An item's mask follows from its length: the first of ``MASKS`` that as many substitutions as the
share allows cannot hit at all places, wherever they are (``fewest`` counts how many that takes). So
substitutions never hide an item from the seeds. Alignments with many added or missing words are
found if some stretch between these has all the words that the mask picks.

Words are runs of letters and digits in lower case, compared by 64-bit hashes. The seeds of a
text are generated inside one stage and, where the benchmark is small enough to broadcast,
looked up there too, so the seeds of clean texts never leave it. The size of the benchmark is
counted first; a larger one is joined by a shuffle, with the same result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.common import beside, restored, text_of
from sessionlake.session import freeze

TOKEN = r"[\p{L}\p{N}]+"
#: Places that a seed picks, counted from its first. Those between are ignored.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 2, 4), (0, 1, 3), (0, 1, 2), (0, 1), (0,))
#: Items from this many words on share a mask.
LONG = 60
SHARE = 0.6
#: Matches that the best alignment needs beyond edits, unless the item is shorter.
LEAST = 6
#: Matches beyond edits that are enough in an item of any length.
RUN = 25
#: Words of a benchmark whose seeds are broadcast; about 100 bytes for each.
BROADCAST_WORDS = 300_000


def tokens(text: Column) -> Column:
    """Hashes of the words of the whole text."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.transform(found, lambda w: F.xxhash64(w))


def _needed(words: Column, share: float, least: int) -> Column:
    """The score of an item of so many words, before ``RUN``."""
    return F.greatest(F.ceil(share * words), F.least(F.lit(least), words)).cast("int")


def fewest(mask: tuple[int, ...], longest: int) -> list[int]:
    """For items of 0 to ``longest`` words, how many must be substituted to hit the mask at all places.

    Goes through the item word by word; a state says which of the last words are substituted.
    """
    span = mask[-1] + 1
    picked = sum(1 << (span - 1 - place) for place in mask)
    cost, found = {0: 0}, [0]
    for size in range(1, longest + 1):
        after: dict[int, int] = {}
        for state, n in cost.items():
            for bit in (0, 1):
                last = state << 1 | bit
                if size < span or last & picked:
                    last &= (1 << span - 1) - 1
                    after[last] = min(after.get(last, longest + 1), n + bit)
        cost = after
        found.append(min(cost.values()))
    return found


def mask_numbers(share: float, least: int) -> list[int]:
    """The number of the mask for items of 0 to ``LONG`` words; the last one is for longer items too.

    Two items one after the other take at least as many substitutions as both. A mask that in all
    items of ``LONG / 2`` to ``LONG`` words takes more than the share allows does so in longer ones.
    """
    found = [fewest(mask, LONG) for mask in MASKS]
    numbers = []
    for n in range(LONG + 1):
        edits = (n - max(math.ceil(share * n), min(least, n))) // 2
        fits = [k for k, f in enumerate(found) if f[n] > edits]
        if n == LONG:
            fits = [k for k, f in enumerate(found) if all(f[m] > m * (1 - share) / 2 for m in range(LONG // 2, LONG + 1))]
        numbers.append(min(fits, default=len(MASKS) - 1))
    return numbers


def _seeds(words: str, at: str, numbers: list[int]) -> Column:
    """Hashes of what the masks pick from a place on, counted from zero; null beyond the end."""
    found = []
    for k in numbers:
        picked = ", ".join(f"{words}[{at} + {place}]" for place in MASKS[k])
        found.append(f"IF({at} + {MASKS[k][-1]} < size({words}), xxhash64({k}, {picked}), NULL)")
    return F.expr(f"array({', '.join(found)})")


def _windows(rows: DataFrame, words: str, at: str, numbers: list[int], keep: list[str]) -> DataFrame:
    places = f"IF(size({words}) > 0, sequence(0, size({words}) - 1), CAST(array() AS array<int>))"
    return (
        rows.select(*keep, words, F.explode(F.expr(places)).alias(at))
        .select(*keep, words, at, F.explode(_seeds(words, at, numbers)).alias("seed"))
        .where("seed IS NOT NULL")
    )


#: Hits are gathered in cells of two items' length. An alignment that scores has fewer than twice
#: the item's words, so that on either side is the region of all alignments with a hit in the cell.
CELL = "CAST(floor(at / (2 * n)) AS int)"
REGION = "slice(words, greatest(2 * n * (cell - 1), 0) + 1, 2 * n * least(3, cell + 2))"


def best_alignment() -> Column:
    """Of ``region`` and ``item``: the most that equal words less edits make up.

    The table of scores is filled along its other diagonals, where no score depends on the next.
    ``one`` and ``two`` are the last two of them, by place in the shorter side, after a border of zero.
    """
    short = "IF(size(region) < size(item), region, item)"
    long = "IF(size(region) < size(item), item, region)"
    border = "array_repeat(CAST(NULL AS bigint), least(size(region), size(item)))"
    zeros = "array_repeat(0, least(size(region), size(item)) + 1)"
    return F.expr(
        f"""aggregate(
            sequence(0, size(region) + size(item) - 2),
            named_struct('long', concat({border}, {long}, {border}), 'short', concat(array(CAST(NULL AS bigint)), {short}),
                'one', {zeros}, 'two', {zeros}, 'best', 0),
            (s, k) -> named_struct('long', s.long, 'short', s.short,
                'one', transform(s.short, (w, j) -> IF(j = 0, 0, greatest(0,
                    s.two[j - 1] + IF(s.long[k - j + size(s.short)] = w, 1, -1), s.one[j] - 1, s.one[j - 1] - 1))),
                'two', s.one,
                'best', greatest(s.best, array_max(s.one))),
            s -> greatest(s.best, array_max(s.one)))"""
    )


def alignments(
    docs: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    share: float = SHARE,
    least: int = LEAST,
    run: int = RUN,
) -> DataFrame:
    """``overlaps``, and ``first``: the place of the first hit, in words of the text from zero."""
    n = F.size("item")
    mask = F.element_at(F.array(*map(F.lit, mask_numbers(share, least))), F.least(n, F.lit(LONG)) + 1)
    items = freeze(
        benchmark.select(F.col(item).alias("item_id"), tokens(text_of(item_text)).alias("item"))
        .where(n > 0)
        .distinct()
        .select("item_id", "item", F.xxhash64("item").alias("key"), n.alias("n"), _needed(n, share, least).alias("needed"))
        .withColumn("mask", mask)
        .withColumn("needed", F.least("needed", F.lit(run)))
    )
    counted = items.agg(F.sum("n").alias("words"), F.collect_set("mask").alias("masks")).first()
    masks = sorted(counted["masks"])
    of_item = ["key", "n", "needed"]
    # An item that has a seed twice is hit once; its words stay behind.
    known = [_windows(items.where(F.col("mask") == k), "item", "place", [k], of_item) for k in masks or [0]]
    known = reduce(DataFrame.unionByName, known).select("seed", *of_item).distinct()
    rows = docs.select(F.col(id).alias("doc_id"), tokens(text_of(text)).alias("words"))
    windows = _windows(rows.withColumn("mark", F.xxhash64("words")), "words", "at", masks or [0], ["doc_id", "mark"])
    whole = items.select("key", "item_id", "item")
    cell = F.expr(CELL).alias("cell")
    # Only regions leave the stage that makes the windows: a window with its whole text would
    # be a row of the text's size, as many times as the text has words.
    if (counted["words"] or 0) <= BROADCAST_WORDS:
        whole = F.broadcast(whole)
        hits = windows.join(F.broadcast(known), "seed").select("doc_id", *of_item, "words", "at", cell)
    else:
        found = windows.drop("words").join(known, "seed").groupBy("doc_id", "mark", *of_item, cell).agg(F.min("at").alias("at"))
        same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("words") == F.col("mark"))
        hits = rows.join(found.withColumnRenamed("doc_id", "hit_id"), same)
    regions = (
        hits.select("doc_id", *of_item, "at", F.expr(REGION).alias("region"))
        .groupBy("doc_id", *of_item, "region")
        .agg(F.min("at").alias("at"))
    )
    # As many equal words as the alignment needs must be there at all.
    shared = F.expr("size(filter(item, w -> array_contains(region, w)))")
    return (
        regions.join(whole, "key")
        .withColumn("matched", F.when(shared >= F.col("needed"), best_alignment()).otherwise(0))
        .where("matched >= needed")
        .groupBy("doc_id", "item_id")
        .agg(F.max("matched").alias("matched"), F.max("n").alias("item_words"), F.min("at").alias("first"))
        .withColumnsRenamed({"doc_id": id, "item_id": item})
    )


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    share: float = SHARE,
    least: int = LEAST,
    run: int = RUN,
) -> DataFrame:
    """One row per text and benchmark item found in it: the ids, ``matched`` and ``item_words``.

    ``matched`` is the score of the best alignment. Items without words are in no text; items of up to ``least`` words are found only word for word. Null texts are empty. Texts and items
    that share an id count as one; a null id is an id too. An empty benchmark finds nothing.
    """
    return alignments(docs, benchmark, id, text, item, item_text, share, least, run).drop("first")


def without_overlaps(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", **options) -> DataFrame:
    """``docs`` less all rows whose id belongs to a text with a benchmark item in it."""
    found = overlaps(docs, benchmark, id=id, **options).select(F.col(id).alias("found")).distinct()
    rows = beside(docs, key=F.col(id))
    return restored(rows.join(found.hint("shuffle_hash"), F.col("key").eqNullSafe(F.col("found")), "left_anti"))
