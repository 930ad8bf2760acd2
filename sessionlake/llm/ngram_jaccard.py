"""Join of texts whose sets of word n-grams have a high Jaccard similarity.

Jaccard distance is a metric, and so is its restriction to a part of all n-grams. Two steps
use that.

*Parts.* In the whole space almost all texts are at distance 1 from any pivot, so regions
around pivots would separate nothing. Instead n-grams are dealt by hash into so many parts
that two linked texts must agree exactly on a part that is not empty: they differ in at most
D n-grams, and there are more than D parts beside the empty ones. In the space of one part
every occurring subset is a pivot, its region are the texts with that subset, and two regions
are further apart than a linked pair can be, so no text needs to be in two of them. Texts are
compared only if they share such a region, in as many parts as a linked pair must have in
common. Pairs and regions that overlap are united into components.

*Regions.* A component of up to ``limit`` texts is joined in one task. A larger one is split by
pivots drawn from it. Each text has its home in the Voronoi region of its nearest pivot, or, if
none is within ``RADIUS``, in the region outside. It is also a guest where the triangle
inequality lets texts linked to it have their homes: in regions whose pivot is at most twice
the allowed distance further away than its own and at most the allowed distance beyond
``RADIUS``, and outside if it is within the allowed distance of that border. Regions are split
again until they are small; a region that pivots cannot split, since its texts are about
equally near or far, is cut into blocks, and blocks are joined two by two.

Both steps are exact up to collisions of 64-bit hashes of n-grams: there are no caps, and every
pair that shares a region is either compared or ruled out by one of the bounds above.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.blocks import in_blocks, lean, small_batches
from sessionlake.llm.common import beside, restored, text_of
from sessionlake.llm.components import components
from sessionlake.session import freeze

#: Texts that one task joins.
LIMIT = 600
#: Texts of a part's region that are paired with each other; a larger region is kept whole.
SMALL = 16
#: Pivots of one split, and splits before a region is cut into blocks.
PIVOTS = 8
DEPTH = 2
#: A text further than this from all pivots has its home outside their regions.
RADIUS = 0.5
OUTSIDE = PIVOTS
#: Sizes within this ratio share a division into parts.
RATIO = 1.43
#: N-grams handled at once in a task.
CHUNK = 1_000_000
#: An element in more than one set of so many, and in more than so many, is common. Rows and columns of a matrix
#: of sets and common elements that are multiplied at once.
COMMON, STRIP, COLUMNS = 20, 1_024, 4_096
#: Seeds tried before empty parts count as parts.
SEEDS = 32

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def salted(h: np.ndarray, salt: int) -> np.ndarray:
    return mixed(h + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64))


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of all texts, A-Z in lower case, as places in a list of distinct words, and words per text."""
    # A copy: the functions below go wrong on a slice of a larger array.
    texts = pa.array(texts.to_pylist(), pa.string()) if texts.offset else texts
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    del texts
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    del lists
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int32)])
    counts = (before[offsets[1:]] - before[offsets[:-1]]).astype(np.int64)
    del before, offsets
    encoded = flat.filter(full).dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary, counts


def ngram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct n-grams of each text; of a shorter text the whole sequence."""
    places, distinct, counts = split_words(texts)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))
    flat = mixed(hashes)[places] if len(places) else np.empty(0, np.uint64)
    grams = flat[: max(0, len(flat) - n + 1)].copy()
    for k in range(1, n):
        grams = mixed(grams * GOLDEN + flat[k : k + len(grams)])
    sets, at = [], 0
    for count in counts.tolist():
        if count >= n:
            sets.append(np.unique(grams[at : at + count - n + 1]))
        elif count:
            whole = np.array([count], np.uint64)
            for h in flat[at : at + count]:
                whole = mixed(whole * GOLDEN + h)
            sets.append(whole)
        else:
            sets.append(np.empty(0, np.uint64))
        at += count
    return sets


def size_classes(num: int, den: int, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower bounds of the classes of sizes; for each the parts, and how many of them may be empty.

    A class serves the pairs whose smaller set is in it. Such a pair differs in at most
    ``differing`` elements, so with ``differing + 1 + spare`` parts at least ``spare + 1`` agree.
    """
    bounds = [1]
    while bounds[-1] <= largest:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * RATIO)))
    low = np.array(bounds, np.int64)
    most = low[1:] - 1
    differing = (most + most * den // num) * (den - num) // (den + num)
    spare = np.maximum(1, differing // 3)
    return low, np.where(differing > 0, differing + 1 + spare, 0), spare


def signatures(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every part that a set has something in: signature, index of the set, agreements needed.

    A linked pair agrees in ``spare + 1`` parts at least, less those empty in both. So it has
    as many signatures in common as one of its sets needs. Where more parts than the spare ones
    are empty nothing is certain, and the set has signatures for one more seed.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    low, parts, spare = size_classes(num, den, int(sizes.max(initial=1)))
    own = np.searchsorted(low, sizes, "right") - 1
    jobs, classes = [], []
    for lower in range(len(low)):
        # The class of the set itself, and lower ones as far as a linked smaller set can be in them.
        c = own - lower
        fits = (sizes > 0) & (c >= 0)
        fits[fits] &= (lower == 0) | ((low[c[fits] + 1] - 1) * den >= num * sizes[fits])
        if not fits.any():
            break
        jobs.append(np.flatnonzero(fits))
        classes.append(c[fits])
    if not jobs:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    job, cls = np.concatenate(jobs), np.concatenate(classes)
    job, cls = job[parts[cls] > 0], cls[parts[cls] > 0]
    found, owners, needs = [], [], []
    for seed in range(SEEDS):
        if not len(job):
            break
        elements = np.concatenate([sets[i] for i in job.tolist()])
        number = parts[cls]
        first = np.concatenate([[0], np.cumsum(number)])
        rank = np.repeat(np.arange(len(job)), sizes[job])
        part = (salted(elements, 2 * seed + 1) % number.astype(np.uint64)[rank]).astype(np.int64)
        slot = first[rank] + part
        content = np.zeros(first[-1], np.uint64)
        np.add.at(content, slot, salted(elements, 2 * seed + 2))
        full = np.zeros(first[-1], bool)
        full[slot] = True
        empty = number - np.add.reduceat(full, first[:-1])
        owner = np.repeat(np.arange(len(job)), number)
        within = np.arange(first[-1]) - first[owner]
        label = mixed(((cls[owner] * SEEDS + seed) * 2**32 + within).astype(np.uint64))
        take = full if seed < SEEDS - 1 else full | (empty > spare[cls])[owner]
        found.append(mixed(content * GOLDEN + label)[take])
        owners.append(job[owner[take]])
        needs.append(np.maximum(0, spare[cls] + 1 - empty)[owner[take]])
        again = empty > spare[cls]
        job, cls = job[again], cls[again]
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found), np.concatenate(owners), np.concatenate(needs)


#: In place of a need: the region is large, its other nodes are not here.
LARGE = -1
PART = np.dtype([("key", "<u8"), ("node", "<i8"), ("need", "<i4")])
EDGE = np.dtype([("a", "<i8"), ("b", "<i8"), ("n", "<i8"), ("need", "<i4")])


def by_key(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct parts by key and node, and where each key starts and how often it occurs."""
    parts = parts[np.lexsort((parts["need"], parts["node"], parts["key"]))]
    new = np.ones(len(parts), bool)
    new[1:] = (parts["key"][1:] != parts["key"][:-1]) | (parts["node"][1:] != parts["node"][:-1])
    parts = parts[new]
    starts = np.flatnonzero(np.concatenate([[True], parts["key"][1:] != parts["key"][:-1]])) if len(parts) else np.empty(0, int)
    return parts, starts, np.diff(np.append(starts, len(parts)))


def edges_of(a: np.ndarray, b: np.ndarray, need: np.ndarray) -> np.ndarray:
    edges = np.zeros(len(a), EDGE)
    edges["a"], edges["b"], edges["n"], edges["need"] = a, b, 1, need
    return edges


def pairs(parts: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Edges between all nodes of small regions."""
    found = [np.empty(0, EDGE)]
    for i in range(SMALL - 1):
        for j in range(i + 1, SMALL):
            at = starts[sizes > j]
            if not len(at):
                break
            x, y = parts[at + i], parts[at + j]
            found.append(edges_of(x["node"], y["node"], np.maximum(x["need"], y["need"])))
    return np.concatenate(found)


def counted(edges: np.ndarray) -> np.ndarray:
    """One edge per pair, with how many there were and the least that any of them needs."""
    if not len(edges):
        return edges
    edges = edges[np.lexsort((edges["b"], edges["a"]))]
    new = np.concatenate([[True], (edges["a"][1:] != edges["a"][:-1]) | (edges["b"][1:] != edges["b"][:-1])])
    at = np.flatnonzero(new)
    one = edges[at]
    one["n"], one["need"] = np.add.reduceat(edges["n"], at), np.minimum.reduceat(edges["need"], at)
    return one


DOC = np.dtype([("id", "<i8"), ("known", "u1"), ("n", "<i8"), ("node", "<i8"), ("digest", "V16")])
PACKED = "bucket int, kind int, packed binary"
UNPACKED = "kind int, a long, b long, n long, need int, digest binary"
DOCS, PARTS, MEMBERS, EDGES = 0, 1, 2, 3


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(s.tobytes())


def _chunks(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, s in enumerate(sets):
        total += len(s)
        if total >= CHUNK:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sets):
        yield start, len(sets)


def _pack(n: int, num: int, den: int, buckets: int) -> Callable:
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in in_blocks(source, "text"):
            sets = ngram_sets(batch.column(1), n)
            ids = batch.column(0)
            docs = np.zeros(len(sets), DOC)
            docs["id"] = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
            docs["known"] = ids.is_valid().to_numpy(zero_copy_only=False)
            docs["n"] = [len(s) for s in sets]
            digests = [_digest(s) for s in sets]
            docs["digest"] = np.array(digests, "V16")
            docs["node"] = np.frombuffer(b"".join(d[:8] for d in digests), "<i8")
            rows: list[tuple[int, int, bytes]] = []

            def deal(kind: int, keys: np.ndarray, packed: np.ndarray) -> None:
                to = (keys % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                ends = np.searchsorted(to[order], np.arange(buckets + 1))
                for bucket in np.unique(to).tolist():
                    some = packed[order[ends[bucket] : ends[bucket + 1]]]
                    rows.append((bucket, kind, some.tobytes()))

            deal(DOCS, mixed(np.arange(len(docs)).astype(np.uint64) + docs["node"].view(np.uint64)), docs)
            # A set that this task has had already adds no signature.
            fresh = [i for i, d in enumerate(digests) if not (d in seen or seen.add(d))]
            kept, nodes = [sets[i] for i in fresh], docs["node"][fresh]
            for a, b in _chunks(kept):
                keys, owner, need = signatures(kept[a:b], num, den)
                parts = np.zeros(len(keys), PART)
                parts["key"], parts["node"], parts["need"] = keys, nodes[a:b][owner], need
                parts, starts, sizes = by_key(parts)
                # Of a large region one node goes on to say so. The others need not meet in one
                # task, and are dealt out evenly.
                large = sizes > SMALL
                within = np.repeat(large, sizes)
                members = parts[within]
                deal(MEMBERS, mixed(members["key"] ^ members["node"].view(np.uint64)), members)
                lead = np.zeros(len(parts), bool)
                lead[starts] = True
                parts["need"][starts[large]] = LARGE
                parts = parts[lead | ~within]
                deal(PARTS, parts["key"], parts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int32()),
                    pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2] for r in rows], pa.binary()),
                ],
                ["bucket", "kind", "packed"],
            )

    return batches


def by_group(source: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal ``key``, which comes sorted."""
    held: list[pa.RecordBatch] = []
    for batch in source:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[-1].column(key)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _unpack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["kind", "a", "b", "n", "need", "digest"]
    for group in by_group(source, "bucket"):
        kinds = group.column("kind").to_pylist()
        blobs = group.column("packed").to_pylist()
        joined = {k: b"".join(b for i, b in zip(kinds, blobs) if i == k) for k in (DOCS, PARTS, MEMBERS)}
        docs = np.frombuffer(joined[DOCS], DOC)
        if len(docs):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(docs), DOCS, np.int32)),
                    pa.array(docs["id"].copy(), mask=docs["known"] == 0),
                    pa.array(docs["node"].copy()),
                    pa.array(docs["n"].copy()),
                    pa.nulls(len(docs), pa.int32()),
                    pa.array([d.tobytes() for d in docs["digest"]], pa.binary()),
                ],
                names,
            )
        parts, starts, sizes = by_key(np.frombuffer(joined[PARTS], PART))
        large = sizes > SMALL
        if len(parts):
            large |= np.minimum.reduceat(parts["need"], starts) == LARGE
        edges = counted(pairs(parts, starts[~large], sizes[~large]))
        if len(edges):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(edges), EDGES, np.int32)),
                    *(pa.array(edges[c].copy()) for c in ("a", "b", "n", "need")),
                    pa.nulls(len(edges), pa.binary()),
                ],
                names,
            )
        here = parts[np.repeat(large, sizes)]
        members = np.concatenate([np.frombuffer(joined[MEMBERS], PART), here[here["need"] != LARGE]])
        if len(members):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(members), MEMBERS, np.int32)),
                    pa.array(members["key"].view(np.int64).copy()),
                    pa.array(members["node"].copy()),
                    pa.nulls(len(members), pa.int64()),
                    pa.array(members["need"].copy()),
                    pa.nulls(len(members), pa.binary()),
                ],
                names,
            )


REGION = "region long, side int, home boolean, digest binary, grams binary"
LINKED = "digest binary, lead binary, links long"


def _row_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(columns[0], pa.int64()),
            pa.array(columns[1], pa.int32()),
            pa.array(columns[2], pa.bool_()),
            pa.array(columns[3], pa.binary()),
            pa.array(columns[4], pa.binary()),
        ],
        ["region", "side", "home", "digest", "grams"],
    )


def _as_sets(n: int) -> Callable:
    """Sets of the chosen texts; a text that only shares the id of the chosen one is left out."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(source, "text"):
            sets = ngram_sets(batch.column("text"), n)
            right = [i for i, (s, d) in enumerate(zip(sets, batch.column("digest").to_pylist())) if _digest(s) == d]
            chosen = batch.take(pa.array(right, pa.int64()))
            rows = [
                (region, -1, True, digest, sets[i].tobytes())
                for i, region, digest in zip(right, chosen.column("region").to_pylist(), chosen.column("digest").to_pylist())
            ]
            if rows:
                yield _row_batch(rows).append_column("size", chosen.column("size"))

    return batches


def overlaps(sets: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each set, how many elements it has in common with each of ``sets``.

    Elements in many of the sets, as near copies have them, are counted by a product of matrices; going
    through the sets of each would take the square of their number.
    """
    sizes = [len(s) for s in sets]
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    held = np.bincount(term)
    common = (held * COMMON > len(sets)) & (held > COMMON)
    number = np.cumsum(common) - 1
    order = np.argsort(term, kind="stable")
    posting, ends = owner[order], np.concatenate([[0], np.cumsum(held)])
    for a in range(0, len(sets), STRIP):
        strip = np.zeros((min(STRIP, len(sets) - a), len(sets)), np.int64)
        for c in range(0, int(common.sum()), COLUMNS):
            here = common[term] & (number[term] >= c) & (number[term] < c + COLUMNS)
            matrix = np.zeros((len(sets), min(COLUMNS, int(common.sum()) - c)), np.float32)
            matrix[owner[here], number[term[here]] - c] = 1
            strip += (matrix[a : a + STRIP] @ matrix.T).astype(np.int64)
        at = sum(sizes[:a])
        for k, size in enumerate(sizes[a : a + STRIP]):
            mine = term[at : at + size]
            at += size
            mine = mine[~common[mine]]
            lengths = ends[mine + 1] - ends[mine]
            jump = np.repeat(ends[mine] - (np.cumsum(lengths) - lengths), lengths)
            yield strip[k] + np.bincount(posting[jump + np.arange(lengths.sum())], minlength=len(sets))


def _join_region(num: int, den: int) -> Callable:
    """Links within each region, each found where the text with the smaller digest is at home."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(source, "region"):
            rows = sorted(
                dict(
                    zip(
                        group.column("digest").to_pylist(),
                        zip(
                            group.column("side").to_pylist(),
                            group.column("home").to_pylist(),
                            group.column("grams").to_pylist(),
                        ),
                    )
                ).items()
            )
            if len(rows) < 2:
                continue
            digests = [d for d, _ in rows]
            side = np.array([r[0] for _, r in rows])
            home = np.array([r[1] for _, r in rows])
            sets = [np.frombuffer(r[2], np.uint64) for _, r in rows]
            sizes = np.array([len(s) for s in sets])
            lead, links = np.arange(len(rows)), np.zeros(len(rows), np.int64)

            for i, common in enumerate(overlaps(sets)):
                later = common[i + 1 :]
                near = den * later >= num * (sizes[i] + sizes[i + 1 :] - later)
                near &= home[i] & ((side[i] < 0) | (side[i] != side[i + 1 :]))
                at = np.flatnonzero(near) + i + 1
                links[i] += len(at)
                links[at] += 1
                tops = np.unique(np.append(lead[at], lead[i]))
                if len(tops) > 1:
                    lead[np.isin(lead, tops)] = tops[0]
            linked = np.flatnonzero(links).tolist()
            if linked:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([digests[i] for i in linked], pa.binary()),
                        pa.array([digests[lead[i]] for i in linked], pa.binary()),
                        pa.array(links[linked]),
                    ],
                    ["digest", "lead", "links"],
                )

    return batches


def distances(s: np.ndarray, pivots: list[np.ndarray]) -> np.ndarray:
    found = []
    for p in pivots:
        common = len(np.intersect1d(s, p, assume_unique=True))
        found.append(1 - common / (len(s) + len(p) - common))
    return np.array(found)


def _split_region(allowed: float) -> Callable:
    """Rows of the regions around the pivots, which come first in each group."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(source, "slice"):
            pivots = []
            for batch in group.to_batches(max_chunksize=500):
                rows = []
                for region, home, digest, grams, place in zip(
                    *(batch.column(c).to_pylist() for c in ("region", "home", "digest", "grams", "place"))
                ):
                    s = np.frombuffer(grams, np.uint64)
                    if place >= 0:
                        pivots.append(s)
                        continue
                    d = distances(s, pivots)
                    nearest = int(d.argmin())
                    own = nearest if d[nearest] < RADIUS else OUTSIDE
                    # A little wider than allowed, against rounding.
                    reach = RADIUS + allowed if own == OUTSIDE else min(RADIUS + allowed, d[nearest] + 2 * allowed)
                    into = np.flatnonzero(d <= reach + 1e-9).tolist()
                    if d[nearest] >= RADIUS - allowed - 1e-9:
                        into.append(OUTSIDE)
                    for k in into:
                        within = int(salted(np.array([region], np.int64).view(np.uint64), k + 1).view(np.int64)[0])
                        rows.append((within, -1, home and k == own, digest, grams))
                if rows:
                    yield _row_batch(rows)

    return batches


def _split(regions: DataFrame, sizes: DataFrame, allowed: float, limit: int) -> DataFrame:
    """Large regions around pivots; rows are sliced, and each slice gets its own copy of the pivots."""
    drawn = regions.where("home").groupBy("region").agg(
        *(
            F.min_by(F.struct("digest", "grams"), F.xxhash64("region", "digest", F.lit(k))).alias(f"p{k}")
            for k in range(PIVOTS)
        )
    )
    pivots = (
        drawn.join(sizes, "region")
        .select("region", "slices", F.posexplode(F.array_distinct(F.array(*(f"p{k}" for k in range(PIVOTS))))))
        .select("region", F.lit(True).alias("home"), "col.digest", "col.grams", F.col("pos").alias("place"),
                F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("n"))
    )
    rows = regions.join(sizes, "region").select(
        "region", "home", "digest", "grams", F.lit(-1).alias("place"),
        F.pmod(F.xxhash64("digest"), "slices").cast("int").alias("n"),
    )
    together = pivots.unionByName(rows).withColumn("slice", F.xxhash64("region", "n"))
    return (
        together.repartition("slice")
        .sortWithinPartitions("slice", F.col("place") < 0, "place")
        .select("region", "home", "digest", "grams", "place", "slice")
        .mapInArrow(lean(_split_region(allowed)), REGION)
    )


def _blocks(regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """Large regions as pairs of blocks: every pair of texts meets in exactly one."""
    own = regions.join(sizes, "region").withColumn("own", F.pmod(F.xxhash64("digest"), F.col("slices") * 2).cast("int"))
    return own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") * 2 - 1))).select(
        F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("region"),
        F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
        "home",
        "digest",
        "grams",
    )


def _joined(regions: DataFrame, num: int, den: int) -> DataFrame:
    return (
        regions.repartition("region").sortWithinPartitions("region").mapInArrow(lean(_join_region(num, den)), LINKED)
    )


def _agreeing(seen: DataFrame) -> DataFrame:
    """Pairs that agree in enough parts.

    Agreements are counted in small regions. In large ones a pair can have at most as many more
    as either of its nodes has large regions. Only nodes with as many large regions as they
    need agreements can be linked through those alone, and only these are united there.
    """
    # Dealt by node once, for all of the steps that go by it: a node has only so many parts.
    members = (
        seen.where(F.col("kind") == MEMBERS)
        .select(F.col("a").alias("key"), F.col("b").alias("node"), "need")
        .repartition("node")
        .distinct()
    )
    crowded = members.groupBy("node").agg(F.count_distinct("key").alias("k"), F.min("need").alias("need"))
    alone = members.join(crowded.where("k >= need").select("node"), "node").select("key", "node")
    leads = alone.groupBy("key").agg(F.min("node").alias("lead"))
    stars = alone.join(leads, "key").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    more = [crowded.select(F.col("node").alias(c), F.col("k").alias(f"k{c}")) for c in ("a", "b")]
    return (
        seen.where(F.col("kind") == EDGES)
        .groupBy("a", "b")
        .agg(F.sum("n").alias("n"), F.min("need").alias("need"))
        .join(more[0], "a", "left")
        .join(more[1], "b", "left")
        .where("n + least(coalesce(ka, 0), coalesce(kb, 0)) >= need")
        .select("a", "b")
        .unionByName(stars)
    )


def jaccard_join(
    docs: DataFrame,
    n: int = 5,
    num: int = 4,
    den: int = 5,
    id: str = "doc_id",
    text: str = "text",
    limit: int = LIMIT,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``n_links``.

    Two texts link if their similarity is at least ``num / den``, compared in whole numbers.
    ``component_id`` is the smallest id reachable by links; ``n_links`` counts the different
    sets linked with, copies of the own one not included. A null text is empty; empty texts
    link with nothing, copies of them neither. Repeated rows are copies. A row with a null id
    takes part, but only gives its component a name if no row there has an id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    buckets = max(1024, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id).cast("long").alias("id"), text_of(text).alias("text"))
    seen = freeze(
        rows.mapInArrow(lean(_pack(n, num, den, buckets)), PACKED)
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(lean(_unpack), UNPACKED)
    )
    known = seen.where(F.col("kind") == DOCS).select(
        F.col("a").alias("id"), F.col("b").alias("node"), F.col("n").alias("n_shingles"), "digest"
    )
    candidate = components(_agreeing(seen))
    # One text of each set that shares a region with another set.
    chosen = freeze(
        known.where("n_shingles > 0")
        .join(candidate, "node")
        .groupBy("digest")
        .agg(F.min("id").alias("id"), F.min("component").alias("region"))
    )
    counted = chosen.groupBy("region").agg(F.count("*").alias("size"))
    sized = freeze(chosen.join(counted.where("size > 1"), "region"))

    few = sized.select(F.col("id").alias("_id"), "digest", "region", "size").hint("shuffle_hash")
    sets = freeze(
        rows.join(few, F.col("id").eqNullSafe(F.col("_id")))
        .select("region", "size", "digest", "text")
        .mapInArrow(lean(_as_sets(n)), f"{REGION}, size long")
    )
    linked = [freeze(_joined(sets.where(F.col("size") <= limit).drop("size"), num, den))]
    large = sets.where(F.col("size") > limit).drop("size")
    depth = 0
    regions = None if large.isEmpty() else freeze(large.dropDuplicates(["digest"]))
    while regions is not None:
        sizes = freeze(
            regions.groupBy("region")
            .agg(F.count("*").alias("size"), F.count_if("home").alias("homes"))
            .where("homes > 0 AND size > 1")
        )
        fit = regions.join(sizes.where(F.col("size") <= limit).select("region"), "region")
        linked.append(freeze(_joined(fit, num, den)))
        wide = sizes.where(F.col("size") > limit).select(
            "region", F.ceil(F.col("size") / limit).cast("int").alias("slices")
        )
        if wide.isEmpty():
            break
        if depth < DEPTH:
            regions = freeze(_split(regions, wide, 1 - num / den, limit))
        else:
            linked.append(freeze(_joined(_blocks(regions, wide), num, den)))
            break
        depth += 1
    links = linked[0]
    for more in linked[1:]:
        links = links.unionByName(more)
    united = components(links.select("digest", "lead"))
    named = united.select(F.col("node").alias("digest"), "component")
    counts = links.groupBy("digest").agg(F.sum("links").alias("n_links"))
    classed = known.join(named, "digest", "left").join(counts, "digest", "left").withColumn(
        "class", F.coalesce("component", "digest")
    )
    smallest = classed.where("n_shingles > 0").groupBy("class").agg(F.min("id").alias("smallest"))
    full = F.col("n_shingles") > 0
    return classed.join(smallest, "class", "left").select(
        F.col("id").alias(id),
        "n_shingles",
        F.when(full, F.col("smallest")).otherwise(F.col("id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def keep_one(docs: DataFrame, id: str = "doc_id", **options) -> DataFrame:
    """The row with the smallest id of each component; rows without words all stay.

    Rows that repeat an id are kept or dropped together.
    """
    joined = jaccard_join(docs, id=id, **options)
    kept = joined.where(F.col("component_id").eqNullSafe(F.col(id))).select(F.col(id).alias("kept")).distinct()
    rows = beside(docs, key=F.col(id))
    return restored(rows.join(kept.hint("shuffle_hash"), F.col("key").eqNullSafe(F.col("kept")), "left_semi"))
