"""Blocks: many texts in one row, as places in a list of their distinct words.

The texts of a block have a bounded size together. Work on words is then done
once for each distinct word of a block, and without a shuffle of the words' occurrences.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 8_000_000
#: Words of which occurrences are expanded at once.
CHUNK = 500_000
#: Spark's setting of bytes in a batch, and what it becomes: about a block. Its own 64 MB are held twice or
#: more by the JVM and by each worker at once.
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 7_500_000


def small_batches(spark: SparkSession) -> None:
    """Without a limit of the user's own, batches for Python get one of about a block."""
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def give_back() -> None:
    """Returns the memory that this worker has free to the system, where the system can take it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(batches: Callable) -> Callable:
    """``batches``, a function for mapInArrow, whose worker gives back memory after each batch and in the end.

    Workers of a task, and those of the last one, wait beside others and the JVM, and would keep it all.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = batches(source)
        for batch in made:
            size = batch.nbytes
            yield batch
            del batch
            if size > BATCH_BYTES // 8:
                give_back()
        del made
        give_back()

    return run


def packed(values: np.ndarray) -> bytes:
    """Whole numbers below 2 ** 32, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], decompressed_size=4 * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, size).T).view("<u4").ravel()


def by_frequency(places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places renumbered so that frequent words come first, and the old place of each new one."""
    order = np.argsort(-np.bincount(places, minlength=size), kind="stable")
    new = np.empty(size, np.int32)
    new[order] = np.arange(size, dtype=np.int32)
    return new[places], order


def strung(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that ``places`` name, one after the other."""
    sizes = lengths[places]
    jump = np.repeat(starts[places] - (np.cumsum(sizes) - sizes), sizes)
    return flat[jump + np.arange(len(jump))]


def in_blocks(source: Iterator[pa.RecordBatch], text: str, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The rows of ``source`` in batches of ``size`` bytes of text."""
    for batch in source:
        if batch.num_rows:
            sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
            for a, b in in_chunks(sizes, size):
                yield batch.slice(a, b - a)
                # An idle worker would keep what a block took while Spark needs the memory.
                pa.default_memory_pool().release_unused()


def in_chunks(counts: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` words each; a longer text has a range of its own."""
    start = total = 0
    for i, count in enumerate(counts.tolist()):
        if total and total + count > most:
            yield start, i
            start, total = i, 0
        total += count
    if start < len(counts):
        yield start, len(counts)
