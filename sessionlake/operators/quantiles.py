"""Quantiles of a numeric column, exact without gathering the column anywhere.

The column is first counted into a histogram (one row per distinct value, combined
before the shuffle), the histogram into bins that depend on the value alone: ``BINS`` for
each power of two. So neither the range of the values nor an outlier matters, and nothing
has to be known before. The running count over the bins shows which bin holds a rank; only
that bin is then looked at value by value. Should it have over ``IN_BIN`` distinct values,
it is cut into ``PARTS`` parts first, and only the part that holds the rank is looked at.
Whole numbers below 2 ** 32, such as durations in seconds, cannot have so many in a bin;
where a caller says they are such (``whole``), the plan goes without that step.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bins for each power of two that values come near.
BINS = 4096

# Distinct values of a bin that one task may put in order.
IN_BIN = 1_000_000

# Parts of a larger bin. Doubles that agree in bin and part are at most 2 ** 20 different ones.
PARTS = 2**20


def _check(quantile: float) -> None:
    if not 0 <= quantile <= 1:
        raise ValueError("quantile must lie between 0 and 1")


def histogram(df: DataFrame, column: str) -> DataFrame:
    """value, n: how often each value occurs. Null is a value that occurs 0 times."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(column).alias("n"))


def discrete_rank(quantile: float) -> Callable[[Column], list[Column]]:
    """The rank (from 1) of the smallest value that covers the share ``quantile``."""
    _check(quantile)
    return lambda n: [F.greatest(F.ceil(F.lit(float(quantile)) * n), F.lit(1)).cast("bigint")]


def neighbour_ranks(quantile: float) -> Callable[[Column], list[Column]]:
    """The ranks on either side of position ``(N - 1) * quantile``."""
    _check(quantile)

    def ranks(n: Column) -> list[Column]:
        at = (n - 1) * F.lit(float(quantile))
        return [(F.floor(at) + 1).cast("bigint"), (F.ceil(at) + 1).cast("bigint")]

    return ranks


# The size of a number as a finite double, its power of two, and how far it is between this power
# and the next, in bins; rounding may make that a bin less or more.
_SIZE = f"least(abs(CAST(value AS DOUBLE)), {sys.float_info.max!r}D)"
_POWER = f"floor(log2({_SIZE}))"
_WAY = f"({_SIZE} / pow(2D, {_POWER}) - 1) * {BINS}"
_NEAR_ZERO = f"WHEN value IS NULL THEN NULL WHEN {_SIZE} < {2.0**-1000!r}D THEN 0"

# The bin of a value and its part in it. Both rise with the value; null for a null. What is not
# finite belongs to the outermost bins.
BIN_OF = f"CASE {_NEAR_ZERO} ELSE IF(value < 0, -1, 1) * (({_POWER} + 1001) * {2 * BINS} + floor({_WAY})) END"
PART_OF = f"CASE {_NEAR_ZERO} ELSE IF(value < 0, -1, 1) * floor(({_WAY} - floor({_WAY})) * {PARTS}) END"


def at_ranks(
    values: DataFrame,
    ranks: Callable[[Column], list[Column]],
    counters: tuple[str, ...] = ("n",),
    whole: bool = False,
) -> DataFrame:
    """The values at the ranks that ``ranks`` derives from the total of ``n``.

    ``values`` is a histogram; it may carry more counters than ``n``. One row per
    distinct rank: rank, value, and for each counter its sum below that value
    (``<c>_below``) and overall (``<c>_total``). A histogram of null alone gives its
    null; an empty one gives no row. ``whole`` says that values are whole numbers below
    2 ** 32; were they not, a task might have more of them to sort, with the same result.
    """
    values = values.withColumn("bin", F.expr(BIN_OF))

    # One task, but over bins only.
    all_bins = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = values.groupBy("bin").agg(F.count("*").alias("size"), *[F.sum(c).alias(c) for c in counters])
    bins = bins.select(
        F.col("bin").alias("hit_bin"),
        F.col("n").alias("n_in_bin"),
        "size",
        *[(F.sum(c).over(so_far) - F.col(c)).alias(f"{c}_before") for c in counters],
        *[F.sum(c).over(all_bins).alias(f"{c}_total") for c in counters],
    )

    def holds_rank(below: str, here: str) -> Column:
        rank, below = F.col("rank"), F.col(below)
        return ((below < rank) & (rank <= below + F.col(here))) | (F.col("n_total") == 0)

    ranked = F.explode(F.array_distinct(F.array(*ranks(F.col("n_total")))))
    hits = bins.withColumn("rank", ranked).where(holds_rank("n_before", "n_in_bin"))

    # As many rows as ranks, so safe to broadcast. Null-safe so that no filter is
    # derived for the histogram side: it stays the same plan as above and is reused.
    inside = values.join(F.broadcast(hits), F.col("bin").eqNullSafe(F.col("hit_bin")))
    carried = ["rank", *[f"{c}_total" for c in counters]]

    def in_order(rows: DataFrame) -> DataFrame:
        """The row of each rank, all rows of one rank in one task."""
        window = Window.partitionBy("rank").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        below = [(F.col(f"{c}_before") + F.sum(c).over(window) - F.col(c)).alias(f"{c}_below") for c in counters]
        return rows.select("value", "n", *below, *carried).where(holds_rank("n_below", "n"))

    if whole:
        return in_order(inside)
    large = inside.where(F.col("size") > IN_BIN).withColumn("part", F.expr(PART_OF))
    by_part = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = (
        large.groupBy("part", *carried, *[f"{c}_before" for c in counters])
        .agg(*[F.sum(c).alias(c) for c in counters])
        .select(
            F.col("part").alias("hit_part"),
            F.col("n").alias("n_in_part"),
            *carried,
            *[(F.col(f"{c}_before") + F.sum(c).over(by_part) - F.col(c)).alias(f"{c}_below") for c in counters],
        )
        .where(holds_rank("n_below", "n_in_part"))
        .select("hit_part", F.col("rank").alias("hit_rank"), *[F.col(f"{c}_below").alias(f"{c}_from") for c in counters])
    )
    in_part = large.join(
        F.broadcast(parts), (F.col("part") == F.col("hit_part")) & (F.col("rank") == F.col("hit_rank"))
    ).withColumns({f"{c}_before": F.col(f"{c}_from") for c in counters})
    columns = ["value", "n", *counters[1:], *[f"{c}_before" for c in counters], *carried]
    rows = inside.where(F.col("size") <= IN_BIN).select(*columns).unionByName(in_part.select(*columns))
    return in_order(rows)


def exact_quantile(
    df: DataFrame, column: str, quantile: float, name: str = "threshold", whole: bool = False
) -> DataFrame:
    """One row: the smallest value whose cumulative share reaches ``quantile``.

    Nulls are left out; null if there is no value. For ``whole`` see :func:`at_ranks`.
    """
    found = at_ranks(histogram(df, column), discrete_rank(quantile), whole=whole)
    return found.agg(F.max("value").cast("double").alias(name))


def interpolated_quantile(
    df: DataFrame, column: str, quantile: float, name: str = "threshold", whole: bool = False
) -> DataFrame:
    """One row: the value at position ``(N - 1) * quantile``, linear between neighbours."""
    found = at_ranks(histogram(df, column), neighbour_ranks(quantile), whole=whole)
    position = (F.max("n_total") - 1) * F.lit(float(quantile))
    low, high = F.min("value"), F.max("value")
    return found.agg(
        (low + (high - low) * (position - F.floor(position))).cast("double").alias(name)
    )


def approximate_quantile(
    df: DataFrame, column: str, quantile: float, error: float, name: str = "threshold"
) -> DataFrame:
    """One row: a value whose rank is off by at most ``error * N``."""
    _check(quantile)
    if not 0 < error < 1:
        raise ValueError("error must lie between 0 and 1")
    sketch = F.percentile_approx(column, float(quantile), math.ceil(1 / error))
    return df.agg(sketch.cast("double").alias(name))


def quantile_of(
    df: DataFrame,
    column: str,
    quantile: float,
    error: float = 0.0,
    name: str = "threshold",
    whole: bool = False,
) -> DataFrame:
    """Exact for ``error`` 0, else a sketch with that rank error."""
    if error == 0:
        return exact_quantile(df, column, quantile, name, whole)
    return approximate_quantile(df, column, quantile, error, name)
