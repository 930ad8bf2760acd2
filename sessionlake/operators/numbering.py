"""Dense numbering of all rows in one global order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.session import freeze

# Documented layout of monotonically_increasing_id: partition above, row below.
_ROW_BITS = 33


def number_globally(df: DataFrame, order: list[str], name: str = "unique_session_id") -> DataFrame:
    """Adds ``name``: 1..N in the order of the columns ``order``.

    Rows are range-partitioned (a busy user spans several ranges), sorted within
    their partition and written to the shared folder together with partition and
    row number, so a lost executor cannot change either. What is left is to add
    the sizes of the earlier partitions: one number per partition.

    Runs a job when called, to write that table.
    """
    marked = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mark", F.monotonically_increasing_id())
    )
    placed = (
        freeze(marked)
        .withColumn("_part", F.shiftright("_mark", _ROW_BITS))
        .withColumn("_row", F.col("_mark").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
    )
    # One row per partition, so both the window and the broadcast are that small.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    )
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_before") + F.col("_row") + 1).alias(name)
    )


def number_sessions(
    sessions: DataFrame, user: str = "userid", name: str = "unique_session_id"
) -> DataFrame:
    """Adds ``name``: 1..N over all sessions, by user and then session.

    The same numbers as :func:`number_globally` gives, but only users are put in order: one
    row per user with the number of its sessions is range-partitioned and written to the
    shared folder when this is called. The sessions, partitioned by user as
    :func:`~sessionlake.operators.sessions.session_summary` leaves them, are neither moved
    nor written. A null user comes first, so nothing lies before it.
    """
    counts = sessions.groupBy(user).agg(F.count("*").alias("_n"))
    placed = freeze(
        counts.repartitionByRange(user)
        .sortWithinPartitions(user)
        .withColumn("_mark", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_mark", _ROW_BITS))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.sum("_n").alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_skipped"))
    )
    within = Window.partitionBy("_part").orderBy("_mark").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.withColumn("_inner", F.coalesce(F.sum("_n").over(within), F.lit(0)))
        .join(F.broadcast(offsets), "_part")
        .select(user, (F.col("_skipped") + F.col("_inner")).alias("_before"))
    )
    own = F.row_number().over(Window.partitionBy(user).orderBy("session_id"))
    return (
        sessions.withColumn("_own", own)
        .join(starts, user, "left")
        .select(
            *sessions.columns,
            (F.coalesce("_before", F.lit(0)) + F.col("_own")).cast("bigint").alias(name),
        )
    )
