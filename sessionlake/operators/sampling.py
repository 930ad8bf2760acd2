"""The first n plays of every user.

For few plays a user, Spark limits each group before it shuffles. For many, the second in which
a user's n-th play lies is found from counts, first by hour and then by second; all plays before
it are kept as they are, and only those of that second are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions.times import epoch_second

# Groups of input partitions per user in the first of the two rounds.
SLICES = 64

# Seconds of a tile, by which plays are counted first; and as many letters of a time as text.
TILE, TILE_LETTERS, SECOND_LETTERS = 3600, 13, 19

LIMIT_SETTING = "spark.sql.optimizer.windowGroupLimitThreshold"


def _keep_first(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    # In this form Spark also limits each group before the shuffle.
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(first)).where(F.col("_row") <= n).drop("_row")


def _cut(counted: DataFrame, unit: str, need: Column) -> DataFrame:
    """Per user the first ``unit`` with which the plays so far reach ``need``, and the plays before it."""
    so_far = Window.partitionBy("_user").orderBy(unit).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("_plays").over(so_far) - F.col("_plays")
    found = counted.withColumn("_before", before).where((F.col("_before") < need) & (need <= F.col("_before") + F.col("_plays")))
    return found.select(F.col("_user").alias("_cut_user"), F.col(unit).alias(f"_cut{unit}"), F.col("_before").alias(f"_before{unit}"))


def _first_many(df: DataFrame, n: int, user: str, ts: str, order: tuple[str, ...]) -> DataFrame:
    if dict(df.dtypes)[ts] == "string":
        tile, second = F.substring(ts, 1, TILE_LETTERS), F.substring(ts, 1, SECOND_LETTERS)
    else:
        second = epoch_second(F.col(ts))
        tile = second - F.pmod(second, F.lit(TILE))
    # Within a struct a null is a value: the smallest one, and equal to itself.
    rows = df.select(
        F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"),
        F.struct(F.col(user).alias("u")).alias("_user"),
        F.struct(second.alias("s")).alias("_second"),
        F.struct(tile.alias("t")).alias("_tile"),
        F.struct(*(F.col(c).alias(f"_{i}") for i, c in enumerate(order))).alias("_order"),
    )
    same = F.col("_user") == F.col("_cut_user")
    by_tile = rows.groupBy("_user", "_tile").agg(F.count("*").alias("_plays"))
    tiles = _cut(by_tile, "_tile", F.lit(n))
    in_tile = rows.join(tiles, same & (F.col("_tile") == F.col("_cut_tile")))
    by_second = in_tile.groupBy("_user", "_second", "_before_tile").agg(F.count("*").alias("_plays"))
    seconds = _cut(by_second, "_second", F.lit(n) - F.col("_before_tile"))
    cuts = tiles.withColumnRenamed("_cut_user", "_of").join(seconds, F.col("_of") == F.col("_cut_user")).drop("_of")
    # Users with fewer plays have no cut and keep all.
    placed = rows.join(cuts, same, "left")
    sure = placed.where(F.col("_cut_user").isNull() | (F.col("_second") < F.col("_cut_second")))
    last = placed.where(F.col("_second") == F.col("_cut_second"))
    first = Window.partitionBy("_user").orderBy("_order")
    rest = last.withColumn("_place", F.row_number().over(first)).where(
        F.col("_place") <= n - F.col("_before_tile") - F.col("_before_second")
    )
    return sure.select("_row.*").unionByName(rest.select("_row.*"))


def first_n_per_user(
    plays: DataFrame,
    n: int = 30,
    user: str = "userid",
    ts: str = "timestamp",
    tie_breakers: tuple[str, ...] = (),
) -> DataFrame:
    """Whole rows of each user's ``n`` earliest plays; without a time sorts first.

    Spark keeps ``n`` rows per user in every input partition before the shuffle.
    For a user who occurs in all of them that is still ``n`` rows per partition, so
    two rounds bring them together: first within 64 groups of partitions, then, of
    at most ``64 * n`` rows, per user. The group only decides which task looks at a
    row, never whether it is kept.

    Spark does that for up to ``spark.sql.optimizer.windowGroupLimitThreshold`` rows. For a
    larger ``n`` plays are counted by hour and second instead, to find each user's last second;
    the plays are then read three times, and only those of one second per user are put in order.

    Which of several plays at the same time survive is open unless
    ``tie_breakers`` name columns for it.
    """
    order = [F.col(c) for c in (ts, *tie_breakers)]
    if n > int(plays.sparkSession.conf.get(LIMIT_SETTING, "1000")):
        return _first_many(plays, n, user, ts, (ts, *tie_breakers))
    sliced = plays.withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(SLICES)))
    per_slice = _keep_first(sliced, [user, "_slice"], order, n).drop("_slice")
    return _keep_first(per_slice, [user], order, n)
