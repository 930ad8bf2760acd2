"""Sessions: runs of plays of one user, each started within ``gap`` seconds of the last.

One user may own a large part of all plays, so no step gathers a user's plays in
one task. Time is cut into tiles of at most ``gap + 1`` seconds. Two plays in one
tile are at most ``gap`` seconds apart, hence always in the same session, and a
tile can be reduced to its first time, last time and number of plays by a plain
hash aggregate, which combines before the shuffle. Only tiles, at most one per
``gap + 1`` seconds of history, are brought together per user; with a small gap, which
makes many, only blocks of tiles are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions.times import epoch_second, seconds_between, tile_of
from sessionlake.session import freeze

DEFAULT_GAP = 900

# Plays that a task may have to sort together: of one user and tile, or of one second.
HOT_TILE = 1_000_000

# Parts into which plays without a time, and plays at one crowded moment, are dealt.
SLICES = 64

# With smaller gaps a user's tiles are scanned in blocks. From here on ten years have 1,050,000 tiles at most.
SPREAD_GAP = 300

# Tiles, and sessions of a user, in a block at most.
BLOCK = 65_536

RESULT_COLUMNS = ("previous_time", "time_diff", "is_new_session", "session_id")


def _whole_gap(gap: float) -> int:
    if gap < 0:
        raise ValueError("gap must not be negative")
    return math.floor(gap)


def _extents(tiled: DataFrame, user: str, ts: str) -> DataFrame:
    """One row per user and tile, combined before the shuffle."""
    return tiled.groupBy(user, "_tile").agg(
        F.min(ts).alias("start_time"),
        F.max(ts).alias("end_time"),
        F.count("*").alias("plays"),
    )


def _scanned(tiles: DataFrame, group: str, gap: int) -> DataFrame:
    """The tiles with the end of the tile before them in their group and the number of their session.

    Plays without a time share the null tile, which sorts first. Each of them
    counts as a session start, so that tile's session number is its play count
    and the user's first timed session gets the number after it.
    """
    history = Window.partitionBy(group).orderBy("_tile")
    idle = seconds_between(F.col("previous_end"), F.col("start_time"))
    starts = (
        F.when(F.col("_tile").isNull(), F.col("plays"))
        .when(F.coalesce(idle > gap, F.lit(True)), F.lit(1))
        .otherwise(F.lit(0))
    )
    return (
        tiles.withColumn("previous_end", F.lag("end_time").over(history))
        .withColumn("_starts", starts)
        .withColumn("session_id", F.sum("_starts").over(history))
        .drop("_starts")
    )


def _in_sessions(tiles: DataFrame, user: str, gap: int) -> DataFrame:
    """The tiles with the end of the user's tile before them and the number of their session.

    With a small gap a user may have a tile for every few seconds. Tiles are then scanned in
    blocks of time, each as if it were a user's whole history; then blocks, one row each, are put in
    order to learn how each block's first tile follows on the block before and how many sessions
    start earlier. Both ways give the same.
    """
    if gap >= SPREAD_GAP:
        return _scanned(tiles, user, gap)
    # In a struct a null equals a null, in joining too. Plays without a time are the null block.
    block = F.col("_tile") - F.pmod("_tile", F.lit(BLOCK * (gap + 1)))
    key = F.struct(F.col(user).alias("user"), block.alias("block")).alias("_block")
    scanned = _scanned(tiles.withColumn("_block", key), "_block", gap)
    history = Window.partitionBy("_block.user").orderBy("_block.block")
    follows = F.coalesce(seconds_between(F.col("_block_previous"), F.col("_from")) <= gap, F.lit(False))
    blocks = (
        scanned.groupBy("_block")
        .agg(
            F.min("start_time").alias("_from"),
            F.max("end_time").alias("_to"),
            F.max("session_id").alias("_starts"),
        )
        .withColumn("_block_previous", F.lag("_to").over(history))
        .withColumn("_new", F.col("_starts") - follows.cast("int"))
        .select("_block", "_block_previous", (F.sum("_new").over(history) - F.col("_starts")).alias("_earlier"))
    )
    return (
        scanned.join(blocks, "_block")
        .withColumn("previous_end", F.coalesce("previous_end", "_block_previous"))
        .withColumn("session_id", F.col("session_id") + F.col("_earlier"))
        .drop("_block", "_block_previous", "_earlier")
    )


def session_summary(
    plays: DataFrame,
    user: str = "userid",
    ts: str = "timestamp",
    gap: float = DEFAULT_GAP,
    drop_null_ts: bool = False,
) -> DataFrame:
    """One row per session: user, session_id, start_time, end_time, session_duration, plays.

    A gap of exactly ``gap`` seconds continues the session. A user's plays without
    a time form one session of null duration, unless ``drop_null_ts`` removes them.

    Plays are shuffled once, combined to tiles; tiles once, by user. The session
    aggregate reuses the partitioning by user. With a gap under ``SPREAD_GAP`` tiles are
    shuffled by user and block instead, and sessions, combined, by user and number.
    """
    gap = _whole_gap(gap)
    if drop_null_ts:
        plays = plays.where(F.col(ts).isNotNull())
    tiled = plays.select(user, ts, tile_of(F.col(ts), gap + 1).alias("_tile"))
    return (
        _in_sessions(_extents(tiled, user, ts), user, gap)
        .groupBy(user, "session_id")
        .agg(
            F.min("start_time").alias("start_time"),
            F.max("end_time").alias("end_time"),
            F.sum("plays").alias("plays"),
        )
        .select(
            user,
            "session_id",
            "start_time",
            "end_time",
            seconds_between(F.col("start_time"), F.col("end_time")).alias("session_duration"),
            "plays",
        )
    )


def _cell(*parts: Column) -> Column:
    """The unit in which plays are sorted. In a struct a null equals a null, in grouping and joining."""
    names = ("user", "tile", "second", "moment", "slice")
    return F.struct(*(part.alias(name) for part, name in zip(parts, names))).alias("_cell")


def _slice_of_task() -> Column:
    """The slice of the plays in a task; another one, maybe, when the plays are read again."""
    return F.pmod(F.spark_partition_id(), F.lit(SLICES))


def _slices() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))


def _cells(rows: DataFrame, tiles: DataFrame, hot_tile: int | None) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their cell, and the cells with ``previous_end`` and ``session_id``.

    A cell is a tile, or a second of a crowded tile, or a slice of the plays at one moment in
    a crowded second. Tiles of plays without a time are sliced in any case. Of the plays at
    one moment only one has an earlier predecessor: the first of the first slice that has any.
    So which slice a play is in must not change once that slice is known: the plays of crowded
    seconds are written with it, and all else is derived from what is written.
    Seconds and moments are looked at only if a tile or a second is crowded at all.
    """
    none = F.lit(None).cast("bigint")
    timed = F.col("_tile").isNotNull()
    sliced = F.when(timed, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SLICES - 1)))
    part = F.when(timed, F.lit(0)).otherwise(F.col("_slice"))
    whole = tiles.withColumn("_part", F.explode(sliced)).select(
        _cell(F.col("_user"), F.col("_tile"), none, none, F.col("_part")),
        "previous_end", "session_id", "plays",
    )
    crowded = tiles.where((F.col("plays") > hot_tile) & timed) if hot_tile is not None else tiles.limit(0)
    if hot_tile is None or crowded.isEmpty():
        return rows.withColumn("_cell", _cell(F.col("_user"), F.col("_tile"), none, none, part)), whole

    # The tile of a play, if it is crowded. There are at most plays / hot_tile of them.
    found = crowded.select(
        F.struct("_user", "_tile").alias("_key"),
        F.col("previous_end").alias("_tile_previous"),
        F.col("session_id").alias("_tile_session"),
    )
    rows = rows.withColumn("_key", F.struct("_user", "_tile")).join(found, "_key", "left")
    in_tile = Window.partitionBy("_key").orderBy("_second")
    seconds = freeze(
        rows.where(F.col("_tile_session").isNotNull())
        .groupBy("_key", epoch_second(F.col("_time")).alias("_second"))
        .agg(
            F.count("*").alias("plays"),
            F.min("_time").alias("_from"),
            F.max("_time").alias("_to"),
            F.max("_tile_previous").alias("_tile_previous"),
            F.max("_tile_session").alias("session_id"),
        )
        .withColumn("previous_end", F.coalesce(F.lag("_to").over(in_tile), "_tile_previous"))
    )
    packed = seconds.where((F.col("plays") > hot_tile)).select(
        "_key", "_second", F.col("previous_end").alias("_second_previous"), F.lit(True).alias("_packed")
    )
    rows = rows.withColumn("_second", F.when(F.col("_tile_session").isNotNull(), epoch_second(F.col("_time"))))
    if packed.isEmpty():
        by_second = seconds.select(
            _cell(F.col("_key._user"), F.col("_key._tile"), F.col("_second"), none, F.lit(0)), "previous_end", "session_id"
        )
        rows = rows.withColumn("_cell", _cell(F.col("_user"), F.col("_tile"), F.col("_second"), none, part))
        by_tile = whole.where((F.col("plays") <= hot_tile) | F.col("_cell.tile").isNull()).drop("plays")
        return rows, by_tile.unionByName(by_second)

    rows = rows.join(packed, ["_key", "_second"], "left")
    crowd = freeze(rows.where("_packed"))
    in_second = Window.partitionBy("_key", "_second").orderBy("_time")
    moments = (
        crowd.groupBy("_key", "_second", "_time")
        .agg(
            F.min("_slice").alias("_first"),
            F.max("_second_previous").alias("_second_previous"),
            F.max("_tile_session").alias("session_id"),
        )
        .withColumn("_before", F.coalesce(F.lag("_time").over(in_second), "_second_previous"))
    )
    moment = F.unix_micros(F.col("_time").cast("timestamp"))
    by_moment = moments.withColumn("_part", _slices()).select(
        _cell(F.col("_key._user"), F.col("_key._tile"), F.col("_second"), moment, F.col("_part")),
        F.when(F.col("_part") == F.col("_first"), F.col("_before")).otherwise(F.col("_time")).alias("previous_end"),
        "session_id",
    )
    by_second = seconds.where(F.col("plays") <= hot_tile).select(
        _cell(F.col("_key._user"), F.col("_key._tile"), F.col("_second"), none, F.lit(0)),
        "previous_end", "session_id",
    )
    by_tile = whole.where((F.col("plays") <= hot_tile) | F.col("_cell.tile").isNull()).drop("plays")
    loose = rows.where(F.col("_packed").isNull()).withColumn(
        "_cell", _cell(F.col("_user"), F.col("_tile"), F.col("_second"), none, part)
    )
    crowd = crowd.withColumn("_cell", _cell(F.col("_user"), F.col("_tile"), F.col("_second"), moment, F.col("_slice")))
    return loose.unionByName(crowd), by_tile.unionByName(by_second).unionByName(by_moment)


def sessionize(
    plays: DataFrame,
    user: str = "userid",
    ts: str = "timestamp",
    gap: float = DEFAULT_GAP,
    drop_null_ts: bool = False,
    hot_tile: int | None = HOT_TILE,
) -> DataFrame:
    """Every play with previous_time, time_diff, is_new_session and session_id.

    The plays are read twice: once for the table of tiles, which is written to the shared
    folder when this is called, and once to be shuffled, by user and tile. The previous play
    is found inside the tile; for a tile's first play it comes from the tile table, joined on
    the same key, so the plays are not moved again. A task sorts at most ``hot_tile`` plays of
    one tile: a tile with more is cut into seconds, a second with more into moments, and the
    plays at one moment into slices; the plays of such seconds are written first, with their
    slice. With None nothing is cut. Results are the same.

    Columns that are not selected cost nothing: asking for session_id alone leaves
    a plain join without a window. The result's own column names may not be in ``plays``.
    """
    clash = sorted({c.lower() for c in plays.columns} & set(RESULT_COLUMNS))
    if clash:
        raise ValueError(f"plays have columns with the names of results: {', '.join(clash)}")
    gap = _whole_gap(gap)
    if drop_null_ts:
        plays = plays.where(F.col(ts).isNotNull())
    # The input's columns by number, so that any name of theirs is free to be used here.
    others = {c: f"_in{i}" for i, c in enumerate(plays.columns) if c not in (user, ts)}
    rows = plays.select(
        *(F.col(f"`{c}`").alias(name) for c, name in others.items()),
        F.col(user).alias("_user"),
        F.col(ts).alias("_time"),
        tile_of(F.col(ts), gap + 1).alias("_tile"),
    )
    extents = _extents(rows.select("_user", "_time", "_tile"), "_user", "_time")
    tiles = freeze(_in_sessions(extents, "_user", gap))
    sliced = rows.withColumn("_slice", _slice_of_task())
    rows, cells = _cells(sliced, tiles, hot_tile)
    in_cell = Window.partitionBy("_cell").orderBy("_time")
    idle = seconds_between(F.col("previous_time"), F.col("_time"))
    placed = (
        rows.select("_cell", *others.values(), "_time")
        .withColumn("_earlier", F.lag("_time").over(in_cell))
        .join(cells.select("_cell", "previous_end", "session_id"), "_cell")
        .withColumn("previous_time", F.coalesce("_earlier", "previous_end"))
    )
    place = {c: F.col(name) for c, name in others.items()} | {user: F.col("_cell.user"), ts: F.col("_time")}
    return placed.select(
        *(place[c].alias(c) for c in plays.columns),
        "previous_time",
        idle.alias("time_diff"),
        F.coalesce(idle > gap, F.lit(True)).cast("int").alias("is_new_session"),
        "session_id",
    )


def number_within_user(sessions: DataFrame, user: str = "userid", gap: float = DEFAULT_GAP) -> DataFrame:
    """Adds user_session_number: 1, 2, ... over each user's sessions.

    Straight after :func:`session_summary` this needs no further shuffle. A user
    has at most one session per ``gap + 1`` seconds of history; with a gap under
    ``SPREAD_GAP`` sessions are numbered within blocks, and the blocks' sizes added up. Session
    numbers must then be unique within a user and not null.
    """
    if _whole_gap(gap) >= SPREAD_GAP:
        order = Window.partitionBy(user).orderBy("session_id")
        return sessions.withColumn("user_session_number", F.row_number().over(order).cast("bigint"))
    block = F.col("session_id") - F.pmod("session_id", F.lit(BLOCK))
    keyed = sessions.withColumn("_block", F.struct(F.col(user).alias("user"), block.alias("block")))
    earlier = Window.partitionBy("_block.user").orderBy("_block.block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy("_block").agg(F.count("*").alias("_size"))
    before = sizes.select("_block", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_block").orderBy("session_id"))
    return (
        keyed.withColumn("_own", own)
        .join(before, "_block")
        .select(*sessions.columns, (F.col("_before") + F.col("_own")).cast("bigint").alias("user_session_number"))
    )
