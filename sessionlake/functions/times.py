"""Column functions on times, in whole seconds: fractions are cut off before subtracting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the timestamp format of the play log.
PLAY_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ssX"


def parse_play_time(text: Column) -> Column:
    """ISO text such as ``2009-05-04T23:08:57Z`` to a timestamp, null if malformed.

    The ``Z`` is read as the zone it stands for, so the instant is the same in
    every session time zone and no daylight-saving change can shift a gap. Other
    zone suffixes are malformed.
    """
    instant = F.try_to_timestamp(text, F.lit(PLAY_TIME_FORMAT))
    return F.when(F.endswith(text, F.lit("Z")), instant)


def epoch_second(time: Column) -> Column:
    """Whole seconds since 1970, the fraction cut off; takes both kinds of timestamp."""
    return F.unix_timestamp(time)


def seconds_between(earlier: Column, later: Column) -> Column:
    """Difference of the whole seconds; null if either time is null."""
    return epoch_second(later) - epoch_second(earlier)


def tile_of(time: Column, width: int) -> Column:
    """First second of the ``width``-second tile that holds ``time``."""
    second = epoch_second(time)
    return second - F.pmod(second, F.lit(width))
