"""The definitions once more, in plain Python, to check small inputs against."""

import math
from itertools import groupby


def second(micros):
    """Whole seconds since 1970, the fraction cut off."""
    return micros // 1_000_000 if micros >= 0 else -(-micros // 1_000_000)


def order_key(value):
    return (value is not None, value if value is not None else 0)


def sessionized(plays, gap):
    """plays: (user, microseconds or None). Yields (user, time, previous, diff, flag, session)."""
    out = []
    for user, group in groupby(
        sorted(plays, key=lambda p: (order_key(p[0]), order_key(p[1]))), lambda p: p[0]
    ):
        times = [t for _, t in group]
        previous, starts, rows = None, 0, []
        for time in times:
            diff = None
            if previous is not None and time is not None:
                diff = second(time) - second(previous)
            flag = int(diff is None or diff > gap)
            starts += flag
            rows.append([user, time, previous, diff, flag, starts])
            previous = time
        missing = times.count(None)
        for row in rows:
            if row[1] is None:
                row[5] = missing
        out += [tuple(row) for row in rows]
    return out


def summarized(plays, gap):
    """(user, session, start, end, duration, plays) per session."""
    sessions = {}
    for user, time, _, _, _, session in sessionized(plays, gap):
        sessions.setdefault((user, session), []).append(time)
    out = []
    for (user, session), times in sessions.items():
        start, end = (None, None) if None in times else (min(times), max(times))
        duration = None if start is None else second(end) - second(start)
        out.append((user, session, start, end, duration, len(times)))
    return out


def discrete(values, q):
    values = sorted(v for v in values if v is not None)
    return values[max(math.ceil(q * len(values)), 1) - 1] if values else None


def share(plays, gap, q):
    """(users with a long session, users, share, threshold, short, long, long share)."""
    sessions = summarized(plays, gap)
    users = {s[0] for s in sessions}
    cut = discrete([s[4] for s in sessions], q)
    timed = [s for s in sessions if s[4] is not None]
    long = [s for s in timed if s[4] >= cut]
    with_long = len({s[0] for s in long})
    return (
        with_long,
        len(users),
        with_long / len(users) if users else None,
        cut,
        len(timed) - len(long),
        len(long),
        len(long) / len(timed) if timed else None,
    )
