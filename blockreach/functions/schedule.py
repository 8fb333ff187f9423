"""Transit-schedule expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from blockreach.functions.numeric import to_number

# Peak windows in minutes of the day, and the mode groups.
PEAK_WINDOWS = ((420, 540), (960, 1080))
MODES = ("bus", "tram", "metro", "train")
MODE_CODES = {
    "bus": ((3, 11), (700, 800)),
    "tram": ((0, 5), (900, 1000)),
    "metro": ((1,), (400, 500)),
    "train": ((2, 12), (100, 200)),
}


def clock_minutes(text: Column) -> Column:
    """``H:M:S`` text to minutes after midnight; hours past 24 are kept, bad text is null."""

    def minutes(t: Column, parts: Column) -> Column:
        part = [F.get(parts, F.lit(i)) for i in range(3)]
        hour, minute, second = (to_number(p) for p in part)
        # Nearly all times are plain digits, which need no further checks.
        h, m, s = (p.try_cast("double") for p in part)
        return F.when(t.rlike(r"^\d+:\d+:\d+$"), h * 60 + m + s / 60).otherwise(hour * 60 + minute + second / 60)

    # Bound by lambdas, so that an expression behind ``text`` and the parts are computed once and not at each mention.
    cut = lambda t: F.get(F.transform(F.array(F.split(t, ":")), lambda parts: minutes(t, parts)), F.lit(0))
    return F.get(F.transform(F.array(text), cut), F.lit(0))


def is_peak(minutes: Column) -> Column:
    """True in the morning or evening peak of any service day."""
    of_day = F.pmod(minutes, F.lit(1440.0))
    hit = F.lit(False)
    for start, end in PEAK_WINDOWS:
        hit = hit | ((of_day >= start) & (of_day < end))
    return F.coalesce(hit, F.lit(False))


def route_mode(route_type: Column) -> Column:
    """Mode group of a route-type code; unknown codes are ``other``."""
    code = to_number(route_type)
    mode = F.lit("other")
    for name, (exact, (low, high)) in MODE_CODES.items():
        mode = F.when(code.isin([float(c) for c in exact]) | ((code >= low) & (code < high)), F.lit(name)).otherwise(mode)
    return mode


def feed_key(feed_idx: Column, raw_id: Column) -> Column:
    """Feed-qualified id, so ids of different feeds never collide."""
    return F.concat(F.lit("feed"), feed_idx.cast("string"), F.lit(":"), raw_id)


def stop_place(x: Column, y: Column) -> Column:
    """Physical stop: the position to 0.1 m (half to even), as a struct key."""
    return F.struct((F.rint(x * 10) / 10).alias("x"), (F.rint(y * 10) / 10).alias("y"))
