"""Column functions over stamps and durations in seconds."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(stamp: Column) -> Column:
    """Microseconds since the epoch of a stamp with or without time zone."""
    return F.unix_micros(stamp.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    """Signed seconds from ``start`` to ``end``; NULL when either is missing."""
    return (micros(end) - micros(start)) / F.lit(1e6)


def duration_s(start: Column, end: Column) -> Column:
    """Seconds from ``start`` to ``end``, 0 when a stamp is missing or they are out of order."""
    return F.greatest(seconds_between(start, end), F.lit(0.0))


def whole_seconds(seconds: Column) -> Column:
    """Nearest whole second, halves away from zero."""
    return F.round(seconds).cast("bigint")


def compact_duration(seconds: Column, pad: bool = True) -> Column:
    """``45s``, ``8m``, ``5m05s`` (``pad``) or ``5m5s``."""
    total = whole_seconds(seconds)
    minutes = F.floor(total / 60)
    rest = total % 60
    both = "%dm%02ds" if pad else "%dm%ds"
    return (
        F.when(total < 60, F.format_string("%ds", total))
        .when(rest == 0, F.format_string("%dm", minutes))
        .otherwise(F.format_string(both, minutes, rest))
    )


def duration_text(seconds: Column) -> Column:
    """Whole seconds as ``1h2m3s``: lower units always shown once a higher one is."""
    total = whole_seconds(seconds)
    size = F.abs(total)
    hours, minutes, rest = F.floor(size / 3600), F.floor(size / 60) % 60, size % 60
    text = (
        F.when(size >= 3600, F.format_string("%dh%dm%ds", hours, minutes, rest))
        .when(size >= 60, F.format_string("%dm%ds", minutes, rest))
        .otherwise(F.format_string("%ds", rest))
    )
    return F.concat(F.when(total < 0, F.lit("-")).otherwise(F.lit("")), text)


# The units a duration text may use, in seconds.
UNIT_SECONDS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}

_NUMBER = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
_UNIT = "ns|us|µs|ms|s|m|h"


def parse_duration(text: Column) -> Column:
    """Seconds of a duration text such as ``1h2m3.5s``; raises on anything else."""
    valid = text.rlike(rf"^[+-]?(?:0|(?:{_NUMBER}(?:{_UNIT}))+)$")
    amounts = F.regexp_extract_all(text, F.lit(rf"({_NUMBER})(?:{_UNIT})"), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(rf"{_NUMBER}({_UNIT})"), F.lit(1))
    scale = F.create_map(*[F.lit(x) for pair in UNIT_SECONDS.items() for x in pair])
    parts = F.zip_with(amounts, units, lambda n, u: n.cast("double") * scale[u])
    size = F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)
    sign = F.when(text.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return (
        F.when(text.isNull(), F.lit(None).cast("double"))
        .when(valid, sign * size)
        .otherwise(F.raise_error(F.concat(F.lit("invalid duration: "), text)).cast("double"))
    )


def total_time_text(seconds: Column) -> Column:
    """``2h30m`` or ``30m``, truncating the seconds away."""
    minutes = F.floor(seconds / 60)
    return F.when(minutes >= 60, F.format_string("%dh%dm", F.floor(minutes / 60), minutes % 60)).otherwise(
        F.format_string("%dm", minutes)
    )


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, 8)


def parse_stamp(text: Column, strict: bool) -> Column:
    """Stamp of an RFC 3339 text. ``''`` is missing; other bad text raises or, if lenient, is missing."""
    given = F.nullif(F.trim(text), F.lit(""))
    return given.cast("timestamp") if strict else F.try_to_timestamp(given)
