"""Column expressions (all built-in, JVM-side, codegen'd). No Python UDFs."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from storytrack.schemas import HOTNESS_DIVISOR_S, HOTNESS_EPOCH_S

# Thumbnail values that mean "no picture to show" (besides NULL).
HIDDEN_THUMBNAILS = ("", "default", "self", "nsfw")
# Fixed display offset and pattern of the ranking page.
DISPLAY_OFFSET = "-05:00"
DISPLAY_PATTERN = "M/d/yy h:mm a"
PERMALINK_HOST = "http://reddit.com"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hotness(score, created_at) -> Column:
    """sign(score)·log10(max(|score|, 1)) + (epoch seconds − HOTNESS_EPOCH_S) / 45000."""
    s = _col(score).cast("double")
    order = F.log10(F.greatest(F.abs(s), F.lit(1.0)))
    seconds = F.unix_millis(_col(created_at)) / F.lit(1000.0) - F.lit(HOTNESS_EPOCH_S)
    return F.signum(s) * order + seconds / F.lit(HOTNESS_DIVISOR_S)


# Largest epoch second whose microseconds fit a 64-bit timestamp, rounded down.
MAX_EPOCH_S = 9_200_000_000_000


def valid_epoch(c) -> Column:
    """Whether epoch seconds can be a timestamp (NULL for NULL)."""
    return _col(c).between(F.lit(-MAX_EPOCH_S), F.lit(MAX_EPOCH_S))


def epoch_seconds_to_ts(c) -> Column:
    """Payload epoch seconds (possibly fractional) → timestamp, truncating like a long parameter.
    Values that no timestamp can hold become NULL (the payload reader rejects their records)."""
    return F.timestamp_seconds(F.when(valid_epoch(c), _col(c)).try_cast("long"))


def to_millis(c) -> Column:
    return F.unix_millis(_col(c))


def as_ts(value) -> Column:
    """A timestamp literal (datetime or 'yyyy-MM-dd HH:mm:ss' text), session zone UTC."""
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(value, str):
        return F.to_timestamp(F.lit(value))
    return _col(value)


def plus_seconds(ts, seconds) -> Column:
    """ts + seconds (seconds may be a column or an int), exact to the microsecond."""
    secs = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.timestamp_micros(F.unix_micros(_col(ts)) + secs.cast("long") * F.lit(1_000_000))


def minus_seconds(ts, seconds) -> Column:
    secs = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return plus_seconds(ts, -secs)


def empty_to_null(c) -> Column:
    return F.nullif(_col(c), F.lit(""))


def full_id(kind: str, short_id) -> Column:
    """Kind-prefixed id, e.g. t3_abc."""
    return F.concat_ws("_", F.lit(kind), _col(short_id))


def utc_day(ts) -> Column:
    """yyyy-MM-dd of a timestamp in UTC (session zone is pinned to UTC)."""
    return F.date_format(_col(ts), "yyyy-MM-dd")


def show_thumbnail(thumbnail) -> Column:
    t = _col(thumbnail)
    return F.coalesce(~t.isin(*HIDDEN_THUMBNAILS), F.lit(False))


def display_time(ts) -> Column:
    return F.date_format(F.from_utc_timestamp(_col(ts), DISPLAY_OFFSET), DISPLAY_PATTERN)


def permalink_url(permalink) -> Column:
    return F.concat(F.lit(PERMALINK_HOST), _col(permalink))


def seconds_between(later, earlier) -> Column:
    """(later − earlier) in seconds as double, millisecond precision."""
    return (F.unix_millis(_col(later)) - F.unix_millis(_col(earlier))) / F.lit(1000.0)


def fail_if(condition, message: str) -> Column:
    """A filter predicate that is always true but raises when ``condition`` holds.

    Used as ``df.filter(fail_if(...))``: a filter is evaluated on every row, whereas a
    check column that is later dropped would be pruned away unevaluated.
    """
    return F.coalesce(F.when(_col(condition), F.raise_error(F.lit(message))).cast("boolean"), F.lit(True))
