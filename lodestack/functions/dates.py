"""Times as texts, as Column expressions; all are in UTC whatever the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLOCK = r"(\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT\s*$"


def _utc(ts: Column) -> Column:
    return F.to_utc_timestamp(ts.cast("timestamp"), F.current_timezone())


def http_date(ts: Column) -> Column:
    """``Sun, 06 Nov 1994 08:49:37 GMT``."""
    return F.date_format(_utc(ts), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def from_http_date(text: Column) -> Column:
    """The time that such a text names, whatever its weekday; null for any other text."""
    clock = F.nullif(F.regexp_extract(text, _CLOCK, 1), F.lit(""))
    return F.try_to_timestamp(F.concat(clock, F.lit(" +0000")), F.lit("dd MMM yyyy HH:mm:ss Z"))


def stamp(ts: Column) -> Column:
    """``1994-11-06 08:49:37.000``, as crawl rows have it."""
    return F.date_format(_utc(ts), "yyyy-MM-dd HH:mm:ss.SSS")


def unmodified(modified: Column, since: Column) -> Column:
    """Whether a page of the time ``modified`` needs not be sent again to who asks with the HTTP date ``since``: whole seconds count."""
    return F.coalesce(F.unix_seconds(modified.cast("timestamp")) <= F.unix_seconds(from_http_date(since)), F.lit(False))
