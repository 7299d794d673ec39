"""Time labels and ranges.

Two range functions, never one with a silent flag:

* :func:`range_closed` - date-label selection: both ends included and the
  end *label* covers its whole day (``sel(time=slice(a, b))`` semantics).
* :func:`range_open` - strict ``a < time < b`` on instants.

:func:`range_instants` is the closed range on instants (the last day is not
widened), used for the relative windows of the forecast evaluation.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts(value: str) -> Column:
    """A TIMESTAMP_NTZ literal from ``YYYY-MM-DD[ HH:MM:SS]``."""
    return F.lit(value).cast("timestamp_ntz")


def _next_day(label: str) -> str:
    d = _dt.date.fromisoformat(label[:10]) + _dt.timedelta(days=1)
    return d.isoformat()


def range_closed(c, start: str, stop: str) -> Column:
    """``start <= c < stop + 1 day``: the stop label includes its whole day."""
    c = _col(c)
    return (c >= ts(start)) & (c < ts(_next_day(stop)))


def range_open(c, start: str, stop: str) -> Column:
    """``start < c < stop`` on instants."""
    c = _col(c)
    return (c > ts(start)) & (c < ts(stop))


def range_instants(c, start: Column, stop: Column) -> Column:
    """``start <= c <= stop`` with instant ends (no widening)."""
    c = _col(c)
    return (c >= start) & (c <= stop)


def partial_label(c, label: str) -> Column:
    """Half-open range selected by a partial label ``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD``."""
    c = _col(c)
    parts = label.split("-")
    if len(parts) == 1:
        start, stop = f"{label}-01-01", f"{int(label) + 1}-01-01"
    elif len(parts) == 2:
        y, m = int(parts[0]), int(parts[1])
        start = f"{y:04d}-{m:02d}-01"
        stop = f"{y + (m == 12):04d}-{(m % 12) + 1:02d}-01"
    else:
        start, stop = label, _next_day(label)
    return (c >= ts(start)) & (c < ts(stop))


def day_of_year(c) -> Column:
    return F.dayofyear(_col(c))


def iso_week(c) -> Column:
    """ISO-8601 week number (2000-01-01 is in week 52, 1990-12-31 in week 1)."""
    return F.weekofyear(_col(c))


def months_between_labels(later, earlier) -> Column:
    """Whole calendar months from ``earlier`` to ``later``."""
    later, earlier = _col(later), _col(earlier)
    return ((F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)).cast("int")


def hours_between(later, earlier) -> Column:
    """Whole hours from ``earlier`` to ``later`` (TIMESTAMP_NTZ inputs)."""
    later, earlier = _col(later), _col(earlier)
    secs = (F.unix_timestamp(later.cast("timestamp")) - F.unix_timestamp(earlier.cast("timestamp")))
    return (secs / 3600).cast("int")
