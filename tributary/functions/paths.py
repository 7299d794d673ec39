"""Forecast file names and object keys as column expressions.

File name layout (fixed value):
``nwm.YYYYMMDD/short_range/nwm.tCCz.short_range.TYPE.fLLL.conus.<ext>``
with cycle ``CC`` 00-23 and lead ``LLL`` in hours.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the forecast file names.
FOLDER_DATE = r"nwm\.(\d{8})"
CYCLE = r"\.t(\d{2})z\."
FORECAST_TYPE = r"\.short_range\.([a-z_]+)\.f\d{3}\."
LEAD = r"\.f(\d{3})\."


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def path_key(path) -> Column:
    """Name without extension, last three parts (``folder/kind/file``): the
    key shared by a source file and the index made from it (F8)."""
    trimmed = F.regexp_replace(_col(path), r"\.[^.]*$", "")
    parts = F.split(trimmed, "/")
    start = F.greatest(F.size(parts) - 2, F.lit(1))
    return F.array_join(F.slice(parts, start, 3), "/")


def base_name(path) -> Column:
    """Last part of a path (F8)."""
    return F.regexp_extract(_col(path), r"([^/]*)$", 1)


def with_extension(path, ext: str) -> Column:
    """The path with its last part's extension changed to ``ext``; one is added
    to a name without (a leading dot is no extension) (F8)."""
    return F.concat(F.regexp_replace(_col(path), r"([^/])\.[^./]*$", "$1"), F.lit(f".{ext}"))


def folder_date(path) -> Column:
    """The ``YYYYMMDD`` of the ``nwm.`` folder as a DATE."""
    raw = F.regexp_extract(_col(path), FOLDER_DATE, 1)
    return F.try_to_timestamp(raw, F.lit("yyyyMMdd")).cast("date")


def parse_forecast_path(path) -> dict[str, Column]:
    """Date, cycle, type and lead of a forecast file; reference and valid time."""
    p = _col(path)
    day = folder_date(p)
    cycle = F.regexp_extract(p, CYCLE, 1).try_cast("int")  # a foreign name gives NULL, not an error
    lead = F.regexp_extract(p, LEAD, 1).try_cast("int")
    ref = F.make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day), cycle, F.lit(0), F.lit(0))
    valid = ref + F.make_dt_interval(F.lit(0), lead)
    return {
        "date": day,
        "cycle": cycle,
        "forecast_type": F.regexp_extract(p, FORECAST_TYPE, 1),
        "lead": lead,
        "reference_time": ref,
        "valid_time": valid,
    }


def forecast_path(day, cycle, lead, forecast_type: str = "channel_rt", ext: str = "nc") -> Column:
    """Object key of one forecast file from its date, cycle and lead."""
    return F.concat(
        F.lit("nwm."), F.date_format(_col(day), "yyyyMMdd"), F.lit("/short_range/nwm.t"),
        F.lpad(_col(cycle).cast("string"), 2, "0"), F.lit(f"z.short_range.{forecast_type}.f"),
        F.lpad(_col(lead).cast("string"), 3, "0"), F.lit(f".conus.{ext}"))
