"""Numeric helpers shared by the reductions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: decimals kept on floating results so that engines summing in
# different orders agree.
DECIMALS = 6

# Fixed value: cubic metres to cubic feet, 3.28084 feet per metre, cubed.
METERS_TO_FEET = 3.28084


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing_as_null(c) -> Column:
    """NaN cells count as missing: array reductions skip them, Spark's ``avg`` would not."""
    c = _col(c)
    return F.nanvl(c, F.lit(None).cast("double"))
