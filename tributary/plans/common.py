"""Shared pieces of the named queries: fixed parameters and rounding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType

from ..functions.numeric import DECIMALS
from ..operators.ids import area_ids, available_ids
from ..sources import fixtures as fx

# Parameters of the named queries.
AREA_HUC = "02"                      # watershed prefix of the study area
RANGE_START = "1996-01-01"           # date labels of the climatology range
RANGE_STOP = "1997-01-01"
BASE_FLOW_SINCE = "1998-01-01"       # lower bound of the base-flow statistics
INSTANT = "1996-03-15"               # exact instant
MONTH_LABEL = "1996-03"              # partial label
POINT_FEATURE = 42                   # point lookup
RETENTION_DAYS = 28                  # catalog retention window
CYCLES = 24                          # forecast cycles per day
LEADS = 18                           # lead hours per cycle


def rounded(df: DataFrame) -> DataFrame:
    """Round every floating column so engines that sum in other orders agree."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name), DECIMALS).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def dates_as_timestamps(df: DataFrame) -> DataFrame:
    """Return DATE columns as midnight TIMESTAMP_NTZ: the form that both this
    engine and the SQL oracle hand to pandas alike."""
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, DateType)
                       else F.col(f.name) for f in df.schema.fields])


def study_ids(spark, root) -> DataFrame:
    """Reach ids of the study area."""
    return area_ids(fx.reach(spark, root), fx.huc(spark, root), AREA_HUC)


def study_available(spark, root, cube: DataFrame) -> DataFrame:
    """Reach ids of the study area present in ``cube``."""
    return available_ids(study_ids(spark, root), cube)


# DuckDB text of the same parameters.
SQL_AREA_IDS = (f"(SELECT r.comid FROM reach r JOIN huc h ON r.huc_key = h.huc_key "
                f"WHERE starts_with(h.huc4, '{AREA_HUC}'))")
SQL_CLOSED = (f"time >= TIMESTAMP '{RANGE_START}' AND time < TIMESTAMP '{RANGE_STOP}' + INTERVAL 1 DAY")
SQL_OPEN = f"time > TIMESTAMP '{RANGE_START}' AND time < TIMESTAMP '{RANGE_STOP}'"
