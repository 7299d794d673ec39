"""Typed reads: look up a table's schema, then apply a per-type cast map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_types(df: DataFrame) -> dict[str, str]:
    """``{column: type name}`` from the schema (no data read)."""
    return {f.name: f.dataType.typeName() for f in df.schema.fields}


def typed_projection(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """Every column whose type name is a key of ``casts`` is cast to the mapped type."""
    types = column_types(df)
    return df.select(*[F.col(c).cast(casts[t]).alias(c) if t in casts else F.col(c) for c, t in types.items()])
