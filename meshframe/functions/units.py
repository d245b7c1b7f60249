"""Scaling to SI units, and physical positions and times."""

from __future__ import annotations

from math import isclose

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scaled(df: DataFrame, column: str, unit_si: float) -> Column:
    """The column times its unit, or as it is if the unit is 1 to a relative 1e-9.

    Floats keep their width, integers become doubles.
    """
    if isclose(1.0, unit_si):
        return F.col(column)
    kind = df.schema[column].dataType
    kind = kind if isinstance(kind, (T.FloatType, T.DoubleType)) else T.DoubleType()
    return F.col(column).cast(kind) * F.lit(unit_si).cast(kind)


def scale_columns(df: DataFrame, units: dict[str, float]) -> DataFrame:
    """df with every column of units scaled."""
    return df.withColumns({c: scaled(df, c, u) for c, u in units.items()})


def cell_position(index: Column, spacing: float, offset: float, grid_unit_si: float = 1.0, inside: float = 0.0, factor: float = 1.0) -> Column:
    """Where a cell is along an axis; `inside` (0 to 1) adds the component's place in its cell, off by default."""
    at = index if not inside else index + F.lit(inside)
    return F.lit(float(grid_unit_si)) * (at * F.lit(float(spacing)) + F.lit(float(offset))) * F.lit(float(factor))


def iteration_seconds(df: DataFrame) -> DataFrame:
    """Adds time_si and dt_si to an iterations table; missing values are 0, 1 and 1."""
    unit = F.coalesce("time_unit_si", F.lit(1.0))
    return df.withColumns({"time_si": F.coalesce("time", F.lit(0.0)) * unit, "dt_si": F.coalesce("dt", F.lit(1.0)) * unit})


def record_time(time: Column, time_offset: Column) -> Column:
    """The time of a record that is shifted against its iteration."""
    return time + F.coalesce(time_offset, F.lit(0.0))
