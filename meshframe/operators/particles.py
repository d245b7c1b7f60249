"""Species as tables: columns of records, units, ranges, unions over iterations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.functions.units import scale_columns
from meshframe.operators.numbering import numbered


def column_name(record: str, component: str | None = None) -> str:
    """record for scalar records, record_component for others."""
    return record if component is None else f"{record}_{component}"


def to_df(particles: DataFrame, records: dict[tuple[str, str | None], str], units: dict[tuple[str, str | None], float] | None = None, constants: dict[tuple[str, str | None], float] | None = None, keep: tuple[str, ...] = ("iteration", "row")) -> DataFrame:
    """A species as a wide table. records maps (record, component) to a column; constants hold one value for all rows."""
    stored = particles.select(*keep, *(F.col(c).alias(column_name(*k)) for k, c in records.items()))
    full = stored.withColumns({column_name(*k): F.lit(v) for k, v in (constants or {}).items()})
    return scale_columns(full, {column_name(*k): u for k, u in (units or {}).items()})


def rows_between(df: DataFrame, start: int, stop: int, column: str = "row") -> DataFrame:
    """Rows [start, stop)."""
    return df.filter((F.col(column) >= start) & (F.col(column) < stop))


def iterations(df: DataFrame, *keys: int, strict: bool = False) -> DataFrame:
    """The rows of some iterations; strict raises KeyError if one has none."""
    found = df.filter(F.col("iteration").isin(*keys))
    if strict:
        missing = set(keys) - {r[0] for r in found.select("iteration").distinct().collect()}
        if missing:
            raise KeyError(f"no iteration {sorted(missing)}")
    return found


def union_iterations(parts: list[DataFrame], renumber: list[str] | None = None) -> DataFrame:
    """One table of several; columns that a part lacks are null. renumber gives new consecutive rows by these columns."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole if renumber is None else numbered(whole.drop("row"), [], renumber)


def align(components: dict[str, DataFrame], keys: list[str], value: str = "value") -> DataFrame:
    """Components of one record side by side, by position; ValueError if they differ in length.

    The long rows are shuffled once: a grouping by position, not a chain of joins. A position that a component lacks or has
    more than once is an error when the result is read; null values are values.
    """
    names = list(components)
    long = reduce(DataFrame.unionByName, (df.select(*keys, F.lit(n).alias("__name"), F.col(value).alias("__value")) for n, df in components.items()))
    counts = {r[0]: r[1] for r in long.groupBy("__name").count().collect()}
    if len({counts.get(n, 0) for n in names}) > 1:
        raise ValueError(f"components of different lengths: {counts}")
    own = [F.col("__name") == n for n in names]
    parts = [F.first(F.when(c, F.col("__value")), ignorenulls=True).alias(f"__v{i}") for i, c in enumerate(own)]
    times = [F.count_if(c).alias(f"__n{i}") for i, c in enumerate(own)]
    found = long.groupBy(*keys).agg(*parts, *times)
    wrong = F.raise_error(F.concat_ws(" ", F.lit("not just one value of each component at"), *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys)))
    once = F.forall(F.array(*(f"__n{i}" for i in range(len(names)))), lambda n: n == 1)
    return found.select(*keys, *(F.when(once, F.col(f"__v{i}")).otherwise(wrong).alias(n) for i, n in enumerate(names)))


def column_stats(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Count, mean, least and greatest of columns, by iteration or what else; NaN takes no part."""
    aggs = [F.count("*").alias("n")]
    for c in columns:
        clean = F.when(~F.isnan(F.col(c).cast("double")), F.col(c))
        aggs += [F.avg(clean).alias(f"{c}_mean"), F.min(clean).alias(f"{c}_min"), F.max(clean).alias(f"{c}_max")]
    return df.groupBy(*by).agg(*aggs)


def map_chunks(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, rows: int = 100_000, keys: tuple[str, ...] = ("iteration", "species")) -> DataFrame:
    """What function makes of each chunk of rows of a species, a pandas frame sorted by row; a chunk never holds more than rows of them.

    df has the keys and row, its place. Chunks are independent: the results are one table.
    """
    dealt = df.withColumn("__chunk", F.floor(F.col("row") / rows))
    return dealt.groupBy(*keys, "__chunk").applyInPandas(lambda pdf: function(pdf.drop(columns="__chunk").sort_values("row", kind="stable")), schema)
