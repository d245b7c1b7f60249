"""Row numbers, running sums and running maxima in order, without a window over everything in one task.

Rows are dealt into buckets by quantiles of a numeric order column, so that a long tail or an outlier makes no large bucket. A
small table holds one figure for each bucket; its prefix is joined back, and only the rows of one bucket are ordered together.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: The rows that a bucket aims at, the most buckets, and the sampled rows a bucket that place its ends.
ROWS, BUCKETS, SAMPLED = 100_000, 16_384, 100


def _bucketed(df: DataFrame, order: str, buckets: int) -> DataFrame:
    """df with __bucket: the number of quantiles at or below the order column; null before all.

    Their number follows from the count of rows, and a sample places them: they divide the work and decide about no result.
    """
    key = F.col(order).cast("double")
    n = df.select(order).count()
    buckets = min(buckets, n // ROWS + 1)
    splits = []
    if buckets > 1:
        keys, share = df.select(key.alias("__key")), SAMPLED * buckets / n
        keys = (keys if share >= 1 else keys.sample(share, seed=0)).filter(F.abs("__key") < float("inf"))  # NaN is greater
        cuts = keys.agg(F.percentile_approx("__key", [i / buckets for i in range(1, buckets)], max(10_000, 10 * buckets))).first()[0]
        splits = sorted(set(cuts or []))
    if not splits:
        return df.withColumn("__bucket", F.when(key.isNotNull(), F.lit(0)).cast("long"))
    found = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="__key", outputCol="__at", handleInvalid="keep").transform(df.withColumn("__key", key))
    return found.withColumn("__bucket", F.when(key.isNotNull(), F.col("__at")).cast("long")).drop("__key", "__at")


def _with_prefix(df: DataFrame, keys: list[str], order: str, value: Column, combine, buckets: int) -> DataFrame:
    """df with __bucket and __before, the combination of value over the earlier buckets of the keys (null: none)."""
    df = _bucketed(df, order, buckets)
    sums = df.groupBy(*keys, "__bucket").agg(combine(value).alias("__own"))
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("__before", combine(F.col("__own")).over(earlier)).drop("__own")
    named = before.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate([*keys, "__bucket"])), "__before")
    on = F.lit(True)
    for i, c in enumerate([*keys, "__bucket"]):
        on = on & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return df.join(named, on, "left").drop(*(f"__k{i}" for i in range(len(keys) + 1)))


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str = "row", buckets: int = BUCKETS) -> DataFrame:
    """df with consecutive numbers from 0 within the keys, by the order columns; the first is an integer column."""
    found = _with_prefix(df, keys, order[0], F.lit(1), F.sum, buckets)
    local = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(*order)) - 1
    return found.withColumn(out, (F.coalesce("__before", F.lit(0)) + local).cast("long")).drop("__bucket", "__before")


def exclusive_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, buckets: int = BUCKETS) -> DataFrame:
    """df with the sum of value over the earlier rows of the keys: a long of integers, else of the type of the sum."""
    found = _with_prefix(df, keys, order[0], F.col(value), F.sum, buckets)
    local = F.sum(value).over(Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    kind = df.schema[value].dataType
    total = F.coalesce("__before", F.lit(0)) + F.coalesce(local, F.lit(0))
    return found.withColumn(out, total.cast("long") if isinstance(kind, IntegralType) else total).drop("__bucket", "__before")


def earlier_max(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, buckets: int = BUCKETS) -> DataFrame:
    """df with the maximum of value over the earlier rows of the keys; null for the first."""
    found = _with_prefix(df, keys, order[0], F.col(value), F.max, buckets)
    local = F.max(value).over(Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn(out, F.greatest("__before", local)).drop("__bucket", "__before")
