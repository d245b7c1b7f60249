"""Weighted histograms on equal bins; only bins are shuffled, never particles."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshframe.functions.arrays import ravel, unravel


def _guess(value: Column, lo: float, hi: float, bins: int) -> Column:
    """The bin by division, which rounding may set one beside the right one."""
    found = F.width_bucket(value.cast("double"), F.lit(float(lo)), F.lit(float(hi)), F.lit(bins)) - 1
    return F.least(F.greatest(F.coalesce(found, F.lit(0).cast("long")), F.lit(0)), F.lit(bins - 1)).cast("int")


def _settled(value: Column, guess: Column, lo: float, hi: float, bins: int) -> Column:
    """The guess set right against the edges, lo + k * ((hi - lo) / bins), which are one constant array; null outside and for NaN."""
    lo, hi, value = float(lo), float(hi), value.cast("double")
    edges = F.array(*(F.lit(lo + k * ((hi - lo) / bins)) for k in range(bins)), F.lit(hi))
    found = F.when(value < F.get(edges, guess), guess - 1).when((guess < bins - 1) & (value >= F.get(edges, guess + 1)), guess + 1).otherwise(guess)
    return F.when(~F.isnan(value) & (value >= lo) & (value <= hi), found)


def bin_index(value: Column, lo: float, hi: float, bins: int) -> Column:
    """The bin of a value on [lo, hi]: half-open bins, the last one closed; null outside and for NaN."""
    return _settled(value, _guess(value, lo, hi, bins), lo, hi, bins)


def _filled(found: DataFrame, keys: list[str], axes: dict[str, int]) -> DataFrame:
    """All bins of every key, with 0 where nothing fell: the missing ones are added to the list of those found.

    The list of a key has as many entries as there are bins, whatever the input; the data is scanned once.
    """
    n = prod(axes.values())
    entry = F.struct(ravel(list(axes), list(axes.values())).alias("bin"), "weight")
    some = found.groupBy(*keys).agg(F.collect_list(entry).alias("__found"))
    absent = F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), F.col("__found.bin"))
    full = some.select(*keys, F.inline(F.concat("__found", F.transform(absent, lambda k: F.struct(k.alias("bin"), F.lit(0.0).alias("weight"))))).alias("__bin", "weight"))
    index = unravel("__bin", list(axes.values()))
    return full.select(*keys, *(i.cast("int").alias(name) for name, i in zip(axes, index, strict=True)), "weight")


def histogram(df: DataFrame, column: str, bins: int, lo: float, hi: float, weight: Column | None = None, keys: tuple[str, ...] = (), exact: bool = False) -> DataFrame:
    """(keys, bin, weight): sums of weight (default: counts) by bin. exact sums decimals of 6 places."""
    return _histogram(df, {"bin": (F.col(column), lo, hi, bins)}, weight, list(keys), exact)


def histogram_2d(df: DataFrame, x: tuple, y: tuple, weight: Column | None = None, keys: tuple[str, ...] = (), exact: bool = False) -> DataFrame:
    """(keys, bin_x, bin_y, weight); x and y are (column, lo, hi, bins), lo and hi None for the data's range."""
    axes = {}
    for name, (column, lo, hi, bins) in (("bin_x", x), ("bin_y", y)):
        if lo is None or hi is None:
            clean = F.when(~F.isnan(F.col(column).cast("double")), F.col(column))
            least, most = df.agg(F.min(clean), F.max(clean)).first()
            lo, hi = (least if lo is None else lo), (most if hi is None else hi)
        axes[name] = (F.col(column), float(lo or 0), float(hi or 0), bins)
    return _histogram(df, axes, weight, list(keys), exact)


def _histogram(df: DataFrame, axes: dict, weight: Column | None, keys: list[str], exact: bool) -> DataFrame:
    weight = F.lit(1.0) if weight is None else weight
    for value, lo, hi, _ in axes.values():  # reaches the scan; bins are then made once, and only for rows that have one
        df = df.filter(value.isNotNull() & (value >= F.lit(lo)) & (value <= F.lit(hi)) & ~F.isnan(value.cast("double")))
    # The guesses are columns of their own, so that setting them right doesn't make them twice.
    guessed = df.select(*keys, *(a[0].alias(f"__v_{n}") for n, a in axes.items()), *(_guess(*a).alias(f"__g_{n}") for n, a in axes.items()), weight.alias("__w"))
    binned = guessed.select(*keys, *(_settled(F.col(f"__v_{n}"), F.col(f"__g_{n}"), *a[1:]).alias(n) for n, a in axes.items()), "__w")
    total = F.sum(F.col("__w").cast("decimal(18,6)")).cast("double") if exact else F.sum(F.col("__w").cast("double"))
    return _filled(binned.groupBy(*keys, *axes).agg(total.alias("weight")), keys, {n: a[3] for n, a in axes.items()})
