"""Synthetic series of any size, made where they are needed."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.operators.numbering import exclusive_sum


def fields(spark: SparkSession, blocks: int, cells: int, steps: int, names: Sequence[str] = ("rho",)) -> DataFrame:
    """(iteration, block, i, values): cell i of block n at step s is n + 0.01 s + 0.0001 i."""
    rows = spark.range(steps * blocks * cells)
    rows = rows.select(F.floor(F.col("id") / (blocks * cells)).alias("iteration"), (F.floor(F.col("id") / cells) % blocks).alias("block"), (F.col("id") % cells).alias("i"))
    value = F.col("block") + F.lit(0.01) * F.col("iteration") + F.col("i") * F.lit(0.0001)
    return rows.select("*", *(value.alias(n) for n in names))


def particles(spark: SparkSession, blocks: int, per_block: int, steps: int) -> DataFrame:
    """(iteration, row, id, charge, position_x, positionOffset_x); i restarts in each block."""
    rows = spark.range(steps * blocks * per_block)
    n = blocks * per_block
    s, row, i = F.floor(F.col("id") / n), F.col("id") % n, F.col("id") % per_block
    return rows.select(s.alias("iteration"), row.alias("row"), row.alias("id"), (F.lit(0.1) * s + F.lit(0.0001) * i).alias("charge"), (F.lit(1.0) * s + F.lit(0.0002) * i).alias("position_x"), F.lit(0.0).alias("positionOffset_x"))


def unbalanced(rows: DataFrame, rank: str = "block") -> DataFrame:
    """On steps that leave 1 modulo 3, writers that end in 0 write nothing and those that end in 1 write twice."""
    odd = F.col("iteration") % 3 == 1
    times = F.when(odd & (F.col(rank) % 10 == 0), 0).when(odd & (F.col(rank) % 10 == 1), 2).otherwise(1)
    return rows.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))


def random_integers(spark: SparkSession, shape: Sequence[int], most: int = 200_000_000, seed: int = 1) -> DataFrame:
    """(linear_index, value): uniform integers from 0 to most."""
    return spark.range(prod(shape)).select(F.col("id").alias("linear_index"), F.floor(F.rand(seed) * (most + 1)).alias("value"))


#: Cells of a block that one list is made of at most.
RUN = 65_536


def _cells_of(extents: DataFrame, steps: int) -> DataFrame:
    """extents (block, cells and other columns) with iteration and i: a row for each step and cell. Blocks of many cells are made run by run."""
    count = F.col("cells").cast("long")
    zero, run = F.lit(0).cast("long"), F.lit(RUN).cast("long")
    some = extents.filter("cells > 0").withColumn("iteration", F.explode(F.sequence(zero, F.lit(steps - 1).cast("long"))))
    some = some.withColumn("__from", F.explode(F.sequence(zero, count - 1, run)))
    return some.withColumn("i", F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + RUN, count) - 1))).drop("__from")


def fields_of(extents: DataFrame, steps: int) -> DataFrame:
    """(iteration, block, i, rho) of blocks that have as many cells as the table (block, cells) says; values as in fields."""
    return _cells_of(extents.select("block", "cells"), steps).select("iteration", "block", "i", (F.col("block") + F.lit(0.01) * F.col("iteration") + F.col("i") * F.lit(0.0001)).alias("rho"))


def particles_of(extents: DataFrame, steps: int) -> DataFrame:
    """(iteration, block, row, charge, position_x) of blocks of as many particles as the table (block, cells) says; rows are numbered in the order of blocks."""
    placed = exclusive_sum(extents.select("block", "cells"), [], ["block"], "cells", "__first")
    rows, s = _cells_of(placed, steps), F.col("iteration")
    return rows.select("iteration", "block", (F.col("__first") + F.col("i")).alias("row"), (F.lit(0.1) * s + F.lit(0.0001) * F.col("i")).alias("charge"), (F.lit(1.0) * s + F.lit(0.0002) * F.col("i")).alias("position_x"))


def random_integers_of(extents: DataFrame, most: int = 200_000_000, seed: int = 1) -> DataFrame:
    """(block, i, value): uniform integers from 0 to most for each cell of each block, the same whenever they are made."""
    return _cells_of(extents.select("block", "cells"), 1).select("block", "i", F.pmod(F.xxhash64(F.lit(seed), "block", "i"), F.lit(most + 1)).alias("value"))
