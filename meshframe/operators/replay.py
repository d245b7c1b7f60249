"""Reading iterations that were appended over time, by policies for repeated and late steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshframe.operators.numbering import earlier_max

POLICIES = ("first", "ascending", "last", "running_max")


def replay(steps: DataFrame, policy: str = "first", keys: Sequence[str] = (), order: str = "write_seq") -> DataFrame:
    """The steps that a reader sees, one for each iteration of the keys.

    first: the first write of each iteration, to be read in write order. ascending: the same steps, to be read
    by iteration. last: the last write. running_max: without step tags, a step counts only if its iteration is greater
    than that of every earlier one. The order of reading is in the column `position_key`.
    """
    if policy not in POLICIES:
        raise ValueError(f"no policy {policy}")
    if policy == "running_max":
        seen = earlier_max(steps, list(keys), [order], "iteration", "__seen")
        return seen.filter(F.col("__seen").isNull() | (F.col("iteration") > F.col("__seen"))).drop("__seen").withColumn("position_key", F.col(order))
    rest = [c for c in steps.columns if c not in (*keys, "iteration")]
    pick = (F.max_by if policy == "last" else F.min_by)(F.struct(*rest), order)
    found = steps.groupBy(*keys, "iteration").agg(pick.alias("__row")).select(*keys, "iteration", *(F.col(f"__row.{c}").alias(c) for c in rest))
    return found.withColumn("position_key", F.col("iteration") if policy == "ascending" else F.col(order))


def snapshots(steps: DataFrame) -> DataFrame:
    """A row for each iteration that a step stands for: its snapshot array, or iteration 0 without one."""
    return steps.withColumn("iteration", F.explode(F.coalesce("snapshot", F.array(F.lit(0).cast("long")))))


def every(iterations: DataFrame, k: int, rest: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Every k-th iteration in ascending order, of the small iterations table: those whose number, from 1, leaves `rest`."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("iteration"))
    return iterations.withColumn("__n", number).filter(F.col("__n") % k == rest).drop("__n")
