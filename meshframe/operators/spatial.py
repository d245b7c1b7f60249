"""Boxes and points joined in any number of dimensions, by equal cells of a grid that fits the boxes.

Along each axis a box has a level: the least power of two (times a step) that its extent fits in. A pair of boxes meets in the grid whose cells
have, along each axis, the larger of the two levels: there each of them lies in two cells an axis at most, however large or thin it is. So every box is dealt
into a few cells for each combination of levels on the other side, both sides join on equality, and a pair is kept in the cell
of the lower corner of its intersection, which is just one. Nothing is broadcast and no side is held whole: the join asks for a sorted merge, as
Spark's guess of a dealt side is that of the file it comes from, before its rows are dealt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Combinations of levels of a side at most; beyond it levels are taken in wider steps.
MOST_LEVELS = 32
#: The level of points, below that of any box.
POINT = -2000


def _level(lo: Column, hi: Column, step: int) -> Column:
    return (F.ceil(F.log2((hi - lo).cast("double")) / step) * step).cast("int")


def _levels(df: DataFrame, side: str, rank: int) -> tuple[list[tuple[int, ...]], int]:
    """The combinations of levels that the boxes have, few of them, and the step that makes them few."""
    step = 1
    while True:
        own = [_level(F.get(f"{side}_lo", d), F.get(f"{side}_hi", d), step).alias(f"l{d}") for d in range(rank)]
        found = df.select(*own).distinct().limit(MOST_LEVELS + 1).collect()
        if len(found) <= MOST_LEVELS or step > 2048:
            return sorted(map(tuple, found)), step
        step *= 2


def _dealt(df: DataFrame, side: str, rank: int, step: int | None, mine: list[tuple[int, ...]], others: list[tuple[int, ...]]) -> DataFrame:
    """A row for each cell and each combination of levels of the other side, with the number of the pair of combinations; step None: points."""
    level = lambda o: F.array(*map(F.lit, o))
    own = [F.lit(POINT) if step is None else _level(F.get(f"{side}_lo", d), F.get(f"{side}_hi", d), step) for d in range(rank)]
    df = df.withColumn(f"{side}_own", F.array(*own)).withColumn("__at", (F.array_position(F.array(*map(level, mine)), F.col(f"{side}_own")) - 1).cast("int"))
    pair = lambda n: F.col("__at") * len(others) + n if side == "l" else F.col("__at") + n * len(mine)
    df = df.withColumn("__other", F.explode(F.array(*(F.struct(level(o).alias("own"), pair(n).alias("pair")) for n, o in enumerate(others)))))
    df = df.withColumns({f"{side}_other": F.col("__other.own"), f"{side}_pair": F.col("__other.pair")}).drop("__other", "__at")
    for d in range(rank):
        width = F.pow(F.lit(2.0), F.greatest(F.get(f"{side}_own", d), F.get(f"{side}_other", d)))
        first = F.floor(F.get(f"{side}_lo", d).cast("double") / width)
        # a box that ends where a cell begins isn't in that cell
        last = F.greatest(first, F.ceil(F.get(f"{side}_hi", d).cast("double") / width) - 1)
        df = df.withColumn(f"{side}_cell{d}", first if step is None else F.explode(F.sequence(first, last)))
    return df


def meeting(left: DataFrame, right: DataFrame, rank: int, keys: Sequence[str] = (), points: bool = False) -> DataFrame:
    """The pairs of rows with equal keys whose boxes meet: left has l_lo and l_hi, right r_lo and r_hi, arrays of numbers; a box goes up to, not including, hi.

    With points, left has only l_lo, and pairs are the points inside a box. Other columns of both sides stay; their names must differ but for the keys.
    Boxes without room, and bounds that are null or NaN, meet nothing. Each pair comes once.
    """
    sides = {"l": left, "r": right}
    for side, df in sides.items():
        for d in range(rank):
            lo = F.get(f"{side}_lo", d)
            df = df.filter(lo.isNotNull() & ~F.isnan(lo.cast("double")) if points and side == "l" else (F.get(f"{side}_hi", d) > lo) & ~F.isnan(lo.cast("double")) & ~F.isnan(F.get(f"{side}_hi", d).cast("double")))
        sides[side] = df
    r_levels, r_step = _levels(sides["r"], "r", rank)
    l_levels, l_step = ([(POINT,) * rank], None) if points else _levels(sides["l"], "l", rank)
    none = [(0,) * rank]
    l = _dealt(sides["l"], "l", rank, l_step, l_levels or none, r_levels or none)  # noqa: E741
    r = _dealt(sides["r"], "r", rank, r_step, r_levels or none, l_levels or none).drop("r_own", "r_other")
    r = r.select(*(F.col(k).alias(f"__r_{k}") for k in keys), *(c for c in r.columns if c not in keys))
    on = F.col("l_pair") == F.col("r_pair")
    for d in range(rank):
        on = on & (F.col(f"l_cell{d}") == F.col(f"r_cell{d}"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__r_{k}"))
    both = l.join(r.hint("merge"), on)
    for d in range(rank):
        lo, hi = F.get("l_lo", d), F.get("l_lo" if points else "l_hi", d)
        both = both.filter((lo < F.get("r_hi", d)) & (F.get("r_lo", d) <= hi if points else F.get("r_lo", d) < hi))
        corner = F.floor(F.greatest(lo, F.get("r_lo", d)).cast("double") / F.pow(F.lit(2.0), F.greatest(F.get("l_own", d), F.get("l_other", d))))
        both = both.filter(corner == F.col(f"l_cell{d}"))
    return both.drop(*(f"{s}_{c}" for s in "lr" for c in ("own", "other", "pair", *(f"cell{d}" for d in range(rank)))), *(f"__r_{k}" for k in keys))
