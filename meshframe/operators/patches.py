"""Particle patches: which rows and which box each one holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshframe.operators.spatial import meeting


def in_patch(particles: DataFrame, patches: DataFrame, keys: Sequence[str] = ("iteration", "species"), width: int = 1 << 16, how: str = "inner") -> DataFrame:
    """Particles with the patch of their row: rows [num_particles_offset, num_particles_offset + num_particles).

    Both sides are dealt into row ranges of `width`, so it's an equi-join at any number of patches. left_semi
    keeps the particles of any patch, left_anti those of none.
    """
    last = F.col("num_particles_offset") + F.col("num_particles") - 1
    dealt = patches.filter("num_particles > 0").withColumn("__range", F.explode(F.sequence(F.floor(F.col("num_particles_offset") / width), F.floor(last / width))))
    extra = [c for c in patches.columns if c not in keys]
    dealt = dealt.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__range").alias("__p_range"), *extra)
    rows = particles.withColumn("__range", F.floor(F.col("row") / width))
    on = (F.col("__range") == F.col("__p_range")) & (F.col("row") >= F.col("num_particles_offset")) & (F.col("row") < F.col("num_particles_offset") + F.col("num_particles"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return rows.join(dealt, on, how).drop("__range", "__p_range", *(f"__{k}" for k in keys))


def inside(positions: Sequence[str], axes: Sequence[str]) -> Column:
    """offset <= position < offset + extent on every axis."""
    out = F.lit(True)
    for p, a in zip(positions, axes, strict=True):
        out = out & (F.col(p) >= F.col(f"offset_{a}")) & (F.col(p) < F.col(f"offset_{a}") + F.col(f"extent_{a}"))
    return out


def violators(particles: DataFrame, patches: DataFrame, positions: Sequence[str], axes: Sequence[str], **options) -> DataFrame:
    """Particles outside the box of the patch that holds their row; null positions count as outside."""
    return in_patch(particles, patches, **options).filter(~F.coalesce(inside(positions, axes), F.lit(False)))


def at_position(particles: DataFrame, patches: DataFrame, positions: Sequence[str], axes: Sequence[str], keys: Sequence[str] = ("iteration", "species")) -> DataFrame:
    """Particles with each patch whose box holds their position, offset <= position < offset + extent on every axis; null positions are in none.

    Found by position alone, in any number of axes and whatever patch a particle's row belongs to: see spatial.meeting. Columns of the patches that
    particles have too, but for the keys, must be renamed before.
    """
    low = F.array(*(F.col(f"offset_{a}").cast("double") for a in axes))
    high = F.array(*((F.col(f"offset_{a}") + F.col(f"extent_{a}")).cast("double") for a in axes))
    points = particles.withColumn("l_lo", F.array(*(F.col(p).cast("double") for p in positions)))
    return meeting(points, patches.withColumns({"r_lo": low, "r_hi": high}), len(axes), keys, points=True).drop("l_lo", "r_lo", "r_hi")


def totals_at_position(particles: DataFrame, patches: DataFrame, positions: Sequence[str], axes: Sequence[str], sums: dict[str, str], keys: Sequence[str] = ("iteration", "species")) -> DataFrame:
    """The patches that hold any particle by position, with n, their particles, and sums of columns of these (new name: column).

    Particles of one position and patches of one box are met once, so the pairs grow with the positions and boxes that differ, not with rows times patches.
    """
    box = [*keys, *(f"{c}_{a}" for a in axes for c in ("offset", "extent"))]
    places = particles.groupBy(*keys, *positions).agg(F.count("*").alias("__n"), *(F.sum(c).alias(f"__{s}") for s, c in sums.items()))
    met = at_position(places, patches.select(*box).distinct(), positions, axes, keys)
    return patches.join(met.groupBy(*box).agg(*(F.sum(f"__{s}").alias(s) for s in ("n", *sums))), box)


def pruned(patches: DataFrame, box: dict[str, tuple[float, float]]) -> DataFrame:
    """Patches that meet a box of (low, high) by axis."""
    for a, (lo, hi) in box.items():
        patches = patches.filter((F.col(f"offset_{a}") < hi) & (F.col(f"offset_{a}") + F.col(f"extent_{a}") > lo))
    return patches


def patch_counts(patches: DataFrame, keys: Sequence[str] = ("iteration", "species")) -> DataFrame:
    return patches.groupBy(*keys).agg(F.count("*").alias("num_patches"), F.sum("num_particles").alias("num_particles"))
