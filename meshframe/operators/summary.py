"""What a series holds: counts and sorted names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _names(kind: str):
    return F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("owner"))))


def listing(components: DataFrame) -> DataFrame:
    """One row: the number of iterations, and the distinct mesh and species names over all of them."""
    return components.agg(F.count_distinct("iteration").alias("iterations"), _names("mesh").alias("meshes"), _names("particle").alias("species"))


def by_iteration(components: DataFrame) -> DataFrame:
    """For each iteration the names of its meshes and species, and the number of its records."""
    record = F.struct("kind", "owner", "record")
    return components.groupBy("iteration").agg(_names("mesh").alias("meshes"), _names("particle").alias("species"), F.count_distinct(record).alias("records"))


def missing(components: DataFrame) -> DataFrame:
    """(iteration, kind, owner): what is in some iteration but not in this one."""
    owners = components.select("kind", "owner").distinct()
    names = owners.agg(F.collect_set(F.struct("kind", "owner")).alias("all"))  # names, not data: a handful
    each = components.groupBy("iteration").agg(F.collect_set(F.struct("kind", "owner")).alias("own"))
    return each.join(F.broadcast(names)).select("iteration", F.inline(F.array_except("all", "own")))


def uncovered(chunks: DataFrame, components: DataFrame) -> DataFrame:
    """Components of which no chunk was written."""
    return components.join(chunks.select("iteration", "path").distinct(), ["iteration", "path"], "left_anti")


def timings(report: DataFrame) -> DataFrame:
    """Mean and greatest write and read times by configuration."""
    keys = ("config", "backend", "ranks", "dtype", "iterations")
    return report.groupBy(*keys).agg(*(f(c).alias(f"{n}_{c}") for c in ("write_s", "read_s") for n, f in (("mean", F.avg), ("max", F.max))))
