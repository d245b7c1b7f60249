"""Series whose components are stored apart, each write of a component a new file: one component of an iteration is overwritten without reading another.

path/<component>/iteration=<k>/write_seq=<n>/kind=<whole|some>: a write holds all places of a component in an iteration, or some of them. A reader
takes the last whole write and what came after it, by the last write of a place. compacted() makes one whole write of iterations that have several.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARTS = "iteration", "write_seq", "kind"


def write(df: DataFrame, path: str, component: str, write_seq: int, *, whole: bool, codec: str = "zstd") -> None:
    """Adds a write of a component: df has iteration, the places (row, or i0, i1, …) and value. Nothing that is stored is read or changed."""
    marked = df.withColumns({"write_seq": F.lit(write_seq).cast("long"), "kind": F.lit("whole" if whole else "some")})
    marked.write.mode("append").option("compression", codec).partitionBy(*PARTS).parquet(f"{path}/{component}")


def writes(stored: DataFrame) -> DataFrame:
    """(iteration, write_seq, kind, counted): the writes of a component and whether readers need them. From folder names; no column is read."""
    found = stored.select(*PARTS).distinct()
    last = F.max(F.when(F.col("kind") == "whole", F.col("write_seq"))).over(Window.partitionBy("iteration"))
    return found.withColumn("counted", F.col("write_seq") >= F.coalesce(last, F.lit(-1)))


def _stored(spark: SparkSession, path: str, component: str, iterations: Sequence[int] | None) -> DataFrame:
    found = spark.read.parquet(f"{path}/{component}")
    found = found.withColumns({"iteration": F.col("iteration").cast("long"), "write_seq": F.col("write_seq").cast("long")})
    return found if iterations is None else found.filter(F.col("iteration").isin(*iterations))


def read(spark: SparkSession, path: str, component: str, iterations: Sequence[int] | None = None) -> DataFrame:
    """(iteration, places, value) of a component as its last writes have it.

    Iterations with one write that counts are read as they are; only the others are merged, by an aggregate with a partial step.
    """
    found = _stored(spark, path, component, iterations)
    places = [c for c in found.columns if c not in (*PARTS, "value")]
    counted = writes(found).filter("counted")
    several = F.count("*").over(Window.partitionBy("iteration")) > 1
    # One row for each write of an iteration; Spark broadcasts them while they are small.
    marked = found.join(counted.select("iteration", "write_seq", several.alias("__several")), ["iteration", "write_seq"])
    merged = marked.filter("__several").groupBy("iteration", *places).agg(F.max_by(F.struct("value"), "write_seq").alias("v"))
    return marked.filter("not __several").select("iteration", *places, "value").unionByName(merged.select("iteration", *places, "v.value"))


def read_together(spark: SparkSession, path: str, components: Sequence[str], iterations: Sequence[int] | None = None) -> DataFrame:
    """(iteration, places, a column for each component), by place; what a component lacks is null."""
    parts = [read(spark, path, c, iterations).withColumnRenamed("value", c) for c in components]
    keys = [c for c in parts[0].columns if c != components[0]]
    return reduce(lambda a, b: a.join(b, keys, "full"), parts)


def compacted(spark: SparkSession, path: str, component: str) -> list[int]:
    """Makes one whole write of each iteration that has several, then removes those; other iterations' files are not touched. Returns the iterations.

    A whole write counts from the moment that it is there, so readers see the same before and after, and a run that was broken off can be run again.
    """
    found = writes(_stored(spark, path, component, None)).groupBy("iteration").agg(F.count("*").alias("n"), F.max("write_seq").alias("last"), F.collect_set(F.struct("write_seq", "kind")).alias("all"))
    rows = {r["iteration"]: r for r in found.filter("n > 1").collect()}  # a row an iteration that was written again
    for seq in sorted({r["last"] for r in rows.values()}):
        own = [k for k, r in rows.items() if r["last"] == seq]
        write(read(spark, path, component, own), path, component, seq + 1, whole=True)
    jvm = spark._jvm
    for k, r in rows.items():
        for w in r["all"]:
            folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{component}/iteration={k}/write_seq={w['write_seq']}/kind={w['kind']}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return sorted(rows)
