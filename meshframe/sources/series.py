"""Columnar series on storage: written by encoding, read by iteration, appended, overwritten, laid out anew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.functions.attributes import copied
from meshframe.operators.replay import replay, snapshots

ENCODINGS = ("fileBased", "groupBased", "variableBased")


def write(df: DataFrame, path: str, encoding: str = "fileBased", mode: str = "overwrite", codec: str = "zstd") -> None:
    """A table of a series: a folder for each iteration, one table, or a log with a snapshot column."""
    if encoding not in ENCODINGS:
        raise ValueError(f"no encoding {encoding}")
    if encoding == "variableBased" and "snapshot" not in df.columns:
        df = df.withColumn("snapshot", F.array("iteration"))
    writer = df.write.mode(mode).option("compression", codec)
    (writer.partitionBy("iteration") if encoding == "fileBased" else writer).parquet(path)


def append(df: DataFrame, path: str, write_seq: int, encoding: str = "fileBased", codec: str = "zstd") -> None:
    """Adds iterations; rows carry the number of the write, by which readers resolve repeated iterations."""
    write(df.withColumn("write_seq", F.lit(write_seq).cast("long")), path, encoding, "append", codec)


def read(spark: SparkSession, path: str, keys: Sequence[int] | None = None) -> DataFrame:
    """The table; with keys, only their folders or row groups are touched."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    df = df.withColumn("iteration", F.col("iteration").cast("long"))
    return df if keys is None else df.filter(F.col("iteration").isin(*keys))


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with the rows of new in place of those of equal keys; columns that new lacks keep their old values."""
    same = [c for c in new.columns if c not in keys]
    left = [c for c in old.columns if c not in keys and c not in same]
    both = old.withColumn("__o", F.lit(True)).join(new.select(*keys, *(F.col(c).alias(f"__{c}") for c in same), F.lit(True).alias("__n")), list(keys), "full")
    merged = [F.when(F.col("__n"), F.col(f"__{c}")).otherwise(F.col(c) if c in old.columns else F.lit(None)).alias(c) for c in same]
    return both.select(*keys, *left, *merged)


def overwrite_iterations(df: DataFrame, path: str, codec: str = "zstd") -> None:
    """Replaces the iterations of df in a series of one folder each; the others aren't touched."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", codec).partitionBy("iteration").parquet(path)


def without(df: DataFrame, iterations: Sequence[int] = (), columns: Sequence[str] = ()) -> DataFrame:
    """df without iterations and without records."""
    kept = df.filter(~F.col("iteration").isin(*iterations)) if iterations else df
    return kept.drop(*columns)


def defragmented(df: DataFrame, files: int, order: Sequence[str] = ("iteration", "row")) -> DataFrame:
    """df in ranges of the order, sorted inside: each written file is one chunk."""
    return df.repartitionByRange(files, *order).sortWithinPartitions(*order)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def sql(df: DataFrame, name: str, query: str) -> DataFrame:
    """A query over a species table under a name."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.sql(query)


def read_variable(spark: SparkSession, path: str, keys: Sequence[str] = (), policy: str = "last", order: str = "write_seq") -> DataFrame:
    """A variable-based series as a reader sees it: each step counts for the iterations of its snapshot, repeated ones are resolved by the policy of replay."""
    return replay(snapshots(spark.read.parquet(path)), policy, keys, order)


def pipe(tables: dict[str, DataFrame], path: str, encoding: str = "fileBased", codec: str = "zstd", transform=None, version_attribute: str | None = None, files: int | None = None) -> None:
    """Copies a series' tables into another layout; attributes without what a writer makes, data through transform.

    Tables with steps that were written more than once (a column write_seq, and row, i0… or patch_id as their place) come
    as their last writes. With files, data is laid out anew in as many ranges of iteration and place. version_attribute is as in copied;
    with a table of attributes it must be named.
    """
    for name, df in tables.items():
        if name == "attributes":
            if version_attribute is None:
                raise ValueError("name the attribute that holds the format's version: it isn't copied")
            copied(df, version_attribute).write.mode("overwrite").option("compression", codec).parquet(f"{path}/{name}")
        else:
            place = [c for c in df.columns if c in ("row", "patch_id", "linear_index") or c[:1] == "i" and c[1:].isdigit()]
            if "write_seq" in df.columns and place:
                others = [c for c in df.columns if c not in ("iteration", *place)]
                df = df.groupBy("iteration", *place).agg(F.max_by(F.struct(*others), "write_seq").alias("__last")).select("iteration", *place, *(F.col(f"__last.{c}").alias(c) for c in others))
            df = transform(df) if transform else df
            write(defragmented(df, files, ("iteration", *place)) if files else df, f"{path}/{name}", encoding, "overwrite", codec)
