"""Columnar series of which some files can't be read: the good ones are read, the bad ones reported."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A file larger than this is reported without being looked into again for the reason.
MOST_BYTES = 256 << 20


def _reasons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Why each file can't be read, null for one without rows. One file at a time."""
    import pyarrow.parquet as pq

    for batch in batches:
        for i in range(batch.num_rows):
            content, why = batch.column(1)[i].as_py(), "the file can't be decoded to its end"
            try:
                if content is not None:
                    why = None
                    for part in pq.ParquetFile(io.BytesIO(content)).iter_batches(4096):
                        why = why if part.num_rows else None
            except Exception as e:  # noqa: BLE001  any reason is reported
                why = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
            yield pa.record_batch({"file": batch.column(0).slice(i, 1), "error": pa.array([why], pa.string())})


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """Files of the folder, from listing alone; hidden ones are left out, as Spark does."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("_metadata.file_path").alias("file")).filter(~F.col("file").rlike("/[_.][^/]*(/|$)"))


def read(spark: SparkSession, path: str, *, deep: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, bad): the rows of the files that can be read, and (iteration, file, error) of the others. ValueError if there are files and none is good.

    A file whose footer can't be read is bad; with deep, so is one whose data can't be decoded to its end, for which all columns are read once. Files
    without rows are good. The good rows come from the good files alone, whose names Spark is given; the bad ones, and only they, are
    opened once more, each by a task, for the reason. iteration is that of the folder, or null.
    """
    lenient = spark.read.option("ignoreCorruptFiles", True).option("recursiveFileLookup", False)
    listed, name = _listed(spark, path), F.col("_metadata.file_path").alias("file")
    try:
        rows = lenient.parquet(path)
    except AnalysisException:  # no footer gives a schema
        rows = spark.createDataFrame([], "iteration long")
        seen = listed.limit(0)
    else:
        seen = rows.groupBy(name).agg(F.count("*").alias("n"))
    if deep and "n" in seen.columns:
        inner = [c for c in rows.columns if c != "iteration"]
        decoded = rows.select(name, F.xxhash64(*inner).alias("h")).groupBy("file").agg(F.count("*").alias("m"), F.bit_xor("h").alias("h"))
        seen = seen.join(decoded.filter("h is not null"), "file").filter("n = m").select("file", "n")
    doubtful = listed.join(seen, "file", "left_anti")
    names = [r["file"] for r in doubtful.select("file").collect()]  # the files without readable rows
    bad = []
    if names:
        suspects = spark.read.format("binaryFile").load(names).select(F.col("_metadata.file_path").alias("file"), F.when(F.col("length") <= MOST_BYTES, F.col("content")).alias("content"))
        bad = [(r["file"], r["error"]) for r in suspects.mapInArrow(_reasons, "file string, error string").filter("error is not null").collect()]
    good = [f for f in (r["file"] for r in listed.select("file").collect()) if f not in {b[0] for b in bad}]
    if bad and not good:
        raise ValueError(f"none of {len(bad)} files can be read: {bad[0][1]}")
    found = spark.read.option("basePath", path).option("mergeSchema", True).parquet(*good) if good else rows
    if "iteration" in found.columns:
        found = found.withColumn("iteration", F.col("iteration").cast("long"))
    report = spark.createDataFrame(bad, "file string, error string")
    key = F.nullif(F.regexp_extract("file", r"/iteration=(\d+)/", 1), F.lit("")).cast("long")
    return found, report.select(key.alias("iteration"), "file", "error")
