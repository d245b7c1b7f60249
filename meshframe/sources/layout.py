"""Blocks laid out along a space-filling curve, with a small table of the box of each file, which decides what files a box reads.

Blocks of a field are numbered along a Z-order curve through the grid of blocks, and a file has a run of the curve: a compact box in all axes, not
only the first. The table (iteration, file, lo, hi, blocks) has a row a file, named by its folder, which holds just it; a plane on any axis opens the files that it crosses.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from meshframe.functions.slicing import Region

#: The table of boxes, beside the data; readers of the folder don't see it.
BOXES = "_boxes"
#: Files that Spark is given by name at most.
NAMED = 1024


def z_order(index: Sequence[Column]) -> Column:
    """The place on the Z-order curve: the bits of the indices in turn, as many as 63 bits hold of each. Indices start at 0."""
    rank = len(index)
    out = F.lit(0).cast("long")
    for bit in range(63 // rank):
        for d, i in enumerate(index):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(i.cast("long"), bit).bitwiseAND(F.lit(1).cast("long")), bit * rank + rank - 1 - d))
    return out


def write(blocks: DataFrame, path: str, widths: Sequence[int], side: int = 3, mode: str = "overwrite", codec: str = "zstd") -> None:
    """Writes blocks (iteration, offset, extent, …) so that a file has at most a cube of 2**side blocks of these widths an axis, and the table of boxes.

    One exchange by iteration and run of the curve, so no key has more than a file's blocks. With mode append, files are added and only they are added to the table.
    """
    rank = len(widths)
    place = z_order([F.floor(F.get("offset", d) / F.lit(w)) for d, w in enumerate(widths)])
    own = f"w{uuid.uuid4().hex[:12]}"
    laid = blocks.withColumns({"write": F.lit(own), "run": F.shiftright(place, side * rank)})
    laid.repartition("iteration", "run").sortWithinPartitions("iteration", "run", "offset").write.mode(mode).option("compression", codec).partitionBy("write", "iteration", "run").parquet(path)
    # the table follows from the blocks: a list of all files would go through the driver
    bounds = lambda f, stop: F.array(*(f(F.get("offset", d) + (F.get("extent", d) if stop else 0)) for d in range(rank)))
    found = laid.groupBy(F.col("iteration").cast("long").alias("iteration"), "run").agg(bounds(F.min, False).alias("lo"), bounds(F.max, True).alias("hi"), F.count("*").alias("blocks"))
    name = F.concat(F.lit(f"{path}/write={own}/iteration="), F.coalesce(F.col("iteration").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")), F.lit("/run="), F.col("run").cast("string"))
    found.select("iteration", name.alias("file"), "lo", "hi", "blocks").write.mode(mode).parquet(f"{path}/{BOXES}")


def boxes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("iteration long, file string, lo array<long>, hi array<long>, blocks long").parquet(f"{path}/{BOXES}")


def crossing(spark: SparkSession, path: str, box: Region, iterations: Sequence[int] | None = None) -> DataFrame:
    """The rows of the table whose boxes meet the box: one for each file that is then read."""
    found = boxes(spark, path)
    if iterations is not None:
        found = found.filter(F.col("iteration").isin(*iterations))
    for d, (o, e) in enumerate(zip(box.offset, box.extent, strict=True)):
        found = found.filter((F.get("lo", d) < o + e) & (F.get("hi", d) > o))
    return found if 0 not in box.extent else found.limit(0)


def _opened(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The blocks of the files named, with their iteration; each is opened by the task."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    for batch in batches:
        for iteration, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            system, at = (fs.LocalFileSystem(), re.sub("^file:/*", "/", folder)) if folder.startswith(("/", "file:")) else fs.FileSystem.from_uri(folder)
            for info in system.get_file_info(fs.FileSelector(at)):
                if not info.base_name.startswith(("_", ".")):
                    with system.open_input_file(info.path) as source:
                        for part in pq.ParquetFile(source).iter_batches():
                            own = {n: part.column(n) for n in part.schema.names} | {"iteration": pa.array([iteration] * part.num_rows, pa.int64())}
                            yield pa.RecordBatch.from_arrays([own[f.name].cast(f.type) for f in schema], schema=schema)


def read(spark: SparkSession, path: str, box: Region, iterations: Sequence[int] | None = None) -> DataFrame:
    """The blocks of the files that the box crosses, without the run of the curve; meshes.blocks_to_cells cuts them to the box.

    Up to NAMED files are given to Spark by name. More are opened by the tasks, from the table, as Spark would list each of them through the driver; their
    store must be one that pyarrow opens.
    """
    chosen = crossing(spark, path, box, iterations)
    files = [r["file"] for r in chosen.select("file").limit(NAMED + 1).collect()]
    if not files:
        files = [r["file"] for r in boxes(spark, path).select("file").limit(1).collect()]
        found = spark.read.option("basePath", path).parquet(*files).limit(0)
    else:
        found = spark.read.option("basePath", path).parquet(*sorted(files if len(files) <= NAMED else files[:1]))
    found = found.withColumn("iteration", F.col("iteration").cast("long")).drop("run", "write")
    if len(files) > NAMED:
        kind = to_arrow_schema(found.schema)
        parts = spark.sparkContext.defaultParallelism * 4
        found = chosen.select("iteration", "file").repartition(parts, "file").mapInArrow(partial(_opened, schema=kind), found.schema)
    return found if iterations is None else found.filter(F.col("iteration").isin(*iterations))
