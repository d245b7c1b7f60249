"""Series that grow while they are read: steps arrive, late and repeated ones are skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.operators.chunks import merged_boxes
from meshframe.operators.numbering import earlier_max
from meshframe.operators.replay import snapshots
from meshframe.operators.spatial import meeting


def read_steps(spark: SparkSession, path: str, schema: str | T.StructType, files_per_batch: int = 16) -> DataFrame:
    """A stream of the Parquet files that are put into a folder; a file becomes visible whole."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def expanded(stream: DataFrame) -> DataFrame:
    """A row for each iteration of a step: its snapshots, or iteration 0 without any."""
    return snapshots(stream)


def first_writes(stream: DataFrame, keys: list[str], ingest: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Repeated steps dropped. With an ingest time, state is kept for the delay only; without, for good."""
    if ingest is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(ingest, delay).dropDuplicatesWithinWatermark(keys)


def split_defective(stream: DataFrame, good) -> tuple[DataFrame, DataFrame]:
    """The steps that hold the condition, and the others, to be reported aside."""
    return stream.filter(F.coalesce(good, F.lit(False))), stream.filter(~F.coalesce(good, F.lit(False)))


#: Parts of the state of a capture; a batch writes those anew whose series it has.
STATE_PARTS = 64


def _part(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(STATE_PARTS)).cast("int").alias("part")


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _versions(spark: SparkSession, path: str, before: int, levels: tuple[str, str] = ("part", "batch")) -> dict[int, list[int]]:
    """The batches before this one that wrote each part of the state, oldest first; from folder names."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, list[int]] = {}
    for folder in system.globStatus(spark._jvm.org.apache.hadoop.fs.Path("/".join((path, *(f"{level}=*" for level in levels))))) or []:
        own = {k: int(v) for k, v in (n.split("=") for n in folder.getPath().toString().split("/")[-2:])}
        if own["batch"] < before:
            found.setdefault(own["part"], []).append(own["batch"])
    return {p: sorted(v) for p, v in found.items()}


class _State:
    """The parts of a state on storage that the series of a batch are in. The version before is kept until the next one is written."""

    def __init__(self, batch: DataFrame, path: str, number: int, key: str, columns: str, levels: tuple[str, str] = ("part", "batch")):
        self.spark, self.path, self.number, self.key, self.levels = batch.sparkSession, path, number, key, levels
        self.schema = f"{key} {batch.schema[key].dataType.simpleString()}, {columns}"
        self.versions = _versions(self.spark, path, number, levels)
        self.touched = sorted(r[0] for r in batch.select(_part(key)).distinct().collect())  # at most STATE_PARTS

    def _folder(self, part: int, batch: int) -> str:
        return "/".join((self.path, *(f"{level}={dict(part=part, batch=batch)[level]}" for level in self.levels)))

    def before(self) -> DataFrame:
        known = [self._folder(p, self.versions[p][-1]) for p in self.touched if p in self.versions]
        return self.spark.read.schema(self.schema).parquet(*known) if known else self.spark.createDataFrame([], self.schema)

    def replace(self, state: DataFrame) -> None:
        """Writes the parts anew, each as one file, and removes the versions before the last."""
        state = state.select(_part(self.key), F.lit(self.number).alias("batch"), *state.columns)
        state.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.levels).parquet(self.path)
        old = [(p, v) for p in self.touched for v in self.versions.get(p, [])[:-1]]
        for p, v in old:
            _remove(self.spark, self._folder(p, v))
        if self.levels[0] == "batch":
            left = {v for versions in _versions(self.spark, self.path, self.number + 1, self.levels).values() for v in versions}
            for v in {v for _, v in old} - left:
                _remove(self.spark, f"{self.path}/batch={v}")


def running_max_capture(stream: DataFrame, path: str, checkpoint: str, key: str = "series"):
    """Starts a query that writes the steps (key, write_seq, iteration) whose iteration is greater than all earlier ones of their series to path/steps, batch by batch, and ends when all is read.

    A batch is compared by ranges of write_seq, so that a series with most of the log is many tasks. The state is the greatest iteration of each series, in
    parts of which a batch reads and writes only those that its series are in; a batch that runs again does the same. Steps without a
    series are one series; those without an iteration are left out.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.select(key, "write_seq", "iteration").filter("iteration is not null").persist()
        state = _State(batch, f"{path}/state", number, key, "most long", ("batch", "part"))
        before = state.before()
        found = earlier_max(batch, [key], ["write_seq"], "iteration", "__seen")
        found = found.join(before.select(F.col(key).alias("__key"), "most"), F.col(key).eqNullSafe(F.col("__key")), "left")
        floor = F.greatest("__seen", "most")
        found.filter(floor.isNull() | (F.col("iteration") > floor)).drop("__seen", "__key", "most").write.mode("overwrite").parquet(f"{path}/steps/batch={number}")
        new = batch.groupBy(key).agg(F.max("iteration").cast("long").alias("most"))
        state.replace(before.unionByName(new).groupBy(key).agg(F.max("most").alias("most")))
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closed_capture(stream: DataFrame, path: str, checkpoint: str, key: str = "series", horizon: int | None = None):
    """Starts a query that writes each iteration of a series once, and steps that open a closed one again aside; it ends when all is read.

    stream has key, iteration, write_seq and other columns. path/steps has the first write of each (key, iteration), path/reopened the other
    steps, both by batch; an iteration is closed when its first step is written, for good. The closed iterations are kept as intervals (key, lo, hi) in
    path/closed: a series without gaps is one row, however long. With a horizon, iterations that lie more than it below the greatest one of their
    series count as closed, written or not, and their intervals as one; a series then has at most horizon + 2. Steps without a key or an
    iteration can't be told apart and are left out: put them aside with split_defective.

    A batch reads and writes only the parts of the intervals that its series are in. The version before is kept until the next one is written,
    so a batch that runs again does the same. Intervals are found by cells and merged by ranges of the axis: no series is one task.
    """
    lowest = -(1 << 62)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.filter(F.col(key).isNotNull() & F.col("iteration").isNotNull()).withColumn("__row", F.struct(*batch.columns)).persist()
        parts = _State(batch, f"{path}/closed", number, key, "lo long, hi long")
        closed = parts.before()
        first = batch.groupBy(key, "iteration").agg(F.min_by("__row", "write_seq").alias("__row"))
        points = first.withColumn("l_lo", F.array(F.col("iteration").cast("long")))
        again = meeting(points, closed.select(key, F.array("lo").alias("r_lo"), F.array(F.col("hi") + 1).alias("r_hi")), 1, [key], points=True).select(key, "iteration")
        fresh = first.join(again, [key, "iteration"], "left_anti").persist()
        fresh.select("__row.*").write.mode("overwrite").parquet(f"{path}/steps/batch={number}")
        # All rows but the first of a new iteration: of these one goes, however often it is repeated.
        counted = batch.groupBy("__row").agg(F.count("*").alias("__n")).join(fresh.select("__row", F.lit(1).alias("__one")), "__row", "left")
        repeats = counted.withColumn("__n", F.col("__n") - F.coalesce("__one", F.lit(0))).filter("__n > 0")
        repeats.select(F.explode(F.sequence(F.lit(1), F.col("__n"))), "__row").select("__row.*").write.mode("overwrite").parquet(f"{path}/reopened/batch={number}")
        new = fresh.select(key, F.array(F.col("iteration").cast("long")).alias("offset"), F.array(F.lit(1).cast("long")).alias("extent"))
        old = closed.select(key, F.array("lo").alias("offset"), F.array(F.col("hi") - F.col("lo") + 1).alias("extent"))
        state = merged_boxes(old.unionByName(new), 1, [key]).select(key, F.get("offset", 0).alias("lo"), (F.get("offset", 0) + F.get("extent", 0) - 1).alias("hi"))
        if horizon is not None:
            floor = state.groupBy(key).agg((F.max("hi") - horizon).alias("__floor"))
            state = state.join(floor, key)
            above = state.filter("hi >= __floor").select(key, F.greatest("lo", "__floor").alias("lo"), "hi")
            state = above.unionByName(floor.select(key, F.lit(lowest).alias("lo"), (F.col("__floor") - 1).alias("hi")))
        parts.replace(state.select(key, "lo", "hi"))
        fresh.unpersist()
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closed_iterations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The intervals (key, lo, hi) of closed iterations that closed_capture has reached; schema is that of the three columns."""
    latest = [f"{path}/closed/part={p}/batch={v[-1]}" for p, v in _versions(spark, f"{path}/closed", 1 << 62).items()]
    return spark.read.schema(schema).parquet(*latest) if latest else spark.createDataFrame([], schema)


def capture(stream: DataFrame, sinks: dict[str, Callable[[DataFrame], DataFrame]], path: str, checkpoint: str, order: str | None = None):
    """Starts a query that writes each batch to one or more folders under path, each after its own function, and ends when all is read."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for name, change in sinks.items():
            out = change(batch)
            (out.sortWithinPartitions(order) if order else out).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
