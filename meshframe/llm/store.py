"""Tables written to the shared folder of the cluster, to cut lineage and share work between branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meshframe.sources.scratch import folder, shared_dir


def place(spark: SparkSession, name: str) -> str:
    """A new folder of this application in the shared one."""
    return folder(spark, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: later reads survive lost executors."""
    path = place(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that are sent to all tasks, up to 4 MB; more are joined by a shuffle.
MOST_BROADCAST = 100_000


def side(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df, a stored table of a few numbers a row, as the smaller side of a join: broadcast if its rows are few enough, else shuffled."""
    return F.broadcast(df) if df.count() <= most else df.hint("shuffle_hash")


def clear(spark: SparkSession) -> None:
    """Deletes the tables that this application has stored; call it when their results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(df: DataFrame) -> None:
    """Deletes the files of a table that `stored` has made, when nothing reads it any more."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent() if df.inputFiles() else None
    if folder is not None:
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def column(name: str) -> Column:
    """The column of just this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns of these names, in any case of letters."""
    taken = {n.lower() for n in names}
    return df.select(*(column(c) for c in df.columns if c.lower() not in taken))


def extended(df: DataFrame, new: str) -> StructType:
    """The schema of df and new columns."""
    return StructType([*df.schema.fields, *StructType.fromDDL(new).fields])


def plain(df: DataFrame) -> DataFrame:
    """df with names that Arrow functions can be given: those with dots, backticks or blanks are replaced. See named."""
    return df.toDF(*(c if c.isidentifier() else f"__column_{i}" for i, c in enumerate(df.columns)))


def named(df: DataFrame, names: list[str]) -> DataFrame:
    """df with these names for its first columns."""
    return df.toDF(*names, *df.columns[len(names) :])
