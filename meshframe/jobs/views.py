"""The given tables as parts of a series: species, fields, patches, chunks, logs and attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.operators.numbering import exclusive_sum, numbered

#: A whole row of lineitem in an order of its own.
_ALL = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as species by return flag, one iteration a year, without row numbers."""
    return table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").cast("long").alias("iteration"), F.col("l_returnflag").alias("species"), F.col("l_orderkey").alias("id"),
        F.col("l_quantity").alias("position_z"), F.col("l_extendedprice").alias("momentum_z"), F.col("l_discount").alias("weighting"), F.col("l_tax").alias("charge"), *_ALL,
    )


def numbered_particles(spark: SparkSession, sf_dir: str, *iterations: int) -> DataFrame:
    """Particles with their row in the species of their iteration; of these iterations only, if any are named, as others don't count for the numbers."""
    own = particles(spark, sf_dir)
    found = numbered(own.filter(F.col("iteration").isin(*iterations)) if iterations else own, ["iteration", "species"], _ALL)
    return found.select("iteration", "species", "row", "id", "position_z", "momentum_z", "weighting", "charge")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as blocks of one row of a field: iteration is the label, axis 0 the vec_id."""
    n = F.size("embedding").cast("long")
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("iteration"), F.col("vec_id"), F.array("vec_id", F.lit(0).cast("long")).alias("offset"), F.array(F.lit(1).cast("long"), n).alias("extent"), F.col("embedding").alias("values"))


def blocks_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as blocks of 4 x 4 x 4 cells of a field that is 16 wide along axes 1 and 2; iteration is the label."""
    at = F.array(F.floor(F.col("vec_id") / 16) * 4, F.floor(F.col("vec_id") / 4) % 4 * 4, F.col("vec_id") % 4 * 4)
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("iteration"), at.cast("array<long>").alias("offset"), F.array(*(F.lit(4).cast("long"),) * 3).alias("extent"), F.col("embedding").alias("values"))


def length_3d(spark: SparkSession, sf_dir: str) -> int:
    """The extent of that field along axis 0."""
    return (table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] // 16 + 1) * 4


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three numbers of each embedding as components x, y, z of a field."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("iteration"), F.col("vec_id").alias("i0"), *(F.get("embedding", i).cast("double").alias(c) for i, c in enumerate("xyz")))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch for each 1000 orders of an iteration and species of particles, rows in order."""
    counts = particles(spark, sf_dir).groupBy("iteration", "species", F.floor(F.col("l_orderkey") / 1000).alias("patch_id")).agg(F.count("*").alias("num_particles"))
    return exclusive_sum(counts, ["iteration", "species"], ["patch_id"], "num_particles", "num_particles_offset")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log of writes: one series for each type, the user as the iteration."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.col("event_id").alias("write_seq"), F.col("user_id").alias("iteration"), "value")


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """props of events as attributes: by event, on a node of its type."""
    events = table(spark, sf_dir, "events")
    pairs = F.from_json("props", "map<string,string>")
    return events.select(F.col("event_id").alias("iteration"), F.concat(F.lit("/"), "event_type").alias("path"), F.explode(pairs).alias("name", "value")).withColumn("dtype", F.when(F.col("value").rlike(r"^-?\d+$"), "LONG").otherwise("STRING"))


#: The same in SQL.
PARTICLES = """p AS (SELECT year(l_shipdate) iteration, l_returnflag species, l_orderkey id, l_quantity position_z, l_extendedprice momentum_z, l_discount weighting, l_tax charge, l_orderkey,
  row_number() OVER (PARTITION BY year(l_shipdate), l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus, l_shipdate) - 1 "row" FROM lineitem)"""
PATCHES = """c AS (SELECT iteration, species, l_orderkey // 1000 patch_id, count(*) num_particles FROM p GROUP BY ALL),
q AS (SELECT *, CAST(coalesce(sum(num_particles) OVER (PARTITION BY iteration, species ORDER BY patch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) num_particles_offset FROM c)"""
LOG = "g AS (SELECT event_type series, event_id write_seq, user_id iteration, value FROM events)"
CELLS = "e AS (SELECT CAST(label AS BIGINT) iteration, vec_id i0, unnest(range(len(embedding))) i1, unnest(embedding) v FROM embeddings)"
CELLS_3D = "e AS (SELECT CAST(label AS BIGINT) iteration, vec_id // 16 * 4 + k // 16 i0, vec_id // 4 % 4 * 4 + k // 4 % 4 i1, vec_id % 4 * 4 + k % 4 i2, embedding[k + 1] v FROM (SELECT *, unnest(range(64)) k FROM embeddings))"
BLOCKS_3D = "b AS (SELECT CAST(label AS BIGINT) iteration, vec_id // 16 * 4 o0, vec_id // 4 % 4 * 4 o1, vec_id % 4 * 4 o2 FROM embeddings)"
