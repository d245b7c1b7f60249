"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")) if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def labelled_sample(docs: DataFrame, grades: DataFrame, *, each: int, most_bytes: int) -> DataFrame:
    """(text, grade, weight): at most `each` documents of each grade, those of the least hashes of their ids.

    grades has doc_id and grade, an int; held-out ids and nulls are left out, an id's repeated grades count as
    the greatest. weight is the share of the grade's labels that the sample stands for. Texts of over
    most_bytes bytes aren't sampled. Only the ids are ranked, so a few thousand of them are joined with docs.
    """
    known = grades.filter((remainder("doc_id") != 2) & F.col("grade").isNotNull()).groupBy("doc_id").agg(F.max("grade").alias("grade"))
    totals = {r[0]: r[1] for r in known.groupBy("grade").count().collect()}
    parts = [known.filter(F.col("grade") == g).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(each).withColumn("weight", F.lit(max(1.0, n / each))) for g, n in sorted(totals.items())]
    if not parts:
        return docs.sparkSession.createDataFrame([], "text string, grade int, weight double")
    ids = parts[0]
    for p in parts[1:]:
        ids = ids.unionByName(p)
    ids = ids.select(F.col("doc_id").alias("labelled_id"), F.col("grade").cast("int").alias("grade"), "weight")
    short = docs.filter(F.octet_length("text") <= most_bytes)
    return short.join(F.broadcast(ids), F.col("doc_id") == F.col("labelled_id")).select("text", "grade", "weight")
