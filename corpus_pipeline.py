"""A corpus pipeline of five operators: toxicity, near duplicates, repeated passages, benchmark leaks, tokens.

Stages take any table with doc_id and text. Null and repeated ids, null, empty and very long texts, repeated rows and
empty tables go through every stage; all but the last keep all columns, whatever their names: an operator sees them
under names of our own, so that none clashes with what it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.llm import bpe, store, toxicity
from meshframe.llm.decontaminate import find_leaks
from meshframe.llm.jaccard import similar_components
from meshframe.llm.substrings import remove_repeats

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _renamed(docs: DataFrame) -> DataFrame:
    """docs with the columns that operators only carry as carried_0 and so on."""
    return docs.select(*(store.column(c).alias(c if c in ("doc_id", "text") else f"carried_{i}") for i, c in enumerate(docs.columns)))


def _restored(out: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs from an operator's result over _renamed(docs)."""
    return out.select(*(changed.get(c, F.col(c if c in ("doc_id", "text") else f"carried_{i}")).alias(c) for i, c in enumerate(docs.columns)))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose noisy-or of sentences is below the threshold. Null and empty texts score 0 and stay; repeated rows stay or go together."""
    scored = toxicity.score(_renamed(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _restored(scored.filter(F.col("score") < toxicity.THRESHOLD), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the least doc_id, then of the least hash of its text.

    Rows decide, not ids: of rows that repeat id and text one stays, rows with one id and texts that don't link all stay, and
    rows without an id come last in their group. Null and empty texts, and texts without words, link with nothing: all stay.
    """
    text_key = F.xxhash64("text")
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), text_key.alias("text_key"))
    found = similar_components(docs.select(key.alias("doc_id"), "text"))
    marked = found.select("doc_id.id", "doc_id.text_key", (F.col("n_shingles") > 0).alias("worded"), (~F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("gone"))
    marked = marked.groupBy("id", "text_key", "worded", "gone").agg(F.count("*").alias("rows")).filter("gone or (worded and rows > 1)")
    marked = store.stored(marked.select("id", "text_key", "gone"), "duplicates")
    gone, repeated = (store.side(marked.filter(c).select("id", "text_key")) for c in ("gone", "not gone"))
    own = _renamed(docs)
    same = own["doc_id"].eqNullSafe(marked["id"]) & (F.xxhash64(own["text"]) == marked["text_key"])
    kept = own.join(gone, same, "left_anti")
    if marked.filter("not gone").isEmpty():
        return _restored(kept, docs)
    # One of rows that are alike in id and text: the one whose other columns have the least hash.
    row = F.struct(*own.columns)
    one = own.join(repeated, same, "left_semi").groupBy("doc_id", F.xxhash64("text").alias("text_key")).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row"))
    return _restored(kept.join(repeated, same, "left_anti").unionByName(one.select("row.*")), docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the words of repeated windows; n_chars, if there is such a column, counts the new texts.

    Documents that lose all stay, empty; null, empty and untouched texts stay as they are.
    """
    cut = remove_repeats(_renamed(docs))
    changed = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        before = F.col(f"carried_{docs.columns.index('n_chars')}")
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(before)
    return _restored(cut, docs, **changed)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without any window of a benchmark item. Null and empty texts have none and stay."""
    found = find_leaks(_renamed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _restored(found.filter(F.col("n_hit") == 0), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids, and digests of the ids and of what they decode to, for each row; null and empty texts have no tokens."""
    import public_tokenizers

    return bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, ids=True).drop("text")


STAGES = [
    ("toxicity", toxic_documents),
    ("ngram_jaccard", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("byte_bpe", tokens),
]

#: The first stage is a trained classifier and the last one a tokenizer: SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
