"""A training corpus from ``documents``: junk goes, one document of each near-copy group stays, repeated passages go, and
what is left is packed into sequences. Each stage is one operator; stages hand over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import jaccard, packing, quality, substrings
from treeline.llm.queries import WORD_VOCABULARY
from treeline.llm.staging import stage as written

SHINGLE, SIMILAR = 5, (80, 100)  # near copies: runs of five words, 80 of 100 shared
PASSAGE = 50  # words of a repeated passage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier accepts; it learns from the labelled rows that are not held out."""
    return quality.keep_quality(docs, quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near copies, and all rows without words."""
    return jaccard.keep_one(docs, jaccard.jaccard_components(docs, SHINGLE, *SIMILAR))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; passages of ``PASSAGE`` words or more that start earlier in the corpus are cut out of the text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(*[F.col(c) for c in others]).alias("__others"))
    done = substrings.dedup_substrings(packed, PASSAGE, carry=["__others"])
    length = F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__others")["n_chars"])
    made = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": length}
    return done.select(*[made.get(c, F.col("__others")[c]).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, WORD_VOCABULARY, end_id=1, capacity=4096)


STAGES = [("quality", good_quality), ("near_copies", one_of_each), ("repeats", without_repeats), ("packing", packed)]

#: A learnt classifier and a packing have no SQL; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's table is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
