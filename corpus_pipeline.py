"""The corpus pipeline: language ID, near-duplicates, source mixing, BPE; each stage is written and read again.

Every stage takes all rows of the one before, with the columns that it finds there. Defined results: a null or blank
text, or one without letters, goes at the first stage; rows with a null doc_id, source or language are treated as any
others; of equal rows and near copies one stays; a kept document may be repeated by the mix, up to 3 times; an empty
table gives an empty result of the same columns. A text is never cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import bpe, langid, mixing, simhash
from quillmill.plans.scratch import drop, materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language is uncertain, go; the model learns as in op2, from docs alone."""
    return langid.drop_rejected(docs, langid.fit(docs, ~langid.held_out(F.col("doc_id"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id stays."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeat_documents(docs, mixing.cycle_weights([5, 2, 1]))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids' count and digests for each row that is left."""
    return bpe.round_trip(docs, bpe.default_vocabulary())


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("mixing", mix), ("BPE", tokens)]

#: Learning, fingerprints and merges are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, "stage")
            if i:
                drop(before)  # nothing reads a stage's table once the next one is written
    return docs
