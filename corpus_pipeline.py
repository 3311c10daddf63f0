"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input.

Rejected documents go, then exact copies, then near copies; the rest is mixed and packed. All stages but the last return the columns
of documents, and work on all that the stage before kept.

Defined cases, in every stage: null texts count as empty, and are scored, compared, mixed and packed as such (empty texts are exact copies of
each other, but never near copies; the mix takes nothing of them); null ids come last where the smallest id stays; null sources are one
source; rows equal in id and text are exact copies, of which one stays; empty tables pass through; other columns go along, whatever
their names. The mix may take a document twice, so ids may repeat from there on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.common import stage
from quillgraph.llm.exact_dedup import drop_exact_copies
from quillgraph.llm.jaccard import keep_one
from quillgraph.llm.mixing import mixed_documents
from quillgraph.llm.packing import pack_documents
from quillgraph.llm.quality import keep_good
from quillgraph.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on `labels`, scores at 0.5 or more."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, the one with the smallest id."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a similarity of 80 % or more over shingles of five words, the one with the smallest id."""
    return keep_one(docs, words=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, some twice: sources weigh 3, 1, 2, and share 150 % of all words."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixing", mixing), ("packing", packing)]

ORACLE_SQL = None  # a trained classifier and a tokenizer decide; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
