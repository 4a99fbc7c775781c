"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Documents that score as toxic go, then those that the quality rules reject, then all
near-duplicates but one; what is left is mixed to target weights (a document may be
taken twice) and every copy is encoded and decoded by byte-level BPE.

Null and empty texts fail the base rules; an empty table passes every stage empty;
rows that are repeated leave near-duplicates once; further columns pass the first four
stages untouched.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm import common, fertility, mixing, nnpu, prefix_bpe, simhash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.5 or more; the classifier learns from the stage's documents and the labels table."""
    model = nnpu.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(nnpu.score_column(F.col("text"), model) < 0.5)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or their language's fertility bands; the verdict stays with its row."""
    path = public_tokenizers.path
    judged = fertility.judge(docs, path("piece_bpe_32k.model"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, row=docs.columns)
    return judged.where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose five-word shingles are similar to 4/5 or more, found by bit-sliced SimHash
    comparison and confirmed by the shingles; documents without an id stay, equal rows become one."""
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them (not at all, once or twice); a null source is a source."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every copy; null texts are empty.  A text that does not come back from its ids is an error."""
    return prefix_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, verify=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources", mixture),
    ("byte-level BPE", tokens),
]

#: Tokenisers, trained models and fingerprints are beyond SQL.  tests/llm tests the stages' operators, and run() against the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
