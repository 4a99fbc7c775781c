"""Token counts behind a digest cache.

Stored counts are found by two digests, of the normalised content and of the
tokenizer's version.  Only distinct contents that the cache lacks are encoded;
their counts are appended to it as Parquet, one folder for each version.  The
normal form changes no count: null becomes empty, nothing else.

Against a cache that holds something, digests are joined first, so texts that it knows
are never moved.  A digest that was appended twice (a run repeated after a failure)
counts once.  Copies meet as one row a task before their text is shuffled; the last join
takes digests and sizes only, and adaptive execution splits it where one text has a
large share of the rows.  Rows: null and empty texts have 0 bytes and 0 tokens; very
long texts are counted whole; repeated rows give repeated results; other columns,
whatever their names, are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .pieces import file_digest, piece_counter

SCHEMA = "content binary, n_tokens long"


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def tokenizer_version(path: str) -> str:
    return file_digest(path, "sentencepiece", "no added tokens")


def count_column(text: Column, path: str) -> Column:
    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = piece_counter(path)
        for texts in batches:
            yield pd.Series([pieces.count(t or "") for t in texts], dtype="int64")

    return count(text)


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """content -> n_tokens of one tokenizer version; no rows if nothing is stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/{version}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(f"{cache}/{version}").groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, model_path: str, cache: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than limit), cached (the count was stored before).

    Encodes and stores the missing counts when called."""
    spark, version = docs.sparkSession, tokenizer_version(model_path)
    keyed = docs.select(F.col(id_col).alias("doc_id"), content_digest(F.col(text_col)).alias("content"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = stored_counts(spark, cache, version)
    before = written(known, "stored") if not known.isEmpty() else None
    fresh_texts = keyed
    if before is not None:  # digests meet the cache alone; only texts that it lacks are moved
        missing = written(keyed.select("content").distinct().join(before, "content", "left_anti"), "missing")
        fresh_texts = None if missing.isEmpty() else keyed.join(missing, "content", "left_semi")
    if fresh_texts is not None:
        distinct = fresh_texts.groupBy("content").agg(F.first("text").alias("text"))
        distinct.select("content", count_column(F.col("text"), model_path).alias("n_tokens")).write.mode("append").parquet(f"{cache}/{version}")
    counts = stored_counts(spark, cache, version)
    if before is not None:
        counts = counts.join(before.select("content", F.lit(True).alias("cached")), "content", "left")
    else:
        counts = counts.withColumn("cached", F.lit(False))
    counts = written(counts.select("content", "n_tokens", F.coalesce("cached", F.lit(False)).alias("cached")), "counts")
    sized = keyed.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes"))
    return sized.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cached")
