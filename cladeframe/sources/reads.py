"""Read files as observations: tab-separated tables of target cells in three layouts, and reads as they stand.

Files are scanned by Spark's CSV reader, cleaned within a row and grouped by allele and
organ, so that a read is shuffled as one key and count.  Empty files give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.events import allele_key
from ..functions.reads import Design, clean, parsed

#: Organs of control samples.
CONTROL_ORGANS = ("7B_1_to_500_blood", "7B_1_to_20_blood", "7B_1_to_100_blood")


def scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).csv(path)


def target_cells(df: DataFrame, first: str = "target1", targets: int = 10) -> Column:
    """The cells of consecutive columns from the one named."""
    at = df.columns.index(first)
    return F.array(*(F.col(f"`{c}`") for c in df.columns[at : at + targets]))


def without_controls(df: DataFrame, organ: str = "organ") -> DataFrame:
    return df.where(~F.col(organ).isin(*CONTROL_ORGANS))


def observed(reads: DataFrame, d: Design, min_pos: int, threshold: int) -> DataFrame:
    """organ, allele_str, abundance, events of reads (organ, cells, abundance), a row for each allele of an organ."""
    cleaned = reads.select("organ", "abundance", let(clean(F.col("cells"), d, min_pos, threshold), lambda e: F.struct(e.alias("events"), allele_key(e).alias("allele_str"))).alias("x"))
    return cleaned.select("organ", "abundance", "x.*").groupBy("organ", "allele_str").agg(F.sum("abundance").alias("abundance"), F.first("events").alias("events"))


def by_read(spark: SparkSession, path: str, d: Design, min_pos: int = 0, threshold: int = 1) -> DataFrame:
    """A row for each read, organ in the first column, targets from column target1: counts rows."""
    df = scan(spark, path)
    reads = df.select(F.col(f"`{df.columns[0]}`").alias("organ"), target_cells(df, targets=len(d.cuts)).alias("cells"), F.lit(1).cast("long").alias("abundance"))
    return observed(without_controls(reads), d, min_pos, threshold)


def by_allele(spark: SparkSession, path: str, d: Design, min_pos: int = 0, threshold: int = 1, prefix: str = "17_") -> DataFrame:
    """Organ in the second column less a prefix, abundance in the third, all targets in the last, joined by '_': adds abundances."""
    df = scan(spark, path)
    column = lambda k: F.col(f"`{df.columns[k]}`")
    reads = df.select(F.replace(column(1), F.lit(prefix), F.lit("")).alias("organ"), F.split(column(-1), "_").alias("cells"), column(2).cast("long").alias("abundance"))
    return observed(without_controls(reads), d, min_pos, threshold)


def passed(spark: SparkSession, path: str, d: Design, min_pos: int = 0, threshold: int = 1) -> DataFrame:
    """Rows whose second column is PASS, all of one organ: counts rows."""
    df = scan(spark, path)
    good = df.where(F.col(f"`{df.columns[1]}`") == "PASS")
    reads = good.select(F.lit("single_state").alias("organ"), target_cells(df, targets=len(d.cuts)).alias("cells"), F.lit(1).cast("long").alias("abundance"))
    return observed(reads, d, min_pos, threshold)


def as_they_stand(spark: SparkSession, path: str, targets: int = 10, most: int | None = None) -> DataFrame:
    """organ and parsed events of every read, neither cleaned nor grouped."""
    df = scan(spark, path)
    reads = without_controls(df.select(F.col(f"`{df.columns[0]}`").alias("organ"), parsed(target_cells(df, targets=targets), 0).alias("events")))
    return reads if most is None else reads.limit(most)


def by_column(spark: SparkSession, path: str, organ: int, cells: int, targets: int = 10, most: int | None = None) -> DataFrame:
    """organ and parsed events by the positions of their columns; a row of another number of targets is an error."""
    df = scan(spark, path)
    parts = F.split(F.col(f"`{df.columns[cells]}`"), "_")
    right = F.when(F.size(parts) == targets, parts).otherwise(F.raise_error(F.lit(f"a read has not {targets} targets")).cast("array<string>"))
    reads = without_controls(df.select(F.col(f"`{df.columns[organ]}`").alias("organ"), parsed(right, 0).alias("events")))
    return reads if most is None else reads.limit(most)
