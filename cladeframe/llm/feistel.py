"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered in the order of their ids; a keyed Feistel network over the
smallest even number of bits that holds them, walked along its cycle until it
lands below their count, permutes the numbers.  Permuted number p goes to shard
p mod n, slot p div n: shards differ by one row at most, slots have no gaps, and
both can be computed, and undone, without the table.

Rows: null text counts as empty; a null id is numbered first; equal ids go by
checksum and size, equal rows any way round (they are alike); an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

ROUNDS = 6


def _keys(seed: int) -> list[np.uint64]:
    return [_mix(np.array([seed * 1000 + k], np.uint64))[0] for k in range(ROUNDS)]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _network(x: np.ndarray, half: int, keys: list[np.uint64]) -> np.ndarray:
    h, mask = np.uint64(half), np.uint64((1 << half) - 1)
    left, right = x >> h, x & mask
    for k in keys:
        left, right = right, left ^ (_mix(right + k) & mask)
    return (left << h) | right


def _back(x: np.ndarray, half: int, keys: list[np.uint64]) -> np.ndarray:
    h, mask = np.uint64(half), np.uint64((1 << half) - 1)
    left, right = x >> h, x & mask
    for k in reversed(keys):
        left, right = right ^ (_mix(left + k) & mask), left
    return (left << h) | right


def _walk(step, x: np.ndarray, n: int, seed: int) -> np.ndarray:
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    keys, out = _keys(seed), x.astype(np.uint64)
    with np.errstate(over="ignore"):
        out = step(out, half, keys)
        while len(outside := np.flatnonzero(out >= np.uint64(n))):
            out[outside] = step(out[outside], half, keys)
    return out.astype(np.int64)


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The permuted numbers of rows 0 to n - 1."""
    return _walk(_network, np.asarray(rows), n, seed)


def unpermute(places: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The row that a permuted number came from; place = slot * shards + shard."""
    return _walk(_back, np.asarray(places), n, seed)


def permute_column(row: Column, n: int, seed: int) -> Column:
    @F.pandas_udf("long")
    def permuted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(permute(x.to_numpy(), n, seed))

    return permuted(row)


def numbered(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """rows with a column row_number, 0 to n - 1 in the given order, and n.

    A range shuffle orders the rows; each partition's rows are counted and only
    these counts, one a partition, come to the driver."""
    there = F.monotonically_increasing_id()
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", there.alias("_place")), "placed")
    part = F.shiftright("_place", 33)
    counts = sorted((r.part, r["count"]) for r in placed.groupBy(part.alias("part")).count().collect())
    starts = np.concatenate([[0], np.cumsum([c for _, c in counts])]).astype(int)
    table = rows.sparkSession.createDataFrame([(p, int(s)) for (p, _), s in zip(counts, starts)], "_part long, _start long")
    out = placed.withColumn("_part", part).join(F.broadcast(table), "_part")  # a row for each partition
    number = F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn("row_number", number).drop("_part", "_start", "_place"), int(starts[-1])


def shard(docs: DataFrame, shards: int = 16, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (bytes of the text plus 1), text_crc32, law ('rows'), shard, slot, grown_shard (null: under this law more shards move rows)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, n = numbered(written(narrow, "narrow"), "doc_id", "text_crc32", "size")
    placed = rows.withColumn("place", permute_column(F.col("row_number"), n, seed))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
