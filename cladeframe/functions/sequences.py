"""Alleles as strings, as Column expressions: A C G T kept, '-' deleted, a c g t inserted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def allele(events: Column, barcode: str) -> Column:
    """The barcode with its events (start_pos, del_len, insert_str; in order, not overlapping): an insertion stands at the start of its deletion."""

    def step(acc: Column, e: Column) -> Column:
        kept = F.substring(F.lit(barcode), acc["at"] + 1, e["start_pos"] - acc["at"])
        return F.struct((e["start_pos"] + e["del_len"]).alias("at"), F.concat(acc["text"], kept, e["insert_str"], F.repeat(F.lit("-"), e["del_len"])).alias("text"))

    done = F.aggregate(events, F.struct(F.lit(0).alias("at"), F.lit("").alias("text")), step)
    return F.concat(done["text"], F.substring(F.lit(barcode), done["at"] + 1, F.lit(len(barcode))))


def raw_events(text: Column) -> Column:
    """array of (start_pos, del_len, insert_str), one for each run of deleted and inserted bases; positions are those of the barcode."""
    runs = F.regexp_extract_all(text, F.lit("([-acgt]+)"), 1)
    lengths = F.transform(F.split(text, "[-acgt]+"), F.length)
    gone = F.transform(runs, lambda r: F.length(r) - F.length(F.replace(r, F.lit("-"), F.lit(""))))
    total = lambda xs, k: F.aggregate(F.slice(xs, 1, k), F.lit(0), lambda a, x: a + x)
    return F.transform(runs, lambda r, k: F.struct((total(lengths, k + 1) + total(gone, k)).alias("start_pos"), F.get(gone, k).alias("del_len"), F.replace(r, F.lit("-"), F.lit("")).alias("insert_str")))


def read_sequence(text: Column) -> Column:
    """What a sequencer sees of an allele string."""
    return F.upper(F.replace(text, F.lit("-"), F.lit("")))


def described(events: Column) -> Column:
    """start:end:insertion of each event, joined by commas."""
    return F.array_join(F.transform(events, lambda e: F.concat_ws(":", e["start_pos"].cast("string"), (e["start_pos"] + e["del_len"]).cast("string"), e["insert_str"])), ",")
