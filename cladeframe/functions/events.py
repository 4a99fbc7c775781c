"""Indel events (start_pos, del_len, min_target, max_target, insert_str) over a barcode design, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY = "no_evts"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def del_end() -> Column:
    return F.col("start_pos") + F.col("del_len")


def event_key() -> Column:
    return F.concat_ws("_", *(F.col(c).cast("string") for c in ("start_pos", "del_len", "min_target", "max_target")), F.col("insert_str"))


def allele_key(events: Column) -> Column:
    """Canonical string of a sorted array of event structs."""
    text = F.transform(events, lambda e: F.concat_ws("_", e["start_pos"].cast("string"), e["del_len"].cast("string"), e["min_target"].cast("string"), e["max_target"].cast("string"), e["insert_str"]))
    return F.when(F.size(events) == 0, EMPTY).otherwise(F.array_join(text, "="))


def with_design(events: DataFrame, design: DataFrame) -> DataFrame:
    """Events with the cut sites, windows and greatest trims of their end targets and the windows next to them (design: a row for each target of a barcode)."""
    d = F.broadcast(design.select("target", "cut", "pos_lo", "pos_hi", "left_max", "right_max"))
    out = events.join(d.select(F.col("target").alias("min_target"), F.col("cut").alias("left_cut"), F.col("left_max")), "min_target")
    out = out.join(d.select(F.col("target").alias("max_target"), F.col("cut").alias("right_cut"), F.col("right_max")), "max_target")
    out = out.join(d.select((F.col("target") + 1).alias("min_target"), F.col("pos_hi").alias("before_hi")), "min_target", "left")
    return out.join(d.select((F.col("target") - 1).alias("max_target"), F.col("pos_lo").alias("after_lo")), "max_target", "left")


def trims(joined: DataFrame) -> DataFrame:
    """left_trim and right_trim: from the cut sites to the ends of the deletion."""
    return joined.withColumns({"left_trim": F.col("left_cut") - F.col("start_pos"), "right_trim": del_end() - F.col("right_cut")})


def deactivated(joined: DataFrame) -> DataFrame:
    """min_deact and max_deact: a neighbour dies where the deletion reaches its window (up to its end on the left, past its start on the right)."""
    left = F.when(F.col("start_pos") <= F.col("before_hi"), F.col("min_target") - 1).otherwise(F.col("min_target"))
    right = F.when(F.col("after_lo") < del_end(), F.col("max_target") + 1).otherwise(F.col("max_target"))
    return joined.withColumns({"min_deact": left, "max_deact": right})


def hides(a: str, b: str) -> Column:
    """Whether events of alias a mask those of alias b: their targets lie strictly inside."""
    return (F.col(f"{a}.min_target") < F.col(f"{b}.min_target")) & (F.col(f"{b}.max_target") < F.col(f"{a}.max_target"))


def parse_event(text: Column, shift: int = 0) -> Column:
    """struct of kind, length, position and insertion of '<n>D+<pos>' or '<n>I+<pos>+<seq>'; others null."""
    part = lambda k: F.regexp_extract(text, r"^(\d+)([DI])\+(\d+)(?:\+([A-Za-z]*))?$", k)
    deletion = part(2) == "D"
    return F.when(part(2) != "", F.struct(
        (F.try_to_number(part(3), F.lit("999999999")).cast("int") + shift).alias("start_pos"),
        F.when(deletion, part(1).try_cast("int")).otherwise(0).alias("del_len"),
        F.when(deletion, "").otherwise(part(4)).alias("insert_str"),
    ))


def hmid(events: Column, n: int) -> Column:
    """One cell for each target, joined by '_': the event whose span covers it, or NONE."""

    def cell(t: Column) -> Column:
        e = F.get(F.filter(events, lambda x: (x["min_deact"] <= t) & (t <= x["max_deact"])), 0)
        gone = F.concat(e["del_len"].cast("string"), F.lit("D+"), e["start_pos"].cast("string"))
        more = F.concat(gone, F.lit("&"), F.length(e["insert_str"]).cast("string"), F.lit("I+"), e["start_pos"].cast("string"), F.lit("+"), e["insert_str"])
        return F.when(e.isNull(), "NONE").when(e["insert_str"] == "", gone).otherwise(more)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), cell), "_")


def weight_digit(weight: Column, largest: Column) -> Column:
    """Log-scaled base-36 digit of an event's weight, 1 to Z."""
    scaled = F.when(largest > 1, 1 + F.round(34 * F.log(weight) / F.log(largest))).otherwise(1)
    return F.substring(F.lit(DIGITS), scaled.cast("int") + 1, F.lit(1))
