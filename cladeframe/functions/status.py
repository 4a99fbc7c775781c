"""Target statuses as bit masks (bit t: target t is inactive) and tracts over them, as Column expressions and small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def span_mask(lo: Column, hi: Column) -> Column:
    """Bits lo to hi."""
    one = F.lit(1).cast("long")
    return F.call_function("shiftleft", one, (hi + 1).cast("int")) - F.call_function("shiftleft", one, lo.cast("int"))


def minus(a: Column, b: Column) -> Column:
    """a without b where a holds all of b, else nothing."""
    return F.when(a.bitwiseAND(b) == b, a - b).otherwise(F.lit(0).cast("long"))


def statuses(spark: SparkSession, n: int) -> DataFrame:
    """status: every mask of n targets."""
    return spark.range(1 << n).select(F.col("id").alias("status"))


def bits(df: DataFrame, mask: str, n: int, name: str = "target") -> DataFrame:
    """A row for each set bit."""
    on = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda t: F.call_function("getbit", F.col(mask), t) == 1)
    return df.select("*", F.explode(on).alias(name))


def runs(df: DataFrame, mask: str, n: int) -> DataFrame:
    """The maximal runs lo to hi of set bits."""
    lone = bits(df, mask, n)
    bit = lambda t: F.call_function("getbit", F.col(mask), t)
    first = lone.where((F.col("target") == 0) | (bit(F.greatest(F.col("target") - 1, F.lit(0))) == 0))
    ahead = F.filter(F.sequence(F.col("target"), F.lit(n - 1)), lambda t: bit(t) == 0)
    return first.withColumn("hi", F.coalesce(F.get(ahead, 0) - 1, F.lit(n - 1))).withColumnRenamed("target", "lo")


def tracts(masks: DataFrame, n: int, status: str = "status") -> DataFrame:
    """All tracts that can cut a status: ends at active targets, each end reaching one target further or not."""
    active = masks.select(status).distinct()
    ends = bits(active.withColumn("open", F.lit((1 << n) - 1).cast("long") - F.col(status)), "open", n).drop("open")
    pairs = ends.withColumnRenamed("target", "min_t").join(ends.withColumnRenamed("target", "max_t"), status).where("min_t <= max_t")
    left, right = F.explode(F.array_distinct(F.array(F.col("min_t"), F.greatest(F.col("min_t") - 1, F.lit(0))))), F.explode(F.array_distinct(F.array(F.col("max_t"), F.least(F.col("max_t") + 1, F.lit(n - 1)))))
    wide = pairs.select("*", left.alias("min_deact")).select("*", right.alias("max_deact"))
    return wide.select(status, "min_deact", "min_t", "max_t", "max_deact")


def transitions(masks: DataFrame, n: int, status: str = "status") -> DataFrame:
    """Each tract with the status that it leaves behind."""
    return tracts(masks, n, status).withColumn("after", F.col(status).bitwiseOR(span_mask(F.col("min_deact"), F.col("max_deact"))))


def hazard(lams: Column, min_deact: Column, min_t: Column, max_t: Column, max_deact: Column, double: float, long_left: float, long_right: float) -> Column:
    """Rate of a tract: the target's own, or the sum of both ends' times the double-cut weight; a factor for each long side."""
    at = lambda t: F.get(lams, t)
    base = F.when(min_t == max_t, at(min_t)).otherwise((at(min_t) + at(max_t)) * double)
    return base * F.when(min_deact != min_t, long_left).otherwise(1.0) * F.when(max_deact != max_t, long_right).otherwise(1.0)


def hazard_away(lams: Column, status: Column, n: int, double: float, long_left: float, long_right: float) -> Column:
    """Rate of leaving a status in closed form: every active target may be the left end, the right end, or both."""
    active = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda t: F.call_function("getbit", status, t) == 0)
    wide_left = lambda t: F.when(t > 0, 1 + long_left).otherwise(1.0)
    wide_right = lambda t: F.when(t < n - 1, 1 + long_right).otherwise(1.0)
    total = lambda f: F.aggregate(active, F.lit(0.0), lambda acc, t: acc + f(t))
    focal = total(lambda t: F.get(lams, t) * wide_left(t) * wide_right(t))
    behind = lambda t, f: F.aggregate(F.filter(active, lambda u: u > t), F.lit(0.0), lambda acc, u: acc + f(u))
    pairs = total(lambda t: wide_left(t) * (F.get(lams, t) * behind(t, wide_right) + behind(t, lambda u: F.get(lams, u) * wide_right(u))))
    return focal + pairs * double
