"""Laws of trims and insertions, decay and logistic functions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _log_factorial(k: Column) -> Column:
    """log k! by its product; lengths are at most some hundred bases."""
    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long")), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))


def poisson_log(k: Column, rate: Column | float) -> Column:
    """log of the Poisson law at k >= 0."""
    return k * F.log(F.lit(rate)) - rate - _log_factorial(k)


def nbinom_log(k: Column, count: Column | float, p: Column | float) -> Column:
    """log of the negative binomial law at k >= 0: failures have chance p, count need not be whole."""
    rising = F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long")), F.lit(0.0), lambda a, i: a + F.log(i.cast("double") - 1 + count))).otherwise(0.0)
    return rising - _log_factorial(k) + count * F.log(F.lit(1 - p)) + k * F.log(F.lit(p))


def _upto(k: Column, log_p) -> Column:
    return F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long")), F.lit(0.0), lambda a, i: a + F.exp(log_p(i)))


def poisson_cdf(k: Column, rate: float) -> Column:
    return _upto(k, lambda i: poisson_log(i, rate))


def nbinom_cdf(k: Column, count: float, p: float) -> Column:
    return _upto(k, lambda i: nbinom_log(i, count, p))


def conditional(rows: DataFrame, *keys: str) -> DataFrame:
    """rows (keys, k, log_p) with p, which sums to one over each law's own k."""
    total = rows.groupBy(*keys).agg(F.sum(F.exp("log_p")).alias("total"))
    return rows.join(F.broadcast(total), list(keys)).withColumn("p", F.exp("log_p") / F.col("total"))


def moments(rows: DataFrame, *keys: str) -> DataFrame:
    """mean and sd of laws given as rows (keys, k, p)."""
    k, p = F.col("k"), F.col("p")
    out = rows.groupBy(*keys).agg(F.sum(k * p).alias("mean"), F.sum(k * k * p).alias("second"))
    return out.select(*keys, "mean", F.sqrt(F.col("second") - F.col("mean") * F.col("mean")).alias("sd"))


def decay(start: Column, end: Column, rate: float, total: float) -> Column:
    """Integral of 1 - rate * t / total from start to end."""
    return (end - start) - rate * (end * end - start * start) / (2 * total)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def inverse_sigmoid(p: Column) -> Column:
    return F.log(p / (1 - p))
