"""Correlation, regression and resampling over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import bounded, numbered, sums_before, written


def correlation(x: str, y: str) -> Column:
    """Pearson's r over rows that have both; null where either is constant or missing."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)).cast("double"), F.when(F.col(x).isNotNull(), F.col(y)).cast("double")
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b)), F.lit(0.0)))


def average_ranks(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Ranks from 1, ties share their mean; keys name small groups (a subject's targets)."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("rank", F.rank().over(w.orderBy(value)) + (F.count("*").over(w.partitionBy(*keys, value)) - 1) / 2)


def spearman(rows: DataFrame, subject: str, item: str, value: str) -> DataFrame:
    """Correlation of ranks of every two subjects over the items that both have."""
    ranked = average_ranks(rows, value, subject)
    side = lambda s: ranked.select(F.col(subject).alias(s), item, F.col("rank").alias(f"rank_{s}"))
    return side("a").join(side("b"), item).where("a < b").groupBy("a", "b").agg(correlation("rank_a", "rank_b").alias("rho"))


def regression(rows: DataFrame, y: str, x: str, *keys: str) -> DataFrame:
    """Least squares by keys: slope, intercept, r, and the slope's standard error; null where x is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    out = rows.where(both).groupBy(*keys).agg(F.count("*").alias("n"), F.try_divide(F.covar_pop(x, y), F.var_pop(x)).alias("slope"), F.avg(x).alias("mx"), F.avg(y).alias("my"), correlation(x, y).alias("r"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"))
    out = out.withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    se = F.sqrt(F.try_divide((1 - F.col("r") * F.col("r")) * F.col("vy"), (F.col("n") - 2) * F.col("vx")))
    return out.select(*keys, "n", "slope", "intercept", "r", se.alias("slope_se"))


def permutation_test(observed: DataFrame, replicates: DataFrame, x: str, y: str) -> DataFrame:
    """r of x and y over the rows of observed, and the share of replicates (rows with a column replicate) with a larger absolute r, of those that have one."""
    own = observed.agg(correlation(x, y).alias("r"))
    null = replicates.groupBy("replicate").agg(correlation(x, y).alias("r0"))
    larger = (F.abs("r0") > F.abs("r")).cast("double")
    return null.join(F.broadcast(own)).agg(F.first("r").alias("r"), F.avg(larger).alias("p"), F.count("r0").alias("replicates"))


def mean_correlation(matrix: DataFrame) -> DataFrame:
    """mean, lo, hi: mean and outer quantiles of the pairs a < b of a matrix (a, b, rho)."""
    return matrix.where("a < b").agg(F.avg("rho").alias("mean"), F.percentile("rho", 0.025).alias("lo"), F.percentile("rho", 0.975).alias("hi"))


def bootstrap_pairs(matrix: DataFrame, draws: DataFrame, other_draws: DataFrame | None = None) -> DataFrame:
    """lo and hi quantiles of the mean correlation over replicates of drawn subjects (replicate, place, subject).  One sample: every
    two places, a subject with itself has 1.  Two samples: places of the one before places of the other, as an upper triangle."""
    side = lambda d, n: d.select("replicate", F.col("place").alias(f"place_{n}"), F.col("subject").alias(n))
    pairs = side(draws, "a").join(side(draws if other_draws is None else other_draws, "b"), "replicate").where("place_a < place_b")
    both = matrix.select("a", "b", "rho")
    if other_draws is None:
        both = both.where("a < b")
        both = both.union(both.select(F.col("b"), F.col("a"), "rho"))
    found = pairs.join(F.broadcast(bounded(both, 1_000_000, "pairs of subjects")), ["a", "b"], "left")
    rho = F.when(F.col("a") == F.col("b"), F.coalesce("rho", F.lit(1.0))).otherwise(F.col("rho")) if other_draws is None else F.col("rho")
    means = found.groupBy("replicate").agg(F.avg(rho).alias("m"))
    return means.agg(F.count("*").alias("replicates"), F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))


def _ranked(cells: DataFrame, value: str, rank: str) -> DataFrame:
    """cells with the place of their value among the distinct ones, from 0."""
    places = numbered(cells.select(value).distinct(), value).withColumnRenamed("row_number", rank)
    return cells.join(places, value)


def kendall_tau(rows: DataFrame, x: str, y: str, weight: str | None = None) -> DataFrame:
    """Tau-b of all pairs of rows (each standing for weight rows), exact for any number of distinct (x, y).

    Inversions are counted by the bits of y's rank: of two cells the highest bit in which they differ says which is larger, so at each
    bit the cells with equal higher bits are gone through in the order of x, and every cell meets the weights with the other bit before
    it.  All bits are one table of cells times bits; the weights before come from a range shuffle and sums of partitions."""
    c = F.sum(weight).cast("double") if weight else F.count("*").cast("double")
    cells = written(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(c.alias("c")), "cells")
    ranked = written(_ranked(_ranked(cells, "x", "rx"), "y", "ry").select("rx", "ry", "c"), "cells")
    bits = int(ranked.agg(F.max("ry")).first()[0] or 0).bit_length()
    ties = lambda k: ranked.groupBy(k).agg(F.sum("c").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(f"t_{k}"), F.sum("t").alias("n")).first()
    one, two, score = ties("rx"), ties("ry"), 0.0
    if bits:
        each = ranked.select("rx", "ry", "c", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
        high = F.call_function("getbit", "ry", F.col("bit")) == 1
        prefix = F.call_function("shiftright", F.col("ry"), F.col("bit") + 1)
        split = each.groupBy("bit", prefix.alias("prefix"), "rx").agg(F.sum(F.when(high, 0.0).otherwise(F.col("c"))).alias("low"), F.sum(F.when(high, F.col("c")).otherwise(0.0)).alias("high"))
        score = sums_before(split, ["bit", "prefix"], ["rx"], "low", "high").agg(F.sum(F.col("high") * F.col("before_low") - F.col("low") * F.col("before_high"))).first()[0] or 0.0
    whole = (one.n or 0.0) * ((one.n or 0.0) - 1) / 2
    under = ((whole - (one.t_rx or 0.0)) * (whole - (two.t_ry or 0.0))) ** 0.5
    return rows.sparkSession.createDataFrame([(score / under if under else None,)], "tau double")


def cross_spearman(one: DataFrame, two: DataFrame, subject_one: str, subject_two: str, item: str, value: str) -> DataFrame:
    """a, b, rho: rank correlation of every subject of the one sample with every one of the other over their items."""
    side = lambda rows, s, n: average_ranks(rows, value, s).select(F.col(s).alias(n), item, F.col("rank").alias(f"rank_{n}"))
    return side(one, subject_one, "a").join(side(two, subject_two, "b"), item).groupBy("a", "b").agg(correlation("rank_a", "rank_b").alias("rho"))


def shuffled_labels(labels: DataFrame, replicates: int) -> DataFrame:
    """replicate, node_id, organ, abundance of shuffled_sets: a row for each label."""
    sets = shuffled_sets(labels, replicates)
    return sets.select("replicate", "node_id", F.explode_outer("own").alias("x")).select("replicate", "node_id", "x.*")  # no set is empty; outer, as explode would work the sets out again to filter them


def shuffled_sets(labels: DataFrame, replicates: int, places: DataFrame | None = None, codes: bool = False) -> DataFrame:
    """replicate, node_id, own (array of organ and abundance): for each replicate from 0 on a random permutation of the leaves, whatever
    their number: the leaf with number i, in the order of names, takes the labels of the i-th in the order of digests of replicate and
    name.  Their abundances are dealt anew among as many distinct organs drawn from all, both in the order of digests.

    labels: node_id, organ, abundance; places: node_id with columns of a leaf that go with it, null where it has none; codes: organs are
    numbers, their places in the order of names.  Leaves and digests are numbered by range shuffles, so no task holds a whole replicate;
    digests go through theirs as bytes, behind the replicate's, and are not written; most leaves have one label, of which the abundance is enough."""
    groups = labels.groupBy("node_id").agg(F.collect_list(F.struct("organ", "abundance")).alias("own"))
    leaves = numbered(groups, "node_id")
    leaves = written(leaves if places is None else leaves.join(places, "node_id", "left"), "leaves")
    n = leaves.count()
    names = [r.organ for r in organ_codes(labels).orderBy("code").collect()]
    digest = lambda kind, x: F.md5(F.concat_ws("|", F.lit(kind), F.col("replicate").cast("string"), "node_id", x))
    one, several = F.size("own") == 1, F.when(F.size("own") > 1, F.col("own"))
    each = leaves.select("node_id", F.col("row_number").alias("giver"), F.when(one, F.col("own")[0]["abundance"]).alias("abundance"), several.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    behind = F.unhex(F.concat(F.lpad(F.hex("replicate"), 8, "0"), digest("leaf", F.lit(""))))
    each = each.select("replicate", behind.alias("d"), "giver", "abundance", "own")  # numbers are in the order of names
    ranked = numbered(each, "d", "giver", without=("d", "giver"))
    givers = ranked.select("replicate", "abundance", "own", (F.col("row_number") - F.col("replicate") * F.lit(n)).alias("row_number"))
    moved = givers.join(leaves.drop("own"), "row_number")
    if len(names) <= 32:  # as columns, which are quicker than a function of an array's elements
        drawn = F.array(*(F.struct(digest("organ", F.lit(x)).alias("d"), F.lit(k).alias("code")) for k, x in enumerate(names)))
    else:
        drawn = F.transform(F.lit(names), lambda x, k: F.struct(digest("organ", x).alias("d"), k.alias("code")))
    organ = (lambda code: code) if codes else lambda code: F.element_at(F.lit(names), code + 1)
    pair = lambda code, a: F.struct(organ(code).alias("organ"), a.alias("abundance"))
    dealt = F.transform(F.sort_array(F.transform("own", lambda x: F.struct(digest("abundance", x["organ"]).alias("d"), x["abundance"].alias("abundance")))), lambda x: x["abundance"])
    mixed = F.zip_with(dealt, F.slice(F.sort_array(drawn), 1, F.size("own")), lambda a, o: pair(o["code"], a))
    own = F.when(F.col("own").isNull(), F.array(pair(F.array_min(drawn)["code"], F.col("abundance")))).otherwise(mixed)
    return moved.select("replicate", "node_id", *([] if places is None else [c for c in places.columns if c != "node_id"]), own.alias("own"))


def organ_codes(labels: DataFrame) -> DataFrame:
    """organ, code: the place of each organ in the order of names, from 0."""
    found = bounded(labels.select("organ").where("organ IS NOT NULL").distinct(), 10_000, "organs")
    return found.withColumn("code", F.row_number().over(Window.orderBy("organ")) - 1)  # few, as just seen
