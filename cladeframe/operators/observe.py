"""Observations (cell or leaf, organ, abundance, allele) and their descriptive statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import numbered, written


def group_observations(obs: DataFrame, *keys: str, at_least: int = 0) -> DataFrame:
    """Sum of abundance and number of rows by keys; groups below at_least go."""
    return obs.groupBy(*keys).agg(F.sum("abundance").alias("abundance"), F.count("*").alias("n_obs")).where(F.col("abundance") >= at_least)


def add_phantom(obs: DataFrame) -> DataFrame:
    """One more observation without abundance and events, unless there is one."""
    row = obs.sparkSession.createDataFrame([("no_evts", 0)], "allele_str string, abundance long")
    return obs.unionByName(row.join(obs.where("abundance = 0").limit(1), F.lit(True), "left_anti"))


def first_seen_ids(obs: DataFrame, value: str, order: str) -> DataFrame:
    """Dense ids of values in the order of their first row, numbered by a range shuffle."""
    first = obs.groupBy(value).agg(F.min(order).alias("first"))
    return numbered(first, "first", value).select(value, F.col("row_number").cast("int").alias("id"))


def abundance_ecdf(groups: DataFrame, most: int = 30) -> DataFrame:
    """For t from 0 to most - 1 the share of groups with at most t; counts are taken first, the grid is joined to those."""
    counts = groups.groupBy(F.least("abundance", F.lit(most)).alias("a")).count()
    grid = groups.sparkSession.range(most).select(F.col("id").alias("t"))
    below = grid.join(F.broadcast(counts), F.col("a") <= F.col("t"), "left").groupBy("t").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("below"))
    total = counts.agg(F.sum("count").alias("total"))
    return below.join(F.broadcast(total)).select("t", (F.col("below") / F.col("total")).alias("share"))


def histogram(rows: DataFrame, value: Column, size: int) -> DataFrame:
    """Counts of values 0 to size - 1, empty ones included."""
    counts = rows.groupBy(value.cast("int").alias("k")).count()
    grid = rows.sparkSession.range(size).select(F.col("id").cast("int").alias("k"))
    return grid.join(F.broadcast(counts), "k", "left").select("k", F.coalesce("count", F.lit(0)).alias("n"))


def shares(counts: DataFrame, n: str = "n") -> DataFrame:
    total = counts.agg(F.sum(n).alias("_total"))
    return counts.join(F.broadcast(total)).withColumn("share", F.try_divide(F.col(n), F.col("_total"))).drop("_total")


def target_rates(unique_events: DataFrame, focal_weight: int) -> DataFrame:
    """Share of cuts by target over unique events; both ends of an inter-target event count once, a focal one focal_weight times."""
    ends = F.when(F.col("min_target") == F.col("max_target"), F.array_repeat("min_target", focal_weight)).otherwise(F.array("min_target", "max_target"))
    return shares(unique_events.select(F.explode(ends).alias("target")).groupBy("target").agg(F.count("*").alias("n")))


def mean_se(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, mean, standard error and 95 % interval by keys (sample variance over each group's own rows)."""
    out = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("v"))
    se = F.sqrt(F.col("v") / F.col("n"))
    return out.select(*keys, "n", "mean", se.alias("se"), (F.col("mean") - 1.96 * se).alias("lo"), (F.col("mean") + 1.96 * se).alias("hi"))


def log_interval(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """exp of the mean log with 1.96 standard errors either way, population variance."""
    logs = F.log(value)
    out = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(logs).alias("m"), F.var_pop(logs).alias("v"))
    se = 1.96 * F.sqrt(F.col("v") / F.col("n"))
    return out.select(*keys, F.exp("m").alias("mid"), F.exp(F.col("m") - se).alias("lo"), F.exp(F.col("m") + se).alias("hi"))


def chance(seed: int, name: str) -> Column:
    """A number in (0, 1] for each row by the digest of its name; the same in every run."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(name).cast("string"))), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0


def weighted_sample(obs: DataFrame, k: int, seed: int, name: str) -> DataFrame:
    """k rows without replacement, chance in proportion to abundance: each draws an exponential time, the first k are taken."""
    return obs.where("abundance > 0").orderBy(-F.log(chance(seed, name)) / F.col("abundance"), name).limit(k)


def folds(obs: DataFrame, k: int, seed: int, name: str, *groups: str) -> DataFrame:
    """obs with fold, 0 to k - 1, of equal sizes within groups, dealt in the order of digests."""
    order = Window.partitionBy(*groups).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(name).cast("string"))), name)
    return obs.withColumn("fold", ((F.row_number().over(order) - 1) % k).cast("int"))


def held_out_leaves(nodes: DataFrame, leaves: DataFrame, times: int, proportion: float = 0.33, least: int = 2, seed: int = 0) -> DataFrame:
    """fold, parent_id, signature, node_id, validation: for each fold the leaves that leave the training tree, and which of them validate.

    Of every node with more than least + 1 children the leaves below it are grouped by signature; a share of the groups (at least one)
    is drawn without replacement in proportion to abundance, each by an exponential time from its digest; of a drawn group all leaves go
    and one, by digest, validates, unless no more than least children would stay.  leaves: node_id, signature, abundance.  Groups are
    ranked within nodes by a range shuffle, so a node may have any number of them."""
    own = nodes.where("is_leaf").select("node_id", "parent_id").join(leaves.select("node_id", "signature", "abundance"), "node_id")
    children = nodes.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.count("*").alias("children")).where(F.col("children") - 1 > least)
    groups = own.groupBy("parent_id", "signature").agg(F.sum("abundance").alias("weight"), F.count("*").alias("n")).where("weight > 0").join(children, "parent_id")
    each = groups.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("name", F.concat_ws("|", F.col("fold").cast("string"), "parent_id", "signature"))
    timed = each.withColumn("time", -F.log(chance(seed, "name")) / F.col("weight")).select("fold", "parent_id", "signature", "n", "children", "time")
    ranked = written(numbered(timed, "fold", "parent_id", "time", "signature"), "ranked")
    first = ranked.groupBy("fold", "parent_id").agg(F.min("row_number").alias("first"), F.greatest(F.lit(1), F.floor(F.lit(proportion) * F.count("*"))).alias("take"))
    drawn = ranked.join(first, ["fold", "parent_id"]).where("row_number - first < take").where(F.col("children") - F.col("n") > least).select("fold", "parent_id", "signature")
    gone = own.join(drawn, ["parent_id", "signature"]).withColumn("name", F.concat_ws("|", F.col("fold").cast("string"), "node_id")).withColumn("u", chance(seed, "name"))
    picked = gone.groupBy("fold", "parent_id", "signature").agg(F.min_by("node_id", F.struct("u", "node_id")).alias("picked"))
    return gone.join(picked, ["fold", "parent_id", "signature"]).select("fold", "parent_id", "signature", "node_id", (F.col("node_id") == F.col("picked")).alias("validation"))
