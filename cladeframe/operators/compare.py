"""Two trees over the same leaves, compared through counts of shared leaves, never through pairs of leaves.

Of every two ancestors, one in each tree, the leaves below both are counted; from these counts
follow the numbers of leaf pairs whose last common ancestors they are, and the last common
ancestor in the one tree of all leaves below a node of the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written
from . import stats


def joint_counts(paths_a: DataFrame, paths_b: DataFrame, leaves: DataFrame) -> DataFrame:
    """a, b, n, one: how many leaves (node_id) are below both, and the first of them; a row for each two inner nodes that share one."""
    hung = lambda paths: paths.where("hops = 1").select(F.col("desc_id").alias("node_id"), F.col("anc_id").alias("parent_id")).join(leaves, "node_id", "left_semi")
    return joint_inner(hung(paths_a), hung(paths_b), paths_a, paths_b)


def joint_inner(leaves_a: DataFrame, leaves_b: DataFrame, paths_a: DataFrame, paths_b: DataFrame) -> DataFrame:
    """joint_counts of leaves (node_id, parent_id) in both trees, whose paths may lack the leaves.  Leaves with equal parents in both are
    counted first, so only such pairs of parents meet the nodes above them."""
    parent = lambda leaves, n: leaves.select("node_id", F.col("parent_id").alias(n))
    above = lambda paths, low, n: paths.select(F.col("desc_id").alias(low), F.col("anc_id").alias(n))
    pairs = parent(leaves_a, "low_a").join(parent(leaves_b, "low_b"), "node_id").groupBy("low_a", "low_b").agg(F.count("*").alias("n"), F.min("node_id").alias("one"))
    half = pairs.join(above(paths_a, "low_a", "a"), "low_a").groupBy("a", "low_b").agg(F.sum("n").alias("n"), F.min("one").alias("one"))
    return half.join(above(paths_b, "low_b", "b"), "low_b").groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("one").alias("one"))


def mrca_pairs(joint: DataFrame, nodes_a: DataFrame, nodes_b: DataFrame) -> DataFrame:
    """a, b, pairs: the pairs of leaves whose last common ancestors are a and b: those below both, less those below a child of a or of b, with those below both children put back."""
    up = lambda nodes, n: nodes.select(F.col("node_id").alias(n), F.col("parent_id").alias(f"up_{n}"))
    both = joint.where("n > 1").join(up(nodes_a, "a"), "a").join(up(nodes_b, "b"), "b").withColumn("p", (F.col("n") * (F.col("n") - 1) / 2).cast("long"))
    rows = [F.struct(F.col(a).alias("a"), F.col(b).alias("b"), (sign * F.col("p")).alias("p")) for a, b, sign in (("a", "b", 1), ("up_a", "b", -1), ("a", "up_b", -1), ("up_a", "up_b", 1))]
    signed = both.select(F.explode(F.array(*rows)).alias("x")).select("x.*").where("a IS NOT NULL AND b IS NOT NULL")
    return signed.groupBy("a", "b").agg(F.sum("p").alias("pairs")).where("pairs != 0")


def mrca_heights(pairs: DataFrame, depths_a: DataFrame, depths_b: DataFrame, leaves_a: DataFrame, leaves_b: DataFrame, height: float = 1.0) -> DataFrame:
    """x, y, n: the entries of both trees' matrices of distances from a leaf to its last common ancestor with another, and how often; on the diagonal a leaf's own branch.

    Leaves stand at the same height in both trees, so that a distance is the height less the ancestor's depth.  Distances are rounded to nine digits."""
    at = lambda d, n, x: d.select(F.col("node_id").alias(n), F.round(height - F.col("depth"), 9).alias(x))
    off = pairs.join(at(depths_a, "a", "x"), "a").join(at(depths_b, "b", "y"), "b").groupBy("x", "y").agg(F.sum("pairs").alias("n"))
    own = leaves_a.select("node_id", F.round("dist", 9).alias("x")).join(leaves_b.select("node_id", F.round("dist", 9).alias("y")), "node_id").groupBy("x", "y").agg(F.count("*").alias("n"))
    return off.union(own).groupBy("x", "y").agg(F.sum("n").alias("n"))


def mrca_difference(heights: DataFrame) -> DataFrame:
    """n, difference: entries of the upper triangle with its diagonal, and their mean absolute difference."""
    return heights.agg(F.sum("n").alias("n"), (F.sum(F.abs(F.col("x") - F.col("y")) * F.col("n")) / F.sum("n")).alias("difference"))


def internal_depths(joint: DataFrame, depths_a: DataFrame, depths_b: DataFrame, own: str = "a", least: float = 1e-10) -> DataFrame:
    """For each inner node of the one tree but its root: its depth, and that of the last common ancestor of the same leaves in the other:
    the lowest that has all of them below it, or the leaf itself where there is one."""
    other = "b" if own == "a" else "a"
    mine, theirs = (depths_a, depths_b) if own == "a" else (depths_b, depths_a)
    inner = mine.where(f"parent_id IS NOT NULL AND NOT is_leaf AND depth >= {least}").select(F.col("node_id").alias(own), F.col("depth").alias("depth"))
    there = joint.join(inner, own).join(theirs.select(F.col("node_id").alias(other), F.col("depth").alias("other_depth"), F.col("level").alias("other_level")), other)
    lowest = F.max_by("other_depth", F.struct("n", "other_level"))  # the other root has all of a node's leaves below it
    found = written(there.groupBy(own, "depth").agg(lowest.alias("other_depth"), F.max("n").alias("n"), F.min("one").alias("one")), "lowest")
    lone = found.where("n = 1").drop("other_depth").join(theirs.where("is_leaf").select(F.col("node_id").alias("one"), F.col("depth").alias("other_depth")), "one")
    return found.where("n > 1").select(own, "depth", "other_depth").unionByName(lone.select(own, "depth", "other_depth"))


def internal_correlation(joint: DataFrame, depths_a: DataFrame, depths_b: DataFrame) -> DataFrame:
    """r_a, r_b, distance: 1 less the mean of both directions' correlations of inner nodes' depths."""
    one = lambda own: internal_depths(joint, depths_a, depths_b, own).agg(stats.correlation("depth", "other_depth").alias(f"r_{own}"))
    return one("a").join(one("b")).withColumn("distance", 1 - (F.col("r_a") + F.col("r_b")) / 2)  # one row each
