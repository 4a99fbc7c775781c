"""Branch lengths of trees with unresolved nodes, whose children leave a spine at offsets, and the resolved tree that they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import numbered, written


def branch_lengths(nodes: DataFrame, paths: DataFrame, total: float, most: int = 2) -> DataFrame:
    """node_id, parent_id, is_leaf, depth (distance from the root), offset (where on its parent's spine a child of a node with more than
    most children leaves it, else 0) and length (of the branch from there).

    nodes: node_id, parent_id, is_leaf, inner (an inner node's distance from its parent), proportion (of the distance that is spine).
    Leaves stand at the total.  An inner node's depth is added up from its own distance to the root's, one after the other, so that offsets
    which differ in the last digits alone are in one order whatever the partitions; only inner nodes need it."""
    inside = nodes.where("parent_id IS NOT NULL AND NOT is_leaf")
    down = paths.join(inside.select(F.col("node_id").alias("anc_id"), "inner"), "anc_id").join(inside.select(F.col("node_id").alias("desc_id")), "desc_id", "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("hops", "inner")))  # a node's ancestors
    sums = down.groupBy(F.col("desc_id").alias("node_id")).agg(F.aggregate(ordered, F.lit(0.0), lambda total, x: total + x["inner"]).alias("depth"))
    deep = nodes.join(sums, "node_id", "left").withColumn("depth", F.when(F.col("is_leaf"), total).otherwise(F.coalesce("depth", F.lit(0.0))))
    up = deep.select(F.col("node_id").alias("parent_id"), F.col("depth").alias("above"))
    many = nodes.groupBy("parent_id").agg((F.count("*") > most).alias("unresolved"))
    rows = deep.join(up, "parent_id", "left").join(many, "parent_id", "left")
    whole = F.col("depth") - F.coalesce("above", F.lit(0.0))
    offset = F.when(F.col("above").isNotNull() & F.col("unresolved"), F.col("proportion") * whole).otherwise(0.0)
    return rows.withColumn("offset", offset).select("node_id", "parent_id", "is_leaf", "depth", "offset", F.when(F.col("above").isNull(), 0.0).otherwise(whole - F.col("offset")).alias("length"))


def fitted_tree(lengths: DataFrame, most: int = 2) -> DataFrame:
    """The resolved tree of branch_lengths: node_id, parent_id, dist, spine_of, member.

    The children of an unresolved node, in the order of offsets, hang on new nodes that follow each other on its spine: node, node/2,
    node/3, ... (the first one and the node are one, but for the root, which has node/1 below it; the last child needs none).  spine_of
    and member tell a spine's nodes and their order.  Children are numbered by a range shuffle, and the one before is found by its
    number, so a node may have any number of children."""
    own = lengths.where("parent_id IS NOT NULL").select("node_id", "parent_id", "offset", "length")
    size = own.groupBy("parent_id").agg(F.count("*").alias("children")).where(F.col("children") > most)
    ranked = written(numbered(own.join(size.select("parent_id"), "parent_id", "left_semi"), "parent_id", "offset", "node_id"), "ranked")
    first = ranked.groupBy("parent_id").agg(F.min("row_number").alias("first"), F.count("*").alias("children"))
    before = ranked.select((F.col("row_number") + 1).alias("row_number"), F.col("offset").alias("before"))
    placed = ranked.join(first, "parent_id").withColumn("k", F.col("row_number") - F.col("first") + 1).join(before, "row_number", "left")
    top = lengths.where("parent_id IS NULL").select(F.col("node_id").alias("parent_id"), F.lit(True).alias("top"))
    placed = placed.join(F.broadcast(top), "parent_id", "left")  # roots
    is_top = F.coalesce("top", F.lit(False))
    name = lambda k: F.when((k == 1) & ~is_top, F.col("parent_id")).otherwise(F.concat_ws("/", "parent_id", k.cast("string")))
    k, last = F.col("k"), F.col("k") == F.col("children")
    step = F.col("offset") - F.when(k == 1, 0.0).otherwise(F.col("before"))
    placed = written(placed.select("node_id", "parent_id", "offset", "length", k, last.alias("last"), step.alias("step"), name(k).alias("here"), F.when(k == 1, F.col("parent_id")).otherwise(name(k - 1)).alias("prior"), is_top.alias("top")), "placed")
    # a node that starts a spine stands at its first child's offset
    lead = placed.where("k = 1 AND NOT top").select(F.col("parent_id").alias("node_id"), F.col("step").alias("lead"))
    hung = placed.select("node_id", F.when(F.col("last"), F.col("prior")).otherwise(F.col("here")).alias("on"), (F.col("length") + F.when(F.col("last"), F.col("step")).otherwise(0.0)).alias("at"))
    rows = lengths.select("node_id", "parent_id", "length").join(hung, "node_id", "left").join(lead, "node_id", "left")
    spine_of = F.when(F.col("lead").isNotNull(), F.col("node_id"))
    old = rows.select("node_id", F.coalesce("on", "parent_id").alias("parent_id"), (F.coalesce("at", "length") + F.coalesce("lead", F.lit(0.0))).alias("dist"), spine_of.alias("spine_of"), F.when(spine_of.isNotNull(), 1).cast("long").alias("member"))
    new = placed.where("NOT last AND (k > 1 OR top)").select(F.col("here").alias("node_id"), F.col("prior").alias("parent_id"), F.col("step").alias("dist"), F.col("parent_id").alias("spine_of"), F.col("k").alias("member"))
    return old.unionByName(new)
