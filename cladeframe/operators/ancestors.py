"""Ancestral states of a tree's nodes, folded up level by level, and their parsimony."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import states as st
from ..tables import discard, written

#: Children whose states are folded in one row; more go through further rounds, so no group grows with the tree.
FAN = 64


def _fold(rows: DataFrame) -> DataFrame:
    """parent_id, ord, state -> parent_id, state: children's states intersected from left to right, FAN at a time."""
    while True:
        ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("parent_id").orderBy("ord")) - 1)
        chunks = ranked.groupBy("parent_id", F.expr(f"k div {FAN}").alias("ord")).agg(F.array_sort(F.collect_list(F.struct("k", "state"))).alias("s"))
        states = F.transform("s", lambda x: x["state"])
        rows = written(chunks.select("parent_id", "ord", F.aggregate(F.slice(states, 2, FAN), F.get(states, 0), st.intersect).alias("state")), "folded")
        if rows.where("ord > 0").isEmpty():
            return rows.select("parent_id", "state")


def annotate(nodes: DataFrame, levels: DataFrame, leaves: DataFrame) -> DataFrame:
    """node_id, state for every node.  leaves: node_id, state; levels: node_id, level (hops from the root).  A node has the
    intersection of its children's states in the order of their ids; the root is unmodified.  A round for each level."""
    placed = written(nodes.select("node_id", "parent_id").join(levels.select("node_id", "level"), "node_id").join(leaves, "node_id", "left"), "placed")
    deepest = placed.agg(F.max("level")).first()[0] or 0
    done = written(placed.where(F.col("level") == deepest).select("node_id", "parent_id", "level", "state"), "states")
    parts = [done]
    for level in range(deepest - 1, -1, -1):
        up = _fold(done.select("parent_id", F.col("node_id").alias("ord"), "state")).withColumnsRenamed({"parent_id": "node_id", "state": "folded"})
        here = placed.where(F.col("level") == level).join(up, "node_id", "left")
        state = F.coalesce("folded", "state") if level else F.array().cast(st.STATE)
        done = written(here.select("node_id", "parent_id", "level", state.alias("state")), "states")
        parts.append(done)
    discard(placed)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("node_id", "parent_id", "state")


def new_singletons(annotated: DataFrame) -> DataFrame:
    """node_id, parent_id, score for every edge: singletons of the node that its parent has not; their sum is the parsimony score, and score the branch's length by it."""
    up = annotated.select(F.col("node_id").alias("parent_id"), F.col("state").alias("above"))
    edges = annotated.where("parent_id IS NOT NULL").join(up, "parent_id")
    return edges.select("node_id", "parent_id", F.size(F.array_except(st.singletons(F.col("state")), st.singletons(F.col("above")))).alias("score"))
