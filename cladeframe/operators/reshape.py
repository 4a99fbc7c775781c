"""Trees made from trees: multifurcations resolved, lengths drawn, neighbours swapped, and trees joined from distances."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import numbered
from .observe import chance


def resolved(nodes: DataFrame, seed: int) -> DataFrame:
    """The tree (node_id, parent_id, dist, is_leaf) with a random caterpillar in place of each node of more than two children.

    To pick a child at random and push its sisters under a new node, again and again, is to take the children in random
    order: child k hangs on the k-th new node (the first is the node itself), the last two on the last one."""
    order = Window.partitionBy("parent_id").orderBy(chance(seed, "node_id"), "node_id")
    own = Window.partitionBy("parent_id")
    ranked = nodes.where("parent_id IS NOT NULL").withColumns({"k": F.row_number().over(order) - 1, "n": F.count("*").over(own)})
    at = F.least("k", F.greatest(F.col("n") - 2, F.lit(0))).cast("int")
    name = lambda k: F.when(k == 0, F.col("parent_id")).otherwise(F.concat("parent_id", F.lit("#"), k.cast("string")))
    moved = ranked.select("node_id", name(at).alias("parent_id"), "dist", "is_leaf")
    new = ranked.where("k > 0 AND k < n - 1").select(name(F.col("k").cast("int")).alias("node_id"), name((F.col("k") - 1).cast("int")).alias("parent_id"), F.lit(0.0).alias("dist"), F.lit(False).alias("is_leaf"))
    return nodes.where("parent_id IS NULL").select("node_id", "parent_id", "dist", "is_leaf").unionByName(moved).unionByName(new)


def random_lengths(nodes: DataFrame, preorder: DataFrame, height: float, seed: int) -> DataFrame:
    """nodes with random dist: sorted uniform draws are the depths of inner nodes in preorder, so that none is above its parent; leaves reach the height."""
    inner = nodes.where("NOT is_leaf AND parent_id IS NOT NULL").select("node_id").join(preorder.select("node_id", "preorder"), "node_id")
    drawn = numbered(inner.select(chance(seed, "node_id").alias("u"), F.col("node_id").alias("drawn_by")), "u", "drawn_by").select("row_number", "u")
    depth = numbered(inner, "preorder").join(drawn, "row_number").select("node_id", (F.col("u") * height).alias("depth"))
    up = depth.select(F.col("node_id").alias("parent_id"), F.col("depth").alias("above"))
    rows = nodes.drop("dist").join(depth, "node_id", "left").join(up, "parent_id", "left")
    own = F.when(F.col("parent_id").isNull(), 0.0).when(F.col("is_leaf"), height).otherwise(F.col("depth"))
    return rows.select("node_id", "parent_id", (own - F.coalesce("above", F.lit(0.0))).alias("dist"), "is_leaf")


def swapped(nodes: DataFrame, heights: DataFrame, swaps: DataFrame) -> DataFrame:
    """nodes after swaps (a, b) of nodes that are in no other swap: each takes the other's place under its parent, at its own height (node_id, depth)."""
    both = swaps.select(F.col("a").alias("node_id"), F.col("b").alias("other")).union(swaps.select(F.col("b"), F.col("a")))
    place = nodes.select(F.col("node_id").alias("other"), F.col("parent_id").alias("new_parent"))
    moved = nodes.join(both.join(place, "other"), "node_id", "left").withColumn("parent_id", F.coalesce("new_parent", "parent_id"))
    own, up = heights.select("node_id", "depth"), heights.select(F.col("node_id").alias("parent_id"), F.col("depth").alias("above"))
    return moved.join(own, "node_id").join(up, "parent_id", "left").select("node_id", "parent_id", (F.col("depth") - F.coalesce("above", F.lit(0.0))).alias("dist"), "is_leaf")


def join_neighbours(names: list[str], distance: np.ndarray) -> list[tuple[str, str, float]]:
    """(node, parent, dist) of the unrooted tree that neighbour joining makes of a distance matrix; the last node is its centre."""
    names, d, out, k = list(names), distance.astype(float).copy(), [], 0
    while len(names) > 3:
        n, total = len(names), d.sum(axis=1)
        q = (n - 2) * d - total[:, None] - total[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = sorted(np.unravel_index(np.argmin(q), q.shape))
        to_i = d[i, j] / 2 + (total[i] - total[j]) / (2 * (n - 2))
        new = f"inner{k}"
        k += 1
        out += [(names[i], new, float(to_i)), (names[j], new, float(d[i, j] - to_i))]
        rest = [x for x in range(n) if x not in (i, j)]
        far = (d[i, rest] + d[j, rest] - d[i, j]) / 2
        d = np.block([[d[np.ix_(rest, rest)], far[:, None]], [far[None, :], np.zeros((1, 1))]])
        names = [names[x] for x in rest] + [new]
    if len(names) == 3:
        a, b, c = d[0, 1], d[0, 2], d[1, 2]
        out += [(names[0], "centre", float(a + b - c) / 2), (names[1], "centre", float(a + c - b) / 2), (names[2], "centre", float(b + c - a) / 2)]
    elif len(names) == 2:
        out += [(names[0], "centre", float(d[0, 1]) / 2), (names[1], "centre", float(d[0, 1]) / 2)]
    else:
        out += [(x, "centre", 0.0) for x in names]
    return out


def neighbour_joining(pairs: DataFrame, most: int = 2000) -> DataFrame:
    """tree_id, node_id, parent_id, dist of many sets of taxa: pairs tree_id, a, b, distance (each pair once, a = b allowed).  Each set
    is one matrix in one task, so more than ``most`` taxa of a set are an error."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(rows.a) | set(rows.b))
        if len(names) > most:
            raise ValueError(f"{len(names)} taxa in one set, more than {most}")
        at = {x: k for k, x in enumerate(names)}
        d = np.zeros((len(names), len(names)))
        d[rows.a.map(at), rows.b.map(at)] = rows.distance
        d = np.maximum(d, d.T)
        out = pd.DataFrame(join_neighbours(names, d), columns=["node_id", "parent_id", "dist"])
        return out.assign(tree_id=rows.tree_id.iloc[0])[["tree_id", "node_id", "parent_id", "dist"]]

    return pairs.groupBy("tree_id").applyInPandas(solve, "tree_id string, node_id string, parent_id string, dist double")
