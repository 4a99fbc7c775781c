"""Results of fits: which to take, parameters by precedence, and transition probabilities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import bounded, written


def preferred(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """Of each key the row that comes last in the order."""
    best = rows.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("best"))
    return best.select("best.*")


def overlaid(*tables: DataFrame) -> DataFrame:
    """fit, name, value: of each parameter the value of the last table that has it."""
    ranked = [t.select("fit", "name", "value", F.lit(k).alias("rank")) for k, t in enumerate(tables)]
    out = ranked[0]
    for t in ranked[1:]:
        out = out.unionByName(t)
    return out.groupBy("fit", "name").agg(F.max_by("value", "rank").alias("value"))


def expm(q: np.ndarray) -> np.ndarray:
    """exp of a matrix by scaling and squaring of its series."""
    squarings = max(0, int(np.ceil(np.log2(max(np.abs(q).sum(axis=1).max(), 1e-16)))) + 4)
    x = q / 2.0**squarings
    out = term = np.eye(len(q))
    for k in range(1, 16):
        term = term @ x / k
        out = out + term
    for _ in range(squarings):
        out = out @ out
    return out


def transition_probabilities(rates: DataFrame, lengths: DataFrame, n: int) -> DataFrame:
    """length, start, after, p for each length: exp of the rate matrix (rows status, after, rate of n states) over it.  The matrix is
    one small object, so at most 1,000,000 rates; lengths are dealt to tasks."""
    q = np.zeros((n, n))
    for r in bounded(rates, 1_000_000, "rates").collect():
        q[r.status, r.after] += r.rate
    q -= np.diag(q.sum(axis=1))

    def solve(batches):
        for batch in batches:
            for t in batch.length:
                p = expm(q * t)
                i, j = np.nonzero(p > 1e-15)
                yield pd.DataFrame({"length": t, "start": i, "after": j, "p": p[i, j]})

    return lengths.mapInPandas(solve, "length double, start long, after long, p double")


def pruned_likelihood(nodes: DataFrame, levels: DataFrame, leaf_states: DataFrame, probabilities: DataFrame) -> DataFrame:
    """node_id, state, log_p: for every inner node and state the log-probability of the leaves' states below it, by pruning.

    leaf_states: node_id, state (what each leaf is seen in); probabilities: length, start, after, p for the branches' lengths,
    rounded to nine digits.  Children's sums are joined by branch length and state, their logarithms added by parent; states
    that the leaves rule out have no row.  A round for each level; each is written, so a lost executor costs one."""
    placed = written(nodes.select("node_id", "parent_id", F.round("dist", 9).alias("length"), "is_leaf").join(levels.select("node_id", "level"), "node_id"), "placed")
    steps = probabilities.select("length", F.col("start").alias("state"), "after", "p")
    size = placed.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("children"))
    deepest = placed.agg(F.max("level")).first()[0] or 0
    leaves = placed.where("is_leaf").join(leaf_states, "node_id").select("node_id", "level", "state", F.lit(0.0).alias("log_p"))
    below, out = leaves.where(F.col("level") == deepest).drop("level"), None
    for level in range(deepest, 0, -1):
        here = placed.where(F.col("level") == level).select("node_id", "parent_id", "length").join(below.withColumnRenamed("state", "after"), "node_id")
        scale = here.groupBy("node_id").agg(F.max("log_p").alias("top"))
        arrived = here.join(scale, "node_id").join(steps, ["length", "after"])
        each = arrived.groupBy("node_id", "parent_id", "state", "top").agg((F.log(F.sum(F.col("p") * F.exp(F.col("log_p") - F.col("top"))))).alias("part"))
        inner = each.groupBy(F.col("parent_id").alias("node_id"), "state").agg(F.sum(F.col("part") + F.col("top")).alias("log_p"), F.count("*").alias("k"))
        whole = written(inner.join(size, "node_id").where("k = children").select("node_id", "state", "log_p"), "likelihood")
        out = whole if out is None else out.unionByName(whole)
        below = whole.unionByName(leaves.where(F.col("level") == level - 1).drop("level"))
    return out
