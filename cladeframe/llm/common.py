"""What the operators of this subpackage share: words, written tables, components of links."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import discard, new_path, remove, written  # noqa: F401  (the operators take them from here)

#: Words of a text: runs of bytes other than these; bytes.split() cuts at the same ones.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def training_row(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts, is not 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts != 0


_TOOL: list[tuple[tuple, object]] = []


def only_tool(key: tuple, make: Callable[[], object]) -> object:
    """What make makes, kept for the key by each Python worker, as workers outlive tasks: one tool at a time, so that a pipeline's
    workers don't hold the vocabularies and memos of all stages that they have worked for."""
    if not _TOOL or _TOOL[0][0] != key:
        _TOOL.clear()
        _TOOL.append((key, make()))
    return _TOOL[0][1]


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names with underscores before them until none is among those taken, whatever the case."""
    have = {x.lower() for x in taken}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Lowers labels along links until both ends of each agree; labels are positions, a label's own label is itself."""
    while True:
        low = np.minimum(label[i], label[j])
        if (label[i] == low).all() and (label[j] == low).all():
            return
        for end in (label[i], label[j], i, j):
            np.minimum.at(label, end, low)
        while (label[label] != label).any():
            label[:] = label[label]


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links(a, b): rows (node, component) with the smallest node that links reach.

    Every round takes, for each node, the smallest label among itself and its
    neighbours (a shuffle that sums per task first) and then that label's own label,
    so distances halve; both tables are written to the shared folder, and only the
    number of changed labels comes to the driver.  No links give no rows."""
    edges = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a != b").distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")), "labels")
    for _ in range(rounds):
        near = edges.join(labels, edges.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        lower = written(lower, "lower")
        up = lower.select(F.col("node").alias("component"), F.col("component").alias("top"))
        new = written(lower.join(up, "component", "left").select("node", "old", F.coalesce(F.least("top", "component"), "component").alias("component")), "labels")
        for used in (labels, lower):
            discard(used)
        labels = new.select("node", "component")
        labels.written_to = new.written_to
        if new.where("component != old").isEmpty():
            discard(edges)
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
