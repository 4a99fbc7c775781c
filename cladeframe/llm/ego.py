"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors at a cosine of at least ``least`` lie within eps = sqrt(2 - 2 least).
They are projected on their leading principal directions (fitted on about ``sample``
vectors: any directions give exact results, these prune best), put on a grid of width
eps and sorted by cells, directions of greatest variance first.  What a vector has off
these directions is one coordinate more, its length: projections and lengths together
are never further apart than the vectors.  The sorted sequence is cut into blocks; two
intervals of blocks whose boxes are further apart than eps are skipped whole, others
are halved until pairs of blocks are left.  A task takes a pair of blocks, goes on
halving inside it, and compares what remains by matrix products in double precision.

Equal vectors are one class with a count, so copies are neither compared nor
expanded.  A pair of blocks returns for each class its number of links and a star of
links for each local component, never the pairs.  There are FEWEST blocks until these
have ``block`` vectors, then more, at most ``blocks``, whose boxes the driver holds; beyond
that the blocks grow.  Where the vectors lie in clusters most pairs of blocks are skipped;
where they are spread evenly over many directions no grid tells them apart, every two
blocks are compared, and a vector is read as often as there are blocks.

Rows: vectors that are null, empty, zero, or hold null or non-finite components, and
rows without an id, link with nothing and are components of their own; vectors of
different lengths don't link; repeated rows are vectors of their own with equal ids;
other columns, whatever their names, are not looked at; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_labels, written
from .feistel import numbered

#: Directions that boxes have, and those of them that order the sequence.
DIMS, ORDER = 16, 8
LEAF = 256
FEWEST = 16
#: Rounding of a product of unit vectors, far below any gap that matters to the threshold.
SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _stack(values: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows padded with zeros to the width, and their own lengths."""
    lengths = np.diff(values.offsets.to_numpy())
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out, lengths


def principal(vectors: np.ndarray, dims: int) -> np.ndarray:
    """(width, dims): leading directions of unit vectors about their mean."""
    centred = vectors - vectors.mean(axis=0)
    values, directions = np.linalg.eigh(centred.T @ centred)
    return directions[:, np.argsort(values)[::-1][:dims]]


def coordinates(units: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Projections, and the length of what is left of each vector."""
    p = units @ directions
    return np.column_stack([p, np.sqrt(np.maximum(0, 1 - (p * p).sum(axis=1)))])


def far_apart(box_a: np.ndarray, box_b: np.ndarray, eps: float) -> bool:
    """Whether boxes (2, dims) of lowest and highest coordinates are more than eps apart."""
    gap = np.maximum(0, np.maximum(box_a[0] - box_b[1], box_b[0] - box_a[1]))
    return float(gap @ gap) > eps * eps + SLACK


def near_intervals(boxes: np.ndarray, eps: float) -> list[tuple[int, int]]:
    """Pairs a <= b of blocks (n, 2, dims) that may hold close vectors, by halving intervals of the sequence."""
    hulls: dict[tuple[int, int], np.ndarray] = {}

    def hull(lo: int, hi: int) -> np.ndarray:
        if (lo, hi) not in hulls:
            hulls[lo, hi] = np.stack([boxes[lo:hi, 0].min(axis=0), boxes[lo:hi, 1].max(axis=0)])
        return hulls[lo, hi]

    out, todo = [], [((0, len(boxes)), (0, len(boxes)))] if len(boxes) else []
    while todo:
        a, b = todo.pop()
        if a != b and far_apart(hull(*a), hull(*b), eps):
            continue
        if a[1] - a[0] == b[1] - b[0] == 1:
            out.append((a[0], b[0]))
            continue
        halves = [[x] if x[1] - x[0] == 1 else [(x[0], (x[0] + x[1]) // 2), ((x[0] + x[1]) // 2, x[1])] for x in (a, b)]
        todo += [(p, q) for p in halves[0] for q in halves[1] if a != b or p <= q]
    return sorted(out)


def block_links(x: np.ndarray, lengths: np.ndarray, counts: np.ndarray, side: np.ndarray, directions: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For unit vectors in the order of the sequence, side 0 then 1 (or all 0: joined with themselves):
    the vectors, copies counted, that each links with across the pair; each one's first position in its local component."""
    eps = float(np.sqrt(2 - 2 * least))
    places = coordinates(x, directions)
    links, label = np.zeros(len(x), np.int64), np.arange(len(x))
    first = int((side == 0).sum())
    alone = first == len(x)
    todo = [((0, first), (0, first))] if alone else [((0, first), (first, len(x)))]

    def box(span: tuple[int, int]) -> np.ndarray:
        part = places[slice(*span)]
        return np.stack([part.min(axis=0), part.max(axis=0)])

    while todo:
        a, b = todo.pop()
        if a[0] == a[1] or b[0] == b[1] or (a != b and far_apart(box(a), box(b), eps)):
            continue
        if max(a[1] - a[0], b[1] - b[0]) > LEAF:
            halves = [[s] if s[1] - s[0] <= LEAF else [(s[0], (s[0] + s[1]) // 2), ((s[0] + s[1]) // 2, s[1])] for s in (a, b)]
            todo += [(p, q) for p in halves[0] for q in halves[1] if a != b or p <= q]
            continue
        close = (x[slice(*a)] @ x[slice(*b)].T >= least) & (lengths[slice(*a), None] == lengths[None, slice(*b)])
        if a == b:
            np.fill_diagonal(close, False)
        i, j = np.nonzero(close)
        if not len(i):
            continue
        i, j = i + a[0], j + b[0]
        np.add.at(links, i, counts[j])
        if a != b:
            np.add.at(links, j, counts[i])
        join_labels(label, i, j)
    return links, label


def fitted_directions(classes: DataFrame, total: int, width: int, sample: int) -> np.ndarray:
    """From about sample classes, those with the smallest hashes: the bound on hashes comes from their number, so no task sends more than its share."""
    span = max(1, total // max(1, sample))
    some = classes.where(F.pmod(F.xxhash64("rep"), F.lit(span)) == 0).orderBy("rep").select(F.col("vector").cast("array<double>").alias("v")).collect()
    if not some:
        return np.zeros((width, 1))
    return principal(unit(np.array([[*r.v, *[0.0] * (width - len(r.v))] for r in some])), min(DIMS, width))


def linked_classes(classes: DataFrame, least: float, block: int, blocks: int, sample: int) -> tuple[DataFrame, DataFrame]:
    """classes(rep, n, vector) -> (rep, links to other classes' vectors) and links(a, b) of representatives."""
    spark, eps = classes.sparkSession, float(np.sqrt(2 - 2 * least))
    whole = classes.agg(F.max(F.size("vector")).alias("width"), F.count("*").alias("total")).first()
    width = whole.width or 1
    directions = fitted_directions(classes, whole.total, width, sample)
    dims, order = directions.shape[1] + 1, min(ORDER, directions.shape[1])
    kind = np.float32 if dict(classes.dtypes)["vector"] == "array<float>" else np.float64

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, lengths = _stack(batch.column("vector").cast(pa.list_(pa.float64())), width)
            p = coordinates(unit(x), directions)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("n"), pa.array([row[:k].tobytes() for row, k in zip(x.astype(kind), lengths)], pa.binary())]
                + [pa.array(np.floor(p[:, k] / eps).astype(np.int32)) for k in range(order)]
                + [pa.array(p[:, k]) for k in range(dims)],
                ["rep", "n", "data", *(f"c{k}" for k in range(order)), *(f"p{k}" for k in range(dims))],
            )

    cells = [f"c{k}" for k in range(order)]
    schema = "rep long, n long, data binary, " + ", ".join(f"{c} int" for c in cells) + ", " + ", ".join(f"p{k} double" for k in range(dims))
    placed, total = numbered(written(classes.mapInArrow(project, schema), "projected"), *cells, "rep")
    size = max(1, -(-total // min(blocks, max(FEWEST, -(-total // block)))))
    placed = written(placed.withColumn("block", F.expr(f"CAST(row_number div {size} AS INT)")), "sequence")
    edges = placed.groupBy("block").agg(*(f(f"p{k}").alias(f"{f.__name__}{k}") for f in (F.min, F.max) for k in range(dims))).orderBy("block").collect()  # at most blocks rows
    boxes = np.array([[[r[f"{f}{k}"] for k in range(dims)] for f in ("min", "max")] for r in edges]).reshape(-1, 2, dims)
    pairs = [(k, a, b) for k, (a, b) in enumerate(near_intervals(boxes, eps))]
    members = [(k, a, 0) for k, a, _ in pairs] + [(k, b, 1) for k, a, b in pairs if a != b]
    table = spark.createDataFrame(members, "pair int, block int, side int")
    rows = placed.select("rep", "n", "data", "row_number", "block").join(F.broadcast(table), "block")  # at most blocks * (blocks + 1) short rows

    def join(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["side", "row_number"])
        lengths = (part.data.str.len() // kind().itemsize).to_numpy()
        x = np.zeros((len(part), width))
        x[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(part.data), kind)
        links, label = block_links(unit(x), lengths, part.n.to_numpy(), part.side.to_numpy(), directions, least)
        reps = part.rep.to_numpy()
        return pd.DataFrame({"rep": reps, "links": links, "root": reps[label]})[links > 0]

    found = written(rows.groupBy("pair").applyInPandas(join, "rep long, links long, root long"), "pair-links")
    return found.groupBy("rep").agg(F.sum("links").alias("links")), found.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b"))


def near_duplicates(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 32_768, blocks: int = 256, sample: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("vector", F.when(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)), v))
    classes = written(rows.where("vector IS NOT NULL").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    links, edges = linked_classes(classes, least, block, blocks, sample)
    joined = classes.join(links, "rep", "left").join(components(edges).withColumnRenamed("node", "rep"), "rep", "left")
    named = written(joined.select("vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "named")
    out = rows.join(named, "vector", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
