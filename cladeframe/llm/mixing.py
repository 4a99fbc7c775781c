"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source's documents fall by hash into blocks.  A source's target is met by
whole passes over its blocks and then by blocks in permuted order; the block at
which the target would be passed is cut into sub-blocks, of which those that fit
are taken, then later blocks that fit.  So quotas are exact numbers of blocks and
the words taken miss the target by less than a sub-block or a document.

A tree then splits the quotas: at each node the left half of the output shards
draws its blocks from the node's by a multivariate hypergeometric law, so each
shard gets as many blocks as any other and a random share of every source.  A shard
takes the next blocks of each source's permuted list and is shuffled locally.

What the driver holds is a table of sources by BLOCKS rows, whatever the number of
documents: a source is a named part of the mixture, not a key of the data, and more
than MOST_SOURCES of them are an error.

Rows: a row's block follows from its id, source and text; rows that agree in all three
are told apart by a number among all such rows, so repeated rows, one id on many rows or
rows without an id spread over the blocks like any others, and reruns agree.  Null text
has size 0; a null source is a source, the last one; a source of size 0 has target 0.
Very long texts are only counted and hashed, and a text longer than what its source's
target leaves is not taken; equal sizes and ties need no order, blocks have one.  Further
columns, whatever their names, come back untouched from mix; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import bounded, numbered, small_table
from .common import WORD, written

BLOCKS = 256
WEIGHTS = (5, 2, 1)
MOST_SOURCES = 20_000
#: Rows of the block table up to which it is broadcast (about 60 bytes each).
BROADCAST_ROWS = 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of total by weight; none above most times its size, the excess shared out again among the others."""
    out, left, rest = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while left:
        whole = sum(weights[i] for i in left)
        above = [i for i in left if rest * weights[i] / whole > most * sizes[i]]
        for i in above or left:
            out[i] = most * sizes[i] if above else rest * weights[i] / whole
        rest -= sum(out[i] for i in above)
        left = [i for i in left if i not in above] if above else []
    return out


def _rng(*key: object) -> np.random.Generator:
    return np.random.default_rng(list(hashlib.sha256(repr(key).encode()).digest()))


def choose(blocks: dict[int, int], rest: float, rng: np.random.Generator) -> tuple[list[int], int | None, float]:
    """Blocks in permuted order until one would pass what is left; that block; what is left.  Where the list ends, None."""
    taken = []
    for b in rng.permutation(sorted(blocks)).tolist():
        if blocks[b] > rest:
            return taken, b, rest
        taken.append(b)
        rest -= blocks[b]
    return taken, None, rest


def fill(blocks: dict[int, int], rest: float, rng: np.random.Generator) -> tuple[list[int], float]:
    """Those blocks, in permuted order, that still fit."""
    taken = []
    for b in rng.permutation(sorted(blocks)).tolist():
        if 0 < blocks[b] <= rest:
            taken.append(b)
            rest -= blocks[b]
    return taken, rest


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources): the tree's draw of blocks; column sums are the quotas, row sums differ by one at most."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid, total = (lo + hi) // 2, int(have.sum())
        sizes = [total // (hi - lo) + (k < total % (hi - lo)) for k in range(hi - lo)]
        left = _rng(seed, "node", lo, hi).multivariate_hypergeometric(have, sum(sizes[: mid - lo]), method="marginals")
        node(lo, mid, left)
        node(mid, hi, have - left)

    node(0, shards, quotas.astype(np.int64))
    return out


class Plan:
    """Which blocks, how often and into which shards; tables for the join with documents."""

    def __init__(self, spark: SparkSession, sizes: DataFrame, share: float, shards: int, seed: int):
        """sizes: source, size, block, sub of every document, at rest."""
        bounded(sizes.select("source").distinct(), MOST_SOURCES, "sources")
        found = sizes.groupBy("source", "block").agg(F.sum("size").alias("words")).collect()
        by_source: dict[str | None, dict[int, int]] = {}
        for r in found:
            by_source.setdefault(r.source, {})[r.block] = r.words
        self.sources = sorted((s for s in by_source if s is not None)) + [None] * (None in by_source)
        self.sizes = [sum(by_source[s].values()) for s in self.sources]
        weights = [float(WEIGHTS[i % len(WEIGHTS)]) for i in range(len(self.sources))]
        self.targets = targets(self.sizes, weights, share * sum(self.sizes))
        tickets: list[list[tuple[int, int]]] = []  # of each source, in drawing order: block, pass
        cut: dict[str | None, tuple[int, float]] = {}
        rests: list[float] = []
        for i, s in enumerate(self.sources):
            blocks, size, target = by_source[s], self.sizes[i], self.targets[i]
            whole = min(2, int(target // size)) if size else 0
            mine = [(b, p) for p in range(whole) for b in _rng(seed, s, p).permutation(sorted(blocks)).tolist()]
            taken, at, rest = choose(blocks, target - whole * size, _rng(seed, s, whole)) if whole < 2 and size else ([], None, 0.0)
            mine += [(b, whole) for b in taken]
            if at is not None:
                mine.append((at, whole))
                cut[s] = (at, rest)
            tickets.append(mine)
            rests.append(rest)
        subs: dict[str | None, list[int]] = {}
        if cut:
            edge = small_table(spark, [(s, b) for s, (b, _) in cut.items()], "cut_source string, cut_block int")  # a row for each source
            rows = sizes.join(F.broadcast(edge), F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("block") == F.col("cut_block")))
            inner: dict[str | None, dict[int, int]] = {}
            for r in rows.groupBy("source", "sub").agg(F.sum("size").alias("words")).collect():
                inner.setdefault(r.source, {})[r.sub] = r.words
            for i, s in enumerate(self.sources):
                if s in cut:
                    subs[s], rest = fill(inner.get(s, {}), rests[i], _rng(seed, s, "sub"))
                    have = {b for b, p in tickets[i] if p == tickets[i][-1][1]}
                    more, _ = fill({b: w for b, w in by_source[s].items() if b not in have}, rest, _rng(seed, s, "more"))
                    tickets[i] += [(b, tickets[i][-1][1]) for b in more]
        drawn = split_quotas(np.array([len(t) for t in tickets]), shards, seed) if tickets else np.zeros((shards, 0), int)
        self.rows = []
        for i, s in enumerate(self.sources):
            shard_of = np.repeat(np.arange(shards), drawn[:, i]).tolist()
            self.rows += [(s, b, p, shard_of[k], s in cut and b == cut[s][0] and k == self._cut_at(tickets[i], cut[s][0])) for k, (b, p) in enumerate(tickets[i])]
        self.subs = [(s, x) for s, xs in subs.items() for x in xs]
        self.spark = spark

    @staticmethod
    def _cut_at(tickets: list[tuple[int, int]], block: int) -> int:
        return max(k for k, (b, _) in enumerate(tickets) if b == block)

    def source_table(self) -> DataFrame:
        """source, source_size, target."""
        return small_table(self.spark, list(zip(self.sources, self.sizes, self.targets)), "plan_source string, source_size long, target double")

    def tickets(self) -> DataFrame:
        """source, block, and the list of its tickets (pass, shard, cut: only chosen sub-blocks)."""
        table = small_table(self.spark, self.rows, "plan_source string, plan_block int, pass int, shard int, cut boolean")
        return table.groupBy("plan_source", "plan_block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", "cut"))).alias("tickets"))

    def sub_table(self) -> DataFrame:
        return small_table(self.spark, self.subs, "sub_source string, plan_sub int").withColumn("chosen", F.lit(True))

    def drawn(self, placed: DataFrame) -> DataFrame:
        """placed (with source, block, sub) with draws: array<struct<pass, shard>> of the copies that the mix takes of the row."""
        small = len(self.rows) <= BROADCAST_ROWS
        hint = F.broadcast if small else (lambda x: x)
        joined = placed.join(hint(self.tickets()), F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("block") == F.col("plan_block")), "left")
        joined = joined.join(hint(self.sub_table()), F.col("source").eqNullSafe(F.col("sub_source")) & (F.col("sub") == F.col("plan_sub")), "left")
        keep = F.filter(F.coalesce("tickets", F.array().cast("array<struct<pass:int,shard:int,cut:boolean>>")), lambda t: ~t["cut"] | F.coalesce("chosen", F.lit(False)))
        return joined.withColumn("draws", keep).drop("plan_source", "plan_block", "tickets", "sub_source", "plan_sub", "chosen")


def _placed(rows: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """rows with a column place: key (of id, source and text), block, sub, order.

    Rows with a key of their own are placed by it.  Those that share one are few or copies: they alone are numbered, in the order of
    keys, by a range shuffle that a random column splits where one key has many rows."""
    key, times, salt, number = "_key", "_times", "_salt", "row_number"  # rows has columns of this module only
    hashed = F.xxhash64(*(F.col(f"`{c}`") for c in (id_col, source_col, text_col)), *(F.col(f"`{c}`").isNull() for c in (id_col, source_col, text_col)))
    keyed = rows.withColumn(key, hashed)
    shared = written(keyed.groupBy(key).agg(F.count("*").alias(times)).where(F.col(times) > 1), "shared-keys")
    joined = keyed.join(shared, key, "left")
    copies = numbered(joined.where(F.col(times).isNotNull()).withColumn(salt, F.xxhash64(F.monotonically_increasing_id())), key, salt).drop(salt)
    alone = joined.where(F.col(times).isNull()).withColumn(number, F.lit(-1).cast("long"))
    both = alone.unionByName(copies)
    at = lambda k: F.xxhash64(F.lit(seed + k), key, number)
    part = lambda k: F.pmod(at(k), F.lit(BLOCKS)).cast("int")
    return both.select(*rows.columns, F.struct(part(0).alias("block"), part(1).alias("sub"), at(2).alias("order")).alias("place"))


def _sizes(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, size, place of every row; a text is its hash before anything moves."""
    hashed = F.xxhash64(F.col(f"`{text_col}`"))
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.when(F.col(f"`{text_col}`").isNotNull(), hashed).alias("text"), word_count(F.col(f"`{text_col}`")).alias("size"))
    placed = _placed(written(narrow, "narrow"), seed, "doc_id", "text", "source")
    return written(placed.select("doc_id", "source", "size", "place.block", "place.sub"), "sizes")


def taken(docs: DataFrame, share: float = 1.5, shards: int = 16, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken (words in the mix), shards (that the tree drew for its copies)."""
    sizes = _sizes(docs, seed, id_col, text_col, source_col)
    plan = Plan(docs.sparkSession, sizes, share, shards, seed)
    rows = plan.drawn(sizes).join(F.broadcast(plan.source_table()), F.col("source").eqNullSafe(F.col("plan_source")))  # a row for each source
    return rows.select("doc_id", "size", "source_size", "target", (F.size("draws") * F.col("size")).alias("taken"), F.transform("draws", lambda t: t["shard"]).alias("shards"))


def mix(docs: DataFrame, share: float = 1.5, shards: int = 16, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: docs' columns, a row for each copy taken, ordered by shard and shuffled within it."""
    plan = Plan(docs.sparkSession, _sizes(docs, seed, id_col, text_col, source_col), share, shards, seed)
    hashed = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.when(F.col(f"`{text_col}`").isNotNull(), F.xxhash64(F.col(f"`{text_col}`"))).alias("text"))
    placed = _placed(hashed, seed, "doc_id", "text", "source").select("row", "source", "place.*")
    copies = plan.drawn(placed).select("row", "order", F.explode("draws").alias("draw"))
    copies = copies.select("row", F.col("draw.shard").alias("shard"), F.xxhash64("order", "draw.pass").alias("order"))
    return copies.repartitionByRange("shard", "order").sortWithinPartitions("shard", "order").select("row.*")
