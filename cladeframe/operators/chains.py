"""Chains of target statuses along a tree's edges: states close by, sparse rates with a sink, the exponential's action, pruning.

A state is a tuple of tracts, an array in the order of targets; its status is the mask of the
targets that it leaves inactive.  An edge's chain depends on the lower node's indel sets, on
the parent's states and on how many steps it may take; edges that agree in all of these share
one chain, so sisters with equal alleles are worked out once.

Tables go by barcode and node.  Every round is written to the shared folder, so a lost executor
costs one round; tables that nothing reads again are discarded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import states as sa
from ..functions import status as st
from ..functions.status import span_mask
from ..tables import discard, written

NODE = ["barcode", "node_id"]
#: Units of uniformised time in one series; longer branches take several.
_UNITS = 32.0
#: Rates that are worked on side by side, and edges for a task at least.
_SIDE, _EDGES = 50_000, 1_000


def _all_tracts(n: int) -> Column:
    """Every tract over n targets; a fixed list, as long as n squared allows."""
    ends = [(max(lo - a, 0), lo, hi, min(hi + b, n - 1)) for lo in range(n) for hi in range(lo, n) for a in (0, 1) for b in (0, 1)]
    return F.from_json(F.lit(str([list(t) for t in sorted(set(ends))])), "array<array<int>>")


def allowed_tracts(state: Column, n: int) -> Column:
    """Tracts that a state allows by themselves: its singletons' own, and all within one of its wildcards."""
    tract = lambda t: F.struct(*(F.get(t, k).alias(c) for k, c in enumerate(("min_deact", "min_t", "max_t", "max_deact"))))

    def fits(t: Column) -> Column:
        inside = lambda x: (lambda lo, hi: (lo <= t["min_deact"]) & (t["max_deact"] <= hi))(*sa._inner(x))
        return F.exists(state, lambda x: inside(x) | (sa.is_singleton(x) & (sa.tract_of(x) == t)))

    return F.filter(F.transform(_all_tracts(n), tract), fits)


def own_tracts(state: Column) -> Column:
    return F.transform(sa.singletons(state), sa.tract_of).cast(sa.TRACTS)


def edges(annotated: DataFrame) -> DataFrame:
    """barcode, node_id, parent_id, state, required (singletons that the parent has not), asked (mask of the singletons' tracts) of every edge."""
    up = annotated.select("barcode", F.col("node_id").alias("parent_id"), F.col("state").alias("above"))
    rows = annotated.where("parent_id IS NOT NULL").join(up, ["barcode", "parent_id"])
    new = F.size(F.array_except(sa.singletons(F.col("state")), sa.singletons(F.col("above"))))
    return rows.select(*NODE, "parent_id", "state", new.alias("required"), sa.status_of(own_tracts(F.col("state"))).alias("asked"))


def _bit(mask: Column, at: Column) -> Column:
    return F.call_function("getbit", mask, at) == 1


def _within(links: list[DataFrame], starts: DataFrame, limits: DataFrame) -> DataFrame:
    """chain, tracts on paths of at most the chain's steps (limits: chain, steps) that end where passed; links[d]: moves of step d + 1.

    Backwards from the last step: what is passed there, and what leads to what was kept one step on."""
    kept, out = None, []
    for d in range(len(links), -1, -1):
        at = starts if d == 0 else links[d - 1].select("chain", F.col("next").alias("tracts"), F.col("next_passed").alias("passed"))
        here = at.where("passed").join(limits.where(F.col("steps") >= d), "chain", "left_semi").select("chain", "tracts", "passed")
        if kept is not None:
            to = kept.select("chain", F.col("tracts").alias("next"), F.col("passed").alias("next_passed"))
            here = here.unionByName(links[d].join(to, ["chain", "next", "next_passed"], "left_semi").select("chain", "tracts", "passed"))
        kept = written(here.distinct(), "kept")
        out.append(kept)
    return reduce(DataFrame.unionByName, out).select("chain", "tracts").distinct()


class Search:
    """The search's expressions over n targets, built once for all its rounds."""

    def __init__(self, n: int):
        self.allowed = allowed_tracts(F.col("state"), n)
        self.own = own_tracts(F.col("state"))
        self.reach = sa.max_status(F.col("state"))
        self.status = sa.status_of(F.col("tracts"))
        left = F.col("reach").bitwiseAND(F.bitwise_not(F.col("status")))
        self.usable = F.explode(F.filter("allowed", lambda t: _bit(left, t["min_t"]) & _bit(left, t["max_t"])))
        self.next = sa.merged(F.concat("tracts", F.array("t").cast(sa.TRACTS)))
        self.possible = sa.is_possible(F.col("state"), F.col("next"))
        self.next_status = sa.status_of(F.col("next"))

    def close(self, chains: DataFrame, starts: DataFrame, extra: int = 1, most: int = 3000) -> tuple[DataFrame, DataFrame]:
        """See close_states."""
        most_extra = F.when(F.pow(F.lit(2.0), F.col("required")) <= most, extra).otherwise(max(extra - 1, 0)).cast("int")
        table = written(chains.select("chain", "state", "required", "asked", self.reach.alias("reach"), self.allowed.alias("allowed"), most_extra.alias("extra")), "chains")
        missing = lambda status: F.col("asked").bitwiseAND(F.bitwise_not(status))
        first = starts.join(table.select("chain", "asked"), "chain").withColumn("status", self.status)
        first = written(first.select("chain", "tracts", "status", (missing(F.col("status")) == 0).alias("passed")).distinct(), "starts")
        links: list[DataFrame] = []
        frontier, steps = first, F.col("required") + F.col("extra")
        longest = F.least(steps, F.bit_count("reach"))  # a step takes a target at least
        for d in range(1, 1 + (table.agg(F.max(longest)).first()[0] or 0)):
            here = frontier.join(table.where(longest >= d), "chain").withColumn("t", self.usable).withColumn("next", self.next).where(self.possible).withColumn("next_status", self.next_status)
            passes = (F.col("passed") | (missing(F.col("next_status")) == 0)).alias("next_passed")
            links.append(written(here.select("chain", "tracts", "passed", "next", "next_status", passes).distinct(), "moves"))
            frontier = links[-1].select("chain", F.col("next").alias("tracts"), F.col("next_status").alias("status"), F.col("next_passed").alias("passed")).distinct()
        exact = table.where(steps == 0).select("chain", self.own.alias("tracts"))
        todo, done, reports = table, [], []
        for back in range(extra + 1):
            found = _within(links, first, todo.where(steps > 0).select("chain", steps.alias("steps")))
            found = written((found if back else found.unionByName(exact)).withColumn("status", self.status), "close")
            own = todo.select("chain", "extra", "required").join(found.groupBy("chain").agg(F.count_distinct("status").alias("statuses")), "chain", "left")
            own = written(own.withColumn("statuses", F.coalesce("statuses", F.lit(0).cast("long"))), "sizes")
            again = own.where((F.col("statuses") > most) & (F.col("extra") > 0) & (steps > 1)).select("chain")
            over = (F.col("statuses") > most).alias("over")
            if again.isEmpty():
                reports.append(own.select("chain", "extra", "statuses", over))
                done.append(found)
                break
            settled = own.join(again, "chain", "left_anti")
            reports.append(settled.select("chain", "extra", "statuses", over))
            done.append(found.join(settled.select("chain"), "chain", "left_semi"))
            todo = todo.join(again, "chain", "left_semi").withColumn("extra", F.col("extra") - 1)
        for used in links:
            discard(used)
        return reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, reports)


def close_states(chains: DataFrame, starts: DataFrame, n: int, extra: int = 1, most: int = 3000) -> tuple[DataFrame, DataFrame]:
    """States close to the asked status, by chain.

    chains: chain, state, required, asked; starts: chain, tracts (the parent's states).  From the starts a step adds one tract that
    the state allows; a state is close if it lies on a path of at most required + extra steps that comes to a state with all asked
    targets inactive.  Where these are more than most statuses, extra is lowered for that chain, down to none; nothing is cut off.
    Without any step the state is that of the singletons.

    Returns (chain, tracts, status) and a report of every chain: chain, extra (as used), statuses, over (still more than most)."""
    return Search(n).close(chains, starts, extra, most)


def _named(starts: Column) -> Column:
    return F.sha2(F.to_json(starts), 256)


def _key(told: Callable[[Column], Column] | None) -> Column:
    """What tells an edge's search and rates apart but for its starts: required, asked, and the state, of whose singletons only tract and told count."""
    sets = F.transform("state", lambda x: F.struct(sa.is_singleton(x).alias("single"), *(x[c] for c in ("min_deact", "min_t", "max_t", "max_deact"))))
    parts = ["state"] if told is None else [sets.alias("sets"), F.transform(sa.singletons(F.col("state")), told).alias("told")]
    return F.sha2(F.to_json(F.struct(*parts, "required", "asked")), 256)


def tree_states(annotated: DataFrame, levels: DataFrame, n: int, extra: int = 1, most: int = 3000, told: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Close states along a tree, from the root (no tract) down, a round a level.

    annotated: barcode, node_id, parent_id, state; levels: node_id, level.  The children of a node first search from all its states;
    the states that every child keeps are then the starts of all of them.  Returns (chain, tracts, status), nodes (barcode, node_id,
    parent_id, chain) and chains (chain, state, required, asked, extra, statuses, over); the root's chain is 'root'.

    Edges with equal states, steps and starts share a chain.  The search needs a singleton's tract alone: where rates need no more than
    told of it (its trim's probability, say), edges that agree in tracts and told share one, and its state is that of any of them."""
    none, spark = F.array().cast(sa.TRACTS), annotated.sparkSession
    placed = edges(annotated).join(levels.select("node_id", "level"), "node_id").withColumn("key", _key(told))
    placed = written(placed, "edges")
    kinds = written(placed.groupBy("key").agg(F.first(F.struct("state", "required", "asked")).alias("x")).select("key", "x.*"), "kinds")
    nodes = annotated.where("parent_id IS NULL").select(*NODE, F.lit(None).cast("string").alias("parent_id"), F.lit("root").alias("chain"))
    states = spark.range(1).select(F.lit("root").alias("chain"), none.alias("tracts"), F.lit(0).cast("long").alias("status"))
    all_states, all_nodes, all_chains, search = [states], [nodes], [], Search(n)

    def searched(rows: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Chains (with starts) of rows: chain, key, set; sets: set, starts.  And their states and report."""
        own = written(rows.select("chain", "key", "set").distinct().join(kinds, "key").join(sets, "set").select("chain", "state", "required", "asked", "starts"), "chains")
        return own, *search.close(own, own.select("chain", F.explode("starts").alias("tracts")), extra, most)

    name = F.sha2(F.concat("key", "set"), 256)
    for level in range(1, 1 + (placed.agg(F.max("level")).first()[0] or 0)):
        rows = placed.where(F.col("level") == level).select(*NODE, "parent_id", "key")
        had = nodes.select("chain").distinct().join(states, "chain", "left").groupBy("chain").agg(F.array_sort(F.collect_set("tracts")).alias("starts"))  # at most the budget's states
        had = written(had.withColumn("set", _named(F.col("starts"))), "sets")
        above = nodes.select("barcode", F.col("node_id").alias("parent_id"), "chain").join(had.select("chain", "set"), "chain").drop("chain")
        each = written(rows.join(above, ["barcode", "parent_id"]).withColumn("chain", name), "edges")
        chains, states, report = searched(each, had.select("set", "starts").distinct())
        kept = chains.select("chain", F.explode("starts").alias("tracts")).join(states, ["chain", "tracts"], "left_semi")
        kept = written(kept, "kept")
        left = kept.groupBy("chain").agg(F.count("*").alias("left"))
        lost = written(chains.select("chain", F.size("starts").alias("n")).join(left, "chain", "left").where("n > coalesce(left, 0)").select("chain"), "lost")
        if not lost.isEmpty():  # these nodes' children start from fewer states
            parents = written(each.join(lost, "chain", "left_semi").select("barcode", "parent_id").distinct(), "parents")
            below = written(each.join(parents, ["barcode", "parent_id"], "left_semi"), "edges")
            lists = below.select("barcode", "parent_id", "chain").distinct()
            shared = lists.join(kept, "chain").groupBy("barcode", "parent_id", "tracts").agg(F.count("*").alias("k"))
            shared = shared.join(lists.groupBy("barcode", "parent_id").agg(F.count("*").alias("n")), ["barcode", "parent_id"]).where("k = n")
            sets = parents.join(shared, ["barcode", "parent_id"], "left").groupBy("barcode", "parent_id").agg(F.array_sort(F.collect_set("tracts")).alias("starts"))
            sets = written(sets.withColumn("set", _named(F.col("starts"))), "sets")
            again = below.drop("set", "chain").join(sets.drop("starts"), ["barcode", "parent_id"]).withColumn("chain", name)
            again = written(again, "edges")
            new = again.join(chains, "chain", "left_anti")
            more = searched(new, sets.select("set", "starts").distinct())
            each = each.join(parents, ["barcode", "parent_id"], "left_anti").unionByName(again)
            used = each.select("chain").distinct()
            chains, states, report = (written(a.unionByName(b).join(used, "chain", "left_semi"), "all") for a, b in zip((chains, states, report), more))
        nodes = each.select(*NODE, "parent_id", "chain")
        all_states.append(states)
        all_nodes.append(nodes)
        all_chains.append(chains.select("chain", "state", "required", "asked").join(report, "chain"))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return union(all_states).distinct(), union(all_nodes), union(all_chains).dropDuplicates(["chain"]) if all_chains else annotated.where("false").select(F.lit("").alias("chain"), "state")


# -- rates ----------------------------------------------------------------------------
class Rates:
    """Hazards of a barcode's targets: lams (one a target), the weight of double cuts, factors of long trims."""

    def __init__(self, lams: list[float], double: float, long_left: float, long_right: float):
        self.n, self.double, self.long_left, self.long_right = len(lams), double, long_left, long_right
        self.lams = F.array(*(F.lit(float(x)) for x in lams))

    def away(self, status: Column) -> Column:
        return st.hazard_away(self.lams, status, self.n, self.double, self.long_left, self.long_right)

    def transitions(self, masks: DataFrame) -> DataFrame:
        """status, after, rate (of all tracts), tracts (array of tract and hazard); masks: status."""
        steps = st.transitions(masks, self.n)
        parts = [F.col(c) for c in ("min_deact", "min_t", "max_t", "max_deact")]
        rated = steps.withColumn("hazard", st.hazard(self.lams, *parts, self.double, self.long_left, self.long_right))
        tract = F.struct(*(F.col(c).cast("int").alias(c) for c in ("min_deact", "min_t", "max_t", "max_deact")))
        return rated.groupBy("status", "after").agg(F.sum("hazard").alias("rate"), F.collect_list(F.struct(tract.alias("tract"), "hazard")).alias("tracts"))


def rate_rows(states: DataFrame, chains: DataFrame, hazards: Rates, trim: Callable[[Column], Column]) -> DataFrame:
    """Rates between the statuses of each chain as rows chain, status, after, rate; after is null for the sink.

    states: chain, status; chains: chain, state.  A step to a status that one of the state's singletons makes with its own tract has that
    tract's hazard alone, any other the sum over its tracts.  trim gives a singleton's probability given its tract: a step that takes an
    end of one new singleton has that factor, one that would take ends of several at once is impossible.  The diagonal is minus the
    rate of leaving; what the chain's statuses do not take flows into the sink, so rows sum to zero."""
    singles = chains.select("chain", sa.singletons(F.col("state")).alias("singles"))
    own = states.select("chain", "status").distinct()
    masks = own.groupBy("chain").agg(F.collect_list("status").alias("all"))  # at most the budget's statuses
    later = F.filter("all", lambda e: (e != F.col("status")) & (e.bitwiseAND(F.col("status")) == F.col("status")))
    pairs = own.join(masks, "chain").select("chain", "status", F.explode(later).alias("after"))
    steps = pairs.join(hazards.transitions(own.select("status").distinct()), ["status", "after"]).join(singles, "chain")
    special = F.filter("tracts", lambda x: F.exists("singles", lambda s: sa.tract_of(s) == x["tract"]))
    new = F.col("after") - F.col("status")
    hit = F.filter("singles", lambda s: _bit(new, s["min_t"]) | _bit(new, s["max_t"]))
    factor = F.when(F.size(hit) == 0, 1.0).when(F.size(hit) == 1, F.get(F.transform(hit, trim), 0)).otherwise(0.0)
    moves = written(steps.select("chain", "status", "after", (F.coalesce(F.get(special, 0)["hazard"], F.col("rate")) * factor).alias("rate")), "rates")
    away = own.withColumn("away", hazards.away(F.col("status")))
    taken = moves.groupBy("chain", "status").agg(F.sum("rate").alias("taken"))
    ends = away.join(taken, ["chain", "status"], "left").withColumn("sink", F.col("away") - F.coalesce("taken", F.lit(0.0)))
    stay = F.array(F.struct(F.col("status").alias("after"), (-F.col("away")).alias("rate")), F.struct(F.lit(None).cast("long").alias("after"), F.col("sink").alias("rate")))
    return moves.unionByName(ends.select("chain", "status", F.explode(stay).alias("x")).select("chain", "status", "x.after", "x.rate"))


def matrices(rates: DataFrame) -> DataFrame:
    """chain, statuses (in order), and its rates as coordinates: starts, ends (places in statuses), values.  The sink needs none: nothing
    comes back from it.  A row has at most the budget's statuses."""
    inner = rates.where("after IS NOT NULL")
    own = inner.groupBy("chain").agg(F.array_sort(F.collect_set("status")).alias("statuses"), F.collect_list(F.struct("status", "after", "rate")).alias("moves"))
    place = lambda name: F.transform("moves", lambda m: (F.array_position(F.col("statuses"), m[name]) - 1).cast("int"))
    return own.select("chain", "statuses", place("status").alias("starts"), place("after").alias("ends"), F.transform("moves", lambda m: m["rate"]).alias("values"))


# -- the exponential ------------------------------------------------------------------
def act(starts: np.ndarray, ends: np.ndarray, values: np.ndarray, length: float, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(Q length) vector and its derivative by the length, Q given by coordinates."""
    return act_all([(starts, ends, values, length, vector)])[0]


def act_all(rows: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
    """act() of each row, all rows' matrices side by side as one: by uniformisation, powers of a stochastic matrix weighed by a Poisson law,
    in pieces of at most _UNITS.  Every row has its own unit of time, all have as many pieces and terms as the longest needs."""
    sizes = np.array([len(r[4]) for r in rows])
    row, first = np.repeat(np.arange(len(rows)), sizes), np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    i, j = (np.concatenate([np.asarray(r[k], int) for r in rows]) + first[own] for k in (0, 1))
    values, vector = (np.concatenate([np.asarray(r[k], float) for r in rows]) for k in (2, 4))
    fastest = np.zeros(len(rows))
    np.maximum.at(fastest, own[i == j], -values[i == j])
    time = fastest * [max(r[3], 0.0) for r in rows]
    pieces = int(np.ceil(time.max() / _UNITS))
    scaled, units = values / np.where(fastest > 0, fastest, 1.0)[own], time / max(pieces, 1)
    for _ in range(pieces):
        term, weight, k = vector, np.exp(-units), 0
        out = weight[row] * term
        while k < 24 or k < 2 * units.max() or weight.max() > 1e-18:
            k += 1
            term = term + np.bincount(i, scaled * term[j], minlength=len(term))
            weight = weight * units / k
            out = out + weight[row] * term
        vector = out
    slope = np.bincount(i, values * vector[j], minlength=len(vector))
    return list(zip(np.split(vector, first[1:]), np.split(slope, first[1:])))


def acted(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows' named columns, statuses, down and slope: the exponential of each row's rates over its length, on its vector; slope is the
    derivative by the length.  rows also has statuses, starts, ends, values, length, vector.  A row is an edge, its size the budget's;
    rows of like lengths are worked out together, as many as have _SIDE rates."""
    kept = rows.select(*columns, "statuses", "starts", "ends", "values", "length", "vector")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.select(*columns, "statuses").schema)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.sort_values("length", kind="stable")
            part = (batch["values"].map(len).cumsum() // _SIDE).to_numpy()
            for some in (batch[part == k] for k in np.unique(part)):
                found = act_all(list(zip(some.starts, some.ends, some["values"], some.length, some.vector)))
                yield some[[*columns, "statuses"]].assign(down=[a for a, _ in found], slope=[b for _, b in found])

    return kept.mapInPandas(solve, f"{schema}, down array<double>, slope array<double>")


# -- pruning --------------------------------------------------------------------------
def likelihood(tree: DataFrame, nodes: DataFrame, rates: DataFrame, leaf_status: DataFrame, hazards: Rates, weight: float = 0.0) -> DataFrame:
    """barcode, log_lik of the leaves' statuses, the root unmodified.

    tree: node_id, parent_id, level, length (of the branch without its part of the spine), spine (of an unresolved node the longest
    offset of its children, else 0), abundance (1 for inner nodes); nodes: barcode, node_id, parent_id, chain; leaf_status: barcode,
    node_id, status.  Every branch takes its vector through its own chain's exponential; a node adds its children's logarithms (a leaf's
    times 1 + weight * (abundance - 1)) and, for an unresolved node, the probability that nothing happens along its spine.  Statuses that
    a child's chain has not are impossible.  Vectors are scaled by their largest value, the scale is carried as a logarithm.  A tree whose
    leaves are impossible has log_lik null.  A round for each level, each written."""
    own = written(nodes.join(tree.select("node_id", "level", "length", "spine", "abundance"), "node_id").select("barcode", "node_id", "parent_id", "chain", "level", "length", "spine", "abundance"), "nodes")
    held = written(matrices(rates), "matrices")
    size = own.where("parent_id IS NOT NULL").groupBy("barcode", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("children"))
    here = own.join(leaf_status, NODE).select("barcode", "node_id", "level", "status", F.lit(0.0).alias("log_p"))
    below, root = written(here, "leaves"), None
    leaves = below
    deepest = own.agg(F.max("level")).first()[0] or 0
    current = leaves.where(F.col("level") == deepest).drop("level")
    known = held.select("chain", "statuses").unionByName(own.sparkSession.range(1).select(F.lit("root").alias("chain"), F.array(F.lit(0).cast("long")).alias("statuses")))
    above = own.join(known, "chain").select("barcode", F.col("node_id").alias("parent_id"), F.col("statuses").alias("above"))
    for level in range(deepest, 0, -1):
        vectors = current.groupBy(*NODE).agg(F.max("log_p").alias("top"), F.map_from_entries(F.collect_list(F.struct("status", "log_p"))).alias("logs"))
        rows = own.where(F.col("level") == level).join(vectors, NODE).join(held.select("chain", "statuses"), "chain")
        value = lambda s: F.coalesce(F.exp(F.try_element_at("logs", s) - F.col("top")), F.lit(0.0))
        rows = rows.withColumn("vector", F.transform("statuses", value)).withColumn("times", F.lit(1.0) + (F.col("abundance") - 1) * weight)
        rows = written(rows.withColumn("action", F.sha2(F.to_json(F.struct("chain", "length", "vector")), 256)).select("barcode", "parent_id", "chain", "top", "times", "length", "vector", "action"), "branches")
        once = rows.groupBy("action").agg(F.first(F.struct("chain", "length", "vector")).alias("x")).select("action", "x.*")  # edges alike act alike
        once = written(once, "actions")
        tasks = min(-(-once.count() // _EDGES), 100_000) or 1
        done = written(acted(once.join(held, "chain").repartition(tasks, "action"), ["action"]), "acted")
        up = rows.select("barcode", "parent_id", "top", "times", "action").join(above, ["barcode", "parent_id"]).join(done, "action")
        fit = F.filter(F.arrays_zip("statuses", "down"), lambda x: (x["down"] > 0) & F.array_contains("above", x["statuses"]))  # the parent's chain has these alone
        logs = up.select("barcode", F.col("parent_id").alias("node_id"), "top", "times", F.explode(fit).alias("x"))
        logs = logs.select(*NODE, F.col("x.statuses").alias("status"), ((F.log("x.down") + F.col("top")) * F.col("times")).alias("part"))
        sums = logs.groupBy(*NODE, "status").agg(F.sum("part").alias("log_p"), F.count("*").alias("k")).join(size, NODE).where("k = children")
        kept = sums.join(own.select(*NODE, "spine"), NODE)
        kept = kept.select(*NODE, "status", (F.col("log_p") - F.col("spine") * hazards.away(F.col("status"))).alias("log_p"))
        root = written(kept, "inner")
        current = root.unionByName(leaves.where(F.col("level") == level - 1).drop("level"))
    trees = own.where("parent_id IS NULL").select(*NODE)
    if root is None:
        return trees.select("barcode", F.lit(None).cast("double").alias("log_lik"))
    return trees.join(root.where("status = 0"), NODE, "left").select("barcode", F.col("log_p").alias("log_lik"))
