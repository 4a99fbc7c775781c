"""Moves of subtrees scored all at once: where a subtree may hang, and what that does to the parsimony score.

A node has the events that all leaves below it share, and the score adds up the events that a
node has and its parent has not, the root being unmodified.  As a parent's events are its
children's as well, the score is the sum over leaves of their events less, over inner nodes but
the root, (children - 1) times theirs.  Hanging a subtree elsewhere only takes events from the
nodes above the new place, so an upward count of leaves and events and one sum down the paths
give the score of every place.

Most places have the same sums whatever moves: those are worked out once, and for each subtree
only the nodes that differ, above it or with events that it has too, are rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import written
from . import trees


def rehung(nodes: DataFrame, paths: DataFrame, events: DataFrame, chads: DataFrame) -> DataFrame:
    """chad, target, place ('node' or 'edge'), change: for each chad (a node below which all moves) the change of the parsimony score if it
    hangs on an inner node, or in the middle of the edge above a node, anywhere outside itself; staying is a 'node' with change 0.

    Nodes that have no other leaf than the chad's vanish with it and are no targets; a parent left with one child stays.  Inner nodes without
    any leaf have no events and count as nobody's children: what hangs there hangs on the next node above that has leaves.  paths may lack the
    leaves.  events: node_id, k, repeated or not.  Every step is written, so that no plan holds those before it."""
    ends = nodes.where("is_leaf AND parent_id IS NOT NULL").select("node_id", "parent_id")
    inner = nodes.where("NOT is_leaf").select("node_id", "parent_id")
    roots = inner.where("parent_id IS NULL").select(F.col("node_id").alias("anc_id"))
    leaves = written(ends.join(events.groupBy("node_id").agg(F.collect_set("k").alias("ks")), "node_id", "left"), "leaf-events")  # few events a leaf
    chad = written(chads.select("chad").distinct().join(nodes.select(F.col("node_id").alias("chad"), "parent_id", "is_leaf"), "chad"), "chads")

    # parents of leaves (k null), and the events that all leaves of a parent have, go up; a node has the events that came from all parents below it
    count, none = F.count("*"), F.lit(None).cast(events.schema["k"].dataType).alias("k")
    sizes = leaves.groupBy("parent_id").agg(count.alias("n"))
    whole = leaves.select("parent_id", F.explode("ks").alias("k")).groupBy("parent_id", "k").agg(count.alias("c")).join(sizes, "parent_id").where("c = n")
    units = written(whole.select("parent_id", "k").unionByName(sizes.select("parent_id", none)), "units")
    up = paths.join(F.broadcast(roots), "anc_id", "left_anti").select(F.col("anc_id").alias("node_id"), F.col("desc_id").alias("parent_id"))
    sums = written(up.join(units, "parent_id").groupBy("node_id", "k").agg(count.alias("c")), "unit-counts")
    below = sums.where("k IS NULL").select("node_id", F.col("c").alias("m"))
    full = written(sums.where("k IS NOT NULL").join(below, "node_id").where("c = m").select("node_id", "k"), "full-events")

    children = leaves.groupBy("parent_id").agg(count.alias("children")).unionByName(inner.join(below, "node_id").groupBy("parent_id").agg(count.alias("children")))
    children = children.groupBy(F.col("parent_id").alias("node_id")).agg(F.sum("children").alias("children"))
    table = inner.join(below, "node_id", "left").join(children, "node_id", "left").join(full.groupBy("node_id").agg(count.alias("full")), "node_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    table = table.select("node_id", "parent_id", (F.col("m").isNull() & F.col("parent_id").isNotNull()).alias("bare"), zero("children").alias("children"), zero("full").alias("full"))
    weight = lambda children, held: F.when(F.col("parent_id").isNotNull() & (children > 1), (children - 1) * held).otherwise(0)
    table = written(table.withColumn("w", weight(F.col("children"), F.col("full"))), "places")

    entries, kept = _differing(nodes, paths, leaves, units, sums, full, table, chad)
    scored = written(table.select("node_id", "parent_id", "bare", "w").join(entries, "node_id", "left"), "scored")
    near = scored.where("bare").select(F.col("node_id").alias("desc_id")).join(paths, "desc_id").join(table.where("NOT bare").select(F.col("node_id").alias("anc_id")), "anc_id").groupBy(F.col("desc_id").alias("node_id")).agg(F.min_by("anc_id", "hops").alias("kept"))
    hung = near.join(scored.select(F.col("node_id").alias("kept"), F.col("entries").alias("more")), "kept").join(scored, "node_id")
    apart = F.filter(F.coalesce("entries", F.filter("more", lambda e: F.lit(False))), lambda e: e["gone"])  # a node without leaves has the sums of the one that it takes
    hung = written(hung.select("node_id", "parent_id", "bare", "w", F.concat(F.coalesce("more", F.filter("entries", lambda e: F.lit(False))), apart).alias("entries")), "hung")
    scored = scored.where("NOT bare").unionByName(hung)

    stays = kept.join(scored, "node_id").withColumn("at", _own()).select("chad", (_at("loss") - _at("both")).alias("stays"))
    own = _events_of(chad, leaves, full).groupBy("chad").agg(F.collect_set("k").alias("chad_ks"))
    moved = chad.select("chad", "is_leaf").join(below.select(F.col("node_id").alias("chad"), "m"), "chad", "left").select("chad", (F.col("is_leaf") | F.col("m").isNotNull()).alias("any"))
    moved = F.broadcast(written(moved.join(stays, "chad").join(own, "chad", "left"), "moved"))  # chads are the caller's few

    each = scored.join(moved).withColumn("at", _own()).where(~_at("gone"))
    score = _at("loss") - _at("both")
    above = F.when(F.col("bare"), score).otherwise(score - F.col("w") - _at("dw"))
    place = lambda name, value: F.struct(F.lit(name).alias("place"), value.alias("score"))
    places = F.array(place("node", score), place("edge", above))
    on_inner = each.select("chad", F.col("node_id").alias("target"), "any", "stays", F.inline(F.when(F.col("parent_id").isNull(), F.slice(places, 1, 1)).otherwise(places)))
    ends = leaves.join(scored.select(F.col("node_id").alias("parent_id"), "entries"), "parent_id").join(moved).withColumn("at", _own()).where(~_at("gone") & (F.col("node_id") != F.col("chad")))
    shared = F.when(F.col("ks").isNull() | F.col("chad_ks").isNull(), 0).otherwise(F.size(F.array_intersect("ks", "chad_ks")))
    on_leaf = ends.select("chad", F.col("node_id").alias("target"), "any", "stays", F.lit("edge").alias("place"), (_at("loss") - shared).alias("score"))
    change = F.when(F.col("any"), F.col("score") - F.col("stays")).otherwise(0)
    return on_inner.unionByName(on_leaf).select("chad", "target", "place", change.cast("long").alias("change"))


def _events_of(chad: DataFrame, leaves: DataFrame, full: DataFrame) -> DataFrame:
    """chad, k: the events that all leaves of a chad have."""
    one = leaves.join(F.broadcast(chad.where("is_leaf").select(F.col("chad").alias("node_id"))), "node_id", "left_semi")
    many = full.join(F.broadcast(chad.select(F.col("chad").alias("node_id"))), "node_id", "left_semi")
    return one.select(F.col("node_id").alias("chad"), F.explode("ks").alias("k")).unionByName(many.select(F.col("node_id").alias("chad"), "k"))


def _differing(nodes: DataFrame, paths: DataFrame, leaves: DataFrame, units: DataFrame, sums: DataFrame, full: DataFrame, table: DataFrame, chad: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node_id, entries: what inner nodes have other than w and nothing: for chads, gone, both (events that the chad has too) and dw (the change
    of w), and dl, a part of the sum of w from the root to the node; dl without a chad is for all.  And chad, node_id: where a chad hangs now, or,
    if that vanishes with it, the next node above that does not."""
    few = F.broadcast(chad)
    above = few.select("chad", F.col("parent_id").alias("desc_id")).join(paths.select("anc_id", "desc_id"), "desc_id").select("chad", F.col("anc_id").alias("node_id"))
    above = written(above.join(nodes.where("parent_id IS NOT NULL").select("node_id", "parent_id"), "node_id"), "above")
    # what a chad takes from the counts of all nodes above it; without a leaf its parent may have more events
    inner = sums.join(few.select(F.col("chad").alias("node_id")), "node_id").select(F.col("node_id").alias("chad"), "k", (-F.col("c")).alias("c"))
    single = F.broadcast(chad.where("is_leaf").select("chad", "parent_id"))
    lone = units.join(single, "parent_id").select("chad", "k", F.lit(-1).cast("long").alias("c"))
    rest = leaves.join(single, "parent_id").where("node_id != chad").select("chad", "ks")
    n = rest.groupBy("chad").agg(F.count("*").alias("n"))
    again = rest.select("chad", F.explode("ks").alias("k")).groupBy("chad", "k").agg(F.count("*").alias("c")).join(n, "chad").where("c = n").select("chad", "k")
    again = again.unionByName(n.select("chad", F.lit(None).cast(units.schema["k"].dataType).alias("k"))).withColumn("c", F.lit(1).cast("long"))
    taken = inner.unionByName(lone).unionByName(again)
    left = above.join(sums, "node_id").select("chad", "node_id", "k", "c").unionByName(above.join(taken, "chad").select("chad", "node_id", "k", "c"))
    left = written(left.groupBy("chad", "node_id", "k").agg(F.sum("c").alias("c")), "left")
    more = left.where("k IS NULL AND c > 0").select("chad", "node_id", F.col("c").alias("m"))
    bare = written(left.where("k IS NOT NULL").join(more, ["chad", "node_id"]).where("c = m").select("chad", "node_id", "k"), "bare")
    vanish = written(left.where("k IS NULL AND c = 0").select("chad", "node_id").join(above, ["chad", "node_id"]), "vanish")

    own = _events_of(chad, leaves, full)
    both = full.join(F.broadcast(own), "k").select("chad", "node_id").join(above, ["chad", "node_id"], "left_anti").unionByName(bare.join(own, ["chad", "k"], "left_semi").select("chad", "node_id"))
    some = sums.where("k IS NULL").select(F.col("node_id").alias("chad"))  # chads without a leaf are nobody's children
    first = chad.where("is_leaf").select("chad", "parent_id").unionByName(chad.where("NOT is_leaf").join(some, "chad", "left_semi").select("chad", "parent_id"))
    lost = first.unionByName(vanish.select("chad", "parent_id")).select("chad", F.col("parent_id").alias("node_id"))
    one = lambda rows, **has: rows.select("chad", "node_id", *(F.lit(has.get(c, 0)).alias(c) for c in ("both", "held", "lost", "over")))
    pairs = one(both, both=1).unionByName(one(bare, held=1)).unionByName(one(lost, lost=1)).unionByName(one(above, over=1))
    pairs = pairs.groupBy("chad", "node_id").agg(*(F.sum(c).alias(c) for c in ("both", "held", "lost")), F.max("over").alias("over"))
    children = F.col("children") - F.col("lost")
    held = F.when(F.col("over") == 1, F.col("held")).otherwise(F.col("full")) - F.col("both")
    own_w = F.when(F.col("parent_id").isNotNull() & (children > 1), (children - 1) * held).otherwise(0)
    pairs = written(pairs.join(table, "node_id").select("chad", "node_id", "both", (own_w - F.col("w")).alias("dw")), "pairs")

    down = pairs.where("dw != 0").select("chad", F.col("node_id").alias("anc_id"), F.col("dw").alias("dl"))
    down = down.unionByName(table.where("w != 0").select(F.lit(None).cast("string").alias("chad"), F.col("node_id").alias("anc_id"), F.col("w").alias("dl")))
    down = down.join(paths.select("anc_id", F.col("desc_id").alias("node_id")), "anc_id").groupBy("node_id", "chad").agg(F.sum("dl").alias("dl"))
    inside = paths.join(few.select(F.col("chad").alias("anc_id")), "anc_id").select(F.col("desc_id").alias("node_id"), F.col("anc_id").alias("chad"))
    gone = inside.unionByName(vanish.select("node_id", "chad")).withColumn("gone", F.lit(True))
    parts = [gone, pairs, down]
    fields = {"gone": F.lit(False), "both": F.lit(0).cast("long"), "dw": F.lit(0).cast("long"), "dl": F.lit(0).cast("long")}
    entry = lambda p: p.select("node_id", F.struct("chad", *((F.col(c).cast("long") if c in p.columns and c != "gone" else F.col(c) if c in p.columns else d).alias(c) for c, d in fields.items())).alias("entry"))
    rows = entry(parts[0]).unionByName(entry(parts[1])).unionByName(entry(parts[2]))
    now = chad.select("chad", F.col("parent_id").alias("node_id")).unionByName(vanish.select("chad", F.col("parent_id").alias("node_id"))).join(vanish, ["chad", "node_id"], "left_anti")
    return rows.groupBy("node_id").agg(F.collect_list("entry").alias("entries")), now


def _own() -> Column:
    """gone, both, dw and loss of the row's chad at the row's node, null where nothing differs."""
    mine = F.filter("entries", lambda e: e["chad"].isNull() | (e["chad"] == F.col("chad")))
    start = F.struct(F.lit(False).alias("gone"), *(F.lit(0).cast("long").alias(c) for c in ("both", "dw", "loss")))
    return F.aggregate(mine, start, lambda s, e: F.struct((s["gone"] | e["gone"]).alias("gone"), (s["both"] + e["both"]).alias("both"), (s["dw"] + e["dw"]).alias("dw"), (s["loss"] + e["dl"]).alias("loss")))


def _at(name: str) -> Column:
    return F.coalesce(F.col("at")[name], F.lit(False) if name == "gone" else F.lit(0).cast("long"))
