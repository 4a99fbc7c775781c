"""Trees as node tables (node_id, parent_id, dist, is_leaf) and their ancestor closure (anc_id, desc_id, hops, path_len).

Many trees go in one table where the keys name the tree as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import discard, last_before, numbered, written


def closure(nodes: DataFrame) -> DataFrame:
    """Every node with its ancestors and itself, at rest.  Paths between nodes that have children are made first; nodes without
    any, most of a tree, are hung on them in one join."""
    parents = nodes.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("node_id")).distinct()
    inner = _doubled(nodes.join(parents, "node_id", "left_semi"))
    out = written(with_ends(inner, nodes.join(parents, "node_id", "left_anti")), "closure")
    discard(inner)
    return out


def with_ends(paths: DataFrame, ends: DataFrame) -> DataFrame:
    """The closure of a tree's upper nodes with further nodes, each hung on one of them and without children."""
    up = paths.select("anc_id", F.col("desc_id").alias("parent_id"), "hops", "path_len")
    own = ends.select(F.col("node_id").alias("anc_id"), F.col("node_id").alias("desc_id"), F.lit(0).alias("hops"), F.lit(0.0).alias("path_len"))
    hung = ends.select("node_id", "parent_id", "dist").join(up, "parent_id").select("anc_id", F.col("node_id").alias("desc_id"), (F.col("hops") + 1).alias("hops"), (F.col("path_len") + F.col("dist")).alias("path_len"))
    return paths.select("anc_id", "desc_id", "hops", "path_len").union(own).union(hung)


def _doubled(nodes: DataFrame) -> DataFrame:
    """Path lengths double each round until no path is as long, so a tree of depth d takes log2(d) joins; both tables are written
    each round, and lost executors take nothing with them."""
    none = F.lit(0.0)
    paths = written(nodes.select(F.col("node_id").alias("anc_id"), F.col("node_id").alias("desc_id"), F.lit(0).alias("hops"), none.alias("path_len")), "paths")
    jump = written(nodes.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("anc_id"), F.col("node_id").alias("desc_id"), F.lit(1).alias("hops"), F.col("dist").alias("path_len")), "jumps")
    while not jump.isEmpty():
        longer, further = written(paths.union(_compose(jump, paths)), "paths"), written(_compose(jump, jump), "jumps")
        for used in (paths, jump):
            discard(used)
        paths, jump = longer, further
    return paths


def _compose(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """Paths of upper followed by paths of lower."""
    a = upper.select("anc_id", F.col("desc_id").alias("mid"), F.col("hops").alias("h1"), F.col("path_len").alias("l1"))
    b = lower.select(F.col("anc_id").alias("mid"), "desc_id", F.col("hops").alias("h2"), F.col("path_len").alias("l2"))
    return a.join(b, "mid").select("anc_id", "desc_id", (F.col("h1") + F.col("h2")).alias("hops"), (F.col("l1") + F.col("l2")).alias("path_len"))


def depths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """nodes with depth (distance from the root) and level (hops)."""
    root = nodes.where("parent_id IS NULL").select(F.col("node_id").alias("anc_id"))
    return nodes.join(paths.join(F.broadcast(root), "anc_id").select(F.col("desc_id").alias("node_id"), F.col("path_len").alias("depth"), F.col("hops").alias("level")), "node_id")


def hung_depths(upper: DataFrame, ends: DataFrame) -> DataFrame:
    """ends (hung on nodes of upper, which have depth and level) with depth and level."""
    up = upper.select(F.col("node_id").alias("parent_id"), F.col("depth").alias("_depth"), F.col("level").alias("_level"))
    return ends.join(up, "parent_id").select(*ends.columns, (F.col("_depth") + F.col("dist")).alias("depth"), (F.col("_level") + 1).alias("level"))


def all_depths(nodes: DataFrame, upper: DataFrame) -> DataFrame:
    """depths by a closure that may lack the leaves, which take theirs from their parents."""
    inner = depths(nodes.where("NOT is_leaf"), upper)
    return inner.unionByName(hung_depths(inner, nodes.where("is_leaf")))


def nearest_above(nodes: DataFrame, paths: DataFrame, kept: DataFrame) -> DataFrame:
    """node_id, kept_id, same: every node with the first kept one (node_id) on its way up, itself included; paths may lack the leaves,
    which are looked up by their parents."""
    named = kept.select(F.col("node_id").alias("anc_id"))
    near = paths.join(named, "anc_id", "left_semi").groupBy(F.col("desc_id").alias("node_id")).agg(F.min_by("anc_id", "hops").alias("kept_id"))
    inner = nodes.where("NOT is_leaf").join(near, "node_id").select("node_id", "kept_id")
    leaves = nodes.where("is_leaf").join(kept.select("node_id", F.lit(True).alias("own")), "node_id", "left").select("node_id", "parent_id", "own")
    hung = leaves.where("own IS NULL").join(near.select(F.col("node_id").alias("parent_id"), "kept_id"), "parent_id").select("node_id", "kept_id")
    out = inner.unionByName(leaves.where("own").select("node_id", F.col("node_id").alias("kept_id"))).unionByName(hung)
    return out.withColumn("same", F.col("node_id") == F.col("kept_id"))


def nearest_kept(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """The tree of the kept nodes (node_id; the root among them): each hangs on its nearest kept ancestor at the whole length of the path.

    Pointers to parents that go are replaced by those parents' own, so runs of such parents double each round and no closure
    is needed: a round reads and writes a row for each node, even where the tree is one long chain."""
    step = written(nodes.select("node_id", F.col("parent_id").alias("to"), F.col("dist").alias("length")), "pointers")
    gone = written(nodes.select("node_id").join(kept.select("node_id"), "node_id", "left_anti"), "gone")
    while True:
        onward = step.join(gone, "node_id", "left_semi").select(F.col("node_id").alias("to"), F.col("to").alias("next"), F.col("length").alias("more"))
        moved = written(step.join(onward, "to", "left").select("node_id", F.coalesce("next", "to").alias("to"), (F.col("length") + F.coalesce("more", F.lit(0.0))).alias("length"), F.col("next").isNotNull().alias("moved")), "pointers")
        discard(step)
        if moved.where("moved").isEmpty():
            break
        step = moved.drop("moved")
        step.written_to = moved.written_to
    out = nodes.join(gone, "node_id", "left_anti").drop("parent_id", "dist")
    return out.join(moved.select("node_id", F.col("to").alias("parent_id"), F.when(F.col("to").isNull(), 0.0).otherwise(F.col("length")).alias("dist")), "node_id")


def collapse_short(nodes: DataFrame, shortest: float = 0.0) -> DataFrame:
    """Internal nodes on branches of at most shortest go; their children hang on the next node that stays."""
    return nearest_kept(nodes, nodes.where((F.col("parent_id").isNull()) | F.col("is_leaf") | (F.col("dist") > shortest)))


def with_kept_leaves(nodes: DataFrame, paths: DataFrame, leaves: DataFrame) -> DataFrame:
    """The nodes that have a kept leaf (node_id) below them, or are one."""
    above = paths.join(leaves.select(F.col("node_id").alias("desc_id")), "desc_id", "left_semi").select(F.col("anc_id").alias("node_id")).distinct()
    return nodes.join(above, "node_id", "left_semi")


def branching(nodes: DataFrame) -> DataFrame:
    """Nodes that stay when chains of single children are suppressed: the root, leaves, and nodes with two children or more."""
    children = nodes.groupBy("parent_id").count().withColumnRenamed("parent_id", "p")
    return nodes.join(children, nodes.node_id == F.col("p"), "left").where(F.col("parent_id").isNull() | F.col("p").isNull() | (F.col("count") > 1)).drop("p", "count")


def leaf_values(paths: DataFrame, leaves: DataFrame, *columns: str) -> DataFrame:
    """anc_id with the columns of every leaf below it, leaves included."""
    return paths.join(leaves.select(F.col("node_id").alias("desc_id"), *columns), "desc_id")


def common_ancestors(paths: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with mrca and the distance from a to it: the shared ancestor with the fewest hops above a."""
    above = lambda end, *more: paths.select(F.col("desc_id").alias(end), F.col("anc_id").alias("mrca"), *more)
    both = pairs.join(above("a", F.col("hops").alias("h"), F.col("path_len").alias("l")), "a").join(above("b"), ["b", "mrca"])
    return both.groupBy("a", "b").agg(F.min_by(F.struct("mrca", "l"), "h").alias("m")).select("a", "b", "m.mrca", F.col("m.l").alias("to_mrca"))


def shared_events(nodes: DataFrame, paths: DataFrame, events: DataFrame) -> DataFrame:
    """node_id, k: the events of every node, from distinct events (node_id, k) of leaves.  A node has those that all leaves
    below it have, so that no event is ever lost on the way down; the root is unmodified."""
    size, held = event_counts(nodes, paths, events)
    full = held.join(size.where("NOT is_leaf"), "node_id").where("c = n").select("node_id", "k")
    return full.unionByName(nodes.where("is_leaf AND parent_id IS NOT NULL").select("node_id").join(events.select("node_id", "k"), "node_id"))


def event_counts(nodes: DataFrame, paths: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of every node but the root: node_id, is_leaf, n (leaves below it or itself), and of inner nodes but the root: node_id, k, c (leaves with event
    k).  events: distinct node_id, k of leaves.  Leaves are added up by parent and event first, so paths may lack them."""
    ends = nodes.where("is_leaf AND parent_id IS NOT NULL").select("node_id", "parent_id")
    up = paths.join(nodes.where("parent_id IS NOT NULL AND NOT is_leaf").select(F.col("node_id").alias("anc_id")), "anc_id", "left_semi").select(F.col("anc_id").alias("node_id"), F.col("desc_id").alias("parent_id"))
    leaves = ends.groupBy("parent_id").agg(F.count("*").alias("n"))
    size = up.join(leaves, "parent_id").groupBy("node_id").agg(F.sum("n").alias("n")).select("node_id", F.lit(False).alias("is_leaf"), "n")
    size = size.unionByName(ends.select("node_id", F.lit(True).alias("is_leaf"), F.lit(1).cast("long").alias("n")))
    own = events.select("node_id", "k").join(ends, "node_id").groupBy("parent_id", "k").agg(F.count("*").alias("c"))
    return size, up.join(own, "parent_id").groupBy("node_id", "k").agg(F.sum("c").alias("c"))


def new_events(nodes: DataFrame, states: DataFrame) -> DataFrame:
    """node_id, parent_id, k: the events of a node that its parent has not, over all edges; their number is the parsimony score."""
    own = states.join(nodes.where("parent_id IS NOT NULL").select("node_id", "parent_id"), "node_id")
    return own.join(states.select(F.col("node_id").alias("parent_id"), "k"), ["parent_id", "k"], "left_anti").select("node_id", "parent_id", "k")


def clades(paths: DataFrame, leaves: DataFrame) -> DataFrame:
    """A signature of each node's set of leaves: their number and the sum and xor of their hashes, added up without lists."""
    h = F.xxhash64("desc_id")
    below = paths.join(leaves.select(F.col("node_id").alias("desc_id")), "desc_id", "left_semi")
    return below.groupBy("anc_id").agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"))


def rf_distance(a: DataFrame, b: DataFrame) -> tuple[Column, DataFrame]:
    """Clades of more than one leaf in one tree but not the other; the Column divides by the clades of both."""
    mark = lambda t, name: t.where("n > 1").select("n", "s", "x").distinct().withColumn(name, F.lit(1))
    both = mark(a, "in_a").join(mark(b, "in_b"), ["n", "s", "x"], "full")
    counts = both.agg(F.count("in_a").alias("clades_a"), F.count("in_b").alias("clades_b"), F.count(F.when(F.col("in_a").isNull() | F.col("in_b").isNull(), 1)).alias("unshared"))
    return F.col("unshared") / (F.col("clades_a") + F.col("clades_b")), counts


def splits(paths: DataFrame, leaves: DataFrame) -> DataFrame:
    """A signature (n, s, x) of the split of leaves at each node but for those with fewer than two leaves on a side: of both sides' signatures
    the smaller one, the other side's following from the whole tree's sums.  Equal splits have one row."""
    own = clades(paths, leaves)
    h = F.xxhash64("node_id")
    whole = leaves.agg(F.count("*").alias("all_n"), F.sum(h.cast("decimal(38,0)")).alias("all_s"), F.bit_xor(h).alias("all_x"))
    side = F.struct("n", "s", "x")
    other = F.struct((F.col("all_n") - F.col("n")).alias("n"), (F.col("all_s") - F.col("s")).cast("decimal(38,0)").alias("s"), F.col("all_x").bitwiseXOR(F.col("x")).alias("x"))
    both = own.join(F.broadcast(whole)).select(side.cast("struct<n:long,s:decimal(38,0),x:long>").alias("a"), other.cast("struct<n:long,s:decimal(38,0),x:long>").alias("b"))  # one row
    return both.where("a.n > 1 AND b.n > 1").select(F.least("a", "b").alias("side")).select("side.*").distinct()


def equal_trees(nodes: DataFrame) -> DataFrame:
    """tree_id, first, trees: of many trees in one table (tree_id, node_id, parent_id, label of leaves; node ids tell trees apart) those with
    equal clades of labels, named by their first tree, and how many they are.

    A digest goes up from the leaves: pointers to ancestors double each round and carry each leaf's label to all nodes above it, where
    numbers, sums and xors of hashes name a clade; a tree's distinct clades are added up in the same way."""
    paths = closure(nodes.select("node_id", "parent_id", F.lit(0.0).alias("dist")))
    labels = nodes.where("label IS NOT NULL").select(F.col("node_id").alias("desc_id"), F.xxhash64("label").alias("h"))
    sums = lambda h: (F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"))
    clade = paths.join(labels, "desc_id").groupBy("anc_id").agg(*sums(F.col("h")))
    own = clade.join(nodes.select(F.col("node_id").alias("anc_id"), "tree_id"), "anc_id").select("tree_id", "n", "s", "x").distinct()
    trees = own.withColumn("h", F.xxhash64("n", "s", "x")).groupBy("tree_id").agg(*sums(F.col("h")))
    classes = trees.groupBy("n", "s", "x").agg(F.min("tree_id").alias("first"), F.count("*").alias("trees"))
    return trees.join(classes, ["n", "s", "x"]).select("tree_id", "first", "trees")


def spines(children: DataFrame, most: int = 2) -> DataFrame:
    """Children (node_id, parent_id, offset) of nodes with more than most, in the order in which they leave a spine that resolves the node."""
    own = Window.partitionBy("parent_id")
    ranked = children.withColumn("n", F.count("*").over(own)).where(F.col("n") > most)
    return ranked.withColumn("spine_ord", F.row_number().over(own.orderBy("offset", "node_id")))


def tissue_distances(nodes: DataFrame, paths: DataFrame, tissues: DataFrame, *by: str) -> DataFrame:
    """organ, other, one_way, distance, n: for each tissue and other tissue the mean, weighted by abundance over the leaves of the
    first, of 1 - depth of the nearest node up from the leaf, itself included and the root not, that has the other among its
    leaves (at the leaf itself half its branch); distance is the mean of both ways.  tissues: node_id, organ, abundance,
    several rows for a leaf of several tissues, and by, columns that name labellings of the same tree.  Without a tissue's leaves: prune the tree first.

    Leaves are added up by parent and tissue first, and only parents look for tissues above them; paths may lack the leaves."""
    ends = nodes.where("parent_id IS NOT NULL").select("node_id", "parent_id", "dist")
    own = tissues.join(ends, "node_id").groupBy(*by, "node_id", "parent_id", "dist").agg(F.collect_set(F.struct("organ", "abundance")).alias("own"))
    return distances_of_sets(nodes, paths, own, *by)


def heights(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """node_id, height (1 - depth) of all nodes of the closure but the root."""
    root = nodes.where("parent_id IS NULL").select(F.col("node_id").alias("anc_id"))
    return paths.where("hops > 0").join(F.broadcast(root), "anc_id").select(F.col("desc_id").alias("node_id"), (1 - F.col("path_len")).alias("height"))


def numbered_inner(nodes: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A tree's inner nodes and their closure with numbers for names, as numbers are quicker to sort and to join; and the leaves: node_id,
    parent_id (a number), dist, height (of the parent, null at the root)."""
    inner = nodes.where("NOT is_leaf")
    ids = written(numbered(inner.select("node_id"), "node_id").join(heights(nodes, paths), "node_id", "left"), "inner-numbers")
    end = lambda name, *more: ids.select(F.col("node_id").alias(name), F.col("row_number").alias(f"_{name}"), *more)
    named = lambda rows, *names: rows.drop(*names).withColumnsRenamed({f"_{n}": n for n in names})
    tops = written(named(inner.join(end("node_id"), "node_id").join(end("parent_id"), "parent_id", "left"), "node_id", "parent_id"), "nodes")
    up = paths.join(end("anc_id"), "anc_id").join(end("desc_id"), "desc_id")
    leaves = nodes.where("is_leaf").select("node_id", "parent_id", "dist").join(end("parent_id", "height"), "parent_id")
    return tops, written(named(up, "anc_id", "desc_id").select(paths.columns), "closure"), named(leaves, "parent_id").select("node_id", "parent_id", "dist", "height")


def distances_of_sets(nodes: DataFrame, paths: DataFrame, sets: DataFrame, *by: str) -> DataFrame:
    """tissue_distances of leaves with all their tissues in a row: sets has by, parent_id, dist, own (array of organ and abundance), and perhaps height
    (of the parent, null at the root).

    A parent's tissues are one row, in which every two of them meet; a parent that has a tissue is the nearest, and only for those that it
    has not are the nodes above it gone through.  Keys begin with the parent, by which rows are told apart soonest."""
    high = heights(nodes, paths)
    sets = sets.where("parent_id IS NOT NULL")
    if "height" not in sets.columns:
        sets = sets.join(high.withColumnRenamed("node_id", "parent_id"), "parent_id", "left")
    place, kind = [*by, "parent_id", "dist", "height"], sets.schema["own"].dataType.elementType["organ"].dataType
    first, none = F.col("own")[0], F.lit(None).cast(kind)
    single = sets.where("size(own) = 1").select(*place, first["organ"].alias("organ"), first["abundance"].alias("abundance"), none.alias("other"))
    several = sets.where("size(own) > 1").select(*place, F.array_compact(F.array_distinct(F.col("own")["organ"])).alias("all"), F.explode("own").alias("x")).select(*place, "all", "x.*").where("organ IS NOT NULL")
    others = F.concat(F.array(none), F.array_remove("all", F.col("organ")))  # without another: all leaves; with one: those that have it themselves
    each = single.where("organ IS NOT NULL").unionByName(several.select(*place, "organ", "abundance", F.explode(others).alias("other")))
    w = F.col("abundance")
    counts = each.groupBy("parent_id", *by, "organ", "other").agg(F.sum(w).alias("w"), F.sum(F.col("dist") / 2 * w).alias("halves"), F.count("*").alias("n"), F.max("height").alias("height"))
    counts = written(counts, "tissue-counts")
    parents = counts.where("other IS NULL").groupBy("parent_id", *by).agg(F.collect_list(F.struct("organ", "w", "n")).alias("own"), F.max("height").alias("height"))
    parents = written(parents.where("height IS NOT NULL"), "parents")  # those below the root no other node counts
    sums = lambda rows: rows.groupBy(*by, "organ", "other").agg(*(F.sum(c).alias(c) for c in ("total", "w", "n")))

    alone = lambda c: F.when(F.col("height").isNull(), F.col(c)).otherwise(0).alias(c)
    itself = counts.where("other IS NOT NULL").select(*by, "organ", "other", (F.col("halves") - F.coalesce("height", F.lit(0.0)) * F.col("w")).alias("total"), alone("w"), alone("n"))
    near = parents.select(*by, "height", F.col("own")["organ"].alias("there"), F.inline("own")).select(*by, "height", "organ", "w", "n", F.explode("there").alias("other"))
    near = near.where("organ != other").select(*by, "organ", "other", (F.col("height") * F.col("w")).alias("total"), "w", "n")

    have = parents.select("parent_id", *by, F.sort_array(F.col("own")["organ"]).alias("have"))
    every = counts.where("other IS NULL").select(*by, "organ").distinct().groupBy(*by).agg(F.collect_set("organ").alias("every"))  # a row for each labelling
    lacks = (have.join(F.broadcast(every), list(by)) if by else have.join(F.broadcast(every))).select("parent_id", *by, F.explode(F.array_except("every", "have")).alias("other"))
    above = paths.where("hops > 0").select("anc_id", F.col("desc_id").alias("parent_id"), "hops").join(high.select(F.col("node_id").alias("anc_id"), F.col("height").alias("length")), "anc_id")
    above = written(above, "above-parents")
    over = paths.select("anc_id", F.col("desc_id").alias("parent_id")).join(above.select("anc_id").distinct(), "anc_id", "left_semi")  # nodes above others, with those and themselves
    there = have.join(over, "parent_id").groupBy("anc_id", *by, "have").agg(F.count("*")).select("anc_id", *by, F.explode("have").alias("other")).distinct()
    found = written(lacks, "lacking").join(above, "parent_id").join(written(there, "tissues-above"), ["anc_id", *by, "other"])
    found = found.groupBy("parent_id", *by, "other").agg(F.min_by("length", "hops").alias("length"))
    far = found.join(parents.drop("height"), ["parent_id", *by]).select(*by, "other", "length", F.inline("own"))
    far = far.select(*by, "organ", "other", (F.col("length") * F.col("w")).alias("total"), "w", "n")

    one = sums(sums(itself).unionByName(sums(near)).unionByName(sums(far))).select(*by, "organ", "other", (F.col("total") / F.col("w")).alias("one_way"), "n")
    one = written(one, "one-way")
    back = one.select(*by, F.col("organ").alias("other"), F.col("other").alias("organ"), F.col("one_way").alias("back"))
    return one.join(back, [*by, "organ", "other"], "left").select(*by, "organ", "other", "one_way", ((F.col("one_way") + F.col("back")) / 2).alias("distance"), "n")


def flows(nodes: DataFrame, placed: DataFrame, labels: DataFrame, grid: DataFrame) -> DataFrame:
    """Branches that cross each time of the grid (t), by the label of their lower node: nodes joined with their depth and their parent's."""
    up = placed.select(F.col("node_id").alias("parent_id"), F.col("depth").alias("from"))
    branch = placed.join(up, "parent_id").join(labels, "node_id")
    return branch.join(F.broadcast(grid), (F.col("from") < F.col("t")) & (F.col("t") < F.col("depth")))


def traversal(nodes: DataFrame, paths: DataFrame, order: str = "node_id") -> DataFrame:
    """node_id, level, preorder, postorder, level_order: numbers from 0, children by a column of nodes.

    A node's place is the path of its ancestors' ranks among their sisters; preorder sorts by it, and postorder follows
    from it, the level and the size of the subtree.  Leaves follow from their parents, so paths may lack them."""
    rank = F.row_number().over(Window.partitionBy("parent_id").orderBy(order))
    ranks = nodes.select("node_id", "parent_id", "is_leaf", F.lpad(rank.cast("string"), 12, "0").alias("rank"))
    inner, ends = ranks.where("NOT is_leaf"), ranks.where("is_leaf")
    up = paths.join(inner.select(F.col("node_id").alias("desc_id")), "desc_id", "left_semi")
    keys = up.join(inner.select(F.col("node_id").alias("anc_id"), "rank"), "anc_id").groupBy(F.col("desc_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("hops")).alias("up"), "rank"))).alias("k"), (F.count("*") - 1).cast("int").alias("level"))
    keys = keys.select("node_id", "level", F.array_join(F.transform("k", lambda x: x["rank"]), ".").alias("key"))
    own = ends.groupBy(F.col("parent_id").alias("desc_id")).agg(F.count("*").alias("leaves"))
    sizes = up.join(own, "desc_id", "left").groupBy(F.col("anc_id").alias("node_id")).agg((F.count("*") + F.coalesce(F.sum("leaves"), F.lit(0))).alias("size"))
    hung = ends.join(keys.select(F.col("node_id").alias("parent_id"), "level", "key"), "parent_id", "left")
    hung = hung.select("node_id", F.coalesce(F.col("level") + 1, F.lit(0)).alias("level"), F.concat_ws(".", "key", "rank").alias("key"), F.lit(1).cast("long").alias("size"))
    placed = keys.join(sizes, "node_id").unionByName(hung)
    first = numbered(placed, "key").withColumnRenamed("row_number", "preorder")
    both = numbered(first, "level", "key").withColumnRenamed("row_number", "level_order")
    return both.select("node_id", "level", "preorder", (F.col("preorder") - F.col("level") + F.col("size") - 1).alias("postorder"), "level_order")


def collapse_same_alleles(nodes: DataFrame, paths: DataFrame, placed: DataFrame) -> DataFrame:
    """The tree that can't tell nodes of one allele apart (node_id, parent_id, dist, is_leaf, abundance).

    nodes have label (allele) and abundance; placed: node_id, depth, level.  Nodes joined by branches without a change of
    allele are a chain, named by its first.  Along time (then level and id) each of a chain hangs on the one before it, and
    one that coincides with it has one abundance more; the first hangs where it did.  Nodes with one child then go.

    A chain may be most of the tree: its nodes are numbered by a range shuffle and found by their numbers.  paths may lack the leaves."""
    up = nodes.select(F.col("node_id").alias("parent_id"), F.col("label").alias("above"))
    changed = nodes.join(up, "parent_id", "left").where(~F.col("label").eqNullSafe(F.col("above")) | F.col("parent_id").isNull()).select("node_id")
    first = nearest_above(nodes, paths, changed).select("node_id", F.col("kept_id").alias("chain"))
    rows = nodes.join(first, "node_id").join(placed.select("node_id", "depth", "level"), "node_id").withColumn("at", F.round("depth", 9))  # heights that sums make differ in the last digits are one
    ranked = written(numbered(rows, "chain", "at", "level", "node_id", without=("at", "level", "label")), "ranked")
    ahead = ranked.select((F.col("row_number") + 1).alias("row_number"), "chain", F.col("node_id").alias("before"), F.col("depth").alias("reached"))
    linked = ranked.join(ahead, ["row_number", "chain"], "left").withColumn("gap", F.col("depth") - F.col("reached"))
    linked = written(linked.select("row_number", "node_id", F.coalesce("before", "parent_id").alias("parent_id"), F.col("before").isNull().alias("first"), "depth", "dist", "gap", "is_leaf", "abundance"), "linked")
    kept = branching(linked.select("node_id", "parent_id")).select("node_id")
    marked = linked.join(kept.withColumn("kept", F.lit(True)), "node_id", "left")
    # pointers go to the last node of the chain that stays, or to its first one, so that they are few however long the chain
    new = F.col("first") | (F.col("gap") > 1e-8)
    start = F.struct("row_number", F.when(F.col("first"), F.col("abundance")).otherwise(F.lit(1)).alias("abundance"))
    seen = last_before(marked, "row_number", on=F.when(F.col("first") | F.col("kept"), F.struct("node_id", "depth")), run=F.when(new, start))
    run = F.when(new, start).otherwise(F.col("run"))
    bumped = run["abundance"] + F.col("row_number") - run["row_number"]
    parent, dist = F.when(F.col("first"), F.col("parent_id")).otherwise(F.col("on.node_id")), F.when(F.col("first"), F.col("dist")).otherwise(F.col("depth") - F.col("on.depth"))
    moved = written(seen.select("node_id", parent.alias("parent_id"), dist.alias("dist"), "is_leaf", bumped.alias("abundance"), "kept"), "collapsed")
    return nearest_kept(moved.drop("kept"), moved.where("kept").select("node_id")).select("node_id", "parent_id", "dist", "is_leaf", "abundance")


def without_unchanged(nodes: DataFrame) -> DataFrame:
    """nodes (with label) less inner nodes of their parent's allele; then those with one child go.  Branches are 1 where the allele changes, else 0."""
    up = nodes.select(F.col("node_id").alias("parent_id"), F.col("label").alias("above"))
    counted = nodes.join(up, "parent_id", "left").select("node_id", "parent_id", F.when(F.col("parent_id").isNull() | F.col("label").eqNullSafe(F.col("above")), 0.0).otherwise(1.0).alias("dist"), "is_leaf")
    counted = written(counted, "counted")
    short = written(collapse_short(counted), "short")
    return nearest_kept(short, branching(short)).select("node_id", "parent_id", "dist", "is_leaf")


def merged_tissues(tissues: DataFrame, groups: DataFrame, without: list[str]) -> DataFrame:
    """node_id, organ: organs under the name of their group (groups: organ, name), but for those left out."""
    return tissues.join(F.broadcast(groups), "organ", "left").select("node_id", F.coalesce("name", "organ").alias("organ")).where(~F.col("organ").isin(*without)).distinct()


def tissue_labels(nodes: DataFrame, paths: DataFrame, merged: DataFrame) -> DataFrame:
    """node_id, label: the sorted first letters of the tissues below each node; a set has at most one letter a tissue.

    A parent's tissues are put together before they go to the nodes above it, so paths may lack the leaves."""
    ends = merged.join(nodes.select("node_id", "parent_id"), "node_id")
    above = paths.select("anc_id", F.col("desc_id").alias("parent_id")).join(ends.select("parent_id", "organ").distinct(), "parent_id").select(F.col("anc_id").alias("node_id"), "organ")
    own = merged.select("node_id", "organ").unionByName(above)
    below = own.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("organ")), lambda o: F.substring(o, 1, 1)), "").alias("label"))
    return nodes.select("node_id").join(below, "node_id", "left").select("node_id", F.coalesce("label", F.lit("")).alias("label"))


def flow(nodes: DataFrame, paths: DataFrame, tissues: DataFrame, labels: DataFrame, times: int) -> DataFrame:
    """progenitor, time, leaf_id, freq of leaves of one tissue: at each time the label of the branch's end, with the leaf's share of
    abundance; time 0 is the root, ``times`` the leaf itself.  tissues: node_id, organ, abundance; labels: node_id, label."""
    single = tissues.groupBy("node_id").agg(F.count("*").alias("k"), F.first("abundance").alias("abundance")).where("k = 1").select(F.col("node_id").alias("leaf_id"), "abundance")
    placed = depths(nodes, paths)
    above = placed.select(F.col("node_id").alias("parent_id"), F.col("depth").alias("from"))
    branches = placed.join(above, "parent_id").select(F.col("node_id").alias("anc_id"), "from", "depth")
    grid = nodes.sparkSession.range(1, times).select(F.col("id").cast("int").alias("time"), (F.col("id") / times).alias("t"))
    crossed = branches.join(F.broadcast(grid), (F.col("from") < F.col("t")) & (F.col("depth") > F.col("t"))).select("anc_id", "time")
    up = paths.select("anc_id", F.col("desc_id").alias("leaf_id"))
    ends = single.select(F.col("leaf_id").alias("anc_id"), F.lit(times).alias("time"), "leaf_id", "abundance")
    roots = up.join(F.broadcast(nodes.where("parent_id IS NULL").select(F.col("node_id").alias("anc_id"))), "anc_id").join(single, "leaf_id").select("anc_id", F.lit(0).alias("time"), "leaf_id", "abundance")
    inner = up.join(single, "leaf_id").join(crossed, "anc_id").select("anc_id", "time", "leaf_id", "abundance")
    total = single.agg(F.sum("abundance").alias("total"))
    named = ends.unionByName(roots).unionByName(inner).join(labels.select(F.col("node_id").alias("anc_id"), F.col("label").alias("progenitor")), "anc_id")
    return named.join(F.broadcast(total)).select("progenitor", "time", "leaf_id", (F.col("abundance") / F.col("total")).alias("freq"))


def time_links(nodes: DataFrame, paths: DataFrame, labels: DataFrame, buckets: int = 10) -> DataFrame:
    """source, target (labels), bucket, n: the graph of labels by time bucket.  A branch that crosses buckets gives a link for
    each: up to the middle under the label of its source (the last node above whose own branch crossed one, or the root), at
    the middle from that to its own, then under its own; n counts distinct nodes at the links' start.  Sources are looked for by
    parents, so paths may lack the leaves."""
    at = F.floor(F.col("depth") * buckets + 1e-9).cast("int")
    placed = all_depths(nodes, paths).withColumn("at", at)
    up = placed.select(F.col("node_id").alias("parent_id"), F.col("at").alias("from"))
    steps = placed.join(up, "parent_id", "left").select("node_id", "parent_id", F.coalesce("from", F.lit(0)).alias("from"), "at")
    turns = steps.where("parent_id IS NULL OR at > from").select(F.col("node_id").alias("anc_id"))
    parents = nodes.select("parent_id").distinct()
    near = paths.withColumnRenamed("desc_id", "parent_id").join(parents, "parent_id", "left_semi").join(turns, "anc_id").groupBy("parent_id").agg(F.min_by("anc_id", "hops").alias("source_id"))
    crossing = steps.where("parent_id IS NOT NULL AND at > from").join(near, "parent_id")
    half = F.expr("from + (at - from) div 2")
    each = crossing.select("node_id", "source_id", half.alias("half"), F.explode(F.expr("sequence(from, at - 1)")).alias("bucket"))
    first, second = F.when(F.col("bucket") <= F.col("half"), F.col("source_id")).otherwise(F.col("node_id")), F.when(F.col("bucket") < F.col("half"), F.col("source_id")).otherwise(F.col("node_id"))
    ends = each.select("bucket", first.alias("one"), second.alias("two"))
    name = lambda n: labels.select(F.col("node_id").alias(n), F.col("label").alias(f"label_{n}"))
    named = ends.join(name("one"), "one").join(name("two"), "two")
    return named.groupBy(F.col("label_one").alias("source"), F.col("label_two").alias("target"), "bucket").agg(F.count_distinct("one").alias("n"))


def organ_pair_lengths(paths: DataFrame, nodes: DataFrame, tissues: DataFrame) -> DataFrame:
    """organ, other, total: over all leaves of the one and of the other the distance from the first to their last common ancestor.

    Along the way up from a leaf each branch counts for the other's leaves not below it, so the total is that of the leaves'
    depths times the number of the others, less each branch times the leaves of both below it: no pairs of leaves are made."""
    below = leaf_values(paths, tissues, "organ").groupBy("anc_id", "organ").agg(F.count("*").alias("n"))
    placed = depths(nodes, paths)
    whole = tissues.join(placed.select("node_id", "depth"), "node_id").groupBy("organ").agg(F.count("*").alias("leaves"), F.sum("depth").alias("depths"))
    side = lambda n, d: d.select("anc_id", F.col("organ").alias(n), F.col("n").alias(f"n_{n}"))
    own = below.join(nodes.where("parent_id IS NOT NULL").select(F.col("node_id").alias("anc_id"), "dist"), "anc_id")
    shared = side("organ", own).join(side("other", own).join(own.select("anc_id", "dist").distinct(), "anc_id"), "anc_id").groupBy("organ", "other").agg(F.sum(F.col("n_organ") * F.col("n_other") * F.col("dist")).alias("shared"))
    pairs = whole.select("organ", "depths").join(F.broadcast(whole.select(F.col("organ").alias("other"), "leaves")))  # a row for each two tissues
    return pairs.join(shared, ["organ", "other"], "left").select("organ", "other", (F.col("depths") * F.col("leaves") - F.coalesce("shared", F.lit(0.0))).alias("total"))


def newick(nodes: DataFrame, levels: DataFrame) -> DataFrame:
    """tree_id, newick of many trees (tree_id, node_id, parent_id, dist; levels: node_id, level): strings of children, by id, are put
    together level by level.  A tree is one string in the end, so trees must be of a size that a row holds."""
    held = written(nodes.join(levels.select("node_id", "level"), "node_id"), "levels")
    text = None
    for level in range(held.agg(F.max("level")).first()[0] or 0, -1, -1):
        here = held.where(F.col("level") == level)
        inner = F.lit("") if text is None else F.coalesce(F.concat(F.lit("("), F.col("inner"), F.lit(")")), F.lit(""))
        if text is not None:
            here = here.join(text, "node_id", "left")
        lines = here.select("tree_id", "node_id", "parent_id", F.concat(inner, F.col("node_id"), F.lit(":"), F.format_string("%.3f", F.col("dist"))).alias("line"))
        lines = written(lines, "lines")
        text = lines.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("node_id").alias("n"), "line"))), lambda x: x["line"]), ",").alias("inner"))
        done = lines.where("parent_id IS NULL").select("tree_id", F.concat("line", F.lit(";")).alias("newick"))
        out = done if level == (held.agg(F.max("level")).first()[0] or 0) else out.union(done)
    return out


def perfect_conflicts(carriers: DataFrame) -> DataFrame:
    """a, b, shared: two events (carriers: taxon, event) that some taxa share though neither's taxa hold the other's; a perfect phylogeny
    has none.  Pairs are counted within a taxon, which has few events."""
    size = carriers.groupBy("event").agg(F.count("*").alias("n"))
    side = lambda n: carriers.select("taxon", F.col("event").alias(n))
    both = side("a").join(side("b"), "taxon").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    count = lambda n: size.select(F.col("event").alias(n), F.col("n").alias(f"n_{n}"))
    return both.join(count("a"), "a").join(count("b"), "b").where("shared < n_a AND shared < n_b").select("a", "b", "shared")
