"""Moves of subtrees, splits, classes of trees, shuffles and rank correlation against plain loops."""

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest

from cladeframe.operators import moves, observe, offsets, stats, trees
from cladeframe.tables import sums_before

NODES = "node_id string, parent_id string, dist double, is_leaf boolean"


def random_tree(rng, leaves):
    """Parents by name; unary nodes and many children come up."""
    parent, inner = {"r": None}, ["r"]
    for k in range(leaves // 2):
        parent[f"i{k}"] = rng.choice(inner)
        inner.append(f"i{k}")
    for k, p in enumerate([*inner, *(rng.choice(inner) for _ in range(leaves))]):
        parent[f"l{k}"] = p
    return parent


def children_of(parent):
    out = defaultdict(list)
    for n, p in parent.items():
        out[p].append(n)
    return out


def score(parent, events):
    """Parsimony by folding the tree: a node has what all leaves below it have, the root nothing."""
    below = children_of(parent)

    def fold(n):
        if n.startswith("l"):
            return events[n], 0
        got = [fold(c) for c in below[n]]
        got = [g for g in got if g is not None]
        if not got:
            return None
        own = set.intersection(*(set(s) for s, _ in got)) if parent[n] is not None else set()
        return own, sum(x + len(set(s) - own) for s, x in got)

    return fold("r")[1]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_place_of_a_subtree_by_folding_again(spark, seed):
    rng = random.Random(seed)
    parent = random_tree(rng, 14)
    events = {n: frozenset(k for k in range(5) if rng.random() < 0.75) for n in parent if n.startswith("l")}
    nodes = spark.createDataFrame([(n, p, 1.0, n.startswith("l")) for n, p in parent.items()], NODES)
    table = spark.createDataFrame([(n, k) for n, s in events.items() for k in s], "node_id string, k int")
    below = children_of(parent)

    def inside(n):
        return {n}.union(*(inside(c) for c in below[n])) if below[n] else {n}

    chads = ["i0", "i3", next(n for n in parent if n.startswith("l"))]
    got = moves.rehung(nodes, trees.closure(nodes), table, spark.createDataFrame([(c,) for c in chads], "chad string")).collect()
    expected = {}
    for chad in chads:
        now = score(parent, events)
        rest = {n: p for n, p in parent.items() if n not in inside(chad)}
        alive = {n for n in rest if n.startswith("l")}
        while True:
            more = {p for n, p in rest.items() if n in alive and p is not None} - alive
            if not more:
                break
            alive |= more
        for t in alive:
            if not t.startswith("l"):
                expected[chad, t, "node"] = score({**parent, chad: t}, events) - now
            if parent[t] is not None:
                expected[chad, t, "edge"] = score({**parent, "middle": parent[t], t: "middle", chad: "middle"}, events) - now
    assert {(r.chad, r.target, r.place): r.change for r in got} == expected
    assert len(got) == len(expected) and len(set(expected.values())) > 1


def test_moves_among_nodes_without_leaves(spark):
    """They are places as well, count as nobody's children, and moving one changes nothing; the result's plan does not hold the steps before it."""
    rng = random.Random(4)
    parent = random_tree(rng, 12) | {"d0": "i0", "d1": "d0", "d2": "r", "d3": "i1"}
    events = {n: frozenset(k for k in range(5) if k < 2 or rng.random() < 0.7) for n in parent if n.startswith("l")}
    nodes = spark.createDataFrame([(n, p, 1.0, n.startswith("l")) for n, p in parent.items()], NODES)
    table = spark.createDataFrame([(n, k) for n, s in events.items() for k in s], "node_id string, k int")
    below = children_of(parent)
    inside = lambda n: {n}.union(*(inside(c) for c in below[n]))
    empty = {n for n in parent if not any(x.startswith("l") for x in inside(n))}
    held = lambda n: n if n not in empty else held(parent[n])
    leaf, now = next(n for n in parent if n.startswith("l")), score(parent, events)
    chads, expected = ["i0", "i2", leaf, "d0"], {}
    for chad in chads:
        rest = {n for n in parent if n not in inside(chad)}
        alive = {n for n in rest if any(x.startswith("l") and x in rest for x in inside(n))}
        for t in (t for t in rest if held(t) in alive):
            if not t.startswith("l"):
                expected[chad, t, "node"] = score({**parent, chad: t}, events) - now
            if parent[t] is not None:
                expected[chad, t, "edge"] = score({**parent, "middle": parent[t], t: "middle", chad: "middle"}, events) - now
    found = moves.rehung(nodes, trees.closure(nodes.where("NOT is_leaf")), table, spark.createDataFrame([(c,) for c in chads], "chad string"))
    assert {(r.chad, r.target, r.place): r.change for r in found.collect()} == expected
    assert {"d1", "d2", "d3"} <= {t for c, t, _ in expected if c == leaf} and {v for (c, *_), v in expected.items() if c == "d0"} == {0} and len(set(expected.values())) > 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") < 10 and plan.count("Aggregate ") < 5


def test_unrooted_splits_by_sets(spark):
    rng = random.Random(5)
    one = random_tree(rng, 12)
    two = dict(one)
    for n in [n for n in one if n.startswith("l")][:5]:
        two[n] = rng.choice([p for p in one if p.startswith("i")])

    def plain(parent):
        below, leaves = children_of(parent), frozenset(n for n in parent if n.startswith("l"))
        under = lambda n: frozenset([n]) if n.startswith("l") else frozenset().union(*(under(c) for c in below[n]))
        return {frozenset([s, leaves - s]) for s in map(under, parent) if 1 < len(s) < len(leaves) - 1}

    def built(parent):
        nodes = spark.createDataFrame([(n, p, 1.0, n.startswith("l")) for n, p in parent.items()], NODES)
        return trees.splits(trees.closure(nodes), nodes.where("is_leaf").select("node_id"))

    a, b = plain(one), plain(two)
    rf, counts = trees.rf_distance(built(one), built(two))
    r = counts.select("*", rf.alias("rf")).first()
    assert (r.clades_a, r.clades_b, r.unshared) == (len(a), len(b), len(a ^ b)) and r.rf == pytest.approx(len(a ^ b) / (len(a) + len(b)))


def test_classes_of_equal_trees_by_pairs(spark):
    rng = random.Random(7)
    rows, clades = [], {}
    for t in range(40):
        cut = rng.randint(1, 3)
        labels = list("abcd")[: rng.randint(2, 4)]
        groups = [g for g in (labels[:cut], labels[cut:]) if g]
        rows.append((t, f"{t}|r", None, None))
        own = {frozenset(labels)}
        for k, g in enumerate(groups):
            rows.append((t, f"{t}|{k}", f"{t}|r", None))
            own.add(frozenset(g))
            for x in g:
                rows.append((t, f"{t}|{k}{x}", f"{t}|{k}", x))
                own.add(frozenset(x))
        clades[t] = own
    got = trees.equal_trees(spark.createDataFrame(rows, "tree_id int, node_id string, parent_id string, label string")).collect()
    for r in got:
        same = [t for t in clades if clades[t] == clades[r.tree_id]]
        assert (r.first, r.trees) == (min(same), len(same))
    assert len(got) == 40


@pytest.mark.parametrize("n", [14, 1001])
def test_labels_are_shuffled_for_any_number_of_leaves(spark, n):
    rows = [(f"n{k:04d}", f"organ{k % 3}", 1 + k % 7) for k in range(n)] + [(f"n{k:04d}", "organ4", 9) for k in range(0, n, 5)]
    got = stats.shuffled_labels(spark.createDataFrame(rows, "node_id string, organ string, abundance int"), 3).collect()
    size = Counter(r[0] for r in rows)
    owned = defaultdict(list)
    for node, _, a in rows:
        owned[node].append(a)
    for k in range(3):
        mine = defaultdict(list)
        for r in got:
            if r.replicate == k:
                mine[r.node_id].append(r.abundance)
                assert r.organ in ("organ0", "organ1", "organ2", "organ4")
        assert len(mine) == n and Counter(map(len, mine.values())) == Counter(size.values())
        assert Counter(tuple(sorted(v)) for v in mine.values()) == Counter(tuple(sorted(v)) for v in owned.values())
        assert sum(sorted(mine[x]) == sorted(owned[x]) for x in owned) < n * 0.6  # moved
    first = [tuple(sorted((r.node_id, r.abundance) for r in got if r.replicate == k)) for k in range(3)]
    assert len(set(first)) == 3


def test_rank_correlation_of_many_cells(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(60), rng.randrange(900) / 7, rng.randint(1, 4)) for _ in range(1500)] + [(None, 1.0, 1), (1, None, 2)]
    kept = [r for r in rows if None not in r]
    s = sum(a[2] * b[2] * (1 if (a[0] - b[0]) * (a[1] - b[1]) > 0 else -1) for a, b in itertools.combinations(kept, 2) if (a[0] - b[0]) * (a[1] - b[1]))
    n = sum(r[2] for r in kept)
    tied = lambda k: sum(t * (t - 1) / 2 for t in [sum(r[2] for r in kept if r[k] == v) for v in {r[k] for r in kept}])
    tau = s / math.sqrt((n * (n - 1) / 2 - tied(0)) * (n * (n - 1) / 2 - tied(1)))
    df = spark.createDataFrame(rows, "x int, y double, w int")
    assert stats.kendall_tau(df.repartition(6), "x", "y", "w").first().tau == pytest.approx(tau)
    assert stats.kendall_tau(df.where("x = 3"), "x", "y", "w").first().tau is None and stats.kendall_tau(df.where("false"), "x", "y").first().tau is None


def test_sums_before_across_partitions(spark):
    """One key over all partitions, small keys within one."""
    rng = random.Random(11)
    rows = [("hot" if k % 3 else f"k{k % 40}", k, float(rng.randint(1, 9))) for k in range(600)]
    got = sums_before(spark.createDataFrame(rows, "g string, at int, v double").repartition(9), ["g"], ["at"], "v").collect()
    run = defaultdict(float)
    expected = {}
    for g, at, v in sorted(rows, key=lambda r: r[1]):
        expected[g, at] = run[g]
        run[g] += v
    assert {(r.g, r.at): r.before_v for r in got} == expected


@pytest.mark.parametrize("seed", [1, 2])
def test_fitted_tree_keeps_depths_and_has_two_children(spark, seed):
    """Every leaf at the total, every child where its offset says, no node but the root with one or more than two children (unary ones of the input aside)."""
    rng = random.Random(seed)
    parent = random_tree(rng, 16)
    below = children_of(parent)
    rows = [(n, p, n.startswith("l"), 0.0 if p is None else 0.02 + rng.random() / 50, rng.choice([0.1, 0.3, 0.3, 0.8])) for n, p in parent.items()]
    nodes = spark.createDataFrame(rows, "node_id string, parent_id string, is_leaf boolean, inner double, proportion double")
    lengths = offsets.branch_lengths(nodes, trees.closure(nodes.withColumnRenamed("inner", "dist")), 1.0)
    inner, part = {r[0]: r[3] for r in rows}, {r[0]: r[4] for r in rows}
    depth = lambda n: 1.0 if n.startswith("l") else 0.0 if parent[n] is None else depth(parent[n]) + inner[n]
    start = {}
    for r in lengths.collect():
        up = 0.0 if r.parent_id is None else depth(r.parent_id)
        off = part[r.node_id] * (depth(r.node_id) - up) if r.parent_id is not None and len(below[r.parent_id]) > 2 else 0.0
        assert (r.depth, r.offset, r.length) == (pytest.approx(depth(r.node_id)), pytest.approx(off), pytest.approx(depth(r.node_id) - up - off))
        start[r.node_id] = up + off
    made = offsets.fitted_tree(lengths).collect()
    at = {r.node_id: r for r in made}
    assert len(at) == len(made)
    height = lambda n: 0.0 if at[n].parent_id is None else at[n].dist + height(at[n].parent_id)
    kids = Counter(r.parent_id for r in made)
    for n in parent:
        lead = min((start[c] - depth(n) for c in below[n]), default=0.0) if len(below[n]) > 2 and parent[n] is not None else 0.0
        assert height(n) == pytest.approx(depth(n) + lead)
        if parent[n] is not None and len(below[parent[n]]) > 2:
            ranked = sorted(below[parent[n]], key=lambda c: (start[c] - depth(parent[n]), c))
            if n != ranked[-1]:
                assert height(at[n].parent_id) == pytest.approx(start[n])
    for r in made:
        if r.node_id in parent and len(below[r.node_id]) > 2 or r.node_id not in parent:
            assert kids[r.node_id] == 2 or (r.parent_id is None and kids[r.node_id] == 1)


def test_held_out_leaves_by_their_rules(spark):
    """Of each node with enough children a third of the groups, or one; whole groups go, one leaf of each validates; heavy groups go more often."""
    rng = random.Random(3)
    leaves = [(f"l{k}", f"s{rng.randrange(9)}" if k % 40 else "heavy", 200 if k % 40 == 0 else rng.randint(0, 2)) for k in range(400)]
    nodes = [("r", None, False)] + [(f"p{j}", "r", False) for j in range(12)] + [(n, f"p{k % 11}" if k < 390 else "p11", True) for k, (n, *_) in enumerate(leaves)]
    nodes += [("q", "r", False), ("only1", "q", True), ("only2", "q", True)]
    leaves += [("only1", "s1", 5), ("only2", "s2", 5)]
    frame = spark.createDataFrame(nodes, "node_id string, parent_id string, is_leaf boolean")
    got = observe.held_out_leaves(frame, spark.createDataFrame(leaves, "node_id string, signature string, abundance int"), 4, seed=2).collect()
    parent, kind, weight = {n: p for n, p, _ in nodes}, {n: s for n, s, _ in leaves}, {n: w for n, _, w in leaves}
    groups, children = defaultdict(set), Counter(p for _, p, _ in nodes)
    for n, s in kind.items():
        groups[parent[n], s].add(n)
    heavy, found = 0, defaultdict(set)
    for r in got:
        assert kind[r.node_id] == r.signature and parent[r.node_id] == r.parent_id != "q"
        found[r.fold, r.parent_id, r.signature].add(r.node_id)
    for (fold, p, s), out in found.items():
        assert out == groups[p, s] and sum(weight[n] for n in out) > 0 and children[p] - len(out) > 2
        assert sum(r.validation for r in got if (r.fold, r.parent_id, r.signature) == (fold, p, s)) == 1
        heavy += s == "heavy"
    for fold in range(4):
        for p in {p for p in children if p and p.startswith("p")}:
            n = sum(1 for (q, s), g in groups.items() if q == p and sum(weight[x] for x in g) > 0)
            mine = [s for f, q, s in found if (f, q) == (fold, p)]
            assert len(mine) <= max(1, int(0.33 * n))
    assert heavy > 0.8 * sum(1 for f in range(4) for (p, s) in groups if s == "heavy")


@pytest.mark.parametrize("up", [True, False])
def test_depths_do_not_depend_on_the_order_of_paths(spark, up):
    """Added up from the node to the root, whatever the order of rows: offsets that tie but for the last digit stay in one order."""
    inner = {"a": ("r", 0.1), "b": ("a", 0.2), "c": ("b", 0.3), "d": ("c", 0.7), "e": ("d", 0.05), "r": (None, 0.0)}
    nodes = spark.createDataFrame([(n, p, False, v, 0.5) for n, (p, v) in inner.items()], "node_id string, parent_id string, is_leaf boolean, inner double, proportion double")
    rows, expected = [], {}
    for n in inner:
        at, hops, total = n, 0, 0.0
        while at is not None:
            rows.append((at, n, hops))
            total, at, hops = total + inner[at][1], inner[at][0], hops + 1
        expected[n] = total
    paths = spark.createDataFrame(sorted(rows, key=lambda r: r[2] if up else -r[2]), "anc_id string, desc_id string, hops int").coalesce(1)
    assert {r.node_id: r.depth for r in offsets.branch_lengths(nodes, paths, 1.0).collect()} == expected
