"""Operators on small cases worked out by hand or by plain loops over all pairs."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.functions import reads, sequences
from cladeframe.functions import states as sa
from cladeframe.operators import ancestors, compare, fits, observe, reshape, trees
from cladeframe.sources import reads as read_source
from cladeframe.sources import sequences as sequence_source
from cladeframe.tables import bounded, new_path, numbered

DESIGN = reads.Design(tuple(19 + 27 * t for t in range(10)), tuple(13 + 27 * t for t in range(10)), tuple(24 + 27 * t for t in range(10)), 284)
NODES = "node_id string, parent_id string, dist double, is_leaf boolean"


def sg(start, length, nd, lo, hi, xd, inserted=""):
    return (start, length, nd, lo, hi, xd, inserted)


def wc(lo, hi):
    return (None, None, lo, lo, hi, hi, None)


def rows_of(state):
    return [tuple(x) for x in state]


def meets(spark, pairs):
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], f"k int, a {sa.STATE}, b {sa.STATE}")
    return [rows_of(r.m) for r in df.select("k", sa.intersect(F.col("a"), F.col("b")).alias("m")).orderBy("k").collect()]


def test_design_numbers():
    """Cuts, windows and trims of a barcode of ten targets, 23 bases each with 4 between."""
    parts = ["CG"] + ["G" * 23 if k % 2 == 0 else "AGTC" for k in range(19)] + ["G" + "A" * 15]
    d = reads.Design.of(parts)
    assert d.cuts == tuple(19 + 27 * k for k in range(10)) and d.length == 284
    rows = d.rows()
    assert rows[0] == (0, 19, 13, 24, 19, 22, 19, 26) and rows[1] == (1, 46, 40, 51, 22, 22, 26, 26) and rows[9] == (9, 262, 256, 267, 22, 21, 26, 21)


def test_states_meet(spark):
    long_cut, inside = sg(10, 90, 0, 0, 3, 3), sg(60, 5, 2, 2, 2, 2)
    cases = [
        ([long_cut], [long_cut]),  # the same
        ([long_cut], [inside]),  # masked by the other
        ([long_cut], [wc(1, 5)]),  # common part of the wildcards
        ([inside], [sg(61, 5, 2, 2, 2, 2)]),  # nothing in common
        ([], [inside]),
        ([sg(60, 30, 1, 2, 2, 2), sg(20, 2, 1, 1, 1, 1)][::-1], [sg(60, 30, 1, 2, 2, 2)]),  # long side on a target where the other list ends short
    ]
    assert meets(spark, cases) == [[long_cut], [inside], [wc(1, 2)], [], [], []]


def test_fold_goes_through_all_children(spark, monkeypatch):
    """Folded two at a time a node has what a loop over its children gives."""
    rng = random.Random(2)

    def state():
        out, t = [], 0
        while t < 8:
            hi = min(9, t + rng.choice((0, 2, 4)))
            out.append(sg(19 + 27 * t - 2, 27 * (hi - t) + 4, t, t, hi, hi, "a" * rng.randrange(2)))
            t = hi + 1 + rng.randrange(2)
        return out

    nodes = [("r", None), ("a", "r"), ("b", "r")] + [(f"a{k}", "a") for k in range(7)] + [(f"b{k}", "b") for k in range(2)]
    base = state()
    leaves = {n: [x for x in (base if rng.random() < 0.8 else state())] for n, p in nodes if p in ("a", "b")}
    for k in range(1, 7):  # a sister that lost one event keeps the others
        leaves[f"a{k}"] = base[:-1] if k == 3 else base
    level = {"r": 0, "a": 1, "b": 1} | {n: 2 for n in leaves}
    monkeypatch.setattr(ancestors, "FAN", 2)
    tree = spark.createDataFrame(nodes, "node_id string, parent_id string")
    got = {r.node_id: rows_of(r.state) for r in ancestors.annotate(tree, spark.createDataFrame(list(level.items()), "node_id string, level int"), spark.createDataFrame(list(leaves.items()), f"node_id string, state {sa.STATE}")).collect()}
    for parent in "ab":
        now = None
        for n in sorted(n for n, p in nodes if p == parent):
            now = leaves[n] if now is None else meets(spark, [(now, leaves[n])])[0]
        assert got[parent] == now
    assert got["r"] == [] and got["a"] and all(got[n] == s for n, s in leaves.items())
    frame = spark.createDataFrame([(n, p, got[n]) for n, p in nodes], f"node_id string, parent_id string, state {sa.STATE}")
    score = {r.node_id: r.score for r in ancestors.new_singletons(frame).collect()}
    assert score["a"] == sum(x[0] is not None for x in got["a"])
    assert score["a1"] == len([x for x in leaves["a1"] if x not in got["a"]])


def test_tuples_of_tracts(spark):
    one, wide, far = (1, 1, 1, 1), (0, 0, 2, 2), (5, 5, 6, 7)
    rows = [([one], [wide]), ([wide], [one]), ([one, far], [wide, far]), ([], [one]), ([far, far], [far])]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(rows)], f"k int, a {sa.TRACTS}, b {sa.TRACTS}")
    got = df.select("k", sa.less_or_equal(F.col("a"), F.col("b")).alias("fits"), sa.difference(F.col("a"), F.col("b")).alias("more"), sa.merged(F.concat("a", "b")).alias("whole")).orderBy("k").collect()
    assert [r.fits for r in got] == [True, False, True, True, True]  # what stands behind the end of the other fits
    assert [rows_of(r.more) for r in got] == [[wide], [], [wide], [one], []]
    assert [rows_of(r.whole) for r in got[:2]] == [[wide]] * 2
    possible = spark.createDataFrame([([sg(10, 90, 0, 0, 3, 3)],)], f"s {sa.STATE}").select(sa.possible_statuses(F.col("s")).alias("m")).first().m
    assert sorted(possible) == [0, 2, 4, 6, 15]


def test_reassigned_events(spark):
    """One target inwards where an end misses its cut; the nearest cut where none is left, the end's at equal distance; clipped and padded."""
    kind = "struct<start_pos:int,del_len:int,min_target:int,max_target:int,insert_str:string>"
    cases = [(15, 10, 0, 0, ""), (21, 30, 0, 1, "g"), (22, 3, 0, 0, "c"), (33, 0, 0, 0, ""), (10, 3, 0, 0, "")]
    df = spark.createDataFrame([(k, e) for k, e in enumerate(cases)], f"k int, e {kind}")
    got = [tuple(r.x) for r in df.select("k", reads.reassign(F.col("e"), DESIGN).alias("x")).orderBy("k").collect()]
    assert got == [(15, 10, 0, 0, ""), (21, 30, 1, 1, "g"), (19, 6, 0, 0, "caaa"), (33, 13, 1, 1, "a" * 13), (10, 9, 0, 0, "aaaaaa")]


def test_clashes_merge(spark):
    kind = reads.EVENTS
    touching = [(10, 12, 0, 0, "a"), (40, 8, 1, 1, "c")]  # dead targets differ: stay
    long_left = [(15, 4, 0, 0, "a"), (20, 30, 1, 1, "c")]  # the second reaches target 0
    overlap = [(15, 40, 0, 1, ""), (44, 6, 1, 1, "g")]
    end = [(250, 60, 9, 9, "")]
    df = spark.createDataFrame([(k, e) for k, e in enumerate([touching, long_left, overlap, end, []])], f"k int, e {kind}")
    got = [rows_of(r.x) for r in df.select("k", reads.clip_overflow(reads.merge_clashes(F.col("e"), DESIGN, 1), DESIGN).alias("x")).orderBy("k").collect()]
    assert got == [touching, [(15, 35, 0, 1, "aca")], [(15, 35, 0, 1, "g")], [(250, 34, 9, 9, "")], []]


def test_read_files_without_rows_and_with_bad_events(spark):
    header = ["organ", "umi", *(f"target{k}" for k in range(1, 11))]
    path = new_path(spark, "empty")
    spark.createDataFrame([], ", ".join(f"{c} string" for c in header)).coalesce(1).write.option("sep", "\t").option("header", True).csv(path)
    text = new_path(spark, "header")
    spark.createDataFrame([("\t".join(header),)], "v string").coalesce(1).write.text(text)
    assert read_source.by_read(spark, text, DESIGN).count() == 0
    bad = new_path(spark, "bad")
    spark.createDataFrame([("\t".join(header),), ("\t".join(["Eye", "1", "5X+20", *["NONE"] * 9]),)], "v string").coalesce(1).write.text(bad)
    with pytest.raises(Exception, match="no event: 5X"):
        read_source.by_read(spark, bad, DESIGN).collect()


def random_trees(rng, leaves=14):
    """Two trees over the same leaves, all leaves at height 1."""
    out = []
    for name in "pq":
        nodes, open_ = [("root", None, 0.0)], [f"l{k}" for k in range(leaves)]
        depth, up, k = {}, {}, 0
        while len(open_) > 1:
            some = rng.sample(open_, min(len(open_), rng.choice((2, 2, 3))))
            new = f"{name}{k}"
            k += 1
            for x in some:
                up[x] = new
                open_.remove(x)
            open_.append(new)
        up[open_[0]] = "root"
        depth["root"] = 0.0
        order = [open_[0]]
        while order:
            x = order.pop()
            depth[x] = 1.0 if x.startswith("l") else round(depth[up[x]] + rng.choice((0.05, 0.1)), 9)
            order += [y for y in up if up[y] == x]
        nodes += [(x, up[x], depth[x] - depth[up[x]]) for x in up]
        out.append((nodes, up, depth))
    return out


def test_comparison_by_all_pairs(spark):
    rng = random.Random(6)
    (na, ua, da), (nb, ub, db) = random_trees(rng)
    frame = lambda nodes: spark.createDataFrame([(*n, n[0].startswith("l")) for n in nodes], NODES)
    a, b = frame(na), frame(nb)
    pa, pb = trees.closure(a), trees.closure(b)
    leaves = a.where("is_leaf").select("node_id")
    joint = compare.joint_counts(pa, pb, leaves)

    def above(up, x):
        out = [x]
        while out[-1] in up:
            out.append(up[out[-1]])
        return out

    def mrca(up, xs):
        shared = set.intersection(*(set(above(up, x)) for x in xs))
        return next(x for x in above(up, xs[0]) if x in shared)

    names = sorted(x for x, *_ in na if x.startswith("l"))
    expected = {}
    for x, y in itertools.combinations(names, 2):
        key = mrca(ua, [x, y]), mrca(ub, [x, y])
        expected[key] = expected.get(key, 0) + 1
    pairs = compare.mrca_pairs(joint, a, b)
    assert {(r.a, r.b): r.pairs for r in pairs.collect()} == expected
    placed_a, placed_b = trees.depths(a, pa), trees.depths(b, pb)
    own = lambda t: t.where("is_leaf").select("node_id", "dist")
    got = compare.mrca_difference(compare.mrca_heights(pairs, placed_a, placed_b, own(a), own(b))).first()
    total = sum(abs(da[mrca(ua, [x, y])] - db[mrca(ub, [x, y])]) for x, y in itertools.combinations(names, 2)) + sum(abs(da[ua[x]] - db[ub[x]]) for x in names)
    assert got.n == 14 * 15 // 2 and got.difference == pytest.approx(total / got.n)
    inner = {r.a: r.other_depth for r in compare.internal_depths(joint, placed_a, placed_b).collect()}
    below = lambda n: [x for x in names if n in above(ua, x)]
    assert inner == pytest.approx({x: db[mrca(ub, below(x))] for x, p, _ in na if p and not x.startswith("l")})


def test_collapse_same_alleles(spark):
    """r(x) - a(x) at 0.3 with leaves p(x) and q(y) at 1, and leaf s(y): p hangs on a, q on a, a on r; of two same leaves at one height one hangs on the other."""
    rows = [("r", None, 0.0, False, "x"), ("a", "r", 0.3, False, "x"), ("p", "a", 0.7, True, "x"), ("q", "a", 0.7, True, "y"), ("s", "r", 1.0, True, "y"), ("t", "r", 1.0, True, "x")]
    nodes = spark.createDataFrame(rows, NODES + ", label string").withColumn("abundance", F.lit(1))
    paths = trees.closure(nodes)
    got = {r.node_id: (r.parent_id, round(r.dist, 9), r.abundance) for r in trees.collapse_same_alleles(nodes, paths, trees.depths(nodes, paths)).collect()}
    assert got == {"r": (None, 0.0, 1), "a": ("r", 0.3, 1), "p": ("a", 0.7, 2), "q": ("a", 0.7, 1), "s": ("r", 1.0, 1)} or got["q"] == ("a", 0.7, 1)
    flat = {r.node_id: (r.parent_id, r.dist) for r in trees.without_unchanged(nodes).collect()}
    assert flat == {"r": (None, 0.0), "p": ("r", 0.0), "q": ("r", 1.0), "s": ("r", 1.0), "t": ("r", 0.0)}


def test_traversal_and_newick(spark):
    rows = [("r", None, 0.0, False), ("a", "r", 1.0, False), ("b", "r", 2.0, True), ("c", "a", 0.5, True), ("d", "a", 0.25, True)]
    nodes = spark.createDataFrame(rows, NODES)
    paths = trees.closure(nodes)
    got = {r.node_id: (r.level, r.preorder, r.postorder, r.level_order) for r in trees.traversal(nodes, paths).collect()}
    assert got == {"r": (0, 0, 4, 0), "a": (1, 1, 2, 1), "c": (2, 2, 0, 3), "d": (2, 3, 1, 4), "b": (1, 4, 3, 2)}
    text = trees.newick(nodes.withColumn("tree_id", F.lit("t")), trees.depths(nodes, paths).select("node_id", "level")).first()
    assert text.newick == "((c:0.500,d:0.250)a:1.000,b:2.000)r:0.000;"


def test_tissue_distances_of_both_ways(spark):
    """Leaf x of two tissues: at the leaf half its branch; y finds B at its parent only."""
    nodes = spark.createDataFrame([("r", None, 0.0, False), ("a", "r", 0.4, False), ("x", "a", 0.6, True), ("y", "a", 0.6, True)], NODES)
    tissues = spark.createDataFrame([("x", "A", 2), ("x", "B", 1), ("y", "A", 4)], "node_id string, organ string, abundance long")
    got = {(r.organ, r.other): (r.one_way, r.distance) for r in trees.tissue_distances(nodes, trees.closure(nodes), tissues).collect()}
    a_b, b_a = (2 * 0.3 + 4 * 0.6) / 6, 0.3
    assert got[("A", "B")] == pytest.approx((a_b, (a_b + b_a) / 2)) and got[("B", "A")] == pytest.approx((b_a, (a_b + b_a) / 2))


def test_matrix_exponential():
    q = np.array([[-2.0, 2.0], [0.0, 0.0]])
    assert fits.expm(q * 0.7) == pytest.approx(np.array([[math.exp(-1.4), 1 - math.exp(-1.4)], [0, 1]]))
    rng = np.random.default_rng(1)
    q = rng.uniform(0, 3, (5, 5))
    q -= np.diag(q.sum(axis=1))
    small = np.linalg.matrix_power(np.eye(5) + q / 2**20, 2**20)
    assert fits.expm(q) == pytest.approx(small, abs=1e-4) and fits.expm(q).sum(axis=1) == pytest.approx(1)


def test_allele_strings_round_trip(spark):
    events = [(2, 3, "ac"), (8, 0, "g"), (10, 2, "")]
    df = spark.createDataFrame([(events,), ([],)], "e array<struct<start_pos:int,del_len:int,insert_str:string>>")
    got = [r.t for r in df.select(sequences.allele(F.col("e"), "ACGTACGTACGT").alias("t")).collect()]
    assert got == ["ACac---CGTgAC--", "ACGTACGTACGT"]
    back = df.select(sequences.raw_events(sequences.allele(F.col("e"), "ACGTACGTACGT")).alias("b")).collect()
    assert [rows_of(r.b) for r in back] == [events, []]


def test_fastq_disagreement(spark):
    path = new_path(spark, "fastq")
    rows = [("b1", "1:4:ac,7:7:g", "ACGT"), ("b2", "1:4:ac,7:7:g", "ACGT"), ("b3", "", "TT"), ("b4", "2:4:", "TT")]
    sequence_source.write_fastq(spark.createDataFrame(rows, "id string, description string, sequence string"), path)
    got = {r.sequence: (r.abundance, r.agree) for r in sequence_source.sequence_counts(sequence_source.read_fastq(spark, path)).collect()}
    assert got == {"ACGT": (2, True), "TT": (2, False)}


def test_mix_output(spark):
    text = "\nName      Characters\n----      ----------\n\nl1           01?\nl2           110\n\n\n  ( . means same as in the node below it on tree)\n\nroot         1      yes    .1.\n1            l1     yes    ..?\n1            l2     maybe  1..\n\n\n"
    rows = sequence_source._parse(text)
    assert rows == [(0, "l1", None, "01?"), (0, "l2", None, "110"), (0, "1", "root", ".1."), (0, "l1", "1", "..?"), (0, "l2", "1", "1..")]
    edges = spark.createDataFrame([("root", None, "000"), *((n, p, c) for _, n, p, c in rows if p)], "node_id string, parent_id string, characters string")
    got = {r.node_id: (r.characters, r.dist) for r in sequence_source.decoded(edges, trees.closure(edges.withColumn("dist", F.lit(0.0)))).collect()}
    assert got == {"root": ("000", 0), "1": ("010", 1), "l1": ("01?", 0), "l2": ("110", 1)}


def test_folds_numbers_and_bounds(spark):
    rows = spark.createDataFrame([(k, "ab"[k % 2], 1) for k in range(41)], "id long, g string, abundance long")
    sizes = observe.folds(rows, 4, 1, "id", "g").groupBy("g", "fold").count().collect()
    assert max(r["count"] for r in sizes) - min(r["count"] for r in sizes) <= 1
    assert [(r.id, r.row_number) for r in numbered(rows.repartition(5), "id").orderBy("id").collect()] == [(k, k) for k in range(41)]
    assert bounded(rows, 41, "rows").count() == 41
    with pytest.raises(ValueError, match="more than 40 rows"):
        bounded(rows, 40, "rows")


def test_neighbour_joining_finds_an_additive_tree(spark):
    edges = {"a": ("u", 2.0), "b": ("u", 3.0), "u": ("v", 1.5), "c": ("v", 4.0), "v": ("w", 2.5), "d": ("w", 1.0), "e": ("w", 5.0)}

    def up(x):
        out = [(x, 0.0)]
        while out[-1][0] in edges:
            p, length = edges[out[-1][0]]
            out.append((p, out[-1][1] + length))
        return dict(out)

    dist = lambda x, y, e: min(v + up_y[k] for k, v in e(x).items() if k in (up_y := e(y)))
    names = "abcde"
    pairs = [("t", x, y, dist(x, y, up)) for k, x in enumerate(names) for y in names[k:]] + [("s", "p", "q", 3.0), ("s", "p", "p", 0.0)]
    rows = reshape.neighbour_joining(spark.createDataFrame(pairs, "tree_id string, a string, b string, distance double")).collect()
    made = {r.node_id: (r.parent_id, r.dist) for r in rows if r.tree_id == "t"}

    def made_up(x):
        out = [(x, 0.0)]
        while out[-1][0] in made:
            p, length = made[out[-1][0]]
            out.append((p, out[-1][1] + length))
        return dict(out)

    assert all(dist(x, y, made_up) == pytest.approx(d) for t, x, y, d in pairs if t == "t")
    assert {(r.node_id, r.dist) for r in rows if r.tree_id == "s"} == {("p", 1.5), ("q", 1.5)}


def test_pruning_sums_over_inner_states(spark):
    q = np.array([[-1.2, 0.7, 0.5], [0.0, -0.4, 0.4], [0.0, 0.0, 0.0]])
    tree = [("r", None, 0.0, False), ("a", "r", 0.4, False), ("x", "a", 0.6, True), ("y", "a", 0.5, True), ("z", "r", 1.0, True)]
    seen = {"x": 1, "y": 2, "z": 0}
    p = {t: fits.expm(q * t) for t in (0.4, 0.5, 0.6, 1.0)}
    expected = {s: sum(p[0.4][s, a] * p[0.6][a, 1] * p[0.5][a, 2] for a in range(3)) * p[1.0][s, 0] for s in range(3)}
    steps = spark.createDataFrame([(t, i, j, float(m[i, j])) for t, m in p.items() for i in range(3) for j in range(3) if m[i, j] > 0], "length double, start long, after long, p double")
    nodes = spark.createDataFrame(tree, NODES)
    states = spark.createDataFrame(list(seen.items()), "node_id string, state long")
    got = fits.pruned_likelihood(nodes, trees.depths(nodes, trees.closure(nodes)), states, steps)
    assert {r.state: math.exp(r.log_p) for r in got.where("node_id = 'r'").collect()} == pytest.approx({s: v for s, v in expected.items() if v > 0})


def test_resolved_trees_are_binary(spark):
    rows = [("r", None, 0.0, False), *((f"l{k}", "r", 1.0, True) for k in range(5))]
    got = reshape.resolved(spark.createDataFrame(rows, NODES), 1).collect()
    assert sorted(r["count"] for r in spark.createDataFrame(got).groupBy("parent_id").count().where("parent_id IS NOT NULL").collect()) == [2] * 4
    assert {r.node_id for r in got if r.is_leaf} == {f"l{k}" for k in range(5)}


def test_joint_counts_have_no_rows_for_leaves(spark):
    """The table of pairs grows with inner nodes, whatever the leaves; a node's only leaf is named."""
    up_a = {"a": "r", "b": "r", **{f"l{k}": "a" if k else "b" for k in range(50)}}
    up_b = {"c": "s", **{f"l{k}": "c" for k in range(50)}}
    frame = lambda up, root: spark.createDataFrame([(root, None, 0.0, False), *((n, p, 0.5, n.startswith("l")) for n, p in up.items())], NODES)
    a, b = frame(up_a, "r"), frame(up_b, "s")
    leaves = a.where("is_leaf").select("node_id")
    joint = compare.joint_counts(trees.closure(a), trees.closure(b), leaves).collect()
    assert {(r.a, r.b): r.n for r in joint} == {(x, y): n for x, n in (("r", 50), ("a", 49), ("b", 1)) for y in "cs"}
    assert {r.one for r in joint if r.n == 1} == {"l0"}
    inner = lambda nodes: trees.closure(nodes.where("NOT is_leaf"))
    again = compare.joint_inner(a.where("is_leaf"), b.where("is_leaf"), inner(a), inner(b))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, joint))
    hung = trees.with_ends(inner(a), a.where("is_leaf"))
    assert sorted(map(tuple, hung.collect())) == sorted(map(tuple, trees.closure(a).collect()))


def test_tissue_distances_by_every_leaf(spark):
    """Against each leaf's way up, with leaves of several tissues and below the root; the closure of inner nodes is enough."""
    up = {"a": "r", "b": "a", "c": "r", **{f"l{k}": "abc"[k % 3] for k in range(12)}, "l12": "r", "l13": "r", "l14": "c"}
    dist = {n: 0.1 + 0.01 * k for k, n in enumerate(up)}
    organs = {f"l{k}": [("xyz"[k % 3], 1 + k)] for k in range(15)} | {"l3": [("x", 2), ("y", 5)], "l12": [("x", 1), ("z", 4)], "l14": [("w", 3), ("x", 1)]}
    nodes = spark.createDataFrame([("r", None, 0.0, False), *((n, p, dist[n], n.startswith("l")) for n, p in up.items())], NODES)
    tissues = spark.createDataFrame([(n, o, w) for n, own in organs.items() for o, w in own], "node_id string, organ string, abundance long")
    way = lambda n: [n] + (way(up[n]) if n in up else [])
    depth = lambda n: sum(dist.get(m, 0.0) for m in way(n))
    has = {}
    for n, own in organs.items():
        for m in way(n):
            has.setdefault(m, set()).update(o for o, _ in own)
    sums = {}
    for n, own in organs.items():
        for o, w in own:
            for other in {"x", "y", "z", "w"} - {o}:
                at = next((m for m in way(n) if m != "r" and other in has[m]), None)
                if at is not None:
                    total, weight, k = sums.get((o, other), (0.0, 0, 0))
                    sums[o, other] = total + w * (dist[n] / 2 if at == n else 1 - depth(at)), weight + w, k + 1
    for paths in (trees.closure(nodes), trees.closure(nodes.where("NOT is_leaf"))):
        got = {(r.organ, r.other): (r.one_way, r.n) for r in trees.tissue_distances(nodes, paths, tissues).collect()}
        assert set(got) == set(sums)
        assert all(got[k] == (pytest.approx(t / w), n) for k, (t, w, n) in sums.items())
