"""Steps that must not grow faster than their input, against the plain results."""

import hashlib

from pyspark.sql import functions as F

from cladeframe.operators import moves, stats, trees
from cladeframe.plans import fixtures
from cladeframe.tables import last_before, numbered

NODES = "node_id string, parent_id string, dist double, is_leaf boolean"
#: Leaves below parents at unlike depths; B has leaves of one tissue alone.
TREE = [("r", None, 0.0, False), ("A", "r", 0.2, False), ("B", "A", 0.3, False), ("C", "r", 0.4, False)] + [(f"l{k}", p, 0.5, True) for k, p in enumerate("BBCCCAr")]
TISSUES = [("l0", "x", 1), ("l1", "x", 2), ("l2", "y", 3), ("l3", "z", 1), ("l3", "x", 2), ("l4", "x", 5), ("l5", "z", 1), ("l6", "y", 2)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_shuffled_sets_are_the_labels_with_places(spark):
    labels = spark.createDataFrame(TISSUES, "node_id string, organ string, abundance long")
    places = spark.createDataFrame([(n, p, d) for n, p, d, leaf in TREE if leaf], "node_id string, parent_id string, dist double")
    sets = stats.shuffled_sets(labels, 3, places)
    assert sets.count() == 3 * 7
    assert rows(sets.select("node_id", "parent_id", "dist").distinct()) == rows(places)
    assert rows(sets.select("replicate", "node_id", F.inline("own"))) == rows(stats.shuffled_labels(labels, 3))
    nodes = spark.createDataFrame(TREE, NODES)
    paths = trees.closure(nodes)
    one = trees.tissue_distances(nodes, paths, stats.shuffled_labels(labels, 3), "replicate")
    assert rows(one) == rows(trees.distances_of_sets(nodes, paths, sets, "replicate"))


def test_distances_by_numbers_are_those_by_names_and_worked_out_once(spark):
    """Inner nodes and tissues as numbers give the same distances; both directions read one written table, so no step before it runs twice."""
    nodes = spark.createDataFrame(TREE, NODES)
    inner = trees.closure(nodes.where("NOT is_leaf"))
    labels = spark.createDataFrame(TISSUES + [("l6", None, 4)], "node_id string, organ string, abundance long")
    tops, up, leaves = trees.numbered_inner(nodes, inner)
    assert {(r.node_id, r.height is None) for r in leaves.collect()} == {(n, p == "r") for n, p, _, leaf in TREE if leaf}
    names = [r.organ for r in stats.organ_codes(labels).orderBy("code").collect()]
    assert names == ["x", "y", "z"]
    kept = labels.where("organ IS NOT NULL")
    sets = stats.shuffled_sets(kept, 3, leaves, codes=True)
    found = trees.distances_of_sets(tops, up, sets, "replicate")
    named = sorted((r.replicate, names[r.organ], names[r.other], round(r.one_way, 12), r.n) for r in found.collect())
    plain = trees.tissue_distances(nodes, inner, stats.shuffled_labels(kept, 3), "replicate")
    assert named == sorted((r.replicate, r.organ, r.other, round(r.one_way, 12), r.n) for r in plain.collect())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == plain._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert rows(trees.tissue_distances(nodes, inner, labels)) == rows(trees.tissue_distances(nodes, inner, kept))


def test_many_organs_are_drawn_as_few_are(spark):
    """Beyond the number that are columns a function of the array draws the same."""
    few = spark.createDataFrame([(f"n{k:02d}", f"o{k % 40:02d}", k) for k in range(60)] + [(f"n{k:02d}", "o07", 3) for k in range(10, 20)], "node_id string, organ string, abundance long")
    md5 = lambda *parts: hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    organs = sorted({r.organ for r in few.collect()})
    for labels, names in ((few, organs), (few.where("organ < 'o10'"), [o for o in organs if o < "o10"])):
        got = stats.shuffled_sets(labels, 2).collect()
        assert got and all([x.organ for x in r.own] == sorted(names, key=lambda o: md5("organ", r.replicate, r.node_id, o))[: len(r.own)] for r in got)  # noqa: B023


def test_columns_of_the_order_alone_are_not_written(spark):
    placed = numbered(spark.range(10).select("id", F.md5(F.col("id").cast("string")).alias("d")), "d", without=("d",))
    assert placed.columns == ["id", "row_number"] and sorted(r.row_number for r in placed.collect()) == list(range(10))


def test_every_step_does_without_leaves_in_the_closure(spark):
    nodes = spark.createDataFrame(TREE, NODES)
    whole, inner = trees.closure(nodes), trees.closure(nodes.where("NOT is_leaf"))
    events = spark.createDataFrame([(n, k) for n, own in {"l0": (1, 2), "l1": (1,), "l2": (3, 1), "l3": (3,), "l4": (3, 4), "l5": (1,)}.items() for k in own], "node_id string, k int")
    labels = spark.createDataFrame(TISSUES, "node_id string, organ string, abundance long")
    named = trees.tissue_labels(nodes, inner, labels)
    assert ("A", "xz") in rows(named) and ("r", "xyz") in rows(named)
    steps = {
        "labels": lambda p: trees.tissue_labels(nodes, p, labels),
        "links": lambda p: trees.time_links(nodes, p, named),
        "events": lambda p: trees.shared_events(nodes, p, events),
        "traversal": lambda p: trees.traversal(nodes, p),
        "rehung": lambda p: moves.rehung(nodes, p, events, spark.createDataFrame([("B",), ("l2",)], "chad string")),
        "collapsed": lambda p: trees.collapse_same_alleles(nodes.withColumn("label", F.when(F.col("node_id").isin("C", "l3"), "c").otherwise("x")).withColumn("abundance", F.lit(1)), p, trees.all_depths(nodes, inner)),
    }
    for name, step in steps.items():
        assert rows(step(whole).select([F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in step(whole).columns])) == rows(step(inner).select([F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in step(inner).columns])), name
    assert ("l0", "B", False) in rows(trees.nearest_above(nodes, inner, nodes.where("NOT is_leaf").select("node_id")))


def test_last_before_across_blocks(spark):
    values = [None, 3, None, None, 7, None, 1, None, None, None]
    got = last_before(spark.createDataFrame(list(enumerate(values)), "k long, v int"), "k", 2, before=F.col("v"))
    assert [r.before for r in got.orderBy("k").collect()] == [None, None, 3, 3, 3, 7, 7, 1, 1, 1]


def test_events_go_to_more_tasks_the_more_rows_there_are(spark, tmp_path, monkeypatch):
    lines = spark.range(100).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "id AS l_partkey", "id AS l_suppkey")
    for name in fixtures._TABLES:
        lines.write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(fixtures, "ITEMS", 10)
    assert fixtures.Fixture(spark, str(tmp_path))._items.rdd.getNumPartitions() == 10
