"""Operators on hand-made rows, and every registered query against DuckDB on the smallest tables."""

import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cladeframe.functions import events as ev
from cladeframe.functions import status as st
from cladeframe.operators import observe, stats, trees
from cladeframe.plans import registry

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def cells(rows):
    def cell(x):
        if x is None or x != x:
            return "~"
        return str(round(float(x), 5) + 0.0) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    expected = duck.execute(f"""SELECT {", ".join(f'"{n}"' for n in names)} FROM ({registry.oracle_sql()[name]}) q""").fetchall()
    assert cells(df.select(*names).collect()) == cells(expected)
    assert expected


def test_status_algebra_cases(spark):
    runs = st.runs(spark.createDataFrame([(235,)], "m long"), "m", 8).select("lo", "hi").collect()
    assert {tuple(r) for r in runs} == {(0, 1), (3, 3), (5, 7)}
    row = spark.createDataFrame([(0b1011, 0b11), (0b1111000, 0b1011)], "a long, b long").select(st.minus(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in row] == [0b1000, 0]
    t = st.transitions(st.statuses(spark, 3), 3)
    assert t.where("status = 0").count() == 13 and t.where("status = 0").select("after").distinct().count() == 6
    got = {(r.min_deact, r.min_t, r.max_t, r.max_deact) for r in t.where("status = 0 AND after = 3").collect()}
    assert got == {(0, 0, 1, 1), (0, 0, 0, 1), (0, 1, 1, 1)}
    assert st.tracts(st.statuses(spark, 10).where("status = 0"), 10).count() == 181


def test_parse(spark):
    row = spark.createDataFrame([("33D+140",), ("4I+203+acgt",), ("5X+1",)], "e string").select(ev.parse_event(F.col("e"), 1).alias("p")).collect()
    assert [tuple(r.p) if r.p else None for r in row] == [(141, 33, ""), (204, 0, "acgt"), None]


def test_tree_operators(spark):
    nodes = spark.createDataFrame([("r", None, 0.0, False), ("a", "r", 0.0, False), ("b", "a", 0.5, False), ("x", "b", 0.5, True), ("y", "a", 1.0, True), ("z", "b", 0.5, True)], "node_id string, parent_id string, dist double, is_leaf boolean")
    paths = trees.closure(nodes)
    assert paths.count() == 6 + 1 + 2 + 3 + 3 + 2
    flat = {r.node_id: (r.parent_id, r.dist) for r in trees.collapse_short(nodes).collect()}
    assert flat == {"r": (None, 0.0), "b": ("r", 0.5), "x": ("b", 0.5), "y": ("r", 1.0), "z": ("b", 0.5)}
    kept = trees.with_kept_leaves(nodes, paths, nodes.where("node_id IN ('x', 'y')"))
    thin = {r.node_id: (r.parent_id, r.dist) for r in trees.nearest_kept(kept, trees.branching(kept)).collect()}
    assert thin == {"r": (None, 0.0), "a": ("r", 0.0), "x": ("a", 1.0), "y": ("a", 1.0)}
    pair = spark.createDataFrame([("x", "z"), ("x", "y")], "a string, b string")
    assert {(r.a, r.b, r.mrca, r.to_mrca) for r in trees.common_ancestors(paths, pair).collect()} == {("x", "z", "b", 0.5), ("x", "y", "a", 1.0)}


def test_long_chain_closes(spark):
    chain = spark.createDataFrame([(str(k), str(k - 1) if k else None, 1.0, k == 40) for k in range(41)], "node_id string, parent_id string, dist double, is_leaf boolean")
    assert trees.closure(chain).agg(F.max("path_len")).first()[0] == 40.0


def test_statistics(spark):
    rows = spark.createDataFrame([("s", k, float(k * k)) for k in range(5)] + [("t", k, float(-k)) for k in range(5)], "s string, k int, v double")
    assert stats.spearman(rows, "s", "k", "v").first().rho == pytest.approx(-1)
    fit = stats.regression(rows.where("s = 't'"), "v", "k").first()
    assert (fit.slope, fit.r) == (pytest.approx(-1), pytest.approx(-1))
    table = observe.mean_se(rows.where("s = 't'"), "v", "s").first()
    assert table.se == pytest.approx(math.sqrt(2.5 / 5))
    obs = spark.createDataFrame([(k, 10 * k) for k in range(1, 6)], "id long, abundance long")
    assert observe.weighted_sample(obs, 3, 1, "id").count() == 3


def test_parsimony_counts_inner_edges(spark):
    nodes = spark.createDataFrame([("r", None, False), ("a", "r", False), ("b", "a", False), ("x", "b", True), ("y", "b", True), ("z", "a", True), ("w", "r", True), ("e", "r", False)], "node_id string, parent_id string, is_leaf boolean").withColumn("dist", F.lit(1.0))
    events = spark.createDataFrame([("x", 1), ("y", 1), ("z", 1), ("x", 2), ("y", 2), ("x", 3), ("w", 1)], "node_id string, k int")
    new = trees.new_events(nodes, trees.shared_events(nodes, trees.closure(nodes), events))
    assert {(r.parent_id, r.node_id, r.k) for r in new.collect()} == {("r", "a", 1), ("a", "b", 2), ("b", "x", 3), ("r", "w", 1)}


def test_constant_input_has_no_correlation(spark):
    rows = spark.createDataFrame([(k, 1.0, float(k), None) for k in range(4)], "k int, x double, y double, z double")
    got = rows.agg(stats.correlation("x", "y").alias("a"), stats.correlation("y", "y").alias("b"), stats.correlation("y", "z").alias("c")).first()
    assert got.a is None and got.b == pytest.approx(1) and got.c is None
    fit = stats.regression(rows, "y", "x").first()
    assert fit.slope is None and fit.r is None
    replicates = spark.createDataFrame([(0, 1.0, 2.0), (0, 1.0, 3.0), (1, 1.0, 5.0), (1, 2.0, 7.0)], "replicate int, x double, y double")
    test = stats.permutation_test(rows.select(F.col("y").alias("x"), (F.col("k") % 3).cast("double").alias("y")), replicates, "x", "y").first()
    assert test.replicates == 1 and test.p == 1.0


def test_kendall_by_all_pairs(spark):
    rng = random.Random(4)
    rows = [(float(rng.randrange(6)), float(rng.randrange(5))) for _ in range(60)]
    sign = lambda x: (x > 0) - (x < 0)
    pairs = [(sign(a[0] - b[0]), sign(a[1] - b[1])) for i, a in enumerate(rows) for b in rows[:i]]
    tau = sum(x * y for x, y in pairs) / math.sqrt(sum(x * x for x, _ in pairs) * sum(y * y for _, y in pairs))
    assert stats.kendall_tau(spark.createDataFrame(rows, "x double, y double"), "x", "y").first().tau == pytest.approx(tau)
