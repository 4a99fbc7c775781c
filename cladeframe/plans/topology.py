"""Queries on trees, on two trees together, and on what is written of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import compare, moves, offsets, trees
from ..tables import new_path
from .fixtures import Fixture
from .registry import plan, with_views

#: The groups of organs, and those left out, of merged labels.
GROUPS = [("1-URGENT", "Heart"), ("2-HIGH", "Heart"), ("3-MEDIUM", "Int"), ("4-NOT SPECIFIED", "Eyes")]
WITHOUT = ["5-LOW"]
_MERGED = "mt AS (SELECT DISTINCT node_id, CASE SUBSTRING(organ,1,1) WHEN '1' THEN 'Heart' WHEN '2' THEN 'Heart' WHEN '3' THEN 'Int' ELSE 'Eyes' END AS organ FROM fx_tissue WHERE organ<>'5-LOW'), lb AS (SELECT n.node_id, COALESCE(x.label,'') AS label FROM fx_node n LEFT JOIN (SELECT node_id, STRING_AGG(substr(organ,1,1),'' ORDER BY organ) AS label FROM (SELECT DISTINCT c.anc_id AS node_id, mt.organ FROM closure c JOIN mt ON mt.node_id=c.desc_id) d GROUP BY 1) x ON x.node_id=n.node_id)"
_ROW = "lf AS (SELECT l.node_id AS leaf, l.dist AS own{0}, c.node_id AS c{0}, n.node_id AS n{0}, r.node_id AS r{0}, r.dist AS dr{0}, r.dist+n.dist AS dn{0}, r.dist+n.dist+c.dist AS dc{0} FROM {1} l JOIN {1} c ON c.node_id=l.parent_id JOIN {1} n ON n.node_id=c.parent_id JOIN {1} r ON r.node_id=n.parent_id WHERE l.is_leaf)"
_BOTH = f"{_ROW.format(1, 'fx_node').replace('lf AS', 'l1 AS')}, {_ROW.format(2, 'fx_other').replace('lf AS', 'l2 AS')}, lf AS (SELECT * FROM l1 JOIN l2 USING (leaf))"
_HEIGHT = "CASE WHEN a.c{0}=b.c{0} THEN 1-a.dc{0} WHEN a.n{0}=b.n{0} THEN 1-a.dn{0} WHEN a.r{0}=b.r{0} THEN 1-a.dr{0} ELSE 1E0 END"
#: All pairs of leaves, by brute force.
_ENTRIES = f"{_BOTH}, en AS (SELECT x, y, SUM(n) AS n FROM (SELECT ROUND({_HEIGHT.format(1)},9) AS x, ROUND({_HEIGHT.format(2)},9) AS y, COUNT(*) AS n FROM lf a JOIN lf b ON a.leaf<b.leaf GROUP BY 1,2 UNION ALL SELECT ROUND(own1,9), ROUND(own2,9), COUNT(*) FROM lf GROUP BY 1,2) z GROUP BY 1,2)"


def joint(f: Fixture) -> DataFrame:
    return f.at_rest("joint", lambda: trees.written(compare.joint_inner(f.node.where("is_leaf"), f.other.where("is_leaf"), f.upper, f.other_upper), "joint"))


def _depths(f: Fixture) -> tuple[DataFrame, DataFrame]:
    return trees.all_depths(f.node, f.upper), trees.all_depths(f.other, f.other_upper)


def heights(f: Fixture) -> DataFrame:
    leaves = lambda nodes: nodes.where("is_leaf").select("node_id", "dist")
    return compare.mrca_heights(compare.mrca_pairs(joint(f), f.node.where("NOT is_leaf"), f.other.where("NOT is_leaf")), *(d.where("NOT is_leaf") for d in _depths(f)), leaves(f.node), leaves(f.other))


def labels(f: Fixture) -> DataFrame:
    groups = f.spark.createDataFrame(GROUPS, "organ string, name string")
    return trees.tissue_labels(f.node, f.upper, trees.merged_tissues(f.tissue.select("node_id", "organ"), groups, WITHOUT))


# -- two trees ------------------------------------------------------------------------
@plan(with_views(_ENTRIES, "SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(n AS BIGINT) AS n FROM en"), "fx_node", "fx_other", doubles="x y")
def mrca_heights(f: Fixture) -> DataFrame:
    return heights(f).select("x", "y", F.col("n").cast("long").alias("n"))


@plan(with_views(_ENTRIES, "SELECT CAST(SUM(n) AS BIGINT) AS n, SUM(ABS(x-y)*n)/SUM(n) AS difference FROM en"), "fx_node", "fx_other", doubles="difference")
def mrca_pairs(f: Fixture) -> DataFrame:
    return compare.mrca_difference(heights(f)).select(F.col("n").cast("long").alias("n"), "difference")


@plan(with_views(_ENTRIES + ", p AS (SELECT SUM(sign(a.x-b.x)*sign(a.y-b.y)*CAST(a.n AS DOUBLE)*b.n) AS s FROM en a JOIN en b ON a.x<b.x), t AS (SELECT SUM(n) AS n FROM en), u AS (SELECT SUM(CAST(k AS DOUBLE)*(k-1)/2) AS u FROM (SELECT SUM(n) AS k FROM en GROUP BY x) z), v AS (SELECT SUM(CAST(k AS DOUBLE)*(k-1)/2) AS v FROM (SELECT SUM(n) AS k FROM en GROUP BY y) z)",
 "SELECT s/SQRT((CAST(n AS DOUBLE)*(n-1)/2-u)*(CAST(n AS DOUBLE)*(n-1)/2-v)) AS tau FROM p, t, u, v"), "fx_node", "fx_other", doubles="tau")
def kendall(f: Fixture) -> DataFrame:
    """Rank correlation of both trees' matrices over all pairs of leaves."""
    from ..operators import stats

    return stats.kendall_tau(heights(f), "x", "y", "n")


def _inner_sql(own: int, other: int) -> str:
    kinds = " UNION ALL ".join(f"SELECT {k}{own} AS node, d{k}{own} AS depth, CASE WHEN COUNT(DISTINCT c{other})=1 THEN MIN(dc{other}) WHEN COUNT(DISTINCT n{other})=1 THEN MIN(dn{other}) WHEN COUNT(DISTINCT r{other})=1 THEN MIN(dr{other}) ELSE 0 END AS there, COUNT(*) AS k FROM lf GROUP BY 1,2" for k in "rnc")
    return f"SELECT * FROM ({kinds}) z"


@plan(with_views(f"{_BOTH}, i1 AS ({_inner_sql(1, 2)}), i2 AS ({_inner_sql(2, 1)}), s1 AS (SELECT leaf, CASE WHEN COUNT(*) OVER (PARTITION BY c1)=1 THEN 1 ELSE 0 END AS lone FROM lf)",
 """SELECT corr(depth, CASE WHEN k=1 THEN 1E0 ELSE there END) AS r_a, (SELECT corr(depth, CASE WHEN k=1 THEN 1E0 ELSE there END) FROM i2) AS r_b, 1-(corr(depth, CASE WHEN k=1 THEN 1E0 ELSE there END)+(SELECT corr(depth, CASE WHEN k=1 THEN 1E0 ELSE there END) FROM i2))/2 AS distance FROM i1"""), "fx_node", "fx_other", doubles="r_a r_b distance")  # fmt: skip
def internal_correlation(f: Fixture) -> DataFrame:
    return compare.internal_correlation(joint(f), *_depths(f))


@plan(with_views("keep AS (SELECT DISTINCT c.anc_id AS node_id FROM closure c JOIN fx_other o ON o.node_id=c.desc_id AND o.is_leaf AND TRY_CAST(substr(o.node_id,2) AS BIGINT)%9=0), ch AS (SELECT parent_id AS p, COUNT(*) AS n FROM fx_node JOIN keep USING (node_id) GROUP BY 1), s AS (SELECT k.node_id FROM keep k LEFT JOIN ch ON ch.p=k.node_id WHERE k.node_id='ROOT' OR ch.n IS NULL OR ch.n>1)",
 "SELECT substr(node_id,1,1) AS kind, COUNT(*) AS n FROM s GROUP BY 1"), "fx_other", "closure")
def prune_to_match(f: Fixture) -> DataFrame:
    """One tree less the leaves that another, smaller one has not: nodes that stay by kind."""
    fewer = f.other.where("is_leaf").where(F.substring("node_id", 2, 20).try_cast("long") % 9 == 0).select("node_id")
    shared = f.node.where("is_leaf").join(fewer, "node_id", "left_semi")
    kept = trees.with_kept_leaves(f.node, f.closure, shared)
    return trees.nearest_kept(kept, trees.branching(kept)).groupBy(F.substring("node_id", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


# -- one tree -----------------------------------------------------------------------------
@plan(with_views("pk(node_id, key, level) AS (SELECT 'ROOT', '', 0 UNION ALL SELECT n.node_id, pk.key||'/'||n.node_id||' ', pk.level+1 FROM pk JOIN fx_node n ON n.parent_id=pk.node_id), sz AS (SELECT anc_id AS node_id, COUNT(*) AS size FROM closure GROUP BY 1)",
 "SELECT node_id, level, ROW_NUMBER() OVER (ORDER BY key)-1 AS preorder, ROW_NUMBER() OVER (ORDER BY key)-1-level+size-1 AS postorder, ROW_NUMBER() OVER (ORDER BY level, key)-1 AS level_order FROM pk JOIN sz USING (node_id)"), "fx_node", "closure")
def traversals(f: Fixture) -> DataFrame:
    return trees.traversal(f.node, f.upper).withColumn("postorder", F.col("postorder").cast("long"))


@plan(with_views("""ch AS (SELECT n.node_id, n.parent_id IS NULL OR a.label<>b.label AS changed FROM fx_node n JOIN fx_label a ON a.node_id=n.node_id LEFT JOIN fx_label b ON b.node_id=n.parent_id),
 fs AS (SELECT c.desc_id AS node_id, ARG_MIN(c.anc_id, c.hops) AS chain FROM closure c JOIN ch ON ch.node_id=c.anc_id AND ch.changed GROUP BY 1),
 g AS (SELECT n.*, fs.chain, d.depth, r.hops AS level, LAG(n.node_id) OVER w AS before, d.depth-LAG(d.depth) OVER w AS gap, ROW_NUMBER() OVER w AS k FROM fx_node n JOIN fs USING (node_id) JOIN depth d USING (node_id) JOIN closure r ON r.desc_id=n.node_id AND r.anc_id='ROOT' WINDOW w AS (PARTITION BY fs.chain ORDER BY ROUND(d.depth,9), r.hops, n.node_id)),
 m AS (SELECT node_id, COALESCE(before,parent_id) AS parent_id, COALESCE(gap,dist) AS dist, is_leaf, ROW_NUMBER() OVER (PARTITION BY chain, run ORDER BY k) AS abundance FROM (SELECT *, SUM(CASE WHEN before IS NULL OR gap>1e-8 THEN 1 ELSE 0 END) OVER (PARTITION BY chain ORDER BY k) AS run FROM g) z),
 kd AS (SELECT parent_id AS p, COUNT(*) AS n FROM m GROUP BY 1), kp AS (SELECT m.*, kd.n AS kids FROM m LEFT JOIN kd ON kd.p=m.node_id)""",
 "SELECT substr(node_id,1,1) AS kind, abundance, COUNT(*) AS n FROM kp WHERE parent_id IS NULL OR kids IS NULL OR kids>1 GROUP BY 1,2"), "fx_node", "fx_label", "closure")
def collapse_ultrametric(f: Fixture) -> DataFrame:
    """Nodes that stay by kind and abundance."""
    nodes = f.node.join(f.label, "node_id").withColumn("abundance", F.lit(1))
    return trees.collapse_same_alleles(nodes, f.upper, trees.all_depths(f.node, f.upper)).groupBy(F.substring("node_id", 1, 1).alias("kind"), F.col("abundance").cast("long").alias("abundance")).agg(F.count("*").alias("n"))


@plan(with_views("""ch AS (SELECT n.node_id, n.is_leaf, n.parent_id IS NULL AS root, n.parent_id IS NULL OR a.label<>b.label AS changed FROM fx_node n JOIN fx_label a ON a.node_id=n.node_id LEFT JOIN fx_label b ON b.node_id=n.parent_id),
 k1 AS (SELECT node_id, is_leaf, changed, root FROM ch WHERE changed OR is_leaf),
 p1 AS (SELECT c.desc_id AS node_id, ARG_MIN(c.anc_id, c.hops) AS parent_id FROM closure c JOIN k1 ON k1.node_id=c.anc_id JOIN k1 d ON d.node_id=c.desc_id WHERE c.hops>0 GROUP BY 1),
 kd AS (SELECT parent_id AS p, COUNT(*) AS n FROM p1 GROUP BY 1)""", "SELECT substr(k1.node_id,1,1) AS kind, COUNT(*) AS n FROM k1 LEFT JOIN kd ON kd.p=k1.node_id WHERE k1.root OR kd.n IS NULL OR kd.n>1 GROUP BY 1"), "fx_node", "fx_label", "closure")
def collapse_unchanged(f: Fixture) -> DataFrame:
    """Nodes that stay by kind when those of their parent's allele are merged into it."""
    return trees.without_unchanged(f.node.join(f.label, "node_id")).groupBy(F.substring("node_id", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


@plan(with_views(_MERGED, "SELECT * FROM lb"), "fx_tissue", "closure")
def merged_tissue_labels(f: Fixture) -> DataFrame:
    return labels(f)


@plan(with_views("""o AS (SELECT DISTINCT c.anc_id, t.organ AS other FROM closure c JOIN fx_tissue t ON t.node_id=c.desc_id),
 u AS (SELECT t.node_id, t.organ, t.abundance, o.other, ARG_MIN(CASE WHEN c.hops=0 THEN n.dist/2 ELSE 1-d.depth END, c.hops) AS len FROM fx_tissue t JOIN closure c ON c.desc_id=t.node_id JOIN depth d ON d.node_id=c.anc_id JOIN fx_node n ON n.node_id=c.anc_id JOIN o ON o.anc_id=c.anc_id WHERE c.anc_id!='ROOT' AND o.other!=t.organ GROUP BY 1,2,3,4),
 x AS (SELECT organ, other, SUM(len*abundance)/SUM(abundance) AS one_way, COUNT(*) AS n FROM u GROUP BY 1,2)""",
 "SELECT a.organ, a.other, a.one_way, (a.one_way+b.one_way)/2 AS distance, a.n FROM x a LEFT JOIN x b ON b.organ=a.other AND b.other=a.organ"), "fx_tissue", "closure", doubles="one_way distance")
def tissue_distance(f: Fixture) -> DataFrame:
    return trees.tissue_distances(f.node, f.upper, f.tissue)


_FLOW = _MERGED + """, sg AS (SELECT node_id, MIN(abundance) AS abundance FROM fx_tissue GROUP BY 1 HAVING COUNT(*)=1), tot AS (SELECT SUM(abundance) AS s FROM sg),
 fl AS (SELECT lb.label AS progenitor, 7 AS time, sg.node_id AS leaf_id, abundance FROM sg JOIN lb USING (node_id) UNION ALL SELECT lb.label, 0, sg.node_id, abundance FROM sg, lb WHERE lb.node_id='ROOT'
  UNION ALL SELECT lb.label, g.k, sg.node_id, abundance FROM sg JOIN closure c ON c.desc_id=sg.node_id JOIN fx_node n ON n.node_id=c.anc_id JOIN depth d ON d.node_id=n.node_id JOIN depth p ON p.node_id=n.parent_id JOIN lb ON lb.node_id=n.node_id, (SELECT UNNEST(range(1,7)) AS k) g WHERE p.depth<g.k/7.0E0 AND d.depth>g.k/7.0E0)"""


@plan(with_views(_FLOW, "SELECT progenitor, CAST(time AS INT) AS time, COUNT(*) AS n, SUM(abundance)/MIN(s) AS freq FROM fl, tot GROUP BY 1,2"), "fx_tissue", "closure", doubles="freq")
def cell_type_flow(f: Fixture) -> DataFrame:
    out = trees.flow(f.node, f.closure, f.tissue, labels(f), 7)
    return out.groupBy("progenitor", "time").agg(F.count("*").alias("n"), F.sum("freq").alias("freq"))


@plan(with_views(_FLOW, "SELECT COUNT(*) AS n, SUM(abundance)/MIN(s) AS freq, MIN(progenitor) AS first FROM fl, tot"), "fx_tissue", "closure", doubles="freq")
def flow_csv(f: Fixture) -> DataFrame:
    """The flow written as CSV with a header and read back."""
    path = new_path(f.spark, "flow")
    trees.flow(f.node, f.closure, f.tissue, labels(f), 7).write.option("header", True).csv(path)
    back = f.spark.read.option("header", True).schema("progenitor string, time int, leaf_id string, freq double").csv(path)
    return back.agg(F.count("*").alias("n"), F.sum("freq").alias("freq"), F.min(F.coalesce("progenitor", F.lit(""))).alias("first"))


_LINKS = _MERGED + """, kt AS (SELECT node_id, CAST(FLOOR(depth*10+1e-9) AS INT) AS k FROM depth), e AS (SELECT n.node_id, n.parent_id, p.k AS lo, c.k AS hi FROM fx_node n JOIN kt p ON p.node_id=n.parent_id JOIN kt c ON c.node_id=n.node_id),
 tn AS (SELECT 'ROOT' AS node_id UNION ALL SELECT node_id FROM e WHERE hi>lo), sr AS (SELECT c.desc_id AS node_id, ARG_MIN(c.anc_id, c.hops) AS src FROM closure c JOIN tn ON tn.node_id=c.anc_id WHERE c.hops>0 GROUP BY 1),
 st AS (SELECT e.node_id, sr.src, e.lo+(e.hi-e.lo)//2 AS half, UNNEST(range(e.lo, e.hi)) AS k FROM e JOIN sr USING (node_id) WHERE e.hi>e.lo),
 ln AS (SELECT k, CASE WHEN k<=half THEN src ELSE node_id END AS one, CASE WHEN k<half THEN src ELSE node_id END AS two FROM st)"""


@plan(with_views(_LINKS, "SELECT a.label AS source, b.label AS target, CAST(k AS INT) AS bucket, COUNT(DISTINCT one) AS n FROM ln JOIN lb a ON a.node_id=one JOIN lb b ON b.node_id=two GROUP BY 1,2,3"), "fx_tissue", "closure")
def tree_graph(f: Fixture) -> DataFrame:
    return trees.time_links(f.node, f.upper, labels(f))


@plan(with_views(_LINKS, "SELECT to_json({'source': source, 'target': target, 'bucket': bucket, 'value': n}) AS line FROM (SELECT a.label AS source, b.label AS target, CAST(k AS INT) AS bucket, COUNT(DISTINCT one) AS n FROM ln JOIN lb a ON a.node_id=one JOIN lb b ON b.node_id=two GROUP BY 1,2,3) z"), "fx_tissue", "closure")
def graph_json(f: Fixture) -> DataFrame:
    """The graph's links as JSON lines, written and read back."""
    path = new_path(f.spark, "graph")
    links = trees.time_links(f.node, f.upper, labels(f)).withColumnRenamed("n", "value")
    links.select(F.to_json(F.struct("source", "target", "bucket", "value")).alias("value")).write.text(path)
    return f.spark.read.text(path).withColumnRenamed("value", "line")


@plan(with_views(_MERGED, "SELECT to_json({'id': n.node_id, 'parent': COALESCE(n.parent_id,''), 'leaf': n.is_leaf, 'label': lb.label}) AS line FROM fx_node n JOIN lb USING (node_id)"), "fx_tissue", "closure")
def node_json(f: Fixture) -> DataFrame:
    """A JSON line for each node, flat: children name their parent."""
    named = f.node.join(labels(f), "node_id")
    return named.select(F.to_json(F.struct(F.col("node_id").alias("id"), F.coalesce("parent_id", F.lit("")).alias("parent"), F.col("is_leaf").alias("leaf"), "label")).alias("line"))


@plan("SELECT x.n AS inner_nodes, x.slope, x.intercept, x.r, y.* FROM (SELECT COUNT(*) AS n, regr_slope(n.dist,d.depth) AS slope, regr_intercept(n.dist,d.depth) AS intercept, corr(n.dist,d.depth) AS r FROM fx_node n JOIN depth d USING (node_id) WHERE NOT n.is_leaf AND n.parent_id IS NOT NULL) x, (SELECT AVG(dist) AS leaf_mean, MIN(dist) AS leaf_min, MAX(dist) AS leaf_max FROM fx_node WHERE is_leaf) y", "closure", doubles="slope intercept r leaf_mean leaf_min leaf_max")
def branch_length_time(f: Fixture) -> DataFrame:
    from ..operators import stats

    fit = stats.regression(trees.depths(f.node.where("NOT is_leaf"), f.upper).where("parent_id IS NOT NULL"), "dist", "depth")
    own = f.node.where("is_leaf").agg(F.avg("dist").alias("leaf_mean"), F.min("dist").alias("leaf_min"), F.max("dist").alias("leaf_max"))
    return fit.select(F.col("n").alias("inner_nodes"), "slope", "intercept", "r").join(own)  # one row each


_CLADES = "cl AS (SELECT d.node_id, d.depth, SUM(l.abundance) AS cells FROM depth d JOIN closure c ON c.anc_id=d.node_id AND c.hops>0 JOIN fx_leaf l ON l.node_id=c.desc_id WHERE d.depth>=0.05 AND (SELECT COUNT(*) FROM fx_node k WHERE k.parent_id=d.node_id)>2 GROUP BY 1,2)"


def clade_cells(f: Fixture) -> DataFrame:
    """node_id, depth, cells of inner nodes with more than two children, away from the root."""
    spined = f.node.groupBy(F.col("parent_id").alias("node_id")).count().where("count > 2").select("node_id")
    inner = trees.depths(f.node.where("NOT is_leaf"), f.upper).where("depth >= 0.05").join(spined, "node_id", "left_semi").select("node_id", "depth")
    own = f.leaf.select("node_id", "abundance").join(f.node.where("is_leaf").select("node_id", "parent_id"), "node_id").groupBy(F.col("parent_id").alias("node_id")).agg(F.sum("abundance").alias("abundance"))
    cells = trees.leaf_values(f.upper, own, "abundance").groupBy(F.col("anc_id").alias("node_id")).agg(F.sum("abundance").alias("cells"))  # by parents first
    return inner.join(cells, "node_id")


@plan(with_views(_CLADES, "SELECT node_id, depth, CAST(cells AS BIGINT) AS cells FROM cl"), "fx_leaf", "closure", doubles="depth")
def clade_abundance(f: Fixture) -> DataFrame:
    return clade_cells(f)


@plan("SELECT c.anc_id AS node_id, t.organ, CAST(SUM(t.abundance) AS BIGINT) AS cells, SUM(t.abundance)/(SELECT SUM(abundance) FROM fx_tissue) AS share FROM closure c JOIN fx_tissue t ON t.node_id=c.desc_id GROUP BY 1,2", "fx_tissue", "closure", doubles="share")
def organ_proportions(f: Fixture) -> DataFrame:
    below = trees.leaf_values(f.closure, f.tissue, "organ", "abundance").groupBy(F.col("anc_id").alias("node_id"), "organ").agg(F.sum("abundance").alias("cells"))
    return below.join(F.broadcast(f.tissue.agg(F.sum("abundance").alias("total")))).select("node_id", "organ", "cells", (F.col("cells") / F.col("total")).alias("share"))


@plan(with_views(f"{_ROW.format(1, 'fx_node')}, fo AS (SELECT lf.*, t.organ FROM lf JOIN fx_leaf t ON t.node_id=lf.leaf)", f"SELECT a.organ, b.organ AS other, SUM(CASE WHEN a.leaf=b.leaf THEN 0 ELSE {_HEIGHT.format(1)} END) AS total FROM fo a JOIN fo b ON TRUE GROUP BY 1,2"), "fx_leaf", "fx_node", doubles="total")
def organ_pair_lengths(f: Fixture) -> DataFrame:
    """SQL: every two leaves."""
    return trees.organ_pair_lengths(f.closure, f.node, f.leaf.select("node_id", "organ"))


@plan("SELECT n.node_id, n.parent_id, n.dist FROM fx_node n WHERE n.node_id IN (SELECT c.anc_id FROM closure c JOIN (SELECT node_id FROM fx_tissue GROUP BY 1 HAVING COUNT(*)=1 AND MIN(organ)='3-MEDIUM') t ON t.node_id=c.desc_id)", "fx_tissue", "closure", doubles="dist")
def pure_prune(f: Fixture) -> DataFrame:
    """Nodes above leaves of one tissue and no other."""
    pure = f.tissue.groupBy("node_id").agg(F.count("*").alias("k"), F.min("organ").alias("organ")).where("k = 1 AND organ = '3-MEDIUM'").select("node_id")
    return trees.with_kept_leaves(f.node, f.closure, pure).select("node_id", "parent_id", "dist")


@plan(with_views("e AS (SELECT DISTINCT pairs AS taxon, UNNEST(string_split(pairs,' ')) AS event FROM fx_obs WHERE pairs<>'no_evts'), s AS (SELECT event, COUNT(*) AS n FROM e GROUP BY 1)",
 "SELECT a.event AS a, b.event AS b, COUNT(*) AS shared FROM e a JOIN e b ON a.taxon=b.taxon AND a.event<b.event JOIN s x ON x.event=a.event JOIN s y ON y.event=b.event GROUP BY 1,2 HAVING COUNT(*)<MIN(x.n) AND COUNT(*)<MIN(y.n)"), "fx_obs")
def perfect_phylogeny(f: Fixture) -> DataFrame:
    carriers = f.obs.where("pairs != 'no_evts'").select(F.col("pairs").alias("taxon"), F.explode(F.split("pairs", " ")).alias("event")).distinct()
    return trees.perfect_conflicts(carriers)


@plan(with_views("o AS (SELECT parent_id AS node_id, STRING_AGG(node_id||':'||printf('%.3f',dist),',' ORDER BY node_id) AS s FROM fx_node WHERE node_id LIKE 'O%' GROUP BY 1), c AS (SELECT n.parent_id AS node_id, STRING_AGG(COALESCE('('||o.s||')','')||n.node_id||':'||printf('%.3f',n.dist),',' ORDER BY n.node_id) AS s FROM fx_node n LEFT JOIN o USING (node_id) WHERE n.node_id LIKE 'C%' GROUP BY 1)",
 "SELECT n.node_id AS tree_id, COALESCE('('||c.s||')','')||n.node_id||':0.000;' AS newick FROM fx_node n LEFT JOIN c USING (node_id) WHERE n.node_id LIKE 'N%'"), "fx_node")
def newick_trees(f: Fixture) -> DataFrame:
    """The subtree of each nation as a tree of its own."""
    own = f.closure.where(F.col("anc_id").startswith("N")).select(F.col("anc_id").alias("tree_id"), F.col("desc_id").alias("node_id"), F.col("hops").alias("level"))
    top = F.col("node_id") == F.col("tree_id")
    nodes = own.join(f.node, "node_id").select("tree_id", "node_id", F.when(~top, F.col("parent_id")).alias("parent_id"), F.when(top, 0.0).otherwise(F.col("dist")).alias("dist"))
    return trees.newick(nodes, own.select("node_id", "level"))


@plan(with_views("e AS (SELECT 'O'||cell_id AS node_id, min_target*10+max_target AS k FROM fx_event GROUP BY 1,2), b AS (SELECT c.anc_id, l.node_id FROM closure c JOIN fx_node l ON l.node_id=c.desc_id AND l.is_leaf WHERE c.anc_id<>'ROOT'), n AS (SELECT anc_id, COUNT(*) AS n FROM b GROUP BY 1), s AS (SELECT b.anc_id AS node_id, e.k FROM b JOIN e USING (node_id) JOIN n ON n.anc_id=b.anc_id GROUP BY 1,2 HAVING COUNT(*)=MIN(n.n))",
 "SELECT COUNT(*) AS score FROM s JOIN fx_node t USING (node_id) WHERE NOT EXISTS (SELECT 1 FROM s u WHERE u.node_id=t.parent_id AND u.k=s.k)"), "fx_event", "closure")
def parsimony(f: Fixture) -> DataFrame:
    """Events new against the parent, over all edges of the tree whose inner nodes have the events that all their leaves share."""
    events = f.event.select(F.concat(F.lit("O"), F.col("cell_id").cast("string")).alias("node_id"), (F.col("min_target") * 10 + F.col("max_target")).alias("k")).distinct()
    return trees.new_events(f.node, trees.shared_events(f.node, f.upper, events)).agg(F.count("*").alias("score"))


def _events(f: Fixture) -> DataFrame:
    return f.event.select(F.concat(F.lit("O"), F.col("cell_id").cast("string")).alias("node_id"), (F.col("min_target") * 10 + F.col("max_target")).alias("k")).distinct()


@plan()
def rehung_subtrees(f: Fixture) -> DataFrame:
    """The first customer of each nation hung on every inner node and on every edge of the tree: how many places change the parsimony score
    by how much.  No SQL: a sum for each place; tests fold every place's tree again."""
    chads = f.customer.groupBy("c_nationkey").agg(F.min("c_custkey").alias("c")).select(F.concat(F.lit("C"), F.col("c").cast("string")).alias("chad"))
    found = moves.rehung(f.node, f.upper, _events(f), chads)
    return found.groupBy("chad", "place", "change").agg(F.count("*").alias("places"), F.min("target").alias("first"))


_SPLIT = """b{0} AS (SELECT anc_id, desc_id FROM closure{0} JOIN {1} l ON l.node_id=desc_id AND l.is_leaf), o{0} AS (SELECT anc_id FROM b{0} WHERE desc_id=(SELECT MIN(desc_id) FROM b{0}) GROUP BY 1),
 v{0} AS (SELECT anc_id, desc_id FROM b{0} WHERE anc_id NOT IN (SELECT anc_id FROM o{0}) UNION ALL SELECT o{0}.anc_id, a.desc_id FROM o{0} JOIN (SELECT DISTINCT desc_id FROM b{0}) a ON NOT EXISTS (SELECT 1 FROM b{0} z WHERE z.anc_id=o{0}.anc_id AND z.desc_id=a.desc_id)),
 t{0} AS (SELECT DISTINCT s FROM (SELECT anc_id, STRING_AGG(desc_id, ',' ORDER BY desc_id) AS s, COUNT(*) AS n FROM v{0} GROUP BY 1) x WHERE n>1 AND n<(SELECT COUNT(DISTINCT desc_id)-1 FROM b{0}))"""


@plan(with_views(f"{_SPLIT.format('', 'fx_node')}, {_SPLIT.format('2', 'fx_other')}", "SELECT COUNT(x.s) AS splits_a, COUNT(y.s) AS splits_b, COUNT(CASE WHEN x.s IS NULL OR y.s IS NULL THEN 1 END) AS unshared, COUNT(CASE WHEN x.s IS NULL OR y.s IS NULL THEN 1 END)/(COUNT(x.s)+COUNT(y.s)) AS rf FROM t x FULL JOIN t2 y ON x.s=y.s"), "closure", "closure2", doubles="rf")
def split_rf(f: Fixture) -> DataFrame:
    """Distance of both trees as unrooted ones: splits with more than one leaf on either side."""
    leaves = f.node.where("is_leaf").select("node_id")
    rf, counts = trees.rf_distance(trees.splits(f.closure, leaves), trees.splits(f.other_closure, leaves))
    return counts.select("*", rf.alias("rf")).withColumnsRenamed({"clades_a": "splits_a", "clades_b": "splits_b"})


@plan(with_views("lf AS (SELECT DISTINCT o_custkey AS tree_id, o_orderstatus AS st, o_orderstatus||SUBSTRING(o_orderpriority,1,1) AS label FROM orders), cl AS (SELECT tree_id, STRING_AGG(label, ',' ORDER BY label) AS s FROM lf GROUP BY tree_id UNION SELECT tree_id, STRING_AGG(label, ',' ORDER BY label) FROM lf GROUP BY tree_id, st UNION SELECT tree_id, label FROM lf), tr AS (SELECT tree_id, STRING_AGG(s, ';' ORDER BY s) AS t FROM cl GROUP BY 1)",
 "SELECT tree_id, MIN(tree_id) OVER (PARTITION BY t) AS first, COUNT(*) OVER (PARTITION BY t) AS trees FROM tr"))
def tree_classes(f: Fixture) -> DataFrame:
    """Trees of all customers (organs by status) in one table, grouped by equal clades: each tree's class is its first member's number."""
    key = lambda *parts: F.concat_ws("|", F.col("o_custkey").cast("string"), *parts)
    organ = F.concat("o_orderstatus", F.substring("o_orderpriority", 1, 1))
    rows = f.orders.select("o_custkey", "o_orderstatus", organ.alias("label")).distinct()
    leaves = rows.select(key("label", F.lit("leaf")).alias("node_id"), key("o_orderstatus").alias("parent_id"), F.col("o_custkey").alias("tree_id"), "label")
    inner = rows.select(key("o_orderstatus").alias("node_id"), key().alias("parent_id"), F.col("o_custkey").alias("tree_id")).distinct()
    roots = rows.select(key().alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("o_custkey").alias("tree_id")).distinct()
    nodes = leaves.select("node_id", "parent_id", "tree_id", "label").unionByName(inner.unionByName(roots), allowMissingColumns=True)
    return trees.equal_trees(nodes)


_LENGTHS = """ch AS (SELECT parent_id AS p, COUNT(*) AS n FROM fx_node GROUP BY 1), ln AS (SELECT x.node_id, x.parent_id, x.is_leaf, d.depth, CASE WHEN ch.n>2 THEN COALESCE(TRY_CAST(substr(x.node_id,2) AS BIGINT)%8,0)/16.0E0*(d.depth-u.depth) ELSE 0E0 END AS off, d.depth-u.depth AS whole
 FROM fx_node x JOIN depth d ON d.node_id=x.node_id LEFT JOIN depth u ON u.node_id=x.parent_id LEFT JOIN ch ON ch.p=x.parent_id), bl AS (SELECT node_id, parent_id, is_leaf, depth, off, COALESCE(whole-off,0E0) AS len FROM ln)"""


def _lengths(f: Fixture) -> DataFrame:
    part = F.coalesce(F.substring("node_id", 2, 20).try_cast("long") % 8, F.lit(0)) / 16.0
    return offsets.branch_lengths(f.node.withColumnRenamed("dist", "inner").withColumn("proportion", part), f.closure, 1.0)


@plan(with_views(_LENGTHS, "SELECT node_id, parent_id, depth, off AS offset_, len AS length FROM bl"), "fx_node", "closure", doubles="depth offset_ length")
def branch_lengths(f: Fixture) -> DataFrame:
    """Depths, offsets on spines and branch lengths from inner distances and proportions."""
    return _lengths(f).select("node_id", "parent_id", "depth", F.col("offset").alias("offset_"), "length")


@plan(with_views(_LENGTHS + ", rk AS (SELECT bl.*, ROW_NUMBER() OVER w AS k, LAG(off) OVER w AS prev, COUNT(*) OVER (PARTITION BY bl.parent_id) AS n FROM bl JOIN ch ON ch.p=bl.parent_id AND ch.n>2 WINDOW w AS (PARTITION BY bl.parent_id ORDER BY off, node_id)), nm AS (SELECT *, off-COALESCE(prev,0) AS step, CASE WHEN k=1 AND parent_id<>'ROOT' THEN parent_id ELSE parent_id||'/'||k END AS here, CASE WHEN k=1 OR (k=2 AND parent_id<>'ROOT') THEN parent_id ELSE parent_id||'/'||(k-1) END AS prior FROM rk)",
 """SELECT b.node_id, COALESCE(CASE WHEN c.k=c.n THEN c.prior ELSE c.here END, b.parent_id) AS parent_id, b.len+CASE WHEN c.k=c.n THEN c.step ELSE 0 END+COALESCE(l.step,0) AS dist, CASE WHEN l.step IS NOT NULL THEN b.node_id END AS spine_of, CASE WHEN l.step IS NOT NULL THEN 1 END AS member
 FROM bl b LEFT JOIN nm c ON c.node_id=b.node_id LEFT JOIN nm l ON l.parent_id=b.node_id AND l.k=1 AND l.parent_id<>'ROOT' UNION ALL SELECT here, prior, step, parent_id, k FROM nm WHERE k<n AND (k>1 OR parent_id='ROOT')"""), "fx_node", "closure", doubles="dist")  # fmt: skip
def fitted_tree(f: Fixture) -> DataFrame:
    """The resolved tree: children of nodes with more than two hang on chained spine nodes in the order of offsets."""
    return offsets.fitted_tree(_lengths(f))
