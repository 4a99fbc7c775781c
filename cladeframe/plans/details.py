"""Queries on properties of events, nodes and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as di
from ..functions import events as ev
from ..operators import compare, fits, reshape, trees
from ..tables import new_path
from . import lineage, topology
from .fixtures import Fixture
from .lineage import DEACT
from .registry import plan, with_views


# -- events -----------------------------------------------------------------
@plan(with_views(DEACT, "SELECT cell_id, start_pos, min_target<max_target AS intertarget, min_deact<>min_target AS left_long, max_deact<>max_target AS right_long, min_target+2<=max_target AS hides_cuts, LENGTH(insert_str) AS insert_len FROM d"), "fx_event")
def event_properties(f: Fixture) -> DataFrame:
    return lineage._dead(f).select("cell_id", "start_pos", (F.col("min_target") < F.col("max_target")).alias("intertarget"), (F.col("min_deact") != F.col("min_target")).alias("left_long"), (F.col("max_deact") != F.col("max_target")).alias("right_long"), (F.col("min_target") + 2 <= F.col("max_target")).alias("hides_cuts"), F.length("insert_str").alias("insert_len"))


@plan("SELECT e.cell_id, e.start_pos, e.del_len+CASE WHEN (e.start_pos+e.del_len)%3=0 THEN 1 ELSE 0 END AS del_len, e.insert_str||CASE WHEN e.start_pos%2=0 THEN 'g' ELSE '' END AS insert_str FROM fx_event e", "fx_event")
def changed_events(f: Fixture) -> DataFrame:
    """A change made once for each distinct event reaches every cell that carries it."""
    key = ["start_pos", "del_len", "min_target", "max_target", "insert_str"]
    longer = F.col("del_len") + ((F.col("start_pos") + F.col("del_len")) % 3 == 0).cast("int")
    changes = f.event.select(*key).distinct().select(*key, longer.alias("new_len"), F.concat("insert_str", F.when(F.col("start_pos") % 2 == 0, "g").otherwise("")).alias("new_insert"))
    return f.event.join(changes, key).select("cell_id", "start_pos", F.col("new_len").alias("del_len"), F.col("new_insert").alias("insert_str"))


#: Law of trims and insertions: chance of none (focal, inter-target), then a negative binomial; long trims a Poisson.
ZERO, COUNT, P, RATE, NO_INSERT = (0.4, 0.3), 2.5, 0.6, 3.0, 0.5


def _nb(k: str) -> str:
    return f"EXP(lgamma({k}+2.5E0)-lgamma({k}+1)-lgamma(2.5E0)+2.5E0*LN(0.4E0)+({k})*LN(0.6E0))"


_CDF = "nb AS (SELECT x.m, (SELECT SUM(" + _nb("k") + ") FROM (SELECT UNNEST(range(0,60)) AS k) z WHERE k<=x.m) AS f FROM (SELECT UNNEST(range(0,40)) AS m) x), po AS (SELECT x.m, (SELECT SUM(EXP(-3E0+k*LN(3E0)-lgamma(k+1))) FROM (SELECT UNNEST(range(0,60)) AS k) z WHERE k<=x.m) AS f FROM (SELECT UNNEST(range(0,40)) AS m) x)"
_TRIM = "CASE WHEN {t}=0 THEN {z} WHEN {g} THEN EXP(-3E0+GREATEST({t}-{lo},0)*LN(3E0)-lgamma(GREATEST({t}-{lo},0)+1))/(SELECT f FROM po WHERE m=GREATEST({hi}-{lo},0)) ELSE (1-{z})*" + _nb("GREATEST({t}-1,0)") + "/(SELECT f FROM nb WHERE m={hi}-1) END"
_ZERO = "CASE WHEN min_target<max_target THEN 0.3E0 ELSE 0.4E0 END"


@plan(with_views(f"{DEACT}, {_CDF}, u AS (SELECT DISTINCT start_pos, del_len, min_target, max_target, min_deact, max_deact, insert_str, 19+27*min_target-start_pos AS lt, start_pos+del_len-19-27*max_target AS rt, CASE WHEN min_target=0 THEN 19 ELSE 22 END AS ll, CASE WHEN min_target=0 THEN 19 ELSE 26 END AS lm, CASE WHEN max_target=9 THEN 21 ELSE 22 END AS rl, CASE WHEN max_target=9 THEN 21 ELSE 26 END AS rm FROM d)",
 f"""SELECT start_pos, del_len, min_target, max_target, insert_str, LN({_TRIM.format(t='lt', z=_ZERO, g='min_deact<>min_target', lo='ll', hi='lm')})+LN({_TRIM.format(t='rt', z=_ZERO, g='max_deact<>max_target', lo='rl', hi='rm')})
 +LN(CASE WHEN LENGTH(insert_str)=0 THEN 0.5E0 ELSE 0.5E0*{_nb('LENGTH(insert_str)-1')} END)-CASE WHEN min_target<max_target OR min_deact<>min_target OR max_deact<>max_target THEN 0 ELSE LN(1-0.4E0*0.4E0*0.5E0) END AS log_p FROM u"""), "fx_event", doubles="log_p")  # fmt: skip
def indel_probabilities(f: Fixture) -> DataFrame:
    """Log-probability of each distinct event given its cut: trims on both sides and the insertion; focal short ones are conditional on a change."""
    d = F.broadcast(f.target.select("target", F.when(F.col("target") == 0, 19).otherwise(22).alias("ll"), F.col("left_max").alias("lm"), F.when(F.col("target") == 9, 21).otherwise(22).alias("rl"), F.col("right_max").alias("rm")))
    rows = ev.trims(lineage._dead(f)).select("start_pos", "del_len", "min_target", "max_target", "min_deact", "max_deact", "insert_str", "left_trim", "right_trim").distinct()
    rows = rows.join(d.select(F.col("target").alias("min_target"), "ll", "lm"), "min_target").join(d.select(F.col("target").alias("max_target"), "rl", "rm"), "max_target")
    inter, long_l, long_r = F.col("min_target") < F.col("max_target"), F.col("min_deact") != F.col("min_target"), F.col("max_deact") != F.col("max_target")
    zero = F.when(inter, ZERO[1]).otherwise(ZERO[0])

    def trim(t: str, is_long, lo: str, hi: str):
        short = (1 - zero) * F.exp(di.nbinom_log(F.greatest(F.col(t) - 1, F.lit(0)), COUNT, P)) / di.nbinom_cdf(F.col(hi) - 1, COUNT, P)
        far = F.exp(di.poisson_log(F.greatest(F.col(t) - F.col(lo), F.lit(0)), RATE)) / di.poisson_cdf(F.greatest(F.col(hi) - F.col(lo), F.lit(0)), RATE)
        return F.when(F.col(t) == 0, zero).when(is_long, far).otherwise(short)

    n = F.length("insert_str")
    inserted = F.when(n == 0, NO_INSERT).otherwise((1 - NO_INSERT) * F.exp(di.nbinom_log(F.greatest(n - 1, F.lit(0)), COUNT, P)))
    changed = F.when(inter | long_l | long_r, 0.0).otherwise(F.log(F.lit(1 - ZERO[0] * ZERO[0] * NO_INSERT)))
    log_p = F.log(trim("left_trim", long_l, "ll", "lm")) + F.log(trim("right_trim", long_r, "rl", "rm")) + F.log(inserted) - changed
    return rows.select("start_pos", "del_len", "min_target", "max_target", "insert_str", log_p.alias("log_p"))


# -- nodes ------------------------------------------------------------------
@plan("SELECT n.node_id, COUNT(k.node_id) AS n_children, COUNT(k.node_id)>2 AS many_furcating, COUNT(k.node_id)<=2 OR COUNT(k.node_id)%2=0 AS resolved FROM fx_node n LEFT JOIN fx_node k ON k.parent_id=n.node_id GROUP BY 1", "fx_node")
def node_predicates(f: Fixture) -> DataFrame:
    """Children, and whether a node is a multifurcation or resolved: by two children at most, or by a mark (here: an even number of children)."""
    kids = f.node.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("k"))
    n = F.coalesce("k", F.lit(0)).cast("long")
    return f.node.join(kids, "node_id", "left").select("node_id", n.alias("n_children"), (n > 2).alias("many_furcating"), ((n <= 2) | (n % 2 == 0)).alias("resolved"))


@plan("SELECT node_id, parent_id, size, CAST(ROW_NUMBER() OVER (PARTITION BY parent_id ORDER BY size, node_id) AS INT) AS ord FROM fx_node JOIN (SELECT anc_id AS node_id, COUNT(*) AS size FROM closure JOIN fx_node l ON l.node_id=desc_id AND l.is_leaf GROUP BY 1) s USING (node_id) WHERE parent_id IS NOT NULL", "closure")
def ladder(f: Fixture) -> DataFrame:
    """Children in the order of the leaves below them."""
    sizes = trees.leaf_values(f.closure, f.node.where("is_leaf")).groupBy(F.col("anc_id").alias("node_id")).agg(F.count("*").alias("size"))
    return f.node.where("parent_id IS NOT NULL").join(sizes, "node_id").select("node_id", "parent_id", "size", F.row_number().over(Window.partitionBy("parent_id").orderBy("size", "node_id")).alias("ord"))


@plan("SELECT n.node_id, n.parent_id, CASE WHEN n.parent_id IS NULL THEN 0 ELSE COALESCE(b.len, n.dist) END AS dist FROM fx_node n LEFT JOIN (SELECT 'C'||c_custkey AS node_id, (1+c_custkey%9)/30.0E0 AS len FROM customer WHERE c_custkey%2=0) b USING (node_id)", "fx_node", doubles="dist")
def assigned_lengths(f: Fixture) -> DataFrame:
    """Branch lengths by node from a table of fitted ones, where it has them."""
    fitted = f.customer.where("c_custkey % 2 = 0").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("node_id"), ((1 + F.col("c_custkey") % 9) / 30.0).alias("len"))
    return f.node.join(fitted, "node_id", "left").select("node_id", "parent_id", F.when(F.col("parent_id").isNull(), 0.0).otherwise(F.coalesce("len", "dist")).alias("dist"))


@plan(with_views("s AS (SELECT node_id FROM fx_node WHERE parent_id IS NULL OR is_leaf OR dist>0.12)", "SELECT c.desc_id AS full_id, ARG_MIN(c.anc_id, c.hops) AS kept_id, MIN(c.hops)=0 AS same FROM closure c JOIN s ON s.node_id=c.anc_id GROUP BY 1"), "closure")
def node_mapping(f: Fixture) -> DataFrame:
    """Every node of the full tree with the one of the collapsed tree that stands for it."""
    kept = f.node.where("parent_id IS NULL OR is_leaf OR dist > 0.12").select("node_id")
    return trees.nearest_above(f.node, f.upper, kept).withColumnRenamed("node_id", "full_id")


@plan(with_views(f"{topology._BOTH}, i1 AS ({topology._inner_sql(1, 2)})", "SELECT node, depth, CASE WHEN k=1 THEN 1E0 ELSE there END AS other_depth FROM i1"), "fx_node", "fx_other", doubles="depth other_depth")
def internal_heights(f: Fixture) -> DataFrame:
    """Depths of inner nodes with those of the same leaves' last common ancestors in the other tree."""
    return compare.internal_depths(topology.joint(f), *topology._depths(f)).withColumnRenamed("a", "node")


# -- fits -------------------------------------------------------------------------
_FITS = "h AS (SELECT o_custkey%50 AS fit, o_orderkey AS iter, CAST(o_totalprice AS DOUBLE) AS log_lik, o_orderkey%11=0 AS final FROM orders)"


@plan(with_views(_FITS, "SELECT fit, iter, log_lik, final FROM h QUALIFY ROW_NUMBER() OVER (PARTITION BY fit ORDER BY final DESC, iter DESC)=1"), doubles="log_lik")
def fit_or_last(f: Fixture) -> DataFrame:
    """The final fit of each run, or the last entry of its history where there is none."""
    rows = f.orders.select((F.col("o_custkey") % 50).alias("fit"), F.col("o_orderkey").alias("iter"), F.col("o_totalprice").cast("double").alias("log_lik"), (F.col("o_orderkey") % 11 == 0).alias("final"))
    return fits.preferred(rows, "fit", F.struct("final", "iter"))


_DEFAULTS = [("rate", 0.5), ("double_weight", 0.1), ("trim_long", 0.05), ("decay", 0.0)]


@plan("SELECT n.fit, p.name, CASE WHEN p.name='decay' AND n.fit%3=0 THEN 0.25E0 WHEN p.name='rate' AND n.fit%2=0 THEN n.fit/10.0E0 ELSE p.v END AS value FROM (SELECT DISTINCT o_custkey%50 AS fit FROM orders) n, (VALUES ('rate',0.5E0),('double_weight',0.1E0),('trim_long',0.05E0),('decay',0E0)) p(name,v)", doubles="value")
def start_parameters(f: Fixture) -> DataFrame:
    """Defaults of every fit, under its warm start's values, under known truths."""
    spark, runs = f.spark, f.orders.select((F.col("o_custkey") % 50).alias("fit")).distinct()
    defaults = spark.createDataFrame(_DEFAULTS, "name string, value double")
    warm = runs.where("fit % 2 = 0").select("fit", F.lit("rate").alias("name"), (F.col("fit") / 10.0).alias("value"))
    known = runs.where("fit % 3 = 0").select("fit", F.lit("decay").alias("name"), F.lit(0.25).alias("value"))
    return fits.overlaid(runs.join(F.broadcast(defaults)), warm, known)


@plan("SELECT fit, CONCAT_WS(',', STRING_AGG(CAST(v AS VARCHAR), ',' ORDER BY target), MAX(w)) AS vector FROM (SELECT o_orderpriority AS fit, o_orderkey%10 AS target, COUNT(*) AS v, LENGTH(o_orderpriority) AS w FROM orders GROUP BY 1,2) x GROUP BY 1")
def parameter_vectors(f: Fixture) -> DataFrame:
    """Rates in the order of targets, then the double weight, as one vector."""
    rates = f.orders.groupBy(F.col("o_orderpriority").alias("fit"), (F.col("o_orderkey") % 10).alias("target")).agg(F.count("*").alias("v"))
    own = rates.groupBy("fit").agg(F.array_sort(F.collect_list(F.struct("target", "v"))).alias("s"))
    return own.select("fit", F.concat_ws(",", F.array_join(F.transform("s", lambda x: x["v"].cast("string")), ","), F.length("fit").cast("string")).alias("vector"))


@plan("SELECT cell_id, organ, abundance, allele_str FROM fx_obs", "fx_obs")
def stored_observations(f: Fixture) -> DataFrame:
    """Observations written as Parquet by organ and read back."""
    path = new_path(f.spark, "observations")
    f.obs.select("cell_id", "organ", "abundance", "allele_str").write.partitionBy("organ").parquet(path)
    return f.spark.read.parquet(path).select("cell_id", "organ", "abundance", "allele_str")


@plan("SELECT 'clade' AS measure, SUM(CASE WHEN s1.s IS NULL OR s2.s IS NULL THEN 1 ELSE 0 END)/(COUNT(s1.s)+COUNT(s2.s)) AS value FROM (SELECT DISTINCT s FROM (SELECT STRING_AGG(desc_id,',' ORDER BY desc_id) AS s FROM closure JOIN fx_node l ON l.node_id=desc_id AND l.is_leaf GROUP BY anc_id HAVING COUNT(*)>1) x) s1 FULL JOIN (SELECT DISTINCT s FROM (SELECT STRING_AGG(desc_id,',' ORDER BY desc_id) AS s FROM closure2 JOIN fx_other l ON l.node_id=desc_id AND l.is_leaf GROUP BY anc_id HAVING COUNT(*)>1) x) s2 ON s1.s=s2.s UNION ALL SELECT 'self', 0E0", "closure", "closure2", doubles="value")
def tree_measures(f: Fixture) -> DataFrame:
    """Measures of trees against a reference in one long table: the other tree, and the reference itself."""
    leaves = f.node.where("is_leaf").select("node_id")
    own, other = trees.clades(f.closure, leaves), trees.clades(f.other_closure, leaves)
    one = lambda name, b: (lambda rf, counts: counts.select(F.lit(name).alias("measure"), rf.alias("value")))(*trees.rf_distance(own, b))
    return one("clade", other).unionByName(one("self", own))


@plan()
def matrix_exponentials(f: Fixture) -> DataFrame:
    """Transition probabilities over a branch of each length, from the rates between masks of three targets.  No SQL: a matrix
    exponential of each length; tests hold it against its series."""
    from ..functions import status as st

    steps = st.transitions(st.statuses(f.spark, 3), 3)
    lams = F.array(F.lit(0.5), F.lit(0.8), F.lit(0.3))
    rates = steps.withColumn("rate", st.hazard(lams, F.col("min_deact"), F.col("min_t"), F.col("max_t"), F.col("max_deact"), 0.3, 0.05, 0.07)).groupBy("status", "after").agg(F.sum("rate").alias("rate"))
    lengths = f.node.where("dist > 0").select(F.round("dist", 9).alias("length")).distinct()
    return fits.transition_probabilities(rates, lengths, 8)


# -- reshaped trees -----------------------------------------------------------------
def _u(seed: int, name: str) -> str:
    return f"((1+('0x'||substr(md5('{seed}|'||{name}),1,8))::BIGINT)/4294967297.0E0)"


@plan(with_views(f"r AS (SELECT node_id, parent_id, dist, is_leaf, ROW_NUMBER() OVER (PARTITION BY parent_id ORDER BY {_u(9, 'node_id')}, node_id)-1 AS k, COUNT(*) OVER (PARTITION BY parent_id) AS n FROM fx_node WHERE parent_id IS NOT NULL)",
 """SELECT node_id, parent_id, dist FROM fx_node WHERE parent_id IS NULL UNION ALL SELECT node_id, CASE WHEN LEAST(k,GREATEST(n-2,0))=0 THEN parent_id ELSE parent_id||'#'||LEAST(k,GREATEST(n-2,0)) END, dist FROM r
 UNION ALL SELECT parent_id||'#'||k, CASE WHEN k=1 THEN parent_id ELSE parent_id||'#'||(k-1) END, 0E0 FROM r WHERE k>0 AND k<n-1"""), "fx_node", doubles="dist")  # fmt: skip
def resolved_tree(f: Fixture) -> DataFrame:
    return reshape.resolved(f.node, 9).select("node_id", "parent_id", "dist")


@plan(with_views(f"pk(node_id, key) AS (SELECT 'ROOT', '' UNION ALL SELECT n.node_id, pk.key||'/'||n.node_id||' ' FROM pk JOIN fx_node n ON n.parent_id=pk.node_id), i AS (SELECT n.node_id, ROW_NUMBER() OVER (ORDER BY key) AS r FROM pk JOIN fx_node n USING (node_id) WHERE NOT n.is_leaf AND n.parent_id IS NOT NULL), u AS (SELECT u, ROW_NUMBER() OVER (ORDER BY u, node_id) AS r FROM (SELECT node_id, {_u(4, 'node_id')} AS u FROM i) z), h AS (SELECT node_id, u AS depth FROM i JOIN u USING (r))",
 "SELECT n.node_id, n.parent_id, CASE WHEN n.parent_id IS NULL THEN 0 WHEN n.is_leaf THEN 1 ELSE h.depth END-COALESCE(p.depth,0) AS dist FROM fx_node n LEFT JOIN h USING (node_id) LEFT JOIN h p ON p.node_id=n.parent_id"), "fx_node", doubles="dist")
def random_lengths(f: Fixture) -> DataFrame:
    return reshape.random_lengths(f.node, trees.traversal(f.node.where("NOT is_leaf"), f.upper), 1.0, 4).select("node_id", "parent_id", "dist")


@plan(with_views("s AS (SELECT 'C'||c_custkey AS a, 'C'||(c_custkey+1) AS b FROM customer WHERE c_custkey%10=0 AND c_custkey+1 IN (SELECT c_custkey FROM customer)), m AS (SELECT a AS node_id, b AS other FROM s UNION ALL SELECT b, a FROM s), t AS (SELECT n.node_id, COALESCE(o.parent_id, n.parent_id) AS parent_id FROM fx_node n LEFT JOIN m USING (node_id) LEFT JOIN fx_node o ON o.node_id=m.other)",
 "SELECT t.node_id, t.parent_id, d.depth-COALESCE(p.depth,0) AS dist FROM t JOIN depth d USING (node_id) LEFT JOIN depth p ON p.node_id=t.parent_id"), "fx_node", "closure", doubles="dist")
def swapped_neighbours(f: Fixture) -> DataFrame:
    key = f.customer.select("c_custkey")
    there = key.select((F.col("c_custkey") - 1).alias("c_custkey"))
    swaps = key.where("c_custkey % 10 = 0").join(there, "c_custkey", "left_semi").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("a"), F.concat(F.lit("C"), (F.col("c_custkey") + 1).cast("string")).alias("b"))
    return reshape.swapped(f.node, trees.depths(f.node, f.closure), swaps).select("node_id", "parent_id", "dist")


@plan()
def joined_neighbours(f: Fixture) -> DataFrame:
    """A tree of organs for each order status from their event sets' distances.  No SQL: neighbour joining; tests hold it against a tree's own distances."""
    kinds = f.event.join(f.obs.select("cell_id", "organ"), "cell_id").join(f.orders.select(F.col("o_orderkey").alias("cell_id"), F.col("o_orderstatus").alias("tree_id")), "cell_id")
    own = kinds.groupBy("tree_id", "organ").agg(F.collect_set(F.struct("start_pos", "min_target", "max_target")).alias("s"))
    side = lambda n: own.select("tree_id", F.col("organ").alias(n), F.col("s").alias(f"s_{n}"))
    pairs = side("a").join(side("b"), "tree_id").where("a <= b").select("tree_id", "a", "b", (F.size(F.array_union("s_a", "s_b")) - F.size(F.array_intersect("s_a", "s_b"))).cast("double").alias("distance"))
    return reshape.neighbour_joining(pairs)


@plan()
def pruned_likelihood(f: Fixture) -> DataFrame:
    """Log-likelihood of the leaves' masks of the first three targets, by the root's state.  No SQL: pruning over matrix exponentials; tests sum over all inner states."""
    steps = f.at_rest("steps", lambda: trees.written(matrix_exponentials(f), "steps"))
    cells = lineage._masks(f).select(F.concat(F.lit("O"), F.col("cell_id").cast("string")).alias("node_id"), F.col("mask").bitwiseAND(F.lit(7)).alias("state"))
    found = fits.pruned_likelihood(f.node, trees.depths(f.node, f.closure), cells, steps)
    return found.where("node_id = 'ROOT'").select("state", "log_p")
