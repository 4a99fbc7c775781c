"""Queries on alleles as text, on tables of results, and on distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as di
from ..functions import events as ev
from ..functions import sequences as sq
from ..operators import observe, stats, trees
from ..sources import sequences as source
from ..tables import new_path
from . import lineage
from .fixtures import Fixture
from .registry import plan, with_views

#: A barcode of the design's length.
BARCODE = "ACGTTGCA" * 35 + "ACGT"


def _alleles(f: Fixture) -> DataFrame:
    own = f.event.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "del_len", "insert_str"))).alias("events"))
    return own.withColumn("allele", sq.allele(F.col("events"), BARCODE))


_STRINGS = f"b AS (SELECT '{BARCODE}' AS b), g AS (SELECT cell_id, start_pos, del_len, insert_str, COALESCE(LAG(start_pos+del_len) OVER (PARTITION BY cell_id ORDER BY start_pos),0) AS at FROM fx_event), al AS (SELECT cell_id, STRING_AGG(substr(b, g.at+1, start_pos-g.at)||insert_str||repeat('-',del_len),'' ORDER BY start_pos)||substr(MIN(b), MAX(start_pos+del_len)+1) AS allele FROM g, b GROUP BY 1)".replace(" AS at ", " AS at_ ").replace("g.at", "g.at_")


@plan(with_views(_STRINGS, "SELECT cell_id, allele FROM al"), "fx_event")
def allele_strings(f: Fixture) -> DataFrame:
    return _alleles(f).select("cell_id", "allele")


@plan("SELECT cell_id, start_pos, del_len, insert_str FROM fx_event WHERE del_len>0 OR insert_str<>''", "fx_event")
def raw_allele_events(f: Fixture) -> DataFrame:
    """Events read back from allele strings; those that change nothing leave no trace."""
    return _alleles(f).select("cell_id", F.explode(sq.raw_events(F.col("allele"))).alias("e")).select("cell_id", "e.*")


@plan(with_views(_STRINGS + ", s AS (SELECT cell_id, UPPER(REPLACE(allele,'-','')) AS sequence FROM al), d AS (SELECT cell_id, STRING_AGG(CONCAT_WS(':',start_pos,start_pos+del_len,insert_str),',' ORDER BY start_pos) AS d FROM fx_event GROUP BY 1)",
 "SELECT sequence, COUNT(*) AS abundance, COUNT(DISTINCT d)=1 AS agree FROM s JOIN d USING (cell_id) GROUP BY 1"), "fx_event")
def fastq(f: Fixture) -> DataFrame:
    """Alleles written as FASTQ, read back and counted by sequence."""
    path = new_path(f.spark, "fastq")
    rows = _alleles(f).select(F.concat(F.lit("b"), F.col("cell_id").cast("string")).alias("id"), sq.described(F.col("events")).alias("description"), sq.read_sequence(F.col("allele")).alias("sequence"))
    source.write_fastq(rows, path)
    return source.sequence_counts(source.read_fastq(f.spark, path)).drop("events")


_MATRIX = lineage.BINARY


@plan(with_views(_MATRIX[0], f"SELECT rpad('s'||cell_id,10,' ')||row AS value FROM ({_MATRIX[1]}) z UNION ALL SELECT COUNT(*)||' '||MAX(LENGTH(row)) FROM ({_MATRIX[1]}) z"), "fx_obs")
def phylip_file(f: Fixture) -> DataFrame:
    """The matrix of characters as PHYLIP reads it, written and read back."""
    path = new_path(f.spark, "phylip")
    source.write_phylip(lineage.binary_matrix(f).select(F.concat(F.lit("s"), F.col("cell_id").cast("string")).alias("id"), F.col("row").alias("characters")), path)
    return f.spark.read.text(path)


@plan("SELECT node_id, parent_id, CASE substr(node_id,1,1) WHEN 'r' THEN '000' WHEN 'R' THEN '100' WHEN 'N' THEN '1'||CASE WHEN CAST(substr(node_id,2) AS INT)%2=0 THEN '1' ELSE '0' END||'0' ELSE '1'||CASE WHEN CAST(substr(parent_id,2) AS INT)%2=0 THEN '1' ELSE '0' END||CASE WHEN CAST(substr(node_id,2) AS INT)%3=0 THEN '?' ELSE '1' END END AS characters, CASE substr(node_id,1,1) WHEN 'r' THEN 0 WHEN 'R' THEN 1 WHEN 'N' THEN CASE WHEN CAST(substr(node_id,2) AS INT)%2=0 THEN 1 ELSE 0 END ELSE CASE WHEN CAST(substr(node_id,2) AS INT)%3=0 THEN 0 ELSE 1 END END AS dist FROM (SELECT 'root' AS node_id, CAST(NULL AS VARCHAR) AS parent_id UNION ALL SELECT 'R'||r_regionkey, 'root' FROM region UNION ALL SELECT 'N'||n_nationkey, 'R'||n_regionkey FROM nation UNION ALL SELECT 'C'||c_custkey, 'N'||c_nationkey FROM customer) n")
def mix_tree(f: Fixture) -> DataFrame:
    """The output of mix for a tree of regions, nations and customers, written, parsed and decoded."""
    number = lambda c: F.substring(c, 2, 20).cast("int")
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    edges = f.region.select(name("R", "r_regionkey").alias("node"), F.lit("root").alias("parent"), F.lit("1..").alias("d"))
    even = F.when(F.col("n_nationkey") % 2 == 0, ".1.").otherwise("...")
    edges = edges.union(f.nation.select(name("N", "n_nationkey"), name("R", "n_regionkey"), even))
    edges = edges.union(f.customer.select(name("C", "c_custkey"), name("N", "c_nationkey"), F.when(F.col("c_custkey") % 3 == 0, "..?").otherwise("..1")))
    lines = edges.select(F.lit(1).alias("one"), F.concat(F.rpad("parent", 12, " "), F.rpad("node", 12, " "), F.lit("yes    "), "d").alias("line")).groupBy("one").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))
    path = new_path(f.spark, "mix")
    lines.select(F.concat(F.lit("  ( . means same as in the node below it on tree)\n\n"), "lines", F.lit("\n\n")).alias("value")).write.text(path)
    rows = trees.written(source.read_mix(f.spark, path).select(F.col("node").alias("node_id"), F.col("parent").alias("parent_id"), "characters"), "edges")
    root = f.spark.createDataFrame([("root", None, "000")], "node_id string, parent_id string, characters string")
    whole = rows.unionByName(root)
    return source.decoded(whole, trees.closure(whole.withColumn("dist", F.lit(0.0))))


@plan(with_views(_STRINGS, "SELECT organ, COUNT(*) AS n_cells, COUNT(DISTINCT allele) AS n_genotypes, AVG(LENGTH(regexp_replace(regexp_replace(allele,'[-acgt]+','#','g'),'[^#]','','g'))) AS mean_indels, CAST(SUM(LENGTH(allele)-LENGTH(REPLACE(allele,'-',''))) AS BIGINT) AS deleted FROM al JOIN fx_obs USING (cell_id) GROUP BY 1"), "fx_obs", doubles="mean_indels")
def forest_summary(f: Fixture) -> DataFrame:
    """Cells, genotypes, indels of a cell and deleted bases of each organ's tree."""
    rows = _alleles(f).join(f.obs.select("cell_id", "organ"), "cell_id")
    gone = F.length("allele") - F.length(F.replace("allele", F.lit("-"), F.lit("")))
    return rows.groupBy("organ").agg(F.count("*").alias("n_cells"), F.count_distinct("allele").alias("n_genotypes"), F.avg(F.regexp_count("allele", F.lit("[-acgt]+"))).alias("mean_indels"), F.sum(gone).cast("long").alias("deleted"))


# -- results ------------------------------------------------------------------------
_R = "r AS (SELECT o_custkey%50 AS idx, o_orderkey AS run, o_orderkey%97 AS parsimony, o_totalprice AS log_lik FROM orders)"


def _results(f: Fixture) -> DataFrame:
    return f.orders.select((F.col("o_custkey") % 50).alias("idx"), F.col("o_orderkey").alias("run"), (F.col("o_orderkey") % 97).alias("parsimony"), F.col("o_totalprice").cast("double").alias("log_lik"))


@plan(with_views(_R + ", b AS (SELECT idx, ARG_MIN(log_lik,(parsimony,run)) AS ll, MIN(parsimony) AS p FROM r GROUP BY 1)", "SELECT run, r.idx, log_lik-ll AS log_lik_delta, parsimony-p AS parsimony_delta FROM r JOIN b ON b.idx=r.idx"), doubles="log_lik_delta")
def against_most_parsimonious(f: Fixture) -> DataFrame:
    """Each run against the most parsimonious (first) of its data set."""
    r = _results(f)
    best = r.groupBy("idx").agg(F.min_by("log_lik", F.struct("parsimony", "run")).alias("ll"), F.min("parsimony").alias("p"))
    return r.join(best, "idx").select("run", "idx", (F.col("log_lik") - F.col("ll")).alias("log_lik_delta"), (F.col("parsimony") - F.col("p")).alias("parsimony_delta"))


@plan("SELECT l.node_id, o.organ, o.abundance FROM fx_leaf l JOIN (SELECT pairs, organ, CAST(SUM(abundance) AS BIGINT) AS abundance FROM fx_obs GROUP BY 1,2) o ON o.pairs=l.pairs", "fx_leaf")
def leaf_organs(f: Fixture) -> DataFrame:
    """Abundances by organ of the allele of each leaf: alleles are summed before they are joined."""
    own = f.obs.groupBy("pairs", "organ").agg(F.sum("abundance").alias("abundance"))
    return f.leaf.select("node_id", "pairs").join(own, "pairs").select("node_id", "organ", "abundance")


_NAMES = [("1-URGENT", 0, "early", "Brain"), ("2-HIGH", 1, "early", "Left eye"), ("3-MEDIUM", 2, "late", "Heart"), ("4-NOT SPECIFIED", 3, "late", "Gills"), ("5-LOW", 4, "late", "Blood")]


@plan("SELECT n.layer, n.name, n.ordinal, CAST(SUM(abundance) AS BIGINT) AS cells FROM fx_obs o JOIN (VALUES ('1-URGENT',0,'early','Brain'),('2-HIGH',1,'early','Left eye'),('3-MEDIUM',2,'late','Heart'),('4-NOT SPECIFIED',3,'late','Gills'),('5-LOW',4,'late','Blood')) n(organ,ordinal,layer,name) ON n.organ=REPLACE('7B_'||o.organ,'7B_','') GROUP BY 1,2,3", "fx_obs")
def organ_names(f: Fixture) -> DataFrame:
    """Cell states by the table of organs: order, germ layer and name, joined without the sample's prefix."""
    table = f.spark.createDataFrame(_NAMES, "organ string, ordinal int, layer string, name string")
    state = f.obs.select(F.concat(F.lit("7B_"), "organ").alias("state"), "abundance")
    named = state.withColumn("organ", F.regexp_replace("state", "^7B_", "")).join(F.broadcast(table), "organ")
    return named.groupBy("layer", "name", "ordinal").agg(F.sum("abundance").alias("cells"))


@plan("""SELECT o_orderstatus AS setting, COUNT(*) AS n, CONCAT(o_orderstatus, ' & ', COUNT(*), format(' & {:.1f} ({:.1f})& {:.3f} ({:.3f})', AVG(o_orderkey%300), SQRT(VAR_POP(o_orderkey%300)/COUNT(*)), AVG(o_custkey%100), SQRT(VAR_POP(o_custkey%100)/COUNT(*))), chr(92), chr(92)) AS line FROM orders GROUP BY 1""")
def setting_table(f: Fixture) -> DataFrame:
    """n, mean and error (population variance) of leaves and of a metric for each setting, as a line of a LaTeX table."""
    rows = f.orders.select(F.col("o_orderstatus").alias("setting"), (F.col("o_orderkey") % 300).alias("leaves"), (F.col("o_custkey") % 100).alias("metric"))
    stat = lambda c: (F.avg(c), F.sqrt(F.var_pop(c) / F.count("*")))
    line = F.format_string("%s & %d & %.1f (%.1f)& %.03f (%.03f)\\\\", F.col("setting"), F.count("*"), *stat("leaves"), *stat("metric"))
    return rows.groupBy("setting").agg(F.count("*").alias("n"), line.alias("line"))


@plan("SELECT method, seed, metric, value FROM (SELECT o_orderpriority AS method, o_orderkey AS seed, CAST(o_totalprice AS DOUBLE) AS price, CAST(o_orderkey%13 AS DOUBLE) AS rf, CAST(o_custkey AS DOUBLE) AS tau FROM orders) UNPIVOT (value FOR metric IN (price, rf, tau))", doubles="value")
def tidy_metrics(f: Fixture) -> DataFrame:
    wide = f.orders.select(F.col("o_orderpriority").alias("method"), F.col("o_orderkey").alias("seed"), F.col("o_totalprice").cast("double").alias("price"), (F.col("o_orderkey") % 13).cast("double").alias("rf"), F.col("o_custkey").cast("double").alias("tau"))
    return wide.unpivot(["method", "seed"], ["price", "rf", "tau"], "metric", "value")


@plan("SELECT x.organ, many, one, many-one AS delta FROM (SELECT organ, COUNT(DISTINCT allele_str) AS many, COUNT(DISTINCT pairs) AS one FROM fx_obs GROUP BY 1) x", "fx_obs")
def allele_counts_delta(f: Fixture) -> DataFrame:
    """Distinct alleles under two designs of each setting, and their difference."""
    both = f.obs.groupBy("organ").agg(F.count_distinct("allele_str").alias("many"), F.count_distinct("pairs").alias("one"))
    return both.withColumn("delta", F.col("many") - F.col("one"))


@plan("SELECT simulation, n FROM (SELECT o_custkey%200 AS simulation, COUNT(*) AS n FROM orders GROUP BY 1) x WHERE n > 0.85*(SELECT AVG(n) FROM (SELECT COUNT(*) AS n FROM orders GROUP BY o_custkey%200) y)")
def enough_observed(f: Fixture) -> DataFrame:
    """Simulations with more than 85 % of the observations of the real data (their mean)."""
    counts = f.orders.groupBy((F.col("o_custkey") % 200).alias("simulation")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.avg("n").alias("real")))).where(F.col("n") > 0.85 * F.col("real")).select("simulation", "n")


@plan("SELECT idx, iter, log_lik, MAX(log_lik) OVER (PARTITION BY idx ORDER BY iter, run) AS best FROM (SELECT o_custkey%50 AS idx, o_orderkey//50 AS iter, o_orderkey AS run, CAST(o_totalprice AS DOUBLE) AS log_lik FROM orders) x", doubles="log_lik best")
def training_history(f: Fixture) -> DataFrame:
    """A fit's metric by iteration and the best so far; a fit's history is a few thousand rows."""
    rows = f.orders.select((F.col("o_custkey") % 50).alias("idx"), F.expr("o_orderkey div 50").alias("iter"), F.col("o_orderkey").alias("run"), F.col("o_totalprice").cast("double").alias("log_lik"))
    return rows.withColumn("best", F.max("log_lik").over(Window.partitionBy("idx").orderBy("iter", "run"))).drop("run")


@plan("SELECT organ, CAST(SUM(abundance) AS BIGINT) AS cells, 100.0*MIN(abundance)/SUM(abundance) AS low, 100.0*MAX(abundance)/SUM(abundance) AS high FROM fx_leaf GROUP BY 1", "fx_leaf", doubles="low high")
def organ_scales(f: Fixture) -> DataFrame:
    """Total cells of an organ over all leaves, and the least and greatest share of a leaf in percent."""
    share = lambda v: 100 * v / F.sum("abundance")
    return f.leaf.groupBy("organ").agg(F.sum("abundance").alias("cells"), share(F.min("abundance")).alias("low"), share(F.max("abundance")).alias("high"))


@plan("SELECT start_pos, start_pos+del_len AS end_pos, COUNT(*) AS n FROM fx_event GROUP BY 1,2", "fx_event")
def event_boundaries(f: Fixture) -> DataFrame:
    return f.event.groupBy("start_pos", (F.col("start_pos") + F.col("del_len")).alias("end_pos")).agg(F.count("*").alias("n"))


@plan("SELECT corr(o_totalprice, o_orderkey%97) AS r, COUNT(*) AS n FROM orders", doubles="r")
def score_distance(f: Fixture) -> DataFrame:
    """Correlation of a fit's score with its distance from the truth."""
    return _results(f).agg(stats.correlation("log_lik", "parsimony").alias("r"), F.count("*").alias("n"))


_PARAM = "p AS (SELECT o_orderpriority AS fit, o_orderkey%10 AS target, AVG(o_totalprice)/1000 AS rate FROM orders GROUP BY 1,2), t AS (SELECT target, AVG(rate) AS truth FROM p GROUP BY 1)"


@plan(with_views(_PARAM, "SELECT fit, SQRT(SUM((rate-truth)*(rate-truth))) AS l2, SUM(ABS(rate-truth))/SUM(ABS(truth)) AS relative_l1, corr(rate,truth) AS r FROM p JOIN t USING (target) GROUP BY 1"), doubles="l2 relative_l1 r")
def parameter_distances(f: Fixture) -> DataFrame:
    """Fitted rates against the truth: Euclidean distance, relative L1 distance and correlation."""
    p = f.orders.groupBy(F.col("o_orderpriority").alias("fit"), (F.col("o_orderkey") % 10).alias("target")).agg((F.avg("o_totalprice") / 1000).alias("rate"))
    both = p.join(F.broadcast(p.groupBy("target").agg(F.avg("rate").alias("truth"))), "target")
    off = F.col("rate") - F.col("truth")
    return both.groupBy("fit").agg(F.sqrt(F.sum(off * off)).alias("l2"), (F.sum(F.abs(off)) / F.sum(F.abs("truth"))).alias("relative_l1"), stats.correlation("rate", "truth").alias("r"))


# -- samples ---------------------------------------------------------------------------
@plan("SELECT cell_id, abundance FROM fx_obs ORDER BY -LN((1+('0x'||substr(md5('7|'||cell_id),1,8))::BIGINT)/4294967297.0E0)/abundance, cell_id LIMIT 100", "fx_obs")
def weighted_leaves(f: Fixture) -> DataFrame:
    """A hundred observations without replacement, the chance in proportion to abundance."""
    return observe.weighted_sample(f.obs.select("cell_id", "abundance"), 100, 7, "cell_id")


@plan("SELECT substr(n.node_id,1,1) AS kind, COUNT(*) AS n FROM fx_node n WHERE n.node_id IN (SELECT c.anc_id FROM closure c JOIN fx_node l ON l.node_id=c.desc_id AND l.is_leaf WHERE (1+('0x'||substr(md5('3|'||l.node_id),1,8))::BIGINT)/4294967297.0E0 < 0.02) GROUP BY 1", "closure")
def sampled_leaves(f: Fixture) -> DataFrame:
    """Every leaf with a chance of 0.02, and the nodes above those taken, by kind."""
    taken = f.node.where("is_leaf").where(observe.chance(3, "node_id") < 0.02).select("node_id")
    return trees.with_kept_leaves(f.node, f.closure, taken).groupBy(F.substring("node_id", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


@plan("SELECT fold, COUNT(*) AS n, CAST(SUM(abundance) AS BIGINT) AS cells FROM (SELECT CAST((ROW_NUMBER() OVER (PARTITION BY organ ORDER BY md5('5|'||cell_id), cell_id)-1)%4 AS INT) AS fold, abundance FROM fx_obs) x GROUP BY 1", "fx_obs")
def folds(f: Fixture) -> DataFrame:
    """Four folds of equal size within each organ, by the order of digests."""
    return observe.folds(f.obs, 4, 5, "cell_id", "organ").groupBy("fold").agg(F.count("*").alias("n"), F.sum("abundance").alias("cells"))


_CHANCE = "((1+('0x'||substr(md5('4|'||{}),1,8))::BIGINT)/4294967297.0E0)"
_HELD = f"""ow AS (SELECT l.node_id, n.parent_id, l.pairs AS signature, l.abundance FROM fx_leaf l JOIN fx_node n ON n.node_id=l.node_id), ch AS (SELECT parent_id, COUNT(*) AS children FROM fx_node WHERE parent_id IS NOT NULL GROUP BY 1 HAVING COUNT(*)-1>2),
 gr AS (SELECT fold, ow.parent_id, signature, COUNT(*) AS n, SUM(abundance) AS w, MIN(children) AS children FROM ow JOIN ch ON ch.parent_id=ow.parent_id, (SELECT UNNEST(range(3)) AS fold) f GROUP BY 1,2,3),
 rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY fold, parent_id ORDER BY -LN({_CHANCE.format("fold||'|'||parent_id||'|'||signature")})/w, signature) AS r, GREATEST(1, FLOOR(0.33E0*COUNT(*) OVER (PARTITION BY fold, parent_id))) AS take FROM gr),
 gn AS (SELECT fold, ow.*, {_CHANCE.format("fold||'|'||node_id")} AS u FROM rk JOIN ow ON ow.parent_id=rk.parent_id AND ow.signature=rk.signature WHERE r<=take AND children-n>2)"""


@plan(with_views(_HELD, "SELECT CAST(fold AS INT) AS fold, parent_id, signature, node_id, ROW_NUMBER() OVER (PARTITION BY fold, parent_id, signature ORDER BY u, node_id)=1 AS validation FROM gn"), "fx_leaf", "fx_node")
def multifurcation_folds(f: Fixture) -> DataFrame:
    """Three folds: below every node with enough children a third of the kinds of leaves goes, one leaf of each validates."""
    return observe.held_out_leaves(f.node, f.leaf.select("node_id", F.col("pairs").alias("signature"), "abundance"), 3, seed=4)


# -- distributions ---------------------------------------------------------------------
#: Laws of the left trims of each target's events: rates are their means (and a half), the binomial's chance has the same mean.
_TRIMS = "r AS (SELECT min_target AS target, COUNT(*) AS n, AVG(19+27*min_target-start_pos)+0.5E0 AS rate FROM fx_event GROUP BY 1), k AS (SELECT UNNEST(range(1,22)) AS k)"
_LAWS = f"""{_TRIMS}, p AS (SELECT 'poisson' AS law, target, n, k, EXP(-rate+(k-1)*LN(rate)-lgamma(k)) AS p FROM r, k
 UNION ALL SELECT 'nbinom', target, n, k, EXP(lgamma(k-1+2.5E0)-lgamma(k)-lgamma(2.5E0)+2.5E0*LN(1-rate/(rate+2.5E0))+(k-1)*LN(rate/(rate+2.5E0))) FROM r, k), w AS (SELECT law, target, n, k, p/SUM(p) OVER (PARTITION BY law, target) AS p FROM p)"""


@plan(with_views(_LAWS, "SELECT law, target, n, k, p FROM w"), "fx_event", doubles="p")
def bounded_distributions(f: Fixture) -> DataFrame:
    """For each target Poisson and negative binomial laws from 1, conditional on at most 21, with the mean of its left trims."""
    trims = ev.trims(ev.with_design(f.event, f.target)).groupBy(F.col("min_target").alias("target")).agg(F.count("*").alias("n"), (F.avg("left_trim") + 0.5).alias("rate"))
    grid = trims.select("target", "n", "rate", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(21).cast("long"))).alias("k"))
    one = lambda name, log_p: di.conditional(grid.select(F.lit(name).alias("law"), "target", "n", "k", log_p.alias("log_p")), "law", "target")
    k, rate = F.col("k"), F.col("rate")
    return one("poisson", di.poisson_log(k - 1, rate)).union(one("nbinom", di.nbinom_log(k - 1, 2.5, rate / (rate + 2.5)))).select("law", "target", "n", "k", "p")


@plan(with_views(_LAWS, "SELECT law, target, SUM(k*p) AS mean, SQRT(SUM(k*k*p)-SUM(k*p)*SUM(k*p)) AS sd FROM w GROUP BY 1,2"), "fx_event", doubles="mean sd")
def distribution_moments(f: Fixture) -> DataFrame:
    return di.moments(bounded_distributions(f), "law", "target")


@plan("SELECT o_orderkey AS fit, t0, t1, (t1-t0) - 0.5E0*0.3E0*(t1*t1-t0*t0)/1E0 AS decayed, 1/(1+EXP(-x)) AS sigmoid FROM (SELECT o_orderkey, (o_orderkey%10)/20.0E0 AS t0, (10+o_orderkey%10)/20.0E0 AS t1, (o_custkey%21-10)/4.0E0 AS x FROM orders) z", doubles="t0 t1 decayed sigmoid")
def decay_factors(f: Fixture) -> DataFrame:
    """The integral of 1 - c t / T over a branch, and logistic values."""
    rows = f.orders.select(F.col("o_orderkey").alias("fit"), ((F.col("o_orderkey") % 10) / 20.0).alias("t0"), ((10 + F.col("o_orderkey") % 10) / 20.0).alias("t1"), ((F.col("o_custkey") % 21 - 10) / 4.0).alias("x"))
    return rows.select("fit", "t0", "t1", di.decay(F.col("t0"), F.col("t1"), 0.3, 1.0).alias("decayed"), di.sigmoid(F.col("x")).alias("sigmoid"))


_BRANCH = "b AS (SELECT LN(dist) AS x, CASE WHEN is_leaf THEN 'leaf' ELSE 'inner' END AS kind FROM fx_node WHERE dist>0)"


@plan(with_views(_BRANCH, "SELECT kind, COUNT(*) AS n, VAR_POP(x) AS penalty FROM b GROUP BY 1 UNION ALL SELECT 'all', COUNT(*), VAR_POP(x) FROM b"), "fx_node", doubles="penalty")
def branch_penalty(f: Fixture) -> DataFrame:
    """Variance of log branch lengths: leaves, inner branches, all."""
    rows = f.node.where("dist > 0").select(F.when(F.col("is_leaf"), "leaf").otherwise("inner").alias("kind"), F.log("dist").alias("x"))
    one = rows.groupBy("kind").agg(F.count("*").alias("n"), F.var_pop("x").alias("penalty"))
    return one.union(rows.agg(F.lit("all"), F.count("*"), F.var_pop("x")))
