"""Queries on correlations, bootstraps and permutation tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import stats, trees
from .fixtures import Fixture
from .registry import plan, with_views

_RATES = "x AS (SELECT o.organ, e.min_target AS target, COUNT(*) AS n FROM fx_event e JOIN fx_obs o ON o.cell_id=e.cell_id GROUP BY 1,2)"


def _rates(f: Fixture) -> DataFrame:
    return f.event.join(f.obs.select("cell_id", "organ"), "cell_id").groupBy("organ", F.col("min_target").alias("target")).agg(F.count("*").alias("n"))


@plan(with_views(_RATES + ", k AS (SELECT *, RANK() OVER (PARTITION BY organ ORDER BY n)+(COUNT(*) OVER (PARTITION BY organ, n)-1)/2 AS rk FROM x)", "SELECT a.organ AS a, b.organ AS b, ROUND(corr(a.rk,b.rk),9) AS rho FROM k a JOIN k b ON a.target=b.target AND a.organ<b.organ GROUP BY 1,2"), "fx_obs", doubles="rho")
def spearman_rates(f: Fixture) -> DataFrame:
    return stats.spearman(_rates(f), "organ", "target", "n").withColumn("rho", F.round("rho", 9))


_RHO = _RATES + ", k AS (SELECT *, RANK() OVER (PARTITION BY organ ORDER BY n)+(COUNT(*) OVER (PARTITION BY organ, n)-1)/2 AS rk FROM x), m AS (SELECT a.organ AS a, b.organ AS b, corr(a.rk,b.rk) AS rho FROM k a JOIN k b ON a.target=b.target AND a.organ<b.organ GROUP BY 1,2)"
_SUBJECTS = "sb AS (SELECT organ AS subject, ROW_NUMBER() OVER (ORDER BY organ)-1 AS i FROM (SELECT DISTINCT organ FROM x) z), dr AS (SELECT r AS replicate, s.i AS place, t.subject FROM sb s, (SELECT UNNEST(range(200)) AS r) q JOIN sb t ON t.i=(s.i*(r+1)*2+r*3+s.i%(r+2))%5)"


def _draws(f: Fixture, subjects: list[str], replicates: int = 200) -> DataFrame:
    """A table of drawn subjects: replicates by modular arithmetic, the same in any engine."""
    rows = [(r, i, subjects[(i * (r + 1) * 2 + r * 3 + i % (r + 2)) % len(subjects)]) for r in range(replicates) for i in range(len(subjects))]
    return f.spark.createDataFrame(rows, "replicate long, place long, subject string")


@plan(with_views(_RHO, "SELECT AVG(rho) AS mean, quantile_cont(rho,0.025) AS lo, quantile_cont(rho,0.975) AS hi FROM m"), "fx_obs", doubles="mean lo hi")
def mean_correlation(f: Fixture) -> DataFrame:
    return stats.mean_correlation(stats.spearman(_rates(f), "organ", "target", "n"))


ORGANS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@plan(with_views(_RHO + ", " + _SUBJECTS + ", w AS (SELECT a.replicate, AVG(CASE WHEN a.subject=b.subject THEN 1E0 ELSE m.rho END) AS m FROM dr a JOIN dr b ON a.replicate=b.replicate AND a.place<b.place LEFT JOIN m ON m.a=LEAST(a.subject,b.subject) AND m.b=GREATEST(a.subject,b.subject) GROUP BY 1)",
 "SELECT COUNT(*) AS replicates, quantile_cont(m,0.025) AS lo, quantile_cont(m,0.975) AS hi FROM w"), "fx_obs", doubles="lo hi")
def bootstrap(f: Fixture) -> DataFrame:
    matrix = stats.spearman(_rates(f), "organ", "target", "n")
    return stats.bootstrap_pairs(matrix, _draws(f, ORGANS))


_TWO = _RATES + """, y AS (SELECT o.o_orderstatus AS status, e.min_target AS target, COUNT(*) AS n FROM fx_event e JOIN orders o ON o.o_orderkey=e.cell_id GROUP BY 1,2),
 k1 AS (SELECT *, RANK() OVER (PARTITION BY organ ORDER BY n)+(COUNT(*) OVER (PARTITION BY organ, n)-1)/2 AS rk FROM x), k2 AS (SELECT *, RANK() OVER (PARTITION BY status ORDER BY n)+(COUNT(*) OVER (PARTITION BY status, n)-1)/2 AS rk FROM y),
 m AS (SELECT a.organ AS a, b.status AS b, corr(a.rk,b.rk) AS rho FROM k1 a JOIN k2 b USING (target) GROUP BY 1,2), """ + _SUBJECTS + """,
 s2 AS (SELECT status AS subject, ROW_NUMBER() OVER (ORDER BY status)-1 AS i FROM (SELECT DISTINCT status FROM y) z), d2 AS (SELECT r AS replicate, s.i AS place, t.subject FROM s2 s, (SELECT UNNEST(range(200)) AS r) q JOIN s2 t ON t.i=(s.i*(r+1)*2+r*3+s.i%(r+2))%3),
 w AS (SELECT a.replicate, AVG(m.rho) AS m FROM dr a JOIN d2 b ON a.replicate=b.replicate AND a.place<b.place LEFT JOIN m ON m.a=a.subject AND m.b=b.subject GROUP BY 1)"""


@plan(with_views(_TWO, "SELECT COUNT(*) AS replicates, quantile_cont(m,0.025) AS lo, quantile_cont(m,0.975) AS hi FROM w"), "fx_obs", doubles="lo hi")
def two_sample_bootstrap(f: Fixture) -> DataFrame:
    status = f.event.join(f.orders.select(F.col("o_orderkey").alias("cell_id"), F.col("o_orderstatus").alias("status")), "cell_id").groupBy("status", F.col("min_target").alias("target")).agg(F.count("*").alias("n"))
    matrix = stats.cross_spearman(_rates(f), status, "organ", "status", "target", "n")
    return stats.bootstrap_pairs(matrix, _draws(f, ORGANS), _draws(f, ["F", "O", "P"]))


#: Replicates of shuffled labels: in each, leaves take labels in the order of digests.
SHUFFLES = 8
_SHUFFLED = f"""ix AS (SELECT node_id, CAST(ROW_NUMBER() OVER (ORDER BY node_id)-1 AS BIGINT) AS i FROM (SELECT DISTINCT node_id FROM fx_tissue) z), rp AS (SELECT CAST(UNNEST(range({SHUFFLES})) AS INT) AS replicate),
 og AS (SELECT DISTINCT organ FROM fx_tissue), rk AS (SELECT replicate, node_id, ROW_NUMBER() OVER (PARTITION BY replicate ORDER BY md5(concat_ws('|','leaf',replicate,node_id,'')), node_id)-1 AS i FROM rp, ix), gv AS (SELECT rk.replicate, ix.node_id, rk.node_id AS giver FROM rk JOIN ix USING (i)),
 ab AS (SELECT g.replicate, g.node_id, t.abundance, ROW_NUMBER() OVER (PARTITION BY g.replicate, g.node_id ORDER BY md5(concat_ws('|','abundance',g.replicate,g.node_id,t.organ))) AS k FROM gv g JOIN fx_tissue t ON t.node_id=g.giver),
 oo AS (SELECT g.replicate, g.node_id, og.organ, ROW_NUMBER() OVER (PARTITION BY g.replicate, g.node_id ORDER BY md5(concat_ws('|','organ',g.replicate,g.node_id,og.organ))) AS k FROM gv g, og),
 sh AS (SELECT ab.replicate, ab.node_id, oo.organ, ab.abundance FROM ab JOIN oo USING (replicate, node_id, k))"""


def shuffled(f: Fixture) -> DataFrame:
    return stats.shuffled_labels(f.tissue, SHUFFLES)


@plan(with_views(_SHUFFLED, "SELECT replicate, organ, COUNT(*) AS n, CAST(SUM(abundance) AS BIGINT) AS cells, MIN(node_id) AS first FROM sh GROUP BY 1,2"), "fx_tissue")
def label_shuffle(f: Fixture) -> DataFrame:
    return shuffled(f).groupBy("replicate", "organ").agg(F.count("*").alias("n"), F.sum("abundance").alias("cells"), F.min("node_id").alias("first"))


def _matrix_sql(name: str, rows: str, n: str) -> str:
    """Symmetric tissue distances of labels (replicate, node_id, organ, abundance) over tree n."""
    nodes = "fx_other" if n else "fx_node"
    return f"""o{name} AS (SELECT DISTINCT t.replicate, c.anc_id, t.organ AS other FROM closure{n} c JOIN {rows} t ON t.node_id=c.desc_id),
 u{name} AS (SELECT t.replicate, t.node_id, t.organ, t.abundance, o.other, ARG_MIN(CASE WHEN c.hops=0 THEN n.dist/2 ELSE 1-d.depth END, c.hops) AS len FROM {rows} t JOIN closure{n} c ON c.desc_id=t.node_id JOIN depth{n} d ON d.node_id=c.anc_id JOIN {nodes} n ON n.node_id=c.anc_id JOIN o{name} o ON o.anc_id=c.anc_id AND o.replicate=t.replicate WHERE c.anc_id!='ROOT' AND o.other!=t.organ GROUP BY 1,2,3,4,5),
 x{name} AS (SELECT replicate, organ, other, SUM(len*abundance)/SUM(abundance) AS d FROM u{name} GROUP BY 1,2,3), m{name} AS (SELECT a.replicate, a.organ, a.other, (a.d+b.d)/2 AS d FROM x{name} a JOIN x{name} b ON b.replicate=a.replicate AND b.organ=a.other AND b.other=a.organ WHERE a.organ<a.other)"""


@plan(with_views(f"{_SHUFFLED}, al AS (SELECT -1 AS replicate, node_id, organ, abundance FROM fx_tissue UNION ALL SELECT * FROM sh), {_matrix_sql('p', 'al', '')}, {_matrix_sql('q', 'al', '2')}, cr AS (SELECT replicate, corr(mp.d, mq.d) AS r FROM mp JOIN mq USING (replicate, organ, other) GROUP BY 1), ow AS (SELECT r FROM cr WHERE replicate=-1)",
 "SELECT MIN(ow.r) AS r, AVG(CASE WHEN ABS(cr.r)>ABS(ow.r) THEN 1E0 ELSE 0E0 END) AS p, COUNT(*) AS replicates FROM cr, ow WHERE cr.replicate>=0"), "fx_tissue", "closure", "closure2", doubles="r p")
def perm_test(f: Fixture) -> DataFrame:
    """Correlation of two trees' tissue matrices against that of shuffled labels."""
    one, other = trees.numbered_inner(f.node, f.upper), trees.numbered_inner(f.other, f.other_upper)
    side = lambda leaves, n: leaves.select("node_id", *(F.col(c).alias(f"{c}_{n}") for c in ("parent_id", "dist", "height")))
    places = side(one[2], "x").join(side(other[2], "y"), "node_id", "full")
    coded = f.tissue.join(F.broadcast(stats.organ_codes(f.tissue)), "organ").select("node_id", F.col("code").alias("organ"), "abundance")
    own = coded.groupBy("node_id").agg(F.collect_set(F.struct("organ", "abundance")).alias("own")).join(places, "node_id").withColumn("replicate", F.lit(-1))
    labelled = f.at_rest("labelled", lambda: trees.written(own.unionByName(stats.shuffled_sets(f.tissue, SHUFFLES, places, codes=True)).drop("node_id"), "labelled"))
    sets = lambda n: labelled.select("replicate", *(F.col(f"{c}_{n}").alias(c) for c in ("parent_id", "dist", "height")), "own")
    matrix = lambda tree, n: trees.distances_of_sets(*tree[:2], sets(n), "replicate").where("organ < other").select("replicate", "organ", "other", F.col("distance").alias(n))
    both = f.at_rest("matrices", lambda: trees.written(matrix(one, "x").join(matrix(other, "y"), ["replicate", "organ", "other"]), "matrices"))
    return stats.permutation_test(both.where("replicate < 0"), both.where("replicate >= 0"), "x", "y")


@plan(with_views("cl AS (SELECT d.node_id, d.depth, SUM(l.abundance) AS cells FROM depth d JOIN closure c ON c.anc_id=d.node_id AND c.hops>0 JOIN fx_leaf l ON l.node_id=c.desc_id WHERE d.depth>=0.05 AND (SELECT COUNT(*) FROM fx_node k WHERE k.parent_id=d.node_id)>2 GROUP BY 1,2), r AS (SELECT COUNT(*) AS n, regr_slope(depth,LOG2(cells)) AS b, corr(depth,LOG2(cells)) AS r, VAR_POP(LOG2(cells)) AS vx, VAR_POP(depth) AS vy FROM cl), s AS (SELECT *, SQRT((1-r*r)*vy/((n-2)*vx)) AS se FROM r)",
 "SELECT n, -30*60*b AS minutes, -30*60*(b-1.96*se) AS hi, -30*60*(b+1.96*se) AS lo FROM s"), "fx_leaf", "closure", doubles="minutes lo hi")
def division_time(f: Fixture) -> DataFrame:
    """Time between divisions from the slope of depth against log2 of a clade's cells, over 30 hours."""
    from . import topology

    rows = topology.clade_cells(f).withColumn("log_cells", F.log2("cells"))
    scaled = lambda c: -30 * 60 * c
    fit = stats.regression(rows, "depth", "log_cells")
    b, se = F.col("slope"), F.col("slope_se")
    return fit.select("n", scaled(b).alias("minutes"), scaled(b - 1.96 * se).alias("hi"), scaled(b + 1.96 * se).alias("lo"))
