"""A lineage data set derived from the driver's tables: barcode design, indel events, observations and a tree.

The SQL of each view runs on Spark and, but for the string aggregate, on DuckDB.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import trees
from ..tables import written

#: Fixed values of the design: ten targets, cut sites 27 bases apart from base 19.
TARGETS, FIRST_CUT, STEP, LENGTH = 10, 19, 27, 284

TARGET = f"""SELECT t AS target, {FIRST_CUT}+{STEP}*t AS cut, 13+27*t AS pos_lo, 24+27*t AS pos_hi,
 CASE WHEN t=0 THEN 19 ELSE 26 END AS left_max, CASE WHEN t=9 THEN 21 ELSE 26 END AS right_max
FROM (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9)) AS v(t)"""

EVENT = """SELECT cell_id, CAST(19+27*min_target-lt AS INT) AS start_pos, CAST(27*(max_target-min_target)+lt+rt AS INT) AS del_len,
 CAST(min_target AS INT) AS min_target, CAST(max_target AS INT) AS max_target, SUBSTRING('acgt',1,il) AS insert_str
FROM (SELECT cell_id, ln-1 AS min_target, LEAST(ln-1 + CASE WHEN pk%5=0 THEN 2 ELSE 0 END, COALESCE(nx,11)-2, 9) AS max_target,
  CASE WHEN pv IS NULL AND ln>1 AND pk%7=0 THEN 23 ELSE CAST(pk%6 AS INT) END AS lt, CAST(sk%6 AS INT) AS rt, CAST(sk%4 AS INT) AS il
 FROM (SELECT d.*, LEAD(ln) OVER (PARTITION BY cell_id ORDER BY ln) AS nx, LAG(ln) OVER (PARTITION BY cell_id ORDER BY ln) AS pv
  FROM (SELECT l_orderkey AS cell_id, l_linenumber AS ln, MIN(l_partkey) AS pk, MIN(l_suppkey) AS sk FROM lineitem GROUP BY l_orderkey, l_linenumber) d) w) s"""

_KEY = "CONCAT_WS('_', CAST(start_pos AS STRING), CAST(del_len AS STRING), CAST(min_target AS STRING), CAST(max_target AS STRING), insert_str)"
OBS = """SELECT o.o_orderkey AS cell_id, o.o_orderpriority AS organ, CAST(1+o.o_orderkey%5 AS BIGINT) AS abundance,
 COALESCE(a.allele_str,'no_evts') AS allele_str, COALESCE(a.pairs,'no_evts') AS pairs
FROM orders o LEFT JOIN (SELECT cell_id, {key} AS allele_str, {pairs} AS pairs FROM fx_event GROUP BY cell_id) a ON a.cell_id=o.o_orderkey"""
_PAIR = "CONCAT(CAST(min_target AS STRING), '-', CAST(max_target AS STRING))"
OBS_SPARK = OBS.format(key=f"LISTAGG({_KEY}, '=') WITHIN GROUP (ORDER BY start_pos)", pairs=f"LISTAGG({_PAIR}, ' ') WITHIN GROUP (ORDER BY start_pos)")
OBS_DUCK = OBS.format(key=f"STRING_AGG({_KEY}, '=' ORDER BY start_pos)", pairs=f"STRING_AGG({_PAIR}, ' ' ORDER BY start_pos)")

NODE = """WITH i AS (
 SELECT 'ROOT' AS node_id, CAST(NULL AS STRING) AS parent_id, 0 AS d20
 UNION ALL SELECT CONCAT('R',CAST(r_regionkey AS STRING)),'ROOT',CAST(1+r_regionkey%5 AS INT) FROM region
 UNION ALL SELECT CONCAT('N',CAST(n_nationkey AS STRING)),CONCAT('R',CAST(n_regionkey AS STRING)),CAST(1+n_nationkey%4 AS INT) FROM nation
 UNION ALL SELECT CONCAT('C',CAST(c_custkey AS STRING)),CONCAT('N',CAST(c_nationkey AS STRING)),CAST(1+c_custkey%5 AS INT) FROM customer),
 p AS (SELECT c.node_id, c.d20+n.d20+r.d20 AS dep FROM i c JOIN i n ON c.parent_id=n.node_id JOIN i r ON n.parent_id=r.node_id WHERE c.node_id LIKE 'C%')
SELECT node_id, parent_id, d20/20.0E0 AS dist, false AS is_leaf FROM i
UNION ALL SELECT CONCAT('O',CAST(o_orderkey AS STRING)), p.node_id, (20-p.dep)/20.0E0, true FROM orders JOIN p ON p.node_id=CONCAT('C',CAST(o_custkey AS STRING))"""

LEAF = "SELECT CONCAT('O',CAST(cell_id AS STRING)) AS node_id, organ, abundance, allele_str, pairs FROM fx_obs"

#: Tissues of a leaf: its organ, and for every seventh cell the next one as well.
TISSUE = """SELECT CONCAT('O',CAST(cell_id AS STRING)) AS node_id, organ, abundance FROM fx_obs
UNION ALL SELECT CONCAT('O',CAST(cell_id AS STRING)), CASE SUBSTRING(organ,1,1) WHEN '1' THEN '2-HIGH' WHEN '2' THEN '3-MEDIUM' WHEN '3' THEN '4-NOT SPECIFIED' WHEN '4' THEN '5-LOW' ELSE '1-URGENT' END, CAST(1+cell_id%3 AS BIGINT) FROM fx_obs WHERE cell_id%7=0"""

#: Raw events of a read: off their cut sites, overlapping, past the end; every fourth order has insertions.
RAW = """SELECT cell_id, CAST(GREATEST(19+27*t-pk%14+5, 0) AS INT) AS start_pos, CASE WHEN ins='' THEN CAST(27*(mx-t)+sk%15+CASE WHEN mx=9 AND pk%3=0 THEN 30 ELSE 0 END AS INT) ELSE 0 END AS del_len,
 CAST(t AS INT) AS min_target, CAST(CASE WHEN ins='' THEN mx ELSE t END AS INT) AS max_target, ins AS insert_str
FROM (SELECT cell_id, t, LEAST(t+CASE WHEN pk%5=0 THEN 2 ELSE 0 END, 9) AS mx, pk, sk, CASE WHEN cell_id%4=0 THEN SUBSTRING('acgt',1,CAST(1+pk%4 AS INT)) ELSE '' END AS ins
 FROM (SELECT l_orderkey AS cell_id, CASE WHEN l_linenumber>=5 THEN l_linenumber+2 ELSE l_linenumber-1 END AS t, MIN(l_partkey) AS pk, MIN(l_suppkey) AS sk FROM lineitem GROUP BY l_orderkey, l_linenumber) d) w"""

#: Another tree over the same leaves: every third customer hangs on the next nation; leaves end at the same height.
OTHER = NODE.replace("CONCAT('N',CAST(c_nationkey AS STRING))", "CONCAT('N',CAST((c_nationkey+CASE WHEN c_custkey%3=0 THEN 1 ELSE 0 END)%25 AS STRING))")

#: Alleles of all nodes, kept or changed on the way down.
LABEL = """WITH c AS (SELECT c_custkey, n_nationkey, CASE WHEN c_custkey%4=0 THEN CONCAT('c',CAST(c_custkey AS STRING)) WHEN n_nationkey%3=0 THEN CONCAT('n',CAST(n_nationkey AS STRING)) ELSE 'x' END AS label FROM customer JOIN nation ON n_nationkey=c_nationkey)
SELECT 'ROOT' AS node_id, 'x' AS label UNION ALL SELECT CONCAT('R',CAST(r_regionkey AS STRING)), 'x' FROM region
UNION ALL SELECT CONCAT('N',CAST(n_nationkey AS STRING)), CASE WHEN n_nationkey%3=0 THEN CONCAT('n',CAST(n_nationkey AS STRING)) ELSE 'x' END FROM nation
UNION ALL SELECT CONCAT('C',CAST(c_custkey AS STRING)), label FROM c
UNION ALL SELECT CONCAT('O',CAST(o_orderkey AS STRING)), CASE WHEN o_orderkey%2=0 THEN label ELSE CONCAT('o',CAST(o_orderkey%5 AS STRING)) END FROM orders JOIN c ON c_custkey=o_custkey"""

#: Rows of lineitem for a task, beyond the session's number of shuffle partitions.
ITEMS = 200_000

_ORDER = ("fx_target", "fx_event", "fx_raw", "fx_obs", "fx_node", "fx_other", "fx_label", "fx_leaf", "fx_tissue")
_TABLES = ("region", "nation", "customer", "orders", "lineitem", "part", "supplier")
_AT_REST: dict[tuple[str, str, str], DataFrame] = {}


class Fixture:
    """The views as DataFrames: f.event, f.obs, f.node, f.leaf, f.target, f.raw, f.tissue; f.closure, at rest.  Node table and
    closure are written once for a session and a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        for t in _TABLES:
            setattr(self, t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        self.target = spark.sql(TARGET)

    @cached_property
    def _items(self) -> DataFrame:
        """lineitem dealt by order once, for its groups, windows and lists alike, to more tasks the more rows it has."""
        rows = self.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        tasks = -(-self.lineitem.count() // ITEMS)
        few = tasks <= int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition("l_orderkey") if few else rows.repartition(tasks, "l_orderkey")

    @cached_property
    def event(self) -> DataFrame:
        return self._sql(EVENT, lineitem=self._items)

    @cached_property
    def raw(self) -> DataFrame:
        return self._sql(RAW, lineitem=self._items)

    @cached_property
    def obs(self) -> DataFrame:
        return self._sql(OBS_SPARK, orders=self.orders, fx_event=self.event)

    @cached_property
    def leaf(self) -> DataFrame:
        return self._sql(LEAF, fx_obs=self.obs)

    @cached_property
    def tissue(self) -> DataFrame:
        return self._sql(TISSUE, fx_obs=self.obs.select("cell_id", "organ", "abundance"))

    @property
    def node(self) -> DataFrame:
        return self.at_rest("nodes", lambda: written(self._sql(NODE, **{t: getattr(self, t) for t in ("region", "nation", "customer", "orders")}), "nodes"))

    @property
    def other(self) -> DataFrame:
        return self.at_rest("other-nodes", lambda: written(self._sql(OTHER, **{t: getattr(self, t) for t in ("region", "nation", "customer", "orders")}), "nodes"))

    @property
    def other_upper(self) -> DataFrame:
        """The other tree's closure without its leaves."""
        return self.at_rest("other-upper", lambda: trees.closure(self.other.where("NOT is_leaf")))

    @property
    def other_closure(self) -> DataFrame:
        return self.at_rest("other-closure", lambda: written(trees.with_ends(self.other_upper, self.other.where("is_leaf")), "closure"))

    @cached_property
    def label(self) -> DataFrame:
        return self._sql(LABEL, **{t: getattr(self, t) for t in ("region", "nation", "customer", "orders")})

    @property
    def upper(self) -> DataFrame:
        """The tree's closure without its leaves."""
        return self.at_rest("upper", lambda: trees.closure(self.node.where("NOT is_leaf")))

    @property
    def closure(self) -> DataFrame:
        return self.at_rest("closure", lambda: written(trees.with_ends(self.upper, self.node.where("is_leaf")), "closure"))

    def at_rest(self, name: str, make) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _AT_REST:
            _AT_REST[key] = make()
        return _AT_REST[key]

    def _sql(self, text: str, **frames: DataFrame) -> DataFrame:
        for name in frames:
            text = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)
        return self.spark.sql(text, **frames)


def duck(select: str, *views: str) -> str:
    """DuckDB SQL with the named views (and those they need) before it; recursive, so that trees can be walked."""
    need = set(views)
    if "closure" in need:
        need.add("fx_node")
    if "closure2" in need:
        need.add("fx_other")
    if need & {"fx_leaf", "fx_tissue"}:
        need.add("fx_obs")
    if "fx_obs" in need:
        need.add("fx_event")
    text = {"fx_target": TARGET, "fx_event": EVENT, "fx_raw": RAW, "fx_obs": OBS_DUCK, "fx_node": NODE, "fx_other": OTHER, "fx_label": LABEL, "fx_leaf": LEAF, "fx_tissue": TISSUE}
    parts = [f"{v} AS ({text[v]})" for v in _ORDER if v in need]
    for n, nodes in (("", "fx_node"), ("2", "fx_other")):
        if f"closure{n}" in need:
            parts.append(f"closure{n}(anc_id, desc_id, hops, path_len) AS (SELECT node_id, node_id, 0, 0.0E0 FROM {nodes} UNION ALL SELECT n.parent_id, c.desc_id, c.hops+1, c.path_len+n.dist FROM closure{n} c JOIN {nodes} n ON n.node_id=c.anc_id WHERE n.parent_id IS NOT NULL)")
            parts.append(f"depth{n} AS (SELECT desc_id AS node_id, path_len AS depth FROM closure{n} WHERE anc_id='ROOT')")
    return f"WITH RECURSIVE {', '.join(parts)} {select}" if parts else select
