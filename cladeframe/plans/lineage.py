"""Queries that apply the lineage operators to whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import events as ev
from ..functions import status as st
from ..operators import observe, stats, trees
from .fixtures import TARGETS, Fixture
from .registry import plan
from .registry import with_views as _duck

UNIQ = "uniq AS (SELECT DISTINCT start_pos, del_len, min_target, max_target, insert_str FROM fx_event)"
DEACT = """d AS (SELECT e.*, CASE WHEN e.min_target>0 AND e.start_pos <= 24+27*(e.min_target-1) THEN e.min_target-1 ELSE e.min_target END AS min_deact,
 CASE WHEN e.max_target<9 AND 13+27*(e.max_target+1) < e.start_pos+e.del_len THEN e.max_target+1 ELSE e.max_target END AS max_deact FROM fx_event e)"""
MASK = f"""{DEACT}, m AS (SELECT o.cell_id, o.organ, CAST(COALESCE(b.mask,0) AS BIGINT) AS mask FROM fx_obs o
 LEFT JOIN (SELECT cell_id, BIT_OR((1<<(max_deact+1))-(1<<min_deact)) AS mask FROM d GROUP BY cell_id) b ON b.cell_id=o.cell_id)"""


def _unique(f: Fixture) -> DataFrame:
    return f.event.select("start_pos", "del_len", "min_target", "max_target", "insert_str").distinct()


def _dead(f: Fixture) -> DataFrame:
    return ev.deactivated(ev.with_design(f.event, f.target))


def _masks(f: Fixture) -> DataFrame:
    own = _dead(f).groupBy("cell_id").agg(F.bit_or(st.span_mask(F.col("min_deact"), F.col("max_deact"))).alias("mask"))
    return f.obs.join(own, "cell_id", "left").select("cell_id", "organ", F.coalesce("mask", F.lit(0)).cast("long").alias("mask"))


# -- events -----------------------------------------------------------------
@plan(_duck(DEACT, "SELECT cell_id, start_pos, min_target, max_target, min_deact, max_deact FROM d"), "fx_event")
def deact_range(f: Fixture) -> DataFrame:
    return _dead(f).select("cell_id", "start_pos", "min_target", "max_target", "min_deact", "max_deact")


@plan("SELECT cell_id, start_pos, 19+27*min_target-start_pos AS left_trim, start_pos+del_len-(19+27*max_target) AS right_trim FROM fx_event", "fx_event")
def trim_lens(f: Fixture) -> DataFrame:
    return ev.trims(ev.with_design(f.event, f.target)).select("cell_id", "start_pos", "left_trim", "right_trim")


@plan("""SELECT CAST(SUM(CASE WHEN start_pos<0 OR min_target<0 OR min_target>max_target OR del_len<0 THEN 1 ELSE 0 END) AS BIGINT) AS bad_fields,
 CAST(SUM(CASE WHEN nx<=max_target THEN 1 ELSE 0 END) AS BIGINT) AS overlaps,
 CAST(SUM(CASE WHEN lt<0 OR rt<0 OR lt>CASE WHEN min_target=0 THEN 19 ELSE 26 END OR rt>CASE WHEN max_target=9 THEN 21 ELSE 26 END THEN 1 ELSE 0 END) AS BIGINT) AS bad_trims,
 CAST(SUM(CASE WHEN start_pos>19+27*min_target OR start_pos+del_len<19+27*max_target THEN 1 ELSE 0 END) AS BIGINT) AS no_cut, COUNT(*) AS n
FROM (SELECT *, LEAD(min_target) OVER (PARTITION BY cell_id ORDER BY start_pos) AS nx, 19+27*min_target-start_pos AS lt, start_pos+del_len-(19+27*max_target) AS rt FROM fx_event) x""", "fx_event")
def dq_violations(f: Fixture) -> DataFrame:
    x = ev.trims(ev.with_design(f.event, f.target)).withColumn("nx", F.lead("min_target").over(Window.partitionBy("cell_id").orderBy("start_pos")))
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    bad = (F.col("start_pos") < 0) | (F.col("min_target") < 0) | (F.col("min_target") > F.col("max_target")) | (F.col("del_len") < 0)
    trims = (F.least("left_trim", "right_trim") < 0) | (F.col("left_trim") > F.col("left_max")) | (F.col("right_trim") > F.col("right_max"))
    no_cut = (F.col("start_pos") > F.col("left_cut")) | (ev.del_end() < F.col("right_cut"))
    return x.agg(count(bad, "bad_fields"), count(F.col("nx") <= F.col("max_target"), "overlaps"), count(trims, "bad_trims"), count(no_cut, "no_cut"), F.count("*").alias("n"))


@plan("SELECT e.cell_id, e.start_pos, COUNT(*) AS n_cuts, MIN(t.target) AS min_target, MAX(t.target) AS max_target FROM fx_event e JOIN fx_target t ON t.cut BETWEEN e.start_pos AND e.start_pos+e.del_len GROUP BY 1,2", "fx_event", "fx_target")
def encode_ranges(f: Fixture) -> DataFrame:
    hit = f.event.select("cell_id", "start_pos", "del_len").join(F.broadcast(f.target), F.col("cut").between(F.col("start_pos"), ev.del_end()))  # one row a target
    return hit.groupBy("cell_id", "start_pos").agg(F.count("*").alias("n_cuts"), F.min("target").alias("min_target"), F.max("target").alias("max_target"))


_HMID = f"""{DEACT}, g AS (SELECT o.cell_id, t.target, COALESCE(ARG_MIN(CASE WHEN insert_str='' THEN CONCAT(del_len,'D+',start_pos) ELSE CONCAT(del_len,'D+',start_pos,'&',LENGTH(insert_str),'I+',start_pos,'+',insert_str) END, start_pos),'NONE') AS c
 FROM fx_obs o CROSS JOIN fx_target t LEFT JOIN d ON d.cell_id=o.cell_id AND t.target BETWEEN d.min_deact AND d.max_deact GROUP BY 1,2),
 h AS (SELECT cell_id, STRING_AGG(c, '_' ORDER BY target) AS hmid FROM g GROUP BY 1)"""


def _hmids(f: Fixture) -> DataFrame:
    own = _dead(f).groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "del_len", "min_deact", "max_deact", "insert_str"))).alias("events"))
    empty = F.array().cast("array<struct<start_pos:int,del_len:int,min_deact:int,max_deact:int,insert_str:string>>")
    return f.obs.join(own, "cell_id", "left").select("cell_id", ev.hmid(F.coalesce("events", empty), TARGETS).alias("hmid"))


@plan(_duck(_HMID, "SELECT * FROM h"), "fx_obs", "fx_target")
def hmid_write(f: Fixture) -> DataFrame:
    return _hmids(f)


@plan(_duck(_HMID, """SELECT cell_id, e AS event, MIN(target) AS min_target, MAX(target) AS max_target, CAST(MIN(regexp_extract(e,'\\+(\\d+)',1)) AS INT) AS start_pos,
 CAST(MIN(CASE WHEN e LIKE '%D+%' THEN regexp_extract(e,'^(\\d+)D',1) ELSE '0' END) AS INT) AS del_len, MIN(CASE WHEN e LIKE '%I+%' THEN regexp_extract(e,'[a-z]+$',0) ELSE '' END) AS insert_str
 FROM (SELECT cell_id, target, UNNEST(string_split(c,'&')) AS e FROM g WHERE c!='NONE') x GROUP BY 1,2"""), "fx_obs", "fx_target")
def hmid_parse(f: Fixture) -> DataFrame:
    cells = _hmids(f).select("cell_id", F.posexplode(F.split("hmid", "_")).alias("target", "cell")).where("cell NOT IN ('NONE', 'UNKNOWN')")
    spans = cells.select("cell_id", "target", F.explode(F.split("cell", "&")).alias("event")).groupBy("cell_id", "event").agg(F.min("target").alias("min_target"), F.max("target").alias("max_target"))
    return spans.withColumn("p", ev.parse_event(F.col("event"))).select("cell_id", "event", "min_target", "max_target", "p.start_pos", "p.del_len", "p.insert_str")


@plan(_duck(UNIQ, "SELECT a.min_target AS outer_min, a.max_target AS outer_max, b.min_target AS inner_min, b.max_target AS inner_max, COUNT(*) AS n_pairs FROM uniq a JOIN uniq b ON a.min_target<b.min_target AND b.max_target<a.max_target GROUP BY 1,2,3,4"), "fx_event")
def hidden_pairs(f: Fixture) -> DataFrame:
    spans = _unique(f).groupBy("min_target", "max_target").count()  # events of one span hide alike: spans are joined, their counts multiplied
    pairs = spans.alias("a").join(F.broadcast(spans.alias("b")), ev.hides("a", "b"))
    return pairs.select(F.col("a.min_target").alias("outer_min"), F.col("a.max_target").alias("outer_max"), F.col("b.min_target").alias("inner_min"), F.col("b.max_target").alias("inner_max"), (F.col("a.count") * F.col("b.count")).alias("n_pairs"))


BINARY = (
    "p AS (SELECT DISTINCT min_target*10+max_target AS id, min_target, max_target FROM fx_event), own AS (SELECT DISTINCT cell_id, min_target, max_target FROM fx_event)",
    """SELECT o.cell_id, STRING_AGG(CASE WHEN w.cell_id IS NOT NULL THEN '1' WHEN EXISTS (SELECT 1 FROM own h WHERE h.cell_id=o.cell_id AND h.min_target<p.min_target AND p.max_target<h.max_target) THEN '?' ELSE '0' END, '' ORDER BY p.id) AS row
 FROM fx_obs o CROSS JOIN p LEFT JOIN own w ON w.cell_id=o.cell_id AND w.min_target=p.min_target AND w.max_target=p.max_target GROUP BY 1""",
)


@plan(_duck(*BINARY), "fx_obs")
def binary_matrix(f: Fixture) -> DataFrame:
    """A character for each kind of event (its span): present, hidden or absent; the kinds are at most n * n, so they stand in one row."""
    spans = f.event.select("min_target", "max_target").distinct()
    kinds = F.broadcast(spans.agg(F.array_sort(F.collect_list(F.struct("min_target", "max_target"))).alias("kinds")))
    own = f.event.groupBy("cell_id").agg(F.collect_set(F.struct("min_target", "max_target")).alias("own"))
    joined = f.obs.join(own, "cell_id", "left").join(kinds).withColumn("own", F.coalesce("own", F.array().cast("array<struct<min_target:int,max_target:int>>")))
    hidden = lambda k: F.exists("own", lambda e: (e["min_target"] < k["min_target"]) & (k["max_target"] < e["max_target"]))
    return joined.select("cell_id", F.array_join(F.transform("kinds", lambda k: F.when(F.array_contains("own", k), "1").when(hidden(k), "?").otherwise("0")), "").alias("row"))


@plan(_duck("w AS (SELECT min_target, max_target, COUNT(*) AS n FROM fx_event GROUP BY 1,2), x AS (SELECT MAX(n) AS m FROM w)",
 "SELECT min_target, max_target, n, SUBSTRING('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(CASE WHEN m>1 THEN 1+ROUND(34*LN(n)/LN(m)) ELSE 1 END AS INT)+1, 1) AS digit FROM w, x"), "fx_event")
def phylip_weights(f: Fixture) -> DataFrame:
    counts = f.event.groupBy("min_target", "max_target").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.max("n").alias("m")))).select("min_target", "max_target", "n", ev.weight_digit(F.col("n"), F.col("m")).alias("digit"))






_AUDIT = "SELECT a.max_target AS left_max, b.min_target AS right_min, COUNT(*) AS n_neighbours, CAST(SUM(CASE WHEN b.start_pos-(a.start_pos+a.del_len)<=3 THEN 1 ELSE 0 END) AS BIGINT) AS n_touching FROM s a JOIN s b ON a.cell_id=b.cell_id AND b.k=a.k+1 GROUP BY 1,2"


@plan(_duck("s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cell_id ORDER BY start_pos) AS k FROM fx_event)", _AUDIT), "fx_event")
def neighbour_audit(f: Fixture) -> DataFrame:
    w = Window.partitionBy("cell_id").orderBy("start_pos")  # a cell's events, at most one a target
    near = f.event.select("*", F.lead("min_target").over(w).alias("right_min"), F.lead("start_pos").over(w).alias("next_start")).where("right_min IS NOT NULL")
    return near.groupBy(F.col("max_target").alias("left_max"), "right_min").agg(F.count("*").alias("n_neighbours"), F.count_if(F.col("next_start") - ev.del_end() <= 3).alias("n_touching"))


# -- observations -------------------------------------------------------------
@plan("SELECT allele_str, CAST(SUM(abundance) AS BIGINT) AS abundance, COUNT(*) AS n_obs FROM fx_obs GROUP BY 1", "fx_obs")
def merge_by_allele(f: Fixture) -> DataFrame:
    return observe.group_observations(f.obs, "allele_str")


@plan("SELECT pairs, organ, CAST(SUM(abundance) AS BIGINT) AS abundance, COUNT(*) AS n_obs FROM fx_obs GROUP BY 1,2", "fx_obs")
def group_allele_organ(f: Fixture) -> DataFrame:
    return observe.group_observations(f.obs, "pairs", "organ")


@plan("SELECT pairs, organ, CAST(SUM(abundance) AS BIGINT) AS abundance, COUNT(*) AS n_obs FROM fx_obs GROUP BY 1,2 HAVING SUM(abundance)>=9", "fx_obs")
def abundance_threshold(f: Fixture) -> DataFrame:
    return observe.group_observations(f.obs, "pairs", "organ", at_least=9)


@plan("SELECT organ, CAST(ROW_NUMBER() OVER (ORDER BY f, organ)-1 AS INT) AS id FROM (SELECT organ, MIN(cell_id) AS f FROM fx_obs GROUP BY 1) x", "fx_obs")
def organ_ids(f: Fixture) -> DataFrame:
    return observe.first_seen_ids(f.obs, "organ", "cell_id")


@plan("SELECT COALESCE(split_part(pairs,' ',1),'') AS first, COALESCE(split_part(pairs,' ',2),'') AS second, CAST(SUM(abundance) AS BIGINT) AS abundance, COUNT(*) AS n_obs FROM fx_obs GROUP BY 1,2", "fx_obs")
def restrict_k(f: Fixture) -> DataFrame:
    parts = F.split("pairs", " ")
    return observe.group_observations(f.obs.select("abundance", F.get(parts, 0).alias("first"), F.coalesce(F.get(parts, 1), F.lit("")).alias("second")), "first", "second")


@plan("SELECT start_pos, del_len, min_target, max_target, insert_str, COUNT(DISTINCT cell_id) AS n_cells FROM fx_event GROUP BY ALL", "fx_event")
def event_sharing(f: Fixture) -> DataFrame:
    return f.event.groupBy("start_pos", "del_len", "min_target", "max_target", "insert_str").agg(F.count("cell_id").alias("n_cells"))  # a cell has one event at a first target


@plan("SELECT pairs, COUNT(*) AS n_leaves, CAST(SUM(abundance) AS BIGINT) AS abundance, MIN(node_id) AS first_node FROM fx_leaf GROUP BY 1", "fx_leaf")
def observe_leaves(f: Fixture) -> DataFrame:
    return f.leaf.groupBy("pairs").agg(F.count("*").alias("n_leaves"), F.sum("abundance").alias("abundance"), F.min("node_id").alias("first_node"))


@plan("SELECT allele_str, CAST(SUM(abundance) AS BIGINT) AS abundance FROM fx_obs GROUP BY 1 UNION ALL SELECT 'no_evts', 0", "fx_obs")
def phantom_leaf(f: Fixture) -> DataFrame:
    return observe.add_phantom(f.obs.groupBy("allele_str").agg(F.sum("abundance").alias("abundance")))


@plan(_duck("g AS (SELECT SUM(abundance) AS a FROM fx_obs GROUP BY pairs)", "SELECT CAST(t AS BIGINT) AS t, (SELECT COUNT(*) FROM g WHERE a<=t)/(SELECT COUNT(*) FROM g) AS share FROM (SELECT UNNEST(range(30)) AS t) x"), "fx_obs", doubles="share")
def abundance_ecdf(f: Fixture) -> DataFrame:
    return observe.abundance_ecdf(observe.group_observations(f.obs, "pairs"))


@plan(_duck(MASK, "SELECT t.target, COUNT(m.cell_id) AS n, COUNT(m.cell_id)/SUM(COUNT(m.cell_id)) OVER () AS share FROM fx_target t LEFT JOIN m ON (m.mask>>t.target)&1=1 GROUP BY 1"), "fx_obs", "fx_target", doubles="share")
def target_deact_hist(f: Fixture) -> DataFrame:
    return observe.shares(observe.histogram(st.bits(_masks(f), "mask", TARGETS), F.col("target"), TARGETS)).withColumnRenamed("k", "target")


@plan(_duck(MASK, "SELECT CAST(k AS INT) AS k, COUNT(m.cell_id) AS n FROM (SELECT UNNEST(range(11)) AS k) g LEFT JOIN m ON bit_count(m.mask)=k GROUP BY 1"), "fx_obs")
def barcode_exhaustion(f: Fixture) -> DataFrame:
    return observe.histogram(_masks(f), F.bit_count("mask"), TARGETS + 1)


@plan(_duck(UNIQ, """SELECT COUNT(*) AS n_unique, CAST(SUM(CASE WHEN min_target<max_target THEN 1 ELSE 0 END) AS BIGINT) AS n_inter, CAST(SUM(CASE WHEN min_target+1<max_target THEN 1 ELSE 0 END) AS BIGINT) AS n_masking,
 AVG(CASE WHEN min_target<max_target THEN 1.0 ELSE 0.0 END) AS double_share, (SELECT CAST(SUM(abundance) AS BIGINT) FROM fx_obs) AS cells, (SELECT COUNT(DISTINCT allele_str) FROM fx_obs) AS alleles FROM uniq"""), "fx_obs", doubles="double_share")
def event_summary(f: Fixture) -> DataFrame:
    inter = F.col("min_target") < F.col("max_target")
    own = _unique(f).agg(F.count("*").alias("n_unique"), F.count_if(inter).alias("n_inter"), F.count_if(F.col("min_target") + 1 < F.col("max_target")).alias("n_masking"), F.avg(inter.cast("double")).alias("double_share"))
    return own.join(f.obs.agg(F.sum("abundance").alias("cells"), F.count_distinct("allele_str").alias("alleles")))


def _rates_sql(weight: int) -> str:
    focal = " UNION ALL SELECT min_target FROM uniq WHERE min_target=max_target" * weight
    return _duck(UNIQ, f"SELECT target, COUNT(*) AS n, COUNT(*)/SUM(COUNT(*)) OVER () AS share FROM (SELECT min_target AS target FROM uniq WHERE min_target<max_target UNION ALL SELECT max_target FROM uniq WHERE min_target<max_target{focal}) x GROUP BY 1")


@plan(_rates_sql(2), "fx_event", doubles="share")
def simple_rates_a(f: Fixture) -> DataFrame:
    return observe.target_rates(_unique(f), 2)


@plan(_rates_sql(1), "fx_event", doubles="share")
def simple_rates_b(f: Fixture) -> DataFrame:
    return observe.target_rates(_unique(f), 1)


@plan(_duck(UNIQ, "SELECT LENGTH(insert_str) AS insert_len, COUNT(*) AS n, quantile_cont(19+27*min_target-start_pos, 0.75) AS left_p75, quantile_cont(start_pos+del_len-19-27*max_target, 0.75) AS right_p75 FROM uniq GROUP BY 1"), "fx_event", doubles="left_p75 right_p75")
def insert_summary(f: Fixture) -> DataFrame:
    x = ev.trims(ev.with_design(_unique(f), f.target))
    return x.groupBy(F.length("insert_str").alias("insert_len")).agg(F.count("*").alias("n"), F.percentile("left_trim", 0.75).alias("left_p75"), F.percentile("right_trim", 0.75).alias("right_p75"))


@plan(_duck(MASK, "SELECT t.target, SUM((m.mask>>t.target)&1)/COUNT(*) AS saturation FROM fx_target t CROSS JOIN m GROUP BY 1"), "fx_obs", "fx_target", doubles="saturation")
def target_saturation(f: Fixture) -> DataFrame:
    flags = [F.avg(F.call_function("getbit", F.col("mask"), F.lit(t)).cast("double")).alias(str(t)) for t in range(TARGETS)]
    return _masks(f).agg(*flags).unpivot([], [str(t) for t in range(TARGETS)], "target", "saturation").withColumn("target", F.col("target").cast("int"))


@plan("SELECT organ, CAST(SUM(abundance) AS BIGINT) AS cells, 100.0*SUM(abundance)/SUM(SUM(abundance)) OVER () AS percent, COUNT(DISTINCT allele_str) AS alleles FROM fx_obs GROUP BY 1", "fx_obs", doubles="percent")
def organ_composition(f: Fixture) -> DataFrame:
    own = f.obs.groupBy("organ").agg(F.sum("abundance").alias("cells"), F.count_distinct("allele_str").alias("alleles"))
    return observe.shares(own, "cells").select("organ", "cells", (100 * F.col("share")).alias("percent"), "alleles")


@plan(_duck(MASK + ", c AS (SELECT m.organ, bit_count(m.mask) AS dead, COUNT(e.cell_id) AS n FROM m LEFT JOIN fx_event e ON e.cell_id=m.cell_id GROUP BY m.cell_id, m.organ, m.mask)",
 "SELECT organ, quantile_cont(n,0.25) AS events_q1, quantile_cont(n,0.5) AS events_median, quantile_cont(n,0.75) AS events_q3, AVG(dead) AS dead_mean FROM c GROUP BY 1"), "fx_obs", doubles="events_q1 events_median events_q3 dead_mean")
def organ_events(f: Fixture) -> DataFrame:
    x = _masks(f).join(f.event.groupBy("cell_id").agg(F.count("*").alias("k")), "cell_id", "left").withColumn("n", F.coalesce("k", F.lit(0)))
    q = lambda p, name: F.percentile("n", p).alias(name)
    return x.groupBy("organ").agg(q(0.25, "events_q1"), q(0.5, "events_median"), q(0.75, "events_q3"), F.avg(F.bit_count("mask")).alias("dead_mean"))


@plan(_duck(UNIQ, "SELECT insert_str!='' AS inserted, COUNT(*) AS n, COUNT(DISTINCT start_pos) AS starts, COUNT(DISTINCT start_pos+del_len-1) AS ends, AVG(del_len) AS mean_len, MAX(del_len) AS max_len FROM uniq GROUP BY 1"), "fx_event", doubles="mean_len")
def unique_indels(f: Fixture) -> DataFrame:
    return _unique(f).groupBy((F.col("insert_str") != "").alias("inserted")).agg(F.count("*").alias("n"), F.count_distinct("start_pos").alias("starts"), F.count_distinct(ev.del_end() - 1).alias("ends"), F.avg("del_len").alias("mean_len"), F.max("del_len").alias("max_len"))


@plan(_duck(UNIQ, "SELECT min_target, COUNT(*) AS n, CAST(MEDIAN(start_pos) AS DOUBLE) AS pos, MIN(start_pos) AS pos_min, MAX(start_pos) AS pos_max, CAST(MEDIAN(del_len) AS DOUBLE) AS len, MIN(del_len) AS len_min, MAX(del_len) AS len_max FROM uniq WHERE min_target=max_target GROUP BY 1"), "fx_event", doubles="pos len")
def target_indel_summary(f: Fixture) -> DataFrame:
    stat = lambda c, name: (F.percentile(c, 0.5).alias(name), F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"))
    return _unique(f).where("min_target = max_target").groupBy("min_target").agg(F.count("*").alias("n"), *stat("start_pos", "pos"), *stat("del_len", "len"))


@plan(_duck(DEACT.replace("FROM fx_event e", "FROM fx_raw e"), "SELECT cell_id, target, COUNT(*) AS n FROM (SELECT cell_id, UNNEST(range(min_deact, max_deact+1)) AS target FROM d) x GROUP BY 1,2 HAVING COUNT(*)>1"), "fx_raw")
def double_hits(f: Fixture) -> DataFrame:
    """Targets that several raw events of a read leave inactive."""
    dead = ev.deactivated(ev.with_design(f.raw, f.target))
    spans = dead.select("cell_id", F.explode(F.sequence("min_deact", "max_deact")).alias("target"))
    return spans.groupBy("cell_id", "target").agg(F.count("*").alias("n")).where("n > 1")


@plan("SELECT min_target, max_target, COUNT(*) AS n FROM fx_event GROUP BY 1,2", "fx_event")
def pair_matrix(f: Fixture) -> DataFrame:
    return f.event.groupBy("min_target", "max_target").agg(F.count("*").alias("n"))


@plan("SELECT disturbed, COUNT(*) AS n FROM (SELECT o.cell_id, CAST(COALESCE(SUM(max_target-min_target+1),0) AS BIGINT) AS disturbed FROM fx_obs o LEFT JOIN fx_event e ON e.cell_id=o.cell_id GROUP BY 1) x GROUP BY 1", "fx_obs")
def disturbed_counter(f: Fixture) -> DataFrame:
    own = f.event.groupBy("cell_id").agg(F.sum(F.col("max_target") - F.col("min_target") + 1).alias("k"))
    return f.obs.join(own, "cell_id", "left").groupBy(F.coalesce("k", F.lit(0)).alias("disturbed")).agg(F.count("*").alias("n"))


@plan(_duck(UNIQ, "SELECT LEAST(del_len,50) AS len, COUNT(*) AS n, SUM(COUNT(*)) OVER (ORDER BY LEAST(del_len,50) DESC)/SUM(COUNT(*)) OVER () AS tail_share FROM uniq WHERE min_target=max_target GROUP BY 1"), "fx_event", doubles="tail_share")
def focal_deletions(f: Fixture) -> DataFrame:
    counts = observe.shares(_unique(f).where("min_target = max_target").groupBy(F.least("del_len", F.lit(50)).alias("len")).agg(F.count("*").alias("n")))
    return counts.select("len", "n", F.sum("share").over(Window.orderBy(F.desc("len"))).alias("tail_share"))  # at most 51 lengths


_METRIC = "r AS (SELECT o_orderpriority AS method, o_orderstatus AS setting, o_orderkey%7 AS seed, o_totalprice/1000.0 AS v FROM orders)"


def _metric(f: Fixture) -> DataFrame:
    return f.orders.select(F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("setting"), (F.col("o_orderkey") % 7).alias("seed"), (F.col("o_totalprice") / 1000.0).alias("v"))


@plan(_duck(_METRIC, "SELECT method, COUNT(*) AS n, AVG(v) AS mean, SQRT(VAR_SAMP(v)/COUNT(*)) AS se, AVG(v)-1.96*SQRT(VAR_SAMP(v)/COUNT(*)) AS lo, AVG(v)+1.96*SQRT(VAR_SAMP(v)/COUNT(*)) AS hi FROM r GROUP BY 1"), doubles="mean se lo hi")
def method_table(f: Fixture) -> DataFrame:
    return observe.mean_se(_metric(f), "v", "method")


@plan(_duck(_METRIC, "SELECT method, setting, EXP(AVG(LN(v))) AS mid, EXP(AVG(LN(v))-1.96*SQRT(VAR_POP(LN(v))/COUNT(*))) AS lo, EXP(AVG(LN(v))+1.96*SQRT(VAR_POP(LN(v))/COUNT(*))) AS hi FROM r GROUP BY 1,2"), doubles="mid lo hi")
def log_ci(f: Fixture) -> DataFrame:
    return observe.log_interval(_metric(f), "v", "method", "setting")


@plan(_duck(_METRIC, "SELECT method, ARG_MIN(setting, (v, seed, setting)) AS best_setting, MIN(v) AS best FROM r GROUP BY 1"), doubles="best")
def best_of(f: Fixture) -> DataFrame:
    return _metric(f).groupBy("method").agg(F.min_by("setting", F.struct("v", "seed", "setting")).alias("best_setting"), F.min("v").alias("best"))


@plan(_duck(_METRIC + ", t AS (SELECT AVG(v) AS truth FROM r)", "SELECT setting, seed, AVG(v)-MIN(truth) AS bias, VAR_POP(v) AS variance, AVG((v-truth)*(v-truth)) AS mse FROM r, t GROUP BY 1,2"), doubles="bias variance mse")
def bias_variance(f: Fixture) -> DataFrame:
    r = _metric(f).join(F.broadcast(_metric(f).agg(F.avg("v").alias("truth"))))
    off = F.col("v") - F.col("truth")
    return r.groupBy("setting", "seed").agg((F.avg("v") - F.min("truth")).alias("bias"), F.var_pop("v").alias("variance"), F.avg(off * off).alias("mse"))


# -- statuses -----------------------------------------------------------------
_NEXT = "z AS (SELECT o_orderkey AS k, LEAD(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), p AS (SELECT x.cell_id, x.mask AS a, y.mask AS b FROM z JOIN m x ON x.cell_id=z.k JOIN m y ON y.cell_id=z.n)"


@plan(_duck(f"{MASK}, {_NEXT}", "SELECT cell_id, a, b, a|b AS merged, CASE WHEN (a&b)=b THEN a-b ELSE 0 END AS minus, CAST(bit_count(a) AS INT) AS inactive FROM p"), "fx_obs")
def status_algebra(f: Fixture) -> DataFrame:
    """Of each cell and the next of its customer the statuses, merged, the first less the second, and how many targets are inactive."""
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    own = _masks(f).select("cell_id", F.col("mask").alias("a"))
    pairs = f.orders.select(F.col("o_orderkey").alias("cell_id"), after.alias("other")).where("other IS NOT NULL").join(own, "cell_id").join(own.withColumnsRenamed({"cell_id": "other", "a": "b"}), "other")
    a, b = F.col("a"), F.col("b")
    return pairs.select("cell_id", "a", "b", a.bitwiseOR(b).alias("merged"), st.minus(a, b).alias("minus"), F.bit_count("a").alias("inactive"))


_RUNS = "b AS (SELECT cell_id, t, t-ROW_NUMBER() OVER (PARTITION BY cell_id ORDER BY t) AS g FROM m, (SELECT UNNEST(range(10)) AS t) x WHERE (mask>>t)&1=1), rn AS (SELECT cell_id, CAST(MIN(t) AS INT) AS lo, CAST(MAX(t) AS INT) AS hi FROM b GROUP BY cell_id, g)"


@plan(_duck(f"{MASK}, {_RUNS}", "SELECT cell_id, lo, hi FROM rn"), "fx_obs")
def mask_runs(f: Fixture) -> DataFrame:
    """Runs of inactive targets of every cell."""
    return st.runs(_masks(f), "mask", TARGETS).select("cell_id", "lo", "hi")


def _tract_sql(n: int) -> str:
    """Tracts that can cut the cells' statuses of the first n targets; s: the statuses and their cells."""
    return f"""{MASK}, s AS (SELECT mask&{(1 << n) - 1} AS status, COUNT(*) AS cells FROM m GROUP BY 1), a AS (SELECT status, t FROM s, (SELECT UNNEST(range({n})) AS t) x WHERE (status>>t)&1=0),
 e AS (SELECT UNNEST([0,1]) AS k), q AS (SELECT DISTINCT l.status, GREATEST(l.t-i.k,0) AS min_deact, l.t AS min_t, r.t AS max_t, LEAST(r.t+j.k,{n - 1}) AS max_deact FROM a l JOIN a r ON l.status=r.status AND l.t<=r.t, e i, e j)"""


def cell_statuses(f: Fixture, n: int) -> DataFrame:
    """status, cells: the statuses of the first n targets and how many cells have each."""
    return _masks(f).groupBy(F.col("mask").bitwiseAND(F.lit((1 << n) - 1)).alias("status")).agg(F.count("*").alias("cells"))


@plan(_duck(_tract_sql(3), "SELECT status, cells, CAST(min_deact AS INT) AS min_deact, CAST(min_t AS INT) AS min_t, CAST(max_t AS INT) AS max_t, CAST(max_deact AS INT) AS max_deact, status|((1<<(max_deact+1))-(1<<min_deact)) AS after FROM q JOIN s USING (status)"), "fx_obs")
def transitions_n3(f: Fixture) -> DataFrame:
    """Every tract that can cut a status of the first three targets that cells have."""
    have = cell_statuses(f, 3)
    return st.transitions(have, 3).join(have, "status")


@plan(_duck(_tract_sql(10), "SELECT status, MIN(cells) AS cells, COUNT(*) AS n_tracts, COUNT(DISTINCT status|((1<<(max_deact+1))-(1<<min_deact))) AS n_after FROM q JOIN s USING (status) GROUP BY 1"), "fx_obs")
def transitions_n10(f: Fixture) -> DataFrame:
    """How many tracts can cut each status that cells have, and how many statuses they lead to."""
    have = cell_statuses(f, TARGETS)
    return st.transitions(have, TARGETS).groupBy("status").agg(F.count("*").alias("n_tracts"), F.count_distinct("after").alias("n_after")).join(have, "status")


@plan(_duck(_tract_sql(10) + """, w AS (SELECT status, SUM(CASE WHEN min_t=max_t THEN 1E-1+min_t ELSE (2E-1+min_t+max_t)*3E-1 END * CASE WHEN min_deact!=min_t THEN 5E-2 ELSE 1E0 END * CASE WHEN max_deact!=max_t THEN 7E-2 ELSE 1E0 END) AS away FROM q GROUP BY 1)""", "SELECT cell_id, mask AS status, COALESCE(away, 0E0) AS away FROM m LEFT JOIN w ON status=mask"), "fx_obs", doubles="away")
def hazard_away(f: Fixture) -> DataFrame:
    """The rate of leaving each cell's status in closed form; the SQL sums over all tracts."""
    lams = F.array(*(F.lit(0.1 + t) for t in range(TARGETS)))
    return _masks(f).select("cell_id", F.col("mask").alias("status"), st.hazard_away(lams, F.col("mask"), TARGETS, 0.3, 0.05, 0.07).alias("away"))


@plan(_duck("k AS (SELECT DISTINCT organ, CONCAT(min_target,'-',max_target) AS e FROM fx_obs o JOIN fx_event v ON v.cell_id=o.cell_id)",
 "SELECT a.organ AS a, b.organ AS b, CAST((SELECT COUNT(*) FROM ((SELECT e FROM k WHERE organ=a.organ EXCEPT SELECT e FROM k WHERE organ=b.organ) UNION ALL (SELECT e FROM k WHERE organ=b.organ EXCEPT SELECT e FROM k WHERE organ=a.organ)) z) AS INT) AS distance FROM (SELECT DISTINCT organ FROM k) a JOIN (SELECT DISTINCT organ FROM k) b ON a.organ>=b.organ"), "fx_obs")
def event_set_distances(f: Fixture) -> DataFrame:
    """Size of the symmetric difference of two organs' kinds of events; a set has at most one member for each pair of targets."""
    own = f.event.join(f.obs.select("cell_id", "organ"), "cell_id").groupBy("organ").agg(F.collect_set(F.concat_ws("-", "min_target", "max_target")).alias("s"))
    side = lambda n: own.select(F.col("organ").alias(n), F.col("s").alias(f"s_{n}"))
    return side("a").join(side("b"), F.col("a") >= F.col("b")).select("a", "b", (F.size(F.array_union("s_a", "s_b")) - F.size(F.array_intersect("s_a", "s_b"))).alias("distance"))


# -- trees --------------------------------------------------------------------
def _paths(f: Fixture) -> DataFrame:
    return f.closure


@plan("SELECT n.node_id, d.depth FROM fx_node n JOIN depth d ON d.node_id=n.node_id", "fx_node", "closure", doubles="depth")
def dist_to_root(f: Fixture) -> DataFrame:
    return trees.depths(f.node, _paths(f)).select("node_id", "depth")


@plan("SELECT hops, COUNT(*) AS n, MAX(path_len) AS longest FROM closure GROUP BY 1", "fx_node", "closure", doubles="longest")
def closure_stats(f: Fixture) -> DataFrame:
    return _paths(f).groupBy("hops").agg(F.count("*").alias("n"), F.max("path_len").alias("longest"))


_LONE = ", k AS (SELECT DISTINCT anc_id AS node_id FROM closure WHERE desc_id IN (SELECT node_id FROM fx_leaf WHERE organ='1-URGENT' AND abundance=5))"


@plan("SELECT n.node_id, n.parent_id, n.dist FROM fx_node n WHERE n.node_id IN (SELECT anc_id FROM closure WHERE desc_id IN (SELECT node_id FROM fx_leaf WHERE organ='1-URGENT' AND abundance=5))", "fx_node", "closure", "fx_leaf", doubles="dist")
def prune(f: Fixture) -> DataFrame:
    return trees.with_kept_leaves(f.node, _paths(f), f.leaf.where("organ = '1-URGENT' AND abundance = 5")).select("node_id", "parent_id", "dist")


_BRANCHING = "s AS (SELECT node_id FROM fx_node WHERE node_id='ROOT' OR is_leaf OR node_id IN (SELECT parent_id FROM kept GROUP BY 1 HAVING COUNT(*)>1))"


@plan(_duck("""kept AS (SELECT * FROM fx_node WHERE node_id IN (SELECT anc_id FROM closure WHERE desc_id IN (SELECT node_id FROM fx_leaf WHERE organ='1-URGENT' AND abundance=5))),
 ch AS (SELECT parent_id AS p, COUNT(*) AS n FROM kept GROUP BY 1), s AS (SELECT k.node_id FROM kept k LEFT JOIN ch ON ch.p=k.node_id WHERE k.node_id='ROOT' OR ch.n IS NULL OR ch.n>1)""",
 "SELECT s.node_id, b.anc_id AS parent_id, COALESCE(b.path_len,0) AS dist FROM s LEFT JOIN (SELECT desc_id, ARG_MIN(anc_id,hops) AS anc_id, MIN(path_len) AS path_len FROM closure WHERE hops>0 AND anc_id IN (SELECT node_id FROM s) GROUP BY 1) b ON b.desc_id=s.node_id"), "fx_node", "closure", "fx_leaf", doubles="dist")
def unary_suppress(f: Fixture) -> DataFrame:
    paths = _paths(f)
    kept = trees.with_kept_leaves(f.node, paths, f.leaf.where("organ = '1-URGENT' AND abundance = 5"))
    return trees.nearest_kept(kept, trees.branching(kept)).select("node_id", "parent_id", "dist")


@plan(_duck("s AS (SELECT node_id FROM fx_node WHERE parent_id IS NULL OR is_leaf OR dist>0.12)",
 "SELECT s.node_id, b.anc_id AS parent_id, COALESCE(b.path_len,0) AS dist FROM s LEFT JOIN (SELECT desc_id, ARG_MIN(anc_id,hops) AS anc_id, MIN(path_len) AS path_len FROM closure WHERE hops>0 AND anc_id IN (SELECT node_id FROM s) GROUP BY 1) b ON b.desc_id=s.node_id"), "fx_node", "closure", doubles="dist")
def short_collapse(f: Fixture) -> DataFrame:
    return trees.collapse_short(f.node, 0.12).select("node_id", "parent_id", "dist")


@plan("SELECT d.node_id, d.depth, COUNT(DISTINCT l.organ) AS n_organs, CAST(SUM(l.abundance) AS BIGINT) AS cells FROM depth d JOIN closure c ON c.anc_id=d.node_id AND c.hops>0 JOIN fx_leaf l ON l.node_id=c.desc_id GROUP BY 1,2", "fx_node", "closure", "fx_leaf", doubles="depth")
def celltypes_vs_time(f: Fixture) -> DataFrame:
    paths = _paths(f)
    below = trees.leaf_values(paths.where("hops > 0"), f.leaf, "organ", "abundance").groupBy("anc_id").agg(F.count_distinct("organ").alias("n_organs"), F.sum("abundance").alias("cells"))
    return trees.depths(f.node, paths).join(below, F.col("node_id") == F.col("anc_id")).select("node_id", "depth", "n_organs", "cells")


@plan(_duck("g AS (SELECT d.node_id, d.depth, COUNT(DISTINCT CASE WHEN l.organ<'3' THEN 'early' ELSE 'late' END) AS k FROM depth d JOIN closure c ON c.anc_id=d.node_id AND c.hops>0 JOIN fx_leaf l ON l.node_id=c.desc_id GROUP BY 1,2)",
 "SELECT COUNT(*) AS n, ROUND(regr_slope(k,depth),6) AS slope, ROUND(regr_intercept(k,depth),6) AS intercept, ROUND(corr(k,depth),6) AS r FROM g"), "fx_node", "closure", "fx_leaf", doubles="slope intercept r")
def germ_layer_regression(f: Fixture) -> DataFrame:
    paths = _paths(f)
    layers = trees.leaf_values(paths.where("hops > 0"), f.leaf.withColumn("layer", F.when(F.col("organ") < "3", "early").otherwise("late")), "layer")
    counts = layers.groupBy("anc_id").agg(F.count_distinct("layer").alias("k"))
    fit = stats.regression(trees.depths(f.node, paths).join(counts, F.col("node_id") == F.col("anc_id")), "k", "depth")
    return fit.select("n", *(F.round(c, 6).alias(c) for c in ("slope", "intercept", "r")))




_GRID = "grid AS (SELECT (k+0.5)/20.0E0 AS t, k FROM (SELECT UNNEST(range(20)) AS k) x)"


@plan(_duck(_GRID + ", tot AS (SELECT SUM(abundance) AS s FROM fx_leaf)", "SELECT CAST(g.k AS BIGINT) AS k, l.organ, COUNT(*) AS n_leaves, ROUND(SUM(l.abundance)/MIN(tot.s),9) AS freq FROM fx_leaf l JOIN fx_node n ON n.node_id=l.node_id JOIN depth p ON p.node_id=n.parent_id JOIN depth d ON d.node_id=n.node_id JOIN grid g ON p.depth<g.t AND g.t<d.depth, tot GROUP BY 1,2"), "fx_node", "closure", "fx_leaf", doubles="freq")
def divergence_flow(f: Fixture) -> DataFrame:
    grid = f.spark.range(20).select(F.col("id").alias("k"), ((F.col("id") + 0.5) / 20.0).alias("t"))
    crossed = trees.flows(f.node, trees.depths(f.node, _paths(f)), f.leaf.select("node_id", "organ", "abundance"), grid)
    total = F.broadcast(f.leaf.agg(F.sum("abundance").alias("total")))
    return crossed.groupBy("k", "organ").agg(F.count("*").alias("n_leaves"), F.sum("abundance").alias("a")).join(total).select("k", "organ", "n_leaves", F.round(F.col("a") / F.col("total"), 9).alias("freq"))




@plan("SELECT pairs, organ, CAST(SUM(abundance) AS BIGINT) AS abundance, CAST(ROW_NUMBER() OVER (PARTITION BY pairs ORDER BY SUM(abundance) DESC, organ) AS INT) AS rank FROM fx_leaf GROUP BY 1,2 QUALIFY rank=1 OR SUM(abundance)>4", "fx_leaf")
def leaf_expand(f: Fixture) -> DataFrame:
    """A leaf for each cell state of an allele: the largest always, others above a threshold."""
    own = f.leaf.groupBy("pairs", "organ").agg(F.sum("abundance").alias("abundance"))
    w = Window.partitionBy("pairs").orderBy(F.desc("abundance"), "organ")  # an allele's cell states, few
    return own.withColumn("rank", F.row_number().over(w)).where("rank = 1 OR abundance > 4")


@plan("SELECT node_id, CAST(UNNEST(range(abundance)) AS BIGINT) AS copy FROM fx_leaf", "fx_leaf")
def single_abundance(f: Fixture) -> DataFrame:
    return f.leaf.select("node_id", F.explode(F.sequence(F.lit(0), F.col("abundance") - 1)).alias("copy"))




@plan(_duck("""e AS (SELECT DISTINCT 'O'||cell_id AS node_id, min_target*10+max_target AS k FROM fx_event),
 b AS (SELECT c.anc_id, l.node_id FROM closure c JOIN fx_node l ON l.node_id=c.desc_id AND l.is_leaf WHERE c.anc_id<>'ROOT'), n AS (SELECT anc_id, COUNT(*) AS n FROM b GROUP BY 1),
 s AS (SELECT b.anc_id AS node_id, e.k FROM b JOIN e ON e.node_id=b.node_id JOIN n ON n.anc_id=b.anc_id GROUP BY 1,2 HAVING COUNT(*)=MIN(n.n)),
 x AS (SELECT substr(s.node_id,1,1) AS kind FROM s JOIN fx_node t ON t.node_id=s.node_id WHERE NOT EXISTS (SELECT 1 FROM s u WHERE u.node_id=t.parent_id AND u.k=s.k))""",
 "SELECT kind, COUNT(*) AS new_events FROM x GROUP BY 1 UNION ALL SELECT 'all', COUNT(*) FROM x"), "fx_node", "fx_event", "closure")
def tree_parsimony(f: Fixture) -> DataFrame:
    """The parsimony score over all edges, by the kind of the lower node, and its total."""
    events = f.event.select(F.concat(F.lit("O"), F.col("cell_id").cast("string")).alias("node_id"), (F.col("min_target") * 10 + F.col("max_target")).alias("k")).distinct()
    new = trees.new_events(f.node, trees.shared_events(f.node, _paths(f), events))
    kinds = new.groupBy(F.substring("node_id", 1, 1).alias("kind")).agg(F.count("*").alias("new_events"))
    return kinds.union(new.agg(F.lit("all").alias("kind"), F.count("*").alias("new_events")))


@plan("SELECT node_id, parent_id, CAST(ROW_NUMBER() OVER (PARTITION BY parent_id ORDER BY dist, node_id) AS INT) AS spine_ord FROM fx_node WHERE parent_id IN (SELECT parent_id FROM fx_node GROUP BY 1 HAVING COUNT(*)>2)", "fx_node")
def spines(f: Fixture) -> DataFrame:
    return trees.spines(f.node.where("parent_id IS NOT NULL").withColumn("offset", F.col("dist"))).select("node_id", "parent_id", "spine_ord")


@plan(_duck("""r1 AS (SELECT l.node_id AS leaf, c.node_id AS c, n.node_id AS n, r.node_id AS r FROM fx_node l JOIN fx_node c ON c.node_id=l.parent_id JOIN fx_node n ON n.node_id=c.parent_id JOIN fx_node r ON r.node_id=n.parent_id WHERE l.is_leaf),
 r2 AS (SELECT l.node_id AS leaf, c.node_id AS c, n.node_id AS n, r.node_id AS r FROM fx_other l JOIN fx_other c ON c.node_id=l.parent_id JOIN fx_other n ON n.node_id=c.parent_id JOIN fx_other r ON r.node_id=n.parent_id WHERE l.is_leaf),
 s1 AS (SELECT DISTINCT s FROM (SELECT STRING_AGG(leaf,',' ORDER BY leaf) AS s FROM (SELECT leaf,c AS k FROM r1 UNION ALL SELECT leaf,n FROM r1 UNION ALL SELECT leaf,r FROM r1 UNION ALL SELECT leaf,'ROOT' FROM r1) x GROUP BY k HAVING COUNT(*)>1) y),
 s2 AS (SELECT DISTINCT s FROM (SELECT STRING_AGG(leaf,',' ORDER BY leaf) AS s FROM (SELECT leaf,c AS k FROM r2 UNION ALL SELECT leaf,n FROM r2 UNION ALL SELECT leaf,r FROM r2 UNION ALL SELECT leaf,'ROOT' FROM r2) x GROUP BY k HAVING COUNT(*)>1) y)""",
 "SELECT COUNT(s1.s) AS clades_a, COUNT(s2.s) AS clades_b, CAST(SUM(CASE WHEN s1.s IS NULL OR s2.s IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unshared, SUM(CASE WHEN s1.s IS NULL OR s2.s IS NULL THEN 1 ELSE 0 END)/(COUNT(s1.s)+COUNT(s2.s)) AS rf FROM s1 FULL JOIN s2 ON s1.s=s2.s"), "fx_node", "fx_other", doubles="rf")
def clade_rf(f: Fixture) -> DataFrame:
    leaves = f.node.where("is_leaf").select("node_id")
    rf, counts = trees.rf_distance(trees.clades(f.closure, leaves), trees.clades(f.other_closure, leaves))
    return counts.select("*", rf.alias("rf"))
