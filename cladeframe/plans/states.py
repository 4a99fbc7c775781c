"""Queries on indel sets, ancestral states and tuples of tracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import states as sa
from ..functions import status as st
from ..operators import ancestors, trees
from . import lineage
from .fixtures import TARGETS, Fixture
from .lineage import DEACT
from .registry import plan, with_views

_SETS = f"{DEACT}, s AS (SELECT cell_id, ROW_NUMBER() OVER (PARTITION BY cell_id ORDER BY start_pos) AS k, start_pos, del_len, min_deact, min_target AS min_t, max_target AS max_t, max_deact, insert_str FROM d)"
_PAIRS = f"{_SETS}, p AS (SELECT o_orderkey AS a, LEAD(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders QUALIFY b IS NOT NULL)"
_INNER = "x.min_t+1<=x.max_t-1 AND x.min_t+1<=y.min_deact AND y.max_deact<=x.max_t-1"
_SAME = "x.start_pos=y.start_pos AND x.del_len=y.del_len AND x.min_deact=y.min_deact AND x.min_t=y.min_t AND x.max_t=y.max_t AND x.max_deact=y.max_deact AND x.insert_str=y.insert_str"
_MEET = f"""CASE WHEN {_SAME} OR ({_INNER.replace('x.', 'z.').replace('y.', 'x.').replace('z.', 'y.')} AND NOT ({_INNER})) THEN 'x' WHEN {_INNER} THEN 'y' WHEN GREATEST(x.min_t,y.min_t)+1<=LEAST(x.max_t,y.max_t)-1 THEN 'w' END"""
#: Left sides first: a set dies whose long side kills the target on which a short side of the pair's list ends, unless its neighbour is there.
_KEEP = """SELECT * EXCLUDE (lg, ld) FROM (SELECT r.*, LAG(max_deact) OVER (PARTITION BY a,b ORDER BY i,j) AS lg, LEAD(min_deact) OVER (PARTITION BY a,b ORDER BY i,j) AS ld FROM {0} r) r
 WHERE NOT (min_t<>min_deact AND EXISTS (SELECT 1 FROM s WHERE s.cell_id=r.{1} AND s.max_deact=s.max_t AND s.max_deact=r.min_deact) AND lg IS DISTINCT FROM min_deact)
 AND NOT (max_t<>max_deact AND EXISTS (SELECT 1 FROM s WHERE s.cell_id=r.{1} AND s.min_deact=s.min_t AND s.min_deact=r.max_deact) AND ld IS DISTINCT FROM max_deact)"""
_MET = f"""{_PAIRS}, q AS (SELECT p.a, p.b, x.k AS i, y.k AS j, {_MEET} AS how, x.*, y.start_pos AS s2, y.del_len AS l2, y.min_deact AS nd2, y.min_t AS n2, y.max_t AS m2, y.max_deact AS md2, y.insert_str AS i2
  FROM p JOIN s x ON x.cell_id=p.a JOIN s y ON y.cell_id=p.b AND y.max_t>=x.min_t AND x.max_t>=y.min_t),
 r0 AS (SELECT a, b, i, j, CASE how WHEN 'x' THEN start_pos WHEN 'y' THEN s2 END AS start_pos, CASE how WHEN 'x' THEN del_len WHEN 'y' THEN l2 END AS del_len,
  CASE how WHEN 'x' THEN min_deact WHEN 'y' THEN nd2 ELSE GREATEST(min_t,n2)+1 END AS min_deact, CASE how WHEN 'x' THEN min_t WHEN 'y' THEN n2 ELSE GREATEST(min_t,n2)+1 END AS min_t,
  CASE how WHEN 'x' THEN max_t WHEN 'y' THEN m2 ELSE LEAST(max_t,m2)-1 END AS max_t, CASE how WHEN 'x' THEN max_deact WHEN 'y' THEN md2 ELSE LEAST(max_t,m2)-1 END AS max_deact, CASE how WHEN 'x' THEN insert_str WHEN 'y' THEN i2 END AS insert_str
  FROM q WHERE how IS NOT NULL), r1 AS ({_KEEP.format('r0', 'a')}), r2 AS ({_KEEP.format('r1', 'b')})"""
_TEXT = "CASE WHEN start_pos IS NULL THEN CONCAT(min_t,'-',max_t) ELSE CONCAT_WS('_',start_pos,del_len,min_deact,min_t,max_t,max_deact,insert_str) END"
_BITS = "BIT_OR((1<<(max_deact+1))-(1<<min_deact))"


def states(f: Fixture) -> DataFrame:
    """cell_id, state of every cell with events."""
    own = lineage._dead(f).groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "del_len", "min_target", "max_target", "min_deact", "max_deact", "insert_str"))).alias("events"))
    return own.select("cell_id", sa.observed(F.col("events")).alias("state"))


def pairs(f: Fixture) -> DataFrame:
    """a, b, sa, sb: states of each two consecutive orders of a customer."""
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    both = f.orders.select(F.col("o_orderkey").alias("a"), after.alias("b")).where("b IS NOT NULL")
    side = lambda n: states(f).select(F.col("cell_id").alias(n), F.col("state").alias(f"s{n}"))
    return both.join(side("a"), "a").join(side("b"), "b")


@plan(with_views(_SETS, "SELECT cell_id, k, start_pos, del_len, min_deact, min_t, max_t, max_deact, insert_str FROM s"), "fx_event")
def observed_states(f: Fixture) -> DataFrame:
    return states(f).select("cell_id", F.posexplode("state").alias("k", "x")).select("cell_id", (F.col("k") + 1).cast("long").alias("k"), "x.*")


@plan(with_views(_MET, f"SELECT a, b, {_TEXT} AS met, i, j FROM r0"), "fx_event")
def set_intersect(f: Fixture) -> DataFrame:
    """Each two sets of a pair that overlap and what they have in common."""
    rows = pairs(f).select("a", "b", F.posexplode("sa").alias("i", "x"), "sb").select("a", "b", "i", "x", F.posexplode("sb").alias("j", "y"))
    near = rows.where((F.col("y.max_t") >= F.col("x.min_t")) & (F.col("x.max_t") >= F.col("y.min_t"))).withColumn("m", sa.meet(F.col("x"), F.col("y"))).where("m IS NOT NULL")
    return near.select("a", "b", sa.text(F.array("m").cast(sa.STATE)).alias("met"), (F.col("i") + 1).cast("long").alias("i"), (F.col("j") + 1).cast("long").alias("j"))


@plan(with_views(_MET + ", h AS (SELECT DISTINCT cell_id FROM s)", f"""SELECT p.a, p.b, COALESCE(t.state,'unmod') AS state, COALESCE(t.all_dead,0) AS all_dead, COALESCE(t.own_dead,0) AS own_dead FROM p JOIN h ha ON ha.cell_id=p.a JOIN h hb ON hb.cell_id=p.b LEFT JOIN
 (SELECT a, b, STRING_AGG({_TEXT},'..' ORDER BY i,j) AS state, CAST({_BITS} AS BIGINT) AS all_dead, CAST({_BITS} FILTER (start_pos IS NOT NULL) AS BIGINT) AS own_dead FROM r2 GROUP BY 1,2) t ON t.a=p.a AND t.b=p.b"""), "fx_event")
def state_intersect(f: Fixture) -> DataFrame:
    """The state that both of a pair may come from, and the masks of the targets that it can leave inactive, by all sets and by singletons."""
    met = pairs(f).select("a", "b", sa.intersect(F.col("sa"), F.col("sb")).alias("s"))
    return met.select("a", "b", sa.text(F.col("s")).alias("state"), sa.max_status(F.col("s")).alias("all_dead"), sa.max_status(sa.singletons(F.col("s"))).alias("own_dead"))


_ONE = "STRUCT_PACK(nd := min_deact, lo := min_t, hi := max_t, xd := max_deact)"
#: Each tuple of tracts that cells have, and how many have it.
_KINDS = f"""{_SETS}, c AS (SELECT cell_id, LIST({_ONE} ORDER BY k) AS own FROM s GROUP BY 1), kd AS (SELECT own, ARRAY_TO_STRING(LIST_TRANSFORM(own, lambda t: CONCAT_WS('-', t.nd, t.lo, t.hi, t.xd)), ' ') AS kind, COUNT(*) AS cells FROM c GROUP BY own),
 x AS (SELECT kind, cells, t.nd AS nd, t.lo AS lo, t.hi AS hi, t.xd AS xd FROM (SELECT kind, cells, UNNEST(own) AS t FROM kd) z)"""


def kinds(f: Fixture) -> DataFrame:
    """kind, cells, tracts, state: each tuple of tracts that cells have, how many have it, and a state with it."""
    tracts = F.transform(sa.singletons(F.col("state")), sa.tract_of).cast(sa.TRACTS)
    own = states(f).groupBy(tracts.alias("tracts")).agg(F.count("*").alias("cells"))
    fields = ("min_deact", "min_t", "max_t", "max_deact")
    name = F.array_join(F.transform("tracts", lambda t: F.concat_ws("-", *(t[c].cast("string") for c in fields))), " ")
    as_set = lambda t: F.struct(F.lit(0).alias("start_pos"), F.lit(0).alias("del_len"), *(t[c].alias(c) for c in fields), F.lit("").alias("insert_str"))
    return own.select(name.alias("kind"), "cells", "tracts", F.transform("tracts", as_set).cast(sa.STATE).alias("state"))


@plan(with_views(_KINDS + ", m AS (SELECT UNNEST(range(1024)) AS m), y AS (SELECT *, (1<<(xd+1))-(1<<nd) AS own, CASE WHEN lo+1<=hi-1 THEN (1<<hi)-(1<<(lo+1)) ELSE 0 END AS inside FROM x), g AS (SELECT kind, MIN(cells) AS cells, BIT_OR(own) AS every FROM y GROUP BY 1)",
 "SELECT g.kind, MIN(g.cells) AS cells, COUNT(*) AS n, CAST(SUM(m) AS BIGINT) AS total FROM g JOIN m ON m.m & ~g.every = 0 WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.kind=g.kind AND (m.m & y.own)<>y.own AND (m.m & y.own & ~y.inside)<>0) GROUP BY 1"), "fx_event")
def possible_statuses(f: Fixture) -> DataFrame:
    """Of every tuple of tracts that cells have how many masks its state allows, and their sum."""
    masks = kinds(f).select("kind", "cells", F.explode(sa.possible_statuses(F.col("state"))).alias("m"))
    return masks.groupBy("kind", "cells").agg(F.count("*").alias("n"), F.sum("m").alias("total"))


@plan(with_views(_KINDS + ", t AS (SELECT DISTINCT nd, lo, hi, xd FROM x), u AS (SELECT kind, cells FROM kd)", """SELECT u.kind, MIN(u.cells) AS cells, CAST(SUM(CASE WHEN EXISTS (SELECT 1 FROM x s WHERE s.kind=u.kind AND s.nd=t.nd AND s.lo=t.lo AND s.hi=t.hi AND s.xd=t.xd
  AND NOT (s.lo<>s.nd AND EXISTS (SELECT 1 FROM x z WHERE z.kind=u.kind AND z.hi=z.xd AND z.xd=s.nd)) AND NOT (s.hi<>s.xd AND EXISTS (SELECT 1 FROM x z WHERE z.kind=u.kind AND z.lo=z.nd AND z.nd=s.xd)))
  OR (NOT EXISTS (SELECT 1 FROM x s WHERE s.kind=u.kind AND s.nd=t.nd AND s.lo=t.lo AND s.hi=t.hi AND s.xd=t.xd) AND EXISTS (SELECT 1 FROM x s WHERE s.kind=u.kind AND s.lo+1<=t.nd AND t.xd<=s.hi-1)) THEN 1 ELSE 0 END) AS BIGINT) AS n_possible FROM u, t GROUP BY 1"""), "fx_event")
def possible_tracts(f: Fixture) -> DataFrame:
    """Of every tuple of tracts that cells have how many of all observed tracts (at most one for each four targets) its state allows alone."""
    own = kinds(f)
    tracts = own.select(F.explode("tracts").alias("t")).distinct().agg(F.collect_list("t").alias("all"))
    ok = F.filter("all", lambda t: sa.is_possible(F.col("state"), F.array(t).cast(sa.TRACTS)))
    return own.join(F.broadcast(tracts)).select("kind", "cells", F.size(ok).cast("long").alias("n_possible"))


@plan(with_views(f"{lineage.MASK}, {lineage._RUNS}, r AS (SELECT lo, hi, COUNT(*) AS runs FROM rn GROUP BY 1,2)", "SELECT lo, hi, runs, m, CAST(ROW_NUMBER() OVER (PARTITION BY lo, hi ORDER BY bit_count(m), m) - 1 AS INT) AS k FROM (SELECT lo, hi, runs, m.m << lo AS m FROM r, (SELECT UNNEST(range(1024)) AS m) m WHERE m.m < (1 << (hi-lo+1))) x"), "fx_obs")
def contained_statuses(f: Fixture) -> DataFrame:
    """All masks within each run of inactive targets that cells have, and how often it comes up."""
    runs = st.runs(lineage._masks(f), "mask", TARGETS).groupBy("lo", "hi").agg(F.count("*").alias("runs"))
    return runs.select("lo", "hi", "runs", F.posexplode(sa.sub_masks(F.col("lo"), F.col("hi"))).alias("k", "m"))


_ORDER = f"""{_PAIRS}, n AS (SELECT cell_id, MAX(k) AS n, CAST({_BITS} AS BIGINT) AS mask FROM s GROUP BY 1), w(a, b, i, j, ok) AS (SELECT p.a, p.b, CAST(1 AS BIGINT), CAST(1 AS BIGINT), TRUE FROM p JOIN n x ON x.cell_id=p.a JOIN n y ON y.cell_id=p.b
 UNION ALL SELECT w.a, w.b, CASE WHEN {{fit}} THEN i+1 ELSE i END, j+1, {{fit}} OR y.max_deact<x.min_deact FROM w JOIN s x ON x.cell_id=w.a AND x.k=w.i JOIN s y ON y.cell_id=w.b AND y.k=w.j WHERE w.ok)"""
_FIT = "(x.min_deact=y.min_deact AND x.min_t=y.min_t AND x.max_t=y.max_t AND x.max_deact=y.max_deact OR x.min_deact>y.min_deact AND x.max_deact<y.max_deact)"


@plan(with_views(_ORDER.format(fit=_FIT) + ", v AS (SELECT a, b, BOOL_AND(ok) AS fits FROM w GROUP BY 1,2)", """SELECT v.a, v.b, fits, CASE WHEN fits THEN (SELECT COUNT(*) FROM s y WHERE y.cell_id=v.b AND NOT EXISTS (SELECT 1 FROM s x WHERE x.cell_id=v.a AND x.min_deact=y.min_deact AND x.min_t=y.min_t AND x.max_t=y.max_t AND x.max_deact=y.max_deact)) ELSE 0 END AS n_new, y.mask
 FROM v JOIN n y ON y.cell_id=v.b"""), "fx_event")
def tract_order(f: Fixture) -> DataFrame:
    """Whether the tracts of the first of a pair fit in those of the second, how many the second has beyond, and its status."""
    tracts = lambda c: F.transform(c, sa.tract_of).cast(sa.TRACTS)
    both = pairs(f).select("a", "b", tracts("sa").alias("ta"), tracts("sb").alias("tb"))
    return both.select("a", "b", sa.less_or_equal(F.col("ta"), F.col("tb")).alias("fits"), F.size(sa.difference(F.col("ta"), F.col("tb"))).cast("long").alias("n_new"), sa.status_of(F.col("tb")).alias("mask"))


@plan(with_views(lineage._tract_sql(10), "SELECT status, CAST(min_deact AS INT) AS min_deact, CAST(min_t AS INT) AS min_t, CAST(max_t AS INT) AS max_t, CAST(max_deact AS INT) AS max_deact, (CASE WHEN min_t=max_t THEN 1E-1+min_t ELSE (2E-1+min_t+max_t)*3E-1 END)*(CASE WHEN min_deact!=min_t THEN 5E-2 ELSE 1E0 END)*(CASE WHEN max_deact!=max_t THEN 7E-2 ELSE 1E0 END) AS rate FROM q"), "fx_obs", doubles="rate")
def tract_hazards(f: Fixture) -> DataFrame:
    """The rate of every tract that can cut a status that cells have."""
    lams = F.array(*(F.lit(0.1 + t) for t in range(TARGETS)))
    column = [F.col(c) for c in ("min_deact", "min_t", "max_t", "max_deact")]
    return st.tracts(lineage.cell_statuses(f, TARGETS), TARGETS).select("status", *column, st.hazard(lams, *column, 0.3, 0.05, 0.07).alias("rate"))


def annotated(f: Fixture) -> DataFrame:
    def make() -> DataFrame:
        own = f.orders.withColumn("first", F.min("o_orderkey").over(Window.partitionBy("o_custkey")))  # a customer's orders are few
        giver = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).otherwise(F.col("first")).alias("cell_id")  # so that sisters share events
        leaves = own.select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("node_id"), giver).join(states(f), "cell_id", "left").select("node_id", F.coalesce("state", F.array().cast(sa.STATE)).alias("state"))
        return ancestors.annotate(f.node, trees.depths(f.node, f.closure), leaves)

    return f.at_rest("annotated", make)


@plan()
def ancestral_states(f: Fixture) -> DataFrame:
    """No SQL: a fold of states up the tree; tests hold it against a plain one."""
    return annotated(f).select("node_id", sa.text(F.col("state")).alias("state"), F.size(sa.singletons(F.col("state"))).alias("n_singletons"))


@plan()
def state_parsimony(f: Fixture) -> DataFrame:
    """The score by the kind of an edge's lower node.  No SQL, as for the states that it counts."""
    return ancestors.new_singletons(annotated(f)).groupBy(F.substring("node_id", 1, 1).alias("kind")).agg(F.sum("score").alias("score"), F.count("*").alias("n_edges"))
