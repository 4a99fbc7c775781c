"""Queries on chains of target statuses: states close by, rates with a sink, likelihoods over all ten targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import states as sa
from ..operators import chains, trees
from ..tables import written
from . import lineage, states
from .fixtures import TARGETS, Fixture
from .registry import plan, with_views
from .states import _SETS

#: Hazards of the fixture: targets' rates, weight of double cuts, factors of long trims.
HAZARDS = ([0.1 + t for t in range(TARGETS)], 0.3, 0.05, 0.07)


def trim(x: Column) -> Column:
    """The fixture's law of a singleton's trims given its tract: by the targets that it takes."""
    return F.lit(1.0) / (x["max_deact"] - x["min_deact"] + 2)


def _name(tracts: Column) -> Column:
    return F.array_join(F.transform(tracts, lambda t: F.concat_ws("-", *(t[c].cast("string") for c in ("min_deact", "min_t", "max_t", "max_deact")))), " ")


def kinds(f: Fixture) -> DataFrame:
    """chain, state, required, asked: each tuple of tracts that a cell has, hung on an unmodified root."""
    return states.kinds(f).select(F.col("kind").alias("chain"), "state", F.size("tracts").alias("required"), sa.status_of(F.col("tracts")).alias("asked"))


def close(f: Fixture) -> tuple[DataFrame, DataFrame]:
    def make() -> tuple[DataFrame, DataFrame]:
        own = written(kinds(f), "kinds")
        found, _ = chains.close_states(own, own.select("chain", F.array().cast(sa.TRACTS).alias("tracts")), TARGETS)
        return own, found

    return f.at_rest("close", make)


_T = "STRUCT_PACK(nd := {0}min_deact, lo := {0}min_t, hi := {0}max_t, xd := {0}max_deact)"
_TEXT = "ARRAY_TO_STRING(LIST_TRANSFORM({0}, lambda t: CONCAT_WS('-', t.nd, t.lo, t.hi, t.xd)), ' ')"
_ALL = "u AS (SELECT UNNEST(range(10)) AS i), w AS (SELECT UNNEST([0,1]) AS e), tr AS (SELECT DISTINCT GREATEST(a.i-x.e,0) AS nd, a.i AS lo, b.i AS hi, LEAST(b.i+y.e,9) AS xd FROM u a JOIN u b ON a.i<=b.i, w x, w y)"
#: Forward moves of each kind, then what leads to states with all of the kind's targets inactive.
_CLOSE = f"""{_SETS}, c AS (SELECT cell_id, LIST({_T.format('')} ORDER BY k) AS own FROM s GROUP BY 1), kd AS (SELECT DISTINCT own, {_TEXT.format('own')} AS chain FROM c), {_ALL},
 al AS (SELECT chain, own, LIST(STRUCT_PACK(nd := tr.nd, lo := tr.lo, hi := tr.hi, xd := tr.xd)) AS al FROM kd, tr WHERE LEN(LIST_FILTER(own, lambda x: (x.lo+1<=x.hi-1 AND x.lo+1<=tr.nd AND tr.xd<=x.hi-1) OR (x.nd=tr.nd AND x.lo=tr.lo AND x.hi=tr.hi AND x.xd=tr.xd)))>0 GROUP BY 1,2),
 mv(chain, d, prev, prev_passed, state, passed) AS (SELECT chain, 0, own[1:0], FALSE, own[1:0], FALSE FROM kd UNION
  SELECT q.chain, q.d+1, q.state, q.passed, q.nxt, q.passed OR LEN(LIST_FILTER(q.own, lambda x: LEN(LIST_FILTER(range(x.nd, x.xd+1), lambda g: LEN(LIST_FILTER(q.nxt, lambda y: y.nd<=g AND g<=y.xd))=0))>0))=0
  FROM (SELECT p.chain, p.d, p.state, p.passed, al.own, LIST_SORT(LIST_APPEND(LIST_FILTER(p.state, lambda y: NOT (y.lo>p.t.lo AND p.t.xd>y.xd)), p.t)) AS nxt
   FROM (SELECT mv.chain, mv.d, mv.state, mv.passed, UNNEST(LIST_FILTER(a.al, lambda t: LEN(LIST_FILTER(mv.state, lambda y: (y.nd<=t.lo AND t.lo<=y.xd) OR (y.nd<=t.hi AND t.hi<=y.xd)))=0)) AS t FROM (SELECT DISTINCT chain, d, state, passed FROM mv) mv JOIN al a ON a.chain=mv.chain WHERE mv.d<=LEN(a.own)) p JOIN al ON al.chain=p.chain) q
  WHERE LEN(LIST_FILTER(q.nxt, lambda x, i: LIST_CONTAINS(q.own, x) AND ((x.lo<>x.nd AND LEN(LIST_FILTER(q.own, lambda z: z.hi=z.xd AND z.xd=x.nd))>0 AND (i=1 OR q.nxt[i-1].xd<>x.nd)) OR (x.hi<>x.xd AND LEN(LIST_FILTER(q.own, lambda z: z.lo=z.nd AND z.nd=x.xd))>0 AND (i=LEN(q.nxt) OR q.nxt[i+1].nd<>x.xd)))))=0),
 bk(chain, d, state, passed) AS (SELECT chain, d, state, passed FROM mv WHERE passed UNION SELECT mv.chain, mv.d-1, mv.prev, mv.prev_passed FROM bk JOIN mv ON mv.chain=bk.chain AND mv.d=bk.d AND mv.state=bk.state AND mv.passed=bk.passed WHERE mv.d>0),
 cs AS (SELECT DISTINCT chain, state, CAST(LIST_SUM(LIST_TRANSFORM(range(10), lambda g: CASE WHEN LEN(LIST_FILTER(state, lambda y: y.nd<=g AND g<=y.xd))>0 THEN 1<<g ELSE 0 END)) AS BIGINT) AS status FROM bk)"""


@plan(with_views(_CLOSE, f"SELECT chain, {_TEXT.format('state')} AS state, status FROM cs"), "fx_event")
def close_states(f: Fixture) -> DataFrame:
    """Every tuple of tracts on the way from an unmodified barcode to each observed one, in at most one step more than it has tracts."""
    _, found = close(f)
    return found.select("chain", _name(F.col("tracts")).alias("state"), "status")


_HAZ = "(CASE WHEN lo=hi THEN 1E-1+lo ELSE (2E-1+lo+hi)*3E-1 END)*(CASE WHEN nd!=lo THEN 5E-2 ELSE 1E0 END)*(CASE WHEN xd!=hi THEN 7E-2 ELSE 1E0 END)"
_RATES = f"""{_CLOSE}, ms AS (SELECT DISTINCT chain, status FROM cs), tm AS (SELECT m.status, m.status|((1<<(xd+1))-(1<<nd)) AS after, nd, lo, hi, xd, {_HAZ} AS hz FROM (SELECT DISTINCT status FROM ms) m, tr WHERE (m.status>>lo)&1=0 AND (m.status>>hi)&1=0),
 aw AS (SELECT status, SUM(hz) AS away FROM tm GROUP BY 1), tg AS (SELECT status, after, SUM(hz) AS rate, LIST(STRUCT_PACK(nd, lo, hi, xd)) AS ts FROM tm GROUP BY 1,2),
 st AS (SELECT a.chain, a.status, b.status AS after, tg.rate, kd.own, LIST_FILTER(kd.own, lambda x: LIST_CONTAINS(tg.ts, x)) AS sp, LIST_FILTER(kd.own, lambda x: ((b.status-a.status)>>x.lo)&1=1 OR ((b.status-a.status)>>x.hi)&1=1) AS ht
  FROM ms a JOIN ms b ON a.chain=b.chain JOIN tg ON tg.status=a.status AND tg.after=b.status JOIN kd ON kd.chain=a.chain),
 mo AS (SELECT chain, status, after, (CASE WHEN LEN(sp)>0 THEN (SELECT hz FROM tm WHERE tm.status=st.status AND tm.nd=sp[1].nd AND tm.lo=sp[1].lo AND tm.hi=sp[1].hi AND tm.xd=sp[1].xd) ELSE rate END)*CASE LEN(ht) WHEN 0 THEN 1E0 WHEN 1 THEN 1E0/(ht[1].xd-ht[1].nd+2) ELSE 0E0 END AS rate FROM st),
 sk AS (SELECT ms.chain, ms.status, COALESCE(away,0) AS away, COALESCE((SELECT SUM(rate) FROM mo WHERE mo.chain=ms.chain AND mo.status=ms.status),0) AS taken FROM ms LEFT JOIN aw USING (status))"""


def _rates(f: Fixture) -> DataFrame:
    own, found = close(f)
    return chains.rate_rows(found, own, chains.Rates(*HAZARDS), trim)


@plan(with_views(_RATES, "SELECT chain, status, after, rate FROM mo UNION ALL SELECT chain, status, status, -away FROM sk UNION ALL SELECT chain, status, NULL, away-taken FROM sk"), "fx_event", doubles="rate")
def sink_rates(f: Fixture) -> DataFrame:
    """The rates between the statuses of each kind's close states, minus the rate of leaving on the diagonal, and the flow into the sink (after null)."""
    return _rates(f)


@plan()
def kind_likelihood(f: Fixture) -> DataFrame:
    """For each observed kind the log-probability of its status at time 0.02, over all ten targets, and its derivative by time.  No SQL: the
    exponential's action on a vector; tests hold it against dense exponentials."""
    own, _ = close(f)
    rows = written(chains.matrices(_rates(f)), "matrices").join(own.select("chain", "asked"), "chain")
    rows = rows.select("chain", "asked", "statuses", "starts", "ends", "values", F.lit(0.02).alias("length"), F.transform("statuses", lambda s: (s == F.col("asked")).cast("double")).alias("vector"))
    found = chains.acted(rows, ["chain"])
    at = F.array_position("statuses", F.lit(0).cast("long")).cast("int")
    return found.select("chain", F.log(F.element_at("down", at)).alias("log_p"), F.element_at("slope", at).alias("slope"))


def tree(f: Fixture) -> DataFrame:
    """node_id, parent_id, level, length, spine, abundance: all inner nodes are unresolved, a child's offset on the spine is a part of its branch."""
    offset = F.col("dist") * (F.crc32(F.col("node_id").cast("binary")) % 4) / 8.0
    nodes = f.node.join(trees.depths(f.node, f.closure).select("node_id", "level"), "node_id").withColumn("offset", offset)
    longest = nodes.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("node_id")).agg(F.max("offset").alias("spine"))
    seen = f.leaf.select("node_id", "abundance")
    out = nodes.join(longest, "node_id", "left").join(seen, "node_id", "left")
    return out.select("node_id", "parent_id", "level", (F.col("dist") - F.col("offset")).alias("length"), F.coalesce("spine", F.lit(0.0)).alias("spine"), F.coalesce("abundance", F.lit(1)).alias("abundance"))


def tree_chains(f: Fixture) -> tuple[DataFrame, DataFrame, DataFrame]:
    def make() -> tuple[DataFrame, DataFrame, DataFrame]:
        annotated = states.annotated(f).withColumn("barcode", F.lit(0))
        levels = trees.depths(f.node, f.closure).select("node_id", "level")
        return tuple(written(t, "tree-chains") for t in chains.tree_states(annotated, levels, TARGETS, told=trim))

    return f.at_rest("tree-chains", make)


@plan()
def tree_close_states(f: Fixture) -> DataFrame:
    """How many states and statuses each node's chain has, the extra steps that it took, and whether they are more than the budget.  No SQL:
    a search from each parent's states; tests hold it against a plain search."""
    found, nodes, own = tree_chains(f)
    size = found.groupBy("chain").agg(F.count("*").alias("states"), F.count_distinct("status").alias("statuses"))
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("states", "statuses")]  # a chain may have no state
    return nodes.join(size, "chain", "left").join(own.select("chain", "required", "extra", "over"), "chain", "left").select("node_id", "parent_id", *counts, "required", "extra", "over")


@plan()
def tree_likelihood(f: Fixture) -> DataFrame:
    """Log-likelihood of all leaves over all ten targets, with spines and abundance weights.  No SQL: pruning; tests sum over all inner states."""
    found, nodes, own = tree_chains(f)
    hazards = chains.Rates(*HAZARDS)
    rates = written(chains.rate_rows(found.where("chain != 'root'"), own, hazards, trim), "rates")
    leaves = states.annotated(f).join(f.node.where("is_leaf").select("node_id"), "node_id").select(F.lit(0).alias("barcode"), "node_id", sa.max_status(F.col("state")).alias("status"))
    return chains.likelihood(tree(f), nodes, rates, leaves, hazards, 0.25)
