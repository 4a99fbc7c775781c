"""Queries on read files and the cleaning of their events.  Files are written from the fixture's raw events to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import events as ev
from ..functions import reads
from ..functions.arrays import let
from ..sources import reads as source
from ..tables import new_path
from .fixtures import FIRST_CUT, LENGTH, STEP, TARGETS, Fixture
from .registry import plan, with_views

DESIGN = reads.Design(tuple(FIRST_CUT + STEP * t for t in range(TARGETS)), tuple(13 + 27 * t for t in range(TARGETS)), tuple(24 + 27 * t for t in range(TARGETS)), LENGTH)
SHIFT, NEAR = 100, 30

_ON_CUTS = """a1 AS (SELECT *, start_pos+del_len AS de, min_target+CASE WHEN start_pos>19+27*min_target THEN 1 ELSE 0 END AS ns, max_target-CASE WHEN start_pos+del_len<19+27*max_target THEN 1 ELSE 0 END AS ne FROM fx_raw),
 a2 AS (SELECT *, CASE WHEN ns<=ne THEN NULL WHEN ns>9 THEN ne WHEN ne<0 THEN 0 WHEN LEAST(ABS(start_pos-19-27*ns),ABS(de-19-27*ns))<LEAST(ABS(start_pos-19-27*ne),ABS(de-19-27*ne)) THEN ns ELSE ne END AS tg FROM a1),
 a3 AS (SELECT *, CASE WHEN tg IS NULL THEN start_pos ELSE LEAST(start_pos,19+27*tg) END AS s FROM a2),
 a4 AS (SELECT *, CASE WHEN tg IS NULL THEN del_len ELSE GREATEST(de,19+27*tg)-s END AS dl FROM a3),
 e4 AS (SELECT cell_id, CAST(ROW_NUMBER() OVER (PARTITION BY cell_id ORDER BY start_pos) AS BIGINT) AS k, CAST(s AS BIGINT) AS s, CAST(dl AS BIGINT) AS dl, CAST(COALESCE(tg,ns) AS BIGINT) AS mn, CAST(COALESCE(tg,ne) AS BIGINT) AS mx,
  insert_str||CASE WHEN tg IS NULL THEN '' ELSE REPEAT('a',CAST(dl-del_len AS BIGINT)) END AS ins FROM a4)"""
_CLASH = """((CASE WHEN m.mx<9 AND 13+27*(m.mx+1)<m.s+m.dl THEN m.mx+1 ELSE m.mx END)=(CASE WHEN e.mn>0 AND e.s<=24+27*(e.mn-1) THEN e.mn-1 ELSE e.mn END) AND e.s-m.s-m.dl<=30 OR m.mx>=e.mn)"""
_MERGED = f"""{_ON_CUTS}, m(cell_id,k,g,s,dl,mn,mx,ins) AS (SELECT cell_id,k,CAST(1 AS BIGINT),s,dl,mn,mx,ins FROM e4 WHERE k=1
  UNION ALL SELECT e.cell_id,e.k,CASE WHEN {_CLASH} THEN m.g ELSE m.g+1 END,CASE WHEN {_CLASH} THEN m.s ELSE e.s END,CASE WHEN {_CLASH} THEN e.s-m.s+e.dl ELSE e.dl END,
   CASE WHEN {_CLASH} THEN m.mn ELSE e.mn END,CASE WHEN {_CLASH} THEN GREATEST(m.mx,e.mx) ELSE e.mx END,CASE WHEN {_CLASH} THEN m.ins||e.ins||CASE WHEN e.s-m.s>=m.dl THEN 'a' ELSE '' END ELSE e.ins END
  FROM m JOIN e4 e ON e.cell_id=m.cell_id AND e.k=m.k+1),
 x AS (SELECT cell_id, g, ARG_MAX(s,k) AS s, ARG_MAX(dl,k) AS dl, ARG_MAX(mn,k) AS mn, ARG_MAX(mx,k) AS mx, ARG_MAX(ins,k) AS ins FROM m GROUP BY 1,2)"""
_CLEAN = f"{_MERGED}, c AS (SELECT cell_id, g, s, CASE WHEN mx=9 AND s+dl>284 THEN 284-s ELSE dl END AS dl, mn, mx, ins FROM x)"
_KEYS = _CLEAN + ", w AS (SELECT cell_id, STRING_AGG(CONCAT_WS('_',s,dl,mn,mx,ins),'=' ORDER BY g) AS allele_str FROM c GROUP BY 1)"


def raw_events(f: Fixture) -> DataFrame:
    return f.raw.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "del_len", "min_target", "max_target", "insert_str"))).alias("events"))


def on_cuts(f: Fixture) -> DataFrame:
    return raw_events(f).withColumn("events", F.transform("events", lambda e: reads.reassign(e, DESIGN)))


def exploded(df: DataFrame) -> DataFrame:
    return df.select("cell_id", F.posexplode("events").alias("k", "e")).select("cell_id", (F.col("k") + 1).cast("long").alias("k"), *(F.col(f"e.{c}").alias(c) for c in ("start_pos", "del_len", "min_target", "max_target", "insert_str")))


def cells(f: Fixture) -> DataFrame:
    """cell_id, organ, cells: an array of target cells for each order that has events."""
    text = lambda e: F.when(e["insert_str"] == "", F.concat(e["del_len"].cast("string"), F.lit("D+"), (e["start_pos"] + SHIFT).cast("string"))).otherwise(F.concat(F.length(e["insert_str"]).cast("string"), F.lit("I+"), (e["start_pos"] + SHIFT).cast("string"), F.lit("+"), e["insert_str"]))

    def cell(t):
        here = F.filter("events", lambda e: (e["min_target"] <= t) & (t <= e["max_target"]))
        return F.when(F.size(here) > 0, F.array_join(F.transform(here, text), "&")).when(F.col("cell_id") % 2 == 0, "NONE").otherwise("UNKNOWN")

    organ = F.when(F.col("o_orderkey") % 11 == 0, "7B_1_to_20_blood").otherwise(F.col("o_orderpriority")).alias("organ")
    own = raw_events(f).join(f.orders.select(F.col("o_orderkey").alias("cell_id"), organ), "cell_id")
    return own.select("cell_id", "organ", F.transform(F.sequence(F.lit(0), F.lit(TARGETS - 1)), cell).alias("cells"))


def file_of(df: DataFrame, name: str) -> str:
    path = new_path(df.sparkSession, name)
    df.write.option("sep", "\t").option("header", True).csv(path)
    return path


def _wide(f: Fixture, *first: str) -> DataFrame:
    return cells(f).select(*(F.expr(x) for x in first), *(F.get("cells", t).alias(f"target{t + 1}") for t in range(TARGETS)))


_ROW = "cell_id, k, CAST(s AS INT) AS start_pos, CAST(dl AS INT) AS del_len, CAST(mn AS INT) AS min_target, CAST(mx AS INT) AS max_target, ins AS insert_str"


@plan(with_views(_ON_CUTS, f"SELECT {_ROW} FROM e4"), "fx_raw")
def cut_site_reassign(f: Fixture) -> DataFrame:
    return exploded(on_cuts(f))


@plan(with_views(_MERGED, f"SELECT {_ROW.replace(' k,', ' g AS k,')} FROM x"), "fx_raw")
def clash_merge(f: Fixture) -> DataFrame:
    return exploded(on_cuts(f).withColumn("events", reads.merge_clashes(F.col("events"), DESIGN, NEAR)))


@plan(with_views(_CLEAN, f"SELECT {_ROW.replace(' k,', ' g AS k,')}, dl<xdl AS clipped FROM (SELECT c.*, x.dl AS xdl FROM c JOIN x USING (cell_id, g)) y"), "fx_raw")
def overflow_clip(f: Fixture) -> DataFrame:
    merged = on_cuts(f).withColumn("events", reads.merge_clashes(F.col("events"), DESIGN, NEAR))
    before = exploded(merged).select("cell_id", "k", F.col("del_len").alias("was"))
    after = exploded(merged.withColumn("events", reads.clip_overflow(F.col("events"), DESIGN)))
    return after.join(before, ["cell_id", "k"]).withColumn("clipped", F.col("del_len") < F.col("was")).drop("was")


@plan(with_views(_KEYS, "SELECT * FROM w"), "fx_raw")
def clean_reads(f: Fixture) -> DataFrame:
    return cells(f).select("cell_id", let(reads.clean(F.col("cells"), DESIGN, SHIFT, NEAR), ev.allele_key).alias("allele_str"))


_ORGAN = "orders o ON o.o_orderkey=w.cell_id WHERE o.o_orderkey%11<>0"


@plan(with_views(_KEYS, f"SELECT o.o_orderpriority AS organ, allele_str, COUNT(*) AS abundance FROM w JOIN {_ORGAN} GROUP BY 1,2"), "fx_raw")
def src_by_read(f: Fixture) -> DataFrame:
    path = file_of(_wide(f, "organ", "cell_id AS umi"), "reads")
    return source.by_read(f.spark, path, DESIGN, SHIFT, NEAR).drop("events")


@plan(with_views(_KEYS, f"SELECT o.o_orderpriority AS organ, allele_str, CAST(SUM(1+cell_id%5) AS BIGINT) AS abundance FROM w JOIN {_ORGAN} GROUP BY 1,2"), "fx_raw")
def src_by_allele(f: Fixture) -> DataFrame:
    control = F.col("organ") == "7B_1_to_20_blood"
    rows = cells(f).select("cell_id", F.when(control, F.col("organ")).otherwise(F.concat(F.lit("17_"), "organ")).alias("organ"), (1 + F.col("cell_id") % 5).alias("n"), F.array_join("cells", "_").alias("hmid"))
    return source.by_allele(f.spark, file_of(rows, "alleles"), DESIGN, SHIFT, NEAR).drop("events")


@plan(with_views(_KEYS, "SELECT 'single_state' AS organ, allele_str, COUNT(*) AS abundance FROM w WHERE cell_id%3<>0 GROUP BY 1,2"), "fx_raw")
def src_passed(f: Fixture) -> DataFrame:
    path = file_of(_wide(f, "cell_id AS umi", "CASE WHEN cell_id%3<>0 THEN 'PASS' ELSE 'FAIL' END AS verdict"), "umis")
    return source.passed(f.spark, path, DESIGN, SHIFT, NEAR).drop("events")


_READS = "SELECT o.o_orderpriority AS organ, start_pos+100 AS start_pos, del_len, min_target, max_target, insert_str, COUNT(*) AS n FROM fx_raw w JOIN " + _ORGAN + " GROUP BY ALL"


def _event_counts(df: DataFrame) -> DataFrame:
    return df.select("organ", F.explode("events").alias("e")).select("organ", "e.start_pos", "e.del_len", "e.min_target", "e.max_target", "e.insert_str").groupBy("organ", "start_pos", "del_len", "min_target", "max_target", "insert_str").agg(F.count("*").alias("n"))


@plan(_READS, "fx_raw")
def src_as_they_stand(f: Fixture) -> DataFrame:
    return _event_counts(source.as_they_stand(f.spark, file_of(_wide(f, "organ", "cell_id AS umi"), "reads")))


@plan(_READS, "fx_raw")
def src_by_column(f: Fixture) -> DataFrame:
    rows = cells(f).select("cell_id", "organ", F.array_join("cells", "_").alias("hmid"))
    return _event_counts(source.by_column(f.spark, file_of(rows, "reads"), 1, 2))
