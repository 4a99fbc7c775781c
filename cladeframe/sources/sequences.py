"""FASTQ with events in the description, PHYLIP character matrices, and the output of its program mix."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every base of a written read has the quality 60, the character ']'; an event in a description.
QUALITY, EVENT = "]", "[0-9]*:[0-9]*:[acgt]*"


def write_fastq(reads: DataFrame, path: str) -> None:
    """reads: id, description, sequence.  Each is four lines."""
    lines = F.concat(F.lit("@"), "id", F.lit(" "), "description", F.lit("\n"), "sequence", F.lit("\n+\n"), F.repeat(F.lit(QUALITY), F.length("sequence")))
    reads.select(lines.alias("value")).write.text(path)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """id, events, sequence of every record.  Records are cut at a '@' that begins a line, so no quality line may begin with one."""
    text = spark.read.option("lineSep", "\n@").text(path)
    whole = F.regexp_replace(F.col("value"), "^@", "")
    lines = F.split(whole, "\n")
    header = F.get(lines, 0)
    return text.where("value != ''").select(F.substring_index(header, " ", 1).alias("id"), F.regexp_extract_all(header, F.lit(f"({EVENT})"), 1).alias("events"), F.get(lines, 1).alias("sequence"))


def sequence_counts(reads: DataFrame) -> DataFrame:
    """sequence, abundance, events, and whether all its records name the same events."""
    return reads.groupBy("sequence").agg(F.count("*").alias("abundance"), F.min("events").alias("events"), (F.count_distinct("events") == 1).alias("agree"))


def write_phylip(rows: DataFrame, path: str) -> None:
    """rows: id, characters.  A line of the numbers of rows and characters, then an id padded to ten and its characters on each."""
    size = rows.agg(F.concat_ws(" ", F.count("*").cast("string"), F.coalesce(F.max(F.length("characters")), F.lit(0)).cast("string")).alias("value"))
    lines = size.select(F.lit(0).alias("part"), "value").union(rows.select(F.lit(1).alias("part"), F.concat(F.rpad("id", 10, " "), "characters")))
    lines.repartitionByRange("part").sortWithinPartitions("part").select("value").write.text(path)


# -- output of mix ----------------------------------------------------------------
_LEAVES, _EDGES = re.compile(r"\s*Name\s*Characters", re.I), re.compile(r"\s*\(\s*.\s*means\s+same", re.I)
_LEAF, _MORE_LEAF = re.compile(r"^([\w>.-]+)\s*([01?. \-]+)$"), re.compile(r"^ {13}([01?. \-]+)$")
_EDGE, _MORE_EDGE = re.compile(r"^\s*([\w>-]+)\s+([\w>.-]+)\s+(?:yes|no|maybe)\s+([01?. \-]+)$"), re.compile(r"^\s+([01?. \-]+)$")
MIX = "file string, tree int, node string, parent string, characters string"


def _parse(text: str) -> list[tuple[int, str, str | None, str]]:
    """tree, node, parent, characters: rows without a parent are leaves' own, others edges' differences ('.': as above)."""
    out: dict[tuple[int, str, str | None], str] = {}
    tree, mode, last, blank = -1, "", None, 0
    for line in text.split("\n"):
        if _LEAVES.match(line):
            tree, mode, last, blank = tree + 1, "leaf", None, 0
        elif _EDGES.match(line):
            tree, mode, last, blank = max(tree, 0) + (mode == "edge"), "edge", None, 0
        elif not line.strip():
            blank += 1
            mode = "" if blank > 1 and last else mode
        elif mode == "leaf" and not line.strip(" -"):
            continue  # the line under the heading
        elif mode:
            blank = 0
            if mode == "leaf" and (m := _LEAF.match(line)):
                last = (0, m[1], None)
                out[last] = m[2].replace(" ", "")
            elif mode == "edge" and (m := _EDGE.match(line)):
                last = (tree, m[2], m[1])
                out[last] = m[3].replace(" ", "").upper()
            elif last and (m := (_MORE_LEAF if mode == "leaf" else _MORE_EDGE).match(line)):
                out[last] += m[1].replace(" ", "").upper()
    return [(*k[:2], k[2], v) for k, v in out.items()]


def read_mix(spark: SparkSession, path: str) -> DataFrame:
    """file, tree, node, parent, characters of every output file; one file is one row, as its sections belong together."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(f, *r) for f, t in zip(batch.file, batch.value) for r in _parse(t)]
            yield pd.DataFrame(found, columns=["file", "tree", "node", "parent", "characters"])

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return files.mapInPandas(rows, MIX)


def decoded(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """node_id, parent_id, characters, dist of edges (node_id, parent_id, characters; the root is 'root', all 0): a '.' is what the
    nearest ancestor has that says otherwise; the length is that of changed characters other than '?'.  paths: closure of the edges."""
    said = edges.select(F.col("node_id").alias("anc_id"), F.posexplode(F.split("characters", "(?!$)")).alias("k", "c")).where("c != '.'")
    places = edges.select(F.col("node_id").alias("desc_id"), F.explode(F.sequence(F.lit(0), F.length("characters") - 1)).alias("k"))
    found = paths.join(said, "anc_id").groupBy("desc_id", "k").agg(F.min_by("c", "hops").alias("c"))
    whole = places.join(found, ["desc_id", "k"], "left").groupBy(F.col("desc_id").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("c", F.lit("0")).alias("c")))), lambda x: x["c"]), "").alias("characters"))
    up = whole.select(F.col("node_id").alias("parent_id"), F.col("characters").alias("above"))
    rows = edges.select("node_id", "parent_id").join(whole, "node_id").join(up, "parent_id", "left")
    above = F.coalesce("above", F.repeat(F.lit("0"), F.length("characters")))
    changed = F.filter(F.sequence(F.lit(1), F.length("characters")), lambda k: (F.substring("characters", k, F.lit(1)) != F.substring(above, k, F.lit(1))) & (F.substring("characters", k, F.lit(1)) != "?"))
    return rows.select("node_id", "parent_id", "characters", F.size(changed).alias("dist"))
