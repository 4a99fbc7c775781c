"""Quality rules by tokeniser fertility.

Two public vocabularies measure each whole text: characters per token of a piece
vocabulary and of a byte-level one, the share of the former's tokens that are
single fallback bytes, and the entropy of its tokens.  Every language has its own
rejection bands for each octave of text length (in tokens): the median and the
quartiles over all documents give a centre and a spread, and a text more than
``low`` spreads below or ``high`` above the centre of any measure (for fallback
only above) is rejected.  The quartiles come from counts of the measures in steps of
``STEP``, which tasks add up before the shuffle, so they are the same in every run.  Where an octave of a language has fewer than ``least``
documents, the nearest octave of the language that has enough gives the bands (the
shorter one of two), else the language over all lengths, else the nearest octave over
all languages, else all documents, however few: every text with tokens meets bands.

Base rules on words (runs of other than ASCII white space) come first.
Rows: null counts as empty (no words: base_failed); a null language is a language
of its own, other than the empty one; very long texts are read whole; repeated rows
give repeated results; further columns, whatever their names, pass by in a struct; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .pieces import two_vocabularies

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MEASURES = ("piece_chars", "byte_level_chars", "fallback", "entropy")
FIELDS = BASE + ", n_tokens long, " + ", ".join(f"{m} double" for m in MEASURES)
WINDOW = 8
#: Width of the steps in which measures are counted for the bands.
STEP = 1 / 256
#: Rows of bands up to which they are broadcast (about 100 bytes each).
BROADCAST_ROWS = 20_000


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows that occur twice or more; windows are ranked exactly, by doubling."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    names = {w: k for k, w in enumerate(dict.fromkeys(words))}
    rank = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
    span = 1
    while span < width:
        rank = np.unique(rank[:-span] * (int(rank.max()) + 1) + rank[span:], return_inverse=True)[1]
        span *= 2
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[width : n + width] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_measures(text: str) -> tuple[int, int, int, int, int]:
    data = text.encode()
    words = data.split()
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in data.split(b"\n") if not x.isspace() and x]
    return len(words), chars, sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), repeated_words(words)


def measure_column(text: Column, model_path: str, ranks_path: str, pattern: str) -> Column:
    """struct of the base measures and of the vocabularies' ones (0 for texts without tokens)."""

    @F.pandas_udf(FIELDS)
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabularies = two_vocabularies(model_path, ranks_path, pattern)
        columns = [x.split()[0] for x in FIELDS.split(", ")]
        for texts in batches:
            rows = []
            for t in texts:
                t = t or ""
                base = base_measures(t)
                if not t:
                    rows.append((*base, 0, 0.0, 0.0, 0.0, 0.0))
                    continue
                counts, other = vocabularies.measure(t)
                n = int(counts.sum())
                if not n:  # white space that the vocabulary's normal form drops
                    rows.append((*base, 0, 0.0, 0.0, 0.0, 0.0))
                    continue
                some = counts[counts > 0]
                entropy = float(np.log2(n) - (some * np.log2(some)).sum() / n)
                rows.append((*base, n, len(t) / n, len(t) / other, float(counts[vocabularies.fallback].sum()) / n, entropy))
            yield pd.DataFrame(rows, columns=columns)

    return measure(text)


def bands(measured: DataFrame, low: float, high: float, least: int) -> DataFrame:
    """Bounds lo_m, hi_m of each measure for every (lang, octave) that measured has: the first that there are of its own
    or the language's nearest octave, the language, the nearest octave over all languages, all documents."""
    steps = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.floor(F.col(m) / STEP).alias("step")) for m in MEASURES)))
    counts = measured.where("NOT base_failed").select("lang", "octave", steps.alias("x")).groupBy("lang", "octave", "x.m", "x.step").agg(F.count("*").alias("c"))
    counts = written(counts, "steps")

    def of(rows: int, *keys: str) -> DataFrame:
        own = Window.partitionBy(*keys, "m")  # a row for each step that any text has
        ranked = counts.groupBy(*keys, "m", "step").agg(F.sum("c").alias("c")).select(*keys, "m", "step", F.sum("c").over(own.orderBy("step")).alias("upto"), F.sum("c").over(own).alias("n"))
        quarter = lambda k: ((F.min(F.when(F.col("upto") * 4 >= F.col("n") * k, F.col("step"))) + 0.5) * STEP).alias(f"q{k}")
        found = ranked.groupBy(*keys, "m", "n").agg(quarter(1), quarter(2), quarter(3)).where(F.col("n") >= rows)
        spread = F.greatest((F.col("q3") - F.col("q1")) / 1.349, F.lit(0.01))
        edges = found.select(*keys, "m", (F.col("q2") - low * spread).alias("lo"), (F.col("q2") + high * spread).alias("hi"))
        at = lambda m, side: F.min(F.when(F.col("m") == m, F.col(side))).alias(f"{side}_{m}")
        return edges.groupBy(*keys).agg(F.struct(*(at(m, side) for m in MEASURES for side in ("lo", "hi"))).alias("band"))

    def nearest(wanted: DataFrame, found: DataFrame, name: str, *keys: str) -> DataFrame:
        """wanted with the band of the octave of found that is nearest, the shorter one of two."""
        there = found.withColumnRenamed("octave", "at")
        pairs = wanted.select(*keys, "octave").distinct().join(there, list(keys)) if keys else wanted.select("octave").distinct().crossJoin(there)
        far = F.struct(F.abs(F.col("at") - F.col("octave")), "at")
        return wanted.join(pairs.groupBy(*keys, "octave").agg(F.min_by("band", far).alias(name)), [*keys, "octave"], "left")

    wanted = written(measured.groupBy("lang", "octave").agg(F.count("*").alias("n")).select("lang", "octave"), "octaves")
    out = nearest(wanted, written(of(least, "lang", "octave"), "bands"), "own", "lang")
    out = out.join(of(least, "lang").withColumnRenamed("band", "language"), "lang", "left")
    out = nearest(out, written(of(least, "octave"), "bands"), "octave_of_all")
    out = out.join(F.broadcast(of(1).where("band.lo_entropy IS NOT NULL").withColumnRenamed("band", "every")), how="left")  # one row
    return out.select("lang", "octave", F.coalesce("own", "language", "octave_of_all", "every").alias("band")).select("lang", "octave", "band.*")


def judge(docs: DataFrame, model_path: str, ranks_path: str, pattern: str, *, row: list[str], text_col: str = "text", lang_col: str = "lang", low: float = 4.0, high: float = 8.0, least: int = 50) -> DataFrame:
    """row (a struct of those columns of docs), base measures, base_failed, the vocabularies' measures, kept."""
    lang = F.coalesce(F.concat(F.lit("="), F.col(lang_col)), F.lit(""))
    picked = docs.select(F.struct(*row).alias("row"), lang.alias("lang"), measure_column(F.col(text_col), model_path, ranks_path, pattern).alias("m"))
    measured = picked.select("row", "lang", "m.*")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    measured = written(measured.withColumns({"base_failed": failed, "octave": F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int")}), "measured")
    own = written(bands(measured, low, high, least), "bands")
    if own.count() <= BROADCAST_ROWS:  # languages times octaves; a corpus with more of them joins by shuffle
        own = F.broadcast(own)
    joined = measured.alias("d").join(own.alias("o"), ["lang", "octave"], "left")
    inside = F.lit(True)
    for m in MEASURES:
        lo, hi = F.col(f"o.lo_{m}"), F.col(f"o.hi_{m}")
        # no band only where no text passes the base rules; a text without tokens fails them
        inside &= F.coalesce((F.col(f"d.{m}") <= hi) if m == "fallback" else F.col(f"d.{m}").between(lo, hi), F.lit(True))
    names = [x.split()[0] for x in BASE.split(", ")]
    return joined.select("row", *names, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "n_tokens", *(F.col(f"d.{m}") for m in MEASURES))
