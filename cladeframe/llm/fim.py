"""Fill-in-middle transformation: texts cut at two of their boundaries, their pieces in another order behind sentinels.

A text becomes a numpy array of code points (UTF-32).  Neighbouring code points of different
class make a boundary; two boundaries, chosen by rank, cut the text into prefix, middle and
suffix, which are encoded again.  Classes are each code point by itself (every place between
two is a boundary), words and the white space between them, or lines.

Ranks and forms follow from a hash of seed and id, so reruns and other partitions agree.

Rows: a null text is empty; an empty text, and one that holds a sentinel, stays plain.  Very
long texts are cut whole: a text takes four bytes a code point and its pieces.  Repeated rows
give repeated results; a null id hashes as the empty string; other columns, whatever their
names, come back in a struct; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: White space between words, as in the other operators.
_BLANKS = np.array([9, 10, 11, 12, 13, 32], np.uint32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def as_text(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def classes(points: np.ndarray, unit: str) -> np.ndarray:
    """A class for each code point; units end where neighbours differ."""
    if unit == "code point":
        return np.arange(len(points))
    if unit == "word":
        return np.isin(points, _BLANKS)
    if unit == "line":
        return np.cumsum(points == 10) - (points == 10)  # a line takes its end along
    raise ValueError(f"no unit {unit}")


def boundaries(points: np.ndarray, unit: str) -> np.ndarray:
    """Where units begin and end, from 0 to the length."""
    kinds = classes(points, unit)
    inner = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def pieces(text: str, first: int, second: int, unit: str = "code point") -> tuple[int, tuple[str, str, str]]:
    """Number of units; prefix, middle and suffix, cut behind as many units as both hashes modulo (units + 1) say."""
    points = code_points(text)
    cuts = boundaries(points, unit)
    n = len(cuts) - 1
    lo, hi = sorted((first % (n + 1), second % (n + 1)))
    a, b = cuts[[lo, hi]]
    return n, (as_text(points[:a]), as_text(points[a:b]), as_text(points[b:]))


def hashes(id_col: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of seed:id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20, unit: str = "code point", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a struct of docs' columns but the text), n (units), form, prefix_chars, middle_chars (code points; null if plain), output.

    plain: percent of texts that stay as they are; spm: percent of the others with the suffix first, the rest have the prefix first."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    h1, h2, h3, h4 = hashes(F.col(f"`{id_col}`"), seed)
    held = F.greatest(*(F.instr(text, s) for s in (PREFIX, SUFFIX, MIDDLE))) > 0
    form = F.when((text == "") | held | (h3 % 100 >= 100 - plain), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")

    @F.pandas_udf("n long, prefix_chars long, middle_chars long, output string")
    def cut(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t, shape, one, two in zip(*batch):
                n, (prefix, middle, suffix) = pieces(t, one, two, unit)
                if shape == "plain":
                    rows.append((n, None, None, t))
                    continue
                parts = (PREFIX, prefix, SUFFIX, suffix) if shape == "psm" else (SUFFIX, suffix, PREFIX, prefix)
                rows.append((n, len(prefix), len(middle), "".join((*parts, MIDDLE, middle))))
            out = pd.DataFrame(rows, columns=["n", "prefix_chars", "middle_chars", "output"])
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    kept = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*kept).alias("row"), text.alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    made = rows.select("row", "form", cut("text", "form", "h1", "h2").alias("x"))
    return made.select("row", "x.n", "form", "x.prefix_chars", "x.middle_chars", "x.output")


def restored(output: Column, form: Column) -> Column:
    """The text from output and form: the pieces between the sentinels' first occurrences.  A text that holds a sentinel stays plain,
    and a piece's end never makes one with the sentinel behind it, so these are the sentinels that were put there."""

    def between(after: str, before: str) -> Column:
        rest = F.substring_index(F.substr(output, F.instr(output, after) + len(after)), before, 1)
        return rest

    last = F.substr(output, F.instr(output, MIDDLE) + F.lit(len(MIDDLE)))
    psm = F.concat(between(PREFIX, SUFFIX), last, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), last, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
