"""Benchmark decontamination by winnowing, in Column expressions only.

Every window of words keeps the smallest hash of its k-grams.  A window that a document and
an item share keeps the same k-gram on both sides, whatever is around it, so joining the kept
hashes finds every shared window; around each hit the document's words are then extended to
whole windows, which must be equal to an item's, word for word.

Documents are cut into chunks of CHUNK window beginnings, so an expression never goes over
more than one chunk.  Chunks test their kept hashes against a bitmap of the items' hashes
(at most 128 KB; more items only let more hits through to the join) and keep the words around
those that pass: the text is read once, and what is shuffled are hits and a digest a document.

Items that share a window are put under one name, by that window's set of items, and
documents with the same sets share one list: a passage that many items and many documents
have is never a product of both.

Rows: texts are compared, not ids: equal texts have equal results, so repeated rows and null
ids need no care.  Null and empty texts have no words; an item without words has no window;
an item of fewer words than a window is one window.  Very long texts go chunk by chunk.
A null item id counts as the empty string, an id that several items have counts once.  Other
columns come back in a struct, whatever their names; an empty table of either kind gives
documents without hits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from .common import ascii_lower, discard, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Window beginnings in a chunk; places within one fit into PLACE bits.
CHUNK, PLACE = 4096, 13
#: Bits of the bitmap: at least, for each hash, at most.
LEAST_BITS, BITS_EACH, MOST_BITS = 1 << 12, 32, 1 << 20

_AT = (1 << PLACE) - 1


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _between(lo: Column, hi: Column) -> Column:
    """lo to hi - 1; nothing where there are none."""
    return F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))


def _gram_hashes(hashes: Column, n: Column, k: int) -> Column:
    """A hash of each k words in a row, its lowest bits their place."""
    gram = lambda i: F.xxhash64(F.lit(k), *(F.get(hashes, i + j) for j in range(k)))
    return F.transform(_between(F.lit(0), n - (k - 1)), lambda i: gram(i).bitwiseAND(F.lit(~_AT)).bitwiseOR(i.cast("long")))


def fingerprints(chunk: Column, window: int, k: int) -> Column:
    """The smallest hash of each window (its first place among equal ones), each once: hash in the upper bits, place in the lowest.  Windows
    of k words or fewer keep all grams of their length."""
    hashes = F.transform(chunk, lambda w: F.xxhash64(w))
    if window <= k:
        return let(hashes, lambda h: _gram_hashes(h, F.size(h), window))
    wide = window - k + 1
    least = lambda v: F.transform(_between(F.lit(0), F.size(v) - (wide - 1)), lambda i: F.least(*(F.get(v, i + j) for j in range(wide))))
    return F.array_distinct(let(hashes, lambda h: let(_gram_hashes(h, F.size(h), k), least)))


def _hash(mark: Column) -> Column:
    return mark.bitwiseAND(F.lit(~_AT))


def _bit(mark: Column, n_bits: int) -> Column:
    return F.shiftright(mark, PLACE).bitwiseAND(F.lit(n_bits - 1))


def _bitmap(hashes: DataFrame, n_bits: int) -> DataFrame:
    """One row: array bits of n_bits / 64 numbers."""
    bit = _bit(F.col("hash"), n_bits)
    one = F.lit(1).cast("long")
    set_bits = hashes.select(F.shiftright(bit, 6).alias("id"), F.call_function("shiftleft", one, bit.bitwiseAND(F.lit(63)).cast("int")).alias("b")).groupBy("id").agg(F.bit_or("b").alias("b"))
    whole = hashes.sparkSession.range(n_bits // 64).join(set_bits, "id", "left").select(F.struct("id", F.coalesce("b", F.lit(0).cast("long")).alias("b")).alias("x"))
    return whole.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]).alias("bits"))


def _chunks(rows: DataFrame, window: int) -> DataFrame:
    """rows (with words) by chunk: start, chunk; a row without words has one empty chunk."""
    starts = F.when(F.size("words") > CHUNK, F.sequence(F.lit(0), F.size("words") - 1, F.lit(CHUNK))).otherwise(F.array(F.lit(0)))
    if_long = F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice("words", s + 1, F.lit(CHUNK + window - 1)).alias("chunk")))
    return rows.withColumn("x", F.explode(if_long)).drop("words").select("*", "x.*").drop("x")


class Benchmark:
    """Items by their windows, at rest: hashes (hash) of every window length, windows (window, items: a name for its set of items),
    members (items, item_id)."""

    def __init__(self, items: DataFrame, window: int, k: int, id_col: str, text_col: str):
        self.window, self.k = window, k
        rows = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item_id"), words(F.col(f"`{text_col}`")).alias("words")).where(F.size("words") > 0)
        size = F.least(F.size("words"), F.lit(window))
        chunks = written(_chunks(rows.withColumn("size", size), window), "item-chunks")
        self.lengths = sorted(r.size for r in chunks.select("size").distinct().collect())  # 1 to window
        marks = [chunks.where(F.col("size") == n).select(F.explode(fingerprints(F.col("chunk"), n, k if n == window else n)).alias("m")) for n in self.lengths]
        found = reduce(DataFrame.unionByName, marks).select(_hash(F.col("m")).alias("hash")) if marks else chunks.select(F.lit(0).cast("long").alias("hash")).where("false")
        self.hashes = written(found.distinct(), "item-hashes")
        place = F.explode(_between(F.lit(0), F.size("chunk") - F.col("size") + 1))
        each = chunks.select("item_id", "chunk", "size", place.alias("i")).select("item_id", F.concat_ws(" ", F.slice("chunk", F.col("i") + 1, F.col("size"))).alias("window"))
        have = written(each.distinct(), "item-windows")
        mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), F.col("item_id")))
        sets = F.concat_ws(".", F.count("*"), mark(1), mark(2))
        self.windows = written(have.groupBy("window").agg(sets.alias("items")), "item-sets")
        one = self.windows.groupBy("items").agg(F.min("window").alias("window"))
        self.members = written(one.join(have, "window").select("items", "item_id"), "item-members")
        for done in (chunks, have):
            discard(done)

    def bitmap(self) -> tuple[DataFrame, int]:
        n_bits = LEAST_BITS
        while n_bits < min(MOST_BITS, BITS_EACH * self.hashes.count()):
            n_bits *= 2
        return _bitmap(self.hashes, n_bits), n_bits

    def marked(self, chunk: Column, bits: Column, n_bits: int) -> Column:
        """The kept hashes of a chunk that the bitmap has, with the words around: array of (hash, size of the window, at, around)."""

        def passes(mark: Column) -> Column:
            bit = _bit(mark, n_bits)
            return F.call_function("getbit", F.get(bits, F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63)).cast("int")) == 1

        def around(size: int) -> Callable[[Column], Column]:
            reach = max(size - self.k, 0) if size == self.window else 0

            def of(mark: Column) -> Column:
                at = mark.bitwiseAND(F.lit(_AT)).cast("int")
                lo = F.greatest(at - reach, F.lit(0))
                return F.struct(_hash(mark).alias("hash"), F.lit(size).alias("size"), lo.alias("at"), F.slice(chunk, lo + 1, at + size - lo).alias("around"))

            return of

        parts = [F.transform(F.filter(fingerprints(chunk, n, self.k if n == self.window else n), passes), around(n)) for n in self.lengths]
        return F.concat(*parts) if parts else F.array().cast("array<struct<hash:long,size:int,at:int,around:array<string>>>")


def _covered(spans: Column) -> Column:
    """Places within any of the spans (first place, places), which are in order."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, s: Column) -> Column:
        end = s["first"] + s["size"]
        return F.struct(F.greatest(acc["upto"], end).alias("upto"), (acc["n"] + F.greatest(end - F.greatest(acc["upto"], s["first"]), F.lit(0))).alias("n"))

    return F.aggregate(spans, start, step)["n"]


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """row (a struct of docs' columns but the text), n_words, n_hit (words within an item's window), spans (hit places: first, size; null
    without hits), items (ids of the items with windows in the text, sorted as strings)."""
    bench = Benchmark(items, window, k, item_id_col, item_text_col)
    bitmap, n_bits = bench.bitmap()
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    own = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct(*kept).alias("row"), F.sha2(own.cast("binary"), 256).alias("digest"), words(own).alias("words"))
    rows = _chunks(rows.withColumn("n_words", F.size("words").cast("long")), window).withColumn("bits", bitmap.scalar())
    marked = rows.select("row", "digest", "n_words", "start", bench.marked(F.col("chunk"), F.col("bits"), n_bits).alias("marks"))
    # a row a chunk: its marks, and for a document's first chunk the document
    found = written(marked.select(F.when(F.col("start") == 0, F.col("row")).alias("row"), "digest", "n_words", "start", "marks"), "marked")
    hits = found.where(F.size("marks") > 0).select("digest", "start", F.explode("marks").alias("m")).select("digest", "start", "m.*").join(bench.hashes, "hash", "left_semi")
    first = F.explode(_between(F.lit(0), F.size("around") - F.col("size") + 1))
    extended = hits.select("digest", "start", "at", "size", "around", first.alias("i"))
    extended = extended.select("digest", (F.col("start") + F.col("at") + F.col("i")).alias("first"), "size", F.concat_ws(" ", F.slice("around", F.col("i") + 1, F.col("size"))).alias("window"))
    equal = written(extended.join(bench.windows, "window").select("digest", "first", "size", "items").distinct(), "hits")
    spans = equal.groupBy("digest").agg(F.array_sort(F.collect_set(F.struct("first", "size"))).alias("spans"), F.array_sort(F.collect_set("items")).alias("sets"))  # bounded by a text's words
    spans = written(spans.withColumn("combination", F.sha2(F.array_join("sets", " "), 256)), "hit-texts")
    combos = spans.groupBy("combination").agg(F.first("sets").alias("sets")).select("combination", F.explode("sets").alias("items"))
    lists = combos.join(bench.members, "items").groupBy("combination").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    per_text = spans.select("digest", "spans", _covered(F.col("spans")).alias("n_hit"), "combination").join(lists, "combination")
    out = found.where(F.col("start") == 0).select("row", "digest", "n_words").join(per_text, "digest", "left")
    return out.select("row", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
