"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids meet in a corpus.

Of each text two packed bitsets mark the byte offsets at which a token of the one and of
the other vocabulary ends.  Their AND holds the shared cuts; ranks by popcount turn a cut
into a number of tokens on either side, so every two consecutive cuts give a group, a range
of tokens of each side.  All pairs within a group are links.

Id pairs are counted over documents: tasks count what they read, a shuffle adds up.  The
counts go back to the documents: pairs in so many documents that at most HOT of them can
exist are looked up in the tasks, others are joined by pair, where by the same bound no
pair has many rows.

Rows: null and empty texts, and texts whose tokens do not give back a space and the text
(the second vocabulary has a sign for the space, which a text may contain), have no tokens.
Very long texts are encoded whole; links are expanded in bounded blocks.  Repeated rows
count as documents of their own, ids may be null or repeated; other columns, whatever
their names, are not looked at; an empty table gives an empty result.  Every token must
have bytes: a vocabulary without them for an id that comes up is an error.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Pairs that are looked up in tasks: 21 bytes each.
HOT = 2_000_000
#: Links expanded at a time; groups with more pairs of tokens go by their distinct ids.
BLOCK, WIDE = 4_000_000, 65_536
#: Documents in a batch of results, and characters after which it ends.
BATCH, CHARS = 500, 4_000_000

#: Chunks of texts whose tokens a worker remembers before it starts anew.
MEMO_ENTRIES = 300_000

_SPACE = "▁"  # how pieces write a space
#: A single space before other text begins a match of the byte-level pattern and, where no piece has a space behind a letter, a piece.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CUT, _RUN = re.compile(f"(?<=[^ ]) (?=[^{_WHITE}])"), re.compile(f"^ | (?:[{_WHITE}]|$)")


def _byte_letters() -> dict[str, int]:
    """The letter of each byte in byte-level vocabularies: printable bytes stand for themselves, others for code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level vocabulary's JSON file, encoded by its ids as ranks; special tokens are no tokens here.

    tests/llm holds the ids against the tokenizers library's."""

    def __init__(self, path: str, pattern: str):
        letters = _byte_letters()
        with open(path, encoding="utf-8") as data:
            held = json.load(data)
        special = {t["id"] for t in held["added_tokens"] if t["special"]}
        ranks = {bytes(letters[c] for c in piece): i for piece, i in held["model"]["vocab"].items() if i not in special}
        self.size = 1 + max(ranks.values())
        self.bytes_of = [b""] * self.size
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self._encoding = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._path, self._whole = path, None

    def encode(self, text: str) -> list[int]:
        try:
            return self._encoding.encode_ordinary(text)
        except BaseException as failed:  # the pattern's engine gives up on some texts of one endless run
            if isinstance(failed, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return self._by_library(text)

    def _by_library(self, text: str) -> list[int]:
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self._path)
            self._whole.encode_special_tokens = True
        return self._whole.encode(text, add_special_tokens=False).ids


class Pieces:
    """A sentencepiece model; it puts a space before a text by itself."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.bytes_of = [self._bytes(i) for i in range(self.size)]
        names = [self.model.id_to_piece(i) for i in range(self.size)]
        self.by_words = not any(_SPACE in n.lstrip(_SPACE) for n in names) and self.model.encode("a  b", out_type=str) == self.model.encode("a", out_type=str) + self.model.encode(" b", out_type=str)

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.model.is_byte(i) else piece.replace(_SPACE, " ").encode()

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


# -- bitsets --------------------------------------------------------------------------
def end_bits(ends: np.ndarray, n_bytes: int) -> np.ndarray:
    """64-bit words with a bit at each end, 1 to n_bytes."""
    marks = np.zeros((n_bytes // 64 + 1) * 64, bool)
    marks[ends] = True
    return np.packbits(marks, bitorder="little").view("<u8")


def select(words: np.ndarray) -> np.ndarray:
    """Places of the set bits."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def rank(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many bits are set up to each place, itself included: whole words by prefix sums of popcounts, the last by a mask."""
    counts = np.bitwise_count(words).astype(np.int64)
    before = np.cumsum(counts) - counts
    at, bit = places >> 6, (places & 63).astype(np.uint64)
    low = words[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit))
    return before[at] + np.bitwise_count(low)


def token_groups(ends_a: np.ndarray, ends_b: np.ndarray, n_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tokens of either side up to each shared cut, from 0 on."""
    a, b = end_bits(ends_a, n_bytes), end_bits(ends_b, n_bytes)
    cuts = select(a & b)
    zero = np.zeros(1, np.int64)
    return np.concatenate([zero, rank(a, cuts)]), np.concatenate([zero, rank(b, cuts)])


# -- links ----------------------------------------------------------------------------
def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def linked_pairs(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked id pairs (first id in the upper 32 bits), in order, and how many links each has."""
    n_a, n_b = np.diff(cut_a), np.diff(cut_b)
    wide = n_a * n_b > WIDE
    keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for g in np.flatnonzero(wide):
        one, k = np.unique(a[cut_a[g] : cut_a[g + 1]], return_counts=True)
        two, m = np.unique(b[cut_b[g] : cut_b[g + 1]], return_counts=True)
        step = max(1, BLOCK // len(two))
        for i in range(0, len(one), step):
            keys.append(((one[i : i + step, None] << 32) | two[None, :]).ravel())
            times.append((k[i : i + step, None] * m[None, :]).ravel())
    each = np.repeat(np.where(wide, 0, n_b), n_a)  # links of each token of the first side
    start = np.repeat(cut_b[:-1], n_a)
    upto = np.cumsum(each)
    lo = 0
    while lo < len(each):
        done = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + BLOCK, "right")))
        count = each[lo:hi]
        at = np.arange(upto[hi - 1] - done) + np.repeat(start[lo:hi] - (upto[lo:hi] - count - done), count)
        key, n = np.unique((np.repeat(a[lo:hi], count) << 32) | b[at], return_counts=True)
        keys.append(key)
        times.append(n)
        lo = hi
    if len(keys) == 2:  # one block, in order
        return keys[1], times[1]
    return _summed(keys, times) if sum(map(len, keys)) else (keys[0], times[0])


class Numbers(dict):
    """A number for each key, in the order of their coming."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Tokens:
    """Ids of chunks in a row, where each chunk's begin, and whether they give its bytes back."""

    def __init__(self) -> None:
        self.ids, self.starts, self.same = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool)

    def add(self, ids: np.ndarray, sizes: np.ndarray, same: np.ndarray) -> None:
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.same = np.concatenate([self.same, same])

    def take(self, at: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the chunks at these places in a row; how many up to each bound; whether all chunks between bounds give their bytes back."""
        sizes = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(sizes)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.starts[at] - (ends - sizes), sizes)].astype(np.int64)
        return ids, ends[upto - 1], np.logical_and.reduceat(self.same[at], np.concatenate([[0], upto[:-1]]))


class Aligner:
    """Aligns texts; one in a worker."""

    def __init__(self, json_path: str, pattern: str, model_path: str):
        self.a, self.b = ByteLevel(json_path, pattern), Pieces(model_path)
        self.lengths = [np.array([len(x) for x in v.bytes_of], np.int64) for v in (self.a, self.b)]
        name = lambda v, end: [f"{i}{end}" for i in range(v.size)]
        self._memo, self._tables = Numbers(), (Tokens(), Tokens())
        self._names = name(self.a, ",") + name(self.a, "|") + name(self.b, ",") + name(self.b, ";")

    def _learn(self, chunks: list[str]) -> None:
        """Adds the tokens of new chunks to the tables: for each side ids, where they begin, and whether they give the chunk's bytes back."""
        for side, vocabulary, found in zip(self._tables, (self.a, self.b), (map(self.a.encode, [" " + c for c in chunks]), self.b.encode_all(chunks))):
            ids, sizes, same = array("i"), [], []
            for chunk, tokens in zip(chunks, found):
                ids.extend(tokens)
                sizes.append(len(tokens))
                same.append(b"".join(map(vocabulary.bytes_of.__getitem__, tokens)) == b" " + chunk.encode())
            side.add(np.frombuffer(ids, np.int32), np.array(sizes, np.int64), np.array(same, bool))

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Of both sides the tokens of all texts (of a space and the text) in a row and up to which one each text goes; and whether each text's
        tokens give it back.  Texts go chunk by chunk, and chunks are remembered until they are MEMO_ENTRIES."""
        if len(self._memo) > MEMO_ENTRIES:
            self._memo, self._tables = Numbers(), (Tokens(), Tokens())
        places, upto, first = array("i"), [], len(self._memo)
        for text in texts:
            chunks = [text] if not self.b.by_words else _CUT.split(text) if _RUN.search(text) else text.split(" ")
            places.extend(map(self._memo.__getitem__, chunks))
            upto.append(len(places))
        self._learn(list(islice(self._memo, first, None)))
        at, upto = np.frombuffer(places, np.int32), np.array(upto, np.int64)
        (a, to_a, same_a), (b, to_b, same_b) = (t.take(at, upto) for t in self._tables)
        return a, to_a, b, to_b, same_a & same_b

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None]:
        """Ids of both sides and the tokens up to each shared cut, for each text; None where the tokens do not give the text back."""
        if not texts:
            return []
        a, to_a, b, to_b, same = self.encode_all(texts)
        size_a, size_b = self.lengths[0][a], self.lengths[1][b]
        if not (size_a.all() and size_b.all()):
            raise ValueError("a token without bytes")
        out, ends_a, ends_b = [], np.cumsum(size_a), np.cumsum(size_b)
        if same.all():  # one bitset for all texts: their ends are shared cuts
            cut_a, cut_b = token_groups(ends_a, ends_b, int(ends_a[-1]))
            bounds = np.searchsorted(cut_a, np.concatenate([[0], to_a]))
            for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
                i, j = cut_a[lo], cut_b[lo]
                out.append((a[i : to_a[k]], b[j : to_b[k]], cut_a[lo : hi + 1] - i, cut_b[lo : hi + 1] - j))
            return out
        i = j = 0
        for k in range(len(texts)):
            base_a, base_b = (ends[at - 1] if at else 0 for ends, at in ((ends_a, i), (ends_b, j)))
            one, two = ends_a[i : to_a[k]] - base_a, ends_b[j : to_b[k]] - base_b
            out.append((a[i : to_a[k]], b[j : to_b[k]], *token_groups(one, two, int(one[-1]))) if same[k] else None)
            i, j = to_a[k], to_b[k]
        return out

    def written_out(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> str:
        """a1,a2|b1;a3|b2,b3: ids of each group."""
        n_a, n_b = np.diff(cut_a), np.diff(cut_b)
        code_a, code_b = a.copy(), b + 2 * self.a.size
        code_a[cut_a[1:] - 1] += self.a.size  # the last of a group
        code_b[cut_b[1:] - 1] += self.b.size
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.repeat(cut_b[:-1], n_a)] = code_a
        out[np.arange(len(b)) + np.repeat(cut_a[1:], n_b)] = code_b
        return "".join(map(self._names.__getitem__, out.tolist()))[:-1]


_ALIGNERS: dict[tuple[str, str, str], Aligner] = {}


def aligner(json_path: str, pattern: str, model_path: str) -> Aligner:
    """One for each Python worker; workers outlive tasks."""
    key = (json_path, pattern, model_path)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


def _parts(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Texts in order, some at a time, with the place of the first."""
    lo, part, chars = 0, [], 0
    for text in column:
        part.append(text.as_py())
        chars += len(part[-1] or "")
        if len(part) == BATCH or chars >= CHARS:
            yield lo, part
            lo, part, chars = lo + len(part), [], 0
    if part:
        yield lo, part


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def align(docs: DataFrame, json_path: str, pattern: str, model_path: str, text_col: str = "text", keep_groups: bool = True) -> DataFrame:
    """A row for each document: its columns but the text, in a struct row; n_a, n_b, n_groups, n_links; groups (written out; null unless
    kept), groups_sha256 ('' without tokens); and its distinct linked pairs: arrays pair_a, pair_b, times."""
    kept = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(None).alias("none")]).alias("row"), F.col(text_col).alias("text"))
    schema = "n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, pair_a array<int>, pair_b array<int>, times array<int>"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(json_path, pattern, model_path)
        nothing = np.zeros(0, np.int64)
        for batch in batches:
            for lo, texts in _parts(batch.column(1)):
                found = iter(work.tokens([t for t in texts if t]))
                numbers, groups, digests, keys, times = [], [], [], [], []
                for text in texts:
                    aligned = next(found) if text else None
                    key, n = linked_pairs(*aligned) if aligned else (nothing, nothing)
                    line = work.written_out(*aligned) if aligned else ""
                    numbers.append((len(aligned[0]), len(aligned[1]), len(aligned[2]) - 1, int(n.sum())) if aligned else (0, 0, 0, 0))
                    groups.append(line if keep_groups else None)
                    digests.append(hashlib.sha256(line.encode()).hexdigest() if aligned else "")
                    keys.append(key)
                    times.append(n)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32))
                key, n = np.concatenate(keys), np.concatenate(times)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (key >> 32, key & 0xFFFFFFFF, n)]
                columns = [pa.array(x, pa.int64()) for x in zip(*numbers)]
                row = batch.column(0).slice(lo, len(texts))
                yield pa.RecordBatch.from_arrays([row, *columns, pa.array(groups, pa.string()), pa.array(digests, pa.string()), *lists], names)

    names = ["row", *_NUMBERS, "groups", "groups_sha256", "pair_a", "pair_b", "times"]
    return rows.mapInArrow(solve, f"row {rows.schema['row'].dataType.simpleString()}, {schema}")


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    a, b = (batch.column(batch.schema.get_field_index(c)).flatten().to_numpy().astype(np.int64) for c in ("pair_a", "pair_b"))
    return (a << 32) | b


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n, best: in how many rows of an aligned table each pair is linked, and whether no pair of its first id is in more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(batch)
            for lo in range(0, len(keys), BLOCK):
                pair, n = np.unique(keys[lo : lo + BLOCK], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], ["pair", "n"])

    counts = written(aligned.select("pair_a", "pair_b").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    first = F.shiftright("pair", 32)
    top = counts.groupBy(first.alias("first")).agg(F.max("n").alias("top"))
    out = written(counts.join(top, first == F.col("first")).select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "pair-counts")
    discard(counts)
    return out


def link_sums(aligned: DataFrame, counts: DataFrame, key: str, hot_pairs: int = HOT) -> DataFrame:
    """key, n_best, count_sum of every row of an aligned table (with that key, at rest).

    A pair is hot if it is in at least 1 / hot_pairs of all rows of pairs, so there are at most hot_pairs of them: these go to
    the tasks as sorted arrays.  Every other pair has fewer rows than that, and is joined."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = 1 if counts.count() <= hot_pairs else -(-total // hot_pairs)
    hot = counts.where(F.col("n") >= least).toArrow()  # bounded as said
    order = np.argsort(hot.column("pair").to_numpy())
    table = aligned.sparkSession.sparkContext.broadcast(tuple(hot.column(c).to_numpy(zero_copy_only=False)[order] for c in ("pair", "n", "best")))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = table.value
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                keys, times = _keys(part), part.column(3).flatten().to_numpy().astype(np.int64)
                size = part.column(3).value_lengths().to_numpy()
                at = np.minimum(np.searchsorted(pairs, keys), max(len(pairs) - 1, 0))
                found = pairs[at] == keys if len(pairs) else np.zeros(len(keys), bool)
                at = np.where(found, at, 0)
                sums = []
                for x in ((times * best[at] * found, times * n[at] * found) if len(pairs) else (np.zeros(len(keys), np.int64),) * 2):
                    upto = np.concatenate([[0], np.cumsum(x)])
                    sums.append(pa.array(np.diff(upto[np.concatenate([[0], np.cumsum(size)])])))
                row = np.repeat(np.arange(len(size)), size)[~found]
                left = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(size)))]).astype(np.int32))
                cold = pa.StructArray.from_arrays([pa.array(keys[~found]), pa.array(times[~found])], ["pair", "times"])
                yield pa.RecordBatch.from_arrays([part.column(0), *sums, pa.ListArray.from_arrays(left, cold)], [key, "n_best", "count_sum", "cold"])

    kind = aligned.schema[key].dataType.simpleString()
    sums = aligned.select(key, "pair_a", "pair_b", "times").mapInArrow(look_up, f"{key} {kind}, n_best long, count_sum long, cold array<struct<pair:long,times:long>>")
    if least == 1:
        return sums.drop("cold")
    sums = written(sums, "link-sums")
    rest = sums.select(key, F.explode("cold").alias("x")).select(key, "x.*").join(counts.where(F.col("n") < least), "pair")
    more = rest.select(key, F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    return sums.drop("cold").unionByName(more).groupBy(key).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def corpus_alignment(docs: DataFrame, json_path: str, pattern: str, model_path: str, text_col: str = "text", hot_pairs: int = HOT) -> DataFrame:
    """A row for each document: its columns but the text, n_a, n_b, n_groups, n_links, n_best (links whose pair no pair of its first id
    exceeds), count_sum (documents with the pair, over all links), groups_sha256."""
    aligned = align(docs, json_path, pattern, model_path, text_col, keep_groups=False).drop("groups")
    aligned = written(aligned.withColumn("number", F.monotonically_increasing_id()), "aligned")  # numbers stay as written
    sums = link_sums(aligned, pair_counts(aligned), "number", hot_pairs)
    out = aligned.select("number", "row", *_NUMBERS, "groups_sha256").join(sums, "number")
    return out.select("row.*", *_NUMBERS, "n_best", "count_sum", "groups_sha256")
