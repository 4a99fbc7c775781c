"""Language-model scores from a log-bilinear neural model, trained by noise-contrastive estimation.

The vector predicted for a token is C1 r(w1) + C2 r(w2) of the two tokens before it.  Every
word has vectors: a frequent one its own, any other those of the words that begin with the same
three bytes (so that contexts tell what language or field they are of).  These units, the end of
a text among them (which also stands before its start), grow with the vocabulary: one for every
``words_a_unit`` distinct words up to ``many`` units, at least ``fewest``, and beyond that one more for every
``more_words_a_unit``; half of them words and half beginnings; rarer beginnings fall by hash into
``_REST`` units.

Units stand in clusters, about the square root of their number, in the order of their bytes.
A token's probability is that of its cluster given the predicted vector, times that of its
unit among its cluster's, times its smoothed share among its unit's training tokens; each
factor is normalised, over all words and one unseen one of each unit, by products of matrices.

Spark counts every word of the training texts and turns texts into numbers of units once.
Training deals training texts by their ids to one trainer for each ``tokens_a_trainer`` tokens,
so the model depends on the data and not on the cluster.  A trainer goes
over its tokens in mini-batches (AdaGrad in numpy; a cluster's noise is shared by a batch, a
unit's drawn for each token by Walker's aliases); the vectors of all are averaged, _FAN trainers at a time, each unit's by
how often a trainer met it, in ``rounds`` rounds, each over its part of the texts and from the last
one's mean, so that every training token is gone over once.

The ``head`` most frequent words go to the tasks with their counts (a fixed number of
entries); the other words of each text meet their counts in a shuffle join.

Rows: null text counts as empty and scores its end alone; a null id counts as the
empty text for the split; very long texts are scored whole; repeated rows give repeated
results; other columns, whatever their names, are not looked at; without training
tokens every word is unknown; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, training_row, written

FOLDS = 10
END = 0
SMOOTH = 0.1
PREFIX = 3
_REST = 64
#: Words that a task counts before it passes them on; bytes of texts whose words it holds at a time; texts that a trainer or the
#: model takes at a time; tokens whose contexts are worked out together; tokens scored at once.
_FLUSH, _BYTES, _SLICE, _BLOCK, _CHUNK = 2_000_000, 2_000_000, 256, 65_536, 1024
#: Logits of two contexts that together stay below this have exponentials whose products keep all their digits in 32 bits.
_SAFE = 60.0
#: Buckets of counts for each doubling when a bound for the most frequent words is looked for.
_STEPS = 64
#: Trainers whose vectors are averaged in one group.
_FAN = 16
_LN10 = float(np.log(10))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts as words_of has them, one after the other, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, offsets = lists.flatten().cast(pa.binary()), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    real = pc.greater(pc.binary_length(words), 0)  # at a text's ends space leaves empty ones
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return words.filter(real), np.diff(upto[offsets])


def _by_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, cut where texts together pass _BYTES; a longer text is alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        upto, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _BYTES, side="right")))
            yield batch.slice(at, end - at)
            at = end


# -- units ----------------------------------------------------------------------
@dataclass
class Units:
    """Words and beginnings with vectors of their own; shares of training tokens; clusters of neighbours in byte order."""

    words: dict[bytes, int]
    prefixes: dict[bytes, int]
    share: np.ndarray
    cluster: np.ndarray  # of each unit
    members: list[np.ndarray]  # units of each cluster
    weight: np.ndarray  # log10 of the training tokens of a beginning's words, smoothed; 0 for words
    place: np.ndarray  # of each unit among its cluster's
    accept: np.ndarray  # for each unit in the order of clusters: the share of its slot that is its own
    other: np.ndarray  # and the unit that has the rest of it

    @classmethod
    def of(cls, words: list[tuple[bytes, int]], prefixes: list[tuple[bytes, int, int]], rest: list[tuple[int, int]], ends: int) -> Units:
        """words: (word, count); prefixes: (beginning, count, distinct words); rest: (count, distinct words) of each rest unit."""
        names = [b"", *(w for w, _ in words), *(p for p, _, _ in prefixes), *([b"\xff"] * len(rest))]
        tokens = np.array([ends, *(c for _, c in words), *(c for _, c, _ in prefixes), *(c for c, _ in rest)], np.float64)
        first = 1 + len(words)
        kinds = np.array([*(v for _, _, v in prefixes), *(v for _, v in rest)], np.float64)
        weight = np.zeros(len(names))
        weight[first:] = np.log10(tokens[first:] + SMOOTH * (kinds + 1))
        order = sorted(range(len(names)), key=lambda k: (names[k], k))
        cluster = np.zeros(len(names), np.int64)
        parts = np.array_split(np.array(order), max(1, int(np.sqrt(len(names)))))
        for k, part in enumerate(parts):
            cluster[part] = k
        share = (tokens + SMOOTH) / (tokens + SMOOTH).sum()
        members, place = [np.sort(p) for p in parts], np.zeros(len(names), np.int64)
        for own in members:
            place[own] = np.arange(len(own))
        accept, other = zip(*(slots(share[own]) for own in members))
        other = np.concatenate([own[x] for own, x in zip(members, other)])
        return cls({w: k + 1 for k, (w, _) in enumerate(words)}, {p: first + k for k, (p, _, _) in enumerate(prefixes)}, share, cluster, members, weight, place, np.concatenate(accept), other)

    def of_word(self, word: bytes) -> int:
        got = self.words.get(word)
        if got is None:
            got = self.prefixes.get(word[:PREFIX])
        return len(self.share) - _REST + rest_unit(word) if got is None else got


def slots(share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal slots for draws by share (Walker's aliases): what part of its slot each place keeps, and which place has the rest."""
    left = (share / share.sum() * len(share)).tolist()
    accept, other = np.ones(len(left)), np.arange(len(left))
    small, large = [k for k, x in enumerate(left) if x < 1], [k for k, x in enumerate(left) if x >= 1]
    while small and large:
        k, much = small.pop(), large[-1]
        accept[k], other[k] = left[k], much
        left[much] -= 1 - left[k]
        if left[much] < 1:
            small.append(large.pop())
    return accept, other


def rest_unit(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word[:PREFIX]) % _REST


# -- model ----------------------------------------------------------------------
@dataclass
class Parameters:
    """Vectors r of units as contexts and q as predicted ones with biases b; the position matrices; clusters' vectors and biases."""

    r: np.ndarray
    q: np.ndarray
    b: np.ndarray
    c1: np.ndarray
    c2: np.ndarray
    qc: np.ndarray
    bc: np.ndarray

    @classmethod
    def start(cls, units: Units, dims: int, seed: int) -> Parameters:
        rng, k, n = np.random.default_rng(seed), len(units.share), len(units.members)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        whole = np.bincount(units.cluster, units.share, n)
        eye = np.eye(dims, dtype=np.float32)
        return cls(small(k, dims), small(k, dims), np.log(units.share / whole[units.cluster]).astype(np.float32), eye.copy(), 0.5 * eye, small(n, dims), np.log(whole).astype(np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    def filled(self, flat: np.ndarray) -> Parameters:
        out, at = [], 0
        for x in self.arrays():
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Parameters(*out)


def _short(ids: np.ndarray, n: int) -> np.ndarray:
    """ids below n in the form that sorts fastest."""
    return ids.astype(np.uint16) if n <= 1 << 16 else ids


def packed(ids: np.ndarray) -> np.ndarray:
    """ids as 32-bit numbers; one that does not fit is an error."""
    if len(ids) and not 0 <= ids.min() <= ids.max() < 1 << 32:
        raise ValueError("a unit's number beyond 32 bits")
    return ids.astype(np.uint32)


def distinct(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of ids below n, and the place of each id among them; without a sort."""
    seen, place = np.zeros(n, bool), np.empty(n, np.int64)
    seen[ids] = True
    own = np.flatnonzero(seen)
    place[own] = np.arange(len(own))
    return own, place.take(ids)


def _sigmoid(x: np.ndarray) -> None:
    """In place; exp may overflow to infinity, which gives 0."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


class Trainer:
    """Noise-contrastive estimation of clusters and of units within them, by mini-batches of tokens with their two contexts.

    Vectors and biases stand in one table: rows of predicted units, of contexts (whose biases stay 0) and of clusters.  A batch
    takes each row that it meets once, works on these and puts them back."""

    def __init__(self, start: Parameters, units: Units, noise: int, rate: float, seed: int):
        self.units, self.noise, self.rate, self.dims = units, noise, rate, start.r.shape[1]
        self.n_units, self.n_clusters = len(units.share), len(units.members)
        none = np.zeros(self.n_units, np.float32)
        self.vectors, self.biases, self.mix = np.concatenate([start.q, start.r, start.qc]), np.concatenate([start.b, none, start.bc]), np.concatenate([start.c1, start.c2])
        self.vector_sums, self.bias_sums, self.mix_sums = (np.full(x.shape, 1e-3, np.float32) for x in (self.vectors, self.biases, self.mix))
        whole = np.bincount(units.cluster, units.share, self.n_clusters)
        self.upto = np.cumsum(whole)
        self.few = max(1, noise // 16)
        self.logs = np.concatenate([np.log(self.few * units.share / whole[units.cluster]), none, np.log(noise * whole)]).astype(np.float32)  # of the noise expected of a row
        self.sizes = np.array([len(m) for m in units.members])
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.listed = np.concatenate(units.members)
        self.met = np.zeros(self.n_units)  # tokens of each unit
        self.rng = np.random.default_rng(seed)
        # gradients are added up in pairs of numbers, which takes half the additions
        self.pair = np.complex64 if self.dims % 2 == 0 else np.float32
        self.across = np.arange(self.dims * 4 // np.dtype(self.pair).itemsize)

    @property
    def p(self) -> Parameters:
        k = self.n_units
        return Parameters(self.vectors[k : 2 * k], self.vectors[:k], self.biases[:k], self.mix[: self.dims], self.mix[self.dims :], self.vectors[2 * k :], self.biases[2 * k :])

    def _move(self, x: np.ndarray, sums: np.ndarray, g: np.ndarray) -> None:
        """An AdaGrad step, in place."""
        by = g * g
        sums += by
        np.sqrt(sums, out=by)
        np.divide(g, by, out=by)
        by *= self.rate
        x -= by

    def _summed(self, at: np.ndarray, grads: np.ndarray, n: int) -> np.ndarray:
        """The sums of the rows of grads that go to each of n places."""
        out = np.zeros((n, self.dims), np.float32)
        spots = (at * len(self.across))[:, None] + self.across
        np.add.at(out.view(self.pair).reshape(-1), spots.reshape(-1), grads.view(self.pair).reshape(-1))
        return out

    def _noise(self, c: np.ndarray) -> np.ndarray:
        """Units by their shares in each token's cluster."""
        spread = self.rng.random((self.few, len(c)))
        spread *= self.sizes.take(c)
        slot = spread.astype(np.int64)
        spread -= slot
        slot += self.firsts.take(c)
        return np.where(spread < self.units.accept.take(slot), self.listed.take(slot), self.units.other.take(slot))

    def step(self, w: np.ndarray, before: np.ndarray, drawn: np.ndarray) -> None:
        """A batch: tokens, the two contexts of each, and clusters drawn as noise, which it shares."""
        n, k = len(w), self.n_units
        c = self.units.cluster.take(w)
        # each token's unit, noise units from its cluster, its cluster; noise clusters; contexts
        ids = np.concatenate([w, self._noise(c).reshape(-1), c + 2 * k, drawn + 2 * k, before.reshape(-1) + k])
        own, at = distinct(ids, len(self.vectors))
        vectors, vector_sums, biases, bias_sums = (x.take(own, axis=0) for x in (self.vectors, self.vector_sums, self.biases, self.bias_sums))
        rows, offsets = vectors.take(at, axis=0), biases - self.logs.take(own)
        i, j = len(ids) - 2 * n - self.noise, len(ids) - 2 * n
        mine, others, r = rows[:i].reshape(-1, n, self.dims), rows[i:j], rows[j:].reshape(n, -1)
        h = r @ self.mix
        off = np.einsum("knd,nd->kn", mine, h)
        off += offsets.take(at[:i]).reshape(-1, n)
        _sigmoid(off)
        off[0] -= 1
        off[-1] -= 1
        off /= n
        false = h @ others.T
        false += offsets.take(at[i:j])
        _sigmoid(false)
        false /= n
        dh = false @ others
        dh += np.einsum("kn,knd->nd", off, mine)
        grads = np.empty_like(rows)
        np.multiply(off[:, :, None], h, out=grads[:i].reshape(-1, n, self.dims))
        np.matmul(false.T, h, out=grads[i:j])
        np.matmul(dh, self.mix.T, out=grads[j:].reshape(n, -1))
        self._move(self.mix, self.mix_sums, r.T @ dh)
        self._move(vectors, vector_sums, self._summed(at, grads, len(own)))
        self._move(biases, bias_sums, np.bincount(at[:j], np.concatenate([off.reshape(-1), false.sum(axis=0)]), len(own)).astype(np.float32))
        self.biases[own], self.bias_sums[own] = biases, bias_sums
        whole = np.dtype((np.void, vectors.strides[0]))  # rows go back as one value each
        for table, new in ((self.vectors, vectors), (self.vector_sums, vector_sums)):
            table.view(whole)[own] = new.view(whole)

    def texts(self, ids: np.ndarray, batch: int) -> None:
        """Goes over texts that follow each other, in mini-batches of their tokens in random order."""
        before = np.stack(contexts(ids), axis=1)
        order = self.rng.permutation(len(ids))
        noise = self.rng.random((-(-len(ids) // batch), self.noise)) * self.upto[-1]
        drawn = np.minimum(np.searchsorted(self.upto, noise), self.n_clusters - 1)
        with np.errstate(over="ignore"):
            for k, own in enumerate(drawn):
                part = order[k * batch : (k + 1) * batch]
                self.step(ids.take(part), before.take(part, axis=0), own)
        self.met += np.bincount(ids, minlength=len(self.met))


def contexts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units one and two places before each token of texts that follow each other, each with its end."""
    one = np.concatenate([[END], ids[:-1]])
    two = np.concatenate([[END], one[:-1]])
    return one, np.where(one == END, END, two)


def _log_chances(h: np.ndarray, vectors: np.ndarray, own: np.ndarray) -> np.ndarray:
    """log of the share of each row's own column among all, of exp(h vectors); the largest is taken off only where exp would overflow."""
    logits = h @ vectors
    got = logits[np.arange(len(logits)), own]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], np.float32)
    if not np.isfinite(total).all() or not total.all():
        logits = h @ vectors
        top = logits.max(axis=1)
        return got - top - np.log(np.exp(logits - top[:, None]).sum(axis=1))
    return got - np.log(total)


def _log_clusters(p: Parameters, a: np.ndarray, b: np.ndarray, c: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
    """log-probabilities of clusters.  As the predicted vector is a sum, exp of its products is the product of what each context gives,
    which is worked out once for all tokens that it stands before."""
    (one, at1), (two, at2) = distinct(w1, len(a)), distinct(w2, len(b))
    first, second = a.take(one, axis=0) @ p.qc.T + p.bc, b.take(two, axis=0) @ p.qc.T
    out = np.empty(len(c), np.float64)
    if np.abs(first).max() + np.abs(second).max() > _SAFE:
        for lo in range(0, len(c), _CHUNK):
            part = slice(lo, lo + _CHUNK)
            h = np.hstack([a.take(w1[part], axis=0) + b.take(w2[part], axis=0), np.ones((len(c[part]), 1), np.float32)])
            out[part] = _log_chances(h, np.vstack([p.qc.T, p.bc]), c[part])
        return out
    got = first[at1, c] + second[at2, c]
    np.exp(first, out=first)
    np.exp(second, out=second)
    for lo in range(0, len(c), _CHUNK):
        part = slice(lo, lo + _CHUNK)
        out[part] = np.einsum("nk,nk->n", first.take(at1[part], axis=0), second.take(at2[part], axis=0))
    return got - np.log(out)


def log_p(p: Parameters, units: Units, w: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
    """Natural log-probabilities of units given the two before: of the cluster, and of the unit in it."""
    if not len(w):
        return np.empty(0)
    c, a, b = units.cluster.take(w), p.r @ p.c1, p.r @ p.c2
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.concatenate([_log_clusters(p, a, b, c[part], w1[part], w2[part]) for lo in range(0, len(w), _BLOCK) for part in [slice(lo, lo + _BLOCK)]])
        order = np.argsort(_short(c, len(units.members)), kind="stable")
        h = np.ones((len(w), a.shape[1] + 1), np.float32)  # the last column meets the biases
        np.add(a.take(w1.take(order), axis=0), b.take(w2.take(order), axis=0), out=h[:, :-1])
        ranked, own = c.take(order), units.place.take(w.take(order))
        edges = np.flatnonzero(np.concatenate([[True], np.diff(ranked) != 0, [True]])).tolist()
        for i, j in zip(edges[:-1], edges[1:]):
            members = units.members[ranked[i]]
            vectors = np.vstack([p.q[members].T, p.b[members]])
            for lo in range(i, j, _CHUNK):
                part = slice(lo, min(j, lo + _CHUNK))
                out[order[part]] += _log_chances(h[part], vectors, own[part])
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            yield batch.slice(at, _SLICE)


# -- counting -------------------------------------------------------------------
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Array] = []

    def send() -> pa.RecordBatch:
        counts = pa.chunked_array(held, pa.binary()).value_counts()
        held.clear()
        return pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["word", "c"])

    for rows in _by_bytes(batches):
        held.append(split_words(rows.column("text"))[0])
        if sum(map(len, held)) > _FLUSH:
            yield send()
    if held:
        yield send()


def word_counts(texts: DataFrame) -> DataFrame:
    """word, c over all texts; each task adds up its own before the shuffle."""
    return written(texts.select("text").mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


def cut_off(counts: DataFrame, most: int) -> int:
    """The least count above which there are at most so many rows (c), whatever the counts: by histograms, so that no task sends its own
    top, first over _STEPS buckets for each doubling, then over the counts within the bucket that the bound falls into."""
    bucket = F.floor(F.log2("c") * _STEPS)
    rows = counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()  # at most 63 * _STEPS rows
    left = most
    for r in sorted(rows, key=lambda r: -r.b):
        if r.n > left:  # as many counts as its width or its rows, of which a corpus of N words has N / c
            for x in sorted(counts.where(bucket == r.b).groupBy("c").agg(F.count("*").alias("n")).collect(), key=lambda x: -x.c):
                if x.n > left:
                    return x.c
                left -= x.n
        left -= r.n
    return 0


def made_units(counts: DataFrame, ends: int, size: int) -> Units:
    """About ``size`` units: the most frequent words, and the most frequent beginnings of all others."""
    cut = cut_off(counts, size // 2)
    words = sorted((bytes(r.word), r.c) for r in counts.where(F.col("c") > cut).collect())
    tail = counts.where(F.col("c") <= cut).groupBy(F.substring("word", 1, PREFIX).alias("prefix")).agg(F.sum("c").alias("c"), F.count("*").alias("v"))
    tail = written(tail, "beginnings")
    edge = cut_off(tail, size // 2)
    prefixes = sorted((bytes(r.prefix), r.c, r.v) for r in tail.where(F.col("c") > edge).collect())

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"unit": [rest_unit(bytes(x)) for x in rows.prefix], "c": rows.c, "v": rows.v})

    others = tail.where(F.col("c") <= edge).mapInPandas(named, "unit int, c long, v long").groupBy("unit").agg(F.sum("c").alias("c"), F.sum("v").alias("v"))
    rest = {r.unit: (r.c, r.v) for r in others.collect()}  # at most _REST rows
    discard(tail)
    return Units.of(words, prefixes, [rest.get(k, (0, 0)) for k in range(_REST)], ends)


# -- training -------------------------------------------------------------------
def train(texts: DataFrame, units: Units, dims: int, noise: int, rate: float, batch: int, rounds: int, trainers: int, seed: int) -> Parameters:
    """Parameters after the rounds over texts (trainer, part, ids); a round sees the texts of its part."""
    spark, start = texts.sparkSession, Parameters.start(units, dims, seed)
    held_units = spark.sparkContext.broadcast(units)
    dealt = texts.select("trainer", "part", F.xxhash64("ids").alias("order"), "ids")

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        """Each unit's vectors weighted by how often a trainer met it, all else by tokens."""
        rows = rows.sort_values("p", ignore_index=True)  # sums in one order, so reruns agree
        ps = [start.filled(np.frombuffer(p, np.float32)).arrays() for p in rows.p]
        met = [np.frombuffer(m, np.float64) for m in rows.met]
        tokens = rows.tokens.to_numpy(np.float64)
        out = []
        for k in range(len(ps[0])):
            if k < 3:
                weights = [m + 1e-6 for m in met]
                weights = [w[:, None] if ps[0][k].ndim == 2 else w for w in weights]
            else:
                weights = list(tokens)
            out.append(sum(p[k] * w for p, w in zip(ps, weights)) / sum(weights))
        flat = np.concatenate([x.ravel() for x in out]).astype(np.float32)
        return pd.DataFrame({"g": rows.g[:1].to_numpy(), "tokens": [int(tokens.sum())], "p": [flat.tobytes()], "met": [sum(met).tobytes()]})

    for k in range(rounds):
        sent = spark.sparkContext.broadcast(start)

        def learn(batches: Iterator[pa.RecordBatch], sent=sent, k: int = k) -> Iterator[pa.RecordBatch]:
            held: dict[int, Trainer] = {}
            tokens: dict[int, int] = {}
            for rows in _slices(batches):
                for t in sorted(set(rows.column("trainer").to_pylist())):
                    if t not in held:
                        held[t], tokens[t] = Trainer(sent.value, held_units.value, noise, rate, seed + 1 + k + 1000 * t), 0
                    mine = [x.as_py() for x, y in zip(rows.column("ids"), rows.column("trainer").to_pylist()) if y == t]
                    ids = np.frombuffer(b"".join(mine), np.uint32).astype(np.int64)
                    held[t].texts(ids, batch)
                    tokens[t] += len(ids)
            for t, trainer in sorted(held.items()):
                yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([tokens[t]]), pa.array([trainer.p.flat().tobytes()], pa.binary()), pa.array([trainer.met.tobytes()], pa.binary())], ["g", "tokens", "p", "met"])

        placed = dealt.where(F.col("part") == k).repartition(trainers, "trainer").sortWithinPartitions("trainer", "order")
        learned = written(placed.mapInArrow(learn, "g long, tokens long, p binary, met binary"), "learned")
        left = trainers
        while left > 1:
            left = -(-left // _FAN)
            up = written(learned.withColumn("g", F.expr(f"g div {_FAN}")).groupBy("g").applyInPandas(mean, "g long, tokens long, p binary, met binary"), "learned")
            discard(learned)
            learned = up
        found = learned.first()  # the only row
        discard(learned)
        if found:
            start = start.filled(np.frombuffer(found.p, np.float32))
    return start


# -- scoring --------------------------------------------------------------------
def score(docs: DataFrame, words_a_unit: int = 16, fewest: int = 1024, many: int = 16_384, more_words_a_unit: int = 1024, head: int = 200_000, dims: int = 16, noise: int = 32, rate: float = 0.2, batch: int = 1024, rounds: int = 2, tokens_a_trainer: int = 2_000_000, seed: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), training_row(F.col(id_col), FOLDS).alias("trains"))
    training = rows.where("trains").select("text")
    counts = word_counts(training)
    ends = training.count()
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = whole.n + ends, whole.v + (ends > 0)
    units = made_units(counts, ends, max(fewest, min(many, whole.v // words_a_unit) + max(0, whole.v - many * words_a_unit) // more_words_a_unit))
    least = cut_off(counts, head)
    base_of = -np.log10(n + SMOOTH * (v + 1))
    end_base = float(np.log10(ends + SMOOTH) + base_of)
    known = sorted((bytes(r.word), r.c) for r in counts.where(F.col("c") > least).collect())
    sent = spark.sparkContext.broadcast((units, [w for w, _ in known], np.array([units.of_word(w) for w, _ in known], np.int64), np.log10(np.array([c for _, c in known], np.float64) + SMOOTH)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units of each text; sums over the words that the head knows; the list of the others."""
        units, head, unit_of, log_of = sent.value
        unit_of, log_of = np.append(unit_of, END), np.append(log_of, 0.0)  # the last one stands for an end, and first for words that the head lacks
        inside_of = np.where(units.weight[unit_of] != 0, log_of, 0.0) - units.weight[unit_of]
        end, options = len(head), pc.SetLookupOptions(value_set=pa.array(head, pa.binary()))
        for rows in _by_bytes(batches):
            words, sizes = split_words(rows.column("text"))
            lengths = sizes + 1
            starts = np.cumsum(lengths) - lengths
            found = pc.index_in(words, options=options)
            inner = np.ones(int(lengths.sum()), bool)
            inner[starts + sizes] = False
            at = np.full(len(inner), end, np.int64)
            at[inner] = pc.fill_null(found, end).to_numpy()
            ids, inside, base = unit_of.take(at), inside_of.take(at), log_of.take(at)
            missing = found.is_null()
            others, missed = words.filter(missing), missing.to_numpy(zero_copy_only=False)
            different = others.dictionary_encode()
            unit = np.array([units.of_word(w) for w in different.dictionary.to_pylist()], np.int64).take(different.indices.to_numpy())
            spots = np.flatnonzero(inner)[missed]
            ids[spots], inside[spots] = unit, -units.weight.take(unit)
            before = np.concatenate([[0], np.cumsum(missed)])
            edges = before.take(np.concatenate([[0], np.cumsum(sizes)]))
            data = packed(ids)
            yield pa.RecordBatch.from_arrays(
                [rows.column("row"), rows.column("doc_id"), rows.column("trains"), rows.column("share"), pa.array(lengths), pa.array(np.add.reduceat(base, starts) + sizes * base_of + end_base), pa.array(np.add.reduceat(inside, starts)),
                 pa.array([data[i : i + n].tobytes() for i, n in zip(starts.tolist(), lengths.tolist())], pa.binary()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), others)],
                ["row", "doc_id", "trains", "share", "n_tokens", "base", "inside", "ids", "rest"],
            )

    keyed = rows.withColumns({"row": F.monotonically_increasing_id(), "share": F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))})
    kind = dict(rows.dtypes)["doc_id"]
    encoded = written(keyed.mapInArrow(encode, f"row long, doc_id {kind}, trains boolean, share long, n_tokens long, base double, inside double, ids binary, rest array<binary>"), "encoded")
    several = max(1, -(-n // tokens_a_trainer))
    by = F.xxhash64("share")
    dealt = encoded.where("trains").select(F.pmod(by, F.lit(several)).cast("int").alias("trainer"), F.pmod(F.shiftright(by, 32), F.lit(rounds)).alias("part"), "ids")
    parameters = spark.sparkContext.broadcast(train(dealt, units, dims, noise, rate, batch, rounds, several, seed))

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = sent.value[0]
        for rows in _slices(batches):
            lengths = rows.column("n_tokens").to_numpy()
            ids = np.frombuffer(b"".join(rows.column("ids").to_pylist()), np.uint32).astype(np.int64)
            one, two = contexts(ids)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            logs = np.add.reduceat(log_p(parameters.value, units, ids, one, two), starts) / _LN10
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in ("row", "doc_id", "trains", "n_tokens", "base")] + [pa.array(logs + rows.column("inside").to_numpy())], ["row", "doc_id", "trains", "n_tokens", "base", "model"])

    scored = encoded.select("row", "doc_id", "trains", "n_tokens", "base", "inside", "ids").mapInArrow(model, f"row long, doc_id {kind}, trains boolean, n_tokens long, base double, model double")
    tail = counts.where(F.col("c") <= least).select("word", "c")
    each = encoded.select("row", F.explode("rest").alias("word")).join(tail, "word", "left")
    logs = F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)
    sums = each.groupBy("row").agg(F.sum(logs).alias("logs"), F.count("c").alias("seen"), F.count("*").alias("n"))
    joined = scored.join(sums, "row", "left")
    more = F.coalesce("logs", F.lit(0.0))
    return joined.select(
        "doc_id", (~F.col("trains")).alias("held_out"), "n_tokens",
        (F.col("n_tokens") - (0 if ends else 1) - F.coalesce("n", F.lit(0)) + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"),
    )
