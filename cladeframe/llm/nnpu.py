"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents and unlabelled ones train a linear classifier in numpy by
the non-negative risk estimator: with class prior p, the risk of the unlabelled as
negatives less p times that of the positives as negatives is the risk of the true
negatives, and whenever the data push it below zero its gradient is turned round.

Features are the words of the whole text (lower-cased, without marks at their ends)
and their beginnings of five and six letters, present or not, under 64-bit names.
Spark counts the features of the confirmed texts and of all training texts.  A feature's
evidence is twice the log-likelihood ratio of its share among the confirmed against its
share among all; of either sign, over- and under-represented, the ``features`` with most
evidence enter, of those with ``least`` or more.  One that speaks for the positives must by
itself make them likelier than not (prior times over-representation ``posterior`` or more),
which common words never do.

Fitting takes at most ``positives`` confirmed documents, those with the smallest hashes of
their ids, one text of each id (the least), and every training document as unlabelled.
Training documents are dealt by hash to one trainer for each ``texts_a_trainer``; all
trainers hold the confirmed ones.  Each lowers the whole risk over its texts by Adam,
and the trainers' weights are averaged, in ``rounds`` rounds; one trainer is the plain
estimator.  The prior comes from all training labels.

Labels of rows whose crc32(id) mod 5 is 0 are never used; nor are labels, language,
source or id inputs of a score.  Rows: null text counts as empty and scores by the
bias alone; very long texts are read whole; null labels are no labels; repeated rows
give repeated results and count as often among the unlabelled, an id that is repeated is
one confirmed example; other columns, whatever their names, are not looked at; without
any positive example every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, training_row, written

FOLDS = 5
_MARKS = b".,;:!?\"'()[]{}<>|*#$%&-_/\\"
_MEMO_ENTRIES = 200_000
#: Texts whose features a task holds at a time.
_SLICE = 256


def word_features(word: bytes) -> tuple[int, ...]:
    """Names of a lower-case word's features."""
    word = word.strip(_MARKS)
    if not word:
        return ()
    letters = word.decode("utf-8", "replace")
    parts = [b"w" + word, *(f"{n}{letters[:n]}".encode() for n in (5, 6) if len(letters) > n - 1)]
    return tuple(xxhash.xxh64_intdigest(p) >> 1 for p in parts)


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").encode().lower().split())


def text_features(text: str | None) -> set[int]:
    return {f for w in words_of(text) for f in word_features(w)}


# -- learning -----------------------------------------------------------------
@dataclass
class Texts:
    """The chosen features of texts: on holds them in a row, ends up to which each text's go."""

    on: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Texts:
        return cls(np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64), np.cumsum([len(r) for r in rows]))

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Of each text its features' weights."""
        upto = np.concatenate([[0.0], np.cumsum(weights[self.on])])
        return upto[self.ends] - upto[np.concatenate([[0], self.ends[:-1]])]

    def spread(self, values: np.ndarray, n: int) -> np.ndarray:
        """Of each feature its texts' values."""
        return np.bincount(self.on, np.repeat(values, np.diff(self.ends, prepend=0)), minlength=n)


def fit_nnpu(positive: Texts, unlabelled: Texts, prior: float, start: np.ndarray, steps: int = 300, rate: float = 0.05, decay: float = 3e-4, gamma: float = 1.0) -> np.ndarray:
    """Weights, the last one the bias, that lower prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)) under the logistic loss, by Adam."""
    n, w = len(start) - 1, start.copy()
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for step in range(1, steps + 1):
        at_p, at_u = sigmoid(positive.sums(w[:n]) + w[n]), sigmoid(unlabelled.sums(w[:n]) + w[n])
        # d/dz log(1 + exp(-z)) = s - 1 and d/dz log(1 + exp(z)) = s
        plus = (at_p - 1) / len(at_p)
        minus_p, minus_u = at_p / len(at_p), at_u / len(at_u)
        negative = -np.log1p(-at_u.clip(max=1 - 1e-12)).mean() + prior * np.log1p(-at_p.clip(max=1 - 1e-12)).mean()
        turn = 1.0 if negative >= 0 else -gamma
        on_p = prior * plus * (negative >= 0) - turn * prior * minus_p
        on_u = turn * minus_u
        grad = np.concatenate([positive.spread(on_p, n) + unlabelled.spread(on_u, n), [on_p.sum() + on_u.sum()]])
        grad[:n] += decay * w[:n]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


@dataclass
class Model:
    weights: dict[int, float] = field(default_factory=dict)  # by feature name
    bias: float = -40.0

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores texts in a task; keeps which words have features in the model."""

    def __init__(self, model: Model):
        self.weights, self.bias = model.weights, model.bias
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def _of(self, word: bytes) -> tuple[int, ...]:
        out = tuple(f for f in word_features(word) if f in self.weights)
        if len(self.memo) < _MEMO_ENTRIES:
            self.memo[word] = out
        return out

    def score(self, text: str | None) -> float:
        memo, hits = self.memo, set()
        for w in words_of(text):
            found = memo.get(w)
            if found is None:
                found = self._of(w)
            if found:
                hits.update(found)
        total = self.bias + sum(self.weights[f] for f in sorted(hits))
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


class Features:
    """Features of texts in a task; those of its words are kept."""

    def __init__(self) -> None:
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def of(self, text: str | None) -> set[int]:
        memo, out = self.memo, set()
        for w in words_of(text):
            if (found := memo.get(w)) is None:
                found = word_features(w)
                if len(memo) < _MEMO_ENTRIES:
                    memo[w] = found
            out.update(found)
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and in how many texts they are; a task's texts are counted before they are shuffled."""
    features = Features()
    for batch in batches:
        for lo in range(0, batch.num_rows, _SLICE):
            names = array("q")
            for text in batch.column(0).slice(lo, _SLICE).to_pylist():
                names.extend(features.of(text))
            if names:
                found, n = np.unique(np.frombuffer(names, np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["feature", "n"])


def feature_counts(texts: DataFrame) -> DataFrame:
    """feature, n: the texts that have it."""
    return texts.select("text").mapInArrow(_count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def evidence(p: Column, u: Column, n_p: int, n_u: int) -> Column:
    """Twice the log-likelihood ratio of a share of p in n_p against u in n_u, with the sign of the difference."""
    a, b = (p + 0.5) / (n_p + 1), (u + 0.5) / (n_u + 1)
    g = 2 * n_p * (a * F.log(a / b) + (1 - a) * F.log((1 - a) / (1 - b)))
    return F.when(a > b, g).otherwise(-g)


def chosen_features(confirmed: DataFrame, training: DataFrame, n_p: int, n_u: int, prior: float, features: int, least: float, posterior: float) -> list[int]:
    """Those with most evidence of either sign, at most ``features`` of each, in order of their names (see above)."""
    counts = feature_counts(training).withColumnRenamed("n", "u").join(feature_counts(confirmed).withColumnRenamed("n", "p"), "feature", "full")
    counts = counts.select("feature", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("p", "u")))
    ratio = ((F.col("p") + 0.5) / (n_p + 1)) / ((F.col("u") + 0.5) / (n_u + 1))
    counts = written(counts.withColumn("g", evidence(F.col("p"), F.col("u"), n_p, n_u)).select("feature", "g", (prior * ratio).alias("posterior")), "evidence")
    speaks = (F.col("g") < 0) | (F.col("posterior") >= posterior)
    best = [counts.where(speaks & (sign * F.col("g") >= least)).orderBy(F.desc(F.abs("g")), "feature").limit(features) for sign in (1, -1)]
    out = sorted(r.feature for side in best for r in side.collect())  # at most features of each sign
    discard(counts)
    return out


def _least_hashes(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """The ids (distinct) with the smallest hashes, at most so many.  A bound on hashes from the number of ids keeps back all
    but about twice as many before they are sorted."""
    there = ids.agg(F.approx_count_distinct("doc_id").alias("n")).first().n
    order = F.xxhash64(F.lit(seed), "doc_id")
    if there > 2 * most:
        ids = ids.where(F.shiftrightunsigned(order, 1) < int(2 * most / there * (1 << 63)))
        order = F.shiftrightunsigned(order, 1)
    return ids.distinct().orderBy(order, "doc_id").limit(most)


class Learner:
    """What comes before the weights: the prior, the confirmed texts, the chosen features (empty where nothing is confirmed)."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, positives: int, features: int, least: float, posterior: float):
        train = labels.where(training_row(F.col("doc_id"), FOLDS) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        shares = train.agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("toxic")).first()
        self.rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), training_row(F.col(id_col), FOLDS).alias("trains"))
        self.names, self.prior = None, 0.0
        if not shares.toxic:
            return
        self.prior = min(max(shares.toxic / shares.n, 1e-3), 0.9)
        training = self.rows.where("trains").select("doc_id", "text")
        picked = written(_least_hashes(train.where("toxic = 1").select("doc_id"), positives, 5), "picked")
        texts = training.join(F.broadcast(picked), "doc_id")  # at most positives ids
        confirmed = written(texts.groupBy("doc_id").agg(F.min("text").alias("text")), "confirmed")
        n_p, self.n_u = confirmed.count(), training.count()
        if not n_p:
            return
        self.names = chosen_features(confirmed, training, n_p, self.n_u, self.prior, features, least, posterior)
        sure = sorted(list(r.on) for r in self.encoded(confirmed.select(F.lit(0).alias("trainer"), "text"), "trainer int").collect())  # at most positives rows
        self.known = Texts.of([np.array(x, np.int64) for x in sure])

    def encoded(self, rows: DataFrame, schema: str) -> DataFrame:
        """rows (text last) with on, the places of its text's chosen features, in the text's place."""
        place = {f: k for k, f in enumerate(self.names)}
        kept = rows.columns[:-1]

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo: dict[bytes, tuple[int, ...]] = {}
            for batch in batches:
                for lo in range(0, batch.num_rows, _SLICE):
                    part, out = batch.slice(lo, _SLICE), []
                    for text in part.column(len(kept)).to_pylist():
                        on: set[int] = set()
                        for w in words_of(text):
                            if (found := memo.get(w)) is None:
                                found = tuple(place[f] for f in word_features(w) if f in place)
                                if len(memo) < _MEMO_ENTRIES:
                                    memo[w] = found
                            if found:
                                on.update(found)
                        out.append(sorted(on))
                    yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(kept))), pa.array(out, pa.list_(pa.int32()))], [*kept, "on"])

        return rows.mapInArrow(chosen, f"{schema}, on array<int>")

    def deal(self, texts_a_trainer: int) -> tuple[Column, int]:
        several = max(1, -(-self.n_u // texts_a_trainer))
        return F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(several)).cast("int"), several

    def weights(self, on: DataFrame, several: int, rounds: int, steps: int) -> np.ndarray:
        """Weights of the features, the last one the bias, from all rows of on (trainer, on)."""
        on = written(on.repartition(several, "trainer").sortWithinPartitions("trainer", "on"), "chosen")
        weights = np.zeros(len(self.names) + 1)
        weights[-1] = np.log(self.prior / (1 - self.prior))
        known, prior = self.known, self.prior

        def trainer(start: np.ndarray) -> Callable[[pd.DataFrame], pd.DataFrame]:
            def learn(rows: pd.DataFrame) -> pd.DataFrame:
                w = fit_nnpu(known, Texts.of(list(rows.on)), prior, start, steps)
                return pd.DataFrame({"place": np.arange(len(w)), "w": w * len(rows), "n": len(rows)})

            return learn

        for _ in range(rounds if several > 1 else 1):
            mean = on.groupBy("trainer").applyInPandas(trainer(weights), "place int, w double, n long").groupBy("place").agg((F.sum("w") / F.sum("n")).alias("w"))
            found = mean.collect()  # a row a feature
            weights = np.array([r.w for r in sorted(found, key=lambda r: r.place)])
        discard(on)
        return weights


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", positives: int = 4000, features: int = 1024, least: float = 12.0, posterior: float = 0.7, texts_a_trainer: int = 50_000, rounds: int = 2, steps: int = 300,
) -> Model:
    """Trains on at most positives confirmed documents and on all others (see above)."""
    learner = Learner(docs, labels, id_col, text_col, positives, features, least, posterior)
    if learner.names is None:
        return Model()
    deal, several = learner.deal(texts_a_trainer)
    on = learner.encoded(learner.rows.where("trains").select(deal.alias("trainer"), "text"), "trainer int")
    weights = learner.weights(on, several, rounds, steps)
    return Model({f: float(w) for f, w in zip(learner.names, weights)}, float(weights[-1]))


def score_column(text: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model.scorer()
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")

    return score(text)


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", positives: int = 4000, features: int = 1024, least: float = 12.0, posterior: float = 0.7, texts_a_trainer: int = 50_000, rounds: int = 2, steps: int = 300,
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, by the model that fit makes; texts are read for it and for their scores at once."""
    learner = Learner(docs, labels, id_col, text_col, positives, features, least, posterior)
    held = (~F.col("trains")).alias("held_out")
    if learner.names is None:
        score = F.lit(float(1 / (1 + np.exp(-Model().bias))))
        return learner.rows.select("doc_id", held, score.alias("score"), F.lit(0).alias("predicted"))
    deal, several = learner.deal(texts_a_trainer)
    kind = dict(learner.rows.dtypes)["doc_id"]
    on = written(learner.encoded(learner.rows.select("doc_id", "trains", deal.alias("trainer"), "text"), f"doc_id {kind}, trains boolean, trainer int"), "encoded")
    weights = learner.weights(on.where("trains").select("trainer", "on"), several, rounds, steps)

    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        total = Texts.of(list(rows)).sums(weights[:-1]) + weights[-1] if len(rows) else np.zeros(0)
        return pd.Series(1 / (1 + np.exp(-np.clip(total, -500, 500))))

    scored = on.select("doc_id", held, score("on").alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
