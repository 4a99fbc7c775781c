"""Mixing and sharding."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cladeframe.llm import feistel, mixing

SCHEMA = "doc_id long, text string, source string, shard int, block string"


def documents(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "a", "a", "b", "c", "d", None]), 1, "x") for k in range(3000)]
    rows += [(5000, None, "a", 1, "x"), (5001, "", "e", 1, "x"), (None, "one two", "a", 1, "x"), (3, rows[3][1], rows[3][2], 1, "x")]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_targets_reshare_the_excess():
    assert mixing.targets([100, 100, 1], [5, 2, 1], 300) == pytest.approx([200, 98, 2])
    assert mixing.targets([0, 10], [5, 2], 15) == pytest.approx([0, 15])
    assert mixing.targets([], [], 0) == []


def test_mix_meets_targets_and_reruns_agree(spark):
    rows, docs = documents(spark)
    first = mixing.taken(docs).collect()
    assert len(first) == len(rows)
    totals, targets = defaultdict(int), {}
    for r in first:
        assert r.taken in (0, r.size, 2 * r.size)
    source_of = {d: s for d, _, s, *_ in rows}
    for r in first:
        totals[source_of[r.doc_id]] += r.taken
        targets[source_of[r.doc_id]] = r.target
    assert all(abs(totals[s] - t) <= max(60, 0.02 * t) for s, t in targets.items())
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, first)) == sorted(map(key, mixing.taken(docs.repartition(7)).collect()))
    copies = mixing.mix(docs)
    assert copies.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in copies.collect()) == sum(totals.values())
    assert mixing.taken(docs.where("false")).count() == 0 and mixing.mix(docs.where("false")).count() == 0


def test_one_id_or_one_row_many_times(spark):
    """Half of the rows under one id, a third of them the same row, many without an id: targets are met as with ids of their own."""
    rows = [(7 if k % 2 else k, "w " * (k % 40) if k % 3 else "one two three", "ab"[k % 5 == 0], 1, "x") for k in range(3000)] + [(None, "u v " * (k % 9), "a", 1, "x") for k in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.taken(docs.withColumn("source", docs.source)).join(docs.select("source").distinct(), how="left_semi").collect()
    own = Counter()
    for _, t, s, *_ in rows:
        own[s] += len(t.split())
    size_of = {v: k for k, v in own.items()}
    taken, target = Counter(), {}
    for r in got:
        taken[size_of[r.source_size]] += r.taken
        target[size_of[r.source_size]] = r.target
    assert all(abs(taken[s] - target[s]) <= 60 for s in own)
    key = lambda r: (str(r.doc_id), r.size, r.taken, tuple(r.shards))
    assert Counter(map(key, got)) == Counter(map(key, mixing.taken(docs.repartition(5, "shard", "text").sortWithinPartitions("doc_id")).collect()))
    assert sum(len((r.text or "").split()) for r in mixing.mix(docs).collect()) == sum(taken.values())


def test_tree_decides_shards(spark, monkeypatch):
    """A plain rebuild: blocks in the plan's drawing order, dealt to shards as the tree's draw says; another tree gives other rows."""
    _, docs = documents(spark)
    rows = mixing.taken(docs).collect()
    counts = Counter(s for r in rows for s in r.shards)
    assert set(counts) == set(range(16))
    plan = mixing.Plan(spark, mixing._sizes(docs, 11, "doc_id", "text", "source"), 1.5, 16, 11)
    of_shard = Counter(r[3] for r in plan.rows)
    assert max(of_shard.values()) - min(of_shard.values()) <= 1
    for s in plan.sources:
        tickets = [r for r in plan.rows if r[0] == s]
        quotas = Counter(r[3] for r in tickets)
        assert [r[3] for r in tickets] == [k for k in range(16) for _ in range(quotas[k])]
        assert len({(b, p) for _, b, p, *_ in tickets}) == len(tickets)
    def in_one(quotas, shards, seed):
        out = np.zeros((shards, len(quotas)), np.int64)
        out[0] = quotas
        return out

    monkeypatch.setattr(mixing, "split_quotas", in_one)
    assert {s for r in mixing.taken(docs).collect() for s in r.shards} == {0}


def test_splitting_tree_follows_its_law():
    """Means of the draws of a shard are quota / shards, and variances those of the multivariate hypergeometric law."""
    quotas, shards = np.array([60, 30, 6]), 4
    draws = np.array([mixing.split_quotas(quotas, shards, seed)[1] for seed in range(1500)])
    n, total = 24, 96
    share = quotas / total
    variance = n * share * (1 - share) * (total - n) / (total - 1)
    assert np.abs(draws.mean(axis=0) - n * share).max() < 4 * np.sqrt(variance.max() / len(draws))
    assert np.abs(draws.var(axis=0) / variance - 1).max() < 0.2


def test_splitting_tree_keeps_quotas():
    quotas = np.array([40, 7, 0, 1])
    out = mixing.split_quotas(quotas, 6, 1)
    assert (out.sum(axis=0) == quotas).all() and out.sum(axis=1).max() - out.sum(axis=1).min() <= 1


def test_feistel_is_a_permutation_and_can_be_undone():
    for n in (1, 2, 3, 16, 17, 1000):
        places = feistel.permute(np.arange(n), n, 7)
        assert sorted(places.tolist()) == list(range(n))
        assert feistel.unpermute(places, n, 7).tolist() == list(range(n))


def test_shards_by_recomputed_permutation(spark):
    """Rows in the order of id, checksum and size; number k goes to place feistel(k): shard place mod 16, slot place div 16, and back."""
    rows, docs = documents(spark)
    got = feistel.shard(docs).collect()
    of = lambda t: (zlib.crc32((t or "").encode()), len((t or "").encode()) + 1)
    order = sorted(((d is not None, d or 0), *of(t), d) for d, t, *_ in rows)
    places = feistel.permute(np.arange(len(order)), len(order), 7).tolist()
    expected = Counter((str(d), size, crc, place % 16, place // 16) for (_, crc, size, d), place in zip(order, places))
    assert Counter((str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in got) == expected
    back = feistel.unpermute(np.array([r.slot * 16 + r.shard for r in got]), len(order), 7)
    assert sorted(back.tolist()) == list(range(len(order)))
    assert all(r.law == "rows" and r.grown_shard is None for r in got)


def test_mix_by_recomputed_targets(spark):
    """Sizes and targets from the rule alone: weights 5, 2, 1 over sources by code point, null last, shares of 150 % of all words, none above twice its own, the excess shared again."""
    rows, docs = documents(spark)
    size = lambda t: len((t or "").split())
    sources = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    own = {s: sum(size(t) for _, t, x, *_ in rows if x == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, left, rest = {}, list(sources), 1.5 * sum(own.values())
    while left:
        whole = sum(weight[s] for s in left)
        full = [s for s in left if rest * weight[s] / whole > 2 * own[s]]
        if not full:
            target |= {s: rest * weight[s] / whole for s in left}
            break
        for s in full:
            target[s] = 2.0 * own[s]
        rest -= sum(target[s] for s in full)
        left = [s for s in left if s not in full]
    by_id = {(str(d), size(t)): s for d, t, s, *_ in rows}
    for r in mixing.taken(docs).collect():
        s = by_id[str(r.doc_id), r.size]
        assert r.source_size == own[s] and r.target == pytest.approx(target[s])


def test_shards(spark):
    rows, docs = documents(spark)
    got = feistel.shard(docs).collect()
    assert Counter((str(r.doc_id), r.size, r.text_crc32) for r in got) == Counter((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert feistel.shard(docs.where("false")).count() == 0
