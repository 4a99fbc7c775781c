"""Token counts, fertility, byte-level BPE, language-model scores and toxicity against their libraries and brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cladeframe.llm import digest_cache, fertility, lbl, nnpu, prefix_bpe
from cladeframe.llm.common import new_path

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES, RANKS, PATTERN = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, content string, n_tokens long"
TEXTS = [None, "", " ", "\n\t \n", "one", "  two  spaces ", "Ünïcode é漢字🙂 ok", "<|endoftext|> special", "can't WON'T 123,456.78", "tab\tand\r\nline  \n\n end ", "long " * 20_000, "x" * 5_000, "▁ sign", "a\x1cb\x85c d"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "clash", 7) for k, t in enumerate([*TEXTS, *TEXTS[4:7]])] + [(None, "no id", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_token_counts_meet_the_library_and_the_cache(spark, docs):
    sentencepiece = pytest.importorskip("sentencepiece")
    model, cache = sentencepiece.SentencePieceProcessor(model_file=PIECES), new_path(spark, "cache")
    first = digest_cache.token_counts(docs, PIECES, cache, limit=100).collect()
    assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in first} == {(r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in docs.collect()}
    assert len(first) == docs.count() and not any(r.cached for r in first) and any(r.over_limit for r in first)
    more = docs.unionByName(spark.createDataFrame([(99, "a new text", "en", None, None)], SCHEMA))
    again = digest_cache.token_counts(more, PIECES, cache, limit=100).collect()
    assert {r.doc_id for r in again if not r.cached} == {99}
    assert digest_cache.token_counts(docs.where("doc_id > 1000"), PIECES, new_path(spark, "cache")).count() == 0


def repeats(words, width=8):
    windows = Counter(tuple(words[k : k + width]) for k in range(len(words) - width + 1))
    return len({k + j for k in range(len(words) - width + 1) if windows[tuple(words[k : k + width])] > 1 for j in range(width)})


def test_base_rules_by_brute_force():
    rng = random.Random(1)
    for n in (0, 7, 8, 9, 40, 300):
        words = [rng.choice([b"a", b"b"]) for _ in range(n)]
        assert fertility.repeated_words(words) == repeats(words)
    text = "a #b\n  \na #b\n\nc\u2028d <x>\n a #b"
    assert fertility.base_measures(text) == (8, 15, 5, 1, 0)  # U+2028 is no ASCII white space: c and d are one word


def test_fertility_bands_reject_the_odd_one(spark, docs):
    rng = random.Random(2)
    words = ["river", "mountain", "evening", "paper", "window", "summer", "people", "garden", "letter", "morning", "the", "of"]
    plain = [" ".join(rng.choice(words) for _ in range(rng.randrange(80, 110))) for _ in range(120)]
    odd = " ".join("".join(chr(rng.randrange(0x12000, 0x12300)) for _ in range(4)) for _ in range(30))
    rows = [(k, t, "en", None, None) for k, t in enumerate([*plain, odd])]
    got = {r.doc_id: r for r in fertility.judge(spark.createDataFrame(rows, SCHEMA), PIECES, RANKS, PATTERN, row=["doc_id"]).select("row.doc_id", "*").collect()}
    assert sum(got[k].kept for k in range(120)) >= 118 and got[120].fallback > 0.5
    edge = fertility.judge(docs, PIECES, RANKS, PATTERN, row=["doc_id"]).select("row.doc_id", "*").collect()
    assert len(edge) == docs.count() and all(r.base_failed and not r.kept for r in edge)
    assert fertility.judge(docs.where("doc_id > 1000"), PIECES, RANKS, PATTERN, row=["doc_id"]).select("row.doc_id", "*").count() == 0


def test_fertility_judges_lengths_with_few_documents(spark):
    """One long text of junk, and one of a language of its own: neither its octave nor its language has bands."""
    rng = random.Random(2)
    words = ["river", "mountain", "evening", "paper", "window", "summer", "people", "garden", "letter", "morning", "the", "of"]
    plain = [" ".join(rng.choice(words) for _ in range(rng.randrange(80, 110))) for _ in range(120)]
    odd = lambda n: " ".join("".join(chr(rng.randrange(0x12000, 0x12300)) for _ in range(4)) for _ in range(n))
    good = " ".join(rng.choice(words) for _ in range(70))
    rows = [(k, t, "en", None, None) for k, t in enumerate(plain)] + [(200, odd(1500), "en", None, None), (201, odd(900), "xx", None, None), (202, good, "xx", None, None)]
    got = {r.doc_id: r for r in fertility.judge(spark.createDataFrame(rows, SCHEMA), PIECES, RANKS, PATTERN, row=["doc_id"]).select("row.doc_id", "*").collect()}
    assert not got[200].base_failed and not got[200].kept and not got[201].base_failed and not got[201].kept
    assert got[202].kept and len(got) == len(rows)
    few = fertility.judge(spark.createDataFrame([rows[0], rows[1], rows[2]], SCHEMA), PIECES, RANKS, PATTERN, row=["doc_id"]).select("row.doc_id", "*").collect()
    assert len(few) == 3


def brute_bands(rows, least=50, low=4.0, high=8.0):
    """(kept, base_failed) of rows (lang, octave, failed, four measures), by sorting all values of a group."""

    def band(values):
        steps = sorted(math.floor(v / fertility.STEP) for v in values)
        q1, q2, q3 = ((steps[-(-k * len(steps) // 4) - 1] + 0.5) * fertility.STEP for k in (1, 2, 3))
        spread = max((q3 - q1) / 1.349, 0.01)
        return q2 - low * spread, q2 + high * spread

    passed = [r for r in rows if not r[2]]

    def nearest(octave, groups):
        there = {o: g for o, g in groups.items() if len(g) >= least}
        return there[min(there, key=lambda o: (abs(o - octave), o))] if there else None

    def octaves(some):
        return {o: [r for r in some if r[1] == o] for o in {r[1] for r in some}}

    out = []
    for lang, octave, failed, *values in rows:
        mine = [r for r in passed if r[0] == lang]
        group = nearest(octave, octaves(mine)) or (mine if len(mine) >= least else None) or nearest(octave, octaves(passed)) or passed
        good = not failed
        for k, m in enumerate(fertility.MEASURES):
            if group:
                lo, hi = band([r[3 + k] for r in group])
                good &= values[k] <= hi and (m == "fallback" or values[k] >= lo)
        out.append(good)
    return out


def test_judge_by_brute_force(spark):
    """Every column of judge() on four languages (one null, one empty), many octaves, junk, repeats and empty texts."""
    sentencepiece, tiktoken = pytest.importorskip("sentencepiece"), pytest.importorskip("tiktoken")
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=prefix_bpe.read_ranks(RANKS), special_tokens={})
    rng = random.Random(12)
    words = "river mountain evening paper window summer people garden letter morning the of über façade 漢字 речка #tag".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    junk = lambda n: " ".join("".join(chr(rng.randrange(0x12000, 0x12300)) for _ in range(4)) for _ in range(n))
    texts = [(text(rng.choice((25, 60, 130, 400))), rng.choice(["en", "en", "de", None, ""])) for _ in range(260)]
    texts += [(junk(40), "en"), (junk(900), "de"), (junk(30), None), ("word " * 300, "en"), (None, "en"), ("", None), (" \n ", "xx"), (text(3000), "xx"), ("a#b\n" * 30, "en")]
    docs = spark.createDataFrame([(k, t, lang, "x", 1) for k, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string, m string, octave int")
    got = {r.doc_id: r for r in fertility.judge(docs, PIECES, RANKS, PATTERN, row=["doc_id"]).select("row.doc_id", "*").collect()}
    rows = []
    for k, (t, lang) in enumerate(texts):
        t = t or ""
        own = t.encode().split()
        lines = [x for x in t.encode().split(b"\n") if x.split()]
        base = (len(own), sum(len(w.decode()) for w in own), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeats(own))
        assert base == tuple(got[k][n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        assert got[k].base_failed == failed
        ids = pieces.encode(t)
        shares = [c / len(ids) for c in Counter(ids).values()]
        values = (len(t) / len(ids), len(t) / len(ranks.encode_ordinary(t)), sum(map(pieces.is_byte, ids)) / len(ids), -sum(x * math.log2(x) for x in shares)) if ids else (0.0,) * 4
        assert got[k].n_tokens == len(ids) and [got[k][m] for m in fertility.MEASURES] == pytest.approx(values)
        rows.append((lang, int(math.log2(max(1, len(ids)))), failed, *(got[k][m] for m in fertility.MEASURES)))
    expected = brute_bands(rows)
    assert [got[k].kept for k in range(len(texts))] == expected
    assert not any(expected[k] for k in (260, 261, 262)) and sum(expected) > 200


def test_prefix_bpe_round_trip(docs):
    tiktoken = pytest.importorskip("tiktoken")
    library = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=prefix_bpe.read_ranks(RANKS), special_tokens={})
    got = {r.doc_id: r for r in prefix_bpe.encode_documents(docs, RANKS, PATTERN).collect()}
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert prefix_bpe.encode_documents(docs.where("doc_id > 1000"), RANKS, PATTERN).count() == 0


def test_appends_and_edits_are_exact():
    bpe, rng = prefix_bpe.PrefixEncoder(prefix_bpe.read_ranks(RANKS)), random.Random(4)
    for _ in range(20):
        data = bytes(rng.choice(b" etaoinshr01\xc3\xa9") for _ in range(rng.randrange(1, 60)))
        last = bpe.prefixes(data)
        more = bytes(rng.choice(b" etaoin") for _ in range(5))
        assert bpe.append(data, last, more)[1] == bpe.prefixes(data + more)
        at = rng.randrange(len(data))
        out, state = bpe.edit(data, last, at, min(len(data), at + 2), b"the")
        assert state == bpe.prefixes(out) and bpe.decode(bpe.tokens(state)) == out


def trains(doc_id, parts):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts != 0


def model_rows():
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["a", "b", "B", "cc", "d" + str(rng.randrange(30)), "tail" + str(rng.randrange(60)), "é" + str(rng.randrange(9))]) for _ in range(rng.randrange(0, 40)))) for k in range(80)]
    return rows + [(200, None), (201, ""), (None, "a b"), (202, "never seen words"), (3, rows[3][1]), (203, "a b cc " * 3000)]


def test_language_model_by_brute_force(spark, monkeypatch):
    """Base scores from counts; scores from the trained vectors by plain sums over all units, token by token."""
    rows, held = model_rows(), {}
    tokens = {k: [w.decode() for w in lbl.words_of(t)] + ["\0end"] for k, (_, t) in enumerate(rows)}
    counts = Counter(w for k, (d, _) in enumerate(rows) if trains(d, 10) for w in tokens[k])
    n, v = sum(counts.values()), len(counts)
    train = lbl.train

    def kept(texts, units, *more):
        held["units"], held["p"] = units, train(texts, units, *more)
        return held["p"]

    monkeypatch.setattr(lbl, "train", kept)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, word int, ids string")
    got = lbl.score(docs, fewest=24, head=12, dims=4, noise=16, batch=64).collect()
    expected = sorted((str(d), len(tokens[k]), sum(w in counts for w in tokens[k]), round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[k]), 6)) for k, (d, _) in enumerate(rows))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == expected
    assert all(r.train_tokens == n and r.held_out == (not trains(r.doc_id, 10)) for r in got)

    units, p = held["units"], held["p"]
    assert len(units.words) > 3 and len(units.prefixes) > 2 and len(units.members) > 3
    unit = lambda w: lbl.END if w == "\0end" else units.of_word(w.encode())
    inside = Counter()  # smoothed tokens of a unit's known words and one unseen
    for w, c in counts.items():
        inside[unit(w)] += c + 0.1

    def probability(w, h):
        k = unit(w)
        clusters = np.exp(h @ p.qc.T.astype(float) + p.bc)
        members = units.members[units.cluster[k]]
        mine = np.exp(h @ p.q[members].T.astype(float) + p.b[members])
        share = 1.0 if k == lbl.END or w.encode() in units.words else (counts[w] + 0.1) / (inside[k] + 0.1)
        return clusters[units.cluster[k]] / clusters.sum() * mine[members.tolist().index(k)] / mine.sum() * share

    def total(words):
        before, out = [lbl.END, lbl.END], 0.0
        for w in words:
            out += math.log10(probability(w, p.r[before[-1]].astype(float) @ p.c1 + p.r[before[-2]].astype(float) @ p.c2))
            before.append(unit(w))
        return out

    scores = {k: total(tokens[k]) for k in range(len(rows)) if len(tokens[k]) < 100}
    order = lambda rows: sorted(rows, key=lambda x: (x[0], x[1], round(x[2], 2), x[2]))
    own = order((str(d), len(tokens[k]), scores[k]) for k, (d, _) in enumerate(rows) if k in scores)
    found = order((str(r.doc_id), r.n_tokens, r.score) for r in got if r.n_tokens < 100)
    assert [x[:2] for x in found] == [x[:2] for x in own] and [x[2] for x in found] == pytest.approx([x[2] for x in own], abs=2e-3)
    h = np.random.default_rng(1).normal(size=4)
    words = [*counts, *(f"{x.decode()}never{k}" for k, x in enumerate(units.prefixes))]
    assert sum(probability(w, h) for w in words) <= 1 + 1e-9  # all known words and an unseen one of each beginning
    assert lbl.score(docs.where("doc_id > 1000")).count() == 0


def test_held_out_texts_score_above_the_base(spark):
    """Two languages, each with many rare words: context must tell which one a text is of."""
    rng = random.Random(8)
    plain = {x: [x + "".join(rng.choice("aeiou" if x == "th" else "kmnrst") for _ in range(5)) for _ in range(800)] for x in ("th", "zo")}
    rows = [(k, " ".join(rng.choice(plain[("th", "zo")[k % 2]]) for _ in range(60))) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r for r in lbl.score(docs).collect() if r.held_out]
    gain = sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got)
    assert len(got) > 50 and gain > 0.15
    assert sorted((r.doc_id, round(r.score, 3)) for r in got) == sorted((r.doc_id, round(r.score, 3)) for r in lbl.score(docs.repartition(7)).collect() if r.held_out)


def test_bound_on_frequent_words_is_exact(spark):
    """The most words above a count, but never more than asked for, however large the counts are."""
    rng = random.Random(4)
    for counts in ([10**k + j for k in range(1, 13) for j in range(6)], [3] * 50 + [10**9] * 40, [2**40 + rng.randrange(9) for _ in range(60)], [7]):
        table = spark.createDataFrame([(c,) for c in counts], "c long")
        for most in (0, 1, 7, 30, 60, 10**6):
            cut = lbl.cut_off(table, most)
            above = sum(c > cut for c in counts)
            assert above <= most and (cut == 0 or above + counts.count(cut) > most)


def test_units_beyond_16_bits():
    """70,000 units: numbers are kept whole, and one that 32 bits cannot hold is an error."""
    units = lbl.Units.of([(b"%d" % k, 2) for k in range(70_000)], [], [(0, 0)] * 64, 1)
    ids = np.array([1, 69_999, 65_537, 70_000])
    assert np.frombuffer(lbl.packed(ids).tobytes(), np.uint32).tolist() == ids.tolist()
    for outside in ([-1], [1 << 32]):
        with pytest.raises(ValueError):
            lbl.packed(np.array(outside))
    p = lbl.Parameters.start(units, 2, 1)
    got = lbl.log_p(p, units, ids, *lbl.contexts(ids))
    one, two = lbl.contexts(ids)
    for k, w in enumerate(ids):
        h = p.r[one[k]].astype(float) @ p.c1 + p.r[two[k]].astype(float) @ p.c2
        members = units.members[units.cluster[w]]
        cluster, mine = h @ p.qc.T + p.bc, h @ p.q[members].T + p.b[members]
        plain = cluster[units.cluster[w]] - np.log(np.exp(cluster).sum()) + mine[members.tolist().index(w)] - np.log(np.exp(mine).sum())
        assert got[k] == pytest.approx(plain, abs=1e-4)


def test_many_trainers_are_averaged(spark, monkeypatch):
    """More trainers than are averaged in one group: two rounds of averages, every token used."""
    monkeypatch.setattr(lbl, "_FAN", 3)
    rows = [(k, " ".join(["a b c d"] * 5)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lbl.score(docs, fewest=70, dims=4, noise=16, batch=64, tokens_a_trainer=400).collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_model_learns_order():
    """A text in which each word tells the next: contexts must beat the shares of words."""
    units = lbl.Units.of([(b"a", 3000), (b"b", 3000), (b"c", 3000), (b"d", 3000)], [], [(0, 0)] * 64, 1)
    ids = np.tile(np.array([1, 2, 3, 4]), 3000)
    trainer = lbl.Trainer(lbl.Parameters.start(units, 8, 1), units, 32, 0.2, 1)
    trainer.texts(ids, 100)
    one, two = lbl.contexts(ids)
    model = lbl.log_p(trainer.p, units, ids[-400:], one[-400:], two[-400:]).mean()
    assert model > np.log(units.share[ids[-400:]]).mean() + 0.5
    every = np.arange(len(units.share))
    assert np.exp(lbl.log_p(trainer.p, units, every, np.full(len(every), 2), np.full(len(every), 3))).sum() == pytest.approx(1, abs=1e-4)


def test_contexts_are_worked_out_once(monkeypatch):
    """Scoring 20,000 tokens after 40 different contexts: clusters take exponentials of these contexts, not of every token; values as by plain sums."""
    units = lbl.Units.of([(b"%d" % k, 2) for k in range(3000)], [], [(0, 0)] * 64, 1)
    rng, p, seen = np.random.default_rng(2), lbl.Parameters.start(units, 4, 1), []
    w, w1, w2 = rng.integers(0, 3000, 20_000), rng.integers(0, 40, 20_000), rng.integers(0, 40, 20_000)
    exp = np.exp
    monkeypatch.setattr(np, "exp", lambda x, *more, **named: (seen.append(np.size(x)), exp(x, *more, **named))[1])
    got = lbl.log_p(p, units, w, w1, w2)
    clusters, most = len(units.members), max(map(len, units.members))
    assert sum(seen) <= 20_000 * most + 80 * clusters < 20_000 * (min(map(len, units.members)) + clusters)
    for lost in (1e9, 0):  # both ways of the clusters' sums
        monkeypatch.setattr(lbl, "_SAFE", lost)
        assert lbl.log_p(p, units, w, w1, w2) == pytest.approx(got, abs=1e-4)
    for k in range(0, 20_000, 997):
        h = p.r[w1[k]].astype(float) @ p.c1 + p.r[w2[k]].astype(float) @ p.c2
        members = units.members[units.cluster[w[k]]]
        cluster, mine = h @ p.qc.T + p.bc, h @ p.q[members].T + p.b[members]
        plain = cluster[units.cluster[w[k]]] - np.log(exp(cluster).sum()) + mine[members.tolist().index(w[k])] - np.log(exp(mine).sum())
        assert got[k] == pytest.approx(plain, abs=1e-4)


@pytest.mark.parametrize("dims", [3, 4])
def test_step_by_plain_gradients(dims):
    """A batch with units, contexts and noise met several times moves each row once, by the sum of its gradients, and no other row."""
    units = lbl.Units.of([(b"%d" % k, k + 1) for k in range(30)], [], [(0, 0)] * 64, 1)
    start = lbl.Parameters.start(units, dims, 1)
    trainer, rng = lbl.Trainer(start, units, 32, 0.2, 1), np.random.default_rng(3)
    w, before, drawn = rng.integers(0, 30, 50), rng.integers(0, 30, (50, 2)), rng.integers(0, len(units.members), 32)
    noise = trainer._noise(units.cluster[w])
    assert noise.shape == (2, 50) and (units.cluster[noise] == units.cluster[w]).all()
    trainer._noise = lambda c: noise
    trainer.step(w, before, drawn)
    p, g = start.arrays(), [np.zeros(x.shape) for x in start.arrays()]
    r, q, b, c1, c2, qc, bc = (x.astype(float) for x in p)
    whole = np.bincount(units.cluster, units.share)
    for t in range(50):
        k, (x, y) = units.cluster[w[t]], before[t]
        h, dh = r[x] @ c1 + r[y] @ c2, np.zeros(dims)
        unit = [(w[t], 1), *((z, 0) for z in noise[:, t])]
        for vectors, biases, at, rows, expected in ((q, b, 1, unit, lambda z: 2 * units.share[z] / whole[k]), (qc, bc, 5, [(k, 1), *((z, 0) for z in drawn)], lambda z: 32 * whole[z])):
            for z, true in rows:
                off = (1 / (1 + np.exp(-(h @ vectors[z] + biases[z] - np.log(expected(z))))) - true) / 50
                dh += off * vectors[z]
                g[at][z] += off * h
                g[at + 1][z] += off
        g[0][x] += dh @ c1.T
        g[0][y] += dh @ c2.T
        g[3] += np.outer(r[x], dh)
        g[4] += np.outer(r[y], dh)
    for old, new, grad in zip(p, trainer.p.arrays(), g):
        assert new == pytest.approx(old - 0.2 * grad / np.sqrt(1e-3 + grad * grad), abs=1e-4)
        assert (new[grad == 0] == old[grad == 0]).all()


def test_slots_draw_by_shares():
    for share in ([1.0], [0.5, 0.5], [1e-9, 3.0, 2.0, 1e-3, 7.5], np.random.default_rng(1).random(131) ** 8):
        accept, other = lbl.slots(np.array(share))
        chance = accept.copy()
        np.add.at(chance, other, 1 - accept)
        assert chance / len(chance) == pytest.approx(np.array(share) / np.sum(share), abs=1e-9)


def test_words_of_columns_are_those_of_texts(monkeypatch):
    texts = [" A  b\t\x0bC\x0c", "", None, "\x1c\x85 x\u00a0Y", "A\x00B \u00c9\u0130", "\n", "one", "x" * 50, None, "two words"]
    for part in (pa.array(texts), pa.array(["left out", *texts, "too"])[1:-1], pa.array(texts[:0], pa.string())):
        words, sizes = lbl.split_words(part)
        assert words.to_pylist() == [w for t in part.to_pylist() for w in lbl.words_of(t)] and sizes.tolist() == [len(lbl.words_of(t)) for t in part.to_pylist()]
    monkeypatch.setattr(lbl, "_BYTES", 9)
    cut = [x.column("text").to_pylist() for x in lbl._by_bytes(iter([pa.record_batch({"text": pa.array(texts)})]))]
    assert [t for x in cut for t in x] == texts and len(cut) > 3
    assert all(len(x) == 1 or sum(len((t or "").encode()) for t in x) <= 9 for x in cut)


def test_risk_gradient_of_positive_unlabelled_learning():
    """One step goes down prior R_p(+) + R_u(-) - prior R_p(-) where that part is not negative, and up the negative part where it is."""
    rng = np.random.default_rng(3)
    positive, unlabelled, prior = rng.integers(0, 2, (40, 3)).astype(float), rng.integers(0, 2, (60, 3)).astype(float), 0.3
    loss = lambda z: np.log1p(np.exp(-z))

    def parts(w, b):
        p, u = positive @ w + b, unlabelled @ w + b
        return prior * loss(p).mean(), loss(-u).mean() - prior * loss(-p).mean()

    risk = lambda w, b: parts(w, b)[0] + max(0.0, parts(w, b)[1])
    start = risk(np.zeros(3), math.log(prior / (1 - prior)))
    sparse = lambda x: nnpu.Texts.of([np.flatnonzero(r) for r in x])
    apart = lambda w: (w[:-1], w[-1])
    begin = lambda n, prior: np.append(np.zeros(n), math.log(prior / (1 - prior)))
    assert risk(*apart(nnpu.fit_nnpu(sparse(positive), sparse(unlabelled), prior, begin(3, prior), steps=200, decay=0.0))) < start
    # all positives stand out and no unlabelled text is like them: the estimate of the negatives' risk would go far below zero
    only, none = np.ones((50, 1)), np.zeros((50, 1))
    w, b = apart(nnpu.fit_nnpu(sparse(only), sparse(none), 0.5, begin(1, 0.5), steps=400, decay=0.0))
    z_p, z_u = only @ w + b, none @ w + b
    assert loss(-z_u).mean() - 0.5 * loss(-z_p).mean() > -0.5


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    plain, bad = [f"word{k}" for k in range(200)], [f"vile{k}x" for k in range(12)]
    rows, labels = [], []
    for k in range(1500):
        toxic = k % 5 == 0
        words = [rng.choice(plain) for _ in range(30)] + ([rng.choice(bad) for _ in range(4)] if toxic else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words), "x"))
        if k % 2 == 0 or k % 3 == 0:
            labels.append((k, 1, int(toxic)))
    rows += [(9000, None, "x"), (9001, "", "x"), (None, "word1", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    table = spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = nnpu.toxicity(docs, table).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1500]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.95
    assert all(r.score < 0.5 for r in got if r.doc_id in (9000, 9001))
    assert {r.score < 0.5 for r in nnpu.toxicity(docs, table.where("false")).collect()} == {True}
    assert nnpu.toxicity(docs.where("false"), table).count() == 0


def plain_toxicity(rows, labels, steps):
    """Features, evidence, risk and scores by loops and dense matrices."""
    marks = ".,;:!?\"'()[]{}<>|*#$%&-_/\\"

    def features(text):
        out = set()
        for w in (text or "").lower().split():
            if w := w.strip(marks):
                out |= {"w" + w} | {f"{n}{w[:n]}" for n in (5, 6) if len(w) >= n}
        return out

    known = [(d, x) for d, _, x in labels if d is not None and x is not None and trains(d, 5)]
    prior = sum(x for _, x in known) / len(known)
    toxic = {d for d, x in known if x}
    training = [(d, t) for d, t in rows if trains(d, 5)]
    confirmed = [features(min(t or "" for e, t in training if e == d)) for d in sorted(toxic) if any(e == d for e, _ in training)]
    every = [features(t) for _, t in training]
    p, u = Counter(f for x in confirmed for f in x), Counter(f for x in every for f in x)
    chosen = []
    for f in u:
        a, b = (p[f] + 0.5) / (len(confirmed) + 1), (u[f] + 0.5) / (len(every) + 1)
        g = 2 * len(confirmed) * (a * math.log(a / b) + (1 - a) * math.log((1 - a) / (1 - b)))
        if g >= 12 and (a <= b or prior * a / b >= 0.7):
            chosen.append(f)
    dense = lambda texts: np.array([[f in t for f in chosen] + [True] for t in texts], float)
    pos, unl, w = dense(confirmed), dense(every), np.append(np.zeros(len(chosen)), math.log(prior / (1 - prior)))
    first = second = np.zeros(len(w))
    for k in range(1, steps + 1):
        at = lambda x: 1 / (1 + np.exp(-x @ w))
        s_p, s_u = at(pos), at(unl)
        negative = -np.log(1 - s_u).mean() + prior * np.log(1 - s_p).mean()
        towards = unl.T @ s_u / len(unl) - prior * pos.T @ s_p / len(pos)
        grad = towards + prior * pos.T @ (s_p - 1) / len(pos) if negative >= 0 else -towards
        grad[:-1] += 3e-4 * w[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w = w - 0.05 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return chosen, 1 / (1 + np.exp(-dense([features(t) for _, t in rows]) @ w))


def test_toxicity_by_brute_force(spark):
    """Every score from a plain rebuild; words of both signs are inputs; an id on many rows is one confirmed text."""
    rng = random.Random(16)
    rows = []
    for k in range(700):
        toxic = k % 4 == 0
        words = [rng.choice(["kind", "calm", "river!", "Stone"]) if rng.random() < (0.1 if toxic else 0.4) else f"w{rng.randrange(300)}" for _ in range(20)]
        rows.append((k, " ".join(words + ([rng.choice(["vileness", "(vilest)", "scum"])] if toxic and rng.random() < 0.9 else []))))
    rows += [(None, "scum"), (701, None), (702, ""), (4, "scum calm"), (8, rows[8][1]), (703, "vilest " * 5000)]
    labels = [(k, 1, int(k % 4 == 0)) for k in range(0, 700) if k % 3] + [(None, 1, 1), (9, None, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, trainer int")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chosen, scores = plain_toxicity(rows, labels, 300)
    assert {"wscum", "5viles", "wcalm", "wkind"} <= set(chosen)
    got = nnpu.toxicity(docs, table).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    own, found = sorted(((d, float(s)) for (d, _), s in zip(rows, scores)), key=key), sorted(((r.doc_id, r.score) for r in got), key=key)
    assert [d for d, _ in own] == [d for d, _ in found] and [s for _, s in found] == pytest.approx([s for _, s in own], abs=1e-6)
    model = nnpu.fit(docs, table, texts_a_trainer=100)  # six trainers, averaged
    whole = nnpu.fit(docs, table)
    assert set(model.weights) == set(whole.weights)
    assert all((model.weights[f] > 0) == (w > 0) for f, w in whole.weights.items() if abs(w) > 0.5)


def test_training_rows_are_crc32(spark):
    from cladeframe.llm.common import training_row

    got = spark.range(100).select("id", training_row(F.col("id"), 5).alias("t")).collect()
    assert all(r.t == trains(r.id, 5) for r in got)
