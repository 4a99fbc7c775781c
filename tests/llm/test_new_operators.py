"""Alignment of tokenizers, winnowing and fill-in-middle, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cladeframe.llm import alignment, fim, winnow

PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
ODD = list("ab  \n\t'sS1.,é漢\x1c\x85 　 🙂▁") + ["<|endoftext|>", "'ll", "<0x0A>", "</s>", " the", " of"]


def odd_texts(n, seed=3, most=24):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, most))) for _ in range(n)]


# -- alignment ------------------------------------------------------------------------
def plain_alignment(texts):
    """Groups, links and corpus counts from the libraries' tokens by plain sets and loops."""
    a_lib, b_lib = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[2])
    a_lib.encode_special_tokens = True
    letters = alignment._byte_letters()
    out, pairs = [], []
    for t in texts:
        data = b" " + (t or "").encode()
        a, b = (a_lib.encode(" " + t, add_special_tokens=False).ids, b_lib.encode(t)) if t else ([], [])
        one = [bytes(letters[c] for c in a_lib.id_to_token(i)) for i in a]
        two = [bytes([int(b_lib.id_to_piece(i)[3:-1], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or b"".join(one) != data or b"".join(two) != data:
            out.append((0, 0, 0, 0, ""))
            pairs.append([])
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (one, two)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, lo = [], 0
        for c in cuts:
            groups.append(tuple([i for i, e in zip(ids, side) if lo < e <= c] for ids, side in zip((a, b), ends)))
            lo = c
        own = [(i, j) for g, h in groups for i in g for j in h]
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((len(a), len(b), len(groups), len(own), hashlib.sha256(text.encode()).hexdigest()))
        pairs.append(own)
    count = Counter(p for own in pairs for p in set(own))
    top = defaultdict(int)
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    return [(*o[:4], sum(count[p] == top[p[0]] for p in own), sum(count[p] for p in own), o[4]) for o, own in zip(out, pairs)]


@pytest.mark.parametrize("hot", [alignment.HOT, 40])
def test_alignment_by_brute_force(spark, hot):
    texts = [None, "", " ", "the of the of", "a" * 700, "  \n" * 90, *odd_texts(150), "the of the of"]
    docs = spark.createDataFrame([(k % 60 if k % 7 else None, t, "x", 5) for k, t in enumerate(texts)], "doc_id long, text string, number string, n_a int")
    got = alignment.corpus_alignment(docs.select("doc_id", "text"), *PATHS, hot_pairs=hot).collect()
    expected = Counter((k % 60 if k % 7 else None, *x) for k, x in enumerate(plain_alignment(texts)))
    assert Counter(tuple(r) for r in got) == expected
    wide = alignment.align(docs, *PATHS)
    assert wide.select("row.number", "row.n_a").distinct().collect() == [("x", 5)]
    assert alignment.corpus_alignment(docs.where("false").select("doc_id", "text"), *PATHS).count() == 0


def test_ids_are_the_library_s():
    """Also where white space meets, texts are cut for the memory of chunks, and the memory is full."""
    work = alignment.Aligner(*PATHS)
    a_lib = Tokenizer.from_file(PATHS[0])
    a_lib.encode_special_tokens = True
    texts = [t for t in odd_texts(3000, 5) if t and "▁" not in t]
    kept, alignment.MEMO_ENTRIES = alignment.MEMO_ENTRIES, 500
    try:
        for lo in range(0, len(texts), 100):
            part = texts[lo : lo + 100]
            a, to_a, b, to_b, _ = work.encode_all(part)
            assert [x.tolist() for x in np.split(a, to_a[:-1])] == [a_lib.encode(" " + t, add_special_tokens=False).ids for t in part]
            assert [x.tolist() for x in np.split(b, to_b[:-1])] == [work.b.model.encode(t) for t in part]
    finally:
        alignment.MEMO_ENTRIES = kept


def test_bitsets():
    rng = np.random.default_rng(4)
    for n in (1, 63, 64, 65, 1000):
        ends = np.flatnonzero(rng.random(n) < 0.3) + 1
        bits = alignment.end_bits(ends, n)
        assert alignment.select(bits).tolist() == ends.tolist()
        assert alignment.rank(bits, np.arange(n + 1)).tolist() == [int((ends <= k).sum()) for k in range(n + 1)]


def test_wide_groups_and_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 9, 400), rng.integers(0, 7, 300)
    cut_a, cut_b = np.array([0, 1, 200, 400]), np.array([0, 2, 3, 300])
    plain = Counter((int(i), int(j)) for g in range(3) for i in a[cut_a[g] : cut_a[g + 1]] for j in b[cut_b[g] : cut_b[g + 1]])
    for wide, block in ((10**9, 10**9), (50, 8), (10**9, 500)):
        monkeypatch.setattr(alignment, "WIDE", wide)
        monkeypatch.setattr(alignment, "BLOCK", block)
        key, n = alignment.linked_pairs(a, b, cut_a, cut_b)
        assert {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(x) for k, x in zip(key, n)} == plain and (np.diff(key) > 0).all()


# -- winnowing ------------------------------------------------------------------------
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_contamination(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = lower_words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add("" if i is None else str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w = lower_words(t)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        out.append((d, len(w), len(hit), sorted(found)))
    return Counter((d, n, h, ",".join(f)) for d, n, h, f in out)


@pytest.mark.parametrize("chunk", [winnow.CHUNK, 16])
def test_winnowing_by_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(winnow, "CHUNK", chunk)
    rng = random.Random(6)
    pick = lambda n: [rng.choice(["ab", "cd", "Éf", "x1", "漢字", "the"]) for _ in range(n)]
    items = [(k, " ".join(pick(rng.randint(8, 40)))) for k in range(30)]
    items += [(100, "ab cd"), (101, "x1"), (102, None), (103, "..., !"), (104, ""), (3, items[4][1]), (None, items[5][1]), (105, items[5][1]), (106, "the the the the the the the the the the the the")]
    docs = []
    for k in range(120):
        words = pick(rng.randint(0, 90))
        for _ in range(rng.randint(0, 3)):
            own = (items[rng.randrange(30)][1]).split()
            lo = rng.randrange(len(own))
            words[len(words) // 2 : len(words) // 2] = own[lo : lo + rng.randint(6, 30)]
        docs.append((k % 100, rng.choice([" ", ", ", "-\n"]).join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words)))
    docs += [(None, None), (None, ""), (7, docs[7][1]), (300, "the " * 400)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n_hit int")
    i = spark.createDataFrame([(*x, 2) for x in items], "item_id long, text string, hash int")
    read = lambda df: Counter((r.row.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in df.collect())
    long = lambda t: t is None or len(lower_words(t)) >= 10 or not lower_words(t)
    assert read(winnow.contamination(d, i)) == plain_contamination(docs, items)
    assert read(winnow.contamination(d, i.where("item_id is null or item_id < 100"))) == plain_contamination(docs, [x for x in items if x[0] is None or x[0] < 100])
    assert any(long(t) for _, t in items)
    assert read(winnow.contamination(d, i.where("false"))) == plain_contamination(docs, [])
    assert winnow.contamination(d.where("false"), i).count() == 0


# -- fill in the middle ---------------------------------------------------------------
def plain_fim(doc_id, text):
    t = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark):
    texts = [None, "", "x", "a<P>b", "<", "<S", "S><", "<M>", *odd_texts(300, 9), *["".join(random.Random(k).choice("<>PSM") for _ in range(12)) for k in range(200)], "é🙂" * 20_000]
    rows = [(k if k % 50 else None, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, "f", 3) for r in rows], "doc_id long, text string, form string, n int")
    from pyspark.sql import functions as F

    made = fim.transform(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r.row.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made) == Counter((d, *plain_fim(d, t)) for d, t in rows)
    assert Counter(r.back for r in made) == Counter(t or "" for t in texts)
    assert {r.row.form for r in made} == {"f"} and fim.transform(docs.where("false")).count() == 0


def test_units():
    text = "ab  c\nd\n\ne"
    cut = lambda unit: [fim.as_text(x) for x in np.split(fim.code_points(text), fim.boundaries(fim.code_points(text), unit)[1:-1])]
    assert cut("code point") == list(text)
    assert cut("word") == ["ab", "  ", "c", "\n", "d", "\n\n", "e"]
    assert cut("line") == ["ab  c\n", "d\n", "\n", "e"]
    assert fim.boundaries(fim.code_points(""), "line").tolist() == [0]
    n, parts = fim.pieces(text, 5, 2, "word")
    assert n == 7 and parts == ("ab  ", "c\nd", "\n\ne")
