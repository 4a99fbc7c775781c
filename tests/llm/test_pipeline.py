"""The corpus pipeline as a whole, on a small corpus with every awkward row, against its stages by brute force."""

import hashlib
import random

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, content string, row int, fp long"
LABELS = "doc_id long, quality int, toxic int"
WORDS = "river mountain evening paper window summer people garden letter morning table bridge forest silver village".split()


def corpus():
    rng = random.Random(3)
    text = lambda n, more=(): " ".join(rng.choice([*WORDS, *more]) for _ in range(n))
    rows = [(k, text(rng.randrange(60, 140)), "en", rng.choice(["web", "books", None])) for k in range(200)]
    toxic = [(1000 + k, text(90, ["vilefoul", "hatesome", "slurword"] * 3), "en", "web") for k in range(60)]
    base = text(120).split()
    near = [(2000 + k, " ".join([*base[:k], "changed", *base[k + 1 :]]), "en", "books") for k in (0, 30, 60, 119)]
    copies = [(3000, rows[5][1], "en", "web"), (3001, rows[5][1].upper(), "en", "web"), rows[7], rows[7]]
    shared_id = [(4000, text(100), "en", "web"), (4000, text(100), "en", "web")]
    odd = [(5000, None, None, None), (5001, "", "en", "web"), (5002, "word " * 400, "en", "web"), (None, text(80), "en", "web")]
    return rows + toxic + near + copies + shared_id + odd


def write(spark, folder, rows, labels):
    spark.createDataFrame([(*r, len(r[1] or ""), "clash", 1, 2) for r in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")


def similar(a, b):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    x, y = shingles(a), shingles(b)
    return 5 * len(x & y) >= 4 * len(x | y)


def test_run_by_brute_force(spark, tmp_path):
    rows = corpus()
    labels = [(k, 1, 0) for k in range(200)] + [(1000 + k, 0, 1) for k in range(60)] + [(None, 1, 1), (5000, None, None)]
    write(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.written(stage(spark, docs, str(tmp_path)), name.replace(" ", "-"))
        kept[name] = docs
        if name != "byte-level BPE":
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    ids = lambda name: sorted((str(r.doc_id), r.text) for r in kept[name].select("doc_id", "text").collect())
    toxic = {i for i, _ in ids("toxicity")}
    assert not toxic & {str(1000 + k) for k in range(60)} and {str(k) for k in range(200)} <= toxic
    quality = ids("quality rules")
    assert not {"5000", "5001", "5002"} & {i for i, _ in quality} and len(quality) >= 205
    # near-duplicates: of each component of similar texts the smallest (id, hash of the text); rows without an id stay
    named = sorted({(int(i), t) for i, t in quality if i != "None"}, key=lambda x: (x[0], hashlib.sha256(x[1].encode()).digest()))
    root = list(range(len(named)))
    for i in range(len(named)):
        for j in range(i):
            if root[i] != root[j] and similar(named[i][1], named[j][1]):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    expected = sorted([(str(named[k][0]), named[k][1]) for k in set(root)] + [x for x in quality if x[0] == "None"])
    assert ids("SimHash near-dedup") == expected and len(expected) < len(quality) - 4
    # the mix takes documents of what was kept, none more than twice
    mixed = ids("mixing sources")
    assert set(mixed) <= set(expected) and all(mixed.count(x) <= 2 for x in set(mixed))
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    from cladeframe.llm import prefix_bpe

    library = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=prefix_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    ids_of = [(i, library.encode_ordinary(t), t) for i, t in mixed]
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((i, len(x), digest(" ".join(map(str, x)).encode()), digest(t.encode())) for i, x, t in ids_of)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in kept["byte-level BPE"].collect()) == want


def test_run_on_an_empty_table(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_mix_has_no_python_workers(spark):
    from cladeframe.llm import mixing
    from cladeframe.tables import small_table

    sizes = spark.createDataFrame([(s, 10 + k, k % 7, k % 5) for k in range(60) for s in ("web", None)], "source string, size long, block int, sub int")
    plan = mixing.Plan(spark, sizes, 1.5, 4, 11)
    tables = [plan.source_table(), plan.tickets(), plan.sub_table(), small_table(spark, [], "a long, b string"), small_table(spark, [(1, None), (2, None)], "a long, b string")]
    for t in tables:
        assert "PythonRDD" not in t._jdf.queryExecution().toRdd().toDebugString()
    assert [tuple(r) for r in tables[0].collect()] == list(zip(plan.sources, plan.sizes, plan.targets))
    assert tables[3].count() == 0 and [tuple(r) for r in tables[4].collect()] == [(1, None), (2, None)]


def test_a_worker_keeps_one_stage_s_tool():
    import weakref

    import public_tokenizers

    from cladeframe.llm import pieces, prefix_bpe

    path, pattern = public_tokenizers.path, public_tokenizers.PATTERN
    first = pieces.two_vocabularies(path("piece_bpe_32k.model"), path("byte_bpe_50k.tiktoken"), pattern)
    assert first is pieces.two_vocabularies(path("piece_bpe_32k.model"), path("byte_bpe_50k.tiktoken"), pattern)
    gone = weakref.ref(first)
    del first
    encoder = prefix_bpe.encoder(path("byte_bpe_50k.tiktoken"), pattern)
    assert gone() is None and encoder is prefix_bpe.encoder(path("byte_bpe_50k.tiktoken"), pattern)
