"""The queries of this subpackage, one for each operator, with production parameters, and the SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, digest_cache, ego, feistel, fertility, fim, lbl, mixing, nnpu, prefix_bpe, simhash, warc, winnow
from .common import new_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    path = public_tokenizers.path
    judged = fertility.judge(docs, path("piece_bpe_32k.model"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, row=["doc_id"])
    return judged.select("row.doc_id", *judged.columns[1:])


def op2_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts the table against an empty cache, which fills it, and again against the full one: the counts returned are the stored ones."""
    docs, cache = _table(spark, sf_dir, "documents").select("doc_id", "text"), new_path(spark, "token-counts")
    path = public_tokenizers.path("piece_bpe_32k.model")
    digest_cache.token_counts(docs, path, cache)
    return digest_cache.token_counts(docs, path, cache)


def op3_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.score(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nnpu.toxicity(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))


def op5_splitting_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.taken(docs).select("doc_id", "size", "source_size", "target", "taken", F.array_join("shards", ",").alias("shards"))


def op6_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return prefix_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), new_path(spark, "archives"))


def op10_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel.shard(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_bitset_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = _table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path
    return alignment.corpus_alignment(docs, path("byte_bpe_50k.json"), public_tokenizers.PATTERN, path("piece_bpe_32k.model"))


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("item_id", "text"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_fertility, op2_digest_cache, op3_log_bilinear, op4_nnpu, op5_splitting_tree, op6_prefix_bpe, op7_epsilon_grid, op8_simhash, op9_boundary_chain, op10_feistel, op11_bitset_alignment, op12_winnowing, op13_fill_in_middle)}


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(({' + '.join(f'(strpos({chr(39)}0123456789abcdef{chr(39)}, substr(h, {5 * k + j + 1}, 1)) - 1) * {16 ** (4 - j)}' for j in range(5))}) // {32 ** (3 - i)} % 32 AS INTEGER), 1)"
    for k in range(8)
    for i in range(4)
)

ORACLES = {
    "op7_epsilon_grid": """
WITH RECURSIVE v AS (
 SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id != b.vec_id AND list_dot_product(a.e, b.e) >= 0.95 * a.n * b.n),
r(node, hop) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.hop)
SELECT e.vec_id, CAST((SELECT COUNT(*) FROM l WHERE l.a = e.vec_id) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT node, MIN(hop) AS component_id FROM r GROUP BY node) c ON c.node = e.vec_id""",
    "op9_boundary_chain": f"""
WITH p AS (SELECT page_id, COALESCE(html, '') AS t, sha1(COALESCE(html, '')) AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest FROM p),
f AS (SELECT *, MIN(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
 CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f""",
    "op12_winnowing": """
WITH lower AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item AS (SELECT COALESCE(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
part AS (SELECT item_id, w, LEAST(10, len(w)) AS n, UNNEST(range(1, len(w) - LEAST(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS t FROM part),
place AS (SELECT r, w, n, UNNEST(range(1, len(w) - n + 2)) AS i FROM lower, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT r, place.n, i, item_id FROM place JOIN win ON win.n = place.n AND win.t = array_to_string(w[i : i + place.n - 1], ' ')),
words AS (SELECT r, COUNT(DISTINCT p) AS n_hit FROM (SELECT r, UNNEST(range(i, i + n)) AS p FROM hit) GROUP BY r),
ids AS (SELECT r, COUNT(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(s, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM lower LEFT JOIN words USING (r) LEFT JOIN ids USING (r)""",
    "op13_fill_in_middle": """
WITH t AS (SELECT doc_id, COALESCE(text, '') AS t, sha256('1:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, LEAST(h1 % (n + 1), h2 % (n + 1)) AS a, GREATEST(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
 ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END AS o FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(o) AS output_sha256, sha256(t) AS restored_sha256 FROM o""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
