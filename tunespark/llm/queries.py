"""Registered queries of the operators, over whole tables with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunespark.llm import bm25_search, byte_bpe, cover_tree, heap_lloyd, language_id, order_minhash, packing, prefix_trie, sharding, toxicity, url_filter, winnowing
from tunespark.llm.common import read


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op6_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(read(spark, sf_dir, "embeddings"), 0.9)


def op7_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return bm25_search.search(docs, docs.where(F.col("doc_id") % 100 == 0), 10)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = sharding.shard(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("ids")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = winnowing.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = heap_lloyd.compress(read(spark, sf_dir, "embeddings"))
    rows = heap_lloyd.with_label_error(coded)
    return rows.select("vec_id", "code", "error", "label_error", F.lit(heap_lloyd.digest(codebooks)).alias("codebooks_sha256"))


def _codes_sql(rounds: int) -> str:
    """Lloyd's rounds one after the other, every part compared with every entry."""
    nearest = """a{r} AS MATERIALIZED (
          SELECT row, v.p, any_value(v.x) AS x, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), j := c.j)) AS m
          FROM v JOIN c{r} c ON c.p = v.p GROUP BY row, v.p)"""
    update = """s{r} AS (SELECT p, j, list(y ORDER BY i) AS x FROM (
          SELECT p, j, i, CAST(floor(sum(y) / count(*)) AS BIGINT) AS y FROM (SELECT p, m.j AS j, unnest(x) AS y, unnest(range(len(x))) AS i FROM a{q}) GROUP BY p, j, i) GROUP BY p, j),
        c{r} AS MATERIALIZED (SELECT c.p, c.j, coalesce(s.x, c.x) AS x FROM c{q} c LEFT JOIN s{r} s ON s.p = c.p AND s.j = c.j)"""
    steps = [nearest.format(r=0)] + [x.format(r=r, q=r - 1) for r in range(1, rounds + 1) for x in (update, nearest)]
    return f"""
        WITH k AS MATERIALIZED (
          SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
          FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        v AS MATERIALIZED (SELECT row, p, e[p * (len(e) // 8) + 1 : (p + 1) * (len(e) // 8)] AS x FROM k, range(8) t(p)),
        c0 AS (SELECT p, row - 1 AS j, x FROM v WHERE row <= 16),
        {", ".join(steps)},
        t AS (SELECT row, string_agg(format('{{:02x}}', m.j), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY row),
        b AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, j, i)) AS h FROM (SELECT p, j, unnest(x) AS y, unnest(range(len(x))) AS i FROM c{rounds}))
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
        FROM k JOIN t ON t.row = k.row CROSS JOIN b"""


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_url_filter, op3_near_duplicates, op4_toxicity, op5_language_id, op6_embedding_duplicates, op7_top_k_search, op8_packing, op9_sharding, op10_byte_bpe, op11_decontamination, op12_vector_codes, op13_conversation_trie)}

ORACLE = {
    "op13_conversation_trie": """
        WITH t AS (
          SELECT conv_id, dense_rank() OVER (ORDER BY digest) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS i, size
          FROM (SELECT conv_id, turn, sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, length(coalesce(text, '')) AS size
                FROM conversations WHERE conv_id IS NOT NULL)),
        c AS (
          SELECT conv_id, xor(4294967295, list_reduce(flatten([[4294967295], flatten(list_transform(range(1, length(s) + 1), lambda i: [256 + ascii(s[i]), 0, 0, 0, 0, 0, 0, 0, 0]))]),
                 lambda c, o: CASE WHEN o >= 256 THEN xor(c, o - 256) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) % 6 AS h
          FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t)),
        b AS (SELECT c.conv_id, 0 AS own, t.i, t.x, t.size FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.i <= h
              UNION ALL SELECT c.conv_id, 1, t.i, t.x, t.size FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > h),
        q AS (SELECT c.conv_id, coalesce(list(x ORDER BY own, i) FILTER (WHERE x IS NOT NULL), []) AS path, coalesce(list(size ORDER BY own, i) FILTER (WHERE x IS NOT NULL), []) AS sizes
              FROM c LEFT JOIN b ON b.conv_id = c.conv_id GROUP BY c.conv_id),
        p AS (SELECT conv_id, len(path) AS whole, path[1 : d] AS path, d, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM q)),
        n AS MATERIALIZED (
          SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE whole = d), '')) AS ends
          FROM p GROUP BY path, d),
        k AS (SELECT path[1 : d - 1] AS path, count(*) AS n FROM n WHERE d > 0 GROUP BY 1),
        s AS (SELECT u.path[1 : j] AS path, sum(saved) AS saved, count(*) FILTER (WHERE leaf) AS leaves
              FROM (SELECT n.path, n.saved, k.n IS NULL AS leaf, unnest(range(n.d + 1)) AS j FROM n LEFT JOIN k ON k.path = n.path) u GROUP BY 1)
        SELECT n.conv_id, n.d AS depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
        FROM n JOIN s ON s.path = n.path LEFT JOIN k ON k.path = n.path LEFT JOIN n a ON n.d > 0 AND a.d = n.d - 1 AND a.path = n.path[1 : n.d - 1]""",
    "op12_vector_codes": _codes_sql(heap_lloyd.ROUNDS),
    "op2_url_filter": """
        WITH u AS (
          SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
          FROM pages),
        r(rule, says) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
        c AS (SELECT rule, says, split_part(rule, '/', 1) AS rhost, substr(rule, strpos(rule, '/')) AS rpath FROM r),
        best AS (
          SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says
          FROM (SELECT DISTINCT host, path FROM u) d
          JOIN c ON (d.host = rhost OR ends_with(d.host, '.' || rhost)) AND starts_with(d.path, rpath)
          GROUP BY host, path)
        SELECT page_id, u.host, u.path, rule, coalesce(says, 'allow') AS verdict
        FROM u LEFT JOIN best ON u.host = best.host AND u.path = best.path""",
    "op6_embedding_duplicates": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        w AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
        g AS (SELECT * FROM w WHERE norm > 0 AND isfinite(norm) AND len(list_filter(e, lambda x: x IS NULL)) = 0),
        l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
              AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
        r(x, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.y, r.c FROM r JOIN l ON r.x = l.x),
        m AS (SELECT x, min(c) AS c FROM r GROUP BY x),
        n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
        SELECT v.vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, v.vec_id = m.c AS kept
        FROM v JOIN m ON m.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id""",
    "op7_top_k_search": """
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS term FROM documents),
        f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
        len AS (SELECT doc_id, sum(tf) AS dl FROM f GROUP BY doc_id),
        s AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM len) / (SELECT count(*) FROM documents) AS mean),
        d AS (SELECT term, count(*) AS df FROM f GROUP BY term),
        h AS (
          SELECT q.doc_id AS query_id, f.doc_id, round(sum(q.tf * ln(1 + (n - df + 0.5) / (df + 0.5)) * f.tf * 2.2 / (f.tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
          FROM f q JOIN d USING (term) JOIN f ON f.term = q.term JOIN len ON len.doc_id = f.doc_id CROSS JOIN s
          WHERE q.doc_id % 100 = 0 GROUP BY ALL)
        SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h) WHERE rank <= 10""",
    "op11_decontamination": """
        WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        i AS (SELECT item_id, least(10, len(w)) AS size, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS f FROM b WHERE len(w) > 0),
        k AS (SELECT DISTINCT item_id, size, array_to_string(w[f : f + size - 1], ' ') AS words FROM i),
        s AS (SELECT DISTINCT size FROM k),
        x AS (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS f FROM d, s WHERE len(w) >= size),
        h AS (SELECT row, f, k.size, item_id FROM (SELECT row, f, size, array_to_string(w[f : f + size - 1], ' ') AS words FROM x) y JOIN k ON k.size = y.size AND k.words = y.words),
        c AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(f, f + size)) AS p FROM h) GROUP BY row),
        g AS (SELECT row, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS id FROM h WHERE item_id IS NOT NULL) GROUP BY row)
        SELECT doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(g.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN c ON c.row = d.row LEFT JOIN g ON g.row = d.row""",
}
