"""The registered queries of the corpus operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import ball_kmeans, bpe, chat_format, hash_forest, language_id, license_scan, line_dedup, mixing, ngram_jaccard, secret_scan, token_counts, topk_search, vector_codes
from .common import fresh_path, table, written

Query = Callable[[SparkSession, str], DataFrame]


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.exact_top_k(table(spark, sf_dir, "embeddings")).drop("scored")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.ngram_jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text lines of every page, without its host's boilerplate."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", line_dedup.html_lines(F.col("html")).alias("text"))
    return line_dedup.line_dedup(written(pages, "page-lines"), text_col="text", min_pages=line_dedup.MIN_PAGES).drop("url")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, counted in flat files that hold nothing but ids and separators."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    folder = fresh_path(spark, "tokens")
    end = max(rank for _, rank in bpe.load_ranks(path)) + 1  # the first id that the vocabulary leaves free
    manifest = token_counts.write_token_files(table(spark, sf_dir, "documents"), folder, lambda texts: bpe.encode_texts(texts, path, pattern), end)
    counts = token_counts.token_counts(spark, folder, end)
    return manifest.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.nearest(table(spark, sf_dir, "embeddings"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep=["doc_id"])


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.cluster(table(spark, sf_dir, "embeddings")).drop("compared")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_topk_search, op2_ngram_jaccard, op3_license_scan, op4_language_id, op5_line_dedup, op6_chat_format, op7_token_counts,
        op8_mixing, op9_hash_forest, op10_bpe, op11_secret_scan, op12_vector_codes, op13_ball_kmeans,
    )
}

_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)"
#: Exact floor of a quotient, for a negative sum too.
_MEAN = "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"


def _op12_sql() -> str:
    """Each round's assignment and codebooks as tables of their own."""
    parts, entries = vector_codes.PARTS, vector_codes.ENTRIES
    steps = [f"""k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({vector_codes.SCALE} * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND {_WHOLE})""",
        f"p AS MATERIALIZED (SELECT r, j, v[j * len(v) // {parts} + 1 : (j + 1) * len(v) // {parts}] AS s FROM k, range({parts}) t(j))",
        f"c0 AS (SELECT j, e, s FROM p JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < {entries}) USING (r))"]
    for i in range(vector_codes.ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, j, any_value(p.s) AS s, min({{'d': CAST(list_sum(list_transform(list_zip(p.s, c.s), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS BIGINT), 'e': e}}) AS m
  FROM p JOIN c{i} c USING (j) GROUP BY r, j)""")
        if i < vector_codes.ROUNDS:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT j, e, coalesce(n.s, c.s) AS s FROM c{i} c LEFT JOIN (SELECT j, e, list(y ORDER BY i) AS s
  FROM (SELECT j, m.e AS e, i, CAST({_MEAN} AS BIGINT) AS y FROM (SELECT j, m, unnest(s) AS x, unnest(range(len(s))) AS i FROM a{i}) GROUP BY 1, 2, 3) GROUP BY 1, 2) n USING (j, e))""")
    last = vector_codes.ROUNDS
    return f"""WITH {", ".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY j, e)) AS codebooks_sha256 FROM c{last}),
f AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY j) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{last} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f JOIN k USING (r), h"""


def _op13_sql() -> str:
    width, last = ball_kmeans.WIDTH, ball_kmeans.ROUNDS
    steps = [f"""k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({ball_kmeans.SCALE} * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {width} AND {_WHOLE})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS e, v AS s FROM k QUALIFY e < {ball_kmeans.CLUSTERS})"]
    for i in range(last + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, any_value(k.v) AS v, min({{'d': CAST(list_sum(list_transform(list_zip(k.v, c.s), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS BIGINT), 'e': e}}) AS m
  FROM k, c{i} c GROUP BY r)""")
        if i < last:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT e, coalesce(n.s, c.s) AS s FROM c{i} c LEFT JOIN (SELECT e, list(y ORDER BY i) AS s
  FROM (SELECT m.e AS e, i, CAST({_MEAN} AS BIGINT) AS y FROM (SELECT m, unnest(v) AS x, unnest(range({width})) AS i FROM a{i}) GROUP BY 1, 2) GROUP BY 1) n USING (e))""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(m.e AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.e) AS BIGINT) AS cluster_inertia,
  CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.s, ',')) AS centroid_sha256 FROM a{last} JOIN k USING (r) JOIN c{last} c ON c.e = m.e"""


_HTML_LINES = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>', '', 'gis'),
  '</?(?:p|div|li|ul|ol|nav|article|section|header|footer|aside|main|h[1-6]|br|hr|tr|td|th|table|pre|blockquote|body|html)\b[^>]*>', chr(10), 'gi'),
  '<[^>]*>', '', 'g'), '[ \t\r]*\n\s*', chr(10), 'g'), ' ' || chr(9) || chr(13) || chr(10))"""

ORACLES: dict[str, str] = {
    "op1_topk_search": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
  FROM e q JOIN e x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
    "op2_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS raw FROM documents),
l AS (SELECT doc_id, list_transform(raw, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM w),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [1] ELSE range(1, len(ws) - 3) END) AS i FROM l)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b FROM (SELECT a.doc_id AS x_id, b.doc_id AS y_id, count(*) AS common FROM s a JOIN s b USING (g)
    WHERE a.doc_id <> b.doc_id GROUP BY 1, 2) c JOIN n x ON x.doc_id = x_id JOIN n y ON y.doc_id = y_id WHERE 100 * common >= 80 * (x.n + y.n - common)),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY 1) m USING (doc_id)""",
    "op3_license_scan": license_scan.oracle(),
    "op5_line_dedup": rf"""
WITH p AS (SELECT page_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') AS host, {_HTML_LINES} AS text FROM pages),
t AS (SELECT host, count(DISTINCT page_id) AS n FROM p WHERE host IS NOT NULL GROUP BY 1),
l AS (SELECT page_id, host, text, i, lines[i] AS line, trim(lines[i], ' ' || chr(9) || chr(13)) AS key
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS lines FROM p))),
b AS (SELECT host, key FROM l JOIN t USING (host) WHERE key <> '' GROUP BY host, key, t.n
  HAVING count(DISTINCT page_id) >= {line_dedup.MIN_PAGES} AND count(DISTINCT page_id) > {line_dedup.MAX_RATIO} * t.n)
SELECT l.page_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (b.key IS NULL), '') AS text,
  CAST(count(b.key) AS INTEGER) AS lines_dropped
FROM l LEFT JOIN b ON l.host = b.host AND l.key = b.key GROUP BY l.page_id""",
    "op6_chat_format": f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
  '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS said,
  coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n') || chr(2) AS own FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT *, string_agg(own, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS so_far FROM t),
w AS (SELECT conv_id, max(pos) AS n_turns, arg_max(so_far, pos) AS whole FROM s GROUP BY 1),
k AS (SELECT w.conv_id, w.n_turns FROM w WHERE NOT EXISTS (SELECT 1 FROM s JOIN w o USING (conv_id)
  WHERE s.so_far = w.whole AND (o.n_turns > s.pos OR o.conv_id < w.conv_id)))
SELECT conv_id, (pos - 1) // {chat_format.PIECE} AS part, n_turns, string_agg(said, '' ORDER BY pos) AS text
FROM t JOIN k USING (conv_id) GROUP BY 1, 2, 3""",
    "op12_vector_codes": _op12_sql(),
    "op13_ball_kmeans": _op13_sql(),
}
