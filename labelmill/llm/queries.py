"""The registered queries of the language-model data operators: name -> (query, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.llm import (
    exact_dedup,
    language_id,
    lm_scores,
    near_dedup,
    packing,
    prefix_trie,
    quality_rules,
    sentencepieces,
    substring_dedup,
    suffix_dedup,
    token_counts,
    url_filters,
    whitening,
)
from labelmill.llm.ship import ship


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents")).drop("row_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.score(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


# The rules of the URL query.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Pages whose id this divides are reported pages; their URLs are the list.
REPORTED = 7


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is judged; the list is the URLs of reported pages, which no pattern of hosts gives."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(F.col("page_id") % REPORTED == 0).select("url")
    return url_filters.filter_urls(pages, listed, RULES)


OP5_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM parts),
split AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(coalesce(rest, ''), length(raw) + 1), '^[^?#]*') AS path
  FROM hosts),
pages_c AS (SELECT *, CASE WHEN host <> '' THEN host || rtrim(path, '/') END AS canonical FROM split),
known AS (SELECT DISTINCT canonical FROM pages_c WHERE page_id % 7 = 0 AND canonical IS NOT NULL),
rules(kind, rule, name, rest) AS (VALUES
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'),
  ('block', 'com/de/', 'com', '/de/')),
fits AS (
  SELECT p.page_id, p.host, p.path, p.canonical, r.kind, r.rule,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS nth
  FROM pages_c p LEFT JOIN rules r
    ON (p.host = r.name OR ends_with(p.host, '.' || r.name)) AND starts_with(p.path, r.rest))
SELECT f.page_id, f.host, f.path, f.rule,
       coalesce(f.kind, CASE WHEN k.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       k.canonical IS NOT NULL AS listed
FROM fits f LEFT JOIN known k ON k.canonical = f.canonical WHERE f.nth = 1"""

OP2_SQL = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
ranked AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS nth,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM texts WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id))
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, text_sha256 FROM ranked"""


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lists AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM lists WHERE len(w) >= 50)),
owned AS (SELECT h, min(doc_id) AS owner FROM windows GROUP BY h),
late AS (
  SELECT w.doc_id, list(w.p) AS ps FROM windows w JOIN owned o USING (h) WHERE o.owner < w.doc_id GROUP BY w.doc_id),
gone AS (
  SELECT doc_id, list(DISTINCT q) AS qs
  FROM (SELECT doc_id, unnest(range(p, p + 50)) AS q FROM (SELECT doc_id, unnest(ps) AS p FROM late)) GROUP BY doc_id),
words AS (SELECT l.doc_id, l.w, coalesce(g.qs, []) AS qs FROM lists l LEFT JOIN gone g USING (doc_id)),
kept AS (
  SELECT doc_id, coalesce(string_agg(word, ' ' ORDER BY i), '') AS text
  FROM (SELECT l.doc_id, unnest(l.w) AS word, unnest(range(1, len(l.w) + 1)) AS i FROM lists l) x
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(qs) AS q FROM gone) g WHERE g.doc_id = x.doc_id AND g.q = x.i)
  GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, CAST(len(w.qs) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids again, and digest both."""
    path = vocabulary("piece_bpe_32k.model")
    both = sentencepieces.encode_and_decode(table(spark, sf_dir, "documents"), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.crc32(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary")).alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "round_trip",
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_by_labels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
codes AS (SELECT row, doc_id, strlen(text) AS n_bytes, hex(encode(text)) AS code FROM texts),
blocks AS (
  SELECT row, s, least(s + 256, n_bytes - 398) AS e, substr(code, CAST(2 * s - 1 AS BIGINT), 1310) AS code
  FROM (SELECT row, n_bytes, code, unnest(range(1, n_bytes - 398, 256)) AS s FROM codes WHERE n_bytes >= 400)),
windows AS (
  SELECT row, p, md5(substr(code, CAST(2 * (p - s) + 1 AS BIGINT), 800)) AS h
  FROM (SELECT row, s, code, unnest(range(s, e)) AS p FROM blocks)),
twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
hits AS (SELECT w.row, w.p FROM windows w JOIN twice t USING (h)),
steps AS (SELECT row, p, p - lag(p) OVER (PARTITION BY row ORDER BY p) AS gap FROM hits),
parts AS (SELECT row, p, sum(CASE WHEN gap <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY row ORDER BY p) AS part FROM steps),
spans AS (SELECT row, part, min(p) AS a, max(p) + 399 AS b FROM parts GROUP BY row, part),
pieces AS (
  SELECT row, a, b, lag(b, 1, 0) OVER (PARTITION BY row ORDER BY a) AS before FROM spans),
kept AS (
  SELECT c.row, count(*) AS n_spans, sum(p.b - p.a + 1) AS n_removed,
         string_agg(substr(c.code, CAST(2 * p.before + 1 AS BIGINT), CAST(2 * (p.a - 1 - p.before) AS BIGINT)), '' ORDER BY p.a)
           || substr(any_value(c.code), CAST(2 * max(p.b) + 1 AS BIGINT)) AS code
  FROM pieces p JOIN codes c USING (row) GROUP BY c.row)
SELECT c.doc_id, CAST(c.n_bytes AS BIGINT) AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(k.n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.code, c.code))) AS kept_sha256
FROM codes c LEFT JOIN kept k USING (row)"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_nodes(table(spark, sf_dir, "conversations"))


# crcs: CRC-32 of the decimal digits by its definition, eight shifts a character
OP13_SQL = """
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
           sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT DISTINCT conv_id FROM own),
crc_steps AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS s FROM convs),
crcs AS (
  SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
           flatten(list_transform(range(1, length(s) + 1), lambda i: list_concat([-1 - CAST(ascii(substr(s, i, 1)) AS BIGINT)],
             [-1000, -1000, -1000, -1000, -1000, -1000, -1000, -1000])))),
           lambda a, x: CASE WHEN x > -1000 THEN xor(a, -1 - x)
                             WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) AS crc
  FROM crc_steps),
heads AS (SELECT conv_id, crc % 9 AS h FROM crcs),
rebuilt AS (
  SELECT h.conv_id, o.role, o.text, 0 AS part, o.pos
  FROM heads h JOIN own o ON o.conv_id = h.conv_id - h.conv_id % 5 AND o.pos <= h.h
  UNION ALL
  SELECT h.conv_id, o.role, o.text, 1, o.pos FROM heads h JOIN own o ON o.conv_id = h.conv_id AND o.pos > h.h),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth,
         sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text) AS turn, strlen(text) AS bytes
  FROM rebuilt),
paths AS (
  SELECT conv_id, depth, bytes, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
lengths AS (SELECT conv_id, max(depth) AS n FROM paths GROUP BY conv_id),
members AS (
  SELECT p.conv_id, p.depth, p.bytes, sha256(p.path) AS node,
         CASE WHEN p.depth > 0 THEN sha256(substr(p.path, 1, CAST(64 * (p.depth - 1) AS BIGINT))) END AS parent, p.depth = l.n AS ends
  FROM paths p JOIN lengths l USING (conv_id)),
nodes AS (
  SELECT depth, node, any_value(parent) AS parent, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY depth, node),
children AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
counted AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (depth, node)),
below AS (
  SELECT a.depth, a.node, sum((n.n_children = 0)::BIGINT) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved_tokens
  FROM counted n JOIN members a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY 1, 2)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children,
       CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM counted n JOIN below b USING (depth, node) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.parent"""


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_near_dedup": (op1_near_dedup, None),
    "op2_exact_dedup": (op2_exact_dedup, OP2_SQL),
    "op3_lm_scores": (op3_lm_scores, None),
    "op4_packing": (op4_packing, None),
    "op5_url_filters": (op5_url_filters, OP5_SQL),
    "op6_substring_dedup": (op6_substring_dedup, OP6_SQL),
    "op7_token_counts": (op7_token_counts, None),
    "op8_sentencepiece": (op8_sentencepiece, None),
    "op9_language_id": (op9_language_id, None),
    "op10_quality_rules": (op10_quality_rules, None),
    "op11_embedding_whitening": (op11_embedding_whitening, None),
    "op12_suffix_dedup": (op12_suffix_dedup, OP12_SQL),
    "op13_prefix_trie": (op13_prefix_trie, OP13_SQL),
}
