"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from depthline.llm import hard_negatives, language_codes, mixing, multi_index, order_minhash, pii, prefix_trie, quality_model, quality_rules, sentence_pieces, template_text, token_blocks, url_filter


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.token_report(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_text.main_texts(_table(spark, sf_dir, "pages"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(_table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicate_report(_table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.piece_report(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_codes.language_ids(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_embedding_near_dedup, op2_token_files, op3_html_extraction, op4_url_filter, op5_pii, op6_mixing, op7_quality_rules, op8_minhash_near_dedup, op9_sentencepiece, op10_quality_classifier, op11_conversation_trie, op12_hard_negatives, op13_language_id)
}

ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM good a JOIN good b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS u, vec_id AS w FROM v
  UNION
  SELECT r.u, l.w FROM reach r JOIN link l ON r.w = l.u
), comp AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM link GROUP BY u)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, comp.component_id, v.vec_id = comp.component_id AS kept
FROM v LEFT JOIN n ON n.u = v.vec_id JOIN comp ON comp.u = v.vec_id
""",
    "op7_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), rep AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), s AS (
  SELECT w.doc_id, t, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(cov.n, 0) AS n_repeat_words
  FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id
), r AS (
  SELECT doc_id, n_words, word_chars, n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    length(regexp_replace(t, '\P{Lu}+', '', 'g')) / greatest(length(regexp_replace(t, '[^\p{Lu}\p{Ll}]+', '', 'g')), 1) AS upper_share
  FROM s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 100 > n_words * 10 OR n_dup_lines * 100 > n_lines * 50
    OR word_chars < n_words * 2.0 OR word_chars > n_words * 12.0 OR upper_share > 0.45) AS kept
FROM r
""",
    "op11_conversation_trie": r"""
WITH t AS (
  SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (SELECT conv, count(*) AS n FROM t GROUP BY conv),
plan AS (
  SELECT conv, n, conv - conv % 5 AS base,
    xor(list_reduce(list_transform(string_split(CAST(conv AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda a, b: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, b)),
      4294967295::BIGINT), 4294967295::BIGINT) % 9 AS h
  FROM own
), cut AS (SELECT p.*, least(h, coalesce(o.n, 0)) AS head FROM plan p LEFT JOIN own o ON o.conv = p.base),
turns AS (
  SELECT c.conv, t.i, t.role, t.text FROM cut c JOIN t ON t.conv = c.base AND t.i <= c.head
  UNION ALL
  SELECT c.conv, c.head + t.i - c.h, t.role, t.text FROM cut c JOIN t ON t.conv = c.conv AND t.i > c.h
), path AS (
  SELECT conv, i AS d, octet_length(encode(text)) AS bytes,
    md5(string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv ORDER BY i)) AS p
  FROM turns
  UNION ALL SELECT conv, 0, 0, '' FROM cut
), ended AS (SELECT conv, max(d) AS size FROM path GROUP BY conv),
node AS (
  SELECT d, p, min(conv) AS conv, count(*) AS n, max(size) > d AS inner_node, (count(*) - 1) * max(bytes) AS saved,
    sha256(coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (d = size), '')) AS ends
  FROM path JOIN ended USING (conv) GROUP BY d, p
), below AS (
  SELECT x.d, x.p, sum(CASE WHEN u.inner_node THEN 0 ELSE 1 END) AS leaves, sum(u.saved) AS saved, sum(CASE WHEN u.d = x.d + 1 THEN 1 ELSE 0 END) AS kids
  FROM node u JOIN path x ON x.conv = u.conv AND x.d <= u.d GROUP BY x.d, x.p
), up AS (SELECT x.conv, x.d + 1 AS d, n.conv AS parent FROM path x JOIN node n ON n.d = x.d AND n.p = x.p)
SELECT n.conv AS conv_id, CAST(n.d AS BIGINT) AS depth, up.parent AS parent_conv_id, n.n AS n_convs, CAST(b.kids AS BIGINT) AS n_children,
  CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM node n JOIN below b ON b.d = n.d AND b.p = n.p LEFT JOIN up ON up.conv = n.conv AND up.d = n.d
""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS u, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.u AS au, a.vec_id AS anchor_id, b.u AS bu, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.u <> b.u AND len(a.e) = len(b.e)
), p AS (
  SELECT au, anchor_id, bu AS pu, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY au ORDER BY score DESC, other) <= 5
), n AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.au, p.pu ORDER BY s.score DESC, s.other) AS rank,
    s.other AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s ON s.au = p.au AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
""",
}
