"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat_quotes, exact_topk, html_wrapper, langid, packing, quality, simhash, token_cache
from .common import read, shared_dir


def op1_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document; links at 3 or fewer differing bits."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), radius=3)


def op2_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return html_wrapper.extract(read(spark, sf_dir, "pages"))


def op3_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: 5 nearest found by cosine of each vector whose id 50 divides."""
    return ann.nearest(read(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of decoded bytes of every document."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op5_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return quality.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, cached of every document. The first call finds an empty cache and encodes
    each distinct text once; the second, whose rows these are, finds all counts stored. A production caller passes a
    lasting folder."""
    cache, path = f"{shared_dir(spark)}/token_cache/{uuid.uuid4().hex}", public_tokenizers.path("piece_bpe_32k.model")
    docs = read(spark, sf_dir, "documents")
    token_cache.count_tokens(docs, path, cache)
    return token_cache.count_tokens(docs, path, cache, limit=4096, with_cached=True)


def op7_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    return langid.identify(read(spark, sf_dir, "documents"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: 5 highest integer inner products of each vector whose id 50 divides."""
    return exact_topk.exact_top_k(read(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5, scale=256.0)


def op9_variable_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin of every piece of every document, by piece_bpe_32k tokens."""
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without its quotes, with its thread."""
    return chat_quotes.format_conversations(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_bktree": op1_simhash_bktree,
    "op2_wrapper_induction": op2_wrapper_induction,
    "op3_learned_partitions": op3_learned_partitions,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_rule_ensemble": op5_rule_ensemble,
    "op6_token_counts": op6_token_counts,
    "op7_centroids": op7_centroids,
    "op8_exact_topk": op8_exact_topk,
    "op9_variable_bins": op9_variable_bins,
    "op10_quotation_linking": op10_quotation_linking,
}

#: The others cannot be expressed in SQL; tests/llm hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op8_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op10_quotation_linking": r"""
        WITH RECURSIVE m AS (
            SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
        ), l0 AS (
            SELECT rid, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM (SELECT rid, string_split_regex(text, '\r\n|\n|\r') AS lines FROM m)
        ), l1 AS (
            SELECT *, len(regexp_replace(regexp_extract(line, '^[ \t]*(?:>[ \t]?)+'), '[^>]', '', 'g')) AS lv FROM l0
        ), l AS (
            SELECT *, coalesce(lead(lv) OVER (PARTITION BY rid ORDER BY pos), 0) AS nxt,
                   regexp_matches(line, '^[ \t]*(?:On\b.{0,300}\bwrote|.{1,200}\bwrote|.{1,200}\bschrieb|.{1,200}\ba écrit|.{1,200}\bescribió)[ \t]*:[ \t]*$') AS says FROM l1
        ), own AS (
            SELECT rid, line, pos FROM l WHERE lv = 0 AND NOT (says AND nxt > 0)
        ), body AS (
            SELECT m.rid, conv_id, turn, coalesce(string_agg(line, chr(10) ORDER BY pos), '') AS body FROM m LEFT JOIN own USING (rid) GROUP BY ALL
        ), unit AS (
            SELECT conv_id, turn, body AS x FROM body UNION ALL SELECT conv_id, turn, unnest(string_split_regex(body, '\n[ \t]*\n')) FROM body
            UNION ALL SELECT conv_id, turn, line FROM own JOIN m USING (rid)
        ), origin AS (
            SELECT conv_id, lower(trim(regexp_replace(x, '\s+', ' ', 'g'))) AS norm, min(turn) AS quoted FROM unit WHERE turn IS NOT NULL AND conv_id IS NOT NULL GROUP BY ALL
        ), runs AS (
            SELECT rid, pos, lv, regexp_replace(line, '^[ \t]*(?:>[ \t]?)+', '') AS b, sum(begins) OVER (PARTITION BY rid ORDER BY pos) AS passage FROM (
                SELECT *, CASE WHEN lv = lag(lv) OVER (PARTITION BY rid ORDER BY pos) THEN 0 ELSE 1 END AS begins FROM l)
        ), asked AS (
            SELECT rid, passage, lv, -1 AS li, string_agg(b, chr(10) ORDER BY pos) AS x FROM runs WHERE lv > 0 GROUP BY rid, passage, lv
            UNION ALL SELECT rid, passage, lv, row_number() OVER (PARTITION BY rid, passage ORDER BY pos) - 1, b FROM runs WHERE lv > 0
        ), linked AS (
            SELECT m.conv_id, m.turn, lv, passage, first(quoted ORDER BY li) AS quoted FROM asked JOIN m USING (rid)
            JOIN origin o ON o.conv_id = m.conv_id AND o.norm = lower(trim(regexp_replace(x, '\s+', ' ', 'g'))) AND o.norm <> '' AND quoted < m.turn GROUP BY ALL
        ), parent AS (
            SELECT conv_id, turn, first(quoted ORDER BY lv, passage) AS reply_to FROM linked GROUP BY ALL
        ), up AS (
            SELECT conv_id, turn, reply_to AS root, CAST(1 AS BIGINT) AS depth FROM parent
            UNION ALL SELECT up.conv_id, up.turn, p.reply_to, up.depth + 1 FROM up JOIN parent p ON p.conv_id = up.conv_id AND p.turn = up.root
        ), tree AS (
            SELECT conv_id, turn, last(root ORDER BY depth) AS root, max(depth) AS depth FROM up GROUP BY ALL
        ), q AS (SELECT rid, count(*) FILTER (WHERE lv > 0) AS n_quoted FROM l GROUP BY rid
        ), t AS (SELECT rid, regexp_replace(body, '^\s+|\s+$', '', 'g') AS text FROM body)
        SELECT m.conv_id, m.turn, m.role, t.text, p.reply_to, coalesce(tree.root, m.turn) AS thread_root, coalesce(tree.depth, 0) AS depth, n_quoted,
               '<|' || m.role || '|>' || chr(10) || t.text || chr(10) || '<|end|>' AS formatted
        FROM m JOIN t USING (rid) JOIN q USING (rid) LEFT JOIN parent p ON p.conv_id = m.conv_id AND p.turn = m.turn LEFT JOIN tree ON tree.conv_id = m.conv_id AND tree.turn = m.turn
    """,
}
