"""A query per operator over its whole table, with the SQL it is checked against where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.staging import scratch_folder
from . import (
    decontamination,
    exact_dedup,
    html_extraction,
    language_model,
    licenses,
    mixing,
    prefix_trie,
    quality,
    secrets,
    simhash,
    token_alignment,
    token_files,
    toxicity,
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf_dir))


def tokenizer_file() -> str:
    """The vocabulary that the queries use; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "token-files")  # only what is read back leaves this query
    files = token_files.write_token_files(documents(spark, sf_dir), folder, tokenizer_file())
    return token_files.read_token_files(files)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score_quality(docs, quality.train_quality(docs, labels(spark, sf_dir)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels(spark, sf_dir)))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(documents(spark, sf_dir))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(conversations(spark, sf_dir))


def piece_file() -> str:
    """The other vocabulary that is aligned with the first."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(documents(spark, sf_dir), tokenizer_file(), piece_file())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_quality": op2_quality,
    "op3_language_model": op3_language_model,
    "op4_mixing": op4_mixing,
    "op5_decontamination": op5_decontamination,
    "op6_token_files": op6_token_files,
    "op7_simhash": op7_simhash,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_secrets": op9_secrets,
    "op10_toxicity": op10_toxicity,
    "op11_license_scan": op11_license_scan,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {
    "op8_exact_dedup": r"""
        WITH forms AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS form
            FROM documents
        ), groups AS (
            SELECT form, min(doc_id) AS keep_id, count(*) AS group_size FROM forms GROUP BY form
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(form) AS text_sha256
        FROM forms JOIN groups USING (form)
    """,
    "op12_prefix_trie": r"""
        WITH RECURSIVE turns AS (
            SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
                dense_rank() OVER (ORDER BY coalesce(role, ''), coalesce(text, '')) AS letter
            FROM conversations WHERE conv_id IS NOT NULL
        ), ids AS (
            SELECT c, CAST(c AS VARCHAR) AS s, count(*) AS n FROM turns GROUP BY c
        ), crc(c, s, i, v) AS (
            SELECT c, s, 0, CAST(4294967295 AS BIGINT) FROM ids
            UNION ALL
            SELECT c, s, i + 1, CASE WHEN w & 1 = 1 THEN xor(w >> 1, CAST(3988292384 AS BIGINT)) ELSE w >> 1 END
            FROM (SELECT c, s, i,
                    CASE WHEN i % 8 = 0 THEN xor(v, CAST(ascii(substr(s, i // 8 + 1, 1)) AS BIGINT)) ELSE v END AS w
                FROM crc WHERE i < 8 * length(s))
        ), heads AS (
            SELECT c, c - c % 5 AS b, xor(v, CAST(4294967295 AS BIGINT)) % 9 AS h FROM crc WHERE i = 8 * length(s)
        ), rebuilt AS (
            SELECT heads.c, t.pos AS d, t.letter, t.text FROM heads JOIN turns t ON t.c = heads.b WHERE t.pos <= h
            UNION ALL
            SELECT heads.c, least(h, coalesce(base.n, 0)) + t.pos - h, t.letter, t.text
            FROM heads JOIN turns t ON t.c = heads.c LEFT JOIN ids base ON base.c = heads.b WHERE t.pos > h
        ), members AS (
            SELECT c, d, list(letter) OVER (PARTITION BY c ORDER BY d) AS path, octet_length(encode(text)) AS bytes,
                d = max(d) OVER (PARTITION BY c) AS ends
            FROM rebuilt
            UNION ALL
            SELECT c, 0, [], 0, c NOT IN (SELECT c FROM rebuilt) FROM ids
        ), nodes AS (
            SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
                sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
            FROM members GROUP BY d, path
        ), children AS (
            SELECT d - 1 AS d, path[1:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
        ), above AS (
            SELECT unnest(range(0, d + 1)) AS k, path, (n_convs - 1) * bytes AS saved,
                CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf
            FROM nodes LEFT JOIN children USING (d, path)
        ), subtrees AS (
            SELECT k AS d, path[1:k] AS path, sum(saved) AS saved_tokens, sum(leaf) AS n_leaves FROM above GROUP BY ALL
        )
        SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs,
            coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
            CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM nodes n JOIN subtrees USING (d, path) LEFT JOIN children USING (d, path)
            LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]
    """,
}
