"""One query a training-data operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from contigua.llm import chat, compaction, conversation_repair, decontaminate, kneser_ney, knn, mixing, pattern_packing, simhash, suffix_dedup, token_counts, vector_codes, warc
from contigua.llm.common import scratch, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.knn_join(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, manifest).withColumnRenamed("id", "page_id").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(mixing.sizes_of(table(spark, sf_dir, "documents")))
    return plan.selectExpr("doc_id", "size", "source_size", "target", "copies * size AS taken", "copies")


def op9_quality_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with what it decided on."""
    found = kneser_ney.classify(table(spark, sf_dir, "documents"), kneser_ney.trusted_ids(table(spark, sf_dir, "labels")))
    return found.filter("keep").selectExpr("doc AS doc_id", "lang", "n_words", "perplexity", "most", "keep")


def op10_compact_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.shard(table(spark, sf_dir, "documents"))


def op11_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pattern_packing.cut_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pattern_packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = vector_codes.train(vectors)
    found = vector_codes.with_label_error(vector_codes.encode(vectors, books))
    return found.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.digests(conversation_repair.damaged(conversation_repair.plain(table(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Query]:
    found = [op1_token_counts, op2_knn_join, op3_warc, op4_simhash_dedup, op5_chat_format, op6_decontaminate, op7_suffix_dedup, op8_mix_sources, op9_quality_kneser_ney, op10_compact_shards, op11_pattern_packing, op12_vector_codes, op13_conversation_repair]
    return {f.__name__: f for f in found}


#: The five-bit digits of 20 bits (five hexadecimal digits) at a time.
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (CAST('0x' || substr(s, i // 4 * 5 + 1, 5) AS BIGINT) >> (15 - i % 4 * 5)) % 32 + 1, 1)), '')"

_SQL = {
    "op2_knn_join": (
        "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings"
        " WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),"
        " s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)"
        " SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5"
    ),
    "op3_warc": (
        "WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS s FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS first FROM d)"
        f" SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM m"
    ),
}


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL expresses; the others' tests hold them against brute force."""
    return dict(_SQL)
