"""One query per operator over its whole table, with production parameters, and the SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.llm import (
    best_fit,
    context_mixing,
    conversation_repair,
    decontaminate,
    language_id,
    packing,
    periodic_runs,
    quality,
    simhash,
    structure_sql,
    suffix_dedup,
    token_counts,
    topk,
    warc,
)
from scrubline.llm.common import crc_of, table


def tokenizer(name: str) -> str:
    """The file of a public tokenizer; it lies at the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_of("doc_id") % 4 == 2
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_of("doc_id") % 5 == 0
    net = language_id.train(docs, ~held_out)
    whole = docs.select("doc_id", "text", held_out.alias("held_out"))
    return language_id.predict(whole, net).select("doc_id", "held_out", "lang_pred", "score")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(periodic_runs.with_planted_runs(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")), present_col="present")


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op2_warc": op2_warc,
    "op3_decontaminate": op3_decontaminate,
    "op4_context_mixing": op4_context_mixing,
    "op5_quality": op5_quality,
    "op6_token_counts": op6_token_counts,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_curve_packing": op8_curve_packing,
    "op9_simhash": op9_simhash,
    "op10_language_id": op10_language_id,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_best_fit": op13_best_fit,
}

# DuckDB twins. The other queries have none: training, tokenizers and 64-bit shingle hashes are not SQL,
# and exact token overlaps or 50-byte windows are too slow there; tests compare those with brute force.
ORACLE_SQL = {
    "op1_exact_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.ints, b.ints), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v q JOIN v b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op2_warc": """
        WITH p AS (
          SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY ALL)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
          CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN first_id < page_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)""",
    "op11_periodic_runs": structure_sql.PERIODIC_RUNS,
    "op12_conversation_repair": structure_sql.CONVERSATION_REPAIR,
}
