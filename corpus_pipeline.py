"""The corpus pipeline: language ID, near-duplicates, repeated passages, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the last return the columns of
``documents``.  Decisions name documents by their doc_id; a row without one cannot be named and stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.llm import decontaminate, language_id, packing, simhash, suffix_dedup
from scrubline.llm.common import crc_of, stored, table
from scrubline.llm.queries import tokenizer

# a document whose best label has less mean probability than this is in none of the languages
LEAST_LANGUAGE_SCORE = 0.4
# near copies are looked for by fingerprints of shingles of so many words and of sets of words, then verified
FINGERPRINT_WORDS = 3


def _named(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    kept = docs.join(ids, docs["doc_id"] == ids["named_id"], how)
    return kept.select(*[docs[c] for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a learned language; texts without letters and texts of no clear language go."""
    net = language_id.train(docs, crc_of("doc_id") % 5 != 0)
    found = language_id.predict(docs, net, pred_col="__lang", score_col="__lang_score")
    return found.where(f"__lang <> 'und' AND __lang_score >= {LEAST_LANGUAGE_SCORE}").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near copies, once; near copies share 0.8 or more of their five-word shingles."""
    groups = simhash.verified_groups(docs, words_each=FINGERPRINT_WORDS)
    heads = groups.where("doc_id = component_id").select(F.col("doc_id").alias("named_id")).distinct()
    kept = _named(docs, heads, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id IS NULL"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of fifty bytes or more that a smaller document holds; documents with nothing left go."""
    found = suffix_dedup.remove_repeats(docs, texts_too=True, carry=tuple(docs.columns))
    untouched = F.col("n_removed") == 0
    text = F.when(untouched, F.col(f"carried_{docs.columns.index('text')}")).otherwise(F.col("kept_text"))
    columns = []
    for k, name in enumerate(docs.columns):
        value = text if name == "text" else F.col(f"carried_{k}")
        if name == "n_chars":
            value = F.when(untouched, value).otherwise(F.length(text)).cast(docs.schema[name].dataType)
        columns.append(value.alias(name))
    return found.where("n_removed = 0 OR n_removed < n_bytes").select(*columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    found = decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark"))
    return _named(docs, found.select(F.col("doc_id").alias("named_id")).distinct(), "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

# trained networks, token ids and suffix classes are not SQL; tests compare each stage with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
