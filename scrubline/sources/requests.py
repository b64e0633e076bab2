"""Requests: tables of prompts, and scenario documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.functions.policy import DEFAULT_SKILL
from scrubline.functions.prompts import CONTEXT_PREFIX, QUESTION_SEPARATOR

REQUEST_SCHEMA = (
    "request_id long, ts string, actor string, role string, prompt string, skill string, "
    "model string, model_error string, upstream_status int, upstream_body string, "
    "audit_error string, latency_ms double"
)
SCENARIO_SCHEMA = (
    "title string, scenarios array<struct<id: string, label: string, skill: string, "
    "context: string, question: string, expect_blocked: boolean>>"
)


def fill_skill(df: DataFrame) -> DataFrame:
    """Requests that name no skill get the default one."""
    return df.withColumn("skill", F.coalesce("skill", F.lit(DEFAULT_SKILL)))


def read_requests(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read requests from parquet, ORC or JSON lines, with the default skill filled in."""
    return fill_skill(spark.read.schema(REQUEST_SCHEMA).format(fmt).load(path))


def scenario_prompt(context, question):
    return F.concat(F.lit(CONTEXT_PREFIX), context, F.lit(QUESTION_SEPARATOR), question)


def scenario_rows(documents: DataFrame) -> DataFrame:
    """One row per scenario of the documents, with its prompt built."""
    rows = documents.select("title", F.explode("scenarios").alias("s")).select("title", "s.*")
    return (
        fill_skill(rows)
        .withColumn("expect_blocked", F.coalesce("expect_blocked", F.lit(False)))
        .withColumn("prompt", scenario_prompt(F.col("context"), F.col("question")))
    )


BROKEN = "__broken"


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of any number of lines, one or a list of them a file, with what could not be read and where it lies."""
    read = spark.read.schema(f"{SCENARIO_SCHEMA}, {BROKEN} string").option("multiLine", True).option("mode", "PERMISSIVE")
    rows = read.option("columnNameOfCorruptRecord", BROKEN).option("recursiveFileLookup", True).json(path)
    return rows.select("title", "scenarios", BROKEN, F.col("_metadata.file_path").alias("path"))


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """The scenarios of JSON documents that may run over several lines; see also :func:`broken_scenarios`."""
    return scenario_rows(_documents(spark, path).where(F.col(BROKEN).isNull()))


def broken_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Documents that :func:`read_scenarios` leaves out: ``path``, ``reason`` and the ``text`` where that is no JSON of the schema.

    The reason is ``no JSON`` or ``no scenarios``; a document with an empty list of scenarios is neither.
    """
    documents = _documents(spark, path)
    reason = F.when(F.col(BROKEN).isNotNull(), F.lit("no JSON")).when(F.col("scenarios").isNull(), F.lit("no scenarios"))
    return documents.select("path", reason.alias("reason"), F.col(BROKEN).alias("text")).where("reason IS NOT NULL")
