"""Inputs of the registered queries, derived from the given tables.

The tables at hand hold no notes, requests or audit rows, so those are written
from order, event and customer rows: every row gives one, and its content varies
with the row's keys.  Expressions both SQL dialects accept are shared with the
oracle; everything else is stated separately on each side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.functions.rules import ENTITY_TYPES, RULES, Rule
from scrubline.operators.audit import with_entry_hash
from scrubline.sources.requests import fill_skill


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# so many tasks for each core that Spark may use
TASKS_A_CORE = 4


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt evenly over all cores: a table file of one row group is read by one task, which would do all that follows.

    They go by a hash of all their columns, as dealing them in turn has that task sort them first.
    """
    return rows.repartition(TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism, *rows.columns)


# --- shared SQL -------------------------------------------------------------

NOTE_TEXT = """concat(
  CASE o_custkey % 4 WHEN 0 THEN 'Patient Ida Voss' WHEN 1 THEN 'Mr. Karl Brandt'
                     WHEN 2 THEN 'Nurse Adler, RN' ELSE 'Follow-up for Nora Quill' END,
  ' seen ', {us_date}, '. Age: ', o_custkey % 110, '. MRN: M-', o_orderkey,
  '. Ref #', 1000 + o_orderkey % 9000,
  CASE WHEN o_orderkey % 5 = 0 THEN concat('. SSN ', lpad(concat(o_custkey % 1000, ''), 3, '0'), '-',
       lpad(concat(o_orderkey % 100, ''), 2, '0'), '-', lpad(concat(o_orderkey % 10000, ''), 4, '0')) ELSE '' END,
  CASE WHEN o_orderkey % 7 = 0 THEN '. certificate KR-6021' ELSE '' END,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('. subscriber id: SB', o_custkey, ', mail u', o_custkey, '@mail.ward.test') ELSE '' END,
  CASE o_orderkey % 16
    WHEN 1 THEN concat('. facsimile 312-448-', 1000 + o_custkey % 9000)
    WHEN 2 THEN concat('. Lives at ', o_custkey % 900, ' Juniper Road, Dayton, OH ', 10000 + o_custkey % 89999)
    WHEN 3 THEN '. acct number KT-2093' WHEN 4 THEN '. ambulance vehicle id WD-5513'
    WHEN 5 THEN '. implant id PX-3020'
    WHEN 6 THEN concat('. results under http://lab.ward.test/r/', o_orderkey)
    WHEN 7 THEN concat('. host 10.44.7.', o_custkey % 256) WHEN 8 THEN '. retina scan taken'
    WHEN 9 THEN '. a headshot was filed' WHEN 10 THEN concat('. accession AX-', o_orderkey)
    WHEN 11 THEN '. Sex: F' WHEN 12 THEN concat('. ring (312) 448-', 1000 + o_custkey % 9000)
    WHEN 13 THEN '. born 2024-01-05, again on March 4, 2021' WHEN 14 THEN '. she is 45 yo'
    ELSE '' END,
  '. Discharge stable.')"""

PROMPT_TEXT = """concat('CONTEXT:', chr(10),
  CASE o_custkey % 3 WHEN 0 THEN concat('DE-IDENTIFIED DISCHARGE NOTE', chr(10)) WHEN 1 THEN concat('De-identified  lab panel ', chr(10))
       ELSE '' END,
  '| ', text, ' |', chr(10), chr(10), 'Sex: M', chr(10), '  Plan: rest  ',
  CASE WHEN note_id % 9 = 0 THEN '' ELSE concat(chr(10), chr(10), 'QUESTION:', chr(10),
    CASE note_id % 4 WHEN 0 THEN 'Write a plain-language summary for the patient and family.'
      WHEN 1 THEN 'What should the clinician check for a critical value?'
      WHEN 2 THEN 'Plain-language summary, please. ' ELSE 'Clinician view only.' END) END,
  CASE WHEN note_id % 17 = 0 THEN repeat(' padding', 520) ELSE '' END)"""

SKILL = """CASE WHEN note_id % 11 = 0 THEN 'summary-writer' WHEN note_id % 13 = 0 THEN NULL
  WHEN note_id % 29 = 0 THEN repeat('s', 65) ELSE 'vault-answer' END"""

MODEL = "CASE note_id % 3 WHEN 0 THEN 'BioMistral-7B' WHEN 1 THEN 'llama3.2:1b' ELSE 'meditron' END"

MODEL_ERROR = """CASE note_id % 23 WHEN 1 THEN 'not_configured' WHEN 2 THEN 'http' WHEN 3 THEN 'api'
  WHEN 4 THEN 'api' WHEN 5 THEN 'api' WHEN 6 THEN 'empty' END"""

UPSTREAM_STATUS = "CASE note_id % 23 WHEN 3 THEN 400 WHEN 4 THEN 402 WHEN 5 THEN CASE WHEN note_id % 4 < 3 THEN 529 END END"

UPSTREAM_BODY = """CASE note_id % 23 WHEN 2 THEN 'Connection refused (os error 111)' WHEN 3 THEN 'bad input'
  WHEN 4 THEN 'Your credit balance is too low' WHEN 5 THEN CASE WHEN note_id % 2 = 0 THEN 'overloaded' END END"""

AUDIT_ERROR = "CASE WHEN note_id % 31 = 0 THEN 'sqlite error: disk full' END"

OUTCOME = "CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'blocked' ELSE 'ok' END"

METADATA = """concat('{"z": ', props, ', "prompt_len": ', event_id,
  ', "latency_ms": ', CASE WHEN event_id % 50 = 0 THEN '12.0' ELSE concat(value, '') END,
  ', "deid_warnings": [', CASE WHEN event_type = 'view' THEN '"possible_name_remainder:Nora Quill"' ELSE '' END,
  '], "actor": {"b": true, "a": null}}')"""

HANDLER = """CASE event_type WHEN 'click' THEN '/v1/inference' WHEN 'error' THEN '/v1/inference'
  WHEN 'view' THEN '/v1/audit' WHEN 'purchase' THEN '/v1/audit/export' ELSE '/health' END"""

STATUS = "CASE event_id % 10 WHEN 0 THEN 401 WHEN 1 THEN 403 ELSE 200 END"

REPLY_TEXT = """concat(text, CASE conv_id % 5 WHEN 0 THEN ' I CANNOT PROVIDE that.'
  WHEN 1 THEN ' Is there anything else I can help with?' ELSE '' END)"""

RETRY_TEXT = "CASE conv_id % 2 WHEN 0 THEN 'I am not able to do so.' ELSE 'Rest and fluids.' END"

REPLY_MODEL = "CASE turn % 4 WHEN 1 THEN 'BioMistral-7B' ELSE 'llama3.2:1b' END"

CLAIM_GROUPS = """CASE c_custkey % 4 WHEN 0 THEN array('ward-operators', 'staff') WHEN 1 THEN array('staff')
  WHEN 2 THEN array('ward-auditors', 'ward-operators') END"""

CLAIM_ROLES = "CASE c_custkey % 5 WHEN 0 THEN array('ward-auditors') WHEN 1 THEN array('guest') END"

OPERATOR_GROUPS = ["ward-operators", "ward-admins"]
AUDITOR_GROUPS = ["ward-auditors"]

ENDPOINT = """CASE event_type WHEN 'click' THEN 'inference' WHEN 'error' THEN 'inference'
  WHEN 'view' THEN 'audit_list' ELSE 'audit_export' END"""

CREDENTIAL = """CASE event_id % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'invalid' WHEN 2 THEN 'key' WHEN 3 THEN 'key'
  ELSE 'token' END"""

EVENT_ROLE = "CASE user_id % 3 WHEN 0 THEN 'operator' WHEN 1 THEN 'auditor' END"

# words looked up in a text as stand-ins for what an entity recogniser finds
ENTITY_WORDS = [("seen", "PERSON"), ("Discharge", "LOCATION"), ("stable", "ORGANISATION")]

# a list of rules other than the built-in one: no postal codes, but references of the ward, before all else
WARD_RULES = [
    Rule("w01", "ward_reference", r"(?i)\b(?:certificate|subscriber id)\s*[:#]?\s*[\w-]+\b", "[WARD-REF]"),
    *[r for r in RULES if r.name != "r05"],
]

# one event in so many arrives last, after the others have arrived in so many parts
LATE_EACH = 50
LATE_PARTS = 5

CUTOVER = "2024-01-20T00:00:00"

# --- Spark side -------------------------------------------------------------


def notes(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """A note of each order; ``dealt`` over all cores unless only files are written from them."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    orders = spread(orders) if dealt else orders
    text = NOTE_TEXT.format(us_date="date_format(o_orderdate, 'MM/dd/yyyy')")
    return (
        orders.select(
            F.col("o_orderkey").alias("note_id"),
            "o_custkey",
            "o_orderdate",
            F.col("o_orderpriority").alias("source"),
            F.expr(text).alias("text"),
        )
    )


# notes whose ids agree but for this span make up one scenario document
SCENARIO_SPAN = 2000


def scenario_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents over several lines, each of a bounded span of notes; of seven, one is cut short and one has no scenarios."""
    scenario = F.struct(
        F.concat(F.lit("s"), F.col("note_id")).alias("id"),
        F.col("source").alias("label"),
        F.lit("vault-answer").alias("skill"),
        F.col("text").alias("context"),
        F.lit("What next?").alias("question"),
        F.when(F.col("note_id") % 5 == 0, F.lit(True)).alias("expect_blocked"),
    )
    span = F.floor(F.col("note_id") / SCENARIO_SPAN)
    grouped = notes(spark, sf_dir).groupBy(span.alias("k")).agg(F.collect_list(scenario).alias("scenarios"))
    listed = F.when(F.col("k") % 7 != 5, F.col("scenarios"))
    document = F.to_json(F.struct(F.concat(F.lit("group "), F.col("k")).alias("title"), listed.alias("scenarios")), {"pretty": "true"})
    cut = F.substring(document, F.lit(1), F.floor(F.length(document) / 2).cast("int"))
    return grouped.select("k", F.when(F.col("k") % 7 == 3, cut).otherwise(document).alias("value"))


def raw_requests(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    return notes(spark, sf_dir, dealt).select(
        F.col("note_id").alias("request_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("ts"),
        F.expr("concat('user-', o_custkey)").alias("actor"),
        F.lit("operator").alias("role"),
        F.expr(PROMPT_TEXT).alias("prompt"),
        F.expr(SKILL).alias("skill"),
        F.expr(MODEL).alias("model"),
        F.expr(MODEL_ERROR).alias("model_error"),
        F.expr(UPSTREAM_STATUS).alias("upstream_status"),
        F.expr(UPSTREAM_BODY).alias("upstream_body"),
        F.expr(AUDIT_ERROR).alias("audit_error"),
        F.expr("note_id % 1000 / 8.0D").alias("latency_ms"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_skill(raw_requests(spark, sf_dir))


def audit_events(events: DataFrame) -> DataFrame:
    """Audit rows without ids and hashes from the event table."""
    return events.select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("ts"),
        F.expr("concat('user-', user_id)").alias("actor"),
        F.expr("CASE user_id % 2 WHEN 0 THEN 'operator' ELSE 'auditor' END").alias("role"),
        F.col("event_type").alias("action"),
        F.lit("vault-answer").alias("resource"),
        F.expr(OUTCOME).alias("outcome"),
        F.expr(METADATA).alias("metadata_json"),
        F.col("value").alias("__value"),
    )


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_entry_hash(audit_events(table(spark, sf_dir, "events")))
    return rows.select((F.col("event_id") + 1).alias("id"), *[c for c in rows.columns if c != "event_id"])


def tampered_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit table with outcomes changed, and some metadata broken, under old hashes."""
    changed = F.when(F.col("__value") < 20, F.lit("ok-edited")).otherwise(F.col("outcome"))
    broken = F.when(F.col("__value") > 400, F.lit('{"cut": ')).otherwise(F.col("metadata_json"))
    return audit(spark, sf_dir).withColumn("outcome", changed).withColumn("metadata_json", broken)


def early_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy of the audit table taken at the cutover."""
    return audit(spark, sf_dir).where(F.col("ts") < CUTOVER)


def doubled_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit table with its errors recorded a second time under higher ids."""
    rows = audit(spark, sf_dir)
    again = rows.where("action = 'error'").withColumn("id", F.col("id") + 1_000_000_000)
    return rows.unionByName(again)


def access_log(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.lit("POST").alias("method"),
        F.expr(HANDLER).alias("handler"),
        F.expr(STATUS).alias("status"),
        (F.col("value") / 25).alias("latency_s"),
        F.expr(OUTCOME).alias("outcome"),
    )


def access_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.expr(ENDPOINT).alias("endpoint"),
        F.expr(CREDENTIAL).alias("credential"),
        F.expr(EVENT_ROLE).alias("role"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.expr("concat('sub-', c_custkey)").alias("sub"),
        F.expr("CASE WHEN c_custkey % 3 <> 0 THEN concat('c', c_custkey, '@ward.test') END").alias("email"),
        F.expr("CASE WHEN c_custkey % 2 = 0 THEN c_name END").alias("preferred_username"),
        F.expr(CLAIM_GROUPS).alias("groups"),
        F.struct(F.expr(CLAIM_ROLES).alias("roles")).alias("realm_access"),
    )


def entities_in(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Spans of the stand-in words, and one span per text that ends past it."""
    spans = F.array(
        *[
            F.struct(
                F.lit(kind).alias("entity_type"),
                (F.locate(word, F.col(text_col)) - 1).alias("start"),
                (F.locate(word, F.col(text_col)) - 1 + len(word)).alias("end"),
            )
            for word, kind in ENTITY_WORDS
        ],
        F.struct(
            F.lit("URL").alias("entity_type"), F.lit(0).alias("start"), (F.length(text_col) + 5).alias("end")
        ),
    )
    return texts.select(id_col, F.inline(spans)).where("start >= 0")


# the kinds of entities that stretches of text are marked with in turn; the last is none of the known ones
MARK_KINDS = [*ENTITY_TYPES, "ORGANISATION"]
# marks start so many characters apart, two of three; the first of two reaches into the second, which has its own length
MARK_STRIDE, MARK_REACH, MARK_SIZE, MARK_ALONE = 30, 2, 20, 10


def marked_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans over the whole of every document, every second of which the one before reaches into."""
    documents = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.length("text").alias("size"))
    at = F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / MARK_STRIDE).cast("int")))
    marks = documents.select("doc_id", "size", at.alias("k")).where("k % 3 < 2")
    start, behind = F.col("k") * MARK_STRIDE, (F.col("k") + 1) * MARK_STRIDE
    first = F.when(behind + MARK_SIZE <= F.col("size"), behind + MARK_REACH).otherwise(start + MARK_ALONE)
    end = F.when(F.col("k") % 3 == 0, first).otherwise(start + MARK_SIZE)
    kind = F.element_at(F.array(*map(F.lit, MARK_KINDS)), ((F.col("k") + F.col("doc_id")) % len(MARK_KINDS) + 1).cast("int"))
    marked = marks.select("doc_id", kind.alias("entity_type"), start.cast("int").alias("start"), end.cast("int").alias("end"), "size")
    return marked.where("end <= size").drop("size")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return said.select(
        "conv_id",
        "turn",
        F.expr(REPLY_MODEL).alias("model"),
        F.expr(REPLY_TEXT).alias("text"),
        F.expr(RETRY_TEXT).alias("retry_text"),
    )
