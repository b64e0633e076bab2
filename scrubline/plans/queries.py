"""Every operator as a query over the given tables.

Lists and maps are written out as text, so that results compare by value
whatever reads them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.functions import policy, prompts, risk, text
from scrubline.functions.canonical import canonical_json
from scrubline.functions.rules import category_table, order_categories
from scrubline.operators import access, audit, gate, metrics, scrub, spans
from scrubline.plans import inputs
from scrubline.session import scratch_path, written
from scrubline.sources import audit_tables, requests
from scrubline.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(array: Column, separator: str = ",") -> Column:
    return F.array_join(array, separator)


def flat_scrub(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys, "scrubbed", F.col("redaction_count").cast("long").alias("redaction_count"),
        joined(F.col("categories")).alias("categories"),
    )


def flat_risk(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, joined(F.col("validation_warnings"), "|").alias("warnings"), "residual_risk")


# --- sources and sinks ------------------------------------------------------


@query
def read_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "requests")
    inputs.raw_requests(spark, sf_dir, dealt=False).write.parquet(path)
    return requests.read_requests(spark, path).select("request_id", "ts", "actor", "role", "prompt", "skill")


def scenario_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of scenario documents, one a file."""
    path = scratch_path(spark, "scenarios")
    inputs.scenario_documents(spark, sf_dir).write.partitionBy("k").text(path)
    return path


@query
def read_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario documents written from the notes, over several lines each, and read back."""
    return requests.read_scenarios(spark, scenario_files(spark, sf_dir)).select(
        "title", "id", "label", "skill", "prompt", "expect_blocked"
    )


@query
def broken_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents were set aside, and why."""
    broken = requests.broken_scenarios(spark, scenario_files(spark, sf_dir))
    return broken.groupBy("reason").agg(F.countDistinct("path").alias("documents"))


@query
def scan_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_tables.scan_audit(inputs.tampered_audit(spark, sf_dir)).select("id", "ts", "action", "metadata_json")


@query
def append_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends: the rows before the cutover, then the rest."""
    path = scratch_path(spark, "append")
    events = inputs.audit_events(inputs.table(spark, sf_dir, "events"))
    audit_tables.append_audit(spark, events.where(F.col("ts") < inputs.CUTOVER), path)
    audit_tables.append_audit(spark, events.where(F.col("ts") >= inputs.CUTOVER), path)
    return audit_tables.read_audit(spark, path).select("id", "ts", "actor", "action", "outcome", "entry_hash")


@query
def merge_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after a merge into an early copy of it, run twice."""
    path = scratch_path(spark, "target")
    audit_tables.create_audit(spark, inputs.early_audit(spark, sf_dir), path)
    source = inputs.doubled_audit(spark, sf_dir)
    first = audit_tables.merge_audit(spark, source, path)
    second = audit_tables.merge_audit(spark, source, path)
    return audit_tables.read_audit(spark, path).select(
        "id", "entry_hash", F.lit(first).cast("long").alias("inserted"), F.lit(second).cast("long").alias("again")
    )


@query
def prefiltered_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a merge of one action into the whole table shuffles little more of the table than both share."""
    path = scratch_path(spark, "merged")
    audit_tables.create_audit(spark, inputs.audit(spark, sf_dir), path)
    source = written(inputs.audit(spark, sf_dir).where("action = 'signup'").select(*audit.AUDIT_COLUMNS), "part")
    target = audit_tables.read_audit(spark, path)
    near = audit_tables.near_source(source, target)
    total, shared, passed = target.count(), source.count(), near.count()
    lost = source.select("entry_hash").exceptAll(near).count()
    return spark.range(1).select(
        F.lit(total).cast("long").alias("target_rows"), F.lit(shared).cast("long").alias("shared"), F.lit(lost).cast("long").alias("lost"),
        F.lit(passed - shared <= (total - shared) / 8).alias("few_others"),
    )


# --- de-identification ------------------------------------------------------


@query
def scrub_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_scrub(scrub.scrub(inputs.notes(spark, sf_dir)), "note_id")


@query
def scrub_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_scrub(scrub.scrub(inputs.table(spark, sf_dir, "documents")), "doc_id")


@query
def scrub_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_scrub(scrub.scrub(inputs.table(spark, sf_dir, "pages"), "html"), "page_id")


@query
def scrub_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_scrub(scrub.scrub(inputs.table(spark, sf_dir, "conversations")), "conv_id", "turn")


@query
def scrub_with_own_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule and a category added, a rule left out."""
    return flat_scrub(scrub.scrub(inputs.notes(spark, sf_dir), rules=inputs.WARD_RULES), "note_id")


@query
def category_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scrub.category_hits(inputs.notes(spark, sf_dir), "note_id")


@query
def category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits per category with the category's place in the order."""
    hits = scrub.category_hits(inputs.notes(spark, sf_dir), "note_id")
    totals = hits.groupBy("category").agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("notes"))
    slugs = F.broadcast(category_table(spark))
    return (
        slugs.join(totals, slugs["slug"] == totals["category"], "left")
        .select(
            F.col("ordinal").cast("long").alias("ordinal"),
            "slug",
            F.coalesce("hits", F.lit(0)).alias("hits"),
            F.coalesce("notes", F.lit(0)).alias("notes"),
        )
    )


@query
def categories_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category lists gathered in any order per customer, put into fixed order."""
    hits = scrub.category_hits(
        inputs.notes(spark, sf_dir).select(F.col("o_custkey").alias("custkey"), "text"), "custkey"
    )
    sets = hits.groupBy("custkey").agg(F.collect_set("category").alias("found"))
    return sets.select("custkey", joined(order_categories(F.col("found"))).alias("categories"))


@query
def generalise_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.notes(spark, sf_dir).select("note_id", text.generalise_dates(F.col("text")).alias("text"))


@query
def bucket_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.notes(spark, sf_dir).select("note_id", text.bucket_ages(F.col("text")).alias("text"))


@query
def map_entity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = inputs.entities_in(inputs.notes(spark, sf_dir), "note_id", "text")
    return entities.groupBy(
        "entity_type", spans.entity_category(F.col("entity_type")).alias("category")
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def map_all_entity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = inputs.marked_entities(spark, sf_dir)
    return entities.groupBy(
        "entity_type", spans.entity_category(F.col("entity_type")).alias("category")
    ).agg(F.count(F.lit(1)).alias("n"))


def flat_spans(df: DataFrame, key: str = "note_id") -> DataFrame:
    return df.select(
        key, "span_text", F.col("span_count").cast("long").alias("span_count"),
        joined(F.col("span_categories")).alias("span_categories"),
        F.col("overlap_count").cast("long").alias("overlap_count"),
    )


@query
def redact_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = inputs.notes(spark, sf_dir).select("note_id", "text")
    return flat_spans(spans.redact_spans(notes, inputs.entities_in(notes, "note_id", "text"), "note_id"))


@query
def redact_overlapping_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans all over the documents, every other one cut short by the one before it."""
    documents = inputs.table(spark, sf_dir, "documents").select("doc_id", "text")
    return flat_spans(spans.redact_spans(documents, inputs.marked_entities(spark, sf_dir), "doc_id"), "doc_id")


@query
def scrub_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules run once; entities are looked for in, and written into, the stored result."""
    notes = inputs.notes(spark, sf_dir).select("note_id", "text")
    scrubbed = written(scrub.scrub(notes).drop("text"), "scrubbed")
    done = spans.hybrid(scrubbed, inputs.entities_in(scrubbed, "note_id", "scrubbed"), "note_id")
    return done.select(
        "note_id", "scrubbed", F.col("redaction_count").cast("long").alias("redaction_count"),
        joined(F.col("categories")).alias("categories"),
        joined(F.col("validation_warnings"), "|").alias("warnings"), "residual_risk",
    )


@query
def deid_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = scrub.deid_report(scrub.scrub(inputs.notes(spark, sf_dir)), ["source"])
    return report.withColumn("avg_redactions", F.round("avg_redactions", 6))


@query
def deid_report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = inputs.table(spark, sf_dir, "documents")
    report = scrub.deid_report(scrub.scrub(documents), ["source", "lang"])
    return report.withColumn("avg_redactions", F.round("avg_redactions", 6))


# --- residual risk ----------------------------------------------------------


@query
def residual_risk_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = inputs.notes(spark, sf_dir).withColumn("categories", F.array().cast("array<string>"))
    return flat_risk(spans.assess(raw, "text"), "note_id")


@query
def residual_risk_scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_risk(spans.assess(scrub.scrub(inputs.notes(spark, sf_dir))), "note_id")


@query
def residual_risk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = inputs.table(spark, sf_dir, "documents")
    return flat_risk(spans.assess(scrub.scrub(documents)), "doc_id")


@query
def first_name_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = inputs.table(spark, sf_dir, "documents")
    return documents.select("doc_id", risk.first_name_pair(F.col("text")).alias("pair"))


@query
def risk_levels_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrub, assess and count risk levels for each category hit."""
    assessed = spans.assess(scrub.scrub(inputs.notes(spark, sf_dir)))
    return (
        assessed.select(F.explode("categories").alias("category"), "residual_risk", "redaction_count")
        .groupBy("category", "residual_risk")
        .agg(F.count(F.lit(1)).alias("notes"), F.sum("redaction_count").alias("redactions"))
    )


@query
def block_high_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = inputs.notes(spark, sf_dir).withColumn("categories", F.array().cast("array<string>"))
    assessed = spans.assess(raw, "text")
    level = F.col("residual_risk")
    return assessed.select(
        "note_id",
        risk.is_high_risk_block(level, True).alias("blocked"),
        risk.is_high_risk_block(level, False).alias("blocked_by_default"),
    )


# --- policy and gate --------------------------------------------------------


@query
def check_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.requests(spark, sf_dir).select("request_id", policy.check_skill(F.col("skill")).alias("reason"))


@query
def hard_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = F.col("prompt")
    return inputs.requests(spark, sf_dir).select(
        "request_id",
        policy.has_ssn(prompt).alias("has_ssn"),
        policy.has_email(prompt).alias("has_email"),
        policy.has_phone(prompt).alias("has_phone"),
        policy.hard_block(prompt).alias("reason"),
    )


@query
def hard_block_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = inputs.table(spark, sf_dir, "documents")
    return documents.select("doc_id", policy.hard_block(F.col("text")).alias("reason"))


@query
def policy_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.requests(spark, sf_dir).select(
        "request_id", policy.policy_reason(F.col("skill"), F.col("prompt")).alias("reason")
    )


@query
def size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.requests(spark, sf_dir).select(
        "request_id", policy.size_error(F.col("prompt"), F.col("skill")).alias("error")
    )


@query
def size_guard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte limits on texts with many characters of more than one byte."""
    documents = inputs.table(spark, sf_dir, "documents")
    return documents.select("doc_id", policy.size_error(F.col("text"), F.col("source")).alias("error"))


@query
def gate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = gate.gate(inputs.requests(spark, sf_dir), fallback_stub=True)
    return decided.select(
        "request_id", "decision", "size_error", "policy_reason", "outcome", "model", "scrubbed",
        F.col("redaction_count").cast("long").alias("redaction_count"),
        joined(F.col("categories")).alias("categories"), "residual_risk",
    )


@query
def gate_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate with entity spans found in the scrubbed prompts."""
    find = lambda scrubbed: inputs.entities_in(scrubbed, "request_id", "scrubbed")
    decided = gate.gate(inputs.requests(spark, sf_dir), entities=find)
    return decided.select(
        "request_id", "decision", "scrubbed",
        F.col("redaction_count").cast("long").alias("redaction_count"),
        joined(F.col("categories")).alias("categories"), "residual_risk",
    )


@query
def status_and_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = gate.gate(inputs.requests(spark, sf_dir))
    return gate.detail(gate.status_code(decided)).select(
        "request_id", F.col("status").cast("long").alias("status"), "detail"
    )


@query
def audit_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = gate.gate(inputs.requests(spark, sf_dir))
    return gate.audit_metadata(decided).select("request_id", "metadata_json")


@query
def audit_metadata_without_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = gate.gate(inputs.requests(spark, sf_dir))
    built = gate.audit_metadata(decided, keep_matches=False)
    return built.select("request_id", F.get_json_object("metadata_json", "$.deid_warnings").alias("warnings"))


@query
def audit_from_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit rows a gated batch gives rise to, hashed."""
    decided = gate.audit_metadata(gate.gate(inputs.requests(spark, sf_dir)))
    return audit.with_entry_hash(gate.audit_events(decided)).select("actor", "outcome", "entry_hash")


# --- audit tables -----------------------------------------------------------


@query
def canonical_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.audit_events(inputs.table(spark, sf_dir, "events"))
    return rows.select("event_id", canonical_json(F.col("metadata_json")).alias("canonical"))


@query
def entry_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.audit(spark, sf_dir).select("id", "entry_hash")


@query
def entry_hash_in_field_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes with the outer keys as they are inserted instead of sorted."""
    order = ["ts", "actor", "role", "action", "resource", "outcome", "metadata"]
    rows = inputs.audit_events(inputs.table(spark, sf_dir, "events"))
    return audit.with_entry_hash(rows, order).select("event_id", "entry_hash")


@query
def assign_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return audit.assign_ids(rows, ["ts", "event_id"], last_id=500).select("id", "event_id")


@query
def verify_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.verify(inputs.tampered_audit(spark, sf_dir)).select("id", "hash_valid")


@query
def verify_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids asked for, half of which are not in the table."""
    asked = inputs.table(spark, sf_dir, "events").select((F.col("event_id") * 2).alias("id"))
    return audit.verify_ids(inputs.tampered_audit(spark, sf_dir), asked)


@query
def list_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = audit.list_latest(inputs.tampered_audit(spark, sf_dir), 500)
    return listed.select("id", "actor", "outcome", "metadata_json", "entry_hash", "hash_valid")


def stored_audit(spark: SparkSession, sf_dir: str) -> str:
    """The tampered audit table written to storage; its path."""
    path = scratch_path(spark, "listed")
    audit_tables.create_audit(spark, inputs.tampered_audit(spark, sf_dir), path)
    return path


@query
def list_latest_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = audit_tables.list_latest_stored(spark, stored_audit(spark, sf_dir), 500)
    return listed.select("id", "actor", "outcome", "metadata_json", "entry_hash", "hash_valid")


@query
def audit_panel_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_tables.audit_panel_stored(spark, stored_audit(spark, sf_dir))


@query
def high_water_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and the range of ids of each day after two appends, as the ledger has them."""
    path = scratch_path(spark, "marks")
    events = inputs.audit_events(inputs.table(spark, sf_dir, "events"))
    audit_tables.append_audit(spark, events.where(F.col("ts") < inputs.CUTOVER), path)
    audit_tables.append_audit(spark, events.where(F.col("ts") >= inputs.CUTOVER), path)
    return audit_tables.marks(spark, path)


@query
def export_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.export(inputs.audit(spark, sf_dir), "auditor")


@query
def export_audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.export_summary(audit.export(inputs.audit(spark, sf_dir), "auditor"), "auditor")


@query
def export_audit_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.export(inputs.audit(spark, sf_dir), "auditor", None)


@query
def audit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = audit.audit_metrics(inputs.audit_events(inputs.table(spark, sf_dir, "events")))
    entries = F.transform(
        F.map_entries("by_action"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return row.select("total_entries", "failure_count", joined(entries).alias("by_action"))


@query
def missing_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = audit.missing_entries(inputs.doubled_audit(spark, sf_dir), inputs.early_audit(spark, sf_dir))
    return missing.select("id", "entry_hash")


@query
def id_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = inputs.audit_events(inputs.table(spark, sf_dir, "events")).select(
        (F.col("event_id") + 1).alias("id"),
        *[c for c in audit.AUDIT_COLUMNS if c not in ("id", "outcome", "entry_hash")],
        F.when(F.col("__value") < 20, F.lit("ok-edited")).otherwise(F.col("outcome")).alias("outcome"),
    )
    return audit.id_conflicts(inputs.audit(spark, sf_dir), audit.with_entry_hash(changed))


@query
def next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.next_id(inputs.table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("id")))


@query
def leaky_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.audit_events(inputs.table(spark, sf_dir, "events"))
    leaky = audit.leaky_metadata(rows.withColumn("id", F.col("event_id") + 1))
    return leaky.select("id", joined(F.col("leaks"), "|").alias("leaks"))


@query
def audit_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.audit_events(inputs.table(spark, sf_dir, "events"))
    between = audit.audit_between(rows, "2024-01-10T06:00:00+00:00", "2024-01-12T18:30:00+00:00")
    return between.select("event_id", "ts", "action")


# --- metrics ----------------------------------------------------------------


def stamp(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def flat_rate(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(stamp("window_start"), *keys, "events", F.round("per_second", 9).alias("per_second"))


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.audit_events(inputs.table(spark, sf_dir, "events"))


def access_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.access_log(inputs.table(spark, sf_dir, "events"))


@query
def audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.audit_totals(audit_rows(spark, sf_dir))


@query
def appends_by_action_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.appends_by_action_outcome(audit_rows(spark, sf_dir))


@query
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = metrics.latency_histogram(access_rows(spark, sf_dir), ["outcome"])
    return long.withColumn("latency_sum", F.round("latency_sum", 4))


@query
def latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.latency_quantile(access_rows(spark, sf_dir), ["outcome"], exact=True)
    return found.select(
        "outcome", "latency_count", F.round("bucket_quantile", 6).alias("bucket_quantile"),
        F.round("exact_quantile", 6).alias("exact_quantile"),
    )


@query
def latency_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether p95 from merged sketches of days, and from one sketch, has the stated error in rank (twice that at 99 % confidence)."""
    rows = access_rows(spark, sf_dir)
    days = metrics.latency_sketches(rows, ["outcome"])
    merged = metrics.sketch_quantile(days, ["outcome"])
    whole = metrics.sketch_quantile(metrics.latency_sketches(rows, ["outcome"], "3650 days"), ["outcome"])
    found = merged.join(whole.select("outcome", F.col("sketch_quantile").alias("whole_quantile")), "outcome")
    latency, error = F.col("latency_s"), 2 * metrics.sketch_error()

    def holds(name: str) -> Column:
        below, upto = F.count_if(latency < F.col(name)), F.count_if(latency <= F.col(name))
        total = F.count(F.lit(1))
        return (below / total <= 0.95 + error) & (upto / total >= 0.95 - error)

    return (
        rows.join(found, "outcome")
        .groupBy("outcome", "latency_count", "windows")
        .agg(holds("sketch_quantile").alias("merged_holds"), holds("whole_quantile").alias("whole_holds"))
    )


@query
def auth_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.auth_failures(access_rows(spark, sf_dir))
    return found.select(F.col("status").cast("long").alias("status"), "failures")


@query
def request_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = flat_rate(metrics.request_rate(access_rows(spark, sf_dir)), "handler", "status")
    return rates.withColumn("status", F.col("status").cast("long"))


@query
def append_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_rate(metrics.append_rate(audit_rows(spark, sf_dir)), "action")


@query
def append_rate_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_rate(metrics.append_rate(audit_rows(spark, sf_dir), "1 minute"), "action")


@query
def appends_by_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.appends_by_action(audit_rows(spark, sf_dir))


@query
def audit_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_panel(inputs.tampered_audit(spark, sf_dir))


# --- access review ----------------------------------------------------------


@query
def review_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviewed = access.review_claims(
        inputs.claims(spark, sf_dir), inputs.OPERATOR_GROUPS, inputs.AUDITOR_GROUPS
    )
    return reviewed.select("sub", joined(F.col("all_groups")).alias("all_groups"), "role", "actor")


def flat_access(df: DataFrame) -> DataFrame:
    return df.select("event_id", "endpoint", "credential", "role", F.col("status").cast("long").alias("status"))


@query
def access_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = inputs.access_events(spark, sf_dir)
    return flat_access(access.access_decision(events, access.access_matrix(spark)))


@query
def access_decision_with_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = inputs.access_events(spark, sf_dir)
    return flat_access(
        access.access_decision(events, access.access_matrix(spark), role_keys_with_tokens=True)
    )


# --- prompts and replies ----------------------------------------------------


def prompt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts split and cleaned, over the scrubbed text as a model would get it."""
    scrubbed = scrub.scrub(inputs.requests(spark, sf_dir).select("request_id", "prompt", "skill"), "prompt")
    parts = scrubbed.withColumn("parts", prompts.split_prompt(F.col("scrubbed")))
    return parts.select("request_id", "skill", "parts.context", "parts.task").withColumn(
        "stripped", prompts.strip_tokens(F.col("context"))
    ).withColumn("softened", prompts.soften_task(F.col("task")))


@query
def split_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompt_parts(spark, sf_dir).select("request_id", "context", "task")


@query
def strip_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompt_parts(spark, sf_dir).select("request_id", "stripped")


@query
def soften_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompt_parts(spark, sf_dir).select("request_id", "softened")


@query
def facts_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = prompts.facts_prompt(F.col("stripped"), F.col("softened"))
    return prompt_parts(spark, sf_dir).select("request_id", built.alias("prompt"))


@query
def clinical_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    skill = F.col("skill")
    return prompt_parts(spark, sf_dir).select(
        "request_id",
        prompts.clinical_prompt(F.col("stripped"), F.col("softened"), skill).alias("prompt"),
        prompts.clinical_system(skill).alias("system"),
        prompts.hosted_system(skill).alias("hosted_system"),
    )


@query
def minimal_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompt_parts(spark, sf_dir).select(
        "request_id", prompts.minimal_prompt(F.col("stripped")).alias("prompt")
    )


@query
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.replies(spark, sf_dir).select(
        "conv_id", "turn", prompts.looks_like_refusal(F.col("text")).alias("refused")
    )


@query
def medical_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.requests(spark, sf_dir)
    return rows.groupBy("model", prompts.is_medical_model(F.col("model")).alias("medical")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def fallback_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.requests(spark, sf_dir)
    return rows.select("request_id", prompts.is_fallback_error(F.col("upstream_body")).alias("eligible"))


@query
def reply_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = inputs.replies(spark, sf_dir).select(
        "conv_id", "turn",
        prompts.reply_outcome(F.col("model"), F.col("text"), F.col("retry_text")).alias("outcome"),
    )
    error = prompts.reply_error(F.col("outcome"))
    return replies.select(
        "conv_id", "turn", "outcome", error["upstream_status"].cast("long").alias("status"),
        error["upstream_body"].alias("body"), prompts.is_fallback_error(error["upstream_body"]).alias("eligible"),
    )


# --- streams ----------------------------------------------------------------


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = inputs.table(spark, sf_dir, name).schema
    return jobs.read_table_stream(spark, sf_dir, f"{name}.parquet", schema)


def finished(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    path = scratch_path(spark, "stream")
    return jobs.run_to_end(stream, path + "/table", path + "/state", mode)


@query
def stream_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = finished(spark, jobs.stream_scrub(table_stream(spark, sf_dir, "conversations")))
    return flat_scrub(done, "conv_id", "turn", "residual_risk")


@query
def stream_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over a stream of request files."""
    path = scratch_path(spark, "requests")
    inputs.raw_requests(spark, sf_dir).write.parquet(path)
    arriving = spark.readStream.schema(requests.REQUEST_SCHEMA).option("maxFilesPerTrigger", 4).parquet(path)
    done = finished(spark, jobs.stream_gate(inputs.spread(arriving)))
    return done.select("request_id", "decision", "policy_reason", "scrubbed", "residual_risk")


@query
def stream_audit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append the event stream twice over; each entry ends up in the table once."""
    path = scratch_path(spark, "audit")
    for run in ("first", "second"):
        events = inputs.audit_events(table_stream(spark, sf_dir, "events"))
        jobs.start_audit_append(events, path + "/table", f"{path}/state-{run}").awaitTermination()
    return audit_tables.read_audit(spark, path + "/table").select("id", "ts", "action", "entry_hash")


@query
def stream_request_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    access_stream = inputs.access_log(table_stream(spark, sf_dir, "events"))
    stream = jobs.stream_rate(access_stream, ["handler", "status"], "1 minute")
    rates = flat_rate(finished(spark, stream, "complete"), "handler", "status")
    return rates.withColumn("status", F.col("status").cast("long"))


def closed_windows(spark: SparkSession, sf_dir: str) -> str:
    """The access log as files in order of time with a late one at the end, run through the window job; where it writes."""
    path = scratch_path(spark, "windows")
    log = inputs.table(spark, sf_dir, "events").withColumn("late", F.col("event_id") % inputs.LATE_EACH == 0)
    for part in range(inputs.LATE_PARTS):
        week = F.floor((F.dayofmonth("ts") - 1) / 7) == part
        log.where(~F.col("late") & week).drop("late").coalesce(1).write.mode("append").parquet(path + "/in")
    log.where("late").drop("late").coalesce(1).write.mode("append").parquet(path + "/in")
    arriving = spark.readStream.schema(inputs.table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 1).parquet(path + "/in")
    jobs.start_closed_windows(
        inputs.access_log(arriving), path, path + "/state", ["handler", "status"], "1 hour", delay="2 hours"
    ).awaitTermination()
    return path


@query
def stream_closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = spark.read.parquet(closed_windows(spark, sf_dir) + "/closed")
    return closed.select(stamp("window_start"), "handler", F.col("status").cast("long").alias("status"), "events")


@query
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that came after their window had closed."""
    late = spark.read.parquet(closed_windows(spark, sf_dir) + "/late")
    return late.groupBy("handler").agg(F.count(F.lit(1)).alias("rows"))


@query
def stream_latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    access_stream = inputs.access_log(table_stream(spark, sf_dir, "events"))
    stream = jobs.stream_histogram(access_stream, ["outcome"], "1 day")
    done = finished(spark, stream, "complete")
    return done.select(
        F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "outcome",
        *[F.col(f"__le_{i}").alias(f"le_{i}") for i in range(len(metrics.LATENCY_BOUNDS))], "latency_count",
        F.round("latency_sum", 4).alias("latency_sum"),
    )
