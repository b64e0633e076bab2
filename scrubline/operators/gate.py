"""The request gate: one decision row per request.

Cheap checks come first, and only requests that pass all of them are scrubbed.
Everything is a column of the request's own row, so the gate neither shuffles
nor depends on other rows; it runs on batch tables and on streams alike.

Request columns: ``request_id, ts, actor, role, prompt, skill`` and what the
model call reported: ``model`` (its label), ``model_error`` (null,
``not_configured``, ``http``, ``api`` or ``empty``), ``upstream_status``,
``upstream_body``, ``audit_error`` (message, or null) and ``latency_ms``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.functions.policy import ALLOWED_SKILLS, policy_reason, size_error
from scrubline.functions.prompts import is_fallback_error
from scrubline.functions.risk import is_high_risk_block
from scrubline.operators.scrub import scrub
from scrubline.operators.spans import assess, hybrid
from scrubline.session import written

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
HIGH_RISK_REASON = "deid_residual_risk_high"
HIGH_RISK_AUDIT_REASON = "residual_risk_high"
NOT_CONFIGURED_TEXT = "LLM disabled or API key not configured"
EMPTY_REPLY_TEXT = "empty response from model"
UNKNOWN_STATUS = "unknown"
FALLBACK_MODEL = "stub-fallback"
OFF_MODEL = "stub"
AUDITED_ACTION = "inference"
# ---------------------------------------------------------------------------


PROMPT_MISSING = "prompt is required"


def gate(
    requests: DataFrame,
    *,
    entities: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    allowed_skills: list[str] = ALLOWED_SKILLS,
    block_high_risk: bool = False,
    fallback_stub: bool = False,
    model_off: bool = False,
) -> DataFrame:
    """Add the decision and the de-identification result to each request.

    ``decision`` is ``rejected`` (too large or without a prompt, not audited), ``blocked`` or
    ``allowed``.  Blocked and rejected prompts are not scrubbed: they carry the
    result of an empty text, never the raw one.  ``entities`` switches on the
    hybrid scrub; its spans refer to the scrubbed prompts.  It may be a function that finds them in the
    requests with their ``scrubbed`` prompts, which are then written once and read by both.  ``model_off`` says that no model
    is called: what is allowed succeeds with the model ``stub``, whatever was reported.
    """
    prompt, skill = F.col("prompt"), F.col("skill")
    missing = F.when(prompt.isNull(), F.lit(PROMPT_MISSING))
    checked = requests.withColumn("size_error", F.coalesce(missing, size_error(prompt, skill)))
    checked = checked.withColumn(
        "policy_reason",
        F.when(F.col("size_error").isNull(), policy_reason(skill, prompt, allowed_skills)),
    )
    passes = F.col("size_error").isNull() & F.col("policy_reason").isNull()
    checked = checked.withColumn("__checked", F.when(passes, prompt).otherwise(F.lit("")))
    scrubbed = scrub(checked, "__checked").drop("__checked")
    if entities is None:
        scrubbed = assess(scrubbed)
    else:
        if callable(entities):
            scrubbed = written(scrubbed, "gated")
            entities = entities(scrubbed)
        scrubbed = hybrid(scrubbed, entities, "request_id").drop("overlap_count")

    held = is_high_risk_block(F.col("residual_risk"), block_high_risk)
    decided = scrubbed.withColumn("deid_block_reason", F.when(held, F.lit(HIGH_RISK_REASON)))
    decided = decided.withColumn(
        "decision",
        F.when(F.col("size_error").isNotNull(), F.lit("rejected"))
        .when(F.col("policy_reason").isNotNull() | F.col("deid_block_reason").isNotNull(), F.lit("blocked"))
        .otherwise(F.lit("allowed")),
    )
    if model_off:
        decided = decided.withColumn("model", F.lit(OFF_MODEL)).withColumn(
            "model_error", F.lit(None).cast("string")
        )
    return _with_model_result(decided, fallback_stub)


def _with_model_result(decided: DataFrame, fallback_stub: bool) -> DataFrame:
    """Keep the model's error only where a model was called, and settle the outcome."""
    allowed = F.col("decision") == "allowed"
    body = F.when(F.col("model_error").isin("api", "http"), F.col("upstream_body"))
    stands_in = is_fallback_error(body) if fallback_stub else F.lit(False)
    error = F.when(allowed & ~stands_in, F.col("model_error"))
    return (
        decided.withColumn(
            "model", F.when(allowed & F.col("model_error").isNull(), F.col("model")).when(
                allowed & stands_in, F.lit(FALLBACK_MODEL)
            ),
        )
        .withColumn("model_error", error)
        .withColumn(
            "outcome",
            F.when(F.col("decision") == "blocked", F.lit("blocked"))
            .when(F.col("model_error").isNotNull(), F.lit("error"))
            .when(allowed, F.lit("ok")),
        )
    )


def model_error_text(kind: Column, status: Column, body: Column) -> Column:
    """The message of a model's error; one that came without a body or a status still has a message."""
    body, status = F.coalesce(body, F.lit("")), F.coalesce(status.cast("string"), F.lit(UNKNOWN_STATUS))
    return (
        F.when(kind == "not_configured", F.lit(NOT_CONFIGURED_TEXT))
        .when(kind == "http", F.concat(F.lit("http error: "), body))
        .when(kind == "api", F.concat(F.lit("api error ("), status, F.lit("): "), body))
        .when(kind == "empty", F.lit(EMPTY_REPLY_TEXT))
    )


def status_code(decided: DataFrame) -> DataFrame:
    """Add ``status``.  An entry that could not be audited is a server error."""
    api = F.col("model_error") == "api"
    status = (
        F.when(F.col("decision") == "rejected", F.lit(400))
        .when(F.col("audit_error").isNotNull(), F.lit(500))
        .when(F.col("decision") == "blocked", F.lit(403))
        .when(F.col("model_error") == "not_configured", F.lit(503))
        .when(api & F.col("upstream_status").isin(400, 402), F.lit(400))
        .when(F.col("model_error").isNotNull(), F.lit(502))
        .otherwise(F.lit(200))
    )
    return decided.withColumn("status", status)


def detail(decided: DataFrame) -> DataFrame:
    """Add ``detail``, the message of a request that did not succeed."""
    text = (
        F.when(
            F.col("decision") == "rejected",
            model_error_text(F.lit("api"), F.lit(400), F.col("size_error")),
        )
        .when(F.col("audit_error").isNotNull(), F.col("audit_error"))
        .when(
            F.col("policy_reason").isNotNull(),
            F.concat(F.lit("request blocked by policy: "), F.col("policy_reason")),
        )
        .when(
            F.col("deid_block_reason").isNotNull(),
            F.concat(F.lit("request blocked by de-identification: "), F.col("deid_block_reason")),
        )
        .otherwise(
            model_error_text(F.col("model_error"), F.col("upstream_status"), F.col("upstream_body"))
        )
    )
    return decided.withColumn("detail", text)


def audit_metadata(decided: DataFrame, *, keep_matches: bool = True) -> DataFrame:
    """Add ``metadata_json``: the audit metadata with sorted keys.

    Rejected requests are not audited and get null.  Each outcome has its own
    keys, and an error states its model as an explicit null.  ``keep_matches``
    false cuts a name warning down to its kind, so no matched text is stored.
    """
    warnings = F.col("validation_warnings")
    if not keep_matches:
        warnings = F.transform(warnings, lambda w: F.regexp_replace(w, "(?s):.*", ""))
    common = {
        "deid_categories": F.col("categories"),
        "deid_prompt_len": F.octet_length("scrubbed").cast("long"),
        "deid_redaction_count": F.col("redaction_count"),
        "deid_residual_risk": F.col("residual_risk"),
        "deid_warnings": warnings,
        "latency_ms": F.round(F.col("latency_ms") * 100) / 100,
        "prompt_len": F.octet_length("prompt").cast("long"),
    }

    def packed(**extra: Column) -> Column:
        fields = {**common, **extra}
        return F.to_json(
            F.struct(*[fields[name].alias(name) for name in sorted(fields)]),
            {"ignoreNullFields": "false"},
        )

    error = model_error_text(F.col("model_error"), F.col("upstream_status"), F.col("upstream_body"))
    built = (
        F.when(F.col("policy_reason").isNotNull(), packed(policy_reason=F.col("policy_reason")))
        .when(
            F.col("deid_block_reason").isNotNull(),
            packed(deid_block_reason=F.lit(HIGH_RISK_AUDIT_REASON)),
        )
        .when(F.col("model_error").isNotNull(), packed(error=error, model=F.lit(None).cast("string")))
        .otherwise(packed(model=F.col("model")))
    )
    return decided.withColumn("metadata_json", F.when(F.col("decision") != "rejected", built))


def audit_events(decided: DataFrame) -> DataFrame:
    """The audit rows a gated batch gives rise to, without ids and hashes."""
    return decided.where(F.col("decision") != "rejected").select(
        "ts",
        "actor",
        "role",
        F.lit(AUDITED_ACTION).alias("action"),
        F.col("skill").alias("resource"),
        "outcome",
        "metadata_json",
    )
