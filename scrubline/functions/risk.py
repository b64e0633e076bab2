"""Score what may remain in a text after it was scrubbed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrubline.functions.matching import skipping
from scrubline.functions.rules import LINEAR_EMAIL, rule

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
POSSIBLE_SSN = rule("r14").pattern
POSSIBLE_PHONE = r"\b\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
POSSIBLE_EMAIL = rule("r13").pattern
POSSIBLE_NAME = r"\b[A-Z][a-z]{2,}\s+[A-Z][a-z]{2,}\b"
CLINICAL_ALLOWLIST = [
    "DE-IDENTIFIED",
    "Admission",
    "Discharge",
    "Hospital",
    "Follow-up",
    "Medications",
    "Creatinine",
    "Potassium",
    "BUN",
    "amoxicillin",
    "lisinopril",
    "spironolactone",
    "pneumonia",
    "albuterol",
    "CONTEXT",
    "QUESTION",
    "Practice case",
]
LONG_TEXT_BYTES = 200
SSN_WARNING = "possible_ssn_remainder"
PHONE_WARNING = "possible_phone_remainder"
EMAIL_WARNING = "possible_email_remainder"
NAME_WARNING = "possible_name_remainder:"
UNTOUCHED_WARNING = "no_redactions_on_long_text"
# ---------------------------------------------------------------------------


def first_name_pair(text: Column) -> Column:
    """The first two-word name candidate with neither word on the clinical list."""
    listed = "|".join(CLINICAL_ALLOWLIST)
    pairs = F.regexp_extract_all(text, F.lit("(?U)" + POSSIBLE_NAME), F.lit(0))
    survives = lambda pair: ~pair.rlike(rf"(?iU)^(?:{listed})\s|\s(?:{listed})$")
    return F.get(F.filter(pairs, survives), F.lit(0))


def residual_warnings(text: Column, categories: Column) -> Column:
    """Warnings in fixed order; null where the text is null."""
    finds = lambda pattern: text.rlike("(?U)" + pattern)
    warnings = F.array_compact(
        F.array(
            F.when(finds(skipping(POSSIBLE_SSN)), F.lit(SSN_WARNING)),
            F.when(finds(POSSIBLE_PHONE), F.lit(PHONE_WARNING)),
            F.when(text.contains("@") & finds(LINEAR_EMAIL), F.lit(EMAIL_WARNING)),
            F.concat(F.lit(NAME_WARNING), first_name_pair(text)),
            F.when(
                (F.size(categories) == 0) & (F.octet_length(text) > LONG_TEXT_BYTES),
                F.lit(UNTOUCHED_WARNING),
            ),
        )
    )
    return F.when(text.isNotNull(), warnings)


def risk_level(warnings: Column) -> Column:
    """``high`` for a possible SSN, ``low`` without warnings, else ``medium``."""
    return (
        F.when(F.array_contains(warnings, SSN_WARNING), F.lit("high"))
        .when(F.size(warnings) > 0, F.lit("medium"))
        .when(F.size(warnings) == 0, F.lit("low"))
    )


def is_high_risk_block(level: Column, enabled: bool) -> Column:
    """Whether a row is held back for its risk level; off unless enabled."""
    return F.coalesce(level == "high", F.lit(False)) if enabled else F.lit(False)
