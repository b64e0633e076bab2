"""The Safe Harbor rule table and the lookup tables around it.

Everything under the *fixed values* banner is data: category names, patterns,
tokens and entity types.  They decide the output byte for byte, so they are
written out plainly and in application order.  What the rules need in a text and how they run fast is
derived from them, or from any other list of rules, in ``matching``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.functions.matching import fast_form


@dataclass(frozen=True)
class Rule:
    """One redaction rule: what it matches, and the token that replaces it.

    ``fast`` and ``fast_token`` may give a form that does the same in linear time, where the one that is derived
    from the pattern does not.  ``$1`` in a token stands for the first group.
    """

    name: str
    category: str
    pattern: str
    token: str
    fast: str = ""
    fast_token: str = ""

    @property
    def java(self) -> str:
        """The pattern as Spark runs it: ``(?U)`` makes ``\\w \\d \\s \\b`` Unicode-aware."""
        return "(?U)" + fast_form(self.pattern)


# The address pattern (r13) tries every start in a long dotted run anew.  This form matches the same text
# but reads a run of such characters once: it goes from the run's start, or from the end of the last match in it,
# to the first word boundary, group 1, and never gives back what follows up to the ``@``.
EMAIL_RUN = "[A-Za-z0-9._%+-]"
LINEAR_EMAIL = (
    rf"(?:(?<!{EMAIL_RUN})|\G)((?:\B{EMAIL_RUN})*+)\b{EMAIL_RUN}++@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b"
)


# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------

# The 18 Safe Harbor identifier categories; position is the sort order.
CATEGORIES = [
    "name",
    "geography",
    "date",
    "phone",
    "fax",
    "email",
    "ssn",
    "mrn",
    "health_plan_id",
    "account_number",
    "license_number",
    "vehicle_id",
    "device_id",
    "url",
    "ip",
    "biometric",
    "photo",
    "other_unique_id",
]

# The rules in application order.  Order decides the result: a later rule sees
# the text the earlier ones left behind.
RULES = [
    Rule(
        "r01", "name",
        r"\b(?:[Pp]atient|[Mm]r\.?|[Mm]rs\.?|[Mm]s\.?|[Dd]r\.?|[Mm]other|[Ff]ather|[Ss]pouse|[Ss]on|[Dd]aughter|[Bb]rother|[Ss]ister)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b",
        "[REDACTED-NAME]",
    ),
    Rule("r02", "name", r"\b[A-Z][a-z]+,\s*(?:MD|DO|RN|NP|PA|PharmD|DDS)\b", "[REDACTED-NAME]"),
    Rule(
        "r03", "geography",
        r"\b\d{1,5}\s+[A-Za-z0-9]+\s+(?:St|Street|Ave|Avenue|Rd|Road|Blvd|Boulevard|Drive|Dr|Lane|Ln|Way|Court|Ct)\.?\b",
        "[REDACTED-ADDRESS]",
    ),
    Rule("r04", "geography", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?,\s*[A-Z]{2}\b", "[REDACTED-CITY]"),
    Rule("r05", "geography", r"\b\d{5}(?:-\d{4})?\b", "[REDACTED-ZIP]"),
    Rule("r06", "date", r"\b(?:\d{1,2}[/-]\d{1,2}[/-])(\d{2,4})\b", "[REDACTED-DATE]-$1"),
    Rule(
        "r07", "date",
        r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+(\d{4})\b",
        "[REDACTED-DATE]-$1",
    ),
    Rule("r08", "date", r"\b\d{4}-\d{2}-\d{2}\b", "[REDACTED-DATE]"),
    Rule(
        "r09", "date",
        r"(?i)\b(?:age\s*[:=]?\s*(?:9\d|[1-9]\d{2,})|(?:9\d|[1-9]\d{2,})\s*(?:year|yr)s?\s*old)\b",
        "[AGE-90+]",
    ),
    Rule(
        "r10", "date",
        r"(?i)\b(?:age\s*[:=]?\s*\d{1,3}|\d{1,3}\s*(?:year|yr)s?\s*old|\d{1,3}\s*y/?o)\b",
        "[REDACTED-AGE]",
    ),
    Rule(
        "r11", "fax",
        r"(?i)\b(?:fax|facsimile)\s*[:#]?\s*(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
        "[REDACTED-FAX]",
    ),
    Rule(
        "r12", "phone",
        r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
        "[REDACTED-PHONE]",
    ),
    Rule(
        "r13", "email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[REDACTED-EMAIL]",
        LINEAR_EMAIL, "$1[REDACTED-EMAIL]",
    ),
    Rule("r14", "ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED-SSN]"),
    Rule(
        "r15", "mrn",
        r"(?i)\b(?:MRN|medical record(?: number)?|patient id|study id)\s*[:#]?\s*#?[\w-]+\b",
        "[REDACTED-MRN]",
    ),
    Rule(
        "r16", "health_plan_id",
        r"(?i)\b(?:member id|subscriber id|beneficiary(?: id)?|policy(?: number)?|health plan id)\s*[:#]?\s*[\w-]+\b",
        "[REDACTED-PLAN-ID]",
    ),
    Rule(
        "r17", "account_number",
        r"(?i)\b(?:account|acct)(?:\s+number)?\s*[:#]?\s*[\w-]+\b",
        "[REDACTED-ACCOUNT]",
    ),
    Rule(
        "r18", "license_number",
        r"(?i)\b(?:license|lic(?:ense)?|certificate|cert)(?:\s+number)?\s*[:#]?\s*[\w-]+\b",
        "[REDACTED-LICENSE]",
    ),
    Rule(
        "r19", "vehicle_id",
        r"(?i)\b(?:vin|vehicle id|license plate|plate number)\s*[:#]?\s*[\w-]+\b",
        "[REDACTED-VEHICLE]",
    ),
    Rule(
        "r20", "device_id",
        r"(?i)\b(?:device id|device serial|serial number|implant id|udi)\s*[:#]?\s*[\w-]+\b",
        "[REDACTED-DEVICE]",
    ),
    Rule("r21", "url", r"https?://[^\s]+", "[REDACTED-URL]"),
    Rule("r22", "ip", r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "[REDACTED-IP]"),
    Rule(
        "r23", "biometric",
        r"(?i)\b(?:fingerprint|voice print|voiceprint|retina scan|biometric)\b",
        "[REDACTED-BIOMETRIC]",
    ),
    Rule(
        "r24", "photo",
        r"(?i)\b(?:patient photo|facial image|headshot|portrait photo)\b",
        "[REDACTED-PHOTO]",
    ),
    Rule(
        "r25", "other_unique_id",
        r"(?i)\b(?:encounter id|visit id|order id|accession)\s*[:#]?\s*#?[\w-]+\b",
        "[REDACTED-ID]",
    ),
    Rule("r26", "other_unique_id", r"#\d{4,}\b", "[REDACTED-ID]"),
    Rule("r27", "other_unique_id", r"(?i)\b(?:sex|gender)\s*[:=]\s*[MFNB]\b", "[REDACTED-SEX]"),
]

# The rule list runs over the text this many times.
PASSES = 3

# Token written over an entity span of each category.
SPAN_TOKENS = {
    "name": "[REDACTED-NAME]",
    "geography": "[REDACTED-GEO]",
    "date": "[REDACTED-DATE]",
    "phone": "[REDACTED-PHONE]",
    "fax": "[REDACTED-FAX]",
    "email": "[REDACTED-EMAIL]",
    "ssn": "[REDACTED-SSN]",
    "mrn": "[REDACTED-MRN]",
    "health_plan_id": "[REDACTED-PLAN-ID]",
    "account_number": "[REDACTED-ACCOUNT]",
    "license_number": "[REDACTED-LICENSE]",
    "vehicle_id": "[REDACTED-VEHICLE]",
    "device_id": "[REDACTED-DEVICE]",
    "url": "[REDACTED-URL]",
    "ip": "[REDACTED-IP]",
    "biometric": "[REDACTED-BIOMETRIC]",
    "photo": "[REDACTED-PHOTO]",
    "other_unique_id": "[REDACTED-ID]",
}

# Named-entity types and the category each one belongs to; any other type
# counts as ENTITY_DEFAULT.
ENTITY_TYPES = {
    "PERSON": "name",
    "EMAIL_ADDRESS": "email",
    "PHONE_NUMBER": "phone",
    "US_SSN": "ssn",
    "DATE_TIME": "date",
    "LOCATION": "geography",
    "US_DRIVER_LICENSE": "geography",
    "IP_ADDRESS": "ip",
    "URL": "url",
    "CREDIT_CARD": "account_number",
    "US_BANK_NUMBER": "account_number",
    "MEDICAL_LICENSE": "license_number",
    "NRP": "license_number",
}
ENTITY_DEFAULT = "other_unique_id"

# ---------------------------------------------------------------------------
# Columns built from the tables
# ---------------------------------------------------------------------------


def rule(name: str) -> Rule:
    return next(r for r in RULES if r.name == name)


def category_table(spark: SparkSession) -> DataFrame:
    """The 18 categories as a table of ordinal and slug."""
    slugs = F.array(*[F.lit(c) for c in CATEGORIES])
    return spark.range(1).select(F.posexplode(slugs).alias("ordinal", "slug"))


def in_category_order(present: dict[str, Column]) -> Column:
    """An array of the category slugs whose flag holds, in category order."""
    return F.array_compact(
        F.array(*[F.when(present[c], F.lit(c)) for c in CATEGORIES if c in present])
    )


def order_categories(categories: Column) -> Column:
    """Distinct categories of an array, in category order; unknown slugs drop out."""
    return F.array_intersect(F.array(*[F.lit(c) for c in CATEGORIES]), categories)
