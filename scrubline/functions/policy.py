"""Decide from the raw request whether it may go on at all."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrubline.functions.matching import skipping
from scrubline.functions.rules import LINEAR_EMAIL, rule

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
ALLOWED_SKILLS = ["vault-answer"]
DEFAULT_SKILL = "vault-answer"
BLOCK_SSN = rule("r14").pattern
BLOCK_EMAIL = rule("r13").pattern
BLOCK_PHONE = rule("r12").pattern
SKILL_REASON = "skill_not_allowed"
PATTERN_REASON = "phi_pattern_detected"
PROMPT_BYTES = 4000
SKILL_BYTES = 64
PROMPT_TOO_LONG = "prompt exceeds 4000 characters"
SKILL_TOO_LONG = "skill exceeds 64 characters"
# ---------------------------------------------------------------------------


def _finds(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike("(?U)" + pattern), F.lit(False))


def has_ssn(text: Column) -> Column:
    return _finds(text, skipping(BLOCK_SSN))


def has_email(text: Column) -> Column:
    return F.coalesce(text.contains("@"), F.lit(False)) & _finds(text, LINEAR_EMAIL)


def has_phone(text: Column) -> Column:
    return _finds(text, BLOCK_PHONE)


def check_skill(skill: Column, allowed: list[str] = ALLOWED_SKILLS) -> Column:
    """The reason to refuse a skill, or null."""
    permitted = F.coalesce(skill.isin(*allowed), F.lit(False))
    return F.when(~permitted, F.lit(SKILL_REASON))


def hard_block(prompt: Column) -> Column:
    """The reason to refuse a raw prompt, or null; refused text is not redacted."""
    return F.when(has_ssn(prompt) | has_email(prompt) | has_phone(prompt), F.lit(PATTERN_REASON))


def policy_reason(skill: Column, prompt: Column, allowed: list[str] = ALLOWED_SKILLS) -> Column:
    """The first reason that applies: skill, then prompt content."""
    return F.coalesce(check_skill(skill, allowed), hard_block(prompt))


def size_error(prompt: Column, skill: Column) -> Column:
    """Why a request is too large, or null.  Limits count UTF-8 bytes."""
    return F.when(F.octet_length(prompt) > PROMPT_BYTES, F.lit(PROMPT_TOO_LONG)).when(
        F.octet_length(skill) > SKILL_BYTES, F.lit(SKILL_TOO_LONG)
    )
