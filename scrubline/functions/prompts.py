"""Shape prompts for a model and classify what comes back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
CONTEXT_PREFIX = "CONTEXT:\n"
QUESTION_SEPARATOR = "\n\nQUESTION:\n"
DEFAULT_TASK = "Summarize in plain English."
TOKEN = r"\[REDACTED-[A-Z]+\]"
HEADER = r"(?i)^DE-IDENTIFIED\s+(DISCHARGE NOTE|LAB PANEL)\s*$"
HEADER_REPLACEMENT = "Practice case"
SOFTENED = [
    ("plain-language summary", "simple summary"),
    ("Plain-language summary", "Simple summary"),
    ("clinician", "reader"),
    ("Clinician", "Reader"),
    ("patient and family", "a general audience"),
    ("critical value", "notable lab result"),
]
REFUSALS = [
    "can i help you with something else",
    "is there anything else i can help",
    "can't assist",
    "cannot assist",
    "cannot provide",
    "can't provide",
    "sensitive",
    "private medical",
    "medical diagnosis",
    "medical information",
    "healthcare information",
    "i'm not able",
    "i am not able",
]
MEDICAL_MODELS = ["biomistral", "meditron", "medgemma"]
FALLBACK_ERRORS = [
    "credit balance",
    "billing",
    "quota",
    "insufficient",
    "connection refused",
    "connection failed",
    "failed to connect",
    "timed out",
    "local model refused",
]
REFUSAL_STATUS = 422
REFUSAL_BODY = (
    "local model refused fictional demo content — try restarting BioMistral or set LLM_PROVIDER=anthropic"
)
FACTS_TEMPLATE = (
    "Writing class exercise (fictional practice material).\n"
    "Task: {task}\n\n"
    "Facts:\n{facts}\n\n"
    "Complete the task using only the facts above. Be concise."
)
CLINICAL_TEMPLATE = (
    "You are a clinical documentation assistant (skill: {skill}). "
    "The text below is de-identified synthetic training material — not real PHI.\n\n"
    "{context}\n\n"
    "Task: {task}\n\n"
    "Respond concisely using only the information above."
)
CLINICAL_SYSTEM_TEMPLATE = (
    "You help clinicians draft plain-language summaries from de-identified synthetic notes. "
    "Be factual and concise. Skill: {skill}."
)
HOSTED_SYSTEM_TEMPLATE = (
    "You are a HIPAA-aligned clinical assistant skill '{skill}'. "
    "Respond concisely. The user prompt is assumed de-identified upstream."
)
MINIMAL_TEMPLATE = "Turn the following practice notes into 3 short simple sentences:\n\n{context}"
# ---------------------------------------------------------------------------


def _fill(template: str, **values: Column) -> Column:
    """A text template as one ``concat``."""
    parts, rest = [], template
    while rest:
        at, name = min(
            ((rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest),
            default=(-1, ""),
        )
        if at < 0:
            parts.append(F.lit(rest))
            break
        parts += [F.lit(rest[:at]), values[name]] if at else [values[name]]
        rest = rest[at + len(name) + 2:]
    return F.concat(*parts)


# what counts as white space at the ends of a line, in Unicode
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _trim(text: Column) -> Column:
    """Drop white space of any kind at both ends, looking at each character once."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def split_prompt(prompt: Column) -> Column:
    """``context`` and ``task`` of a prompt, as a struct."""
    at = F.locate(QUESTION_SEPARATOR, prompt)
    before = F.substring(prompt, F.lit(1), at - 1)
    after = F.substring(prompt, at + len(QUESTION_SEPARATOR), F.length(prompt))
    context = F.when(
        before.startswith(CONTEXT_PREFIX),
        F.substring(before, F.lit(len(CONTEXT_PREFIX) + 1), F.length(before)),
    ).otherwise(before)
    return F.when(at > 0, F.struct(_trim(context).alias("context"), _trim(after).alias("task"))).otherwise(
        F.struct(_trim(prompt).alias("context"), F.lit(DEFAULT_TASK).alias("task"))
    )


def _lines(text: Column) -> Column:
    return F.split(text, r"\r?\n", -1)


def strip_tokens(text: Column) -> Column:
    """Remove plain redaction tokens line by line and drop lines left empty."""

    def clean(line: Column) -> Column:
        line = F.regexp_replace(line, "(?U)" + HEADER, HEADER_REPLACEMENT)
        line = _trim(F.regexp_replace(line, TOKEN, ""))
        return _trim(F.btrim(line, F.lit("|")))

    kept = F.filter(F.transform(_lines(text), clean), lambda line: line != "")
    return _trim(F.array_join(kept, "\n"))


def soften_task(task: Column) -> Column:
    for find, put in SOFTENED:
        task = F.replace(task, F.lit(find), F.lit(put))
    return task


def facts_prompt(context: Column, task: Column) -> Column:
    """Bullets for each line of an already stripped context, with a softened task."""
    lines = F.filter(F.transform(_lines(context), _trim), lambda line: line != "")
    bullets = F.array_join(F.transform(lines, lambda line: F.concat(F.lit("- "), line)), "\n")
    return _fill(FACTS_TEMPLATE, task=task, facts=bullets)


def clinical_prompt(context: Column, task: Column, skill: Column) -> Column:
    return _fill(CLINICAL_TEMPLATE, context=context, task=task, skill=skill)


def clinical_system(skill: Column) -> Column:
    return _fill(CLINICAL_SYSTEM_TEMPLATE, skill=skill)


def hosted_system(skill: Column) -> Column:
    return _fill(HOSTED_SYSTEM_TEMPLATE, skill=skill)


def minimal_prompt(context: Column) -> Column:
    return _fill(MINIMAL_TEMPLATE, context=context)


def _mentions(text: Column, phrases: list[str]) -> Column:
    lowered = F.lower(text)
    found = lowered.contains(phrases[0])
    for phrase in phrases[1:]:
        found = found | lowered.contains(phrase)
    return F.coalesce(found, F.lit(False))


def looks_like_refusal(text: Column) -> Column:
    return _mentions(text, REFUSALS)


def is_medical_model(model: Column) -> Column:
    return _mentions(model, MEDICAL_MODELS)


def is_fallback_error(message: Column) -> Column:
    """Billing and connection errors, for which a stand-in reply may be served."""
    return _mentions(message, FALLBACK_ERRORS)


def reply_outcome(model: Column, first_reply: Column, retry_reply: Column) -> Column:
    """What became of a reply.

    A general model that refuses gets a second try with the minimal prompt; a
    reply still refusing after that is an error.  ``retry`` stands for a refusal
    whose second reply is not known yet.
    """
    refused_first = looks_like_refusal(first_reply)
    retried = refused_first & ~is_medical_model(model)
    refused = F.when(retried, looks_like_refusal(retry_reply)).otherwise(refused_first)
    return (
        F.when(retried & retry_reply.isNull(), F.lit("retry"))
        .when(refused, F.lit("refused"))
        .when(retried, F.lit("ok_after_retry"))
        .otherwise(F.lit("ok"))
    )


def reply_error(outcome: Column) -> Column:
    """What a refused reply reports to the gate: ``model_error``, ``upstream_status`` and ``upstream_body``, null otherwise."""
    return F.when(
        outcome == "refused",
        F.struct(
            F.lit("api").alias("model_error"),
            F.lit(REFUSAL_STATUS).alias("upstream_status"),
            F.lit(REFUSAL_BODY).alias("upstream_body"),
        ),
    )
