"""Entity spans against a straight right-to-left loop, overlaps included."""

import random

from scrubline.functions.rules import CATEGORIES, ENTITY_DEFAULT, ENTITY_TYPES, SPAN_TOKENS
from scrubline.operators.spans import redact_spans, scrub_hybrid


def by_hand(text, spans):
    valid = [s for s in spans if s[1] < s[2] <= len(text)]
    valid.sort(key=lambda s: (s[1], s[2], ENTITY_TYPES.get(s[0], ENTITY_DEFAULT)), reverse=True)
    found, n = set(), 0
    overlaps = sum(later[2] > earlier[1] for earlier, later in zip(valid, valid[1:]))
    for kind, start, end in valid:
        category = ENTITY_TYPES.get(kind, ENTITY_DEFAULT)
        if start < len(text) and end <= len(text):
            text = text[:start] + SPAN_TOKENS[category] + text[end:]
            found.add(category)
            n += 1
    return text, n, [c for c in CATEGORIES if c in found], overlaps


def test_random_spans(spark):
    rng = random.Random(7)
    kinds = [*ENTITY_TYPES, "UNKNOWN"]
    docs, entities = [], []
    for doc in range(60):
        text = "".join(rng.choice("abc déñ\n") for _ in range(rng.randint(0, 40)))
        docs.append((doc, text))
        for _ in range(rng.randint(0, 5)):
            start = rng.randint(0, 40)
            entities.append((doc, rng.choice(kinds), start, start + rng.randint(-2, 12)))
    done = redact_spans(
        spark.createDataFrame(docs, "doc_id int, text string"),
        spark.createDataFrame(entities, "doc_id int, entity_type string, start int, end int"),
        "doc_id",
    )
    for row in done.collect():
        spans = [e[1:] for e in entities if e[0] == row.doc_id]
        got = (row.span_text, row.span_count, row.span_categories, row.overlap_count)
        assert got == by_hand(row.text, spans)


def test_hybrid_without_entities_is_the_rules_alone(spark):
    docs = spark.createDataFrame([(1, "SSN 123-45-6789"), (2, None)], "doc_id int, text string")
    none = spark.createDataFrame([], "doc_id int, entity_type string, start int, end int")
    rows = {r.doc_id: r for r in scrub_hybrid(docs, none, "doc_id").collect()}
    assert (rows[1].scrubbed, rows[1].redaction_count, rows[1].categories) == (
        "SSN [REDACTED-SSN]", 1, ["ssn"],
    )
    assert rows[2].scrubbed is None and rows[2].residual_risk is None


def test_many_spans_take_linear_time(spark):
    """A document of 100,000 spans, all overlapping, and one of as many copies of one span."""
    import time

    text = "word " * 100_000
    docs = spark.createDataFrame([(1, text), (2, text), (3, text)], "doc_id int, text string")
    spans = spark.range(100_000).selectExpr("cast(id as int) as k")
    entities = (
        spans.selectExpr("1 as doc_id", "'PERSON' as entity_type", "5 * k as start", "5 * k + 7 as end")
        .unionByName(spans.selectExpr("2 as doc_id", "'URL' as entity_type", "40 as start", "400 as end"))
    )
    started = time.time()
    found = {r.doc_id: r for r in redact_spans(docs, entities, "doc_id").collect()}
    assert time.time() - started < 60
    for doc, kept in ((1, [("PERSON", 5 * k, 5 * k + 7) for k in range(100_000)]), (2, [("URL", 40, 400)] * 100_000)):
        if doc == 2:  # each copy replaces what the one before wrote, and 345 characters more, as long as there are any
            kept = kept[:3_000]
        text_2, n, categories, _ = by_hand(text, kept) if doc == 2 else (None, 99_999, ["name"], 0)
        assert found[doc].span_categories == categories
        assert (found[doc].span_text, found[doc].span_count) == (text_2, n) if doc == 2 else found[doc].span_count == n
    assert found[1].overlap_count == 99_998 and found[3].span_text == text and found[3].span_count == 0
