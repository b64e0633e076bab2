"""Rules as a table: what is read off patterns, forms that run in linear time, and lists of one's own."""

import random
import re
import time

import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from scrubline.functions import matching, policy, prompts, risk
from scrubline.functions.matching import ColumnRunner, RuleRunner, fast_form, for_columns, needs, read_once, shape, shapes, skipping, starting
from scrubline.functions.rules import CATEGORIES, PASSES, RULES, Rule
from scrubline.operators.scrub import scrub
from scrubline.plans import inputs

LITERALS = sorted({literal for r in RULES for clause in needs(r.pattern)[0] for literal in clause})
PIECES = [
    " ", "  ", "\t", "1", "12", "123", "1234", "12345", "-", ".", ",", ":", "#", "=", "Aa", "Bob", "MD", "RN", "St", "Road", "@", "a",
    "Z", "_", "é", "years", "yr", "old", "y/o", "99", "100", "(", ")", "+1", "/", "Jan", "[REDACTED-LICENSE]", "x@y.org", "F",
]


def random_texts(count, seed):
    rng = random.Random(seed)
    for _ in range(count):
        yield "".join(
            rng.choice(PIECES) if rng.random() < 0.8 else rng.choice([str, str.title, str.upper])(rng.choice(LITERALS))
            for _ in range(rng.randint(1, 14))
        )


def straight(text, rules, engine=re):
    """The rules as a loop over their patterns as they are written."""
    counts = {}
    for _ in range(PASSES):
        for r in rules:
            text, n = engine.subn(r.pattern, r.token.replace("$1", r"\1"), text)
            if n:
                counts[r.category] = counts.get(r.category, 0) + n
    return text, counts


def test_needs_are_read_off_patterns():
    assert needs(r"(?i)\b(?:fax|facsimile)\s*\d{3}")[0] == (frozenset({"fax", "facsimile"}),)
    assert needs(r"https?://[^\s]+")[0] == (frozenset({"http://", "https://"}),)
    assert needs(r"\d{1,3}\s*y/?o\b") == ((frozenset({"yo", "y/o"}),), True)
    assert needs(r"[Pp]atient|x*") == ((), False)
    assert needs(r"\b\d{5}\b") == ((), True)


def test_fast_forms_match_the_same():
    for text in random_texts(800, 1):
        for engine in (re, regex):
            for r in RULES:
                want = engine.subn(r.pattern, r.token.replace("$1", r"\1"), text)
                form, token = (r.fast, r.fast_token) if r.fast else (fast_form(r.pattern), r.token)
                got = (regex if r.fast else engine).subn(form, token.replace("$1", r"\1"), text)
                assert got == want, (r.name, text)
                clauses, digit = needs(r.pattern)
                folded = text.casefold()
                if want[1]:
                    assert all(any(x in folded for x in clause) for clause in clauses) and (not digit or re.search(r"\d", text))


def test_forms_keep_what_they_may_not_change():
    assert read_once(r"a\s*[:=]\s*b") == r"a\s*[:=]\s*b"
    assert read_once(r"a\s*[:#]?\s*.b") == r"a\s*[:#]?\s*.b"
    assert skipping(r"\b(?:\d{2}|x)") == r"\b(?:\d{2}|x)"
    assert skipping(r"\b\d+x") == r"\b\d+x"


@pytest.mark.parametrize("engine", [re, regex])
def test_runner_equals_the_straight_loop(engine):
    runner = RuleRunner(RULES, CATEGORIES, PASSES, engine)
    for text in random_texts(1_500, 2):
        done, total, categories, counts = runner.run(text)
        want, by_category = straight(text, RULES, engine)
        assert (done, total, dict(zip(categories, counts))) == (want, sum(by_category.values()), by_category)


def hostile(r, size):
    words = sorted({x for clause in needs(r.pattern)[0] for x in clause if x.isascii()}) or ["1"]
    fill = [" ", "1", "1 ", "-", ".", " .", ",", "a", "Aa ", "A", "#", "@", "a.", "a@", "(", "Aa,", "/", "1/", "1-", "_", "\t\n", " : "]
    for word in words:
        for start in {word, word.upper(), word.title()}:
            yield from (start + (f * size)[:size] + "!" for f in (" ", "1", "-", ".", "\t\n", " : "))
            yield ((start + " ") * size)[:size] + "!"
    yield from ((f * size)[:size] + "!" for f in fill)


@pytest.mark.parametrize("r", RULES, ids=lambda r: r.name)
def test_time_grows_with_the_text_only(r):
    """200,000 characters of blanks, digits, marks or repeated labels; a quadratic form needs minutes for one of them."""
    for engine in (re, regex):
        pattern = (regex if r.fast else engine).compile(r.fast or fast_form(r.pattern))
        started = time.process_time()
        texts = 0
        for text in hostile(r, 200_000):
            pattern.sub("x", text)
            texts += 1
        assert time.process_time() - started < 0.5 * texts


def test_a_megabyte_of_blanks_in_every_operator(spark):
    size = 1_000_000
    texts = ["MRN" + " " * size + "!", "x" + " " * size + "x", "|" * size + "x", "age" + "\t" * size, ("a." * size)[:size] + "@", " " * size + "é"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string").cache()
    rows.count()
    started = time.time()
    done = scrub(rows).withColumn("w", risk.residual_warnings(F.col("scrubbed"), F.col("categories")))
    done = done.withColumn("block", policy.hard_block(F.col("text"))).withColumn("parts", prompts.split_prompt(F.col("text")))
    found = done.withColumn("lines", prompts.strip_tokens(F.col("text"))).orderBy("id").collect()
    assert time.time() - started < 60
    assert [r.redaction_count for r in found] == [0] * 6
    assert found[1].lines == texts[1] and found[2].lines == "x" and found[5].lines == "é"


def test_trim_knows_all_white_space(spark):
    for space in prompts.WHITE_SPACE:
        assert regex.fullmatch(r"\s", space)
    others = [chr(c) for c in (0x1C, 0x180E, 0x200B, 0xFEFF, 0x7F)]
    text = prompts.WHITE_SPACE + others[0] + "x" + others[3] + prompts.WHITE_SPACE
    assert spark.createDataFrame([(text,)], "t string").select(prompts._trim(F.col("t"))).first()[0] == others[0] + "x" + others[3]


def test_rules_of_ones_own(spark):
    rules = inputs.WARD_RULES
    texts = ["certificate KR-6021 kept", "zip 45402", "subscriber id: 7 and Sex: F", None, "", "plain"]
    rows = scrub(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), rules=rules).orderBy("id").collect()
    for text, row in zip(texts, rows):
        if text is None:
            assert row.scrubbed is None and row.categories is None
            continue
        want, counts = straight(text, rules)
        assert (row.scrubbed, row.redaction_count, set(row.categories)) == (want, sum(counts.values()), set(counts))
    assert rows[0].categories == ["ward_reference"] and rows[1].redaction_count == 0
    assert rows[2].categories == ["other_unique_id", "ward_reference"]


@pytest.mark.parametrize("rules", [[], [Rule("a", "name", r"(\w)\1", "<$1>")], [Rule("a", "name", r"x++y", r"\1")], [Rule("a", "name", "ab", "b"), Rule("b", "date", "cb", "!")]])
def test_odd_lists_of_rules(spark, rules):
    text = "aabb xxy cab"
    row = scrub(spark.createDataFrame([(text,)], "text string"), rules=rules).first()
    counts = {}
    for _ in range(PASSES):
        for r in rules:
            put = (lambda m: f"<{m[1]}>") if "$1" in r.token else (lambda m, t=r.token: t)
            text, n = re.subn(r.pattern, put, text)
            counts[r.category] = counts.get(r.category, 0) + n
    assert (row.scrubbed, row.redaction_count) == (text, sum(counts.values()))


def test_shapes_tell_digits_and_blanks():
    assert shapes(r"\b\d{3}-\d{2}-\d{4}\b") == (frozenset({"000-00-0000"}),)
    assert shapes(r"(?i)\b(?:sex|gender)\s*[:=]\s*M") == (
        frozenset(f"{w}{a}{sign}{b}m" for w in ("sex", "gender") for a in ("", " ") for sign in ":=" for b in ("", " ")),
    )
    assert shapes(r"[abcd]{5}") == () or all(len(x) < 5 for c in shapes(r"[abcd]{5}") for x in c)
    assert shapes(r"x*") == () and shapes(r"[Pp]atient|x*") == ()
    assert shape("Aé \t٣ ß") == "aé 0 ss"


def test_shapes_occur_in_every_match():
    own = [r"[ab]{20}c", r"(?:\.\d{1,3}){3}x?", r"\d{18}", r"(?:ab|c+)d", r"a(?:b|\s+c)?d", r"(a|bc){2}\s", r"a\s{2}b", r"[-.\s]?\d?z"]
    texts = [*random_texts(600, 3), "ab" * 10 + "c", ".1.22.333x", "1" * 18, "abd ccd", "a \t cd abd ad", "abc a ", "a  b", "-1z .z 2z z"]
    for text in texts:
        for pattern in [*(r.pattern for r in RULES), *own]:
            for engine in (re, regex):
                if engine.search(pattern, text):
                    assert all(any(x in shape(text) for x in clause) for clause in shapes(pattern)), (pattern, text)


def test_starting_forms_match_the_same():
    changed = [r for r in RULES if starting(fast_form(r.pattern)) != fast_form(r.pattern)]
    assert len(changed) > 12
    for text in [*random_texts(1_500, 4), "ſex: M, K, ımplant id 7 xſtudy id 1"]:
        for r in changed:
            form, token = starting(fast_form(r.pattern)), r.token.replace("$1", r"\1")
            assert re.subn(form, token, text) == re.subn(r.pattern, token, text), (r.name, text)
    for pattern in (r"\b(?:a|b)|c", r"\b(?:a|b)?c", r"\b(?:a?b|c)", r"\b(?:a|\W)", r"x(?:a|b)", r"\b(?:\d{0,2}a|b)"):
        assert starting(pattern) == pattern


@pytest.mark.parametrize("r", RULES, ids=lambda r: r.name)
def test_starting_forms_read_a_text_once(r):
    form = re.compile(starting(fast_form(r.pattern)) if not r.fast else "x")
    started = time.process_time()
    texts = 0
    for text in hostile(r, 100_000):
        form.sub("x", text)
        texts += 1
    assert time.process_time() - started < 0.25 * texts


def test_groups_that_move_may_bring_anything():
    """What a token's group joins may meet a later rule's need that the text did not."""
    rules = [Rule("a", "name", r"foo(\d)", "$1[X]"), Rule("b", "date", r"\b\d{5}\b", "!")]
    runner = RuleRunner(rules, ["name", "date"], 1, re)
    assert runner.run("1234foo5")[0] == "![X]"


def test_few_rules_are_tried():
    """The need for time of scrub: of the rules tried over notes, most must match."""
    runner = RuleRunner(RULES, CATEGORIES, PASSES, re)
    text = "Patient Ida Voss seen 12/03/1996. Age: 45. MRN: M-4711. Ref #5711. SSN 123-45-6789. host 10.44.7.9. Discharge stable."
    tried = matched = 0
    for _ in range(2):
        found = runner.found_in(text)
        for mask, subn, put, _, brings in runner.rules:
            if found & mask == mask:
                tried += 1
                text, n = subn(put, text)
                if n:
                    matched += 1
                    found |= brings
    assert matched >= 7 and tried <= matched + 4


def column_results(runner, texts):
    """(text, numbers of replacements by category) of each text."""
    return [(t, {c: int(n) for c, n in zip(CATEGORIES, own) if n}) for some, counts in runner.run(pa.array(texts, pa.string())) for t, own in zip(some.to_pylist(), counts)]


def test_columns_are_scrubbed_like_single_texts(monkeypatch):
    """Nulls, empty and equal texts, other alphabets, odd white space, and neighbours that a match could reach into."""
    monkeypatch.setattr(matching, "LEAST_BYTES", 0)
    texts = [*random_texts(3_000, 8), None, "", " ", "MRN\x0b12", "MRN\x1c12", "x\x01y SSN 123-45-6789", "é MRN 12", "MRN 5", "MRN 5", "12345 12345-12345(312) 448-1000"]
    runner = ColumnRunner(RULES, CATEGORIES, PASSES)
    assert runner.by_column
    want = [(t, {}) if not t else straight(t, RULES, re if t.isascii() and "\x1c" not in t else regex) for t in texts]
    assert column_results(runner, texts) == want
    monkeypatch.setattr(matching, "COLUMN_BYTES", 100)
    assert column_results(runner, texts) == want
    assert column_results(runner, []) == []


def test_patterns_that_engines_may_read_apart_run_one_by_one(monkeypatch):
    monkeypatch.setattr(matching, "LEAST_BYTES", 0)
    assert all(for_columns(r.pattern) for r in RULES)
    for pattern in (r"x*", r"(?:a?)+b", r"a(?=b)", r"(a)\1", r"^a", r"a$", r"a.b", r"(?i)ſon", r"[ı]", "é", r"a{,3}b", r"\101", r"[[:alpha:]]", r"(", r"a\Z"):
        assert not for_columns(pattern), pattern
    rules = [Rule("a", "name", r"\bward(?=\d)", "[WARD]"), Rule("b", "date", r"(\d)-(\d)", r"$2\$1")]
    runner = ColumnRunner(rules, CATEGORIES, 2)
    assert not runner.by_column
    assert column_results(runner, ["ward7 1-2", "ward 7"]) == [("[WARD]7 2\\1", {"name": 1, "date": 1}), ("ward 7", {})]
    assert column_results(ColumnRunner(rules[1:], CATEGORIES, 1), ["1-2-3"]) == [("2\\1-3", {"date": 1})]
    assert column_results(ColumnRunner([], CATEGORIES, 2), ["a", None]) == [("a", {}), (None, {})]


def test_long_columns_take_linear_time():
    """Blanks, digits, marks and repeated labels; a quadratic form needs minutes for one of them."""
    runner = ColumnRunner(RULES, CATEGORIES, PASSES)
    for r in RULES[::4]:
        for text in list(hostile(r, 200_000))[::3]:
            start = time.perf_counter()
            assert len(column_results(runner, [text])) == 1
            assert time.perf_counter() - start < 5, r.name


def test_many_texts_are_scrubbed_in_little_time():
    """Rules run over columns: row by row, texts with many matches took three times as long."""
    texts = [f"Patient Ida Voss seen 01/02/2024. Age: {k % 100}. MRN: M-{k}. Ref #{1000 + k}. mail u{k}@mail.ward.test. Sex: M" * 2 for k in range(8_000)]
    runner = ColumnRunner(RULES, CATEGORIES, PASSES)
    took = []
    for run in (lambda: column_results(runner, texts), lambda: [runner.plain.run(t) for t in texts]):
        start = time.perf_counter()
        run()
        took.append(time.perf_counter() - start)
    assert took[0] < 0.7 * took[1], took


def test_dealing_rows_needs_no_sort(spark):
    """Rows dealt in turn are sorted first, by the one task that reads a file of one row group."""
    dealt = inputs.spread(spark.range(1000).selectExpr("id", "id % 7 AS k", "cast(null AS string) AS empty"))
    assert "RoundRobin" not in dealt._jdf.queryExecution().toString()
    sizes = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 1000 and len(sizes) == inputs.TASKS_A_CORE * spark.sparkContext.defaultParallelism
