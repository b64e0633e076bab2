"""Redact entity spans found by a recogniser, alone or after the rules."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.functions.risk import residual_warnings, risk_level
from scrubline.functions.rules import ENTITY_DEFAULT, ENTITY_TYPES, SPAN_TOKENS, order_categories
from scrubline.operators.scrub import scrub


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for item in table.items() for x in item])[key]


def entity_category(entity_type: Column) -> Column:
    """The category of a named-entity type."""
    return F.coalesce(_lookup(ENTITY_TYPES, entity_type), F.lit(ENTITY_DEFAULT))


def sweep(text: str, spans: Iterable[tuple[int, int, str]]) -> tuple[str, int, set[str]]:
    """The text with a token over each span, how many were written, and the categories.

    ``spans`` (start, end, token) come from the highest start down.  What lies behind the lowest start so far is a stack of
    slices, the frontmost on top, so a span that reaches past that start takes its part off the top, be it text or an
    earlier token.  Every slice is pushed once and dropped or shortened from the front, and the text is put together
    once at the end: the time is that of the text and the number of spans.
    """
    front, behind, written, tokens = len(text), 0, 0, set()
    stack: list[tuple[str, int]] = []  # (a slice's text, where it begins in it)
    for start, end, token in spans:
        if start >= front + behind or end > front + behind:
            continue
        if end < front:
            stack.append((text[end:front], 0))
            behind += front - end
        taken = end - front
        while taken > 0:
            piece, at = stack.pop()
            rest = len(piece) - at
            behind -= min(taken, rest)
            if rest > taken:
                stack.append((piece, at + taken))
            taken -= rest
        stack.append((token, 0))
        behind += len(token)
        front = start
        written += 1
        tokens.add(token)
    return text[:front] + "".join(piece[at:] for piece, at in reversed(stack)), written, tokens


SWEPT = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("categories", T.ArrayType(T.StringType())),
        T.StructField("overlaps", T.IntegerType()),
    ]
)


@F.pandas_udf(SWEPT)
def _sweep_batch(texts: pd.Series, starts: pd.Series, ends: pd.Series, categories: pd.Series) -> pd.DataFrame:
    """Spans per text in ascending order of start, end and category; a text without spans gives nulls."""
    rows = []
    for text, start, end, category in zip(texts, starts, ends, categories):
        if text is None or start is None:
            rows.append((None, None, None, None))
            continue
        spans = [x for x in zip(start.tolist(), end.tolist(), category.tolist()) if x[1] <= len(text)][::-1]
        # in descending order of start, a span overlaps when it reaches past the start of its neighbour
        overlaps = sum(later[1] > earlier[0] for earlier, later in zip(spans, spans[1:]))
        found: dict[str, str] = {SPAN_TOKENS[c]: c for _, _, c in spans}
        done, written, tokens = sweep(text, ((s, e, SPAN_TOKENS[c]) for s, e, c in spans))
        rows.append((done, written, sorted(found[token] for token in tokens), overlaps))
    return pd.DataFrame(rows, columns=SWEPT.names, dtype=object)


_sweep_once = _sweep_batch.asNondeterministic()


def redact_spans(
    docs: DataFrame, entities: DataFrame, id_col: str, text_col: str = "text"
) -> DataFrame:
    """Replace entity spans by tokens; offsets count characters from zero.

    Adds ``span_text``, ``span_count``, ``span_categories`` and
    ``overlap_count``.  Spans that are empty or end past the text are dropped.
    The rest are written from the highest start down, a longer span before a
    shorter one at the same start; overlapping spans are not merged, only
    counted.  Entities are gathered per document before they meet the texts, so
    each text is shuffled at most once and never repeated; writing them takes time in proportion to
    the text and its spans.  Texts without spans do not leave the JVM.
    """
    spans = (
        entities.where((F.col("end") > F.col("start")) & (F.col("start") >= 0))
        .select(
            F.col(id_col),
            F.struct("start", "end", entity_category(F.col("entity_type")).alias("category")).alias("span"),
        )
        .groupBy(id_col)
        .agg(F.sort_array(F.collect_list("span")).alias("__spans"))
    )
    joined = docs.join(spans, id_col, "left")
    swept = _sweep_once(
        F.when(F.col("__spans").isNotNull(), F.col(text_col)),
        *[F.col(f"__spans.{name}") for name in ("start", "end", "category")],
    )
    done = joined.select(*docs.columns, swept.alias("__done"))
    known = F.col(text_col).isNotNull()
    none = F.array().cast("array<string>")
    return done.select(
        *docs.columns,
        F.coalesce("__done.text", text_col).alias("span_text"),
        F.when(known, F.coalesce("__done.n", F.lit(0))).alias("span_count"),
        F.when(known, order_categories(F.coalesce("__done.categories", none))).alias("span_categories"),
        F.when(known, F.coalesce("__done.overlaps", F.lit(0))).alias("overlap_count"),
    )


def assess(df: DataFrame, text_col: str = "scrubbed") -> DataFrame:
    """Add ``validation_warnings`` and ``residual_risk`` to a scrubbed table."""
    warned = df.withColumn("validation_warnings", residual_warnings(F.col(text_col), F.col("categories")))
    return warned.withColumn("residual_risk", risk_level(F.col("validation_warnings")))


def hybrid(scrubbed: DataFrame, entities: DataFrame, id_col: str, text_col: str = "scrubbed") -> DataFrame:
    """Entity spans after the rules, then risk; ``scrubbed`` is what :func:`scrub` returned, stored or not.

    Counts add up and categories are united; without entities the result is that
    of the rules alone.
    """
    rest = [c for c in scrubbed.columns if c not in (text_col, "redaction_count", "categories")]
    spanned = redact_spans(scrubbed, entities, id_col, text_col)
    return assess(
        spanned.select(
            *rest,
            F.col("span_text").alias(text_col),
            (F.col("redaction_count") + F.col("span_count")).alias("redaction_count"),
            order_categories(F.concat("categories", "span_categories")).alias("categories"),
            "overlap_count",
        ),
        text_col,
    )


def scrub_hybrid(
    docs: DataFrame, entities: DataFrame, id_col: str, text_col: str = "text"
) -> DataFrame:
    """Rules first, then entity spans located in the scrubbed text, then risk, in one call."""
    return hybrid(scrub(docs, text_col), entities, id_col)
