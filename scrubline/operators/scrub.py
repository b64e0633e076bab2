"""De-identify a text column with the Safe Harbor rules, or with any other list of rules.

Texts cross to Python in Arrow batches and stay there: ASCII texts are taken as columns, others one by one, where an
automaton over the words that the rules need tells which of them are worth trying (see ``matching``).  For a text that
stays as it is nothing but a null comes back.  No rule looks beyond its own row, so there is no shuffle.

The rules are not a chain of column expressions on purpose: three passes make 81
nested replacements, which the optimizer copies into every condition on the
result and the code generator cannot compile.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.functions.matching import ColumnRunner, categories_of
from scrubline.functions.rules import CATEGORIES, PASSES, RULES, Rule

RESULT_COLUMNS = ("redaction_count", "categories", "category_counts")

SCRUBBED = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("categories", T.ArrayType(T.StringType())),
        T.StructField("counts", T.ArrayType(T.LongType())),
    ]
)


def _lists(values: pa.Array, of: np.ndarray, rows: int) -> pa.Array:
    """A list of each row's values, null where there are none; ``of`` is the row of each value, in order."""
    sizes = np.bincount(of, minlength=rows)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(sizes == 0))


def _scrubber(rules: Sequence[Rule], passes: int):
    """The rules as a function of a text column, marked so that conditions on the result do not run it once more."""
    rules, names = tuple(rules), categories_of(rules, CATEGORIES)

    def results(texts: pa.Array, counts: np.ndarray) -> pa.Array:
        """Nulls for a text that stays as it is."""
        of, category = np.nonzero(counts)
        total = counts.sum(axis=1)
        same = pa.array(total == 0)
        return pa.StructArray.from_arrays(
            [
                pc.if_else(same, pa.scalar(None, texts.type), texts),
                pc.if_else(same, None, pa.array(total.astype(np.int32))),
                _lists(pa.array(names, pa.string()).take(pa.array(category)), of, len(texts)),
                _lists(pa.array(counts[of, category]), of, len(texts)),
            ],
            SCRUBBED.names,
        )

    @F.arrow_udf(SCRUBBED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        runner = ColumnRunner(rules, names, passes)
        for texts in batches:
            done = [results(*some) for some in runner.run(texts)]
            yield pa.concat_arrays(done) if done else results(texts, np.zeros((0, len(names)), np.int64))

    return run.asNondeterministic()


def scrub(
    df: DataFrame,
    text_col: str = "text",
    *,
    out: str = "scrubbed",
    only: Column | None = None,
    counts: bool = False,
    rules: Sequence[Rule] = RULES,
    passes: int = PASSES,
) -> DataFrame:
    """Add ``out``, ``redaction_count`` and ``categories`` to every row.

    ``rules`` are applied in their order, the whole list ``passes`` times.  They may name
    categories of their own, which come after the known ones.

    ``only`` limits the work to rows where it holds; other rows keep their text
    and report no redactions.  ``counts`` adds ``category_counts``, an array of
    ``(category, n)`` for the categories hit.  A null text stays null, with a
    null count and null categories, so it is never taken for a clean one.

    Conditions that do not need the result belong before this call: none is
    pushed through it.
    """
    keep = [c for c in df.columns if c != out and c not in RESULT_COLUMNS]
    looked_at = F.col(text_col) if only is None else F.when(only, F.col(text_col))
    done = df.select(*keep, F.col(text_col).alias("__text"), _scrubber(rules, passes)(looked_at).alias("__done"))
    known = F.col("__text").isNotNull()
    none = F.array().cast("array<string>")
    result = [
        F.coalesce("__done.text", "__text").alias(out),
        F.when(known, F.coalesce("__done.n", F.lit(0))).alias("redaction_count"),
        F.when(known, F.coalesce("__done.categories", none)).alias("categories"),
    ]
    if counts:
        pairs = F.zip_with(
            "__done.categories", "__done.counts", lambda c, n: F.struct(c.alias("category"), n.alias("n"))
        )
        no_pairs = F.array().cast("array<struct<category:string,n:bigint>>")
        result.append(F.when(known, F.coalesce(pairs, no_pairs)).alias("category_counts"))
    return done.select(*keep, *result)


def category_hits(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """One row per document and category hit, with the number of replacements.

    The counts are already per row, so they are unfolded rather than grouped:
    no shuffle, whatever the number of documents.
    """
    scrubbed = scrub(df.select(id_col, text_col), text_col, counts=True)
    return scrubbed.select(id_col, F.inline("category_counts"))


def deid_report(scrubbed: DataFrame, by: list[str]) -> DataFrame:
    """Redactions, documents hit and category prevalence by group.

    Expects the output of :func:`scrub`.  Partial aggregation before the shuffle
    keeps a group that holds most of the rows from mattering.
    """
    return scrubbed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("redaction_count") > 0).alias("documents_hit"),
        F.sum("redaction_count").alias("redactions"),
        F.avg("redaction_count").alias("avg_redactions"),
        *[F.count_if(F.array_contains("categories", c)).alias(f"with_{c}") for c in CATEGORIES],
    )
