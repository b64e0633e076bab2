"""Single-purpose text columns: parts of the rule set that are useful alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrubline.functions.rules import rule


def _run(col: Column, *names: str) -> Column:
    for name in names:
        r = rule(name)
        col = F.regexp_replace(col, F.lit(r.java), F.lit(r.token))
    return col


def generalise_dates(col: Column) -> Column:
    """Numeric and month-name dates keep their year; ISO dates are dropped whole."""
    return _run(col, "r06", "r07", "r08")


def bucket_ages(col: Column) -> Column:
    """Ages from 90 up become one bucket; other stated ages are removed."""
    return _run(col, "r09", "r10")
