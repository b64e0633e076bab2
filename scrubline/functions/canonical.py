"""Canonical JSON and entry hashes.

Canonical JSON has its object keys sorted at every depth, arrays in place and no
white space.  ``parse_json`` keeps objects sorted, so printing what it parsed
does the work in the JVM.  It reformats some literals, though (``12.0`` becomes
``12``), and refuses repeated keys.  Texts where that may matter are recognised
by one pattern and go through an Arrow function instead; other rows reach that
function as nulls and cost it nothing.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
HASHED_FIELDS = ["ts", "actor", "role", "action", "resource", "outcome", "metadata"]
DEEPEST_NESTING = 127
# ---------------------------------------------------------------------------

# Literals the JVM form may write differently: exponents, fractions that end in
# zero or are long, long digit runs, minus zero, and escapes by code point;
# then characters outside the basic plane, which sort differently.
REFORMATTED = (
    r"[0-9][eE]|\.[0-9]*0(?![0-9])|\.[0-9]{5}|[0-9]{15}|-0|\\u|[\x00-\x1F&&[^\n\r\t]]"
    r"|[\x{7F}\x{2028}\x{2029}\x{10000}-\x{10FFFF}]"
)


def _number(x: float) -> str:
    """Shortest decimal form: positional from 1e-5 up to 1e16, else ``1.5e-7``."""
    shortest = repr(x)
    if "e" not in shortest:
        return shortest
    mantissa, exponent = shortest.split("e")
    if int(exponent) == -5:
        sign = "-" if mantissa.startswith("-") else ""
        return f"{sign}0.0000{mantissa.lstrip('-').replace('.', '')}"
    return f"{mantissa}e{int(exponent)}"


def _compact(value, depth: int = 0) -> str:
    if depth > DEEPEST_NESTING:
        raise ValueError("nested too deeply")
    if isinstance(value, dict):
        members = (f"{_quoted(k)}:{_compact(v, depth + 1)}" for k, v in sorted(value.items()))
        return "{" + ",".join(members) + "}"
    if isinstance(value, list):
        return "[" + ",".join(_compact(v, depth + 1) for v in value) + "]"
    if isinstance(value, float):
        if value in (float("inf"), float("-inf")):
            raise ValueError("number out of range")
        return _number(value)
    return _quoted(value)


def _quoted(value) -> str:
    return json.dumps(value, ensure_ascii=False)


def _integer(digits: str) -> int | float:
    value = int(digits)
    if digits == "-0" or not -(2**63) <= value < 2**64:
        return float(digits)
    return value


def _refuse(name: str):
    raise ValueError(name)


def canonical_text(text: str | None) -> str | None:
    """Canonical form of one JSON text; None when it is not valid JSON."""
    if text is None:
        return None
    try:
        value = json.loads(text, parse_int=_integer, parse_constant=_refuse)
        result = _compact(value)
        result.encode("utf-8")  # refuses lone surrogates
        return result
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def _canonical_exact(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_text, na_action="ignore").astype(object)


# Marked so that conditions on the result, the optimizer's own among them, do not run the function once more.
_canonical_once = _canonical_exact.asNondeterministic()


def _in_list(text: Column) -> Column:
    """Canonical form of a list of the text alone, as the JVM writes it; null where that is not valid JSON."""
    return F.to_json(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))


def _is_rare(text: Column, in_list: Column) -> Column:
    """Whether a text has to go through the Arrow function."""
    # The parser stops after one value.  Whatever may follow that value breaks the
    # list or the object around it, so text that fits both is one whole value.
    in_object = F.try_parse_json(F.concat(F.lit('{"k":'), text, F.lit("}")))
    whole = in_list.isNotNull() & in_object.isNotNull()
    openings = F.length(text) - F.length(F.translate(text, "[{", ""))
    return text.rlike(REFORMATTED) | ~whole | (openings > DEEPEST_NESTING)


def _chosen(text: Column, in_list: Column, rare: Column) -> Column:
    native = F.substring(in_list, F.lit(2), F.length(in_list) - 2)
    return F.coalesce(_canonical_once(F.when(rare, text)), F.when(~rare, native))


def canonical_json(text: Column) -> Column:
    """Canonical form of a JSON text column; null where it is not valid JSON."""
    in_list = _in_list(text)
    return _chosen(text, in_list, _is_rare(text, in_list))


def with_canonical_json(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """As ``canonical_json``, as a column ``out``.

    What is used more than once has a column of its own on the way, so that each text is parsed twice and not six times.
    """
    parsed = df.withColumn("__in_list", _in_list(F.col(text_col)))
    told = parsed.withColumn("__rare", _is_rare(F.col(text_col), F.col("__in_list")))
    done = told.withColumn(out, _chosen(F.col(text_col), F.col("__in_list"), F.col("__rare")))
    return done.drop("__in_list", "__rare")


def _fields(names: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(n).alias(n) for n in names]), {"ignoreNullFields": "false"})


def hash_input(canonical_metadata: Column, key_order: list[str] | None = None) -> Column:
    """The text an entry's hash is taken over.

    ``key_order`` is the order of the outer keys, sorted by default.  The
    metadata goes in as it stands, already in canonical form.
    """
    order = sorted(HASHED_FIELDS) if key_order is None else key_order
    at = order.index("metadata")
    before, after = order[:at], order[at + 1:]
    head = F.regexp_replace(_fields(before), r"\}$", ',"metadata":') if before else F.lit('{"metadata":')
    tail = F.regexp_replace(_fields(after), r"^\{", ",") if after else F.lit("}")
    return F.concat(head, canonical_metadata, tail)


def entry_hash(canonical_metadata: Column, key_order: list[str] | None = None) -> Column:
    """Hex SHA-256 of an entry; the other fields are read from the row."""
    return F.sha2(hash_input(canonical_metadata, key_order), 256)
