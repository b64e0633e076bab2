"""Counts, histograms and rates over audit and access tables.

Every one is a grouped aggregate on small keys: rows are combined before the
shuffle, so a key that holds most of the rows costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
LATENCY_BOUNDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
AUTH_FAILURE_STATUSES = [401, 403]
# ---------------------------------------------------------------------------


def audit_totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("audit_entries"),
        F.count_if(F.col("outcome") != "ok").alias("audit_failures"),
    )


def appends_by_action_outcome(df: DataFrame) -> DataFrame:
    return df.groupBy("action", "outcome").agg(F.count(F.lit(1)).alias("appends"))


def appends_by_action(df: DataFrame) -> DataFrame:
    return df.groupBy("action").agg(F.count(F.lit(1)).alias("appends"))


def _bound_column(i: int) -> str:
    return f"__le_{i}"


def histogram_aggregates(seconds: Column) -> list[Column]:
    """Cumulative bucket counts, sum and count, for use in any ``agg``."""
    buckets = [F.count_if(seconds <= b).alias(_bound_column(i)) for i, b in enumerate(LATENCY_BOUNDS)]
    return [*buckets, F.sum(seconds).alias("latency_sum"), F.count(seconds).alias("latency_count")]


def _buckets() -> Column:
    finite = [
        F.struct(F.lit(b).alias("le"), F.col(_bound_column(i)).alias("n")) for i, b in enumerate(LATENCY_BOUNDS)
    ]
    last = F.struct(F.lit(float("inf")).alias("le"), F.col("latency_count").alias("n"))
    return F.array(*finite, last)


def latency_histogram(df: DataFrame, by: list[str], seconds_col: str = "latency_s") -> DataFrame:
    """Long form: one row per group and bound, with the bound as text."""
    wide = df.groupBy(*by).agg(*histogram_aggregates(F.col(seconds_col)))
    long = wide.select(*by, F.explode(_buckets()).alias("b"), "latency_sum", "latency_count")
    le = F.when(F.col("b.le") == float("inf"), F.lit("+Inf")).otherwise(F.col("b.le").cast("string"))
    return long.select(*by, le.alias("le"), F.col("b.n").alias("cumulative"), "latency_sum", "latency_count")


def histogram_quantile(q: float) -> Column:
    """A quantile read off the buckets of :func:`histogram_aggregates`.

    Linear inside the bucket the rank falls in; beyond the last finite bound the
    answer is that bound; null for an empty group.
    """
    rank = F.lit(q) * F.col("latency_count")
    answer = F.when(F.col("latency_count") == 0, F.lit(None).cast("double"))
    low, below = F.lit(0.0), F.lit(0)
    for i, bound in enumerate(LATENCY_BOUNDS):
        n = F.col(_bound_column(i))
        answer = answer.when(n >= rank, low + (F.lit(bound) - low) * (rank - below) / (n - below))
        low, below = F.lit(bound), n
    return answer.otherwise(F.lit(LATENCY_BOUNDS[-1]))


def latency_quantile(
    df: DataFrame, by: list[str], q: float = 0.95, seconds_col: str = "latency_s", exact: bool = False
) -> DataFrame:
    """The bucket estimate of a quantile and, if asked for, the exact value.

    The exact value keeps a count for each distinct latency of a group; leave it
    out where those are too many.
    """
    extra = [F.percentile(F.col(seconds_col), q).alias("exact_quantile")] if exact else []
    wide = df.groupBy(*by).agg(*histogram_aggregates(F.col(seconds_col)), *extra)
    return wide.select(
        *by,
        "latency_count",
        histogram_quantile(q).alias("bucket_quantile"),
        *(["exact_quantile"] if exact else []),
    )


# items a sketch keeps a level; its size hardly grows with the rows
SKETCH_SIZE = 400


def sketch_error(size: int = SKETCH_SIZE) -> float:
    """How far the rank of a quantile read off a sketch may be from the one asked for, as a share of all rows, with 99 % confidence."""
    return 2.296 / size**0.9723


def latency_sketches(
    df: DataFrame, by: list[str], every: str = "1 day", *, seconds_col: str = "latency_s", size: int = SKETCH_SIZE
) -> DataFrame:
    """A quantile sketch of the latencies of each window and group, with how many they are.

    Sketches are a few kilobytes whatever the rows, and are built before the shuffle; kept in a table, they answer for any
    quantile and any span of windows later on (see :func:`sketch_quantile`).
    """
    known = df.where(F.col(seconds_col).isNotNull())
    return known.groupBy(F.window("ts", every).alias("window"), *by).agg(
        F.kll_sketch_agg_double(F.col(seconds_col), F.lit(size)).alias("latency_sketch"), F.count(F.lit(1)).alias("latency_count")
    )


def sketch_quantile(sketches: DataFrame, by: list[str], q: float = 0.95) -> DataFrame:
    """A quantile over all windows of each group, from merged sketches."""
    merged = sketches.groupBy(*by).agg(
        F.kll_merge_agg_double("latency_sketch").alias("merged"), F.sum("latency_count").alias("latency_count"),
        F.count(F.lit(1)).alias("windows"),
    )
    quantile = F.kll_sketch_get_quantile_double(F.col("merged"), F.lit(q))
    return merged.select(*by, "latency_count", "windows", quantile.alias("sketch_quantile"))


def auth_failures(df: DataFrame) -> DataFrame:
    refused = df.where(F.col("status").isin(*AUTH_FAILURE_STATUSES))
    return refused.groupBy("status").agg(F.count(F.lit(1)).alias("failures"))


def rate(
    df: DataFrame, by: list[str], every: str = "1 minute", slide: str | None = None, ts_col: str = "ts"
) -> DataFrame:
    """Events and events per second by time window; windows slide if asked to."""
    window = F.window(ts_col, every, slide) if slide else F.window(ts_col, every)
    counted = df.groupBy(window.alias("window"), *by).agg(F.count(F.lit(1)).alias("events"))
    length = F.unix_micros(F.col("window.end")) - F.unix_micros(F.col("window.start"))
    return counted.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *by,
        "events",
        (F.col("events") * 1e6 / length).alias("per_second"),
    )


def request_rate(access: DataFrame, by: tuple[str, ...] = ("handler", "status")) -> DataFrame:
    """Requests per second by handler and status, or other keys such as ``method``, in windows of one minute."""
    return rate(access, list(by))


def append_rate(audit: DataFrame, slide: str | None = None) -> DataFrame:
    """Audit rows per second by action, in windows of five minutes."""
    return rate(audit.withColumn("ts", F.to_timestamp("ts")), ["action"], "5 minutes", slide)
