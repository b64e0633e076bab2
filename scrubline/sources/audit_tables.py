"""Audit tables on storage: scan, append and merge.

A table is a parquet folder partitioned by ``dt``, the day of the entry, and the number of the commit that
added it, with a ledger of commits beside it.  Rows are only ever added.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from scrubline.functions.canonical import canonical_json
from scrubline.operators.audit import (
    AUDIT_COLUMNS,
    AUDIT_SCHEMA,
    assign_ids,
    LIST_DEFAULT,
    LIST_MOST,
    id_conflicts,
    list_latest,
    maybe_present,
    missing_entries,
    panel,
    source_conflicts,
    utc_day,
    with_entry_hash,
)
from scrubline.session import scratch_path, written
from scrubline.sources.ledger import Ledger, advanced, day_marks, in_days


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The committed rows of the table with their ``dt``; empty when nothing was written yet."""
    return _committed(spark, path, Ledger(spark, path).last()["commit"])


def _committed(spark: SparkSession, path: str, commit: int) -> DataFrame:
    schema = AUDIT_SCHEMA + ", dt date"
    if not commit:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema + ", commit long").parquet(path)
    return rows.where(F.col("commit") <= commit).drop("commit")


def high_water(spark: SparkSession, path: str) -> dict:
    """The highest id, the next one and the number of rows, from the ledger alone."""
    state = Ledger(spark, path).last()
    return {"max_id": state["max_id"], "next_id": state["max_id"] + 1, "rows": state["rows"]}


def marks(spark: SparkSession, path: str) -> DataFrame:
    """Rows and the range of ids of each day, from the ledger alone."""
    days = Ledger(spark, path).last()["days"]
    schema = "day string, rows long, first_id long, last_id long"
    return spark.createDataFrame([(day or None, *mark) for day, mark in sorted(days.items())], schema)


def repair_ledger(spark: SparkSession, path: str) -> dict:
    """Write the ledger of a table anew from its rows, all of which then count as committed."""
    ledger = Ledger(spark, path)
    rows = spark.read.schema(AUDIT_SCHEMA + ", dt date, commit long").parquet(path)
    newest = max(rows.agg(F.max("commit").alias("commit")).first()["commit"] or 0, ledger.last()["commit"]) + 1
    empty = {"rows": 0, "max_id": 0, "days": {}, "batches": ledger.last()["batches"]}
    state = advanced(empty, newest, day_marks(rows), None, None)
    ledger.commit(state)
    return state


def scan_audit(df: DataFrame) -> DataFrame:
    """All entries by ascending id; metadata that is no JSON becomes null."""
    return df.withColumn("metadata_json", canonical_json(F.col("metadata_json"))).orderBy("id")


def _write(spark: SparkSession, rows: DataFrame, path: str, number: int) -> None:
    dated = rows.select(*AUDIT_COLUMNS, utc_day(F.col("ts")).alias("dt"), F.lit(number).cast("long").alias("commit"))
    dated.write.mode("append").partitionBy("dt", "commit").parquet(path)


def _commit(spark: SparkSession, ledger: Ledger, state: dict, number: int, writer: str, batch: int | None) -> None:
    """Enter what lies under a claimed number into the ledger; only those rows are read."""
    schema = AUDIT_SCHEMA + ", dt date, commit long"
    try:
        rows = spark.read.schema(schema).parquet(ledger.path).where(F.col("commit") == number)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    ledger.commit(advanced(state, number, day_marks(rows), writer, batch))


def create_audit(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Write a table from rows that have ids and hashes already."""
    ledger, writer = Ledger(spark, path), uuid.uuid4().hex
    state = ledger.last()
    ledger.claim(state["commit"] + 1, writer)
    _write(spark, rows, path, state["commit"] + 1)
    _commit(spark, ledger, state, state["commit"] + 1, writer, None)


def rejects_path(path: str) -> str:
    """Where entries that cannot be hashed are kept: beside the table."""
    return path.rstrip("/") + "_rejects"


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a table that were set aside because their metadata is no JSON."""
    try:
        return spark.read.schema(AUDIT_SCHEMA).parquet(rejects_path(path))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], AUDIT_SCHEMA)


def _set_aside(spark: SparkSession, rows: DataFrame, path: str) -> int:
    """Keep rows without a hash, each as often as it comes; those kept before are not kept again."""
    fresh_path = scratch_path(spark, "rejects")
    rows.select(*AUDIT_COLUMNS).exceptAll(read_rejects(spark, path)).write.parquet(fresh_path)
    fresh = spark.read.schema(AUDIT_SCHEMA).parquet(fresh_path)
    count = fresh.count()
    if count:
        fresh.write.mode("append").parquet(rejects_path(path))
    return count


def append_audit(spark: SparkSession, events: DataFrame, path: str) -> int:
    """Hash events, number them after the last id and add them to the table, each entry once.

    Events carry every audit column but id and hash.  Those without a time get
    the current one.  The order of ids is that of time, then hash.  Returns how many were set aside.
    """
    stamped = events.withColumn(
        "ts",
        F.coalesce("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")),
    )
    return append_new(spark, stamped, path)


# a batch that touches more days than this looks through the span from its first to its last day
MOST_DAYS = 400


def append_new(
    spark: SparkSession, events: DataFrame, path: str, *, writer: str | None = None, batch: int | None = None, take_over: bool = False
) -> int:
    """Append only events whose hash the table does not hold yet, however late they are.

    A stream names itself as ``writer`` and the number of its ``batch``: a batch that is in the ledger adds nothing and reads no data, and
    one that was written but not committed is written anew.  Other writers are refused while a claim
    stands (see ``ledger``); ``take_over`` ends one that was left behind.

    Running it twice with the same events adds nothing the second time.  The
    hash covers the time, so only the days that occur in the events are looked
    through in the table.  Events that cannot be hashed are set aside in the rejects beside
    the table, never folded; their number is returned.  Ids continue
    from the highest in the ledger; no rows of other days are read.
    """
    ledger = Ledger(spark, path)
    state = ledger.last()
    if writer is not None and batch is not None and batch <= state["batches"].get(writer, -1):
        return 0
    number, writer = state["commit"] + 1, writer or uuid.uuid4().hex
    ledger.claim(number, writer, take_over)
    columns = [c for c in AUDIT_COLUMNS if c not in ("id", "entry_hash")]
    staged_path = scratch_path(spark, "append")
    with_entry_hash(events.select(*columns)).withColumn("dt", utc_day(F.col("ts"))).write.parquet(staged_path)
    staged = spark.read.schema(AUDIT_SCHEMA.removeprefix("id long, ") + ", dt date").parquet(staged_path)
    unhashed = staged.where("entry_hash IS NULL").select(F.lit(None).cast("long").alias("id"), *columns, "entry_hash")
    aside = _set_aside(spark, unhashed, path)
    hashed = staged.where("entry_hash IS NOT NULL").dropDuplicates(["entry_hash"])
    present = _committed(spark, path, state["commit"]).where(days_of(staged)).select("entry_hash")
    fresh = hashed.join(present, "entry_hash", "left_anti").drop("dt")
    _write(spark, assign_ids(fresh, ["ts", "entry_hash"], state["max_id"]), path, number)
    _commit(spark, ledger, state, number, writer, batch)
    return aside


def days_needed(state: dict, n: int, nth_of: Callable[[list[str]], int]) -> tuple[list[str], int]:
    """The days of a ledger that hold the ``n`` highest ids, and the lowest of those ids.

    ``nth_of(days)`` looks up the ``n``-th highest id of some days.  Days are walked down by highest id until the next cannot reach
    above the lowest id wanted; as late entries make days overlap, more of them may be looked at than are needed in the end.
    """
    newest = sorted(state["days"], key=lambda day: -state["days"][day][2])
    looked_at, rows = 0, 0
    while looked_at < len(newest) and rows < n:
        rows += state["days"][newest[looked_at]][0]
        looked_at += 1
    while True:
        lowest = nth_of(newest[:looked_at])
        needed = [day for day in newest if state["days"][day][2] >= lowest]
        if len(needed) <= looked_at:
            return needed, lowest
        looked_at = min(2 * looked_at, len(needed))


def newest_rows(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The rows with the ``n`` highest ids, read from the last days only.

    Ids come first and alone; the other columns are read for the days and ids that are wanted.
    """
    state = Ledger(spark, path).last()
    table = _committed(spark, path, state["commit"])
    if not state["rows"]:
        return table

    def nth_of(days: list[str]) -> int:
        ids = table.where(in_days(days)).select("id").orderBy(F.col("id").desc()).limit(n)
        return ids.agg(F.min("id").alias("id")).first()["id"]

    days, lowest = days_needed(state, n, nth_of)
    near = table.where(in_days(days) & (F.col("id") >= lowest))
    return near.orderBy(F.col("id").desc()).limit(n)


def list_latest_stored(spark: SparkSession, path: str, n: int = LIST_DEFAULT) -> DataFrame:
    """As :func:`scrubline.operators.audit.list_latest`, over a stored table."""
    return list_latest(newest_rows(spark, path, max(1, min(n, LIST_MOST))), n)


def audit_panel_stored(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`scrubline.operators.audit.audit_panel`, over a stored table."""
    return panel(newest_rows(spark, path, LIST_DEFAULT))


def days_of(rows: DataFrame) -> Column:
    """Whether ``dt`` may be a day of the entries of a stored table: one of them, or, if they are many, within their span."""
    each = rows.select(utc_day(F.col("ts")).alias("dt"))
    days = [row["dt"] for row in each.distinct().limit(MOST_DAYS + 1).collect()]
    known = [day for day in days if day is not None]
    if len(days) > MOST_DAYS:
        span = each.agg(F.min("dt").alias("first"), F.max("dt").alias("last")).first()
        near = F.col("dt").between(span["first"], span["last"])
    else:
        near = F.col("dt").isin(known) if known else F.lit(False)
    return near | F.col("dt").isNull()


def near_source(src: DataFrame, target: DataFrame) -> DataFrame:
    """The hashes of a table that a stored source may share: on its days, and past a filter of its hashes.

    Equal hashes mean equal times, so other days need not be read.  What is left is little more than what both hold, and only
    that is shuffled to meet the source.
    """
    return maybe_present(target.where(days_of(src)).select("entry_hash"), src, src.count())


def _in_id_range(target: DataFrame, state: dict, rows: DataFrame) -> DataFrame:
    """The rows of the days that may hold an id between the lowest and the highest of ``rows``, by the ledger."""
    span = rows.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    if span["low"] is None:
        return target.limit(0)
    days = [day for day, (_, first, last) in state["days"].items() if first <= span["high"] and last >= span["low"]]
    return target.where(in_days(days) & F.col("id").between(span["low"], span["high"]))


class IdConflict(RuntimeError):
    """Source and target use one id for different entries."""


def merge_audit(spark: SparkSession, src: DataFrame, path: str) -> int:
    """Copy entries with their ids and hashes; return how many were new.

    Entries the table holds already are skipped, so a second run inserts none.
    Entries without a hash are set aside in the rejects.  Conflicting ids, within the source or against the table, are looked for first and nothing is written if there are any.
    The new rows go to the shared scratch folder before they join the table, so
    they are found once, and are counted and written from there.
    """
    ledger, writer = Ledger(spark, path), uuid.uuid4().hex
    state = ledger.last()
    target = _committed(spark, path, state["commit"])
    src = written(src.select(*AUDIT_COLUMNS), "merge-source")
    staged = written(missing_entries(src, near_source(src, target)), "merge")
    if not source_conflicts(src).isEmpty() or not id_conflicts(staged, _in_id_range(target, state, staged)).isEmpty():
        raise IdConflict("the same id stands for different entries; nothing was written")
    ledger.claim(state["commit"] + 1, writer)
    _set_aside(spark, src.where("entry_hash IS NULL"), path)
    _write(spark, staged, path, state["commit"] + 1)
    _commit(spark, ledger, state, state["commit"] + 1, writer, None)
    return staged.count()
