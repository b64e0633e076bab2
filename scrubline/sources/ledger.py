"""The ledger beside an audit table: one small file per commit.

A commit's file states the table as it is after it: the number of the commit, the highest id, the rows and the range of ids of each
day, and the last batch of each stream that writes.  So an append learns its first id, a listing the days it has
to read, and a replayed batch that it is done, from one file and none of the data.

A writer claims the next number before it writes data, and its rows go to folders that carry that number.  Rows of a number
that was never committed are not part of the table; whoever holds the claim writes them anew.  Claims and
commits are files that must not exist yet, so on a file system that creates files atomically a second writer is refused.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT, CLAIM = "commit", "claim"
EMPTY = {"commit": 0, "rows": 0, "max_id": 0, "days": {}, "batches": {}}
# the key of rows whose time cannot be read, in a ledger
NO_DAY = ""


class ConcurrentWriter(RuntimeError):
    """Another writer is at work on the table, or was when it stopped."""


class Ledger:
    """``path`` is that of the table; the ledger lies beside it."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self.folder = self.path + "_ledger"
        self.jvm = spark._jvm
        self.files = self._hadoop(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _create(self, name: str, text: str) -> bool:
        """Write a file that does not exist yet; false if it does."""
        target = self._hadoop(f"{self.folder}/{name}")
        self.files.mkdirs(self._hadoop(self.folder))
        try:
            out = self.files.create(target, False)
        except Py4JJavaError as error:
            if self.files.exists(target):
                return False
            raise error
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def _read(self, name: str) -> dict | None:
        target = self._hadoop(f"{self.folder}/{name}")
        if not self.files.exists(target):
            return None
        stream = self.files.open(target)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def exists(self) -> bool:
        return self.files.exists(self._hadoop(self.folder))

    def last(self) -> dict:
        """What the newest commit says; of a table that was never written, that it is empty."""
        if not self.exists():
            return json.loads(json.dumps(EMPTY))
        names = [status.getPath().getName() for status in self.files.listStatus(self._hadoop(self.folder))]
        commits = sorted(name for name in names if name.startswith(COMMIT))
        return (self._read(commits[-1]) if commits else None) or json.loads(json.dumps(EMPTY))

    def claim(self, number: int, writer: str, take_over: bool = False) -> None:
        """Reserve a commit for a writer; the same writer may claim it again after a failure.

        ``take_over`` ends the claim of a writer that is known to have stopped for good.
        """
        name = f"{CLAIM}-{number:012d}.json"
        if take_over:
            self.files.delete(self._hadoop(f"{self.folder}/{name}"), False)
        if not self._create(name, json.dumps({"writer": writer})):
            holder = (self._read(name) or {}).get("writer")
            if holder != writer:
                raise ConcurrentWriter(f"commit {number} of {self.path} is claimed by {holder}")
        for status in self.files.globStatus(self._hadoop(f"{self.path}/*/commit={number}")) or []:
            self.files.delete(status.getPath(), True)

    def commit(self, state: dict) -> None:
        if not self._create(f"{COMMIT}-{state['commit']:012d}.json", json.dumps(state, sort_keys=True)):
            raise ConcurrentWriter(f"commit {state['commit']} of {self.path} exists already")


def advanced(state: dict, number: int, marks: DataFrame, writer: str | None, batch: int | None) -> dict:
    """The state after a commit; ``marks`` has a row per day written: dt, rows, first_id, last_id."""
    days, rows, highest = dict(state["days"]), state["rows"], state["max_id"]
    for mark in marks.collect():
        key = str(mark["dt"]) if mark["dt"] is not None else NO_DAY
        old = days.get(key, [0, mark["first_id"], mark["last_id"]])
        days[key] = [old[0] + mark["rows"], min(old[1], mark["first_id"]), max(old[2], mark["last_id"])]
        rows, highest = rows + mark["rows"], max(highest, mark["last_id"])
    batches = state["batches"] | ({writer: batch} if batch is not None else {})
    return {"commit": number, "rows": rows, "max_id": highest, "days": days, "batches": batches}


def day_marks(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dt").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def in_days(days: list[str]) -> Column:
    """Whether ``dt`` is one of a ledger's days."""
    known = [day for day in days if day != NO_DAY]
    near = F.col("dt").isin([F.lit(day).cast("date") for day in known]) if known else F.lit(False)
    return near | F.col("dt").isNull() if NO_DAY in days else near
