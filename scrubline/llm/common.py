"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.session import scratch_path

# Texts that wait in a worker for a vectorised step are bounded by bytes, not rows.
BATCH_BYTES = 4 << 20


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back.

    Unlike a cached or locally checkpointed table it survives lost executors,
    and a plan that uses it twice computes it once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, an action's shuffle files are removed when the action ends, not some time later."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def shipped(spark: SparkSession, value) -> Broadcast:
    """A value for every task, as bytes that ``pickle.loads`` reads.

    A broadcast of an object of this package is written by reference, and workers need not have the package; these bytes hold its class
    too where the package is registered to go by value.
    """
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def bodies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_id: str = "doc_id") -> DataFrame:
    """Ids as long and whole texts as UTF-8 bytes; a null text is an empty one."""
    return docs.select(
        F.col(id_col).cast("long").alias(out_id),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"),
    )


def crc_of(id_col: str | Column) -> Column:
    """crc32 of an id's decimal text; a null id counts as the empty text."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def by_bytes(
    batches: Iterator[pa.RecordBatch], column: str = "body", limit: int = BATCH_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Arrow batches cut anew so that each holds about ``limit`` bytes of text, or one row."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column)).to_pylist()
        start = size = 0
        for at, value in enumerate(values):
            if size and size + len(value) > limit:
                yield batch.slice(start, at - start), values[start:at]
                start, size = at, 0
            size += len(value)
        if values:
            yield batch.slice(start), values[start:]


# a table of ids with at most so many rows is sent to every task; a larger one is joined by a shuffle
BROADCAST_IDS = 2_000_000


def small_or_shuffled(ids: DataFrame) -> DataFrame:
    """A stored table of a few numbers a row, marked for broadcast only if its counted size allows it."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
