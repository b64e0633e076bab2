"""Best-fit packing planned on a histogram of lengths.

Best fit decreasing places items one by one; here it places counts of equal items, so the plan costs the same
whether a length occurs once or a billion times.  The plan says which ranks of which length go to which
sequences.  A document's rank within its length comes from a count per task and a prefix sum over tasks,
so no task ever sees all documents of a length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubline.llm.common import bodies, by_bytes, stored
from scrubline.llm.packing import Encoder

SEQUENCE = 1024
# rows of an Arrow batch on the way out
ROWS_OUT = 20_000
# a rank within a length takes fewer bits than this
RANK_BITS = 48

CUT_SCHEMA = "task int, rank long, doc_id long, piece int, start long, length int, ids_crc32 long"
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def plan_counts(histogram: dict[int, int], size: int = SEQUENCE) -> np.ndarray:
    """Best fit decreasing over counts: rows (length, first rank, items a sequence, first sequence, offset).

    Items of one length that fall into sequences with equal room are placed together.  Sequences that were filled
    alike so far are one range of numbers, which a placement moves whole or splits in at most three, so there are
    at most ``4 * size`` ranges.  No sequence holds more than ``sqrt(2 * size)`` different lengths, which bounds
    the rows of the plan by the product of both, whatever the counts.
    """
    ranges: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by room left: (first sequence, how many)
    plan, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= size:
            raise ValueError(f"length {length} does not fit in {size}")
        left, rank, room = histogram[length], 0, length
        while left:
            while room < size and not ranges[room]:
                room += 1
            each = room // length
            if ranges[room]:
                first, many = ranges[room].pop()
            else:  # nothing fits: new sequences
                first, many = sequences, -(-left // each)
                sequences += many
            full = min(many, left // each)
            if full:
                plan.append((length, rank, each, first, size - room))
                ranges[room - each * length].append((first, full))
                rank, left = rank + full * each, left - full * each
            if full < many and left:  # fewer than fill one more
                plan.append((length, rank, left, first + full, size - room))
                ranges[room - left * length].append((first + full, 1))
                full, left = full + 1, 0
            if full < many:
                ranges[room].append((first + full, many - full))
    return np.array(sorted(plan), np.int64).reshape(-1, 5)


def cut_tokens(
    docs: DataFrame, tokenizer_path: str, *, size: int = SEQUENCE, end_id: int = 2,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``size`` ids, with the task that cut them and their rank in it among pieces of that length.

    ``with_ids`` adds the ids themselves as ``ids``, unsigned 32-bit little-endian.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder(tokenizer_path), TaskContext.get().partitionId()
        seen = [0] * (size + 1)
        rows: list[tuple] = []
        for batch, texts in by_bytes(batches):
            encoded = encoder.encode([text.decode("utf-8", "replace") for text in texts])
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(), encoded):
                ids = np.append(np.frombuffer(packed, encoder.kind), end_id).astype("<u4")
                stop = (len(ids) - 1) % size + 1  # the first piece takes what is over
                start = piece = 0
                while start < len(ids):
                    data = ids[start:stop].tobytes()
                    row = (task, seen[stop - start], doc_id, piece, start, stop - start, zlib.crc32(data))
                    rows.append((*row, data) if with_ids else row)
                    seen[stop - start] += 1
                    start, stop, piece = stop, stop + size, piece + 1
                if len(rows) >= ROWS_OUT:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    kinds = {"task": pa.int32(), "rank": pa.int64(), "doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int32(), "ids_crc32": pa.int64()}
    kinds |= {"ids": pa.binary()} if with_ids else {}

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds.values())]
        return pa.RecordBatch.from_arrays(arrays, list(kinds))

    return bodies(docs, id_col, text_col).mapInArrow(run, CUT_SCHEMA + (", ids binary" if with_ids else ""))


def pack(
    docs: DataFrame, tokenizer_path: str, *, size: int = SEQUENCE, end_id: int = 2,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """A row per piece: which ids of which document lie where in which sequence.

    A document is its ids and ``end_id``; a null text is an empty one and holds the end id alone.  Documents of at
    most ``size`` ids stay whole.  Longer ones are cut into pieces of ``size``, of which the first takes the
    remainder.  Rows with equal or null ids are packed one by one.  An empty table has no pieces.
    """
    spark = docs.sparkSession
    cut = stored(cut_tokens(docs, tokenizer_path, size=size, end_id=end_id, id_col=id_col, text_col=text_col, with_ids=with_ids), "cut")
    by_task = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("items"))
    # at most ``size`` rows reach the driver, however many documents there are
    histogram = {r["length"]: r["items"] for r in by_task.groupBy("length").agg(F.sum("items").alias("items")).collect()}
    planned = spark.sparkContext.broadcast(plan_counts(histogram, size))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("task", "length", F.coalesce(F.sum("items").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["task", "length"]).withColumn("rank", F.col("base") + F.col("rank")).drop("task", "base")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = planned.value
        firsts = (plan[:, 0] << RANK_BITS) | plan[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy()
            row = plan[np.searchsorted(firsts, (length << RANK_BITS) | rank, "right") - 1]
            sequence, slot = np.divmod(rank - row[:, 1], np.maximum(row[:, 2], 1))
            out = {
                "doc_id": batch.column("doc_id"),
                "piece": batch.column("piece"),
                "start": batch.column("start"),
                "length": pa.array(length),
                "ids_crc32": batch.column("ids_crc32"),
                "sequence_id": pa.array(row[:, 3] + sequence),
                "offset": pa.array(row[:, 4] + slot * length),
            }
            if with_ids:
                out["ids"] = batch.column("ids")
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return ranked.mapInArrow(place, PIECE_SCHEMA + (", ids binary" if with_ids else ""))
