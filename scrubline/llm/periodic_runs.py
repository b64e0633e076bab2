"""Runs of a repeated period in texts, by scale-tiled distribution.

A run of period q and length at least 3q has a match interval, the places i with word[i] = word[i+q], of at least
2q places.  Periods are taken octave by octave, q in [P, 2P).  Boundaries stand every P words, so each match interval
holds one after which at least P words match.  The tile of a boundary is the words from P before it to 4P after it; tiles of
neighbouring boundaries overlap, and tiles in which no block of P words comes again q places on (by a rolling
hash, so only more may pass) are not made at all.  Tiles are solved one by one, wherever they are: the Z-function
of the words after the boundary gives how far each period matches to the right, that of the reversed words how far to the left.
The fragments of a document and period then meet in a shuffle and are stitched where they touch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubline.llm.common import bodies, by_bytes, crc_of, stored

LEAST_LENGTH = 24
LEAST_PERIODS = 3
# the first octave takes all periods below twice this; match intervals there have 16 places or more
FIRST_OCTAVE = 8
WORD = r"[^\x20\x09-\x0D]+"

TILE = "struct<octave:int,at:long,lead:int,wide:boolean,words:binary>"
SCANNED = f"key long, doc_id long, n_words long, body binary, collapsed string, tiles array<{TILE}>"
RUN_SCHEMA = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


# --- one tile ---------------------------------------------------------------


def z_function(s: list[int]) -> list[int]:
    """For every place, how many items from there on equal the first items."""
    n = len(s)
    z = [n] + [0] * (n - 1)
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def solve_tile(octave: int, lead: int, words: list[int]) -> list[tuple[int, int, int]]:
    """(period, words matched before the boundary, words matched after it) of a tile whose boundary is at ``lead``.

    Only periods of the octave after which ``octave`` words match, and of which the period itself is no
    repetition of a shorter one.
    """
    after = words[lead:]
    z = z_function(after) if after else []
    lowest = 1 if octave == FIRST_OCTAVE else octave
    found = [q for q in range(lowest, min(2 * octave, len(z))) if z[q] >= octave]
    if not found:
        return []
    shorter = [d for d in range(1, min(octave, len(z))) if z[d] + d >= lowest]
    found = [q for q in found if not any(q % d == 0 and z[d] >= q - d for d in shorter if d < q)]
    if not found or not lead:
        return [(q, 0, z[q]) for q in found]
    stop = min(len(words), lead + 2 * octave)
    back = z_function([*words[lead - 1 :: -1], -1, *words[stop - 1 :: -1]])
    return [(q, min(lead, back[lead + 1 + stop - lead - q]), z[q]) for q in found]


def candidates(hashed: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(octave, boundaries) where a block of ``octave`` words may come again within the octave's periods."""
    block, octave, base = hashed, 1, np.uint64(0x9E3779B97F4A7C15)
    while octave < FIRST_OCTAVE:
        block, base, octave = block[:-octave] + base * block[octave:], base * base, 2 * octave
    while LEAST_PERIODS * octave <= max(longest, LEAST_LENGTH) and len(block):
        rows = -(-len(block) // octave) + 1
        tiled = np.zeros((rows, octave), np.uint64)
        tiled.reshape(-1)[: len(block)] = block
        if octave == FIRST_OCTAVE:
            hit = (tiled[:-1, 1:] == tiled[:-1, :1]).any(axis=1) | (tiled[1:] == tiled[:-1, :1]).any(axis=1)
        else:
            hit = (tiled[1:] == tiled[:-1, :1]).any(axis=1)
        yield octave, np.flatnonzero(hit) * octave
        block = block[:-octave] + base * block[octave:] if len(block) > octave else block[:0]
        base, octave = base * base, 2 * octave


def tiles_of(words: list[list[bytes]]) -> list[list[tuple[int, int, int, np.ndarray]]]:
    """The tiles (octave, boundary, lead, word numbers) of each text of a batch."""
    counts = np.array([len(w) for w in words], np.int64)
    codes, _ = pd.factorize(np.array([w for one in words for w in one], object))
    # behind each text stands a number of its own, so that nothing matches across texts
    starts = np.concatenate(([0], np.cumsum(counts + 1)))
    line = np.empty(starts[-1], np.int64)
    ends = starts[1:] - 1
    inside = np.ones(len(line), bool)
    inside[ends] = False
    line[inside] = codes
    line[ends] = len(codes) + 1 + np.arange(len(words))
    with np.errstate(over="ignore"):
        mixed = (line.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(32)
        out: list[list] = [[] for _ in words]
        for octave, boundaries in candidates(mixed, int(counts.max(initial=0))):
            for at, doc in zip(boundaries.tolist(), (np.searchsorted(starts, boundaries, "right") - 1).tolist()):
                low, high = max(at - octave, starts[doc]), min(at + 4 * octave, ends[doc])
                if high - at > octave:
                    out[doc].append((octave, at - int(starts[doc]), int(at - low), line[low:high]))
    return out


# --- whole texts ------------------------------------------------------------


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run (start, length, period) holds after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [word for word, kept in zip(words, keep.tolist()) if kept]


def smallest_first(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs by start, then period."""
    return sorted(runs, key=lambda run: (run[0], run[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; ties: smallest start, then period."""
    near = max((length / period for _, length, period in runs), default=0) * (1 - 1e-9)
    close = [run for run in runs if run[1] / run[2] >= near]
    return min(close, key=lambda run: (-Fraction(run[1], run[2]), run[0], run[2]), default=None)


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per text: its tiles and its bytes, or, where it has no tile, the digest of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch, texts in by_bytes(batches):
            words = [text.split() for text in texts]
            rows = []
            for text, own, tiles in zip(texts, words, tiles_of(words)):
                packed = []
                for octave, at, lead, numbers in tiles:
                    kinds, small = np.unique(numbers, return_inverse=True)
                    wide = len(kinds) > 1 << 16
                    packed.append({"octave": octave, "at": at, "lead": lead, "wide": wide, "words": small.astype("<u4" if wide else "<u2").tobytes()})
                rows.append((key, len(own), text if packed else None, None if packed else _digest(b" ".join(own)), packed))
                key += 1
            keys, counts, kept, digests, packed = zip(*rows)
            kind = pa.list_(pa.struct([("octave", pa.int32()), ("at", pa.int64()), ("lead", pa.int32()), ("wide", pa.bool_()), ("words", pa.binary())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(kept, pa.binary()), pa.array(digests, pa.string()), pa.array(packed, kind)],
                ["key", "doc_id", "n_words", "body", "collapsed", "tiles"],
            )

    return bodies(docs, id_col, text_col).mapInArrow(run, SCANNED)


def fragments(tiles: DataFrame) -> DataFrame:
    """(key, period, first, stop): match intervals that tiles (key, octave, at, lead, wide, words) hold, cut at their edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tile in batch.to_pylist():
                numbers = np.frombuffer(tile["words"], "<u4" if tile["wide"] else "<u2").tolist()
                for period, before, after in solve_tile(tile["octave"], tile["lead"], numbers):
                    rows.append((tile["key"], period, tile["at"] - before, tile["at"] + after))
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "period", "first", "stop"])

    return tiles.mapInArrow(run, "key long, period long, first long, stop long")


def stitch(parts: DataFrame) -> DataFrame:
    """(key, start, length, period): whole runs from fragments of match intervals that overlap or touch."""
    of_period = Window.partitionBy("key", "period").orderBy("first", "stop")
    reached = F.max("stop").over(of_period.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("first") > reached).cast("long"), F.lit(1))
    numbered = parts.withColumn("opens", opens).withColumn("run", F.sum("opens").over(of_period.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("key", "period", "run").agg(F.min("first").alias("start"), (F.max("stop") - F.min("first") + F.col("period")).alias("length"))
    return whole.where((F.col("length") >= LEAST_LENGTH) & (F.col("length") >= LEAST_PERIODS * F.col("period"))).select("key", "start", "length", "period")


def runs_table(scanned: DataFrame) -> DataFrame:
    """(key, start, length, period) of all runs of a stored scan; a long text's tiles spread over tasks."""
    tiles = scanned.select("key", F.inline("tiles")).repartition("key", "octave", "at")
    return stitch(fragments(tiles))


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per text: how many runs, the strongest one, and digests of all runs and of the text without repeats.

    Words are what white space of ASCII parts.  A run is a longest stretch of words with smallest period q that has at least
    24 words and three periods.  Null, empty and blank texts have no words, hence no runs and the digest of
    nothing.  Rows with equal or null ids each give a row; an empty table gives none.
    """
    scanned = stored(scan(docs, id_col, text_col), "tiles")
    runs = runs_table(scanned).groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    some = scanned.where("body IS NOT NULL").select("key", "doc_id", "n_words", "body").join(runs, "key", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_bytes(batches):
            rows = []
            for doc_id, text, found in zip(batch.column("doc_id").to_pylist(), texts, batch.column("runs").to_pylist()):
                runs = smallest_first([(r["start"], r["length"], r["period"]) for r in found or []])
                words = text.split()
                best = strongest(runs)
                listed = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
                rows.append((
                    doc_id, len(words), len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
                    _digest(listed.encode()), _digest(b" ".join(collapse(words, runs))),
                ))
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in RUN_SCHEMA.split(", ")])

    none = F.lit(None).cast("long")
    clean = scanned.where("body IS NULL").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_runs"),
        *[none.alias(c) for c in ("start", "length", "period", "exponent_milli")],
        F.lit(_digest(b"")).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"),
    )
    return clean.unionByName(some.select("doc_id", "n_words", "body", "runs").mapInArrow(finish, RUN_SCHEMA))


# --- planted repeats --------------------------------------------------------


def with_planted_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents of which one in ten, by the checksum of the id, repeats a stretch of words to its end.

    Words are then parted by one space.  Other texts, and texts without words, stay as they are.
    """
    seed = F.floor(crc_of(id_col) / 10)
    marked = docs.withColumn("__words", F.when(crc_of(id_col) % 10 == 0, F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))))
    words, n = F.col("__words"), F.size("__words")

    def whole(column: Column) -> Column:
        return column.cast("int")

    first = whole(seed % n)
    period = whole(1 + F.floor((n - F.col("__first")) / (3 + seed % 8)))
    marked = marked.withColumn("__first", F.when(n > 0, first)).withColumn("__period", F.when(n > 0, period))
    times = whole(F.ceil((n - F.col("__first")) / F.col("__period")))
    tail = F.flatten(F.array_repeat(F.slice(words, F.col("__first") + 1, F.col("__period")), times))
    line = F.slice(F.concat(F.slice(words, F.lit(1), F.col("__first")), tail), F.lit(1), n)
    changed = F.when(F.col("__period").isNotNull(), F.array_join(line, " ")).otherwise(F.col(text_col))
    return marked.withColumn(text_col, changed).drop("__words", "__first", "__period")
