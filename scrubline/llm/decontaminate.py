"""Benchmark decontamination by spaced-seed hashing.

A mask selects six of nine successive tokens; the hash of the selected tokens is a seed, so a changed
token at an ignored place leaves it as it was.  The three masks are such that any thirteen tokens with two
substitutions still hold a whole seed.  Seeds of the benchmark and of the documents are joined, and
around each hit the aligned tokens are compared: an overlap counts if some window of thirteen tokens agrees in
eighty percent or more of its places.

Items of fewer than thirteen tokens have masks of their own: their places fall into five blocks, and a mask ignores as many blocks as
the item may have substitutions, so one of the masks meets none of them.  The whole item is compared.

Most seeds of the documents match nothing.  A filter of fixed size holds the benchmark's seeds, and what it
lets through is joined, so a full filter costs time but never a hit.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import bodies, by_bytes, stored

MASKS = ((0, 1, 2, 3, 4, 8), (0, 1, 3, 5, 7, 8), (0, 1, 2, 5, 7, 8))
SPAN = 9
WINDOW_TOKENS = 13
AGREEING = 0.8
FILTER_BITS = 26
TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+")

# a frame is what is compared around a hit: the span of its mask and a window less one token on both sides
SIDE = WINDOW_TOKENS - 1
FRAME = SPAN + 2 * SIDE
_ODD = (np.random.default_rng(5).integers(1 << 40, 1 << 62, SPAN, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

HIT_SCHEMA = "owner long, seed long, size int, frame binary"


def token_hashes(text: bytes) -> np.ndarray:
    """A hash per token: runs of letters and digits, ASCII letters lower-cased, with what is not ASCII counted in."""
    words = TOKEN.findall(text.lower())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def seed_hashes(tokens: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The seed that starts at each token that has a whole span after it."""
    n = len(tokens) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for place, at in enumerate(mask):
        total += tokens[at : at + n] * _ODD[place]
    total ^= total >> np.uint64(32)
    total *= _ODD[-1]
    return total ^ (total >> np.uint64(29))


def _rows(owners: pa.Array, texts: list[bytes], pad: int, wanted) -> pa.RecordBatch:
    """Seeds of all texts that ``wanted`` accepts, each with its frame; ``pad`` fills frames beyond a text's ends."""
    each = [token_hashes(text) for text in texts]
    sizes = np.array([len(one) for one in each], np.int64)
    gap = np.zeros(SIDE, np.uint64)
    tokens = np.concatenate([piece for one in each for piece in (one, gap)] or [gap])
    ends = np.cumsum(sizes + SIDE) - SIDE
    starts = ends - sizes
    owner_of = np.repeat(np.arange(len(each)), sizes + SIDE)
    real = np.ones(len(tokens), bool)
    for end in ends:
        real[end : end + SIDE] = False
    at, seeds = [], []
    for mask in MASKS:
        found = seed_hashes(tokens, mask)
        owner = owner_of[: len(found)]
        keep = np.arange(len(found)) + SPAN <= ends[owner]
        keep &= wanted(found)
        places = np.flatnonzero(keep)
        at.append(places)
        seeds.append(found[places])
    at, seeds = np.concatenate(at), np.concatenate(seeds)
    owner = owner_of[at]
    # frames of 32 bits a token; two values are kept free for the pads of either side
    place = at[:, None] + np.arange(-SIDE, SPAN + SIDE)[None, :]
    inside = (place >= starts[owner][:, None]) & (place < ends[owner][:, None])
    narrow = np.maximum((tokens >> np.uint64(32)).astype(np.uint32), 2)
    frames = np.where(inside, narrow[np.clip(place, 0, len(tokens) - 1)], np.uint32(pad)).astype("<u4")
    return pa.RecordBatch.from_arrays(
        [
            owners.take(pa.array(owner)),
            pa.array(seeds.view(np.int64)),
            pa.array(np.minimum(sizes[owner], WINDOW_TOKENS).astype(np.int32)),
            pa.array([frame.tobytes() for frame in frames], pa.binary()),
        ],
        ["owner", "seed", "size", "frame"],
    )


def benchmark_seeds(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(owner, seed, size, frame) of all seeds of the items that have a window of tokens or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_bytes(batches):
            yield _rows(batch.column("owner"), texts, 1, lambda found: np.ones(len(found), bool))

    found = bodies(benchmark, id_col, text_col, "owner").mapInArrow(run, HIT_SCHEMA)
    return found.where(F.col("size") == WINDOW_TOKENS).distinct()


# --- items shorter than a window --------------------------------------------

# an item of fewer tokens counts only where it is the whole document
LEAST_PASSAGE = 5
BLOCKS = 5
SHORT_SCHEMA = "owner long, n int, seed long, frame binary"


def needed(n: int) -> int:
    """How many of ``n`` places have to agree."""
    return math.ceil(AGREEING * n)


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks over ``n`` places of which one meets none of as many substitutions as are allowed."""
    if n == needed(n):
        return [tuple(range(n))]
    blocks = [set(b.tolist()) for b in np.array_split(np.arange(n), min(n, BLOCKS))]
    return [tuple(sorted(set(range(n)).difference(*gone))) for gone in combinations(blocks, n - needed(n))]


def _short_rows(owners: pa.Array, texts: list[bytes], lengths: list[int], wanted, whole: bool) -> pa.RecordBatch:
    """Seeds of every stretch of so many tokens that ``wanted`` accepts, with the stretch; with ``whole``, of whole texts only."""
    each = [token_hashes(text) for text in texts]
    sizes = np.array([len(one) for one in each], np.int64)
    tokens = np.concatenate([*each, np.zeros(WINDOW_TOKENS, np.uint64)])
    ends = np.cumsum(sizes)
    owner_of = np.repeat(np.arange(len(each)), sizes)
    narrow = (tokens >> np.uint64(32)).astype("<u4")
    found: list[tuple] = []
    for n in lengths:
        at = np.arange(len(owner_of))
        inside = at + n <= ends[owner_of]
        if whole or n < LEAST_PASSAGE:
            inside &= sizes[owner_of] == n
            inside &= at == (ends - sizes)[owner_of]
        at = at[inside]
        for number, mask in enumerate(short_masks(n)):
            seeds = np.full(len(at), n * 64 + number, np.uint64)
            for place in mask:
                seeds = (seeds ^ tokens[at + place]) * _ODD[place % SPAN]
                seeds ^= seeds >> np.uint64(32)
            keep = np.flatnonzero(wanted(seeds))
            frames = narrow[at[keep][:, None] + np.arange(n)[None, :]]
            found.append((owner_of[at[keep]], np.full(len(keep), n, np.int32), seeds[keep], [f.tobytes() for f in frames]))
    owner, n, seed, frame = zip(*found) if found else ((), (), (), ())
    empty = np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [
            owners.take(pa.array(np.concatenate([empty, *owner]).astype(np.int64))), pa.array(np.concatenate([empty, *n]).astype(np.int32)),
            pa.array(np.concatenate([empty.astype(np.uint64), *seed]).view(np.int64)), pa.array([f for part in frame for f in part], pa.binary()),
        ],
        ["owner", "n", "seed", "frame"],
    )


def short_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, agreeing, hits) for items of one to twelve tokens, of (owner, body) on both sides.

    Equal stretches of documents and equal items meet once, so a phrase that many of them hold is compared once.
    """
    spark = docs.sparkSession

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_bytes(batches):
            yield _short_rows(batch.column("owner"), texts, list(range(1, WINDOW_TOKENS)), lambda seeds: np.ones(len(seeds), bool), True)

    items = stored(benchmark.mapInArrow(of_items, SHORT_SCHEMA).distinct(), "short-items")
    lengths = sorted(row["n"] for row in items.select("n").distinct().collect())  # twelve at most
    if not lengths:
        return spark.createDataFrame([], "doc_id long, item_id long, agreeing int, hits long")
    shared = spark.sparkContext.broadcast(seed_filter(items))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = passing(shared.value)
        for batch, texts in by_bytes(batches):
            yield _short_rows(batch.column("owner"), texts, lengths, wanted, False)

    hits = stored(docs.mapInArrow(find, SHORT_SCHEMA).distinct(), "short-hits")
    frames = hits.select("n", "seed", "frame").distinct().join(
        items.select("n", "seed", F.col("frame").alias("item_frame")).distinct(), ["n", "seed"]
    )

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(*(batch.column(c).to_pylist() for c in ("n", "frame", "item_frame")))
            agreeing = [(n, int((np.frombuffer(x, "<u4") == np.frombuffer(y, "<u4")).sum())) for n, x, y in pairs]
            keep = pa.array([k >= needed(n) for n, k in agreeing], pa.bool_())
            columns = [batch.column("n"), batch.column("frame"), batch.column("item_frame"), pa.array([k for _, k in agreeing], pa.int32())]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], ["n", "frame", "item_frame", "agreeing"])

    alike = frames.select("n", "frame", "item_frame").distinct().mapInArrow(confirm, "n int, frame binary, item_frame binary, agreeing int")
    return (
        hits.select(F.col("owner").alias("doc_id"), "n", "frame").distinct().join(alike, ["n", "frame"])
        .join(items.select(F.col("owner").alias("item_id"), "n", F.col("frame").alias("item_frame")).distinct(), ["n", "item_frame"])
        .groupBy("doc_id", "item_id").agg(F.max("agreeing").alias("agreeing"), F.count(F.lit(1)).alias("hits"))
    )


# --- all items --------------------------------------------------------------


def passing(bits: np.ndarray):
    """Whether the filter lets seeds through."""

    def wanted(found: np.ndarray) -> np.ndarray:
        slot = found >> np.uint64(64 - FILTER_BITS)
        return ((bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)

    return wanted


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A bit for each value of a seed's top bits; its size is fixed."""
    slot = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    words = (
        seeds.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 AS int))")).alias("bits"))
        .toPandas()
    )
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return table.view(np.uint8)


def overlaps(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, agreeing, hits): a row per document and item that overlap.

    ``agreeing`` is the largest number of equal tokens in a window of thirteen, or in the whole of a shorter
    item, ``hits`` the number of confirmed seeds, for shorter items of different stretches.  Items of fewer than five tokens
    count only where they are the whole document.  Texts without tokens, null and empty ones among them, give no
    rows.  Repeated rows count as one; rows without an id share the null id.
    """
    seeds = stored(benchmark_seeds(benchmark, item_col, item_text_col), "benchmark-seeds")
    shared = docs.sparkSession.sparkContext.broadcast(seed_filter(seeds))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = passing(shared.value)
        for batch, texts in by_bytes(batches):
            rows = _rows(batch.column("owner"), texts, 0, wanted)
            if len(rows):
                yield rows

    hits = bodies(docs, id_col, text_col, "owner").mapInArrow(find, HIT_SCHEMA)
    pairs = hits.select(F.col("owner").alias("doc_id"), "seed", "frame").join(
        seeds.select(F.col("owner").alias("item_id"), "seed", "size", F.col("frame").alias("item_frame")), "seed"
    )

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            frames, items = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, FRAME) for c in ("frame", "item_frame")
            )
            equal = np.concatenate([np.zeros((len(frames), 1), np.int64), np.cumsum(frames == items, axis=1)], axis=1)
            most = (equal[:, WINDOW_TOKENS:] - equal[:, :-WINDOW_TOKENS]).max(axis=1)
            needed = np.array([math.ceil(AGREEING * n) for n in range(WINDOW_TOKENS + 1)])[batch.column("size").to_numpy()]
            keep = pa.array(most >= needed)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").filter(keep), batch.column("item_id").filter(keep), pa.array(most.astype(np.int32)).filter(keep)],
                ["doc_id", "item_id", "agreeing"],
            )

    confirmed = pairs.select("doc_id", "item_id", "size", "frame", "item_frame").mapInArrow(
        confirm, "doc_id long, item_id long, agreeing int"
    )
    long = confirmed.groupBy("doc_id", "item_id").agg(F.max("agreeing").alias("agreeing"), F.count(F.lit(1)).alias("hits"))
    return long.unionByName(short_overlaps(bodies(docs, id_col, text_col, "owner"), bodies(benchmark, item_col, item_text_col, "owner")))
