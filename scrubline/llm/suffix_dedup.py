"""Repeated passages across documents, by blockwise suffix sorting with a difference cover.

A string of ``length`` bytes counts as repeated where it also starts in a document with a smaller id.

Copies of whole texts are set aside first: a copy loses everything, and the smallest document stands for it.

1. Every string is assigned to the least hash of the 24-byte pieces it holds.  Neighbouring strings share
   it, so a text falls into short stretches, one key each, and equal strings always fall to equal keys.
2. A filter tells which keys may occur twice; stretches with other keys go no further.  Its size follows from the
   counted keys; at its largest it lets more stretches through, which costs work and changes no result.
3. Equal stretches are folded to the smallest document that holds them.
4. The different stretches of a key are brought together, and the suffixes of a block of stretches are sorted
   one bucket at a time: by eight bytes first, and long ties by the ranks of a difference
   cover.  Positions that are 0, 1 or 3 modulo 7 are ranked beforehand; any two suffixes reach ranked positions
   after the same step of at most six bytes, so a tie is decided by two ranks, however long it is.  Neighbours that agree in
   ``length`` bytes form a class, and its smallest document decides.
   A key with very many stretches (one passage between ever different neighbours) is not brought to one task: its strings are
   grouped by value, which combines before the shuffle.
5. What is repeated is joined back to every document and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import bodies, by_bytes, small_or_shuffled, stored, tidy

PIECE = 24
# bits of the address of a filter, at least and at most (16 to 128 MB); in between it has eight bits for each key
LEAST_FILTER, MOST_FILTER = 27, 30
# keys are gathered in buckets by their top bits; a bucket stands for so many bytes of text
BUCKET_TEXT = 1 << 26
LEAST_BUCKETS, MOST_BUCKETS = 12, 20
MOST_STRINGS = 64
# places travel with a number of strings or bytes as one number
SPAN_BITS = 8
SPAN_UNIT = 1 << SPAN_BITS
BLOCK_BYTES = 6 << 20
BUCKET_SUFFIXES = 1 << 19
# a stretch is known by 128 bits
IDENTITY = ["stretch_hash", "stretch_check"]
# keys with more stretches than this are grouped by value instead of sorted in one task
STRETCHES_AT_ONCE = 65_536

PERIOD = 7
COVER = (0, 1, 3)
# the step after which suffixes at residues a and b both stand in the cover
STEP = [[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)]
_PLACE = np.array([COVER.index(r) if r in COVER else -1 for r in range(PERIOD)])

_ODD = (np.random.default_rng(3).integers(1 << 40, 1 << 62, 4, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


# --- stretches --------------------------------------------------------------


def stretches(texts: list[bytes], length: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, and key, text, place and number of strings of every stretch."""
    data = b"".join(texts) + bytes(8)
    total = len(data) - 8
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    none = np.empty(0, np.int64)
    if total < length:
        return data, none.astype(np.uint64), none, none, none
    words = np.ndarray((total,), "<u8", data, strides=(1,))
    n = total - PIECE + 1
    hashes = words[:n] * _ODD[0]
    for step in (8, PIECE - 8):
        hashes += words[step : step + n] * _ODD[step // 8]
        hashes ^= hashes >> np.uint64(31)
    hashes *= _ODD[3]
    hashes ^= hashes >> np.uint64(29)
    # least hash of the pieces of each string, doubling the reach
    width, size, least = length - PIECE + 1, 1, hashes
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if width > size:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    # strings that would reach beyond their text are left out
    real = np.ones(len(least), bool)
    for end in ends[:-1]:
        real[max(0, end - length + 1) : end] = False
    first = real.copy()
    first[1:] &= ~(real[:-1] & (least[1:] == least[:-1]))
    starts = np.flatnonzero(first)
    stops = np.flatnonzero(real & ~np.append(real[1:] & ~first[1:], False)) + 1
    counts = stops - starts
    if counts.size and counts.max() > MOST_STRINGS:
        cuts = (counts + MOST_STRINGS - 1) // MOST_STRINGS
        within = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        starts = np.repeat(starts, cuts) + within * MOST_STRINGS
        counts = np.minimum(MOST_STRINGS, np.repeat(counts, cuts) - within * MOST_STRINGS)
    owner = np.searchsorted(ends, starts, side="right")
    # least hashes crowd at the low end; multiplied, they spread over all buckets and bits
    return data, least[starts] * _ODD[2], owner, starts, counts


def filter_size(keys: int) -> int:
    """Bits of the address of a filter for so many keys."""
    return min(MOST_FILTER, max(LEAST_FILTER, (8 * keys).bit_length()))


def _bit_table(rows: DataFrame, buckets: int, size: int) -> np.ndarray:
    """All bits of a filter of rows (bucket, bits)."""
    table = np.zeros((1 << buckets, (1 << (size - buckets)) // 8), np.uint8)
    with tidy(rows.sparkSession):
        found = rows.collect()
    for row in found:
        table[row["bucket"]] = np.frombuffer(row["bits"], np.uint8)
    return table.reshape(-1)


def repeat_filter(texts: DataFrame, length: int) -> tuple[np.ndarray, int]:
    """Bits, by the top of a key, of the keys that may occur twice, and the bits of their address."""
    total = texts.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, (total // BUCKET_TEXT).bit_length()))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, some in by_bytes(batches):
            _, keys, owner, _, _ = stretches(some, length)
            keys >>= np.uint64(32 - buckets)
            order = np.argsort(keys)
            keys, owner = keys[order], owner[order]
            same = keys[1:] == keys[:-1]
            # a key of several documents has neighbours of different documents
            again = np.unique(keys[1:][same & (owner[1:] != owner[:-1])])
            once = keys[np.append(~same, True)] if len(keys) else keys
            bounds = np.arange((1 << buckets) + 1, dtype=np.uint64) << np.uint64(32)
            at, at_again = np.searchsorted(once, bounds[:-1]), np.searchsorted(again, bounds[:-1])
            parts = [np.split(x.astype("<u4"), cut[1:]) for x, cut in ((once, at), (again, at_again))]
            kept = [k for k, one in enumerate(parts[0]) if len(one)]
            if kept:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kept, pa.int32()), *(pa.array([part[k].tobytes() for k in kept], pa.binary()) for part in parts)],
                    ["bucket", "once", "again"],
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def twice_of(bucket: int, once: list[bytes], again: list[bytes]) -> tuple[int, int, bytes]:
            keys = np.sort(np.frombuffer(b"".join(once), "<u4"))
            twice = np.unique(np.concatenate([keys[1:][keys[1:] == keys[:-1]], np.frombuffer(b"".join(again), "<u4")]))
            return bucket, len(twice), twice.tobytes()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], ["bucket", "n", "twice"])

        now, once, again, done = None, [], [], []
        for batch in batches:
            for bucket, one, more in zip(*(batch.column(c).to_pylist() for c in ("bucket", "once", "again"))):
                if bucket != now:
                    if now is not None:
                        done.append(twice_of(now, once, again))
                    now, once, again = bucket, [], []
                once.append(one)
                again.append(more)
                if len(done) == 256:
                    yield batch_of(done)
                    done = []
        if now is not None:
            done.append(twice_of(now, once, again))
        if done:
            yield batch_of(done)

    def to_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for keys in batch.column("twice").to_pylist():
                bits = np.zeros(1 << (size - buckets), bool)
                bits[np.frombuffer(keys, "<u4") >> np.uint32(32 - (size - buckets))] = True
                found.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(found, pa.binary())], ["bucket", "bits"])

    twice = stored(
        texts.select("body").mapInArrow(gather, "bucket int, once binary, again binary")
        .repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, "bucket int, n long, twice binary"),
        "keys-twice",
    )
    size = filter_size(twice.agg(F.sum("n")).first()[0] or 0)
    return _bit_table(twice.select("bucket", "twice").mapInArrow(to_bits, "bucket int, bits binary"), buckets, size), size


def _has(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return ((bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _head_slot(stretch_hash: np.ndarray, doc_id: np.ndarray, size: int) -> np.ndarray:
    return (stretch_hash ^ (doc_id.view(np.uint64) << np.uint64(64 - size))) >> np.uint64(64 - size)


def head_filter(heads: DataFrame) -> tuple[np.ndarray, int]:
    """Bits of the pairs (stretch, smallest document), and the bits of their address."""
    size = filter_size(heads.count())
    rest, low = 64 - size, size - LEAST_BUCKETS

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = np.sort(batch.column("slot").to_numpy())
            buckets, first = np.unique(slot >> low, return_index=True)
            for bucket, some in zip(buckets.tolist(), np.split(slot, first[1:])):
                bits = np.zeros(1 << low, bool)
                bits[some & ((1 << low) - 1)] = True
                packed = np.packbits(bits, bitorder="little")
                found[bucket] = found[bucket] | packed if bucket in found else packed
        rows = [bits.tobytes() for bits in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(rows, pa.binary())], ["bucket", "bits"])

    slot = F.shiftrightunsigned(F.col("stretch_hash").bitwiseXOR(F.shiftleft("head", rest)), rest)
    slots = heads.select(slot.alias("slot")).repartition(F.shiftright("slot", low))
    return _bit_table(slots.mapInArrow(merge, "bucket int, bits binary"), LEAST_BUCKETS, size), size


def _hits(texts: DataFrame, length: int, keys_bits, heads_bits, schema: str) -> DataFrame:
    """Stretches the filters let through, without their bytes, or, given the filter of heads, with them."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, size = keys_bits.value
        heads, heads_size = heads_bits.value if heads_bits else (None, 0)
        for batch, some in by_bytes(batches):
            data, keys, owner, starts, counts = stretches(some, length)
            hit = np.flatnonzero(_has(bits, keys >> np.uint64(64 - size)))
            sizes = np.fromiter(map(len, some), np.int64, len(some))
            begins = np.cumsum(sizes) - sizes
            ids = batch.column("doc_id").to_numpy()
            for at in range(0, len(hit), 50_000):
                part = hit[at : at + 50_000]
                pieces = [data[s:e] for s, e in zip(starts[part].tolist(), (starts[part] + counts[part] + length - 1).tolist())]
                digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), "<u8").reshape(-1, 2)
                hashes, checks = np.ascontiguousarray(digests.T)
                who = owner[part]
                if heads is None:
                    columns = [
                        batch.column("doc_id").take(pa.array(who)), batch.column("text_key").take(pa.array(who)),
                        pa.array((starts[part] - begins[who]) * SPAN_UNIT + counts[part]), pa.array(hashes.view(np.int64)), pa.array(checks.view(np.int64)),
                    ]
                else:
                    of = np.flatnonzero(_has(heads, _head_slot(hashes, ids[who], heads_size)))
                    columns = [
                        pa.array(keys[part][of].view(np.int64)), pa.array(hashes[of].view(np.int64)), pa.array(checks[of].view(np.int64)),
                        pa.array(ids[who[of]]), pa.array([pieces[k] for k in of], pa.binary()),
                    ]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [part.split()[0] for part in schema.split(", ")]
    return texts.where("doc_id IS NOT NULL").mapInArrow(find, schema)


def candidate_stretches(texts: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Places of all stretches that may be repeated; the smallest document of each; the bytes of each, once.

    The bytes of a stretch are read again where its smallest document lies, instead of moving those of every copy.
    The second filter may let through other documents too; ``repeats_within`` sorts them like any others.
    """
    context = texts.sparkSession.sparkContext
    keys = context.broadcast(repeat_filter(texts, length))
    places = stored(
        _hits(texts, length, keys, None, "doc_id long, text_key long, at long, stretch_hash long, stretch_check long"), "stretches"
    )
    heads = stored(places.groupBy(*IDENTITY).agg(F.min("doc_id").alias("head")), "stretch-heads")
    bits = context.broadcast(head_filter(heads))
    distinct = stored(
        _hits(texts, length, keys, bits, "key long, stretch_hash long, stretch_check long, head long, stretch binary"), "distinct-stretches"
    )
    # the tables are stored, so no later task needs the filters
    keys.destroy()
    bits.destroy()
    return places, heads, distinct


# --- suffix sorting ---------------------------------------------------------


def cover_ranks(text: bytes, depth: int) -> np.ndarray:
    """Ranks of the positions in the cover by at least ``depth`` bytes, equal where those are equal."""
    groups = (len(text) - 7) // PERIOD
    words = np.ndarray((groups * PERIOD,), ">u8", text, strides=(1,))
    at = (np.arange(groups)[:, None] * PERIOD + np.array(COVER)[None, :]).reshape(-1)
    names = words[at].astype(np.uint64) >> np.uint64(8)
    reach = PERIOD
    while True:
        order = np.argsort(names)
        ordered = names[order]
        ranks = np.empty(len(names), np.uint64)
        ranks[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) if len(names) else ordered
        if reach >= depth:
            return ranks
        ahead = reach // PERIOD * len(COVER)
        names = (ranks + np.uint64(1)) << np.uint64(32)
        names[: len(ranks) - ahead] |= ranks[ahead:] + np.uint64(1)
        reach *= 2


def sort_bucket(text: bytes, suffixes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that share eight bytes with another one, in order, and the group of each."""
    words = np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))
    heads = words[suffixes].astype(np.uint64)
    order = np.argsort(heads)
    ordered = heads[order]
    same = np.concatenate([[False], ordered[1:] == ordered[:-1]])
    tied = same | np.append(same[1:], False)
    suffixes = suffixes[order][tied]
    group = np.cumsum(~same)[tied].astype(np.uint64) << np.uint64(32)
    # how many tied suffixes come before each, counted against one residue at a time
    residue = suffixes % PERIOD
    members = [np.flatnonzero(residue == r) for r in range(PERIOD)]

    def keys(rows: np.ndarray, step: int) -> np.ndarray:
        at = suffixes[rows] + step
        return group[rows] | ranks[at // PERIOD * len(COVER) + _PLACE[at % PERIOD]]

    before = np.zeros(len(suffixes), np.int64)
    for a in range(PERIOD):
        own = keys(members[a], STEP[a][a])
        place = np.empty(len(own), np.int64)
        place[np.argsort(own)] = np.arange(len(own))
        before[members[a]] += place
        for b in range(PERIOD):
            if a != b and len(own) and len(members[b]):
                step = STEP[a][b]
                against = np.sort(keys(members[b], step))
                before[members[a]] += np.searchsorted(against, keys(members[a], step), side="right" if b < a else "left")
    order = np.argsort(before, kind="stable")
    return suffixes[order], group[order]


def repeated_strings(pieces: list[bytes], docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, place) of the strings that a piece of a smaller document holds as well."""
    # a gap keeps reads beyond the last piece inside the text
    text = b"".join(pieces) + bytes(length + 4 * PERIOD * 8)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begins = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(pieces)), counts)
    suffixes = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begins[owner]
    ranks = cover_ranks(text, length)
    raw = np.frombuffer(text, np.uint8)
    words = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    lead = raw[suffixes].astype(np.int64) << 8 | raw[suffixes + 1]
    sums = np.cumsum(np.bincount(lead, minlength=1 << 16))
    bucket_of = (np.concatenate([[0], sums[:-1]]) // BUCKET_SUFFIXES)[lead]
    found = []
    for bucket in np.unique(bucket_of):
        ordered, group = sort_bucket(text, suffixes[bucket_of == bucket], ranks)
        if not len(ordered):
            continue
        equal = group[1:] == group[:-1]
        for step in [*range(8, length - 8, 8), length - 8]:
            at = np.flatnonzero(equal)
            equal[at] = words[ordered[at] + step] == words[ordered[at + 1] + step]
        first = np.flatnonzero(np.concatenate([[True], ~equal]))
        holder = np.searchsorted(begins, ordered, side="right") - 1
        doc = docs[holder]
        least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(ordered))))
        hit = least < doc
        found.append(ordered[hit])
    places = np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)
    piece = np.searchsorted(begins, places, side="right") - 1
    return piece, places - begins[piece]


def repeats_within(distinct: DataFrame, length: int) -> DataFrame:
    """(stretch_hash, stretch_check, head, spans): the runs of strings of distinct stretches that a smaller document holds elsewhere."""
    sizes = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    large = stored(sizes.where(F.col("n") > STRETCHES_AT_ONCE).select("key"), "large-keys")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block() -> pa.RecordBatch | None:
            piece, place = repeated_strings(stretch, np.array(docs), length)
            if not len(piece):
                return None
            new = np.concatenate([[True], (piece[1:] != piece[:-1]) | (place[1:] != place[:-1] + 1)])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(piece)) - 1
            rows = piece[first].tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array([hashes[r] for r in rows]), pa.array([checks[r] for r in rows]), pa.array([docs[r] for r in rows]), pa.array(place[first].astype(np.int32)),
                 pa.array((place[last] + 1).astype(np.int32))], [*IDENTITY, "head", "from", "to"])

        keys, hashes, checks, docs, stretch, size = [], [], [], [], [], 0
        group: list[tuple] = []

        def close(group: list[tuple]) -> int:
            # a stretch alone under its key has nothing to meet
            if len(group) < 2:
                return 0
            for row in group:
                for column, value in zip((keys, hashes, checks, docs, stretch), row):
                    column.append(value)
            return sum(len(row[-1]) for row in group)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", *IDENTITY, "head", "stretch"))):
                if group and row[0] != group[0][0]:
                    size += close(group)
                    group = []
                    if size >= BLOCK_BYTES:
                        if (found := block()) is not None:
                            yield found
                        keys, hashes, checks, docs, stretch, size = [], [], [], [], [], 0
                group.append(row)
        size += close(group)
        if size and (found := block()) is not None:
            yield found

    schema = "stretch_hash long, stretch_check long, head long, from int, to int"
    sorted_ones = (
        distinct.join(large, "key", "left_anti").select("key", *IDENTITY, "head", "stretch")
        .repartition("key").sortWithinPartitions("key").mapInArrow(sort, schema)
    )
    strings = distinct.join(large, "key", "left_semi").select(
        *IDENTITY, "head",
        F.posexplode(F.expr(f"transform(sequence(1, octet_length(stretch) - {length - 1}), k -> substring(stretch, k, {length}))")).alias("from", "string"),
    )
    least = strings.groupBy("string").agg(F.min("head").alias("least"))
    grouped_ones = strings.join(least, "string").where("least < head").select(
        *IDENTITY, "head", "from", (F.col("from") + 1).alias("to")
    )
    spans = sorted_ones.unionByName(grouped_ones)
    return stored(
        spans.groupBy(*IDENTITY, "head").agg(F.collect_list(F.struct("from", "to")).alias("spans")), "inner-spans"
    )


# --- documents --------------------------------------------------------------


def cut_out(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of a text, and the number of maximal removed runs."""
    kept, at, runs = [], 0, 0
    for start, end in sorted(spans):
        if start > at or not runs:
            kept.append(text[at:start])
            runs += 1
        at = max(at, end)
    kept.append(text[at:])
    return b"".join(kept), runs


def remove_repeats(
    docs: DataFrame, *, length: int = 50, id_col: str = "doc_id", text_col: str = "text", texts_too: bool = False, carry: tuple[str, ...] = ()
) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``texts_too`` what is left as ``kept_text``.

    Removed is every byte of a string of ``length`` bytes that also starts in a document with a smaller id, judged
    on the whole input.  A null text is an empty one.  A row without an id loses nothing and takes
    nothing from others; rows with equal ids never remove from each other.  Where a cut splits a character, ``kept_text``
    leaves out the rest of it; the hash covers all remaining bytes.  ``carry`` names columns to
    hand on, as ``carried_0`` and so on.
    """
    if length < 2 * PIECE:
        raise ValueError(f"strings of at least {2 * PIECE} bytes")
    if length - 1 + MOST_STRINGS >= SPAN_UNIT:
        raise ValueError(f"strings of at most {SPAN_UNIT - MOST_STRINGS} bytes")
    # rows with equal ids but different texts are told apart
    hashed = F.xxhash64("doc_id", "body")
    texts = bodies(docs, id_col, text_col).withColumn("text_key", hashed)
    lights = texts.select("doc_id", "text_key", F.sha2("body", 256).alias("digest"), F.octet_length("body").cast("long").alias("n"))
    firsts = lights.groupBy("digest").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copies = stored(
        lights.join(firsts.drop("copies"), "digest").where("doc_id > head").select("doc_id", "text_key", "n").distinct(), "copies"
    )
    own = texts.join(small_or_shuffled(copies.drop("n")), ["doc_id", "text_key"], "left_anti")
    found, heads, distinct = candidate_stretches(own, length)
    inside = repeats_within(distinct, length)
    named = heads.select(*IDENTITY, "head").join(inside, [*IDENTITY, "head"], "left")
    # a stretch that a smaller document holds as a whole is repeated as a whole
    whole = F.array(F.struct(F.lit(0).alias("from"), F.col("strings").alias("to")))
    # a span is one number: its place, and its length, which is less than the unit
    spans = (
        found.join(named, IDENTITY)
        .withColumn("place", F.shiftright("at", SPAN_BITS)).withColumn("strings", F.col("at").bitwiseAND(SPAN_UNIT - 1).cast("int"))
        .select("doc_id", "text_key", "place", F.explode(F.when(F.col("doc_id") > F.col("head"), whole).otherwise(F.col("spans"))).alias("s"))
        .select("doc_id", "text_key", (F.shiftleft(F.col("place") + F.col("s.from"), SPAN_BITS) + (F.col("s.to") - F.col("s.from") + (length - 1))).alias("span"))
    )
    by_doc = stored(spans.groupBy("doc_id", "text_key").agg(F.collect_list("span").alias("spans")), "spans")
    carried = [F.col(f"`{name}`").alias(f"carried_{k}") for k, name in enumerate(carry)]
    whole_docs = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"), *carried
    ).withColumn("text_key", hashed)
    copied = copies.select("doc_id", "text_key", F.lit(True).alias("copy"))
    named_by = ["doc_id", "text_key"]
    joined = whole_docs.join(by_doc, named_by, "left").join(small_or_shuffled(copied), named_by, "left").drop("text_key")
    names = [name for name in joined.columns if name.startswith("carried_")]

    kept_text = ["kept_text"] if texts_too else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, some in by_bytes(batches):
            left = []
            for text, spans, copy in zip(some, batch.column("spans").to_pylist(), batch.column("copy").to_pylist()):
                runs = [(s >> SPAN_BITS, (s >> SPAN_BITS) + (s & (SPAN_UNIT - 1))) for s in spans or ()]
                left.append(cut_out(text, [(0, len(text))] if copy and len(text) >= length else runs))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(list(map(len, some)), pa.int64()),
                 pa.array([len(t) - len(k) for t, (k, _) in zip(some, left)], pa.int64()), pa.array([n for _, n in left], pa.int64()),
                 pa.array([hashlib.sha256(k).hexdigest() for k, _ in left]),
                 *([pa.array([k.decode("utf-8", "ignore") for k, _ in left], pa.string())] if texts_too else []), *(batch.column(name) for name in names)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *kept_text, *names],
            )

    kinds = ", kept_text string" * texts_too + "".join(f", {name} {joined.schema[name].dataType.simpleString()}" for name in names)
    return joined.mapInArrow(
        cut, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{kinds}"
    )
