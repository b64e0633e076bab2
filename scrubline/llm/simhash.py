"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two segments of 32 bits.  Two fingerprints that differ in at most
three bits differ in at most one bit in one of the segments, so it is enough to look up, for each segment,
its own value and the 32 values one bit away.  Of each pair one side has a zero at the
differing bit, so only zeros are flipped.  What falls on one table entry is then verified on all 64 bits.

Equal fingerprints are folded first.  An entry that many fingerprints share is looked up
again with the half (then quarter) segments of its remaining bits, by the same rule, until
at most eight bits are open, so no entry is compared whole when it is large.
An entry yields a spanning forest of its links, not all pairs.

Fingerprints alone do not say how alike two texts are.  ``verified_groups`` takes what they link only as blocks, within which
texts are compared by their whole sets of five-word shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import bodies, by_bytes, small_or_shuffled, stored
from scrubline.llm.components import components

SEED = 42
WORD_SET_KINDS = 4
# an entry with more fingerprints than this is cut further; it decides the way only, not the result
ENTRY_SIZE = 2048
COMPARED_AT_ONCE = 1 << 20
# the rule of near copies: shingles of so many words, and the share in tenths that two sets have in common
SHINGLE_WORDS = 5
LEAST_TENTHS = 8
# sets, and shingles of sets, that one side of a comparison holds; they decide the way only, not the result
CELL_SETS = 4096
CELL_SHINGLES = 1 << 20


# --- fingerprints -----------------------------------------------------------


def fingerprint(text: bytes, words_each: int = 3) -> int:
    """The fingerprint of one text, by the definition in ``fingerprints``."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < words_each:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(words_each))))
        hashes = [xxhash.xxh64_intdigest(s, SEED) for s in shingles]
    table = np.array(hashes, np.uint64)
    counts = np.zeros(64, np.int64)
    for start in range(0, len(table), 1 << 16):
        part = table[start : start + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(table)).tobytes(), "big")


def word_set_fingerprints(text: bytes) -> list[int]:
    """Four independent fingerprints of the set of distinct words; zeros without words."""
    counts, words = np.zeros(64 * WORD_SET_KINDS, np.int64), list(set(text.lower().split()))
    for start in range(0, len(words), 1 << 14):
        part = b"".join(xxhash.xxh3_128_digest(w, s) for w in words[start : start + (1 << 14)] for s in range(WORD_SET_KINDS // 2))
        rows = np.frombuffer(part, np.uint8).reshape(-1, 8 * WORD_SET_KINDS)
        counts += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(words)).view(">u8").astype(np.uint64).tolist()


def fingerprints(
    docs: DataFrame, *, words_each: int = 3, word_sets: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fps) of every whole text: the shingle fingerprint first, then, if asked for, those of its set of words.

    ASCII letters are lower-cased and words are what stands between ASCII white space.
    A bit is set if more than half of the shingles' XXH64 values have it, repeats
    included.  A text with fewer words is one shingle; one without words, or null, has fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [
                [fingerprint(text, words_each), *(word_set_fingerprints(text) if word_sets else ())]
                for text in batch.column("body").to_pylist()
            ]
            fps = pa.array([np.array(v, np.uint64).view(np.int64) for v in values], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fps], ["doc_id", "fps"])

    return bodies(docs, id_col, text_col).mapInArrow(run, "doc_id long, fps array<long>")


# --- links ------------------------------------------------------------------


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _zero_flips(value: Column, shift: int, width: int) -> Column:
    """The value itself and the values with one zero of the segment set."""
    bits = F.array(*[F.lit(0).cast("long"), *[F.lit(_signed(1 << (shift + b))).cast("long") for b in range(width)]])
    flips = F.filter(bits, lambda bit: value.bitwiseAND(bit) == 0)
    return F.transform(flips, lambda bit: value.bitwiseOR(bit))


def _entries(members: DataFrame, segments: list[tuple[int, int]]) -> DataFrame:
    """Table entries (kind, mask, value) of members (kind, fp, mask, value) for each further segment (shift, width)."""

    def of_segment(shift: int, width: int) -> Column:
        own = F.lit(_signed(((1 << width) - 1) << shift))
        return F.transform(
            _zero_flips(F.col("fp"), shift, width),
            lambda key: F.struct(
                F.col("mask").bitwiseOR(own).alias("mask"),
                F.col("value").bitwiseOR(key.bitwiseAND(own)).alias("value"),
            ),
        )

    found = [of_segment(shift, width) for shift, width in segments]
    return members.select("kind", "fp", F.explode(F.concat(*found)).alias("entry")).select("kind", "fp", "entry.mask", "entry.value")


def forest(values: np.ndarray, most: int = 3) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of the links between distinct fingerprints."""
    n, pairs = len(values), []
    label = np.arange(n)
    step = max(1, COMPARED_AT_ONCE // max(1, n))
    for start in range(0, n, step):
        rows = values[start : start + step]
        near = np.bitwise_count(rows[:, None] ^ values[None, :]) <= most
        near &= np.arange(n)[None, :] > np.arange(start, start + len(rows))[:, None]
        for a, b in np.argwhere(near):
            x, y = a + start, int(b)
            if label[x] != label[y]:
                pairs.append((int(x), y))
                label[label == label[y]] = label[x]
    return pairs


def links(fps: DataFrame, *, most: int = 3) -> DataFrame:
    """(kind, u, v): links that connect all distinct fingerprints of a kind which differ in at most ``most`` <= 3 bits."""
    if not 0 <= most <= 3:
        raise ValueError("two segments looked up at one bit cover at most three differing bits")

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = np.unique(rows["fp"].to_numpy().view(np.uint64))
        pairs = np.array(forest(values, most), np.int64).reshape(-1, 2)
        signed = values.view(np.int64)
        return pd.DataFrame({"kind": np.int32(key[0]), "u": signed[pairs[:, 0]], "v": signed[pairs[:, 1]]})

    start = fps.select("kind", "fp").distinct().withColumn("mask", F.lit(0).cast("long")).withColumn("value", F.lit(0).cast("long"))
    entries, found = None, []
    for depth, width in enumerate((32, 16, 8)):
        if depth == 0:
            entries = _entries(start, [(32, 32), (0, 32)])
            # only values that are some fingerprint's own segment can hold a link
            shares = [F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in (0xFFFFFFFF << 32, 0xFFFFFFFF)]
            own = start.select(
                "kind", F.explode(F.array(*[
                    F.struct(F.lit(_signed(m)).alias("mask"), share.alias("value"))
                    for m, share in zip((0xFFFFFFFF << 32, 0xFFFFFFFF), shares)
                ])).alias("e")
            ).select("kind", "e.mask", "e.value").distinct()
            entries = entries.join(own, ["kind", "mask", "value"], "left_semi")
        else:
            parts = []
            # the open bits of a mask are one run of 2 * width bits; each half is a segment
            for shift in range(0, 64, 2 * width):
                open_bits = F.lit(_signed(((1 << 2 * width) - 1) << shift))
                here = entries.where(F.col("mask").bitwiseAND(open_bits) == 0)
                parts.append(_entries(here, [(shift, width), (shift + width, width)]))
            merged = parts[0]
            for part in parts[1:]:
                merged = merged.unionByName(part)
            entries = merged.distinct()
        entries = stored(entries, "entries")
        sizes = entries.groupBy("kind", "mask", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        last = width == 8
        small = sizes if last else sizes.where(F.col("n") <= ENTRY_SIZE)
        grouped = entries.join(small.drop("n"), ["kind", "mask", "value"], "left_semi")
        found.append(grouped.groupBy("kind", "mask", "value").applyInPandas(compare, "kind int, u long, v long"))
        if last:
            break
        large = sizes.where(F.col("n") > ENTRY_SIZE).drop("n")
        entries = entries.join(large, ["kind", "mask", "value"], "left_semi")
        if large.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def near_duplicates(
    docs: DataFrame, *, words_each: int = 3, most: int = 3, also_word_sets: bool = False, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """A row per document: doc_id, fingerprint, and the smallest doc_id of its group.

    Fingerprints link at ``most`` or fewer differing bits, and groups are what links reach.
    ``also_word_sets`` links texts by four more fingerprints, those of their sets of words, any of which is enough:
    a changed word moves three shingles but one member of the set, so more near copies are found.
    Null, empty and blank texts share fingerprint 0.  Rows with equal ids each give a row.  A
    row without an id takes the smallest id of its group, null if the group has none.
    """
    rows = stored(
        fingerprints(docs, words_each=words_each, word_sets=also_word_sets, id_col=id_col, text_col=text_col), "fingerprints"
    )
    each = rows.select("doc_id", F.posexplode("fps").alias("kind", "fp"))
    heads = stored(each.groupBy("kind", "fp").agg(F.min("doc_id").alias("head")), "fingerprint-heads")
    found = stored(links(heads, most=most), "fingerprint-links")
    pairs = (
        found.join(heads.select("kind", F.col("fp").alias("u"), F.col("head").alias("a")), ["kind", "u"])
        .join(heads.select("kind", F.col("fp").alias("v"), F.col("head").alias("b")), ["kind", "v"]).select("a", "b")
    )
    if also_word_sets:
        # the kinds of a document meet in the document itself
        pairs = pairs.unionByName(
            each.join(heads, ["kind", "fp"]).select(F.col("doc_id").alias("a"), F.col("head").alias("b")).where("a <> b")
        )
    groups = components(pairs, "a", "b")
    first = heads.where("kind = 0").select("fp", "head")
    lookup = stored(
        first.join(groups, first["head"] == groups["node"], "left").select("fp", F.coalesce("component", "head").alias("component_id")),
        "fingerprint-groups",
    )
    return rows.select("doc_id", F.col("fps")[0].alias("fp")).join(lookup, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# --- verified groups --------------------------------------------------------


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct five-word shingles; a text with fewer words is one, one without words none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE_WORDS)))) if len(words) >= SHINGLE_WORDS else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64))


def _set_key(shingles: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(shingles.tobytes(), SEED))


def _signatures(docs: DataFrame, words_each: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, fps): a text's shingle set by its hash, and all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("body").to_pylist()
            keys = pa.array([_set_key(shingle_set(text)) for text in texts], pa.int64())
            values = [[fingerprint(text, words_each), *word_set_fingerprints(text)] for text in texts]
            fps = pa.array([np.array(v, np.uint64).view(np.int64) for v in values], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), keys, fps], ["doc_id", "key", "fps"])

    return bodies(docs, id_col, text_col).mapInArrow(run, "doc_id long, key long, fps array<long>")


def _shingle_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, shingles) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_bytes(batches):
            sets = [shingle_set(text) for text in texts]
            shingles = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([_set_key(s) for s in sets], pa.int64()), shingles], ["key", "shingles"])

    return bodies(docs, id_col, text_col).mapInArrow(run, "key long, shingles array<long>")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) of keys whose shingle sets share eight tenths of their union or more."""
    both = (
        pairs.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
        .join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a")
        .select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("shared"))
    )
    return both.where(f"10 * shared >= {LEAST_TENTHS} * (nx + ny - shared)").select("a", "b")


def group_links(own: np.ndarray, sets: list[np.ndarray], firsts: int | None = None) -> list[tuple[int, int]]:
    """Index pairs of alike sets that connect the groups ``own`` of the sets just as all their alike pairs do.

    With ``firsts``, only pairs of one of the first so many sets with one of the others count.  How many shingles two sets share is
    counted from lists of the holders of a shingle, or, for shingles that very many hold, by a matrix product of bounded slices.
    """
    label = np.unique(own, return_inverse=True)[1]
    n, m = np.array([len(s) for s in sets], np.int64), len(sets)
    rows, columns = (m, slice(0, m)) if firsts is None else (firsts, slice(firsts, m))
    if not m or label.min() == label.max() or columns.start == m or not rows:
        return []
    flat, holder = np.concatenate(sets), np.repeat(np.arange(m), n)
    order = np.argsort(flat, kind="stable")
    flat, holder = flat[order], holder[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.empty(0, np.int64)
    held = np.diff(np.append(first, len(flat)))
    shared = np.zeros((rows, m - columns.start), np.float32)
    if len(first):
        several = np.minimum.reduceat(label[holder], first) < np.maximum.reduceat(label[holder], first)
        common = held > max(64, m // 8)
        # few holders: every pair of them, those so many places apart in a shingle's list at a time
        few = np.flatnonzero(np.repeat(several & ~common, held))
        who, left = holder[few], (np.repeat(first + held, held) - np.arange(len(flat)))[few]
        at, apart = np.arange(len(few)), 0
        while True:
            apart += 1
            at = at[left[at] > apart]
            if not len(at):
                break
            x, y = who[at], who[at + apart]
            across = (x < rows) & (y >= columns.start)
            np.add.at(shared.reshape(-1), x[across] * shared.shape[1] + y[across] - columns.start, np.float32(1))
        many = np.flatnonzero(several & common)
        for start in range(0, len(many), 1024):
            some = many[start : start + 1024]
            has = np.zeros((m, len(some)), np.float32)
            for k, s in enumerate(some):
                has[holder[first[s] : first[s] + held[s]], k] = 1
            shared += has[:rows] @ has[columns].T
    found = []
    for x in range(rows):
        alike = (10 + LEAST_TENTHS) * shared[x].astype(np.int64) >= LEAST_TENTHS * (n[x] + n[columns])
        alike &= label[columns] != label[x]
        if firsts is None:
            alike[: x + 1] = False
        y = np.flatnonzero(alike) + columns.start
        if len(y):
            others, place = np.unique(label[y], return_index=True)
            found += [(x, int(k)) for k in y[place]]
            label[np.isin(label, others)] = label[x]
    return found


def _open_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): keys of alike sets that connect the groups of a block wherever two sets of different groups are alike.

    ``members`` (key, block, own, n) are stored; n is the size of the set.  A block of bounded size is compared in one task.  A larger one is cut
    into bands of like size, sets of bands that are no neighbours not being alike, and bands into cells of bounded size; each
    two cells that may hold alike sets meet in a task of their own, so that all pairs are looked at and no task or table holds them.
    """
    sums = [F.count(F.lit(1)).alias("held"), F.sum("n").alias("total")]
    blocks = stored(members.groupBy("block").agg(*sums), "block-sizes")
    large = F.expr(f"held > {CELL_SETS} OR total > {CELL_SHINGLES}")
    # sizes of alike sets differ by a factor of 10 / LEAST_TENTHS at most, which is less than a band's
    band = F.when(large, F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / float(np.log(10.08 / LEAST_TENTHS)))).otherwise(F.lit(0))
    banded = members.join(small_or_shuffled(blocks), "block").select("key", "block", "own", "n", band.cast("long").alias("band"))
    cells = banded.groupBy("block", "band").agg(*sums).select(
        "block", "band", F.ceil(F.greatest(F.col("held") / CELL_SETS, F.col("total") / CELL_SHINGLES, F.lit(1))).cast("int").alias("parts")
    )
    cells = stored(cells, "cells")
    for name, step in (("here", 0), ("above", 1), ("below", -1)):
        near = cells.select("block", (F.col("band") - step).alias("band"), F.col("parts").alias(name))
        banded = banded.join(small_or_shuffled(near), ["block", "band"], "left")
    units = """concat(
        transform(sequence(0, here - 1), q -> struct(band AS lo, least(part, q) AS lo_part, band AS hi, greatest(part, q) AS hi_part, part > q AS second)),
        filter(transform(sequence(0, coalesce(above, 0)), q -> struct(band AS lo, part AS lo_part, band + 1 AS hi, q AS hi_part, false AS second)),
               u -> u.hi_part < coalesce(above, 0)),
        filter(transform(sequence(0, coalesce(below, 0)), q -> struct(band - 1 AS lo, q AS lo_part, band AS hi, part AS hi_part, true AS second)),
               u -> u.lo_part < coalesce(below, 0)))"""
    part = F.pmod(F.xxhash64("key"), F.col("here").cast("long")).cast("int")
    placed = banded.withColumn("part", part).select("key", "block", "own", F.expr(units).alias("units"))
    met = placed.join(sets, "key").select("key", "block", "own", "shingles", F.explode("units").alias("u")).select("key", "block", "own", "shingles", "u.*")

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("second", kind="stable")
        firsts = int((~rows["second"]).sum()) if key[1:3] != key[3:5] else None
        keys = rows["key"].to_numpy()
        pairs = np.array(group_links(rows["own"].to_numpy(), rows["shingles"].tolist(), firsts), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": keys[pairs[:, 0]], "b": keys[pairs[:, 1]]})

    return met.groupBy("block", "lo", "lo_part", "hi", "hi_part").applyInPandas(compare, "a long, b long")


def verified_groups(docs: DataFrame, *, words_each: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id and the smallest doc_id of its group.

    Two texts link if their whole sets of five-word shingles have a Jaccard similarity of 0.8 or more; groups are what links
    reach.  Pairs are looked for within blocks: what fingerprints of shingles and of word sets connect.  First the links
    of a block's spanning forest are verified, then every pair its groups leave open that can be alike.
    Texts with equal sets are one.  Rows with equal ids each give a row.  A row without an id takes the smallest id of its
    group, null if the group has none.
    """
    rows = stored(_signatures(docs, words_each, id_col, text_col), "signatures")
    each = rows.select("key", F.posexplode("fps").alias("kind", "fp")).distinct()
    heads = stored(each.groupBy("kind", "fp").agg(F.min("key").alias("head")), "signature-heads")
    found = stored(links(heads), "signature-links")
    pairs = (
        found.join(heads.select("kind", F.col("fp").alias("u"), F.col("head").alias("a")), ["kind", "u"])
        .join(heads.select("kind", F.col("fp").alias("v"), F.col("head").alias("b")), ["kind", "v"]).select("a", "b")
        .unionByName(each.join(heads, ["kind", "fp"]).select(F.col("key").alias("a"), F.col("head").alias("b")))
        .where("a <> b")
    )
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    blocks = stored(components(pairs, "a", "b"), "blocks")
    nodes = blocks.select(F.col("node").alias("key"), F.col("component").alias("block"))
    # one text of each set is read again; a text without an id cannot be looked up, so all of those are read
    wanted = stored(
        rows.join(nodes, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("wanted_id")).where("wanted_id IS NOT NULL")
        .select("wanted_id").distinct(),
        "wanted",
    )
    named = docs.join(small_or_shuffled(wanted), docs[id_col].cast("long") == F.col("wanted_id"), "left_semi")
    texts = named.unionByName(docs.where(F.col(id_col).isNull())).select(id_col, text_col)
    sets = stored(_shingle_sets(texts, id_col, text_col).join(nodes, "key", "left_semi").dropDuplicates(["key"]), "shingle-sets")
    linked = stored(_alike(pairs, sets), "verified-links")
    groups = components(linked, "a", "b")
    members = stored(
        nodes.join(groups.withColumnRenamed("node", "key"), "key", "left").select("key", "block", F.coalesce("component", "key").alias("own")),
        "members",
    )
    open_blocks = members.groupBy("block").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low < high").select("block")
    sizes = sets.select("key", F.size("shingles").alias("n"))
    more = _open_links(stored(members.join(open_blocks, "block", "left_semi").join(sizes, "key"), "open-members"), sets)
    groups = components(linked.unionByName(more), "a", "b")
    placed = stored(
        rows.join(groups.withColumnRenamed("node", "key"), "key", "left").select("doc_id", F.coalesce("component", "key").alias("component")),
        "placed",
    )
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "component").select("doc_id", "component_id")
