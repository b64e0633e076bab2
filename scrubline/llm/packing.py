"""Packing along a space-filling curve.

The token counts of a document, hashed to a short vector, are projected to a few dimensions, and the
Hilbert index of that point is the document's key.  Documents are range-sorted by key, so each
partition holds one stretch of the curve, and neighbours on it fill the same sequences.
Documents are cut where a sequence ends; only the last sequence of a stretch is not full, and it
is split into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import bodies, by_bytes, stored

SEQUENCE = 1024
HASHED = 256
AXES = 4
AXIS_BITS = 12
# the pattern of byte-level pre-tokenizers, a fixed value
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_WORD = re.compile(r"\S{2000}|\s{2000}")

PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


# --- keys -------------------------------------------------------------------


def hilbert(points: np.ndarray, bits: int = AXIS_BITS) -> np.ndarray:
    """Hilbert indices of integer points (rows, axes) with ``bits`` bits an axis."""
    x = points.astype(np.int64).T.copy()
    axes = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(axes):
            set_here = (x[i] & q) != 0
            swap = np.where(set_here, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_here, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = top
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    index = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            index = (index << 1) | ((x[i] >> bit) & 1)
    return index


def projection(seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((HASHED, AXES))


def curve_keys(vectors: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Keys of hashed document vectors (rows, HASHED); documents with like vectors are close."""
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    points = (vectors / np.maximum(norms, 1e-12)) @ axes
    cells = (1 + np.tanh(points)) / 2 * (1 << AXIS_BITS)
    return hilbert(np.clip(cells, 0, (1 << AXIS_BITS) - 1).astype(np.int64))


# --- tokens -----------------------------------------------------------------


def _byte_of_character() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Token ids of texts by a byte-level tokenizer file of the tokenizers library.

    Where ids are merge ranks, as in such files, tiktoken gives the same ids from the same file in a quarter of the
    time; other files, and texts with very long words, go to the library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as file:
            self.ranked = self._ranked(json.load(file))

    @staticmethod
    def _ranked(parts: dict):
        """The tiktoken twin of a plain byte-level file, None if it has no exact twin."""
        import tiktoken

        model, before = parts["model"], parts.get("pre_tokenizer") or {}
        plain = (
            model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex")
            and not before.get("add_prefix_space") and not parts.get("normalizer")
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        )
        added = parts.get("added_tokens", [])
        if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            return None
        special = {t["content"]: t["id"] for t in added}
        merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        if any(model["vocab"].get(m.replace(" ", "")) != 256 + k for k, m in enumerate(merged)):
            return None
        to_byte = _byte_of_character()
        ranks = {bytes(map(to_byte.__getitem__, t)): k for t, k in model["vocab"].items() if t not in special}
        return tiktoken.Encoding("twin", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed in the encoder's number type."""
        out = []
        for text in texts:
            if self.ranked is None or LONG_WORD.search(text):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            else:
                ids = self.ranked.encode(text, allowed_special="all", disallowed_special=())
            out.append(np.array(ids, self.kind).tobytes())
        return out


def keyed_tokens(
    docs: DataFrame, tokenizer_path: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(key, doc_id, wide, ids): curve key and token ids with the end id, packed in two bytes, or four where ``wide``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, axes = Encoder(tokenizer_path), projection()
        end = np.array([end_id], encoder.kind).tobytes()
        wide = encoder.kind.itemsize == 4
        for batch, texts in by_bytes(batches):
            ids = [one + end for one in encoder.encode([text.decode("utf-8", "replace") for text in texts])]
            vectors = np.zeros((len(ids), HASHED))
            for at, one in enumerate(ids):
                hashed = (np.frombuffer(one, encoder.kind).astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)
                vectors[at] = np.sqrt(np.bincount(hashed, minlength=HASHED))
            yield pa.RecordBatch.from_arrays(
                [pa.array(curve_keys(vectors, axes)), batch.column("doc_id"), pa.array([wide] * len(ids)), pa.array(ids, pa.binary())],
                ["key", "doc_id", "wide", "ids"],
            )

    return bodies(docs, id_col, text_col).mapInArrow(run, "key long, doc_id long, wide boolean, ids binary")


# --- sequences --------------------------------------------------------------


def cut_stretch(documents: Iterator[tuple[int | None, np.ndarray]], size: int = SEQUENCE) -> Iterator[tuple]:
    """Pieces (doc_id, start, ids, doc_tokens, sequence, offset) of documents in order; sequences count from 0."""
    sequence, used, waiting = 0, 0, []
    for doc_id, ids in documents:
        start = 0
        while start < len(ids):
            length = min(size - used, len(ids) - start)
            waiting.append((doc_id, start, ids[start : start + length], len(ids), sequence, used))
            start, used = start + length, used + length
            if used == size:
                yield from waiting
                sequence, used, waiting = sequence + 1, 0, []
    # the rest: sequences of the powers of two that add up to it
    room = offset = 0
    for doc_id, start, ids, total, *_ in waiting:
        at = 0
        while at < len(ids):
            if offset == room:
                sequence += bool(room)
                room, offset = 1 << (used.bit_length() - 1), 0
                used -= room
            length = min(room - offset, len(ids) - at)
            yield doc_id, start + at, ids[at : at + length], total, sequence, offset
            at, offset = at + length, offset + length


def pack(
    docs: DataFrame, tokenizer_path: str, *, size: int = SEQUENCE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row per piece: which ids of which document lie where in which sequence.

    Every id of every document, with the end id, lies in exactly one piece.  A null text is an empty one and holds the end id alone.
    Rows with equal or null ids are packed one by one.  Sequences have ``size`` ids or a power of two of them.
    """
    tokens = stored(keyed_tokens(docs, tokenizer_path, end_id=end_id, id_col=id_col, text_col=text_col), "tokens")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33

        def documents() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in batches:
                for doc_id, wide, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "wide", "ids"))):
                    yield doc_id, np.frombuffer(ids, "<u4" if wide else "<u2")

        rows: list[tuple] = []
        for doc_id, start, ids, total, sequence, offset in cut_stretch(documents(), size):
            rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, first + sequence, offset))
            if len(rows) == 20_000:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in zip(*rows)], names)

    return (
        tokens.repartitionByRange(parts, "key", "doc_id")
        .sortWithinPartitions("key", "doc_id", F.xxhash64("ids"))
        .mapInArrow(run, PIECE_SCHEMA)
    )
