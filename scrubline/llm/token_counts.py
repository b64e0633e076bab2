"""Token counts: batch encoding in Arrow functions that returns lengths only.

Texts wait until about four megabytes are together, whatever their number.  Each
is cut at white space, which this kind of tokenizer drops, so no token crosses a cut;
pieces without white space that are still long are cut between characters that never share a
token.  Equal pieces of a batch are encoded once, and only lengths leave the encoder.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from scrubline.llm.common import bodies, by_bytes

# pieces and their counts are kept for later batches up to so many bytes and pieces
KEPT_BYTES = 16 << 20
KEPT_PIECES = 400_000
LONG_PIECE = 1024
# a boundary on both sides of an ASCII digit, or between an ASCII letter and an ASCII mark other than an apostrophe
SAFE_CUT = re.compile(
    r"(?<=[0-9])(?=[\x00-\x7f])|(?<=[\x00-\x7f])(?=[0-9])"
    r"|(?<=[A-Za-z])(?=[!-&(-/:-@\[-`{-~])|(?<=[!-&(-/:-@\[-`{-~])(?=[A-Za-z])"
)

COUNT_SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def safe_parts(piece: str, size: int = LONG_PIECE) -> list[str]:
    """Parts of a long piece whose tokens are together those of the piece.

    Parts are at least ``size`` characters where the piece allows it.  A piece that may hold a special
    string stays whole.
    """
    if "<|" in piece or "|>" in piece:
        return [piece]
    parts, start = [], 0
    for found in SAFE_CUT.finditer(piece):
        if found.start() - start >= size:
            parts.append(piece[start : found.start()])
            start = found.start()
    return [*parts, piece[start:]]


def token_counts(
    docs: DataFrame, tokenizer_path: str, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Bytes and tokens of every whole text, and whether it has more than ``limit`` tokens.

    Null and empty texts have no bytes and no tokens.  Rows with equal or null ids each give a row.
    For tokenizers that drop white space; special strings inside texts count as the library counts them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        known: dict[bytes, int] = {}
        kept = 0

        def encode(pieces: list[bytes]) -> None:
            long, short = [], []
            for piece in pieces:
                (long if len(piece) > LONG_PIECE else short).append(piece)
            for start in range(0, len(short), 20_000):
                some = short[start : start + 20_000]
                found = tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)
                known.update(zip(some, map(len, found)))
            for piece in long:
                parts, total = safe_parts(piece.decode()), 0
                for start in range(0, len(parts), 256):
                    found = tokenizer.encode_batch_fast(parts[start : start + 256], add_special_tokens=False)
                    total += sum(map(len, found))
                known[piece] = total

        for batch, texts in by_bytes(batches):
            split = [text.split() for text in texts]
            wanted = set().union(*split)
            new = wanted.difference(known)
            if len(known) + len(new) > KEPT_PIECES or kept + sum(map(len, new)) > KEPT_BYTES:
                known.clear()
                kept, new = 0, wanted
            encode(list(new))
            kept += sum(map(len, new))
            counts = [sum(map(known.__getitem__, pieces)) for pieces in split]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(list(map(len, texts)), pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n > limit for n in counts], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return bodies(docs, id_col, text_col).mapInArrow(count, COUNT_SCHEMA)
