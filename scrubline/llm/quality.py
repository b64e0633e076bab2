"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is cut into bins.  Shallow trees over the bins of one feature are boosted
in turn, feature after feature, and their leaves are added into a lookup table per feature; then
the pairs of features that explain most of what is left get tables in the same way.  A score is the
logistic of the sum of the table entries of a text's bins.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``); features and
scores cover every whole text.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import bodies, by_bytes, shipped, stored

SAMPLE_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 120
PAIR_ROUNDS = 60
RATE = 0.15
LEAST_ROWS = 8

FEATURES = [
    "log_bytes", "log_words", "bytes_per_word", "upper_share", "digit_share", "symbol_share", "mark_share",
    "high_share", "line_share", "words_per_line", "distinct_words", "distinct_lines", "longest_line",
    "symbol_words", "ends_marked",
]

_UPPER, _LOWER, _DIGIT, _MARK, _SYMBOL, _HIGH, _SPACE = range(7)
_KIND = np.full(256, _SYMBOL, np.uint8)
_KIND[128:] = _HIGH
_KIND[ord("A") : ord("Z") + 1] = _UPPER
_KIND[ord("a") : ord("z") + 1] = _LOWER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[list(b".,;:!?'\"()-")] = _MARK
_KIND[list(b" \t\n\r\x0b\x0c")] = _SPACE


def features(texts: list[bytes]) -> np.ndarray:
    """(texts, features) of whole texts; an empty text has zeros."""
    found = np.zeros((len(texts), len(FEATURES)))
    for at, text in enumerate(texts):
        if not text:
            continue
        counts = np.zeros(256, np.int64)
        for start in range(0, len(text), 1 << 20):
            counts += np.bincount(np.frombuffer(text[start : start + (1 << 20)], np.uint8), minlength=256)
        kinds = np.bincount(_KIND, counts, 7)
        words, lines = text.split(), text.split(b"\n")
        n, w = len(text), max(1, len(words))
        distinct = set(words)
        inked = max(1.0, n - kinds[_SPACE])
        symbols = sum(word[-1] < 128 and not word[-1:].isalnum() for word in words)
        found[at] = (
            np.log1p(n), np.log1p(len(words)), n / w, kinds[_UPPER] / max(1.0, kinds[_UPPER] + kinds[_LOWER]),
            kinds[_DIGIT] / inked, kinds[_SYMBOL] / inked, kinds[_MARK] / inked, kinds[_HIGH] / inked,
            len(lines) / w, w / len(lines), len(distinct) / w, len(set(lines)) / len(lines),
            len(max(lines, key=len)) / n, symbols / w, sum(line[-1:] in (b".", b"!", b"?") for line in lines) / len(lines),
        )
    return found


@dataclass
class Model:
    """Bin edges of each feature, the base score, and a lookup table per feature and per pair."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, values: np.ndarray) -> np.ndarray:
        """Probabilities by adding the table entries of all bins at once."""
        total = np.full(len(values), self.base)
        for k, (edges, entries) in enumerate(zip(self.edges, self.tables)):
            total += entries[np.searchsorted(edges, values[:, k], side="right")]
        for (a, b), entries in zip(self.pairs, self.pair_tables):
            one = np.searchsorted(self.coarse[a], values[:, a], side="right")
            two = np.searchsorted(self.coarse[b], values[:, b], side="right")
            total += entries[one, two]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _gain(slope: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return slope * slope / (weight + 1.0)


def _tree(slope: np.ndarray, weight: np.ndarray, rows: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Leaf values per bin of a tree with at most ``leaves`` leaves, each split the best at its time."""
    spans = [(0, len(slope))]
    while len(spans) < leaves:
        best = None
        for start, end in spans:
            s, w, n = (np.cumsum(x[start:end]) for x in (slope, weight, rows))
            if end - start < 2:
                continue
            gain = _gain(s[:-1], w[:-1]) + _gain(s[-1] - s[:-1], w[-1] - w[:-1]) - _gain(s[-1], w[-1])
            gain[(n[:-1] < LEAST_ROWS) | (n[-1] - n[:-1] < LEAST_ROWS)] = -1
            at = int(np.argmax(gain))
            if gain[at] > 1e-9 and (best is None or gain[at] > best[0]):
                best = (gain[at], start, end, start + at + 1)
        if best is None:
            break
        _, start, end, at = best
        spans.remove((start, end))
        spans += [(start, at), (at, end)]
    leaf = np.zeros(len(slope))
    for start, end in spans:
        leaf[start:end] = slope[start:end].sum() / (weight[start:end].sum() + 1.0)
    return leaf


def _pair_tree(slope: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best cross of one cut in each of two features."""
    s, w = slope.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    quarters = []
    for total in (s, w):
        here = total[:-1, :-1]
        down, right = total[:-1, -1:], total[-1:, :-1]
        quarters.append((here, down - here, right - here, total[-1, -1] - down - right + here))
    gain = sum(_gain(a, b) for a, b in zip(*quarters))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    leaf = np.zeros_like(slope)
    for (rows, columns), a, b in zip(
        ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)),
         (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))),
        *quarters,
    ):
        leaf[rows, columns] = a[i, j] / (b[i, j] + 1.0)
    return float(gain[i, j]), leaf


def fit(values: np.ndarray, truth: np.ndarray) -> Model:
    """Boost tables of single features in cycles, then of the best pairs."""
    cut = lambda column, bins: np.unique(np.quantile(column, np.arange(1, bins) / bins))
    edges = [cut(values[:, k], BINS) for k in range(values.shape[1])]
    coarse = [cut(values[:, k], PAIR_BINS) for k in range(values.shape[1])]
    bins = [np.searchsorted(e, values[:, k], side="right") for k, e in enumerate(edges)]
    rough = [np.searchsorted(e, values[:, k], side="right") for k, e in enumerate(coarse)]
    share = np.clip(truth.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    total = np.full(len(truth), base)
    tables = [np.zeros(len(e) + 1) for e in edges]
    for _ in range(ROUNDS):
        for k, at in enumerate(bins):
            chance = 1 / (1 + np.exp(-total))
            size = len(tables[k])
            leaf = RATE * _tree(
                np.bincount(at, truth - chance, size), np.bincount(at, chance * (1 - chance), size), np.bincount(at, minlength=size)
            )
            tables[k] += leaf
            total += leaf[at]
    chance = 1 / (1 + np.exp(-total))
    found = []
    for a in range(len(rough)):
        for b in range(a + 1, len(rough)):
            shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
            if min(shape) < 2:
                continue
            cell = rough[a] * shape[1] + rough[b]
            cells = [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (truth - chance, chance * (1 - chance))]
            found.append((_pair_tree(*cells)[0], a, b))
    pairs = [(a, b) for _, a, b in sorted(found, reverse=True)[:PAIRS]]
    pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in pairs]
    for _ in range(PAIR_ROUNDS):
        for entries, (a, b) in zip(pair_tables, pairs):
            chance = 1 / (1 + np.exp(-total))
            cell = rough[a] * entries.shape[1] + rough[b]
            cells = [np.bincount(cell, v, entries.size).reshape(entries.shape) for v in (truth - chance, chance * (1 - chance))]
            leaf = RATE * _pair_tree(*cells)[1]
            entries += leaf
            total += leaf[rough[a], rough[b]]
    return Model(edges, coarse, base, tables, pairs, pair_tables)


# --- tables -----------------------------------------------------------------


def train(
    docs: DataFrame, labels: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", sample_rows: int = SAMPLE_ROWS,
) -> Model | None:
    """Fit on at most ``sample_rows`` labelled documents among those where ``learn`` holds.

    The sample is that of the smallest hashes of ids.  Documents without an id or a label of 0 or 1 are not learned
    from; a document with several labels counts once, by the largest.  None if nothing is left.
    """
    marked = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    known = docs.where(learn).select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    chosen = stored(
        marked.join(known, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows), "quality-sample"
    )
    texts = bodies(docs.where(learn), id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "body")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, some in by_bytes(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(features(some).tolist(), pa.list_(pa.float64()))],
                ["doc_id", "label", "x"],
            )

    rows = texts.mapInArrow(measure, "doc_id long, label int, x array<double>").orderBy("doc_id", "x").collect()
    if not rows:
        return None
    return fit(np.array([row["x"] for row in rows]), np.array([row["label"] for row in rows], np.float64))


def score(
    docs: DataFrame, model: Model | None, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, score, predicted) of every row; null and empty texts get the score of an empty text.

    Without a model every score is 0.5.
    """
    shared = shipped(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = pickle.loads(shared.value)
        for batch, texts in by_bytes(batches):
            scores = fitted.score(features(texts)) if fitted else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    return bodies(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")
