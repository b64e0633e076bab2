"""Language ID by a bidirectional gated recurrent network over bytes.

Texts are read as consecutive windows of bytes.  One recurrent layer reads each window forwards and one
backwards; both together label every position, and the probabilities of all positions
of a text are averaged.  The network is trained in numpy by backpropagation through time on a
bounded sample of labelled rows; labelling runs where the texts are, many windows side by side.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scrubline.llm.common import by_bytes, shipped, stored

WINDOW = 64
HIDDEN = 12
WINDOWS_AT_ONCE = 4096
LETTER = re.compile(r"[^\W\d_]")

# the bounded training sample: documents of each language, and bytes of their whole texts together
SAMPLE_DOCS = 500
SAMPLE_BYTES = 8 << 20
STEPS = 300
BATCH = 256
RATE = 0.01


@dataclass
class Network:
    """Input table, recurrent weights and output weights of both directions, output bias, and the labels."""

    labels: list[str]
    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    outputs: list[np.ndarray]
    bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [*self.tables, *self.recurrent, *self.outputs, self.bias]


def fresh(labels: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Network(
        labels,
        [draw(3 * hidden, 256, scale=0.3) for _ in range(2)],
        [draw(3 * hidden, hidden, scale=0.6 / hidden**0.5) for _ in range(2)],
        [draw(len(labels), hidden, scale=0.3) for _ in range(2)],
        np.zeros((len(labels), 1), np.float32),
    )


def _order(steps: int, direction: int) -> range:
    return range(steps) if direction == 0 else range(steps - 1, -1, -1)


def _step(inputs: np.ndarray, state: np.ndarray, recurrent: np.ndarray) -> tuple[np.ndarray, ...]:
    """One gated step, a column per window; gates are piecewise linear, the candidate is a tanh."""
    hidden = len(state)
    product = recurrent @ state
    gates = inputs[: 2 * hidden] + product[: 2 * hidden]
    gates *= 0.25
    gates += 0.5
    np.clip(gates, 0, 1, out=gates)
    update, reset, part = gates[:hidden], gates[hidden:], product[2 * hidden :]
    candidate = reset * part
    candidate += inputs[2 * hidden :]
    np.tanh(candidate, out=candidate)
    new = candidate - state
    new *= update
    new += state
    return new, update, reset, part, candidate


def _softmax(logits: np.ndarray) -> np.ndarray:
    """In place, over the labels of (steps, labels, windows)."""
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def position_probabilities(net: Network, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(steps, labels, windows); windows must come longest first, and steps past an end are meaningless."""
    hidden, (n, steps) = net.recurrent[0].shape[1], windows.shape
    by_step = np.ascontiguousarray(windows.T).astype(np.intp)
    logits = np.zeros((steps, len(net.labels), n), np.float32)
    logits += net.bias
    alive = (lengths[None, :] > np.arange(steps)[:, None]).sum(axis=1)
    for direction in range(2):
        state = np.zeros((hidden, n), np.float32)
        for t in _order(steps, direction):
            k = alive[t]
            if k == n:
                inputs = np.take(net.tables[direction], by_step[t], axis=1, mode="clip")
                state = _step(inputs, state, net.recurrent[direction])[0]
            else:
                inputs = np.take(net.tables[direction], by_step[t, :k], axis=1, mode="clip")
                state[:, :k] = _step(inputs, state[:, :k], net.recurrent[direction])[0]
            logits[t] += net.outputs[direction] @ state
    return _softmax(logits)


def gradients(net: Network, windows: np.ndarray, truth: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over all positions of full windows, and its gradients in the order of ``weights``."""
    hidden, (n, steps) = net.recurrent[0].shape[1], windows.shape
    logits = np.zeros((steps, len(net.labels), n), np.float32)
    logits += net.bias
    kept: list[list] = [[], []]
    for direction in range(2):
        state = np.zeros((hidden, n), np.float32)
        for t in _order(steps, direction):
            before = state
            state, *rest = _step(net.tables[direction][:, windows[:, t]], before, net.recurrent[direction])
            logits[t] += net.outputs[direction] @ state
            kept[direction].append((t, before, state, *rest))
    wrong = _softmax(logits)
    loss = float(-np.log(np.maximum(wrong[:, truth, np.arange(n)], 1e-9)).mean())
    wrong[:, truth, np.arange(n)] -= 1
    wrong /= n * steps
    tables, recurrents, outputs = [], [], []
    for direction in range(2):
        weights, to_out = net.recurrent[direction], net.outputs[direction]
        down = np.zeros((hidden, n), np.float32)
        d_recurrent, d_out = np.zeros_like(weights), np.zeros_like(to_out)
        d_inputs, bytes_read = [], []
        for t, before, state, update, reset, part, candidate in reversed(kept[direction]):
            d_out += wrong[t] @ state.T
            down = down + to_out.T @ wrong[t]
            d_update = down * (candidate - before) * 0.25 * ((update > 0) & (update < 1))
            d_candidate = down * update * (1 - candidate * candidate)
            d_reset = d_candidate * part * 0.25 * ((reset > 0) & (reset < 1))
            d_product = np.concatenate([d_update, d_reset, d_candidate * reset])
            d_recurrent += d_product @ before.T
            d_inputs.append(np.concatenate([d_update, d_reset, d_candidate]))
            bytes_read.append(windows[:, t])
            down = down * (1 - update) + weights.T @ d_product
        read, by_input = np.concatenate(bytes_read), np.concatenate(d_inputs, axis=1)
        order = np.argsort(read, kind="stable")
        values, first = np.unique(read[order], return_index=True)
        d_table = np.zeros_like(net.tables[direction])
        d_table[:, values] = np.add.reduceat(by_input[:, order], first, axis=1)
        tables.append(d_table)
        recurrents.append(d_recurrent)
        outputs.append(d_out)
    return loss, [*tables, *recurrents, *outputs, wrong.sum(axis=(0, 2))[:, None]]


def fit(windows: np.ndarray, truth: np.ndarray, labels: list[str], steps: int = STEPS, seed: int = 7) -> Network:
    """Adam on batches drawn so that every label is equally frequent."""
    net, rng = fresh(labels, seed=seed), np.random.default_rng(seed)
    means = [np.zeros_like(w) for w in net.weights()]
    squares = [np.zeros_like(w) for w in net.weights()]
    rows = [np.flatnonzero(truth == k) for k in range(len(labels))]
    for step in range(1, steps + 1):
        drawn = np.concatenate([rng.choice(r, max(1, BATCH // len(rows))) for r in rows if len(r)])
        _, slopes = gradients(net, windows[drawn], truth[drawn])
        norm = float(np.sqrt(sum(float((s * s).sum()) for s in slopes)))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for weight, mean, square, slope in zip(net.weights(), means, squares, slopes):
            slope = slope * min(1.0, 1.0 / (norm + 1e-9))
            mean += 0.1 * (slope - mean)
            square += 0.001 * (slope * slope - square)
            weight -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return net


def cut(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts longest first, their lengths, and the text each belongs to."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = (sizes + window - 1) // window
    owner = np.repeat(np.arange(len(texts)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    lengths = np.minimum(window, sizes[owner] - within * window)
    starts = (np.cumsum(sizes) - sizes)[owner] + within * window
    data = np.frombuffer(b"".join(texts) + bytes(window), np.uint8)
    order = np.argsort(-lengths, kind="stable")
    return data[starts[order, None] + np.arange(window)], lengths[order], owner[order]


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """(texts, labels): mean probabilities over all positions of each text; zeros for an empty one."""
    windows, lengths, owner = cut(texts)
    sums = np.zeros((len(texts), len(net.labels)))
    for start in range(0, len(windows), WINDOWS_AT_ONCE):
        span = slice(start, start + WINDOWS_AT_ONCE)
        chances = position_probabilities(net, windows[span], lengths[span])
        if lengths[span][-1] < WINDOW:
            chances *= (lengths[span][None, :] > np.arange(WINDOW)[:, None])[:, None, :]
        for label, by_window in enumerate(chances.sum(axis=0)):
            sums[:, label] += np.bincount(owner[span], by_window, len(texts))
    sizes = np.fromiter(map(len, texts), np.float64, len(texts))
    return sums / np.maximum(sizes, 1)[:, None]


def label_positions(net: Network, text: bytes) -> list[str]:
    """The label of every byte of one text."""
    windows, lengths, _ = cut([text])
    windows, lengths = windows[np.argsort(-lengths, kind="stable")], np.sort(lengths)[::-1]
    best = position_probabilities(net, windows, lengths).argmax(axis=1).T
    return [net.labels[k] for row, size in zip(best, lengths) for k in row[:size]]


# --- tables -----------------------------------------------------------------


def train(
    docs: DataFrame, learn: Column, *, text_col: str = "text", lang_col: str = "lang", docs_each: int = SAMPLE_DOCS,
    bytes_each: int = SAMPLE_BYTES,
) -> Network | None:
    """Fit on at most ``docs_each`` different texts of each label among the rows where ``learn`` holds, read whole.

    The texts are those with the smallest hashes, so they are spread over
    the table and the same in any partitioning, as many as have ``bytes_each`` together.  A text
    longer than a sixteenth of that is passed over, lest a few fill the sample.
    Of a label with many texts only those below a bound on the hash are ranked: the bound expects four times as many as are taken.
    Rows without text or label are not learned from; None if there are no others.
    """
    labelled = docs.select(
        F.col(lang_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("body"), learn.alias("learn")
    ).where("learn AND label IS NOT NULL AND body <> ''")
    sized = labelled.select("label", F.xxhash64("body").alias("h"), F.octet_length("body").cast("long").alias("size"))
    hashed = stored(sized.where(F.col("size") <= bytes_each // 16).groupBy("label", "h").agg(F.max("size").alias("size")), "language-hashes")
    counts = hashed.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    # hashes are even over all longs, so this share of them lies below the bound
    share = F.least(F.lit(1.0), F.lit(4.0 * docs_each) / F.col("n"))
    near = hashed.join(counts, "label").where(F.col("h").cast("double") / F.lit(2.0**64) + F.lit(0.5) <= share)
    order = Window.partitionBy("label").orderBy("h")
    ranked = near.withColumn("place", F.row_number().over(order)).withColumn("together", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    within = (F.col("place") <= docs_each) & (F.col("together") <= bytes_each)
    chosen = stored(ranked.where(within).select("label", "h"), "language-sample")
    rows = (
        labelled.withColumn("h", F.xxhash64("body")).join(F.broadcast(chosen), ["label", "h"], "left_semi")
        .dropDuplicates(["label", "h"]).select("label", "h", F.col("body").cast("binary").alias("body")).orderBy("label", "h").collect()
    )
    labels = sorted({row["label"] for row in rows})
    if not labels:
        return None
    pieces, truth = [], []
    for row in rows:
        text = bytes(row["body"])
        # the last window ends with the text; a short text is repeated to fill its window
        starts = [*range(0, len(text) - WINDOW, WINDOW), max(0, len(text) - WINDOW)]
        pieces += [(text[at : at + WINDOW] * (WINDOW // min(WINDOW, len(text)) + 1))[:WINDOW] for at in starts]
        truth += [labels.index(row["label"])] * len(starts)
    windows = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, WINDOW)
    return fit(windows, np.array(truth), labels)


def predict(
    docs: DataFrame, net: Network | None, *, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score"
) -> DataFrame:
    """The columns of ``docs`` and two more: the likeliest label of each whole text and its probability.

    ``und`` with score 0 where the text is null or has no letter, or where nothing could be learned.  The added columns
    replace columns of these names.
    """
    named = {pred_col.lower(), score_col.lower()}
    kept = [c for c in docs.columns if c.lower() not in named]
    shared = shipped(docs.sparkSession, net)
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("__body"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        for batch, texts in by_bytes(batches, "__body"):
            named = [model is not None and LETTER.search(text.decode("utf-8", "replace")) is not None for text in texts]
            chances = pooled(model, [t if ok else b"" for t, ok in zip(texts, named)]) if any(named) else None
            best = chances.argmax(axis=1) if any(named) else [0] * len(texts)
            label = [model.labels[b] if ok else "und" for b, ok in zip(best, named)]
            score = [float(chances[i, b]) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, named))]
            arrays = [batch.column(k) for k in range(len(schema) - 2)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(label, pa.string()), pa.array(score, pa.float64())], names)

    names = [field.name for field in schema.fields]
    return source.mapInArrow(run, schema)
