"""Each operator against a brute-force version, and on odd rows: nulls, empty and long texts, repeats, clashing columns."""

import hashlib
import io
import math
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from scrubline.llm import context_mixing, decontaminate, language_id, packing, quality, simhash, suffix_dedup, token_counts, topk, warc
from scrubline.llm.common import crc_of
from scrubline.llm.queries import tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key long, component_id long"
PASSAGE = "the committee of the harbour town met again on monday to hear what the pilots had to say about the new lights"
LONG = " ".join(f"word{k % 97} and{k % 31}" for k in range(30_000))
BASE = " ".join(f"tale{k} of{k % 7}" for k in range(120))
ODD = [
    (1, "An early text. " + PASSAGE + ". Then more.", "en"),
    (2, "Another one! " + PASSAGE, "en"),
    (3, None, "en"),
    (4, "", None),
    (5, "An early text. " + PASSAGE + ". Then more.", "en"),
    (5, "An early text. " + PASSAGE + ". Then more.", "en"),
    (6, LONG, "en"),
    (7, LONG[5_000:9_000] + " ends", "fr"),
    (8, "  \n \t ", "fr"),
    (9, "Über die Brücke, déjà vu — 中文 \U0001f600 <|endoftext|> don't 123", "de"),
    (10, BASE, "en"),
    (11, BASE + " x", "en"),
    (None, "a text without an id " + PASSAGE, "en"),
    (12, "1234 !!", "en"),
    (13, "a" * 5_000, "en"),
]


def frame(spark, rows, partitions=3):
    full = [(i, t, lang, "s", None if t is None else len(t), 0.5, 1, 2) for i, t, lang in rows]
    return spark.createDataFrame(full, DOCS).repartition(partitions)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [], 1)


def body(text):
    return (text or "").encode()


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.standard_normal(20)], i % 3) for i in range(300)]
    rows += [(i, rows[i - 400][1], 0) for i in range(400, 420)]
    broken = [(500, None, 0), (520, [1.0, None], 0), (540, [float("nan")] * 20, 0), (560, [float("inf")] * 20, 0), (None, [1.0] * 20, 0)]
    table = spark.createDataFrame(rows + broken + rows[:1], "vec_id long, embedding array<float>, rank int").repartition(4)
    found = {}
    for r in topk.top_k(table, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    vectors = {i: np.floor(64 * np.array(x, np.float32).astype(float)).astype(int) for i, x, _ in rows}
    assert set(found) == {i for i in vectors if i % 20 == 0}
    for q, got in found.items():
        best = sorted((-int(vectors[q] @ v), i) for i, v in vectors.items() if i != q)[:20]
        assert [got[k + 1] for k in range(20)] == [(i, -s) for s, i in best]
    assert topk.top_k(table.where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_save_most_multiplications_on_clustered_vectors():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((64, 100))
    base = np.floor(64 * (np.tile(centres, 200) + 0.1 * rng.standard_normal((64, 20_000)))).astype(np.int64)
    base = base[:, rng.permutation(base.shape[1])]
    ids = np.arange(base.shape[1])
    wanted = ids[::20]
    wanted = wanted[topk.like_order(base[:, wanted])]
    queries = base[:, wanted]
    best = topk.Best(len(wanted), 20)
    for at in range(0, len(ids), topk.CANDIDATES):
        span = slice(at, at + topk.CANDIDATES)
        topk.search(queries, wanted, base[:, span], ids[span], best)
    assert best.products < 0.3 * queries.size * base.shape[1]
    scores = queries.T @ base
    for q in range(0, len(wanted), 50):
        order = [i for i in np.lexsort((ids, -scores[q])) if i != wanted[q]][:20]
        assert best.id[best.query == q].tolist() == order and best.score[best.query == q].tolist() == scores[q][order].tolist()


@pytest.mark.parametrize("scale", [1, 1 << 28])
def test_bounds_lose_nothing_to_ties_and_large_numbers(scale):
    rng = np.random.default_rng(4)
    base = rng.integers(-2, 3, (30, 500)) * scale
    ids = rng.permutation(500)
    best = topk.Best(50, 20)
    for at in range(0, 500, 170):
        topk.search(base[:, :50], ids[:50], base[:, at : at + 170], ids[at : at + 170], best)
    scores = base[:, :50].T @ base
    for q in range(50):
        order = [i for i in np.lexsort((ids, -scores[q])) if i != q][:20]
        assert best.id[best.query == q].tolist() == ids[order].tolist()


def test_rows_of_other_queries_are_not_sorted_again():
    rng = np.random.default_rng(6)
    base, ids = rng.integers(-60, 60, (16, 2_000)), rng.permutation(2_000)
    best = topk.Best(400, 20)
    for at in range(0, 2_000, 500):
        topk.search(base[:, :400], ids[:400], base[:, at : at + 500], ids[at : at + 500], best)
    # a tile's own rows and the new ones, not the rows of all queries for each tile
    assert best.sorted < 4 * 3 * 400 * 20
    scores = base[:, :400].T @ base
    for q in range(0, 400, 7):
        order = [i for i in np.lexsort((ids, -scores[q])) if i != q][:20]
        assert best.id[best.query == q].tolist() == ids[order].tolist() and best.score[best.query == q].tolist() == scores[q][order].tolist()


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 300_000
    pages = [(1, "http://a", "same " * 40), (2, "http://b c\n", "same " * 40), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", big), (8, "ü", big + "é")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    found = {r["page_id"]: r for r in warc.round_trip(table.repartition(3)).collect()}
    assert set(found) == {p[0] for p in pages}
    for i, _, html in pages:
        assert found[i]["payload_bytes"] == len(body(html)) and found[i]["payload_digest"] == hashlib.sha256(body(html)).hexdigest()
    assert {i for i, r in found.items() if r["record_type"] == "revisit"} == {2} and found[2]["refers_to"] == 1
    assert warc.round_trip(table.where("page_id < 0")).count() == 0


def test_many_small_archives_are_read_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1)
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html"))
    read = warc.round_trip(pages.repartition(8))
    by_task = read.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in by_task) == 40 and len(by_task) > 8


def test_warc_reader_finds_broken_records():
    good = warc.record_member(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False)
    assert [r.payload for r in warc.read_records(io.BytesIO(good * 3), keep_payload=True)] == [b"payload"] * 3
    wrong = warc.record_member(1, "u", b"payload", "0" * 64, None, False)
    for data in (good[:-9], wrong):
        with pytest.raises(warc.BrokenRecord):
            list(warc.read_records(io.BytesIO(data)))


def test_token_counts(odd, none):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    found = token_counts.token_counts(odd, path).collect()
    want = Counter((i, len(body(t)), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in ODD)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in found) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in found)
    assert token_counts.token_counts(none, path).count() == 0
    for piece in ("ab12!cd" * 900, "don't'll" * 400, "x9" * 2000):
        assert sum(len(library.encode(p, add_special_tokens=False).ids) for p in token_counts.safe_parts(piece, 64)) == len(library.encode(piece, add_special_tokens=False).ids)


def removed_by_force(docs, length=50):
    first, out = {}, {}
    for i in sorted({i for i, _ in docs if i is not None}):
        for text in {body(t) for j, t in docs if j == i}:
            for k in range(len(text) - length + 1):
                first.setdefault(text[k : k + length], i)
    for i, t in docs:
        text = body(t)
        mark = np.zeros(len(text), bool)
        if i is not None:
            for k in range(len(text) - length + 1):
                if first[text[k : k + length]] < i:
                    mark[k : k + length] = True
        kept = bytes(b for b, gone in zip(text, mark) if not gone)
        runs = int((mark & ~np.concatenate([[False], mark[:-1]])).sum()) if len(text) else 0
        out.setdefault(i, set()).add((len(text), int(mark.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("at_once", [65_536, 1])
def test_suffix_dedup(odd, none, monkeypatch, at_once):
    monkeypatch.setattr(suffix_dedup, "STRETCHES_AT_ONCE", at_once)
    found = {}
    for r in suffix_dedup.remove_repeats(odd).collect():
        found.setdefault(r["doc_id"], set()).add((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    assert found == removed_by_force([(i, t) for i, t, _ in ODD])
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_keys_fill_a_filter_evenly():
    text = np.random.default_rng(5).integers(0, 256, 400_000, dtype=np.uint8).tobytes()
    keys = suffix_dedup.stretches([text], 50)[1]
    tops = np.bincount((keys >> np.uint64(60)).astype(np.int64), minlength=16)
    assert tops.min() > 0.8 * tops.mean() and tops.max() < 1.2 * tops.mean()


def test_filters_grow_with_their_keys_up_to_a_bound():
    assert [suffix_dedup.filter_size(n) for n in (0, 1 << 24, 1 << 26, 1 << 40)] == [27, 28, 30, 30]


def test_suffix_classes_of_long_ties():
    rng = np.random.default_rng(2)
    pieces = [bytes(rng.choice(list(b"ab"), 200)) for _ in range(6)] + [b"a" * 300, b"a" * 120, b"ab" * 90, b"ab" * 70]
    docs = np.arange(len(pieces))[::-1].copy()
    piece, place = suffix_dedup.repeated_strings(pieces, docs, 50)
    least = {}
    for p, d in zip(pieces, docs):
        for k in range(len(p) - 49):
            least[p[k : k + 50]] = min(d, least.get(p[k : k + 50], d))
    want = {(n, k) for n, (p, d) in enumerate(zip(pieces, docs)) for k in range(len(p) - 49) if least[p[k : k + 50]] < d}
    assert set(zip(piece.tolist(), place.tolist())) == want


def test_packing(odd, none):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack(odd, path).collect()
    ids = {(i, t): np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t, _ in ODD}
    assert sum(r["length"] for r in rows) == sum(len(ids[i, t]) for i, t, _ in ODD)
    for i in {i for i, _, _ in ODD if i != 5}:
        whole, at = next(v for (j, _), v in ids.items() if j == i), 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(whole[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(whole)
    fill = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert all(n <= 1024 and n & (n - 1) == 0 for n in fill.values())
    assert packing.pack(none, path).count() == 0
    cells = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    walk = cells[np.argsort(packing.hilbert(cells, 3))]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def groups_by_force(values):
    ids = sorted(values)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if bin(values[a] ^ values[b]).count("1") <= 3 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_simhash(odd, none):
    found = simhash.near_duplicates(odd).collect()
    values = {i: simhash.fingerprint(body(t)) for i, t, _ in ODD if i is not None}
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == groups_by_force(values)
    assert all(r["fingerprint"] == f"{values[r['doc_id']]:016x}" for r in found if r["doc_id"] is not None) and len(found) == len(ODD)
    words = BASE.lower().encode().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(len(words) - 2)]
    assert values[10] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("entry_size", [2048, 2])
def test_links_reach_what_all_pairs_reach(spark, monkeypatch, entry_size):
    monkeypatch.setattr(simhash, "ENTRY_SIZE", entry_size)
    rng = np.random.default_rng(4)
    values = {int(x) for x in rng.integers(0, 1 << 63, 40)}
    for v in list(values)[:12]:
        for _ in range(6):
            values.add(v ^ sum(1 << int(b) for b in rng.choice(63, int(rng.integers(1, 5)), replace=False)))
    table = spark.createDataFrame([(0, v) for v in values], "kind int, fp long")
    from scrubline.llm.components import components

    found = {r["node"]: r["component"] for r in components(simhash.links(table)).collect()}
    assert {v: found.get(v, v) for v in values} == groups_by_force({v: v for v in values})


def test_language_gradients():
    net = language_id.fresh(["a", "b"], hidden=3)
    for field in (net.tables, net.recurrent, net.outputs):
        field[:] = [w.astype(np.float64) for w in field]
    rng = np.random.default_rng(0)
    windows, truth = rng.integers(97, 100, (4, 6)).astype(np.uint8), np.array([0, 1, 1, 0])
    _, slopes = language_id.gradients(net, windows, truth)
    for weight, slope in zip(net.weights(), slopes):
        at = tuple(int(k) for k in np.unravel_index(int(np.abs(slope).argmax()), slope.shape))
        step, kept = 1e-2, weight[at]
        sides = []
        for sign in (1, -1):
            weight[at] = kept + sign * step
            sides.append(language_id.gradients(net, windows, truth)[0])
        weight[at] = kept
        assert (sides[0] - sides[1]) / (2 * step) == pytest.approx(slope[at], rel=0.05, abs=2e-4)


def test_language_id(spark, odd, none, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = crc_of("doc_id") % 5 == 0
    net = language_id.train(docs, ~held)
    rows = language_id.predict(docs.where(held), net).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.9 * len(rows)
    found = language_id.predict(odd, net).collect()
    assert len(found) == len(ODD) and all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in found)
    assert language_id.train(none, F.lit(True)) is None and language_id.predict(none, net).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(odd, None).collect()} == {"und"}


def test_quality(spark, odd, none, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, crc_of("doc_id") % 4 != 2)
    rows = quality.score(docs, model).join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.9 * len(rows)
    found = quality.score(odd, model).collect()
    assert len(found) == len(ODD) and all(0 <= r["score"] <= 1 for r in found)
    assert quality.train(none, labels, F.lit(True)) is None and quality.score(none, None).count() == 0


def test_language_model(odd, none):
    found = context_mixing.score(odd).collect()
    counts, learned, n_docs = Counter(), [(i, t) for i, t, _ in ODD if zlib.crc32(str("" if i is None else i).encode()) % 10], 0
    for _, t in learned:
        counts.update(body(t).lower().split())
    n_docs, n = len(learned), sum(counts.values()) + len(learned)
    below = math.log10(n + 0.1 * (len(counts) + 2))
    want = Counter()
    for i, t, _ in ODD:
        tokens = body(t).lower().split()
        base = sum(math.log10(counts[w] + 0.1) - below for w in tokens) + math.log10(n_docs + 0.1) - below
        want[i, len(tokens) + 1, sum(w in counts for w in tokens) + 1, n, round(base, 3)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in found) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)
    assert context_mixing.score(none).count() == 0


def test_bits_are_those_of_a_distribution():
    """The chances of all next bytes after one context add up to one."""
    texts = [b"abcabcabc", b"abdabd"]
    tables = np.random.default_rng(1).integers(-60, 60, (len(context_mixing.ORDERS), context_mixing.SLOTS)).astype(np.int8)
    mixer = context_mixing.fit_mixer(tables, [t + context_mixing.END for t in texts])
    spent = lambda text: context_mixing.bits_of(mixer, tables, [text])[0]
    ends = [context_mixing.bits_of(mixer, tables, [bytes([b])])[0] for b in (97, 98)]
    assert all(math.isfinite(x) and x > 0 for x in [*ends, spent(b"abc" * 5_000)])
    data, at = context_mixing.padded([bytes([b]) for b in range(256)])
    chance = np.ones(256)
    for place, (taken, _, bit) in enumerate(context_mixing.inputs(tables, data, at)):
        total = context_mixing.mixed(taken, mixer.weights[place])
        chance *= 1 / (1 + np.exp(-total * (bit.astype(float) * 2 - 1)))
    assert chance.sum() == pytest.approx(1, abs=1e-4)


def slow_bits(mixer, tables, text):
    """The bits of one text, bit by bit: what it learns moves after each block by sums over the block."""
    cm, text = context_mixing, text.lower() + context_mixing.END
    data, at = cm.padded([text])
    steps = [(np.stack(taken) / cm.SCALE, partial, bit) for taken, partial, bit in cm.inputs(tables, data, at)]
    weights, refined, last, spent = mixer.weights.astype(float), mixer.refined.astype(float), mixer.last.astype(float), 0.0
    for start in range(0, len(text), cm.BLOCK):
        end = min(start + cm.BLOCK, len(text))
        base, more, cells, ends = np.zeros((8, 4)), np.zeros((8, 4)), np.zeros_like(refined), np.zeros(2)
        for place, (x, partial, bit) in enumerate(steps):
            for k in range(start, end):
                known = int(x[-1, k] != 0)
                total = np.clip(weights[place, known] @ x[:, k], -11, 11)
                where = place, partial[k], int(np.float32(total) * np.float32((cm.LEVELS - 1) / 24) + np.float32(cm.LEVELS / 2))
                fine = np.clip(refined[where], -11, 11)
                chance = 1 / (1 + math.exp(-np.clip(last @ [total, fine], -20, 20)))
                spent -= math.log2(chance if bit[k] else 1 - chance)
                miss = bit[k] - chance
                base[place] += miss * x[:, k]
                more[place] += known * miss * x[:, k]
                cells[where] += miss
                ends += [miss * total, miss * fine]
        n = end - start
        limit = lambda moved: np.clip(moved * last[0] * cm.GATED_RATE / math.sqrt(n), -cm.GATED_MOVE, cm.GATED_MOVE)
        weights[:, 0] += limit(base)
        weights[:, 1] += limit(base) + limit(more)
        refined += cm.CELL_RATE * last[1] * cells
        last = np.clip(last + cm.RATE * ends / math.sqrt(8 * n), 0, 1.5)
    return spent


def test_all_weights_move_while_a_text_is_read(monkeypatch):
    rng = np.random.default_rng(2)
    tables = rng.integers(-60, 60, (len(context_mixing.ORDERS), context_mixing.SLOTS)).astype(np.int8)
    tables[-1][rng.random(context_mixing.SLOTS) < 0.5] = 0
    text = b" ".join(b"w%d" % w for w in rng.integers(0, 30, 900))
    mixer = context_mixing.fit_mixer(tables, [text[:400] + context_mixing.END])
    found = context_mixing.bits_of(mixer, tables, [b"other", text, b"", text])
    assert found[1] == found[3] == pytest.approx(slow_bits(mixer, tables, text), rel=1e-3)
    monkeypatch.setattr(context_mixing, "PORTION", 1024)
    assert context_mixing.bits_of(mixer, tables, [b"other", text, b""]) == pytest.approx(found[:3], rel=1e-5)
    # weights that begin far off come closer
    worse = context_mixing.Mixer(mixer.weights * np.float32(0.2), mixer.refined, mixer.last)
    reads = lambda: context_mixing.bits_of(worse, tables, [text * 3])[0]
    moving = reads()
    monkeypatch.setattr(context_mixing, "GATED_RATE", 0)
    still = reads()
    monkeypatch.setattr(context_mixing, "CELL_RATE", 0)
    assert moving < still and moving < reads()


def test_words_are_cut_and_hashed_as_bytes(spark):
    rows = [b"  The tale\x0bof\x1ca \xc3\x89t\xc3\xa9\r\n", b"", b" \t", b"\xff Z z", b"end"]
    for whole, texts in ((pa.array(rows, pa.binary()), rows), (pa.array(rows, pa.binary())[2:], rows[2:]), (pa.array([b""], pa.binary()), [b""])):
        words, ends = context_mixing.words_of(whole)
        assert [words.to_pylist()[i:j] for i, j in pairwise(ends.tolist())] == [t.lower().split() for t in texts]
        want = spark.createDataFrame([(k, bytearray(w)) for k, w in enumerate(words.to_pylist())], "k int, w binary").orderBy("k").select(F.xxhash64("w").alias("h")).collect()
        assert context_mixing.hashes_of(words).view(np.int64).tolist() == [r["h"] for r in want]
    assert len(context_mixing.hashes_of(pa.array([], pa.binary()))) == 0


def test_contexts_of_words_do_not_depend_on_what_was_read_before():
    texts = [b"one two  three", b"", b"two", b"a" * 40_000 + b" two"]
    powers = context_mixing.Powers()
    found = []
    for text in texts:
        data, at = context_mixing.padded([text + context_mixing.END])
        for order in context_mixing.ORDERS:
            own = context_mixing.contexts(data, order, powers)
            assert np.array_equal(own, context_mixing.contexts(data, order))
        found.append(context_mixing.contexts(data, context_mixing.WORD, powers)[at - 8])
    assert found[2][3] == found[0][7] == found[3][-1] and len({*found[0][:4].tolist()}) == 4


def test_scoring_keeps_to_the_cells_that_can_occur():
    """A text's own copy of the refinement holds 256 rows of levels, not eight times as many, and a block walks over no more."""
    rng = np.random.default_rng(4)
    tables = rng.integers(-60, 60, (len(context_mixing.ORDERS), context_mixing.SLOTS)).astype(np.int8)
    mixer = context_mixing.fit_mixer(tables, [b"some text to fit" + context_mixing.END])
    learner = context_mixing.Learner(mixer)
    assert learner.refined.size == 256 * context_mixing.LEVELS
    cells = learner.refined.reshape(256, context_mixing.LEVELS)
    assert all(np.array_equal(cells[1 << bit | p], mixer.refined[bit, p]) for bit in range(8) for p in range(1 << bit))


def test_decontamination(spark, odd, none):
    changed = PASSAGE.split()
    changed[4], changed[11] = "HARBOR", "listen"
    items = spark.createDataFrame([(1, PASSAGE), (2, "too short to count"), (3, None), (4, "nothing of this stands in any text " * 3), (1, PASSAGE)], "item_id long, text string")
    more = frame(spark, [(20, "before, " + " ".join(changed) + " after", "en"), (21, "the committee of the town", "en")])
    found = decontaminate.overlaps(odd.unionByName(more), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, 1) for i in (1, 2, 5, 20, None)}
    assert decontaminate.overlaps(none, items).count() == 0 and decontaminate.overlaps(odd, items.where("item_id < 0")).count() == 0


def overlaps_by_force(docs, items):
    """All alignments of all documents and items: (doc_id, item_id) and the most that agree."""
    found = {}
    for doc_id, text in docs:
        tokens = decontaminate.token_hashes(body(text))
        for item_id, item in items:
            own = decontaminate.token_hashes(body(item))
            n = min(len(own), decontaminate.WINDOW_TOKENS)
            if not n or len(tokens) < n or (n < decontaminate.LEAST_PASSAGE and len(tokens) != n):
                continue
            equal = tokens[:, None] == own[None, :]
            for shift in range(-len(own) + n, len(tokens) - n + 1):
                line = np.diagonal(equal, -shift)
                if len(line) < n:
                    continue
                sums = np.concatenate([[0], np.cumsum(line)])
                most = int((sums[n:] - sums[:-n]).max())
                if most >= decontaminate.needed(n):
                    found[doc_id, item_id] = max(found.get((doc_id, item_id), 0), most)
    return found


def test_decontamination_equals_all_windows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 8000").select("doc_id", "text")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [tuple(r) for r in docs.collect()]
    # items of every length, cut out of documents, some tokens changed
    rng = np.random.default_rng(3)
    for n in range(1, 16):
        for k in range(4):
            words = next(w for w in (str(rows[i][1]).split() for i in rng.permutation(len(rows))) if len(w) > 40)
            at = int(rng.integers(0, len(words) - n))
            part = words[at : at + n]
            for gone in rng.choice(n, min(n, k), replace=False):
                part[gone] = f"other{gone}"
            items.append((10_000 + 10 * n + k, " ".join(part)))
    rows += [(900_000 + n, " ".join(f"w{j}" for j in range(n))) for n in range(1, 6)]
    items += [(20_000 + n, " ".join(f"w{j}" for j in range(n))) for n in range(1, 6)] + [(30_000, None), (30_001, "!!")]
    found = decontaminate.overlaps(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    want = overlaps_by_force(rows, items)
    assert {(r["doc_id"], r["item_id"]): r["agreeing"] for r in found} == want
    assert len({item for _, item in want if item >= 10_000}) > 30


@pytest.mark.parametrize("n", range(1, 13))
def test_short_masks_miss_no_allowed_substitutions(n):
    from itertools import combinations

    for gone in combinations(range(n), n - decontaminate.needed(n)):
        assert any(not set(mask) & set(gone) for mask in decontaminate.short_masks(n))


def test_masks_find_any_two_substitutions():
    from itertools import combinations

    n = decontaminate.WINDOW_TOKENS
    for gone in combinations(range(n), 2):
        assert any(not {o + p for p in mask} & set(gone) for mask in decontaminate.MASKS for o in range(n - decontaminate.SPAN + 1))


def test_pipeline_stages(spark, odd, none, sf_dir, tmp_path):
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count(), name
        assert stage(spark, none, str(tmp_path)).count() == 0
    leaks = corpus_pipeline.drop_benchmark_leaks(spark, odd, str(tmp_path))
    assert {r["doc_id"] for r in leaks.collect()} == {i for i, t, _ in ODD if i is None or PASSAGE not in (t or "")}
    groups = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, odd, sf_dir).collect()}
    assert 1 in groups and 5 not in groups and 11 not in groups
    passages = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_passages(spark, odd, sf_dir).collect()}
    assert passages[2] == "Another one!" and 5 not in passages and passages[3] is None


def shingles_of(text):
    words = body(text).lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def groups_by_similarity(rows):
    """The smallest id of each document's group, by all pairs of 0.8 or more."""
    sets, least = [(i, shingles_of(t)) for i, t in rows], {i: i for i, _ in rows}
    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x == y or 10 * len(x & y) >= 8 * len(x | y):
                a, b = sorted((least[i], least[j]))
                least = {n: a if m == b else m for n, m in least.items()}
    return least


def test_near_copies_are_verified(spark, odd, sf_dir):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in rng.integers(0, 10**6, 200)]
    rows = [(100, " ".join(words)), (101, " ".join(words[::-1])), (102, " ".join(words[100:] + words[:100]))]
    for k in range(12):
        edited = list(words)
        for at in rng.choice(200, k, replace=False):
            edited[at] = f"new{k}-{at}"
        rows.append((110 + k, " ".join(edited)))
    made = frame(spark, [(i, t, "en") for i, t in rows])
    want = groups_by_similarity(rows)
    assert want[101] == 101 and want[102] == 100 and want[121] == 121
    assert {r["doc_id"]: r["component_id"] for r in simhash.verified_groups(made).collect()} == want
    kept = corpus_pipeline.drop_near_duplicates(spark, made, sf_dir).collect()
    assert {r["doc_id"] for r in kept} == {i for i, least in want.items() if i == least}
    found = {r["doc_id"]: r["component_id"] for r in simhash.verified_groups(odd.where("doc_id IS NOT NULL")).collect()}
    assert found == groups_by_similarity([(i, t) for i, t, _ in ODD if i is not None])


def test_mixer_is_fitted_on_whole_texts_of_all_kept_documents(spark):
    """Bytes after the first 2,048, and texts after the first 128, count; copies of a text count once."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"t{k}{w}" for w in rng.integers(0, 50, 700 if k % 50 == 0 else 40)) for k in range(200)]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(1_000 + k, texts[0], "en") for k in range(150)]
    learned = frame(spark, rows).selectExpr("cast(text AS binary) AS body", "doc_id % 2 = 1 AS kept")
    parts = context_mixing.count_tables(learned)
    found = context_mixing.fit_in_tasks(parts, learned)
    want = context_mixing.fit_mixer(context_mixing.slot_tables(parts, "without"), [t.encode() for t in texts])
    assert np.allclose(found.weights, want.weights, atol=1e-3)
    counted = context_mixing.cells_of(want.weights, context_mixing.slot_tables(parts, "without"), [t.encode() for t in texts])
    assert counted[0].sum() == 8 * sum(len(t) + 1 for t in texts) and np.abs(found.refined - want.refined).mean() < 1e-2


def test_sampled_texts_are_read_whole(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in (10, 64, 65, 1000, 5000)]
    seen = []
    monkeypatch.setattr(language_id, "fit", lambda windows, truth, labels: seen.append({w.tobytes() for w in windows}))
    table = frame(spark, [(k, t, "en") for k, t in enumerate(texts)])
    language_id.train(table, F.lit(True), bytes_each=100_000)
    parts = {t[at : at + 64].encode() for t in texts[1:] for at in [*range(0, len(t) - 64, 64), len(t) - 64]}
    assert seen[0] == parts | {(texts[0] * 7)[:64].encode()}
    # a text beyond the bound is passed over, the others stay
    language_id.train(table, F.lit(True), bytes_each=20_000)
    assert seen[1] < seen[0] and texts[4][:64].encode() not in seen[1]


def test_kept_pieces_are_bounded_by_bytes(odd, monkeypatch):
    whole = sorted(token_counts.token_counts(odd, tokenizer("word_bpe_49k.json")).collect(), key=str)
    monkeypatch.setattr(token_counts, "KEPT_BYTES", 10)
    assert sorted(token_counts.token_counts(odd, tokenizer("word_bpe_49k.json")).collect(), key=str) == whole


def test_copies_take_no_places_in_the_language_sample(spark, monkeypatch):
    texts = [f"some text number {k} of the sample" for k in range(12)]
    hashed = frame(spark, [(k, t, "en") for k, t in enumerate(texts)]).select("doc_id", F.xxhash64("text").alias("h"))
    lowest = hashed.orderBy("h").first()["doc_id"]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(100 + k, texts[lowest], "en") for k in range(50)]
    seen = []
    monkeypatch.setattr(language_id, "fit", lambda windows, truth, labels: seen.append(len({w.tobytes() for w in windows})))
    language_id.train(frame(spark, rows), F.lit(True), docs_each=10)
    assert seen == [10]


@pytest.mark.parametrize("cell", [4096, 7])
def test_groups_of_a_large_block_are_joined_without_a_table_of_its_pairs(spark, monkeypatch, cell):
    """Groups are those of all pairs, and each comparison yields fewer links than it has sets, however many share a shingle."""
    monkeypatch.setattr(simhash, "CELL_SETS", cell)
    rng = np.random.default_rng(5)
    sets = {}
    for k in range(150):
        kept = rng.choice(100, rng.integers(55, 101), replace=False) if k % 2 else np.arange(100)[rng.integers(0, 8) : 100 - rng.integers(0, 8)]
        sets[k] = sorted({*map(int, kept), *(1000 + 50 * k + j for j in range(rng.integers(0, 14)))})
    alike = [(a, b) for a in sets for b in sets if a < b and 10 * len({*sets[a]} & {*sets[b]}) >= 8 * len({*sets[a]} | {*sets[b]})]

    def groups(pairs):
        least = {k: k for k in sets}
        for a, b in pairs:
            low, high = sorted((least[a], least[b]))
            least = {k: low if m == high else m for k, m in least.items()}
        return least

    want = groups(alike)
    assert len(alike) > 1_000 and 20 < len(set(want.values())) < 130
    members = spark.createDataFrame([(k, 9, k, len(s)) for k, s in sets.items()], "key long, block long, own long, n int")
    table = spark.createDataFrame([(k, s) for k, s in sets.items()], "key long, shingles array<long>")
    found = [(r["a"], r["b"]) for r in simhash._open_links(members, table).collect()]
    assert groups(found) == want
    assert cell < len(sets) or len(found) == len(sets) - len(set(want.values()))
    # given groups, only what lies between them is linked
    halves = {k: g if k % 3 else k for k, g in want.items()}
    indices = simhash.group_links(np.array([halves[k] for k in sets]), [np.array(s, np.int64) for s in sets.values()])
    assert len(indices) == len(set(halves.values())) - len(set(want.values()))


def test_mixer_is_fitted_on_all_training_texts(spark, monkeypatch):
    """Every training text is read, once, against tables of all others but those of its fold; a start on a few texts changes nothing."""
    cm = context_mixing
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 8))) for _ in range(300)]
    texts = [" ".join(words[w] for w in rng.zipf(1.3, 60) % 300) for _ in range(240)]
    docs = frame(spark, [(k, t, "en") for k, t in enumerate([*texts, texts[0], texts[1], None, ""])])
    seen, fit = [], cm.fit_in_tasks
    monkeypatch.setattr(cm, "fit_in_tasks", lambda *given: seen.append((*given, fit(*given))) or seen[-1][-1])
    assert cm.score(docs).count() == 244
    (parts, learned, folds, mixer), = seen
    rows = [(bytes(r["body"]), r["kept"]) for r in learned.collect()]
    want = [body(t) for k, t in enumerate([*texts, texts[0], texts[1], None, ""]) if zlib.crc32(str(k).encode()) % 10]
    assert Counter(t for t, _ in rows) == Counter(want) and len({f for _, f in rows}) == folds and len(dict(rows)) == len(set(rows))
    # the tables are those of plain counts without the fold
    own = {f: cm.slot_tables(parts, "without", f) for f in range(1, folds + 1)}
    for left in (1, folds):
        others = spark.createDataFrame([(t, False) for t, f in rows if f != left], "body binary, kept boolean")
        assert np.array_equal(own[left], cm.slot_tables(cm.count_tables(others), "full"))
    every = spark.createDataFrame([(t, False) for t, _ in rows], "body binary, kept boolean")
    assert np.array_equal(cm.slot_tables(parts, "full"), cm.slot_tables(cm.count_tables(every), "full"))
    once = [[t for t, f in set(rows) if f == fold] for fold in own]
    summed = lambda of: lambda weights: sum(of(weights, own[f + 1], some) for f, some in enumerate(once))
    expected = cm.fitted(summed(cm.slopes_of), summed(cm.cells_of))
    assert np.allclose(mixer.weights, expected.weights, atol=1e-2) and np.abs(mixer.refined - expected.refined).mean() < 1e-2
    assert cm.cells_of(expected.weights, own[1], sum(once, []))[0].sum() == 8 * sum(len(t) + 1 for t in set(want))
    monkeypatch.setattr(cm, "FIRST_TEXTS", 3)
    cost = lambda weights: summed(cm.slopes_of)(weights)[:, :, 0].sum()
    assert cost(fit(parts, learned, folds).weights) == pytest.approx(cost(expected.weights), rel=1e-3)


def test_sums_of_the_fit_are_those_of_single_bits():
    """Cost, slope, curvature and cells of each bit by itself."""
    cm, rng = context_mixing, np.random.default_rng(4)
    tables = rng.integers(-60, 60, (len(cm.ORDERS), cm.SLOTS)).astype(np.int8)
    tables[-1][rng.random(cm.SLOTS) < 0.5] = 0
    weights, texts = rng.normal(0.3, 0.1, (8, 2, 4)), [b"one text", b"", b"and a second one \xc3\xa9"]
    sums, cells = np.zeros((8, 2, 21)), np.zeros((2, 8, 256, cm.LEVELS))
    for text in texts:
        data, at = cm.padded([text + cm.END])
        for place, (taken, partial, bits) in enumerate(cm.inputs(tables, data, at)):
            for k, bit in enumerate(bits):
                x, gate = np.array([t[k] for t in taken]) / cm.SCALE, int(taken[-1][k] != 0)
                total = float(np.clip(x @ weights[place, gate], -11, 11))
                chance = 1 / (1 + math.exp(-total))
                bend = np.outer(x, x).reshape(-1) * chance * (1 - chance)
                sums[place, gate] += [math.log1p(math.exp(total * (1 - 2 * int(bit)))), *((chance - bit) * x), *bend]
                cells[:, place, partial[k], int(cm.level(np.float32(total)))] += [1, bit]
    assert np.allclose(cm.slopes_of(weights, tables, texts), sums, rtol=1e-4, atol=1e-4)
    assert np.array_equal(cm.cells_of(weights, tables, texts).reshape(cells.shape), cells)
