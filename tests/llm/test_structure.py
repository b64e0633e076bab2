"""Periodic runs, conversation repair and best-fit packing against brute force, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubline.llm import best_fit, conversation_repair, periodic_runs, queries
from scrubline.llm.queries import tokenizer

DOCS = "doc_id long, text string, lang string, key long, tiles string, rank int, task int"
CYCLE = " ".join(f"p{k}" for k in range(40))
ODD = [
    (1, f"before {CYCLE} {CYCLE} {CYCLE} {CYCLE} after it"),
    (2, "a " * 500),
    (3, None),
    (4, ""),
    (5, " \t\n \x0b"),
    (6, "ab cd   " + "x y " * 12),
    (6, "ab cd   " + "x y " * 12),
    (7, " ".join(f"word{k % 97} and{k % 31}" for k in range(12_000))),
    (8, "one two three"),
    (9, "中文 é " * 30 + "don't <|endoftext|> 123"),
    (10, ("q " * 30 + "r ") * 9),
    (None, "lost " + "na " * 30),
    (11, "z" * 5_000),
    (12, "b c " * 11 + "b"),
    (13, "b c " * 12),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", 1, "t", 2, 3) for i, t in ODD], DOCS).repartition(3).cache()


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- periodic runs ----------------------------------------------------------


def runs_by_force(words):
    """Every period tried over the whole text; runs with a smaller period inside are no runs of this one."""
    found = []
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length, part = j - i + q, words[i : j + q]
            if j > i and length >= max(24, 3 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda run: (run[0], run[2]))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted_by_force(doc_id, text):
    words = words_of(text)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def report_by_force(doc_id, words):
    runs = runs_by_force(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        digest(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def report(rows):
    return Counter(tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in rows)


def test_periodic_runs_of_odd_rows(spark, odd):
    small = [(i, t) for i, t in ODD if i != 7]
    found = periodic_runs.periodic_runs(odd.where("doc_id IS NULL OR doc_id <> 7")).collect()
    assert report(found) == Counter(report_by_force(i, words_of(t)) for i, t in small)
    assert periodic_runs.periodic_runs(odd.where("doc_id = 7")).first()["n_runs"] > 0
    assert periodic_runs.periodic_runs(odd.where("doc_id = 0")).count() == 0


def test_periodic_runs_of_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("length(text) < 6000").collect()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = Counter(report_by_force(r["doc_id"], planted_by_force(r["doc_id"], r["text"])) for r in rows)
    assert report(periodic_runs.periodic_runs(periodic_runs.with_planted_runs(docs)).collect()) == want
    assert sum(n for (_, runs, *_), n in want.items() if runs) > 5


def test_planted_runs_of_the_whole_table(spark, sf_dir):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = queries.op11_periodic_runs(spark, sf_dir).collect()
    assert len(found) == len(rows)
    for r in found:
        words = planted_by_force(r["doc_id"], rows[r["doc_id"]])
        if not r["n_runs"]:
            assert r["collapsed_sha256"] == digest(" ".join(words)) and r["start"] is None
        else:
            s, length, q = r["start"], r["length"], r["period"]
            assert all(words[i] == words[i + q] for i in range(s, s + length - q))
            assert (s == 0 or words[s - 1] != words[s - 1 + q]) and (s + length == len(words) or words[s + length] != words[s + length - q])


def test_tiles_hold_all_runs():
    rng = random.Random(5)
    for _ in range(150):
        batch = []
        for _ in range(rng.randint(1, 5)):
            letters, words, size = rng.choice([1, 2, 3, 40]), [], rng.randint(0, 400)
            while len(words) < size:
                part = [f"w{rng.randrange(letters)}".encode() for _ in range(rng.randint(1, 70))]
                words += (part * 7)[: int(len(part) * rng.uniform(0.3, 6))]
            batch.append(words)
        for words, tiles in zip(batch, periodic_runs.tiles_of(batch)):
            match = defaultdict(set)
            for octave, at, lead, numbers in tiles:
                for q, before, after in periodic_runs.solve_tile(octave, lead, numbers.tolist()):
                    match[q].update(range(at - before, at + after))
            found = []
            for q, places in match.items():
                for start in (i for i in places if i - 1 not in places):
                    stop = next(i for i in itertools.count(start) if i not in places)
                    if stop - start + q >= max(24, 3 * q):
                        found.append((start, stop - start + q, q))
            assert sorted(found, key=lambda r: (r[0], r[2])) == runs_by_force(words)


def test_z_function():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randint(1, 40))]
        assert periodic_runs.z_function(s) == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]


# --- conversation repair ----------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, digest string, mark int, first string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def faults_by_force(rows):
    out, seen = [], set()
    for _, role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def all_repairs(rows, faults, most):
    """Every sequence of edits that costs at most ``most``: (cost, audit, repaired lines, their initials)."""

    def go(i, cost, audit, lines):
        if cost > most:
            return
        if i == len(rows):
            yield cost, audit, lines
        for role in ("user", "assistant"):
            yield from go(i, cost + 2, audit + "I", [*lines, (role, "")])
        if i < len(rows):
            _, role, text = rows[i]
            yield from go(i + 1, cost + 3, audit + "D", lines)
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                yield from go(i + 1, cost + more, audit + "K", [*lines, (role, text)])
                for other in ("user", "assistant"):
                    yield from go(i + 1, cost + 2 + more, audit + "R", [*lines, (other, text)])

    return (x for x in go(0, 0, "", []) if GRAMMAR.fullmatch("".join(r[:1] or "-" for r, _ in x[2])))


def repair_by_force(rows):
    """Cheapest repair by trying all, dearer step by step."""
    faults = faults_by_force(rows)
    found = next(list(x) for x in (all_repairs(rows, faults, most) for most in range(3 * len(rows) + 1)) for x in [list(x)] if x)
    cost = min(x[0] for x in found)
    audit = min(x[1] for x in found if x[0] == cost)
    lines = {tuple(x[2]) for x in found if x[:2] == (cost, audit)}
    assert len(lines) == 1
    initials = [r[:1] for _, r, _ in rows]
    turns = {t for t, _, _ in rows if t is not None}
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit,
        digest("\n".join(f"{role}:{text}" for role, text in lines.pop())),
    )


def damaged_by_force(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        row = (turn, "user" if fault == 4 else role, text)
        out[conv] += [] if fault == 0 else [row] * (2 if fault == 3 else 1)
    return {
        conv: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        for conv, rows in out.items()
    }


def by_conversation(rows):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    found = {r["conv_id"]: tuple(r[c] for c in names) for r in rows}
    assert len(found) == len(rows)
    return found


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, "f") for r in rows], TURNS).repartition(3)


def plain_repair(rows, size):
    random_rows = random.Random(7)
    for _ in range(rows):
        turn, out = 0, []
        for _ in range(random_rows.randint(0, size)):
            turn += random_rows.choice([0, 1, 1, 2])
            out.append((turn, random_rows.choice(["user", "assistant", "system", "tool", ""]), random_rows.choice(["", " \n", "yes.", "no", "so it is!\n"])))
        yield out


def walked(rows):
    found, seen = conversation_repair.Conversation(), set()
    for turn, role, text in rows:
        found.row(turn, role, text, text.encode(), (role, text) in seen)
        seen.add((role, text))
    return found.end()


def test_cheapest_repair_of_short_conversations():
    for rows in plain_repair(250, 4):
        assert walked(rows) == repair_by_force(rows)


def test_repairs_do_not_depend_on_when_prefixes_are_settled(monkeypatch):
    whole = [(rows, walked(rows)) for rows in plain_repair(60, 120)]
    monkeypatch.setattr(conversation_repair, "WAITING_ROWS", 1)
    for rows, want in whole:
        assert walked(rows) == want


def test_hashes_that_agree_are_verified(monkeypatch):
    whole = [(rows, walked(rows)) for rows in plain_repair(40, 60)]
    monkeypatch.setattr(conversation_repair.Audits, "MODULUS", 2)
    for rows, want in whole:
        assert walked(rows) == want


def test_a_long_conversation_does_not_pile_up():
    found = conversation_repair.Conversation()
    for k in range(20_000):
        found.row(k, ("user", "assistant")[k // 3 % 2], f"turn {k}", b"%d" % k, False)
        assert len(found.repair.waiting) <= 2 * conversation_repair.WAITING_ROWS and len(found.repair.audits.edit) < 40_000
    assert len(found.end()[-2]) >= 20_000


def test_repair_of_odd_rows(spark):
    rows = [
        (1, 0, "system", "Rules."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello."),
        (2, 0, "user", None), (2, None, None, "what"), (2, None, "user", "First."), (2, 5, "user", "First."),
        (3, 1, "assistant", "x" * 200_000), (3, 1, "assistant", "x" * 200_000), (3, 9, "tool", "é…"),
        (None, 0, "user", "Hm."), (None, None, "assistant", "Yes."), (4, None, None, None),
    ]
    rows += [(k, t, ("user", "assistant")[t % 2], f"{t}.") for k in range(20, 60) for t in range(3)] + [(99, t, "user", "same") for t in (3, 3, 8)]
    table = conversations(spark, rows)
    want = {conv: repair_by_force(turns) for conv, turns in damaged_by_force(rows).items()}
    assert any(not turns for turns in damaged_by_force([(k, 0, "user", "x") for k in range(60)]).values())
    assert by_conversation(conversation_repair.repair(conversation_repair.damaged(table), present_col="present").collect()) == want
    alone = conversations(spark, [(k, 0, "user", "x") for k in range(60)])
    empty = [r for r in conversation_repair.repair(conversation_repair.damaged(alone), present_col="present").collect() if r["audit"] == ""]
    assert empty and all((r["cost"], r["repaired_sha256"]) == (0, digest("")) for r in empty)
    assert conversation_repair.repair(table.where("conv_id = -1")).count() == 0


def test_repair_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {conv: repair_by_force(turns) for conv, turns in damaged_by_force(rows).items() if len(turns) <= 5}
    found = by_conversation(queries.op12_conversation_repair(spark, sf_dir).collect())
    assert {conv: found[conv] for conv in want} == want and set(found) == {r[0] for r in rows}


def test_repaired_turns_are_those_of_the_digest(spark):
    rows = [(k, t, ("user", "assistant", "user")[(t * k) % 3], f"{t * k % 4}.") for k in range(30) for t in range(6)]
    table = conversations(spark, rows)
    lines = defaultdict(list)
    for r in sorted(conversation_repair.repaired_turns(table).collect(), key=lambda r: (r["conv_id"], r["position"])):
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for conv, got in by_conversation(conversation_repair.repair(table).collect()).items():
        assert got[-1] == digest("\n".join(lines[conv]))


# --- best-fit packing -------------------------------------------------------


def test_plan_equals_best_fit_item_by_item():
    rng = random.Random(3)
    for _ in range(200):
        size = rng.choice([8, 16, 64, 1024])
        histogram = Counter(rng.randint(1, size) for _ in range(rng.randint(0, 80)) for _ in range(rng.randint(1, 4)))
        rooms = []
        for length in sorted(histogram.elements(), reverse=True):
            fits = [i for i, room in enumerate(rooms) if room >= length]
            if fits:
                rooms[min(fits, key=rooms.__getitem__)] -= length
            else:
                rooms.append(size - length)
        plan = best_fit.plan_counts(histogram, size).tolist()
        held = defaultdict(list)
        for row, (length, rank, each, first, offset) in enumerate(plan):
            last = plan[row + 1][1] if row + 1 < len(plan) and plan[row + 1][0] == length else histogram[length]
            for k in range(last - rank):
                held[first + k // each].append((offset + k % each * length, length))
        for slots in held.values():
            assert [at for at, _ in sorted(slots)] == [0, *itertools.accumulate(n for _, n in sorted(slots))][:-1]
        assert sorted(size - sum(n for _, n in slots) for slots in held.values()) == sorted(rooms)


def test_plans_do_not_grow_with_counts():
    few = best_fit.plan_counts({n: 3 for n in range(1, 1025)})
    many = best_fit.plan_counts({n: 10**12 + n for n in range(1, 1025)})
    assert len(many) < 4 * len(few) + 4 * 1024 and many[:, 3].max() > 10**14


def test_best_fit_packs_whole_texts(spark, odd):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    found = best_fit.pack(odd, path, with_ids=True).collect()
    texts = defaultdict(list)
    for r in found:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        texts[r["doc_id"]].append(r)
    want = defaultdict(list)
    for doc_id, text in ODD:
        want[doc_id].append([*library.encode(text or "", add_special_tokens=False).ids, 2])
    assert set(texts) == set(want)
    for doc_id, pieces in texts.items():
        copies = len(want[doc_id])
        assert all(one == want[doc_id][0] for one in want[doc_id])
        ids = want[doc_id][0]
        assert len(pieces) == copies * -(-len(ids) // 1024)
        for r in pieces:
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids[r["start"] : r["start"] + r["length"]]
            assert r["piece"] == 0 and r["start"] == 0 or r["length"] == 1024 and (r["start"] - len(ids)) % 1024 == 0
    held = defaultdict(list)
    for r in found:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for slots in held.values():
        assert [at for at, _ in sorted(slots)] == [0, *itertools.accumulate(n for _, n in sorted(slots))][:-1]
        assert sum(n for _, n in slots) <= 1024
    assert best_fit.pack(odd.where("doc_id = 0"), path).count() == 0


def test_best_fit_of_the_table_needs_few_sequences(spark, sf_dir):
    found = queries.op13_best_fit(spark, sf_dir)
    total, used, docs = found.agg(F.sum("length"), F.countDistinct("sequence_id"), F.countDistinct("doc_id")).first()
    assert docs == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert used <= 1.02 * -(-total // 1024) + 1


# --- SQL --------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_conversation_repair"])
def test_matches_sql(spark, sf_dir, name):
    import duckdb

    from tools.check_oracle import compare

    connection = duckdb.connect()
    for table in ("documents", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    assert compare(spark, connection, name, sf_dir)[0].startswith("ok")
