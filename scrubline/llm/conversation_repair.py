"""Cheapest repair of the structure of conversations, with its audit trail.

The rows of a conversation pass by in order, once.  For each state of the grammar ``(s?(ua)+)?`` a dynamic programme
keeps the cheapest edits so far as one node of a forest; a node adds one edit to its parent, so prefixes
are shared.  Of two audits with equal cost the ASCII-least wins: nodes hold ancestors at powers of two and a rolling hash, by
which the longest common prefix is searched; where hashes agree, the nodes behind them are compared.
As soon as all states that can still win share a prefix, that part is final: its rows are written out and
forgotten, so a conversation of any length is a stream, not a group in memory.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
SENTENCE_ENDS = ".!?"
LEGAL_PAIRS = {"su", "ua", "au"}

# states: nothing yet, after a system turn, after a user turn, after an assistant turn
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {
    (EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT,
}
WANTED = {EMPTY: "u", SYSTEM: "u", ASSISTANT: "u", USER: "a"}
ROLES = {"u": "user", "a": "assistant"}
# DETOUR[y][x]: whatever follows state x, state y can match it at so much more at most
DETOUR = {
    EMPTY: {SYSTEM: 0, USER: INSERT_COST, ASSISTANT: 0},
    SYSTEM: {EMPTY: 2 * INSERT_COST, USER: INSERT_COST, ASSISTANT: 2 * INSERT_COST},
    USER: {EMPTY: INSERT_COST + DELETE_COST, SYSTEM: INSERT_COST, ASSISTANT: INSERT_COST},
    ASSISTANT: {EMPTY: DELETE_COST, SYSTEM: 0, USER: INSERT_COST},
}

# rows, or characters of text, that wait at least before a shared prefix is looked for
WAITING_ROWS = 512
WAITING_CHARS = 4 << 20
ROWS_OUT = 2_000

ROW_SCHEMA = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
TURN_SCHEMA = "conv_id long, position long, edit string, role string, text string"


class Audits:
    """A forest of edit sequences; node 0 is the empty one."""

    MODULUS = (1 << 61) - 1
    BASE = 1_000_003

    def __init__(self):
        self.edit, self.depth, self.hash = [""], [0], [0]
        self.above: list[list[int]] = [[]]  # ancestors 1, 2, 4, ... edits before

    def add(self, parent: int, edit: str) -> int:
        node, above = len(self.edit), [parent]
        while len(self.above[above[-1]]) >= len(above):
            above.append(self.above[above[-1]][len(above) - 1])
        self.edit.append(edit)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * self.BASE + ord(edit)) % self.MODULUS)
        self.above.append(above)
        return node

    def lift(self, node: int, depth: int) -> int:
        """The ancestor of a node at a depth."""
        while self.depth[node] > depth:
            node = self.above[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two nodes of equal depth stand for equal edits; an agreeing hash is verified."""
        if self.hash[a] != self.hash[b]:
            return False
        while a != b:
            if self.edit[a] != self.edit[b]:
                return False
            a, b = self.above[a][0], self.above[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the edits of ``a`` come before those of ``b`` in ASCII order."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.lift(a, depth), self.lift(b, depth)
        if self.same(x, y):
            return self.depth[a] < self.depth[b]
        # x and y differ; go up while the ancestors still do
        for k in range(len(self.above[x]) - 1, -1, -1):
            if k < len(self.above[x]) and not self.same(self.above[x][k], self.above[y][k]):
                x, y = self.above[x][k], self.above[y][k]
        return self.edit[x] < self.edit[y]

    def shared(self, nodes: list[int]) -> int:
        """The deepest common ancestor."""
        one = nodes[0]
        for other in nodes[1:]:
            depth = min(self.depth[one], self.depth[other])
            one, other = self.lift(one, depth), self.lift(other, depth)
            for k in range(len(self.above[one]) - 1, -1, -1):
                if k < len(self.above[one]) and self.above[one][k] != self.above[other][k]:
                    one, other = self.above[one][k], self.above[other][k]
            if one != other:
                one = self.above[one][0]
        return one

    def edits(self, node: int, since: int = 0) -> str:
        """The edits of a node after those of its ancestor ``since``."""
        out = []
        while node != since:
            out.append(self.edit[node])
            node = self.above[node][0]
        return "".join(reversed(out))


class Repair:
    """The edits of one conversation, whose rows arrive in order."""

    def __init__(self, emit: Callable[[str, str, str], None]):
        """``emit(edit, role, text)`` gets the final edits in order; a deleted row has no role and text."""
        self.emit = emit
        self.audits, self.best = Audits(), {EMPTY: (0, 0)}  # state: (cost, node)
        self.waiting: deque[tuple[str, str]] = deque()
        self.chars, self.patience = 0, 1
        self.state = EMPTY
        self.insert()

    def offer(self, best: dict[int, tuple[int, int]], state: int, cost: int, parent: int, edit: str) -> bool:
        old = best.get(state)
        if old is not None and old[0] < cost:
            return False
        node = self.audits.add(parent, edit)
        if old is not None and old[0] == cost and not self.audits.less(node, old[1]):
            return False
        best[state] = (cost, node)
        return True

    def insert(self) -> None:
        """Add turns out of nothing where that leads to a state more cheaply, and drop states that cannot win."""
        best, changed = self.best, True
        while changed:
            changed = False
            for state in [*best]:
                cost, node = best[state]
                changed |= self.offer(best, NEXT[state, WANTED[state]], cost + INSERT_COST, node, INSERT)
        self.best = {
            x: (cost, node) for x, (cost, node) in best.items()
            if not any(y != x and cost > other + DETOUR[y][x] for y, (other, _) in best.items())
        }

    def row(self, role: str, text: str, bad: bool, truncated: bool) -> None:
        """The next row; a bad one must be deleted."""
        best: dict[int, tuple[int, int]] = {}
        initial, more = role[:1], TRUNCATED_COST if truncated else 0
        for state, (cost, node) in self.best.items():
            self.offer(best, state, cost + DELETE_COST, node, DELETE)
            if not bad:
                kept = NEXT.get((state, initial))
                if kept is not None:
                    self.offer(best, kept, cost + more, node, KEEP)
                self.offer(best, NEXT[state, WANTED[state]], cost + more + REROLE_COST, node, REROLE)
        self.best = best
        self.insert()
        self.waiting.append(("", "") if bad else (role, text))
        self.chars += 0 if bad else len(text)
        if len(self.waiting) >= self.patience * WAITING_ROWS or self.chars >= self.patience * WAITING_CHARS:
            before = len(self.waiting)
            self.settle(self.audits.shared([node for _, node in self.best.values()]))
            # look again only after as many rows more as still wait
            self.patience = 1 if 2 * len(self.waiting) < before else 2 * self.patience

    def settle(self, node: int) -> None:
        """Write out the edits up to a node that all live nodes descend from, and forget them."""
        old, self.audits = self.audits, Audits()
        for edit in old.edits(node):
            role, text = self.waiting.popleft() if edit != INSERT else ("", "")
            if edit == DELETE:
                self.emit(edit, None, None)
                continue
            self.chars -= len(text)
            wanted = role[:1] if edit == KEEP else WANTED[self.state]
            self.state = NEXT[self.state, wanted]
            self.emit(edit, role if edit == KEEP else ROLES[wanted], text)
        moved = {}
        for state, (cost, live) in self.best.items():
            at = 0
            for edit in old.edits(live, node):
                at = self.audits.add(at, edit)
            moved[state] = (cost, at)
        self.best = moved

    def end(self) -> int:
        """Settle on the cheapest whole audit; its cost."""
        cost, node = self.best.get(EMPTY) or self.best[ASSISTANT]
        if ASSISTANT in self.best:
            other_cost, other = self.best[ASSISTANT]
            if other_cost < cost or (other_cost == cost and other != node and self.audits.less(other, node)):
                cost, node = other_cost, other
        self.best = {}
        self.settle(node)
        return cost


class Conversation:
    """Counts, audit and digest of one conversation, whose rows arrive in order."""

    def __init__(self, emit: Callable[[str, str, str], None] | None = None):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None
        self.last = self.key = None
        self.audit: list[str] = []
        self.digest, self.written, self.also = hashlib.sha256(), False, emit
        self.repair = Repair(self.emit)

    def emit(self, edit: str, role: str | None, text: str | None) -> None:
        self.audit.append(edit)
        if role is not None:
            self.digest.update((("\n" if self.written else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.written = True
        if self.also:
            self.also(edit, role, text)

    def row(self, turn: int | None, role: str, text: str, digest: bytes, seen: bool) -> None:
        seen |= (turn, role, digest) == self.key
        self.key = (turn, role, digest)
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        initial = role[:1]
        self.illegal += self.last is not None and self.last + initial not in LEGAL_PAIRS
        self.last = initial
        shown = text.rstrip(BLANKS)
        blank, cut = not shown, bool(shown) and shown[-1] not in SENTENCE_ENDS
        self.blank += blank
        self.duplicate += seen and not blank
        self.truncated += cut and not seen
        self.repair.row(role, text, blank or seen, cut)

    def end(self) -> tuple:
        cost = self.repair.end()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.digest.hexdigest()


def in_order(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, present) with what says that a row was seen before, sorted by conversation.

    Where role and text come again at a later turn is found without the texts, by digests and the smallest turn of
    each; a mark then lies right before such a row.  Only the sorted stream itself moves the texts.
    """
    keyed = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    place = F.struct(F.col("turn").isNotNull(), "turn")  # a null turn comes first
    light = keyed.where("present").select("conv_id", "turn", "role", "digest", place.alias("place"))
    again = (
        light.groupBy("conv_id", "role", "digest")
        .agg(F.min("place").alias("first"), F.max("place").alias("last"))
        .where("last > first")
        .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    )
    here = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    marks = light.join(again, here).where("place > first").select("conv_id", "turn", "role", "digest")
    marks = marks.select("*", F.lit(True).alias("present"), F.lit(True).alias("mark"), F.lit(None).cast("string").alias("text"))
    stream = keyed.select("conv_id", "turn", "role", "digest", "present", F.lit(False).alias("mark"), F.when(F.col("present"), F.col("text")).alias("text"))
    return stream.unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest", F.col("mark").desc())


def _rows(convs: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present_col: str | None) -> DataFrame:
    space = F.lit(" ")
    return convs.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), space).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), space).alias("text"),
        (F.coalesce(F.col(present_col), F.lit(False)) if present_col else F.lit(True)).alias("present"),
    )


def _walk(batches: Iterator[pa.RecordBatch], start: Callable[[int | None], Conversation], done: Callable[[int | None, Conversation], None]) -> Iterator[None]:
    """Feed sorted rows to conversations; yields after every batch and at the end."""
    current, conv_id, marked = None, None, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "digest", "present", "mark", "text")]
        for conv, turn, role, digest, present, mark, text in zip(*columns):
            if current is None or conv != conv_id:
                if current is not None:
                    done(conv_id, current)
                current, conv_id, marked = start(conv), conv, None
            if mark:
                marked = (turn, role, digest)
            elif present:
                current.row(turn, role, text, digest, (turn, role, digest) == marked)
        yield
    if current is not None:
        done(conv_id, current)
    yield


def repair(
    convs: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    present_col: str | None = None,
) -> DataFrame:
    """One row per conversation: its faults, the cost and audit of its cheapest repair, the digest of what comes out.

    Rows are taken by turn, null turns first; at one turn by role and the digest of the text.  A null role
    or text is one space.  Rows with a null conversation id form one conversation.  Repeated rows are duplicates.  Where
    ``present_col`` is not true, a row only names its conversation, which has zeros and an empty audit if it holds no other row.
    An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        names = [c.split()[0] for c in ROW_SCHEMA.split(", ")]
        for _ in _walk(batches, lambda _: Conversation(), lambda conv, found: rows.append((conv, *found.end()))):
            for at in range(0, len(rows), ROWS_OUT):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + ROWS_OUT]), kinds)], names)
            rows.clear()

    return in_order(_rows(convs, conv_col, turn_col, role_col, text_col, present_col)).mapInArrow(run, ROW_SCHEMA)


def repaired_turns(
    convs: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    present_col: str | None = None,
) -> DataFrame:
    """The repaired conversations: position from 0, the edit that made the turn (K, R or I), role and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def start(conv: int | None) -> Conversation:
            count = iter(range(1 << 62))

            def emit(edit: str, role: str | None, text: str | None) -> None:
                if role is not None:
                    rows.append((conv, next(count), edit, role, text))

            return Conversation(emit)

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = [c.split()[0] for c in TURN_SCHEMA.split(", ")]
        for _ in _walk(batches, start, lambda _, found: found.end()):
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                rows.clear()

    return in_order(_rows(convs, conv_col, turn_col, role_col, text_col, present_col)).mapInArrow(run, TURN_SCHEMA)


def damaged(convs: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with planted faults, by the checksum of id and turn.

    Dropped rows stay as rows that are not ``present``.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(name.cast("binary")) % 20
    text, role = F.coalesce(F.col("text"), space), F.coalesce(F.col("role"), space)
    return convs.select(
        "conv_id",
        "turn",
        F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, SENTENCE_ENDS, "")).otherwise(text).alias("text"),
        (fault != 0).alias("present"),
        F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")
