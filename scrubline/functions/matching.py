"""Run any list of rules over texts, trying only those that can match.

What a match of a rule must contain is read off its pattern: sets of literals of which one has to occur in the text's shape, where case is
folded, a digit is ``0`` and a run of white space one blank.  One
pass of an automaton over that shape finds all literals of all rules; a rule whose needs are not met is
not tried.  A rule from whose pattern nothing can be read is always tried.

The forms that run are equivalent to the patterns but read each character a bounded number of times: blanks around an
optional sign are taken once, and a word boundary before a class comes after its first character, so
that the engine skips ahead to that class; a group of alternatives is likewise entered by a class of its first characters.

Columns of ASCII texts are taken whole, rule by rule, by Arrow's engine, which looks at each character once and knows no other
word characters.  Texts of other kinds, and lists of rules with a pattern that this engine may read in another way, are run one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

try:
    from re import _constants as ops
    from re import _parser as parser
except ImportError:  # another layout of the standard library: nothing is read off, every rule is tried
    ops = parser = None
try:
    import ahocorasick
except ImportError:
    ahocorasick = None

# more alternatives than this are not told apart within one literal
MOST_VARIANTS = 4
# shorter literals are looked for one by one: they occur too often to be reported
SHORTEST_IN_AUTOMATON = 3

Clause = frozenset


# --- what a pattern needs ---------------------------------------------------


def _folded_character(op, value) -> str | None:
    """The one character, case folded, that an item matches."""
    if op is ops.LITERAL:
        return chr(value).casefold()
    if op is ops.IN and all(kind is ops.LITERAL for kind, _ in value):
        folded = {chr(c).casefold() for _, c in value}
        return folded.pop() if len(folded) == 1 else None
    return None


def _members(value) -> set[str] | None:
    """The characters of a class, if they are few and listed one by one."""
    if len(value) <= MOST_VARIANTS and all(kind is ops.LITERAL for kind, _ in value):
        return {chr(c).casefold() for _, c in value}
    return None


def _only_digits(op, value) -> bool:
    if op is ops.LITERAL:
        return chr(value).isdigit()
    return op is ops.IN and all(
        (kind is ops.LITERAL and chr(v).isdigit())
        or (kind is ops.RANGE and v[0] >= ord("0") and v[1] <= ord("9"))
        or (kind is ops.CATEGORY and v is ops.CATEGORY_DIGIT)
        for kind, v in value
    )


def _strength(clause: Clause) -> tuple[int, int]:
    return min(map(len, clause)), -len(clause)


def _walk(items, start: set[str] | None = None) -> tuple[list[Clause], bool]:
    """Clauses, each a set of literals of which one must occur, and whether a digit must; ``start`` stands before."""
    clauses: list[Clause] = []
    digit = False
    run = start or {""}

    def flush() -> None:
        nonlocal run
        if "" not in run:
            clauses.append(Clause(run))
        run = {""}

    for op, value in items:
        character = _folded_character(op, value)
        if character is not None:
            run = {variant + character for variant in run}
            digit |= character.isdigit()
            continue
        if op is ops.AT:
            continue
        if op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
            least, most, item = value
            optional = _folded_character(*item[0]) if len(item) == 1 else None
            if (least, most) == (0, 1) and optional is not None and 2 * len(run) <= MOST_VARIANTS:
                run |= {variant + optional for variant in run}
                continue
            flush()
            if least:
                more, number = _walk(item)
                clauses += more
                digit |= number
            continue
        if op is ops.BRANCH:
            each = [_walk(branch, run) for branch in value[1]]
            digit |= all(number for _, number in each)
            if all(of for of, _ in each):
                clauses.append(Clause().union(*(max(of, key=_strength) for of, _ in each)))
                run = {""}
            flush()
            continue
        flush()
        if op is ops.IN:
            digit |= _only_digits(op, value)
            members = _members(value)
            if members:
                clauses.append(Clause(members))
        elif op in (ops.SUBPATTERN, ops.ATOMIC_GROUP):
            more, number = _walk(value[-1] if op is ops.SUBPATTERN else value)
            clauses += more
            digit |= number
    flush()
    clauses = [Clause(x for x in c if not any(y in x for y in c if y != x)) for c in clauses]
    return [c for c in clauses if all(len(x) > 1 or not x.isalnum() for x in c)], digit


def needs(pattern: str) -> tuple[tuple[Clause, ...], bool]:
    """Sets of case-folded literals, of each of which one occurs in every match, and whether every match holds a digit."""
    if parser is None:
        return (), False
    try:
        clauses, digit = _walk(parser.parse(pattern))
    except re.error:  # a pattern for the other engine only
        return (), False
    return tuple(dict.fromkeys(clauses)), digit


# --- what a match looks like -------------------------------------------------

# so many literals are told apart within one stretch, and so many repeats of a character are written out
MOST_SHAPES = 64
MOST_REPEATS = 16


# the shape of each ASCII character; 0x1c to 0x1f are white space to one of the engines
_ASCII = bytes(48 if c in b"0123456789" else 32 if c in b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f" else c for c in bytes(range(128)).lower()) + bytes(128)
# characters outside ASCII that may match a letter when case is ignored; the kinds of i are not folded into it
_OTHER_CASES = "\u0130\u0131\u017f\u212a"


def shape(text: str) -> str:
    """The text with case folded, every digit as ``0`` and every run of white space as one blank, as either engine knows them."""
    if text.isascii():
        text = text.encode().translate(_ASCII).decode()
    else:
        text = text.replace("\u0130", "i").replace("\u0131", "i").casefold()
        for engine in (re, regex):
            text = engine.sub(r"\s", " ", engine.sub(r"\d", "0", text))
    while "  " in text:
        text = text.replace("  ", " ")
    return text


def _shapes_of(op, value) -> set[str] | None:
    """The shapes of the characters that an item matches, if they are few."""
    if op is ops.LITERAL:
        return {shape(chr(value))}
    if op is not ops.IN:
        return None
    found = set()
    for kind, v in value:
        if kind is ops.LITERAL:
            found.add(shape(chr(v)))
        elif kind is ops.RANGE and v[1] - v[0] < MOST_SHAPES:
            found |= {shape(chr(c)) for c in range(v[0], v[1] + 1)}
        elif kind is ops.CATEGORY and v in (ops.CATEGORY_DIGIT, ops.CATEGORY_SPACE):
            found.add("0" if v is ops.CATEGORY_DIGIT else " ")
        else:
            return None
    return found if len(found) <= MOST_VARIANTS else None


def _then(run: set[str], more: set[str]) -> set[str]:
    """Each of ``run`` followed by each of ``more``; one that ends in another says no more than that."""
    both = {(a + b).replace("  ", " ") for a in run for b in more}
    return {x for x in both if not any(x.endswith(y) for y in both if y != x)}


def _closed(run: set[str]) -> list[Clause]:
    return [] if "" in run else [Clause(run)]


def _walk_shapes(items, run: set[str]) -> tuple[list[Clause], set[str]]:
    """Clauses of shapes of which one must occur, and the shapes that may stand right before what follows the items."""
    clauses: list[Clause] = []

    def close(after: set[str]) -> set[str]:
        clauses.extend(_closed(run))
        return after

    for op, value in items:
        if op is ops.AT:
            continue
        members, least, most = _shapes_of(op, value), 1, 1
        if op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
            least, most, inner = value
            members = _shapes_of(*inner[0]) if len(inner) == 1 else None
            if members is None:
                more, end = _walk_shapes(inner, run if (least, most) in ((0, 1), (1, 1)) else {""})
                if (least, most) == (0, 1) and not more and len(run | end) <= MOST_SHAPES:
                    run = run | end
                    continue
                run = close({""})
                if least:
                    clauses += more + _closed(end)
                continue
        if members is not None:
            if members == {" "}:  # a run of white space is one blank
                least, most = min(least, 1), 1
            written, times = {""}, 0
            while times < min(least, MOST_REPEATS) and len(written) * len(members) <= MOST_SHAPES:
                written, times = _then(written, members), times + 1
            if len(run) * len(written) * (len(members) + 1 if most > least else 1) > MOST_SHAPES:
                run = close({""})
            run = _then(run, written)
            if (least, most) == (0, 1):
                run = run | _then(run, members)
            elif most > least or least > times:
                run = close(written)
            continue
        if op is ops.BRANCH:
            each = [_walk_shapes(branch, run) for branch in value[1]]
            ends = set().union(*(end for _, end in each))
            if any(more for more, _ in each) or len(ends) > MOST_SHAPES:
                own = [more + _closed(end) for more, end in each]
                clauses += _closed(run)
                if all(own):
                    clauses.append(Clause().union(*(max(of, key=_strength) for of in own)))
            run = ends if len(ends) <= MOST_SHAPES else {""}
        elif op is ops.SUBPATTERN or op is ops.ATOMIC_GROUP:
            more, run = _walk_shapes(value[-1] if op is ops.SUBPATTERN else value, run)
            clauses += more
        else:
            run = close({""})
    return clauses, run


def shapes(pattern: str) -> tuple[Clause, ...]:
    """Sets of literals, of each of which one occurs in the shape of every match.

    They say more than ``needs``: digits and white space count as the signs that stand for them.
    """
    if parser is None:
        return ()
    try:
        clauses, run = _walk_shapes(parser.parse(pattern), {""})
    except re.error:  # a pattern for the other engine only
        return ()
    clauses = [Clause(x for x in c if not any(y in x for y in c if y != x)) for c in clauses + _closed(run)]
    clauses = [c for c in dict.fromkeys(clauses) if all(len(x) > 1 or x == "0" or not x.isalnum() for x in c)]
    # a clause that another one brings along says nothing new
    return tuple(c for c in clauses if not any(o != c and all(any(x in y for x in c) for y in o) for o in clauses))


# --- forms that run in linear time ------------------------------------------

# blanks, an optional sign, blanks, before something that is no blank
_SEPARATOR = re.compile(r"\\s\*(\[[^\]\\]+\])\?\\s\*(?=(?:#\?)?(?:\[\\w|\\d|\(\?:(?:\d|\\\+)))")
_BOUNDARY = re.compile(r"(\(\?i\))?\\b((?:\(\?:)?)(\[A-Z\]|\\d)(?:\{(\d+)(?:,(\d+))?\})?(?![+*?{])")


def read_once(pattern: str) -> str:
    """The same matches, with blanks on both sides of an optional sign read once instead of split in every way."""
    return _SEPARATOR.sub(r"\\s*+(?:\1\\s*+)?", pattern)


def skipping(pattern: str) -> str:
    """The same matches, with a leading word boundary tested after the first character of a class of word characters."""
    found = _BOUNDARY.match(pattern)
    if not found or (found[2] and "|" in pattern):
        return pattern
    flag, group, of, least, most = found.groups()
    rest = ""
    if least is not None:
        rest = f"{of}{{{int(least) - 1},{int(most) - 1}}}" if most else f"{of}{{{int(least) - 1}}}"
    return f"{flag or ''}{group}{of}(?<!\\w{of}){rest}{pattern[found.end():]}"


def fast_form(pattern: str) -> str:
    return skipping(read_once(pattern))


_FIRST = re.compile(r"([A-Za-z0-9])(?![?*+{])|\[([A-Za-z0-9]+|\d-\d)\](?![?*+{])|(\\d)(?:\{(\d+)(?:,(\d+))?\})?(?![?*+{])")


def _alternatives(pattern: str) -> list[str] | None:
    """The alternatives of the group that a text starts with, and what comes after it; none if it cannot be told."""
    found, depth, begin, at, in_class = [], 0, 3, 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            depth += 1
        elif c in "|)" and depth == 1:
            found.append(pattern[begin:at])
            begin = at + 1
            if c == ")":
                rest = pattern[begin:]
                return None if rest[:1] in ("?", "*", "+", "{") else [*found, rest]
        if c == ")" and not in_class:
            depth -= 1
        at += 1
    return None


def _without_first(pattern: str, ignore_case: bool) -> tuple[str, str] | None:
    """The first character, as the inside of a class, and what follows it."""
    if pattern.startswith("(?:"):
        split = _alternatives(pattern)
        parts = split and [_without_first(x, ignore_case) for x in split[:-1]]
        if not parts or not all(parts):
            return None
        return "".join(first for first, _ in parts), "(?:" + "|".join(f"(?<=[{first}]){rest}" for first, rest in parts) + ")" + split[-1]
    found = _FIRST.match(pattern)
    if not found:
        return None
    one, listed, digit, least, most = found.groups()
    rest = pattern[found.end():]
    if digit:
        if least is None:
            return digit, rest
        if int(least) < 1:
            return None
        return digit, (f"\\d{{{int(least) - 1},{int(most) - 1}}}" if most else f"\\d{{{int(least) - 1}}}") + rest
    first = one or listed
    if ignore_case and first.isalnum():
        kinds = dict.fromkeys(first + first.lower() + first.upper() + _OTHER_CASES)
        first = "".join(c for c in kinds if re.match(f"(?i)[{first}]", c))
    return first, rest


def starting(pattern: str) -> str:
    """The same matches, where a word boundary and a group of alternatives come first, for an engine that skips ahead to a class only.

    The first character is taken as a class that lists both cases, and the alternatives look back at it.
    """
    ignore_case = pattern.startswith("(?i)")
    body = pattern.removeprefix("(?i)")
    if not body.startswith(r"\b(?:"):
        return pattern
    split = _alternatives(body[2:])
    cut = _without_first(body[2:], ignore_case) if split else None
    if cut is None or _alternatives(f"(?:{body})") != [body, ""]:
        return pattern
    first, rest = cut
    return f"[{first}](?<!\\w[{first}])(?{'i' if ignore_case else ''}:{rest})"


# --- running rules ----------------------------------------------------------


def _straddles(literal: str, fixed: str) -> bool:
    """Whether a literal may reach over an end of a fixed stretch of text."""
    cuts = [(literal[:at], literal[at:]) for at in range(1, len(literal))]
    return any(fixed.startswith(b) or b.startswith(fixed) or fixed.endswith(a) or a.endswith(fixed) for a, b in cuts)


def _stands_at(pattern: str, group: int, end: int) -> bool:
    """Whether a group is the first (0) or last (-1) thing in every match."""
    try:
        items = [(op, value) for op, value in parser.parse(pattern) if op is not ops.AT]
    except re.error:
        return False
    return bool(items) and items[end][0] is ops.SUBPATTERN and items[end][1][0] == group


def _put(token: str) -> str:
    """A token as the engines write it in."""
    return re.sub(r"\\|\$(\d)", lambda m: rf"\{m[1]}" if m[1] else r"\\", token)


class RuleRunner:
    """Rules compiled with one engine, the ``re`` module or one like it."""

    def __init__(self, rules: Sequence, categories: Sequence[str], passes: int, engine=re):
        self.passes, self.categories = passes, list(categories)
        wanted = [shapes(r.pattern) for r in rules]
        # a bit for each clause; a literal has those of all clauses that it meets
        bit = {clause: 1 << k for k, clause in enumerate(dict.fromkeys(c for clauses in wanted for c in clauses))}
        self.every = (1 << len(bit)) - 1
        self.met: dict[str, int] = {}
        for clause, b in bit.items():
            for literal in clause:
                self.met[literal] = self.met.get(literal, 0) | b
        self.short = [(x, b) for x, b in self.met.items() if len(x) < SHORTEST_IN_AUTOMATON or ahocorasick is None]
        self.automaton = None
        if len(self.short) < len(self.met):
            self.automaton = ahocorasick.Automaton()
            for literal, b in self.met.items():
                if len(literal) >= SHORTEST_IN_AUTOMATON:
                    self.automaton.add_word(literal, b | self._inside(literal))
            self.automaton.make_automaton()
        self.rules = []
        for r, clauses in zip(rules, wanted):
            mask = sum(bit[clause] for clause in clauses)
            form, token = (r.fast, r.fast_token) if r.fast else (fast_form(r.pattern), r.token)
            put = _put(token)
            if engine is re and not r.fast:
                form = starting(form)
            compiled = (regex if r"\G" in form else engine).compile(form)  # only that engine knows where the last match ended
            self.rules.append((mask, compiled.subn, put, self.categories.index(r.category), self._brought_by(r.pattern, r.token)))

    def _inside(self, text: str) -> int:
        found = 0
        for literal, b in self.met.items():
            if literal in text:
                found |= b
        return found

    def _brought_by(self, pattern: str, token: str) -> int:
        """What a token may bring into a text: literals in it, and any that could reach over one of its ends.

        A group keeps the neighbours it had only where it stands at the same end of the match; otherwise it may bring anything.
        """
        parts = [shape(part) for part in re.split(r"\$\d", token)]
        groups = [int(g) for g in re.findall(r"\$(\d)", token)]
        moved = groups and not (
            all(parts[1:-1]) and (parts[0] or _stands_at(pattern, groups[0], 0)) and (parts[-1] or _stands_at(pattern, groups[-1], -1))
        )
        if moved or not any(parts):
            return self.every
        found = 0
        for part in filter(None, parts):
            found |= self._inside(part)
            for literal, b in self.met.items():
                if _straddles(literal, part):
                    found |= b
        return found

    def found_in(self, text: str) -> int:
        """The bits of all clauses that the text meets."""
        folded = shape(text)
        found = 0
        for literal, b in self.short:
            if literal in folded:
                found |= b
        if self.automaton is not None:
            for _, bits in self.automaton.iter(folded):
                found |= bits
        return found

    def run(self, text: str) -> tuple[str, int, list[str], list[int]]:
        """The text after all passes, how many replacements, and by category in order."""
        counts = [0] * len(self.categories)
        for _ in range(self.passes):
            changed, found = False, self.found_in(text)
            for mask, subn, put, category, brings in self.rules:
                if found & mask == mask:
                    text, n = subn(put, text)
                    if n:
                        counts[category] += n
                        found |= brings
                        changed = True
            if not changed:
                break
        hit = [k for k, n in enumerate(counts) if n]
        return text, sum(counts), [self.categories[k] for k in hit], [counts[k] for k in hit]


# --- running rules over columns ---------------------------------------------

# stands before each token until replacements are counted
MARK = "\x01"
# texts with such a character run one by one: the mark, and what only some engines take for white space
ODD_CHARACTERS = r"[\x00-\x08\x0b\x0e-\x1f]"
# texts of so many bytes, or one text, are taken at a time
COLUMN_BYTES = 4 << 20
# texts of fewer bytes run one by one, as patterns are compiled for each column anew
LEAST_BYTES = 1 << 16
# so many neighbours in the list are first looked for as one pattern
TOGETHER = 5


def _means_the_same(items) -> bool:
    """Whether all engines read the items alike in ASCII texts: nothing but characters, classes, groups, repeats and word boundaries."""
    for op, value in items:
        if op in (ops.LITERAL, ops.NOT_LITERAL):
            alike = value < 128
        elif op is ops.IN:
            alike = all(
                kind in (ops.NEGATE, ops.CATEGORY) or (kind is ops.LITERAL and v < 128) or (kind is ops.RANGE and v[1] < 128) for kind, v in value
            )
        elif op is ops.AT:
            alike = value in (ops.AT_BOUNDARY, ops.AT_NON_BOUNDARY)
        elif op is ops.BRANCH:
            alike = all(map(_means_the_same, value[1]))
        elif op is ops.SUBPATTERN:
            alike = _means_the_same(value[-1])
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
            # engines differ in whether an empty repeat counts
            alike = value[2].getwidth()[0] > 0 and _means_the_same(value[2])
        else:
            alike = False
        if not alike:
            return False
    return True


def for_columns(pattern: str) -> bool:
    """Whether Arrow's engine finds the same matches of the pattern in ASCII texts, none of them empty."""
    # spellings that the engines read apart: repeats without a lower bound, octal characters, classes named within classes
    if parser is None or not pattern.isascii() or re.search(r"\{,|\\\d|\[\[", pattern):
        return False
    try:
        items = parser.parse(pattern)
        pc.match_substring_regex(pa.array([""]), pattern)
    except (re.error, pa.ArrowInvalid):
        return False
    return items.getwidth()[0] > 0 and _means_the_same(items)


def _any_of(patterns: Iterable[str]) -> str:
    return "|".join(f"(?:{pattern})" for pattern in patterns)


class ColumnRunner:
    """Rules over columns of texts."""

    def __init__(self, rules: Sequence, categories: Sequence[str], passes: int):
        self.passes, self.categories = passes, list(categories)
        # outside ASCII, only the slower engine knows all word characters
        self.plain, self.full = (RuleRunner(rules, categories, passes, engine) for engine in (re, regex))
        self.by_column = bool(rules) and all(for_columns(r.pattern) and MARK not in r.token for r in rules)
        self.rules = [(r.pattern, _put(r.token), self.categories.index(r.category)) for r in rules]
        # a text that no rule of a group matches is the same after all of them: (any of its rules, group), the last being all rules
        groups = [self.rules[k : k + TOGETHER] for k in range(0, len(rules), TOGETHER)]
        self.tree = (_any_of(rule[0] for rule in self.rules), [(_any_of(rule[0] for rule in group), group) for group in groups])
        try:
            pc.match_substring_regex(pa.array([""]), self.tree[0])
        except pa.ArrowInvalid:
            self.by_column = False

    def run(self, texts: pa.Array) -> Iterable[tuple[pa.Array, np.ndarray]]:
        """Some texts at a time: those after all passes, and their (text, category) numbers of replacements; a null text has none."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(texts):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + COLUMN_BYTES, "right")))
            yield self._some(texts.slice(start, stop - start))
            start = stop

    def _some(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        counts = np.zeros((len(texts), len(self.categories)), np.int64)
        full = pc.greater(pc.binary_length(texts), 0)
        plain = pc.and_(pc.string_is_ascii(texts), pc.invert(pc.match_substring_regex(texts, ODD_CHARACTERS)))
        by_column = self.by_column and pc.sum(pc.binary_length(texts), min_count=0).as_py() >= LEAST_BYTES
        whole = pc.fill_null(pc.and_(full, plain), False).to_numpy(zero_copy_only=False) & by_column
        alone = pc.fill_null(full, False).to_numpy(zero_copy_only=False) & ~whole
        if alone.any():
            done = [self._one(text, own) for text, own in zip(texts.filter(pa.array(alone)).to_pylist(), self._rows(counts, alone))]
            texts = pc.replace_with_mask(texts, pa.array(alone), pa.array(done, texts.type))
        rows, now = np.flatnonzero(whole), texts.filter(pa.array(whole))
        for _ in range(self.passes):
            now, changed = self._any(self.tree, now, rows, counts)
            if not changed.any():
                break
            # what a pass leaves as it is stays so in the next
            some = np.zeros(len(texts), bool)
            some[rows[changed]] = True
            rows, now = rows[changed], now.filter(pa.array(changed))
            texts = pc.replace_with_mask(texts, pa.array(some), now)
        return texts, counts

    @staticmethod
    def _rows(counts: np.ndarray, which: np.ndarray) -> Iterable[np.ndarray]:
        return (counts[k] for k in np.flatnonzero(which))

    def _one(self, text: str, counts: np.ndarray) -> str:
        """One text after all passes; its replacements are added to ``counts``."""
        # the faster engine takes 0x1c to 0x1f for white space, which they are not
        runner = self.plain if text.isascii() and not re.search("[\x1c-\x1f]", text) else self.full
        text, _, found, times = runner.run(text)
        for category, n in zip(found, times):
            counts[self.categories.index(category)] += n
        return text

    def _any(self, node: tuple, texts: pa.Array, rows: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The texts after a rule or a group, and which of them changed; their replacements are added to their rows of ``counts``."""
        hit = pc.match_substring_regex(texts, node[0])
        where = hit.to_numpy(zero_copy_only=False)
        if not where.any():
            return texts, where
        some = texts if where.all() else texts.filter(hit)
        if isinstance(node[1], list):
            changed = np.zeros(len(some), bool)
            for inner in node[1]:
                some, more = self._any(inner, some, rows[where], counts)
                changed |= more
        else:
            pattern, put, category = node
            marked = pc.replace_substring_regex(some, pattern, MARK + put)
            some, changed = pc.replace_substring(marked, MARK, ""), True
            counts[rows[where], category] += pc.subtract(pc.binary_length(marked), pc.binary_length(some)).to_numpy()
        where = where.copy()
        if len(some) < len(texts):
            texts = pc.replace_with_mask(texts, hit, some)
            where[where] = changed
        else:
            texts, where[:] = some, changed
        return texts, where


def categories_of(rules: Iterable, known: Sequence[str]) -> list[str]:
    """The known categories, then those that only the rules name, in their order."""
    return list(dict.fromkeys([*known, *(r.category for r in rules)]))
