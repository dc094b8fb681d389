"""Secrets (operator 2): all rule patterns in one deterministic automaton, one pass over the bytes of a text.

The patterns are parsed to a nondeterministic automaton, made deterministic by subset construction, minimised by
partition refinement and laid out as one flat transition array over byte classes. A rule's hit is the end of a stretch
of accepting states; its start is found by running the reversed rule backwards from there, so that the matches are the
leftmost longest ones that do not overlap, kind by kind.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import whole

# Rule name, pattern, least length of a match (a long count in a pattern costs states, a check does not).
# Patterns know literals, [classes], (a|b), and the repeats ? * + {n,}; "(?i)" makes the letters of the rule's first group
# stand for both cases.
RULES = (
    ("assign", "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]+", 0),
    ("access", "AKIA[A-Z0-9]+", 16),
    ("hex", "[0-9a-f]{8,}", 32),
    ("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    ("google", "AIza[A-Za-z0-9_-]+", 39),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
)
BASE_KINDS = ("assign", "access", "hex")
LEAST_VALUE = 8


class _Parser:
    """Patterns as trees: ("set", bytes), ("cat", parts), ("or", parts), ("rep", part, least, most)."""

    def __init__(self, pattern: str):
        self.fold = pattern.startswith("(?i)")
        self.text, self.at = pattern.removeprefix("(?i)"), 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def char(self) -> int:
        c = self.take()
        if c == "\\":
            c = self.take()
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def either(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return ("or", parts) if len(parts) > 1 else parts[0]

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        part = self.single()
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            if c == "{":
                least = self.text[self.at : self.text.index(",}", self.at)]
                self.at += len(least) + 2
                part = ("rep", part, int(least), None)
            else:
                part = ("rep", part, int(c == "+"), 1 if c == "?" else None)
        return part

    def single(self):
        c = self.peek()
        if c == "(":
            self.take()
            part = self.either()
            self.take()
            self.fold = False
            return part
        if c == "[":
            self.take()
            found = set()
            while self.peek() != "]":
                a = self.char()
                if self.peek() == "-" and self.text[self.at + 1] != "]":
                    self.take()
                    found.update(range(a, self.char() + 1))
                else:
                    found.add(a)
            self.take()
            return ("set", frozenset(found))
        a = self.char()
        if self.fold and chr(a).isalpha():
            return ("set", frozenset((ord(chr(a).lower()), ord(chr(a).upper()))))
        return ("set", frozenset((a,)))


class _Net:
    """A nondeterministic automaton with free moves."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.moves: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append(None)
        return len(self.free) - 1

    def add(self, tree, start: int, backwards: bool) -> int:
        """Build `tree` from `start` on; the state where it ends."""
        kind, body = tree[0], tree[1]
        if kind == "set":
            here, end = self.state(), self.state()
            self.free[start].append(here)
            self.moves[here] = (body, end)
            return end
        if kind == "cat":
            for part in reversed(body) if backwards else body:
                start = self.add(part, start, backwards)
            return start
        end = self.state()
        if kind == "or":
            for part in body:
                self.free[self.add(part, start, backwards)].append(end)
            return end
        least, most = tree[2], tree[3]
        for _ in range(least):
            start = self.add(body, start, backwards)
        if most is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(body, loop, backwards)].append(loop)
            self.free[loop].append(end)
        else:
            self.free[start].append(end)
            for _ in range(most - least):
                start = self.add(body, start, backwards)
                self.free[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)


class Automaton:
    """`table[state + class]` is the next state (states are multiples of `width`), `accepts[state // width]` its rules.

    States that accept come last: `state >= first_hit` is the only test of the scan.
    """

    def __init__(self, trees: list, searching: bool, backwards: bool = False):
        net = _Net()
        root = net.state()
        ends = {}
        for i, tree in enumerate(trees):
            ends[net.add(tree, root, backwards)] = i
        # Bytes that every set treats alike form one class.
        sets = list({m[0] for m in net.moves if m})
        signs: dict[tuple, int] = {}
        self.classes = bytes(signs.setdefault(tuple(b in s for s in sets), len(signs)) for b in range(256))
        sample = [self.classes.index(c) for c in range(len(signs))]
        start = net.closure([root])
        number, rows, todo = {start: 0}, [], [start]
        while todo:  # subset construction
            nexts = []
            held = todo.pop(0)
            steps = [net.moves[s] for s in held if net.moves[s]]
            for b in sample:
                goal = {t for chars, t in steps if b in chars}
                goal = net.closure(goal | {root} if searching else goal)
                if goal not in number:
                    number[goal] = len(number)
                    todo.append(goal)
                nexts.append(number[goal])
            rows.append(nexts)
        accepts = [tuple(sorted(ends[s] for s in held if s in ends)) for held in number]
        block = accepts
        while True:  # minimisation: split blocks until their members move alike
            ids: dict = {}
            finer = [ids.setdefault((block[s], *(block[t] for t in rows[s])), len(ids)) for s in range(len(rows))]
            if len(ids) == len(set(block)):
                break
            block = finer
        by_block = {b: s for s, b in reversed(list(enumerate(finer)))}
        order = sorted(by_block, key=lambda b: (bool(accepts[by_block[b]]), by_block[b]))
        place = {b: i for i, b in enumerate(order)}
        self.width = len(sample)
        self.table = [place[finer[t]] * self.width for b in order for t in rows[by_block[b]]]
        self.accepts = [accepts[by_block[b]] for b in order]
        self.start = place[finer[0]] * self.width
        self.first_hit = next((i for i, a in enumerate(self.accepts) if a), len(order)) * self.width
        steps = range(self.width)
        self.dead = {s for s in range(0, self.first_hit, self.width) if all(self.table[s + c] == s for c in steps)}


@lru_cache(maxsize=4)
def compiled(rules: tuple) -> tuple[Automaton, list[Automaton]]:
    trees = [_Parser(r[1]).either() for r in rules]
    return Automaton(trees, searching=True), [Automaton([t], searching=False, backwards=True) for t in trees]


def _start_of(back: Automaton, codes: bytes, end: int, floor: int) -> int:
    """The leftmost start, not before `floor`, of a match of one rule that ends at `end`; -1 if there is none."""
    table, first_hit, state, found = back.table, back.first_hit, back.start, -1
    for at in range(end - 1, floor - 1, -1):
        state = table[state + codes[at]]
        if state >= first_hit:
            found = at
        elif state in back.dead:
            break
    return found


def find(text: str, machines) -> list[tuple[int, int, int]]:
    """(start, end, rule) of each match in code points, by start, then by rule; before any check of lengths."""
    forward, back = machines
    raw = text.encode("ascii", "replace")  # one byte for each code point; "?" is in no rule
    table, first_hit, state = forward.table, forward.first_hit, forward.start
    hits: dict[int, list[int]] = {}  # rule: ends of its stretches
    for at, code in enumerate(raw.translate(forward.classes), 1):
        state = table[state + code]
        if state >= first_hit:
            for rule in forward.accepts[state // forward.width]:
                ends = hits.setdefault(rule, [0])
                if ends[-1] == at - 1:
                    ends[-1] = at
                else:
                    ends.append(at)
    found = []
    for rule, ends in hits.items():
        codes, floor = raw.translate(back[rule].classes), 0
        for end in ends:
            if end and (start := _start_of(back[rule], codes, end, floor)) >= 0:
                found.append((start, end, rule))
                floor = end
    return sorted(found, key=lambda x: (x[0], x[2]))


def value_of(match: str) -> str:
    """What an assignment assigns: the text after the first sign, spaces and quote."""
    at = min(i for i in (match.find(":"), match.find("=")) if i >= 0)
    value = match[at + 1 :].lstrip(" ")
    return value[1:] if value[:1] in ("'", '"') else value


def secrets_of(text: str, rules: tuple = RULES, machines=None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the matches that pass their rule's check."""
    out = []
    for start, end, rule in find(text, machines or compiled(rules)):
        kind, _, least = rules[rule]
        if end - start >= least and (kind != "assign" or len(value_of(text[start:end])) >= LEAST_VALUE):
            out.append((kind, start, end))
    return out


RESULT = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no spans (the digest of the empty string, and an empty list). Every row is its own
    result: repeated rows repeat, other columns are not read. Spans are kind:start:end in code points, by start, then in
    the order of the rules; a document's spans are one string and grow with its own text only.
    """
    machines = compiled(RULES)

    @F.arrow_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def found(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            spans = secrets_of(t, RULES, machines)
            base = [s for s in spans if s[0] in BASE_KINDS]
            joined = [",".join(f"{k}:{a}:{b}" for k, a, b in x) for x in (base, spans)]
            count = {k: sum(s[0] == k for s in base) for k in BASE_KINDS}
            out.append(
                {"n_assign": count["assign"], "n_access": count["access"], "n_hex": count["hex"],
                 "base_sha256": hashlib.sha256(joined[0].encode()).hexdigest(), "spans": joined[1]}
            )
        return pa.array(out, RESULT)

    return rows.select(F.col(key).alias("doc_id"), found(whole(text)).alias("s")).select("doc_id", "s.*")
