"""Repair of conversations (operator 12): the cheapest edits that give each conversation a legal order of roles.

A conversation's edits are a path through a lattice of (rows consumed, state of the roles so far). An auction finds its
prices: from each origin a path grows along arcs that cost exactly the difference of prices and shrinks where none does,
raising the price of its last node to the best it can get. Origins are taken from the end of the conversation to its
start, so that a path ends as soon as it meets a settled node and each node settles after a few steps. The prices are
then the exact remaining costs; arcs that spend exactly a difference of prices are tight, and taking the least letter
among them at each node gives the ASCII-least of the cheapest edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .shared import whole

SPACES = " \t\n\x0b\x0c\r"
#: First faults of a row, and the initials that the pattern knows; a row's code is initial + 4 * fault.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
OTHER, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: States: nothing yet, or the last role. `(s?(ua)+)?` may end in these:
NONE = 0
ENDS = (NONE, ASSISTANT)
#: State and initial -> state.
FOLLOWS = {(NONE, SYSTEM): SYSTEM, (NONE, USER): USER, (SYSTEM, USER): USER, (USER, ASSISTANT): ASSISTANT, (ASSISTANT, USER): USER}
#: The state after a user or assistant row of free choice: only one of the two fits.
FREE = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
DELETE, REROLE, INSERT, SHORT = 3, 2, 2, 1
#: Rows whose prices are held at once; of longer conversations the prices at block borders are kept and the rest found again.
BLOCK = 4096
END = None


def arcs(code: int | None, state: int) -> list[tuple[str, int, bool, int]]:
    """(letter, cost, consumes the row, next state) of the edits at a node; code None is the end of the conversation."""
    found = [("I", INSERT, False, FREE[state])]
    if code is END:
        return found
    initial, fault = code % 4, code // 4
    found.insert(0, ("D", DELETE, True, state))
    if fault in (SOUND, TRUNCATED):
        more = SHORT if fault == TRUNCATED else 0
        if (state, initial) in FOLLOWS:
            found.append(("K", more, True, FOLLOWS[state, initial]))
        found.append(("R", REROLE + more, True, FREE[state]))
    return found


@lru_cache(maxsize=65536)
def settle(code: int | None, beyond: tuple[int, ...] | None) -> tuple[int, ...]:
    """Prices of the four nodes before a row, given those after it (None: the end, where legal states cost nothing)."""
    low = min(beyond) if beyond else 0
    price, settled = [low] * 4, set()  # no arc is cheaper than nothing, so the least price beyond is a fair start
    for origin in range(4):
        path = [origin]
        while True:
            node = path[-1]
            ways = [(cost + (beyond[to] if eats else price[to]), to, eats) for _, cost, eats, to in arcs(code, node)]
            if code is END and node in ENDS:
                ways.append((0, node, True))
            best, to, eats = min(ways)
            if price[node] < best:  # contract
                price[node] = best
                if len(path) > 1:
                    path.pop()
            elif eats or to in settled:  # a node with a known way to the end
                break
            else:  # extend
                path.append(to)
        settled.add(origin)
    return tuple(price)


def _priced(code: int | None, beyond: tuple[int, ...] | None) -> tuple[int, ...]:
    """`settle` on prices less their least, which is what it depends on; so few cases come up."""
    if not beyond:
        return settle(code, beyond)
    low = min(beyond)
    return tuple([p + low for p in settle(code, tuple([p - low for p in beyond]))])


def _layers(codes: bytes, beyond: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Prices before each row of a block, and after its last."""
    found = [beyond]
    for code in reversed(codes):
        found.append(_priced(code, found[-1]))
    return found[::-1]


def cheapest(codes: bytes) -> tuple[int, str]:
    """The least cost of a conversation, and the ASCII-least letters of the edits that cost it."""
    starts = range(0, len(codes), BLOCK)
    border = [_priced(END, None)]
    for at in reversed(starts):
        border.append(_layers(codes[at : at + BLOCK], border[-1])[0])
    border.reverse()
    state, letters = NONE, []

    def walk(code, here, beyond, state):
        """Follow the least tight letters at this row until it is consumed."""
        while True:
            if code is END and here[state] == 0 and state in ENDS:
                return state
            for letter, cost, eats, to in arcs(code, state):  # in ASCII order
                if here[state] == cost + (beyond[to] if eats else here[to]):
                    letters.append(letter)
                    state = to
                    break
            if eats:
                return state

    for i, at in enumerate(starts):
        block = codes[at : at + BLOCK]
        layers = _layers(block, border[i + 1])
        for k, code in enumerate(block):
            state = walk(code, layers[k], layers[k + 1], state)
    walk(END, border[-1], None, state)
    return border[0][NONE], "".join(letters)


@lru_cache(maxsize=8192)
def _remembered(codes: bytes) -> tuple[int, str]:
    return cheapest(codes)


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


class Tally:
    """What is held of a conversation while its rows pass: a byte for each row and some numbers."""

    def __init__(self):
        self.codes, self.turns, self.first, self.last = bytearray(), 0, None, None

    def add(self, turn: int | None, code: int):
        self.codes.append(code)
        if turn is not None and (self.last is None or turn != self.last):
            self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn

    def row(self) -> tuple:
        codes = bytes(self.codes)
        cost, audit = _remembered(codes) if len(codes) <= 64 else cheapest(codes)
        faults = [c // 4 for c in codes]
        illegal = sum((a % 4, b % 4) not in LEGAL for a, b in zip(codes, codes[1:]))
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal, cost, audit


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows after the damage that crc32(`conv_id:turn`) % 20 picks; nulls are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("said", "[.!?]", "")).otherwise(F.col("said"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("who"))
    rows = rows.select("conv_id", "turn", blank("role").alias("who"), blank("text").alias("said"), kind.alias("kind"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _lines(rows: DataFrame) -> DataFrame:
    text = whole("text")
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), whole("role").alias("role"), text.alias("text"), F.sha2(text, 256).alias("digest"))


#: A conversation's rows in order; what announces it comes first. Rows equal in all of these are the same row.
ORDER = ("conv_id", "is_line", "turn", "role", "digest")


def plans(lines: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conversation with COUNTS. Only a few numbers of a row and its text's digest are shuffled."""
    initial = F.substring("role", 1, 1)
    end = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    seen = F.row_number().over(W.partitionBy("conv_id", "role", "digest").orderBy("turn"))
    facts = lines.select("conv_id", "turn", "role", "digest", initial.alias("initial"), end.alias("end"), F.lit(True).alias("is_line"))
    marks = conversations.select("conv_id", F.lit(False).alias("is_line"))
    facts = facts.unionByName(marks, allowMissingColumns=True).repartition("conv_id").withColumn("seen", seen)
    fault = F.when(F.col("end") == "", BLANK).when(F.col("seen") > 1, DUPLICATE).when(~F.col("end").isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    letter = F.coalesce(*[F.when(F.col("initial") == k, v) for k, v in INITIALS.items()], F.lit(OTHER))
    facts = facts.select(*ORDER, "seen", (letter + 4 * fault).cast("int").alias("code")).sortWithinPartitions(*ORDER, "seen")
    key = facts.schema["conv_id"]
    schema = T.StructType([key, *T._parse_datatype_string(COUNTS).fields])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tally = None, None
        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "is_line", "turn", "code")]
            for conv, is_line, turn, code in zip(*columns):
                if not is_line:
                    if tally:
                        done.append((known, *tally.row()))
                    known, tally = conv, Tally()
                else:
                    tally.add(turn, code)
            yield _batch(done, batch.schema.field("conv_id").type, schema)
        if tally:
            yield _batch([(known, *tally.row())], batch.schema.field("conv_id").type, schema)

    return facts.select("conv_id", "is_line", "turn", "code").mapInArrow(count, schema)


def _batch(rows: list[tuple], key: pa.DataType, schema: T.StructType) -> pa.RecordBatch:
    types = [key] + [pa.string() if isinstance(f.dataType, T.StringType) else pa.int64() for f in schema.fields[1:]]
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Plans and lines in order -> ("plan", batch, place) and ("row", role, text, letter) as they come about."""
    letters, at, state = "", 0, NONE

    def inserted():
        nonlocal at, state
        while at < len(letters) and letters[at] == "I":
            state, at = FREE[state], at + 1
            yield "row", ROLE[state], "", "I"

    for batch in batches:
        is_line, role, text, audit = (batch.column(c).to_pylist() for c in ("is_line", "role", "text", "audit"))
        for i in range(len(is_line)):
            yield from inserted()  # before a row, or at the end of the conversation before
            if not is_line[i]:
                letters, at, state = audit[i], 0, NONE
                yield "plan", batch, i, None
                continue
            letter, at = letters[at], at + 1
            if letter == "K":
                state = FOLLOWS[state, INITIALS[role[i][:1]]]
                yield "row", role[i], text[i], "K"
            elif letter == "R":
                state = FREE[state]
                yield "row", ROLE[state], text[i], "R"
    yield from inserted()


def _streamed(lines: DataFrame, conversations: DataFrame) -> DataFrame:
    """Each conversation's plan, then its lines in order. Texts are shuffled once, by conversation."""
    found = plans(lines, conversations).withColumn("is_line", F.lit(False))
    both = lines.withColumn("is_line", F.lit(True)).unionByName(found, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(*ORDER).drop("turn", "digest")


def report(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conversation of `conversations` (conv_id): COUNTS and repaired_sha256.

    rows: conv_id, turn, role, text; other columns are ignored, whatever their names. A conversation's rows are taken by
    turn, nulls first, then by role and the text's SHA-256; equal rows follow each other, and the later ones are
    duplicates. Null texts and roles count as empty. A null conv_id is a conversation of its own. A role that begins with
    no letter of the pattern, the empty one too, must be reroled or deleted. A conversation without rows has zeros, an
    empty audit and the hash of the empty string; empty tables give no rows. By the result's definition one hash runs
    over all of a conversation, so its rows pass through one task in order, as a stream: what is held is a byte for each
    row, its audit, and prices of one block.
    """
    key = rows.schema["conv_id"]
    schema = T.StructType([key, *T._parse_datatype_string(COUNTS + ", repaired_sha256 string").fields])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, sha, first, done, kind = None, None, True, [], None
        for what, a, b, _ in _followed(batches):
            if what == "row":
                sha.update(f"{a}:{b}".encode() if first else f"\n{a}:{b}".encode())
                first = False
                continue
            if plan:
                done.append((*plan, sha.hexdigest()))
                if len(done) >= 1000:
                    yield _batch(done, kind, schema)
                    done = []
            kind = a.schema.field("conv_id").type
            plan = tuple(a.column(c)[b].as_py() for c in schema.names[:-1])
            sha, first = hashlib.sha256(), True
        if plan:
            yield _batch([*done, (*plan, sha.hexdigest())], kind, schema)

    return _streamed(_lines(rows), conversations.select("conv_id").distinct()).mapInArrow(digest, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, place (0, 1, 2...), role, text, edit (K, R or I); deleted rows are gone. See `report`."""
    key = rows.schema["conv_id"]
    schema = T.StructType([key, *T._parse_datatype_string("place long, role string, text string, edit string").fields])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place, kind, out, size = None, 0, None, [], 0

        def flush():
            columns = list(zip(*out))
            types = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

        for what, a, b, letter in _followed(batches):
            if what == "plan":
                conv, place, kind = a.column("conv_id")[b].as_py(), 0, a.schema.field("conv_id").type
                continue
            out.append((conv, place, a, b, letter))
            place, size = place + 1, size + len(b) + 64
            if size > 4_000_000:
                yield flush()
                out, size = [], 0
        if out:
            yield flush()

    return _streamed(_lines(rows), rows.select("conv_id").distinct()).mapInArrow(emit, schema)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """`report` on the conversations after their damage, for every original conv_id."""
    return report(damage(conversations), conversations)
