"""Personal data (operator 9): format-preserving pseudonyms by a keyed Feistel permutation.

Found values are validated (check digits, ranges, calendar), turned to a number within the numbers of their format, and
permuted there by a Feistel network with keyed rounds, walking the cycle until the result is in range. Equal values get
equal pseudonyms in every document; other characters of the format stay where they are.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import whole

ROUNDS = 8
KINDS = ("email", "card", "iban", "ssn", "phone", "ip", "date")


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """The place of `value` in a keyed permutation of 0..size-1."""
    if size <= 1:
        return value
    half = ((size - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for i in range(ROUNDS):
            seen = f"{tweak}:{size}:{i}:{right}".encode()
            digest = hashlib.blake2b(seen, key=key, digest_size=max(8, half // 8 + 1)).digest()
            left, right = right, left ^ (int.from_bytes(digest, "big") & mask)
        value = left << half | right
        if value < size:
            return value


def luhn(digits: str) -> int:
    """The check digit that follows the digits."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def refill(text: str, signs: str, pattern: str = "[0-9]") -> str:
    """The text with the places that the pattern takes filled by the signs in turn."""
    left = iter(signs)
    return re.sub(pattern, lambda _: next(left), text)


class Pseudonyms:
    """A value's pseudonym by kind, or None if the value is not valid; `key` is at most 64 bytes."""

    def __init__(self, key: bytes):
        self.key = key
        self.of = lru_cache(maxsize=100_000)(self._of)

    def _of(self, kind: str, text: str) -> str | None:
        return getattr(self, kind)(text)

    def number(self, digits: str, tweak: str) -> str:
        return str(permute(int(digits), 10 ** len(digits), self.key, tweak)).zfill(len(digits))

    def mixed(self, text: str, tweak: str) -> str:
        """Each small letter, capital and digit stays one of its sort; the text as a whole is one number."""
        sorts = [next((s for s in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c in s), c) for c in text]
        value = size = 0
        size = 1
        for c, s in zip(text, sorts, strict=True):
            value, size = value * len(s) + s.index(c), size * len(s)
        value, out = permute(value, size, self.key, tweak + str([len(s) for s in sorts])), []
        for s in reversed(sorts):
            value, i = divmod(value, len(s))
            out.append(s[i])
        return "".join(reversed(out))

    def email(self, text: str) -> str | None:
        name, _, host = text.partition("@")
        # The host, too, may name a person; its last part is a register's and stays.
        host, _, top = host.rpartition(".")
        return f"{self.mixed(name, 'name')}@{self.mixed(host, 'host')}.{top}"

    def card(self, text: str) -> str | None:
        digits = re.sub("[^0-9]", "", text)
        if len(set(digits)) == 1 or luhn(digits[:-1]) != int(digits[-1]):
            return None
        body = self.number(digits[:-1], "card")
        return refill(text, body + str(luhn(body)))

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        country, check, body = plain[:2], plain[2:4], plain[4:]
        if not 15 <= len(plain) <= 34 or iban_check(country, body) != int(check):
            return None
        body = self.mixed(body, "iban" + country)
        return refill(text, f"{country}{iban_check(country, body):02d}{body}", "[A-Z0-9]")

    def ssn(self, text: str) -> str | None:
        area, group, serial = (int(x) for x in text.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        areas = [a for a in range(1, 900) if a != 666]
        value = permute((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999, self.key, "ssn")
        value, serial = divmod(value, 9999)
        area, group = divmod(value, 99)
        return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"

    def phone(self, text: str) -> str | None:
        digits = re.sub("[^0-9]", "", text)
        if not 9 <= len(digits) <= 15:
            return None
        # A country prefix stays; the first digit of what follows stays above zero where it was.
        keep = len(re.match(r"\+?([0-9]{0,3})", text)[1]) if text.startswith("+") else 0
        head, first, rest = digits[:keep], digits[keep], digits[keep + 1 :]
        if first == "0":
            return refill(text, head + first + self.number(rest, "phone0"))
        n = len(rest)
        value = permute((int(first) - 1) * 10**n + int(rest), 9 * 10**n, self.key, "phone")
        return refill(text, f"{head}{value // 10**n + 1}{value % 10**n:0{n}d}")

    def ip(self, text: str) -> str | None:
        parts = [int(x) for x in text.split(".")]
        if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
            return None
        value = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, self.key, "ip")
        return ".".join(map(str, value.to_bytes(4, "big")))

    def date(self, text: str) -> str | None:
        first, sign, middle, last = re.fullmatch(r"([0-9]+)([-/.])([0-9]+)[-/.]([0-9]+)", text).groups()
        orders = ("%Y", "%m", "%d") if len(first) == 4 else ("%d", "%m", "%Y")
        orders = ("%m", "%d", "%Y") if sign == "/" and len(first) == 2 and int(first) <= 12 else orders
        try:
            day = datetime.datetime.strptime("-".join((first, middle, last)), "-".join(orders)).date()
        except ValueError:
            return None
        start, end = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal()
        if not start <= day.toordinal() < end:
            return None
        # Of the days whose text reads the same way: with "/" a day above 12 decides the order and must stay above 12.
        for _ in range(100):
            day = datetime.date.fromordinal(start + permute(day.toordinal() - start, end - start, self.key, "date"))
            if sign != "/" or orders[0] != "%d" or day.day > 12:
                break
        return day.strftime(sign.join(orders))


# What the values look like. The first kind that takes a place has it.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\1[0-9]{4})(?![0-9-])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![A-Za-z0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
}
COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}
#: Part of every valid value but addresses of mail: figures with the signs between them, or the start of an IBAN.
NUMBERS = re.compile(r"[0-9][0-9 ()./-]{6,}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2}")


def spans_of(text: str, names: Pseudonyms) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the valid values, without overlaps, by place."""
    found: list[tuple[int, int, str, str]] = []
    refused: list[tuple[int, int]] = []  # what looks like another kind but is not valid is no telephone number either
    kinds = [k for k in COMPILED if k != "email"] if NUMBERS.search(text) else []
    for kind in (["email"] if "@" in text else []) + kinds:
        for m in COMPILED[kind].finditer(text):
            # Bare digit runs are too common to be called telephone numbers: those need a prefix or a separator.
            if kind == "phone" and not re.search(r"[+() .-]", m[0]):
                continue
            if any(m.start() < end and start < m.end() for start, end, *_ in found):
                continue
            if kind == "phone" and any(m.start() < end and start < m.end() for start, end in refused):
                continue
            name = names.of(kind, m[0])
            if name is None:
                refused.append(m.span())
            else:
                found.append((m.start(), m.end(), kind, name))
    return sorted(found)


def pseudonymised(text: str, names: Pseudonyms) -> tuple[str, list[tuple[int, int, str, str]]]:
    out, at, spans = [], 0, spans_of(text, names)
    for start, end, _, name in spans:
        out += [text[at:start], name]
        at = end
    return "".join([*out, text[at:]]), spans


RESULT = pa.struct([("text", pa.string()), *[(f"n_{k}", pa.int64()) for k in KINDS]])


def replace(rows: DataFrame, key: str, text: str, secret: bytes) -> DataFrame:
    """One row per input row: doc_id, text with pseudonyms, and how many values of each kind were replaced.

    Null and empty texts give the empty text; whole texts are read; repeated rows repeat; other columns are not read.
    Nothing is shuffled: equal values meet by the key, not by a table.
    """

    @F.arrow_udf("text string, " + ", ".join(f"n_{k} long" for k in KINDS))
    def replaced(texts: pa.Array) -> pa.Array:
        names, out = _names(secret), []
        for t in texts.to_pylist():
            new, spans = pseudonymised(t, names)
            out.append({"text": new} | {f"n_{k}": sum(s[2] == k for s in spans) for k in KINDS})
        return pa.array(out, RESULT)

    return rows.select(F.col(key).alias("doc_id"), replaced(whole(text)).alias("r")).select("doc_id", "r.*")


@lru_cache(maxsize=2)
def _names(secret: bytes) -> Pseudonyms:
    return Pseudonyms(secret)
