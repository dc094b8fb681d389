"""Toxicity by a weighted lexicon (operator 1), matched by Aho-Corasick over folded text.

Folding undoes disguises: compatibility forms, look-alike letters of other scripts, invisible characters, and digits or
signs in place of letters. The lexicon is learned from labelled rows: whole words, beginnings and endings of words that
toxic rows have far more often, weighted by their log odds. Phrases around a term that only harmless rows have are
exceptions and take the term's weight back. The weights' sum, and the same for the length, give the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import each_text, fresh, whole, written

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i", "ʟ": "l", "ո": "n", "օ": "o",
}
# Digits, and signs before a letter, that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i"}

FOREIGN = re.compile("[ɐ-֏]")
HIDDEN = re.compile("[­​-‏⁠﻿]")
SIGN = re.compile(r"[@$!](?=[^\W_])")
#: One character for each code below 256: digits folded, other signs blank.
PLAIN = "".join(DIGITS.get(c := chr(i), c if c.isalnum() else " ") for i in range(256))
LOOKALIKE_TABLE = str.maketrans(LOOKALIKES)


def fold(text: str) -> str:
    """Words of folded letters with one space between, before and after."""
    if not text.isascii():
        text = HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    text = text.lower()
    if FOREIGN.search(text):
        text = text.translate(LOOKALIKE_TABLE)
    if "@" in text or "$" in text or "!" in text:
        text = SIGN.sub(lambda m: SIGNS[m[0]], text)
    return f" {' '.join(text.translate(PLAIN).split())} "


#: Parts of words that may become terms have these many letters.
SHORTEST, LONGEST = 4, 8


def word_parts(word: str) -> list[str]:
    """A word, its beginnings and its endings, with the spaces that bound them."""
    sizes = range(SHORTEST, min(LONGEST, len(word) - 1) + 1)
    return [f" {word} ", *[f" {word[:n]}" for n in sizes], *[f"{word[-n:]} " for n in sizes]]


@dataclass(frozen=True)
class Settings:
    """Bounds of the fit. `rows`: labelled training rows it is fitted on; `candidates` and `terms`: size of the lexicon."""

    rows: int = 12_000
    candidates: int = 100_000
    terms: int = 2_000
    least_share: float = 0.01  # of the toxic rows that a term must be in
    least_rows: int = 5
    least_odds: float = 2.5
    ridge: float = 1e-3


@dataclass
class Model:
    """Terms with weights, exception phrases with what they take back, and the score's three coefficients."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, float, float] = (-6.0, 0.0, 0.0)
    automaton: object = None

    def __getstate__(self):
        return self.terms, self.exceptions, self.coefficients

    def __setstate__(self, state):
        self.terms, self.exceptions, self.coefficients = state
        self.automaton = None

    def weight(self, folded: str) -> float:
        """The summed weights of all terms in a folded text, less the exceptions."""
        if not self.terms:
            return 0.0
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for term, weight in {**self.terms, **self.exceptions}.items():
                self.automaton.add_word(term, weight)
            self.automaton.make_automaton()
        return max(0.0, sum([w for _, w in self.automaton.iter(folded)]))

    def features(self, text: str) -> tuple[float, float]:
        folded = fold(text)
        weight = self.weight(folded)
        return math.log1p(weight), math.log1p(100 * weight / max(1, folded.count(" ") - 1))

    def score(self, text: str) -> float:
        a, b, c = self.coefficients
        x, y = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def _counts(rows: DataFrame, found, schema: str = "part string, rows long") -> DataFrame:
    """In how many rows each part is: `found(folded)` gives a row's parts; summed in each task, then over tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for batch in batches:
            for text in each_text(batch.column(0)):
                total.update(found(text))
        yield pa.RecordBatch.from_pydict({"part": list(total), "rows": list(total.values())}, pa.schema([("part", pa.string()), ("rows", pa.int64())]))

    return rows.select("folded").mapInArrow(count, schema).groupBy("part").agg(F.sum("rows").alias("rows"))


def held_out(key: str) -> Column:
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def _fold_batch(texts: pa.Array) -> pa.Array:
    return pa.array([fold(t) for t in each_text(texts)], pa.string())


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, settings: Settings = Settings()) -> Model:
    """Learn from labelled rows that are not held out.

    Labels are taken from a bounded sample of documents chosen by a hash of the key, at most about `settings.rows`; of
    several labels of a key the largest counts, null labels and keys count for nothing. What reaches the driver is
    bounded by the settings. Without a toxic row among them the model has no terms and scores every text near zero.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, settings.rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    chosen = chosen.select(F.col("doc_id").alias("label_key"), "toxic")
    fold_all = F.arrow_udf(_fold_batch, "string")
    # The sample is bounded by `rows`, and so is its broadcast.
    sample = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), F.col("k") == F.col("label_key"))
    sample = written(sample.select("toxic", fold_all(whole("t")).alias("folded")), "labelled")
    toxic, clean = sample.where("toxic = 1"), sample.where("toxic <> 1")
    n_toxic, n_clean = toxic.count(), clean.count()
    if not n_toxic:
        return Model()

    least = max(settings.least_rows, int(settings.least_share * n_toxic))
    parts = _counts(toxic, lambda t: {p for w in {*t.split()} for p in word_parts(w)}).where(F.col("rows") >= least)
    in_toxic = {r["part"]: r["rows"] for r in parts.orderBy(F.desc("rows"), "part").limit(settings.candidates).collect()}
    held = frozenset(in_toxic)
    in_clean = {r["part"]: r["rows"] for r in _counts(clean, lambda t: {p for w in {*t.split()} for p in word_parts(w) if p in held}).collect()}

    def odds(t: int, n: int) -> float:
        return math.log((t + 0.5) / (n_toxic + 1)) - math.log((n + 0.5) / (n_clean + 1))

    weights = {p: w for p, t in in_toxic.items() if (w := odds(t, in_clean.get(p, 0))) >= settings.least_odds}
    terms: dict[str, float] = {}
    # Shorter terms first: a longer one is of use only if it is much surer than those within it.
    for part in sorted(weights, key=lambda p: (len(p), p))[: 50 * settings.terms]:
        inner = [weights[q] for n in range(SHORTEST, len(part)) for i in range(len(part) - n + 1) if (q := part[i : i + n]) in terms]
        if not inner or weights[part] > max(inner) + 1:
            terms[part] = weights[part]
    terms = dict(sorted(terms.items(), key=lambda x: (-x[1] * in_toxic[x[0]], x[0]))[: settings.terms])
    model = Model(terms)
    doubtful = [p for p in terms if in_clean.get(p)]
    if doubtful:
        finder = ahocorasick.Automaton()
        for p in doubtful:
            finder.add_word(p, p)
        finder.make_automaton()
        near = lambda t: phrases(t, finder)
        often = {r["part"] for r in _counts(clean, near).where("rows >= 3").orderBy(F.desc("rows"), "part").limit(settings.terms).collect()}
        never = often - {r["part"] for r in _counts(toxic, lambda t: near(t) & often).collect()}
        model.exceptions = {p: -model.weight(p) for p in sorted(never)}
        model.automaton = None
    shipped = Model(model.terms, model.exceptions)

    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        return pa.array([list(shipped.features(t)) for t in each_text(texts)], pa.list_(pa.float64()))

    points = np.array([[1.0, *r["x"], r["toxic"] == 1] for r in sample.select("toxic", features("folded").alias("x")).collect()])
    model.coefficients = logistic(points[:, :3], points[:, 3], settings.ridge)
    return model


def phrases(folded: str, finder) -> set[str]:
    """Each word with a doubtful term, with the word before it and with the word after it."""
    words, found = folded.split(), set()
    for i, word in enumerate(words):
        if next(finder.iter(f" {word} "), None):
            found |= {f" {' '.join(words[j : j + 2])} " for j in (i - 1, i) if 0 <= j < len(words) - 1}
    return found


def logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> tuple[float, float, float]:
    """Weighted least squares until it stands still."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (y - p) - ridge * len(y) * beta * np.array([0, 1, 1])
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, ridge * len(y), ridge * len(y)])
        step = np.linalg.solve(bend, slope)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(beta.tolist())


def with_score(docs: DataFrame, text: str, model: Model, column: str) -> DataFrame:
    """The rows with the score of each whole text; null counts as empty; the model is bounded by its settings."""

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t) for t in each_text(texts)], pa.float64())

    return docs.withColumn(column, scores(whole(text)))


def score_all(docs: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Repeated rows repeat; an empty table gives none."""
    model = fit(docs, labels, key, text)
    scored = with_score(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text", model, "score")
    out = F.coalesce(held_out("doc_id"), F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """The rows with a score below one half; all columns stay, whatever their names."""
    score, = fresh(docs, "score")
    return with_score(docs, text, fit(docs, labels, key, text), score).where(F.col(score) < 0.5).drop(score)
