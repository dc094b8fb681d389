"""Quality by Bradley-Terry ranking (operator 13).

A document's strength is a linear form of measures of its whole text. That one document is preferred to another has the
probability that the logistic function gives the difference of their strengths; the weights are learned from preference
pairs of labelled rows, by logistic loss on the differences of their measures. The cut between good and bad is the
quantile of the strengths at the share of bad rows, and the score is moved so that the cut lies at `Settings.cut`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import global_rank
from .shared import each_text, whole, written

MEASURES = (
    "length", "word_length", "capital_words", "signs", "bars", "shouts", "marked_words", "digits", "stops", "line_length",
    "repeated_pairs", "repeated_lines", "commonest", "distinct", "single_letters", "odd_signs", "marked_run", "capital_run",
)
WORD = re.compile(r"[^\W\d_]+")
#: A word with two signs or more at its end that close no sentence.
MARKED = re.compile(r"\w[.,;:]?([^\w\s.,;:'\")\]-])\1+(?=\s|$)")
SIGN = re.compile(r"[^\w\s]")
ODD = re.compile(r"[#$%&*+<=>@\\^`{|}~]")
STOP = re.compile(r"[.!?](?=\s|$)")
#: Words of a stretch in which the densest marks and capitals are looked for.
STRETCH = 64


def measures(text: str) -> list[float]:
    """The measures of a whole text, in one pass each; an empty text has none of anything."""
    words, tokens = WORD.findall(text), text.split()
    n, m = max(1, len(words)), max(1, len(tokens))
    low = [w.lower() for w in words]
    capital = [len(w) > 1 and w.isupper() for w in words]
    pairs = len(set(zip(low, low[1:])))
    lines = [s for line in text.split("\n") if (s := line.strip())]
    twice = sum(len(line) * (k - 1) for line, k in Counter(lines).items())
    counts = Counter(low)
    marked = [bool(MARKED.search(t)) for t in tokens] if MARKED.search(text) else []
    part = lambda x: math.log1p(100 * x)
    return [
        math.log1p(len(tokens)),
        sum(map(len, words)) / n,
        part(sum(capital) / n),
        part(len(SIGN.findall(text)) / m),
        part(text.count("|") / m),
        part(text.count("!") / m),
        part(sum(marked) / m),
        part(sum(map(str.isdigit, text)) / max(1, len(text))),
        part(len(STOP.findall(text)) / m),
        math.log1p(m / max(1, len(lines))),
        part(1 - pairs / max(1, len(low) - 1)) if len(low) > 1 else 0.0,
        part(twice / max(1, len(text))),
        part(max(counts.values(), default=0) / n),
        part(len(counts) / n),
        part(sum(len(w) == 1 for w in words) / n),
        part(len(ODD.findall(text)) / m),
        part(_densest(marked)),
        part(_densest(capital)),
    ]


def _densest(flags: list[bool]) -> float:
    """The greatest share of set flags in a stretch."""
    if not any(flags):
        return 0.0
    total = np.concatenate([[0], np.cumsum(flags)])
    width = min(STRETCH, len(flags))
    return float((total[width:] - total[:-width]).max() / width)


@dataclass(frozen=True)
class Settings:
    """`pairs`: at least so many preference pairs, if there are as many; more where a kind has more rows, so that none is
    left out. `cut`: score of the quantile."""

    pairs: int = 60_000
    ridge: float = 1e-3
    cut: float = 0.3


@dataclass(frozen=True)
class Model:
    """Strength = weights * (measures - middle) / spread; `bar` is the strength of the quantile."""

    weights: tuple[float, ...] = (0.0,) * len(MEASURES)
    middle: tuple[float, ...] = (0.0,) * len(MEASURES)
    spread: tuple[float, ...] = (1.0,) * len(MEASURES)
    bar: float = 0.0
    cut: float = 0.3

    def strengths(self, points: np.ndarray) -> np.ndarray:
        return ((points - np.array(self.middle)) / np.array(self.spread)) @ np.array(self.weights)

    def scores(self, points: np.ndarray) -> np.ndarray:
        x = self.strengths(points) - self.bar + math.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def bradley_terry(points: np.ndarray, good: np.ndarray, settings: Settings) -> np.ndarray:
    """Weights from pairs of a good and a bad row: each row of either kind is in as many pairs as its fellows.

    Newton steps on the mean of log(1 + exp(-w (x_good - x_bad))), with a ridge; the pairs are dealt in rounds, each
    shifting the bad rows against the good ones by one more, so that no pair comes twice.
    """
    up, down = points[good], points[~good]
    n = pair_count(len(up), len(down), settings)
    i = np.arange(n)
    most = max(len(up), len(down), 1)
    turn = i // most
    many, few = i % most, (i + turn) % max(1, min(len(up), len(down)))
    gap = (up[many] - down[few] if len(up) == most else up[few] - down[many]) if n else points[:0]
    return newton(lambda weights: pulls(gap, weights), n, points.shape[1], settings)


def pair_count(good: int, bad: int, settings: Settings) -> int:
    return min(max(settings.pairs, good, bad), good * bad)


def pulls(gap: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over pairs of the slope and of the bend of the loss."""
    lost = 1 / (1 + np.exp(np.clip(gap @ weights, -30, 30)))
    return gap.T @ lost, (gap * (lost * (1 - lost))[:, None]).T @ gap


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], n: int, width: int, settings: Settings) -> np.ndarray:
    """The weights at which the slope of the mean loss over `n` pairs is 0; without a pair all are 0."""
    weights = np.zeros(width)
    for _ in range(60 if n else 0):
        slope, bend = sums(weights)
        step = np.linalg.solve(bend / n + settings.ridge * np.eye(width), slope / n - settings.ridge * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def dealt_pairs(rows: DataFrame, good: int, bad: int, settings: Settings) -> DataFrame:
    """`gap` of every pair of `bradley_terry`, dealt by joins on places: rows are (k, good, x), in the order of a hash of k."""
    n, most, fewest = pair_count(good, bad, settings), max(good, bad), min(good, bad)
    order = [F.xxhash64("k"), F.asc("k")]
    side = lambda kind: global_rank(rows.where(F.col("good") == kind), order, "place").select((F.col("place") - 1).alias("at"), "x")
    many, few = side(good == most), side(good != most)
    turns = F.explode(F.sequence(F.lit(0), F.lit((n - 1) // most)))
    many = many.select("at", "x", turns.alias("turn")).where(F.col("turn") * most + F.col("at") < n)
    met = many.withColumn("at", (F.col("turn") * most + F.col("at") + F.col("turn")) % fewest).join(few.toDF("at", "y"), "at")
    sign = 1.0 if good == most else -1.0
    return met.select(F.zip_with("x", "y", lambda a, b: (a - b) * sign).alias("gap"))


def fitted(gaps: DataFrame, n: int, settings: Settings) -> np.ndarray:
    """Newton steps over written pairs: each task sums its own, and one number for each sum reaches the driver."""
    width = len(MEASURES)

    def sums(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width + width * width)
            for batch in batches:
                gap = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                slope, bend = pulls(gap, weights)
                total += np.concatenate([slope, bend.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "value"])

        rows = gaps.mapInArrow(part, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        total = np.zeros(width + width * width)
        for r in rows:
            total[r["at"]] = r["value"]
        return total[:width], total[width:].reshape(width, width)

    return newton(sums, n, width, settings)


def quantile(rows: DataFrame, count: int, share: float) -> float:
    """The quantile of `strength` over all rows, between its two neighbours by rank."""
    at = share * (count - 1)
    low = math.floor(at)
    near = global_rank(rows, [F.asc("strength"), F.asc("k")], "place").where(F.col("place").isin(low + 1, low + 2))
    values = sorted(r["strength"] for r in near.select("strength").collect())
    return values[0] + (values[-1] - values[0]) * (at - low)


def measured(texts: pa.Array) -> pa.Array:
    return pa.array([measures(t) for t in each_text(texts)], pa.list_(pa.float64()))


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def fit(points: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from all labelled rows that are not held out; `points` are (k, x), the measures of every document.

    Of several labels of a key the smallest counts, of several texts the one with the least measures; null labels and
    keys count for nothing. With labels of one kind only, or none, all weights are 0 and every text has the score of the cut.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").alias("k")).agg((F.min("quality") > 0).alias("good"))
    rows = written(points.join(known, "k").groupBy("k", "good").agg(F.min("x").alias("x")), "preferences")
    width = range(len(MEASURES))
    at = lambda i: F.get("x", F.lit(i))
    totals = rows.agg(F.count("*"), F.count_if("good"), *[F.avg(at(i)) for i in width], *[F.stddev_pop(at(i)) for i in width]).head()
    count, good = totals[0], totals[1]
    if not count:
        return Model(cut=settings.cut)
    middle, spread = np.array(totals[2:2 + len(width)]), np.array(totals[2 + len(width):])
    spread[spread < 1e-9] = 1.0
    model = Model(middle=tuple(middle.tolist()), spread=tuple(spread.tolist()), cut=settings.cut)
    if not 0 < good < count:
        return model
    plain = F.array(*[(at(i) - float(middle[i])) / float(spread[i]) for i in width])
    gaps = written(dealt_pairs(rows.select("k", "good", plain.alias("x")), good, count - good, settings), "gaps")
    model = replace(model, weights=tuple(fitted(gaps, pair_count(good, count - good, settings), settings).tolist()))
    strengths = rows.select("k", _rowwise(model.strengths)("x").alias("strength"))
    return replace(model, bar=quantile(strengths, count, (count - good) / count))


def _rowwise(of):
    """A column of numbers from a column of measures."""

    @F.arrow_udf("double")
    def numbers(x: pa.Array) -> pa.Array:
        return pa.array(of(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(MEASURES))))

    return numbers


def score_all(docs: DataFrame, labels: DataFrame, key: str, text: str, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Texts are measured once, for the fit and the scores.

    Null texts count as empty; repeated rows repeat; a null key is not held out; other columns are ignored, whatever
    their names; an empty table gives no rows.
    """
    measure = F.arrow_udf(measured, "array<double>")
    points = written(docs.select(F.col(key).alias("k"), measure(whole(text)).alias("x")), "measures")
    model = fit(points, labels, settings)
    scored = points.select(F.col("k").alias("doc_id"), _rowwise(model.scores)("x").alias("score"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= settings.cut).cast("int").alias("predicted"))
