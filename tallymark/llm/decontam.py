"""Benchmark decontamination (operator 3): windows as long as an item, compared by weighted shingles.

A shingle of an item weighs one over the number of benchmark texts that have it, whatever block of the benchmark is in
memory; a shingle that the item does not have weighs the item's mean, so that an edit counts like any other word of it.
A window that reaches LEAST holds LEAST of the item's weight. An item is therefore looked up by its rarest shingles, as
many as leave less than that, and windows with enough weight are compared exactly: no fingerprint decides, none is missed.
A document shorter than the item is one window.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import each_text, fresh, whole, written

SHINGLE, LEAST = 5, 0.8
#: Characters of benchmark text that one pass over the documents holds in memory: the bound of what is broadcast.
PASS_CHARS = 4_000_000

WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingles(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit code of each run of `size` words."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    return _mix(out)


def _codes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def item_shingles(words: list[str]) -> tuple[int, list[int]]:
    """(words of a shingle, the item's shingles): an item of fewer words than SHINGLE is one shingle of its own length."""
    size = min(SHINGLE, len(words))
    return size, _shingles(_codes(words), size).tolist()


class Index:
    """The items of one pass: (item, text, owners), owners being (shingle, texts that have it) where that is above one.

    Without owners the items are the whole benchmark and are counted here.
    """

    def __init__(self, items: tuple[tuple, ...]):
        texts: dict[tuple[str, ...], list[int]] = {}
        for i, t, *_ in items:
            if w := words_of(t):
                texts.setdefault(tuple(w), []).append(i)
        self.codes = {w: xxhash.xxh64_intdigest(w) for ws in texts for w in ws}
        rows = [(ids, len(ws), *item_shingles(list(ws))) for ws, ids in texts.items()]
        #: By shingle length, the texts that have a shingle.
        self.owners: dict[int, Counter] = {}
        if items and len(items[0]) == 2:
            for _, _, size, row in rows:
                self.owners.setdefault(size, Counter()).update(set(row))
        else:
            for _, t, own in items:
                counts = self.owners.setdefault(min(SHINGLE, len(words_of(t))), Counter())
                counts |= Counter({x & (1 << 64) - 1: n for x, n in own})
        #: (ids, words, words of a shingle, bag, shingles sorted, their weights, weight of the whole item)
        self.items = []
        #: By shingle length and shingle, the items looked up by it.
        self.posts: dict[int, dict[int, list[int]]] = {}
        known: dict[int, set[int]] = {}
        for ids, length, size, row in rows:
            bag = Counter(row)
            weights, _ = self.weigh(bag, size)
            whole_weight = rest = sum(weights[x] * n for x, n in bag.items())
            for x in sorted(bag, key=lambda x: (-weights[x], x)):  # noqa: B023
                if rest < LEAST * whole_weight - 1e-9:
                    break
                self.posts.setdefault(size, {}).setdefault(x, []).append(len(self.items))
                rest -= weights[x] * bag[x]
            own = np.array(sorted(bag), np.uint64)
            known.setdefault(size, set()).update(bag)
            self.items.append((ids, length, size, bag, own, np.array([weights[x] for x in own.tolist()]), whole_weight))
        self.known = {size: np.sort(np.array(list(k), np.uint64)) for size, k in known.items()}

    def weigh(self, bag: Counter, size: int) -> tuple[dict[int, float], float]:
        """The weights of an item's shingles, and that of all others for this item."""
        owners = self.owners.get(size, {})
        weights = {s: 1 / max(1, owners.get(s, 1)) for s in bag}
        return weights, sum(weights[s] * n for s, n in bag.items()) / sum(bag.values())

    def similarity(self, a: Counter, b: Counter, size: int) -> float:
        """Weighted Jaccard of a window with an item, b."""
        weights, mean = self.weigh(b, size)
        total = common = 0.0
        for s in sorted(a.keys() | b.keys()):
            w = weights.get(s, mean)
            common += w * min(a[s], b[s])
            total += w * max(a[s], b[s])
        return common / total

    def matches(self, text: str) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window of each item that reaches LEAST."""
        words = words_of(text)
        get = self.codes.get
        codes = np.array([get(w, 0) for w in words], np.uint64)
        if not codes.any():
            return []
        best: dict[int, tuple[float, int, int]] = {}
        for size, known in self.known.items():
            s = _shingles(codes, size)
            if not len(s):
                continue
            # Words of no item have the code zero; a run with one of them is no item's shingle.
            places = np.flatnonzero(np.convolve(codes != 0, np.ones(size, np.int64))[size - 1 : len(codes)] == size)
            at = np.minimum(np.searchsorted(known, s[places]), len(known) - 1)
            places = places[known[at] == s[places]]
            if not len(places):
                continue
            hits, posts = s[places], self.posts[size]
            items = sorted({i for x in np.unique(hits).tolist() for i in posts.get(x, ())})
            true = _shingles(np.array([get(w) or xxhash.xxh64_intdigest(w) for w in words], np.uint64), size) if items else None
            for i in items:
                ids, length, _, bag, own, weights, whole_weight = self.items[i]
                length = min(length, len(words))
                width = length - size + 1
                at = np.minimum(np.searchsorted(own, hits), len(own) - 1)
                held = np.zeros(len(s) + 1)
                held[places + 1] = np.where(own[at] == hits, weights[at], 0.0)
                held = np.cumsum(held)
                starts = np.flatnonzero(held[width:] - held[:-width] >= LEAST * whole_weight - 1e-6)
                for start in starts.tolist():
                    score = self.similarity(Counter(true[start : start + width].tolist()), bag, size)
                    if score >= LEAST:
                        for name in ids:
                            if name not in best or (-score, start) < (-best[name][0], best[name][1]):
                                best[name] = (score, start, length)
        return [(i, *best[i]) for i in sorted(best)]


@lru_cache(maxsize=1)
def index(items: tuple[tuple, ...]) -> Index:
    return Index(items)


FOUND = "array<struct<item_id: long, similarity: double, first_word: int, n_words: int>>"
FOUND_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int32()), ("n_words", pa.int32())]))


def _shingled(texts: pa.Array) -> pa.Array:
    out = []
    for t in each_text(texts):
        words = words_of(t)
        size, row = item_shingles(words) if words else (0, [])
        name = np.uint64(xxhash.xxh64_intdigest(" ".join(words))).view(np.int64)
        out.append({"text": int(name), "size": size, "shingles": np.unique(np.array(row, np.uint64)).view(np.int64).tolist()})
    return pa.array(out, pa.struct([("text", pa.int64()), ("size", pa.int32()), ("shingles", pa.list_(pa.int64()))]))


def blocks(benchmark: DataFrame, item: str, text: str, pass_chars: int = PASS_CHARS) -> Iterator[tuple[tuple, ...]]:
    """The benchmark in blocks of about `pass_chars` characters, one at a time; texts of one id stay together.

    Each text comes with its shingles that other texts have as well, counted over the whole benchmark; texts of equal words
    are one.
    """
    rows = benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).alias("item"), F.col(text).alias("body")).distinct()
    shingled = F.arrow_udf(_shingled, "text long, size int, shingles array<long>")
    rows = written(rows.withColumn("own", shingled("body")), "items")
    each = rows.select("own.*").dropDuplicates(["text"]).select("size", F.explode("shingles").alias("s"))
    shared = each.groupBy("size", "s").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = rows.select("own.*").dropDuplicates(["text"]).select("text", "size", F.explode("shingles").alias("s")).join(shared, ["size", "s"])
    own = own.groupBy("text").agg(F.collect_list(F.struct("s", "n")).alias("shared"))
    rows = rows.select("item", "body", F.col("own.text").alias("text")).join(own, "text", "left")
    block, size = [], 0
    for r in rows.select("item", "body", "shared").orderBy("item", "body").toLocalIterator():
        if block and size + len(r[1]) > pass_chars and r[0] != block[-1][0]:
            yield tuple(block)
            block, size = [], 0
        block.append((r[0], r[1], tuple((x[0], x[1]) for x in r[2] or ())))
        size += len(r[1])
    if block:
        yield tuple(block)


def passes(benchmark: DataFrame, item: str, text: str, pass_chars: int = PASS_CHARS) -> list[tuple[tuple, ...]]:
    """All blocks at once, for benchmarks known to be small."""
    return list(blocks(benchmark, item, text, pass_chars))


def with_matches(docs: DataFrame, text: str, items: tuple[tuple, ...], column: str) -> DataFrame:
    """The rows with the items that each whole text holds, by one pass of the benchmark."""
    held = docs.sparkSession.sparkContext.broadcast(items)

    @F.arrow_udf(FOUND)
    def found(texts: pa.Array) -> pa.Array:
        look = index(held.value)
        names = ("item_id", "similarity", "first_word", "n_words")
        return pa.array([[dict(zip(names, m, strict=True)) for m in look.matches(t)] for t in each_text(texts)], FOUND_ARROW)

    return docs.withColumn(column, found(whole(text)))


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", pass_chars: int = PASS_CHARS) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: the best window of each item in each document that has it.

    Null and empty texts and items without words match nothing; repeated rows repeat; of windows as similar the first is
    given. Documents are read once for each pass of the benchmark and never shuffled. An empty table gives no rows.
    """
    out = None
    for items in blocks(benchmark, item, "text", pass_chars):
        rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
        # An outer explode: for an inner one Spark infers a filter on the array and would run the search twice.
        rows = with_matches(rows, "text", items, "found").select("doc_id", F.explode_outer("found").alias("m"))
        rows = rows.select("doc_id", "m.*").where("item_id IS NOT NULL")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = docs.select(F.col(key).alias("doc_id")).where("false").selectExpr(
            "doc_id", "0L AS item_id", "0D AS similarity", "0 AS first_word", "0 AS n_words"
        )
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", pass_chars: int = PASS_CHARS) -> DataFrame:
    """The rows that hold no item; all columns stay."""
    for items in blocks(benchmark, item, "text", pass_chars):
        found, = fresh(docs, "found")
        docs = with_matches(docs, text, items, found).where(F.size(found) == 0).drop(found)
    return docs
