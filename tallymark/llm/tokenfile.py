"""Token ids as files of 64-bit words (operator 4): Simple-8b with escapes and block offsets.

A word holds a selector in its top four bits and, in the other sixty, as many ids as the selector's width allows. A
value above sixty bits is an escape: its word holds a place in the block's list of whole 64-bit values. Blocks of
BLOCK ids start at a word of their own, whose offset is kept, so that any block can be decoded alone and all words of
one selector are decoded by one array operation.

A shard is the image of one file: magic, counts, then the arrays of its documents' keys, id counts, word counts and
escape counts, the block offsets, the words and the escapes, all little-endian. Shards are the rows of a table in the
shared folder, whose commit survives lost executors; each is at most about SHARD_IDS ids and one document long.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_letters
from .shared import shared_path, whole

#: (ids in a word, bits of each) by selector; selector 15 marks an escape.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
BLOCK, PACK_IDS, SHARD_IDS, MAGIC = 4096, 400_000, 2_000_000, 0x3142_3853
COUNTS = np.array([*(c for c, _ in SELECTORS), 0, 1], np.int64)


def _bits(ids: np.ndarray) -> np.ndarray:
    """How many bits each id needs (1 for zero)."""
    high, low = (ids >> np.uint64(32)).astype(np.float64), (ids & np.uint64(0xFFFF_FFFF)).astype(np.float64)
    return np.maximum(np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]), 1).astype(np.uint8)


def pack_all(docs: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words, word offset of each block, escapes) of each list of ids; lists and blocks start at a word of their own.

    All lists are laid out with a barrier after each block. The most ids that fit in a word from a place on come from
    running maxima of the needed bits, selector by selector; then one walk picks the places where words start.
    """
    cuts = [(d, i, min(i + BLOCK, len(ids))) for d, ids in enumerate(docs) for i in range(0, len(ids), BLOCK)]
    if not cuts:
        return [(np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.uint64)) for _ in docs]
    barrier = np.zeros(1, np.uint64)
    ids = np.concatenate([x for d, i, j in cuts for x in (docs[d][i:j].astype(np.uint64), barrier)])
    walls = np.cumsum([j - i + 1 for _, i, j in cuts]) - 1
    bits = _bits(ids)
    escaped = bits > 60
    bits[walls] = 255
    n = len(ids)
    take, chosen = np.ones(n, np.int64), np.full(n, len(SELECTORS) - 1, np.uint64)
    chosen[escaped] = ESCAPE
    most, width = bits, 1  # `most`: the running maximum over `width` places
    for s in range(len(SELECTORS) - 2, -1, -1):  # few ids in a word first: the last selector that fits takes most
        count, size = SELECTORS[s]
        while width < count and len(most) > 0:
            step = min(width, count - width)
            most, width = np.maximum(most[:-step], most[step:]), width + step
        fits = np.flatnonzero(most <= size)
        take[fits], chosen[fits] = count, s
    jumps, starts, i = take.tolist(), [], 0
    while i < n:
        starts.append(i)
        i += jumps[i]
    starts = np.array(starts)
    picked = chosen[starts]
    words = picked << np.uint64(60)
    wall = bits[starts] == 255
    escapes = np.flatnonzero((picked == ESCAPE) & ~wall)
    for s in np.unique(picked):
        if s != ESCAPE:
            count, size = SELECTORS[int(s)]
            rows = np.flatnonzero((picked == s) & ~wall)
            for k in range(count):
                words[rows] |= ids[starts[rows] + k] << np.uint64(k * size)
    block = np.searchsorted(walls, starts)  # of each word
    doc_of_block = np.array([d for d, _, _ in cuts])
    escape_docs = doc_of_block[block[escapes]]
    first_escape = np.searchsorted(escape_docs, escape_docs)
    words[escapes] |= (np.arange(len(escapes)) - first_escape).astype(np.uint64)
    values = ids[starts[escapes]]
    words, block = words[~wall], block[~wall]
    block_starts = np.searchsorted(block, np.arange(len(cuts) + 1))
    edges = np.searchsorted(doc_of_block, np.arange(len(docs) + 1))
    escape_edges = np.searchsorted(escape_docs, np.arange(len(docs) + 1))
    out = []
    for d in range(len(docs)):
        offsets = block_starts[edges[d] : edges[d + 1]]
        first, last = block_starts[edges[d]], block_starts[edges[d + 1]]
        out.append((words[first:last], (offsets - first).astype(np.uint32), values[escape_edges[d] : escape_edges[d + 1]]))
    return out


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of words from any block's start to any block's end; `escapes` are those that the words name."""
    chosen = (words >> np.uint64(60)).astype(np.uint8)
    counts = COUNTS[chosen]
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        starts = ends[rows] - counts[rows]
        payload = words[rows] & np.uint64((1 << 60) - 1)
        if s == ESCAPE:
            out[starts] = escapes[payload.astype(np.int64)]
            continue
        count, bits = SELECTORS[s]
        mask = np.uint64((1 << bits) - 1)
        for k in range(count):
            out[starts + k] = payload >> np.uint64(k * bits) & mask
    return out


# --------------------------------------------------------------------------------------------------------- encoding


# Fixed value: how the byte vocabulary's texts are cut into pre-tokens.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", regex.V0)


def ids_as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """The tokenizers library, asked once for each pre-token.

    Its pre-tokens never reach from a visible character over a following space, so that a text may be cut before each
    space that follows a visible character; stretches and pre-tokens that come again are remembered, within a bound.
    Texts with other white space than spaces and line ends, with such a run, or with "<|" go to the library whole.
    """

    ODD = re.compile(r"<\||[^\S \n]| {2}|\n | $")
    #: Stretches and pre-tokens in a generation of the memory; the generation before is kept too.
    STRETCHES, WORDS = 250_000, 350_000

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.stretches: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_stretches: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        if (ids := self.old_words.get(word)) is not None:
            self.words[word] = ids
            return ids
        if word.isascii() and word.isprintable():
            spelled = word.replace(" ", self.letters[32])
        else:
            spelled = "".join(map(self.letters.__getitem__, word.encode()))
        ids = ids_as_bytes([t.id for t in self.model.tokenize(spelled)])
        if len(word) <= 64:
            if len(self.words) >= self.WORDS:
                self.old_words, self.words = self.words, {}
            self.words[word] = ids
        return ids

    def stretch(self, part: str) -> bytes:
        """The ids of a stretch with a space before it."""
        if (ids := self.old_stretches.get(part)) is not None:
            self.stretches[part] = ids
            return ids
        words = self.words
        ids = b"".join([words.get(w) or self.word(w) for w in PRE_TOKENS.findall(" " + part)])
        if len(part) <= 64:
            if len(self.stretches) >= self.STRETCHES:
                self.old_stretches, self.stretches = self.stretches, {}
            self.stretches[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.ODD.search(text):
            return ids_as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        parts = text.split(" ")
        found = list(map(self.stretches.get, parts))
        found[0] = b"".join([self.words.get(w) or self.word(w) for w in PRE_TOKENS.findall(parts[0])])
        if None in found:
            found = [self.stretch(p) if f is None else f for f, p in zip(found, parts, strict=True)]
        return b"".join(found)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


PACKED = "n_ids long, bucket int, words binary, blocks binary, escapes binary"
PACKED_ARROW = pa.struct([("n_ids", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()), ("blocks", pa.binary()), ("escapes", pa.binary())])


def packed_texts(rows: DataFrame, key: str, text: str, vocabulary: str, end_id: int | None, bounds: list[int]) -> DataFrame:
    """doc_id with the packed ids of its text and the number of its key range."""
    borders = np.array(bounds, np.int64)

    @F.arrow_udf(PACKED)
    def coded(keys: pa.Array, texts: pa.Array) -> pa.Array:
        ask, out = encoder(vocabulary), []
        ranges = np.searchsorted(borders, keys.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), side="left")
        end, held, size = b"" if end_id is None else np.array([end_id], "<u4").tobytes(), [], 0

        def packed():
            for ids, (words, blocks, escapes) in zip(held, pack_all(held), strict=True):
                out.append((len(ids), words.tobytes(), blocks.tobytes(), escapes.tobytes()))
            held.clear()

        for t in texts.to_pylist():
            held.append(np.frombuffer(ask.encode(t) + end, "<u4"))
            size += len(held[-1])
            if size > PACK_IDS:
                packed()
                size = 0
        packed()
        sizes, *parts = zip(*out, strict=True) if out else ((),) * 4
        arrays = [pa.array(sizes, pa.int64()), pa.array(ranges, pa.int32()), *[pa.array(p, pa.binary()) for p in parts]]
        return pa.StructArray.from_arrays(arrays, fields=list(PACKED_ARROW))

    doc_id = F.col(key).cast("long")
    return rows.select(doc_id.alias("doc_id"), coded(doc_id, whole(text)).alias("p")).select("doc_id", "p.*")


# ------------------------------------------------------------------------------------------------------------ shards

#: `inner`: ids of the range before the shard.
SHARDS = "bucket int, place int, inner long, n_ids long, n_docs long, image binary"
SHARDS_ARROW = pa.schema([("bucket", pa.int32()), ("place", pa.int32()), ("inner", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("image", pa.binary())])


def shard_image(docs: list[dict]) -> bytes:
    """The bytes of a file: documents in the order given, each a dict of doc_id, n_ids, words, blocks, escapes."""
    head = np.array([MAGIC, len(docs)], "<u8").tobytes()
    keys = np.array([d["doc_id"] or 0 for d in docs], "<i8").tobytes()
    known = np.array([d["doc_id"] is not None for d in docs], "<i8").tobytes()
    sizes = [np.array([f(d) for d in docs], "<i8").tobytes() for f in (lambda d: d["n_ids"], lambda d: len(d["words"]) // 8, lambda d: len(d["blocks"]) // 4, lambda d: len(d["escapes"]) // 8)]
    return b"".join([head, keys, known, *sizes, *[d[k] for k in ("words", "escapes", "blocks") for d in docs]])


def read_image(image: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of a file, in its order."""
    magic, n = (int(x) for x in np.frombuffer(image, "<u8", 2))
    if magic != MAGIC:
        raise ValueError("not a file of packed token ids")
    fields = np.frombuffer(image, "<i8", 6 * n, 16).reshape(6, n)
    keys, known, n_ids, n_words, _, n_escapes = fields
    start = 16 + 48 * n
    words = np.frombuffer(image, "<u8", int(n_words.sum()), start)
    escapes = np.frombuffer(image, "<u8", int(n_escapes.sum()), start + 8 * len(words))
    # All words at once: an escape names a place among its document's own, moved here to its place among all.
    moved = np.repeat(np.cumsum(n_escapes) - n_escapes, n_words).astype(np.uint64)
    ids = unpack(words + np.where(words >> np.uint64(60) == ESCAPE, moved, np.uint64(0)), escapes)
    if len(ids) != n_ids.sum():
        raise ValueError("the file is damaged")
    ends = np.cumsum(n_ids)
    for i in range(n):
        yield (int(keys[i]) if known[i] else None), ids[ends[i] - n_ids[i] : ends[i]]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and key -> shards that end with a bucket or when they are full."""
    held, bucket, place, n, inner = [], None, 0, 0, 0

    def out():
        image = shard_image(held)
        return pa.RecordBatch.from_pylist([{"bucket": bucket, "place": place, "inner": inner, "n_ids": n, "n_docs": len(held), "image": image}], SHARDS_ARROW)

    for batch in batches:
        for doc in batch.to_pylist():
            if held and (doc["bucket"] != bucket or n >= SHARD_IDS):
                yield out()
                place, inner = (place + 1, inner + n) if doc["bucket"] == bucket else (0, 0)
                held, n = [], 0
            bucket = doc["bucket"]
            held.append(doc)
            n += doc["n_ids"]
    if held:
        yield out()


def write(rows: DataFrame, key: str, text: str, vocabulary: str, path: str, end_id: int | None = None) -> None:
    """Encode every whole text and write the ids in ascending key order as shards under `path`.

    Keys are cut into ranges of about as many rows by approximate quantiles (a bounded sketch), so that texts are read
    once, only packed ids are shuffled, and ranges sort and write on their own. Null texts count as empty, null keys come
    first, equal keys stand together in the order of their packed words.
    """
    ranges = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / ranges for i in range(1, ranges)]
    found = rows.agg(F.percentile_approx(F.col(key).cast("long"), F.array(*map(F.lit, cuts)), F.lit(20 * ranges)).alias("q")).first()
    bounds = sorted(set(found["q"] or []))
    packed = packed_texts(rows, key, text, vocabulary, end_id, bounds)
    ordered = packed.repartition(ranges, "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), "words")
    ordered.mapInArrow(_shards, SHARDS).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """One row per document of the files under `path`: doc_id, start, n_tokens, ids_crc32.

    The ids before a shard are those of the ranges before its own and the count that it carries itself. The sums per
    range are as many rows as `write` made ranges, so that their broadcast is bounded; images are never shuffled.
    """
    shards = spark.read.schema(SHARDS).parquet(path)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = shards.groupBy("bucket").agg(F.sum("n_ids").alias("n"))
    ranges = ranges.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = shards.join(F.broadcast(ranges), "bucket").select((F.col("base") + F.col("inner")).alias("first"), "image")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start, out = row["first"], []
                for doc_id, ids in read_image(row["image"]):
                    out.append({"doc_id": doc_id, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())})
                    start += len(ids)
                yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    return placed.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(rows: DataFrame, key: str, text: str, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Write the ids of all texts to files in the shared folder and describe the documents from the files."""
    path = shared_path(rows.sparkSession, "token-files")
    write(rows, key, text, vocabulary, path, end_id)
    return read(rows.sparkSession, path)
