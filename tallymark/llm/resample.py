"""Importance resampling towards a target distribution (operator 11), features hashed by a position-table CRC.

A CRC-32 is linear in the bytes: the checksum of a span is the XOR of what each byte contributes at its distance from
the span's end, and of a constant that depends on the length only. The contributions stand in one table, byte by
distance; all spans of a batch of texts are looked up at once and folded with `bitwise_xor.reduceat`. Spans longer than
the table are cut into blocks from their end: a block's value moves over the 2^k blocks behind it by one linear map for
each set bit of their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import global_rank
from .shared import whole, written

#: Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Distances of the table (64 KB); a longer span is folded blockwise.
REACH = 64
BUCKETS, RUN, SHARE, LEAST_WORDS, SEED = 10_000, 3, 5, 20, "42"
#: Bytes that are looked up at once, and bytes of text that are cut into words at once: bounds of space.
SLICE, PIECE = 1 << 17, 1 << 20


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


BYTE = _byte_table()


def _positions() -> np.ndarray:
    """Contribution of each byte at each distance from the end, flat: distance * 256 + byte."""
    rows = [BYTE]
    for _ in range(REACH - 1):
        rows.append((rows[-1] >> 8) ^ BYTE[rows[-1] & 0xFF])
    return np.concatenate(rows)


POSITION = _positions()


def _moved(values: np.ndarray, maps: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given as four tables of a byte each."""
    return maps[0][values & 0xFF] ^ maps[1][(values >> 8) & 0xFF] ^ maps[2][(values >> 16) & 0xFF] ^ maps[3][values >> 24]


def _maps() -> list[np.ndarray]:
    """Moving a value over 2^k zero bytes, k = 0..40."""
    shift = np.arange(256, dtype=np.uint32)
    one = np.stack([(v >> 8) ^ BYTE[v & 0xFF] for v in (shift << (8 * k) for k in range(4))])
    found = [one]
    for _ in range(40):
        found.append(np.stack([_moved(column, found[-1]) for column in found[-1]]))
    return found


MAPS = _maps()


def _over(values: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Each value moved over its own number of zero bytes."""
    values, k = values.copy(), 0
    while (left := steps >> k).any():
        which = np.flatnonzero(left & 1)
        values[which] = _moved(values[which], MAPS[k])
        k += 1
    return values


def span_checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of data[start:end] for each span; no span is empty."""
    lengths = ends - starts
    ones = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    # The constant of a length: the initial value moved over it, and the final inversion.
    sizes, kind = np.unique(lengths, return_inverse=True)
    result = (_over(ones[: len(sizes)], sizes) ^ np.uint32(0xFFFFFFFF))[kind]
    blocks = (lengths + REACH - 1) // REACH
    owner = np.repeat(np.arange(len(starts)), blocks)
    # Blocks of a span from its end backwards; the last of them, at its start, may be shorter.
    behind = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    block_end = ends[owner] - behind * REACH
    block_len = np.minimum(REACH, block_end - starts[owner])
    reach = np.cumsum(block_len)
    at = 0
    while at < len(owner):
        to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + SLICE, "right")))
        # Whole numbers of 32 bits suffice within a slice; only the place in the data may be larger.
        size, origin = block_len[at:to], int((block_end[at:to] - block_len[at:to]).min())
        first = (np.cumsum(size) - size).astype(np.int32)
        distance = np.repeat(first + (size - 1).astype(np.int32), size) - np.arange(int(size.sum()), dtype=np.int32)
        byte = data[origin:][np.repeat((block_end[at:to] - 1 - origin).astype(np.int32), size) - distance]
        value = np.bitwise_xor.reduceat(POSITION.take((distance << 8) | byte), first)
        far = np.flatnonzero(behind[at:to])
        if len(far):
            value[far] = _over(value[far], behind[at:to][far] * REACH)
        new = np.flatnonzero(np.diff(owner[at:to], prepend=-1))
        result[owner[at:to][new]] ^= np.bitwise_xor.reduceat(value, new)
        at = to
    return result


#: Bytes of a word: digits, small letters and all of a letter beyond ASCII. Large letters become small ones first.
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one after the other: words joined by one space, their starts and ends in that, each text's words."""
    raw = LOWER[raw]
    inside = IN_WORD[raw]
    border = np.zeros(len(raw) + 1, bool)
    border[offsets] = True
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    begins = np.flatnonzero(inside & (~before | border[:-1]))
    stops = np.flatnonzero(inside & (~after | border[1:])) + 1
    lengths = stops - begins
    ends = np.cumsum(lengths + 1) - 1
    joined = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    letters = raw[inside]
    joined[np.arange(len(letters)) + np.repeat(np.arange(len(lengths)), lengths)] = letters
    return joined, ends - lengths, ends, np.diff(np.searchsorted(begins, offsets))


def pieces(texts: pa.Array) -> Iterator[tuple]:
    """(`word_spans` of a piece, place of its first text, leading words that were in the piece before).

    A piece holds as many whole texts as fit in PIECE bytes. A longer text comes in pieces that end between words and
    begin with the last two words before, so that no run of words is lost at a border.
    """
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1
        if j > i:
            yield word_spans(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), i, 0
            i = j
            continue
        at, end, carry = int(offsets[i]), int(offsets[i + 1]), np.zeros(0, np.uint8)
        carried = 0
        while at < end:
            to = min(at + PIECE, end)
            while to < end and not len(gap := np.flatnonzero(~IN_WORD[LOWER[raw[to : min(end, to + PIECE)]]])):
                to = min(end, to + PIECE)
            to = to + int(gap[0]) if to < end else end
            block = np.concatenate([carry, raw[at:to]])
            found = word_spans(block, np.array([0, len(block)]))
            yield found, i, carried
            data, starts, ends, _ = found
            carried = min(RUN - 1, len(starts))
            carry = np.append(data[starts[-carried] : ends[-1]], np.uint8(32)) if carried else carry[:0]
            at = to
        i += 1


def buckets_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket of each run of 1, 2 and 3 words, and its text's place in the batch (rising within each array)."""
    for (data, starts, ends, words), place, carried in pieces(texts):
        text = place + np.repeat(np.arange(len(words)), words)
        for n in range(1, RUN + 1):
            low = max(0, carried - n + 1)
            last = low + n - 1
            first = slice(low, max(low, len(starts) - n + 1))
            same = np.flatnonzero(text[first] == text[last:])
            if len(same):
                yield (span_checksums(data, starts[first][same], ends[last:][same]) % BUCKETS).astype(np.int64), text[last:][same]


def words_of(texts: pa.Array) -> np.ndarray:
    """How many words each text of a batch has."""
    total = np.zeros(len(texts), np.int64)
    for (_, _, _, words), place, carried in pieces(texts):
        total[place : place + len(words)] += words - carried
    return total


def bucket_counts(rows: DataFrame, text: str) -> DataFrame:
    """bucket, n: how many features of all rows fall in each bucket. A task gives at most BUCKETS rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for found, _ in buckets_of(batch.column(0)):
                total += np.bincount(found, minlength=BUCKETS)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": hit, "n": total[hit]}, pa.schema([("bucket", pa.int64()), ("n", pa.int64())]))

    return rows.select(whole(text).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, text: str) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio) of each bucket: BUCKETS numbers, whatever the tables' size."""
    own, wanted = (np.zeros(BUCKETS, np.int64) for _ in range(2))
    for rows, into in ((raw, own), (target, wanted)):
        for r in bucket_counts(rows, text).collect():
            into[r["bucket"]] = r["n"]
    s_all, t_all = float(own.sum() + BUCKETS), float(wanted.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(own.tolist(), wanted.tolist())], np.int64)


def with_weight(rows: DataFrame, text: str, gain: np.ndarray) -> DataFrame:
    """The rows with a column `found`: n_words, n_features and weight of each whole text."""

    @F.arrow_udf("struct<n_words:long,n_features:long,weight:long>")
    def look(texts: pa.Array) -> pa.Array:
        features, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for found, text in buckets_of(texts):
            low, high = int(text[0]), int(text[-1]) + 1
            features[low:high] += np.bincount(text - low, minlength=high - low)
            # Sums as whole numbers: cumulated, then differences at the texts' borders (places rise).
            total = np.concatenate([[0], np.cumsum(gain[found])])
            border = np.searchsorted(text, np.arange(low, high + 1))
            weight[low:high] += total[border[1:]] - total[border[:-1]]
        return pa.StructArray.from_arrays([pa.array(words_of(texts)), pa.array(features), pa.array(weight)], ["n_words", "n_features", "weight"])

    return rows.withColumn("found", look(whole(text)))


def noise(key: str, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, fixed by the key: floor(-1000 ln(-ln((h + 0.5) / 2^32)))."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, key: str, text: str, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null where it is not drawn).

    Of the documents with `least_words` words or more, `share` of a hundred are drawn by weight plus noise: a draw without
    replacement in proportion to exp(weight / 1000). Null texts have no words and weight 0; a null key has the noise of
    an empty name and ranks before other keys of its score; repeated rows are drawn one by one; empty tables give no
    rows. Other columns are ignored, whatever their names. Every text is read twice (counts, then weights); only the
    numbers are written and ranked, by ranges of the score, so that no task sees all of them.
    """
    gain = gains(docs, target, text)
    scored = with_weight(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text", gain)
    scored = scored.select("doc_id", "found.n_words", "found.n_features", "found.weight", (F.col("found.weight") + noise("doc_id")).alias("score"))
    scored = written(scored.select("*", F.monotonically_increasing_id().alias("row")), "weights")
    long_enough = scored.where(F.col("n_words") >= least_words)
    drawn = share * long_enough.count() // 100
    ranked = global_rank(long_enough, [F.desc("score"), F.asc("doc_id"), F.asc("row")], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    out = ("doc_id", "n_features", "weight", "score", "rank")
    return ranked.select(*out).unionByName(rest.select(*out))
