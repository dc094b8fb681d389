"""BPE by dynamic programming over prefixes (operator 7).

For every prefix of a pre-token the last token of its encoding is unique. An automaton over the vocabulary reports the
tokens that end at each position; a token is the prefix's last one if the prefix before it ends in a token with which it
can stand: no merge across their border would have come first. Following the stored last tokens back from the end gives
the exact ids, without replaying merges.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import each_text, whole

END = "</w>"
#: Stretches and words in a generation of a worker's memory, beside the one before: a bound of space, not of the work.
STRETCHES, WORDS = 110_000, 160_000
#: Tested pairs of tokens that are remembered.
FITS = 250_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or one above 255 in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Bpe:
    """A vocabulary file of the tokenizers library with byte letters, merges and (maybe) a suffix for word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.letters = byte_letters()
        self.table = {b: c for b, c in self.letters.items()}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        # A merge: pair of ids -> (rank, id made). A made token's parts: id -> pair, with the rank at which it is made.
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            made = self.vocab[a + b]
            pair = (self.vocab[a], self.vocab[b])
            self.merges[pair] = (rank, made)
            if made not in self.parts:
                self.parts[made], self.rank[made] = pair, rank
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for token, i in self.vocab.items():
            if i in self.rank or len(self._symbols(token)) == 1:
                symbols = self._symbols(token)
                self.automaton.add_word(symbols, (len(symbols), i))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.words: dict[str, tuple] = {}
        self.stretches: dict[str, tuple] = {}
        self.old_words: dict[str, tuple] = {}
        self.old_stretches: dict[str, tuple] = {}

    def _symbols(self, token: str) -> str:
        """A token as symbols, one for each byte; the byte with the word's end is a symbol of its own."""
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + 0x1000)
        return token

    def compatible(self, left: int, right: int) -> bool:
        """Whether `left right` is what encoding their joint text gives.

        The two are taken apart at their border in the reverse order of merging. As long as the tokens then at the
        border exist together, a merge of the two that ranks before what has been taken apart would have come first.
        """
        if len(self.fits) > FITS:
            self.fits.clear()
        a, b, bound, good = left, right, float("inf"), True
        while True:
            merge = self.merges.get((a, b))
            if merge and merge[0] < bound:
                good = False
                break
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                break
            # Of merges with one rank the leftmost is made first: a merge across the border comes before that of the
            # right token, but after that of the left one.
            if ra > rb:
                bound, a = ra, self.parts[a][1]
            else:
                bound, b = rb + 1, self.parts[b][0]
        self.fits[left << 20 | right] = good
        return good

    def encode_word(self, word: str) -> list[int]:
        """The ids of one pre-token, given in byte letters."""
        if not word:
            return []
        symbols = word[:-1] + chr(ord(word[-1]) + 0x1000) if self.suffix else word
        last: list = [None] * len(symbols)  # for each prefix: (its last token, its length)
        fits, compatible = self.fits.get, self.compatible
        for end, hit in self.automaton.iter(symbols):
            if last[end] is None:
                before = end - hit[0]
                if before >= 0:
                    held = last[before][1]
                    good = fits(held << 20 | hit[1])
                    if not (compatible(held, hit[1]) if good is None else good):
                        continue
                last[end] = hit
        ids, at = [], len(symbols) - 1
        while at >= 0:
            size, token = last[at]
            ids.append(token)
            at -= size
        return ids[::-1]

    def spelled(self, text: str) -> str:
        """A text in byte letters."""
        if text.isascii() and text.isprintable() and " " not in text:
            return text
        letters = self.letters
        return "".join([letters[b] for b in text.encode()])


# How the word vocabulary's texts are cut, and its white space.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", regex.V0)
BLANKS = regex.compile(r"[\t-\r \x85\xa0  -     　]+")


class WordCodec(Bpe):
    """The word vocabulary: composed characters, one space for white space, lower case; one pre-token per word."""

    def __init__(self, path: str):
        super().__init__(path)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")

    @staticmethod
    def normalized(text: str) -> str:
        text = BLANKS.sub(" ", text if text.isascii() else unicodedata.normalize("NFC", text))
        return text.lower() if text.isascii() else "".join([c.lower() for c in text])

    def word(self, word: str) -> tuple:
        """(number of ids, ids in decimal, tokens) of one pre-token."""
        if found := self.old_words.get(word):
            self.words[word] = found
            return found
        ids = self.encode_word(self.spelled(word))
        found = (len(ids), " ".join(map(str, ids)), " ".join([self.names[i] for i in ids]))
        if len(word) <= 64:
            if len(self.words) >= WORDS:
                self.old_words, self.words = self.words, {}
            self.words[word] = found
        return found

    def stretch(self, part: str) -> tuple:
        """The same of a stretch of text without spaces and line ends, with special tokens in it or not."""
        if found := self.old_stretches.get(part):
            self.stretches[part] = found
            return found
        found, words = [], self.words
        for at, bit in enumerate(self.cut.split(part) if "<|" in part else (part,)):
            if at % 2:
                found.append((1, str(self.special[bit]), bit))
            else:
                found += [words.get(w) or self.word(w) for w in PIECES.findall(self.normalized(bit))]
        found = found[0] if len(found) == 1 else (sum([f[0] for f in found]), *[" ".join([f[i] for f in found]) for i in (1, 2)])
        if len(part) <= 64:
            if len(self.stretches) >= STRETCHES:
                self.old_stretches, self.stretches = self.stretches, {}
            self.stretches[part] = found
        return found

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, ids in decimal and decoded text; stretches between spaces and line ends are independent."""
        held, fresh = self.stretches, self.stretch
        found = [held.get(w) or fresh(w) for w in text.replace("\n", " ").split(" ") if w]
        found = [f for f in found if f[0]]
        return sum([f[0] for f in found]), " ".join([f[1] for f in found]), " ".join([f[2] for f in found])

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.digests(text)[1].split()]

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in its file, the library joins the tokens with one space; unknown ids are left out."""
        return " ".join([self.names[i] for i in ids if i in self.names])


class IdCodec(WordCodec):
    """Ids only: what is remembered is a few bytes a word, within a smaller bound, since other stages share the worker."""

    STRETCHES, WORDS = 30_000, 50_000

    def word(self, word: str) -> bytes:
        found = self.old_words.get(word)
        if found is None:
            found = np.array(self.encode_word(self.spelled(word)), np.int32).tobytes()
        return self._kept(word, found, "words", self.WORDS)

    def stretch(self, part: str) -> bytes:
        found = self.old_stretches.get(part)
        if found is None:
            pieces, words = [], self.words
            for at, bit in enumerate(self.cut.split(part) if "<|" in part else (part,)):
                if at % 2:
                    pieces.append(np.int32(self.special[bit]).tobytes())
                else:
                    for w in PIECES.findall(self.normalized(bit)):
                        ids = words.get(w)
                        pieces.append(self.word(w) if ids is None else ids)
            found = b"".join(pieces)
        return self._kept(part, found, "stretches", self.STRETCHES)

    def _kept(self, text: str, found: bytes, memory: str, most: int) -> bytes:
        if len(text) <= 64:
            held = getattr(self, memory)
            if len(held) >= most:
                # The memory is emptied in place: the callers hold on to it.
                setattr(self, f"old_{memory}", dict(held))
                held.clear()
            held[text] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        held, parts = self.stretches, [w for w in text.replace("\n", " ").split(" ") if w]
        found = list(map(held.get, parts))
        if None in found:
            found = [self.stretch(p) if f is None else f for f, p in zip(found, parts, strict=True)]
        return np.frombuffer(b"".join(found), np.int32)


@lru_cache(maxsize=2)
def codec(path: str, kind: type = WordCodec) -> WordCodec:
    return kind(path)


RESULT = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digest(rows: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    `vocabulary` is the path of the file on every executor. Null and empty texts have no ids and the digest of the empty
    string; repeated rows repeat; other columns are not read. Nothing is shuffled.
    """

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def coded(texts: pa.Array) -> pa.Array:
        bpe, sha = codec(vocabulary), hashlib.sha256
        found = [bpe.digests(t) for t in texts.to_pylist()]
        return pa.array(
            [{"n_tokens": n, "ids_sha256": sha(i.encode()).hexdigest(), "decoded_sha256": sha(d.encode()).hexdigest()} for n, i, d in found],
            RESULT,
        )

    return rows.select(F.col(key).alias("doc_id"), coded(whole(text)).alias("c")).select("doc_id", "c.*")


def token_ids(rows: DataFrame, text: str, out: str, vocabulary: str) -> DataFrame:
    """The rows with one more column: the ids of each text, an empty array for null and empty texts."""

    @F.arrow_udf("array<int>")
    def coded(texts: pa.Array) -> pa.Array:
        bpe = codec(vocabulary, IdCodec)
        lists = [bpe.encode(t) for t in each_text(texts)]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*lists, np.empty(0, np.int32)])))

    return rows.withColumn(out, coded(whole(text)))
