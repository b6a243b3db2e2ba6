"""Byte-pair encoding and decoding with a given vocabulary.

A text is split into words by the vocabulary's pattern. A short word is held as a contiguous array of parts with
the ranks of adjacent parts beside it: scan for the least rank, delete that boundary, refresh the two neighbouring
ranks, until no pair has a rank. Words of up to WIDE bytes that are met for the first time go through this together, as
rows of two numpy arrays (parts and ranks), one deletion per row and step. Words longer than SHORT_WORD go through a heap of
pairs, whose cost does not grow with the square of the length; all give the same parts. Words recur, so each worker keeps the
ids of recent stretches between two spaces, where the pattern always cuts unless white space stands on both sides of a space.

Null texts count as empty; an empty text has no ids and decodes to an empty text. Rows are independent of each
other, so repeated rows get equal results and an empty table gives an empty one. Other columns stay, but one with
the name of the output is replaced.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: how the vocabulary's pre-tokenizer cuts text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers of later editions of Unicode than the tokenizer's (16), in hexadecimal. To it they
#: are neither.
LATER_CHARACTERS = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7
10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6
187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24
1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff
2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
_FIRST_LATER = "\u0558"
SHORT_WORD = 96
#: Bytes of words that are encoded many at a time, and stretches of texts whose new words are.
WIDE = 32
TOGETHER = 1 << 18
KEPT_STRETCHES = 1 << 17
_NO_RANK, _NO_PAIR = 1 << 62, np.int32((1 << 31) - 1)
_ENDS = (",", ".", ";", ":", "!", "?")
#: A space between white space, or between white space and the end: there the pattern may not cut.
_JOINED_SPACE = re.compile(r"\s (?:\s|\Z)|\A \Z")


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: Latin-1 letters and signs for
    themselves, the other bytes in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}


def _pattern_without(later: str) -> str:
    """The pattern where the given ranges of characters are neither letters nor numbers."""
    ranges = [r.split("-") for r in later.split()]
    new = "[" + "".join(f"\\U{int(r[0], 16):08x}-\\U{int(r[-1], 16):08x}" for r in ranges) + "]"
    pattern = WORD_PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[{new}||[^\s\p{{L}}\p{{N}}]]")
    return pattern.replace(r" ?\p{L}", rf" ?[\p{{L}}--{new}]").replace(r" ?\p{N}", rf" ?[\p{{N}}--{new}]")


class Vocabulary:
    """Ids, merges and special tokens of a byte-level vocabulary file in JSON."""

    def __init__(self, content: str) -> None:
        spec, letters = json.loads(content), byte_letters()
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces = {i: bytes(letters[c] for c in token) for token, i in ids.items()}
        pieces |= {i: token.encode() for token, i in self.special.items()}
        self.pieces = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.first = [0] * 256
        for letter, byte in letters.items():
            self.first[byte] = ids[letter]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(ids[left] << 32 | ids[right], rank)
            self.merged.append(ids[left + right])
        order = np.argsort(keys := np.fromiter(self.ranks, np.int64, len(self.ranks)))
        self.pair_keys, self.pair_ranks = keys[order], np.fromiter(self.ranks.values(), np.int32, len(self.ranks))[order]
        self.merged_ids, self.first_ids = np.array(self.merged, np.int32), np.array(self.first, np.int32)
        self.words = regex.compile(WORD_PATTERN).findall
        self.late_words = regex.compile(_pattern_without(LATER_CHARACTERS), regex.V1).findall
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.kept = _Kept(self)

    def word(self, word: bytes) -> list[int]:
        parts = [self.first[b] for b in word]
        return self._by_array(parts) if len(parts) <= SHORT_WORD else self._by_heap(parts)

    def _by_array(self, parts: list[int]) -> list[int]:
        rank_of, merged = self.ranks.get, self.merged
        ranks = [rank_of(a << 32 | b, _NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < _NO_RANK:
            at = ranks.index(least)
            parts[at] = merged[least]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] << 32 | parts[at], _NO_RANK)
            if at < len(ranks):
                ranks[at] = rank_of(parts[at] << 32 | parts[at + 1], _NO_RANK)
        return parts

    def _by_heap(self, parts: list[int]) -> list[int]:
        rank_of, n = self.ranks.get, len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := rank_of(a << 32 | b)) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) >= 0 and (r := rank_of(parts[i] << 32 | parts[j])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = self.merged[rank], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p >= 0]

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        if not len(self.pair_keys):
            return np.full(len(keys), _NO_PAIR)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NO_PAIR)

    def many(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words of at most WIDE bytes. A row holds the parts of a word and the ranks of adjacent parts; in each
        step every row that has a ranked pair loses the boundary with the least rank."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        width = int(size.max(initial=1))
        inside = np.arange(width) < size[:, None]
        parts = np.zeros((len(words), width), np.int32)
        parts[inside] = self.first_ids[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full((len(words), width), _NO_PAIR, np.int32)
        pairs = np.zeros_like(inside)
        pairs[:, :-1] = inside[:, 1:]
        ranks[pairs] = self._rank_of(parts[pairs], np.roll(parts, -1, axis=1)[pairs])
        done, done_size, left = np.zeros_like(parts), size.copy(), np.arange(len(words))
        columns = np.arange(width)
        while len(left):
            each = np.arange(len(left))
            at = ranks.argmin(axis=1)
            least = ranks[each, at]
            ended = least == _NO_PAIR
            if ended.any():
                done[left[ended]], done_size[left[ended]] = parts[ended], size[ended]
                going = ~ended
                parts, ranks, size, left, at, least = parts[going], ranks[going], size[going], left[going], at[going], least[going]
                each = np.arange(len(left))
            later = np.minimum(columns + (columns > at[:, None]), width - 1)
            parts[each, at] = self.merged_ids[least]
            parts, ranks = np.take_along_axis(parts, later, axis=1), np.take_along_axis(ranks, later, axis=1)
            size = size - 1
            ranks[each, size - 1] = _NO_PAIR
            for place in (at - 1, at):
                some = np.flatnonzero((place >= 0) & (place < size - 1))
                ranks[some, place[some]] = self._rank_of(parts[some, place[some]], parts[some, place[some] + 1])
        packed = done[np.arange(width) < done_size[:, None]].tobytes()
        ends = (4 * np.cumsum(done_size)).tolist()
        return [packed[a:z] for a, z in zip([0, *ends], ends, strict=False)]

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """As encode() for each text; the new words of several texts are encoded together."""
        waiting: list[str | list[str]] = []
        size = 0
        for text in chain(texts, [None]):
            if text is not None:
                odd = _JOINED_SPACE.search(text) or (self.cut is not None and any(token in text for token in self.special))
                waiting.append(text if odd else text.split(" "))
                size += 0 if odd else len(waiting[-1])
            if text is None or size >= TOGETHER:
                self.kept.learn(set().union(*(x[1:] for x in waiting if isinstance(x, list))))
                for x in waiting:
                    yield self.encode(x) if isinstance(x, str) else self.stretch(x[0]) + b"".join(map(self.kept.__getitem__, x[1:]))
                waiting, size = [], 0

    def encode(self, text: str) -> bytes:
        """Ids as packed 32-bit numbers. Texts of special tokens stand for themselves, as in the tokenizer."""
        if self.cut is None or not any(token in text for token in self.special):
            return self._plain(text)
        out, at = [], 0
        for found in chain(self.cut.finditer(text), [None]):
            out.append(self._plain(text[at : found.start() if found else len(text)]))
            if found:
                out.append(array("i", [self.special[found[0]]]).tobytes())
                at = found.end()
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        if _JOINED_SPACE.search(text):
            return self.stretch(text)
        first, *rest = text.split(" ")
        return self.stretch(first) + b"".join(map(self.kept.__getitem__, rest))

    def split(self, text: str) -> list[str]:
        return self.words(text) if max(text, default="") < _FIRST_LATER else self.late_words(text)

    def stretch(self, text: str) -> bytes:
        return array("i", chain.from_iterable(map(self.word, map(str.encode, self.split(text))))).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Unknown ids are left out; bytes that are no UTF-8 become U+FFFD."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.pieces):
            ids = ids[(ids >= 0) & (ids < len(self.pieces))]
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


class _Kept(dict):
    """Packed ids of a space and the stretch after it. When full, all becomes the older generation, from which only what is
    met again comes back, so memory stays bounded."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary
        self.old: dict[str, bytes] = {}

    def __missing__(self, stretch: str) -> bytes:  # a long one, or one that was not learnt
        return self.vocabulary.stretch(" " + stretch)

    def learn(self, stretches: set[str]) -> None:
        """Encodes those of the stretches that are new, their words all together."""
        new = stretches - self.keys()
        if len(self) + len(new) > KEPT_STRETCHES:
            self.old = dict(self)
            self.clear()
            new = stretches
        known = new & self.old.keys()
        self.update((stretch, self.old[stretch]) for stretch in known)
        # Flat lists of strings: millions of small containers would keep the garbage collector busy.
        held: list[str] = []
        counts: list[int] = []
        words: list[bytes] = []
        for stretch in new - known:
            if len(stretch) <= SHORT_WORD:
                before = len(words)
                letters = stretch[:-1] if stretch[-1:] in _ENDS else stretch
                if letters.isalpha() and (letters.isascii() or max(letters) < _FIRST_LATER):  # the pattern's answer is plain
                    words.append(f" {letters}".encode())
                    if letters is not stretch:
                        words.append(stretch[-1:].encode())
                else:
                    words += map(str.encode, self.vocabulary.split(" " + stretch))
                held.append(stretch)
                counts.append(len(words) - before)
        short = [word for word in words if len(word) <= WIDE]
        packed = iter(self.vocabulary.many(short) if short else [])
        each = (next(packed) if len(word) <= WIDE else array("i", self.vocabulary.word(word)).tobytes() for word in words)
        for stretch, n in zip(held, counts, strict=True):
            self[stretch] = next(each) if n == 1 else b"".join(islice(each, n))


_loaded: dict[int, Vocabulary] = {}


def _vocabulary(content) -> Vocabulary:
    """One per worker process and broadcast."""
    if content.id not in _loaded:
        _loaded.clear()
        _loaded[content.id] = Vocabulary(content.value)
    return _loaded[content.id]


class _Shared:
    """A broadcast with its id, which workers keep loaded vocabularies by."""

    def __init__(self, spark: SparkSession, content: str) -> None:
        self.id, self.inner = hash(content), spark.sparkContext.broadcast(content)

    @property
    def value(self) -> str:
        return self.inner.value


def _as_lists(packed: list[bytes]) -> pa.ListArray:
    ends = np.fromiter(accumulate((len(p) // 4 for p in packed), initial=0), np.int64, len(packed) + 1)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))


class Tokenizer:
    """Encodes and decodes columns. The file's content is broadcast: its size is that of the vocabulary."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            self.shared = _Shared(spark, file.read())

    def encode(self, df: DataFrame, text: str = "text", ids: str = "ids") -> DataFrame:
        """df with the token ids of a text column as array<int>."""
        shared = self.shared

        @F.arrow_udf("array<int>")
        def encoded(texts: pa.Array) -> pa.Array:
            return _as_lists(list(_vocabulary(shared).encode_all(text.as_py() for text in texts)))

        return df.withColumn(ids, encoded(F.coalesce(F.col(text), F.lit(""))))

    def round_trip(self, df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
        """df with the token ids of a text column and the text that these ids decode to, in one visit of a worker."""
        shared = self.shared

        @F.arrow_udf("ids array<int>, decoded string")
        def both(texts: pa.Array) -> pa.Array:
            vocabulary = _vocabulary(shared)
            packed = list(vocabulary.encode_all(text.as_py() for text in texts))
            back = pa.array([vocabulary.decode(np.frombuffer(p, np.int32)) for p in packed], pa.string())
            return pa.StructArray.from_arrays([_as_lists(packed), back], ["ids", "decoded"])

        made = df.withColumn(ids, both(F.coalesce(F.col(text), F.lit(""))))
        return made.withColumn(decoded, F.col(ids)["decoded"]).withColumn(ids, F.col(ids)["ids"])

    def decode(self, df: DataFrame, ids: str = "ids", text: str = "decoded") -> DataFrame:
        """df with the text of a column of token ids; null ids count as none."""
        shared = self.shared

        @F.arrow_udf("string")
        def decoded(lists: pa.Array) -> pa.Array:
            decode, flat = _vocabulary(shared).decode, lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum([0, *(len(x) for x in lists)]) if lists.null_count or lists.offset else lists.offsets.to_numpy() - lists.offsets[0].as_py()
            return pa.array([decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())

        return df.withColumn(text, decoded(F.coalesce(F.col(ids), F.array().cast("array<int>"))))
