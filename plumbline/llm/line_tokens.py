"""Lines of texts as sets of words, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash

#: Words are counted by this many bits of their hash; the order of rarity comes from these counts.
COUNT_BITS = 17
#: Bits of a word's hash beside its rarity in the order of words.
ORDER_BITS = 38
#: Words of a stretch at most, or of one text.
_STRETCH = 1 << 19
_LINE_BITS = 64 - 8 - ORDER_BITS
#: Longer words are hashed one by one.
_LONGEST = 64
_SPACES = b" \t\n\r\x0b\x0c"
_IN_WORD = bytes(b not in _SPACES for b in range(256))
#: The first n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64 bits."""
    for k in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        x = (x ^ x >> np.uint64(32)) * np.uint64(k)
    return x ^ x >> np.uint64(32)


#: A word of n bytes begins from number n.
_SIZES = _mixed(np.arange(1, _LONGEST + 2, dtype=np.uint64))


@dataclass
class Words:
    """Words of texts, A-Z in lower case: the text and the line of each line with words, its number of words, and their hashes."""

    text: np.ndarray
    line: np.ndarray
    sizes: np.ndarray
    hashes: np.ndarray


def words_of(texts: list[bytes]) -> Words:
    data = b"".join((b"\n", b"\n".join(texts), b"\n", bytes(8))).lower()
    n = len(data) - 8
    inside = np.frombuffer(data.translate(_IN_WORD), bool, n)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, end = edges[::2], edges[1::2]
    ends = np.flatnonzero(np.frombuffer(data, np.uint8, n) == 10)  # of the lines, after the one that stands before them
    counts = np.diff(np.searchsorted(begin, ends))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    first = np.searchsorted(ends, np.cumsum(lengths) - lengths)
    text = np.repeat(np.arange(len(texts)), np.diff(np.r_[first, len(counts)]))
    line = np.arange(len(counts)) - first[text]
    held = counts > 0
    return Words(text[held], line[held], counts[held], _hashes(data, begin, end - begin))


def _hashes(data: bytes, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of data, which ends with eight more bytes; eight bytes of all words at a time."""
    eights = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    out = _mixed(eights[begin] & _FIRST[np.minimum(size, 8)] ^ _SIZES[np.minimum(size, _LONGEST)])
    more, at = np.flatnonzero((size > 8) & (size <= _LONGEST)), 8
    while len(more):
        out[more] = _mixed(out[more] ^ eights[begin[more] + at] & _FIRST[np.minimum(size[more] - at, 8)])
        at += 8
        more = more[size[more] > at]
    for k in np.flatnonzero(size > _LONGEST).tolist():
        out[k] = xxhash.xxh64_intdigest(data[begin[k] : begin[k] + size[k]])
    return out


def _stretches(texts: Iterator[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts) of parts of bounded size."""
    part: list[bytes] = []
    first = size = 0
    for k, text in enumerate(texts):
        part.append(text)
        size += len(text)
        if size >= 2 * _STRETCH:  # a word and what follows it take two bytes at least
            yield first, part
            part, first, size = [], k + 1, 0
    if part:
        yield first, part


def count_words(texts: Iterator[bytes], counts: np.ndarray) -> None:
    """Adds the occurrences of words to counts, by the leading bits of their hashes."""
    for _, part in _stretches(texts):
        counts += np.bincount((words_of(part).hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=len(counts))


def levels_of(counts: np.ndarray) -> np.ndarray:
    """A step from 0 (rarest) to 255 for each count, on a scale of logarithms."""
    return np.minimum(255, 6 * np.log2(1 + counts)).astype(np.uint64)


class Lines:
    """Sets of words of the lines of a stretch of texts: text (its place in the iterator) and line say where a set is from, and its words, in
    order from the rarest on, are order[start : start + size]."""

    def __init__(self, first: int, words: Words, levels: np.ndarray) -> None:
        hashed, sizes = words.hashes, words.sizes
        rarity = levels[(hashed >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
        ordered = rarity << np.uint64(ORDER_BITS) | hashed & np.uint64((1 << ORDER_BITS) - 1)
        of = np.repeat(np.arange(len(sizes)), sizes)
        for a in range(0, len(sizes), 1 << _LINE_BITS):  # more than once for a text of very many lines: line, rarity and hash share 64 bits
            cut = slice(int(np.searchsorted(of, a)), int(np.searchsorted(of, a + (1 << _LINE_BITS))))
            packed = (of[cut] - a).astype(np.uint64) << np.uint64(64 - _LINE_BITS) | ordered[cut]
            at = np.argsort(packed)
            ordered[cut], hashed[cut] = ordered[cut][at], hashed[cut][at]
        new = np.ones(len(hashed), bool)
        new[1:] = (hashed[1:] != hashed[:-1]) | (of[1:] != of[:-1])
        self.order, self.hashes, of = ordered[new], hashed[new], of[new]
        self.size = np.bincount(of, minlength=len(sizes))
        self.start = np.cumsum(self.size) - self.size
        self.text, self.line = first + words.text, words.line


def lines_of(texts: Iterator[bytes], levels: np.ndarray) -> Iterator[Lines]:
    """Lines that have a word, in stretches of bounded size (one text's words at least)."""
    for first, part in _stretches(texts):
        words = words_of(part)
        if len(words.text):
            yield Lines(first, words, levels)
