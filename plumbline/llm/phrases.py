"""Phrases that words form more often than their parts explain, mined by partitioning (SON).

Texts (A-Z in lower case, null: empty) are split at PIECE_ENDS into pieces and these at spaces and tabs into words.
Everything is per language (null: `und`). A candidate is a phrase of 2 to `longest` words with at least `least`
contiguous occurrences inside pieces, overlaps included. Cutting it in two parts gives floor(1000000 * a * a / (l * r))
from its own count and those of the parts; its score is the lowest of these (ties: the smallest first part). A
candidate is dropped if its words lie side by side in a longer candidate that has at least half of its count.

How: words are counted first. Then, for each length, every shard (a stretch of at most about SHARD words of a task's
documents) is mined completely: all its phrases whose parts are frequent everywhere and that reach, in the shard, the
shard's share of `least`, rounded up. A phrase with `least` occurrences reaches that in one shard at least, so the
union of what the shards report holds every frequent phrase. If all shards were mined at a support of one, their counts
are complete and their sum is the count; else all texts are read again and the candidates of the union are counted
exactly. Phrases are counted in numpy within a shard, and by Spark over shards, combined before the shuffle.

Frequent words and phrases reach the tasks as bitmaps of 2**BITMAP_BITS bits; false positives only cost rows. The
languages' totals are broadcast for the LANGUAGES largest languages; shards mine any others at a support of one.
Words stand for 64-bit hashes while they are counted. That no two words share one is checked over all words, and
another seed is taken if two do.

Empty texts and texts of separators have no words. A very long text is read in stretches that end with a piece; only
one piece must fit into a task's memory. Repeated rows count as often as they occur. Ties are ordered by score, count and phrase, which is a
total order. An empty table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import stored

LEAST = 10
LONGEST = 3
TOP = 2000
#: A longer candidate with this share of a candidate's count replaces it.
COVERED = (50, 100)
UNKNOWN = "und"
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
SHARD = 1 << 20
BITMAP_BITS = 26
LANGUAGES = 4096
#: Slices in which a language's candidates are ranked before the last ranking, and candidates a slice.
_SLICES, _SLICE = 32, 100_000
#: Bytes of text that are cut into words at once.
_STRETCH = 1 << 22
_TO = bytes.maketrans((PIECE_ENDS + "\t" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ").encode(), b"\n" * len(PIECE_ENDS) + b" " + b"abcdefghijklmnopqrstuvwxyz")
_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer words are hashed one by one.
_SHORT = 64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _TURN
    return x ^ x >> np.uint64(29)


class _Words:
    """The words of stretches of text: a hash of each with its language, its piece, and its bytes."""

    def __init__(self, text: bytes, owner_ends: np.ndarray, langs: np.ndarray, seed: int) -> None:
        """owner_ends: where in text the part of each document ends; langs: 64-bit hash of each one's language."""
        self.text = text
        held = np.frombuffer(text + bytes(_SHORT + 8), np.uint8)
        inside = np.zeros(len(text) + 2, bool)
        inside[1:-1] = (held[: len(text)] != 32) & (held[: len(text)] != 10)
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.size = edges[::2], edges[1::2] - edges[::2]
        self.piece = np.searchsorted(np.flatnonzero(held[: len(text)] == 10), self.start)
        self.owner = np.searchsorted(owner_ends, self.start, side="right")
        eights = np.ndarray((len(held) - 7,), "<u8", held.tobytes(), strides=(1,))
        key = self.size.astype(np.uint64) * _MIX + np.uint64(seed)
        for j in range(0, min(_SHORT, int(self.size.max(initial=0))), 8):
            some = np.flatnonzero((self.size > j) & (self.size <= _SHORT))
            part = eights[self.start[some] + j] & _MASKS[np.minimum(8, self.size[some] - j)]
            key[some] = _mixed((key[some] ^ part) * _MIX)
        for k in np.flatnonzero(self.size > _SHORT).tolist():
            key[k] = xxhash.xxh3_64_intdigest(self.bytes(k), seed)
        self.key = _mixed(key * _MIX + langs[self.owner])

    def bytes(self, k: int) -> bytes:
        return self.text[self.start[k] : self.start[k] + self.size[k]]


def _stretches(batches: Iterator[pa.RecordBatch], seed: int, stretch: int) -> Iterator[tuple[_Words, list[str]]]:
    """Words of texts (columns lang, text as binary) in stretches of about `stretch` bytes that end with pieces, and the
    documents' languages."""
    parts: list[bytes] = []
    langs: list[str] = []
    size = 0

    def words() -> tuple[_Words, list[str]]:
        ends = np.cumsum([len(p) + 1 for p in parts])
        hashes = {lang: xxhash.xxh64_intdigest(lang, seed) for lang in set(langs)}
        return _Words(b"\n".join(parts), ends, np.array([hashes[lang] for lang in langs], np.uint64), seed), langs

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            whole, at = text.as_py().translate(_TO), 0
            while at < len(whole):
                end = whole.find(b"\n", at + stretch - size)
                end = len(whole) if end < 0 else end
                parts.append(whole[at:end])
                langs.append(lang)
                size, at = size + end - at, end + 1
                if size >= stretch:
                    yield words()
                    parts, langs, size = [], [], 0
    if parts:
        yield words()


def _word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """(lang, key, word, n) for every word."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, langs in _stretches(batches, seed, _STRETCH):
            keys, first, counts = np.unique(words.key, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([langs[k] for k in words.owner[first].tolist()], pa.string()), pa.array(keys.view(np.int64)),
                 pa.array([words.bytes(k) for k in first.tolist()], pa.binary()).cast(pa.string()), pa.array(counts)],
                ["lang", "key", "word", "n"])

    return texts.mapInArrow(found, "lang string, key long, word string, n long").groupBy("lang", "key", "word").agg(F.sum("n").alias("n"))


def _joined(keys: list[np.ndarray]) -> np.ndarray:
    """A hash of phrases from the hashes of their words."""
    out = keys[0]
    for key in keys[1:]:
        out = _mixed(out * _MIX + key)
    return out


def _bitmap(phrases: DataFrame) -> np.ndarray:
    """Bits of the phrases (column ws) as a field of 2**BITMAP_BITS bits."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ws = batch.column("ws")
            if len(ws):
                keys = ws.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(len(ws), -1)
                bit = (_joined(list(keys.T)) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array(np.int64(1) << (bit & 63))], ["slot", "bit"])

    slots = phrases.select("ws").mapInArrow(placed, "slot long, bit long").groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    field = np.zeros(1 << BITMAP_BITS - 6, np.uint64)
    field[slots["slot"].to_numpy()] = slots["bits"].to_numpy().view(np.uint64)
    return field


def _held(field: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys >> np.uint64(64 - BITMAP_BITS)
    return (field[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


class _Shard:
    """Words of a stretch of documents, to be mined for phrases of one length."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.langs: dict[str, int] = {}
        self.size = self.pieces = 0

    def add(self, words: _Words, langs: list[str]) -> None:
        of = np.array([self.langs.setdefault(lang, len(self.langs)) for lang in langs], np.int32)
        self.parts.append((words.key, words.piece + self.pieces, of[words.owner]))
        self.size += len(words.key)
        self.pieces += len(words.text) + 1

    def mine(self, length: int, frequent: np.ndarray, wanted: np.ndarray | None, support: dict[str, float]) -> pa.RecordBatch:
        """(w1 ... w<length>, n, t): phrases whose parts without the last and the first word are held by `frequent`.
        Without `wanted`, those that reach the local support t, and one row without words for each language that has
        a support above one; else those that `wanted` holds."""
        key, piece, lang = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        names = list(self.langs)
        own = np.bincount(lang, minlength=len(names))
        t = np.array([max(1, math.ceil(own[k] * support[x] - 1e-9)) if x in support else 1 for k, x in enumerate(names)], np.int64)
        n = max(0, len(key) - length + 1)
        inner = _held(frequent, _joined([key[k : len(key) - length + 2 + k] for k in range(length - 1)]))
        at = np.flatnonzero(inner[:n] & inner[1 : n + 1] & (piece[:n] == piece[length - 1 : length - 1 + n]))
        if wanted is not None:
            at = at[_held(wanted, _joined([key[at + k] for k in range(length)]))]
        ids, codes = np.unique(key[(at + np.arange(length)[:, None])], return_inverse=True)
        codes = codes.reshape(length, -1)
        code = codes[0]
        for k in range(1, length):
            code = code * len(ids) + codes[k]
            if k < length - 1:  # keeps the numbers small
                code = np.unique(code, return_inverse=True)[1]
        _, first, counts = np.unique(code, return_index=True, return_counts=True)
        least = t[lang[at[first]]]
        if wanted is None:
            first, counts, least = (x[kept] for kept in [counts >= least] for x in (first, counts, least))
        marks = t[(t > 1) & (own > 0)] if wanted is None else t[:0]
        found = at[first]
        columns = [pa.array(np.concatenate((key[found + k].view(np.int64), np.zeros(len(marks), np.int64)))) for k in range(length)]
        rest = pa.array(np.concatenate((counts, np.zeros(len(marks), np.int64)))), pa.array(np.concatenate((least, marks)))
        return pa.RecordBatch.from_arrays([*columns, *rest], [*(f"w{k + 1}" for k in range(length)), "n", "t"])


def _mined(texts: DataFrame, length: int, frequent: np.ndarray, wanted: np.ndarray | None, support: dict[str, float], seed: int) -> DataFrame:
    """(w1 ..., n, t): what the shards report, summed; t is the highest local support."""
    shared = texts.sparkSession.sparkContext.broadcast((frequent, wanted, support))
    names = [f"w{k + 1}" for k in range(length)]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for words, langs in _stretches(batches, seed, _STRETCH):
            if shard.size and shard.size + len(words.key) > SHARD:
                yield shard.mine(length, *shared.value)
                shard = _Shard()
            shard.add(words, langs)
        if shard.size:
            yield shard.mine(length, *shared.value)

    rows = texts.mapInArrow(found, ", ".join([*(f"{w} long" for w in names), "n long", "t long"]))
    return rows.groupBy(*names).agg(F.sum("n").alias("n"), F.max("t").alias("t"))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, totals, phrases): (lang, key, word, n) of words with `least` occurrences, (lang, n) with the words of each language, and
    (ws, n) with the words' keys for all phrases of 1 to `longest` words that have `least` occurrences."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    for seed in itertools.count(1):
        all_words = stored(_word_counts(texts, seed))
        if all_words.groupBy("key").count().filter("count > 1").isEmpty():  # else two words share a hash
            break
    totals = stored(all_words.groupBy("lang").agg(F.sum("n").alias("n")))
    support = {r["lang"]: least / r["n"] for r in totals.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    words = stored(all_words.filter(F.col("n") >= least))
    phrases = [words.select(F.array("key").alias("ws"), "n")]
    for length in range(2, longest + 1):
        names = [f"w{k + 1}" for k in range(length)]
        parts = _bitmap(phrases[-1])
        reported = stored(_mined(texts, length, parts, None, support, seed).withColumn("ws", F.array(*names)).select("ws", "n", "t"))
        counts = reported
        if not reported.filter("t > 1").isEmpty():  # some shards did not report all their phrases
            union = _bitmap(reported.filter("n > 0"))
            counts = stored(_mined(texts, length, parts, union, {}, seed).select(F.array(*names).alias("ws"), "n"))
        phrases.append(stored(counts.filter(F.col("n") >= least).select("ws", "n")))
    both = phrases[0]
    for more in phrases[1:]:
        both = both.union(more)
    return words, totals, both


def _big(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def scored(phrases: DataFrame) -> DataFrame:
    """(ws, a, l, r, score) for phrases (ws, n) of two words and more, by their weakest cut."""
    candidates = phrases.filter(F.size("ws") > 1).select("ws", F.col("n").alias("a"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)))
    cuts = cuts.select("ws", "a", "k", F.expr("slice(ws, 1, k)").alias("left"), F.expr("slice(ws, k + 1, size(ws) - k)").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(phrases.select(F.col("ws").alias(side), F.col("n").alias(name)), side)
    above, below = F.lit(1_000_000).cast("decimal(7,0)") * _big(F.col("a")) * _big(F.col("a")), _big(F.col("l")) * _big(F.col("r"))
    cuts = cuts.select("ws", "a", "l", "r", "k", above.alias("above"), below.alias("below")).withColumn("score", F.expr("above div below"))
    weakest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return cuts.groupBy("ws", "a").agg(weakest).select("ws", "a", "cut.l", "cut.r", "cut.score")


def _covered(phrases: DataFrame, covered: tuple[int, int]) -> DataFrame:
    """(ws): phrases that lie in longer ones with the given share of their count."""
    share, of = covered
    part = "flatten(transform(sequence(2, size(ws) - 1), m -> transform(sequence(1, size(ws) - m + 1), i -> slice(ws, i, m))))"
    inside = phrases.filter(F.size("ws") > 2).select(F.explode(F.expr(part)).alias("ws"), "n").groupBy("ws").agg(F.max("n").alias("most"))
    return phrases.join(inside, "ws").filter(of * F.col("most") >= share * F.col("n")).select("ws")


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: tuple[int, int] = COVERED, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language by score, count and phrase."""
    words, totals, phrases = frequent_phrases(docs, least, longest, text, lang)
    kept = stored(scored(phrases).join(_covered(phrases, covered), "ws", "left_anti"))
    spelt = kept.select("ws", F.posexplode("ws").alias("pos", "key")).join(words.select("key", "word", "lang"), "key").groupBy("ws").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"), F.first("lang").alias("lang"))
    named = stored(kept.join(spelt, "ws").drop("ws"))
    slices = max(_SLICES, named.count() // _SLICE)
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    for part in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(slices))], ["lang"]):
        named = named.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return named.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

