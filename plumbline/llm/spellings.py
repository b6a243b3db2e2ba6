"""Spelling variants: words that differ by one letter, and the form that each of them is a variant of.

Words are maximal runs of LETTERS of the texts (A-Z in lower case), changed by `marked` where the caller asks for it, of
`shortest` code points and more and with `fewest` occurrences and more over all documents. Two words are near if they
differ by exactly one inserted, deleted or replaced code point. A word's form is its near word with the most
occurrences (ties: the smallest in code-point order) if that has at least `times` as many as the word itself; its root
is the last word of the chain of forms, or the word itself.

How: two near words whose shorter one has l code points share their first l // 2 code points or their last l - l // 2,
so a word meets its near words in four groups (for its length as the shorter and the longer one, by either end). A
group of more than BLOCK words is split into blocks, and every block meets every other in a task of its own. In a task, a
position index holds, for each (position, letter), the words with that letter there as the bits of a number. A word
runs over the index once: sets of words with no error so far and with one replaced, inserted or deleted code
point so far are moved on together, the latter two against the positions after and before. A pair that shares both
ends counts in the group of the first end only. Words come by falling number of occurrences, so the lowest bit of the
result is the best near word, and no pair is ever listed.

Null texts have no words; a null doc_id counts as an empty one. Very long texts are matched as wholes, very long runs
are words like any others. Repeated rows count as often as they occur. An empty table gives an empty result. Columns other than doc_id and text
are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored

LETTERS = "[A-Za-zÀ-ÿ]"
SHORTEST = 7
FEWEST = 2
TIMES = 10
#: Every so many words lose a code point, by a checksum of document and word.
MARKED = 31
BLOCK = 4096
#: Words that share a position index, whatever their groups, if the groups are small.
_INDEX = 1024


def marked(doc_id: Column, word: Column) -> Column:
    """The word, without one of its code points if the checksum of document and word says so."""
    sum32 = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word), "UTF-8"))
    at = F.pmod(sum32, F.char_length(word).cast("long")).cast("int")
    return F.when(sum32 % MARKED == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))).otherwise(word)


def vocabulary(docs: DataFrame, change: Callable[[Column, Column], Column] | None = None, shortest: int = SHORTEST, fewest: int = FEWEST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words and how often they occur."""
    lowered = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.regexp_extract_all(lowered, F.lit(f"{LETTERS}{{{shortest},}}"), F.lit(0))).alias("run"))
    words = runs.select((change(F.col("doc_id"), F.col("run")) if change else F.col("run")).alias("word"))
    return words.filter(F.char_length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= fewest)


class _Index:
    """Which of up to a few thousand words have a letter at a position, as the bits of numbers."""

    def __init__(self, words: list[str]) -> None:
        longest = max(map(len, words), default=0)
        self.at: list[dict[str, int]] = [defaultdict(int) for _ in range(longest + 2)]
        self.long: dict[int, int] = defaultdict(int)
        for k, word in enumerate(words):
            bit = 1 << k
            self.long[len(word)] |= bit
            for place, letter in zip(self.at, word):  # noqa: B905
                place[letter] |= bit

    def near(self, word: str, among: int, shorter: int, last: bool) -> int:
        """Words of `among` that differ from word by one code point, the shorter of both having `shorter` of them: those that
        share its first half, or those that do not (last)."""
        half, zero, replaced, inserted, deleted, same = shorter // 2, among, 0, 0, 0, among
        before: dict[str, int] = {}
        for i, letter in enumerate(word):
            if i == half:
                same = zero
            if i + 1 >= len(self.at):  # no word is as long
                return 0
            here = self.at[i].get(letter, 0)
            deleted = deleted & before.get(letter, 0) | zero
            inserted = (inserted | zero) & self.at[i + 1].get(letter, 0)
            replaced = replaced & here | zero & ~here
            zero &= here
            before = self.at[i]
            if not (zero or replaced or inserted or deleted):
                return 0
        n, long = len(word), self.long.get
        found = replaced & long(n, 0) | (inserted | zero) & long(n + 1, 0) if n == shorter else deleted & long(n - 1, 0)
        return found & ~same if last else found & same


_QUERY, _INDEXED = 1, 2


def _meetings(words: DataFrame, shortest: int) -> DataFrame:
    """(unit, word, n, shorter, last, role): the words that meet in a unit, as queries, in the index, or as both."""
    size = F.char_length("word")
    ends = words.withColumn("shorter", F.explode(F.array(size, size - 1))).filter(F.col("shorter") >= shortest).withColumn("last", F.explode(F.array(F.lit(False), F.lit(True))))
    half = F.floor(F.col("shorter") / 2).cast("int")
    own = F.when(F.col("last"), F.expr("right(word, shorter - shorter div 2)")).otherwise(F.substring("word", F.lit(1), half))
    ends = ends.withColumn("meeting", F.xxhash64("shorter", "last", own))
    crowded = stored(ends.groupBy("meeting").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > BLOCK))
    blocks = F.coalesce(F.ceil(F.col("size") / BLOCK).cast("int"), F.lit(1))
    dealt = ends.join(crowded, "meeting", "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "word"), F.col("blocks")).cast("int"))
    columns = ["word", "n", "shorter", "last"]
    alone = dealt.filter("blocks = 1").select(F.col("meeting").alias("unit"), *columns, F.lit(_QUERY | _INDEXED).alias("role"))
    pairs = dealt.filter("blocks > 1").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    same = F.col("block") == F.col("other")
    asks = pairs.select(F.xxhash64("meeting", "block", "other").alias("unit"), *columns, F.when(same, F.lit(_QUERY | _INDEXED)).otherwise(F.lit(_QUERY)).alias("role"))
    stands = pairs.filter(~same).select(F.xxhash64("meeting", "other", "block").alias("unit"), *columns, F.lit(_INDEXED).alias("role"))
    return alone.union(asks).union(stands)


def _asked(rows: list[tuple]) -> Iterator[tuple[str, int, str, int]]:
    """(word, number of near words, the best of them, its n) for the queries among the rows of whole units."""
    rows.sort(key=lambda row: (-row[2], row[1]))
    held = [(unit, word, n) for unit, word, n, _, _, role in rows if role & _INDEXED]
    index, members = _Index([word for _, word, _ in held]), defaultdict(int)
    for k, (unit, _, _) in enumerate(held):
        members[unit] |= 1 << k
    for unit, word, _, shorter, last, role in rows:
        among = members.get(unit, 0) if role & _QUERY else 0
        if among & (among - 1) or among and role == _QUERY:  # another word than the query itself
            if near := index.near(word, among, shorter, last):
                _, best, n = held[(near & -near).bit_length() - 1]
                yield word, near.bit_count(), best, n


def near_words(words: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(word, n_near, best, best_n) for the words of (word, n) that have near words."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def answers() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [dict(zip(("word", "near", "best", "best_n"), x, strict=True)) for x in _asked(rows)],
                pa.schema([("word", pa.string()), ("near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())]))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(rows) >= _INDEX and row[0] != rows[-1][0]:
                    yield answers()
                    rows = []
                rows.append(row)
        if rows:
            yield answers()

    together = _meetings(words, shortest).repartition("unit").sortWithinPartitions("unit")
    answers = together.mapInArrow(found, "word string, near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best"))).alias("first")
    return answers.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", F.col("first.best").alias("best"), (-F.col("first.less")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last word of each chain of forms. The steps double in each round."""
    reached = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        after = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(reached.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")))
        if moved.filter("on").isEmpty():
            return moved.select("word", "root")
        reached = moved.select("word", "root")


def group(docs: DataFrame, change: Callable[[Column, Column], Column] | None = None, shortest: int = SHORTEST, fewest: int = FEWEST, times: int = TIMES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word."""
    words = stored(vocabulary(docs, change, shortest, fewest, doc_id, text))
    found = words.join(near_words(words, shortest), "word", "left")
    chosen = F.col("best_n") >= times * F.col("n")
    known = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, F.col("best")).alias("form"), F.when(chosen, F.col("best_n")).alias("form_n")))
    roots = _roots(known.filter("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
