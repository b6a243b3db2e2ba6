"""Line dedup by an exact set-similarity join.

A line is the set of its words (A-Z in lower case); lines without words are neither compared nor removed. Two lines
match if the Jaccard similarity of their sets is at least 0.8. Lines have an order: by doc_id (null first), then a hash
of the text, then their place. A line is removed if it matches any earlier line. Rows with equal doc_id and text are
one document: they lose the same lines, and a line does not match itself in the other row.

How: equal sets are one row, so a line with any number of copies is met once. The words of a set are ordered from the
rarest on, by counts over all texts. Two sets can only match if they share a word among the first |x| - ceil(0.8 |x|) + 1
of each, so these words are the join keys: Spark brings the entries of a word together, sorted by document, and a task
compares them in numpy. Pairs must pass the length filter, the positional filter (it is enough to find a pair at the first
word that both have, so all they share is this word and what follows) and a parity filter (each word that only one set
has flips at most one of 128 bits). Survivors are verified on the sets.

By the positional filter the smaller set of a pair has the word among its first |x| - ceil(8/9 |x|) + 1, its leading
ones. Lists are therefore split by size and by leading or not, and only splits that can pass
meet: lines of one template, whose common word leads in none of them, are never paired. Large splits that do meet, for
entries with more than LONG others to meet, are joined on parts of the parity bits: if at most f of 128 bits differ, one of f + 1 parts is equal in both. Where f is
over 128 / SHORTEST_PART the parts say too little, and blocks of all pairs of the two splits are compared.

It is enough to find one earlier match. In a word's list a set meets its LAGS predecessors, and the whole list unless half of
them pass; the KEPT partners with the fewest flips are verified. Where there may be more, the word is noted, and sets whose partners all
fail are verified against all that pass, in a second round over the lists of these words only. No pairs within a large group of near
copies are formed for members whose first partners hold, and no match is lost.

Words are compared by 64-bit hashes. The only broadcasts are the table of word counts (2**COUNT_BITS numbers) and a
bitmaps of 2**BITMAP_BITS bits that spare most texts and lines the verification; false positives only cost rows.

doc_id is a whole number. Null texts stay null and have no lines. A text that loses all lines becomes empty; its row stays. Repeated rows keep
equal results, an empty table gives an empty one, other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored, temporary
from plumbline.llm.line_tokens import COUNT_BITS, count_words, levels_of, lines_of

LAGS = 8
#: Partners of an entry that are verified at once.
KEPT = 4
#: Entries with more others to meet are compared split by split.
LONG = 4096
#: Splits with more pairs are joined on parts of the parity bits, of this many bits at least.
MANY = 1 << 14
SHORTEST_PART = 12
#: Pairs that are compared at once, and entries that are.
_MATRIX = 1 << 21
_TOGETHER = 1 << 16
#: Rows of a task's word counts.
_COUNT_PARTS = 256
#: Sets that a task remembers to have met.
_MET = 1 << 20
#: Words are dealt to this many parts, a power of two, and so many entries of a part at most are one row.
PARTS = 1 << 12
BLOCK = 1 << 10
BITMAP_BITS = 24
#: Sets with fewer words match none but equal sets.
LEAST = 4


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (t.as_py() for t in batch.column("text"))


def word_levels(texts: DataFrame) -> np.ndarray:
    """Rarity by the leading bits of a word's hash, from counts over all texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((_COUNT_PARTS, (1 << COUNT_BITS) // _COUNT_PARTS), np.int64)
        for batch in batches:
            count_words(_texts(batch), counts.reshape(-1))
        yield rows(dict(enumerate(counts)))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.int64)
        yield rows(sums)

    def rows(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([c.tobytes() for c in parts.values()], pa.binary())], ["part", "counts"])

    # Many counts are one row, so that summing up the tasks' counts costs few rows.
    kind = "part int, counts binary"
    summed = texts.select("text").mapInArrow(counted, kind).repartition("part").mapInArrow(added, kind).toArrow()
    counts = np.zeros((_COUNT_PARTS, (1 << COUNT_BITS) // _COUNT_PARTS), np.int64)
    for part, held in zip(summed["part"].to_pylist(), summed["counts"].to_pylist(), strict=True):
        counts[part] = np.frombuffer(held, np.int64)
    counts = counts.reshape(-1)
    return levels_of(counts)


def _keys(lines) -> np.ndarray:
    """Per line: a 128-bit digest of its set."""
    data, at, size = lines.hashes.tobytes(), lines.start, lines.size
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[8 * a : 8 * (a + n)]) for a, n in zip(at.tolist(), size.tolist(), strict=True)), "S16")


def _parities(lines) -> tuple[np.ndarray, ...]:
    """Per line: 128 parity bits of its set in two numbers."""
    at = lines.start
    bit, low = np.uint64(1) << (lines.hashes & np.uint64(63)), (lines.hashes >> np.uint64(6)) & np.uint64(1) > 0
    return tuple(np.bitwise_xor.reduceat(np.where(side, bit, np.uint64(0)), at).view(np.int64) for side in (low, ~low))


def _binary(keys: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def _words(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Numbers as binary values, sizes[k] of them in value k."""
    ends = 8 * np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(values)])


def line_sets(texts: DataFrame, levels: np.ndarray) -> DataFrame:
    """(doc, dh, line, key, odd1, odd2, size, prefix) for each line with words; texts has doc, dh and text (binary).
    The prefix, eight bytes a word, is empty where the task has met the set before, in no later document."""
    shared, kind = texts.sparkSession.sparkContext.broadcast(levels), texts.schema["doc"].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[bytes, int] = {}
        for batch in batches:
            docs = batch.column("doc").cast(pa.int64()).fill_null(-(1 << 63)).to_pylist()
            for lines in lines_of(_texts(batch), shared.value):
                keys, (odd1, odd2) = _keys(lines), _parities(lines)
                size, new = lines.size, np.zeros(len(keys), bool)
                if len(met) > _MET:
                    met.clear()
                for k, (key, text, n) in enumerate(zip(keys.tolist(), lines.text.tolist(), size.tolist(), strict=True)):
                    if n >= LEAST and docs[text] < met.get(key, 1 << 63):
                        met[key], new[k] = docs[text], True
                reach = np.where(new, size + 1 + (-4 * size) // 5, 0)
                inside = np.arange(len(lines.order)) - np.repeat(lines.start, size) < np.repeat(reach, size)
                at = pa.array(lines.text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(at), batch.column("dh").take(at), pa.array(lines.line.astype(np.int32)), _binary(keys), pa.array(odd1), pa.array(odd2),
                     pa.array(size.astype(np.int32)), _words(lines.order[inside], reach)],
                    ["doc", "dh", "line", "key", "odd1", "odd2", "size", "prefix"])

    return texts.mapInArrow(found, f"doc {kind}, dh long, line int, key binary, odd1 long, odd2 long, size int, prefix binary")


def _part(odd1: np.ndarray, odd2: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Bits begin to end (at most 64) of the 128 parity bits."""
    low, high = odd1.view(np.uint64), odd2.view(np.uint64)
    bits = low >> np.uint64(begin) if begin < 64 else high >> np.uint64(begin - 64)
    if begin < 64 < end:
        bits = bits | high << np.uint64(64 - begin)
    return bits & np.uint64((1 << (end - begin)) - 1)


def _ranges(begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(k, place) for each place of the ranges [begin[k], begin[k] + size[k]), in blocks of about _MATRIX places."""
    ends, at = np.cumsum(size), 0
    while at < len(size):
        more = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _MATRIX, "right")) - at)
        cut = slice(at, at + more)
        k = np.repeat(np.arange(at, at + len(size[cut])), size[cut])
        yield k, np.arange(len(k)) - np.repeat(np.cumsum(size[cut]) - size[cut], size[cut]) + begin[k]
        at += more


class _List:
    """Entries of words, sorted by word and document: columns word, doc, odd1, odd2, size, pos, open."""

    def __init__(self, columns: list[np.ndarray]) -> None:
        self.columns = columns
        self.word, self.doc, self.odd1, self.odd2, self.size, self.pos, self.open = columns
        self.size, self.pos = self.size.astype(np.int32), self.pos.astype(np.int32)
        self.more = np.zeros(len(self.word), bool)  # entries with earlier partners that pairs(False) may not have named

    def flips(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Differing parity bits of pairs of entries that pass all filters; 255 for the others. Jaccard of at least 0.8
        is an overlap of at least 4/9 of both sizes, and different sets of one size do not overlap wholly. Entries of
        one document pass in either order."""
        out, n, m = np.full(len(x), 255, np.uint8), self.size[x], self.size[y]
        both, rest = n + m, np.minimum(n - self.pos[x], m - self.pos[y])
        kept = np.flatnonzero(9 * (rest - (rest == np.maximum(n, m))) >= 4 * both)  # most pairs end here
        x, y, both = x[kept], y[kept], both[kept]
        flips = sum(np.bitwise_count((odd[x] ^ odd[y]).view(np.uint64)).astype(np.int32) for odd in (self.odd1, self.odd2))
        good = (both >= 9 * flips) & (flips > 0)
        out[kept[good]] = flips[good]
        return out

    def _splits(self, places: np.ndarray) -> list[tuple[int, bool, np.ndarray]]:
        """(size, whether the word leads, places) of the splits of a word's entries."""
        n = self.size[places]
        kind = 2 * n + (9 * (n - self.pos[places]) >= 8 * n)
        order = np.argsort(kind, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(kind[order]) > 0])
        return [(int(k) // 2, bool(k % 2), part) for k, part in zip(kind[order][starts], np.split(places[order], starts[1:]), strict=True)]

    def _met(self, xs: np.ndarray, ys: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(x, y) of two splits, with all pairs of `most` or fewer different parity bits among them, some more than once."""
        parts = most + 1
        if len(xs) * len(ys) <= MANY or parts * SHORTEST_PART > 128:
            for k, place in _ranges(np.zeros(len(ys), np.int64), np.full(len(ys), len(xs))):
                yield xs[place], ys[k]
            return
        for p in range(parts):
            edges = 128 * p // parts, 128 * (p + 1) // parts
            of_x, of_y = (_part(self.odd1[at], self.odd2[at], *edges) for at in (xs, ys))
            order = np.argsort(of_x, kind="stable")
            of_x = of_x[order]
            begin = np.searchsorted(of_x, of_y)
            for k, place in _ranges(begin, np.searchsorted(of_x, of_y, "right") - begin):
                yield xs[order[place]], ys[k]

    def _long(self, ys: np.ndarray, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(x, y) for entries y of a word whose list is [first, last), with all pairs that pass the filters among them."""
        xs = self._splits(np.arange(first, last))
        for m, y_leads, of_y in self._splits(ys):
            for n, x_leads, of_x in xs:
                leads = x_leads if n < m else y_leads if n > m else x_leads and y_leads and n >= 9
                if leads and 5 * n >= 4 * m and 5 * m >= 4 * n and n + m >= 9:
                    yield from self._met(of_x, of_y, (n + m) // 9)

    def _fewest(self, x: np.ndarray, y: np.ndarray, flips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of each y with the fewest flips, KEPT at most with different parities of x; notes y that have more."""
        at = np.lexsort((self.odd2[x], self.odd1[x], flips, y))
        x, y, flips = x[at], y[at], flips[at]
        new = np.ones(len(y), bool)
        new[1:] = (y[1:] != y[:-1]) | (self.odd1[x[1:]] != self.odd1[x[:-1]]) | (self.odd2[x[1:]] != self.odd2[x[:-1]])
        x, y, flips = x[new], y[new], flips[new]
        starts = np.flatnonzero(np.r_[True, y[1:] != y[:-1]][: len(y)])
        rank = np.arange(len(y)) - np.repeat(starts, np.diff(np.r_[starts, len(y)]))
        self.more[y[rank >= KEPT]] = True
        return x[rank < KEPT], y[rank < KEPT], flips[rank < KEPT]

    def pairs(self, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(x, y, flips) of places: for each y the best earlier x, noting y that may have others; or with every all that
        pass for open y."""
        n = len(self.word)
        starts = np.flatnonzero(np.r_[True, self.word[1:] != self.word[:-1]])
        sizes = np.diff(np.r_[starts, n])
        first = np.repeat(starts, sizes)
        same = np.flatnonzero(np.r_[True, (self.word[1:] != self.word[:-1]) | (self.doc[1:] != self.doc[:-1])])
        last = np.repeat(np.r_[same[1:], n], np.diff(np.r_[same, n]))  # the end of the entries of y's word and document
        todo = np.flatnonzero(self.open & (np.repeat(sizes, sizes) > 1))
        if not every:
            rest = []
            for part in np.split(todo, range(_MATRIX, len(todo), _MATRIX)):
                near, passed = [], np.zeros(n, np.int8)
                for lag in range(1, LAGS + 1):
                    y = part[part - lag >= first[part]]
                    flips = self.flips(y - lag, y)
                    y, flips = y[(good := flips < 255)], flips[good]
                    passed[y] += 1
                    near.append((y - lag, y, flips))
                longer = (part - first[part] > LAGS) | (last[part] - part > 1)
                crowded = passed[part] >= max(1, LAGS // 2)
                self.more[part[longer & crowded]] = True
                rest.append(part[longer & ~crowded])
                passed[rest[-1]] = 0  # they meet the whole list
                x, y, flips = map(np.concatenate, zip(*near, strict=True))
                yield self._fewest(*(column[passed[y] > 0] for column in (x, y, flips)))
            todo = np.concatenate(rest)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, most = 0, _MATRIX
        for x, y in self._whole(todo, first, last):
            flips = self.flips(x, y)
            at = np.flatnonzero((flips < 255) & (x < last[y]))  # later lines of y's own document are in it
            if every:
                yield x[at], y[at], flips[at]
                continue
            held.append((x[at], y[at], flips[at]))
            size += len(at)
            if size > most:
                held = [self._fewest(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
                most = 2 * size + _MATRIX
        if held:
            yield self._fewest(*map(np.concatenate, zip(*held, strict=True)))

    def _whole(self, todo: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(x, y) from the whole lists of entries todo: x of the sizes that can pass, and leading if it is smaller."""
        longest = 2 + (int(self.size.max()) * 5) // 4
        leads = 9 * (self.size - self.pos) >= 8 * self.size
        # Entries by word, leading or not, and size; a range of sizes is a range of places.
        cell = (2 * (np.cumsum(np.r_[False, self.word[1:] != self.word[:-1]])) + leads) * longest + self.size
        order = np.argsort(cell, kind="stable")
        cells, m, base = cell[order], self.size[todo], cell[todo] - self.size[todo]
        most = np.where(leads[todo], 5 * m // 4, 0)
        led, others = base + np.where(leads[todo], 0, longest), base - np.where(leads[todo], longest, 0)
        ranges = [(led - (-4 * m // 5), led + m - 1), (led + m + (m < 9), led + most), (others + m + 1, others + most)]
        begin, end = (np.array([np.searchsorted(cells, r[k], side) for r in ranges]) for k, side in enumerate(("left", "right")))
        width = np.maximum(0, end - begin)
        short = width.sum(axis=0) <= LONG
        for start, size in zip(begin, width, strict=True):
            for k, place in _ranges(start[short], size[short]):
                yield order[place], todo[short][k]
        long = todo[~short]
        for ys in np.split(long, np.flatnonzero(np.diff(first[long])) + 1) if len(long) else ():
            yield from self._long(ys, int(first[ys[0]]), int(last[ys[-1]]))


_BOTH = ("odd1", "odd2")


def _entries(lines: DataFrame, failed: DataFrame | None) -> DataFrame:
    """(part, entries): words are dealt to parts, and many entries of a part are one row, see _dealt. An entry is word, doc, odd1, odd2, and size, pos
    and open in one number; there is one per prefix word of a line. With failed (key, word), of these words and few others only, and open only for
    these sets."""
    doc = F.coalesce(F.col("doc").cast("long"), F.lit(-(1 << 63))).alias("doc")
    indexed = lines.filter(F.length("prefix") > 0).select(doc, *_BOTH, F.col("size").cast("long").alias("size"), "key", "prefix")
    shared = None
    if failed is not None:
        shared = lines.sparkSession.sparkContext.broadcast((_bitmap(failed.select(_number_of(F.col("key")).alias("number"))), _bitmap(failed.select("word"))))

    def of(batch: pa.RecordBatch) -> np.ndarray:
        doc, odd1, odd2, size = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        ends, word = _content(batch.column("prefix"))
        reach = np.diff(ends) // 8
        line, place = np.repeat(np.arange(len(reach)), reach), np.arange(len(word)) - np.repeat(ends[:-1] // 8, reach)
        is_open = np.ones(len(reach), np.int64)
        if shared is not None:
            sets, words = shared.value
            is_open = _held(sets, _numbers(_content(batch.column("key"))[1])).astype(np.int64)
            take = np.flatnonzero(_held(words, word))  # the low bits of a word are bits of its hash
            word, line, place = word[take], line[take], place[take]
        return np.stack([word, doc[line], odd1[line], odd2[line], size[line] << 32 | place << 1 | is_open[line]])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                held.append(of(batch.slice(at, 1000)))
                if sum(part.shape[1] for part in held) >= _TOGETHER << 3:
                    yield _dealt(np.concatenate(held, axis=1))
                    held = []
        if held:
            yield _dealt(np.concatenate(held, axis=1))

    return indexed.mapInArrow(dealt, "part int, entries binary")


def _content(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Binary values of whole numbers: where they end, from 0, and the numbers of all."""
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    content = values.buffers()[2]
    return ends - ends[0], np.frombuffer(content[ends[0] : ends[-1]] if content else b"", np.int64)


def _dealt(entries: np.ndarray) -> pa.RecordBatch:
    """Entries (five rows of numbers) by parts, which are bits of their words, BLOCK at most in a row: column after column."""
    part = (entries[0] & (PARTS - 1)).astype(np.uint16)
    entries, counts = entries[:, np.argsort(part, kind="stable")], np.bincount(part, minlength=PARTS)
    pieces = -(-counts // BLOCK)
    of = np.repeat(np.arange(PARTS), pieces)
    start = (np.cumsum(counts) - counts)[of] + BLOCK * (np.arange(len(of)) - (np.cumsum(pieces) - pieces)[of])
    size = np.diff(np.r_[start, entries.shape[1]])
    place, step = np.arange(entries.shape[1]) + np.repeat(4 * start, size), np.repeat(size, size)
    out = np.empty(entries.size, np.int64)
    for k, column in enumerate(entries):
        out[place + k * step] = column
    ends = pa.py_buffer(np.r_[40 * start, out.nbytes].astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(of), [None, ends, pa.py_buffer(out)])], ["part", "entries"])


def candidates(lines: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Pairs (x1, x2, y1, y2, more) of different parities of sets that pass the filters, x not in a later document than
    y: for each y and word the best partners, and in more the word if there may be others; with failed (key, word) all for these y and words."""
    together = _entries(lines, failed).repartition("part").sortWithinPartitions("part")
    every = failed is not None

    def rows(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        word, doc, odd1, odd2, packed = np.concatenate(held, axis=1)
        at = np.lexsort((doc, word))
        packed = packed[at]
        found = _List([word[at], doc[at], odd1[at], odd2[at], packed >> 32, (packed & 0xFFFFFFFF) >> 1, (packed & 1).astype(bool)])
        for x, y, _ in found.pairs(every):
            more = pa.array(found.word[y], mask=~found.more[y])
            yield pa.RecordBatch.from_arrays([*(pa.array(odd[side]) for side in (x, y) for odd in (found.odd1, found.odd2)), more], ["x1", "x2", "y1", "y2", "more"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, last = 0, -1
        for batch in batches:
            for part, entries in zip(batch.column("part").to_pylist(), batch.column("entries"), strict=True):
                if part != last and size >= _TOGETHER:
                    yield from rows(held)
                    held, size = [], 0
                last = part
                held.append(np.frombuffer(entries.as_py(), np.int64).reshape(5, -1))
                size += held[-1].shape[1]
        if held:
            yield from rows(held)

    return together.mapInArrow(compared, "x1 long, x2 long, y1 long, y2 long, more long")


def _bitmap(numbers: DataFrame) -> np.ndarray:
    """Bits of the numbers (one column)."""
    bit = F.pmod(F.col(numbers.columns[0]), F.lit(1 << BITMAP_BITS))
    words = numbers.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    found, out = words.toArrow(), np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _held(bitmap: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    bits = numbers.view(np.uint64) & np.uint64((1 << BITMAP_BITS) - 1)
    return (bitmap[(bits >> np.uint64(6)).astype(np.int64)] >> (bits & np.uint64(63))) & np.uint64(1) > 0


def _number_of(key: Column) -> Column:
    """The first eight bytes of a digest as a number."""
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long")


def _numbers(keys: bytes) -> np.ndarray:
    """The same of many digests."""
    return np.frombuffer(keys, ">i8")[::2].astype(np.int64)


def _sets(texts: DataFrame, levels: np.ndarray, wanted: DataFrame) -> DataFrame:
    """(odd1, odd2, key, first, words) of wanted sets (odd1, odd2, key, first); their words are read again where they
    first occur."""
    spark, kind = texts.sparkSession, texts.schema["doc"].dataType.simpleString()
    shared = spark.sparkContext.broadcast((levels, _bitmap(wanted.select("first.dh")), _bitmap(wanted.select(_number_of(F.col("key")).alias("number")))))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, texts_held, sets_held = shared.value
        for batch in batches:
            batch = batch.filter(pa.array(_held(texts_held, batch.column("dh").to_numpy())))
            for lines in lines_of(_texts(batch), levels):
                keys = _keys(lines)
                take = _held(sets_held, _numbers(keys.tobytes()))
                at = pa.array(lines.text[take])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(at), batch.column("dh").take(at), pa.array(lines.line[take].astype(np.int32)), _binary(keys[take]),
                     _lists(lines.hashes[np.repeat(take, lines.size)], lines.size[take])],
                    ["doc", "dh", "line", "key", "words"])

    read = texts.mapInArrow(found, f"doc {kind}, dh long, line int, key binary, words array<long>")
    here = F.struct("doc", "dh", "line").eqNullSafe(F.col("first"))
    return read.join(wanted, "key").filter(here).dropDuplicates(["key"]).select(*_BOTH, "key", "first", "words")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, odd1, odd2) of sets that match an earlier one."""
    x, y = (sets.select(*(F.col(f"odd{k}").alias(f"{s}{k}") for k in (1, 2)), *(F.col(c).alias(f"{s}_{c}") for c in ("key", "words", "first"))) for s in "xy")
    both = pairs.select("x1", "x2", "y1", "y2").join(x, ["x1", "x2"]).join(y, ["y1", "y2"]).filter((F.col("x_key") != F.col("y_key")) & (F.col("x_first") < F.col("y_first")))
    shared = F.size(F.array_intersect("x_words", "y_words"))
    close = both.filter(9 * shared >= 4 * (F.size("x_words") + F.size("y_words")))
    return close.select(F.col("y_key").alias("key"), F.col("y1").alias("odd1"), F.col("y2").alias("odd2")).distinct()


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, dh, gone): for each document that loses lines, their places from 0. dh is xxhash64 of the text."""
    texts = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("dh"), F.col(text).cast("binary").alias("text"))
    levels = word_levels(texts)
    lines = stored(line_sets(texts, levels))
    place = F.struct("doc", "dh", "line")
    firsts = stored(lines.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), *(F.min(c).alias(c) for c in _BOTH)))
    # Sets that share all parity bits meet here; most parities stand for one set.
    shared = firsts.groupBy(*_BOTH).agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    twins = shared.select(*(F.col(f"odd{k}").alias(f"{s}{k}") for s in "xy" for k in (1, 2)))

    def matched(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("x1").alias("odd1"), F.col("x2").alias("odd2")).union(pairs.select("y1", "y2")).distinct()
        return stored(_verified(pairs, stored(_sets(texts, levels, stored(firsts.join(ids, [*_BOTH]).select(*_BOTH, "key", "first"))))))

    both = ["x1", "x2", "y1", "y2"]
    met = stored(candidates(lines))
    pairs = stored(met.select(*both).distinct().union(twins))
    flagged = matched(pairs)
    # A pair of parities can stand for several sets; those of them that found no match stay open.
    more = met.filter("more IS NOT NULL").select(F.col("y1").alias("odd1"), F.col("y2").alias("odd2"), F.col("more").alias("word")).distinct()
    failed = stored(firsts.join(more, [*_BOTH]).join(flagged.select("key"), "key", "left_anti").select("key", "word"))
    if not failed.isEmpty():
        others = stored(candidates(lines, failed).select(*both).distinct().join(pairs, both, "left_anti"))
        flagged = flagged if others.isEmpty() else flagged.union(matched(others))
    marked = firsts.join(flagged.select("key", F.lit(True).alias("near")).distinct(), "key", "left").filter("n > 1 OR near")
    marked = stored(marked.select("key", "first", F.coalesce("near", F.lit(False)).alias("near")))
    gone = lines.select("key", "doc", "dh", "line").join(marked, "key").filter(F.col("near") | ~place.eqNullSafe(F.col("first")))
    return gone.groupBy("doc", "dh").agg(F.collect_set("line").alias("gone"))


def _cut(texts: pa.Array, gone: pa.Array) -> pa.Array:
    out = []
    for text, places in zip(texts.to_pylist(), gone.to_pylist(), strict=True):
        drop = set(places)
        out.append("\n".join(line for k, line in enumerate(text.split("\n")) if k not in drop))
    return pa.array(out, pa.string())


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, text, gone): for each row of docs, the row as a struct, its text without the lines that match earlier
    ones, and the places of these lines (null if there are none)."""
    with temporary(docs.sparkSession):
        gone = stored(removals(docs, doc_id, text), keep=True)
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("own_id"), F.col(text).alias("whole"), F.xxhash64(text).alias("own_dh"))
    joined = rows.join(gone, rows.own_id.eqNullSafe(gone.doc) & (rows.own_dh == gone.dh), "left")
    cut = F.when(F.col("gone").isNull(), F.col("whole")).otherwise(F.arrow_udf(_cut, "string")(F.coalesce("whole", F.lit("")), F.coalesce("gone", F.array().cast("array<int>"))))
    return joined.select("row", cut.alias("text"), "gone")
