"""Language-model scores of whole texts: a hidden Markov model over words.

Words of a text (A-Z in lower case) are followed by one end token. Counts of all training tokens make the base model,
add-one smoothed single words. The hidden Markov model has STATES states; its symbols are the HOT most frequent tokens
and one class for each kind of the others (by length and last character). Within a class, a word has its base
probability divided by the class's, so the model gives every text a probability.

Training is Baum-Welch. A bounded sample of SEED_DOCS documents sets the start in one task; then ROUNDS passes over
all training texts collect expected counts in every task, which are added by symbol in a shuffle. Only the model
itself, (HOT + classes) * STATES numbers, reaches the driver and is broadcast. Training and scoring run the recursions
over whole texts, training in segments of SEGMENT tokens, so that its memory for a very long text stays bounded.

Counts of tokens outside the HOT ones are joined by shuffle, each document's own such tokens with the counts of the
corpus, so nothing that grows with the vocabulary is broadcast.

Null and empty texts are one end token. Repeated rows count as often as they occur and get equal scores. A null doc_id
counts as an empty one. Without training rows every token is unknown: both scores are 0 for known mass of one. An
empty table gives an empty result. Extra columns are left out.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import least_places, stored

STATES = 8
HOT = 50_000
#: Tokens of a text whose states are kept at once.
SEGMENT = 4_096
SEED_DOCS, SEED_ROUNDS, ROUNDS = 1_500, 12, 2
#: Weight of the base model in each state's words, as a part of the state's tokens and in tokens.
BASE_SHARE, PRIOR = 0.2, 50.0
END = b"\n"
LENGTHS = 16
CLASSES = 2 * (LENGTHS + 1)
COUNTED_AT_ONCE = 1 << 19
#: Tokens that run through a recursion side by side.
_ABREAST = 1 << 19
_ONES = np.ones((STATES, 1), np.float32)


def word_class(word: bytes) -> int:
    return 2 * min(len(word), LENGTHS) + (word[-1:] in (b".", b","))


def class_of(token: Column) -> Column:
    """word_class of a column of binary tokens."""
    last = F.substring(token, -1, 1)
    return 2 * F.least(F.octet_length(token), F.lit(LENGTHS)) + F.when(last.isin(bytearray(b"."), bytearray(b",")), 1).otherwise(0)


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, c) over all rows of texts (binary column `text`); added up in the tasks first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(text.as_py().lower().split())
                counts[END] += 1
                if len(counts) > COUNTED_AT_ONCE:
                    yield packed(counts)
                    counts.clear()
        yield packed(counts)

    def packed(counts: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["token", "n"])

    return texts.select("text").mapInArrow(counted, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


class Symbols(dict):
    """Symbol by hot token; other tokens have their class's."""

    def __init__(self, hot: list[bytes]) -> None:
        super().__init__({token: i for i, token in enumerate(hot)})
        self.n = len(hot)

    def __missing__(self, word: bytes) -> int:
        return self.n + word_class(word)


class Hmm:
    """Start (STATES), moves (STATES x STATES) and words (symbols x STATES, each column a distribution)."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, words: np.ndarray) -> None:
        self.start, self.moves, self.words = start.astype(np.float32), moves.astype(np.float32), words.astype(np.float32)

    @classmethod
    def first(cls, base: np.ndarray) -> Hmm:
        """States that keep to themselves, with words tilted at random (by a fixed seed)."""
        rng = np.random.default_rng(11)
        words = base[:, None] * rng.uniform(0.2, 1.8, (len(base), STATES))
        moves = np.full((STATES, STATES), 0.3 / STATES) + 0.7 * np.eye(STATES)
        return cls(np.full(STATES, 1 / STATES), moves, words / words.sum(0))

    @classmethod
    def of_counts(cls, start: np.ndarray, moves: np.ndarray, words: np.ndarray, base: np.ndarray) -> Hmm:
        words = words + (BASE_SHARE * words.sum(0) + PRIOR) * base[:, None]
        return cls((start + 1) / (start + 1).sum(), (moves + 0.1) / (moves + 0.1).sum(1, keepdims=True), words / words.sum(0))

    def log10_forward(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each whole sequence of symbols. Longest first, so that the running ones are in front."""
        lengths = np.array([len(t) for t in texts])
        out, order = np.zeros(len(texts)), np.argsort(-lengths, kind="stable")
        for group in _groups(lengths, order):
            table, running = _side_by_side([texts[i] for i in group]), lengths[group]
            alive = np.searchsorted(-running, -np.arange(len(table)), "left")
            logs, state = np.zeros(len(group)), None
            for t, n in enumerate(alive):
                state, total = self._step(state, self.words[table[t, :n]])
                logs[:n] += np.log10(total[:, 0], dtype=np.float64)
            out[group] = logs
        return out

    def expect(self, texts: list[np.ndarray], start: np.ndarray, moves: np.ndarray, words: np.ndarray) -> None:
        """Adds the expected counts of these whole sequences. The forward pass keeps the states between segments; from
        the last segment on, each is run again with all its states kept, followed by its backward pass."""
        lengths = np.array([len(t) for t in texts])
        for group in _groups(lengths, np.argsort(-lengths, kind="stable")):
            table, running = _side_by_side([texts[i] for i in group]), lengths[group]
            alive = np.searchsorted(-running, -np.arange(len(table)), "left")
            segments = range(0, len(table), SEGMENT)
            before: list[np.ndarray | None] = [None]
            for a in segments[:-1]:
                state = before[-1]
                for t in range(a, a + SEGMENT):
                    state, _ = self._step(state, self.words[table[t, : alive[t]]])
                before.append(state)
            back, ahead = np.ones((len(group), STATES), np.float32), np.zeros((0, STATES), np.float32)
            for a, state in zip(reversed(segments), reversed(before), strict=True):
                sizes = alive[a : a + SEGMENT]
                symbols = np.concatenate([row[:n] for row, n in zip(table[a : a + SEGMENT], sizes, strict=True)])
                emitted, weights, states = self.words[symbols], np.empty((len(symbols), STATES), np.float32), []
                at = np.cumsum(np.r_[0, sizes]).tolist()
                for here, end in itertools.pairwise(at):
                    state, total = self._step(state, emitted[here:end])
                    states.append((state, total))
                for (state, total), (here, end) in zip(reversed(states), reversed([*itertools.pairwise(at)]), strict=True):
                    if more := len(ahead):
                        moves += (state[:more].T @ ahead) * self.moves
                        np.matmul(ahead, self.moves.T, out=back[:more])
                    np.multiply(state, back[: len(state)], out=weights[here:end])
                    ahead = emitted[here:end] * back[: len(state)]
                    ahead /= total
                if a == 0:
                    start += weights[: sizes[0]].sum(0)
                for s in range(STATES):
                    words[:, s] += np.bincount(symbols, weights[:, s], len(words))

    def _step(self, state: np.ndarray | None, emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The scaled states after one more symbol of each running sequence, and the scales; None is the start."""
        state = (self.start if state is None else state[: len(emitted)] @ self.moves) * emitted
        total = state @ _ONES
        state /= total
        return state, total


def _groups(lengths: np.ndarray, order: np.ndarray) -> Iterator[np.ndarray]:
    """Stretches of the order whose longest member times their number is bounded; one member at least."""
    at = 0
    while at < len(order):
        n = max(1, _ABREAST // max(1, int(lengths[order[at]])))
        yield order[at : at + n]
        at += n


def _side_by_side(texts: list[np.ndarray]) -> np.ndarray:
    table = np.zeros((max(map(len, texts)), len(texts)), np.int32)
    for i, text in enumerate(texts):
        table[: len(text), i] = text
    return table


def _symbols(text: bytes, symbols: Symbols) -> np.ndarray:
    words = text.lower().split()
    words.append(END)
    return np.fromiter(map(symbols.__getitem__, words), np.int32, len(words))


class Model:
    """Counts of the corpus (stored, by token), the hot tokens and the hidden Markov model."""

    def __init__(self, counts: DataFrame, tokens: int, kinds: int, hot: dict[bytes, int], classes: np.ndarray, hmm: Hmm) -> None:
        self.counts, self.tokens, self.kinds, self.hot, self.classes, self.hmm = counts, tokens, kinds, hot, classes, hmm

    @classmethod
    def fit(cls, texts: DataFrame) -> Model:
        """texts: the training rows, with a column `text`."""
        plain = texts.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
        counts = stored(token_counts(plain))
        total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
        n, v = total.n or 0, total.v
        top = counts.orderBy(F.col("c").desc(), "token").limit(HOT).collect()
        hot = {bytes(r.token): r.c for r in top}
        by_class = counts.groupBy(class_of(F.col("token")).alias("k")).agg(F.sum(F.col("c") + 1).alias("w")).collect()
        mass = np.ones(CLASSES)
        for row in by_class:
            mass[row.k] += row.w
        for token, c in hot.items():
            mass[word_class(token)] -= c + 1
        classes = mass / (n + v + 1)
        base = np.concatenate([[(c + 1) / (n + v + 1) for c in hot.values()], classes])
        hmm = Hmm.first(base / base.sum())
        if n:
            texts_read = counts.filter(F.col("token") == F.lit(END)).first().c
            seeds = least_places(plain.withColumn("place", F.xxhash64("text")), "place", texts_read, SEED_DOCS).select("text")
            hmm = _trained(seeds.repartition(1), hot, base / base.sum(), hmm, SEED_ROUNDS)
            for _ in range(ROUNDS):
                hmm = _trained(plain, hot, base / base.sum(), hmm, 1)
        return cls(counts, n, v, hot, classes, hmm)

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_tokens, n_known, base_score and score of every row of docs."""
        n, v, spark = self.tokens, self.kinds, docs.sparkSession
        symbols = Symbols([*self.hot])
        logs = np.array([math.log10((c + 1) / (n + v + 1)) for c in self.hot.values()] + [0.0] * CLASSES)
        within = -np.log10(self.classes)
        shared = spark.sparkContext.broadcast((symbols, logs, within, self.hmm))

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            symbols, logs, within, hmm = shared.value
            row = TaskContext.get().partitionId() << 33
            for batch in batches:
                found = [_symbols(t.as_py(), symbols) for t in batch.column("text")]
                rest = [[w for w in t.as_py().lower().split() if w not in symbols] for t in batch.column("text")]
                hidden = hmm.log10_forward(found) if found else np.zeros(0)
                hidden += [within[f[f >= symbols.n] - symbols.n].sum() for f in found]
                known = [int((f < symbols.n).sum()) for f in found]
                values = [np.arange(row, row + len(found)), [len(f) for f in found], known, [logs[f].sum() for f in found], hidden]
                row += len(found)
                columns = [pa.array(x, k) for x, k in zip(values, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(rest, pa.list_(pa.binary()))],
                                                 ["doc_id", "row", "n_tokens", "n_hot", "base", "hidden", "rest"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        given = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
        first = stored(given.mapInArrow(scored, f"doc_id {kind}, row long, n_tokens long, n_hot long, base double, hidden double, rest array<binary>"))
        rare = first.select("row", F.explode("rest").alias("token")).join(self.counts, "token", "left")
        log = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(n + v + 1)))
        sums = rare.groupBy("row").agg(F.sum(log).alias("more"), F.count("c").alias("n_rare"))
        more = F.coalesce("more", F.lit(0.0))
        return first.drop("rest").join(sums, "row", "left").select(
            "doc_id", "n_tokens", (F.col("n_hot") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
            (F.col("base") + more).alias("base_score"), (F.col("hidden") + more).alias("score"),
        )


def _trained(texts: DataFrame, hot: dict[bytes, int], base: np.ndarray, hmm: Hmm, rounds: int) -> Hmm:
    """Baum-Welch over texts. More than one round only where all texts are in one task."""
    size, spark = len(base), texts.sparkSession
    shared = spark.sparkContext.broadcast((Symbols([*hot]), base, hmm))

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, base, model = shared.value

        whole = ([_symbols(t.as_py(), symbols) for t in batch.column(0)] for batch in batches)
        parts = list(whole) if rounds > 1 else whole
        for left in range(rounds, 0, -1):
            start, moves, words = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((size, STATES))
            for part in parts:
                model.expect(part, start, moves, words)
            if left > 1:
                model = Hmm.of_counts(start, moves, words, base)
        rows = np.vstack([words, moves, start])  # the last rows are the states'
        held = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), *(pa.array(rows[held, s]) for s in range(STATES))],
                                         ["k", *(f"s{s}" for s in range(STATES))])

    names = [f"s{s}" for s in range(STATES)]
    counted = texts.mapInArrow(expected, "k int, " + ", ".join(f"{x} double" for x in names)).groupBy("k").agg(*(F.sum(x).alias(x) for x in names))
    rows = np.zeros((size + STATES + 1, STATES))
    for row in counted.collect():  # HOT + CLASSES + STATES + 1 rows at most
        rows[row.k] = row[1:]
    return Hmm.of_counts(rows[-1], rows[size:-1], rows[:size], base)
