"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features: for each text the set of its words, pairs, triples and pairs that skip one word, hashed to 2**HASH_BITS
numbers. Words are in lower case (A-Z) without punctuation at their ends. Insults are inflected, so the leading bytes
of words count as stems, and words and stems that occur twice or four times have features of their own. Nothing else
enters a score.

Training: a bounded sample of SAMPLE labelled documents at most, the first in the order of a hash of the id. Their
features are found in all tasks; one task holds them, four bytes each, and goes over them EPOCHS times. Every coordinate has its own learning rate, and the L1 penalty leaves few weights
other than zero; these (2**HASH_BITS at most, so the broadcast is bounded) score all whole texts.

Very long texts are scored whole. Null and empty texts have no features and get the score of the intercept. A label is the rounded mean of the rows of
its doc_id; rows without doc_id or label teach nothing. Documents that share a doc_id teach with the least of their
texts. Without training rows every score is 0. Repeated rows get equal scores, an empty table an empty result; other
columns stay, but one with the name of the score is replaced.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import least_places, stored

HASH_BITS = 20
SAMPLE = 8_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.2, 1.0, 8.0, 0.5
INTERCEPT = -1
#: The intercept when there is nothing to learn from.
UNTAUGHT = -40.0
KEPT_WORDS = 1 << 16
_STRETCH = 1 << 15
_EDGES = b".,;:!?\"'()[]{}"
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


#: Leading bytes of a word that stand for its stem.
_STEMS = (5, 6, 7)
#: A word or stem has a feature of its own from each of these numbers of occurrences on; their hashes differ by a mask.
_TIMES = {1: 0, 2: 0x5A5A5 & ((1 << HASH_BITS) - 1), 4: 0xC3C3C & ((1 << HASH_BITS) - 1)}
_ALL = (1 << HASH_BITS) - 1


class _WordHashes(dict):
    """Packed hashes of a word and its stems; emptied when full."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        bare = word.strip(_EDGES)
        forms = [xxhash.xxh64_digest(bare), *(xxhash.xxh64_digest(bare[:n], n) for n in _STEMS)]
        self[word] = packed = b"".join(forms)
        return packed


_hashes = _WordHashes()


def features(texts: Iterator[bytes], weighty: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For stretches of texts, their number and the distinct (place of the text << HASH_BITS | feature), sorted.
    weighty: only features for which this is true."""
    words: list[bytes] = []
    counts: list[int] = []
    for text in texts:
        own = text.lower().split()
        words += own
        counts.append(len(own))
        if len(words) >= _STRETCH:
            yield len(counts), _features(words, counts, weighty)
            words, counts = [], []
    if counts:
        yield len(counts), _features(words, counts, weighty)


def _features(words: list[bytes], counts: list[int], weighty: np.ndarray | None) -> np.ndarray:
    hashes = np.frombuffer(b"".join(map(_hashes.__getitem__, words)), np.uint64).reshape(len(words), 1 + len(_STEMS))
    text, shift = np.repeat(np.arange(len(counts)), counts), np.uint64(64 - HASH_BITS)
    if not len(words):
        return np.zeros(0, np.int64)

    def coded(hashed: np.ndarray, at: np.ndarray, use: np.ndarray | None) -> np.ndarray:
        found = (hashed >> shift).astype(np.int64)
        if use is not None:
            found, at = found[kept := use[found]], at[kept]
        return at << HASH_BITS | found

    one = hashes[:, 0] * _ODD[0]
    pair, skip = one[:-1] * _ODD[1] + one[1:], one[:-2] * _ODD[2] + one[2:]
    triple = pair[:-1] * _ODD[3] + one[2:]
    grams = []
    for hashed, reach in ((pair * _ODD[2], 1), (skip * _ODD[3], 2), (triple * _ODD[1], 2)):
        same = text[: len(hashed)] == text[len(text) - len(hashed) :]
        grams.append(coded(hashed[same], text[: len(hashed)][same], weighty))
    any_times = None if weighty is None else np.any([weighty[np.arange(_ALL + 1) ^ mask] for mask in _TIMES.values()], axis=0)
    for form in range(1 + len(_STEMS)):
        single, times = np.unique(coded(hashes[:, form] * _ODD[form], text, any_times), return_counts=True)
        for least, mask in _TIMES.items():
            often = single[times >= least] ^ mask
            grams.append(often if weighty is None else often[weighty[often & _ALL]])
    return np.unique(np.concatenate(grams))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(features, label, place) of rows (text, label, place), some texts at a time."""
    for batch in batches:
        done = 0
        for n, both in features(t.as_py() for t in batch.column("text")):
            ends = np.searchsorted(both, np.arange(n + 1) << HASH_BITS).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(ends), pa.array((both & _ALL).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([sets, batch.column("label").slice(done, n), batch.column("place").slice(done, n)], ["features", "label", "place"])
            done += n


def fit_ftrl(examples: list[tuple[np.ndarray, int]]) -> dict[int, float]:
    """Weights other than zero by feature; the intercept at INTERCEPT, without an L1 penalty."""
    if not examples:
        return {}
    z, n = np.zeros(1 << HASH_BITS), np.zeros(1 << HASH_BITS)
    z0 = n0 = 0.0

    def weights(z, n):
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, label in examples:
            zs, ns = z[at], n[at]
            w, w0 = weights(zs, ns), -z0 / ((BETA + n0**0.5) / ALPHA + L2)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + w0, -35, 35))) - label
            z[at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[at] = ns + g * g
            z0 += g - ((n0 + g * g) ** 0.5 - n0**0.5) / ALPHA * w0
            n0 += g * g
    w = weights(z, n)
    return {INTERCEPT: float(-z0 / ((BETA + n0**0.5) / ALPHA + L2))} | {int(i): float(w[i]) for i in np.flatnonzero(w)}


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    examples: list[tuple[np.ndarray, int]] = []
    for batch in batches:
        examples += ((x.values.to_numpy(), y) for x, y in zip(batch.column("features"), batch.column("label").to_pylist(), strict=True))
    model = fit_ftrl(examples)
    yield pa.RecordBatch.from_arrays([pa.array(model.keys(), pa.int32()), pa.array(model.values(), pa.float64())], ["feature", "weight"])


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether a row is held out: crc32 of the id's text (null: empty) modulo parts is part."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, teaches: Column) -> DataFrame:
    """(doc_id, text, label, place) of at most `most` labelled documents, in the order of a hash of the id."""
    known = labels.select("doc_id", F.col(label).alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & teaches)
    known = known.groupBy("doc_id").agg(F.round(F.avg("label")).cast("int").alias("label"))
    picked = least_places(known.withColumn("place", F.xxhash64("doc_id")), "place", known.count(), most)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")  # `most` rows of 20 bytes
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"), F.first("place").alias("place"))


class Model:
    """A fitted model: weights by feature."""

    def __init__(self, weights: dict[int, float]) -> None:
        self.weights = weights

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, teaches: Column | None = None) -> Model:
        """teaches: which rows of labels may be learnt from."""
        rows = labelled_sample(docs, labels, label, sample, F.lit(True) if teaches is None else teaches)
        examples = rows.select(F.col("text").cast("binary").alias("text"), "label", "place").mapInArrow(_featured, "features array<int>, label int, place long")
        ordered = stored(examples).repartition(1).sortWithinPartitions("place", "features")
        fitted = ordered.select("features", "label").mapInArrow(_fit, "feature int, weight double").collect()
        return cls({r.feature: r.weight for r in fitted})

    def score(self, df: DataFrame, text: str = "text", score: str = "score") -> DataFrame:
        """df with the probability (0 to 1) that a text is of the labelled kind."""
        dense = np.zeros(1 << HASH_BITS, np.float32)
        for feature, weight in self.weights.items():
            if feature != INTERCEPT:
                dense[feature] = weight
        shared, intercept = df.sparkSession.sparkContext.broadcast(dense), self.weights.get(INTERCEPT, UNTAUGHT)

        def scored(texts: pa.Array) -> pa.Array:
            weights, sums = shared.value, [np.zeros(0)]
            for n, both in features((t.as_py() for t in texts), weights != 0):
                sums.append(np.bincount(both >> HASH_BITS, weights[both & _ALL], n))
            return pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(sums) + intercept, -35, 35))))

        return df.withColumn(score, F.arrow_udf(scored, "double")(F.coalesce(F.col(text), F.lit("")).cast("binary")))
