"""Toxicity, quality rules and language-model scores."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import lm, quality, queries, toxicity

WORDS = "the of and on in by with this that house river stone green light water under over people".split()


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def made(seed, n=300):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randint(55, 120))
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["Scumbag,", "scumbags", "vermin"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 7 != 0), int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def labels_of(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(make_docs, labels_of):
    rows, labels = made(3)
    docs = make_docs(rows)
    model = toxicity.Model.fit(docs, labels_of(labels), teaches=~toxicity.held_out(F.col("doc_id"), 5, 0))
    truth = {d: t for d, _, t in labels}
    got = {r.doc_id: r.score for r in model.score(docs).collect() if crc(r.doc_id) % 5 == 0}
    assert sum((s >= 0.5) == bool(truth[d]) for d, s in got.items()) >= 0.97 * len(got)
    assert 0 < len(model.weights) < 2_000


def slow_features(text):
    """The features of a text, word by word."""
    mask, hashed = (1 << 64) - 1, lambda part, seed=0: int.from_bytes(xxhash.xxh64_digest(part, seed), "little")
    odd, top = [int(x) for x in toxicity._ODD], lambda h: (h & ((1 << 64) - 1)) >> (64 - toxicity.HASH_BITS)
    words = [w.strip(toxicity._EDGES) for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()]
    one = [hashed(w) * odd[0] & mask for w in words]
    out = set()
    for i, h in enumerate(one):
        if i + 1 < len(one):
            pair = (h * odd[1] + one[i + 1]) & mask
            out.add(top(pair * odd[2]))
            if i + 2 < len(one):
                out |= {top((h * odd[2] + one[i + 2]) * odd[3]), top((pair * odd[3] + one[i + 2]) * odd[1])}
    for k, n in enumerate((None, *toxicity._STEMS)):
        singles = Counter(top((hashed(w[:n], n) if n else hashed(w)) * odd[k]) for w in words)
        out |= {f ^ m for f, c in singles.items() for least, m in toxicity._TIMES.items() if c >= least}
    return out


def slow_ftrl(examples):
    """FTRL-proximal, coordinate by coordinate; the intercept has no L1 penalty."""
    z, n = Counter(), Counter()

    def weight(i):
        penalty = 0.0 if i == toxicity.INTERCEPT else toxicity.L1
        return 0.0 if abs(z[i]) <= penalty else (math.copysign(penalty, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for features, label in examples:
            own = {i: weight(i) for i in (*features, toxicity.INTERCEPT)}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(own.values()))))) - label
            for i, w in own.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w
                n[i] += g * g
    return {i: w for i in z if (w := weight(i)) or i == toxicity.INTERCEPT}


def test_toxicity_against_a_slow_model(make_docs, labels_of):
    rows, labels = made(5, 120)
    rows = [(d, f"{t} Say, \"{t[:40]}\" ({'so ' * (d % 6)})" if d % 7 else "\u00c9 a" * (d % 3)) for d, t in rows]
    docs, truth = make_docs(rows), {d: t for d, _, t in labels}
    batch = pa.RecordBatch.from_pydict({"text": [t.encode() for _, t in rows], "label": [0] * len(rows), "place": [d for d, _ in rows]})
    found = {d: x for part in toxicity._featured(iter([batch])) for d, x in zip(part["place"].to_pylist(), part["features"].to_pylist(), strict=True)}
    assert {d: set(x) for d, x in found.items()} == {d: slow_features(t) for d, t in rows} and all(len(x) == len(set(x)) for x in found.values())
    order = {r.doc_id: r.place for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("place")).collect()}
    texts = dict(rows)
    want = slow_ftrl([(slow_features(texts[d]), truth[d]) for d in sorted((d for d in order if d in truth), key=order.get)])
    model = toxicity.Model.fit(docs, labels_of(labels))
    assert model.weights == pytest.approx(want, rel=1e-6, abs=1e-9)
    for r in model.score(docs).collect():
        total = want[toxicity.INTERCEPT] + sum(want.get(i, 0.0) for i in slow_features(r.text))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-5)


def test_toxicity_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op6_toxicity(spark, sf).collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    apart = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, t in apart) >= 0.9 * len(apart)


def test_toxicity_edge_cases(edge_docs, empty_docs, labels_of):
    labels = labels_of([(1, 1, 1), (1, 1, 1), (3, 0, 0), (5, None, None), (None, 1, 1), (99, 1, 1)])
    model = toxicity.Model.fit(edge_docs, labels)
    scored = model.score(edge_docs).collect()
    assert len(scored) == edge_docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if not (r.text or "").strip()}) == 1
    assert model.score(empty_docs).count() == 0
    untaught = toxicity.Model.fit(edge_docs, labels_of([]))
    assert all(r.score < 1e-12 for r in untaught.score(edge_docs).collect())


def slow_counts(text):
    words = "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ")
    words = [w for w in words if w]
    lines = [line for line in (text or "").split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in line)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_quality_query(spark, sf):
    rows = {r.doc_id: r for r in queries.op7_quality_rules(spark, sf).collect()}
    for doc in spark.read.parquet(f"{sf}/documents.parquet").collect():
        r, want = rows[doc.doc_id], slow_counts(doc.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.Rules.fit(docs, labels, teaches=~toxicity.held_out(F.col("doc_id"), 5, 0))
    scored = {r.doc_id: r.quality for r in rules.score(quality.statistics(docs.select("doc_id", "text"))).collect()}
    apart = [(scored[r.doc_id] >= 0.5, bool(r.quality)) for r in labels.collect() if crc(r.doc_id) % 5 == 0]
    assert sum(p == t for p, t in apart) >= 0.95 * len(apart)


def test_forest_falls_where_it_must():
    rng = np.random.default_rng(1)
    rows = rng.random((800, len(quality.FEATURES)))
    at = quality.FEATURES.index("repeats")
    labels = (rows[:, at] + rng.normal(0, 0.4, 800) > 0.5).astype(float)  # the data rise, the score must not
    forest = quality.fit_forest(rows, labels)
    for row in rows[:20]:
        ladder = np.tile(row, (50, 1))
        ladder[:, at] = np.linspace(0, 1, 50)
        assert (np.diff(forest.margin(ladder)) <= 1e-12).all()
    free = quality.fit_forest(rows, labels, falling=())
    assert ((free.margin(rows) > 0) == labels).mean() > 0.8


def test_quality_edge_cases(edge_docs, empty_docs, labels_of):
    rules = quality.Rules.fit(edge_docs, labels_of([]))
    rows = rules.score(quality.statistics(edge_docs)).collect()
    for r in rows:
        assert (r.counts.n_words, r.counts.word_chars, r.counts.n_symbols, r.counts.n_dup_lines, r.counts.n_repeat_words) == slow_counts(r.text)
        assert r.quality > 0.99
    assert rules.score(quality.statistics(empty_docs)).count() == 0


def slow_base(rows, train):
    tokens = lambda text: [*"".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split(), b"\n"]
    counts = Counter(t for text in train for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for text in rows:
        own = tokens(text)
        out.append((len(own), sum(counts[t] > 0 for t in own), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)))
    return out


def slow_forward(hmm, symbols):
    state, log = hmm.start.astype(float), 0.0
    for k, s in enumerate(symbols):
        state = (state if k == 0 else state @ hmm.moves.astype(float)) * hmm.words[s].astype(float)
        log += math.log10(state.sum())
        state /= state.sum()
    return log


@pytest.mark.parametrize("hot", [40, 50_000])
def test_lm_query(spark, sf, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT", hot)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = dict(zip(docs, slow_base(docs.values(), [t for d, t in docs.items() if crc(d) % 7 != 2]), strict=True))
    rows = queries.op10_lm_scoring(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3])
        assert r.held_out == (crc(r.doc_id) % 7 == 2)
    if hot > 100:
        apart = [r for r in rows if r.held_out]
        assert sum(r.score for r in apart) > sum(r.base_score for r in apart)


def test_lm_forward_and_counts():
    rng = np.random.default_rng(2)
    base = rng.random(30)
    hmm = lm.Hmm.first(base / base.sum())
    texts = [rng.integers(0, 30, n).astype(np.int32) for n in (1, 7, 40, 3, 7)]
    assert hmm.log10_forward(texts) == pytest.approx([slow_forward(hmm, t) for t in texts], abs=1e-3)
    sums = []
    for _ in range(4):
        start, moves, words = np.zeros(lm.STATES), np.zeros((lm.STATES, lm.STATES)), np.zeros((30, lm.STATES))
        hmm.expect(texts, start, moves, words)
        assert start.sum() == pytest.approx(5, rel=1e-3) and words.sum() == pytest.approx(58, rel=1e-3) and moves.sum() == pytest.approx(53, rel=1e-3)
        sums.append(hmm.log10_forward(texts).sum())
        hmm = lm.Hmm((start + 1e-9) / start.sum(), (moves + 1e-9) / (moves + 1e-9).sum(1, keepdims=True), (words + 1e-9) / words.sum(0))
    assert sums == sorted(sums)


def slow_expected(hmm, symbols):
    """Expected counts of one whole sequence from unscaled forward and backward probabilities."""
    words, moves = hmm.words.astype(float), hmm.moves.astype(float)
    ahead, back = [hmm.start.astype(float) * words[symbols[0]]], [np.ones(lm.STATES)]
    for s in symbols[1:]:
        ahead.append(ahead[-1] @ moves * words[s])
    for s in symbols[:0:-1]:
        back.append(moves @ (words[s] * back[-1]))
    back.reverse()
    whole = ahead[-1].sum()
    moved, seen = np.zeros_like(moves), np.zeros_like(words)
    for k, s in enumerate(symbols):
        seen[s] += ahead[k] * back[k] / whole
        if k:
            moved += np.outer(ahead[k - 1], words[s] * back[k]) * moves / whole
    return ahead[0] * back[0] / whole, moved, seen


@pytest.mark.parametrize("segment, abreast", [(4096, 1 << 19), (7, 40), (1, 1), (64, 100)])
def test_lm_expected_counts_of_whole_texts(monkeypatch, segment, abreast):
    monkeypatch.setattr(lm, "SEGMENT", segment)
    monkeypatch.setattr(lm, "_ABREAST", abreast)
    rng = np.random.default_rng(4)
    base = rng.random(20)
    hmm = lm.Hmm.first(base / base.sum())
    texts = [rng.integers(0, 20, n).astype(np.int32) for n in (1, 2, 7, 8, 64, 65, 100, 7)]
    got = np.zeros(lm.STATES), np.zeros((lm.STATES, lm.STATES)), np.zeros((20, lm.STATES))
    hmm.expect(texts, *got)
    for found, want in zip(got, zip(*(slow_expected(hmm, t) for t in texts), strict=True), strict=True):
        np.testing.assert_allclose(found, sum(want), rtol=1e-3, atol=1e-4)
    empty = np.zeros(lm.STATES), np.zeros((lm.STATES, lm.STATES)), np.zeros((20, lm.STATES))
    hmm.expect([], *empty)
    assert not any(x.any() for x in empty)


def test_lm_gives_probabilities_that_add_up(spark, make_docs, monkeypatch):
    """Over all one-word texts of known words and one unknown, plus the empty text and longer ones, mass is at most 1."""
    monkeypatch.setattr(lm, "HOT", 5)
    train = make_docs([(i, " ".join(random.Random(i).choices(WORDS, k=6))) for i in range(50)])
    model = lm.Model.fit(train)
    texts = [(k, w) for k, w in enumerate([*WORDS, "unheard", ""])]
    mass = sum(10 ** r.score for r in model.score(make_docs(texts)).collect())
    assert 0 < mass < 1


def test_lm_edge_cases(edge_docs, empty_docs):
    for train in (edge_docs, empty_docs):
        rows = lm.Model.fit(train).score(edge_docs).collect()
        texts = [r.text for r in edge_docs.collect()]
        want = slow_base(texts, [r.text for r in train.collect()])
        assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == sorted((n, k, round(s, 6)) for n, k, _, s in want)
    assert lm.Model.fit(edge_docs).score(empty_docs).count() == 0
