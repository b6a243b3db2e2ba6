import contextlib
import random

import pytest

import corpus_pipeline
from plumbline.llm import shingles


def slow_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def slow_kept(rows):
    """The first id of each component of all pairs of a Jaccard similarity of 0.8 or more."""
    sets = [slow_set(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 10 * len(x & y) >= 8 * len(x | y):
                parent[root(i)] = root(j)
    least = {}
    for k, (doc, _) in enumerate(rows):
        least[root(k)] = min(doc, least.get(root(k), doc))
    return sorted(least.values())


def made(seed):
    """Texts of 1 to 300 words and copies of them with more and more words changed."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = []
    for n in [*range(1, 12), 25, 60, 100, 200, 300] * 2:
        base = [word() for _ in range(n)]
        texts.append(base)
        for changes in range(0, 1 + n // 20):
            copy = list(base)
            for k in rng.sample(range(n), min(n, changes)):
                copy[k] = word()
            texts += [copy, [*base, *(word() for _ in range(changes))]]
    rng.shuffle(texts)
    return [(k, " ".join(t).upper() if k % 5 == 0 else "  ".join(t)) for k, t in enumerate([*texts, [], []])]


@pytest.mark.parametrize("crowd", [64, 2])
def test_stage_against_all_pairs(make_docs, sf, spark, monkeypatch, crowd):
    """With lists of more than two nodes as crowded, the stars are used too."""
    monkeypatch.setattr(shingles, "CROWD", crowd)
    monkeypatch.setattr(shingles, "SHARES", 3)
    rows = made(crowd)
    want = slow_kept(rows)
    assert len(want) < 0.6 * len(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, make_docs(rows), sf).collect()) == want


def test_form_letters_form_no_pairs(make_docs, sf, spark, monkeypatch):
    """Letters that differ in one word in the middle (Jaccard 0.66) share shingles that lead in none of them."""
    words = [f"w{k}" for k in range(28)]
    rows = [(k, " ".join([*words[:13], f"name{k}", *words[14:]])) for k in range(300)]
    rows += [(300, " ".join(words)), (301, " ".join([*words, "end"]))]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, make_docs(rows), sf).collect()) == list(range(301))


def test_fingerprints_come_first(make_docs, sf, spark, monkeypatch):
    """Near copies of long texts are linked by their SimHash fingerprints; what the sets do not confirm is left alone."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(2000)]
    rows = [(0, " ".join(base)), (1, " ".join([*base, "end"])), (2, "other words here"), (3, "x y"), (4, " ".join(["start", *base]))]
    seen, pairs = [], shingles._fingerprint_pairs
    monkeypatch.setattr(shingles, "_fingerprint_pairs", lambda prints: seen.append(found := pairs(prints)) or found)
    kept = corpus_pipeline.drop_near_duplicates(spark, make_docs(rows), sf)
    monkeypatch.setattr(corpus_pipeline, "temporary", lambda spark: contextlib.nullcontext())
    again = corpus_pipeline.drop_near_duplicates(spark, make_docs(rows), sf)
    assert len(seen) == 2 and seen[1].count() >= 1
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in again.collect()) == [0, 2, 3]
