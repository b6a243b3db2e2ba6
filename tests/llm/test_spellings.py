import random
import re
import zlib
from collections import Counter

import pytest

from plumbline.llm import queries, spellings


def slow_words(rows, change=True):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if change and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_groups(words, times=10):
    """All pairs of words, compared letter by letter."""
    near = {w: [] for w in words}
    order = sorted(words)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if abs(len(a) - len(b)) <= 1 and is_near(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= times * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_query_against_all_pairs(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    words = dict(sorted(slow_words(rows).items(), key=lambda x: (-x[1], x[0])))
    have = got(queries.op12_spelling_groups(spark, sf))
    assert {r[0]: r[3] for r in have} == words
    some = set(list(words)[::7]) | {w for r in have if r[4] for w in (r[0], r[1] or r[0])}
    assert [r[0] for r in have if r[1]], "no variants in the data"
    sub = {w: n for w, n in words.items() if w in some}
    assert [r for r in slow_groups(sub) if r[4]] == [r for r in have if r[4]]


@pytest.mark.parametrize("block", [4096, 6])
def test_random_words_against_all_pairs(spark, monkeypatch, block):
    """Few letters, so that many words are near, and groups that are split into blocks."""
    monkeypatch.setattr(spellings, "BLOCK", block)
    monkeypatch.setattr(spellings, "_INDEX", 16)
    rng = random.Random(3)
    words = {}
    for _ in range(500):
        word = "".join(rng.choice("aéb") for _ in range(rng.randint(7, 10)))
        words[word] = rng.choice([2, 3, 19, 20, 21, 200, 2000, 20_000])
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    near = {r.word: (r.n_near, r.best if r.best_n >= 10 * words[r.word] else None) for r in spellings.near_words(df).collect()}
    want = slow_groups(words)
    assert near == {w: (n, near[w][1]) for w, _, _, _, n, _ in want if n}
    assert {w: near.get(w, (0, None))[1] for w in words} == {r[0]: r[1] for r in want}


def test_chains_ties_and_edges(spark):
    text = " ".join(["standard"] * 300 + ["standart"] * 25 + ["standat"] * 2 + ["Größenn"] * 2 + ["GRößenm"] * 2 + ["größen×m"] * 2 + ["abcdefg"] * 20 + ["abcdefh"] * 20 + ["abcdefi"] * 2 + ["long" * 3000] * 2 + ["long" * 3000 + "s"] * 2)
    rows = [(1, text), (1, "hidden"), (2, None), (None, "nothing nothing short"), (3, "")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    plain = slow_words(rows, change=False)
    assert got(spellings.group(docs)) == slow_groups(plain)
    assert got(spellings.group(docs, spellings.marked)) == slow_groups(slow_words(rows))
    roots = {r[0]: r[2] for r in got(spellings.group(docs))}
    assert roots["standat"] == "standard" and roots["abcdefi"] == "abcdefg"


def test_empty_tables(empty_docs):
    assert spellings.group(empty_docs).count() == 0
