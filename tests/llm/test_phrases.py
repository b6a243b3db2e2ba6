import re
from collections import Counter, defaultdict

import pytest

from plumbline.llm import phrases, queries

DOCS = "doc_id long, text string, lang string"


def slow(rows, least, longest=3, top=2000, covered=(50, 100)):
    """Phrases of (text, lang) rows by counting everything in one place."""
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            score, k, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            longer = max((n for q, n in f.items() if len(q) > len(p) and n >= least and any(q[i : i + len(p)] == p for i in range(len(q)))), default=0)
            if covered[1] * longer < covered[0] * a or not longer:
                found.append((score, a, " ".join(p), left, right))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, rank, p, a, left, right, totals[lang], score) for rank, (score, a, p, left, right) in enumerate(found[:top], 1)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("shard", [1 << 20, 300])
def test_query_against_counting_everything(spark, sf, monkeypatch, shard):
    """With one shard a task and with many: the local support falls to one."""
    monkeypatch.setattr(phrases, "_STRETCH", max(2000, shard))
    monkeypatch.setattr(phrases, "SHARD", shard)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = slow([(r.text, r.lang) for r in docs.collect()], 10)
    assert want and got(queries.op13_phrase_mining(spark, sf)) == want


def test_longer_phrases_ties_and_small_support(spark):
    text = "a b c d e. A B c d e! x y x y x y\tx  y, x; b c d e f\nnew  york city new york"
    rows = [(1, text, "en"), (1, text, "en"), (2, text, None), (3, text + " Zoë́ said zoë", "und"), (4, None, "de"), (5, "", "de"), (6, " . ,\n", None)]
    docs = spark.createDataFrame([(*r, "w", 1, "p", 2) for r in rows], DOCS + ", ws string, n int, phrase string, rank int")
    for least, longest in ((2, 3), (3, 5), (1, 2)):
        assert got(phrases.mine(docs, least, longest)) == slow([r[1:] for r in rows], least, longest)
    assert got(phrases.mine(docs, 2, 3, top=3)) == slow([r[1:] for r in rows], 2, 3, top=3)


def test_long_texts_and_words(spark, monkeypatch):
    """A text of several stretches, words of many lengths, and one of 100,000 bytes."""
    monkeypatch.setattr(phrases, "_STRETCH", 1000)
    monkeypatch.setattr(phrases, "SHARD", 500)
    words = ["q" * k for k in (1, 7, 8, 9, 63, 64, 65, 66, 100_000)] + ["é" * 40, "é" * 32]
    rows = [(1, ". ".join(" ".join(words[i % 11 : i % 11 + 3]) for i in range(2000)), "en"), (2, " ".join(words) * 2, "fr")]
    assert got(phrases.mine(spark.createDataFrame(rows, DOCS))) == slow([r[1:] for r in rows], 10)


def test_words_that_share_a_hash_take_another_seed(spark, monkeypatch):
    counted, seeds = phrases._word_counts, []

    def clashing(texts, seed):
        seeds.append(seed)
        found = counted(texts, seed)
        return found.selectExpr("lang", "7L AS key", "word", "n") if seed == 1 else found

    monkeypatch.setattr(phrases, "_word_counts", clashing)
    rows = [(1, "a b c d e f a b c d e f", "en")]
    assert got(phrases.mine(spark.createDataFrame(rows, DOCS), 2)) == slow([r[1:] for r in rows], 2)
    assert seeds == [1, 2]


def test_empty_tables(spark, empty_docs):
    assert phrases.mine(empty_docs).count() == 0
