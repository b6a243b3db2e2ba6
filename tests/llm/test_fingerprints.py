import hashlib
import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import fingerprints, queries


def edited(rows):
    """(text, edited text, next text) by id, for rows of distinct ids."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for k, (doc, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 4
        out[doc] = (text, text[: len(text) - cut] + after[:cut], after)
    return out


def test_query_against_python(spark, sf):
    want = edited([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    rows = queries.op9_fingerprints(spark, sf).collect()
    assert len(rows) == len(want)
    prints = {}
    for r in rows:
        text, changed, _ = want[r.doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert prints.setdefault(changed, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert sum(r.near_edited > r.near_next for r in rows) > 0.95 * len(rows)


def test_peeling_recovers_the_difference(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        common = [rng.getrandbits(63) for _ in range(rng.choice([0, 1, 20, 300]))]
        rows.append((k, common + [rng.getrandbits(63) for _ in range(rng.choice([0, 1, 5, 40]))], common + [rng.getrandbits(63) for _ in range(rng.choice([0, 2, 30]))]))
    df = spark.createDataFrame(rows, "k int, a array<bigint>, b array<bigint>")
    got = {r.k: r.d for r in df.select("k", fingerprints.differing(F.col("a"), F.col("b")).alias("d")).collect()}
    for k, a, b in rows:
        assert sorted(got[k]) == sorted(set(a) ^ set(b))


def test_a_sketch_of_enough_cells_needs_no_comparison(spark):
    df = spark.range(200).select(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.xxhash64(F.col("id"), i)).alias("a"))
    cells = F.lit(40)
    empty = F.array().cast("array<bigint>")
    cut = fingerprints.subtract(fingerprints.sketch(F.col("a"), cells), fingerprints.sketch(empty, cells))
    peeled = df.select("a", fingerprints.peel(cut, cells).alias("d")).collect()
    solved = [r for r in peeled if r.d is not None]
    assert len(solved) >= 190 and all(sorted(r.d) == sorted(r.a) for r in solved)


@pytest.mark.parametrize("n", [1, 2, 41])
def test_order_of_documents(spark, make_docs, n):
    rows = [((7 * i) % 43 - 20, f"text {i} " * (i % 5)) for i in range(n)]
    want = edited(rows)
    for r in fingerprints.versions(make_docs(rows)).collect():
        assert r.edited == want[r.doc_id][1]


def test_edge_cases(edge_docs, empty_docs):
    rows = fingerprints.versions(edge_docs).select("doc_id", "n_chars", fingerprints.likeness(F.col("own"), F.col("changed")).alias("near"), "edited").collect()
    assert len(rows) == edge_docs.count()
    assert sorted(r.n_chars for r in rows) == sorted(len(r.text or "") for r in edge_docs.collect())
    assert all(r.near == 1 for r in rows if r.n_chars == 0)
    assert fingerprints.versions(empty_docs).count() == 0
