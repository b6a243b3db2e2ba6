import math
import random

import numpy as np
import pytest

from plumbline.llm import queries, vectors


def slow(rows, least=0.9):
    """All pairs, one by one."""
    def good(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(x, y):
        dot = lambda a, b: math.fsum(p * q for p, q in zip(a, b, strict=True))
        return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))

    near = {i: set() for i in range(len(rows))}
    for i, (_, x) in enumerate(rows):
        for j, (_, y) in enumerate(rows[:i]):
            if good(x) and good(y) and len(x) == len(y) and cosine(x, y) >= least:
                near[i].add(j)
                near[j].add(i)
    out, seen = [], {}
    for i in near:
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                new = near[todo.pop()] - group
                group |= new
                todo += new
            ids = [rows[k][0] for k in group if rows[k][0] is not None]
            seen.update(dict.fromkeys(group, min(ids, default=None)))
        out.append((rows[i][0], len(near[i]), seen[i]))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id").collect()), key=str)


def made(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, embedding array<{kind}>, node int, block string")


def clustered(rng, n, size, spread):
    centres = [rng.normal(size=size) for _ in range(12)]
    return [np.float32(centres[rng.integers(12)] * (i % 3 + 1) + rng.normal(size=size) * spread).tolist() for i in range(n)]


@pytest.mark.parametrize("block,fan", [(12, 3), (4, 1), (3, 2)])
def test_clusters_against_all_pairs(spark, monkeypatch, block, fan):
    """One block, and many blocks on several levels, with copies, multiples and vectors in even directions."""
    monkeypatch.setattr(vectors, "BLOCK_BITS", block)
    monkeypatch.setattr(vectors, "FAN_BITS", fan)
    rng = np.random.default_rng(5)
    found = clustered(rng, 150, 12, 0.25) + clustered(rng, 40, 12, 3.0)
    rows = [(k if k % 17 else None, found[k % 170]) for k in range(200)]
    want = slow(rows)
    assert any(r[1] > 3 for r in want) and any(not r[1] for r in want)
    assert got(vectors.near_duplicates(made(spark, rows))) == want


def test_blocks_far_apart_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_BITS", 4)
    rng = np.random.default_rng(6)
    rows = [(k, (np.eye(8)[k % 4] * 5 + rng.normal(size=8) * 0.1).tolist()) for k in range(256)]
    distinct = made(spark, rows, "double").selectExpr("embedding AS vector", "1L AS n", "vec_id AS first")
    placed = vectors._placed(distinct, 0.9)
    pairs = {(r.a, r.b) for r in vectors._block_pairs(placed, 0.9).collect()}
    assert {(k, k) for k in range(16)} <= pairs and len(pairs) <= 4 * 10 + 8 < 16 * 17 // 2
    assert got(vectors.near_duplicates(made(spark, rows, "double"))) == slow(rows)


def test_vectors_without_direction_lengths_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, nan]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [-0.0, 1.0]), (9, [0.0, 2.0]),
            (10, [3.0, 0.0]), (10, [3.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [1e300, 1e300, 0.0]), (13, [1e-300, 1e-300, 0.0]), (None, [1.0]), (None, [4.0]), (None, None),
            (14, [0.9, math.sqrt(0.19)]), (15, [0.8999999, math.sqrt(1 - 0.8999999**2)])]
    assert got(vectors.near_duplicates(made(spark, rows, "double"))) == [
        r if r[0] not in (12, 13) else (r[0], 1, 12) for r in slow([(i, [x * 1e250 if x and abs(x) < 1e-200 else x / 1e250 if x and inf > x > 1e200 else x for x in v] if v else v) for i, v in rows])]


def test_a_spanning_forest_joins_what_the_links_join():
    rng = random.Random(2)
    near = np.zeros((30, 40), bool)
    for _ in range(45):
        near[rng.randrange(30), rng.randrange(40)] = True
    nodes, parents = vectors._forest([near, near.T.copy()], (30, 40))
    assert len(set(nodes.tolist())) == len(nodes) == near.any(0).sum() + near.any(1).sum()
    label = {n: n if p < 0 else None for n, p in zip(nodes.tolist(), parents.tolist(), strict=True)}
    for n, p in zip(nodes.tolist(), parents.tolist(), strict=True):
        assert p < 0 or near[min(n, p), max(n, p) - 30]
        label[n] = n if p < 0 else label[p]
    for i, j in np.argwhere(near).tolist():
        assert label[i] == label[30 + j]


def test_query_on_the_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = queries.op11_embedding_near_dedup(spark, sf)
    assert got(found) == slow(rows)
    assert {r.kept == (r.vec_id == r.component_id) for r in found.collect()} == {True}


def test_empty_table(spark):
    assert vectors.near_duplicates(made(spark, [])).count() == 0
    assert got(vectors.near_duplicates(made(spark, [(1, None)]))) == [(1, 0, 1)]
