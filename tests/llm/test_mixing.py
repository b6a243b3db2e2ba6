from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixing, queries
from validation.compare import difference, duck


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Share by weight, cut what is over the cap, share it again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    open_, out, left = set(names), {}, share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > cap * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 50, None: 7}, {"a": 1}, {"x": 0, "y": 10, "z": 1000}, {"a": 0, None: 0}, {f"s{i:02}": (i * 37) % 91 for i in range(30)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(slow_targets(sizes))


def test_query_against_sql(spark, sf):
    assert difference(spark, duck(sf), queries.op5_mixing, queries.oracle_sql()["op5_mixing"], sf) is None


def test_slices_do_not_change_the_result(spark, sf, monkeypatch):
    one = sorted(map(tuple, queries.op5_mixing(spark, sf).collect()))
    monkeypatch.setattr(mixing, "SLICE", 7)
    assert sorted(map(tuple, queries.op5_mixing(spark, sf).collect())) == one


def test_edge_cases(make_docs, edge_docs, empty_docs):
    rows = [(i, "word " * (i % 9), None if i % 3 == 0 else f"s{i % 3}") for i in range(90)] + [(1, "word " * 4, "s1")] * 40 + [(None, None, None)]
    for docs in (make_docs(rows, "key size slice name words ahead target n part epochs"), edge_docs):
        mixed = mixing.mix(docs).collect()
        assert len(mixed) == docs.count()
        taken, targets = Counter(), {}
        for r in mixed:
            assert 0 <= r.size * r.epochs + r.part <= 2 * r.size
            taken[r.row.source] += r.size * r.epochs + r.part
            targets[r.row.source] = r.target
        assert all(abs(taken[s] - t) <= 1 for s, t in targets.items())
        drawn = mixing.draw(mixing.mix(docs)).select("row.source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")).alias("n")).collect()
        words = Counter()
        for r in drawn:
            words[r.source] += r.n
        assert +words == +taken
    assert mixing.mix(empty_docs).count() == 0
