import random

import xxhash
from pyspark.sql import functions as F

from plumbline.llm import queries, simhash
from plumbline.llm.graph import components


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """Least id per fingerprint's component, by comparing all pairs."""
    distinct = list(dict.fromkeys(fp for _, fp in prints))
    parent = {fp: fp for fp in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for doc, fp in prints:
        if doc is not None:
            least[root(fp)] = min(doc, least.get(root(fp), doc))
    return [least.get(root(fp)) for _, fp in prints]


def check(docs, got):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    prints = [(doc, slow_fingerprint(text)) for doc, text in rows]
    want = sorted(((doc, f"{fp:016x}", least) for (doc, fp), least in zip(prints, slow_components(prints), strict=True)), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_query_against_all_pairs(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"), queries.op8_simhash_near_dedup(spark, sf))


def test_edge_cases(edge_docs, empty_docs):
    hexed = lambda docs: simhash.near_duplicates(docs).select("doc_id", simhash.as_hex(F.col("fp")), "component_id")
    check(edge_docs, hexed(edge_docs))
    assert simhash.near_duplicates(empty_docs).count() == 0


def test_every_close_pair_is_found_in_crowded_buckets(spark, monkeypatch):
    """Fingerprints around a few centres, and buckets of four at most, so that every level is used."""
    monkeypatch.setattr(simhash, "BUCKET", 4)
    rng = random.Random(7)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for centre in list(prints)[:3]:
        for _ in range(120):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    got = {(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links(df).distinct().collect()}
    order = sorted(prints, key=simhash._signed)
    assert got == {(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if (a ^ b).bit_count() <= 2}


def test_chains_of_the_ring_hold_for_every_pair():
    """Any two errors leave one start whose chains all keep their share."""
    keys = simhash.ring(list(range(64)), simhash.SEGMENTS, 2)
    for x in range(64):
        for y in range(x, 64):
            errors = 1 << x | 1 << y
            assert any(not errors & mask and all((errors & m).bit_count() <= most for m, most in chains) for mask, chains in keys)


def test_components_of_a_long_chain(spark):
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(100, 99)], "a long, b long"))
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 99: 99, 100: 99}
    assert components(links.limit(0)).count() == 0
