"""Near duplicates by an exact set-similarity join over shingles.

A text is the set of its shingles of SHINGLE words (A-Z in lower case); fewer words make one shingle, no words an empty
set. Two texts are linked if the Jaccard similarity of their sets is at least 0.8; groups are the components of links.

How: texts of equal sets are one node. A node's shingles are ordered from the rarest on, by counts over all texts; the
order changes the work, not the result. Sets x and y of a Jaccard similarity of 0.8 share k shingles among the first
|x| - ceil(0.8 |x|) + k of each, for every k up to their overlap, and among the first |x| - ceil(8/9 |x|) + k of x if it is
not the larger one; these lead in x. So each set enters the former for k = 1 + |x| // PART, and pairs that share
1 + min(|x|, |y|) // PART shingles that lead in the smaller set and pass the length and positional filters are verified on
the sets. Form letters, whose common shingles lead in none of them, form no pairs.
SimHash comes first: nodes of equal SimHash fingerprints, and of fingerprints that `simhash.links` finds near, are verified on
the sets, and those that pass start the components. Fingerprints alone miss pairs of that similarity, so the join adds what they miss.
Pairs within one component need no look. Lists of a shingle with more than CROWD nodes are first joined up by stars:
each node with the least of its share of the list, then these with the least of the list. After that all pairs of a list
whose ends are in different components are formed. No list is cut and no pair is lost.

Shingles and sets are compared by 64-bit hashes. The only broadcast is the table of 2**COUNT_BITS shingle counts. Null
texts count as empty; empty texts are one group. Repeated rows are in one group. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import simhash
from plumbline.llm.common import stored, temporary
from plumbline.llm.graph import components

SHINGLE = 5
SEED = 42
PART = 20
#: Shingles are counted by this many bits of their hash.
COUNT_BITS = 20
CROWD = 64
#: Shares of a crowded list that have a star of their own.
SHARES = 64
#: Hashes that are counted together.
_BLOCK = 1 << 20


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The different hashes of a text's shingles, ascending."""
    words = text.lower().split()  # on bytes, both touch ASCII alone
    if not words:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, parts, repeat(SEED))), ">u8").astype(np.uint64))


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (t.as_py() for t in batch.column("text"))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def shingle_levels(texts: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """A step from 0 (rarest) to 255 by the leading bits of a shingle's hash, from counts over all texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(1 << COUNT_BITS, np.int64), [], 0
        for batch in batches:
            for text in _texts(batch):
                held.append(shingle_set(text, shingle))
                size += len(held[-1])
                if size >= _BLOCK:
                    counts += np.bincount(_bucket(np.concatenate(held)), minlength=len(counts))
                    held, size = [], 0
        if held:
            counts += np.bincount(_bucket(np.concatenate(held)), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["bucket", "n"])

    summed = texts.select("text").mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    counts[summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    return np.minimum(255, 8 * np.log2(1 + counts)).astype(np.uint8)


def _node(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def prefixes(texts: DataFrame, levels: np.ndarray, shingle: int = SHINGLE) -> DataFrame:
    """(id, dh, node, size, prefix, fp) for each row of texts (id, dh, text as binary)."""
    shared, kind = texts.sparkSession.sparkContext.broadcast(levels), texts.schema["id"].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, parts = [], [], []
            for text in _texts(batch):
                hashes = shingle_set(text, shingle)
                n = len(hashes)
                order = np.argsort(shared.value[_bucket(hashes)], kind="stable")
                nodes.append(_node(hashes))
                sizes.append(n)
                parts.append(hashes[order[: n + 1 + (-4 * n) // 5 + n // PART]].view(np.int64))
            ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("dh"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), lists, simhash.fingerprints(batch.column("text"))], ["id", "dh", "node", "size", "prefix", "fp"])

    return texts.mapInArrow(found, f"id {kind}, dh long, node long, size int, prefix array<long>, fp long")


def _sets(texts: DataFrame, firsts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of the wanted nodes, from the text that stands for each."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "hashes"])

    here = firsts.join(wanted, "node", "left_semi").select(F.col("who.id").alias("own"), F.col("who.dh").alias("own_dh"))
    read = texts.join(here, texts.id.eqNullSafe(here.own) & (texts.dh == here.own_dh), "left_semi")
    return read.select("text").mapInArrow(found, "node long, hashes array<long>").dropDuplicates(["node"])


def _fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints are equal or linked: the least node of each fingerprint stands for it."""
    own = stored(prints.groupBy("node").agg(F.min("fp").alias("fp")))
    least = stored(own.groupBy("fp").agg(F.min("node").alias("least")))
    equal = own.join(least, "fp").filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    x, y = (least.select(F.col("fp").alias(s), F.col("least").alias(f"{s}_node")) for s in "ab")
    near = simhash.links(least.select("fp")).distinct().join(x, "a").join(y, "b")
    return equal.union(near.select(F.least("a_node", "b_node"), F.greatest("a_node", "b_node"))).distinct()


def _passing(a: str, b: str) -> Column:
    """Length and positional filter of two entries of a shingle."""
    n, m, i, j = F.col(f"{a}.size"), F.col(f"{b}.size"), F.col(f"{a}.pos"), F.col(f"{b}.pos")
    return (5 * n >= 4 * m) & (5 * m >= 4 * n) & (9 * (F.least(i, j) + F.least(n - i, m - j)) >= 4 * (n + m))


def _stars(entries: DataFrame, group: list[str]) -> DataFrame:
    """Pairs (a, b) of the least node of each group of entries and the others."""
    least = stored(entries.groupBy(*group).agg(F.min(F.struct("node", "size", "pos")).alias("least")))
    x, y = least.select(*group, "least.*").alias("x"), entries.alias("y")
    meets = (F.col("x.node") < F.col("y.node")) & _passing("x", "y")
    for g in group:
        meets &= F.col(f"x.{g}") == F.col(f"y.{g}")
    return x.join(y, meets).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, dh, group) for every row of docs: its id, xxhash64 of its text ('' for null) and the number of its group."""
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(doc_id).alias("id"), F.xxhash64(whole).alias("dh"), whole.cast("binary").alias("text"))
    prints = stored(prefixes(texts, shingle_levels(texts, shingle), shingle))
    firsts = stored(prints.groupBy("node").agg(F.min(F.struct("id", "dh")).alias("who")))
    nodes = prints.join(firsts, (prints.node == firsts.node) & F.struct("id", "dh").eqNullSafe(firsts.who), "left_semi").dropDuplicates(["node"])
    leads = 9 * (F.col("size") - F.col("pos") + F.floor(F.col("size") / PART)) >= 8 * F.col("size")
    with temporary(docs.sparkSession):  # the entries that meet none go at once
        spread = stored(nodes.select("node", "size", F.posexplode("prefix").alias("pos", "word")))
        lists = spread.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.max(leads).alias("led")).filter("n > 1 AND led").drop("led")
        entries = stored(spread.join(lists, "word"), outer=True)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs)
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        sets = stored(_sets(texts, firsts, ends, shingle))
        x, y = (sets.select(F.col("node").alias(s), F.col("hashes").alias(f"{s}_hashes")) for s in "ab")
        both = pairs.join(x, "a").join(y, "b")
        shared = F.size(F.array_intersect("a_hashes", "b_hashes"))
        return stored(both.filter(9 * shared >= 4 * (F.size("a_hashes") + F.size("b_hashes"))).select("a", "b"))

    near = _fingerprint_pairs(prints)
    crowded = entries.filter(F.col("n") > CROWD).withColumn("share", F.pmod(F.xxhash64("node"), F.lit(SHARES)))
    some = not crowded.isEmpty()
    found = verified(near.union(_stars(crowded, ["word", "share"])).distinct() if some else near)
    labels = components(found)
    if some:
        labelled = crowded.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        heads = labelled.groupBy("word", "label").agg(F.min(F.struct("node", "size", "pos")).alias("e")).select("word", "e.*")
        found = found.union(verified(_stars(stored(heads), ["word"]))).distinct()
        labels = components(found)
    marked = entries.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    marked = stored(marked.select("word", "node", "size", "pos", "label"))
    x, y = marked.filter(leads).alias("x"), marked.alias("y")
    smaller = F.struct("x.size", "x.node") < F.struct("y.size", "y.node")
    meets = (F.col("x.word") == F.col("y.word")) & smaller & (F.col("x.label") != F.col("y.label")) & _passing("x", "y")
    pairs = x.join(y, meets).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.size").alias("least"))
    pairs = pairs.groupBy("a", "b", "least").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 1 + F.floor(F.col("least") / PART)).select("a", "b")
    more = verified(pairs)
    labels = components(found.union(more).distinct())
    return prints.select("id", "dh", "node").join(labels, "node", "left").select("id", "dh", F.coalesce("label", "node").alias("group"))
