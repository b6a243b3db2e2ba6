"""Near duplicates by SimHash fingerprints, found with the pigeonring principle.

Fingerprint: words of the text (A-Z in lower case), shingles of SHINGLE words with repeats, XXH64 of each; a bit is 1
if it is set in over half of the hashes. Fewer words than SHINGLE make one shingle, no words a fingerprint of zero.

Links: two fingerprints with at most BITS differing bits. Their 64 bits form a ring of SEGMENTS segments. If the
differences around the ring sum to at most BITS, there is a segment from which every chain of consecutive segments
differs in no more than its proportional share, length * BITS / SEGMENTS. The longest chain whose share is below one
bit must be equal, so it is the join key; the longer chains are checked next, and the whole distance last.

Buckets: equal fingerprints are one row. A bucket of a key with more than BUCKET fingerprints is split by the same
principle over the ring of its remaining bits, twice more if need be; after that so few bits are free that a bucket
cannot hold more than 2**10. No bucket is cut and no pair is lost.

Null texts count as empty, and empty texts are linked like any others. Repeated rows share a fingerprint and so a
component. Rows without a doc_id get the least doc_id of their component, null if there is none. An empty table
gives an empty result. Whole texts are used; a very long one is hashed in one task, its words only once in memory.
"""

from __future__ import annotations

import bisect
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored
from plumbline.llm.graph import components

SHINGLE = 3
SEED = 42
BITS = 2
SEGMENTS = 7
BUCKET = 1024
#: Segments of the rings over the bits that are left, for crowded buckets.
DEEPER = (5, 3, 3)
_LANES = np.uint64(0x0101010101010101)
#: Hashes whose bits are summed together.
_BLOCK = 1 << 20


def _shingle_hashes(text: bytes) -> bytes:
    words = text.lower().split()  # on bytes, both touch ASCII alone
    if len(words) < SHINGLE:
        return xxhash.xxh64_digest(b" ".join(words), SEED) if words else b""
    return b"".join(map(xxhash.xxh64_digest, map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)), repeat(SEED)))


def majority_bits(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For texts whose hashes (uint64) lie behind each other: bits that over half of a text's hashes have.

    Eight counters share a 64-bit number, so stretches of at most 255 hashes are summed at a time."""
    counts = np.diff(ends, prepend=0)
    out = np.zeros(len(ends), np.uint64)
    held = np.flatnonzero(counts)
    if not len(held):
        return out
    pieces = (counts[held] + 254) // 255
    first = np.concatenate(([0], np.cumsum(pieces)[:-1]))
    inner = np.arange(pieces.sum()) - np.repeat(first, pieces)
    starts = np.repeat(ends[held] - counts[held], pieces) + 255 * inner
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, starts)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over = (2 * sums > counts[held, None]).astype(np.uint64)
        out[held] |= (over << (8 * np.arange(8, dtype=np.uint64) + np.uint64(bit))).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(texts: pa.Array) -> pa.Array:
    """The fingerprints of texts (binary) as signed numbers."""
    found, parts, ends, size = [], [], [], 0

    def flush() -> None:
        hashes = np.frombuffer(b"".join(parts), ">u8").astype(np.uint64)
        found.append(majority_bits(hashes, np.array(ends, np.int64)))

    for text in texts:
        part = _shingle_hashes(text.as_py())
        size += len(part) // 8
        parts.append(part)
        ends.append(size)
        if size >= _BLOCK:
            flush()
            parts, ends, size = [], [], 0
    flush()
    return pa.array(np.concatenate(found).view(np.int64))


def fingerprint(text: Column) -> Column:
    """The 64-bit fingerprint of a text as a signed number."""
    return F.arrow_udf(fingerprints, "long")(F.coalesce(text, F.lit("")).cast("binary"))


def as_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def ring(bits: list[int], segments: int, errors: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each start on the ring of these bits: the mask that must be equal, and (mask, most differences) for the
    longer chains."""
    cuts = [len(bits) * k // segments for k in range(segments + 1)]
    parts = [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
    share = [length * errors // segments for length in range(1, segments + 1)]
    out = []
    for start in range(segments):
        chains = [sum(parts[(start + k) % segments] for k in range(length)) for length in range(1, segments + 1)]
        longest = {most: chains[bisect.bisect_right(share, most) - 1] for most in share}
        out.append((longest.pop(0), [(mask, most) for most, mask in longest.items() if most < errors]))
    return out


def _levels() -> list[list[tuple[int, int, list[tuple[int, int]]]]]:
    """Per level: (parent, equal mask, chains) of each key; a deeper key's mask holds its parent's."""
    levels = [[(-1, mask, chains) for mask, chains in ring(list(range(64)), SEGMENTS, BITS)]]
    for segments in DEEPER:
        levels.append([(parent, mask | own, chains) for parent, (_, mask, _) in enumerate(levels[-1])
                       for own, chains in ring([b for b in range(64) if not mask >> b & 1], segments, BITS)])
    return levels


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (column fp) that differ in at most BITS bits; each once or more."""
    found: DataFrame | None = None
    spark, rest = prints.sparkSession, None
    for level, keys in enumerate(_levels()):
        table = [(k, parent, _signed(mask), *(_signed(m) for m, _ in chains)) for k, (parent, mask, chains) in enumerate(keys)]
        budgets = [most for _, most in keys[0][2]]
        names = [f"chain{i}" for i in range(len(budgets))]
        masks = spark.createDataFrame(table, ", ".join(["key int", "parent int", "mask long", *(f"{n} long" for n in names)]))
        if rest is None:
            entries = prints.select("fp", F.explode(F.array(*(F.struct(*(F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, masks.dtypes, strict=True))) for row in table))).alias("k")).select("fp", "k.*")
        else:
            entries = rest.join(F.broadcast(masks), "parent")  # a row for each key of a level: 315 at most
        entries = entries.select("key", F.expr("fp & mask").alias("part"), "fp", *names)
        sizes = entries.groupBy("key", "part").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        shared = stored(entries.join(sizes, ["key", "part"]))
        last = level == len(DEEPER)
        near = shared if last else shared.filter(F.col("size") <= BUCKET)
        a, b = near.alias("a"), near.select("key", "part", "fp").alias("b")
        differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
        meets = (F.col("a.key") == F.col("b.key")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.fp") < F.col("b.fp"))
        for name, most in zip(names, budgets, strict=True):
            meets &= F.bit_count(differ.bitwiseAND(F.col(f"a.{name}"))) <= most
        pairs = a.join(b, meets & (F.bit_count(differ) <= BITS)).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
        found = pairs if found is None else found.union(pairs)
        rest = shared.filter(F.col("size") > BUCKET).select(F.col("key").alias("parent"), "fp")
        if last or rest.isEmpty():
            return found


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs: its fingerprint and the least doc_id that can be reached
    over links, its own included."""
    prints = stored(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp")))
    firsts = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(links(firsts.select("fp")))
    joined = labels.join(firsts, labels.node == firsts.fp).select("label", "fp", "first")
    least = joined.groupBy("label").agg(F.min("first").alias("least"))
    moved = joined.join(least, "label").select("fp", F.col("least").alias("component_id"))
    classes = stored(firsts.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")))
    return prints.join(classes, "fp", "left").select("doc_id", "fp", "component_id")
