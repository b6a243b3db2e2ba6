"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: windows of WINDOW words within a line; its first OPENING words into windows of FINE words,
so that short texts have several. Each paragraph's digest (XXH64) is added to one cell in each of three parts of a
sketch. A cell holds a count, the XOR of its digests and the XOR of their checks. Subtracting the cells of two sketches
leaves those of the digests that only one text has. Peeling recovers them: a cell of count 1 or -1 whose check fits its
digest holds exactly that digest, which is then taken out of its other cells, until all cells are empty. A sketch starts
with cells for differences of about a quarter of the digests; if peeling fails, the same texts are sketched with four times
the cells, up to TRIES times. Sets of more than BLOCK digests are split by hash into blocks that are sketched apart, so
the work grows with the length of a text. What still fails, which two digests in the same three cells can cause, is
compared set against set.

Likeness of two fingerprints: 1 - differing digests / all digests of both; 1 if both have none.

Everything is a DataFrame operation on rows that hold two texts' digests; the only shuffles bring a document and its
successor together. Null texts count as empty. Successors follow doc_id (null first), then a hash of the text; rows with
equal doc_id and text are one document, and each gets its result. The last document's successor is the first; a single
document succeeds itself. An empty table gives an empty result. Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, stored

OPENING, FINE, WINDOW = 32, 4, 32
PARTS = 3
#: Cells in a part of the fixed sketch that a fingerprint's text shows.
SHOWN = 4
BLOCK = 128
TRIES = 4
ROUNDS = 12
_SPACE, _SPACE_IN_LINE = r"[\x20\x09-\x0D]", r"[\x20\x09\x0B-\x0D]"
_ZERO = "named_struct('n', 0, 'k', 0L, 'h', 0L)"


def paragraphs(text: Column) -> Column:
    opening = F.regexp_extract(text, rf"^(?:{_SPACE}*+{WORD}+){{1,{OPENING}}}+", 0)
    rest = F.substring(text, F.length(opening) + 1, F.length(text))
    windows = lambda part, space, n: F.regexp_extract_all(part, F.lit(rf"(?:{WORD}+{space}*+){{1,{n}}}+"), 0)
    return F.concat(windows(opening, _SPACE, FINE), windows(rest, _SPACE_IN_LINE, WINDOW))


def digests(text: Column) -> Column:
    """The set of paragraph digests, sorted."""
    return F.sort_array(F.array_distinct(F.transform(paragraphs(text), lambda p: F.xxhash64(p))))


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once: a lambda's variable holds it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check"))


def _at(digest: Column, part: int, cells: Column) -> Column:
    """Place of a digest within one part of a sketch with so many cells a part."""
    return F.pmod(F.xxhash64(digest, F.lit(part)), cells).cast("int")


def _item(sign: Column, digest: Column, check: Column, cells: Column) -> Column:
    return F.struct(sign.alias("n"), digest.alias("k"), check.alias("h"), *(_at(digest, p, cells).alias(f"c{p}") for p in range(PARTS)))


def _with(cell: Column, items: Column, part: int, at: Column, sign: int) -> Column:
    """A cell with the items that fall into its place added or taken out."""
    return F.aggregate(F.filter(items, lambda i: i[f"c{part}"] == at), cell, lambda c, i: F.struct(
        (c["n"] + sign * i["n"]).alias("n"), c["k"].bitwiseXOR(i["k"]).alias("k"), c["h"].bitwiseXOR(i["h"]).alias("h")))


def sketch(found: Column, cells: Column) -> Column:
    """The cells of a set of digests, part after part."""
    items = F.transform(found, lambda d: _item(F.lit(1), d, _check(d), cells))
    places = F.sequence(F.lit(0), cells - 1)
    part = lambda made, p: F.transform(places, lambda at: _with(F.expr(_ZERO), made, p, at, 1))
    return _bound(items, lambda made: F.concat(*(part(made, p) for p in range(PARTS))))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))


def peel(difference: Column, cells: Column) -> Column:
    """The digests that only one of two sketches has, or null if some stay hidden."""

    def round_(state: Column, _: Column) -> Column:
        pure = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["h"] == _check(c["k"])))
        items = F.array_distinct(F.transform(pure, lambda c: _item(c["n"], c["k"], c["h"], cells)))
        part = lambda found, p: F.transform(F.slice(state["cells"], cells * p + 1, cells), lambda c, at: _with(c, found, p, at, -1))
        return _bound(items, lambda found: F.when(F.size(found) == 0, state).otherwise(F.struct(
            F.concat(*(part(found, p) for p in range(PARTS))).alias("cells"),
            F.concat(state["found"], F.transform(found, lambda i: i["k"])).alias("found"))))

    start = F.struct(difference.alias("cells"), F.array().cast("array<bigint>").alias("found"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_,
        lambda s: F.when(F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["h"] != 0)), None).otherwise(s["found"]),
    )


def differing(a: Column, b: Column) -> Column:
    """Digests that only one of two sets has, recovered from the difference of their sketches."""

    def tried(x: Column, y: Column, more: int) -> Column:
        cells = F.greatest(F.lit(4), F.ceil((F.size(x) + F.size(y)) / F.lit(8))).cast("int") * (4**more)
        return _bound(cells, lambda n: _bound(subtract(sketch(x, n), sketch(y, n)), lambda cut: peel(cut, n)))

    def block(x: Column, y: Column) -> Column:
        return F.coalesce(*(tried(x, y, more) for more in range(TRIES)), F.concat(F.array_except(x, y), F.array_except(y, x)))

    blocks = F.ceil((F.size(a) + F.size(b)) / F.lit(BLOCK)).cast("int")
    part = lambda d, k, n: F.pmod(F.xxhash64(d, F.lit("block")), n) == k
    parts = lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.filter(a, lambda d: part(d, k, n)).alias("x"), F.filter(b, lambda d: part(d, k, n)).alias("y")))
    return F.when(blocks <= 1, block(a, b)).otherwise(F.flatten(F.transform(parts(blocks), lambda p: block(p["x"], p["y"]))))


def likeness(a: Column, b: Column) -> Column:
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(1 - F.size(differing(a, b)) / both)


def shown(found: Column) -> Column:
    """A fingerprint as text: the number of digests and the cells of a sketch of fixed size."""
    cells = F.transform(sketch(found, F.lit(SHOWN)), lambda c: F.concat(c["n"].cast("string"), F.lit("."), F.lower(F.hex(c["k"]))))
    return F.concat(F.size(found).cast("string"), F.lit(":"), F.array_join(cells, ","))


def successors(docs: DataFrame) -> DataFrame:
    """(r1, r2, n1, n2) per document of docs (doc_id, r1, r2): its two hashes and those of the next one."""
    rank = F.struct(F.col("doc_id"), F.col("r1"), F.col("r2"))
    ranged = docs.groupBy("doc_id", "r1", "r2").agg(F.lit(1)).repartitionByRange("doc_id", "r1", "r2")
    placed = stored(ranged.select("doc_id", "r1", "r2", F.spark_partition_id().alias("part")))
    firsts = placed.groupBy("part").agg(F.min(rank).alias("first"))
    after = firsts.withColumn("after", F.coalesce(F.lead("first").over(W.orderBy("part")), F.min("first").over(W.partitionBy())))  # a row per part
    within = placed.withColumn("next", F.lead(rank).over(W.partitionBy("part").orderBy("doc_id", "r1", "r2")))
    found = within.join(F.broadcast(after.select("part", "after")), "part").withColumn("next", F.coalesce("next", "after"))
    return found.select("r1", "r2", F.col("next.r1").alias("n1"), F.col("next.r2").alias("n2"))


def versions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited, own, changed, next) per row: code points, the text whose last quarter is replaced by the
    start of the next document, and the digests of the text, the edited text and the next document."""
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), plain.alias("text"), F.length(plain).cast("long").alias("n"),
                       F.xxhash64(doc_id, plain).alias("r1"), F.xxhash64(plain, doc_id, F.lit(1)).alias("r2"))
    steps = stored(rows.select("doc_id", "r1", "r2", "n").groupBy("doc_id", "r1", "r2").agg(F.first("n").alias("n")))
    chain = successors(steps).join(steps, ["r1", "r2"])
    needs = stored(chain.select(F.col("n1").alias("r1"), F.col("n2").alias("r2"), F.col("r1").alias("p1"), F.col("r2").alias("p2"), F.col("doc_id").alias("of"), F.col("n").alias("chars")))
    # Both joins read the same columns of the texts, so these are shuffled once.
    texts = rows.select("r1", "r2", "text")
    head = F.substring(F.col("text"), F.lit(1), F.floor(F.col("chars") / 4).cast("int"))
    given = texts.join(needs, ["r1", "r2"]).select(F.col("p1").alias("r1"), F.col("p2").alias("r2"), "of", "chars", head.alias("head"), digests(F.col("text")).alias("next"))
    heads = given.groupBy("r1", "r2").agg(*(F.first(c).alias(c) for c in ("of", "chars", "head", "next")))
    joined = texts.join(heads, ["r1", "r2"])
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("chars") - F.floor(F.col("chars") / 4)).cast("int")), F.col("head"))
    return joined.select(F.col("of").alias("doc_id"), F.col("chars").alias("n_chars"), edited.alias("edited"), digests(F.col("text")).alias("own"), digests(edited).alias("changed"), "next")
