"""Near duplicates among vectors, found with an epsilon grid order join.

Two vectors are linked if their cosine, in double precision, is at least `least`. Vectors that are null, empty, zero or
hold a null or a component that is not finite are linked with none; vectors of different lengths are not linked either.

How: equal vectors are one. Unit vectors with a cosine of `least` lie at a distance of at most epsilon = sqrt(2 - 2 * least).
They are turned into the principal axes of a bounded sample; the first AXES coordinates make a grid of cells as wide as
epsilon, and the vectors are sorted by the cells in lexicographic order. Intervals of the sequence are blocks of 2**BLOCK_BITS
vectors, 2**FAN_BITS blocks are an interval of the next level and so on. Starting from the whole sequence with itself,
pairs of intervals are split into pairs of their parts as long as their boxes are not provably farther apart than epsilon;
boxes hold the leading coordinates and the length of what is left of the vectors, so no link is lost. Pairs of
blocks that remain are compared in tasks of their own as products of matrices. The axes, the grid and the blocks
only decide what is skipped; results do not depend on them. A pair of blocks returns a row for each vector
with links at most: their number, and one neighbour such that the rows join what the links join. No list of all
links is made, and copies are counted, never paired.

Where vectors fill all directions evenly no box is far from another, and every block meets every block: the work then
grows with the square of the number of different vectors (the rows that are shuffled too, divided by the block's
size). Clustered vectors are pruned.

Rows without an id take part and get the least id of their component, null if there is none. Repeated rows are rows:
each counts as another vector. A cosine within 1e-12 of `least` is computed again with exactly rounded sums, so ties
do not depend on the order of summation. Vectors are compared whole, however long; a block of 2**BLOCK_BITS of
them must fit into a task. An empty table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import least_places, stored
from plumbline.llm.graph import components

LEAST = 0.9
AXES = 8
#: Vectors from which the axes are taken.
SAMPLE = 4096
BLOCK_BITS = 12
FAN_BITS = 3
#: Parts of a block that are joined with its pairs apart from each other.
_CHUNKS = 16
#: Rows of a matrix of cosines that is held at once.
_TILE = 512
_CLOSE = 1e-12


def usable(vector: Column) -> Column:
    """Whether the vector has a direction."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def _units(vectors: pa.ListArray, size: int) -> np.ndarray:
    """Unit vectors of vectors of one size."""
    rows = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _sizes(vectors: pa.ListArray) -> np.ndarray:
    return vectors.value_lengths().to_numpy(zero_copy_only=False)


def _axes(vectors: DataFrame) -> np.ndarray:
    """Principal axes (columns) of a sample of at most SAMPLE vectors, for vectors of the sample's usual length."""
    placed = vectors.select("vector", F.xxhash64("vector").alias("place"))
    sample = least_places(placed, "place", vectors.count(), SAMPLE).select("vector").toArrow().column(0).combine_chunks()
    if not len(sample):
        return np.zeros((0, 0))
    sizes = _sizes(sample)
    usual = int(np.bincount(sizes).argmax())
    rows = _units(sample.filter(pa.array(sizes == usual)), usual)
    rows = rows - rows.mean(axis=0)
    return np.linalg.svd(rows, full_matrices=False)[2][:AXES].T


def _placed(vectors: DataFrame, least: float) -> DataFrame:
    """(node, block, box, vector, n, first): vectors in the order of the grid; box has their length and coordinates."""
    axes = _axes(vectors)
    shared, width = vectors.sparkSession.sparkContext.broadcast(axes), math.sqrt(2 - 2 * least)

    def found(batches):
        for batch in batches:
            column = batch.column("vector")
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            sizes = _sizes(column)
            box = np.zeros((len(column), AXES + 2))
            box[:, 0] = sizes  # vectors of different lengths are farther apart than any two unit vectors
            box[:, -1] = 1
            mine = np.flatnonzero(sizes == len(shared.value))
            if len(mine):
                at = _units(column.take(pa.array(mine)), len(shared.value)) @ shared.value
                box[mine, 1 : 1 + at.shape[1]] = at
                box[mine, -1] = np.sqrt(np.maximum(0, 1 - (at * at).sum(axis=1)))
            order = np.column_stack((box[:, 0], np.floor(box[:, 1:-1] / width), box[:, 1:-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(box), pa.list_(pa.float64())), pa.array(list(order), pa.list_(pa.float64()))], [*batch.schema.names, "box", "order"])

    kind = vectors.schema["vector"].dataType.simpleString()
    first = vectors.schema["first"].dataType.simpleString()
    rows = vectors.select("vector", "n", "first").mapInArrow(found, f"vector {kind}, n long, first {first}, box array<double>, order array<double>")
    ordered = rows.repartitionByRange("order").sortWithinPartitions("order").drop("order").withColumn("node", F.monotonically_increasing_id())
    ordered = stored(ordered)
    part, place = F.shiftright("node", 33), F.col("node").bitwiseAND((1 << 33) - 1)
    counts = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))  # a row for each task that sorted
    before = stored(counts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before")))
    numbered = ordered.withColumn("part", part).join(before, "part")
    return numbered.select("node", F.shiftright(F.col("before") + place, BLOCK_BITS).alias("block"), "box", "vector", "n", "first")


def _levels(placed: DataFrame) -> list[DataFrame]:
    """Intervals (id, parent, lo0 ..., hi0 ...) by level, from the blocks up to a single interval."""
    bounds = [(F.min, f"lo{i}", i) for i in range(AXES + 2)] + [(F.max, f"hi{i}", i) for i in range(AXES + 2)]
    parent = F.shiftright("id", FAN_BITS).alias("parent")
    level = placed.groupBy(F.col("block").alias("id")).agg(*(f(F.col("box")[i]).alias(name) for f, name, i in bounds))
    levels = [stored(level.select("*", parent))]
    while levels[-1].count() > 1:
        above = levels[-1].groupBy(F.col("parent").alias("id")).agg(*(f(name).alias(name) for f, name, _ in bounds))
        levels.append(stored(above.select("*", parent)))
    return levels


def _block_pairs(placed: DataFrame, least: float) -> DataFrame:
    """(a, b), a <= b: pairs of blocks that can hold links."""
    levels = _levels(placed)
    pairs = levels[-1].select(F.col("id").alias("a"), F.col("id").alias("b"))
    for level in reversed(levels[:-1]):
        x, y = level.alias("x"), level.alias("y")
        gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"x.lo{i}") - F.col(f"y.hi{i}"), F.col(f"y.lo{i}") - F.col(f"x.hi{i}")), F.lit(2.0)) for i in range(AXES + 2)), F.lit(0.0))
        near = pairs.join(x, F.col("a") == F.col("x.parent")).join(y, F.col("b") == F.col("y.parent")).filter((F.col("x.id") <= F.col("y.id")) & (gap <= 2 - 2 * least + 1e-9))
        pairs = stored(near.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")))
    return pairs


def _cosine(x: np.ndarray, y: np.ndarray) -> float:
    return math.fsum((x * y).tolist()) / math.sqrt(math.fsum((x * x).tolist()) * math.fsum((y * y).tolist()))


def _near(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """For unit vectors x and y, which pairs have a cosine of at least `least`."""
    out = np.empty((len(x), len(y)), bool)
    for at in range(0, len(x), _TILE):
        cosines = x[at : at + _TILE] @ y.T
        out[at : at + _TILE] = cosines >= least
        for i, j in np.argwhere(np.abs(cosines - least) < _CLOSE).tolist():
            out[at + i, j] = _cosine(x[at + i], y[j]) >= least
    return out


def _forest(sides: list[np.ndarray], counts: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(node, parent) of a spanning forest: sides[s][i] says which nodes of the other side node i of side s has as
    neighbours; one side that is its own other side if there is just one. Roots have the parent -1."""
    starts = [0, counts[0]][: len(sides)]
    open_ = [near.any(axis=1) for near in sides]
    nodes: list[int] = []
    parents: list[int] = []
    for s in range(len(sides)):
        for root in np.flatnonzero(open_[s]).tolist():
            if not open_[s][root]:
                continue
            open_[s][root] = False
            nodes.append(starts[s] + root)
            parents.append(-1)
            todo = [(s, root)]
            while todo:
                side, node = todo.pop()
                other = len(sides) - 1 - side
                new = np.flatnonzero(sides[side][node] & open_[other])
                open_[other][new] = False
                nodes += (starts[other] + new).tolist()
                parents += [starts[side] + node] * len(new)
                todo += [(other, k) for k in new.tolist()]
    return np.array(nodes, np.int64), np.array(parents, np.int64)


def _compared(rows: pa.Table, least: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(node, links, other) for the vectors of a pair of blocks that have links across it; other -1 for none."""
    a, b = rows.column("a")[0].as_py(), rows.column("b")[0].as_py()
    node, n, block = (rows.column(c).to_numpy() for c in ("node", "n", "block"))
    vectors = rows.column("vector").combine_chunks()
    sizes, found = _sizes(vectors), []
    for size in np.unique(sizes).tolist():
        at = [np.flatnonzero((block == x) & (sizes == size)) for x in ([a] if a == b else [a, b])]
        if not all(map(len, at)):
            continue
        units = [_units(vectors.take(pa.array(k)), size) for k in at]
        near = _near(units[0], units[-1], least)
        if a == b:
            near = near | near.T
            np.fill_diagonal(near, False)
        if not near.any():
            continue
        sides = [near] if a == b else [near, np.ascontiguousarray(near.T)]
        i, j = np.nonzero(near)
        links = [np.bincount(i, n[at[-1]][j], len(at[0])), np.bincount(j, n[at[0]][i], len(at[-1]))][: len(sides)]
        some, parent = _forest(sides, tuple(map(len, at)))
        all_nodes = np.concatenate([node[k] for k in at])
        found.append((all_nodes[some], np.concatenate(links).astype(np.int64)[some], np.where(parent < 0, -1, all_nodes[parent])))
    return found


def _links(placed: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """(node, links, other): for each pair of blocks the vectors with links across it."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def found(rows: pa.Table) -> pa.Table:
        parts = _compared(rows, least)
        columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3)]
        return pa.table([pa.array(c, pa.int64()) for c in columns], schema)

    chunk = F.pmod("node", F.lit(_CHUNKS)).cast("int")
    ends = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(_CHUNKS - 1))))
    rows = ends.join(placed.select("block", chunk.alias("chunk"), "node", "vector", "n"), ["block", "chunk"])
    return rows.select("a", "b", "block", "node", "vector", "n").groupBy("a", "b").applyInArrow(found, "node long, links long, other long")


def near_duplicates(vectors: DataFrame, least: float = LEAST, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id) for every row: the number of other rows linked with it, and the least id that can
    be reached over links, its own included."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
    good = F.coalesce(usable(F.col("vector")), F.lit(False))
    distinct = stored(rows.filter(good).groupBy("vector").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first")))
    placed = stored(_placed(distinct, least))
    found = stored(_links(placed, _block_pairs(placed, least), least))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = stored(components(found.filter("other >= 0").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()))
    known = stored(placed.join(linked, "node", "left").join(labels, "node", "left").select("vector", "n", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "node").alias("label")))
    least_ids = known.groupBy("label").agg(F.min("first").alias("component_id"))
    known = stored(known.join(least_ids, "label").select("vector", (F.col("n") - 1 + F.col("links")).alias("n_links"), "component_id"))
    whole = rows.filter(good).join(known, "vector").select("vec_id", "n_links", "component_id")
    return whole.union(rows.filter(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
