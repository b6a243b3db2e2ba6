"""Keys and references that the data hold, whether anyone declared them or not.

References: a column is included in another if all its values occur there.  All columns of
all tables are compared at once: values are grouped, each with one bit per column that
holds it, and the sets of columns that occur are counted.  One shuffle of
(digest of the value, bits), combined in the tasks first; after that only sets of columns are left.

Keys: sets of columns without NULLs in which no two rows agree, searched level by level.
Sketches of the distinct counts, many in one pass, leave out what cannot be
unique.  Repeats among the rows of one key in 64 refute most of the rest, all sets of a level in one grouping,
and what remains is verified exactly over all rows, one set at a time.

Values are compared by two 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import is_nested, quoted, type_category
from plumbline.plans.measure import local_frame
from plumbline.sources.scratch import kept

_WORD = 64
#: Relative error of the sketches, and how many of these errors an estimate may lie below the rows.
_ERROR, _ERRORS = 0.02, 6
#: Sketches a pass.
_SKETCHES = 40
#: Repeats are looked for in one of so many slices of the keys before they are in all.
_SLICES = 64


def _comparable_kind(data_type: T.DataType) -> str | None:
    """Columns of one kind can refer to each other; real numbers, truth values and nested values refer to nothing."""
    kind = type_category(data_type)
    return None if is_nested(data_type) or kind in ("float", "bool") or isinstance(data_type, T.BinaryType) else kind


def _text(col: Column, kind: str) -> Column:
    return (col.cast("decimal(38,0)") if kind == "int" else col.cast("timestamp_ntz") if kind == "datetime" else col).cast("string")


def _digest(*parts: Column) -> list[Column]:
    return [F.xxhash64(F.lit(0), *parts).alias("h0"), F.xxhash64(F.lit(1), *parts).alias("h1")]


def inclusions(spark: SparkSession, tables: Mapping[str, DataFrame], least: float = 1.0) -> DataFrame:
    """(child_table, child_column, parent_table, parent_column, n_values, n_shared, coverage, parent_values) for all pairs of
    columns of one kind of which the child's different values occur in the parent, all of them or the share ``least``."""
    columns = [(t, f.name, kind) for t, df in tables.items() for f in df.schema.fields if (kind := _comparable_kind(f.dataType))]
    words = max(1, math.ceil(len(columns) / _WORD))
    bits = [f"b{w}" for w in range(words)]
    cells = None
    for table, df in tables.items():
        own = [(i, name, kind) for i, (t, name, kind) in enumerate(columns) if t == table]
        if not own:
            continue
        held = F.array(*[
            F.struct(F.lit(kind).alias("kind"), _text(F.col(quoted(name)), kind).alias("v"),
                     *[F.lit(_signed(1 << i % _WORD) if i // _WORD == w else 0).cast("long").alias(b) for w, b in enumerate(bits)])
            for i, name, kind in own
        ])
        part = df.select(F.explode(held).alias("cell")).select("cell.*").where("v IS NOT NULL").select(*_digest(F.col("kind"), F.col("v")), *bits)
        cells = part if cells is None else cells.union(part)
    if cells is None:
        return spark.createDataFrame([], _INCLUSIONS)
    per_value = cells.groupBy("h0", "h1").agg(*[F.bit_or(b).alias(b) for b in bits])
    sets = per_value.groupBy(*bits).agg(F.count(F.lit(1)).alias("n"))
    members = F.filter(
        F.array(*[F.when(F.col(bits[i // _WORD]).bitwiseAND(F.lit(_signed(1 << i % _WORD)).cast("long")) != 0, F.lit(i)) for i in range(len(columns))]),
        lambda x: x.isNotNull(),
    )
    named = sets.select(members.alias("members"), "n")
    pairs = kept(
        named.select("n", "members", F.explode("members").alias("child")).select("n", "child", F.explode("members").alias("parent"))
        .groupBy("child", "parent").agg(F.sum("n").alias("n_shared"))
    )
    own_values = pairs.where("child = parent").select(F.col("child").alias("id"), F.col("n_shared").alias("n"))
    known = local_frame(spark, {
        "id": (range(len(columns)), pa.int32()), "table": ([c[0] for c in columns], pa.string()), "column": ([c[1] for c in columns], pa.string()),
    }).join(own_values, "id")
    child = known.select(F.col("id").alias("child"), F.col("table").alias("child_table"), F.col("column").alias("child_column"), F.col("n").alias("n_values"))
    parent = known.select(F.col("id").alias("parent"), F.col("table").alias("parent_table"), F.col("column").alias("parent_column"), F.col("n").alias("parent_values"))
    found = pairs.where("child <> parent").join(child, "child").join(parent, "parent")
    found = found.withColumn("coverage", F.col("n_shared") / F.col("n_values")).where(F.col("coverage") >= least)
    return found.select(*[c.split()[0] for c in _INCLUSIONS.split(", ")])


_INCLUSIONS = (
    "child_table string, child_column string, parent_table string, parent_column string,"
    " n_values long, n_shared long, coverage double, parent_values long"
)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _same_name(child: Column, parent: Column) -> Column:
    """Whether the names are equal, or the child's ends with what follows the first underscore of the parent's (o_custkey, c_custkey)."""
    core = F.lower(F.regexp_replace(parent, "^[^_]*_", ""))
    return (F.lower(child) == F.lower(parent)) | ((F.length(core) > 2) & F.lower(child).endswith(core))


def foreign_keys(spark: SparkSession, tables: Mapping[str, DataFrame], least: float = 1.0, by_name: bool = True) -> DataFrame:
    """Inclusions in another column that is unique and never NULL; with ``by_name`` only those whose names agree as well,
    for small ranges of numbers are included in every key."""
    rows = None
    for table, df in tables.items():
        counted = df.agg(F.count(F.lit(1)).alias("parent_rows")).select(F.lit(table).alias("parent_table"), "parent_rows")
        rows = counted if rows is None else rows.union(counted)
    found = inclusions(spark, tables, least)
    if rows is None:
        return found
    # as many different values as rows: unique, and no NULL
    unique = found.join(rows, "parent_table").where("parent_values = parent_rows").drop("parent_rows")
    return (unique.where(_same_name(F.col("child_column"), F.col("parent_column"))) if by_name else unique).select(*found.columns)


# -- keys -----------------------------------------------------------------------

def _passes(items: Sequence, size: int) -> Iterable[Sequence]:
    return (items[i:i + size] for i in range(0, len(items), size))


def unique_sets(df: DataFrame, columns: Sequence[str] | None = None, most: int = 3, all_levels: bool = False) -> list[tuple[str, ...]]:
    """The minimal sets of at most ``most`` columns that identify a row.

    Real numbers and nested columns are not considered unless named, columns with NULLs never.  The search ends with the first level that has a
    key, or goes on to sets of ``most`` columns with ``all_levels``.  The driver holds sets of column names.
    """
    usable = [f.name for f in df.schema.fields if not is_nested(f.dataType) and type_category(f.dataType) != "float"]
    names = list(columns) if columns is not None else usable
    if not names:
        return []
    facts = df.agg(F.count(F.lit(1)), *[F.count(F.col(quoted(n))) for n in names]).first()
    rows = facts[0]
    names = [n for n, present in zip(names, facts[1:]) if present == rows]
    digest = lambda group: F.xxhash64(*[F.col(quoted(n)) for n in group])
    lower = rows * (1 - _ERRORS * _ERROR)
    estimates: dict[tuple[str, ...], int] = {}

    def sketch(groups: Sequence[tuple[str, ...]]) -> None:
        for part in _passes(groups, _SKETCHES):
            found = df.agg(*[F.approx_count_distinct(digest(g), _ERROR) for g in part]).first()
            estimates.update(zip(part, found))

    def unrefuted(groups: Sequence[tuple[str, ...]]) -> list[tuple[str, ...]]:
        """The sets without repeats among the rows of some keys and among some rows; the latter meet any frequent key."""
        if not groups:
            return []
        cells = F.array(*[F.struct(F.lit(i).alias("g"), *_digest(*[F.col(quoted(n)) for n in g])) for i, g in enumerate(groups)])
        some = df.select(F.explode(cells).alias("cell")).select("cell.*").where((F.pmod("h1", F.lit(_SLICES)) == 0) | (F.rand(7) < 1 / _SLICES))
        counts = some.groupBy("g", "h0", "h1").agg(F.count(F.lit(1)).alias("n"))
        repeated = {r[0] for r in counts.where("n > 1").select("g").distinct().collect()}
        return [g for i, g in enumerate(groups) if i not in repeated]

    def verified(group: tuple[str, ...]) -> bool:
        """Whether no two of all rows agree.  One hash of a row is shuffled, both only for rows that share one."""
        h0, h1 = _digest(*[F.col(quoted(n)) for n in group])
        # Hardly a value repeats, so there is nothing to combine in the tasks first.
        counts = df.select(h0).repartition("h0").groupBy("h0").agg(F.count(F.lit(1)).alias("n"))
        shared = kept(counts.where("n > 1").select("h0"))
        if shared.isEmpty():
            return True
        again = df.select(h0, h1).join(shared, "h0", "left_semi").groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("n"))
        return again.where("n > 1").isEmpty()

    keys: list[tuple[str, ...]] = []
    for size in range(1, most + 1):
        groups = [g for g in combinations(names, size) if not any(set(k) <= set(g) for k in keys)]
        # a set cannot have more different rows than the product of its columns' values
        groups = [g for g in groups if size == 1 or math.prod(estimates[(n,)] * (1 + _ERRORS * _ERROR) + 1 for n in g) >= rows]
        sketch(groups)
        keys += sorted(g for g in unrefuted([g for g in groups if estimates[g] >= lower]) if verified(g))
        if keys and not all_levels:
            break
    return keys


def key_frame(spark: SparkSession, found: Mapping[str, Sequence[tuple[str, ...]]]) -> DataFrame:
    """Keys by table as rows (table, columns)."""
    rows = [(t, list(k)) for t, keys in found.items() for k in keys]
    return local_frame(spark, {"table": ([r[0] for r in rows], pa.string()), "columns": ([r[1] for r in rows], pa.list_(pa.string()))})
