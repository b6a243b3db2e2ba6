"""Values that are equal but for a few edits (inserted, deleted or replaced characters).

Pairs come from an exact self-join by partition segments.  A value of length l is
cut into edits + 1 even segments; a value within ``edits`` of it holds one of them
unchanged, at a place that can be shifted only as far as the edits left over for both
sides allow.  So a value is indexed by (length, segment number, segment) and looks
for the segments of its own length and of those up to ``edits`` shorter.

A segment that many values share (``CUSTOMER#``) would bring all of them together.
Where more than MEETINGS pairs would meet, the entries of the segment are keyed once more, by what
is left of them after up to ``edits`` deletions: values within that distance
have one such rest in common, and few values share a rest.  No pair is lost, no bucket
is cut, and what meets is verified with ``levenshtein``.

All joins are by sort and merge: their tables grow with the values, and a table that is small as
Parquet may be large when the driver unpacks it for a broadcast.

Groups are the connected components of the pairs.  They need no more pairs than hold each
component together, so they come from numbered values and links, in time that grows with
the values and not with the pairs (``_links``): of m segments, all but ``edits`` are unchanged and make
one key; a crowded key is cut into twice as many segments, and where what is left is short,
spelled out with ``edits`` wildcards and deletions, so that all values under one such pattern are
within ``edits`` of its first (``_stars``).  The components are found by hooking each node to its least neighbour
and contracting, and by one task as soon as few links are left (``connected``).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from plumbline.functions.predicates import label
from plumbline.sources.scratch import kept

#: Pairs that may meet under one segment before it is keyed more finely.
MEETINGS = 1 << 14
#: Ways of cutting a value that one round may try.
CUTS = 2000
#: Links whose components one task finds.
FEW = 1 << 18
#: Stands between the columns of a tuple, and for a missing part of it.
_BETWEEN, _MISSING = "\x1f", "\x1e"
_CUT, _WILD = "\x1d", "\x1c"
#: Lengths of runs are put into one number; cuts have more than five runs only where all but one segment are given up, as one or two.
_RUN = 1 << 12


def normalised(parts: Sequence[Column]) -> Column:
    """One text for a value or tuple, without case and outer blanks.  NULL for a missing value; a missing part of a
    tuple counts as one odd character."""
    labels = [label(p) for p in parts]
    return labels[0] if len(labels) == 1 else F.concat_ws(_BETWEEN, *[F.coalesce(p, F.lit(_MISSING)) for p in labels])


def _lookups(edits: int) -> list[tuple[bool, int, int, int]]:
    """(indexed, how much shorter, segment, shift): one per segment for the index, then those a value looks for."""
    out = [(True, 0, i, 0) for i in range(edits + 1)]
    for shorter in range(edits + 1):
        for i in range(edits + 1):
            first, last = max(-i, shorter - (edits - i)), min(i, shorter + (edits - i))
            out += [(False, shorter, i, shift) for shift in range(first, last + 1)]
    return out


def _entries(values: DataFrame, edits: int) -> DataFrame:
    """(value, indexed, shorter, key, at, size): the places of the segments of each value."""
    fields = ("indexed", "shorter", "segment", "shift")
    looks = F.array(*[F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, look)]) for look in _lookups(edits)])
    exploded = values.select("value", F.char_length("value").alias("length"), F.explode(looks).alias("look")).select("value", "length", "look.*")
    of = F.col("length") - F.col("shorter")
    even, over = F.floor(of / (edits + 1)).cast("int"), edits + 1 - of % (edits + 1)
    size = even + (F.col("segment") >= over).cast("int")
    at = F.col("segment") * even + F.greatest(F.lit(0), F.col("segment") - over) + F.col("shift")
    placed = exploded.withColumn("of", of).withColumn("size", size).withColumn("at", at)
    inside = placed.where((F.col("of") >= 0) & (F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("length")))
    key = F.xxhash64("of", "segment", F.substring("value", F.col("at") + 1, F.col("size")))
    return inside.select("value", "indexed", "shorter", key.alias("key"), "at", "size")


def _rests(entries: DataFrame, edits: int) -> DataFrame:
    """The entries, once for each rest: the value without its segment and without up to ``edits`` more characters."""
    left, right = F.substring("value", F.lit(1), F.col("at")), F.substring("value", F.col("at") + F.col("size") + 1, F.char_length("value"))
    found = entries.withColumn("rest", F.concat(left, F.lit(_CUT), right))
    for _ in range(edits):
        fewer = F.expr("transform(sequence(1, char_length(rest)), p -> concat(substring(rest, 1, p - 1), substring(rest, p + 1)))")
        whole = F.filter(F.array_union(F.array("rest"), fewer), lambda rest: F.contains(rest, F.lit(_CUT)))
        found = found.withColumn("rest", F.explode(whole))
    return found.withColumn("key", F.xxhash64("key", "rest")).select("value", "indexed", "shorter", "key").distinct()


def _meetings(entries: DataFrame) -> DataFrame:
    x = entries.where("indexed").select("key", F.col("value").alias("x"))
    y = entries.where("NOT indexed").select("key", F.col("value").alias("y"), "shorter")
    once = (F.col("shorter") > 0) | (F.col("x") < F.col("y"))
    return x.join(y.hint("merge"), "key").where(once & (F.col("x") != F.col("y"))).select("x", "y")


def fuzzy_pairs(values: DataFrame, edits: int = 1) -> DataFrame:
    """(left, right, distance), left < right, for different values (column value, NULL ignored) within ``edits``."""
    if edits < 1:
        raise ValueError("edits must be 1 or more")
    entries = kept(_entries(values.select("value").where("value IS NOT NULL").distinct(), edits))
    counts = entries.groupBy("key").agg(F.count_if("indexed").alias("x"), F.count_if(~F.col("indexed")).alias("y"))
    crowded = kept(counts.where(F.col("x") * F.col("y") > MEETINGS).select("key"))
    met = _meetings(entries.join(crowded.hint("merge"), "key", "left_anti"))
    if not crowded.isEmpty():
        met = met.union(_meetings(_rests(entries.join(crowded.hint("merge"), "key", "left_semi"), edits)))
    close = met.distinct().withColumn("distance", F.levenshtein("x", "y", edits)).where("distance > 0")
    return close.select(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"), "distance")


def _cuts(m: int, edits: int) -> list[tuple[int, int, list[tuple[int, int, int, int]]]]:
    """(number, how much shorter, runs): the ways in which a value of m segments may lie in another, those without shifts first.

    ``edits`` segments are given up.  A run is (first segment, end, shift before, shift after): neighbours given up
    together, which take at most as many edits as they are; edits that crowd into one segment spread over its neighbours.
    """
    out = []
    for number, hits in enumerate(itertools.combinations(range(m), edits)):
        runs = [[h for _, h in run] for _, run in itertools.groupby(enumerate(hits), lambda x: x[1] - x[0])]
        for grown in itertools.product(*[range(-len(run), len(run) + 1) for run in runs]):
            shifts = [0, *itertools.accumulate(grown)]
            if 0 <= shifts[-1] <= edits:
                out.append((any(grown), number, shifts[-1], [(run[0], run[-1] + 1, *pair) for run, pair in zip(runs, itertools.pairwise(shifts))]))
    return [cut[1:] for cut in sorted(out, key=lambda cut: cut[0])]


def _tried(cuts: list, m: int, edits: int) -> Column:
    """The cuts as an array.  All have the same number of runs; those that lack some end with empty ones."""
    items = []
    for k, (number, shorter, runs) in enumerate(cuts):
        padded = runs + [(m, m, shorter, shorter)] * (edits - len(runs))
        places = [f"{v} AS {n}{i}" for i, run in enumerate(padded) for n, v in zip("lrba", run)]
        items.append(f"struct({', '.join([f'{k} AS cut', f'{number} AS number', f'{shorter} AS shorter', *places])})")
    return F.expr(f"array({', '.join(items)})")


def _placed(tried: DataFrame, m: int, edits: int) -> DataFrame:
    """With the columns start0, end0, ...: where the runs of a cut (columns of ``_tried``, and of) lie in the value."""
    even, over = F.floor(F.col("of") / m).cast("int"), m - F.col("of") % m
    place = lambda segment: F.col(segment) * even + F.greatest(F.lit(0), F.col(segment) - over)
    starts = [(place(f"l{i}") + F.col(f"b{i}")).alias(f"start{i}") for i in range(edits)]
    return tried.select("*", *starts, *[(place(f"r{i}") + F.col(f"a{i}")).alias(f"end{i}") for i in range(edits)])


def _runs(edits: int) -> list[Column]:
    """What is given up of a placed value."""
    return [F.substring("value", F.col(f"start{i}") + 1, F.col(f"end{i}") - F.col(f"start{i}")) for i in range(edits)]


def _cut_entries(values: DataFrame, cuts: list, m: int, edits: int, least: int) -> DataFrame:
    """(key, id, cut, of): what is not given up of each value, for values it may meet that have ``least`` or more characters."""
    tried = values.select("id", "value", F.explode(_tried(cuts, m, edits)).alias("look")).select("id", "value", "look.*")
    placed = _placed(tried.withColumn("of", F.char_length("value") - F.col("shorter")).where(F.col("of") >= least), m, edits)
    inside = placed.where(" AND ".join(f"start{i} <= end{i}" for i in range(edits)))
    ends = [F.lit(0), *[F.col(f"end{i}") for i in range(edits)]]
    parts = [F.substring("value", since + 1, F.col(f"start{i}") - since) for i, since in enumerate(ends[:-1])]
    return inside.select(F.xxhash64("of", "number", *parts, F.substring("value", ends[-1] + 1, F.char_length("value"))).alias("key"), "id", "cut", "of")


def _given_up(met: DataFrame, values: DataFrame, cuts: list, m: int, edits: int) -> DataFrame:
    """The entries with their values, cuts and places."""
    valued = met.join(values.select("id", "value").hint("merge"), "id")
    looked = valued.select("key", "id", "of", "value", F.element_at(_tried(cuts, m, edits), F.col("cut") + 1).alias("look"))
    return _placed(looked.select("key", "id", "of", "value", "look.*"), m, edits)


def _spelled(given_up: float, edits: int) -> float:
    """About how many patterns a value has, by the number of characters that may differ."""
    kinds = [(w, d) for d in range(edits // 2 + 1) for w in range(edits - 2 * d + 1)]
    return sum(given_up ** (w + d) / (math.factorial(w) * math.factorial(d)) for w, d in kinds)


def _close(met: DataFrame, values: DataFrame, cuts: list, m: int, edits: int) -> DataFrame:
    """Links of the values under one key that are within ``edits``.  Most are told apart by what is given up of them."""
    placed = _given_up(met, values, cuts, m, edits).select("key", "id", "value", F.concat_ws(_CUT, *_runs(edits)).alias("rest"), (F.col("cut") < math.comb(m, edits)).alias("plain"))
    x = placed.where("plain").select("key", F.col("id").alias("x"), F.col("value").alias("xv"), F.col("rest").alias("xr"))
    y = placed.select("key", F.col("id").alias("y"), F.col("value").alias("yv"), F.col("rest").alias("yr"), "plain")
    once = (F.col("x") < F.col("y")) | (~F.col("plain") & (F.col("x") != F.col("y")))
    within = (F.levenshtein("xr", "yr", edits) >= 0) & (F.levenshtein("xv", "yv", edits) >= 0)
    return x.join(y.hint("merge"), "key").where(once & within).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _patterns(met: DataFrame, values: DataFrame, cuts: list, m: int, edits: int) -> DataFrame:
    """(h, g, id, d, room): what is given up of a value, spelled with wildcards and d deletions; room edits are left.

    A pattern is known by two hashes of its key, characters, wildcards' places and the lengths of its runs.  A value that may be n
    longer than those it meets needs n deletions or more, and each one above n stands for one more edit on the other side.
    """
    runs = _runs(edits)
    lengths = sum(F.char_length(run).cast("bigint") * _RUN**i for i, run in enumerate(runs))
    ends = [sum((F.char_length(run) for run in runs[: i + 1]), F.lit(0)).alias(f"upto{i}") for i in range(edits - 1)]
    fixed = ["key", "id", "shorter", "text", *[f"upto{i}" for i in range(edits - 1)]]
    # Few bytes of entries make many patterns: all tasks share them.
    tasks = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = _given_up(met, values, cuts, m, edits).repartition(tasks).select(
        "key", "id", "shorter", F.concat(*runs).alias("text"), *ends, lengths.alias("lengths"), F.lit("").alias("out"), F.lit(0).alias("at"),
        F.lit(0).alias("w"), F.lit(0).alias("d"), F.lit(0).cast("bigint").alias("marks"))
    n = F.char_length("text")
    for _ in range(edits):
        # The next edit: a wildcard (even) or a deletion (odd) at half of this number, or none at the end of the text.
        # The outer form, as for the other one Spark would work out the array once more in a filter; it is never empty.
        state = state.select("*", F.explode_outer(F.sequence(F.col("at") * 2, n * 2)).alias("next"))
        place, last, gone = F.floor(F.col("next") / 2).cast("int"), F.col("next") == n * 2, F.col("next") % 2
        state = state.select(*fixed, "lengths", "out", "at", "w", "d", "marks", place.alias("place"), last.alias("last"), (gone == 1).alias("gone"))
        wild = ~F.col("last") & ~F.col("gone")
        run = F.lit(1).cast("bigint")
        for i in range(edits - 1):
            run = F.when(F.col("place") >= F.col(f"upto{i}"), F.lit(_RUN ** (i + 1)).cast("bigint")).otherwise(run)
        state = state.select(
            *fixed, F.when(F.col("gone"), F.col("lengths") - run).otherwise(F.col("lengths")).alias("lengths"),
            F.concat("out", F.substring("text", F.col("at") + 1, F.col("place") - F.col("at")), F.when(wild, _WILD).otherwise("")).alias("out"),
            F.when(F.col("last"), F.col("place")).otherwise(F.col("place") + 1).alias("at"),
            (F.col("w") + wild.cast("int")).alias("w"), (F.col("d") + F.col("gone").cast("int")).alias("d"),
            F.when(wild, F.xxhash64("marks", F.col("place") - F.col("d"))).otherwise(F.col("marks")).alias("marks"))
        state = state.where(F.col("w") + 2 * F.greatest("d", "shorter") - F.col("shorter") <= edits)
    whole = state.where(F.col("d") >= F.col("shorter")).withColumn("out", F.concat("out", F.substring("text", F.col("at") + 1, n)))
    hashes = [F.xxhash64(F.lit(salt), "out", "key", "w", "marks", "lengths").alias(salt) for salt in ("h", "g")]
    return whole.select(*hashes, "id", "d", (edits - F.col("w") - F.col("d")).alias("room"))


def _stars(met: DataFrame, values: DataFrame, cuts: list, m: int, edits: int) -> DataFrame:
    """Links that hold together the values under one key that are within ``edits``.

    Two values of one pattern with w wildcards, made by d and e deletions, are within w + d + e edits.  So all that
    are near any other are near the first by deletions, and are linked with that.
    """
    first = Window.partitionBy("h", "g").orderBy("d", "id")
    links = _patterns(met, values, cuts, m, edits).select("id", "room", F.first("id").over(first).alias("star"), F.first("d").over(first).alias("gone"))
    return links.where((F.col("id") != F.col("star")) & (F.col("gone") <= F.col("room"))).select(F.col("id").alias("a"), F.col("star").alias("b"))


def _links(values: DataFrame, edits: int) -> DataFrame:
    """(a, b): links between different values (id, value) within ``edits``, enough to connect all that such links connect.

    Two values within ``edits`` share a key in every round that tries their lengths.  They meet there,
    or under a pattern of it, or both are kept for the next round.
    """
    if edits < 1:
        raise ValueError("edits must be 1 or more")
    m, least, found, left = edits + 1, 0, [], values
    cuts = _cuts(m, edits)
    while True:
        then = _cuts(2 * m, edits) if math.comb(2 * m, edits) <= CUTS else []
        finer = 0 < len(then) <= CUTS
        # From this length on, cutting a value again makes fewer entries than spelling it.
        long = next(n for n in itertools.count(1) if _spelled(n * edits / m, edits) > 2 * len(then)) if finer else 1 << 30
        plain = math.comb(m, edits)
        key = Window.partitionBy("key")
        counted = _cut_entries(left, cuts, m, edits, least).withColumn("x", F.count_if(F.col("cut") < plain).over(key)).withColumn("y", F.count(F.lit(1)).over(key)).withColumn("other", F.min("id").over(key) != F.max("id").over(key))
        crowded = F.col("x") * F.col("y") > MEETINGS
        met = kept(counted.where((F.col("x") > 0) & F.col("other")).select("key", "id", "cut", "of", crowded.alias("crowded")))
        few, short, more = (n > 0 for n in met.agg(*[F.count_if(c) for c in (F.expr("NOT crowded"), F.col("crowded") & (F.col("of") < long), F.col("crowded") & (F.col("of") >= long))]).first())
        if few or not found:
            found.append(kept(_close(met.where("NOT crowded"), values, cuts, m, edits).distinct()))
        if short:
            found.append(kept(_stars(met.where(F.col("crowded") & (F.col("of") < long)), values, cuts, m, edits)))
        if not more:
            out = found[0]
            for links in found[1:]:
                out = out.union(links)
            return out
        left = kept(left.join(met.where(F.col("crowded") & (F.col("of") >= long)).select("id").distinct().hint("merge"), "id", "left_semi"))
        m, least, cuts = 2 * m, long, then


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(a, b): for every node of the edges the least node it is connected with, found by one task."""

    def found(batches):
        import pyarrow as pa

        over: dict = {}

        def top(node):
            last = node
            while (above := over.setdefault(last, last)) != last:
                last = above
            while over[node] != last:
                over[node], node = last, over[node]
            return last

        for batch in batches:
            schema = batch.schema
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = top(x), top(y)
                over[max(x, y)] = min(x, y)
        if over:
            nodes = list(over)
            for k in range(0, len(nodes), 10_000):
                part = nodes[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, schema.field(0).type), pa.array([top(n) for n in part], schema.field(1).type)], names=["a", "b"])

    return edges.coalesce(1).mapInArrow(found, StructType([StructField(n, edges.schema[0].dataType) for n in ("a", "b")]))


def _hooked(edges: DataFrame) -> DataFrame:
    """(a, b): for every node that has a smaller neighbour, the end of the way from least neighbour to least neighbour."""
    up = kept(edges.groupBy("a").agg(F.min("b").alias("b")))
    done = []
    while True:
        above = up.select(F.col("a").alias("via"), F.col("b").alias("top"))
        step = kept(up.join(above.hint("merge"), F.col("b") == F.col("via"), "left").select("a", F.coalesce("top", "b").alias("b"), F.col("top").isNotNull().alias("on")))
        done.append(step.where("NOT on").select("a", "b"))
        if step.where("on").isEmpty():
            return done[-1]
        up = step.select("a", "b")


def connected(links: DataFrame) -> DataFrame:
    """(node, group): the least node that can be reached over links (a, b), for every node of a link.

    Each round hooks every node to its least neighbour, if that is smaller, and goes on with the ends of these ways; of two rounds,
    at least half of the nodes that still have neighbours are hooked.  The last links are left to one task.
    """
    edges = kept(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    rounds = []
    while edges.count() > FEW:
        ends = _hooked(edges)
        rounds.append(ends)
        for side in ("a", "b"):
            end = ends.select(F.col("a").alias("node"), F.col("b").alias("end"))
            edges = edges.join(end.hint("merge"), F.col(side) == F.col("node"), "left").withColumn(side, F.coalesce("end", side)).select("a", "b")
        edges = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    found = kept(_in_one_task(edges))
    for ends in reversed(rounds):
        # Ends that the later rounds do not know are the least of their group.
        later = found.select(F.col("a").alias("node"), F.col("b").alias("end"))
        named = ends.join(later.hint("merge"), F.col("b") == F.col("node"), "left").select("a", F.coalesce("end", "b").alias("b"))
        alone = named.select(F.col("b").alias("a"), "b").distinct()
        found = kept(named.union(found).union(alone).distinct())
    return found.select(F.col("a").alias("node"), F.col("b").alias("group"))


def fuzzy_groups(df: DataFrame, columns: Sequence[Column], edits: int = 1) -> DataFrame:
    """(value, rows, group) for every normalised value in a group of more than one row.

    A group holds the values that are linked by pairs within ``edits``, directly or over others; it is named by the
    least of them.  NULL groups with NULL only.  This runs jobs: links and groups take several rounds.
    """
    counted = df.select(normalised(columns).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("rows"))
    # Numbers in the order of the values: the least number of a group is that of its least value.
    values = kept(counted.orderBy("value").select(F.monotonically_increasing_id().alias("id"), "value", "rows"))
    groups = connected(_links(values.where("value IS NOT NULL").select("id", "value"), edits))
    names = values.select(F.col("id").alias("group"), F.col("value").alias("name"))
    named = kept(groups.join(names.hint("merge"), "group").select("node", F.col("name").alias("group")))
    linked = values.join(named.hint("merge"), F.col("id") == F.col("node"), "left")
    return linked.where(F.col("node").isNotNull() | (F.col("rows") > 1)).select("value", "rows", F.coalesce("group", "value").alias("group"))
