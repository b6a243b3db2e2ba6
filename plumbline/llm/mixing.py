"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share by weight, at most CAP times its size, with what is over the cap shared again by weight
among the others until none is above. Complete epochs come first: a source gives all its documents as often as its
target holds its size. The rest is a fraction of an epoch. Every document draws the key -ln(u) / quality, u from a
digest of doc_id and text; documents are taken from the least key on until their sizes add up to the fraction, and the
last is taken in part, so a source meets its target to the word. Documents of more quality come sooner on average.

Everything is a DataFrame operation. Sizes are added up in slices of the range of keys, about SLICE documents each,
first over the slices of a source and then within a slice, so a source of any size is spread over many tasks. Only
the sources themselves, one row each, are ranked in one task.

Null and empty texts have size 0, are never taken and get key order like others. A null source is a source, the last
in order. Rows with equal doc_id and text draw equal keys; the prefix sums run over them in any order, which changes
nothing as they are alike. With no words at all every target is 0. An empty table gives an empty result. Extra columns
stay inside the struct `row`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, stored, words_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SLICE = 5_000
LEAST_QUALITY = 0.25


def quality(text: Column) -> Column:
    """A weight from LEAST_QUALITY to 1: the share of letters and white space among the code points, squared."""
    n = F.length(text)
    plain = (n - F.regexp_count(text, F.lit(r"[^\p{L}\x20\x09-\x0D]"))).cast("double")
    return F.when(n > 0, F.greatest(F.lit(LEAST_QUALITY), plain * plain / (n.cast("double") * n))).otherwise(F.lit(1.0))


def uniform(doc_id: Column, text: Column) -> Column:
    """A number between 0 and 1, from the leading 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source. Weights repeat over the sources in
    code-point order, null last. The level at which no source is above its cap is found in one pass: with the sources
    in the order of cap / weight, those before the first whose own level holds are full."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sizes.withColumn("weight", cycle).withColumn("most", F.col("source_size") * float(cap))
    order = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    wanted = F.sum("source_size").over(whole) * float(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = weighed.withColumn("level", wanted / weight_left).withColumn("place", F.row_number().over(order)).withColumn("holds", F.col("level") <= F.col("most") / F.col("weight"))
    level = F.min(F.when(F.col("holds"), F.struct("place", "level"))).over(whole)["level"]
    return levels.withColumn("common", level).select("source", "source_size", F.least("most", F.coalesce(F.col("weight") * F.col("common"), F.col("most"))).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None, **shares) -> DataFrame:
    """(row, size, source_size, target, epochs, part) for each row of docs: the row as a struct (of the columns in
    keep, or all), its words, those of its source, the source's target, how often the whole document is taken, and how
    many of its first words are taken once more."""
    plain = F.coalesce(F.col(text), F.lit(""))
    drawn = stored(docs.select(
        F.struct(*(keep or ["*"])).alias("row"), F.col(source).alias("source"), words_of(F.col(text)).alias("size"),
        (-F.log(uniform(F.col(doc_id), plain)) / quality(plain)).alias("key"),
    ))
    sources = targets(drawn.groupBy("source").agg(F.sum("size").alias("source_size")), **shares)
    slices = max(1, -(-drawn.count() // SLICE))
    # The slice grows with the key, and none gets more than 1 / LEAST_QUALITY times its part of the documents.
    named = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")).alias("name")
    sliced = drawn.select("*", named, F.floor((1 - F.exp(-F.col("key") * LEAST_QUALITY)) * slices).alias("slice"))
    before = W.partitionBy("name").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    within = sliced.groupBy("name", "slice").agg(F.sum("size").alias("words"))
    ahead = within.select("name", "slice", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("ahead"))
    starts = stored(ahead.join(sources.select(named, "source_size", "target"), "name"))
    order = W.partitionBy("name", "slice").orderBy("key", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = sliced.withColumn("inside", F.coalesce(F.sum("size").over(order), F.lit(0))).join(starts, ["name", "slice"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    fraction = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), fraction - F.col("ahead") - F.col("inside")))
    return placed.select("row", "size", "source_size", "target", epochs.cast("long").alias("epochs"), part.cast("long").alias("part"))


def draw(mixed: DataFrame, text: str = "text") -> DataFrame:
    """(row, text): the documents of a mix, each as often as it is taken; where only a part is, its first words."""
    taken = F.filter(F.concat(F.array_repeat("size", F.col("epochs").cast("int")), F.array("part")), lambda n: n > 0)
    words = F.slice(F.regexp_extract_all(F.col(f"row.{text}"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), 0), F.lit(1), F.col("n").cast("int"))
    drawn = mixed.withColumn("n", F.explode(taken))
    return drawn.select("row", F.when(F.col("n") == F.col("size"), F.col(f"row.{text}")).otherwise(F.array_join(words, "")).alias("text"))
