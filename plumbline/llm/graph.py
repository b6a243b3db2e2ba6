"""Connected components of a graph whose nodes have few neighbours each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored

#: Copies of the table of labels, so that nodes of one large component meet it in many tasks.
SALTS = 64


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b): label is the least node that can be reached.

    Each round takes the least label among the neighbours, then the label of that label, so the number of rounds
    grows with the logarithm of the longest chain. A node's neighbours are met in one task; their number must be
    bounded, as it is for links between distinct fingerprints. No label is collected.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = stored(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next")))
        used = nearer.groupBy(F.col("next").alias("node")).agg(F.lit(1).alias("one"))
        heads = nearer.join(used, "node").select(F.col("node").alias("next"), F.col("next").alias("head"))
        salted = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = nearer.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        moved = stored(spread.join(salted, ["next", "salt"], "left").select("node", "label", F.least("next", "head").alias("next")))
        if moved.filter("label <> next").isEmpty():
            return moved.select("node", "label")
        labels = moved.select("node", F.col("next").alias("label"))
