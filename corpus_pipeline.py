"""A pipeline from raw documents to token ids: toxicity, line dedup, near duplicates, mixing, encoding.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the docs of the next. All but the last return the columns of docs. In every stage a null
text counts as empty (line dedup leaves it null), repeated rows are met as rows, and an empty table gives an empty one.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, line_dedup, mixing, shingles, toxicity
from plumbline.llm.common import stored, table, temporary

REJECTED_FROM = 0.5
#: Rows that a Python worker gets at a time. Texts are long, and both sides of the pipe hold a batch.
BATCH = 1_000
#: The stages hold learnt weights and fixpoints, which SQL cannot express.
ORACLE_SQL = None


def _rows_with(found: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of docs from the struct `row`, with another text and its number of code points."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below REJECTED_FROM."""
    model = toxicity.Model.fit(docs, table(spark, sf_dir, "labels"))
    scored = model.score(docs.select(F.struct("*").alias("row"), F.col("text").alias("own_text")), "own_text", "toxic_score")
    return scored.filter(F.col("toxic_score") < REJECTED_FROM).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that match earlier ones."""
    return _rows_with(line_dedup.drop_repeated_lines(docs), docs, F.col("text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more): the first by
    doc_id (null last), then by a hash of the text."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("dh"))
    with temporary(spark):
        ranked = shingles.groups(docs).select(F.struct(F.col("id").isNull().alias("last"), "id", "dh").alias("who"), F.col("group").alias("component"))
        kept = stored(ranked.groupBy("component").agg(F.min("who").alias("who")).select("who.id", "who.dh"), keep=True)
    same = rows.id.eqNullSafe(kept.id) & (rows.dh == kept.dh)
    found = rows.join(kept, same, "left_semi")
    repeated = stored(rows.groupBy("id", "dh").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", "dh"))
    again = found.id.eqNullSafe(repeated.id) & (found.dh == repeated.dh)
    once = found.join(repeated, again, "left_anti").select("row")
    one = found.join(repeated, again, "left_semi").dropDuplicates(["id", "dh"]).select("row")
    return once.union(one).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last of a source may be cut."""
    return _rows_with(mixing.draw(mixing.mix(docs)), docs, F.col("text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and whether they decode to its text."""
    tokenizer = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.json"))
    done = tokenizer.round_trip(docs.select("doc_id", "source", "text"))
    return done.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def _short_batches(stage: Callable) -> Callable:
    """The stage, with the session's batches for Python workers lowered to BATCH rows if they are longer."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(name)) <= BATCH:
            spark.conf.set(name, BATCH)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", _short_batches(drop_toxic)),
    ("line_dedup", _short_batches(drop_repeated_lines)),
    ("simhash_near_dedup", _short_batches(drop_near_duplicates)),
    ("mixing", _short_batches(mix_sources)),
    ("bpe", _short_batches(encode)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stored(docs) if k + 1 < len(STAGES) else docs
    return docs
