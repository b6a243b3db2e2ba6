"""Masking of personal values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

_BLANK = "***"


def mask_value(value: Column, category: Column) -> Column:
    """The value with all but a few characters hidden, by category of the data.

    contact with an @   first character and the domain
    contact, a number   first three characters
    identity            first character of each word
    financial           last four digits
    anything else       first two characters
    """
    text = F.regexp_replace(value.cast("string"), r"(?U)^\s+|\s+$", "")
    at = F.instr(text, "@")
    local = F.substring_index(text, "@", 1)
    domain = F.substring(text, at + F.lit(1), F.length(text))
    words = F.split(text, r"(?U)\s+")
    digits = F.regexp_replace(text, r"(?U)\D", "")
    return (
        F.when(value.isNull(), None)
        .when(text == "", F.lit(_BLANK))
        .when((category == "contact") & (at > 0), F.concat(F.left(local, F.lit(1)), F.lit("***@"), domain))
        .when((category == "contact") & text.rlike(r"(?U)^\+?\d"), _keep(text, 3))
        .when(category == "identity", F.array_join(F.transform(words, lambda w: F.concat(F.left(w, F.lit(1)), F.lit("***"))), " "))
        .when((category == "financial") & (F.length(digits) >= 4), F.concat(F.lit("**** **** **** "), F.right(digits, F.lit(4))))
        .when(category == "financial", F.repeat(F.lit("*"), F.length(text)))
        .otherwise(_keep(text, 2))
    )


def _keep(text: Column, n: int) -> Column:
    hidden = F.greatest(F.length(text) - F.lit(n), F.lit(0))
    return F.concat(F.left(text, F.lit(n)), F.repeat(F.lit("*"), hidden))


def personal_values(df: DataFrame, text: str, patterns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """The values in free text that match one of the patterns, masked: the other columns of df, kind, masked.

    ``patterns`` gives by kind the category to mask by and the expression to look for.
    One read of the text serves all kinds.
    """
    found = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("values"))
        for kind, (_, pattern) in patterns.items()
    ])
    others = [c for c in df.columns if c != text]
    values = df.select(*others, F.inline(found)).select(*others, "kind", F.explode("values").alias("value"))
    masked = F.coalesce(*[
        F.when(F.col("kind") == kind, mask_value(F.col("value"), F.lit(category))) for kind, (category, _) in patterns.items()
    ])
    return values.select(*others, "kind", masked.alias("masked"))
