"""License scans: whole texts looked up among digests of known licence texts.

A text is brought to a canonical form: lower case, lines with a copyright notice left out, equivalent spellings made
one, everything but letters and digits a separator. Its SHA-256 digest is hash-joined to the digests of the known
texts. The texts looked up are the whole document, each of its paragraphs (between empty lines) and each of its lines.
Known texts of several lines are also looked for as passages: runs of words of the document's canonical form, so that
they are found among other text too, over paragraphs, however their lines are broken and behind comment marks; one that is
also a paragraph of a longer document has a row for either. Texts of one line count only as a whole document,
paragraph or line.

The catalogue is a list of known texts (name, family, text). Texts that are empty in canonical form match nothing, as
no known text is empty. Null texts count as empty. Repeated rows get equal results, an empty table gives an empty one.
Other columns stay inside the struct `row`.
"""

from __future__ import annotations

import importlib.resources
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Notices and short licence texts as their owners publish them (name, family, text).
KNOWN = (
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", "Licensed under the MIT License."),
    ("MIT", "permissive", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "permissive", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "copyleft", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "non-commercial", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "permissive", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "copyleft", "Licensed under CC BY-SA 4.0."),
    ("MIT", "permissive", """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions:

        The above copyright notice and this permission notice shall be included in all copies or substantial portions
        of the Software.

        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
        IN THE SOFTWARE."""),
    ("ISC", "permissive", """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.

        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
        ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Unlicense", "public-domain", "This is free and unencumbered software released into the public domain."),
)
# Full texts, standard file headers and SPDX identifiers, kept as a data file of the same rows.
KNOWN += tuple(map(tuple, json.loads((importlib.resources.files("plumbline.llm") / "known_licenses.json").read_text("utf-8"))))
# Spellings that count as one (pattern, one of them). They stand for whole words.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("copyright owner", "copyright holder"),
    ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("favour", "favor"), ("per cent", "percent"),
    ("redistribute and or modify", "redistribute and modify"), ("version 2", "version 2 0"), ("version 3", "version 3 0"), ("version 2 0 0", "version 2 0"), ("version 3 0 0", "version 3 0"),
    ("https", "http"),
)
#: A line that is a copyright notice: the sign first, or the word with a sign, a year or a blank to be filled in. Lines of
#: the text itself that begin with the word, or with the letter of a list, are none.
COPYRIGHT_LINE = r"(?md)^[^a-z0-9\n]*(?:copyright[^a-z0-9\n]*(?:\(c\)|©|[12][0-9]{3}|[<\[{])|\(c\)[^a-z0-9\n]*(?:copyright|[12][0-9]{3})|©)[^\n]*$"
SEPARATOR = r"[^a-z0-9]+"
EMPTY_LINE = r"\n[\x20\x09\x0B-\x0D]*\n"


def canonical(text: Column) -> Column:
    """The canonical form of a text: words between single spaces, one space at either end."""
    plain = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, SEPARATOR, " ")), F.lit(" "))
    for spelling, one in SPELLINGS:
        words = F.replace(words, F.lit(f" {spelling} "), F.lit(f" {one} "))
    return words


def catalogue(spark: SparkSession, known: tuple[tuple[str, str, str], ...] = KNOWN) -> DataFrame:
    """(digest, form, license, family) of known texts; of texts that are equal in canonical form the first name stands."""
    df = spark.createDataFrame([k for k in known if k[2].strip()], "license string, family string, known string")
    forms = df.select("license", "family", canonical(F.col("known")).alias("form")).filter(F.trim("form") != "")
    return forms.groupBy(F.sha2("form", 256).alias("digest"), "form").agg(F.min("license").alias("license"), F.min_by("family", "license").alias("family"))


def passages(known: tuple[tuple[str, str, str], ...] = KNOWN) -> list[str]:
    """The known texts of more than one line."""
    return [text for _, _, text in known if len([line for line in text.splitlines() if line.strip()]) > 1]


def _needed(texts: list[list[str]]) -> list[str]:
    """Few long words of which each text has one; none is changed by SPELLINGS."""
    changed = {w for pair in SPELLINGS for spelling in pair for w in spelling.split()}
    left, out = [set(words) - changed for words in texts], []
    while left:
        size = lambda w: (min(len(w), 12), sum(w in words for words in left), w)
        out.append(max(set().union(*left), key=size))
        left = [words for words in left if out[-1] not in words]
    return out


def _marked(words: list[str], text: Column) -> Column:
    """Whether a text holds one of the words, of which every known text has one."""
    lower, out = F.lower(text), F.lit(False)
    for word in words:
        out |= lower.contains(word)
    return out


#: Words at the beginning of a known text by which its places in a document are found.
_ANCHOR = 6


def _passages(docs: DataFrame, known: DataFrame, texts: list[str], plain: Column) -> DataFrame:
    """Rows of scan() for texts that stand inside a longer document; place is the number of words before. Where a known
    text's first words stand, the digest of as many words as it has is looked up among the known ones."""
    spark = docs.sparkSession
    forms = spark.createDataFrame([(t,) for t in texts], "known string").select(canonical(F.col("known")).alias("form")).distinct()
    held_words = [r.form.split() for r in forms.collect()]  # of the catalogue, not of the documents
    anchor = min(_ANCHOR, *map(len, held_words))
    starts = sorted({" ".join(words[:anchor]) for words in held_words})
    sizes = spark.createDataFrame([(start, sorted({len(w) for w in held_words if " ".join(w[:anchor]) == start})) for start in starts], "start string, sizes array<int>")
    held = docs.filter(_marked(_needed(held_words), plain)).select(F.struct("*").alias("row"), canonical(plain).alias("words")).filter(F.col("words").rlike(f" (?:{'|'.join(starts)}) "))
    listed = held.select("row", F.split(F.trim("words"), " ").alias("ws"))
    at = lambda i, n: F.array_join(F.slice("ws", i, n), " ")
    first = sorted({words[0] for words in held_words})
    places = F.filter(F.sequence(F.lit(1), F.size("ws")), lambda i: F.element_at("ws", i).isin(*first) & at(i, F.lit(anchor)).isin(*starts))
    spots = listed.select("row", "ws", F.explode(places).alias("i")).withColumn("start", at(F.col("i"), F.lit(anchor)))
    runs = spots.join(F.broadcast(sizes), "start").withColumn("n", F.explode("sizes")).filter((F.col("i") + F.col("n") <= F.size("ws") + 1) & (F.col("n") < F.size("ws")))
    digests = runs.select("row", (F.col("i") - 1).alias("place"), F.sha2(F.concat(F.lit(" "), at(F.col("i"), F.col("n")), F.lit(" ")), 256).alias("digest"))
    return digests.join(F.broadcast(known), "digest").select("row", F.lit("passage").alias("unit"), "place", "license", "family")


def scan(docs: DataFrame, known: DataFrame, text: str = "text", texts: list[str] | None = None) -> DataFrame:
    """(row, unit, place, license, family) for each text in docs that is a known one: unit is document, paragraph or
    line, place its number from 0, row the row of docs as a struct; or unit is passage and place the number of words
    before it. known: from catalogue(); it has a row per known text and is broadcast for that. texts: from passages() of
    the same known texts."""
    plain = F.coalesce(F.col(text), F.lit(""))
    named = lambda unit, parts: F.transform(parts, lambda p, i: F.struct(F.lit(unit).alias("unit"), i.alias("place"), p.alias("part")))
    units = F.concat(named("document", F.array(plain)), named("paragraph", F.split(plain, EMPTY_LINE, -1)), named("line", F.split(plain, r"\n", -1)))
    # Only texts that hold a word without which no known text is are brought to canonical form.
    needed = _needed([r.form.split() for r in known.select("form").collect()])
    spread = docs.filter(_marked(needed, plain)).select(F.struct("*").alias("row"), F.explode(units).alias("u")).filter(_marked(needed, F.col("u.part")))
    digests = spread.select("row", "u.unit", "u.place", F.sha2(canonical(F.col("u.part")), 256).alias("digest"))
    short = known.select("digest", "license", "family")
    whole = digests.join(F.broadcast(short), "digest").select("row", "unit", "place", "license", "family")
    texts = passages() if texts is None else texts
    return whole.union(_passages(docs, short, texts, plain)) if texts else whole
