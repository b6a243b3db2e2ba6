import random
import re
import textwrap

from pyspark.sql import functions as F

from plumbline.llm import licenses, queries
from validation.compare import difference, duck


def test_query_against_sql(spark, sf):
    assert difference(spark, duck(sf), queries.op3_license_scan, queries.oracle_sql()["op3_license_scan"], sf) is None


def test_variants_of_known_texts(spark, make_docs, edge_docs, empty_docs):
    mit = next(text for name, _, text in licenses.KNOWN if name == "MIT" and len(text) > 500)
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper()), (2, "text before\n\n" + " ".join(mit.split("\n\n")[0].split()) + "\n\nafter"),
            (3, "a\nRELEASED  under the MIT licence!\nb"), (4, mit[:-20]), (5, "licensed under the Apache Licence, version 2"), (6, None), (7, "")]
    known = licenses.catalogue(spark)
    found = sorted((r.row.doc_id, r.unit, r.place, r.license) for r in licenses.scan(make_docs(rows, "unit place digest license found u"), known).collect())
    assert found == [(1, "document", 0, "MIT"), (3, "line", 1, "MIT"), (5, "document", 0, "Apache-2.0"), (5, "line", 0, "Apache-2.0"), (5, "paragraph", 0, "Apache-2.0")]
    assert licenses.scan(edge_docs, known).count() == 0 == licenses.scan(empty_docs, known).count()


def test_whole_licences_among_other_text(spark, make_docs):
    """At the end of a README, as comment lines in a longer paragraph, and twice in one document."""
    mit, isc = (next(text for name, _, text in licenses.KNOWN if name == wanted and len(text) > 500) for wanted in ("MIT", "ISC"))
    lines = [line.strip() for line in mit.strip().splitlines()]
    comment = "\n".join(f"# {line}".rstrip() if line else "#" for line in lines)
    wrapped = "\n".join(f" * {' '.join(isc.split()[k : k + 9])}" for k in range(0, len(isc.split()), 9))
    rows = [(1, "# Tool\n\nIt does things.\n\nCopyright (c) 2020 Someone\n\n" + mit), (2, f"# a.py\n# Copyright 2020 Someone\n{comment}\nimport os\n"),
            (3, f"one two\n{wrapped}\nthree\n\n{wrapped}\nfour"), (4, "a b\n" + mit[:-20] + "\nc"), (5, mit)]
    found = sorted((r.row.doc_id, r.unit, r.place, r.license) for r in licenses.scan(make_docs(rows), licenses.catalogue(spark)).collect())
    n = len("".join(c if c.isalnum() else " " for c in isc).split())
    assert found == [(1, "passage", 4, "MIT"), (2, "passage", 2, "MIT"), (3, "passage", 2, "ISC"), (3, "passage", 3 + n, "ISC"), (5, "document", 0, "MIT")]


def test_common_licences_headers_and_identifiers(spark, make_docs):
    """Against texts as they are used in source files."""
    apache = """# Copyright 2021 Someone
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     https://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
import os"""
    gpl = """/* This program is free software: you can redistribute it and/or modify it
 * under the terms of the GNU General Public License as published by the Free
 * Software Foundation, either version 3 of the License, or (at your option)
 * any later version. */
int x;"""
    whole = [(name, text) for name, _, text in licenses.KNOWN if len(text) > 1000]
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "MIT"} <= {name for name, _ in whole}
    rows = [(1, apache), (2, gpl), (3, "a\n// SPDX-License-Identifier: BSD-3-Clause\nb"), *((10 + k, f"intro\n\n{text}\n\nend") for k, (_, text) in enumerate(whole))]
    found = {(r.row.doc_id, r.license) for r in licenses.scan(make_docs(rows), licenses.catalogue(spark)).collect()}
    assert {(1, "Apache-2.0"), (2, "GPL-3.0-or-later"), (3, "BSD-3-Clause"), *((10 + k, name) for k, (name, _) in enumerate(whole))} <= found


def test_every_known_text_however_its_lines_are_broken(spark, make_docs):
    """Wrapped at several widths and behind comment marks, so that lines begin with any of its words, "copyright" among them."""
    known = sorted({text for text in licenses.passages()})
    docs, notice = [], re.compile(licenses.COPYRIGHT_LINE.replace("(?md)", "(?m)"))

    def wrapped(text, width, mark):
        parts = [p if notice.search(p.lower()) else textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in re.split(r"\n\s*\n", text)]
        return "\n".join(mark + line for line in "\n\n".join(parts).split("\n"))

    for width, mark in ((60, ""), (66, "# "), (71, "// "), (77, " * "), (83, ""), (100, "; ")):
        docs += [(len(docs) + k, f"intro\n{wrapped(text, width, mark)}\nend of file") for k, text in enumerate(known)]
    assert any(re.search(r"(?m)^copyright (?!\(c\))", text.lower()) for _, text in docs)
    forms = {r.doc_id: r.digest for r in make_docs([(k, text) for k, text in enumerate(known)]).select("doc_id", F.sha2(licenses.canonical(F.col("text")), 256).alias("digest")).collect()}
    names = {r.digest: r.license for r in licenses.catalogue(spark).collect()}
    found = {(r.row.doc_id, r.license) for r in licenses.scan(make_docs(docs), licenses.catalogue(spark)).filter("unit = 'passage'").collect()}
    missed = [doc for doc, _ in docs if (doc, names[forms[doc % len(known)]]) not in found]
    assert not missed


def test_notices_and_lines_that_only_begin_like_one(spark, make_docs):
    lines = ["Copyright (c) 2020 A", "COPYRIGHT 1999, B", "# Copyright © C", "© D", "(c) 2001 E", "Copyright [yyyy] [name]", "copyright <year> f"]
    plain = ["copyright notice and this permission notice", "Copyright holders be liable", "(c) You must retain", "copyright c x"]
    docs = make_docs([(k, f"{line}\nx") for k, line in enumerate(lines + plain)])
    kept = {r.doc_id: r.words for r in docs.select("doc_id", licenses.canonical(F.col("text")).alias("words")).collect()}
    assert [k for k, words in sorted(kept.items()) if words == " x "] == list(range(len(lines)))


def test_passages_against_every_run_of_words(spark, make_docs):
    """Short known texts that begin alike, overlap and repeat, against all runs of words of the documents."""
    known = [("A", "f", "one two three four five six\nseven"), ("B", "f", "one two three four five six\nseven eight"), ("C", "f", "six seven\none two three four five"), ("D", "f", "one one one\none one one one"), ("E", "f", "solo\nword end of it all here")]
    rng = random.Random(1)
    words = "one two three four five six seven eight solo word end of it all here".split()
    texts = [" ".join(t for _ in range(8) for t in (rng.choice(known)[2].split() if rng.random() < 0.7 else [rng.choice(words)])) for _ in range(40)] + ["one " * 9, known[0][2], ""]
    catalogue = licenses.catalogue(spark, tuple(known))
    scanned = licenses.scan(make_docs(list(enumerate(texts))), catalogue, texts=licenses.passages(tuple(known)))
    got = sorted((r.row.doc_id, r.place, r.license) for r in scanned.filter("unit = 'passage'").collect())
    want = []
    for doc, text in enumerate(texts):
        ws = text.split()
        for name, _, form in known:
            f = form.split()
            want += [(doc, i, name) for i in range(len(ws) - len(f) + 1) if ws[i : i + len(f)] == f and len(f) < len(ws)]
    assert got == sorted(want) and len(want) > 50
