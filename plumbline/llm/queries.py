"""One query per operator over its whole table, and the same answers in SQL where SQL can give them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, fingerprints, licenses, line_dedup, lm, mixing, phrases, quality, secrets, simhash, spellings, toxicity, vectors
from plumbline.llm.common import table


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text that they decode to, as digests."""
    tokenizer = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.json"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenizer.round_trip(docs).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that match earlier ones, and how many these are."""
    found = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "text", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, paragraph or line that is a known licence text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs, licenses.catalogue(spark)).select("row.doc_id", "unit", "place", "license", "family")


def _canonical_sql(text: str) -> str:
    lines = licenses.COPYRIGHT_LINE.replace("(?md)", "(?m)")
    words = f"' ' || trim(regexp_replace(regexp_replace(lower({text}), '{lines}', '', 'g'), '{licenses.SEPARATOR}', ' ', 'g'), ' ') || ' '"
    for spelling, one in licenses.SPELLINGS:
        words = f"replace({words}, ' {spelling} ', ' {one} ')"
    return f"sha256({words})"


def _op3_sql() -> str:
    known = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in licenses.KNOWN)
    parts = ("document", "[t]"), ("paragraph", f"string_split_regex(t, '{licenses.EMPTY_LINE}')"), ("line", "string_split(t, chr(10))")
    units = " UNION ALL ".join(f"SELECT doc_id, '{unit}' AS unit, unnest(range(len(p)))::INT AS place, unnest(p) AS part FROM (SELECT doc_id, {split} AS p FROM docs)" for unit, split in parts)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
known AS (SELECT {_canonical_sql("known")} AS digest, min(license) AS license, arg_min(family, license) AS family
  FROM (VALUES {known}) v(license, family, known) GROUP BY 1),
units AS ({units})
SELECT doc_id, unit, place, license, family FROM units JOIN known ON {_canonical_sql("part")} = digest
"""


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.Model.fit(docs).find(docs)
    of = lambda name: F.filter("secrets", lambda s: s["kind"] == name)
    base = F.filter("secrets", lambda s: s["number"] < len(secrets.PATTERNS))
    return found.select(
        "doc_id",
        *(F.size(of(name)).cast("long").alias(f"n_{name}") for name, _, _ in secrets.PATTERNS),
        F.sha2(secrets.as_text(base), 256).alias("base_sha256"),
        secrets.as_text(F.col("secrets")).alias("spans"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words a mix of the sources takes of each document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    taken = F.col("size") * F.col("epochs") + F.col("part")
    return mixed.select("row.doc_id", "size", "source_size", "target", taken.alias("taken"))


OP5_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    len(regexp_extract_all(coalesce(text, ''), '[^\p{L}\x20\x09-\x0D]')) AS odd FROM documents),
keyed AS (
  SELECT doc_id, source, size, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || t), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
    / CASE WHEN length(t) > 0 THEN greatest(0.25::DOUBLE, (length(t) - odd)::DOUBLE * (length(t) - odd)::DOUBLE / (length(t)::DOUBLE * length(t)::DOUBLE)) ELSE 1::DOUBLE END AS key
  FROM docs),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1]::DOUBLE AS weight, source_size * 2::DOUBLE AS most FROM sizes),
levels AS (
  SELECT *, most / weight AS ratio, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS place,
    (sum(source_size::DOUBLE) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, least(most, coalesce(weight * (SELECT arg_min(level, place) FROM levels WHERE level <= ratio), most)) AS target FROM levels),
summed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM keyed),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, s.ahead, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs
  FROM summed s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * epochs + greatest(0, least(size, round(target - epochs * source_size)::BIGINT - ahead)))::BIGINT AS taken
FROM placed
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a model of the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    teaches = ~toxicity.held_out(F.col("doc_id"), 5, 0)
    model = toxicity.Model.fit(docs, table(spark, sf_dir, "labels"), teaches=teaches)
    return model.score(docs).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document, the base rules' verdict, and the trees' on what passes these."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.Rules.fit(docs, table(spark, sf_dir, "labels"))
    scored = rules.score(quality.statistics(docs)).select("doc_id", "counts.*", "quality")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return scored.select(*base, failed.alias("base_failed"), (~failed & (F.col("quality") >= 0.5)).alias("kept"), "quality")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how like they and the next document's are."""
    found = fingerprints.versions(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.shown(F.col("own")).alias("fingerprint"),
        fingerprints.shown(F.col("changed")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        fingerprints.likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by models of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    apart = toxicity.held_out(F.col("doc_id"), 7, 2)
    model = lm.Model.fit(docs.filter(~apart))
    return model.score(docs).select(
        "doc_id", apart.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    found = vectors.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


OP11_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND list_aggregate(embedding, 'count') = len(embedding)
    AND isfinite(list_aggregate(embedding::DOUBLE[], 'sum')) AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_inner_product(x.v, y.v) / sqrt(list_inner_product(x.v, x.v) * list_inner_product(y.v, y.v)) >= 0.9),
reached(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY 1),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l USING (vec_id) LEFT JOIN counts c USING (vec_id)
"""


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with the form that it is a variant of."""
    return spellings.group(table(spark, sf_dir, "documents"), spellings.marked)


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language that their parts explain least."""
    return phrases.mine(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, part FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part FROM documents)),
lists AS (SELECT lang, piece, regexp_extract_all(part, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists WHERE len(w) > 0),
grams AS (SELECT lang, m, w[i:i + m - 1] AS p FROM places, (VALUES (1), (2), (3)) v(m) WHERE i + m - 1 <= len(w)),
counts AS (SELECT lang, m, p, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY 1),
candidates AS (SELECT * FROM counts WHERE m > 1 AND n >= 10),
cuts AS (SELECT lang, m, p, n AS a, unnest(range(1, m)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.p, c.a, c.k, x.n AS l, y.n AS r, (1000000::HUGEINT * c.a * c.a // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.m = c.k AND x.p = c.p[1:c.k]
  JOIN counts y ON y.lang = c.lang AND y.m = c.m - c.k AND y.p = c.p[c.k + 1:c.m]),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
covered AS (
  SELECT lang, part, max(n) AS most FROM (SELECT lang, n, unnest([p[1:2], p[2:3]]) AS part FROM candidates WHERE m = 3) GROUP BY ALL),
kept AS (SELECT w.* FROM weakest w LEFT JOIN covered c ON c.lang = w.lang AND c.part = w.p WHERE c.most IS NULL OR 100 * c.most < 50 * w.a),
ranked AS (
  SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, t.n AS n, score FROM ranked JOIN totals t USING (lang) WHERE rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe_roundtrip, op2_line_dedup, op3_license_scan, op4_secret_scan, op5_mixing, op6_toxicity, op7_quality_rules, op8_simhash_near_dedup, op9_fingerprints, op10_lm_scoring, op11_embedding_near_dedup, op12_spelling_groups, op13_phrase_mining)}


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": _op3_sql(), "op5_mixing": OP5_SQL, "op11_embedding_near_dedup": OP11_SQL, "op13_phrase_mining": OP13_SQL}
