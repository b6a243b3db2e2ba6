"""Profile, screen, clone and suggestion queries, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline import ScreenConfig, column_roles, profile, scan, suggest_checks, synthesize, table_entries
from plumbline.functions.masking import mask_value, personal_values
from plumbline.functions.pii_values import EXACT_NAMES, NAME_PARTS, VALUE_PATTERNS
from plumbline.operators import profile as profiling, screen as screening
from plumbline.operators.suggest import _MONEY_WORDS, _NUMBER_WORDS, _TIME_WORDS, specs_frame
from plumbline.operators.synth import clone_tables
from validation.cases import AS_OF
from validation.views import frames, with_views

Query = Callable[[SparkSession, str], DataFrame]

# Columns by kind, for the SQL.  i whole, f real, t time, s text, n nested
COLUMNS = {
    "region": "r_regionkey:i r_name:s",
    "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "customer": "c_custkey:i c_name:s c_nationkey:i c_acctbal:f c_mktsegment:s",
    "supplier": "s_suppkey:i s_name:s s_nationkey:i s_acctbal:f",
    "part": "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:f",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:f o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:f l_extendedprice:f l_discount:f"
                " l_tax:f l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:i ts:t user_id:i event_type:s value:f props:s",
    "documents": "doc_id:i text:s lang:s source:s n_chars:i",
    "embeddings": "vec_id:i embedding:n label:i",
    "pages": "page_id:i url:s html:s",
    "benchmark": "item_id:i text:s",
    "labels": "doc_id:i quality:i toxic:i",
    "conversations": "conv_id:i turn:i role:s text:s",
    "orders_dirty": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:f o_orderdate:t o_orderpriority:s",
    "customer_dirty": "c_custkey:i c_name:s c_nationkey:i c_acctbal:f c_mktsegment:s email:s phone:s balance_text:s"
                      " full_name:s credit_card:s ship_location:s",
}


def _kinds(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in COLUMNS[table].split()]


# -- profiles -------------------------------------------------------------------

def _profile(table: str, distinct: str = "exact") -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = profile(frames(spark, sf_dir).frame(table), table, distinct)
        return p.select(
            F.col("column").alias("column_name"), "ordinal", "category", "row_count",
            F.round("null_rate", 10).alias("null_rate"), "unique_count",
            F.round("cardinality_ratio", 10).alias("cardinality_ratio"), "min_value", "max_value",
            F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"), "is_nullable",
            F.size("top_values").alias("n_top_values"), F.size("sample_values").alias("n_sample_values"),
        )
    return query


_CATEGORY = {"i": "int", "f": "float", "t": "datetime", "s": "str", "n": "str"}


def _profile_sql(table: str) -> str:
    rows = []
    for i, (c, kind) in enumerate(_kinds(table)):
        nested = kind == "n"
        unique = "CAST(NULL AS BIGINT)" if nested else f"count(DISTINCT {c})"
        bounds = kind in "ift"
        number = kind in "if"
        rows.append(
            f"SELECT '{c}' AS column_name, CAST({i} AS INTEGER) AS ordinal, '{_CATEGORY[kind]}' AS category,"
            f" count(*) AS row_count, round((count(*) - count({c}))::DOUBLE / count(*), 10) AS null_rate,"
            f" {unique} AS unique_count, round({unique}::DOUBLE / count(*), 10) AS cardinality_ratio,"
            f" {f'CAST(min({c}) AS VARCHAR)' if bounds else 'CAST(NULL AS VARCHAR)'} AS min_value,"
            f" {f'CAST(max({c}) AS VARCHAR)' if bounds else 'CAST(NULL AS VARCHAR)'} AS max_value,"
            f" {f'round(avg({c}::DOUBLE), 4)' if number else 'CAST(NULL AS DOUBLE)'} AS mean,"
            f" {f'round(stddev_samp({c}::DOUBLE), 4)' if number else 'CAST(NULL AS DOUBLE)'} AS stddev,"
            f" count(*) > count({c}) AS is_nullable,"
            f" CAST({'NULL' if nested else f'CASE WHEN {unique} <= 100 THEN least({unique}, 50) END'} AS INTEGER) AS n_top_values,"
            f" CAST({'0' if nested else f'least({unique}, 20)'} AS INTEGER) AS n_sample_values FROM {table}"
        )
    return with_views(" UNION ALL ".join(rows))


TOP_TABLES = ("orders_dirty", "customer_dirty", "lineitem", "events", "part", "documents")


def profile_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top values of all columns with at most 100 values, one row per value."""
    tables = frames(spark, sf_dir)
    out = None
    for t in TOP_TABLES:
        p = profile(tables.frame(t), t).select("table", "column", F.explode("top_values").alias("value", "frequency"))
        out = p if out is None else out.unionByName(p)
    return out.select(
        F.col("table").alias("table_name"), F.col("column").alias("column_name"), "value",
        F.round("frequency", 10).alias("frequency"),
    )


def _top_values_sql() -> str:
    rows = []
    for t in TOP_TABLES:
        for c, kind in _kinds(t):
            rows.append(
                f"(SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(v AS VARCHAR) AS value,"
                f" round(n::DOUBLE / (SELECT count(*) FROM {t}), 10) AS frequency FROM"
                f" (SELECT {c} AS v, count(*) AS n, count(*) OVER () AS kinds FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}) g"
                f" WHERE kinds <= 100 ORDER BY n DESC, CAST(v AS VARCHAR) LIMIT 50)"
            )
    return with_views(" UNION ALL ".join(rows))


def profile_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = frames(spark, sf_dir)
    return screening.table_counts({t: tables.frame(t) for t in COLUMNS}).withColumnRenamed("table", "table_name")


def _row_counts_sql() -> str:
    return with_views(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in COLUMNS))


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.sample_rows(frames(spark, sf_dir).frame("orders_dirty"))


# -- personal data --------------------------------------------------------------

SCREENED = ("customer_dirty", "orders_dirty", "pages", "nation", "events")
FULL = ScreenConfig(sample_size=None)


def _screened(spark: SparkSession, sf_dir: str, names=SCREENED) -> dict[str, DataFrame]:
    tables = frames(spark, sf_dir)
    return {t: tables.frame(t) for t in names}


def screen_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = screening.name_scan(screening.column_listing(spark, _screened(spark, sf_dir, tuple(COLUMNS))))
    rows = screening.table_counts(_screened(spark, sf_dir, tuple(COLUMNS)))
    return found.join(rows, "table").select(
        F.col("table").alias("table_name"), F.col("column").alias("column_name"), "row_count",
        "status", "confidence", "category", "pii_type", "detected_via",
    )


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _by_name(column: str) -> tuple[str, float, str | None, str | None]:
    if column in EXACT_NAMES:
        return ("HIGH", 0.95, *EXACT_NAMES[column])
    part = next((p for p in NAME_PARTS if p in column), None)
    return ("MEDIUM", 0.5, *NAME_PARTS[part]) if part else ("CLEAR", 0.0, None, None)


def _names_sql(tables) -> str:
    rows = []
    for t in tables:
        for c, _ in _kinds(t):
            status, confidence, category, kind = _by_name(c)
            rows.append(
                f"SELECT '{t}' AS table_name, '{c}' AS column_name, (SELECT count(*) FROM {t}) AS row_count,"
                f" '{status}' AS status, CAST({confidence} AS DOUBLE) AS confidence,"
                f" CAST({_quote(category) if category else 'NULL'} AS VARCHAR) AS category,"
                f" CAST({_quote(kind) if kind else 'NULL'} AS VARCHAR) AS pii_type,"
                f" '{'none' if status == 'CLEAR' else 'name_match'}' AS detected_via"
            )
    return " UNION ALL ".join(rows)


def screen_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every pattern in every text column of the dirty customers, over all values."""
    columns = [c for c, kind in _kinds("customer_dirty") if kind == "s"]
    hits = screening.full_hits(frames(spark, sf_dir).frame("customer_dirty"), "customer_dirty", columns)
    return hits.select(
        F.col("column").alias("column_name"), "sample_count",
        *[F.get("hits", F.lit(i)).alias(p) for i, p in enumerate(VALUE_PATTERNS)],
    )


def _hit_sql(pattern: str, column: str) -> str:
    regex, ignore_case, _, _ = VALUE_PATTERNS[pattern]
    flags = ", 'i'" if ignore_case else ""
    return f"count(*) FILTER (WHERE regexp_matches(CAST({column} AS VARCHAR), {_quote(regex)}{flags}))"


def _values_sql() -> str:
    rows = []
    for c, kind in _kinds("customer_dirty"):
        if kind == "s":
            hits = ", ".join(f"{_hit_sql(p, c)} AS {p}" for p in VALUE_PATTERNS)
            rows.append(f"SELECT '{c}' AS column_name, count({c}) AS sample_count, {hits} FROM customer_dirty")
    return with_views(" UNION ALL ".join(rows))


def screen_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = screening.screen_columns(spark, _screened(spark, sf_dir), FULL)
    return found.select(
        F.col("table").alias("table_name"), F.col("column").alias("column_name"), "status", "category", "pii_type",
        F.round("confidence", 8).alias("confidence"), "detected_via", "sample_count", "match_count",
        F.size("masked_samples").alias("n_masked"),
    )


def _findings_sql(rows=lambda table, column: table) -> str:
    named = f"SELECT * FROM ({_names_sql(SCREENED)}) n"
    tested = []
    for t in SCREENED:
        for c, kind in _kinds(t):
            if _by_name(c)[0] == "CLEAR" or kind == "n":
                continue
            for place, (p, (_, _, category, pii_type)) in enumerate(VALUE_PATTERNS.items()):
                tested.append(
                    f"SELECT '{t}' AS table_name, '{c}' AS column_name, {place} AS place, {_quote(category)} AS cat,"
                    f" {_quote(pii_type)} AS typ, count({c}) AS n, {_hit_sql(p, c)} AS hits FROM {rows(t, c)}"
                )
    best = (
        "SELECT *, hits::DOUBLE / n AS share FROM (SELECT *, row_number() OVER (PARTITION BY table_name, column_name"
        f" ORDER BY hits DESC, place) AS best FROM ({' UNION ALL '.join(tested)}) t WHERE n > 0) r WHERE best = 1"
    )
    return (
        "SELECT n.table_name, n.column_name,"
        " CASE WHEN b.share >= 0.8 THEN 'HIGH' WHEN b.share >= 0.4 AND n.status <> 'HIGH' THEN 'MEDIUM'"
        " WHEN b.share < 0.4 AND n.status = 'MEDIUM' THEN 'REVIEW' ELSE n.status END AS status,"
        " CASE WHEN b.share >= 0.8 THEN b.cat ELSE n.category END AS category,"
        " CASE WHEN b.share >= 0.8 THEN b.typ ELSE n.pii_type END AS pii_type,"
        " round(CASE WHEN b.share >= 0.8 THEN least(0.99, 0.5 + b.share / 2) ELSE n.confidence END, 8) AS confidence,"
        " CASE WHEN b.share >= 0.4 THEN n.detected_via || '+regex'"
        " WHEN b.share < 0.4 AND n.status = 'MEDIUM' THEN n.detected_via || '+no_regex' ELSE n.detected_via END AS detected_via,"
        " coalesce(b.n, 0) AS sample_count, coalesce(b.hits, 0) AS match_count,"
        " CAST(least(3, coalesce(b.n, 0)) AS INTEGER) AS n_masked"
        f" FROM ({named}) n LEFT JOIN ({best}) b ON n.table_name = b.table_name AND n.column_name = b.column_name"
    )


def screen_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _screened(spark, sf_dir)
    found = screening.screen_columns(spark, tables, FULL)
    return screening.manifests(found, "exclude", screening.table_counts(tables)).select(
        F.col("table").alias("table_name"), "row_count", "high_count", "medium_count", "review_count", "clear_count",
        "gate_decision", "gate_reason", F.size("columns").alias("n_columns"),
    )


def _manifest_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS row_count FROM {t}" for t in SCREENED)
    return (
        "SELECT table_name, row_count, high_count, medium_count, review_count, clear_count,"
        " CASE WHEN high_count + medium_count + review_count > 0 THEN 'PROCEED_EXCLUDE' ELSE 'CLEAR' END AS gate_decision,"
        " CASE WHEN high_count > 0 THEN 'Left out of the scan: ' || high_count || ' columns with certain and ' || medium_count ||"
        " ' with likely personal data.' WHEN medium_count + review_count > 0 THEN 'To be looked at: ' || medium_count ||"
        " ' columns with likely and ' || review_count || ' with possible personal data.'"
        " ELSE 'Nothing looks like personal data.' END AS gate_reason, n_columns FROM"
        " (SELECT table_name, count(*) FILTER (WHERE status = 'HIGH') AS high_count,"
        " count(*) FILTER (WHERE status = 'MEDIUM') AS medium_count, count(*) FILTER (WHERE status = 'REVIEW') AS review_count,"
        " count(*) FILTER (WHERE status = 'CLEAR') AS clear_count, CAST(count(*) AS INTEGER) AS n_columns"
        f" FROM ({_findings_sql()}) f GROUP BY table_name) m JOIN ({rows}) r ON m.table_name = r.t"
    )


def screen_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of all tables, set to go on with synthetic data."""
    found = screening.screen_columns(spark, _screened(spark, sf_dir), FULL)
    return screening.worst_gate(screening.manifests(found, "synthetic"))


def _gate_sql() -> str:
    return (
        "SELECT CASE WHEN bool_or(status = 'HIGH') THEN 'SYNTHETIC_MODE' WHEN bool_or(status <> 'CLEAR') THEN"
        f" 'PROCEED_EXCLUDE' ELSE 'CLEAR' END AS gate_decision FROM ({_findings_sql()}) f"
    )


def screen_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = screening.screen_columns(spark, _screened(spark, sf_dir), FULL)
    return screening.excluded_columns(found).toDF("table_name", "column_name")


def screen_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of two categories only."""
    config = ScreenConfig(sample_size=None, categories=("contact", "financial"))
    found = screening.screen_columns(spark, _screened(spark, sf_dir), config)
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def screen_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The screen as it runs by default: 100 values per flagged column."""
    return screening.screen_columns(spark, _screened(spark, sf_dir)).select(
        "table", "column", "status", "category", "sample_count", "match_count", "masked_samples"
    )


#: Columns that tell the rows of a screened table apart.
SAMPLE_KEYS = {t: (_kinds(t)[0][0],) for t in SCREENED}


def screen_sampled_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings from 100 values per flagged column, drawn by a hash of the key."""
    found = screening.screen_columns(spark, _screened(spark, sf_dir), screening.ScreenConfig(sample_key=SAMPLE_KEYS))
    return found.select(
        F.col("table").alias("table_name"), F.col("column").alias("column_name"), "status", "category", "pii_type",
        F.round("confidence", 8).alias("confidence"), "detected_via", "sample_count", "match_count",
        F.size("masked_samples").alias("n_masked"),
    )


def _sample_sql(table: str, column: str) -> str:
    place = f"substr(md5(concat_ws(chr(31), '42', coalesce(CAST({SAMPLE_KEYS[table][0]} AS VARCHAR), ''))), 1, 13)"
    return f"(SELECT {column} FROM {table} WHERE {column} IS NOT NULL ORDER BY {place}, CAST({column} AS VARCHAR) LIMIT 100) s"


def screen_extra_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date rule and card test over the orders and the dirty customers."""
    tables = frames(spark, sf_dir)
    found = [screening.extra_rule_scan(tables.frame(t), t) for t in ("orders", "customer_dirty")]
    return found[0].unionByName(found[1]).select(
        F.col("column").alias("column_name"), "rule", "values", "hits", F.round("hit_ratio", 10).alias("hit_ratio")
    )


def _extra_rules_sql() -> str:
    digits = "regexp_replace(v::VARCHAR, '[ -]', '', 'g')"
    digit = "substr(d, (len(d) + 1 - i)::INT, 1)::INT"
    luhn = f"list_sum([CASE WHEN i % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END for i in range(1, len(d) + 1)]) % 10 = 0"
    rows = []
    for table in ("orders", "customer_dirty"):
        for name, kind in (c.split(":") for c in COLUMNS[table].split()):
            if kind == "t":
                hits, rule, source = "CAST(v AS DATE) < DATE '2006-01-01'", "date_before_2006", f"SELECT {name} AS v FROM {table}"
            elif kind == "s" or kind == "i" and name not in ("c_nationkey",):
                digits_of = digits if kind == "s" else "v::VARCHAR"
                hits = f"CASE WHEN regexp_full_match(d, '[0-9]{{13,19}}') THEN {luhn} ELSE false END"
                rule, source = "luhn_card", f"SELECT v, {digits_of} AS d FROM (SELECT {name} AS v FROM {table}) x"
            else:
                continue
            rows.append(
                f"SELECT '{name}' AS column_name, '{rule}' AS rule, count(v) AS values, count(*) FILTER (WHERE {hits}) AS hits,"
                f" round(count(*) FILTER (WHERE {hits})::DOUBLE / nullif(count(v), 0), 10) AS hit_ratio FROM ({source}) y"
            )
    return with_views(" UNION ALL ".join(rows))


MASKED = {"email": "contact", "phone": "contact", "full_name": "identity", "credit_card": "financial",
          "balance_text": "other", "ship_location": "contact"}


def mask_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every personal value of the dirty customers, masked."""
    masked = [mask_value(F.col(c), F.lit(category)).alias(c) for c, category in MASKED.items()]
    return frames(spark, sf_dir).frame("customer_dirty").select(F.col("c_name"), *masked)


def _mask_sql(column: str, category: str) -> str:
    stars = "repeat('*', greatest(length({0}) - {1}, 0))"
    keep = lambda v, n: f"left({v}, {n}) || " + stars.format(v, n)
    v = f"trim({column})"
    default = keep(v, 2)
    if category == "contact":
        email = f"left({v}, 1) || '***@' || substr({v}, strpos({v}, '@') + 1)"
        return (
            f"CASE WHEN strpos({v}, '@') > 0 THEN {email} WHEN regexp_matches({v}, '^\\+?[0-9]')"
            f" THEN {keep(v, 3)} ELSE {default} END"
        )
    if category == "identity":
        return f"regexp_replace({v}, '([^ ])[^ ]*', '\\1***', 'g')"
    if category == "financial":
        return f"'**** **** **** ' || right(regexp_replace({v}, '[^0-9]', '', 'g'), 4)"
    return default


def _masked_sql() -> str:
    columns = ", ".join(f"{_mask_sql(c, category)} AS {c}" for c, category in MASKED.items())
    return with_views(f"SELECT c_name, {columns} FROM customer_dirty")


_FOUND = {
    "email": ("contact", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    "card": ("financial", r"[0-9]{13,19}"),
    "ipv4": ("contact", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    "phone": ("contact", r"[0-9]{3}-[0-9]{3}-[0-9]{4}"),
}


def mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal values found in the whole texts of the documents, masked and counted."""
    texts = frames(spark, sf_dir).frame("documents").select("doc_id", "text")
    return personal_values(texts, "text", _FOUND).groupBy("doc_id", "kind", "masked").agg(F.count(F.lit(1)).alias("n"))


def _mask_documents_sql() -> str:
    rows = [
        f"SELECT doc_id, '{kind}' AS kind, {_mask_sql('value', category)} AS masked FROM"
        f" (SELECT doc_id, unnest(regexp_extract_all(text, {_quote(pattern)})) AS value FROM documents) v"
        for kind, (category, pattern) in _FOUND.items()
    ]
    return f"SELECT doc_id, kind, masked, count(*) AS n FROM ({' UNION ALL '.join(rows)}) m GROUP BY doc_id, kind, masked"


# -- clones ---------------------------------------------------------------------

def synth_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clone with as many rows as the original."""
    original = frames(spark, sf_dir).frame("lineitem")
    return synthesize(spark, profile(original, "lineitem"), rows=original.count())


def synth_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a clone of the dirty orders keeps of each column: rows, share of NULLs, bounds, the values of few-valued text."""
    original = frames(spark, sf_dir).frame("orders_dirty")
    clone = synthesize(spark, profile(original, "orders_dirty"), rows=original.count())
    facts = lambda df: df.agg(F.struct(F.count(F.lit(1)).alias("n"), *[
        f(F.col(c)).alias(f"{name}_{c}") for c in df.columns for name, f in (("present", F.count), ("low", F.min), ("high", F.max))
    ]).alias("facts"))
    was, rows = facts(original).scalar(), []
    for c in (x.split(":")[0] for x in COLUMNS["orders_dirty"].split()):
        now = lambda name, c=c: F.col(f"facts.{name}_{c}")
        then = lambda name, c=c: F.col(f"was.{name}_{c}")
        missing = lambda of, n: 1 - of("present") / n
        rows.append(F.struct(
            F.lit(c).alias("column_name"), (F.col("facts.n") == F.col("was.n")).alias("same_rows"),
            (F.abs(missing(now, F.col("facts.n")) - missing(then, F.col("was.n"))) < 0.1).alias("null_share_kept"),
            ((now("low") >= then("low")) & (now("high") <= then("high"))).alias("inside_bounds"),
        ))
    return facts(clone).withColumn("was", was).select(F.inline(F.array(*rows)))


def synth_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per screened column of the dirty customers: values of the original that its clone holds."""
    tables = frames(spark, sf_dir)
    original = tables.frame("customer_dirty")
    found = screening.screen_columns(spark, {"customer_dirty": original}, FULL)
    columns = sorted(r["column"] for r in screening.excluded_columns(found).collect())
    specs = [{"check_id": 1, "table": "customer_dirty", "column": "phone"}]
    clones = clone_tables(spark, specs, tables, rows=original.count(), allow_sample_values=True,
                          protected=[("customer_dirty", c) for c in columns])
    clone, out = clones.frame("customer_dirty"), None
    for c in columns:
        kept = clone.select(F.col(c).cast("string").alias("v")).join(original.select(F.col(c).cast("string").alias("v")), "v", "left_semi")
        one = kept.agg(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("original_values"))
        out = one if out is None else out.unionByName(one)
    return out


def synth_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks on clones of the dirty orders and customers, as many rows as in the orders."""
    tables = frames(spark, sf_dir)
    specs = [
        {"check_id": 1, "table": "orders_dirty", "column": "o_custkey"},
        {"check_id": 9, "table": "orders_dirty", "column": "o_orderstatus", "allowed_values": ["O", "F", "P"]},
        {"check_id": 12, "table": "orders_dirty", "column": "o_totalprice"},
        {"check_id": 1, "table": "customer_dirty", "column": "phone"},
    ]
    clones = clone_tables(spark, specs, tables, rows=tables.frame("orders").count())
    return scan(spark, specs, clones, as_of=AS_OF, mode="synthetic").checks


# -- suggestions ----------------------------------------------------------------

SUGGESTED = ("orders_dirty", "customer_dirty", "lineitem", "events", "part")


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = frames(spark, sf_dir)
    return column_roles(profiling.profile_tables({t: tables.frame(t) for t in SUGGESTED}))


def suggest_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = _roles(spark, sf_dir)
    return roles.select(
        F.col("table").alias("table_name"), F.col("column").alias("column_name"),
        F.array_join(F.array_sort("roles"), ",").alias("roles"), "min", "max",
    )


_MONEY, _NUMBER, _TIME = ("|".join(words) for words in (_MONEY_WORDS, _NUMBER_WORDS, _TIME_WORDS))


def _role_rows_sql() -> str:
    """A row per column with a flag per role."""
    rows = []
    for t in SUGGESTED:
        for c, kind in _kinds(t):
            bound = f"min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi" if kind in "if" else \
                "CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi"
            rows.append(
                f"SELECT '{t}' AS t, '{c}' AS c, '{kind}' AS kind, count(*) AS n, count(DISTINCT {c}) AS u, {bound} FROM {t}"
            )
    m = lambda words: f"regexp_matches(c, '{words}')"
    return (
        "SELECT *, k AS pk, NOT k AND isid AND NOT num AS bk, num AND money AS monetary, num AND NOT money AND NOT k AS numeric_,"
        " kind = 't' OR (ist AND NOT k) AS timestamp_, NOT num AND NOT k AND NOT isid AND NOT (kind = 't' OR ist) AND u > 0"
        " AND (u <= 50 OR u::DOUBLE / n <= 0.02) AS categorical FROM (SELECT *, kind IN ('i', 'f') OR (kind = 's' AND"
        f" {m(_NUMBER)}) AS num, {m(_MONEY)} AS money, kind IN ('i', 'f', 's') AND {m('(_sk|_key|_pk)$')} AS k,"
        f" {m('(_id|_code|_num|_no|_nbr)$')} AS isid, {m(_TIME)} AS ist FROM ({' UNION ALL '.join(rows)}) r) f"
    )


def _roles_sql() -> str:
    names = ("bk", "categorical", "monetary", "numeric_", "pk", "timestamp_")
    listed = ", ".join(f"CASE WHEN {n} THEN '{n.strip('_')}' END" for n in names)
    return with_views(
        f"SELECT t AS table_name, c AS column_name, concat_ws(',', {listed}) AS roles, lo AS min, hi AS max"
        f" FROM ({_role_rows_sql()}) r"
    )


def suggest_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each check is suggested for each table."""
    specs = specs_frame(spark, suggest_checks(table_entries(_roles(spark, sf_dir))))
    return specs.groupBy(F.col("table").alias("table_name"), "check_id").agg(F.count(F.lit(1)).alias("n"))


def _specs_sql() -> str:
    rules = {
        1: "sum(monetary::INT + categorical::INT + numeric_::INT + timestamp_::INT + bk::INT)",
        2: "(sum((monetary OR pk OR bk)::INT) >= 2)::INT", 3: "(sum((monetary OR pk OR bk)::INT) >= 1)::INT",
        5: "sum(pk::INT)", 6: "max(bk::INT)", 7: "max(bk::INT)", 8: "sum(monetary::INT)", 12: "sum(monetary::INT)",
        28: "sum(monetary::INT + numeric_::INT)", 29: "sum(numeric_::INT)",
        9: "sum((categorical AND u <= 50)::INT)", 11: "sum((numeric_ AND lo IS NOT NULL)::INT)",
    }
    rows = " UNION ALL ".join(
        f"SELECT t AS table_name, CAST({i} AS INTEGER) AS check_id, CAST({rule} AS BIGINT) AS n FROM roles GROUP BY t"
        for i, rule in rules.items()
    )
    return with_views(f"SELECT * FROM (WITH roles AS ({_role_rows_sql()}) {rows}) s WHERE n > 0")


# -- all ------------------------------------------------------------------------

def queries() -> dict[str, Query]:
    return {f"profile_{t}": _profile(t) for t in COLUMNS} | {
        "profile_top_values": profile_top_values,
        "profile_row_counts": profile_row_counts,
        "profile_lineitem_approx": _profile("lineitem", "approx"),
        "sample_rows": sample_rows,
        "screen_names": screen_names,
        "screen_values": screen_values,
        "screen_findings": screen_findings,
        "screen_manifest": screen_manifest,
        "screen_gate": screen_gate,
        "screen_excluded": screen_excluded,
        "screen_categories": screen_categories,
        "screen_sampled": screen_sampled,
        "screen_sampled_findings": screen_sampled_findings,
        "screen_extra_rules": screen_extra_rules,
        "mask_values": mask_values,
        "mask_documents": mask_documents,
        "synth_lineitem": synth_lineitem,
        "synth_kept": synth_kept,
        "synth_protected": synth_protected,
        "synth_scan": synth_scan,
        "suggest_roles": suggest_roles,
        "suggest_specs": suggest_specs,
    }


def oracle_sql() -> dict[str, str]:
    return {f"profile_{t}": _profile_sql(t) for t in COLUMNS} | {
        "profile_top_values": _top_values_sql(),
        "profile_row_counts": _row_counts_sql(),
        "screen_names": with_views(_names_sql(COLUMNS)),
        "screen_values": _values_sql(),
        "screen_findings": with_views(_findings_sql()),
        "screen_sampled_findings": with_views(_findings_sql(_sample_sql)),
        "screen_manifest": with_views(_manifest_sql()),
        "screen_gate": with_views(_gate_sql()),
        "screen_excluded": with_views(
            f"SELECT table_name, column_name FROM ({_findings_sql()}) f WHERE status IN ('HIGH', 'MEDIUM')"
        ),
        "screen_categories": with_views(
            "SELECT CASE WHEN category IN ('contact', 'financial') THEN status ELSE 'CLEAR' END AS status, count(*) AS n"
            f" FROM ({_findings_sql()}) f GROUP BY ALL"
        ),
        "screen_extra_rules": _extra_rules_sql(),
        "synth_kept": " UNION ALL ".join(
            f"SELECT '{c.split(':')[0]}' AS column_name, true AS same_rows, true AS null_share_kept, true AS inside_bounds"
            for c in COLUMNS["orders_dirty"].split()
        ),
        "synth_protected": with_views(
            f"SELECT column_name, 0::BIGINT AS original_values FROM ({_findings_sql()}) f"
            " WHERE status IN ('HIGH', 'MEDIUM') AND table_name = 'customer_dirty'"
        ),
        "mask_values": _masked_sql(),
        "mask_documents": _mask_documents_sql(),
        "suggest_roles": _roles_sql(),
        "suggest_specs": _specs_sql(),
    }
