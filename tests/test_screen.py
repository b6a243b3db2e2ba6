"""Screening for personal data."""

import re

import pytest
from pyspark.sql import functions as F

from plumbline import CheckSpec, PIIBlocked, ScreenConfig, run_scan, screen
from plumbline.functions.masking import mask_value
from plumbline.functions.pii_values import VALUE_PATTERNS
from plumbline.operators import screen as s

VALUES = [
    "jo@x.com", "jo@x", "+4917612345678", "12345678", "0123", "(212) 555-1234", "212-555-1234", "+1 212 555 1234",
    "07123456789", "+447123456789", "123-45-6789", "ab123456c", "SW1A 1AA", "sw1a1aa", "12345", "12345-6789",
    "10.0.0.1", "1.2.3", "fe80::1", "4111111111111111", "GB82WEST12345698765432", "jo@x.com\n", "12345\r", "١٢٣٤٥",
    " jo@x.com", "", "99999999999999999999",
]


def test_patterns_match_whole_values_as_python_does(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "v string")
    got = df.select("v", *[s.matches(F.col("v"), p).alias(p) for p in VALUE_PATTERNS]).collect()
    for row in got:
        for name, (pattern, ignore_case, _, _) in VALUE_PATTERNS.items():
            want = bool(re.match(pattern, row["v"], re.IGNORECASE if ignore_case else 0))
            assert row[name] == want, (row["v"], name)


MASKS = [
    ("jo@x.com", "contact", "j***@x.com"), ("@x.com", "contact", "***@x.com"), ("a@b@c", "contact", "a***@b@c"),
    ("+4917", "contact", "+49**"), ("12", "contact", "12"), ("high street", "contact", "hi*********"),
    (" John  Smith\t", "identity", "J*** S***"), ("4111-1111 1111 1234", "financial", "**** **** **** 1234"),
    ("12a", "financial", "***"), ("abcdef", "health", "ab****"), ("a", "other", "a"), ("  ", "other", "***"),
    ("", "identity", "***"), (None, "contact", None),
]


def test_masks(spark):
    df = spark.createDataFrame(MASKS, "v string, c string, want string")
    rows = df.select("want", mask_value(F.col("v"), F.col("c")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


def test_names(spark):
    listed = spark.createDataFrame(
        [("t", i, c) for i, c in enumerate(["Email", "user_email", "c_name", "card_account", "geo", "IBAN", "id", "username"])],
        "table string, ordinal int, column string",
    )
    rows = {r["column"]: r for r in s.name_scan(listed).collect()}
    assert (rows["Email"]["status"], rows["Email"]["confidence"], rows["Email"]["category"]) == ("HIGH", 0.95, "contact")
    assert rows["user_email"]["status"] == "CLEAR"
    assert (rows["c_name"]["status"], rows["c_name"]["pii_type"]) == ("MEDIUM", "Identity — name (partial)")
    assert rows["card_account"]["category"] == "financial" and rows["card_account"]["pii_type"] == "Financial — card"
    assert (rows["IBAN"]["status"], rows["id"]["detected_via"]) == ("HIGH", "none")


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(0, 400, 1, 5).selectExpr(
        "id", "'user' || id || '@x.com' AS email",
        "CASE WHEN id % 2 = 0 THEN '10.0.0.' || id % 200 ELSE 'n/a' END AS location",
        "'Ann Lee' AS surname", "CAST(NULL AS STRING) AS phone", "'p' || id AS note",
        "CASE WHEN id % 10 = 0 THEN '555-12-' || (1000 + id) ELSE 'x' END AS ssn", "CAST(4111111111111111 AS BIGINT) AS account",
    )


@pytest.mark.parametrize("size", [None, 100, 400])
def test_values_revise_the_names(spark, people, size):
    rows = {r["column"]: r for r in s.screen_columns(spark, {"t": people}, ScreenConfig(sample_size=size)).collect()}
    e = rows["email"]
    assert (e["status"], e["category"], e["confidence"], e["detected_via"]) == ("HIGH", "contact", 0.99, "name_match+regex")
    assert e["sample_count"] == e["match_count"] == (size or 400)
    assert len(e["masked_samples"]) == 3 and set(e["masked_samples"]) == {"u***@x.com"}
    assert (rows["surname"]["status"], rows["surname"]["detected_via"]) == ("REVIEW", "name_match+no_regex")
    assert set(rows["surname"]["masked_samples"]) == {"A*** L***"}
    assert rows["phone"]["status"] == "HIGH" and rows["phone"]["sample_count"] == 0 and rows["phone"]["masked_samples"] == []
    # few hits leave a name that is sure as it is
    assert (rows["ssn"]["status"], rows["ssn"]["confidence"], rows["ssn"]["detected_via"]) == ("HIGH", 0.95, "name_match")
    # sixteen digits are no phone number of up to fifteen, so they are a card
    assert (rows["account"]["status"], rows["account"]["pii_type"]) == ("HIGH", "Financial — credit card")
    assert set(rows["account"]["masked_samples"]) == {"**** **** **** 1111"}
    assert rows["note"]["status"] == "CLEAR" and rows["note"]["sample_count"] == 0
    if size != 100:
        assert (rows["location"]["status"], rows["location"]["match_count"]) == ("MEDIUM", 200)
        assert rows["location"]["detected_via"] == "name_match+regex"


def test_samples_do_not_depend_on_layout_or_size(spark, people):
    shuffled = people.repartition(7).orderBy(F.desc("email")).repartition(3)
    cut = lambda df: df.select("id", "email", "note")
    for key, cases in (({}, ((people, 100), (shuffled, 1500))), ({"t": ("id",)}, ((shuffled, 3), (people, None)))):
        seen = []
        for df, size in cases:
            found = s.screen_columns(spark, {"t": cut(df)}, ScreenConfig(sample_size=size, sample_key=key)).where("column = 'email'").first()
            assert found["sample_count"] == min(400, size or 400) and len(found["masked_samples"]) == 3
            seen.append(found["masked_samples"])
        assert seen[0] == seen[1]


def test_samples_of_hostile_tables(spark):
    rows = [(None, "a@x.com", [1])] * 5 + [(None, None, None)] * 3 + [("", "", [])]
    t = spark.createDataFrame(rows, "`order` string, email string, rank array<int>")
    (row,) = s.screen_columns(spark, {"t": t}).where("column = 'email'").collect()
    assert (row["sample_count"], row["match_count"]) == (6, 5)
    assert s.screen_columns(spark, {"t": t.limit(0)}).where("sample_count > 0").count() == 0


def test_equal_hits_keep_the_earlier_pattern(spark):
    t = spark.createDataFrame([("4111111111111",)], "card string")       # phone_e164 and credit_card
    row = s.screen_columns(spark, {"t": t}).first()
    assert (row["pii_type"], row["match_count"]) == ("Contact — phone", 1)


def test_all_text_and_categories(spark, people):
    wide = s.screen_columns(spark, {"t": people.withColumn("memo", F.col("email"))}, ScreenConfig(scan_all_text=True))
    memo = wide.where("column = 'memo'").first()
    assert (memo["status"], memo["category"], memo["detected_via"]) == ("HIGH", "contact", "regex")
    some = s.screen_columns(spark, {"t": people}, ScreenConfig(categories=("financial",))).collect()
    assert {r["column"] for r in some if r["status"] != "CLEAR"} == {"account"}


def test_gate_and_manifest(spark, people):
    found = screen(spark, {"people": people, "plain": people.select("id")})
    rows = {r["table"]: r for r in found.manifests.collect()}
    m = rows["people"]
    assert (m["row_count"], m["high_count"], m["review_count"], m["gate_decision"]) == (400, 4, 1, "PROCEED_EXCLUDE")
    assert "4 columns with certain and 1 with likely" in m["gate_reason"] and m["passes_run"] == [1, 2]
    assert [c["column"] for c in m["columns"]] == people.columns
    assert (rows["plain"]["gate_decision"], rows["plain"]["passes_run"]) == ("CLEAR", [1])
    assert found.gate == "PROCEED_EXCLUDE" and ("people", "email") in found.excluded
    assert ("people", "surname") not in found.excluded
    with pytest.raises(PIIBlocked, match="people.email"):
        screen(spark, {"people": people}, ScreenConfig(on_pii_detected="block"))
    assert screen(spark, {"people": people}, ScreenConfig(on_pii_detected="synthetic")).gate == "SYNTHETIC_MODE"
    assert screen(spark, {"plain": people.select("id")}, ScreenConfig(on_pii_detected="block")).gate == "CLEAR"


def test_run_with_a_screen(spark, people):
    config = {
        "checks": [{"check_id": 1, "table": "people", "column": "email"}, {"check_id": 1, "table": "people", "column": "note"}],
        "screener": {"on_pii_detected": "exclude"},
    }
    rows = {r["column"]: r for r in run_scan(spark, config, {"people": people}).result.checks.collect()}
    assert rows["email"]["error"] == "pii_excluded" and rows["email"]["skipped"] and not rows["note"]["skipped"]
    assert not run_scan(spark, config, {"people": people}, skip_screener=True).result.checks.where("skipped").count()
    del config["screener"]
    assert run_scan(spark, config, {"people": people}).screening is None
    config |= {"screener": {"on_pii_detected": "synthetic"}, "synthetic_row_count": 50}
    run = run_scan(spark, config, {"people": people})
    assert run.result.mode == "synthetic" and run.result.plan.ctx.frame("people").count() == 50


def test_tables_of_specs(spark, people):
    specs = [CheckSpec(17, child_table="a", parent_table="b"), CheckSpec(1, table="gone")]
    assert set(s.tables_of_specs(spark, specs, {"a": people, "b": people})) == {"a", "b"}


def test_extra_rules(spark):
    t = spark.sql("SELECT '4111 1111 1111 1111' AS card, DATE'1999-01-01' AS born UNION ALL SELECT '4111 1111 1111 1112', DATE'2010-01-01'")
    rows = {r["column"]: r for r in s.extra_rule_scan(t, "t").collect()}
    assert (rows["card"]["rule"], rows["card"]["hit_ratio"]) == ("luhn_card", 0.5)
    assert (rows["born"]["rule"], rows["born"]["hit_ratio"]) == ("date_before_2006", 0.5)
