"""The registered queries against the same answers in SQL, on the smallest test data."""

import os

import pytest

import __spark_entry__ as entry
from validation.cases import CASES
from validation.compare import difference, duck

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")

# scan_checks holds the metrics of all check queries
COMPARED = [
    "scan_checks", "scan_flat", "scan_first_phase", "report_check_types", "report_priorities", "report_readiness",
    "profile_orders_dirty", "profile_customer_dirty", "profile_documents", "profile_top_values",
    "screen_values", "screen_manifest", "mask_values", "mask_documents", "suggest_roles", "suggest_specs",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", COMPARED)
def test_same_rows(spark, con, name):
    assert difference(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF_DIR) is None


def test_every_check_has_a_case():
    assert {c.check_id for c in CASES} == set(range(1, 34))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == len(CASES) and df.where("metric_value IS NULL").count() == 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
