"""Every registered query against its SQL check, and the shape of the registry."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from larkspur.plans.registry import ORACLES, QUERIES
from tests.compare import differences, duck

# timers on event time, and registry version grammars: checked in their own tests
NO_SQL = {"scl3_registry_keys", "str10_sla_monitor"}

# no rows in the smallest tables, some in the larger ones
EMPTY_HERE = {"agg29_run_list", "gr3_dev_only", "udf6_detect_secrets"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    assert differences(spark, sf_dir, QUERIES[name], ORACLES[name], con) == ("EMPTY" if name in EMPTY_HERE else None)


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == NO_SQL


def test_entry_has_rows_and_columns(spark):
    out = entry.entry(spark)
    assert out.columns == ["osv_id", "depscore", "severity", "worst_project_id", "affected_project_count"]
    assert out.count() == 5
