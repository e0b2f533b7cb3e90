"""Registered queries against their SQL on the smallest tables."""

import ast
import inspect
import math
from pathlib import Path

import pytest

import __spark_entry__ as registry

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["a6_stored_history", "f5_permutation_p", "f12_severity", "a2_job_pages", "a4_batch_jobs", "a4_batch_diagnostics", "k1_ingest", "d2_rate_table", "d5_changing_labels", "e9_without_repeats",
          "f2_cusum_in_pieces", "f6_normal_p", "f8_shift_report_in_pieces", "a7_upsert_runs", "b6_dedup_retries", "c1_sliced_percentiles_events", "c9_job_stats_grouped", "c17_failure_report",
          "d6_workflow_costs", "e8_group_outliers", "f4_exact_p", "f8_change_points", "g5_stage_structure", "i18_priority_findings"]


def rounded(value):
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return None if math.isnan(value) else round(float(value), 4)
    return value


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        con.sql(f"create view {file.stem} as select * from '{file}'")
    check = con.sql(registry.oracle_sql()[name])
    columns = sorted(check.columns)
    df = registry.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == columns
    ours = sorted(([rounded(x) for x in row] for row in df.select(*columns).collect()), key=repr)
    theirs = sorted(([rounded(x) for x in row] for row in check.select(", ".join(columns)).fetchall()), key=repr)
    assert ours == theirs


def test_every_query_has_a_check_or_cannot():
    """Training-data queries are held against brute force in their own tests."""
    own = {name for name in registry.queries() if not (name.startswith("op") or name == "pipeline")}
    assert own - set(registry.oracle_sql()) == {"h1_analyze"}
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_job_positions_match_sql(spark):
    test_query_matches_sql(spark, "f1_job_series")


@pytest.mark.parametrize("module", registry._MODULES, ids=lambda m: m.__name__)
def test_names_taken_from_other_modules_exist(module):
    """Queries look functions up when they are called, so a moved one would fail only there."""
    asked = [n for n in ast.walk(ast.parse(inspect.getsource(module))) if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name)]
    own = [(getattr(module, n.value.id, None), n.attr) for n in asked]
    assert [f"{m.__name__}.{name}" for m, name in own if inspect.ismodule(m) and not hasattr(m, name)] == []
