"""Registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

from panelloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One query of each family; the driver compares all of them.
CHECKED = ["f1_f10_window_features", "f2_f3_f5_recursive_features", "l4_cross_sectional_label", "q1_q6_audit_findings", "b1_baseline_performance", "n6_company_tags", "n7_aligned_to_sessions", "e9_tercile_buckets", "e19_e22_ensemble", "u1_u5_statement_features", "o6_combined_scores", "k1_k3_o14_sizes_and_actions", "i1_i2_bootstrap_intervals", "s6_s8_corpus_upsert", "p11_classification", "tm_monthly_matrix", "i6_holm", "o7_debate_residuals", "p12_architecture_summary", "s13_statement_basis", "tf_drawdown_in_falls", "to_horizon_cost_grid", "x6_rubric_agreement", "p9_p10_factor_regressions", "s12_section_tables", "k5_k7_sequential_decisions", "m6_s15_two_scorers", "v12_risk_event_log", "v4_v6_account_overview", "x4_deletion_test"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _row(values):
    return tuple("null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.5g}" if isinstance(v, float) else str(v)[:40] for v in values)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(_row(r[c] for c in cols) for r in df.collect())
    found = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    assert got == sorted(_row(r[i] for i in at) for r in found.fetchall())


def test_every_sql_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
