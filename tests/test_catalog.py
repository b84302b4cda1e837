"""Every registered query with SQL gives the rows of that SQL."""

import duckdb
import pytest

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df, cols):
    return sorted(map(tuple, df[cols].astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_plans_have_no_python_or_cross_join(spark):
    for name in ("policy_scores", "reconciled_findings", "overlap_candidates", "blast_radius", "selection_decisions", "effort_scores"):
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "Python" not in plan, name


def test_results_do_not_depend_on_partitioning(spark):
    from tidemark.operators import scoring
    from tidemark.sources import fixtures

    f = fixtures.findings(spark, SF)
    one = lambda n: sorted(map(tuple, scoring.first_by_location(f.repartition(n)).select("ord").collect()))
    assert one(1) == one(17)


def executed(df):
    """The plan that ran, with what was reused."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_reconciliation_computes_fingerprints_once(spark):
    plan = executed(catalog.queries()["reconciled_findings"](spark, SF))
    assert plan.count("AS fingerprint") == 1 and plan.count("FileScan parquet") <= 3 and plan.count("SortMergeJoin") <= 2, plan


def test_scoring_needs_no_join(spark):
    plan = executed(catalog.queries()["findings_severity_histogram"](spark, SF))
    assert "Join" not in plan and plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") <= 2, plan
