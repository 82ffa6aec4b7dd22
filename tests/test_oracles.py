"""Every registered query against its SQL, and the contract of the entry module."""

import pytest

import __spark_entry__ as E
from quire.plans.oracles import oracle_sql
from quire.plans.queries import QUERIES
from tests.conftest import SF, same_as_duck


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    same_as_duck(QUERIES[name](spark, SF), oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(oracle_sql())))
def test_other_queries_run(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0


def test_entry(spark):
    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_every_branch_is_exercised(spark):
    """The synthetic pages reach the cases that the queries are about."""
    kinds = {r.region_type for r in QUERIES["classify_blocks"](spark, SF).collect()}
    assert kinds >= {"heading", "body", "caption", "figure", "table"}
    c = QUERIES["chunks"](spark, SF).collect()
    assert any(r.x0 is None for r in c) and any(r.page_start != r.page_end for r in c)
    assert QUERIES["links"](spark, SF).count() > 0
    assert {r.column_index for r in QUERIES["reading_order"](spark, SF).collect()} == {0, 1}


def test_core_queries_without_a_dependency_of_the_others():
    import subprocess
    import sys

    from tests.conftest import ROOT

    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; from quire.plans.queries import QUERIES; print(set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) <= set(QUERIES))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip().endswith("True"), out.stderr
