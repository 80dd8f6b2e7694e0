import pytest
from compare import assert_same, connect

from callweave.queries import ORACLES, QUERIES

FITS = {"a1_train_meta", "a5_ablation", "a7_train_balanced"}  # fits: values are tested in test_learning.py


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - FITS))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[0] == "dialogue_id"
