"""Every registered query against its DuckDB SQL on the smallest tables, and the flagship query."""

import glob
import os

import duckdb
import pytest

from tidegauge.plans import scan_catalogue as catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    ours, theirs = (d[columns].sort_values(columns).reset_index(drop=True) for d in (ours, theirs))
    assert len(ours) == len(theirs)
    for c in columns:
        assert ((ours[c] == theirs[c]) | (ours[c].isna() & theirs[c].isna())).all(), c


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 8
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_top_k_is_not_a_full_sort(spark):
    plan = catalogue.QUERIES["top8"](spark, SF)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_latest_limits_groups_before_the_shuffle(spark):
    plan = catalogue.QUERIES["latest_per_series"](spark, SF)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_a_broken_subpackage_leaves_the_other_queries(tmp_path, monkeypatch):
    """A module that can't be imported is warned of and left out; one that isn't there is left out."""
    import __spark_entry__

    (tmp_path / "broken_operators.py").write_text("import a_library_that_is_not_there\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.warns(UserWarning, match="broken_operators"):
        assert __spark_entry__._if_there("broken_operators") is None
    assert __spark_entry__._if_there("absent_operators") is None
