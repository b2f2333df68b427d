import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL

SAMPLE = ["engineer_features", "clean_rows", "encoded_matrix", "stratified_split", "kfold_assign", "mutual_info_binned", "headline_metrics",
          "auc_ovr", "throttle_decisions", "rolling_per_row"]


def _plain(v):
    return v if v is None or isinstance(v, (bool, int, str)) else float(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    df = entry.queries()[name](spark, SMALL)
    relation = con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=str)
    where = [relation.columns.index(c) for c in columns]
    want = sorted((tuple(_plain(r[i]) for i in where) for r in relation.fetchall()), key=str)
    assert got == want


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_counts_all_levels(spark):
    rows = entry.entry(spark).collect()
    assert [r["severity"] for r in rows] == ["LOW", "MEDIUM", "HIGH", "CRITICAL"] and sum(r["n"] for r in rows) > 0
