import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canonical

from samples import SF

NAMES = sorted(entry.oracle_sql())
CHECKED = [n for n in NAMES if n in (
    "parse_nginx_combined", "window_features", "alerts_every_window", "failure_similarity",
    "write_alerts", "report", "stream_change_rates")]


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    mine = entry.queries()[name](spark, SF).toPandas()
    theirs = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert canonical(mine) == canonical(theirs)
