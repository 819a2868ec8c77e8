import os

import duckdb
import pytest

import __spark_entry__ as entry
from barloom.functions.registry import Registry

DATA = "/root/testdata/sf0.001"
TABLES = ("lineitem", "orders", "events")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def other_engine():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def test_every_feature_has_a_query_and_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in Registry.default().names():
        assert f"feature_{name}" in queries and f"feature_{name}" in sql
    assert set(sql) <= set(queries)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["feature_rsi_14", "feature_vol_yz_21", "feature_season_tom_3", "feature_rskew_78", "transform_xs_rank", "bars_volume_lee_ready", "bars_time_tick_rule", "panel_gaps", "membership_gaps", "quotes_asof", "signed_ticks", "audit"])
def test_query_equals_sql(spark, other_engine, name):
    made = [r.asDict() for r in entry.queries()[name](spark, DATA).collect()]
    cursor = other_engine.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    order = lambda row: [(v is None, str(v)) for v in row]
    want = sorted(cursor.fetchall(), key=order)
    assert sorted((tuple(r[c] for c in columns) for r in made), key=order) == want and want
