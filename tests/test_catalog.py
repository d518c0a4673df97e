"""A cross-section of the registered queries against DuckDB at the smallest scale, also through the plans for hot keys."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.check_oracle import TABLES, canon
from tests.conftest import DATA

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
SAMPLE = ["flagship", "mselstr_R", "mjoin_nN", "mrjoin_k", "mnrjoin_nN", "mnrcommon", "msummary", "msim_spearman", "mbucket_label", "mcross", "mnumber_skip", "mslide", "mwindow",
          "mmvavg_w", "mmvsim_kendall", "mbest_u", "mvjoin", "msed_g_around", "mdformat_t", "groupby2_keys", "ts_mpid_fix", "ts_polation_linear", "ts_join", "csvtoboxplot", "stream_tumbling"]
HOT = ["mjoin", "mcommon_u", "mshare", "mnumber", "mslide_r", "mmvavg_exp", "mnrcommon_u", "ts_polation_previous", "mstats_qrange"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def _same(spark, duck, name):
    df, want = QUERIES[name](spark, DATA), duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canon(df.columns, df.collect()) == canon(want.columns, want.fetchall())


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, duck, name):
    _same(spark, duck, name)


@pytest.mark.parametrize("name", HOT)
def test_query_with_hot_keys(spark, duck, name):
    spark.conf.set("millrace.blockRows", "50")
    try:
        _same(spark, duck, name)
    finally:
        spark.conf.unset("millrace.blockRows")


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
