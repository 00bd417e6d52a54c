import os

import duckdb
import pytest

import __spark_entry__
from fieldspark import queries as engine

SF = "/root/testdata/sf0.01"
#: quick ones of each family; the others run the same way
NAMES = ["run_summary", "simultaneous_intervals", "processing_summary", "nan_to_mean", "clock_zero_clip", "first_difference", "median_filter", "sliding_windows", "detrend_linear", "stft", "cross_power", "tf_ols", "tf_remote", "resistivity_phase", "huber_step", "taper_families", "prewhitened_stft", "feature_weights", "compare_tf", "decimate_iir", "edf_weights", "tf_rme", "process_stored"]


def test_entry_runs(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 8 * 4 and all(r["rho"] is None or r["rho"] >= 0 for r in rows)


def test_every_sql_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(engine.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    got = engine.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    cols = ", ".join(f'"{c}"' for c in got.columns)
    sql = con.execute(f"select {cols} from ({engine.ORACLES[name]})").fetchall()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(sql, key=key)
