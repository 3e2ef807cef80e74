"""Every registered query against its DuckDB oracle (sf0.001), plus the
driver entry point and a streaming run."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from triage.plans import registry
from triage.plans.check import TABLES, digest

from conftest import SF001
from helpers import tmpdir, write

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(SQL[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert digest(rows, df.columns)[0] == digest(orows, ocols)[0]


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "alert_type" in df.columns


def test_stream_detectors(spark):
    from triage.streaming.live import start_alert_stream
    src = tmpdir()
    write(src, "s1.csv", "service_name,binary_path\nevil,cmd.exe /c x\nok,C:\\a.exe\n")
    out = os.path.join(tmpdir(), "alerts")
    q = start_alert_stream(spark, "services", src, ["service_name", "binary_path"], out)
    q.awaitTermination(120)
    got = [(r.alert_type, r.key_or_name) for r in spark.read.parquet(out).collect()]
    assert got == [("SERVICE_MASQUERADE", "evil")]
