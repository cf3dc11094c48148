"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from weirflow.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        assert rows(got) == rows(duck.execute(SQL[name]).df())
    else:
        assert len(got)


def test_stats_records_of_many_jobs_and_nulls(spark, duck, tmp_path):
    events = f"{tmp_path}/events.parquet"
    copies = f"SELECT e.* REPLACE (e.event_id + 1000 * r.k AS event_id) FROM '{SF}/events.parquet' e, range(200) r(k)"
    duck.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id <> 7 THEN event_id END AS event_id, CASE WHEN event_id % 10 <> 3 THEN value END AS value) FROM ({copies})) TO '{events}'")
    got = QUERIES["stats_records"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(duck.execute(SQL["stats_records"].replace("FROM events", f"FROM '{events}'")).df())
