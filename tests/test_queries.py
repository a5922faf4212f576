import functools
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import oracle, queries, store_oracle, store_queries
from tidemark.sources import artefacts

SF = "/root/testdata/sf0.001"
SQL = oracle.oracle_sql() | store_oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def canonical(x):
    return f"{float(x):.9g}" if isinstance(x, float) else str(x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", queries.queries())
def test_query_equals_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, SF), duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(tuple(canonical(r[c]) for c in sorted(got.columns)) for r in got.collect())
    order = [want.columns.index(c) for c in sorted(want.columns)]
    assert rows == sorted(tuple(canonical(r[i]) for i in order) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_consumer_walk_empties_a_log_of_more_than_one_sweep(spark, duck, monkeypatch):
    """A sweep of a log that is larger than its batch stops early; the query must go on."""
    monkeypatch.setattr(store_queries, "Retention", functools.partial(store_queries.Retention, delete_batch=10))
    got = {r["name"]: r["offset"] for r in store_queries.consumer_offsets_walk(spark, SF).collect()}
    assert got == {name: offset for _, name, offset in duck.sql(SQL["consumer_offsets_walk"]).fetchall()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_retention_of_a_log_of_more_than_one_sweep(spark, duck, monkeypatch):
    kept = store_queries.Retention
    monkeypatch.setattr(store_queries, "Retention", lambda max_events: kept(max_events=25, delete_batch=10))
    want = duck.sql(SQL["log_retention"].replace("> 2500", "> 25"))
    got = store_queries.log_retention(spark, SF).first().asDict()
    assert got == dict(zip(want.columns, want.fetchall()[0])) and got["deleted_segments"] == 3


def test_display_of_large_sizes(spark, tmp_path):
    """Keys of a larger table, whose sizes pass 1024 GiB."""
    (tmp_path / "part.parquet").mkdir()
    duckdb.sql(f"copy (select k as p_partkey, 'x' as p_name from (values (1::bigint), (12_240), (396_000), (396_336), (1_199_999)) v(k)) to '{tmp_path}/part.parquet/0.parquet' (format parquet)")
    con = duckdb.connect()
    con.sql(f"create view part as select * from read_parquet('{tmp_path}/part.parquet/*')")
    want = con.sql(f"select p_partkey, size from ({SQL['display_columns']})").fetchall()
    assert sorted((r["p_partkey"], r["size"]) for r in queries.display_columns(spark, str(tmp_path)).collect()) == sorted(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and [r["sequence"] for r in rows] == sorted(r["sequence"] for r in rows) and {r["table_name"] for r in rows} == {"users"}


def test_every_query_has_sql():
    assert set(queries.queries()) == set(SQL)


def test_artefacts(spark, tmp_path):
    (tmp_path / "environment.txt").write_text("name=run\nrate=a=b\nnothing\n")
    (tmp_path / "log").write_text("x\nnumber of transactions actually processed: 1,234/5000\ntps = 41.5 (without initial connection time)\n")
    (tmp_path / "m.jsonl").write_text('{"a":{"b":3}}\n{"a":{"b":7}}\n{}\n')
    (tmp_path / "pg.csv").write_text("t,c,d,retained,x\n1,a,b,5,1\n2,a,b,,1\n3,a,b,9,1\n")
    assert {tuple(r) for r in artefacts.read_environment(spark, str(tmp_path / "environment.txt")).collect()} == {("name", "run"), ("rate", "a=b")}
    assert tuple(artefacts.read_log(spark, str(tmp_path / "log")).first()) == (1234, 41.5)
    assert artefacts.read_json_lines(spark, str(tmp_path / "m.jsonl"), {"b": "$.a.b"}).first()["b"] == 7.0
    assert artefacts.max_retained_wal(spark, str(tmp_path / "pg.csv")).first()[0] == 9
    parts = spark.createDataFrame([("run", 10, 8, 10, 0)], "name string, generated long, captured long, consumed long, seconds long")
    row = artefacts.summary(parts).first()
    assert row["captured"] == 10 and row["converged"] and row["events_per_second"] == 0.0 and len(row) == 22
    artefacts.write_summary(parts, str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).count() == 1
