"""Registered queries against their SQL, over the smallest tables."""

import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_every_query_equals_its_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found)
    for name, text in sql.items():
        rows = found[name](spark, SF)
        got = rows.collect()
        r = db.execute(text)
        columns = [c[0] for c in r.description]
        assert sorted(columns) == sorted(rows.columns), name
        want = sorted(repr(tuple(x[columns.index(c)] for c in sorted(columns))) for x in r.fetchall())
        assert sorted(repr(tuple(x[c] for c in sorted(columns))) for x in got) == want, name


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_ingest_scan_walks_the_whole_folder(spark, tmp_path):
    (tmp_path / "deep/er").mkdir(parents=True)
    for name in ("a.parquet", "deep/b.parquet", "deep/er/c.txt"):
        (tmp_path / name).write_text(name)
    rows = entry.queries()["ingest_scan"](spark, str(tmp_path)).collect()
    assert {(r["path"], r["size"]) for r in rows} == {(f"{tmp_path}/{n}", len(n)) for n in ("a.parquet", "deep/b.parquet", "deep/er/c.txt")}


def test_ingest_scan_hashes_files_that_no_row_can_hold(spark, tmp_path):
    with open(tmp_path / "large.parquet", "wb") as file:
        file.truncate((2 << 30) + 5)  # takes no room
    want = hashlib.sha256()
    for _ in range(2048):
        want.update(bytes(1 << 20))
    want.update(bytes(5))
    assert [tuple(r) for r in entry.queries()["ingest_scan"](spark, str(tmp_path)).collect()] == [(f"{tmp_path}/large.parquet", (2 << 30) + 5, want.hexdigest())]
