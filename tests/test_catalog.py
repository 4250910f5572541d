"""Every registered query of the triage engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from quarrylens import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f[:-8]} as select * from '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, con, tmp_path, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    df.write.parquet(str(tmp_path / "out"))
    if name not in catalog.SQL:
        return
    con.execute(f"create or replace table want as {catalog.SQL[name]}")
    con.execute(f"create or replace table got as select * from '{tmp_path}/out/*.parquet'")
    c = ", ".join(f'"{x}"' for x in df.columns)
    for a, b in (("want", "got"), ("got", "want")):
        assert con.execute(f"select {c} from {a} except all select {c} from {b} limit 3").fetchall() == []


def test_flagship(spark, sf_dir):
    assert catalog.flagship(spark, sf_dir).count() > 0
