"""Every query with SQL against DuckDB on the smallest tables; the others must give rows."""

import os
from pathlib import Path

import duckdb
import pytest

from granary.plans.load import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, tmp_path, name):
    QUERIES[name](spark, DATA).write.parquet(str(tmp_path / "out"))
    got = f"'{tmp_path}/out/*.parquet'"
    if name not in ORACLES:
        assert duck.execute(f"SELECT count(*) FROM {got}").fetchall()[0][0] > 0
        return
    duck.execute(f"CREATE OR REPLACE TEMP TABLE want AS {ORACLES[name]}")
    cols = sorted(r[0] for r in duck.execute("DESCRIBE want").fetchall())
    assert cols == sorted(r[0] for r in duck.execute(f"DESCRIBE SELECT * FROM {got}").fetchall())
    names = ", ".join(f'"{c}"' for c in cols)
    for a, b in (("want", got), (got, "want")):
        assert duck.execute(f"SELECT {names} FROM {a} EXCEPT ALL SELECT {names} FROM {b} LIMIT 3").fetchall() == []
