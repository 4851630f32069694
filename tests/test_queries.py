"""Every query with a statement against DuckDB on the smallest tables, and the registry's shape."""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "scripts"))

import __spark_entry__ as entry  # noqa: E402

FOLDER = os.environ.get("TERRASTAT_TEST_DATA", "/root/testdata/sf0.001")
ORACLES = entry.oracle_sql()
#: All points of the smallest tables lie beside their raster.
EMPTY = {"join_02_band_assembly"} if FOLDER.endswith("sf0.001") else set()
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def test_every_statement_has_a_query():
    assert set(ORACLES) <= set(entry.queries()) and len(entry.queries()) >= 168


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_statement(spark, con, name):
    from check_oracles import compare

    why = compare(entry.queries()[name](spark, FOLDER), con, ORACLES[name])
    assert why == ("no rows" if name in EMPTY else ""), why


def test_entry_returns_class_counts(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"class", "n"}
