import os

import duckdb
import pytest

from catalog.literal_models import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = "events", "lineitem"


def plain(value):
    if isinstance(value, float):
        return repr(value + 0.0)
    return value.isoformat().replace("+00:00", "") if hasattr(value, "isoformat") else str(value)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")
@pytest.mark.parametrize("name", QUERIES)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    found = QUERIES[name](spark, SF_DIR)
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    rows = sorted([plain(v) for v in r] for r in found.select(*names).collect())
    assert sorted(names) == sorted(found.columns)
    assert rows and rows == sorted([plain(v) for v in r] for r in want.fetchall())
