"""Every core query against its SQL on the smallest tables, where those are there."""

import math
import os
from decimal import Decimal

import duckdb
import pytest
from karstline.queries import ORACLES, QUERIES, flagship

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return connection


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return str(v) if isinstance(v, Decimal) else v


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"conformance_cases"}))
def test_query_equals_its_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    want = sorted(([plain(v) for v in r] for r in found.fetchall()), key=repr)
    assert sorted(([plain(v) for v in r] for r in frame.select(*names).collect()), key=repr) == want


def test_flagship_has_no_shuffle(spark, capsys):
    flagship(spark, SF).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "IsNotNull(l_linenumber)" in plan
