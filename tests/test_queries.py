"""Every registered query against its SQL on the smallest tables."""

import importlib.util
from collections import Counter
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")

from cantera.plans.oracle import ORACLE  # noqa: E402
from cantera.plans.queries import QUERIES  # noqa: E402


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(str(r[i]) for i in order) for r in data)


def compare(spark, run, sql):
    with duckdb.connect() as con:
        for file in DATA.glob("*.parquet"):
            con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
        expected = con.execute(sql).fetchall()
        names = [x[0] for x in con.description]
    got = run(spark, str(DATA))
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, expected)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    compare(spark, QUERIES[name], ORACLE[name])


def test_sampling_is_fixed_by_its_seed(spark):
    a, b = (QUERIES["random_sample_limit"](spark, str(DATA)).collect() for _ in range(2))
    assert a == b and len(a) == 100


def test_entry():
    spec = importlib.util.spec_from_file_location("entry", Path(__file__).parent.parent / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert set(module.oracle_sql()) <= set(module.queries()) and set(QUERIES) <= set(module.queries())
