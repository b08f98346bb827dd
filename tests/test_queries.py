"""Every registered query against its SQL, on the small tables."""

import math
from pathlib import Path

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def entries():
    import sys

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as e

    return e


def rows(records, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    norm = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(norm(r[k]) for k in order) for r in records), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


E = entries()


@pytest.mark.parametrize("name", [n for n in E.queries() if not n.startswith(("op", "pipeline"))])
def test_query(spark, duck, name):
    got = E.queries()[name](spark, SF)
    mine = rows(got.collect(), got.columns)
    assert mine
    if name in E.oracle_sql():
        want = duck.execute(E.oracle_sql()[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        assert mine == rows(want.fetchall(), names)


def test_entry(spark):
    assert E.entry(spark).count() > 0
