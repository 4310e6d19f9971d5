"""Every registered query of the engine against its SQL in DuckDB, and rows of those without."""

from pathlib import Path

import duckdb
import pytest

from waymark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(rows):
    return sorted(tuple(repr(float(x)) if isinstance(x, float) else repr(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert canonical(rows) == canonical(expected)


def test_map_match_takes_all_records(spark, duck):
    """Every record is in its vehicle's trace, and each trace is matched as by a plain search."""
    from waymark.operators import mapmatching

    got = {r.vehicle_id: r for r in catalogue.map_match(spark, SF).collect()}
    n = dict(duck.execute("SELECT user_id, count(*) FROM events GROUP BY 1").fetchall())
    assert {k: len(r.path) for k, r in got.items()} == n
    assert max(n.values()) > 10
    ways = {}
    for u, v, length in sorted((e.u, e.v, float(e.n)) for e in catalogue.trade(spark, SF).collect()):
        ways.setdefault(u, []).append((v, length))
    for r in got.values():
        assert r.node_path == mapmatching.match(ways, r.path, {})


def test_entry_points(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
