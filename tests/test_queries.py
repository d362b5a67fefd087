import glob
import os

import duckdb
import pytest

from periplus.plans import catalogue


def rows_of(table):
    names = sorted(table.column_names)
    show = lambda v: f"{v:.10g}" if isinstance(v, float) else str(v)
    return names, sorted(tuple(show(v) for v in r) for r in zip(*(table.column(c).to_pylist() for c in names)))


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


#: Iterative or streaming ones take several jobs each; two of them stand for all here.
FEW = [n for n in catalogue.queries() if n in catalogue.oracle_sql() and n not in ("hull_features", "route_clusters", "waypoints", "to_geodetic", "pip_semi", "voyage_positions")]


@pytest.mark.parametrize("name", FEW)
def test_oracle(spark, small, duck, name):
    assert rows_of(catalogue.queries()[name](spark, small).toArrow()) == rows_of(duck.sql(catalogue.oracle_sql()[name]).to_arrow_table())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["row_id", "mmsi", "voyage_id", "itinerary", "seconds", "lon", "lat"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
