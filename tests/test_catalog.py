"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from cartoloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr(r).replace("-0.0,", "0.0,") for r in frame.where(frame.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    ours = catalog.QUERIES[name](spark, SF).toPandas()
    theirs = duck.execute(catalog.ORACLES[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_spatial_joins_do_not_compare_all_pairs(spark):
    for name in ("points_in_boxes", "points_in_polygons", "box_overlaps", "last_body_wins"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
