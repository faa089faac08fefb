import duckdb
import pytest

import __spark_entry__ as entry
from trackweave.plans import oracle, queries

SF = "/root/testdata/sf0.001"
CHECKED = ("project_points", "segments", "global_cells_k3", "pyramid_cells", "tiles_for_bbox", "admission_prefix", "apply_diff_compat", "copy_tiles")


def test_names():
    assert set(oracle.ORACLE) <= set(queries.QUERIES) and set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 4516


@pytest.mark.parametrize("name", CHECKED)
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(oracle.ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].values.tolist()))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [f"{x}_all" for x in ("pyramid_compat", "diff_pyramid_saturating", "vector_features", "modified_tiles", "tile_values")])
def test_whole_queries_equal_sql(spark, name):
    test_queries_equal_sql(spark, name)
    part, whole = queries.QUERIES[name.removesuffix("_all")](spark, SF), queries.QUERIES[name](spark, SF)
    assert part.select(*part.columns).exceptAll(whole.select(*part.columns)).count() == 0 and whole.count() > part.count()
