"""Grids that end early, and orders that are not those of ids."""

import pytest

from cartoloom.operators import mesh, overlay, raster, water
from cartoloom.sources import readers
from pyspark.sql import functions as F


def grids(spark, shapes=((4, 5), (2, 5))):
    rows = [(g, r, c, float(c), float(n - 1 - r), 3.0 + r + c / 8) for g, (n, m) in enumerate(shapes) for r in range(n) for c in range(m)]
    return spark.createDataFrame(rows, "grid_id int, row int, col int, x double, y double, h_mm double")


def test_exact_grids_follow_their_requests(spark):
    cells = grids(spark)
    asked = lambda *rows: spark.createDataFrame(rows, "grid_id int, rows int, columns int")
    assert readers.exact_grid(cells, requests=asked((0, 4, 5), (1, 2, 5))).count() == 30
    for wrong in (((0, 4, 5), (1, 4, 5)), ((0, 4, 5),), ((0, 4, 5), (1, 2, 5), (2, 1, 1))):
        with pytest.raises(ValueError):
            readers.exact_grid(cells, requests=asked(*wrong))
    with pytest.raises(ValueError):
        readers.exact_grid(cells, 4, 5)


def test_edition_keeps_a_given_order(spark):
    items = spark.createDataFrame([("io-2023-1", 0, 1), ("io-2020-2023", 0, 2)], "id string, grid_id int, n int")
    assert [r.id for r in readers.edition(items, order="n").orderBy("item_order").collect()] == ["io-2023-1", "io-2020-2023"]
    assert [r.id for r in readers.edition(items).orderBy("item_order").collect()] == ["io-2020-2023", "io-2023-1"]


@pytest.mark.parametrize("with_water", [False, True])
def test_solids_of_grids_that_end_early_are_closed(spark, with_water):
    name = F.concat(F.lit("terrain/"), F.col("grid_id"))
    if with_water:
        bodies = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, 4.0)], "body_order int, min_x double, min_y double, max_x double, max_y double, level_mm double")
        v, f = water.terrain_with_water(grids(spark), bodies, 4, 5, 1.0, layer=name)
    else:
        v, f = mesh.terrain_solid(grids(spark), 4, 5, 1.0, name)
    assert {r.layer: (r.open_edges, r.overused_edges, r.winding_defects) for r in mesh.edge_defects(f).collect()} == {"terrain/0": (0, 0, 0), "terrain/1": (0, 0, 0)}
    assert {r.layer: r.n for r in f.groupBy("layer").agg(F.count("*").alias("n")).collect()} == {"terrain/0": 4 * 12 + 4 * 7, "terrain/1": 4 * 4 + 4 * 5}
    assert mesh.audit(v, f).count() == 0


def test_holes_at_the_end_of_a_grid_that_ends_early(spark):
    """A gap in the last row there is: a hole by the full shape, open by the grid's own."""
    rows = [(0, r, c, 0 if (r, c) == (4, 3) else 3, False) for r in range(5) for c in range(7)]
    cells = spark.createDataFrame(rows, "grid_id int, row int, col int, class int, water boolean")
    at = lambda **how: raster.clean_exposed(cells, cell_w=0.4, cell_h=0.4, **how).where("row = 4 AND col = 3").first().cleaned
    assert at(shape=(9, 7)) and not at(shape=(5, 7)) and not at()


def test_skins_do_not_reach_out_of_their_grid(spark):
    cells = grids(spark, ((3, 3),))
    chosen = lambda row, col: spark.createDataFrame([(0, row, col, 0)], "grid_id int, row int, col int, half int")
    assert overlay.surface_skin(cells, chosen(1, 1)).count() == 8
    for row, col in ((2, 0), (0, 2)):
        with pytest.raises(Exception, match="outside of the grid"):
            overlay.surface_skin(cells, chosen(row, col)).count()


def test_queries_on_a_table_whose_last_grid_ends_early(spark, tmp_path):
    import duckdb
    from cartoloom.plans import catalog

    duckdb.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet' WHERE vec_id < 137) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    for name in ("centred_mesh", "cleaned_mask", "terrain_solid", "printability_audit", "exact_grids", "surface_skins"):
        ours = catalog.QUERIES[name](spark, str(tmp_path)).toPandas()
        theirs = duck.execute(catalog.ORACLES[name]).fetchdf()[list(ours.columns)]
        assert sorted(map(repr, ours.astype(object).values.tolist())) == sorted(map(repr, theirs.astype(object).values.tolist())), name
