"""The whole job of queries whose SQL covers a part of the rows only."""

import pytest

import __spark_entry__ as entry

Q = entry.queries()


@pytest.fixture()
def surveys(spark, tmp_path):
    """Three surveys: by x and y, by geometry alone in either axis order; one without a place."""
    rows = [(1, 200000.0, 650000.0, None), (2, None, None, "POINT (200010 650010)"), (3, None, None, "POINT (650500 200500)"), (4, None, None, None)]
    spark.createDataFrame(rows, "row_id long, x double, y double, geometry string").write.parquet(f"{tmp_path}/transit_nodes.parquet")
    zone = [(7, "M", "POLYGON ((199900 649900, 200100 649900, 200100 650100, 199900 650100, 199900 649900))")]
    spark.createDataFrame(zone, "zone_id long, metro_name string, geometry string").write.parquet(f"{tmp_path}/zones.parquet")
    return str(tmp_path)


def test_places_of_geometry_alone(spark, surveys):
    rows = lambda name: Q[name](spark, surveys).collect()
    assert {r.row_id for r in rows("places_in_degrees")} == {1, 2, 3}
    assert {r.id: r.zone_id for r in rows("point_in_zone")} == {1: 7, 2: 7, 3: None}
    assert {r.id: r.area for r in rows("zone_then_district_fallback")} == {1: "M", 2: "M", 3: "North district"}
    cells = {r.row_id: r for r in rows("hex_cells")}
    assert set(cells) == {1, 2, 3} and abs(cells[3].cx - 200500) <= 66 and abs(cells[3].cy - 650500) <= 66
    held = {r.cell for r in cells.values()}
    assert held <= {f"{r.q}:{r.r}" for r in rows("hex_neighbors")}
    near = {f"{r.qa}:{r.ra}" for r in rows("hex_proximity_pairs")}
    assert near <= held and (cells[1].cell == cells[2].cell or {cells[1].cell, cells[2].cell} <= near)
