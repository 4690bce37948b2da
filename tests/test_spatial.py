import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hubloom.functions import hexgrid as X
from hubloom.functions import projection as J
from hubloom.operators import spatial as P
from hubloom.operators.grouping import connected, merge_groups_by_nodes, numbered_groups
from hubloom.operators.numbering import number_in_order, seeded_sample


def test_disc_area_is_exact():
    ring = np.array([[-5.0, -5], [5, -5], [5, 5], [-5, 5]])
    assert P.disc_area(ring, 0, 0, 3) == pytest.approx(math.pi * 9)
    assert P.disc_area(ring, 0, 0, 100) == pytest.approx(100)
    assert abs(P.disc_area(ring, 5, 0, 2)) == pytest.approx(math.pi * 2)
    assert P.disc_area(ring, 50, 0, 2) == pytest.approx(0, abs=1e-9)
    assert P.overlap_with_disc("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))", 2, 2, 50) == pytest.approx(15)


def test_disc_area_matches_sampling():
    rng = np.random.default_rng(0)
    wkt = "POLYGON ((0 0, 8 1, 3 4, 9 9, 1 8, 0 0))"
    ring = P.polygons(wkt)[0][0]
    xy = rng.uniform(0, 9, (100_000, 2))
    inside = np.zeros(len(xy), bool)
    for a, b in zip(ring, np.roll(ring, -1, axis=0)):
        with np.errstate(all="ignore"):
            inside ^= ((a[1] > xy[:, 1]) != (b[1] > xy[:, 1])) & (xy[:, 0] < (b[0] - a[0]) * (xy[:, 1] - a[1]) / (b[1] - a[1]) + a[0])
    share = (inside & (np.hypot(xy[:, 0] - 4, xy[:, 1] - 4) <= 3)).mean() * 81
    assert P.overlap_with_disc(wkt, 4, 4, 3) == pytest.approx(share, rel=0.03)


def test_disc_rings(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e6, 0.0)], "id long, x double, y double")
    zones = spark.createDataFrame([("POLYGON ((-50 -50, 50 -50, 50 50, -50 50, -50 -50))", 100.0), (None, 5.0), ("POLYGON ((1 1, 1 1, 1 1))", 7.0)], "geometry string, pop double")
    got = {r.id: r for r in P.disc_ring_totals(points, zones, [10.0, 20.0, 100.0], ["pop"]).collect()}
    assert got[1].pop_zone1 == pytest.approx(math.pi) and got[1].pop_zone2 == pytest.approx(3 * math.pi) and got[1].pop_zone1 + got[1].pop_zone2 + got[1].pop_zone3 == pytest.approx(100)
    assert got[1].covered and not got[2].covered and got[2].pop_zone3 == 0


def test_shapes():
    a, b, c = ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((1 1, 2 1, 2 2, 1 2, 1 1))", "POLYGON ((9 9, 10 9, 10 10, 9 9))")
    assert P.shapes_intersect(a, b) and P.shapes_intersect(b, a) and not P.shapes_intersect(a, c) and not P.shapes_intersect(a, None)
    assert P.shape_within(b, a) and not P.shape_within(a, b)


def test_hex_distance_and_offsets():
    assert X.edge_distance(1, 0) == 0 and X.edge_distance(2, 0) == pytest.approx(66 * math.sqrt(3))
    assert X.edge_distance(1, 1) == pytest.approx(66)
    assert (2, 0) in X.offsets_within(120.1) and (3, 0) not in X.offsets_within(120.1)


def test_hex_cell_holds_its_point(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in rng.uniform(-1e5, 1e5, (500, 2))], "x double, y double")
    q, r = X.axial(F.col("x"), F.col("y"))
    cx, cy = X.centre(F.col("q"), F.col("r"))
    far = df.withColumns({"q": q, "r": r}).select(F.max(F.sqrt(F.pow(cx - F.col("x"), 2) + F.pow(cy - F.col("y"), 2)))).first()[0]
    assert far <= 66.0 + 1e-6
    ring = df.withColumns({"q": q, "r": r}).select(X.corners(F.col("q"), F.col("r")).alias("c")).first().c
    assert len(ring) == 6


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(34.8, 32.1), (35.2045169, 31.7343936), (35.9, 33.2), (34.3, 29.6)], "lon double, lat double")
    x, y = J.to_metres(F.col("lon"), F.col("lat"))
    m = df.withColumns({"x": x, "y": y})
    lon, lat = J.to_degrees(F.col("x"), F.col("y"))
    for r in m.select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert r.lon2 == pytest.approx(r.lon, abs=1e-8) and r.lat2 == pytest.approx(r.lat, abs=1e-8)
    at = m.collect()[1]
    assert at.x == pytest.approx(J.EAST0, abs=0.01) and at.y == pytest.approx(J.NORTH0, abs=0.01)


def union_find(pairs):
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {v: find(v) for v in list(parent)}


def test_connected_matches_union_find(spark):
    rng = np.random.default_rng(4)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, i) for i in range(400, 460)]
    got = {r.id: r.root for r in connected(spark.createDataFrame(pairs + pairs[:9], "a long, b long")).collect()}
    assert got == {v: r for v, r in union_find([p for p in pairs if p[0] != p[1]]).items()}
    assert connected(spark.createDataFrame([(None, 1), (2, 2)], "a long, b long")).count() == 0


def test_group_numbers_and_merges(spark):
    ids = spark.createDataFrame([(i,) for i in (5, 1, 9, 3, 7)], "id long")
    links = spark.createDataFrame([(9, 5), (3, 7)], "a long, b long")
    groups = numbered_groups(ids, links)
    assert {r.id: r.group for r in groups.collect()} == {1: 0, 3: 1, 7: 1, 5: 2, 9: 2}
    members = spark.createDataFrame([(1, 10), (7, 70), (9, 90)], "id long, node long")
    notes = spark.createDataFrame([("a", 10), ("a", 90), ("b", 70), ("b", 12345)], "note string, node long")
    assert {r.id: r.group for r in merge_groups_by_nodes(groups, members, notes).collect()} == {1: 0, 5: 0, 9: 0, 3: 1, 7: 1}


def test_numbering_and_sample(spark):
    df = spark.range(1000).withColumn("v", (F.col("id") * 7919) % 10)
    rows = number_in_order(df, F.desc("v"), "id").orderBy("number").collect()
    assert [r.number for r in rows] == list(range(1, 1001)) and [(-r.v, r.id) for r in rows] == sorted((-r.v, r.id) for r in rows)
    assert number_in_order(df.limit(0), "id").count() == 0
    assert seeded_sample(df, "id", 5, 1).collect() == seeded_sample(df.repartition(7), "id", 5, 1).collect()


def test_square_rings_by_corners(spark):
    """The same as with a row for each pair: slivers, nested and touching zones, values that are no numbers, crowded tiles."""
    rng = np.random.default_rng(8)
    zones = [(float(x), float(y), float(x + a), float(y + b), float(v), float(v % 7)) for x, y, a, b, v in zip(*rng.integers(0, 90, (2, 300)), *rng.integers(0, 30, (2, 300)), rng.integers(-5, 99, 300))]
    zones += [(5.0, 5.0, 5.0 + 1e-9, 6.0, 50.0, 1.0), (200.0, 200.0, 201.0, 201.0, float("nan"), 1.0), (300.0, 0.0, 301.0, 1.0, float("inf"), 1.0), (-50.0, -50.0, 150.0, 150.0, None, 3.0), (400.0, 0.0, 410.0, 10.0, 1.0, 1.0)]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-20, 120, (200, 2)))]
    points += [(500, None, 1.0), (501, 200.0, 203.0), (502, 303.0, 0.0), (503, 420.0, 5.0), (504, 419.0, 5.0), (505, 1e6, 1e6), (506, 390.0, -10.0)]
    z = spark.createDataFrame(zones, "x0 double, y0 double, x1 double, y1 double, pop double, emp double")
    p = spark.createDataFrame(points, "id long, x double, y double")
    radii = [2.0, 5.0, 10.0]
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    want = {r.id: tuple(r) for r in P.ring_totals(p, z, [P.square_overlap(F.col("x"), F.col("y"), r) for r in radii], area, 10.0, ["pop", "emp"]).collect()}
    for crowd in ((100_000, 50_000), (40, 30)):
        got = {r.id: tuple(r) for r in P.square_ring_totals(p, z, radii, ["pop", "emp"], crowd).collect()}
        assert set(got) == set(want)
        for i, r in want.items():
            assert got[i][-1] == r[-1], i
            assert got[i][:-1] == pytest.approx(r[:-1], abs=1e-6, nan_ok=True), i


def test_places_amid_very_many_zones():
    """A row for each pair would be 4e9 here."""
    import pandas as pd

    k = np.arange(40_000)
    zones = pd.DataFrame({"x0": k % 200, "y0": k // 200, "x1": k % 200 + 1, "y1": k // 200 + 1, "pop": 2.0})
    points = pd.DataFrame({"x": np.full(100_000, 100.0), "y": np.full(100_000, 100.0)})
    rings, met = P._square_sums(points, zones, [10.0, 20.0, 99.0], ["pop"])
    assert met.all() and [float(r[-1]) for r in rings] == pytest.approx([800, 2400, 2 * (198**2 - 40**2)])
