import numpy as np
import pytest
from pyspark.sql import functions as F

from hubloom.functions.geometry import cell_place, place, polygons, wkt_centroid
from hubloom.operators import near
from hubloom.operators.near import pairs_within, regions_around, slabs


def points(spark, xy):
    return spark.createDataFrame([(i, float(x), float(y), "clash") for i, (x, y) in enumerate(xy)], "id long, x double, y double, salt string")


@pytest.mark.parametrize("hot", [10_000, 3])
def test_pairs_match_brute_force(spark, hot):
    rng = np.random.default_rng(1)
    xy = np.vstack([rng.uniform(-500, 500, (150, 2)), np.full((30, 2), 7.0) + rng.uniform(0, 5, (30, 2))])
    got = {(r.id_a, r.id_b) for r in pairs_within(points(spark, xy), 60.0, hot=hot).collect()}
    want = {(i, j) for i in range(len(xy)) for j in range(i + 1, len(xy)) if np.hypot(*(xy[i] - xy[j])) <= 60}
    assert got == want


def test_pairs_bad_rows(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, None, 0.0), (None, 0.0, 0.0), (4, float("nan"), 0.0)], "id long, x double, y double")
    assert [tuple(r)[:2] for r in pairs_within(df, 5.0).collect()] == [(1, 2)]
    assert pairs_within(df.limit(0), 5.0).count() == 0


def even_odd(wkt, x, y):
    odd = False
    for ring in (r for p in polygons(wkt) for r in p):
        a, b = ring, np.roll(ring, -1, axis=0)
        for (x1, y1), (x2, y2) in zip(a, b):
            if (x1 <= x < x2 or x2 <= x < x1) and y1 + (y2 - y1) * (x - x1) / (x2 - x1) <= y:
                odd = not odd
    return odd


SHAPES = [
    (1, "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (3 3, 3 7, 7 7, 7 3, 3 3))"),
    (2, "MULTIPOLYGON (((20 0, 30 0, 25 10, 20 0)), ((5 5, 15 6, 12 20, 5 5)))"),
    (3, "POLYGON ((0 0, 8 1, 3 4, 9 9, 1 8, 4 4, 0 0))"),
    (4, None), (5, "POINT (1 1)"), (6, ""), (None, "POLYGON ((0 0, 9 0, 9 9, 0 0))"),
]


@pytest.mark.parametrize("tile", [2_000.0, 3.0])
def test_regions_match_even_odd(spark, tile):
    rng = np.random.default_rng(2)
    xy = rng.uniform(-2, 32, (400, 2))
    cut = slabs(spark.createDataFrame(SHAPES, "id long, wkt string"), tile=tile)
    got = {(r.id, r.region) for r in regions_around(points(spark, xy), cut, hot=20).collect()}
    want = {(i, k) for i, (x, y) in enumerate(xy) for k, w in SHAPES if k and even_odd(w, x, y)}
    assert got == want


def inside(rows, x, y):
    """The search of `regions_around`, in Python."""
    hits = 0
    for size, tx, ty, xs, odd, starts, y0, y1 in rows:
        if (np.floor(x / size), np.floor(y / size)) == (tx, ty):
            hits += 1
            k = min(max(np.searchsorted(xs, x, "right") - 1, 0), len(odd) - 1)
            t = (x - xs[k]) / (xs[k + 1] - xs[k])
            yield (sum(a + (b - a) * t <= y for a, b in zip(y0[starts[k] : starts[k + 1]], y1[starts[k] : starts[k + 1]])) % 2 == 1) != odd[k]
    assert hits <= 1


@pytest.mark.parametrize("crowded", [48, 3])
@pytest.mark.parametrize("tile", [1.0, 2.5, 7.0, 100.0])
@pytest.mark.parametrize("seed", range(4))
def test_tiles_of_any_shape(monkeypatch, seed, tile, crowded):
    """Also with ends on the tiles' lines, upright and level edges, and edges that cross."""
    monkeypatch.setattr(near, "CROWDED", crowded)
    rng = np.random.default_rng(seed)
    ring = rng.uniform(-12, 12, (30, 2)) if seed % 2 else rng.integers(-6, 7, (30, 2)).astype(float) * 2
    wkt = f"POLYGON (({', '.join(f'{a} {b}' for a, b in ring)}))"
    rows = list(near._tiles(wkt, tile))
    for x, y in rng.uniform(-14, 14, (300, 2)):
        assert any(inside(rows, x, y)) == even_odd(wkt, x, y)


def test_many_vertices_take_memory_in_proportion(spark):
    turn = np.linspace(0, 2 * np.pi, 100_000, endpoint=False)
    radius = 900 + 60 * np.sin(5_000 * turn)
    teeth = np.stack([radius * np.cos(turn), radius * np.sin(turn)], axis=1)
    comb = np.array([(x, y) for k in range(1_000) for x, y in ((0.0, k), (900.0 + k % 7, k), (900.0 + k % 7, k + 0.5), (1.0, k + 0.5))])
    for ring in (teeth, comb):
        rows = list(near._tiles(f"POLYGON (({', '.join(f'{a:.6f} {b:.6f}' for a, b in ring)}))", 2_000.0))
        assert sum(len(r[6]) for r in rows) < 40 * len(ring)
        size = [r[0] for r in rows]
        assert min(size) < 2_000.0


def test_regions_empty(spark):
    cut = slabs(spark.createDataFrame(SHAPES, "id long, wkt string"))
    assert regions_around(points(spark, [(1, 1)]).limit(0), cut).count() == 0
    assert regions_around(points(spark, [(1, 1)]), cut.limit(0)).count() == 0


@pytest.mark.parametrize(
    "wkt, want",
    [
        ("POINT (200000.5 600000)", (200000.5, 600000, 0)),
        ("point ( 600000   200000.5 )", (200000.5, 600000, 0)),
        ("SRID=2039;POINT(200000 600000)", (200000, 600000, 0)),
        ("POINT Z (200000 600000 329)", (200000, 600000, 0)),
        ("POINT (2.0e+05 6.0e+05)", (200000, 600000, 0)),
        ("POLYGON ((200000 600000, 200010 600000, 200010 600010, 200000 600010, 200000 600000))", (200005, 600005, 1)),
        ("POLYGON ((600000 200000, 600000 200010, 600010 200010, 600010 200000, 600000 200000))", (200005, 600005, 1)),
        ("MULTIPOINT ((200000 600000), (200010 600010))", (200005, 600005, 1)),
        ("LINESTRING (200000 600000, 200010 600000)", (200005, 600000, 1)),
        ("POINT EMPTY", None), ("nan", None), ("", None), (None, None), ("POLYGON EMPTY", None),
    ],
)
def test_places(spark, wkt, want):
    got = spark.createDataFrame([(wkt,)], "g string").select(place(F.col("g")).alias("p")).first().p
    assert got is None if want is None else tuple(got) == pytest.approx(want)


def test_cells(spark):
    df = spark.createDataFrame([("['8a8000180002fff', '8a7fab08166efff']",), ("none",), (None,)], "c string")
    got = [r.p for r in df.select(cell_place(F.col("c")).alias("p")).collect()]
    assert tuple(got[0]) == pytest.approx((66 * 3**0.5 * 2, 198, 2)) and got[1:] == [None, None]


def test_centroid_of_hole():
    assert wkt_centroid("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (2 1, 3 1, 3 3, 2 3, 2 1))") == pytest.approx((27 / 14, 2.0))
