"""Spatial joins and areas: containment with one match, nearness, rings over zones, shapes."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hubloom.functions import hexgrid as X
from hubloom.functions.geometry import polygons, wkt_centroid
from hubloom.operators.near import regions_around


def first_region(points: DataFrame, cut: DataFrame, id: str = "id") -> DataFrame:
    """id, region: the first (smallest) region around each point; null for a point in none. points: id, x, y."""
    hit = regions_around(points, cut, id).groupBy("id").agg(F.min("region").alias("region"))
    return points.select(F.col(id).alias("id")).join(hit, "id", "left")


def near_any(points: DataFrame, others: DataFrame, distance: float, keep: str | None = None) -> DataFrame:
    """id, near, best: whether any of the others (x, y) lies within the distance, and the largest `keep` of those.

    A bucketed equi-join: the points have one cell, the others are copied to the nine
    around them. Each point comes out once, however many are near.
    """
    p = points.withColumns({"_cx": F.floor(F.col("x") / distance), "_cy": F.floor(F.col("y") / distance)})
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    o = others.select(
        F.col("x").alias("_x"), F.col("y").alias("_y"), (F.col(keep) if keep else F.lit(1)).alias("_k"), F.explode(around).alias("_o")
    ).select(
        "_x", "_y", "_k", (F.floor(F.col("_x") / distance) + F.col("_o.i")).alias("_cx"), (F.floor(F.col("_y") / distance) + F.col("_o.j")).alias("_cy")
    )
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    hit = p.join(o, ["_cx", "_cy"]).where(dx * dx + dy * dy <= distance * distance).groupBy("id").agg(F.max("_k").alias("best"), F.lit(True).alias("near"))
    return points.select("id").join(hit, "id", "left").select("id", F.coalesce("near", F.lit(False)).alias("near"), "best")


def square_overlap(x: Column, y: Column, r: float, box: tuple[str, str, str, str] = ("x0", "y0", "x1", "y1")) -> Column:
    """Area of a rectangle within the square of half-width r around a point, in the JVM."""
    x0, y0, x1, y1 = (F.col(c) for c in box)
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(x1, x + r) - F.greatest(x0, x - r)) * F.greatest(zero, F.least(y1, y + r) - F.greatest(y0, y - r))


def disc_area(ring: np.ndarray, x: float, y: float, r: float) -> float:
    """Signed area of a ring within a disc, exactly: the sum over its edges of triangles inside and sectors outside."""
    p = ring - [x, y]
    q = np.roll(p, -1, axis=0)
    d = q - p
    a = (d * d).sum(1)
    keep = a > 0
    p, q, d, a = p[keep], q[keep], d[keep], a[keep]
    b = (p * d).sum(1)
    root = b * b - a * ((p * p).sum(1) - r * r)
    root = np.sqrt(np.maximum(root, 0)) * (root > 0)
    t0, t1 = np.clip((-b - root) / a, 0, 1), np.clip((-b + root) / a, 0, 1)
    m0, m1 = p + t0[:, None] * d, p + t1[:, None] * d

    def sector(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return r * r / 2 * np.arctan2(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0], (u * v).sum(1))

    inside = (m0[:, 0] * m1[:, 1] - m0[:, 1] * m1[:, 0]) / 2
    return float((sector(p, m0) + inside + sector(m1, q)).sum())


def overlap_with_disc(wkt: str | None, x: float, y: float, r: float) -> float:
    """Area of a polygon or multipolygon, holes left out, within the disc."""
    return sum(abs(disc_area(shell, x, y, r)) - sum(abs(disc_area(h, x, y, r)) for h in holes) for shell, *holes in polygons(wkt))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _disc_overlaps(wkt: pd.Series, x: pd.Series, y: pd.Series, radii: pd.Series) -> pd.Series:
    return pd.Series([[overlap_with_disc(w, a, b, r) for r in rs] for w, a, b, rs in zip(wkt, x, y, radii)])


def ring_totals(points: DataFrame, zones: DataFrame, areas: list[Column], area: Column, reach: float, sums: list[str], box: tuple[str, str, str, str] = ("x0", "y0", "x1", "y1")) -> DataFrame:
    """id and, for each ring and sum, the zones' values in proportion to their area within the ring.

    areas: of the overlap with nested shapes around the point, the smallest first; a ring
    is what one has over the one before. reach: half-width of the largest. Zones, with
    their bounding boxes, are spread by a grid as wide as the reach. Zones of no area
    count nothing; a share is at most 1. `covered`: whether any zone meets the largest.
    """
    x0, y0, x1, y1 = box
    tiles = F.explode(F.sequence(F.floor((F.col(x0) - reach) / reach), F.floor((F.col(x1) + reach) / reach)))
    z = zones.where(area > 0).withColumn("_tx", tiles)
    z = z.withColumn("_ty", F.explode(F.sequence(F.floor((F.col(y0) - reach) / reach), F.floor((F.col(y1) + reach) / reach))))
    p = points.withColumns({"_tx": F.floor(F.col("x") / reach), "_ty": F.floor(F.col("y") / reach)})
    joined = p.join(z, ["_tx", "_ty"]).where(
        (F.col(x0) <= F.col("x") + reach) & (F.col(x1) >= F.col("x") - reach) & (F.col(y0) <= F.col("y") + reach) & (F.col(y1) >= F.col("y") - reach)
    )
    joined = joined.withColumns({f"_a{i}": a for i, a in enumerate(areas)}).withColumn("_area", area)
    shares = [F.least(F.lit(1.0), (F.col(f"_a{i}") - (F.col(f"_a{i - 1}") if i else F.lit(0.0))) / F.col("_area")) for i in range(len(areas))]
    out = joined.groupBy("id").agg(
        *(F.sum(F.coalesce(F.col(s), F.lit(0.0)) * share).alias(f"{s}_zone{i + 1}") for s in sums for i, share in enumerate(shares)),
        F.max(F.col(f"_a{len(areas) - 1}") > 0).alias("covered"),
    )
    every = points.select("id").join(out, "id", "left")
    named = [f"{s}_zone{i + 1}" for s in sums for i in range(len(areas))]
    return every.select("id", *(F.coalesce(n, F.lit(0.0)).alias(n) for n in named), F.coalesce("covered", F.lit(False)).alias("covered"))


def _below(px: np.ndarray, py: np.ndarray, values: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each place (x, y) the sums of the rows of values over the points with px < x and py < y.

    A wavelet matrix: points lie by px and are parted by the bits of their rank by py, a
    place follows its own rank's bits. So the cost is that of the logarithm of the points
    for each point and place, never of their pairs.
    """
    by_x, by_y = np.argsort(px, kind="stable"), np.argsort(py, kind="stable")
    end, limit = np.searchsorted(px[by_x], x), np.searchsorted(py[by_y], y)
    rank = np.empty(len(px), dtype=np.int64)
    rank[by_y] = np.arange(len(px))
    rank, values = rank[by_x], values[by_x]
    start, out = np.zeros_like(end), np.zeros((len(x), values.shape[1]), dtype=values.dtype)
    for bit in range(len(px).bit_length() - 1, -1, -1):
        one = (rank >> bit) & 1 == 1
        zeros = np.append(0, np.cumsum(~one))
        turn = np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])
        rank, values, n = rank[turn], values[turn], zeros[-1]
        sums = np.zeros((n + 1, values.shape[1]), dtype=values.dtype)
        np.cumsum(values[:n], axis=0, out=sums[1:])
        up = np.flatnonzero((limit >> bit) & 1)
        s0, e0 = zeros[start], zeros[end]
        for at in range(0, len(up), 1 << 16):
            here = up[at : at + (1 << 16)]
            out[here] += sums[e0[here]] - sums[s0[here]]
        s0[up], e0[up] = n + start[up] - s0[up], n + end[up] - e0[up]
        start, end = s0, e0
    return out


def _square_sums(points: pd.DataFrame, zones: pd.DataFrame, radii: Sequence[float], sums: Sequence[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each sum and ring the totals at the points, and whether a zone meets the largest square.

    A zone's area in a quadrant below a place is the product of two ramps, so it is a sum
    over its corners; a square is four quadrants. Numbers have 64 bits of fraction or more
    where the machine has them, as large sums are taken from one another. Zones whose value
    is no finite number, or whose area is a sliver beside the square, are set against each
    point near them.
    """
    wide, reach = np.longdouble, radii[-1]
    x0, y0, x1, y1 = (zones[c].to_numpy(dtype=float) for c in ("x0", "y0", "x1", "y1"))
    value = [zones[s].to_numpy(dtype=float) for s in sums]
    area = (x1 - x0) * (y1 - y0)
    odd = (area < 1e-6 * reach * reach) | ~np.logical_and.reduce([np.isfinite(v) for v in value])
    px, py = points["x"].to_numpy(dtype=float), points["y"].to_numpy(dtype=float)
    # places are taken from the middle of all, to lose no digits
    mx, my = (px.min() + px.max()) / 2, (py.min() + py.max()) / 2
    x, y, ends = px.astype(wide) - mx, py.astype(wide) - my, [(x0.astype(wide) - mx, y0.astype(wide) - my), (x1.astype(wide) - mx, y1.astype(wide) - my)]
    plain = ~odd
    corners = [(ends[i][0][plain], ends[j][1][plain], 1 if i == j else -1) for i in (0, 1) for j in (0, 1)]
    cx, cy = (np.concatenate([c[k] for c in corners]) for k in (0, 1))
    weights = [np.concatenate([c[2] * (v[plain].astype(wide) / area[plain]) for c in corners]) for v in value]
    quadrants = [(k, i, j) for k in range(len(radii)) for i in (-1, 1) for j in (-1, 1)]
    qx, qy = (np.concatenate([p + q[of] * radii[q[0]] for q in quadrants]) for of, p in ((1, x), (2, y)))
    got = _below(cx, cy, np.column_stack([v for w in weights for v in (w, w * cx, w * cy, w * cx * cy)]), qx, qy)
    held = [[np.zeros(len(x), dtype=wide) for _ in radii] for _ in sums]
    for n in range(len(sums)):
        d, dx, dy, dxy = got[:, 4 * n : 4 * n + 4].T
        ramps = d * qx * qy - dx * qy - dy * qx + dxy
        for q, (k, i, j) in enumerate(quadrants):
            held[n][k] += i * j * ramps[q * len(x) : (q + 1) * len(x)]
    del got
    rings = [[(held[n][k] - (held[n][k - 1] if k else 0)).astype(float) for k in range(len(radii))] for n in range(len(sums))]
    # zones that begin before the square's end less those that end before its begin, on both axes
    met = np.zeros(len(x), dtype=np.int64)
    one = np.ones((int(plain.sum()), 1), dtype=np.int64)
    for i in (0, 1):
        for j in (0, 1):
            # an end that only touches the square is before its begin, a beginning that touches its end isn't inside
            ex, ey = (np.nextafter(p - reach, np.inf) if e else p + reach for p, e in ((px, i), (py, j)))
            met += (1 if i == j else -1) * _below((x1 if i else x0)[plain], (y1 if j else y0)[plain], one, ex, ey)[:, 0]
    met = met > 0
    by_x = np.argsort(px, kind="stable")
    sorted_x = px[by_x]
    for z in np.flatnonzero(odd):
        at = by_x[np.searchsorted(sorted_x + reach, x0[z], side="left") : np.searchsorted(sorted_x - reach, x1[z], side="right")]
        at = at[(y0[z] <= py[at] + reach) & (y1[z] >= py[at] - reach)]
        inside = [np.zeros(len(at))] + [
            np.maximum(0, np.minimum(x1[z], px[at] + r) - np.maximum(x0[z], px[at] - r)) * np.maximum(0, np.minimum(y1[z], py[at] + r) - np.maximum(y0[z], py[at] - r)) for r in radii
        ]
        met[at] |= inside[-1] > 0
        for k in range(len(radii)):
            share = np.minimum(1, (inside[k + 1] - inside[k]) / area[z])
            for n, v in enumerate(value):
                with np.errstate(invalid="ignore"):
                    rings[n][k][at] += v[z] * share
    return [ring for of in rings for ring in of], met


def square_ring_totals(points: DataFrame, zones: DataFrame, radii: Sequence[float], sums: list[str], crowd: tuple[int, int] = (150_000, 50_000)) -> DataFrame:
    """ring_totals for squares of the half-widths `radii` (rising) over rectangles x0, y0, x1, y1, without a row for each pair.

    Tiles are four reaches wide; a zone is copied to those within reach of it. Each tile's
    sums are made in one task, or in several where it is crowded: zones and points are
    dealt to parts of `crowd` rows and parts are added up, each pair of parts a task.
    """
    reach, tile = float(radii[-1]), 4 * float(radii[-1])
    tiles = lambda a, b: F.explode(F.sequence(F.floor((F.col(a) - reach) / tile), F.floor((F.col(b) + reach) / tile)))
    z = zones.where("x1 > x0 and y1 > y0 and not isnan(x1) and not isnan(y1)").select("x0", "y0", "x1", "y1", *(F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(s) for s in sums))
    z = z.withColumn("_tx", tiles("x0", "x1")).withColumn("_ty", tiles("y0", "y1"))
    p = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    p = p.withColumns({"_tx": F.floor(F.col("x") / tile), "_ty": F.floor(F.col("y") / tile)})
    cell = ["_tx", "_ty"]
    parts = lambda df, n, most: df.groupBy(*cell).agg(F.ceil(F.count("*") / most).cast("int").alias(n))
    crowded = F.broadcast(parts(z, "_nz", crowd[0]).join(parts(p, "_np", crowd[1]), cell))  # one row for each tile that has both
    dealt = lambda df, own, other: (
        df.join(crowded, cell)
        .withColumn(own, F.floor(F.rand(0) * F.col(f"_n{own[-1]}")).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"_n{other[-1]}") - 1)))
        .drop("_nz", "_np")
    )
    key = [*cell, "_z", "_p"]
    named = [f"{s}_zone{i + 1}" for s in sums for i in range(len(radii))]

    def one(a: pa.Table, b: pa.Table) -> pa.Table:  # not pandas, which takes NaN for null
        rings, met = [np.zeros(len(a))] * len(named), np.zeros(len(a), dtype=bool)
        if len(a) and len(b):
            rings, met = _square_sums(a.select(["x", "y"]).to_pandas(), b.to_pandas(), radii, sums)
        return pa.table([a["id"], *map(pa.array, rings), pa.array(met)], names=["id", *named, "covered"])

    kind = points.schema["id"].dataType.simpleString()
    each = dealt(p, "_p", "_z").groupBy(*key).cogroup(dealt(z, "_z", "_p").groupBy(*key)).applyInArrow(one, f"id {kind}, " + ", ".join(f"{n} double" for n in named) + ", covered boolean")
    out = each.groupBy("id").agg(*(F.sum(n).alias(n) for n in named), F.max("covered").alias("covered"))
    every = points.select("id").join(out, "id", "left")
    return every.select("id", *(F.coalesce(n, F.lit(0.0)).alias(n) for n in named), F.coalesce("covered", F.lit(False)).alias("covered"))


def disc_ring_totals(points: DataFrame, zones: DataFrame, radii: list[float], sums: list[str], wkt: str = "geometry") -> DataFrame:
    """ring_totals for true discs over polygons. zones: wkt and the sums."""
    z = with_shape(zones, wkt)
    overlaps = _disc_overlaps(F.col(wkt), F.col("x"), F.col("y"), F.array(*(F.lit(float(r)) for r in radii)))
    return ring_totals(points, z, [overlaps[i] for i in range(len(radii))], F.col("area_m2"), max(radii), sums)


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("area", "cx", "cy", "x0", "y0", "x1", "y1")]))
def _shape(wkt: pd.Series) -> pd.DataFrame:
    rows = []
    for w in wkt:
        found = polygons(w)
        if not found:
            rows.append((None,) * 7)
            continue
        def size(ring: np.ndarray) -> float:
            q = np.roll(ring, -1, axis=0) - ring[0]
            p = ring - ring[0]
            return abs((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)

        points = np.vstack([r for p in found for r in p])
        area = sum(size(s) - sum(map(size, holes)) for s, *holes in found)
        rows.append((area, *wkt_centroid(w), *points.min(axis=0), *points.max(axis=0)))
    return pd.DataFrame(rows, columns=["area", "cx", "cy", "x0", "y0", "x1", "y1"], dtype=float)


def with_shape(df: DataFrame, wkt: str = "geometry") -> DataFrame:
    """df with area_m2, cx, cy and the bounding box of its polygons; null for anything else."""
    s = df.withColumn("_s", _shape(F.col(wkt)))
    return s.withColumns({"area_m2": F.col("_s.area"), **{c: F.col(f"_s.{c}") for c in ("cx", "cy", "x0", "y0", "x1", "y1")}}).drop("_s")


def _segments_cross(a: np.ndarray, b: np.ndarray) -> bool:
    p, r = a[:, None], (np.roll(a, -1, axis=0) - a)[:, None]
    q, s = b[None], (np.roll(b, -1, axis=0) - b)[None]
    cross = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    d = cross(r, s)
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = cross(q - p, s) / d, cross(q - p, r) / d
    return bool(((d != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)).any())


def _holds(shape: list[list[np.ndarray]], at: np.ndarray) -> bool:
    odd = False
    for ring in (r for p in shape for r in p):
        a, b = ring, np.roll(ring, -1, axis=0)
        over = (a[:, 1] > at[1]) != (b[:, 1] > at[1])
        with np.errstate(divide="ignore", invalid="ignore"):
            odd ^= bool((over & (at[0] < (b[:, 0] - a[:, 0]) * (at[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0])).sum() % 2)
    return odd


def shapes_intersect(a: str | None, b: str | None) -> bool:
    """Whether two polygon texts share any point."""
    p, q = polygons(a), polygons(b)
    if not p or not q:
        return False
    rings = [(x, y) for s in p for x in s for t in q for y in t]
    return any(_segments_cross(x, y) for x, y in rings) or any(_holds(q, s[0][0]) for s in p) or any(_holds(p, t[0][0]) for t in q)


def shape_within(a: str | None, b: str | None) -> bool:
    """Whether polygon a lies in polygon b: every corner inside and no edges crossing."""
    p, q = polygons(a), polygons(b)
    if not p or not q:
        return False
    rings = [(x, y) for s in p for x in s for t in q for y in t]
    return all(_holds(q, c) for s in p for c in s[0]) and not any(_segments_cross(x, y) for x, y in rings)


@F.pandas_udf(T.BooleanType())
def intersects(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([shapes_intersect(x, y) for x, y in zip(a, b)])


@F.pandas_udf(T.BooleanType())
def within(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([shape_within(x, y) for x, y in zip(a, b)])


def shape_pairs(left: DataFrame, right: DataFrame, id: str, wkt: str = "geometry", tile: float = 5_000.0) -> DataFrame:
    """id_a, id_b: shapes of two tables that intersect: boxes meet in a grid tile first, then in full."""
    def boxed(df: DataFrame, n: str) -> DataFrame:
        s = with_shape(df.select(F.col(id).alias(f"id_{n}"), F.col(wkt).alias(f"w_{n}")), f"w_{n}").where("x0 is not null")
        s = s.withColumn("tx", F.explode(F.sequence(F.floor(F.col("x0") / tile), F.floor(F.col("x1") / tile))))
        s = s.withColumn("ty", F.explode(F.sequence(F.floor(F.col("y0") / tile), F.floor(F.col("y1") / tile))))
        return s.select(f"id_{n}", f"w_{n}", "tx", "ty", *(F.col(c).alias(f"{c}_{n}") for c in ("x0", "y0", "x1", "y1")))

    pairs = boxed(left, "a").join(boxed(right, "b"), ["tx", "ty"]).where("x0_a <= x1_b and x0_b <= x1_a and y0_a <= y1_b and y0_b <= y1_a")
    once = pairs.dropDuplicates(["id_a", "id_b"])
    return once.where(intersects("w_a", "w_b")).select("id_a", "id_b")


def bounds_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: both tables' bounds of x and y, and the share of a's box that b's covers."""
    ends = lambda df, n: df.agg(*(f(c).alias(f"{n}_{k}_{c}") for c in ("x", "y") for k, f in (("min", F.min), ("max", F.max))))
    j = ends(a, "a").crossJoin(ends(b, "b"))
    side = lambda c: F.greatest(F.lit(0.0), F.least(f"a_max_{c}", f"b_max_{c}") - F.greatest(f"a_min_{c}", f"b_min_{c}"))
    whole = (F.col("a_max_x") - F.col("a_min_x")) * (F.col("a_max_y") - F.col("a_min_y"))
    return j.withColumn("coverage", F.try_divide(side("x") * side("y"), whole))


def dissolve(cells: DataFrame, group: str, edge: float = X.EDGE) -> DataFrame:
    """group, cells, area, edges, perimeter, outline: the union of each group's cells (q, r; once each).

    An edge that two cells of a group share isn't of its outline: edges are counted by
    group and place, so no cell is compared with another. outline: MULTILINESTRING of what
    is left, a line for each edge.
    """
    corner = X.corners(F.col("q"), F.col("r"), edge)
    spot = lambda k: F.struct(F.round(F.get("_c", k)["x"], 3).alias("x"), F.round(F.get("_c", k)["y"], 3).alias("y"))
    sides = F.array(*(F.struct(F.least(spot(k), spot((k + 1) % 6)).alias("a"), F.greatest(spot(k), spot((k + 1) % 6)).alias("b")) for k in range(6)))
    each = cells.withColumn("_c", corner).select(group, F.inline(sides))
    outer = each.groupBy(group, "a", "b").agg(F.count("*").alias("n")).where("n = 1")
    text = lambda p: F.concat_ws(" ", *(F.format_string("%.3f", F.col(f"{p}.{c}")) for c in ("x", "y")))
    lines = outer.groupBy(group).agg(F.count("*").alias("edges"), F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("("), text("a"), F.lit(", "), text("b"), F.lit(")")))), ", ").alias("outline"))
    counted = cells.groupBy(group).agg(F.count("*").alias("cells"))
    return counted.join(lines, group).select(
        group, "cells", (F.col("cells") * (1.5 * math.sqrt(3) * edge * edge)).alias("area"), "edges", (F.col("edges") * edge).alias("perimeter"),
        F.concat(F.lit("MULTILINESTRING ("), "outline", F.lit(")")).alias("outline"),
    )
