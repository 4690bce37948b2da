"""Places from geometry texts: WKT in many spellings, and cells of a planar hexagonal grid."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
#: EPSG:2039: every y of the region is above this, every x below it.
AXIS_SPLIT = 325_000.0
#: The cells' size: centre x = 66 sqrt(3) (q + r / 2), y = 99 r; q and r are written plus this offset.
CELL_X, CELL_Y, CELL_OFFSET = 66.0 * 3**0.5, 99.0, 524_288


def _rings(body: str) -> list[np.ndarray]:
    """The coordinate lists of a WKT body, each as an array of x, y rows; empty ones left out."""
    out = []
    for part in re.findall(r"[^()]+", body):
        rows = [[float(n) for n in re.findall(NUMBER, p)[:2]] for p in part.split(",")]
        rows = [r for r in rows if len(r) == 2]
        if rows:
            out.append(np.array(rows))
    return out


def _ring_area(ring: np.ndarray) -> tuple[float, np.ndarray]:
    """Signed area and centroid of a ring, closed or not."""
    origin = ring[0]
    p = ring - origin
    q = np.roll(p, -1, axis=0)
    cross = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
    area = cross.sum() / 2
    if abs(area) < 1e-9:
        return 0.0, ring.mean(axis=0)
    return area, origin + ((p + q) * cross[:, None]).sum(axis=0) / (6 * area)


def polygons(wkt: str | None) -> list[list[np.ndarray]]:
    """The polygons of a POLYGON or MULTIPOLYGON, each a shell and its holes; none for anything else."""
    text = re.sub(r"^\s*SRID\s*=\s*\d+\s*;", "", wkt or "", flags=re.I).strip()
    if re.match(r"POLYGON\b", text, re.I):
        found = [_rings(text[7:])]
    elif re.match(r"MULTIPOLYGON\b", text, re.I):
        found = [_rings(p) for p in re.findall(r"\(\s*\([^()]*\)(?:\s*,\s*\([^()]*\))*\s*\)", text[12:])]
    else:
        found = []
    return [p for p in found if p]


def wkt_centroid(wkt: str | None) -> tuple[float, float] | None:
    """The centroid of a WKT text: of areas, else of lengths, else of points. None if it has no coordinates."""
    shapes = polygons(wkt)
    if shapes:
        total, at = 0.0, np.zeros(2)
        for shell, *holes in shapes:
            for sign, ring in [(1, shell), *((-1, h) for h in holes)]:
                area, centre = _ring_area(ring)
                total += sign * abs(area)
                at += sign * abs(area) * centre
        if total > 1e-9:
            return tuple(at / total)
        points = np.vstack([r for p in shapes for r in p])
        return tuple(points.mean(axis=0))
    text = re.sub(r"^\s*SRID\s*=\s*\d+\s*;", "", wkt or "", flags=re.I)
    parts = _rings(text[text.find("(") :]) if "(" in text else []
    if not parts:
        return None
    if re.search("LINESTRING", text, re.I):
        a, b = np.vstack([p[:-1] for p in parts]), np.vstack([p[1:] for p in parts])
        length = np.hypot(*(b - a).T)
        if length.sum() > 0:
            return tuple(((a + b) / 2 * length[:, None]).sum(axis=0) / length.sum())
    return tuple(np.vstack(parts).mean(axis=0))


@F.pandas_udf(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
def _centroid(wkt: pd.Series) -> pd.DataFrame:
    found = [wkt_centroid(w) if w is not None else None for w in wkt]
    return pd.DataFrame([f if f is not None else (None, None) for f in found], columns=["x", "y"], dtype=float)


POINT = rf"(?i)^\s*(?:SRID\s*=\s*\d+\s*;)?\s*POINT\s*(?:ZM|Z|M)?\s*\(\s*({NUMBER})[\s,]+({NUMBER})"


def place(geometry: Column) -> Column:
    """struct(x, y, rank) of a geometry text: rank 0 for a point, 1 for the centroid of a shape; null without coordinates.

    Points are read in the JVM; only other shapes go to Python. The axis order isn't
    trusted: of two numbers on different sides of AXIS_SPLIT the larger is y.
    """
    is_point = geometry.rlike(POINT)
    px = F.regexp_extract(geometry, POINT, 1).try_cast("double")
    py = F.regexp_extract(geometry, POINT, 2).try_cast("double")
    shape = _centroid(F.when(~is_point & geometry.contains("("), geometry))
    a, b = F.when(is_point, px).otherwise(shape["x"]), F.when(is_point, py).otherwise(shape["y"])
    swap = (a > AXIS_SPLIT) & (b < AXIS_SPLIT)
    x, y = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    return F.when(
        x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y),
        F.struct(x.alias("x"), y.alias("y"), F.when(is_point, 0).otherwise(1).alias("rank")),
    )


def surveyed_place(x: Column, y: Column, geometry: Column) -> Column:
    """struct(x, y) of a survey: its own x and y where both are filled, else the place of its geometry text; null without either."""
    own = x.isNotNull() & y.isNotNull()
    return F.coalesce(F.when(own, F.struct(x.alias("x"), y.alias("y"))), place(F.when(~own, geometry)).dropFields("rank"))


def cell_place(cells: Column) -> Column:
    """struct(x, y, rank 2): the centre of the first cell of a text; null if it holds none."""
    cell = r"(?i)8a([0-9a-f]{5})([0-9a-f]{5})fff"
    q, r = (F.conv(F.nullif(F.regexp_extract(cells, cell, i), F.lit("")), 16, 10).cast("int") - CELL_OFFSET for i in (1, 2))
    return F.when(q.isNotNull(), F.struct((CELL_X * (q + r / 2)).alias("x"), (CELL_Y * r).alias("y"), F.lit(2).alias("rank")))
