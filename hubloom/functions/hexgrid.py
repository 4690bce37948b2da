"""A planar hexagonal grid (pointy top) in metres: cells, centres, corners, neighbours, distances by offset."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = 66.0


def _nearest(c: Column) -> Column:
    return F.floor(c + 0.5)


def axial(x: Column, y: Column, edge: float = EDGE) -> tuple[Column, Column]:
    """q and r of the cell that holds the point, by rounding cube coordinates."""
    q, r = (x * (math.sqrt(3) / 3) - y / 3) / edge, y * (2 / 3) / edge
    s = -q - r
    rq, rr, rs = _nearest(q), _nearest(r), _nearest(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    return (
        F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq).cast("bigint"),
        F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr).cast("bigint"),
    )


def cell_id(q: Column, r: Column) -> Column:
    return F.concat_ws(":", q.cast("string"), r.cast("string"))


def centre(q: Column, r: Column, edge: float = EDGE) -> tuple[Column, Column]:
    return (q + r / 2) * (edge * math.sqrt(3)), r * (1.5 * edge)


def corners(q: Column, r: Column, edge: float = EDGE) -> Column:
    """The cell's boundary as an array of six structs x, y."""
    x, y = centre(q, r, edge)
    at = [math.radians(30 + 60 * k) for k in range(6)]
    return F.array(*(F.struct((x + edge * math.cos(a)).alias("x"), (y + edge * math.sin(a)).alias("y")) for a in at))


def ring_offsets(k: int) -> list[tuple[int, int]]:
    """The offsets of all cells at most k steps away, the cell itself among them."""
    return [(q, r) for q in range(-k, k + 1) for r in range(-k, k + 1) if abs(q + r) <= k]


def neighbours(q: Column, r: Column, k: int = 1) -> Column:
    """An array of structs q, r."""
    return F.array(*(F.struct((q + i).cast("bigint").alias("q"), (r + j).cast("bigint").alias("r")) for i, j in ring_offsets(k)))


def edge_distance(dq: int, dr: int, edge: float = EDGE) -> float:
    """Edge-to-edge distance of two cells of the grid: it depends on their offset alone."""
    at = np.radians(30 + 60 * np.arange(6))
    a = edge * np.column_stack([np.cos(at), np.sin(at)])
    b = a + [edge * math.sqrt(3) * (dq + dr / 2), 1.5 * edge * dr]
    if (abs(dq) + abs(dr) + abs(dq + dr)) // 2 <= 1:
        return 0.0
    return min(_to_segments(a, b), _to_segments(b, a))


def _to_segments(p: np.ndarray, ring: np.ndarray) -> float:
    s, e = ring, np.roll(ring, -1, axis=0)
    d = e - s
    t = np.clip(((p[:, None] - s) * d).sum(-1) / (d * d).sum(-1), 0, 1)
    return float(np.sqrt((((s + t[..., None] * d) - p[:, None]) ** 2).sum(-1)).min())


def offsets_within(distance: float, edge: float = EDGE) -> list[tuple[int, int]]:
    """The offsets, each pair of cells once, whose cells are at most `distance` apart edge to edge."""
    k = math.ceil(distance / (1.5 * edge)) + 2
    return [(q, r) for q, r in ring_offsets(k) if (q, r) > (0, 0) and edge_distance(q, r, edge) <= distance]
