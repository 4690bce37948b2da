"""Points near other points, and the regions around points, by equi-joins only.

Distances: a grid as wide as the distance; a point's partners lie in its own cell or the
eight around it, so one side is copied to half of them and joined by cell. Cells with
very many points are salted.

Regions: a trapezoidal decomposition by tiles. Each region's boundary is clipped to square
tiles, crowded ones being quartered, and cut in each tile at the x of every end and
crossing into slabs, in which its edges don't cross and are ordered by y. A slab knows
whether its lower end lies inside. A tile's slabs are one row; a point searches the slabs
of its tile in halves, then the slab's edges in halves: each edge below it changes sides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubloom.functions.geometry import polygons

from hubloom.session import written

#: Points in a cell from which its join is spread over several tasks.
HOT = 10_000
#: Edges from which a tile is quartered, and how often at most: edges that meet in one point can't be parted.
CROWDED, DEEPEST = 48, 20
#: Rows of slabs that are built at a time.
BATCH = 2_000


def _salts(points: DataFrame, cell: list[str], hot: int) -> DataFrame:
    """cell, salts: a salt for every `hot` points of a crowded cell: one side of its join is dealt out, the other copied."""
    return points.groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") > hot).select(*cell, F.ceil(F.col("n") / hot).cast("int").alias("salts"))


def pairs_within(points: DataFrame, distance: float, id: str = "id", x: str = "x", y: str = "y", hot: int = HOT) -> DataFrame:
    """id_a < id_b, d: all pairs of points at most `distance` apart.

    points: one row per id. Rows with a null id, x or y have no partners. Ties at the
    distance itself are in.
    """
    p = points.select(F.col(id).alias("id"), F.col(x).alias("x"), F.col(y).alias("y")).where(
        "id is not null and x is not null and y is not null and not isnan(x) and not isnan(y)"
    )
    p = p.withColumns({"cx": F.floor(F.col("x") / distance), "cy": F.floor(F.col("y") / distance)})
    crowded = _salts(p, ["cx", "cy"], hot)
    right = p.join(crowded, ["cx", "cy"], "left").select(
        F.col("id").alias("id_r"), F.col("x").alias("x_r"), F.col("y").alias("y_r"), "cx", "cy",
        F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"),
    )
    half = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))))
    left = (
        p.select("id", "x", "y", "cx", "cy", F.explode(half).alias("o"))
        .select("id", "x", "y", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"), (F.col("o.i") + F.abs("o.j") == 0).alias("same"))
        .join(crowded, ["cx", "cy"], "left")
        .select("id", "x", "y", "cx", "cy", "same", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    )
    dx, dy = F.col("x") - F.col("x_r"), F.col("y") - F.col("y_r")
    d = F.sqrt(dx * dx + dy * dy)
    return (
        left.join(right, ["cx", "cy", "salt"])
        .where((d <= distance) & (~F.col("same") | (F.col("id") < F.col("id_r"))) & (F.col("id") != F.col("id_r")))
        .select(F.least("id", "id_r").alias("id_a"), F.greatest("id", "id_r").alias("id_b"), d.alias("d"))
    )


def _edges(wkt: str | None) -> np.ndarray:
    """xl, yl, xr, yr of every edge of a region, from left to right, an upright one as it comes."""
    edges = [np.empty((0, 4))]
    for ring in (r for p in polygons(wkt) for r in p):
        after = np.roll(ring, -1, axis=0)
        edges.append(np.hstack([ring, after])[(ring != after).any(axis=1)])
    e = np.vstack(edges)
    turned = e[:, 0] > e[:, 2]
    e[turned] = e[turned][:, [2, 3, 0, 1]]
    return e


def _by_columns(e: np.ndarray, first: np.ndarray, last: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of edges in the columns first..last of each, and their columns. Upright ones are whole."""
    n = (last - first + 1).astype(np.int64)
    of = np.repeat(np.arange(len(e)), n)
    column = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    xl, yl, xr, yr = e[of].T
    a, b = np.maximum(xl, column * size), np.minimum(xr, (column + 1) * size)
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = (yr - yl) / (xr - xl)
        pieces = np.stack([a, np.where(a == xl, yl, yl + slope * (a - xl)), b, np.where(b == xr, yr, yl + slope * (b - xl))], axis=1)
    kept = (a < b) | (xl == xr)
    return pieces[kept], column[kept]


def _crossings(e: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The x at which edges cross the heights y."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(e[:, 0] == e[:, 2], e[:, 0], e[:, 0] + (y - e[:, 1]) * (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1]))


def _by_rows(e: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of edges in rows of tiles, the edge and row of each; and the row and x of every crossing of a row's lower line."""
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    first, last = np.floor(low / size), np.floor(high / size)
    n = (last - first + 1).astype(np.int64)
    of = np.repeat(np.arange(len(e)), n)
    row = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    up = e[of]
    down = up[:, 1] > up[:, 3]
    at_low, at_high = _crossings(up, row * size), _crossings(up, (row + 1) * size)
    inner_low, inner_high = row > first[of], row < last[of]
    p = up.copy()
    for side, y in ((inner_low, row * size), (inner_high, (row + 1) * size)):
        x = at_low if side is inner_low else at_high
        for mask, k in ((side & (down == (side is inner_low)), 2), (side & (down != (side is inner_low)), 0)):
            p[mask, k], p[mask, k + 1] = x[mask], y[mask]
    return p, of, row, row[inner_low], at_low[inner_low]


def _leaf(level: int, tx: int, ty: int, size: float, pieces: np.ndarray, corner: int, flips: np.ndarray) -> Iterator[tuple]:
    """The rows of a tile. corner: whether the place just right of its lower left corner lies inside; flips: where that changes along its lower line."""
    p = pieces[pieces[:, 0] < pieces[:, 2]]
    x0, x1, y0 = tx * size, (tx + 1) * size, ty * size
    if len(p) > CROWDED and level < DEEPEST:
        half = size / 2
        xm, ym = x0 + half, y0 + half
        low, high = np.minimum(pieces[:, 1], pieces[:, 3]), np.maximum(pieces[:, 1], pieces[:, 3])
        over = (low < ym) & (high >= ym)
        middle = np.sort(_crossings(pieces[over], np.full(over.sum(), ym)))
        above = (corner + np.count_nonzero((p[:, 0] == x0) & (p[:, 1] < ym))) % 2
        parts, of, row, _, _ = _by_rows(pieces, half)
        for j, begin, line in ((0, corner, flips), (1, above, middle[middle > x0])):
            mine = parts[np.clip(row - 2 * ty, 0, 1) == j]
            first, last = (np.clip(np.floor(mine[:, k] / half), 2 * tx, 2 * tx + 1) for k in (0, 2))
            cut, column = _by_columns(mine, first, last, half)
            right = (begin + np.count_nonzero(line <= xm)) % 2
            yield from _leaf(level + 1, 2 * tx, 2 * ty + j, half, cut[column == 2 * tx], begin, line[line < xm])
            yield from _leaf(level + 1, 2 * tx + 1, 2 * ty + j, half, cut[column == 2 * tx + 1], right, line[line > xm])
        return
    if not len(p) and not len(flips):
        if corner:
            yield size, tx, ty, [x0, x1], [True], [0, 0], [], []
        return
    xs = np.unique(np.concatenate([[x0, x1], p[:, 0], p[:, 2], flips]))
    xs = xs[(xs >= x0) & (xs <= x1)]
    inside = (corner + np.searchsorted(flips, (xs[:-1] + xs[1:]) / 2)) % 2 == 1
    at, edge = np.nonzero((p[:, 0] <= xs[:-1, None]) & (p[:, 2] >= xs[1:, None]))
    slope = (p[:, 3] - p[:, 1]) / (p[:, 2] - p[:, 0])
    a, b = (p[edge, 1] + slope[edge] * (xs[at + k] - p[edge, 0]) for k in (0, 1))
    order = np.lexsort((b, a + b, at))
    starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(inside)))])
    yield size, tx, ty, xs.tolist(), inside.tolist(), starts.tolist(), a[order].tolist(), b[order].tolist()


def _tiles(wkt: str | None, tile: float) -> Iterator[tuple]:
    """The rows of a region."""
    e = _edges(wkt)
    if not len(e):
        return
    columns, column = _by_columns(e, np.floor(e[:, 0] / tile), np.floor(e[:, 2] / tile), tile)
    pieces, of, row, crossed, x = _by_rows(columns, tile)
    key = np.stack([row, column[of]], axis=1)
    order = np.lexsort((key[:, 1], key[:, 0]))
    pieces, key = pieces[order], key[order]
    found, begin = np.unique(key, axis=0, return_index=True)
    groups = dict(zip(map(tuple, found.astype(np.int64).tolist()), np.split(pieces, begin[1:])))
    order = np.lexsort((x, crossed))
    crossed, x = crossed[order], x[order]
    left, right = int(column.min()), int(column.max())
    nothing = np.empty((0, 4))
    for ty in range(int(row.min()), int(row.max()) + 1):
        line = x[np.searchsorted(crossed, ty) : np.searchsorted(crossed, ty, "right")]
        for tx in range(left, right + 1):
            a, b = np.searchsorted(line, tx * tile, "right"), np.searchsorted(line, (tx + 1) * tile)
            mine = groups.get((ty, tx), nothing)
            if len(mine) or a < b or a % 2:
                yield from _leaf(0, tx, ty, tile, mine, int(a % 2), line[a:b])


SLABS = "region bigint, size double, tx bigint, ty bigint, xs array<double>, inside array<boolean>, starts array<int>, y0 array<double>, y1 array<double>"


def slabs(regions: DataFrame, id: str = "id", wkt: str = "wkt", tile: float = 2_000.0) -> DataFrame:
    """The slabs of all regions, a row for each region and tile, as a written table. Holes and multipolygons count by the even-odd rule.

    The tile sets how the work is spread: a region has a row for each tile inside it, and
    rows of slabs along its boundary, whose edges are in proportion to its own.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["region", "size", "tx", "ty", "xs", "inside", "starts", "y0", "y1"]
        for batch in batches:
            for region, text in zip(batch["region"], batch["wkt"]):
                rows = ((region, *row) for row in _tiles(text, tile))
                while some := list(islice(rows, BATCH)):
                    yield pd.DataFrame(some, columns=names)

    kept = regions.where(F.col(id).isNotNull() & F.col(wkt).isNotNull())
    return written(kept.select(F.col(id).cast("bigint").alias("region"), F.col(wkt).alias("wkt")).mapInPandas(cut, SLABS))[0]


def _halved(low: Column, high: Column, before: Callable[[Column], Column]) -> Column:
    """The first place in low..high before which `before` holds no longer, by halving."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2((high - low) + F.lit(1.0))).cast("int"))

    def halve(found: Column, _: Column) -> Column:
        mid = ((found["lo"] + found["hi"]) / 2).cast("int")
        open_ = found["lo"] < found["hi"]
        over = open_ & before(mid)
        return F.struct(F.when(over, mid + 1).otherwise(found["lo"]).alias("lo"), F.when(over | ~open_, found["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(steps, F.struct(low.alias("lo"), high.alias("hi")), halve)["lo"]


def regions_around(points: DataFrame, cut: DataFrame, id: str = "id", x: str = "x", y: str = "y", hot: int = HOT) -> DataFrame:
    """id, region: the regions each point lies in. cut: of `slabs`. A lower or left boundary is inside, an upper or right one outside.

    Rows with a null id, x or y lie nowhere. Tiles with very many points are salted.
    """
    sizes = sorted(r["size"] for r in cut.select("size").distinct().collect())  # one for each time a tile may be quartered
    p = points.select(F.col(id).alias("id"), F.col(x).alias("x"), F.col(y).alias("y")).where(
        "id is not null and x is not null and y is not null and not isnan(x) and not isnan(y)"
    )
    p = p.withColumn("size", F.explode(F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<double>"))).withColumns(
        {"tx": F.floor(F.col("x") / F.col("size")), "ty": F.floor(F.col("y") / F.col("size"))}
    )
    cell = ["size", "tx", "ty"]
    p = p.join(cut.select(*cell).distinct(), cell, "left_semi")
    crowded = _salts(p, cell, hot)
    p = p.join(crowded, cell, "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    copied = cut.join(crowded, cell, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    px, py = F.col("x"), F.col("y")
    slab = _halved(F.lit(0), F.size("xs"), lambda k: F.get("xs", k) <= px) - 1
    met = p.join(copied, [*cell, "salt"]).withColumn("slab", F.greatest(F.least(slab, F.size("inside") - 1), F.lit(0)))
    met = met.withColumn("t", (px - F.get("xs", F.col("slab"))) / (F.get("xs", F.col("slab") + 1) - F.get("xs", F.col("slab"))))
    begin = F.get("starts", F.col("slab"))
    below = _halved(begin, F.get("starts", F.col("slab") + 1), lambda k: F.get("y0", k) + (F.get("y1", k) - F.get("y0", k)) * F.col("t") <= py) - begin
    return met.where((below % 2 == 1) != F.get("inside", F.col("slab"))).select("id", "region")
