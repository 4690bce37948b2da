"""Queries on places, zones, grids and connected groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubloom.functions import hexgrid as X
from hubloom.functions.geometry import AXIS_SPLIT, place, surveyed_place
from hubloom.operators import spatial as P
from hubloom.operators.grouping import merge_groups_by_nodes, numbered_groups
from hubloom.operators.near import pairs_within, slabs
from hubloom.operators.numbering import number_in_order, seeded_sample
from hubloom.operators.validate import geometry_counts
from hubloom.plans.preparation import hub_places
from hubloom.plans.registry import Registry
from hubloom.session import table, written

query = Registry()
queries, oracle_sql = query.queries, query.oracle_sql

# Suppliers and customers stand for places, by whole-number coordinates made from their keys.
SUPPLIERS = "s AS (SELECT s_suppkey AS id, ((s_suppkey * 7919) % 1000)::DOUBLE AS x, ((s_suppkey * 104729) % 1000)::DOUBLE AS y FROM supplier)"
CUSTOMERS = "c AS (SELECT c_custkey AS id, ((c_custkey * 7919) % 20011)::DOUBLE AS x, ((c_custkey * 104729) % 20021)::DOUBLE AS y FROM customer)"
TERMINALS = "t AS (SELECT s_suppkey AS tid, ((s_suppkey * 15485863) % 20011)::DOUBLE AS x, ((s_suppkey * 32452843) % 20021)::DOUBLE AS y, (s_suppkey % 4)::BIGINT AS category FROM supplier)"
ZONES = "z AS (SELECT p_partkey AS zid, ((p_partkey * 31) % 20011)::DOUBLE AS x0, ((p_partkey * 977) % 20021)::DOUBLE AS y0, ((p_partkey * 31) % 20011 + 100 + p_size * 10)::DOUBLE AS x1, ((p_partkey * 977) % 20021 + 150 + p_size * 8)::DOUBLE AS y1, p_retailprice * 1.000731::DOUBLE AS pop, p_size * 1.03717::DOUBLE AS emp FROM part)"
LINK = 60.0


def _places(spark: SparkSession, sf_dir: str, name: str, key: str, m: int, n: int, a: int = 7919, b: int = 104729, *more) -> DataFrame:
    k = F.col(key)
    return table(spark, sf_dir, name).select(k.alias("id"), ((k * a) % m).cast("double").alias("x"), ((k * b) % n).cast("double").alias("y"), *more)


def _suppliers(spark, sf_dir):
    return _places(spark, sf_dir, "supplier", "s_suppkey", 1000, 1000)


def _customers(spark, sf_dir):
    return _places(spark, sf_dir, "customer", "c_custkey", 20011, 20021)


def _terminals(spark, sf_dir):
    return _places(spark, sf_dir, "supplier", "s_suppkey", 20011, 20021, 15485863, 32452843, (F.col("s_suppkey") % 4).alias("category"))


def _boxes(spark, sf_dir):
    p, s = F.col("p_partkey"), F.col("p_size")
    x0, y0 = (p * 31) % 20011, (p * 977) % 20021
    ends = {"x0": x0, "y0": y0, "x1": x0 + 100 + s * 10, "y1": y0 + 150 + s * 8}
    return table(spark, sf_dir, "part").select(p.alias("zid"), *(c.cast("double").alias(n) for n, c in ends.items()), (F.col("p_retailprice") * 1.000731).alias("pop"), (s * 1.03717).alias("emp"))


_PAIRS = f"{SUPPLIERS}, pairs AS (SELECT a.id AS id_a, b.id AS id_b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM s a JOIN s b ON a.id < b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {LINK * LINK})"


@query(f"WITH {_PAIRS} SELECT id_a, id_b, round(d, 4) AS d FROM pairs")
def proximity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_within(_suppliers(spark, sf_dir), LINK).select("id_a", "id_b", F.round("d", 4).alias("d"))


_GROUPS = f"""{_PAIRS}, link AS (SELECT id_a AS a, id_b AS b FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
  reach(id, v) AS (SELECT id, id FROM s UNION SELECT r.id, l.b FROM reach r JOIN link l ON l.a = r.v),
  root AS (SELECT id, min(v) AS root FROM reach GROUP BY id), grp AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS g FROM root)"""


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _suppliers(spark, sf_dir)
    return numbered_groups(s, pairs_within(s, LINK).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))


@query(f'WITH RECURSIVE {_GROUPS} SELECT id, g::BIGINT AS "group" FROM grp')
def proximity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir)


@query(f"""WITH RECURSIVE {_GROUPS}, note AS (SELECT s_acctbal::BIGINT // 500 AS note, s_suppkey AS id FROM supplier), gl AS (SELECT DISTINCT n.note, grp.g FROM note n JOIN grp USING (id)),
  ln AS (SELECT x.g AS a, y.g AS b FROM gl x JOIN gl y USING (note)), mg(g, v) AS (SELECT DISTINCT g, g FROM grp UNION SELECT m.g, ln.b FROM mg m JOIN ln ON ln.a = m.v),
  mr AS (SELECT g, min(v) AS root FROM mg GROUP BY g) SELECT grp.id, (dense_rank() OVER (ORDER BY mr.root) - 1)::BIGINT AS "group" FROM grp JOIN mr USING (g)""")
def manual_merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups tied by notes become one: suppliers with like balances stand for notes."""
    members = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("node"))
    notes = table(spark, sf_dir, "supplier").select(F.expr("cast(round(s_acctbal) as bigint) div 500").alias("note"), F.col("s_suppkey").alias("node"))
    groups, _ = written(_groups(spark, sf_dir))
    return merge_groups_by_nodes(groups, members, notes)


_RING = r"""rg AS (SELECT zone_id, r AS ring, list_transform(string_split(ring_text, ','), lambda p: [TRY_CAST(regexp_extract(trim(p), '^(\S+)\s+(\S+)', 1) AS DOUBLE), TRY_CAST(regexp_extract(trim(p), '^(\S+)\s+(\S+)', 2) AS DOUBLE)]) AS pts
  FROM (SELECT zone_id, unnest(regexp_extract_all(geometry, '\(([^()]+)\)', 1)) AS ring_text, generate_subscripts(regexp_extract_all(geometry, '\(([^()]+)\)', 1), 1) AS r FROM zones)),
  ed AS (SELECT zone_id, ring, pts[i][1] AS xa, pts[i][2] AS ya, pts[i % len(pts) + 1][1] AS xb, pts[i % len(pts) + 1][2] AS yb FROM (SELECT *, unnest(range(1, len(pts) + 1)) AS i FROM rg))"""
_IN = f"""{_RING}, pt AS (SELECT row_id AS id, x, y FROM transit_nodes WHERE x IS NOT NULL AND y IS NOT NULL),
  inside AS (SELECT pt.id, ed.zone_id FROM pt JOIN ed ON xa <> xb AND ((xa <= pt.x AND pt.x < xb) OR (xb <= pt.x AND pt.x < xa)) AND ya + (yb - ya) * (pt.x - xa) / (xb - xa) <= pt.y GROUP BY ALL HAVING count(*) % 2 = 1)"""


_FILLED = "FROM transit_nodes WHERE x IS NOT NULL AND y IS NOT NULL"
_LOCATED = rf"""tx AS (SELECT row_id, x, y, x IS NOT NULL AND y IS NOT NULL AS own, TRY_CAST(regexp_extract(geometry, 'POINT\s*\(([\d.]+)\s+([\d.]+)\)', 1) AS DOUBLE) AS a, TRY_CAST(regexp_extract(geometry, 'POINT\s*\(([\d.]+)\s+([\d.]+)\)', 2) AS DOUBLE) AS b FROM transit_nodes),
  sv AS (SELECT row_id, CASE WHEN own THEN x WHEN a > {AXIS_SPLIT} AND b < {AXIS_SPLIT} THEN b ELSE a END AS x, CASE WHEN own THEN y WHEN a > {AXIS_SPLIT} AND b < {AXIS_SPLIT} THEN a ELSE b END AS y FROM tx WHERE own OR (a IS NOT NULL AND b IS NOT NULL))"""


def _whole(sql: str) -> str:
    """The same SQL over all surveys with a place, whether it is in x and y or in the geometry text."""
    return f"{_LOCATED}, {sql.replace(_FILLED, 'FROM sv')}"


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, x, y of every survey with a place: x and y where they are filled, else the geometry text's."""
    p = surveyed_place(F.col("x"), F.col("y"), F.col("geometry"))
    t = table(spark, sf_dir, "transit_nodes").select("row_id", p.alias("p")).where("p is not null")
    return t.select("row_id", "p.x", "p.y")


def _first_zone(spark: SparkSession, sf_dir: str, places: DataFrame) -> DataFrame:
    cut = slabs(table(spark, sf_dir, "zones"), "zone_id", "geometry")
    return P.first_region(places, cut).select("id", F.col("region").alias("zone_id"))


@query(f"WITH {_whole(_IN)} SELECT pt.id, min(zone_id) AS zone_id FROM pt LEFT JOIN inside USING (id) GROUP BY pt.id")
def point_in_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first zone around each surveyed place, also of those that have only a geometry text."""
    return _first_zone(spark, sf_dir, located(spark, sf_dir).withColumnRenamed("row_id", "id"))


@query(f"""WITH {_whole(_IN)}, f AS (SELECT pt.id, any_value(pt.y) AS y, min(zone_id) AS zone_id FROM pt LEFT JOIN inside USING (id) GROUP BY pt.id)
  SELECT f.id, coalesce(z.metro_name, CASE WHEN f.y < 600000 THEN 'South district' WHEN f.y < 750000 THEN 'North district' END, 'Unknown') AS area FROM f LEFT JOIN zones z USING (zone_id)""")
def zone_then_district_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zone's name, else the district's, else unknown, for every surveyed place, also those that have only a geometry text. Districts are two rectangles here."""
    return _areas(spark, sf_dir, located(spark, sf_dir).withColumnRenamed("row_id", "id"))


def _areas(spark: SparkSession, sf_dir: str, surveyed: DataFrame) -> DataFrame:
    box = "POLYGON ((0 {0}, 1000000 {0}, 1000000 {1}, 0 {1}, 0 {0}))"
    districts = spark.createDataFrame([(1, "South district", box.format(0, 600000)), (2, "North district", box.format(600000, 750000))], "zone_id bigint, name string, geometry string")
    zones = table(spark, sf_dir, "zones")
    places, _ = written(surveyed)
    z = P.first_region(places, slabs(zones, "zone_id", "geometry")).join(zones.select(F.col("zone_id").alias("region"), "metro_name"), "region", "left").select("id", "metro_name")
    left = places.join(z.where("metro_name is null"), "id", "left_semi")
    d = P.first_region(left, slabs(districts, "zone_id", "geometry")).join(districts.select(F.col("zone_id").alias("region"), "name"), "region", "left").select("id", "name")
    return z.join(d, "id", "left").select("id", F.coalesce("metro_name", "name", F.lit("Unknown")).alias("area"))


_NEAR = f"WITH {CUSTOMERS}, {TERMINALS}, h AS (SELECT c.id, max(t.category) AS best FROM c JOIN t ON (c.x - t.x) * (c.x - t.x) + (c.y - t.y) * (c.y - t.y) <= 40000 GROUP BY c.id)"


@query(f"{_NEAR} SELECT c.id, h.id IS NOT NULL AS near FROM c LEFT JOIN h USING (id)")
def terminal_within_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.near_any(_customers(spark, sf_dir), _terminals(spark, sf_dir), 200.0).select("id", "near")


@query(f"{_NEAR} SELECT c.id, h.best FROM c LEFT JOIN h USING (id)")
def terminal_best_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per place, with the best category near it."""
    return P.near_any(_customers(spark, sf_dir), _terminals(spark, sf_dir), 200.0, "category").select("id", "best")


RADII = (500.0, 1000.0, 1500.0)
_OV = {i: f"greatest(0, least(x1, c.x + {r}) - greatest(x0, c.x - {r})) * greatest(0, least(y1, c.y + {r}) - greatest(y0, c.y - {r}))" for i, r in enumerate(RADII, 1)}
_RT = f"""WITH {CUSTOMERS}, {ZONES}, o AS (SELECT c.id, pop, emp, (x1 - x0) * (y1 - y0) AS t, {', '.join(f'{e} AS a{i}' for i, e in _OV.items())} FROM c JOIN z ON x0 <= c.x + 1500 AND x1 >= c.x - 1500 AND y0 <= c.y + 1500 AND y1 >= c.y - 1500)"""
_SH = {1: "a1 / t", 2: "(a2 - a1) / t", 3: "(a3 - a2) / t"}


@query(f"{_RT}, r AS (SELECT id, " + ", ".join(f"sum({s} * least(1, {e})) AS {s}_zone{i}" for s in ("pop", "emp") for i, e in _SH.items()) + ", max((a3 > 0)::INT) = 1 AS covered FROM o GROUP BY id) SELECT c.id, "
       + ", ".join(f"round(coalesce({s}_zone{i}, 0), 2)::DOUBLE AS {s}_zone{i}" for s in ("pop", "emp") for i in _SH) + ", coalesce(covered, false) AS covered FROM c LEFT JOIN r USING (id)")
def ring_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People and jobs in rings around each place, by share of area: square rings over rectangles, which SQL can repeat."""
    out = P.square_ring_totals(_customers(spark, sf_dir), _boxes(spark, sf_dir), RADII, ["pop", "emp"])
    return out.select("id", *(F.round(c, 2).alias(c) for c in out.columns[1:-1]), "covered")


@query()
def ring_population_discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each zone in true rings around the hubs; polygons with holes, discs exactly."""
    places = hub_places(spark, sf_dir).withColumnRenamed("group_id", "id")
    zones = table(spark, sf_dir, "zones").select("geometry", F.lit(1_000_000.0).alias("pop"))
    return P.disc_ring_totals(places, zones, list(RADII), ["pop"])


_EDGE = f"{X.EDGE}::DOUBLE"
_SQ3 = "1.7320508075688772::DOUBLE"
_HEX = f"""ax AS (SELECT row_id, (x * ({_SQ3} / 3) - y / 3) / {_EDGE} AS q, (y * (2.0::DOUBLE / 3)) / {_EDGE} AS r FROM transit_nodes WHERE x IS NOT NULL AND y IS NOT NULL),
  rd AS (SELECT *, floor(q + 0.5) AS rq, floor(r + 0.5) AS rr, floor(-q - r + 0.5) AS rs FROM ax), df AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - (-q - r)) AS ds FROM rd),
  hx AS (SELECT row_id, CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END::BIGINT AS q, CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END::BIGINT AS r FROM df)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = located(spark, sf_dir)
    q, r = X.axial(F.col("x"), F.col("y"))
    return t.select("row_id", q.alias("q"), r.alias("r"))


_CELLS = f" SELECT row_id, q || ':' || r AS cell, round({_EDGE} * {_SQ3} * (q + r / 2), 3) AS cx, round(1.5 * {_EDGE} * r, 3) AS cy FROM hx"


def _hex_cells(c: DataFrame) -> DataFrame:
    cx, cy = X.centre(F.col("q"), F.col("r"))
    return c.select("row_id", X.cell_id(F.col("q"), F.col("r")).alias("cell"), F.round(cx, 3).alias("cx"), F.round(cy, 3).alias("cy"))


def _hex_neighbors(c: DataFrame) -> DataFrame:
    d = c.select("q", "r").distinct()
    return d.select(F.inline(X.neighbours(F.col("q"), F.col("r"), 1))).distinct()


_OFFSETS = X.offsets_within(120.1)


def _hex_pairs(cells: DataFrame) -> DataFrame:
    c = cells.select("q", "r").distinct()
    near = F.array(*(F.struct((F.col("q") + i).alias("qb"), (F.col("r") + j).alias("rb")) for i, j in _OFFSETS))
    a = c.select(F.col("q").alias("qa"), F.col("r").alias("ra"), F.inline(near))
    return a.join(c.select(F.col("q").alias("qb"), F.col("r").alias("rb")), ["qb", "rb"]).select("qa", "ra", "qb", "rb")


@query(f"WITH {_whole(_HEX)}{_CELLS}")
def hex_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell of every surveyed place, also of those that have only a geometry text, and its centre."""
    return _hex_cells(_cells(spark, sf_dir))


@query(f"WITH {_whole(_HEX)} SELECT DISTINCT c.q + i AS q, c.r + j AS r FROM (SELECT DISTINCT q, r FROM hx) c, range(-1, 2) a(i), range(-1, 2) b(j) WHERE abs(i + j) <= 1")
def hex_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells in or next to one that holds any place."""
    return _hex_neighbors(_cells(spark, sf_dir))


@query(f"WITH {_whole(_HEX)}, c AS (SELECT DISTINCT q, r FROM hx), o AS (SELECT * FROM (VALUES {', '.join(f'({i}, {j})' for i, j in _OFFSETS)}) t(i, j)) SELECT a.q AS qa, a.r AS ra, b.q AS qb, b.r AS rb FROM c a JOIN o ON true JOIN c b ON b.q = a.q + o.i AND b.r = a.r + o.j")
def hex_proximity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of all places at most 120.1 m apart edge to edge: in a grid the distance depends on the offset alone, so this is an equi-join."""
    return _hex_pairs(_cells(spark, sf_dir))


@query(f"""WITH {CUSTOMERS}, {TERMINALS}, e AS (SELECT min(c.x) AS ax0, max(c.x) AS ax1, min(c.y) AS ay0, max(c.y) AS ay1 FROM c), g AS (SELECT min(x) AS bx0, max(x) AS bx1, min(y) AS by0, max(y) AS by1 FROM t)
  SELECT ax0 AS a_min_x, ax1 AS a_max_x, bx0 AS b_min_x, bx1 AS b_max_x, round(greatest(0, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0, least(ay1, by1) - greatest(ay0, by0)) / ((ax1 - ax0) * (ay1 - ay0)), 6) AS coverage FROM e, g""")
def bounds_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = P.bounds_overlap(_customers(spark, sf_dir), _terminals(spark, sf_dir))
    return o.select("a_min_x", "a_max_x", "b_min_x", "b_max_x", F.round("coverage", 6).alias("coverage"))


@query(f"""WITH {_RING}, ar AS (SELECT zone_id, ring, abs(sum((xa - 200000) * (yb - 500000) - (xb - 200000) * (ya - 500000))) / 2 AS a FROM ed GROUP BY ALL)
  SELECT zone_id, round(sum(CASE WHEN ring = 1 THEN a ELSE -a END) / 1000000, 4) AS km2 FROM ar JOIN zones USING (zone_id) WHERE starts_with(geometry, 'POLYGON') GROUP BY zone_id""")
def zone_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of simple polygons, holes left out; multipolygons are in zone_shapes."""
    z = table(spark, sf_dir, "zones").where(F.col("geometry").startswith("POLYGON"))
    return P.with_shape(z).select("zone_id", F.round(F.col("area_m2") / 1e6, 4).alias("km2"))


@query()
def zone_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, centroid and bounds of all zones."""
    return P.with_shape(table(spark, sf_dir, "zones")).select("zone_id", "area_m2", "cx", "cy", "x0", "y0", "x1", "y1")


@query()
def zone_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones that intersect one another."""
    z = table(spark, sf_dir, "zones")
    return P.shape_pairs(z, z, "zone_id").where("id_a < id_b")


@query("SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (geometry IS NULL OR trim(geometry) = '' OR lower(trim(geometry)) IN ('nan', 'point empty'))::BIGINT AS missing, 0::BIGINT AS open_rings FROM grouped_hubs")
def geometry_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry_counts(table(spark, sf_dir, "grouped_hubs"), "geometry")


@query(rf"""SELECT row_id, greatest(a, b) AS y, least(a, b) AS x FROM (SELECT row_id, TRY_CAST(regexp_extract(geometry, 'POINT\s*\(([\d.]+)\s+([\d.]+)\)', 1) AS DOUBLE) AS a, TRY_CAST(regexp_extract(geometry, 'POINT\s*\(([\d.]+)\s+([\d.]+)\)', 2) AS DOUBLE) AS b FROM transit_nodes WHERE geometry LIKE 'POINT%')
  WHERE a IS NOT NULL AND greatest(a, b) > {AXIS_SPLIT} AND least(a, b) < {AXIS_SPLIT}""")
def wkt_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of surveys that have only a geometry text, whatever its axis order."""
    t = table(spark, sf_dir, "transit_nodes").where("geometry like 'POINT%'").select("row_id", place(F.col("geometry")).alias("p"))
    return t.where("p is not null").select("row_id", "p.x", "p.y")


@query("SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey)::BIGINT AS number FROM supplier")
def global_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal")
    return number_in_order(s, F.desc("s_acctbal"), "id").select("id", "number")


@query("SELECT s_suppkey AS id FROM supplier ORDER BY md5('7/' || s_suppkey), s_suppkey LIMIT 50")
def seeded_random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator."""
    return seeded_sample(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), "id", 50, 7)
