"""The queries of the general data-preparation operators: drifting schemas, packed fields, nearby points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubloom.functions.geometry import cell_place, place
from hubloom.functions.packed import explode_packed, packed_items, whole_number
from hubloom.operators.drift import DEMAND_FIELDS, drift, ingest, replay
from hubloom.operators.near import pairs_within, regions_around, slabs
from hubloom.session import table, written

#: Planned modes that hold a blank.
BLANK_MODES = ("HighSpeed Rail", "Interurban Rail", "Suburban Rail", "Express Bus", "Cable Line")
NEAR = 200.0


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a demand file's columns against the file before it in its feed."""
    return drift(table(spark, sf_dir, "demand_records"), table(spark, sf_dir, "demand_files"))[1]


def p1_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All demand records with the same columns and types; old node numbers are replayed from the rescue column."""
    typed, _ = ingest(table(spark, sf_dir, "demand_records"), table(spark, sf_dir, "demand_files"))
    return replay(typed, {"OldNode": ("old_node", "bigint"), "Zone": ("zone", "bigint")}).drop("origin")


def p1_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed columns of `p1_table` with the number of keys that stayed in the rescue column: together every key of a record."""
    t = p1_table(spark, sf_dir)
    left = F.coalesce(F.size(F.map_keys(F.from_json("rescued", "map<string,variant>"))), F.lit(0)).cast("bigint")
    return t.select("record_id", "node", *(F.round(c, 4).alias(c) for c in ("boardings_daily", "alightings_daily", "totaltransfers")), "old_node", "zone", left.alias("n_rescued"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of the hubs' packed fields with its position."""
    hubs = table(spark, sf_dir, "grouped_hubs")
    nodes = F.filter(F.transform(packed_items(F.col("node"), "always"), whole_number), lambda n: n.isNotNull())
    return explode_packed(
        hubs,
        {
            "line_unique": packed_items(F.col("line_unique"), "codes"),
            "mode_planned": packed_items(F.col("mode_planned"), "always", BLANK_MODES),
            "node": nodes,
        },
        ["hub_row"],
    )


def hub_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, x, y: one place per hub. A point goes before a shape's centroid, that before a cell's centre; then the first export."""
    hubs = table(spark, sf_dir, "grouped_hubs")
    at = hubs.where("group_id is not null").select(
        "group_id", "hub_row", F.coalesce(place(F.col("geometry")), cell_place(F.col("h3_index"))).alias("at")
    )
    best = F.min_by("at", F.struct(F.col("at.rank"), F.col("hub_row")))
    return (
        at.where("at is not null").groupBy("group_id").agg(best.alias("at")).select("group_id", "at.x", "at.y")
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hubs at most 200 m apart, and the zones around hubs."""
    places, _ = written(hub_places(spark, sf_dir))
    cut = slabs(table(spark, sf_dir, "zones"), "zone_id", "geometry")
    near = pairs_within(places, NEAR, "group_id").select(
        F.lit("hub").alias("kind"), F.col("id_a").alias("group_id"), F.col("id_b").alias("other_id")
    )
    around = regions_around(places, cut, "group_id").select(
        F.lit("zone").alias("kind"), F.col("id").alias("group_id"), F.col("region").alias("other_id")
    )
    return near.unionByName(around)


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_table, p1_typed, p2_found, p4_found)}


_NAMES = " ".join(f"WHEN '{a}' THEN '{f.name}'" for f in DEMAND_FIELDS for a in f.aliases + f.parts)
_ORDER = " ".join(f"WHEN '{a}' THEN {k}" for f in DEMAND_FIELDS for k, a in enumerate(f.aliases))
#: Keys by spelling, else by values, else by spellings that values approved elsewhere.
_BOUND = r"""WITH f AS (SELECT file_id, feed_id, released, lag(file_id) OVER (PARTITION BY feed_id ORDER BY released, file_id) AS before FROM demand_files WHERE file_id IS NOT NULL AND feed_id IS NOT NULL AND released IS NOT NULL),
  r AS (SELECT f.feed_id, f.file_id, d.record_id, e.key, e.type, e.value FROM demand_records d JOIN f USING (file_id), json_each(CASE WHEN json_valid(d.body) THEN d.body END) e),
  n AS (SELECT feed_id, file_id, record_id, key, CASE regexp_replace(lower(key), '[\s_\-]+', '', 'g') @NAMES@ END AS role, regexp_replace(lower(key), '[\s_\-]+', '', 'g') IN ('transferboardings', 'transferalight') AS part,
    CASE WHEN type IN ('BIGINT', 'UBIGINT', 'HUGEINT') THEN 'whole' WHEN type = 'DOUBLE' THEN 'point' WHEN type = 'VARCHAR' THEN 'string' WHEN type = 'BOOLEAN' THEN 'boolean' WHEN type <> 'NULL' THEN 'nested' END AS kind,
    TRY_CAST(replace(trim(json_extract_string(value, '$')), ',', '') AS DOUBLE) AS v FROM r),
  own AS (SELECT DISTINCT feed_id, file_id, role FROM n WHERE role IS NOT NULL),
  lacks AS (SELECT a.file_id, b.role FROM (SELECT DISTINCT feed_id, file_id FROM n) a JOIN (SELECT DISTINCT feed_id, role FROM own) b USING (feed_id) WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.file_id = a.file_id AND o.role = b.role)),
  place AS (SELECT DISTINCT feed_id, v FROM n WHERE role = 'node' AND v IS NOT NULL),
  onode AS (SELECT n.file_id, n.key, avg((p.v IS NOT NULL)::INT) AS share FROM n JOIN lacks l ON l.file_id = n.file_id AND l.role = 'node' LEFT JOIN place p ON p.feed_id = n.feed_id AND p.v = n.v WHERE n.role IS NULL AND n.v IS NOT NULL GROUP BY ALL HAVING share >= 0.6),
  bnode AS (SELECT file_id, arg_max(key, share) AS key FROM onode GROUP BY 1),
  spot AS (SELECT n.feed_id, n.record_id, n.v AS node FROM n WHERE role = 'node' AND v IS NOT NULL UNION SELECT n.feed_id, n.record_id, n.v FROM n JOIN bnode USING (file_id, key) WHERE n.v IS NOT NULL),
  usual AS (SELECT feed_id, node, role, median(v) AS u FROM (SELECT feed_id, record_id, role, sum(v) AS v FROM n WHERE role <> 'node' AND v IS NOT NULL GROUP BY ALL) JOIN spot USING (feed_id, record_id) GROUP BY ALL),
  fit AS (SELECT n.file_id, n.key, usual.role, avg((abs(n.v - u) <= 0.15 * abs(u))::INT) AS share FROM n JOIN lacks l USING (file_id) JOIN spot USING (feed_id, record_id) JOIN usual ON usual.feed_id = n.feed_id AND usual.node = spot.node AND usual.role = l.role
    WHERE n.role IS NULL AND n.v IS NOT NULL GROUP BY ALL HAVING share >= 0.6),
  told AS (SELECT file_id, key, arg_max(role, share) AS role FROM fit GROUP BY ALL UNION ALL SELECT file_id, key, 'node' FROM bnode),
  agreed AS (SELECT regexp_replace(lower(key), '[\s_\-]+', '', 'g') AS plain, min(role) AS role FROM told JOIN f USING (file_id) GROUP BY 1 HAVING min(role) = max(role) AND count(DISTINCT feed_id) >= 2),
  found AS (SELECT * FROM told UNION ALL SELECT file_id, min(key), agreed.role FROM n JOIN agreed ON agreed.plain = regexp_replace(lower(key), '[\s_\-]+', '', 'g')
    WHERE n.role IS NULL AND NOT EXISTS (SELECT 1 FROM own WHERE own.feed_id = n.feed_id AND own.role = agreed.role) AND NOT EXISTS (SELECT 1 FROM told WHERE told.file_id = n.file_id AND told.key = n.key) GROUP BY file_id, agreed.role)""".replace("@NAMES@", _NAMES)
#: Each file against the one before it.
P1_SQL = _BOUND + r""",
  c AS (SELECT n.file_id, coalesce(n.role, o.role, lower(n.key)) AS field, n.key, n.part, n.kind FROM n LEFT JOIN found o USING (file_id, key)),
  k AS (SELECT file_id, field, kind, count(*) AS m FROM c WHERE kind IS NOT NULL GROUP BY ALL),
  most AS (SELECT file_id, field, arg_max(kind, m) AS kind FROM k GROUP BY ALL),
  pf AS (SELECT c.file_id, c.field, array_to_string(list_sort(list(DISTINCT key)), '|') AS keys, bool_or(part) AS part, any_value(most.kind) AS kind FROM c LEFT JOIN most USING (file_id, field) GROUP BY ALL),
  now AS (SELECT f.file_id, pf.field, keys, part, kind FROM f JOIN pf USING (file_id) WHERE before IS NOT NULL), old AS (SELECT f.file_id, pf.field, keys, part, kind FROM f JOIN pf ON pf.file_id = f.before),
  j AS (SELECT coalesce(now.file_id, old.file_id) AS file_id, coalesce(now.field, old.field) AS field, now.keys AS nk, old.keys AS ok, now.part AS np, old.part AS op, now.kind AS nt, old.kind AS ot FROM now FULL JOIN old ON now.file_id = old.file_id AND now.field = old.field)
  SELECT file_id, field, unnest(list_filter([CASE WHEN ok IS NULL THEN 'added' END, CASE WHEN nk IS NULL THEN 'removed' END, CASE WHEN np AND NOT op THEN 'split' END, CASE WHEN op AND NOT np THEN 'merged' END,
    CASE WHEN np = op AND nk <> ok THEN 'renamed' END, CASE WHEN np = op AND nt <> ot THEN 'retyped' END], lambda x: x IS NOT NULL)) AS change_kind FROM j"""
#: Record by record: the first spelling that can be cast, else the sum of both parts; what isn't used is counted.
P1_TYPED_SQL = _BOUND + r""",
  e AS (SELECT d.record_id, d.file_id, j.key, regexp_replace(lower(j.key), '[\s_\-]+', '', 'g') AS plain, json_extract_string(j.value, '$') AS s FROM demand_records d, json_each(CASE WHEN json_valid(d.body) AND json_type(d.body) = 'OBJECT' THEN d.body END) j),
  c AS (SELECT e.*, CASE plain @NAMES@ ELSE o.role END AS role, CASE plain @ORDER@ ELSE 99 END AS k, TRY_CAST(replace(trim(s), ',', '') AS DOUBLE) AS v FROM e LEFT JOIN found o USING (file_id, key)),
  w AS (SELECT *, CASE WHEN role = 'node' AND v <> floor(v) OR isnan(v) THEN NULL ELSE v END AS x, plain IN ('transferboardings', 'transferalight') AS part FROM c),
  pick AS (SELECT record_id, role, arg_min(x, k) AS x, 1 AS used FROM w WHERE role IS NOT NULL AND NOT part AND x IS NOT NULL GROUP BY ALL),
  added AS (SELECT record_id, role, sum(x) AS x, 2 AS used FROM w WHERE part GROUP BY ALL HAVING count(*) = 2 AND count(x) = 2),
  got AS (SELECT * FROM pick UNION ALL SELECT * FROM added ANTI JOIN pick USING (record_id, role)),
  wide AS (SELECT record_id, sum(used) AS used, max(x) FILTER (role = 'node') AS node, max(x) FILTER (role = 'boardings_daily') AS b, max(x) FILTER (role = 'alightings_daily') AS a, max(x) FILTER (role = 'totaltransfers') AS t FROM got GROUP BY 1),
  more AS (SELECT record_id, max(v) FILTER (key = 'OldNode' AND v = floor(v)) AS old_node, max(v) FILTER (key = 'Zone' AND v = floor(v)) AS zone, count(*) AS keys FROM w GROUP BY 1)
  SELECT d.record_id, wide.node::BIGINT AS node, round(b, 4) AS boardings_daily, round(a, 4) AS alightings_daily, round(t, 4) AS totaltransfers, old_node::BIGINT AS old_node, zone::BIGINT AS zone,
    (CASE WHEN keys IS NULL THEN (d.body IS NOT NULL AND NOT coalesce(json_valid(d.body) AND json_type(d.body) = 'OBJECT', false))::INT ELSE keys - coalesce(used, 0) - (old_node IS NOT NULL)::INT - (zone IS NOT NULL)::INT END)::BIGINT AS n_rescued
  FROM demand_records d LEFT JOIN wide USING (record_id) LEFT JOIN more USING (record_id)""".replace("@NAMES@", _NAMES).replace("@ORDER@", _ORDER)

#: The texts read from left to right by one pattern: a quoted span, or what lies between delimiters.
P2_SQL = r"""WITH t AS (SELECT hub_row, 'line_unique' AS field, line_unique AS s FROM grouped_hubs UNION ALL
    SELECT hub_row, 'mode_planned', replace(replace(replace(replace(replace(mode_planned, 'HighSpeed Rail', 'HighSpeed~Rail'), 'Interurban Rail', 'Interurban~Rail'), 'Suburban Rail', 'Suburban~Rail'), 'Express Bus', 'Express~Bus'), 'Cable Line', 'Cable~Line') FROM grouped_hubs),
  c AS (SELECT hub_row, field, regexp_replace(regexp_replace(s, '["'']\s*\[', '[', 'g'), '\]\s*["'']', ']', 'g') AS s FROM t),
  k AS (SELECT hub_row, field, regexp_extract_all(s, '''(?:[^''\\]|\\.)*''|"(?:[^"\\]|\\.|"")*"|(?:nan|None)\b|[^\s,;|/\[\]{}''"][^,;|/\[\]{}\t\r\n]*') AS raw FROM c),
  w AS (SELECT hub_row, field, list_transform(raw, lambda x: CASE
      WHEN x[1] = '"' THEN [regexp_replace(replace(x[2:-2], '""', '"'), '\\(.)', '\1', 'g')] WHEN x[1] = '''' THEN [regexp_replace(x[2:-2], '\\(.)', '\1', 'g')]
      WHEN field = 'mode_planned' OR len(list_filter(regexp_split_to_array(trim(x), '\s+'), lambda y: NOT (regexp_matches(y, '[0-9]') AND regexp_matches(y, '\p{L}')))) = 0 THEN regexp_split_to_array(trim(x), '\s+') ELSE [x] END) AS parts FROM k),
  i AS (SELECT hub_row, field, list_filter(list_transform(flatten(parts), lambda x: trim(replace(x, '~', ' '))), lambda x: lower(x) NOT IN ('', 'nan', 'none')) AS items FROM w
    UNION ALL SELECT hub_row, 'node', list_transform(regexp_extract_all(node, '(?:^|[^0-9A-Za-z_.])(\d+)', 1), lambda x: x::BIGINT::VARCHAR) FROM grouped_hubs)
  SELECT hub_row, field, generate_subscripts(items, 1)::BIGINT AS pos, unnest(items) AS item FROM i"""

#: Places (shapes of hubs have no holes here), pairs by brute force, and zones by the even-odd rule over all edges.
P4_SQL = r"""WITH h AS (SELECT group_id, hub_row, regexp_replace(upper(trim(geometry)), '^SRID=\d+;', '') AS g, h3_index FROM grouped_hubs WHERE group_id IS NOT NULL),
  n AS (SELECT group_id, hub_row, g, h3_index, list_transform(regexp_extract_all(g, '-?\d+(?:\.\d+)?(?:E[+-]?\d+)?'), lambda x: x::DOUBLE) AS v FROM h),
  ring AS (SELECT group_id, hub_row, generate_subscripts(rs, 1) AS k, list_transform(regexp_extract_all(unnest(rs), '-?\d+(?:\.\d+)?(?:E[+-]?\d+)?'), lambda x: x::DOUBLE) AS v
    FROM (SELECT *, regexp_extract_all(g, '\(([^()]+)\)', 1) AS rs FROM n WHERE regexp_matches(g, '^(MULTI)?POLYGON'))),
  edge AS (SELECT group_id, hub_row, k, v[1] AS ox, v[2] AS oy, v[i] - v[1] AS xa, v[i + 1] - v[2] AS ya, v[CASE WHEN i + 2 > len(v) THEN 1 ELSE i + 2 END] - v[1] AS xb, v[CASE WHEN i + 2 > len(v) THEN 2 ELSE i + 3 END] - v[2] AS yb
    FROM (SELECT *, unnest(range(1, len(v), 2)) AS i FROM ring)),
  part AS (SELECT group_id, hub_row, k, any_value(ox) AS ox, any_value(oy) AS oy, sum(xa * yb - xb * ya) / 2 AS a, sum((xa + xb) * (xa * yb - xb * ya)) / 6 AS mx, sum((ya + yb) * (xa * yb - xb * ya)) / 6 AS my FROM edge GROUP BY ALL),
  shape AS (SELECT group_id, hub_row, sum(abs(a) * (ox + mx / a)) / sum(abs(a)) AS x, sum(abs(a) * (oy + my / a)) / sum(abs(a)) AS y FROM part WHERE a <> 0 GROUP BY ALL),
  cand AS (SELECT group_id, hub_row, 0 AS rank, v[1] AS x, v[2] AS y FROM n WHERE starts_with(g, 'POINT') AND len(v) >= 2
    UNION ALL SELECT group_id, hub_row, 1, x, y FROM shape
    UNION ALL SELECT group_id, hub_row, 2, 66 * sqrt(3) * (q + r / 2.0), 99.0 * r FROM (SELECT group_id, hub_row, ('0x' || substr(c, 3, 5))::BIGINT - 524288 AS q, ('0x' || substr(c, 8, 5))::BIGINT - 524288 AS r FROM (SELECT *, regexp_extract(h3_index, '8a[0-9a-f]{10}fff') AS c FROM n) WHERE c <> '')),
  best AS (SELECT group_id, arg_min(x, rank * 1000000000000 + hub_row) AS a, arg_min(y, rank * 1000000000000 + hub_row) AS b FROM cand WHERE x IS NOT NULL GROUP BY 1),
  p AS (SELECT group_id, CASE WHEN a > 325000 AND b < 325000 THEN b ELSE a END AS x, CASE WHEN a > 325000 AND b < 325000 THEN a ELSE b END AS y FROM best),
  rg AS (SELECT zone_id, list_transform(string_split(unnest(regexp_extract_all(geometry, '\(([^()]+)\)', 1)), ','), lambda t: [split_part(trim(t), ' ', 1)::DOUBLE, split_part(trim(t), ' ', 2)::DOUBLE]) AS pts FROM zones),
  ed AS (SELECT zone_id, pts[i][1] AS xa, pts[i][2] AS ya, pts[i % len(pts) + 1][1] AS xb, pts[i % len(pts) + 1][2] AS yb FROM (SELECT *, unnest(range(1, len(pts) + 1)) AS i FROM rg))
  SELECT 'hub' AS kind, a.group_id, b.group_id AS other_id FROM p a JOIN p b ON a.group_id < b.group_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 40000
  UNION ALL SELECT 'zone', p.group_id, zone_id FROM p JOIN ed ON xa <> xb AND ((xa <= p.x AND p.x < xb) OR (xb <= p.x AND p.x < xa)) AND ya + (yb - ya) * (p.x - xa) / (xb - xa) <= p.y GROUP BY ALL HAVING count(*) % 2 = 1"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p1_typed": P1_TYPED_SQL, "p2_found": P2_SQL, "p4_found": P4_SQL}
