"""Queries on variants of rules, regional column configurations, dissolved cells and summaries of flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubloom.functions import hexgrid as X
from hubloom.functions import rules
from hubloom.functions import settings as S
from hubloom.functions.text import correct_area
from hubloom.operators import aggregate as A
from hubloom.operators import lookup as L
from hubloom.operators import spatial as P
from hubloom.plans.analog import HUB, hubs
from hubloom.plans.registry import Registry
from hubloom.plans.spatial import _cells, _HEX, _whole
from hubloom.session import table

query = Registry()
queries, oracle_sql = query.queries, query.oracle_sql

_DROPPED = ", ".join(f"'{x}'" for x in S.DROPPED_LINES)


@query(f"""SELECT t.row_id, t.line_id FROM transit_nodes t WHERE t.line_id IS NULL OR t.line_id NOT IN
  (SELECT line_model_name FROM lines_modes WHERE area = '{S.DROPPED_AREA}' AND line_model_name IN ({_DROPPED}))""")
def drop_listed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surveys but those of the listed lines of one area."""
    return A.without_listed_lines(table(spark, sf_dir, "transit_nodes"), table(spark, sf_dir, "lines_modes")).select("row_id", "line_id")


@query(f"{HUB} SELECT hub, " + ", ".join(f"round({p}{k}, 6)::DOUBLE AS {p}_{a}_{b}" for p in ("pop", "emp") for k, (a, b) in enumerate(((0, 500), (500, 1000), (1000, 1500)), 1)) + " FROM hub")
def ring_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ring totals under the names of their radii."""
    named = A.rename_rings(hubs(spark, sf_dir), ("pop", "emp"))
    return named.select("hub", *(F.round(c, 6).alias(c) for c in named.columns if c.startswith(("pop_", "emp_"))))


_FLAGS = {"Demand": "demand >= 1000", "Modes": "len(modes) >= 2", "Rail only": "len(list_filter(modes, lambda m: m <> 'Rail')) = 0"}


@query(f"{HUB}, f AS (SELECT " + ", ".join(f"{x} AS f{k}" for k, x in enumerate(_FLAGS.values())) + " FROM hub), c AS (SELECT count(*) AS n, count(*) FILTER (f0 AND f1) AS a, "
       + ", ".join(f"count(*) FILTER (f{k}) AS c{k}" for k in range(len(_FLAGS))) + " FROM f) SELECT criterion, k::BIGINT AS count, round(100.0 * k / n, 1)::DOUBLE AS percentage FROM (SELECT n, unnest(["
       + ", ".join(f"'{x}'" for x in ("Total", "All", *_FLAGS, "None of all")) + "]) AS criterion, unnest([n, a, " + ", ".join(f"c{k}" for k in range(len(_FLAGS))) + ", n - a]) AS k FROM c)")
def flag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows meet each criterion, and their share in per cent."""
    flags = {"Demand": F.col("demand") >= 1000, "Modes": F.size("modes") >= 2, "Rail only": F.forall("modes", lambda m: m == "Rail")}
    return A.flag_summary(hubs(spark, sf_dir), flags, together=("Demand", "Modes"))


_NAMED_ONLY = "list_filter(modes, lambda m: m <> 'Rail')"


@query(f"""{HUB} SELECT hub, CASE WHEN list_has_any(modes, ['HighSpeed Rail', 'Interurban Rail']) AND lines >= 3 AND demand >= 50000 THEN 'National'
  WHEN list_has_any(modes, ['HighSpeed Rail', 'Interurban Rail', 'Suburban Rail', 'Metro']) AND lines >= 3 THEN 'Regional' WHEN list_has_any(modes, ['BRT', 'LRT']) AND lines >= 3 AND demand >= 1000 THEN 'Local'
  WHEN list_has_any(modes, ['HighSpeed Rail', 'Interurban Rail', 'Suburban Rail']) AND lines <= 2 THEN 'Train Station' ELSE 'Not Hub' END AS tier FROM (SELECT * REPLACE (list_transform(modes, lambda m: CASE m WHEN 'Rail' THEN 'Interurban Rail' WHEN 'Express Bus' THEN 'Suburban Rail' ELSE m END) AS modes) FROM hub)""")
def former_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The former ladder under its English names, without generic rail. The stand-in's modes are renamed, so that its rail rungs are reached."""
    modes = F.transform("modes", lambda m: F.when(m == "Rail", "Interurban Rail").when(m == "Express Bus", "Suburban Rail").otherwise(m))
    return hubs(spark, sf_dir).select("hub", rules.former_tier(modes, F.col("lines"), F.col("demand")).alias("tier"))


_MID = (250.0, 750.0, 1250.0)


@query(f"{HUB} SELECT hub, round(" + " + ".join(f"(pop{k} * p + emp{k} * (1 - p)) / {m**1.5!r}::DOUBLE" for k, m in enumerate(_MID, 1)) + f", 6) AS raw FROM (SELECT *, CASE WHEN tier IN ('{S.NATIONAL}', '{S.METROPOLITAN}', 'National', 'Regional') THEN 0.2 ELSE 0.8 END::DOUBLE AS p FROM hub)")
def pop_jobs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People and jobs over their distance, by weights that don't add up to one; every tier but the two highest counts people most."""
    pop, emp = ([F.col(f"{n}{k}") for k in (1, 2, 3)] for n in ("pop", "emp"))
    return hubs(spark, sf_dir).select("hub", F.round(rules.pop_jobs_raw(pop, emp, F.col("tier")), 6).alias("raw"))


@query("""SELECT hub_row, coalesce(array_to_string(list_filter(list_transform(string_split(mode_planned, ','), lambda m: CASE replace(trim(m), ',', '') WHEN 'HighSpeed' THEN 'HighSpeed Rail' WHEN 'Interurban' THEN 'Interurban Rail' WHEN 'Suburban' THEN 'Suburban Rail' ELSE trim(m) END), lambda m: m <> 'Rail'), ','), '') AS modes FROM grouped_hubs""")
def corrected_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short rail names made long; generic rail is dropped."""
    return table(spark, sf_dir, "grouped_hubs").select("hub_row", F.array_join(rules.corrected_modes(F.split("mode_planned", ",")), ",").alias("modes"))


@query(r"""SELECT hub_row, CASE WHEN regexp_matches(t, 'חיפ|Haifa|צפון|North') THEN 'Haifa' WHEN regexp_matches(t, 'תל אבי|תל-אבי|Tel Aviv|TelAviv|מרכז|Center') THEN 'TelAviv' WHEN regexp_matches(t, 'ירושלי|Jerusalem') THEN 'Jerusalem'
  WHEN regexp_matches(t, 'דרום|South|באר שב|Beer Sheva|BeerSheva') THEN 'BeerSheva' WHEN regexp_matches(t, 'אשדוד|Ashdod') THEN 'Ashdod' WHEN regexp_matches(t, 'אשקלון|Ashkelon') THEN 'Ashkelon' ELSE 'Unknown' END AS model FROM (SELECT hub_row, concat_ws(' ', district, area) AS t FROM grouped_hubs)""")
def first_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidate model of a district and area, else Unknown."""
    return table(spark, sf_dir, "grouped_hubs").select("hub_row", rules.first_model(F.col("district"), F.col("area")).alias("model"))


@query("SELECT hub_row, CASE area WHEN 'תל' THEN 'תל אביב' WHEN 'באר' THEN 'באר שבע' ELSE area END AS area FROM (SELECT hub_row, split_part(area, ' ', 1) AS area FROM grouped_hubs)")
def corrected_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas cut to their first word completed."""
    return table(spark, sf_dir, "grouped_hubs").select("hub_row", correct_area(F.get(F.split("area", " "), 0)).alias("area"))


def _number(key: str) -> str:
    return f"TRY_CAST(replace(trim(b ->> '{key}'), ',', '') AS DOUBLE)"


_REGION = " ".join(
    f"WHEN '{m}' THEN {{'node': {_number(c.node)}, 'boardings': {_number(c.boardings)}, 'alightings': {_number(c.alightings)}, 'transfers': {' + '.join(f'coalesce({_number(t)}, 0)' for t in c.transfers) or '0.0::DOUBLE'}}}"
    for m, c in S.REGION_COLUMNS.items()
)
_OTHER = S.REGION_DEFAULT


@query(f"""WITH r AS (SELECT record_id, model, CASE WHEN json_valid(body) THEN body::JSON END AS b FROM demand_records JOIN demand_files USING (file_id)),
  c AS (SELECT record_id, model, CASE model {_REGION} ELSE {{'node': {_number(_OTHER.node)}, 'boardings': {_number(_OTHER.boardings)}, 'alightings': {_number(_OTHER.alightings)}, 'transfers': {' + '.join(f'coalesce({_number(t)}, 0)' for t in _OTHER.transfers)}}} END AS v FROM r)
  SELECT record_id, model, CASE WHEN v.node = floor(v.node) THEN v.node END::BIGINT AS node, v.boardings AS boardings, v.alightings AS alightings, v.transfers AS transfers FROM c""")
def regional_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand records by their model's configuration of columns."""
    records = table(spark, sf_dir, "demand_records").join(table(spark, sf_dir, "demand_files").select("file_id", "model"), "file_id")
    return L.by_region(records, "body", "model", S.REGION_COLUMNS, S.REGION_DEFAULT).select("record_id", "model", "node", "boardings", "alightings", "transfers")


_BLOCKS = "b AS (SELECT DISTINCT q, r, floor(q / 8)::BIGINT || ':' || floor(r / 8)::BIGINT AS block FROM hx)"


@query(f"""WITH {_whole(_HEX)}, {_BLOCKS}, o AS (SELECT * FROM (VALUES (1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)) t(i, j)),
  n AS (SELECT a.block, count(*) AS shared FROM b a JOIN o ON true JOIN b c ON c.q = a.q + o.i AND c.r = a.r + o.j AND c.block = a.block GROUP BY 1)
  SELECT block, count(*)::BIGINT AS cells, (6 * count(*) - coalesce(any_value(n.shared), 0))::BIGINT AS edges, round((6 * count(*) - coalesce(any_value(n.shared), 0)) * {X.EDGE}, 3)::DOUBLE AS perimeter,
    round(count(*) * 1.5 * sqrt(3) * {X.EDGE} * {X.EDGE}, 2) AS area FROM b LEFT JOIN n USING (block) GROUP BY block""")
def dissolved_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of the cells of each group, blocks of the grid here, by its outline: edges that two of its cells share are none."""
    c = _cells(spark, sf_dir).select("q", "r").distinct()
    block = X.cell_id(F.floor(F.col("q") / 8), F.floor(F.col("r") / 8))
    d = P.dissolve(c.select("q", "r", block.alias("block")), "block")
    return d.select("block", "cells", "edges", F.round("perimeter", 3).alias("perimeter"), F.round("area", 2).alias("area"))


_MERGED = ", ".join(f"({a}, {b})" for a, b in S.MERGED_GROUPS.items())


@query(f"SELECT hub_row, coalesce(m.b, group_id)::BIGINT AS group_id FROM grouped_hubs LEFT JOIN (VALUES {_MERGED}) m(a, b) ON m.a = group_id")
def renumbered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single groups merged by hand."""
    return A.renumbered(table(spark, sf_dir, "grouped_hubs"), "group_id", S.MERGED_GROUPS).select("hub_row", "group_id")
