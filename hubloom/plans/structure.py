"""Queries on structure: joins, aggregations, pivots, demand lookup, set operations, text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hubloom.functions import rules, text
from hubloom.functions import settings as S
from hubloom.operators import aggregate as A
from hubloom.operators import lookup as L
from hubloom.plans.analog import AREAS, HUB, MODES, NODE_LINES, hubs, node_lines, tier_sql, values
from hubloom.plans.registry import Registry
from hubloom.session import table

query = Registry()
queries, oracle_sql = query.queries, query.oracle_sql
MASS = "[" + ", ".join(f"'{m}'" for m in S.MASS_TRANSIT) + "]"


@query("""SELECT t.row_id, t.node, t.line_id, m.mode_planned, m.area FROM transit_nodes t
  LEFT JOIN lines_modes m ON t.line_id = m.line_model_name""")
def scan_nodes_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey rows with the modes of their lines; a line listed twice fans out."""
    lines = table(spark, sf_dir, "lines_modes")
    t = table(spark, sf_dir, "transit_nodes")
    return t.join(lines, t.line_id == lines.line_model_name, "left").select("row_id", "node", "line_id", "mode_planned", "area")


@query(f"""{HUB} SELECT hub, lines, round(demand, 4) AS demand FROM hub
  WHERE demand >= 1000 AND len(list_filter(modes, lambda m: list_contains({MASS}, m))) >= 2
  AND NOT (len(list_filter(modes, lambda m: list_contains({MASS}, m))) > 0 AND len(list_filter(modes, lambda m: list_contains({MASS}, m) AND m <> 'Rail')) = 0)""")
def threshold_and_set_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows over a threshold whose lists meet conditions on sets of members."""
    return A.filter_by_threshold_and_sets(hubs(spark, sf_dir), "demand", "modes").select("hub", "lines", F.round("demand", 4).alias("demand"))


@query(f"""{HUB} SELECT hub, len(modes)::BIGINT AS n_modes, len(list_filter(modes, lambda m: list_contains({MASS}, m)))::BIGINT AS n_members,
  list_has_any(modes, ['Metro', 'LRT', 'BRT', 'HighSpeed Rail']) AS has_other,
  (len(list_filter(modes, lambda m: list_contains({MASS}, m))) > 0 AND len(list_filter(modes, lambda m: list_contains({MASS}, m) AND m NOT IN ('Rail', 'Suburban Rail', 'Interurban Rail'))) = 0) AS only_rail FROM hub""")
def set_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same conditions as columns, without filtering."""
    m = F.col("modes")
    return hubs(spark, sf_dir).select(
        "hub", F.size(m).cast("bigint").alias("n_modes"), rules.count_members(m).cast("bigint").alias("n_members"),
        rules.any_member(m, S.NON_RAIL).alias("has_other"), rules.only_members(m, S.MASS_TRANSIT, S.RAIL_ONLY).alias("only_rail"),
    )


@query(f"{HUB} SELECT hub, len(modes)::BIGINT AS n_modes FROM hub WHERE len(modes) >= 2")
def single_mode_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hubs(spark, sf_dir).where(F.size("modes") >= 2).select("hub", F.size("modes").cast("bigint").alias("n_modes"))


@query(f"{HUB} SELECT hub, array_to_string(modes, ',') AS modes FROM hub WHERE NOT (len(modes) > 0 AND len(list_filter(modes, lambda m: m NOT IN ('Rail', 'Suburban Rail', 'Interurban Rail'))) = 0)")
def rail_only_filter_all_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists whose members all lie in a set are left out; empty lists stay."""
    only = (F.size("modes") > 0) & F.forall("modes", lambda m: m.isin(*S.RAIL_ONLY))
    return hubs(spark, sf_dir).where(~only).select("hub", F.array_join("modes", ",").alias("modes"))


@query("""SELECT line_model_name, mode_planned, area FROM lines_modes l WHERE NOT EXISTS (
  SELECT 1 FROM lines_modes o WHERE o.area = 'Haifa' AND starts_with(lower(o.line_model_name), 'm') AND o.line_model_name = l.line_model_name)""")
def antijoin_old_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lines_modes")
    old = lines.where((F.col("area") == "Haifa") & F.lower("line_model_name").startswith("m")).select("line_model_name")
    return lines.join(old, "line_model_name", "left_anti").select("line_model_name", "mode_planned", "area")


@query(f"WITH {NODE_LINES} SELECT hub, node, mode, count(DISTINCT line)::BIGINT AS line_nunique FROM nl GROUP BY ALL")
def cell_node_mode_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.level_one(node_lines(spark, sf_dir), "hub", "node", "mode", "line").select("hub", "node", "mode", "line_nunique")


@query(f"""WITH {NODE_LINES}, one AS (SELECT hub, node, mode, count(DISTINCT line) AS n FROM nl GROUP BY ALL)
  SELECT hub, (SELECT count(DISTINCT node) FROM nl WHERE nl.hub = one.hub)::BIGINT AS n_nodes, array_to_string(list_sort(list(DISTINCT mode)), ',') AS modes,
  sum(n)::BIGINT AS line_nunique, (SELECT array_to_string(list_sort(list(DISTINCT line)), ',') FROM nl WHERE nl.hub = one.hub) AS lines FROM one GROUP BY hub""")
def cell_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels: lines shared by nodes or modes count again in line_nunique, as in the source data."""
    one = A.level_one(node_lines(spark, sf_dir), "hub", "node", "mode", "line")
    return A.level_two(one, "hub", "node", "mode").select(
        "hub", F.size("nodes").cast("bigint").alias("n_nodes"), F.array_join("modes", ",").alias("modes"), "line_nunique", F.array_join("lines", ",").alias("lines")
    )


@query("""SELECT group_id, round(coalesce(sum(CASE WHEN NOT isnan(totaldemand) THEN totaldemand END), 0), 4) AS totaldemand, round(coalesce(sum(CASE WHEN NOT isnan(totaltransfers) THEN totaltransfers END), 0), 4) AS totaltransfers,
  coalesce(arg_min(nullif(area, 'Unknown'), hub_row) FILTER (area IS NOT NULL AND area <> 'Unknown'), 'Unknown') AS area, coalesce(arg_min(district, hub_row) FILTER (district IS NOT NULL AND district <> 'Unknown'), 'Unknown') AS district,
  arg_min(address, hub_row) FILTER (address IS NOT NULL AND address <> 'Unknown') AS address, count(*)::BIGINT AS n_rows
  FROM grouped_hubs WHERE group_id IS NOT NULL GROUP BY group_id""")
def group_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to groups: sums without NaN, first known value by row number."""
    out = A.merge_groups(table(spark, sf_dir, "grouped_hubs"), "group_id", "hub_row", sums=("totaldemand", "totaltransfers"), firsts=("area", "district", "address"))
    return out.select(
        "group_id", F.round("totaldemand", 4).alias("totaldemand"), F.round("totaltransfers", 4).alias("totaltransfers"),
        F.coalesce("area", F.lit("Unknown")).alias("area"), F.coalesce("district", F.lit("Unknown")).alias("district"), "address", "n_rows",
    )


@query(f"""WITH {NODE_LINES}, f AS (SELECT hub, node, min(price) AS price FROM nl GROUP BY ALL) SELECT hub, round(sum(price), 2) AS demand FROM f GROUP BY hub""")
def first_dedup_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value per (group, node), then sums per group."""
    return A.dedup_then_sum(node_lines(spark, sf_dir), "hub", "node", "price").select("hub", F.round("price", 2).alias("demand"))


_PIVOT = ", ".join(f"""count(DISTINCT line) FILTER (mode = '{m}')::BIGINT AS "{m} Lines" """ for m in MODES.values())


@query(f"WITH {NODE_LINES} SELECT hub, {_PIVOT} FROM nl GROUP BY hub")
def mode_lines_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of lines for each mode; the modes are given, so the schema is fixed."""
    lines = node_lines(spark, sf_dir).groupBy("hub", "mode").agg(F.count_distinct("line").alias("n"))
    wide = A.pivot_sum(lines, "hub", "mode", "n", list(MODES.values()))
    return wide.select("hub", *(F.col(m).cast("bigint").alias(f"{m} Lines") for m in MODES.values()))


_EVEN_LIST = "list_filter(list_transform(modes, lambda m: CASE WHEN m = 'Rail' THEN 'Interurban Rail' ELSE m END), lambda m: m IN (" + ", ".join(f"'{m}'" for m in S.MODE_COLUMNS) + "))"
_EVEN = {m: f"CASE WHEN list_contains({_EVEN_LIST}, '{m}') THEN lines::DOUBLE / len({_EVEN_LIST}) ELSE 0::DOUBLE END" for m in S.MODE_COLUMNS}


@query(f"{HUB} SELECT hub, " + ", ".join(f'round({e}, 4) AS "{m} Lines"' for m, e in _EVEN.items()) + " FROM hub")
def mode_lines_even_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = rules.mode_lines(F.col("modes"), F.col("lines"))
    return hubs(spark, sf_dir).select("hub", *(F.round(c, 4).alias(f"{m} Lines") for m, c in cols.items()))


_N_POS = " + ".join(f"(({e}) > 0)::BIGINT" for e in _EVEN.values())
_LINEAR = " + ".join(f"({e}) * {S.MODE_WEIGHTS[m]}" for m, e in _EVEN.items())


@query(f"{HUB} SELECT hub, ({_N_POS})::BIGINT AS num_modes, round(({_LINEAR}) * (1 + 0.1 * greatest(({_N_POS}) - 1, 0)), 4)::DOUBLE AS mode_score FROM hub")
def mode_score_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = rules.mode_lines(F.col("modes"), F.col("lines"))
    return hubs(spark, sf_dir).select("hub", rules.positive_count(cols.values()).cast("bigint").alias("num_modes"), F.round(rules.mode_score(cols), 4).alias("mode_score"))


# demand -----------------------------------------------------------------------------------------------

_DEMAND = "d AS (SELECT event_type AS model, user_id AS node, sum(value) AS demand, sum(CASE WHEN event_id % 2 = 0 THEN value ELSE 0 END) AS transfers FROM events WHERE user_id IS NOT NULL GROUP BY ALL)"
CANDIDATES = {"Tel Aviv": ("click", "view"), "Haifa": ("view", "error"), "Jerusalem": ("error",), "South": ("click", "error", "view")}
OVERLAY = ("purchase", "signup")


def _demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    half = F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(0.0)
    rows = e.select(F.col("event_type").alias("model"), F.col("user_id").alias("node"), F.col("value").alias("demand"), half.alias("transfers"))
    return L.demand_by_node(rows)


@query(f"WITH {_DEMAND} SELECT model, node, round(demand, 4) AS demand, round(transfers, 4) AS transfers FROM d")
def demand_by_model_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _demand(spark, sf_dir).select("model", "node", F.round("demand", 4).alias("demand"), F.round("transfers", 4).alias("transfers"))


@query("""WITH j AS (SELECT record_id, body FROM demand_records)
  SELECT record_id, TRY_CAST(coalesce(body->>'$.Node', body->>'$.NODE_ID', body->>'$.NodeID', body->>'$.ModelNode', body->>'$.ID') AS DOUBLE)::BIGINT AS node,
  TRY_CAST(replace(coalesce(body->>'$.Boardings', body->>'$.TotalBoardings', body->>'$.On', body->>'$.InitialBoardings', body->>'$.DailyBoard_2050', body->>'$.Boardings_Daily'), ',', '') AS DOUBLE) AS boardings,
  coalesce(TRY_CAST(replace(body->>'$.TransferBoardings', ',', '') AS DOUBLE), 0) + coalesce(TRY_CAST(replace(body->>'$.TransferAlight', ',', '') AS DOUBLE), 0) AS transfers FROM j""")
def demand_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns found by ordered candidate names, transfers as the sum of their parts."""
    return L.standardise(
        table(spark, sf_dir, "demand_records"), "body", ("Node", "NODE_ID", "NodeID", "ModelNode", "ID"),
        ("Boardings", "TotalBoardings", "On", "InitialBoardings", "DailyBoard_2050", "Boardings_Daily"), ("TransferBoardings", "TransferAlight"),
    ).select("record_id", "node", "boardings", "transfers")


@query("""SELECT model, count(*)::BIGINT AS n_rows, round(sum(v), 2) AS total FROM (
  SELECT 'purchase' AS model, value AS v FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'signup', value FROM events WHERE event_type = 'signup'
  UNION ALL SELECT 'view', NULL FROM events WHERE event_type = 'view') GROUP BY model""")
def demand_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets with different columns as one table."""
    e = table(spark, sf_dir, "events")
    sheets = [e.where(F.col("event_type") == m).select(F.lit(m).alias("model"), F.col("value").alias("v")) for m in OVERLAY]
    sheets.append(e.where("event_type = 'view'").select(F.lit("view").alias("model")))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sheets)
    return whole.groupBy("model").agg(F.count("*").alias("n_rows"), F.round(F.sum("v"), 2).alias("total"))


_CAND = ", ".join(f"('{a}', {i}, '{m}')" for a, ms in CANDIDATES.items() for i, m in enumerate(ms))
_HUB_NODES = f"hn AS (SELECT DISTINCT hub, node FROM nl), ha AS (SELECT hub, area FROM hub)"


@query(f"""{HUB}, {_DEMAND}, {_HUB_NODES},
  cand AS (SELECT hn.hub, hn.node, o.v AS model, o.k AS prio FROM hn CROSS JOIN (VALUES (0, 'purchase'), (1, 'signup')) o(k, v)
    UNION ALL SELECT hn.hub, hn.node, c.m, 10 + c.i FROM hn JOIN ha USING (hub) JOIN (VALUES {_CAND}) c(a, i, m) ON c.a = ha.area),
  hit AS (SELECT c.hub, c.node, arg_min(d.demand, prio) AS demand, arg_min(d.transfers, prio) AS transfers FROM cand c JOIN d ON d.model = c.model AND d.node = c.node GROUP BY ALL)
  SELECT hub.hub, round(coalesce(sum(hit.demand), 0), 4) AS demand, round(coalesce(sum(hit.transfers), 0), 4) AS transfers FROM hub LEFT JOIN hit ON hit.hub = hub.hub GROUP BY hub.hub""")
def demand_priority_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's demand from the first model that has it: overlays, then its area's candidates in order."""
    h = hubs(spark, sf_dir).select("hub", "area")
    nodes = node_lines(spark, sf_dir).select("hub", "node").distinct()
    found = L.prioritised_lookup(nodes.join(h, "hub"), _demand(spark, sf_dir), "hub", "node", rules.lookup({a: ",".join(m) for a, m in CANDIDATES.items()}, F.col("area"), ""), OVERLAY)
    return h.join(found, "hub", "left").select("hub", F.round(F.coalesce("demand", F.lit(0.0)), 4).alias("demand"), F.round(F.coalesce("transfers", F.lit(0.0)), 4).alias("transfers"))


@query(f"""{HUB}, {_DEMAND}, {_HUB_NODES}, g AS (SELECT node, sum(demand) AS demand FROM d WHERE model NOT IN ('purchase', 'signup') GROUP BY node),
  o AS (SELECT node, sum(demand) AS demand FROM d WHERE model IN ('purchase', 'signup') GROUP BY node),
  f AS (SELECT a.k AS area, a.v AS model FROM (VALUES {", ".join(f"('{a}', '{m[0]}')" for a, m in CANDIDATES.items())}) a(k, v))
  SELECT hn.hub, round(sum(coalesce(r.demand, g.demand, 0) + coalesce(o.demand, 0)), 4) AS demand FROM hn JOIN ha USING (hub) LEFT JOIN f ON f.area = ha.area
  LEFT JOIN d r ON r.model = f.model AND r.node = hn.node LEFT JOIN g ON g.node = hn.node LEFT JOIN o ON o.node = hn.node GROUP BY hn.hub""")
def demand_additive_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The additive variant: the area's model, else the sum of all, plus the overlays."""
    h = hubs(spark, sf_dir).select("hub", "area")
    nodes = node_lines(spark, sf_dir).select("hub", "node").distinct().join(h, "hub")
    return L.additive_lookup(nodes, _demand(spark, sf_dir), "hub", "node", rules.lookup({a: m[0] for a, m in CANDIDATES.items()}, F.col("area")), OVERLAY).select("hub", F.round("demand", 4).alias("demand"))


@query(f"""WITH {NODE_LINES}, ov AS (SELECT user_id AS node, event_id AS row_no, value AS v FROM events),
  m AS (SELECT nl.hub, arg_max(ov.v, ov.row_no) AS v FROM (SELECT DISTINCT hub, node FROM nl) nl JOIN ov ON ov.node = nl.node GROUP BY nl.hub)
  SELECT h.hub, coalesce(m.v, 0) AS demand FROM (SELECT DISTINCT hub FROM nl) h LEFT JOIN m ON m.hub = h.hub""")
def manual_override_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hub takes the value of the last override that names one of its nodes."""
    nodes = node_lines(spark, sf_dir).select("hub", "node").distinct()
    over = table(spark, sf_dir, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("row_no"), F.col("value").alias("v"))
    return L.override_last_wins(nodes, over, "hub", "node", "row_no", "v").select("hub", F.coalesce("v", F.lit(0.0)).alias("demand"))


@query("""SELECT hub_row, array_to_string(list_distinct(list_filter([
  CASE WHEN regexp_matches(t, 'חיפ|Haifa|צפון|North') THEN 'Haifa' END, CASE WHEN regexp_matches(t, 'תל אבי|תל-אבי|Tel Aviv|TelAviv|מרכז|Center') THEN 'TelAviv' END,
  CASE WHEN regexp_matches(t, 'ירושלי|Jerusalem') THEN 'Jerusalem' END, CASE WHEN regexp_matches(t, 'דרום|South|באר שב|Beer Sheva|BeerSheva') THEN 'BeerSheva' END,
  CASE WHEN regexp_matches(t, 'דרום|South|אשדוד|Ashdod') THEN 'Ashdod' END, CASE WHEN regexp_matches(t, 'דרום|South|אשקלון|Ashkelon') THEN 'Ashkelon' END], lambda x: x IS NOT NULL)).list_sort(), ',') AS models
  FROM (SELECT hub_row, concat_ws(' ', district, area) AS t FROM grouped_hubs)""")
def candidate_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "grouped_hubs").select("hub_row", F.array_join(F.sort_array(rules.candidate_models(F.col("district"), F.col("area"))), ",").alias("models"))


# line tables ------------------------------------------------------------------------------------------

_STATUS = ", ".join(f"count(*) FILTER (status = {i})::BIGINT AS status_{i}" for i in range(8))


@query(f"""WITH {NODE_LINES}, gl AS (SELECT DISTINCT hub, line FROM nl), s AS (SELECT gl.hub, p.p_size % 8 AS status FROM gl LEFT JOIN part p ON p.p_partkey = gl.line)
  SELECT hub, {_STATUS}, count(*)::BIGINT AS total FROM s GROUP BY hub""")
def line_status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = node_lines(spark, sf_dir).select("hub", "line").distinct()
    status = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line"), (F.col("p_size") % 8).alias("status"))
    joined = lines.join(status, "line", "left").groupBy("hub", "status").agg(F.count("*").alias("n"))
    wide = A.pivot_sum(joined, "hub", "status", "n", list(range(8)), total="total")
    return wide.select("hub", *(F.col(str(i)).cast("bigint").alias(f"status_{i}") for i in range(8)), F.col("total").cast("bigint").alias("total"))


@query("""WITH n AS (SELECT p_partkey, p_name FROM part), st AS (SELECT replace(p_name, 'ring', 'loop') AS name, min(p_size) AS status FROM part GROUP BY 1),
  corr AS (SELECT DISTINCT p_name AS name, replace(p_name, 'ring', 'loop') AS correct FROM part WHERE contains(p_name, 'ring'))
  SELECT n.p_partkey, coalesce(c.correct, n.p_name) AS name, st.status::BIGINT AS status FROM n LEFT JOIN corr c ON c.name = n.p_name LEFT JOIN st ON st.name = coalesce(c.correct, n.p_name)""")
def line_name_correction_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names corrected by a table, then joined again."""
    p = table(spark, sf_dir, "part")
    fixed = F.replace(F.col("p_name"), F.lit("ring"), F.lit("loop"))
    status = p.groupBy(fixed.alias("name")).agg(F.min("p_size").cast("bigint").alias("status"))
    corrections = p.where(F.contains(F.col("p_name"), F.lit("ring"))).select(F.col("p_name").alias("name"), fixed.alias("correct")).distinct()
    return L.corrected_join(p.select("p_partkey", F.col("p_name").alias("name")), corrections, status, "name").select("p_partkey", "name", "status")


@query("""SELECT line_model_name, coalesce(n.label, '[Unknown] ' || line_model_name) AS label FROM (SELECT DISTINCT line_model_name FROM lines_modes) l
  LEFT JOIN (SELECT line_model_name AS name, min(mode_planned) AS label FROM lines_modes WHERE mode_planned IS NOT NULL AND area = 'Haifa' GROUP BY 1) n ON n.name = l.line_model_name""")
def hebrew_names_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Localised names, the first of each; a line without one is marked unknown."""
    lines = table(spark, sf_dir, "lines_modes")
    names = lines.where("mode_planned is not null and area = 'Haifa'").groupBy(F.col("line_model_name").alias("name")).agg(F.min("mode_planned").alias("label"))
    out = lines.select("line_model_name").distinct().join(names, F.col("line_model_name") == F.col("name"), "left")
    return out.select("line_model_name", F.coalesce("label", F.concat(F.lit("[Unknown] "), F.col("line_model_name"))).alias("label"))


@query(r"""SELECT hub_row, array_to_string(list_distinct_ordered, '|') AS lines, len(list_distinct_ordered)::BIGINT AS n FROM (SELECT hub_row,
  list_filter(all_items, lambda x, i: list_position(all_items, x) = i) AS list_distinct_ordered FROM (SELECT hub_row, list_filter(regexp_split_to_array(regexp_replace(coalesce(line_unique, ''), '[\[\]''"\r]', '', 'g'), '[,\s]+'), lambda x: x <> '') AS all_items FROM grouped_hubs))""")
def parse_line_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = text.parse_lines(F.col("line_unique"))
    return table(spark, sf_dir, "grouped_hubs").select("hub_row", F.array_join(items, "|").alias("lines"), F.size(items).cast("bigint").alias("n"))


@query(r"""SELECT line_model_name, mode_planned, trim(regexp_replace(regexp_replace(line_model_name, '\\r|\\n|\r|\n', '', 'g'), '[\t ]+', ' ', 'g'), ' ') AS clean FROM lines_modes""")
def clean_line_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lines_modes").select("line_model_name", "mode_planned", text.clean_line_name(F.col("line_model_name")).alias("clean"))


@query(r"""SELECT doc_id, round(length(regexp_replace(text, '[^\x{0590}-\x{05FF}]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(text, '[\t\n\x0B\f\r ]', '', 'g')), 0), 4) AS ratio,
  length(regexp_replace(text, '[\t\n\x0B\f\r ]', '', 'g')) = 0 OR coalesce(length(regexp_replace(text, '[^\x{0590}-\x{05FF}]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(text, '[\t\n\x0B\f\r ]', '', 'g')), 0) >= 0.3, false) AS valid FROM documents WHERE text IS NOT NULL""")
def hebrew_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of whole texts."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.round(text.hebrew_ratio(t), 4).alias("ratio"), text.is_valid_hebrew(t).alias("valid"))


def _completed_sql(c: str) -> str:
    """Word by word, twice, as a match takes the sign after it along."""
    words = c
    for cut, full in S.TRUNCATED.items():
        for _ in range(2):
            words = rf"regexp_replace({words}, '(^|[^\p{{L}}\p{{M}}\p{{N}}_]){cut}([^\p{{L}}\p{{M}}\p{{N}}_]|$)', '\1{full}\2', 'g')"
    return f"CASE {c} " + " ".join(f"WHEN '{cut}' THEN '{full}'" for cut, full in S.TRUNCATED.items()) + f" ELSE {words} END"


@query(f"SELECT hub_row, {_completed_sql('metro_position')} AS fixed FROM grouped_hubs")
def fix_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row, lists and other texts word by word."""
    return table(spark, sf_dir, "grouped_hubs").select("hub_row", text.fix_truncated(F.col("metro_position")).alias("fixed"))


@query("""SELECT hub_row, round(CASE WHEN NOT isnan(totaldemand) AND totaldemand > 0 THEN coalesce(CASE WHEN isnan(totaltransfers) THEN 0 ELSE totaltransfers END, 0) / totaldemand ELSE 0 END, 4)::DOUBLE AS transfer_rate,
  CASE WHEN metro_position LIKE '%גלעין%' OR metro_position LIKE '%Core%' THEN 3 WHEN metro_position LIKE '%טבעת%' OR metro_position LIKE '%Ring%' THEN 2 ELSE 1 END::BIGINT AS location_category,
  CASE WHEN area LIKE '%Tel Aviv%' OR area LIKE '%Center%' OR area LIKE '%תל אביב%' OR area LIKE '%תל-אביב%' OR area LIKE '%מרכז%' THEN 0 ELSE 1 END::BIGINT AS region_category,
  TRY_CAST(nullif(regexp_extract(geometry, 'POINT\\s*\\(([\\d.-]+)\\s+([\\d.-]+)\\)', 1), '') AS DOUBLE) AS x, TRY_CAST(nullif(regexp_extract(geometry, 'POINT\\s*\\(([\\d.-]+)\\s+([\\d.-]+)\\)', 2), '') AS DOUBLE) AS y FROM grouped_hubs""".replace("\\\\", "\\"))
def results_derived_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "grouped_hubs")
    d, t = rules.no_nan(F.col("totaldemand")), F.coalesce(rules.no_nan(F.col("totaltransfers")), F.lit(0.0))
    x, y = text.wkt_point(F.col("geometry"))
    return h.select(
        "hub_row", F.round(F.when(d > 0, t / d).otherwise(0.0), 4).alias("transfer_rate"), F.coalesce(rules.location_category(F.col("metro_position")), F.lit(1)).cast("bigint").alias("location_category"),
        F.coalesce(rules.region_category(F.col("area")), F.lit(1)).cast("bigint").alias("region_category"), x.alias("x"), y.alias("y"),
    )


@query("""SELECT hub_row, coalesce(nullif(district, 'Unknown'), nullif(trim(string_split(address, ',')[1]), ''), 'Hub ' || group_id) AS hub_name FROM grouped_hubs""")
def hub_name_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "grouped_hubs").select("hub_row", text.hub_name(F.nullif(F.col("district"), F.lit("Unknown")), F.col("address"), F.col("group_id")).alias("hub_name"))


@query("""SELECT expert, criterion_a, criterion_b, value FROM ahp_expert_comparisons e WHERE expert IS NOT NULL AND (judged_at >= TIMESTAMP '2025-06-01'
  OR NOT EXISTS (SELECT 1 FROM ahp_expert_comparisons n WHERE n.judged_at >= TIMESTAMP '2025-06-01' AND n.expert = e.expert))""")
def upsert_experts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experts' earlier judgements are replaced by their later ones: those from June on stand for the update."""
    c = table(spark, sf_dir, "ahp_expert_comparisons").where("expert is not null")
    later = F.coalesce(F.col("judged_at") >= "2025-06-01", F.lit(False))
    return A.upsert(c.where(~later), c.where(later), "expert").select("expert", "criterion_a", "criterion_b", "value")


@query("""SELECT 'totaldemand' AS field, count(*)::BIGINT AS n_rows, count(*) FILTER (totaldemand IS NULL OR isnan(totaldemand))::BIGINT AS missing, round(min(CASE WHEN NOT isnan(totaldemand) THEN totaldemand END), 4) AS least, round(max(CASE WHEN NOT isnan(totaldemand) THEN totaldemand END), 4) AS most,
  round(avg((totaldemand IS NULL OR isnan(totaldemand))::INT), 6) > 0.1 AS incomplete FROM grouped_hubs
  UNION ALL SELECT 'line_nunique', count(*), count(*) FILTER (line_nunique IS NULL), min(line_nunique)::DOUBLE, max(line_nunique)::DOUBLE, round(avg((line_nunique IS NULL)::INT), 6) > 0.1 FROM grouped_hubs""")
def dq_range_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hubloom.operators.validate import ranges

    return ranges(table(spark, sf_dir, "grouped_hubs"), ("totaldemand", "line_nunique")).select(
        "field", "n_rows", "missing", F.round("least", 4).alias("least"), F.round("most", 4).alias("most"), "incomplete"
    )


@query("SELECT group_id, count(*)::BIGINT AS n FROM grouped_hubs GROUP BY group_id HAVING count(*) > 1")
def dq_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hubloom.operators.validate import duplicates

    return duplicates(table(spark, sf_dir, "grouped_hubs"), "group_id")


@query("SELECT count(*)::BIGINT AS n_groups, count(*) FILTER (n = 1)::BIGINT AS singles, count(*) FILTER (n > 1)::BIGINT AS several, max(n)::BIGINT AS largest, round(avg(n), 4) AS mean FROM (SELECT count(*) AS n FROM grouped_hubs GROUP BY group_id)")
def group_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.group_sizes(table(spark, sf_dir, "grouped_hubs"), "group_id").withColumn("mean", F.round("mean", 4))


@query("SELECT mode_planned AS value, count(*)::BIGINT AS n FROM lines_modes GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lines_modes").groupBy(F.col("mode_planned").alias("value")).agg(F.count("*").alias("n"))


@query("SELECT criterion FROM (SELECT criterion_a AS criterion FROM ahp_expert_comparisons UNION SELECT criterion_b FROM ahp_expert_comparisons) WHERE criterion IS NOT NULL")
def criteria_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "ahp_expert_comparisons")
    return c.select(F.col("criterion_a").alias("criterion")).union(c.select("criterion_b")).where("criterion is not null").distinct()


@query("SELECT line_model_name, mode_planned, area FROM (SELECT *, row_number() OVER (PARTITION BY line_model_name ORDER BY mode_planned NULLS FIRST, area NULLS FIRST) AS n FROM lines_modes) WHERE n = 1")
def first_of_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("line_model_name").orderBy("mode_planned", "area")
    return table(spark, sf_dir, "lines_modes").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


@query("""SELECT file_id, CASE lower(sheet_name) WHEN '5040_daily' THEN 'Haifa' WHEN 'daily_5087' THEN 'Tel Aviv' WHEN 'daily_bs' THEN 'Beer Sheva' WHEN 'national' THEN 'Rail' ELSE coalesce(sheet_name, model) END AS region FROM demand_files""")
def sheet_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet's region by its known name, else its own name, else its model."""
    f = table(spark, sf_dir, "demand_files")
    return f.select("file_id", F.coalesce(rules.lookup(S.SHEET_REGIONS, F.lower("sheet_name")), "sheet_name", "model").alias("region"))


@query("SELECT file_id, model, strftime(released, '%Y-%m') AS month, replace(replace(replace(model || '/' || coalesce(sheet_name, ''), '/', '_'), '\\', '_'), ' ', '_') AS file_name FROM demand_files".replace("\\\\", "\\"))
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "demand_files")
    name = F.concat(F.col("model"), F.lit("/"), F.coalesce("sheet_name", F.lit("")))
    return f.select("file_id", "model", F.date_format("released", "yyyy-MM").alias("month"), text.safe_file_name(name).alias("file_name"))
