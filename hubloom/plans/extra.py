"""Queries on whole steps, report tables, SQL functions and variants of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubloom.functions import projection, rules, text, udf
from hubloom.functions import settings as S
from hubloom.operators import lookup as L
from hubloom.operators import score as C
from hubloom.operators import workflow as O
from hubloom.plans.analog import HUB, hubs, values
from hubloom.plans.registry import Registry
from hubloom.plans.scoring import mm
from hubloom.plans.simulation import example
from hubloom.plans.spatial import located
from hubloom.session import table

query = Registry()
queries, oracle_sql = query.queries, query.oracle_sql


@query(f"{HUB} SELECT hub, round(pop1, 4) AS pop1 FROM hub ORDER BY pop1 DESC, hub LIMIT 20")
def top20_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report."""
    return O.report_tables(hubs(spark, sf_dir), "hub", "pop1", "emp1")["top_pop1"].select("hub", F.round("pop1", 4).alias("pop1"))


@query(f"{HUB} SELECT round(avg(pop1), 4) AS pop1, round(avg(emp1), 4) AS emp1 FROM hub")
def ring_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.report_tables(hubs(spark, sf_dir), "hub", "pop1", "emp1")["averages"].select(F.round("pop1", 4).alias("pop1"), F.round("emp1", 4).alias("emp1"))


@query(f"{HUB}, x AS (SELECT hub, unnest(modes) AS m FROM hub) SELECT hub, array_to_string(list_sort(list(coalesce(l.v, m))), ',') AS labels FROM x LEFT JOIN {values(S.MODE_LABELS_HE, 'l')} ON l.k = m GROUP BY hub")
def mode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes under their local names; one without keeps its own."""
    labels = F.transform("modes", lambda m: F.coalesce(rules.lookup(S.MODE_LABELS_HE, m), m))
    return hubs(spark, sf_dir).select("hub", F.array_join(F.sort_array(labels), ",").alias("labels"))


@query(f"""WITH o AS (SELECT user_id + 400000 AS node, event_id AS n, value AS demand FROM events UNION ALL SELECT * FROM (VALUES {", ".join(f"({n}, {10**12 + i}, {d}::DOUBLE)" for i, (n, d, _) in enumerate(S.NODE_OVERRIDES))}) t(a, b, c))
  SELECT node, arg_max(demand, n) AS demand FROM o GROUP BY node""")
def builtin_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") + 400000).alias("node"), F.col("event_id").alias("row_no"), F.col("value").alias("demand"), F.lit(None).cast("double").alias("transfers"))
    return O.with_builtin_overrides(e).groupBy("node").agg(F.max_by("demand", "row_no").alias("demand"))


@query(r"""SELECT row_id AS note, CAST(unnest(list_distinct(regexp_extract_all(nodes_in_group, '(\d+)', 1))) AS BIGINT) AS node FROM is_same_group WHERE len(list_distinct(regexp_extract_all(nodes_in_group, '(\d+)', 1))) > 1""")
def manual_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.group_notes(table(spark, sf_dir, "is_same_group"), "nodes_in_group", "row_id")


@query(r"""SELECT line_model_name, round(length(regexp_replace(line_model_name, '[^\x{0590}-\x{05FF}]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(line_model_name, '\s', '', 'g')), 0), 4) AS ratio FROM lines_modes""")
def sql_function_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SQL function that Catalyst inlines."""
    udf.register(spark)
    return table(spark, sf_dir, "lines_modes").select("line_model_name", F.round(F.expr("hebrew_ratio(line_model_name)"), 4).alias("ratio"))


@query(f"{HUB} SELECT hub, CASE WHEN demand >= 50000 THEN '{S.NATIONAL}' WHEN demand >= 5000 THEN '{S.METROPOLITAN}' ELSE '{S.LOCAL}' END AS tier, len(list_filter(modes, lambda m: m IN ('Rail', 'HighSpeed Rail', 'Metro', 'LRT', 'BRT')))::BIGINT AS n FROM hub")
def sql_function_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    udf.register(spark)
    return hubs(spark, sf_dir).select("hub", F.expr("tier_of_demand(demand)").alias("tier"), F.expr("CAST(mass_transit_modes(modes) AS BIGINT)").alias("n"))


@query("SELECT s_suppkey AS id, s_suppkey + i AS q, s_nationkey + j AS r FROM supplier, range(-2, 3) a(i), range(-2, 3) b(j) WHERE abs(i + j) <= 2")
def table_function_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function: the ring of cells around a cell of each row."""
    udf.register(spark)
    table(spark, sf_dir, "supplier").createOrReplaceTempView("_ring_source")
    return spark.sql("SELECT s_suppkey AS id, h.q, h.r FROM _ring_source, LATERAL hex_ring(s_suppkey, CAST(s_nationkey AS BIGINT), 2) h")


@query(f"{HUB}, f AS (SELECT hub, coalesce(CASE WHEN location = 'Core' THEN NULL ELSE pop1 END, 0) AS v FROM hub) SELECT hub, round({mm('v')}, 4) AS score FROM f")
def minmax_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant that takes missing values as 0 before scaling."""
    v = F.when(~F.coalesce(F.col("location") == "Core", F.lit(False)), F.col("pop1"))
    return C.normalised(hubs(spark, sf_dir), "score", F.coalesce(v, F.lit(0.0))).select("hub", F.round("score", 4).alias("score"))


@query(f"{HUB} SELECT hub, round((demand - min(demand) OVER (PARTITION BY tier)) / nullif(max(demand) OVER (PARTITION BY tier) - min(demand) OVER (PARTITION BY tier), 0), 4) AS share FROM hub")
def minmax_unguarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant without a rule for groups of one value: null there."""
    h = C.with_range(hubs(spark, sf_dir), F.col("demand"), "tier", "d")
    return h.select("hub", F.round(F.try_divide(F.col("demand") - F.col("d_min"), F.col("d_max") - F.col("d_min")), 4).alias("share"))


@query(r"""SELECT hub_row, coalesce(list_max(list_transform(string_split(coalesce(metro_position, ''), ','), lambda p: CASE WHEN contains(p, 'גלעין') OR contains(p, 'Core') THEN 3 WHEN contains(p, 'טבעת') OR contains(p, 'Ring') THEN 2 ELSE 1 END)), 1)::BIGINT AS category FROM grouped_hubs""")
def location_list_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best category of a list of places."""
    best = F.array_max(F.transform(F.split(F.coalesce("metro_position", F.lit("")), ","), rules.location_category))
    return table(spark, sf_dir, "grouped_hubs").select("hub_row", F.coalesce(best, F.lit(1)).cast("bigint").alias("category"))


@query("SELECT p_partkey, p_name, string_split(p_name, ' ')[1] AS first FROM part")
def first_of_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", text.first_of_list(F.regexp_replace("p_name", " ", ",")).alias("first"))


@query(f"{HUB} SELECT hub, (CASE WHEN regexp_matches(term_type, 'גדול|משולב') THEN 3 WHEN regexp_matches(term_type, 'קטן|בינוני') THEN 2 WHEN contains(term_type, 'לילה') THEN 1 ELSE 0 END)::BIGINT AS category FROM hub")
def terminal_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hubs(spark, sf_dir).select("hub", F.coalesce(rules.terminal_category(F.col("term_type")), F.lit(0)).cast("bigint").alias("category"))


@query("""SELECT user_id AS node, count(*)::BIGINT AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS least, round(quantile_cont(value, 0.25), 4) AS q1, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.75), 4) AS q3, round(max(value), 4) AS most FROM events GROUP BY user_id""")
def describe_by_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = [F.round(F.percentile("value", p), 4).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node")).agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_samp("value"), 4).alias("std"), F.round(F.min("value"), 4).alias("least"), *q, F.round(F.max("value"), 4).alias("most")
    )


@query()
def ahp_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and ranks by the example experts' judgements."""
    scored = C.criteria(hubs(spark, sf_dir))
    names = {"activity": "activity_score", "service": "service_score", "location": "location_score", "pop_jobs": "pop_jobs_score", "terminal": "terminal_score"}
    return O.ahp_run(scored, example(spark), names)[0].select("hub", "ahp_score", "ahp_rank")


@query()
def score_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoring step as a whole: 10,000 draws, ranks by pool, experts' scores beside them."""
    return O.score_run(hubs(spark, sf_dir), comparisons=example(spark)).select("hub", "final_score", "rank", "ahp_score", "ahp_rank")


@query()
def expert_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.expert_export(example(spark), "urban_economist")


@query()
def places_in_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surveyed places in degrees of their own datum, also those that have only a geometry text."""
    t = located(spark, sf_dir)
    lon, lat = projection.to_degrees(F.col("x"), F.col("y"))
    return t.select("row_id", lon.alias("lon"), lat.alias("lat"))


@query("""SELECT n.node, coalesce(o.v, d.v, 0) AS v FROM (SELECT DISTINCT node FROM transit_nodes WHERE node IS NOT NULL) n LEFT JOIN (SELECT node, max(row_id)::DOUBLE AS v FROM transit_nodes WHERE x IS NOT NULL GROUP BY node) d USING (node)
  LEFT JOIN (SELECT * FROM (VALUES (400020, 108409.0::DOUBLE), (400470, 40628.0), (400460, 41000.0)) t(node, v)) o USING (node)""")
def demand_overrides_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by node, replaced by those of a manual table; one node holds a tenth of the rows."""
    t = table(spark, sf_dir, "transit_nodes").where("node is not null")
    over = spark.createDataFrame([(400020, 1, 108409.0), (400470, 2, 40628.0), (400460, 3, 41000.0)], "node bigint, n int, v double")
    own = t.where("x is not null").groupBy("node").agg(F.max("row_id").cast("double").alias("own"))
    nodes = t.select("node").distinct()
    found = L.override_last_wins(nodes.withColumn("hub", F.col("node")), over, "hub", "node", "n", "v").withColumnRenamed("hub", "node")
    return nodes.join(own, "node", "left").join(found, "node", "left").select("node", F.coalesce("v", "own", F.lit(0.0)).alias("v"))
