"""Hubs bound to the star tables: an order is a hub, its suppliers are nodes, its parts lines.

The binding only serves to test the operators on tables of any size against SQL. `HUB` and
`BASE` say the same in SQL as `node_lines` and `hubs` do in Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubloom.functions import rules
from hubloom.functions import settings as S
from hubloom.session import table

MODES = {"STANDARD": "Bus", "ECONOMY": "BRT", "MEDIUM": "LRT", "PROMO": "Express Bus", "SMALL": "Rail", "LARGE": "Metro"}
AREAS = {0: "Tel Aviv", 1: "Haifa", 2: "Jerusalem", 3: "South", 4: "North"}
LOCATIONS = {"AUTOMOBILE": "Core", "BUILDING": "Inner Ring", "FURNITURE": "Outer", "HOUSEHOLD": "Outer Ring"}
TERMINALS = {0: "מסוף גדול", 1: "חניון לילה", 2: "מסוף קטן", 3: "Regional", 4: "Local"}


def values(table_: dict, name: str) -> str:
    rows = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in kv) + ")" for kv in table_.items())
    return f"(VALUES {rows}) {name}(k, v)"


def case_weights(column: str, weights: dict[str, float], default: float) -> str:
    whens = " ".join(f"WHEN contains(lower({column}), '{k.lower()}') THEN {w}::DOUBLE" for k, w in weights.items())
    return f"CASE {whens} ELSE {default}::DOUBLE END"


NODE_LINES = f"""
nl AS (SELECT l.l_orderkey AS hub, o.o_custkey AS cust, l.l_suppkey AS node, l.l_partkey AS line, m.v AS mode, l.l_extendedprice AS price, l.l_linestatus AS status
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey JOIN {values(MODES, 'm')} ON m.k = p.p_type)"""
HAS = {n: "list_has_any(modes, [" + ", ".join(f"'{m}'" for m in ms) + "])" for n, ms in {"rail": S.RAIL_ONLY + ("HighSpeed Rail",), "metro": ("Metro",), "local": ("BRT", "LRT"), "nat": ("HighSpeed Rail", "Interurban Rail", "Rail")}.items()}


def tier_sql(metro_min: float | None = None) -> str:
    more = f" AND demand >= {metro_min}" if metro_min is not None else ""
    return (
        f"CASE WHEN {HAS['nat']} AND lines >= 3 AND demand >= 50000 THEN '{S.NATIONAL}' "
        f"WHEN ({HAS['rail']} OR {HAS['metro']}) AND lines >= 3{more} THEN '{S.METROPOLITAN}' "
        f"WHEN {HAS['local']} AND lines >= 3 AND demand >= 1000 THEN '{S.LOCAL}' "
        f"WHEN {HAS['rail']} AND lines <= 2 THEN 'Train Station' ELSE 'Not Hub' END"
    )


HUB = f"""WITH {NODE_LINES},
hub0 AS (SELECT hub, max(cust) AS cust, list_sort(list(DISTINCT mode)) AS modes, count(DISTINCT line) AS lines, count(DISTINCT node) AS nodes,
    sum(price) / 3 AS demand, coalesce(sum(price) FILTER (status = 'F'), 0) / 3 AS transfers FROM nl GROUP BY hub),
rings AS (SELECT l.l_orderkey AS hub,
    coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS pop1, coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) AS pop2, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS pop3,
    coalesce(sum(l_extendedprice) FILTER (l_returnflag = 'A'), 0) / 1000 AS emp1, coalesce(sum(l_extendedprice) FILTER (l_returnflag = 'N'), 0) / 1000 AS emp2, coalesce(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 0) / 1000 AS emp3
  FROM lineitem l GROUP BY 1),
hub AS (SELECT h.*, a.v AS area, lo.v AS location, t.v AS term_type, c.c_custkey % 3 <> 0 AS near, pop1, pop2, pop3, emp1, emp2, emp3, {tier_sql()} AS tier
  FROM hub0 h JOIN customer c ON c.c_custkey = h.cust LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN {values(AREAS, 'a')} ON a.k = n.n_regionkey LEFT JOIN {values(LOCATIONS, 'lo')} ON lo.k = c.c_mktsegment LEFT JOIN {values(TERMINALS, 't')} ON t.k = c.c_custkey % 6
  LEFT JOIN rings r ON r.hub = h.hub)"""


def node_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hub, node, line, mode, price, status: a row for each line at a node."""
    li, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    rows = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    # orders last: rows lie by their hub then, so that grouping by it shuffles nothing
    return rows.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("hub"), F.col("o_custkey").alias("cust"), F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("line"),
        rules.lookup(MODES, F.col("p_type")).alias("mode"), F.col("l_extendedprice").alias("price"), F.col("l_linestatus").alias("status"),
    ).where("mode is not null")


def hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per hub with modes, lines, demand, place, rings and tier."""
    hub0 = node_lines(spark, sf_dir).groupBy("hub").agg(
        F.sort_array(F.collect_set("mode")).alias("modes"), F.size(F.collect_set("line")).cast("bigint").alias("lines"), F.size(F.collect_set("node")).cast("bigint").alias("nodes"),
        (F.sum("price") / 3).alias("demand"), (F.sum(F.when(F.col("status") == "F", F.col("price")).otherwise(0.0)) / 3).alias("transfers"), F.max("cust").alias("cust"),
    )
    li = table(spark, sf_dir, "lineitem")
    at = {"A": 1, "N": 2, "R": 3}
    rings = li.groupBy(F.col("l_orderkey").alias("hub")).agg(
        *(F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0.0)).alias(f"pop{i}") for f, i in at.items()),
        *((F.sum(F.when(F.col("l_returnflag") == f, F.col("l_extendedprice")).otherwise(0.0)) / 1000).alias(f"emp{i}") for f, i in at.items()),
    )
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    place = c.select(
        F.col("c_custkey").alias("cust"), rules.lookup(AREAS, F.col("n_regionkey")).alias("area"),
        rules.lookup(LOCATIONS, F.col("c_mktsegment")).alias("location"), rules.lookup(TERMINALS, (F.col("c_custkey") % 6).cast("int")).alias("term_type"),
        (F.col("c_custkey") % 3 != 0).alias("near"),
    )
    # both sides of the first join are grouped by hub already: nothing is shuffled for it
    return hub0.join(rings, "hub", "left").join(place, "cust").withColumn("tier", rules.tier(F.col("modes"), F.col("lines"), F.col("demand")))
