"""The whole pipeline as one lazy plan, and its queries: nodes to cells, groups, demand, places, scores, ranks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubloom.functions import hexgrid as X
from hubloom.functions import rules
from hubloom.functions import settings as S
from hubloom.functions.geometry import place
from hubloom.operators import aggregate as A
from hubloom.operators import montecarlo as M
from hubloom.operators import score as C
from hubloom.operators import spatial as P
from hubloom.operators.drift import ingest
from hubloom.operators.grouping import numbered_groups
from hubloom.operators.near import slabs
from hubloom.plans.registry import Registry
from hubloom.session import shared_dir, table, written
from hubloom.streaming import demand as D

query = Registry()
queries, oracle_sql = query.queries, query.oracle_sql


def surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, line, mode, q, r: surveys with a place, each line with its modes."""
    lines = table(spark, sf_dir, "lines_modes").select(F.trim("line_model_name").alias("line"), F.trim("mode_planned").alias("mode")).distinct()
    t = table(spark, sf_dir, "transit_nodes")
    both = F.coalesce(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct("x", "y")), place(F.col("geometry")).dropFields("rank"))
    t = t.where("node is not null").select("node", F.trim("line_id").alias("line"), both.alias("p")).where("p is not null").distinct()
    q, r = X.axial(F.col("p.x"), F.col("p.y"))
    return t.select("node", "line", q.alias("q"), r.alias("r")).join(lines, "line", "left")


class HubPipeline:
    """run() gives ranked hubs; every step is a DataFrame of its own, computed when something asks for it."""

    def __init__(self, spark: SparkSession, sf_dir: str, near: float = 120.1):
        self.spark, self.sf_dir, self.near = spark, sf_dir, near

    def cells(self) -> DataFrame:
        s = surveys(self.spark, self.sf_dir).withColumn("cell", X.cell_id(F.col("q"), F.col("r")))
        one = A.level_one(s, "cell", "node", "mode", "line")
        return A.level_two(one, "cell", "node", "mode")

    def groups(self, cells: DataFrame) -> DataFrame:
        """cell, group: cells near one another, directly or through others."""
        parts = F.transform(F.split("cell", ":"), lambda x: x.cast("bigint"))
        c = cells.select("cell", parts[0].alias("q"), parts[1].alias("r"))
        near = F.array(*(F.struct(X.cell_id(F.col("q") + i, F.col("r") + j).alias("other")) for i, j in X.offsets_within(self.near)))
        links = c.select(F.col("cell").alias("a"), F.inline(near)).join(c.select(F.col("cell").alias("other")), "other", "left_semi").select("a", F.col("other").alias("b"))
        return numbered_groups(c, links, id="cell").withColumnRenamed("id", "cell")

    def demand(self) -> DataFrame:
        """node, demand, transfers: the sum over all models of each feed's last file."""
        records, files = table(self.spark, self.sf_dir, "demand_records"), table(self.spark, self.sf_dir, "demand_files")
        typed, _ = ingest(records, files)
        last = files.where("released is not null").groupBy("feed_id").agg(F.max_by("file_id", "released").alias("file_id")).select("file_id")
        rows = typed.join(last, "file_id").where("node is not null").dropDuplicates(["file_id", "line_no", "node"])
        got = F.coalesce("boardings_daily", F.lit(0.0)) + F.coalesce("alightings_daily", F.lit(0.0))
        return rows.groupBy("node").agg(F.sum(got).alias("demand"), F.sum(F.coalesce("totaltransfers", F.lit(0.0))).alias("transfers"))

    def hubs(self) -> DataFrame:
        """One row per group: modes, lines, nodes, demand, centre, zone, tier."""
        cells, _ = written(self.cells())
        groups, _ = written(self.groups(cells))
        j = cells.join(groups, "cell")
        parts = F.transform(F.split("cell", ":"), lambda x: x.cast("bigint"))
        x, y = X.centre(parts[0], parts[1])
        per = j.groupBy("group").agg(
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("modes")))).alias("modes"), F.sum("line_nunique").alias("lines"), F.avg(x).alias("x"), F.avg(y).alias("y"), F.count("*").alias("cells")
        )
        nodes = j.select("group", F.explode("nodes").alias("node")).distinct()
        demand = nodes.join(self.demand(), "node").groupBy("group").agg(F.sum("demand").alias("demand"), F.sum("transfers").alias("transfers"))
        h = per.join(demand, "group", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("demand", "transfers")})
        h, _ = written(h)
        zones = table(self.spark, self.sf_dir, "zones")
        at = P.first_region(h.select(F.col("group").alias("id"), "x", "y"), slabs(zones, "zone_id", "geometry")).join(zones.select(F.col("zone_id").alias("region"), F.col("metro_name").alias("area"), F.col("zone_name").alias("location")), "region", "left")
        return h.join(at.select(F.col("id").alias("group"), "area", "location"), "group", "left").withColumn("tier", rules.tier(F.col("modes"), F.col("lines"), F.col("demand")))

    def scored(self, hubs: DataFrame) -> DataFrame:
        """Scores on demand, service and location, their mean over Monte-Carlo weights, and the rank in its pool."""
        place_ = rules.first_contained(F.col("area"), S.REGION_WEIGHTS, 0.5) * rules.first_contained(F.col("location"), S.POSITION_WEIGHTS, 1.5)
        names = ("activity_score", "service_score", "location_score")
        s = C.normalised_all(hubs, {
            "activity_score": (rules.log10_or_zero(F.col("demand")), "tier"), "service_score": (rules.mode_service(F.col("modes"), F.col("lines")), "tier"), "location_score": (place_, None)
        }).drop(*(f"{n}_most" for n in names))
        s = M.mean_score(s, names, M.draw_weights(len(names)))
        return C.ranked(s, "final_score", pool=C.scope("tier", "area"))

    def run(self) -> DataFrame:
        return self.scored(self.hubs())


@query()
def full_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked hubs from surveys, lines, demand sheets and zones."""
    return HubPipeline(spark, sf_dir).run().select("group", F.array_join("modes", ",").alias("modes"), "lines", "demand", "transfers", "area", "tier", "final_score", "rank")


@query("SELECT event_type AS model, user_id AS node, round(sum(value), 4) AS demand, round(sum(CASE WHEN event_id % 2 = 0 THEN value ELSE 0 END), 4) AS transfers FROM events WHERE user_id IS NOT NULL GROUP BY ALL")
def streaming_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand by model and node from a stream of files, run until all of them are read."""
    t = table(spark, sf_dir, "events")
    at = f"{shared_dir(spark)}/hubloom-stream-{uuid.uuid4().hex}"
    rows = D.read_files(spark, f"{sf_dir}/events.parquet", t.schema).select(
        F.col("event_type").alias("model"), F.col("user_id").alias("node"), F.col("value").alias("demand"), F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(0.0).alias("transfers")
    )
    D.upsert_totals(D.demand_totals(rows), f"{at}/out", f"{at}/state").awaitTermination()
    return D.latest(spark, f"{at}/out").select("model", "node", F.round("demand", 4).alias("demand"), F.round("transfers", 4).alias("transfers"))
