"""Lookups: demand by prioritised models, manual overrides, corrected names."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubloom.functions.settings import RegionColumns
from hubloom.operators.drift import number, whole


def demand_by_node(rows: DataFrame) -> DataFrame:
    """model, node, demand, transfers: sums; rows without a node are dropped, missing values count nothing."""
    return rows.where("node is not null and model is not null").groupBy("model", "node").agg(
        F.coalesce(F.sum("demand"), F.lit(0.0)).alias("demand"), F.coalesce(F.sum("transfers"), F.lit(0.0)).alias("transfers")
    )


def standardise(records: DataFrame, body: str, nodes: Iterable[str], boardings: Iterable[str], transfers: Iterable[str]) -> DataFrame:
    """record_id, node, boardings, transfers of JSON records: the first candidate key that has a value; transfers are summed."""
    m = F.from_json(body, "map<string,string>")
    first = lambda keys: F.coalesce(*(F.try_element_at(F.col("_m"), F.lit(k)) for k in keys))
    parts = [F.coalesce(number(F.try_element_at(F.col("_m"), F.lit(k))), F.lit(0.0)) for k in transfers]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return records.withColumn("_m", m).select(
        "record_id", first(nodes).try_cast("double").try_cast("bigint").alias("node"), number(first(boardings)).alias("boardings"), total.alias("transfers")
    )


def by_region(records: DataFrame, body: str, model: str, regions: Mapping[str, RegionColumns], other: RegionColumns) -> DataFrame:
    """records with node, boardings, alightings and transfers, from the columns that their model's sheet has them in.

    A missing transfer column counts nothing, any other gives null.
    """
    def of(c: RegionColumns) -> Column:
        value = lambda k: F.try_element_at(F.col("_m"), F.lit(k))
        total = F.lit(0.0)
        for t in c.transfers:
            total = total + F.coalesce(number(value(t)), F.lit(0.0))
        return F.struct(whole(value(c.node)).alias("node"), number(value(c.boardings)).alias("boardings"), number(value(c.alightings)).alias("alightings"), total.alias("transfers"))

    found = of(other)
    for name, c in regions.items():
        found = F.when(F.col(model) == name, of(c)).otherwise(found)
    df = records.withColumn("_m", F.from_json(body, "map<string,string>")).withColumn("_v", found)
    return df.select(*records.columns, "_v.*")


def prioritised_lookup(nodes: DataFrame, demand: DataFrame, group: str, node: str, candidates: Column, overlays: Iterable[str]) -> DataFrame:
    """group, demand, transfers: the sum over a group's nodes of what the first model has for each.

    candidates: a group's models in order, separated by commas. Overlays go before them
    and never count again as candidates.
    """
    over = list(overlays)
    mine = F.filter(F.split(candidates, ","), lambda m: (m != "") & ~m.isin(over))
    tried = nodes.select(group, node, F.posexplode(F.concat(F.array(*map(F.lit, over)), mine)).alias("prio", "model"))
    hit = tried.join(demand.withColumnRenamed("node", node), ["model", node]).groupBy(group, node).agg(F.min_by(F.struct("demand", "transfers"), "prio").alias("d"))
    return hit.groupBy(group).agg(F.sum("d.demand").alias("demand"), F.sum("d.transfers").alias("transfers"))


def additive_lookup(nodes: DataFrame, demand: DataFrame, group: str, node: str, model: Column, overlays: Iterable[str]) -> DataFrame:
    """group, demand: a node's own model, else the sum of all base models, plus the overlays on top."""
    over = list(overlays)
    d = demand.withColumnRenamed("node", node)
    base = d.where(~F.col("model").isin(over)).groupBy(node).agg(F.sum("demand").alias("of_all"))
    top = d.where(F.col("model").isin(over)).groupBy(node).agg(F.sum("demand").alias("of_overlays"))
    own = d.select("model", node, F.col("demand").alias("of_model"))
    j = nodes.withColumn("model", model).join(own, ["model", node], "left").join(base, node, "left").join(top, node, "left")
    return j.groupBy(group).agg(F.sum(F.coalesce("of_model", "of_all", F.lit(0.0)) + F.coalesce("of_overlays", F.lit(0.0))).alias("demand"))


def override_last_wins(nodes: DataFrame, overrides: DataFrame, group: str, node: str, order: str, value: str) -> DataFrame:
    """group, value: of the last override that names any of the group's nodes; null without one."""
    last = overrides.groupBy(node).agg(F.max_by(F.struct(order, value), order).alias("o"))
    hit = nodes.join(last, node).groupBy(group).agg(F.max_by(f"o.{value}", f"o.{order}").alias(value))
    return nodes.select(group).distinct().join(hit, group, "left")


def corrected_join(rows: DataFrame, corrections: DataFrame, dimension: DataFrame, name: str) -> DataFrame:
    """Names replaced by their corrections (name, correct), then joined to the dimension; the first correction counts."""
    one = corrections.groupBy(name).agg(F.min("correct").alias("correct"))
    fixed = rows.join(one, name, "left").withColumn(name, F.coalesce("correct", name)).drop("correct")
    return fixed.join(dimension, name, "left")
