"""Connected groups by alternating star operations, their numbers, and manual merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from hubloom.operators.numbering import number_in_order
from hubloom.session import drop_written, written


def _observed(links: DataFrame) -> tuple[DataFrame, str, tuple]:
    """The links written, with their number and the sum of their hashes, taken while writing."""
    seen = Observation()
    out, at = written(links.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
    return out, at, (seen.get["n"], seen.get["h"])


def connected(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """id, root: each linked id with the smallest of its group. Null ends and loops are left out.

    Large star: larger neighbours are linked to the least neighbour; small star: smaller
    ones. Ends when nothing changes. Every step is aggregated before it is shuffled.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    e, at, before = _observed(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after, after_at, now = _observed(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        drop_written(spark, at)
        e, at = after, after_at
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"not connected after {max_rounds} rounds")
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("root"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)


def numbered_groups(ids: DataFrame, links: DataFrame, id: str = "id", a: str = "a", b: str = "b") -> DataFrame:
    """id, group: every id's group, numbered from 0 in the order of their smallest members; an id without links is its own."""
    roots = connected(links, a, b)
    every = ids.select(F.col(id).alias("id")).where("id is not null").distinct().join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    every, _ = written(every)
    numbers = number_in_order(every.select("root").distinct(), "root")
    return every.join(numbers, "root").select("id", (F.col("number") - 1).alias("group"))


def merge_groups_by_nodes(groups: DataFrame, members: DataFrame, notes: DataFrame) -> DataFrame:
    """id, group after manual merges, numbered anew from 0 by their smallest old group.

    groups: id, group. members: id, node. notes: note, node; the groups of a note's nodes
    become one. Notes whose nodes lie in fewer than two groups change nothing.
    """
    named = notes.join(members, "node").join(groups, "id").select("note", "group").distinct()
    first = named.groupBy("note").agg(F.min("group").alias("first"))
    links = named.join(first, "note").where(F.col("group") != F.col("first")).select(F.col("group").alias("a"), F.col("first").alias("b"))
    new = numbered_groups(groups.select(F.col("group").alias("id")), links).select(F.col("id").alias("group"), F.col("group").alias("merged"))
    return groups.join(new, "group").select("id", F.col("merged").alias("group"))
