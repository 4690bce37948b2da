"""Aggregations of nodes to cells, cells to groups, and tables to pivots. Null keys are dropped, as in the source data's tools."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubloom.functions import rules
from hubloom.functions import settings as S


def filter_by_threshold_and_sets(
    df: DataFrame, value: str, modes: str, least: float = S.MIN_PASSENGERS, count: int = S.MIN_MODES, within: Iterable[str] = S.MASS_TRANSIT, not_only: Iterable[str] = S.RAIL_ONLY
) -> DataFrame:
    """Rows of at least `least` (null and NaN are below) with `count` members of a set that aren't all of another. A missing column passes its test."""
    keep = F.lit(True)
    if value in df.columns:
        keep = keep & F.coalesce(rules.no_nan(F.col(value)) >= least, F.lit(False))
    if modes in df.columns:
        m = F.col(modes)
        keep = keep & (rules.count_members(m, within) >= count) & ~rules.only_members(m, within, not_only)
    return df.where(keep)


def level_one(df: DataFrame, cell: str, node: str, mode: str, line: str) -> DataFrame:
    """cell, node, mode, line_nunique, lines: distinct lines of each mode at each node."""
    kept = df.dropna(subset=[cell, node, mode])
    # the list is wanted anyway: its size saves the shuffles of a distinct count
    return kept.groupBy(cell, node, mode).agg(F.collect_set(line).alias("lines")).withColumn("line_nunique", F.size("lines").cast("bigint"))


def level_two(one: DataFrame, cell: str, node: str, mode: str) -> DataFrame:
    """cell, nodes, modes, line_nunique (the sum over nodes and modes), lines: sorted distinct lists."""
    return one.groupBy(cell).agg(
        F.sort_array(F.collect_set(node)).alias("nodes"), F.sort_array(F.collect_set(mode)).alias("modes"),
        F.sum("line_nunique").alias("line_nunique"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"),
    )


def merge_groups(
    df: DataFrame, group: str, order: str, lists: Iterable[str] = (), sums: Iterable[str] = (), firsts: Iterable[str] = (), unknown: Iterable[str] = ("Unknown",)
) -> DataFrame:
    """Rows to groups: sorted unions of lists, sums without nulls and NaN (0 for none), the first known value by `order`, n_rows.

    Columns that the table lacks are left out. Null groups are dropped.
    """
    have = set(df.columns)
    known = lambda c: F.when(F.col(c).isNotNull() & ~F.col(c).isin(*unknown), F.col(order))
    aggregates = [
        *(F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists if c in have),
        *(F.coalesce(F.sum(rules.no_nan(F.col(c).cast("double"))), F.lit(0.0)).alias(c) for c in sums if c in have),
        *(F.min_by(F.when(known(c).isNotNull(), F.col(c)), known(c)).alias(c) for c in firsts if c in have),
        F.count("*").alias("n_rows"),
    ]
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(*aggregates)


def dedup_then_sum(df: DataFrame, group: str, node: str, value: str) -> DataFrame:
    """The least value of each (group, node), summed by group: a node in several cells counts once."""
    return df.dropna(subset=[group, node]).groupBy(group, node).agg(F.min(value).alias(value)).groupBy(group).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))


def pivot_sum(df: DataFrame, group: str, key: str, value: str, keys: list, total: str | None = None) -> DataFrame:
    """A column for each of the given keys with the sum of value, 0 for none; total: over all keys, others too."""
    sums = [F.coalesce(F.sum(F.when(F.col(key) == k, F.col(value))), F.lit(0)).alias(str(k)) for k in keys]
    if total:
        sums.append(F.coalesce(F.sum(value), F.lit(0)).alias(total))
    return df.groupBy(group).agg(*sums)


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    per = df.groupBy(group).agg(F.count("*").alias("n"))
    return per.agg(
        F.count("*").alias("n_groups"), F.count_if(F.col("n") == 1).alias("singles"), F.count_if(F.col("n") > 1).alias("several"),
        F.max("n").alias("largest"), F.avg("n").alias("mean"),
    )


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new, and the rows of old whose key new lacks. Rows of old without a key stay."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def without_listed_lines(rows: DataFrame, lines: DataFrame, area: str = S.DROPPED_AREA, names: Iterable[str] = S.DROPPED_LINES) -> DataFrame:
    """rows but those of the named lines that the area has."""
    listed = lines.where((F.col("area") == area) & F.col("line_model_name").isin(list(names))).select(F.col("line_model_name").alias("line_id")).distinct()
    return rows.join(listed, "line_id", "left_anti")


def rename_rings(df: DataFrame, prefixes: Iterable[str], radii: tuple[int, ...] = (0, 500, 1000, 1500)) -> DataFrame:
    """prefix1, prefix2.. under the names of their radii: prefix_0_500 and so on; columns that are missing are left out."""
    return df.withColumnsRenamed({f"{p}{k + 1}": f"{p}_{a}_{b}" for p in prefixes for k, (a, b) in enumerate(zip(radii, radii[1:]))})


def flag_summary(df: DataFrame, flags: Mapping[str, Column], together: Iterable[str]) -> DataFrame:
    """criterion, count, percentage: all rows, those that meet all of `together`, each flag, and those that don't meet all. One aggregation."""
    every = reduce(lambda a, b: a & b, [flags[n] for n in together])
    hit = lambda c: F.count(F.when(F.coalesce(c, F.lit(False)), 1))
    one = df.agg(F.count("*").alias("n"), hit(every).alias("a"), *(hit(c).alias(f"c{k}") for k, c in enumerate(flags.values())))
    rows = [("Total", F.col("n")), ("All", F.col("a")), *((name, F.col(f"c{k}")) for k, name in enumerate(flags)), ("None of all", F.col("n") - F.col("a"))]
    long = one.select("n", F.inline(F.array(*(F.struct(F.lit(name).alias("criterion"), c.alias("count")) for name, c in rows))))
    return long.select("criterion", "count", F.round(F.try_divide(F.col("count") * 100.0, F.col("n")), 1).alias("percentage"))


def renumbered(df: DataFrame, group: str, merged: Mapping[int, int]) -> DataFrame:
    """df with single groups under another's number."""
    to = F.create_map(*(F.lit(x).cast("bigint") for pair in merged.items() for x in pair))
    return df.withColumn(group, F.coalesce(F.try_element_at(to, F.col(group)), F.col(group)))
