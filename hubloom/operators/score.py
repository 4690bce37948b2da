"""Criterion scores, ranks and their summaries. Windows are partitioned wherever the meaning allows it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hubloom.functions import rules
from hubloom.functions import settings as S
from hubloom.operators.numbering import parts_ahead
from hubloom.session import written


def with_range(df: DataFrame, value: Column, by: str | None, prefix: str) -> DataFrame:
    """df with {prefix}_min and {prefix}_max of the value, per group or over all rows.

    Ranges are aggregated before they meet the rows: one row per group, whose number is
    that of a short list of tiers, or one row.
    """
    v = df.withColumn(f"{prefix}_v", value)
    if by is None:
        one = v.agg(F.min(f"{prefix}_v").alias(f"{prefix}_min"), F.max(f"{prefix}_v").alias(f"{prefix}_max"))
        return v.crossJoin(F.broadcast(one))
    per = v.groupBy(by).agg(F.min(f"{prefix}_v").alias(f"{prefix}_min"), F.max(f"{prefix}_v").alias(f"{prefix}_max"))
    return v.join(per.where(F.col(by).isNotNull()), by, "left")


def normalised_all(df: DataFrame, scores: dict[str, tuple[Column, str | None]], clip: bool = True) -> DataFrame:
    """df with a column for each score: name -> (value, group column or None for overall), scaled to 1..10.

    All ranges come from one aggregation by the group, whose rows are as few as the groups;
    the overall ones are aggregated from those. Null values and null groups give null.
    {name}_most, the largest value of its range, stays for rules that need it.
    """
    groups = {by for _, by in scores.values() if by is not None}
    if len(groups) > 1:
        raise ValueError("scores may share one group column")
    by = next(iter(groups), None)
    v = df.withColumns({f"_v_{n}": rules.no_nan(value.cast("double")) for n, (value, _) in scores.items()})
    ends = [f(f"_v_{n}").alias(f"{k}_{n}") for n in scores for k, f in (("_a", F.min), ("_b", F.max))]
    per = v.groupBy(*([by] if by else [])).agg(*ends)
    out = v
    whole = [n for n, (_, g) in scores.items() if g is None]
    if whole:
        one = per.agg(*(f(f"{k}_{n}").alias(f"{k}_{n}") for n in whole for k, f in (("_a", F.min), ("_b", F.max))))
        out = out.crossJoin(F.broadcast(one))
    if by:
        grouped = [n for n in scores if n not in whole]
        out = out.join(per.where(F.col(by).isNotNull()).select(by, *(f"{k}_{n}" for n in grouped for k in ("_a", "_b"))), by, "left")
    scaled = {n: rules.minmax(F.col(f"_v_{n}"), F.col(f"_a_{n}"), F.col(f"_b_{n}"), clip=clip) for n in scores}
    return out.select(*df.columns, *(c.alias(n) for n, c in scaled.items()), *(F.col(f"_b_{n}").alias(f"{n}_most") for n in scores))


def normalised(df: DataFrame, name: str, value: Column, by: str | None = None, clip: bool = True) -> DataFrame:
    """df with `name`: the value scaled to 1..10 per group or overall."""
    return normalised_all(df, {name: (value, by)}, clip).drop(f"{name}_most")


def log_positive(df: DataFrame, name: str, value: Column, by: str) -> DataFrame:
    """The variant whose range is of positive logarithms only but holds for all rows: values under 1 are possible; 1 if none is positive."""
    log = F.when(value == 0, 0.0).when(value > 0, F.log10(value))
    v = df.withColumn("_l", log)
    per = v.where(F.col(by).isNotNull()).groupBy(by).agg(F.min(F.when(F.col("_l") > 0, F.col("_l"))).alias("_a"), F.max(F.when(F.col("_l") > 0, F.col("_l"))).alias("_b"))
    out = v.join(per, by, "left")
    score = F.when(F.col("_a").isNull(), 1.0).otherwise(rules.minmax(F.col("_l"), F.col("_a"), F.col("_b"), clip=False))
    return out.withColumn(name, score).drop("_l", "_a", "_b")


CRITERIA = ("activity_score", "service_score", "location_score", "pop_jobs_score", "terminal_score")


def criteria(df: DataFrame) -> DataFrame:
    """The five criterion scores of a hub table (demand, modes, lines, area, location, rings, near, term_type, tier)."""
    pop, jobs = ([F.col(f"{k}{i}") for i in (1, 2, 3)] for k in ("pop", "emp"))
    place = rules.first_contained(F.col("area"), S.REGION_WEIGHTS, 0.5) * rules.first_contained(F.col("location"), S.POSITION_WEIGHTS, 1.5)
    terminal = F.when(F.col("near"), rules.first_contained(F.col("term_type"), S.TERMINAL_WEIGHTS, 1.0)).otherwise(0.0)
    out = normalised_all(
        df,
        {
            "activity_score": (rules.log10_or_zero(F.col("demand")), "tier"),
            "service_score": (rules.mode_service(F.col("modes"), F.col("lines")), "tier"),
            "location_score": (place, None),
            "pop_jobs_score": (rules.pop_jobs(pop, jobs, F.col("tier")), "tier"),
            "terminal_score": (terminal, None),
        },
    )
    score = F.when(F.col("terminal_score_most") > 0, F.col("terminal_score")).otherwise(1.0)
    return out.withColumn("terminal_score", score).drop(*(f"{c}_most" for c in CRITERIA))


def weighted(columns: Iterable[str], weights: Iterable[float]) -> Column:
    total = None
    for c, w in zip(columns, weights):
        part = F.col(c) * float(w)
        total = part if total is None else total + part
    return total


def scope(tier: str | None, area: str | None) -> Column:
    """The pool a row is ranked in: the top tier as one, the next two by area, all the rest together.

    Without a tier column all rows are one pool; without an area column each tier is.
    """
    if tier is None:
        return F.lit("all")
    t = F.col(tier)
    if area is None:
        return F.coalesce(t, F.lit("rest"))
    local = t.isin(S.METROPOLITAN, S.LOCAL) & F.col(area).isNotNull()
    return F.when(t == S.NATIONAL, S.NATIONAL).when(local, F.concat_ws("\u0001", t, F.col(area))).otherwise("rest")


def ranked(df: DataFrame, by: str, name: str = "rank", pool: Column | None = None, how: str = "min") -> DataFrame:
    """Rank by falling score within pools; ties share the least (min) or the next (dense) rank; null scores have none."""
    f = {"min": F.rank, "dense": F.dense_rank}[how]
    w = W.partitionBy(F.lit(0) if pool is None else pool, F.col(by).isNotNull()).orderBy(F.desc(by))
    return df.withColumn(name, F.when(F.col(by).isNotNull(), f().over(w)).cast("bigint"))


def global_rank(df: DataFrame, by: str, name: str = "rank", dense: bool = False) -> DataFrame:
    """df with the min (or dense) rank by falling `by` over all rows, for tables of any size.

    Values are counted and sorted over the cluster; a value's rank is what its sorted
    partition and the ones before it hold above it. Null has no rank. df is read twice:
    write it first if it is dear.
    """
    n = F.lit(1).cast("bigint") if dense else F.count("*")
    valued = df.where(F.col(by).isNotNull())
    counts = valued.select(by).distinct().withColumn("_n", n) if dense else valued.groupBy(by).agg(n.alias("_n"))
    counts, _ = written(counts.orderBy(F.desc(by)).withColumn("_part", F.spark_partition_id()))
    inside = W.partitionBy("_part").orderBy(F.desc(by)).rowsBetween(W.unboundedPreceding, -1)
    place = counts.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(parts_ahead(counts, F.sum("_n"))), "_part")
    return df.join(place.select(by, (F.col("_ahead") + F.col("_in") + 1).cast("bigint").alias(name)), by, "left")


def top_per_group(df: DataFrame, group: str, by: str, tie: str, n: int) -> DataFrame:
    w = W.partitionBy(group).orderBy(F.desc(by), tie)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def summary(df: DataFrame, scores: Iterable[str], by: str) -> DataFrame:
    """score, group ('All' for all rows), mean, median, std, least, most of each score."""
    rows = F.array(*(F.struct(F.lit(s).alias("score"), F.col(s).alias("v")) for s in scores))
    # a row counts for all and for its group; a null group stays apart from all
    long = df.select(F.explode(F.array(F.lit("All"), F.coalesce(F.concat(F.lit("="), F.col(by)), F.lit("?")))).alias("g"), F.explode(rows).alias("s")).select("g", "s.score", "s.v")
    out = long.groupBy("score", "g").agg(
        F.avg("v").alias("mean"), F.percentile("v", 0.5).alias("median"), F.stddev_samp("v").alias("std"), F.min("v").alias("least"), F.max("v").alias("most"), F.count("v").alias("n")
    )
    return out.withColumn("group", F.when(F.col("g") == "All", "All").when(F.col("g") == "?", None).otherwise(F.expr("substring(g, 2)"))).drop("g")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin, n: equal bins from the least to the largest value, the last one closed."""
    v = df.select(F.col(value).alias("v")).where("v is not null and not isnan(v)")
    r = v.agg(F.min("v").alias("a"), F.max("v").alias("b"))
    at = F.when(F.col("b") > F.col("a"), F.least(F.floor((F.col("v") - F.col("a")) / ((F.col("b") - F.col("a")) / bins)), F.lit(bins - 1))).otherwise(F.lit(0))
    return v.crossJoin(F.broadcast(r)).groupBy(at.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
