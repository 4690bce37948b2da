"""Whole steps of the analysis: scoring runs, expert runs, report tables, manual corrections."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubloom.functions import settings as S
from hubloom.functions.text import node_numbers
from hubloom.operators import ahp as H
from hubloom.operators import montecarlo as M
from hubloom.operators import score as C
from hubloom.session import written


def ahp_run(df: DataFrame, comparisons: DataFrame, scores: Mapping[str, str], method: str = "eigenvector", how: str = "geometric_mean") -> tuple[DataFrame, dict[str, object]]:
    """df with ahp_score and ahp_rank, and what led to them: weights, consistency ratios, inconsistent experts.

    scores: criterion -> score column. Criteria nobody judged weigh nothing; the weights
    of the others are normalised. Inconsistent experts are reported, not left out.
    """
    m = H.matrices(comparisons)
    per_expert = H.priorities(m, method)
    found = {r["criterion"]: r["weight"] for r in H.aggregate_experts(per_expert, how).where(F.col("criterion").isin(list(scores))).collect()}
    total = sum(found.values())
    if not total:
        raise ValueError("no judgements of these criteria")
    weights = {c: found.get(c, 0.0) / total for c in scores}
    ratios = {r["expert"]: r["cr"] for r in H.consistency(m, per_expert).collect()}
    scored = df.withColumn("ahp_score", C.weighted(scores.values(), weights.values()))
    out = C.global_rank(written(scored)[0], "ahp_score", "ahp_rank")
    return out, {"weights": weights, "consistency": ratios, "inconsistent": sorted(e for e, r in ratios.items() if r > S.CONSISTENT)}


def score_run(df: DataFrame, iterations: int = S.MC_ITERATIONS, seed: int = S.MC_SEED, sampler: str = "uniform_norm", comparisons: DataFrame | None = None) -> DataFrame:
    """Criteria, mean Monte-Carlo score and rank in its pool; with judgements the expert score and rank too."""
    scored = M.mean_score(C.criteria(df), C.CRITERIA, M.draw_weights(len(C.CRITERIA), iterations, seed, sampler))
    out = C.ranked(scored, "final_score", pool=C.scope("tier" if "tier" in df.columns else None, "area" if "area" in df.columns else None))
    if comparisons is None:
        return out
    return ahp_run(out, comparisons, {c.removesuffix("_score"): c for c in C.CRITERIA})[0]


def report_tables(df: DataFrame, id: str, first: str, second: str, n: int = 20) -> dict[str, DataFrame]:
    """The table, its leaders by two measures and by the mean of both scaled to 0..1, and both measures' averages."""
    v = C.with_range(C.with_range(df, F.col(first), None, "_a"), F.col(second), None, "_b")
    scaled = [F.coalesce(F.try_divide(F.col(f"{p}_v") - F.col(f"{p}_min"), F.col(f"{p}_max") - F.col(f"{p}_min")), F.lit(0.0)) for p in ("_a", "_b")]
    both = v.select(*df.columns, ((scaled[0] + scaled[1]) / 2).alias("combined"))
    top = lambda d, c: d.orderBy(F.desc(c), id).limit(n)
    return {
        "data": df, f"top_{first}": top(df, first), f"top_{second}": top(df, second), "top_combined": top(both, "combined"),
        "averages": df.agg(F.avg(first).alias(first), F.avg(second).alias(second)),
    }


def expert_export(comparisons: DataFrame, expert: str, method: str = "eigenvector") -> DataFrame:
    """criterion, weight of one expert, with the consistency ratio, the largest eigenvalue and the name as rows of their own."""
    m = H.matrices(comparisons.where(F.col("expert") == expert))
    w = H.priorities(m, method)
    c = H.consistency(m, w)
    rows = F.array(
        F.struct(F.lit("_consistency_ratio").alias("criterion"), F.col("cr").cast("string").alias("weight")),
        F.struct(F.lit("_lambda_max").alias("criterion"), F.col("lambda_max").cast("string").alias("weight")),
        F.struct(F.lit("_expert").alias("criterion"), F.col("expert").alias("weight")),
    )
    return w.select("criterion", F.col("weight").cast("string").alias("weight")).unionByName(c.select(F.inline(rows)))


def group_notes(notes: DataFrame, text: str, id: str) -> DataFrame:
    """note, node: the numbers of each note that names two nodes or more."""
    n = notes.select(F.col(id).alias("note"), F.array_distinct(node_numbers(F.col(text))).alias("nodes"))
    return n.where(F.size("nodes") > 1).select("note", F.explode("nodes").alias("node"))


def with_builtin_overrides(overrides: DataFrame, builtin: Iterable[tuple[int, float, float | None]] = S.NODE_OVERRIDES) -> DataFrame:
    """node, row_no, demand, transfers: built-in corrections after the table's own rows, so that they win."""
    rows = [(node, i, float(d), None if t is None else float(t)) for i, (node, d, t) in enumerate(builtin)]
    more = overrides.sparkSession.createDataFrame(rows, "node bigint, row_no bigint, demand double, transfers double")
    return overrides.select("node", "row_no", "demand", "transfers").unionByName(more.withColumn("row_no", F.col("row_no") + (1 << 40)))


def with_demand_columns(df: DataFrame, columns: Sequence[str] = ("TotalDemand", "TotalTransfers")) -> DataFrame:
    """df with the columns it lacks, at 0."""
    return df.withColumns({c: F.lit(0.0) for c in columns if c not in df.columns})
