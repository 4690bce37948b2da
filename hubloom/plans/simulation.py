"""Queries on Monte-Carlo weights and expert judgements."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubloom.functions import rules
from hubloom.functions import settings as S
from hubloom.operators import ahp as H
from hubloom.operators import montecarlo as M
from hubloom.operators import score as C
from hubloom.operators import workflow as O
from hubloom.plans.analog import hubs
from hubloom.plans.registry import Registry
from hubloom.session import ship, table, written

query = Registry()
queries, oracle_sql = query.queries, query.oracle_sql
N = len(C.CRITERIA)
#: Draws of the queries whose rows are draws themselves; all others take every one of S.MC_ITERATIONS.
RAW_DRAWS = 200

# The hubs of the surveys, each by its first export, with five measures scaled to 0..1.
_MEASURES = {
    "activity_score": "totaltransfers", "service_score": "line_nunique", "location_score": "num_modes", "pop_jobs_score": "totaldemand", "terminal_score": r"len(regexp_extract_all(node, '\d+'))",
}
_FIRST = ", ".join(f"arg_min(CASE WHEN isnan(({x})::DOUBLE) THEN 0 ELSE coalesce(({x})::DOUBLE, 0) END, hub_row) AS {c}" for c, x in _MEASURES.items())
_SCALED = ", ".join(f"round(coalesce(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0), 4) AS {c}" for c in _MEASURES)
SURVEYED = f"WITH RECURSIVE fh AS (SELECT group_id AS hub, {_FIRST} FROM grouped_hubs WHERE group_id IS NOT NULL GROUP BY 1), rs AS (SELECT hub, {_SCALED} FROM fh)"


def surveyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hub and its criteria, rounded to 4 digits."""
    h = table(spark, sf_dir, "grouped_hubs").where("group_id is not null")
    number = {c: F.regexp_count("node", F.lit(r"\d+")) if "node" in x else F.col(x) for c, x in _MEASURES.items()}
    first = h.groupBy(F.col("group_id").alias("hub")).agg(*(F.min_by(F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)), "hub_row").alias(c) for c, x in number.items()))
    first, _ = written(first)  # its ranges and its rows are read
    ends = first.agg(*(f(c).alias(f"{n}_{c}") for c in _MEASURES for n, f in (("min", F.min), ("max", F.max))))
    scaled = [F.round(F.coalesce(F.try_divide(F.col(c) - F.col(f"min_{c}"), F.col(f"max_{c}") - F.col(f"min_{c}")), F.lit(0.0)), 4).alias(c) for c in _MEASURES]
    return first.crossJoin(F.broadcast(ends)).select("hub", *scaled)


def _values(w: np.ndarray, name: str = "w", first: int = 0) -> str:
    """Draws as a table of SQL, exact to the last digit."""
    rows = ", ".join("(" + ", ".join([str(first + k), *(f"{x:.17e}" for x in r)]) + ")" for k, r in enumerate(w))
    return f"{name}(iteration, {', '.join(f'w{j}' for j in range(w.shape[1]))}) AS (VALUES {rows})"


@lru_cache(1)
def _draws() -> np.ndarray:
    return M.draw_weights(N)


@lru_cache(1)
def _w() -> str:
    return _values(_draws())


_DOT = " + ".join(f"{c} * w{j}" for j, c in enumerate(C.CRITERIA))


def _sim() -> str:
    return f"{SURVEYED}, {_w()}, sim AS (SELECT hub, iteration, {_DOT} AS score FROM rs CROSS JOIN w)"


def _ranks() -> str:
    return f"""{_sim()}, rk AS (SELECT *, row_number() OVER (PARTITION BY iteration ORDER BY score DESC, hub) AS rank FROM sim),
  st AS (SELECT hub, avg(rank) AS mean_rank, avg((rank <= 1)::INT) AS p_top1, avg((rank <= 3)::INT) AS p_top3, avg((rank <= 5)::INT) AS p_top5 FROM rk GROUP BY hub)"""


def _stats_sql() -> str:
    return f"""{_sim()}, st AS (SELECT hub, avg(score) AS mean, stddev_samp(score) AS std, min(score) AS min, max(score) AS max, quantile_cont(score, 0.05) AS p05, quantile_cont(score, 0.1) AS p10, quantile_cont(score, 0.25) AS p25,
  quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS p75, quantile_cont(score, 0.9) AS p90, quantile_cont(score, 0.95) AS p95 FROM sim GROUP BY hub)"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.simulated_distributions(surveyed(spark, sf_dir), "hub", C.CRITERIA, _draws())


def _rank_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.simulated_ranks(surveyed(spark, sf_dir), "hub", C.CRITERIA, _draws())


def _round(df: DataFrame, *columns: str) -> list:
    return [F.round(c, 4).alias(c) for c in columns]


_MEAN_W = ", ".join(f"avg(w{j}) AS m{j}" for j in range(N))
_MEAN_DOT = " + ".join(f"{c} * m{j}" for j, c in enumerate(C.CRITERIA))


@query(lambda: f"{SURVEYED}, {_w()}, mw AS (SELECT {_MEAN_W} FROM w) SELECT hub, round({_MEAN_DOT}, 4) AS final_score FROM rs CROSS JOIN mw")
def final_score_mc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over all draws, as one dot product with the mean weights."""
    return M.mean_score(surveyed(spark, sf_dir), C.CRITERIA, _draws()).select("hub", F.round("final_score", 4).alias("final_score"))


_A = ("mean", "std", "min", "max", "p05", "p10", "p25", "median", "p75", "p90", "p95")


@query(lambda: f"{_stats_sql()} SELECT hub, " + ", ".join(f"round({c}, 4) AS {c}" for c in _A) + ", round(p75 - p25, 4) AS iqr FROM st")
def mc_distribution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distribution of every hub's score over all draws."""
    s = _stats(spark, sf_dir)
    return s.select("hub", *_round(s, *_A, "iqr"))


@query(lambda: f"{_ranks()} SELECT hub, " + ", ".join(f"round({c}, 4) AS {c}" for c in ("mean_rank", "p_top1", "p_top3", "p_top5")) + " FROM st")
def mc_rank_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hub's mean rank and how often it leads, over all draws."""
    s = _rank_stats(spark, sf_dir)
    return s.select("hub", *_round(s, "mean_rank", "p_top1", "p_top3", "p_top5"))


@query(lambda: f"{_stats_sql()} SELECT hub, round(p10, 4) AS p10, rank() OVER (ORDER BY round(p10, 4) DESC)::BIGINT AS conservative_rank FROM st")
def mc_conservative_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _ = written(_stats(spark, sf_dir).select("hub", F.round("p10", 4).alias("p10")))
    return M.conservative_rank(s, 10).select("hub", "p10", "conservative_rank")


@query(lambda: f"{_ranks()} SELECT hub, round(p_top3, 4) AS p_top3 FROM st WHERE p_top3 >= 0.05")
def mc_robust_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.robust_winners(_rank_stats(spark, sf_dir), 3, 0.05).select("hub", F.round("p_top3", 4).alias("p_top3"))


@query(lambda: f"{_stats_sql()} SELECT hub, round(mean, 4) AS mean, rank() OVER (ORDER BY round(mean, 4) DESC)::BIGINT AS overall_rank_by_mean FROM st")
def mc_compare_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of all hubs by their means."""
    s, _ = written(_stats(spark, sf_dir).select("hub", F.round("mean", 4).alias("mean")))
    return C.global_rank(s, "mean", "overall_rank_by_mean").select("hub", "mean", "overall_rank_by_mean")


@query(lambda: f"{_stats_sql()} SELECT hub, round(mean, 4) AS mean, round(p05, 4) AS p05, round(p95, 4) AS p95 FROM st WHERE hub IN (SELECT hub FROM fh ORDER BY hub LIMIT 5)")
def mc_chosen_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distributions of hubs asked for by id: the first five."""
    ids = [r["hub"] for r in surveyed(spark, sf_dir).select("hub").orderBy("hub").limit(5).collect()]
    s, _ = written(_stats(spark, sf_dir))
    return M.chosen(s, "hub", ids).select("hub", *_round(s, "mean", "p05", "p95"))


_UNW = " UNION ALL ".join(f"SELECT '{c}' AS criterion, w{j} AS x FROM w" for j, c in enumerate(C.CRITERIA))


@query(lambda: f"WITH {_w()} SELECT criterion, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(min(x), 6) AS least, round(max(x), 6) AS most FROM ({_UNW}) GROUP BY criterion")
def mc_weight_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = M.weights_table(spark, _draws())
    long = w.select(F.inline(F.array(*(F.struct(F.lit(c).alias("criterion"), F.col(f"w{j}").alias("x")) for j, c in enumerate(C.CRITERIA)))))
    return long.groupBy("criterion").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.percentile("x", 0.5), 6).alias("median"), F.round(F.min("x"), 6).alias("least"), F.round(F.max("x"), 6).alias("most"))


def _raw_draws(rows: int) -> np.ndarray:
    """Uniform draws as the rejecting samplers take them, batch after batch."""
    rng = np.random.RandomState(S.MC_SEED)
    return np.concatenate([rng.rand(4 * RAW_DRAWS, N) for _ in range(-(-rows // (4 * RAW_DRAWS)))])


_EACH = ", ".join(f"w{j}" for j in range(N))
_TOTAL = " + ".join(f"w{j}" for j in range(N))
_NORMED = ", ".join(f"w{j} / ({_TOTAL}) AS w{j}" for j in range(N))


def _drawn_again(spark: SparkSession, sampler: str) -> DataFrame:
    w = M.weights_table(spark, M.draw_weights(N, RAW_DRAWS, sampler=sampler, top=S.MC_TOP))
    return w.select(F.col("iteration").cast("bigint").alias("iteration"), *(F.round(f"w{j}", 6).alias(f"w{j}") for j in range(N)))


def _kept_sql(over: str, under: str) -> str:
    pick = ", ".join(f"round(w{j}, 6) AS w{j}" for j in range(N))
    return f"WITH {_values(_raw_draws(64 * RAW_DRAWS), 'u')}, k AS ({over}), n AS (SELECT row_number() OVER (ORDER BY iteration) - 1 AS iteration, {_EACH} FROM ({under})) SELECT iteration, {pick} FROM n WHERE iteration < {RAW_DRAWS}"


@query(lambda: _kept_sql(f"SELECT * FROM u WHERE greatest({_EACH}) <= {S.MC_TOP}", f"SELECT iteration, {_NORMED} FROM k"))
def mc_reject_then_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws over the limit are drawn again, then normalised."""
    return _drawn_again(spark, "reject_norm")


@query(lambda: _kept_sql(f"SELECT iteration, {_NORMED} FROM u", f"SELECT * FROM k WHERE greatest({_EACH}) <= {S.MC_TOP}"))
def mc_rejection_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws are normalised, then those over the limit are drawn again."""
    return _drawn_again(spark, "norm_reject")


@query(lambda: f"{SURVEYED}, {_values(M.draw_weights(N, RAW_DRAWS))}, sim AS (SELECT hub, iteration, {_DOT} AS score FROM rs CROSS JOIN w) SELECT hub, iteration, round(score, 6) AS score, row_number() OVER (PARTITION BY iteration ORDER BY score DESC, hub) AS rank FROM sim")
def mc_raw_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw rows: every hub in every draw, with its rank there."""
    sim = M.simulate(surveyed(spark, sf_dir), "hub", C.CRITERIA, M.weights_table(spark, M.draw_weights(N, RAW_DRAWS)))
    return M.with_ranks(sim, "hub").select("hub", "iteration", F.round("score", 6).alias("score"), "rank")


# The same on the larger stand-in, whose draws are too many rows for SQL.


@query()
def final_score_mc_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mean_score(C.criteria(hubs(spark, sf_dir)), C.CRITERIA, _draws()).select("hub", F.round("final_score", 4).alias("final_score"))


@query()
def mc_distribution_stats_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    s = M.simulated_distributions(C.criteria(hubs(spark, sf_dir)), "hub", C.CRITERIA, _draws())
    return s.select("hub", *_round(s, *_A, "iqr"))


@query()
def mc_rank_robustness_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    h, _ = written(hubs(spark, sf_dir).drop("nodes", "transfers", "cust"), tidy=True)  # its ranges and its rows are read
    s = M.simulated_ranks(C.criteria(h), "hub", C.CRITERIA, _draws())
    return s.select("hub", *_round(s, "mean_rank", "p_top1", "p_top3", "p_top5"))


# expert judgements ------------------------------------------------------------------------------------

_LONG = """WITH good AS (SELECT expert, criterion_a AS a, criterion_b AS b, value AS v, comparison_id AS o FROM ahp_expert_comparisons
    WHERE expert IS NOT NULL AND criterion_a IS NOT NULL AND criterion_b IS NOT NULL AND criterion_a <> criterion_b AND value > 0 AND NOT isnan(value)),
  last AS (SELECT expert, least(a, b) AS i, greatest(a, b) AS j, arg_max(CASE WHEN a > b THEN 1 / v ELSE v END, o) AS v FROM good GROUP BY ALL),
  two AS (SELECT expert, i, j, v FROM last UNION ALL SELECT expert, j, i, 1 / v FROM last), m AS (SELECT * FROM two UNION ALL SELECT DISTINCT expert, i, i, 1.0::DOUBLE FROM two)"""
_GM = "g AS (SELECT expert, i, exp(avg(ln(v))) AS g FROM m GROUP BY ALL), gw AS (SELECT expert, i AS criterion, g / sum(g) OVER (PARTITION BY expert) AS weight FROM g)"


def _m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.matrices(table(spark, sf_dir, "ahp_expert_comparisons"), order="comparison_id")


@query(f"{_LONG} SELECT expert, i, j, round(v, 6) AS v FROM m")
def ahp_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _m(spark, sf_dir).select("expert", "i", "j", F.round("v", 6).alias("v"))


@query(f"{_LONG}, {_GM} SELECT expert, criterion, round(weight, 6) AS weight FROM gw")
def ahp_geometric_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.geometric_weights(_m(spark, sf_dir)).select("expert", "criterion", F.round("weight", 6).alias("weight"))


@query(f"""{_LONG}, c AS (SELECT *, v / sum(v) OVER (PARTITION BY expert, j) AS n FROM m), r AS (SELECT expert, i AS criterion, sum(n) AS s FROM c GROUP BY ALL)
  SELECT expert, criterion, round(s / sum(s) OVER (PARTITION BY expert), 6) AS weight FROM r""")
def ahp_column_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.column_weights(_m(spark, sf_dir)).select("expert", "criterion", F.round("weight", 6).alias("weight"))


_RI = " ".join(f"WHEN {n} THEN {r}" for n, r in S.RANDOM_INDEX.items())


@query(f"""{_LONG}, {_GM}, mw AS (SELECT m.expert, m.i, sum(m.v * gw.weight) AS mw FROM m JOIN gw ON gw.expert = m.expert AND gw.criterion = m.j GROUP BY ALL),
  l AS (SELECT mw.expert, count(*) AS n, avg(mw.mw / gw.weight) AS lm FROM mw JOIN gw ON gw.expert = mw.expert AND gw.criterion = mw.i GROUP BY ALL),
  c AS (SELECT *, CASE WHEN n > 1 THEN (lm - n) / (n - 1) ELSE 0 END AS ci, CASE n {_RI} ELSE 1.49 END::DOUBLE AS ri FROM l)
  SELECT expert, n::BIGINT AS n, round(lm, 4) AS lambda_max, round(CASE WHEN ri > 0 THEN ci / ri ELSE 0 END, 4)::DOUBLE AS cr, CASE WHEN ri > 0 THEN ci / ri ELSE 0 END <= 0.1 AS consistent FROM c""")
def ahp_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _m(spark, sf_dir)
    c = H.consistency(m, H.geometric_weights(m))
    return c.select("expert", F.col("n").cast("bigint").alias("n"), F.round("lambda_max", 4).alias("lambda_max"), F.round("cr", 4).alias("cr"), "consistent")


@query(f"{_LONG}, {_GM}, a AS (SELECT criterion, exp(avg(ln(weight + 1e-10))) AS g FROM gw GROUP BY 1) SELECT criterion, round(g / sum(g) OVER (), 6) AS weight FROM a")
def ahp_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.aggregate_experts(H.geometric_weights(_m(spark, sf_dir))).select("criterion", F.round("weight", 6).alias("weight"))


@query(f"{_LONG}, {_GM}, a AS (SELECT criterion, quantile_cont(weight, 0.5) AS g FROM gw GROUP BY 1) SELECT criterion, round(g / sum(g) OVER (), 6) AS weight FROM a")
def ahp_aggregate_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.aggregate_experts(H.geometric_weights(_m(spark, sf_dir)), "median").select("criterion", F.round("weight", 6).alias("weight"))


#: The matrix squared again and again: its columns turn into the eigenvector.
_EIGEN = """d AS (SELECT DISTINCT expert, i FROM m), full_m AS (SELECT a.expert, a.i, b.i AS j, coalesce(m.v, 0)::DOUBLE AS v FROM d a JOIN d b USING (expert) LEFT JOIN m ON m.expert = a.expert AND m.i = a.i AND m.j = b.i),
  sq(k, expert, i, j, v) AS (SELECT 0, expert, i, j, v FROM full_m UNION ALL SELECT k + 1, expert, i, j, x / max(x) OVER (PARTITION BY expert) FROM
    (SELECT a.k, a.expert, a.i, b.j, sum(a.v * b.v) AS x FROM sq a JOIN sq b ON a.expert = b.expert AND a.j = b.i WHERE a.k < 16 GROUP BY ALL)),
  rw AS (SELECT expert, i AS criterion, sum(v) AS s FROM sq WHERE k = 16 GROUP BY ALL)"""


@query(f"{_LONG.replace('WITH good', 'WITH RECURSIVE good')}, {_EIGEN} SELECT expert, criterion, round(s / sum(s) OVER (PARTITION BY expert), 6) AS weight FROM rw")
def ahp_eigen_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The principal eigenvector of every expert's matrix."""
    return H.priorities(_m(spark, sf_dir)).select("expert", "criterion", F.round("weight", 6).alias("weight"))


# The judgements of three experts, upper triangle in the order of the criteria.
EXAMPLE = {
    "transport_planner": (3, 5, 2, 4, 3, 0.5, 2, 0.333, 0.5, 2),
    "urban_economist": (1, 2, 0.5, 3, 2, 0.5, 3, 0.333, 2, 5),
    "accessibility_expert": (2, 1, 3, 5, 0.5, 2, 4, 4, 7, 3),
}
EXAMPLE_CRITERIA = ("activity", "service", "location", "pop_jobs", "terminal")


def _judgements() -> list[tuple[str, str, str, float]]:
    pairs = [(a, b) for k, a in enumerate(EXAMPLE_CRITERIA) for b in EXAMPLE_CRITERIA[k + 1 :]]
    return [(e, a, b, float(v)) for e, vs in EXAMPLE.items() for (a, b), v in zip(pairs, vs)]


def example(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_judgements(), "expert string, criterion_a string, criterion_b string, value double")


_JUDGED = "jd(expert, i, j, v) AS (VALUES " + ", ".join(f"('{e}', '{a}', '{b}', {v!r}::DOUBLE)" for e, a, b, v in _judgements()) + """),
  jm AS (SELECT * FROM jd UNION ALL SELECT expert, j, i, 1 / v FROM jd UNION ALL SELECT DISTINCT expert, unnest([i, j]), unnest([i, j]), 1.0::DOUBLE FROM jd),
  jg AS (SELECT expert, i, exp(avg(ln(v))) AS g FROM (SELECT DISTINCT * FROM jm) GROUP BY ALL), jw AS (SELECT expert, i, g / sum(g) OVER (PARTITION BY expert) AS w FROM jg),
  ja AS (SELECT i, exp(avg(ln(w + 1e-10))) AS g FROM jw GROUP BY 1), aw AS (SELECT """ + ", ".join(f"max(g) FILTER (i = '{c}') / sum(g) AS a{k}" for k, c in enumerate(EXAMPLE_CRITERIA)) + " FROM ja)"
_AHP_DOT = " + ".join(f"{c} * a{k}" for k, c in enumerate(C.CRITERIA))


def _both_sql() -> str:
    return f"{SURVEYED}, {_w()}, mw AS (SELECT {_MEAN_W} FROM w), {_JUDGED}, b AS (SELECT hub, round({_AHP_DOT}, 4) AS ahp, round({_MEAN_DOT}, 4) AS mc FROM rs CROSS JOIN mw CROSS JOIN aw)"


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hub, ahp, mc: the score by the experts' judgements and the mean over all Monte-Carlo draws."""
    scored = M.mean_score(surveyed(spark, sf_dir), C.CRITERIA, _draws(), "mc")
    judged, _ = O.ahp_run(scored, example(spark), dict(zip(EXAMPLE_CRITERIA, C.CRITERIA)), "geometric_mean")
    return written(judged.select("hub", F.round("ahp_score", 4).alias("ahp"), F.round("mc", 4).alias("mc")))[0]  # two rankings read it


@query(lambda: f"{_both_sql()} SELECT hub, ahp, rank() OVER (ORDER BY ahp DESC)::BIGINT AS ahp_rank FROM b")
def ahp_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.global_rank(_both(spark, sf_dir), "ahp", "ahp_rank").select("hub", "ahp", "ahp_rank")


@query(lambda: f"{_both_sql()}, r AS (SELECT *, rank() OVER (ORDER BY ahp DESC) AS ra, rank() OVER (ORDER BY mc DESC) AS rm FROM b) SELECT count(*)::BIGINT AS n, round(corr(ahp, mc), 4) AS score_correlation, round(corr(ra, rm), 4) AS rank_correlation, max(abs(ra - rm))::BIGINT AS largest_difference FROM r")
def mc_vs_ahp(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = C.global_rank(C.global_rank(_both(spark, sf_dir), "ahp", "ra"), "mc", "rm")
    return b.agg(
        F.count("*").alias("n"), F.round(F.corr("ahp", "mc"), 4).alias("score_correlation"), F.round(F.corr("ra", "rm"), 4).alias("rank_correlation"), F.max(F.abs(F.col("ra") - F.col("rm"))).alias("largest_difference")
    )


@query(lambda: f"{_both_sql()} SELECT hub FROM (SELECT hub FROM b ORDER BY ahp DESC, hub LIMIT 20) INTERSECT SELECT hub FROM (SELECT hub FROM b ORDER BY mc DESC, hub LIMIT 20)")
def top_n_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: what both lists of leaders hold."""
    b = _both(spark, sf_dir)
    first = lambda c: b.orderBy(F.desc(c), "hub").limit(20).select("hub")
    return first("ahp").intersect(first("mc"))


@query(lambda: f"{_both_sql()}, r AS (SELECT hub, abs(rank() OVER (ORDER BY ahp DESC) - rank() OVER (ORDER BY mc DESC))::BIGINT AS rank_diff FROM b) SELECT hub, rank_diff FROM r ORDER BY rank_diff DESC, hub LIMIT 10")
def largest_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report."""
    b = C.global_rank(C.global_rank(_both(spark, sf_dir), "ahp", "ra"), "mc", "rm")
    return b.select("hub", F.abs(F.col("ra") - F.col("rm")).alias("rank_diff")).orderBy(F.desc("rank_diff"), "hub").limit(10)


@query("SELECT 'expert_' || e AS expert, a.criterion AS criterion_a, b.criterion AS criterion_b, 1.0::DOUBLE AS value FROM ahp_criteria a JOIN ahp_criteria b ON a.criterion < b.criterion CROSS JOIN range(1, 4) t(e)")
def ahp_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.template(table(spark, sf_dir, "ahp_criteria"), 3)


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, '{v}')" for k, v in S.SAATY.items()) + ") t(value, meaning)")
def saaty_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(S.SAATY.items()), "value bigint, meaning string")


@query("""SELECT comparison_id, CASE WHEN s = 0 THEN 1.0 WHEN s > 0 THEN s + 1.0 ELSE 1.0 / (abs(s) + 1.0) END::DOUBLE AS value FROM (SELECT comparison_id, comparison_id % 17 - 8 AS s FROM ahp_expert_comparisons)""")
def slider_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "ahp_expert_comparisons")
    return c.select("comparison_id", rules.slider_to_saaty((F.col("comparison_id") % 17 - 8).cast("double")).alias("value"))
