"""Queries on tiers, criterion scores, ranks and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubloom.functions import rules
from hubloom.functions import settings as S
from hubloom.operators import score as C
from hubloom.plans.analog import HUB, case_weights, hubs, tier_sql, values
from hubloom.plans.registry import Registry
from hubloom.session import written

query = Registry()
queries, oracle_sql = query.queries, query.oracle_sql
TIER_ROWS = values({k: v[0] for k, v in S.TIERS.items()}, "tr")
TIER_CODES = values({k: v[1] for k, v in S.TIERS.items()}, "tc")


def mm(v: str, over: str = "", clip: bool = True) -> str:
    """SQL of a value scaled to 1..10 over a window."""
    lo, hi = f"min({v}) OVER ({over})", f"max({v}) OVER ({over})"
    scaled = f"1 + ({v} - {lo}) * 9 / nullif({hi} - {lo}, 0)"
    if clip:
        scaled = f"CASE WHEN {v} IS NOT NULL THEN least(10, greatest(1, {scaled})) END"
    return f"(CASE WHEN {lo} = {hi} THEN 5.5 ELSE {scaled} END)::DOUBLE"


PER_TIER = "PARTITION BY tier"
SERVICE = (
    "(list_sum(list_transform(modes, lambda m: CASE m " + " ".join(f"WHEN '{m}' THEN {w}" for m, w in S.MODE_WEIGHTS.items()) + " ELSE 1.0 END))::DOUBLE"
    " * sqrt(greatest(1, lines::DOUBLE / len(modes))) * CASE WHEN len(modes) > 1 THEN 1 + 0.1 * (len(modes) - 1) ELSE 1 END)::DOUBLE"
)
PLACE = f"({case_weights('area', S.REGION_WEIGHTS, 0.5)} * {case_weights('location', S.POSITION_WEIGHTS, 1.5)})"
TERMINAL = f"(CASE WHEN near THEN {case_weights('term_type', S.TERMINAL_WEIGHTS, 1.0)} ELSE 0 END)::DOUBLE"
_W = rules.ring_weights()
_JOB = f"CASE WHEN tier = '{S.LOCAL}' THEN 0.2 ELSE 0.8 END"
POP = "(" + " + ".join(f"(pop{i} * (1 - {_JOB}) + emp{i} * {_JOB}) * {w!r}::DOUBLE" for i, w in zip((1, 2, 3), _W)) + ")::DOUBLE"
LOG = "log10(CASE WHEN demand <= 0 THEN 1 ELSE demand END)"
RAW = f"{HUB}, raw AS (SELECT *, {LOG} AS act, {SERVICE} AS srv, {PLACE} AS loc, {POP} AS pj, {TERMINAL} AS ter FROM hub)"
SCORED = f"""{RAW}, scored AS (SELECT hub, tier, area, demand, {mm('act', PER_TIER)} AS activity_score, {mm('srv', PER_TIER)} AS service_score, {mm('loc')} AS location_score,
  {mm('pj', PER_TIER)} AS pop_jobs_score, CASE WHEN max(ter) OVER () > 0 THEN {mm('ter')} ELSE 1 END AS terminal_score FROM raw)"""


@query(f"{HUB} SELECT hub, lines, len(modes)::BIGINT AS n_modes, tier FROM hub")
def hub_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hubs(spark, sf_dir).select("hub", "lines", F.size("modes").cast("bigint").alias("n_modes"), "tier")


@query(f"{HUB} SELECT hub, {tier_sql(5000)} AS tier2 FROM hub")
def hub_tiers_min_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hubs(spark, sf_dir).select("hub", rules.tier(F.col("modes"), F.col("lines"), F.col("demand"), 5000.0).alias("tier2"))


@query(f"{HUB} SELECT hub, CASE WHEN demand >= 50000 THEN '{S.NATIONAL}' WHEN demand >= 5000 THEN '{S.METROPOLITAN}' ELSE '{S.LOCAL}' END AS tier FROM hub")
def tier_from_ridership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hubs(spark, sf_dir).select("hub", rules.tier_from_ridership(F.col("demand")).alias("tier"))


@query(f"{HUB} SELECT hub, tr.v AS tier_en, tc.v::BIGINT AS tier_code FROM hub LEFT JOIN {TIER_ROWS} ON tr.k = tier LEFT JOIN {TIER_CODES} ON tc.k = tier")
def tier_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("tier")
    return hubs(spark, sf_dir).select("hub", rules.lookup({k: v[0] for k, v in S.TIERS.items()}, t).alias("tier_en"), rules.lookup({k: v[1] for k, v in S.TIERS.items()}, t).cast("bigint").alias("tier_code"))


@query(f"{HUB} SELECT hub, lines FROM hub WHERE tier = '{S.NATIONAL}'")
def filter_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hubs(spark, sf_dir).where(F.col("tier") == S.NATIONAL).select("hub", "lines")


@query(f"""{HUB} SELECT tier, count(*)::BIGINT AS n, round(100 * count(*) / (SELECT count(*) FROM hub), 4) AS percent, round(sum(demand), 2) AS total, round(avg(demand), 4) AS mean,
  round(min(demand), 4) AS least, round(max(demand), 4) AS most, round(avg(len(modes)), 4) AS mean_modes, round(avg(lines), 4) AS mean_lines FROM hub GROUP BY tier""")
def tier_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hubs(spark, sf_dir)
    per = h.groupBy("tier").agg(
        F.count("*").alias("n"), F.sum("demand").alias("total"), F.avg("demand").alias("mean"), F.min("demand").alias("least"), F.max("demand").alias("most"),
        F.avg(F.size("modes")).alias("mean_modes"), F.avg("lines").alias("mean_lines"),
    )
    return per.crossJoin(F.broadcast(per.agg(F.sum("n").alias("_all")))).select(
        "tier", "n", F.round(100 * F.col("n") / F.col("_all"), 4).alias("percent"), F.round("total", 2).alias("total"), *(F.round(c, 4).alias(c) for c in ("mean", "least", "most", "mean_modes", "mean_lines"))
    )


def _one(name: str, sql: str, raw: str = HUB) -> str:
    return f"{raw} SELECT hub, round({sql}, 4) AS {name} FROM {'hub' if raw == HUB else 'raw'}"


@query(_one("score", mm("demand")))
def minmax_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.normalised(hubs(spark, sf_dir), "score", F.col("demand")).select("hub", F.round("score", 4).alias("score"))


@query(_one("score", mm("demand", PER_TIER)))
def minmax_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.normalised(hubs(spark, sf_dir), "score", F.col("demand"), "tier").select("hub", F.round("score", 4).alias("score"))


@query(_one("score", mm(LOG)))
def log10_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.normalised(hubs(spark, sf_dir), "score", rules.log10_or_zero(F.col("demand"))).select("hub", F.round("score", 4).alias("score"))


@query(_one("score", mm(LOG, PER_TIER)))
def log10_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.normalised(hubs(spark, sf_dir), "score", rules.log10_or_zero(F.col("demand")), "tier").select("hub", F.round("score", 4).alias("score"))


_TL = "CASE WHEN transfers > 0 THEN log10(transfers) WHEN transfers = 0 THEN 0 END"


@query(f"""{HUB}, l AS (SELECT hub, tier, {_TL} AS l FROM hub), r AS (SELECT *, min(CASE WHEN l > 0 THEN l END) OVER ({PER_TIER}) AS a, max(CASE WHEN l > 0 THEN l END) OVER ({PER_TIER}) AS b FROM l)
  SELECT hub, round(CASE WHEN a IS NULL THEN 1 WHEN a = b THEN 5.5 ELSE 1 + (l - a) * 9 / (b - a) END, 4)::DOUBLE AS score FROM r""")
def log_positive_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.log_positive(hubs(spark, sf_dir), "score", F.col("transfers"), "tier").select("hub", F.round("score", 4).alias("score"))


@query(_one("score", mm("demand", PER_TIER, clip=False)))
def minmax_by_tier_unclipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.normalised(hubs(spark, sf_dir), "score", F.col("demand"), "tier", clip=False).select("hub", F.round("score", 4).alias("score"))


@query(f"{HUB} SELECT hub, round({SERVICE}, 4) AS service FROM hub")
def service_score_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hubs(spark, sf_dir).select("hub", F.round(rules.mode_service(F.col("modes"), F.col("lines")), 4).alias("service"))


def _score(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return C.criteria(hubs(spark, sf_dir)).select("hub", F.round(name, 4).alias(name))

    run.__name__ = name
    return query(f"{SCORED} SELECT hub, round({name}, 4) AS {name} FROM scored")(run)


for _name in C.CRITERIA:
    _score(_name)


@query(f"""{HUB} SELECT hub, (CASE WHEN contains(area, 'Tel Aviv') THEN 0 ELSE 1 END * CASE WHEN contains(location, 'Core') THEN 3 WHEN contains(location, 'Ring') THEN 2 ELSE 1 END)::BIGINT AS region_location FROM hub""")
def region_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.coalesce(rules.region_category(F.col("area")), F.lit(1)) * F.coalesce(rules.location_category(F.col("location")), F.lit(1))
    return hubs(spark, sf_dir).select("hub", both.cast("bigint").alias("region_location"))


@query(f"""{HUB}, n AS (SELECT hub, (demand - min(demand) OVER ()) / (max(demand) OVER () - min(demand) OVER ()) AS d, (pop1 - min(pop1) OVER ()) / (max(pop1) OVER () - min(pop1) OVER ()) AS p FROM hub)
  SELECT hub, round((d + p) / 2, 4) AS combined FROM n ORDER BY (d + p) / 2 DESC, hub LIMIT 20""")
def combined_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: two measures scaled to 0..1 and averaged."""
    h = C.with_range(C.with_range(hubs(spark, sf_dir), F.col("demand"), None, "d"), F.col("pop1"), None, "p")
    both = [F.try_divide(F.col(f"{c}_v") - F.col(f"{c}_min"), F.col(f"{c}_max") - F.col(f"{c}_min")) for c in ("d", "p")]
    return h.withColumn("c", (both[0] + both[1]) / 2).orderBy(F.desc("c"), "hub").limit(20).select("hub", F.round("c", 4).alias("combined"))


FIFTH = "(activity_score + service_score + location_score + pop_jobs_score + terminal_score) / 5"
_SCOPE = f"CASE WHEN tier = '{S.NATIONAL}' THEN tier WHEN tier IN ('{S.METROPOLITAN}', '{S.LOCAL}') AND area IS NOT NULL THEN tier || '/' || area ELSE 'rest' END"


def _final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.criteria(hubs(spark, sf_dir)).withColumn("final", F.round(C.weighted(C.CRITERIA, [0.2] * 5), 4))


FINAL = f"{SCORED}, f AS (SELECT *, round({FIFTH}, 4) AS final FROM scored)"


@query(f"{FINAL} SELECT hub, final, rank() OVER (PARTITION BY {_SCOPE} ORDER BY final DESC)::BIGINT AS rank FROM f")
def tier_area_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ranked(_final(spark, sf_dir), "final", pool=C.scope("tier", "area")).select("hub", "final", "rank")


@query(f"{FINAL} SELECT hub, dense_rank() OVER (PARTITION BY tier ORDER BY final DESC)::BIGINT AS in_tier, dense_rank() OVER (ORDER BY final DESC)::BIGINT AS overall FROM f")
def dense_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, _ = written(_final(spark, sf_dir).select("hub", "tier", "final"))
    return C.ranked(C.global_rank(f, "final", "overall", dense=True), "final", "in_tier", F.col("tier"), "dense").select("hub", "in_tier", "overall")


@query(f"{FINAL} SELECT hub, final FROM f ORDER BY final DESC, hub LIMIT 10")
def top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report."""
    return _final(spark, sf_dir).orderBy(F.desc("final"), "hub").limit(10).select("hub", "final")


@query(f"{FINAL} SELECT hub, final FROM f ORDER BY final, hub LIMIT 10")
def bottom10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bottom-k report."""
    return _final(spark, sf_dir).orderBy("final", "hub").limit(10).select("hub", "final")


@query(f"{FINAL} SELECT tier, hub, final FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY final DESC, hub) AS n FROM f) WHERE n <= 5")
def top_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top_per_group(_final(spark, sf_dir), "tier", "final", "hub", 5).select("tier", "hub", "final")


@query(f"""{SCORED}, u AS (UNPIVOT scored ON activity_score, service_score, location_score, pop_jobs_score, terminal_score INTO NAME score VALUE v)
  SELECT score, g AS "group", round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS median, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS least, round(max(v), 4) AS most, count(v)::BIGINT AS n
  FROM (SELECT score, v, tier AS g FROM u UNION ALL SELECT score, v, 'All' FROM u) GROUP BY score, g""")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.summary(C.criteria(hubs(spark, sf_dir)), C.CRITERIA, "tier")
    return s.select("score", "group", *(F.round(c, 4).alias(c) for c in ("mean", "median", "std", "least", "most")), "n")


@query(f"{FINAL}, r AS (SELECT final, min(final) OVER () AS a, max(final) OVER () AS b FROM f) SELECT least(floor((final - a) / ((b - a) / 20)), 19)::BIGINT AS bin, count(*)::BIGINT AS n FROM r GROUP BY 1")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.histogram(_final(spark, sf_dir), "final", 20)


@query(f"{FINAL} SELECT tier, count(*)::BIGINT AS n, round(avg(demand), 4) AS mean_demand, round(sum(demand), 2) AS total_demand, avg(final) IS NOT NULL AS scored, min(final) AS least, max(final) AS most FROM f GROUP BY tier")
def summary_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _final(spark, sf_dir).groupBy("tier").agg(
        F.count("*").alias("n"), F.round(F.avg("demand"), 4).alias("mean_demand"), F.round(F.sum("demand"), 2).alias("total_demand"), F.avg("final").isNotNull().alias("scored"), F.min("final").alias("least"), F.max("final").alias("most")
    )


@query(f"{FINAL} SELECT hub, CASE WHEN final >= 7 THEN 'red' WHEN final >= 4 THEN 'orange' ELSE 'green' END AS band FROM f")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _final(spark, sf_dir).select("hub", rules.score_band(F.col("final")).alias("band"))


@query(f"{HUB} SELECT hub, contains(area, 'Tel Aviv') AND coalesce(transfers / nullif(demand, 0), 1) < 0.8 AND lines <= 2 AS flagged FROM hub")
def flag_low_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boolean column of three conditions, with defaults for missing values."""
    f = F.col("area").rlike("(?i)tlv|tel aviv|center|מרכז") & (F.coalesce(F.try_divide("transfers", "demand"), F.lit(1.0)) < 0.8) & (F.coalesce("lines", F.lit(10)) <= 2)
    return hubs(spark, sf_dir).select("hub", f.alias("flagged"))
