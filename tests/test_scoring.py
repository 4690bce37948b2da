"""Worked example of five hubs, truth tables of tiers, ranks and sets, and normalisation rules."""

import pytest
from pyspark.sql import functions as F

from hubloom.functions import rules
from hubloom.functions import settings as S
from hubloom.operators import aggregate as A
from hubloom.operators import montecarlo as M
from hubloom.operators import score as C

N, M2, L = S.NATIONAL, S.METROPOLITAN, S.LOCAL
HUBS = [
    (1, N, "תל אביב", "גלעין", 150000.0, ["Rail", "Metro", "LRT", "BRT"], 12, [45000, 35000, 25000], [120000, 80000, 40000], True, "מתקן משולב"),
    (2, N, "ירושלים", "גלעין", 85000.0, ["Rail", "LRT", "BRT"], 8, [55000, 42000, 30000], [70000, 45000, 25000], True, "מסוף גדול"),
    (3, N, "חיפה", "גלעין", 60000.0, ["Rail", "Metro", "BRT"], 7, [38000, 28000, 20000], [55000, 35000, 18000], True, "מסוף גדול"),
    (4, M2, "תל אביב", "טבעת פנימית", 32000.0, ["Metro", "LRT"], 5, [60000, 48000, 35000], [40000, 25000, 12000], True, "מסוף בינוני"),
    (5, M2, "צפון", "גלעין", 18000.0, ["Rail", "LRT"], 4, [42000, 32000, 22000], [25000, 15000, 8000], False, None),
]
SCHEMA = "hub int, tier string, area string, location string, demand double, modes array<string>, lines int, " + ", ".join(f"{k}{i} double" for k in ("pop", "emp") for i in (1, 2, 3)) + ", near boolean, term_type string"


@pytest.fixture(scope="module")
def hubs(spark):
    return spark.createDataFrame([(*h[:7], *map(float, h[7]), *map(float, h[8]), *h[9:]) for h in HUBS], SCHEMA)


def test_criteria(hubs):
    want = {
        1: (10.00, 10.00, 1.00, 10.00, 10.00), 2: (4.4211, 1.0940, 10, 3.6248, 10), 3: (1, 1, 10, 1, 10), 4: (10, 10, 1, 10, 7), 5: (1, 1, 10, 1, 1),
    }
    for r in C.criteria(hubs).collect():
        assert [r[c] for c in C.CRITERIA] == pytest.approx(want[r.hub], abs=1e-4)


def test_raw_values(hubs):
    r = hubs.select("hub", rules.mode_service(F.col("modes"), F.col("lines")).alias("s"), rules.pop_jobs([F.col(f"pop{i}") for i in (1, 2, 3)], [F.col(f"emp{i}") for i in (1, 2, 3)], F.col("tier")).alias("p")).orderBy("hub").collect()
    assert [x.s for x in r] == pytest.approx([49.537, 31.353, 31.162, 19.132, 18.668], abs=1e-3)
    assert [x.p for x in r] == pytest.approx([95150.964, 60746.339, 46581.172, 39926.327, 25670.682], abs=1e-3)
    assert rules.ring_weights() == pytest.approx([0.780096, 0.150130, 0.069774], abs=1e-6)


def test_monte_carlo(hubs, spark):
    w = M.draw_weights(5)
    assert w.mean(axis=0) == pytest.approx([0.2009376, 0.1976472, 0.2003462, 0.2018120, 0.1992570], abs=1e-7)
    scored = C.ranked(M.mean_score(C.criteria(hubs), C.CRITERIA, w), "final_score", pool=C.scope("tier", "area"))
    got = {r.hub: (r.final_score, r["rank"]) for r in scored.collect()}
    assert [got[k][0] for k in range(1, 6)] == pytest.approx([8.1969, 5.8322, 4.5964, 7.5991, 2.8031], abs=1e-3)
    assert [got[k][1] for k in range(1, 6)] == [1, 2, 3, 1, 1]
    two = M.distributions(M.with_ranks(M.simulate(C.criteria(hubs), "hub", C.CRITERIA, M.weights_table(spark, w[:2000])), "hub"), "hub").orderBy("hub").collect()
    assert [r["std"] for r in two] == pytest.approx([1.0205, 1.0148, 1.2544, 0.9956, 1.0205], abs=0.05)
    assert sum(r.p_top1 for r in two) == pytest.approx(1)


@pytest.mark.parametrize("sampler", ["uniform_norm", "reject_norm", "norm_reject"])
def test_samplers(sampler):
    w = M.draw_weights(5, 500, sampler=sampler)
    assert w.shape == (500, 5) and w.sum(axis=1) == pytest.approx(1) and (w >= 0).all()
    if sampler == "norm_reject":
        assert w.max() <= 0.5


def test_sampler_errors():
    with pytest.raises(ValueError):
        M.draw_weights(5, sampler="x")
    with pytest.raises(ValueError):
        M.draw_weights(1, sampler="norm_reject")


@pytest.mark.parametrize(
    "modes, lines, demand, want",
    [
        (["HighSpeed Rail", "LRT"], 3, 50000.0, N), (["HighSpeed Rail", "LRT"], 3, 49999.0, M2), (["Interurban Rail"], 2, 90000.0, "Train Station"), (["Metro", "BRT"], 3, 10.0, M2), (["BRT", "LRT"], 3, 1000.0, L),
        (["BRT", "LRT"], 3, 999.0, "Not Hub"), (["BRT"], 2, 5000.0, "Not Hub"), (["Metro"], 2, 5000.0, "Not Hub"), (["Rail"], 3, 50000.0, N), (None, None, None, "Not Hub"), (["BRT", "LRT"], 3, float("nan"), "Not Hub"),
    ],
)
def test_tiers(spark, modes, lines, demand, want):
    df = spark.createDataFrame([(modes, lines, demand)], "m array<string>, l int, d double")
    assert df.select(rules.tier(F.col("m"), F.col("l"), F.col("d"))).first()[0] == want
    if want == M2 and demand < 5000:
        assert df.select(rules.tier(F.col("m"), F.col("l"), F.col("d"), 5000.0)).first()[0] == "Not Hub"


def test_rank_pools(spark):
    rows = [("a", M2, "x", 5.0), ("b", M2, "x", 5.0), ("c", M2, "x", 4.0), ("d", M2, "y", 1.0), ("e", M2, None, 9.0), ("f", "Train Station", "x", 8.0), ("g", N, "x", 3.0), ("h", N, "y", 2.0), ("i", N, "y", None)]
    df = spark.createDataFrame(rows, "id string, tier string, area string, s double")
    got = {r.id: r["rank"] for r in C.ranked(df, "s", pool=C.scope("tier", "area")).collect()}
    assert got == {"a": 1, "b": 1, "c": 3, "d": 1, "e": 1, "f": 2, "g": 1, "h": 2, "i": None}
    assert {r.id: r["rank"] for r in C.ranked(df, "s", pool=C.scope("tier", None)).collect()}["e"] == 1
    assert {r.id: r["rank"] for r in C.ranked(df, "s", pool=C.scope(None, None)).collect()}["d"] == 8
    assert {r.id: r.g for r in C.global_rank(df, "s", "g").collect()} == {"a": 3, "b": 3, "c": 5, "d": 8, "e": 1, "f": 2, "g": 6, "h": 7, "i": None}


def test_normalisation_edges(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 7.0), ("b", None), ("c", float("nan")), (None, 2.0)], "t string, v double")
    got = C.normalised(df, "s", F.col("v"), "t").collect()
    assert sorted((r.t or "", r.s) for r in got if r.s is not None) == [("a", 1.0), ("a", 10.0), ("b", 5.5), ("b", 5.5)]
    flat = spark.createDataFrame([(4.0,), (4.0,)], "v double")
    assert [r.s for r in C.normalised(flat, "s", F.col("v")).collect()] == [5.5, 5.5]
    assert C.normalised(df.limit(0), "s", F.col("v"), "t").count() == 0


def test_log_positive(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", 1000.0), ("a", 0.0), ("b", 0.0)], "t string, v double")
    assert sorted(r.s for r in C.log_positive(df, "s", F.col("v"), "t").collect()) == pytest.approx([-3.5, 1.0, 1.0, 10.0])


def test_sets_and_filter(spark):
    rows = [(1, 2000.0, ["Rail", "LRT"]), (2, 999.0, ["Rail", "LRT"]), (3, 2000.0, ["Rail", "Rail"]), (4, 2000.0, ["Suburban Rail", "LRT"]), (5, float("nan"), ["Rail", "LRT"]), (6, 2000.0, None), (7, None, ["Metro", "LRT"])]
    df = spark.createDataFrame(rows, "id int, d double, m array<string>")
    assert [r.id for r in A.filter_by_threshold_and_sets(df, "d", "m").collect()] == [1]
    assert {r.id for r in A.filter_by_threshold_and_sets(df, "none", "m").collect()} == {1, 2, 5, 7}


def test_histogram_and_summary(spark):
    df = spark.createDataFrame([("x", float(v)) for v in (0, 1, 2, 3, 10, 10)] + [(None, 5.0), ("x", None)], "t string, v double")
    assert {r.bin: r.n for r in C.histogram(df, "v", 5).collect()} == {0: 2, 1: 2, 2: 1, 4: 2}
    s = {(r.score, r.group): r for r in C.summary(df, ["v"], "t").collect()}
    assert s["v", "All"].n == 7 and s["v", None].n == 1 and s["v", "x"]["median"] == 2.5


def test_weights_and_candidates(spark):
    df = spark.createDataFrame([("Outer Ring", "South"), ("outer", "North x"), (None, None), ("?", "Beer Sheva")], "p string, a string")
    got = df.select(rules.first_contained(F.col("p"), S.POSITION_WEIGHTS, 1.5).alias("w"), rules.candidate_models(F.lit(None), F.col("a")).alias("m")).collect()
    assert [(r.w, r.m) for r in got] == [(2.0, ["BeerSheva", "Ashdod", "Ashkelon"]), (1.0, ["Haifa"]), (1.5, []), (1.5, ["BeerSheva"])]


def test_saaty(spark):
    df = spark.createDataFrame([(0.0,), (3.0,), (-3.0,)], "v double")
    got = [r.s for r in df.select(rules.slider_to_saaty(F.col("v")).alias("s")).collect()]
    assert got == [1.0, 4.0, 0.25]
    assert [r.s for r in spark.createDataFrame([(x,) for x in got], "v double").select(rules.saaty_to_slider(F.col("v")).alias("s")).collect()] == [0, 3, -3]


def test_even_lines_and_score(spark):
    df = spark.createDataFrame([(["Rail", "Interurban Rail", "LRT", "Bus"], 6), ([], 4), (["Bus"], 2)], "m array<string>, n int")
    cols = rules.mode_lines(F.col("m"), F.col("n"))
    got = df.select(*(c.alias(m) for m, c in cols.items()), rules.positive_count(cols.values()).alias("k"), rules.mode_score(cols).alias("s")).collect()
    assert got[0]["Interurban Rail"] == 2 and got[0]["LRT"] == 2 and got[0].k == 2 and got[0].s == pytest.approx((2 * 7 + 2 * 5) * 1.1)
    assert got[1].k == 0 and got[2].s == 0


def test_merge_groups(spark):
    rows = [(1, 2, "Unknown", 1.0, ["b"]), (1, 1, None, float("nan"), ["a", "b"]), (1, 3, "Haifa", 2.0, None), (None, 4, "x", 1.0, ["z"])]
    df = spark.createDataFrame(rows, "g int, o int, area string, d double, l array<string>")
    r = A.merge_groups(df, "g", "o", lists=["l", "missing"], sums=["d"], firsts=["area"]).collect()
    assert len(r) == 1 and (r[0].l, r[0].d, r[0].area, r[0].n_rows) == (["a", "b"], 3.0, "Haifa", 3)


def test_decisions(spark):
    stats = spark.createDataFrame([("a", 3.0, 0.6), ("b", 2.0, 0.2), ("c", 3.0, 0.1)], "id string, p10 double, p_top3 double")
    assert {r.id: r.conservative_rank for r in M.conservative_rank(stats).collect()} == {"a": 1, "c": 1, "b": 3}
    assert [r.id for r in M.robust_winners(stats).collect()] == ["a"]
    assert {r.id for r in M.chosen(stats, "id", ["a", "c"]).collect()} == {"a", "c"}
    for bad in (lambda: M.robust_winners(stats, 2), lambda: M.conservative_rank(stats, 50)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        M.chosen(stats, "id", ["zz"])
