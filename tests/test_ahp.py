import pytest
from pyspark.sql import functions as F

from hubloom.operators import ahp as H
from hubloom.plans.simulation import EXAMPLE_CRITERIA, example

WEIGHTS = {
    "transport_planner": ((0.424635, 0.165510, 0.066764, 0.235221, 0.107871), 0.017734),
    "urban_economist": ((0.212200, 0.212200, 0.119410, 0.386852, 0.069337), 0.003845),
    "accessibility_expert": ((0.313139, 0.181139, 0.352836, 0.105175, 0.047710), 0.011859),
}


def by_expert(weights):
    out = {}
    for r in weights.collect():
        out.setdefault(r.expert, {})[r.criterion] = r.weight
    return out


def test_eigenvectors_and_consistency(spark):
    m = H.matrices(example(spark))
    w = H.priorities(m)
    got = by_expert(w)
    cr = {r.expert: r for r in H.consistency(m, w).collect()}
    for e, (want, ratio) in WEIGHTS.items():
        assert [got[e][c] for c in EXAMPLE_CRITERIA] == pytest.approx(want, abs=1e-6)
        assert cr[e].cr == pytest.approx(ratio, abs=1e-5) and cr[e].consistent
    a = {r.criterion: r.weight for r in H.aggregate_experts(w).collect()}
    assert [a[c] for c in EXAMPLE_CRITERIA] == pytest.approx([0.333033, 0.202698, 0.154421, 0.232256, 0.077592], abs=1e-5)


@pytest.mark.parametrize("method", ["geometric_mean", "normalized_column"])
def test_methods_agree_for_consistent_experts(spark, method):
    got = by_expert(H.priorities(H.matrices(example(spark)), method))
    for e, (want, _) in WEIGHTS.items():
        assert [got[e][c] for c in EXAMPLE_CRITERIA] == pytest.approx(want, abs=0.02) and sum(got[e].values()) == pytest.approx(1)


@pytest.mark.parametrize("how", ["arithmetic_mean", "median"])
def test_aggregates(spark, how):
    assert sum(r.weight for r in H.aggregate_experts(H.geometric_weights(H.matrices(example(spark))), how).collect()) == pytest.approx(1)


def test_errors(spark):
    m = H.matrices(example(spark))
    with pytest.raises(ValueError):
        H.priorities(m, "x")
    with pytest.raises(ValueError):
        H.aggregate_experts(m, "x")


def test_bad_rows(spark):
    rows = [("e", "a", "b", 0.0, 1), ("e", "a", "a", 2.0, 2), (None, "a", "b", 2.0, 3), ("e", None, "b", 2.0, 4), ("e", "a", "b", float("nan"), 5), ("e", "a", "b", 3.0, 6), ("e", "b", "a", 0.5, 7)]
    m = H.matrices(spark.createDataFrame(rows, "expert string, criterion_a string, criterion_b string, value double, n int"), order="n")
    assert {(r.i, r.j): r.v for r in m.collect()} == {("a", "b"): 2.0, ("b", "a"): 0.5, ("a", "a"): 1.0, ("b", "b"): 1.0}
    assert H.matrices(example(spark).limit(0)).count() == 0


def test_invalid_pairs(spark):
    long = spark.createDataFrame([("e", "a", "b", 2.0), ("e", "b", "a", 0.5), ("e", "a", "c", 2.0), ("e", "c", "a", 0.9), ("e", "b", "b", 2.0), ("e", "b", "c", 1.0)], "expert string, i string, j string, v double")
    assert {(r.i, r.j) for r in H.invalid_pairs(long).collect()} == {("a", "c"), ("c", "a"), ("b", "b"), ("b", "c")}


def test_template_and_long_format(spark):
    c = spark.createDataFrame([(x,) for x in "abc"], "criterion string")
    assert H.template(c, 2).count() == 6
    matrix = spark.createDataFrame([("a", 1.0, 2.0), ("b", 0.5, 1.0)], "n string, a double, b double")
    assert {(r.i, r.j): r.v for r in H.long_format(matrix, "n").collect()} == {("a", "a"): 1, ("a", "b"): 2, ("b", "a"): 0.5, ("b", "b"): 1}
    assert matrix.select(F.col("n")).count() == 2
