import numpy as np
import pytest

from hubloom.llm.ranking import rank_items

ITEMS = "item string, rank string"
ROWS = "a string, b string, value double, expert string, strength string"


def run(spark, items, rows, **kw):
    i = spark.createDataFrame([(x, "clash") for x in items], ITEMS)
    r = spark.createDataFrame([(*x, "clash") for x in rows], ROWS)
    return {x.item: x for x in rank_items(r, i, expert="expert", **kw).collect()}


def test_odds(spark):
    rows = [("x", "y", 3.0, f"e{k}") for k in range(200)]
    got = run(spark, ["x", "y", "z"], rows, smoothing=1e-6)
    assert got["x"].strength / got["y"].strength == pytest.approx(3, rel=0.01)
    assert [got[k].rank for k in ("x", "z", "y")] == [1, 2, 3] and got["z"].n_votes == 0 and got["x"].n_opponents == 1
    assert sum(r.strength for r in got.values()) == pytest.approx(1)


def simulated(n=12, experts=15, per=200, seed=5):
    rng = np.random.default_rng(seed)
    names = [f"c_{k:02d}" for k in range(n)]
    s = np.exp(rng.normal(0, 1, n))
    weight = rng.dirichlet(np.full(n, 0.5))
    rows = []
    for e in range(experts):
        for _ in range(per):
            i, j = rng.choice(n, 2, replace=False, p=weight * 0.9 + 0.1 / n)
            v = s[i] / s[j] * np.exp(rng.normal(0, 0.3 + (e % 5 == 0) * 3))
            rows.append((names[i], names[j], float(np.clip(v, 1 / 9, 9)), f"e{e}"))
    return names, s, rows


def test_recovers_order(spark):
    names, s, rows = simulated()
    got = run(spark, names, rows)
    est = np.array([got[x].strength for x in names])
    assert np.corrcoef(np.argsort(np.argsort(est)), np.argsort(np.argsort(s)))[0, 1] > 0.95


def test_cluster_walk_gives_the_same(spark):
    rows = [("p", "q", 2.0, "e"), ("q", "r", 2.0, "e"), ("p", "r", 5.0, "f")]
    one, many = run(spark, ["p", "q", "r"], rows), run(spark, ["p", "q", "r"], rows, one_task=0, tolerance=1e-9)
    for k in one:
        assert many[k].strength == pytest.approx(one[k].strength, rel=1e-7) and many[k].rank == one[k].rank


@pytest.mark.parametrize("one_task", [2_000, 0])
def test_a_walk_that_has_not_converged_raises(spark, one_task):
    with pytest.raises(Exception, match="has not converged"):
        run(spark, ["p", "q"], [("p", "q", 2.0, "e")], one_task=one_task, steps=2)


def test_scale(spark):
    rows = [("p", "q", 50.0, "e")]
    assert run(spark, ["p", "q"], rows)["p"].n_votes == 0
    assert run(spark, ["p", "q"], rows, scale=None)["p"].n_votes == run(spark, ["p", "q"], rows, scale=60.0)["p"].n_votes == 1


def brute(names, pairs, smoothing=1.0):
    """Stationary distribution of the continuous walk, by linear algebra."""
    n = len(names) + 1
    q = np.zeros((n, n))
    for (i, j), (wi, wj) in pairs.items():
        q[i, j] += wj
        q[j, i] += wi
    q[: n - 1, n - 1] += smoothing / 2
    q[n - 1, : n - 1] += smoothing / 2
    q -= np.diag(q.sum(1))
    a = np.vstack([q.T, np.ones(n)])
    p = np.linalg.lstsq(a, np.r_[np.zeros(n), 1], rcond=None)[0][:-1]
    return p / p.sum()


def test_matches_linear_algebra(spark):
    rows = [("p", "q", 2.0, "e"), ("q", "r", 3.0, "f"), ("r", "p", 4.0, "g")]
    got = run(spark, ["p", "q", "r", "s"], rows)
    want = brute(["p", "q", "r", "s"], {(0, 1): (2 / 3, 1 / 3), (1, 2): (3 / 4, 1 / 4), (2, 0): (4 / 5, 1 / 5)})
    assert [got[k].strength for k in "pqrs"] == pytest.approx(list(want), rel=1e-6)


def test_bad_rows_names_and_ties(spark):
    nan = float("nan")
    rows = [("A b", "a_B", 3.0, "e"), ("a_b", "c", nan, "e"), ("a_b", "c", None, "e"), ("a_b", "c", -1.0, "e"), ("a_b", "c", 0.0, "e"), ("a_b", "c", 99.0, "e"), (None, "c", 2.0, "e"), ("a_b", "unknown", 2.0, "e")]
    got = run(spark, ["a_b", "c", None, "A B"], rows)
    assert {k: (r.rank, r.n_votes) for k, r in got.items()} == {"A B": (1, 0), "c": (2, 0)}
    again = run(spark, ["a_b", "c"], [("A B", " c", 3.0, None), ("c", "a b", 1 / 3, None), ("a_b", "c", 3.0, None)])
    assert again["a_b"].rank == 1 and again["a_b"].n_votes == 1


def test_empty(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [], [], one_task=-1) == {}
    got = run(spark, ["a", "b"], [])
    assert [got[k].strength for k in "ab"] == [pytest.approx(0.5)] * 2
