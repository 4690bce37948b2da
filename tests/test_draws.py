import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hubloom.functions import settings as S
from hubloom.operators import montecarlo as M

COLUMNS = ("a", "b", "c")


def test_block_form_is_the_row_form(spark):
    """Ties and a null score among them."""
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, rng.integers(1, 5, 3))) for i in range(60)] + [(99, None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    w = M.draw_weights(3, 40)
    want = {r.id: r for r in M.distributions(M.with_ranks(M.simulate(df, "id", COLUMNS, M.weights_table(spark, w)), "id"), "id").collect()}
    ranks = {r.id: r for r in M.simulated_ranks(df, "id", COLUMNS, w, blocks=7).collect()}
    stats = {r.id: r for r in M.simulated_distributions(df, "id", COLUMNS, w, rows=16).collect()}
    assert set(want) == set(ranks) == set(stats) == {r[0] for r in rows}
    for i, r in want.items():
        assert [ranks[i][c] for c in ("mean_rank", "p_top1", "p_top3", "p_top5")] == pytest.approx([r[c] for c in ("mean_rank", "p_top1", "p_top3", "p_top5")])
        for c in ("mean", "std", "min", "max", "p05", "p10", "p25", "median", "p75", "p90", "p95", "iqr"):
            assert (stats[i][c] is None and r[c] is None) if i == 99 else stats[i][c] == pytest.approx(r[c], abs=1e-9), c


def test_production_draws(spark, monkeypatch):
    """Every hub in every one of the draws that the settings name."""
    from hubloom.plans import simulation

    hub = spark.createDataFrame([(1, 2.0), (2, 1.0)], "hub long, s double")
    monkeypatch.setattr(simulation, "hubs", lambda *_: hub)
    monkeypatch.setattr(simulation.C, "criteria", lambda h: h.select("hub", *(F.col("s").alias(c) for c in simulation.C.CRITERIA)))
    q = entry.queries()
    assert {r.hub: (r.mean_rank, r.p_top1) for r in q["mc_rank_robustness_full"](spark, "").collect()} == {1: (1.0, 1.0), 2: (2.0, 0.0)}


def test_rows_are_not_copied_for_the_blocks(spark):
    df = spark.createDataFrame([(i, float(i % 7), 1.0, 2.0) for i in range(50)], "id long, a double, b double, c double")
    out = M.simulated_ranks(df, "id", COLUMNS, M.draw_weights(3, 20), blocks=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and plan.count("Exchange") == 1 and "_block" not in plan[: plan.index("Exchange")]
    assert out.count() == 50


def test_packed_order_is_the_sorted_one():
    rng = np.random.default_rng(2)
    for n in (1, 2, 70, 70_000):
        for s in (rng.random(n), rng.integers(0, 5, n) / 3, np.ones(n), 1 + rng.integers(0, 9, n) * 1e-16, np.append(rng.random(n - 1) * 1e-15, 10.0)):
            assert (M._falling(s, np.empty(n, np.int64)) == np.argsort(-s, kind="stable")).all()
