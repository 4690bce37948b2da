import itertools

import numpy as np
import pytest

from hubloom.llm.mixing import fit_counts, knapsack, mix


@pytest.mark.parametrize("seed", range(40))
def test_knapsack_matches_brute_force(seed):
    rng = np.random.default_rng(seed)
    k = int(rng.integers(1, 5))
    lengths, counts, budget = rng.choice(np.arange(1, 30), k, replace=False).tolist(), rng.integers(0, 4, k).tolist(), int(rng.integers(0, 60))
    best = max(s for s in (sum(a * n for a, n in zip(x, lengths)) for x in itertools.product(*(range(c + 1) for c in counts))) if s <= budget)
    got = knapsack(lengths, counts, budget)
    assert sum(n * length for length, n in got.items()) == best and all(n <= counts[lengths.index(length)] for length, n in got.items())


@pytest.mark.parametrize("seed", range(20))
def test_counts_stay_within_budget(seed):
    rng = np.random.default_rng(seed)
    k = int(rng.integers(1, 40))
    lengths = np.sort(rng.choice(np.arange(1, 3000), k, replace=False))
    counts = rng.integers(1, 60, k)
    budget = int(rng.integers(0, (lengths * counts).sum() + 1))
    take = fit_counts(lengths, counts, budget, most=5000, room=500)
    assert (take >= 0).all() and (take <= counts).all() and (take * lengths).sum() <= budget


def test_lengths_are_taken_alike():
    lengths, counts = np.arange(1, 2001), np.ones(2000, dtype=int)
    take = fit_counts(lengths, counts, int(lengths.sum()) // 4)
    assert (take * lengths).sum() == int(lengths.sum()) // 4
    assert 0.15 < take[:1000].mean() < 0.35 and 0.15 < take[1000:].mean() < 0.35


DOCS = "doc_id long, text string, source string, n_tokens string, take string, h string"
TARGETS = "source string, target_share double, max_repeats int, tokens string"


def run(spark, docs, targets, **kw):
    d = spark.createDataFrame([(*x, "c", "c", "c") for x in docs], DOCS)
    t = spark.createDataFrame([(*x, "c") for x in targets], TARGETS)
    chosen, report = mix(d, t, **kw)
    return chosen.collect(), {r.source: r for r in report.collect()}


def test_shares_and_repeats(spark):
    rng = np.random.default_rng(6)
    docs = [(i, "w " * int(rng.integers(1, 40)), s) for i, s in enumerate(["big"] * 300 + ["Small "] * 20 + ["other"] * 9 + [None] * 3)]
    docs += [(900, None, "big"), (901, "", "big"), (None, "a b", "big"), (1, "a b", "small")]
    chosen, report = run(spark, docs, [("big", 0.6, 2), ("SMALL", 0.3, 3), ("gone", 0.1, 2), (None, 0.1, 1), ("zero", 0.0, 1)])
    small = report["small"]
    assert small.tokens_used == small.tokens * 3  # the source that sets the total
    assert report["big"].actual_share == pytest.approx(2 / 3, abs=0.002) and small.actual_share == pytest.approx(1 / 3, abs=0.002)
    assert report["gone"].tokens_used == report["zero"].tokens_used == 0 and set(report) == {"big", "small", "gone", "zero"}
    used = {}
    for r in chosen:
        assert 1 <= r.repeats <= {"big": 2, "small": 3}[r.source] and r.n_tokens > 0
        used[r.source] = used.get(r.source, 0) + r.repeats * r.n_tokens
    assert used == {s: report[s].tokens_used for s in ("big", "small")}


def test_total_seed_and_ties(spark):
    docs = [(i, "same words", "a") for i in range(50)] + [(100 + i, "same words", "b") for i in range(50)]
    targets = [("a", 0.5, 1), ("b", 0.5, 1)]
    one, report = run(spark, docs, targets, total=60, seed=1)
    again, _ = run(spark, docs, targets, total=60, seed=1)
    other, _ = run(spark, docs, targets, total=60, seed=2)
    key = lambda rows: sorted((r.doc_id, r.repeats) for r in rows)
    assert key(one) == key(again) != key(other)
    assert report["a"].tokens_used == report["b"].tokens_used == 30
    everything, report = run(spark, docs, targets, total=10**9)
    assert report["a"].tokens_used == 150 and len(everything) == 100


def test_empty(spark):
    chosen, report = run(spark, [], [("a", 1.0, 1)])
    assert chosen == [] and report["a"].tokens_used == 0
    chosen, report = run(spark, [(1, "x", "a")], [])
    assert chosen == [] and report == {}
