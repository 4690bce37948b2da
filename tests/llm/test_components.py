import numpy as np
import pytest

from hubloom.llm.components import components
from hubloom.llm.queries import NODES_FROM, hub_edges, p5_found, p5_groups


def union_find(pairs):
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {v: find(v) for v in list(parent)}


def run(spark, pairs):
    return {r.id: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graph(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 400, (300, 2))]
    assert run(spark, pairs) == union_find(pairs)


def test_chain_star_and_repeats(spark):
    ids = list(np.random.default_rng(3).permutation(300) + 1000)
    chain = [(int(a), int(b)) for a, b in zip(ids, ids[1:])]
    star = [(50, i) for i in range(200)] + [(-5, -5)]
    pairs = chain + star + star + [(b, a) for a, b in chain[:9]]
    assert run(spark, pairs) == union_find(pairs)


def test_nulls_loops_and_empty(spark):
    assert run(spark, [(None, 1), (2, None), (3, 3)]) == {3: 3}
    assert run(spark, []) == {}


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, 2, "x", "y", "z"), (2, 3, "x", "y", "z")], "u long, v long, m string, top string, x string")
    assert {r.id: r.root for r in components(df, "u", "v").collect()} == {1: 1, 2: 1, 3: 1}


def tables(spark, path, hubs, notes):
    spark.createDataFrame(hubs, "group_id long, node string").write.parquet(f"{path}/grouped_hubs.parquet")
    spark.createDataFrame(notes, "nodes_in_group string").write.parquet(f"{path}/is_same_group.parquet")
    return str(path)


def test_hubs_and_notes(spark, tmp_path):
    hubs = [(1, "['10' '11']"), (2, "11.0"), (3, "20"), (4, "[30, nan]"), (5, None), (None, "10"), (6, "40"), (7, "50"), (8, "60"), (3, '"20"'), (9, "")]
    notes = [("20, 30.0",), ("node 40 and node 99",), ("99 = 50 (check)",), ("x, 60",), (None,), ("60.5, 10",), ("abc12, 60",), ("60 ו-60",)]
    d = tables(spark, tmp_path, hubs, notes)
    assert {tuple(r) for r in p5_found(spark, d).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3), (6, 6), (7, 6)}
    assert {tuple(r) for r in p5_groups(spark, d).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6), (7, 6), (8, 8), (9, 9)}


def test_empty_tables(spark, tmp_path):
    assert p5_found(spark, tables(spark, tmp_path, [], [])).count() == 0


def test_long_numbers(spark, tmp_path):
    d = tables(spark, tmp_path, [(1, "123456789012345678901"), (2, "123456789012345678901")], [])
    assert hub_edges(spark, d).where(f"b < {NODES_FROM}").count() == 0
    assert {tuple(r) for r in p5_found(spark, d).collect()} == {(1, 1), (2, 1)}
