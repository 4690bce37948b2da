import numpy as np

import __spark_entry__ as entry
from hubloom.operators.ahp import power_weights

Q = entry.queries()


def test_eigenvectors_of_the_table(spark, tmp_path):
    """An incomplete and a contradictory expert against linear algebra."""
    rows = [("x", "a", "b", 3.0), ("x", "b", "c", 2.0), ("y", "a", "b", 5.0), ("y", "b", "c", 4.0), ("y", "c", "a", 7.0)]
    rows = [(k, *r) for k, r in enumerate(rows)]
    spark.createDataFrame(rows, "comparison_id long, expert string, criterion_a string, criterion_b string, value double").write.parquet(f"{tmp_path}/ahp_expert_comparisons.parquet")
    got = {(r.expert, r.criterion): r.weight for r in Q["ahp_eigen_weights"](spark, str(tmp_path)).collect()}
    for e in "xy":
        m = np.eye(3)
        for _, f, a, b, v in rows:
            if f == e:
                m["abc".index(a), "abc".index(b)], m["abc".index(b), "abc".index(a)] = v, 1 / v
        values, vectors = np.linalg.eig(m)
        w = np.abs(vectors[:, np.argmax(values.real)].real)
        assert np.allclose([got[e, c] for c in "abc"], w / w.sum(), atol=1e-6)


def test_eigenvector_of_a_long_chain():
    """Sixty criteria, each compared with the next only: power iteration alone stops far off."""
    m = np.eye(60)
    for k in range(59):
        m[k, k + 1], m[k + 1, k] = 1.5, 1 / 1.5
    w = power_weights(m)
    assert np.allclose(m @ w, np.max(np.linalg.eigvals(m).real) * w, atol=1e-9)
