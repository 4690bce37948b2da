"""The analytic hierarchy process on long tables: expert, i, j, v.

Experts' matrices are small and many: everything that is sums and products is aggregated
in the JVM over all experts at once; only eigenvectors run in Python, one expert per group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubloom.functions import rules
from hubloom.functions import settings as S


def matrices(long: DataFrame, expert: str = "expert", a: str = "criterion_a", b: str = "criterion_b", value: str = "value", order: str | None = None) -> DataFrame:
    """expert, i, j, v: judgements, their reciprocals and the diagonal; missing pairs have no row.

    Of several judgements of a pair the last by `order` counts. Null names, an item
    against itself, and values that are null, NaN or not positive are left out.
    """
    good = long.where(F.col(expert).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)) & (F.col(value) > 0) & ~F.isnan(value))
    flip = F.col(a) > F.col(b)
    one = good.select(
        F.col(expert).alias("expert"), F.least(a, b).alias("i"), F.greatest(a, b).alias("j"), F.when(flip, 1 / F.col(value)).otherwise(F.col(value)).alias("v"),
        (F.col(order) if order else F.lit(0)).alias("o"),
    )
    last = one.groupBy("expert", "i", "j").agg(F.max_by("v", F.struct("o", "v")).alias("v"))
    both = last.select("expert", F.inline(F.array(F.struct("i", "j", "v"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), (1 / F.col("v")).alias("v")))))
    diagonal = both.select("expert", "i").distinct().select("expert", "i", F.col("i").alias("j"), F.lit(1.0).alias("v"))
    return both.unionByName(diagonal)


def _normalised(df: DataFrame, by: str, raw: str) -> DataFrame:
    total = df.groupBy(by).agg(F.sum(raw).alias("_t"))
    return df.join(total, by).withColumn("weight", F.col(raw) / F.col("_t")).drop("_t", raw)


def geometric_weights(m: DataFrame) -> DataFrame:
    """expert, criterion, weight: geometric means of the rows, normalised."""
    return _normalised(m.groupBy("expert", F.col("i").alias("criterion")).agg(F.exp(F.avg(F.ln("v"))).alias("g")), "expert", "g")


def column_weights(m: DataFrame) -> DataFrame:
    """expert, criterion, weight: means of the rows of the column-normalised matrix, normalised where pairs are missing."""
    columns = m.groupBy("expert", "j").agg(F.sum("v").alias("c"))
    rows = m.join(columns, ["expert", "j"]).groupBy("expert", F.col("i").alias("criterion")).agg(F.sum(F.col("v") / F.col("c")).alias("s"))
    return _normalised(rows, "expert", "s")


def power_weights(matrix: np.ndarray, steps: int = 500, tolerance: float = 1e-14) -> np.ndarray:
    w = np.full(len(matrix), 1 / len(matrix))
    for _ in range(steps):
        after = matrix @ w
        after /= after.sum()
        done = np.abs(after - w).sum() < tolerance
        w = after
        if done:
            return w
    # sparse matrices of many criteria converge slowly
    values, vectors = np.linalg.eig(matrix)
    first = np.abs(vectors[:, np.argmax(values.real)].real)
    return first / first.sum()


def eigen_weights(m: DataFrame) -> DataFrame:
    """expert, criterion, weight: the principal eigenvector, by power iteration; missing pairs are 0."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(g["i"]) | set(g["j"]))
        at = {x: k for k, x in enumerate(names)}
        matrix = np.zeros((len(names), len(names)))
        matrix[[at[x] for x in g["i"]], [at[x] for x in g["j"]]] = g["v"]
        return pd.DataFrame({"expert": g["expert"].iloc[0], "criterion": names, "weight": power_weights(matrix)})

    return m.groupBy("expert").applyInPandas(one, "expert string, criterion string, weight double")


def priorities(m: DataFrame, method: str = "eigenvector") -> DataFrame:
    methods = {"eigenvector": eigen_weights, "geometric_mean": geometric_weights, "normalized_column": column_weights}
    if method not in methods:
        raise ValueError(f"unknown method {method}")
    return methods[method](m)


def consistency(m: DataFrame, weights: DataFrame) -> DataFrame:
    """expert, n, lambda_max, ci, cr, consistent."""
    w = weights.select("expert", F.col("criterion").alias("j"), F.col("weight").alias("wj"))
    rows = m.join(w, ["expert", "j"]).groupBy("expert", "i").agg(F.sum(F.col("v") * F.col("wj")).alias("mw"))
    own = weights.select("expert", F.col("criterion").alias("i"), F.col("weight").alias("wi"))
    per = rows.join(own, ["expert", "i"]).groupBy("expert").agg(F.count("*").cast("int").alias("n"), F.avg(F.col("mw") / F.col("wi")).alias("lambda_max"))
    ci = F.when(F.col("n") > 1, (F.col("lambda_max") - F.col("n")) / (F.col("n") - 1)).otherwise(0.0)
    ri = rules.lookup(S.RANDOM_INDEX, F.col("n"), S.RANDOM_INDEX_BEYOND)
    out = per.withColumn("ci", ci).withColumn("cr", F.when(ri > 0, F.col("ci") / ri).otherwise(0.0))
    return out.withColumn("consistent", F.col("cr") <= S.CONSISTENT)


def invalid_pairs(long: DataFrame) -> DataFrame:
    """expert, i, j, v, back: pairs whose reciprocal is missing or off by over 1 %, values that aren't positive, diagonals that aren't 1."""
    back = long.select("expert", F.col("i").alias("j"), F.col("j").alias("i"), F.col("v").alias("back"))
    j = long.join(back, ["expert", "i", "j"], "left")
    off = F.abs(F.col("v") * F.col("back") - 1) > 0.01
    return j.where((F.col("v") <= 0) | F.col("back").isNull() | off | ((F.col("i") == F.col("j")) & (F.abs(F.col("v") - 1) > 0.01)))


def aggregate_experts(weights: DataFrame, how: str = "geometric_mean") -> DataFrame:
    """criterion, weight over all experts, normalised; inconsistent experts count as well."""
    f = {"geometric_mean": F.exp(F.avg(F.ln(F.col("weight") + 1e-10))), "arithmetic_mean": F.avg("weight"), "median": F.percentile("weight", 0.5)}
    if how not in f:
        raise ValueError(f"unknown aggregate {how}")
    per = weights.groupBy("criterion").agg(f[how].alias("g"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("g").alias("_t")))).select("criterion", (F.col("g") / F.col("_t")).alias("weight"))


def template(criteria: DataFrame, experts: int) -> DataFrame:
    """expert, criterion_a, criterion_b, value 1: an empty questionnaire, each pair of the short list of criteria once."""
    a, b = criteria.select(F.col("criterion").alias("criterion_a")), criteria.select(F.col("criterion").alias("criterion_b"))
    pairs = a.join(b, F.col("criterion_a") < F.col("criterion_b"))
    names = F.transform(F.sequence(F.lit(1), F.lit(experts)), lambda i: F.concat(F.lit("expert_"), i.cast("string")))
    return pairs.select(F.explode(names).alias("expert"), "criterion_a", "criterion_b", F.lit(1.0).alias("value"))


def long_format(matrix: DataFrame, index: str) -> DataFrame:
    """i, j, v of a table with a row and a column for each criterion."""
    columns = [c for c in matrix.columns if c != index]
    return matrix.unpivot([index], columns, "j", "v").withColumnRenamed(index, "i")
