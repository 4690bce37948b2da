"""One global ranking from pairwise comparisons: the stationary distribution of a walk towards winners.

Every vote is a share: a value of v says v to 1 for the first item, v / (v + 1). Votes of
one expert on one pair are averaged, so repeats and contradictions weigh no more than one
vote, and experts are weighted by how well they agree with the others (leave-one-out,
shrunk to the mean). The walk goes from an item to one it was compared with, at the rate at
which that one won. A virtual item that ties with every item, `smoothing` votes each,
connects and smooths everything: items compared hardly at all stay near the middle.

The rates are normalised per item, so that items compared a thousand times mix as fast as
those compared once; dividing the jump walk's distribution by an item's rate gives back the
strength. For two items compared only with each other the strengths' ratio is the odds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from hubloom.operators.numbering import number_in_order
from hubloom.session import drop_written, written

#: Up to so many items the walk, at most their square of rows, runs in one task; beyond, over the cluster.
ONE_TASK_ITEMS = 2_000
#: The usual scale of judgements, 1/9 to 9.
SCALE = 9.0


def plain_name(c: Column) -> Column:
    """A name whatever its case, blanks and underscores."""
    return F.nullif(F.regexp_replace(F.lower(c), r"[\s_\-]+", ""), F.lit(""))


def votes(comparisons: DataFrame, items: DataFrame, item: str, a: str, b: str, value: str, expert: str | None, scale: float | None = SCALE) -> DataFrame:
    """lo, hi (items in order), expert, share of lo: one vote per expert and pair.

    Left out: null or unknown items, an item against itself, and values that are null,
    NaN, infinite, not positive or, by more than rounding, beyond the scale (1/scale to
    scale; None: any). Without an expert every row is its own.
    """
    names = items.where(F.col(item).isNotNull()).select(F.col(item).alias("name"), plain_name(F.col(item)).alias("key")).groupBy("key").agg(F.min("name").alias("name"))
    who = F.coalesce(F.col(expert), F.lit("")) if expert else F.monotonically_increasing_id().cast("string")
    v = F.col(value).cast("double")
    judged = v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < float("inf"))
    if scale is not None:
        judged &= (v >= 0.99 / scale) & (v <= scale * 1.01)
    good = comparisons.where(judged).select(
        plain_name(F.col(a)).alias("a"), plain_name(F.col(b)).alias("b"), who.alias("expert"), (v / (v + 1)).alias("p")
    ).where("a is not null and b is not null and a <> b")
    # aggregated under the written names first, then named: the few pairs are what is shuffled
    per = good.select(
        F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "expert", F.when(F.col("a") < F.col("b"), F.col("p")).otherwise(1 - F.col("p")).alias("p")
    ).groupBy("lo", "hi", "expert").agg(F.avg("p").alias("p"), F.count("*").alias("n"))
    lo, hi = (names.select(F.col("key").alias(k), F.col("name").alias(f"{k}_name")) for k in ("lo", "hi"))
    return per.join(lo, "lo").join(hi, "hi").select(F.col("lo_name").alias("lo"), F.col("hi_name").alias("hi"), "expert", "p", "n")


def expert_weights(v: DataFrame, prior: float = 5.0, floor: float = 0.1, ceiling: float = 10.0) -> DataFrame:
    """expert, weight: the inverse of the mean squared distance from what the others say, shrunk to everyone's mean."""
    pair = v.groupBy("lo", "hi").agg(F.sum("p").alias("s"), F.count("*").alias("k")).where("k > 1")
    off = v.join(pair, ["lo", "hi"]).select("expert", F.pow(F.col("p") - (F.col("s") - F.col("p")) / (F.col("k") - 1), 2).alias("e"))
    per = off.groupBy("expert").agg(F.sum("e").alias("e"), F.count("*").alias("k"))
    mean = per.agg(F.try_divide(F.sum("e"), F.sum("k")).alias("mean"))
    w = F.col("mean") / ((F.col("e") + prior * F.col("mean")) / (F.col("k") + prior))
    return per.crossJoin(F.broadcast(mean)).select("expert", F.coalesce(F.greatest(F.least(F.when(F.col("mean") > 0, w), F.lit(ceiling)), F.lit(floor)), F.lit(1.0)).alias("weight"))


def _walk(i: np.ndarray, j: np.ndarray, rate: np.ndarray, n: int, tolerance: float, steps: int) -> np.ndarray:
    """Strengths of items 0..n-1 by power iteration of the lazy jump walk."""
    out = np.bincount(i, rate, n)
    move = rate / out[i]
    p = np.full(n, 1.0 / n)
    for _ in range(steps):
        after = 0.5 * p + 0.5 * np.bincount(j, p[i] * move, n)
        done = np.abs(after - p).sum() < tolerance
        p = after
        if done:
            p = p / out
            return p / p.sum()
    raise RuntimeError(f"the walk has not converged to {tolerance} after {steps} steps")


def rank_items(
    comparisons: DataFrame, items: DataFrame, item: str = "item", a: str = "a", b: str = "b", value: str = "value", expert: str | None = None,
    smoothing: float = 1.0, tolerance: float = 1e-12, steps: int = 200_000, one_task: int = ONE_TASK_ITEMS, scale: float | None = SCALE,
) -> DataFrame:
    """item, strength, rank, n_votes, n_opponents: a row for every item of `items`.

    Strengths sum to 1 over the items; equal ones are ranked by name. Items nobody
    compared have the middle strength. Names that differ in case, blanks or underscores
    only are one item, under the first of them. scale: see `votes`. A walk that hasn't
    come to rest (a step moves less than `tolerance` of the whole) after `steps` raises.
    """
    spark = items.sparkSession
    v, _ = written(votes(comparisons, items, item, a, b, value, expert, scale))
    weighted = v.join(expert_weights(v), "expert", "left") if expert else v.withColumn("weight", F.lit(1.0))
    weight = F.coalesce("weight", F.lit(1.0))
    pairs = weighted.groupBy("lo", "hi").agg(F.sum(weight * F.col("p")).alias("lo_won"), F.sum(weight * (1 - F.col("p"))).alias("hi_won"), F.count("*").alias("k"))
    both = F.array(F.struct(F.col("lo").alias("i"), F.col("hi").alias("j"), F.col("hi_won").alias("rate"), "k"), F.struct(F.col("hi").alias("i"), F.col("lo").alias("j"), F.col("lo_won").alias("rate"), "k"))
    edges = pairs.select(F.inline(both))
    all_items = items.where(F.col(item).isNotNull()).groupBy(plain_name(F.col(item)).alias("key")).agg(F.min(item).alias("i")).where("key is not null").select("i")
    real = edges.select("i", "j", "rate")
    few = all_items.count() <= one_task
    # the virtual item is null, no item's name; on the cluster it is a number, not rows
    anchor = all_items.select("i", F.lit(None).cast("string").alias("j"), F.lit(smoothing / 2).alias("rate"))
    back = anchor.select(F.col("j").alias("i"), F.col("i").alias("j"), "rate")
    graph, graph_at = written(real.unionByName(anchor).unionByName(back) if few else real)
    if few:

        def solve(group: pd.DataFrame) -> pd.DataFrame:
            names = sorted(set(group["i"].dropna()))
            number = {x: k for k, x in enumerate(names)}
            codes = lambda c: np.array([number.get(x, len(names)) for x in group[c]], dtype=np.int64)
            p = _walk(codes("i"), codes("j"), group["rate"].to_numpy(), len(names) + 1, tolerance, steps)
            return pd.DataFrame({"i": names, "strength": p[:-1]})

        # at most one row per pair of items, whose number was just checked
        strength = graph.groupBy(F.lit(0).alias("g")).applyInPandas(solve, "i string, strength double")
    else:
        strength = _walk_on_cluster(all_items, graph, smoothing, tolerance, steps)
    total = strength.agg(F.sum("strength").alias("total"))
    per = edges.groupBy("i").agg(F.sum("k").alias("n_votes"), F.count("*").alias("n_opponents"))
    ranked, _ = written(strength.crossJoin(F.broadcast(total)).join(per, "i", "left").select(
        "i", (F.col("strength") / F.col("total")).alias("strength"), F.coalesce("n_votes", F.lit(0)).alias("n_votes"), F.coalesce("n_opponents", F.lit(0)).alias("n_opponents"),
    ))
    drop_written(spark, graph_at)  # the strengths are written
    return number_in_order(ranked, F.desc("strength"), "i", name="rank").select(F.col("i").alias(item), "strength", "rank", "n_votes", "n_opponents")


def _walk_on_cluster(items: DataFrame, graph: DataFrame, smoothing: float, tolerance: float, steps: int) -> DataFrame:
    """The same walk over the cluster: a job a step, whose move and mass are observed while it is written.

    What goes to the virtual item and comes back from it is one number a step.
    """
    spark = graph.sparkSession
    half = smoothing / 2
    out = items.join(graph.groupBy("i").agg(F.sum("rate").alias("rate")), "i", "left").select("i", (F.coalesce("rate", F.lit(0.0)) + half).alias("out"))
    out, out_at = written(out)
    moves, moves_at = written(graph.join(out, "i").select("i", "j", (F.col("rate") / F.col("out")).alias("move")))
    n = out.count()
    if not n:
        return out.select("i", F.col("out").alias("strength"))
    p, at = written(out.select("i", "out", F.lit(1.0 / (n + 1)).alias("p")))
    virtual, into_virtual = 1.0 / (n + 1), p.agg(F.sum(F.col("p") * half / F.col("out"))).first()[0]
    for _ in range(steps):
        into = p.join(moves, "i").groupBy(F.col("j").alias("i")).agg(F.sum(F.col("p") * F.col("move")).alias("into"))
        after = 0.5 * F.col("p") + 0.5 * (F.coalesce("into", F.lit(0.0)) + virtual / n)
        step = p.join(into, "i", "left").select("i", "out", F.col("p").alias("was"), after.alias("p"))
        seen = Observation()
        moved = F.sum(F.abs(F.col("p") - F.col("was"))).alias("moved")
        step, step_at = written(step.observe(seen, moved, F.sum(F.col("p") * half / F.col("out")).alias("into_virtual")))
        drop_written(spark, at)
        p, at = step.select("i", "out", "p"), step_at
        before, virtual = virtual, 0.5 * virtual + 0.5 * into_virtual
        into_virtual = seen.get["into_virtual"]
        if seen.get["moved"] + abs(virtual - before) < tolerance:
            for path in (out_at, moves_at):
                drop_written(spark, path)
            return p.select("i", (F.col("p") / F.col("out")).alias("strength"))
    raise RuntimeError(f"the walk has not converged to {tolerance} after {steps} steps")
