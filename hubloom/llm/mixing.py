"""Mixing sources to target weights by fitting token budgets exactly.

The budget of all sources is the largest at which each can give its share without using a
document more often than allowed. A source's budget is met in whole passes over all its
documents, then by a part of them: its documents are counted by exact token length, the
same fraction of every length is taken, and a bounded knapsack over the lengths left fits
what remains of the budget as a sum of lengths. Which documents of a length are taken is
settled by a seeded hash, by counts: nothing but counts ever leaves the executors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hubloom.llm.tokens import VOCABULARY, with_tokens
from hubloom.session import written

#: The knapsack fits a remainder of at most so many tokens; above it, lengths are taken greedily first.
KNAPSACK = 1 << 16
#: At least so many tokens are left to it, so that it has a choice.
ROOM = 1 << 13
#: Seeded documents are selected by buckets of their hash.
BUCKETS = 4096


def plain_source(c: Column) -> Column:
    """A source's name whatever its case, outer blanks and joining characters."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"[\s\-_]+", "_"), F.lit(""))


def knapsack(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """How many of each length to take so that the sum is as near the budget as possible, not over it.

    Exact bounded-knapsack dynamic programming: for each length, every reachable sum
    keeps how many of that length its first way there takes.
    """
    reach = np.full(budget + 1, -1, dtype=np.int32)  # the item by which a sum is first reached; itself for 0
    reach[0] = len(lengths)
    used = np.zeros(budget + 1, dtype=np.int64)
    for k, (length, count) in enumerate(zip(lengths, counts)):
        if length <= 0 or count <= 0 or length > budget:
            continue
        used[:] = 0
        # all residues of the length at once, one step of it after another
        for at in range(length, budget + 1, length):
            end = min(at + length, budget + 1)
            now, before = slice(at, end), slice(at - length, end - length)
            new = (reach[now] < 0) & (reach[before] >= 0) & (used[before] < count)
            reach[now][new] = k
            used[now][new] = used[before][new] + 1
        if reach[budget] >= 0:
            break
    at = int(np.flatnonzero(reach >= 0)[-1])
    taken: dict[int, int] = {}
    while at:
        length = lengths[reach[at]]
        taken[length] = taken.get(length, 0) + 1
        at -= length
    return taken


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, most: int = KNAPSACK, room: int = ROOM, seed: int = 0) -> np.ndarray:
    """How many documents of each length, all over 0, to take once for a sum near the budget, at most it."""
    order = np.argsort(-lengths, kind="stable")
    lengths, counts = lengths[order], counts[order]
    total = int((lengths * counts).sum())
    if budget >= total:
        take = counts.copy()
    else:
        # every document is as likely as any other: an even step through all of them, by length
        at = [int(x) * budget // total for x in np.cumsum(counts).tolist()]  # Python's integers: no overflow
        take = np.diff(np.array([0, *at], dtype=np.int64))
        rest = budget - int((take * lengths).sum())
        # room for the knapsack, by giving back documents from all lengths alike
        given = np.random.default_rng(seed).permutation(np.flatnonzero(take))
        while rest < min(budget, room):
            for i in given[take[given] > 0]:
                back = max(1, int(take[i]) // 64)
                take[i] -= back
                rest += back * int(lengths[i])
                if rest >= min(budget, room):
                    break
        for i in range(len(lengths)):
            if rest <= most:
                break
            more = min(int(counts[i] - take[i]), max(0, (rest - most // 2) // int(lengths[i])))
            take[i] += more
            rest -= more * int(lengths[i])
        left = counts - take
        for length, n in knapsack(lengths.tolist(), left.tolist(), min(rest, most)).items():
            take[np.flatnonzero(lengths == length)[0]] += n
    out = np.empty_like(take)
    out[order] = take
    return out


def _ranked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The `take` first documents of each (source, n_tokens), in the order of (bucket, h, id).

    Buckets are counted first; only in the one where a count falls are documents ranked, so
    no task ever sorts all documents of a length.
    """
    per = docs.groupBy("source", "n_tokens", "bucket").agg(F.count("*").alias("n")).join(wanted, ["source", "n_tokens"])
    before = F.sum("n").over(W.partitionBy("source", "n_tokens").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    part = F.greatest(F.least(F.col("take") - F.coalesce(before, F.lit(0)), F.col("n")), F.lit(0))
    cut = per.withColumn("part", part)
    joined = docs.join(cut.select("source", "n_tokens", "bucket", "n", "part", "passes"), ["source", "n_tokens", "bucket"])
    sure = joined.where("part = n or part = 0").withColumn("extra", (F.col("part") > 0).cast("int"))
    edge = joined.where("part < n and part > 0").withColumn(
        "extra", (F.row_number().over(W.partitionBy("source", "n_tokens", "bucket").orderBy("h", "id")) <= F.col("part")).cast("int")
    )
    return sure.unionByName(edge)


def mix(
    docs: DataFrame, targets: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
    total: int | None = None, seed: int = 0, vocabulary: str = VOCABULARY,
) -> tuple[DataFrame, DataFrame]:
    """The chosen documents (id, source, n_tokens, repeats) and the shares report.

    targets: source, target_share, max_repeats. Report: a row for each source of targets,
    with its share of all tokens, its documents and tokens, its budget and what it got.
    Sources of targets without tokens can't be had: the others' shares are taken in
    proportion, and their rows report it. Sources not in targets, null shares and shares
    or repeats of 0 or less give nothing. total: tokens wanted; the largest possible if
    it is more, or None. Texts of no tokens are never chosen.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id).alias("id"), plain_source(F.col(source)).alias("source"), F.col(text).alias("text"))
    t = targets.select(
        plain_source(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")
    ).where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    useful = t.where("target_share > 0 and max_repeats > 0")
    # targets is a short list by its nature: one row per source
    named = d.join(useful.select("source"), "source", "left_semi").select("id", "source", "text")
    sized = with_tokens(named, ["id", "source"], "text", vocabulary).where("n_tokens > 0")
    h = F.xxhash64(F.lit(seed), "id", "n_tokens")
    sized, _ = written(sized.withColumn("h", h).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int")))
    # counts by source and length: their number is bounded by the lengths of texts, not by the number of documents
    counted, _ = written(sized.groupBy("source", "n_tokens").agg(F.count("*").alias("n")))
    have = counted.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("tokens"), F.sum("n").alias("documents"))
    goal = [r.asDict() for r in useful.join(have, "source").collect()]
    share = sum(g["target_share"] for g in goal)
    most = min((int(g["tokens"]) * g["max_repeats"] * share / g["target_share"] for g in goal), default=0)
    all_tokens = most if total is None else min(total, most)
    plan = [
        (g["source"], min(round(all_tokens * g["target_share"] / share), int(g["tokens"]) * g["max_repeats"]), int(g["tokens"])) for g in goal
    ]
    plans = spark.createDataFrame(
        [(s, budget // have_, budget % have_, budget) for s, budget, have_ in plan], "source string, passes bigint, rest bigint, budget bigint"
    )

    def take(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("n_tokens")
        lengths, counts = group["n_tokens"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        return group.assign(take=fit_counts(lengths, counts, int(group["rest"].iloc[0]), seed=seed))[["source", "n_tokens", "take", "passes"]]

    wanted = counted.join(plans, "source").groupBy("source").applyInPandas(take, "source string, n_tokens bigint, take bigint, passes bigint")
    wanted, _ = written(wanted)
    chosen = (
        _ranked(sized, wanted)
        .withColumn("repeats", (F.col("passes") + F.col("extra")).cast("int"))
        .where("repeats > 0")
        .select(F.col("id").alias(id), "source", "n_tokens", "repeats")
    )
    got = wanted.join(counted, ["source", "n_tokens"]).groupBy("source").agg(
        F.sum(F.col("n_tokens") * (F.col("take") + F.col("passes") * F.col("n"))).alias("tokens_used")
    )
    everything = got.agg(F.sum("tokens_used").alias("everything"))
    report = (
        t.join(have, "source", "left").join(plans.select("source", "budget"), "source", "left").join(got, "source", "left").join(F.broadcast(everything))
        .select(
            "source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("budget", F.lit(0)).alias("budget"), F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"),
            F.coalesce(F.try_divide("tokens_used", "everything"), F.lit(0.0)).alias("actual_share"),
        )
    )
    return chosen, report
