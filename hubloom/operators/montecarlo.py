"""Monte-Carlo weights: mean scores, full distributions, rank robustness.

The mean over iterations is linear, so it is one dot product with the mean weights. The
distributions are rows (id, iteration, score): one shuffle by iteration for the ranks, one
by id for everything else.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from hubloom.functions import settings as S
from hubloom.operators.score import global_rank
from hubloom.session import written

QUANTILES = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)


def draw_weights(n: int, iterations: int = S.MC_ITERATIONS, seed: int = S.MC_SEED, sampler: str = "uniform_norm", top: float = S.MC_TOP) -> np.ndarray:
    """iterations x n weights, each row summing to 1.

    uniform_norm: uniform in 0..top, then normalised. reject_norm: uniform in 0..1, drawn
    again while any is over top, then normalised. norm_reject: normalised, then drawn
    again while any is over top, the only one that keeps to top.
    """
    rng = np.random.RandomState(seed)
    if sampler == "uniform_norm":
        w = rng.uniform(0, top, size=(iterations, n))
        return w / w.sum(axis=1, keepdims=True)
    if sampler not in ("reject_norm", "norm_reject"):
        raise ValueError(f"unknown sampler {sampler}")
    if sampler == "norm_reject" and top * n < 1:
        raise ValueError("no weights can keep to the limit")
    kept, have = [], 0
    while have < iterations:
        w = rng.rand(4 * iterations, n)
        if sampler == "reject_norm":
            w = w[(w <= top).all(axis=1)]
            w = w / w.sum(axis=1, keepdims=True)
        else:
            w = w / w.sum(axis=1, keepdims=True)
            w = w[(w <= top).all(axis=1)]
        kept.append(w)
        have += len(w)
    return np.concatenate(kept)[:iterations]


def weights_table(spark: SparkSession, w: np.ndarray) -> DataFrame:
    """iteration, w0.. wn: one row per draw."""
    rows = [(i, *map(float, r)) for i, r in enumerate(w)]
    return spark.createDataFrame(rows, "iteration int, " + ", ".join(f"w{j} double" for j in range(w.shape[1])))


def sequence_weights(spark: SparkSession, n: int, iterations: int) -> DataFrame:
    """The same table by a linear congruence, which SQL can repeat; no weight is over 0.5 before normalising."""
    u = [F.pmod(F.col("iteration") * 1103515245 + 12345 * (j + 1) + F.col("iteration") * F.lit(7919 * (j + 1) * (j + 3)), F.lit(2147483648)) / 4294967296.0 + 1e-6 for j in range(n)]
    raw = spark.range(1, iterations + 1).withColumnRenamed("id", "iteration").select(F.col("iteration").cast("bigint").alias("iteration"), *(c.alias(f"u{j}") for j, c in enumerate(u)))
    total = F.col("u0")
    for j in range(1, n):
        total = total + F.col(f"u{j}")
    return raw.select("iteration", *((F.col(f"u{j}") / total).alias(f"w{j}") for j in range(n)))


def dot(scores: Sequence[str], names: Sequence[str]) -> Column:
    total = None
    for s, w in zip(scores, names):
        part = F.col(s) * F.col(w)
        total = part if total is None else total + part
    return total


def mean_score(df: DataFrame, scores: Sequence[str], w: np.ndarray, name: str = "final_score") -> DataFrame:
    """df with the mean score over all draws."""
    mean = w.mean(axis=0)
    total = None
    for s, x in zip(scores, mean):
        part = F.col(s) * float(x)
        total = part if total is None else total + part
    return df.withColumn(name, total)


def simulate(df: DataFrame, id: str, scores: Sequence[str], weights: DataFrame) -> DataFrame:
    """id, iteration, score. weights: one row per draw; iterations are a parameter, so the table is small whatever df is."""
    names = [f"w{j}" for j in range(len(scores))]
    return df.select(id, *scores).join(F.broadcast(weights)).select(id, "iteration", dot(scores, names).alias("score"))


def with_ranks(sim: DataFrame, id: str, ranges: int = 64) -> DataFrame:
    """sim with rank: 1.. in each iteration by falling score, ties by id.

    A draw's scores are cut into ranges; rows are ranked within their range, behind those
    of the higher ranges, which are only counted. So a task sorts a range, not a draw.
    """
    range_ = F.least(F.greatest(F.floor((1 - F.col("score")) * ranges), F.lit(0)), F.lit(ranges - 1))
    cut = sim.withColumn("_range", range_)
    before = W.partitionBy("iteration").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ahead = cut.groupBy("iteration", "_range").agg(F.count("*").alias("_n")).select("iteration", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    within = F.row_number().over(W.partitionBy("iteration", "_range").orderBy(F.desc("score"), id))
    return cut.withColumn("_at", within).join(ahead, ["iteration", "_range"]).withColumn("rank", F.col("_ahead") + F.col("_at")).drop("_range", "_at", "_ahead")


def distributions(ranked: DataFrame, id: str) -> DataFrame:
    """Per id: mean, median, std, min, max, percentiles, IQR, mean rank and the share of iterations in the top 1, 3 and 5."""
    out = ranked.groupBy(id).agg(
        F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.min("score").alias("min"), F.max("score").alias("max"), F.sort_array(F.collect_list("score")).alias("_s"),
        F.avg("rank").alias("mean_rank"), *(F.avg((F.col("rank") <= k).cast("double")).alias(f"p_top{k}") for k in (1, 3, 5)),
    )
    names = {x: "median" if x == 0.5 else f"p{round(100 * x):02d}" for x in QUANTILES}
    out = out.withColumns({n: _quantile(F.col("_s"), x) for x, n in names.items()})
    return out.withColumn("iqr", F.col("p75") - F.col("p25")).drop("_s")


def _scores(columns: Sequence[np.ndarray], w: np.ndarray) -> np.ndarray:
    """Summed in the order of `dot`, so that equal scores stay equal."""
    total = columns[0] * w[0]
    for c, x in zip(columns[1:], w[1:]):
        total = total + c * x
    return total


def simulated_distributions(df: DataFrame, id: str, scores: Sequence[str], w: np.ndarray, rows: int = 256) -> DataFrame:
    """The same as `distributions` of all draws but the ranks: each id's draws are made and summed up where its row is, without a shuffle."""
    names = {x: "median" if x == 0.5 else f"p{round(100 * x):02d}" for x in QUANTILES}

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.iloc[at : at + rows]
                s = np.sort(_scores([part[c].to_numpy(dtype=float)[:, None] for c in scores], w.T), axis=1)
                out = {id: part[id], "mean": s.mean(axis=1), "std": s.std(axis=1, ddof=1) if len(w) > 1 else np.nan, "min": s[:, 0], "max": s[:, -1]}
                for x, n in names.items():
                    k = (len(w) - 1) * x
                    low, high = s[:, int(np.floor(k))], s[:, int(np.ceil(k))]
                    out[n] = low + (high - low) * (k - np.floor(k))
                yield pd.DataFrame(out)

    stats = ("mean", "std", "min", "max", *names.values())
    kind = df.schema[id].dataType.simpleString()
    out = df.select(id, *scores).mapInPandas(one, f"{id} {kind}, " + ", ".join(f"{n} double" for n in stats))
    out = out.select(id, *(F.when(~F.isnan(n), F.col(n)).alias(n) for n in stats))
    return out.withColumn("iqr", F.col("p75") - F.col("p25"))


class _Column:
    """A column's numbers as they come in batches: codes of two bytes while it has few distinct ones, else eight bytes each."""

    def __init__(self, most: int = 1 << 16) -> None:
        self.most, self.parts = most, []
        self.known: np.ndarray | None = np.empty(0)  # by code
        self.order = np.empty(0, dtype=np.int64)  # the codes by rising number

    def add(self, v: np.ndarray) -> None:
        if self.known is not None:
            new = np.setdiff1d(v, self.known)
            if len(self.known) + len(new) > self.most:
                self.parts, self.known = [self.known[p] for p in self.parts], None
            elif len(new):
                self.known = np.concatenate([self.known, new])
                self.order = np.argsort(self.known, kind="stable")
        self.parts.append(v if self.known is None else self.order[np.searchsorted(self.known, v, sorter=self.order)].astype(np.uint16))

    def arrange(self, order: np.ndarray) -> None:
        self.whole = np.concatenate(self.parts or [np.empty(0)])
        self.parts = []
        self.whole = self.whole[order]

    def times(self, x: float, at: slice) -> np.ndarray:
        return self.whole[at] * x if self.known is None else (self.known * x)[self.whole[at]]


def _falling(score: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The rows' numbers by falling score, ties by number; in `key`, which is as long.

    Scores are cut to whole numbers and sorted with the row's number in the low bits, which
    is far cheaper than sorting numbers by their scores; rows whose scores are cut to the
    same are put in order by the scores themselves.
    """
    n = len(score)
    most, least = score.max(), score.min()
    if not np.isfinite(most - least):
        return np.argsort(-score, kind="stable")
    low = max(1, (n - 1).bit_length())
    high = min(62 - low, 50)
    scale = ((1 << high) - 2) / (most - least) if most > least else 0.0
    if not np.isfinite(scale):
        return np.argsort(-score, kind="stable")
    for at in range(0, n, 1 << 16):
        part = slice(at, min(n, at + (1 << 16)))
        key[part] = ((most - score[part]) * scale).astype(np.int64)
        key[part] <<= low
        key[part] |= np.arange(part.start, part.stop)
    key.sort()
    same = np.empty(n, dtype=bool)
    same[0] = False
    for at in range(1, n, 1 << 16):
        end = min(n, at + (1 << 16))
        same[at:end] = (key[at:end] ^ key[at - 1 : end - 1]) < (1 << low)
    key &= (1 << low) - 1
    if same.any():
        cut = np.append(same[1:], False) | same
        at = np.flatnonzero(cut)
        rows = key[at]
        key[at] = rows[np.lexsort((rows, -score[rows], np.cumsum(~same[at])))]
    return key


def simulated_ranks(df: DataFrame, id: str, scores: Sequence[str], w: np.ndarray, blocks: int | None = None) -> DataFrame:
    """id, mean_rank, p_top1, p_top3, p_top5 over all draws, ranked as in `with_ranks`.

    Draws are dealt to blocks, by default two for each core. df is written once; a block's
    task reads all of it from there and holds its scores, 8 bytes for each id and continuous
    criterion. It gives sums by id, packed a stretch of ids to a row, so nothing is copied
    for the blocks on disk, and what is shuffled is a number for each id and block.
    """
    spark = df.sparkSession
    blocks = min(blocks or 2 * spark.sparkContext.defaultParallelism, len(w))
    kind = df.schema[id].dataType.simpleString()
    stretch = 1 << 16

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, columns, block = [], [_Column() for _ in scores], None
        for b in batches:
            if b.num_rows:
                block = b.column("_block")[0].as_py() if block is None else block
                ids.append(b.column("_id"))
                for k, c in enumerate(columns):
                    c.add(b.column(f"_s{k}").to_numpy(zero_copy_only=False))
        if block is None:
            return
        ids = pa.chunked_array(ids)
        order = pc.sort_indices(ids).to_numpy()
        ids = ids.take(pa.array(order)) if block == 0 else None
        for c in columns:
            c.arrange(order)
        n = len(order)
        del order
        # rows with a missing score come last in every draw, in the order of their ids
        lost = np.zeros(n, dtype=bool)
        for c in columns:
            lost |= np.isnan(c.times(1.0, slice(None)))
        live = np.flatnonzero(~lost) if lost.any() else None
        m = n if live is None else len(live)
        if live is not None:
            for c in columns:
                c.whole = c.whole[live]
        mine = w[block::blocks]
        score, key, rank, total = np.empty(m), np.empty(m, dtype=np.int64), np.empty(m, dtype=np.uint32), np.zeros(m, dtype=np.int64)
        place = np.arange(1, m + 1, dtype=np.uint32)
        top: dict[tuple[int, int], int] = {}
        for draw in mine:
            for at in range(0, m, 1 << 15):
                part = slice(at, min(m, at + (1 << 15)))
                s = columns[0].times(draw[0], part)
                for c, x in zip(columns[1:], draw[1:]):  # in the order of `dot`, so that equal scores stay equal
                    s = s + c.times(x, part)
                score[part] = s
            order = _falling(score, key) if m else key
            rank[order] = place
            total += rank
            # ids of the first places: beyond the last live one come the lost ones
            for p in range(min(5, n)):
                i = int(order[p]) if p < m else p - m
                top[i if p < m else -1 - i, p] = top.get((i if p < m else -1 - i, p), 0) + 1
        del score, key, rank, place, columns
        if live is not None:
            gone = np.flatnonzero(lost)
            every = np.empty(n, dtype=np.int64)
            every[live], every[gone] = total, len(mine) * np.arange(m + 1, n + 1)
            total = every
            top = {(int(live[i] if i >= 0 else gone[-1 - i]), p): k for (i, p), k in top.items()}
        led: dict[int, list[int]] = {}
        for (i, p), k in top.items():
            sums = led.setdefault(i, [0, 0, 0])
            for t, most in enumerate((1, 3, 5)):
                sums[t] += k * (p < most)
        for at in range(0, n, stretch):
            end = min(n, at + stretch)
            here = sorted(i for i in led if at <= i < end)
            yield pa.RecordBatch.from_pydict(
                {
                    "_at": [at], "_r": [total[at:end].tobytes()], "_i": [[i - at for i in here]], "_t": [[t for i in here for t in led[i]]],
                    "_ids": pa.array([ids.slice(at, end - at).to_pylist() if block == 0 else None], type=pa.list_(id_type)),
                },
                schema=pa.schema([("_at", pa.int64()), ("_r", pa.binary()), ("_i", pa.list_(pa.int32())), ("_t", pa.list_(pa.int64())), ("_ids", pa.list_(id_type))]),
            )

    def summed(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(r, dtype=np.int64) for r in parts["_r"])
        tops = np.zeros((len(total), 3), dtype=np.int64)
        for i, t in zip(parts["_i"], parts["_t"]):
            tops[np.asarray(i, dtype=np.int64)] += np.asarray(t, dtype=np.int64).reshape(-1, 3)
        ids = next(x for x in parts["_ids"] if x is not None)
        return pd.DataFrame({id: ids, "mean_rank": total / len(w), **{f"p_top{k}": tops[:, j] / len(w) for j, k in enumerate((1, 3, 5))}})

    id_type = to_arrow_type(df.schema[id].dataType)
    rows, _ = written(df.select(F.col(id).alias("_id"), *(F.col(c).cast("double").alias(f"_s{k}") for k, c in enumerate(scores))), tidy=True)
    dealt = spark.range(0, blocks, 1, blocks).select(F.col("id").cast("int").alias("_block"))
    # one partition of rows and one for each block: a task for each pair, and no shuffle
    each = rows.coalesce(1).hint("shuffle_replicate_nl").crossJoin(dealt.hint("shuffle_replicate_nl"))
    sums = each.mapInArrow(one, f"_at bigint, _r binary, _i array<int>, _t array<bigint>, _ids array<{kind}>")
    return sums.groupBy("_at").applyInPandas(summed, f"{id} {kind}, mean_rank double, p_top1 double, p_top3 double, p_top5 double")


def _quantile(ordered: Column, x: float) -> Column:
    """Linear interpolation between the ordered values; one id has as many as there are iterations."""
    at = (F.size(ordered) - 1) * F.lit(x)
    low = F.floor(at).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.ceil(at).cast("int"))
    return a + (b - a) * (at - low)


def robust_winners(stats: DataFrame, k: int = 3, least: float = 0.5) -> DataFrame:
    if k not in (1, 3, 5):
        raise ValueError("k is 1, 3 or 5")
    return stats.where(F.col(f"p_top{k}") >= least)


def conservative_rank(stats: DataFrame, percentile: int = 10) -> DataFrame:
    """stats with conservative_rank by a low percentile, of all rows; equal ones share the least rank.

    Ranked by `global_rank`, without a window over everything.
    """
    if percentile not in (10, 25):
        raise ValueError("percentile is 10 or 25")
    return global_rank(stats, f"p{percentile}", "conservative_rank")


def chosen(stats: DataFrame, id: str, ids: Sequence) -> DataFrame:
    """The rows of some ids; raises if one is missing."""
    out = stats.where(F.col(id).isin(list(ids)))
    missing = set(ids) - {r[0] for r in out.select(id).collect()}
    if missing:
        raise KeyError(f"not found: {sorted(missing)}")
    return out
