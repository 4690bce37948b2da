"""Filling containers of fixed capacity by vector best-fit.

A container has three capacities: tokens, documents, and attention cost, counted in the
square tiles that causal attention of each document for itself computes. Items come in
order of falling length; each goes to the open container that holds it under every
constraint and is best by the weighted residual norm, or by the weighted dot product of
item and residual; if none does, a new one is opened.

Falling order alone would fill containers with long items and leave the short ones to
themselves, where the number of documents runs out before the tokens do. So while items
are placed that by their length could fill a container within the number of documents,
the room that the shorter ones need on average is kept free in every container.

The items are dealt to shards of even size by a hash of their row, whatever their id, source
or length, so a shard is a bounded task however skewed the data; only a shard's last open
containers stay underfilled, some tokens in millions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubloom.llm.tokens import VOCABULARY, with_tokens
from hubloom.session import written

CAPACITY, MAX_DOCS = 2048, 16
#: Tokens along a tile of attention.
TILE = 128
#: Pieces of a shard.
SHARD = 20_000
MOST_TASKS = 10_000
WEIGHTS = (1.0, 0.5, 0.5)
#: Room kept free for short items, in shares of what they need on average.
ROOM = 1.3


def tiles(n_tokens, tile: int = TILE):
    """Attention cost of lengths: tiles on and below the diagonal; a text of no tokens costs one."""
    side = np.maximum(1, -(-np.asarray(n_tokens) // tile))
    return side * (side + 1) // 2


def tiles_of(n_tokens: Column, tile: int = TILE) -> Column:
    side = F.greatest(F.ceil(n_tokens / tile), F.lit(1))
    return (side * (side + 1) / 2).cast("bigint")


def best_fit(
    lengths: np.ndarray, capacities: tuple[float, float, float], weights: tuple[float, float, float] = WEIGHTS, select: str = "norm", tile: int = TILE, room: float = ROOM
) -> np.ndarray:
    """The container, from 0, of each item; lengths must fall and none may be over a capacity.

    select: "norm" takes the container whose weighted residual is smallest once the item is
    in; "dot" the one whose residual has the largest weighted dot product with the item,
    per length of the residual. Ties go to the container opened first.
    """
    cap = np.array(capacities, dtype=float)
    w = np.array(weights)
    n = len(lengths)
    costs = tiles(lengths, tile)
    long = lengths >= cap[0] / cap[1]
    keep = room * lengths[~long].sum() / max(1.0, math.ceil(lengths.sum() / cap[0])) if n else 0.0
    need_least = np.array([float(lengths[-1]) if n else 0.0, 1.0, float(costs[-1]) if n else 0.0])
    at = np.empty(n, dtype=np.int64)
    res = np.empty((1024, 3))
    ids = np.empty(1024, dtype=np.int64)
    open_n = opened = 0
    for i, length in enumerate(lengths):
        need = np.array([length, 1.0, costs[i]], dtype=float)
        r = res[:open_n]
        fits = np.flatnonzero((r >= need + (keep if long[i] else 0.0, 0.0, 0.0)).all(axis=1))
        if len(fits):
            share = (r[fits] - need) / cap
            if select == "norm":
                k = fits[np.argmin((w * share * share).sum(axis=1))]
            else:
                have = r[fits] / cap
                k = fits[np.argmax((w * have * (need / cap)).sum(axis=1) / np.maximum(np.sqrt((w * have * have).sum(axis=1)), 1e-12))]
        else:
            if open_n == len(res):
                res, ids = np.concatenate([res, np.empty_like(res)]), np.concatenate([ids, np.empty_like(ids)])
            k, open_n = open_n, open_n + 1
            res[k], ids[k] = cap, opened
            opened += 1
        at[i] = ids[k]
        res[k] -= need
        if (res[k] < need_least).any():  # closed: not even the least item fits
            open_n -= 1
            # keep the order of opening, by which ties are settled
            res[k:open_n], ids[k:open_n] = res[k + 1 : open_n + 1].copy(), ids[k + 1 : open_n + 1].copy()
    return at


def full_cost(capacity: int, tile: int = TILE) -> int:
    """The attention cost of a container's longest piece."""
    return int(tiles(capacity, tile))


def pack(
    docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, max_docs: int = MAX_DOCS,
    attention: int | None = None, shard: int = SHARD, select: str = "norm", vocabulary: str = VOCABULARY, tile: int = TILE, room: float = ROOM, weights: tuple[float, float, float] = WEIGHTS,
) -> DataFrame:
    """id, piece, start_token, n_tokens, container_id: where each document, or piece of one, goes.

    A document of at most `capacity` tokens is one piece, 0; a longer one is cut every
    `capacity` tokens, and only its last piece shares a container. A null or empty text
    is a piece of no tokens. attention: a container's capacity in tiles, of one full piece
    unless given; it may not be less. Repeated ids are packed row by row.
    """
    attention = full_cost(capacity, tile) if attention is None else attention
    if attention < full_cost(capacity, tile) or max_docs < 1:
        raise ValueError("a full piece must fit into a container")
    # written with its rows' numbers: dealing is the same however often a task is run again, and no text is tokenized twice
    lengths, _ = written(with_tokens(docs, [id], text, vocabulary).withColumn("row", F.monotonically_increasing_id()))
    last = F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, F.lit(0)).cast("int")
    pieces = lengths.select(id, "row", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        F.col(id).alias("id"), "row", "piece", (F.col("piece") * F.lit(capacity)).cast("bigint").alias("start_token"),
        F.least(F.col("n_tokens") - F.col("piece") * capacity, F.lit(capacity)).cast("bigint").alias("n_tokens"),
    )
    n_pieces = lengths.agg(F.coalesce(F.sum(F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1))), F.lit(0))).first()[0]
    shards = max(1, math.ceil(n_pieces / shard))
    kind = docs.schema[id].dataType.simpleString()

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "row", "piece"], ascending=[False, True, True], kind="stable")
        found = best_fit(group["n_tokens"].to_numpy(), (capacity, max_docs, attention), weights, select, tile, room)
        group["container_id"] = (group["shard"].to_numpy(dtype=np.int64) << 32) + found
        return group.drop(columns=["shard", "row"])

    # by row, not by id: an id that very many rows share doesn't make a large shard
    deal = F.pmod(F.xxhash64("row", "piece"), F.lit(shards))
    out = f"id {kind}, piece int, start_token bigint, n_tokens bigint, container_id bigint"
    # a given number of partitions, as one task may not fill many shards one after another
    dealt = pieces.withColumn("shard", deal).repartition(min(shards, MOST_TASKS), "shard")
    return dealt.groupBy("shard").applyInPandas(fill, out).withColumnRenamed("id", id)


def containers(packed: DataFrame, tile: int = TILE) -> DataFrame:
    """container_id, tokens, docs, cost of each container."""
    cost = tiles_of(F.col("n_tokens"), tile)
    return packed.groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"), F.sum(cost).alias("cost"))


def fill_report(packed: DataFrame, capacity: int = CAPACITY, max_docs: int = MAX_DOCS, attention: int | None = None, tile: int = TILE) -> DataFrame:
    """One row: containers, pieces, tokens, the share of capacity that is filled, the fewest containers possible, and how many have no document or attention left."""
    attention = full_cost(capacity, tile) if attention is None else attention
    per = containers(packed, tile)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(
        F.count("*").alias("containers"), total("docs").alias("pieces"), total("tokens").alias("tokens"),
        F.try_divide(F.sum("tokens"), F.count("*") * capacity).alias("filled"), F.coalesce(F.max("tokens"), F.lit(0)).alias("fullest"),
        F.ceil(total("tokens") / capacity).alias("least_containers"),
        F.count(F.when(F.col("docs") == max_docs, 1)).alias("full_of_docs"), F.count(F.when(F.col("cost") == attention, 1)).alias("full_of_attention"),
    )


def packing_faults(packed: DataFrame, docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, max_docs: int = MAX_DOCS, attention: int | None = None, vocabulary: str = VOCABULARY, tile: int = TILE) -> DataFrame:
    """One row: documents; containers over each capacity; documents not packed token by token exactly once. Ids must be unique and not null."""
    attention = full_cost(capacity, tile) if attention is None else attention
    over = containers(packed, tile).agg(
        F.count(F.when(F.col("tokens") > capacity, 1)).alias("over_tokens"), F.count(F.when(F.col("docs") > max_docs, 1)).alias("over_docs"), F.count(F.when(F.col("cost") > attention, 1)).alias("over_attention")
    )
    per = packed.groupBy(id).agg(
        F.count("*").alias("k"), F.countDistinct("piece").alias("kinds"), F.max("piece").alias("last"), F.sum("n_tokens").alias("t"),
        F.max((F.col("start_token") != F.col("piece").cast("bigint") * capacity).cast("int")).alias("off"), F.count(F.when(F.col("n_tokens") < capacity, 1)).alias("partial"),
    )
    whole = (F.col("k") == F.col("last") + 1) & (F.col("kinds") == F.col("k")) & (F.col("t") == F.col("n_tokens")) & (F.col("off") == 0) & (F.col("partial") <= 1)
    of = with_tokens(docs, [id], text, vocabulary).join(per, id, "full")
    wrong = of.agg(F.count("*").alias("documents"), F.count(F.when(~F.coalesce(whole, F.lit(False)), 1)).alias("not_whole"))
    return wrong.crossJoin(F.broadcast(over))
