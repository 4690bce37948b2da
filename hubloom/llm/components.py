"""Consolidating pairwise matches into groups by pruning to seeds and flowing back.

Every round, each vertex points its neighbourhood (itself included) to the smallest id in
it. A vertex nobody points to is no possible seed any more: it drops out of the graph and
hangs itself under the smallest id it was pointed to, an edge of the propagation forest.
The others are joined to that id and go on. The graph shrinks fast and is empty after
few rounds; then the seeds' ids flow down the forest by pointer jumping.

A vertex with very many neighbours is one row per neighbour throughout: minima are
aggregated before the shuffle, the joins on it are split by adaptive execution, and no
neighbourhood is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubloom.session import drop_written, exists, written, written_by

EDGE, TREE = 0, 1


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """id, root: the smallest id linked with each vertex, directly or through others.

    edges: pairs of BIGINT ids in either order, repeated or not. Edges with a null end are
    left out; an edge from a vertex to itself makes it a vertex. No edges, no rows.
    """
    spark = edges.sparkSession
    known = edges.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).where("u is not null and v is not null")
    pairs, _ = written(known.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    loops = pairs.where("u = v").select("u")
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    graph = pairs.where("u <> v").select(F.inline(ways))
    layers: list[str] = []
    old = ""
    for _ in range(max_rounds):
        least = graph.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        pointed = graph.join(least, "u").select(F.col("v").alias("x"), "m").unionByName(least.select(F.col("u").alias("x"), "m"))
        chosen = pointed.distinct()
        top = chosen.groupBy("x").agg(F.min("m").alias("top"), F.max(F.col("m") == F.col("x")).alias("stays"))
        # of each vertex: its edges to the least id it was pointed to, and, once, the tree edge if it drops out
        edge = F.array(F.struct(F.lit(EDGE).alias("kind"), F.col("top").alias("u"), F.col("m").alias("v")), F.struct(F.lit(EDGE).alias("kind"), F.col("m").alias("u"), F.col("top").alias("v")))
        drop = F.array(F.struct(F.lit(TREE).alias("kind"), F.col("x").alias("u"), F.col("top").alias("v")))
        out = F.when(F.col("m") != F.col("top"), edge).when(~F.col("stays"), drop)
        at = written_by(chosen.join(top, "x").select(F.inline(out)).distinct(), "kind")
        if exists(spark, f"{at}/kind={TREE}"):
            layers.append(f"{at}/kind={TREE}")
        if old:
            drop_written(spark, f"{old}/kind={EDGE}")
        old = at
        if not exists(spark, f"{at}/kind={EDGE}"):
            break
        graph = spark.read.schema("u bigint, v bigint").parquet(f"{at}/kind={EDGE}")
    else:
        raise RuntimeError(f"not consolidated after {max_rounds} rounds")
    tree = spark.createDataFrame([], "child bigint, parent bigint")
    if layers:
        tree = spark.read.schema("u bigint, v bigint").parquet(*layers).select(F.col("u").alias("child"), F.col("v").alias("parent"))
    # a parent is always smaller than its child, so every path ends in a seed
    old = ""
    while layers:
        # only parents that hang under another go on; each is one row here, however many children it has
        onward = tree.join(tree.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")
        onward, onward_at = written(onward)
        if onward.isEmpty():
            break
        up = onward.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
        tree, at = written(tree.join(up, "parent", "left").select("child", F.coalesce("above", "parent").alias("parent")))
        drop_written(spark, onward_at)
        if old:
            drop_written(spark, old)
        old = at
    seeds = tree.select(F.col("parent").alias("id")).unionByName(loops.select(F.col("u").alias("id"))).distinct()
    lone = seeds.join(tree.select(F.col("child").alias("id")), "id", "left_anti")
    return tree.select(F.col("child").alias("id"), F.col("parent").alias("root")).unionByName(
        lone.select("id", F.col("id").alias("root"))
    )
