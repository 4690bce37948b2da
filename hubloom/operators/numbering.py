"""Global row numbers without a window over everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hubloom.session import written


def parts_ahead(written_parts: DataFrame, size: Column) -> DataFrame:
    """_part, _ahead: what the sorted partitions before each one hold, by a window over one row for each partition."""
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return written_parts.groupBy("_part").agg(size.alias("_size")).select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_ahead"))


def number_in_order(df: DataFrame, *order: Column | str, name: str = "number") -> DataFrame:
    """df with `name`, 1.. in the given order: sorted over the cluster, then numbered by the sorted partitions' row counts.

    The counts, a row for each partition, are joined to the rows. An empty table has no numbers.
    """
    ordered = df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    out, _ = written(ordered)
    within = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    ahead = F.broadcast(parts_ahead(out, F.count("*")))  # as many rows as partitions
    return out.join(ahead, "_part").withColumn(name, (F.col("_ahead") + within + 1).cast("bigint")).drop("_part", "_row", "_ahead")


def seeded_sample(df: DataFrame, id: str, n: int, seed: int) -> DataFrame:
    """n rows, the first by a seeded hash of their id: the same rows on any cluster. A sampling operator."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}/"), F.col(id).cast("string"))), id).limit(n)
