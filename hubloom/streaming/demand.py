"""Demand as a stream: files are read as they come and summed by model and node. An extension of the batch aggregation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as they come; a path to one file is that file of its folder."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).load(at.getParent().toString())
    return reader.load(path)


def demand_totals(stream: DataFrame) -> DataFrame:
    """model, node, demand, transfers of rows with those columns; rows without model or node are left out."""
    return stream.where("node is not null and model is not null").groupBy("model", "node").agg(
        F.coalesce(F.sum("demand"), F.lit(0.0)).alias("demand"), F.coalesce(F.sum("transfers"), F.lit(0.0)).alias("transfers")
    )


def windowed_demand(stream: DataFrame, at: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Demand by model in tumbling windows; rows later than the watermark are dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), "model").agg(F.sum("demand").alias("demand"), F.count("*").alias("n"))


def upsert_totals(totals: DataFrame, path: str, checkpoint: str, on_batch: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Writes what is there now: each batch's totals replace those of the batches before it, in a folder of its own.

    The state of the aggregation holds all totals; the update of a batch is written under
    its number, so a repeated batch overwrites itself. on_batch: scores anew, for example.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if on_batch:
            on_batch(batch)

    return totals.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The totals of the last batch that had each model and node."""
    t = spark.read.parquet(path)
    return t.groupBy("model", "node").agg(F.max_by(F.struct("demand", "transfers"), "batch").alias("t")).select("model", "node", "t.demand", "t.transfers")
