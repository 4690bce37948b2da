"""Sessions and the shared folder in which long plans are cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on: UTC, AQE with skew joins."""
    builder = SparkSession.builder.appName("hubloom")
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return builder.config(map=defaults | conf).getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        package = Path(__file__).parent
        at = tempfile.mkdtemp(prefix="hubloom-code-")
        atexit.register(shutil.rmtree, at, True)
        spark.sparkContext.addPyFile(shutil.make_archive(f"{at}/hubloom", "zip", package.parent, package.name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset, on one machine (tests), a folder of this process.

    On a cluster it must be set: a folder of one machine would be no use to the others.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        at = tempfile.mkdtemp(prefix="hubloom-")
        atexit.register(shutil.rmtree, at, True)
        _OWN[app] = "file://" + at
    return _OWN[app]


def drop_written(spark: SparkSession, path: str) -> None:
    """Removes a table that `written` made."""
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _quietly_drop(spark: SparkSession, path: str) -> None:
    try:
        drop_written(spark, path)
    except Exception:  # the session is gone already: what lies on this machine can still go
        if path.startswith(("file:", "/")):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


_WRITTEN: list[tuple[SparkSession, str]] = []


def drop_all_written() -> None:
    """Drops every table written so far, once the results that read them are saved; at the latest this happens when the driver ends."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        _quietly_drop(spark, path)


atexit.register(drop_all_written)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def written_by(df: DataFrame, column: str) -> str:
    """Like `written`, with a folder {path}/{column}={value} for each value that has rows; the path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hubloom-{uuid.uuid4().hex}"
    df.write.partitionBy(column).parquet(path)
    _WRITTEN.append((spark, path))
    return path


def written(df: DataFrame, tidy: bool = False) -> tuple[DataFrame, str]:
    """Cuts the lineage: df as a Parquet table in the shared folder, and its path.

    All executors share the folder, so the table outlives any of them. It is
    dropped by `drop_written`, else when the driver ends. tidy: what was shuffled for it
    is removed from the executors' disks at once, not when the driver collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hubloom-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    if tidy:
        spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path
