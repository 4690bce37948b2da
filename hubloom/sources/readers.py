"""Readers with fixed schemas and ordered column candidates. Nothing is inferred that a schema can state."""

from __future__ import annotations

import codecs
import warnings
from collections.abc import Iterable, Mapping
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hubloom.functions import rules
from hubloom.functions import settings as S
from hubloom.functions.text import is_valid_hebrew
from hubloom.operators.validate import ValidationError
from hubloom.sources.formats import vector_layer, workbook

#: In the order they are tried.
ENCODINGS = ("windows-1255", "ISO-8859-8", "utf-8")
NODES = T.StructType([T.StructField("node", T.StringType()), T.StructField("LINE_ID", T.StringType()), T.StructField("X", T.DoubleType()), T.StructField("Y", T.DoubleType()), T.StructField("geometry", T.StringType())])


def resolve(columns: Iterable[str], candidates: Iterable[str], partly: bool = False) -> str | None:
    """The first candidate that is a column: as written, then whatever its case, then as part of a name."""
    columns = list(columns)
    low = {c.strip().lower(): c for c in reversed(columns)}
    for c in candidates:
        if c in columns:
            return c
        if c.strip().lower() in low:
            return low[c.strip().lower()]
    if partly:
        for c in candidates:
            for name in columns:
                if c.lower() in name.lower():
                    return name
    return None


def csv(spark: SparkSession, path: str, encoding: str = "utf-8", schema: T.StructType | None = None) -> DataFrame:
    """A CSV with a header. Other encodings than Spark's own need spark.sql.legacy.javaCharsets."""
    if encoding.lower() not in ("utf-8", "us-ascii", "iso-8859-1", "utf-16"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    r = spark.read.option("header", True).option("encoding", encoding).option("multiLine", True).option("escape", '"')
    return (r.schema(schema).option("enforceSchema", False) if schema is not None else r).csv(path)


def sniff_encoding(spark: SparkSession, path: str, columns: Iterable[str] | None = None, encodings: Iterable[str] = ENCODINGS) -> str:
    """The first encoding under which a few values of the text columns are plausible Hebrew; utf-8 if none is.

    A byte sequence that is valid UTF-8 with Hebrew letters is taken as UTF-8 at once. Only
    the head of the file is read.
    """
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 1 << 16).alias("c")).first()
    raw = bytes(head["c"]) if head else b""
    try:  # the head may end within a character
        if any("\u0590" <= ch <= "\u05ff" for ch in codecs.getincrementaldecoder("utf-8")().decode(raw)):
            return "utf-8"
    except UnicodeDecodeError:
        pass
    for encoding in encodings:
        df = csv(spark, path, encoding)
        names = [c for c in (columns or df.columns) if c in df.columns]
        sample = df.select(*names).limit(5)
        if names and sample.where(reduce(lambda a, b: a & b, (is_valid_hebrew(F.col(f"`{c}`")) for c in names))).count() == sample.count() > 0:
            return encoding
    return "utf-8"


def transit_nodes(spark: SparkSession, path: str, encoding: str = "windows-1255") -> DataFrame:
    """node, line_id, x, y, geometry of a nodes CSV; needs node, LINE_ID and either geometry or X and Y."""
    raw = csv(spark, path, encoding)
    node, line = resolve(raw.columns, ("node",)), resolve(raw.columns, ("LINE_ID",))
    x, y, g = (resolve(raw.columns, (c,)) for c in ("X", "Y", "geometry"))
    if node is None or line is None or (g is None and (x is None or y is None)):
        raise ValidationError("needs node, LINE_ID, and geometry or X and Y")
    col = lambda c, t: F.col(f"`{c}`").try_cast(t) if c else F.lit(None).cast(t)
    return raw.select(
        F.col(f"`{node}`").try_cast("double").try_cast("bigint").alias("node"), F.col(f"`{line}`").alias("line_id"), col(x, "double").alias("x"), col(y, "double").alias("y"), col(g, "string").alias("geometry")
    )


def lines_modes(spark: SparkSession, path: str, encoding: str = "windows-1255") -> DataFrame:
    """line_model_name, mode_planned, area; columns the file lacks are null."""
    raw = csv(spark, path, encoding)
    names = {"line_model_name": ("Line_ModelName", "line_model_name"), "mode_planned": ("Mode_Planned",), "area": ("Area",)}
    found = {n: resolve(raw.columns, c) for n, c in names.items()}
    return raw.select(*((F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(n) for n, c in found.items()))


def demand_workbook(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, model, sheet, row_no, body, error: the rows of workbooks as JSON bodies, as the drift operators take them.

    A sheet that can't be read is a row with its error; a sheet's region is its model where it is known.
    """
    w = workbook(spark, path)
    known = F.create_map(*(F.lit(x) for kv in S.SHEET_REGIONS.items() for x in kv))
    model = F.coalesce(F.try_element_at(known, F.lower(F.trim("sheet"))), F.col("sheet"))
    return w.select("path", model.alias("model"), "sheet", "row_no", F.to_json("cells").alias("body"), "error")


def demand_sheets(spark: SparkSession, paths: Mapping[str, str], reader=None) -> DataFrame:
    """One long table with a model column of many sheets with different columns. Sheets that can't be read are left out, with a warning.

    Any columnar or text format does as a sheet; for workbooks see `demand_workbook`.
    """
    frames = []
    for model, path in paths.items():
        try:
            df = (reader or csv)(spark, path)
        except Exception as e:
            warnings.warn(f"sheet {model} left out: {type(e).__name__}: {e}".splitlines()[0], stacklevel=2)
            continue
        region = S.SHEET_REGIONS.get(model.strip().lower(), model)
        frames.append(df.select(*(F.col(f"`{c}`").cast("string").alias(c.strip()) for c in df.columns)).withColumn("model", F.lit(region)))
    if not frames:
        raise ValidationError("no sheet could be read")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """A row per feature: its properties as a map, and its geometry as WKT (points, polygons, multipolygons)."""
    # coordinates are kept as text: their depth differs by type
    schema = "features array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    c = F.regexp_replace(F.col("f.geometry.coordinates"), r"\s", "")
    kind = F.upper(F.col("f.geometry.type"))
    # innermost lists are points: "[1,2]" is "1 2"; the other brackets are parentheses
    points = F.regexp_replace(c, r"\[(-?[\d.eE+-]+),(-?[\d.eE+-]+)(?:,-?[\d.eE+-]+)?\]", "$1 $2")
    body = F.translate(points, "[]", "()")
    wkt = F.when(kind == "POINT", F.concat(F.lit("POINT ("), body, F.lit(")"))).otherwise(F.concat_ws(" ", kind, F.regexp_replace(body, ",", ", ")))
    return f.select(F.col("f.properties").alias("properties"), wkt.alias("geometry"))


def taz_zones(df: DataFrame) -> DataFrame:
    """df with pop_2050 and empl_2050 as numbers, 0 where missing; the columns are found whatever their case, or as part of a name."""
    out = df
    for name, candidates in (("pop_2050", ("POP_2050", "POP")), ("empl_2050", ("EMPL_2050", "EMPL", "EMP"))):
        c = resolve(df.columns, candidates, partly=True)
        value = F.coalesce(rules.no_nan(F.col(f"`{c}`").try_cast("double")), F.lit(0.0)) if c else F.lit(0.0)
        out = out.withColumn(name, value)
        out = out.drop(c) if c and c.lower() != name else out
    return out


def optional(read, *args) -> DataFrame | None:
    """What the reader gives; None where it fails, for layers that may be missing."""
    try:
        return read(*args)
    except Exception as e:
        warnings.warn(f"layer left out: {type(e).__name__}: {e}".splitlines()[0], stacklevel=2)
        return None


def table_by_suffix(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """csv, parquet, json, geojson, orc, shp, gpkg and xlsx by suffix; ValueError for others."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".csv":
        return csv(spark, path, encoding)
    if suffix == ".geojson":
        return geojson(spark, path)
    if suffix in (".shp", ".gpkg"):
        return vector_layer(spark, path, encoding)
    if suffix == ".xlsx":
        return workbook(spark, path)
    if suffix in (".parquet", ".json", ".orc"):
        return spark.read.format(suffix[1:]).load(path)
    raise ValueError(f"no reader for {suffix or path}")


def expert_comparisons(df: DataFrame, expert: str = "expert") -> DataFrame:
    """expert, criterion_a, criterion_b, value of a long table, or of a matrix with a row and a column per criterion."""
    names = [c.lower() for c in df.columns]
    if {"criterion_a", "criterion_b", "value"} <= set(names):
        who = F.col("expert") if "expert" in names else F.lit(expert)
        return df.select(who.alias("expert"), "criterion_a", "criterion_b", F.col("value").try_cast("double").alias("value"))
    index, columns = df.columns[0], df.columns[1:]
    long = df.select(F.col(f"`{index}`").alias("criterion_a"), *(F.col(f"`{c}`").try_cast("double").alias(c) for c in columns)).unpivot(["criterion_a"], columns, "criterion_b", "value")
    return long.where("criterion_a < criterion_b").select(F.lit(expert).alias("expert"), "criterion_a", "criterion_b", "value")


def first_existing(spark: SparkSession, paths: Iterable[str]) -> str | None:
    """The first path that exists, on any file system Spark can reach."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            return p
    return None
