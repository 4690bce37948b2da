"""Writers: CSV, GeoJSON, simulation exports, ordered columns. All write in parallel, a file per partition."""

from __future__ import annotations

import datetime
from collections.abc import Iterable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """Arrays as text joined by commas, other nested columns as JSON: what CSV can hold."""
    def one(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.AtomicType):
            return F.array_join(c.cast("array<string>"), ",").alias(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(c).alias(f.name)
        return c

    return df.select(*map(one, df.schema.fields))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    flat(df).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def _coordinates(wkt: Column) -> Column:
    body = F.regexp_replace(F.regexp_extract(wkt, r"^[^(]*(\(.*\))\s*$", 1), r"\s*([(),])\s*", "$1")
    points = F.regexp_replace(body, r"([-\d.eE+]+) +([-\d.eE+]+)(?: +[-\d.eE+]+)?", "[$1,$2]")
    brackets = F.translate(points, "()", "[]")
    return F.when(F.upper(wkt).rlike(r"^\s*POINT"), F.regexp_replace(brackets, r"^\[\[|\]\]$", "")).otherwise(brackets)


def features(df: DataFrame, wkt: str = "geometry") -> DataFrame:
    """A GeoJSON feature per row, as one column of text: a file of such lines is a GeoJSON sequence."""
    g = F.col(wkt)
    kind = F.regexp_extract(F.upper(F.trim(g)), r"^(MULTIPOLYGON|POLYGON|POINT)", 1)
    name = F.create_map(*(F.lit(x) for x in ("POINT", "Point", "POLYGON", "Polygon", "MULTIPOLYGON", "MultiPolygon")))
    inner = _coordinates(g)
    inner = F.when(kind == "POINT", F.concat(F.lit("["), inner, F.lit("]"))).otherwise(inner)
    geometry = F.when((kind != "") & g.contains("("), F.concat(F.lit('{"type":"'), F.try_element_at(name, kind), F.lit('","coordinates":'), inner, F.lit("}"))).otherwise("null")
    properties = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns if c != wkt)), {"ignoreNullFields": "false"})
    return df.select(F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), geometry, F.lit("}")).alias("value"))


def write_geojson(df: DataFrame, path: str, wkt: str = "geometry", mode: str = "errorifexists") -> None:
    features(df, wkt).write.mode(mode).text(path)


def write_by_suffix(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """By suffix: csv, geojson, parquet, json; GeoJSON, with the suffix added, for others. Returns the path."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".csv":
        write_csv(df, path, mode)
    elif suffix in (".parquet", ".json"):
        df.write.mode(mode).format(suffix[1:]).save(path)
    else:
        path = path if suffix == ".geojson" else path + ".geojson"
        write_geojson(df, path, mode=mode)
    return path


def with_run_metadata(stats: DataFrame, digits: int = 6, **run: object) -> DataFrame:
    """Statistics rounded, with the run's parameters and time as columns."""
    out = stats.select(*(F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in stats.schema.fields))
    return out.withColumns({k: F.lit(v) for k, v in run.items()} | {"written_at": F.lit(datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds"))})


def ordered_columns(df: DataFrame, first: Iterable[str], by: str | None = None) -> DataFrame:
    """The columns of `first` that exist, in that order, then the others; rows sorted by a column if it exists."""
    head = [c for c in first if c in df.columns]
    out = df.select(*(f"`{c}`" for c in head), *(f"`{c}`" for c in df.columns if c not in head))
    return out.orderBy(by) if by and by in df.columns else out


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Several tables side by side in one folder, in place of the sheets of a workbook."""
    for name, df in tables.items():
        (flat(df) if fmt == "csv" else df).write.mode(mode).option("header", True).format(fmt).save(f"{folder}/{name}")
