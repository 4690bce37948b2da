"""Checks of tables: columns, ranges, completeness, duplicates, geometry, counts."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ValidationError(ValueError):
    pass


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValidationError(f"missing columns: {', '.join(missing)}")


def ranges(df: DataFrame, fields: Iterable[str], most_missing: float = 0.1) -> DataFrame:
    """field, n_rows, missing (null or NaN), least, most, incomplete (more than that share missing); one scan."""
    fields = list(fields)
    value = {f: F.col(f).cast("double") for f in fields}
    ok = {f: F.when(~F.isnan(value[f]), value[f]) for f in fields}
    one = df.agg(F.count("*").alias("n"), *(a for f in fields for a in (F.count(ok[f]).alias(f"c_{f}"), F.min(ok[f]).alias(f"l_{f}"), F.max(ok[f]).alias(f"m_{f}"))))
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"c_{f}")).alias("missing"), F.col(f"l_{f}").alias("least"), F.col(f"m_{f}").alias("most")) for f in fields))
    return one.select(F.inline(rows)).withColumn("incomplete", F.coalesce(F.try_divide("missing", "n_rows") > most_missing, F.lit(False)))


def in_range(df: DataFrame, fields: Iterable[str], low: float, high: float, slack: float = 0.01, strict: bool = True) -> list[str]:
    """The fields with values beyond low..high; raises if strict."""
    found = ranges(df, fields).collect()
    bad = [r["field"] for r in found if r["least"] is not None and (r["least"] < low - slack or r["most"] > high + slack)]
    if bad and strict:
        raise ValidationError(f"beyond {low}..{high}: {', '.join(bad)}")
    return bad


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """key, n of keys with more than one row; a null key is one key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def geometry_counts(df: DataFrame, wkt: str) -> DataFrame:
    """n_rows, missing, open_rings: rows without a geometry, and polygons with a ring that isn't closed or has under four points."""
    rings = F.regexp_extract_all(F.col(wkt), F.lit(r"\(([^()]+)\)"), F.lit(1))
    bad = F.exists(rings, lambda r: (F.size(F.split(r, ",")) < 4) | (F.trim(F.get(F.split(r, ","), 0)) != F.trim(F.element_at(F.split(r, ","), -1))))
    polygon = F.col(wkt).rlike("(?i)^\\s*(MULTI)?POLYGON")
    none = F.col(wkt).isNull() | (F.trim(wkt) == "") | F.lower(F.trim(wkt)).isin("nan", "point empty")
    return df.agg(F.count("*").alias("n_rows"), F.count_if(none).alias("missing"), F.count_if(polygon & bad).alias("open_rings"))


def count_between(df: DataFrame, low: int, high: int) -> bool:
    return low <= df.count() <= high


def validate(df: DataFrame, required: Iterable[str], key: str, scores: Iterable[str] = (), low: float = 1.0, high: float = 10.0) -> dict[str, object]:
    """All checks: columns and scores raise, the others are reported."""
    require_columns(df, [*required, key, *scores])
    if scores:
        in_range(df, scores, low, high)
    return {"duplicate_keys": duplicates(df, key).count(), "incomplete": [r["field"] for r in ranges(df, scores).where("incomplete").collect()] if scores else []}


def any_null(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows with a null in any of the columns."""
    return df.where(reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns)))
