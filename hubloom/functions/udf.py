"""Functions for spark.sql: SQL functions, which Catalyst inlines, and one table function in Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from hubloom.functions import hexgrid
from hubloom.functions import settings as S

_QUOTED = ", ".join(f"'{m}'" for m in S.MASS_TRANSIT)
_CELL = f"""
WITH a AS (SELECT (x * {3**0.5 / 3!r} - y / 3) / {hexgrid.EDGE} AS q, (y * {2 / 3!r}) / {hexgrid.EDGE} AS r),
b AS (SELECT *, floor(q + 0.5D) AS rq, floor(r + 0.5D) AS rr, floor(-q - r + 0.5D) AS rs FROM a),
d AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs + q + r) AS ds FROM b)
SELECT concat_ws(':', CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT), CAST(CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END AS BIGINT)) FROM d
"""


def register(spark: SparkSession) -> None:
    """hebrew_ratio(text), mass_transit_modes(array), tier_of_demand(double), saaty(double), hex_cell(x, y), hex_ring(q, r, k)."""
    sql = {
        "hebrew_ratio(s STRING) RETURNS DOUBLE": r"try_divide(CAST(length(regexp_replace(s, '[^\\u0590-\\u05FF]', '')) AS DOUBLE), length(regexp_replace(s, '\\s', '')))",
        "mass_transit_modes(m ARRAY<STRING>) RETURNS INT": f"size(filter(m, x -> x IN ({_QUOTED})))",
        "tier_of_demand(d DOUBLE) RETURNS STRING": f"CASE WHEN isnan(d) THEN '{S.LOCAL}' WHEN d >= {S.TIER_DEMAND[0]} THEN '{S.NATIONAL}' WHEN d >= {S.TIER_DEMAND[1]} THEN '{S.METROPOLITAN}' ELSE '{S.LOCAL}' END",
        "saaty(v DOUBLE) RETURNS DOUBLE": "CASE WHEN v = 0 THEN 1D WHEN v > 0 THEN v + 1 ELSE 1 / (abs(v) + 1) END",
        "hex_cell(x DOUBLE, y DOUBLE) RETURNS STRING": f"({_CELL})",
    }
    for signature, body in sql.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")

    from pyspark.sql.functions import udtf

    class HexRing:
        """The cells at most k steps from a cell."""

        def eval(self, q: int, r: int, k: int):
            for i in range(-k, k + 1):
                for j in range(max(-k, -i - k), min(k, -i + k) + 1):
                    yield q + i, r + j

    spark.udtf.register("hex_ring", udtf(HexRing, returnType="q bigint, r bigint"))
