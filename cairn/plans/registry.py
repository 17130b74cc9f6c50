"""Queries by name: a function of (spark, sf_dir), and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded for comparison with another engine."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


#: The canonical probes in SQL, for oracles.
PROBES = """
probes AS (
  SELECT user_id AS trace, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INT) AS i,
    COUNT(*) AS nv, COUNT(*) FILTER (WHERE event_type <> 'error') AS nt FROM events GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN nv > 0 THEN 1.0 - CAST(nt AS DOUBLE) / nv ELSE 0.5 END AS r FROM probes),
steps AS (
  SELECT *, LAG(i) OVER w AS prev_i, LAG(r) OVER w AS prev_r, LAG(nv) OVER w AS prev_nv, i - LAG(i) OVER w AS gap, r - LAG(r) OVER w AS delta
  FROM p WINDOW w AS (PARTITION BY trace ORDER BY i)),
firsts AS (
  SELECT trace, arg_min(prev_i, i) AS juncture, arg_min(delta, i) AS jump FROM steps WHERE abs(delta) >= 0.30 AND gap = 1 GROUP BY trace)
"""


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    p, z = f"(CAST({k} AS DOUBLE) / {n})", "1.96"
    middle = f"(({p} + {z} * {z} / (2.0 * {n})) / (1 + {z} * {z} / {n}))"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0 * {n} * {n})) / (1 + {z} * {z} / {n}))"
    return f"CASE WHEN {n} > 0 THEN GREATEST(0.0, {middle} - {half}) END", f"CASE WHEN {n} > 0 THEN LEAST(1.0, {middle} + {half}) END"


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")
