"""Registration of queries, and fixtures derived from the driver's tables.

A fixture is SQL that Spark and DuckDB read alike; ``{name}`` stands for a table. Query and oracle start from the same fixture, and
go on independently: operators on one side, SQL on the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from furrow.storage import ship

Query = Callable[[SparkSession, str], DataFrame]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

#: Boxes of 40 x 40 in frames of eight orders; the id numbers a frame's boxes in an order of all columns.
DETECTIONS = """
SELECT frame_index, class_id, confidence, x1, y1, x1 + 40 AS x2, y1 + 40 AS y2,
  CAST(row_number() OVER (PARTITION BY frame_index ORDER BY k1, k2, k3, k4, k5, k6, k7, k8, k9) AS BIGINT) AS detection_id
FROM (SELECT CAST(floor(l_orderkey / 8) AS BIGINT) AS frame_index, CAST(l_linenumber % 2 AS INT) AS class_id, l_quantity / 50 AS confidence,
  CAST((l_partkey * 37 + l_suppkey * 11) % 360 AS DOUBLE) AS x1, CAST((l_partkey * 53 + l_linenumber * 29) % 160 AS DOUBLE) AS y1,
  l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4, l_extendedprice AS k5, l_discount AS k6, l_tax AS k7, l_shipdate AS k8, l_quantity AS k9
  FROM {lineitem}) AS d
"""
POINTS = """
SELECT event_id AS id, event_id % 4 AS g, CAST(event_id * 7919 % 10007 AS DOUBLE) / 10 AS x, CAST(event_id * 104729 % 10009 AS DOUBLE) / 10 AS y, value AS v,
  CAST(event_id * 31 % 97 AS DOUBLE) / 97 AS w, event_type AS kind FROM {events}
"""
#: Plants on rows 60 apart, 40 apart in a row, with holes; a plot is 20 rows of 50.
PLANTS = """
SELECT p_partkey AS plant_id, CAST(floor(p_partkey / 1000) AS BIGINT) AS plot_id, CAST(floor(p_partkey % 1000 / 50) AS BIGINT) AS row_id,
  CAST(p_partkey % 50 * 40 AS DOUBLE) + p_partkey % 3 AS along, CAST(floor(p_partkey % 1000 / 50) * 60 AS DOUBLE) + p_partkey % 5 AS across
FROM {part} WHERE p_partkey * 7 % 23 <> 0 AND p_partkey * 13 % 101 <> 0
"""
#: Flights of frames and of telemetry intervals.
FRAMES = """
SELECT o_orderkey % 8 AS flight, CAST(floor(o_orderkey / 8) AS BIGINT) AS frame_index, CAST(floor(o_orderkey / 8) AS DOUBLE) * 4 / 10 + 0.1 AS query_time,
  o_orderstatus AS status, o_totalprice AS price, o_orderkey AS k FROM {orders}
"""
TELEMETRY = """
SELECT event_id % 8 AS flight, CAST(floor(event_id / 8) AS BIGINT) AS srt_index, CAST(floor(event_id / 8) AS DOUBLE) / 2 + CAST(event_id % 3 AS DOUBLE) / 20 AS start_seconds,
  CAST(floor(event_id / 8) AS DOUBLE) / 2 + CAST(event_id % 3 AS DOUBLE) / 20 + 0.3 AS end_seconds, value AS altitude FROM {events}
"""


def plain(sql: str) -> str:
    """The fixture for DuckDB."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The fixture in Spark."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def query(oracle: str | None = None, **fixtures: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a function of the named fixtures. The oracle sees them as common table expressions of the same names."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        name = f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(**{k: made(spark, sf_dir, v) for k, v in fixtures.items()})

        _queries[name] = run
        if oracle is not None:
            heads = ", ".join(f"{k} AS ({plain(v).strip()})" for k, v in fixtures.items())
            recursive = "RECURSIVE " if "RECURSIVE" in oracle else ""
            body = oracle.replace("RECURSIVE", "").strip()
            _oracles[name] = f"WITH {recursive}{heads}{', ' + body[5:] if body.startswith('WITH ') else ' ' + body}"
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
