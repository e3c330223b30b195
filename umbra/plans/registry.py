"""Where queries and their DuckDB oracles are registered, and the stand-in tables that several of them read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a table reader under ``name``, with its oracle."""

    def register(make: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: make(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            ORACLES[name] = sql
        return make

    return register


# --- stand-ins: points of interest from customers, way nodes from line items, fixes from events -----------------
POIS = "SELECT c_custkey AS id, 19.78 + (c_custkey % 440) / 1000.0 AS lon, 49.96 + (c_custkey * 7 % 170) / 1000.0 AS lat, c_mktsegment AS kind FROM customer"
NODES = """SELECT l_orderkey AS way_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
    l_quantity, l_extendedprice) AS seq, l_partkey AS node_id, l_partkey % 100 * 50.0 AS x, floor(l_partkey / 100) * 50.0 AS y FROM lineitem"""
FIXES = "SELECT event_id, user_id, ts, value AS offset_m, event_id % 130 * 1.0 AS accuracy_m, event_type FROM events"
SEGMENTS = "SELECT s_suppkey AS sid, s_suppkey * 37 % 900 * 1.0 AS x0, s_suppkey * 91 % 900 * 1.0 AS y0, s_suppkey * 37 % 900 + 60.0 AS x1, s_suppkey * 91 % 900 + s_suppkey % 50 * 1.0 AS y1 FROM supplier"
WALKERS = "SELECT c_custkey AS pid, c_custkey * 13 % 950 + 0.25 AS px, c_custkey * 29 % 950 + 0.5 AS py FROM customer"
RASTER = """SELECT vec_id AS "row", i AS "col", v AS value FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"""


def stand_in(read, table: str, statement: str) -> DataFrame:
    return read(table).sparkSession.sql(statement.replace(f"FROM {table}", "FROM {df}"), df=read(table))


def pois(read) -> DataFrame:
    return stand_in(read, "customer", POIS)


def nodes(read) -> DataFrame:
    return stand_in(read, "lineitem", NODES)


def fixes(read) -> DataFrame:
    return stand_in(read, "events", FIXES)


def raster(read) -> DataFrame:
    return read("embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "v")).select("row", "col", F.col("v").cast("double").alias("value"))
