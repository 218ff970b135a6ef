"""Driver tables as market data: events become quotes, line items become trades (deterministic, by expressions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E

#: Names by which the mapped symbols are known elsewhere.
ALIASES = {"click": "CLK", "view": "VIEW"}


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw book rows (seq, event_us, recv_us, sym, venue, inst, bid, ask): some crossed, some one-sided, some without exchange time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("value") > 0)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    half = F.col("value") * (1 + F.col("event_id") % 7) * 0.0001
    crossed = F.col("event_id") % 41 == 0
    return e.select(
        F.col("event_id").alias("seq"), us.alias("event_us"), (us + F.when(F.col("event_id") % 29 == 0, 0).otherwise(20000 + (F.col("event_id") * 7919) % 180000)).alias("recv_us"),
        F.col("event_type").alias("sym"), F.concat(F.lit("V"), (F.col("user_id") % 3).cast("string")).alias("venue"), F.when(F.floor(F.col("user_id") / 3) % 2 == 0, "SPOT").otherwise("PERP").alias("inst"),
        F.when(F.col("event_id") % 53 != 0, F.col("value") + F.when(crossed, half).otherwise(-half)).alias("bid"), (F.col("value") + F.when(crossed, -half).otherwise(half)).alias("ask"),
    )


BOOK_SQL = """
b AS (
  SELECT event_id AS seq, epoch_us(ts) AS event_us, epoch_us(ts) + CASE WHEN event_id % 29 = 0 THEN 0 ELSE 20000 + (event_id * 7919) % 180000 END AS recv_us,
    event_type AS sym, 'V' || (user_id % 3) AS venue, CASE WHEN (user_id // 3) % 2 = 0 THEN 'SPOT' ELSE 'PERP' END AS inst,
    CASE WHEN event_id % 53 <> 0 THEN value + CASE WHEN event_id % 41 = 0 THEN 1 ELSE -1 END * (value * (1 + event_id % 7) * CAST(0.0001 AS DOUBLE)) END AS bid,
    value + CASE WHEN event_id % 41 = 0 THEN -1 ELSE 1 END * (value * (1 + event_id % 7) * CAST(0.0001 AS DOUBLE)) AS ask
  FROM events WHERE value > 0
), q AS (SELECT *, (bid + ask) / 2 AS mid FROM b WHERE bid < ask)
"""


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid quotes with their mid."""
    return book(spark, sf_dir).where(E.valid_book(F.col("bid"), F.col("ask"))).withColumn("mid", (F.col("bid") + F.col("ask")) / 2)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    us = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), us.alias("event_us"), us.alias("recv_us"), F.concat(F.lit("P"), (F.col("l_partkey") % 5).cast("string")).alias("sym"), F.concat(F.lit("V"), (F.col("l_suppkey") % 3).cast("string")).alias("venue"),
        F.lit("SPOT").alias("inst"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.col("l_quantity").alias("qty"), F.when(F.col("l_linestatus") == "O", "B").otherwise("S").alias("side"),
    )


TRADES_SQL = """
t AS (
  SELECT l_orderkey * 10 + l_linenumber AS seq, epoch_us(l_shipdate) AS event_us, epoch_us(l_shipdate) AS recv_us, 'P' || (l_partkey % 5) AS sym, 'V' || (l_suppkey % 3) AS venue,
    'SPOT' AS inst, l_extendedprice / l_quantity AS px, l_quantity AS qty, CASE WHEN l_linestatus = 'O' THEN 'B' ELSE 'S' END AS side
  FROM lineitem
)
"""
