"""Bars and ticks derived from the driver's tables, in Spark and as SQL text of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import roles as r
from ..functions.schema import BarSchema


def read_bars(spark: SparkSession, path: str, timestamp_col: str = "timestamp", format: str = "parquet") -> DataFrame:
    """Any Spark source; a timestamp without zone is taken as UTC."""
    frame = spark.read.format(format).load(path)
    return frame.withColumn(timestamp_col, F.col(timestamp_col).cast("timestamp"))


def write_features(features: DataFrame, path: str, timestamp_col: str = "timestamp", format: str = "parquet") -> None:
    """Partitioned by year, so that readers of a period open only its files."""
    features.withColumn("year", F.year(timestamp_col)).repartition("year").write.mode("overwrite").format(format).partitionBy("year").save(path)


# --- daily bars -------------------------------------------------------------------------------

DAILY = BarSchema.ohlcv(vwap="vwap", dollar_volume="dollar_volume", market_ret="market_ret")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of lineitem by return flag, on dates on which every flag has one; market_ret is the mean return."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("timestamp"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), F.col("l_quantity").alias("q"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("k"))
    bars = lines.groupBy("symbol", "timestamp").agg(F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.sum("q").alias("volume"), F.sum(F.col("p") * F.col("q")).alias("dollar_volume"))
    bars = complete(bars).withColumn("vwap", F.try_divide("dollar_volume", "volume"))
    back = F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("timestamp")) - 1
    return bars.withColumn("__r", back).withColumn("market_ret", F.avg("__r").over(Window.partitionBy("timestamp"))).drop("__r")


def complete(bars: DataFrame) -> DataFrame:
    """The times at which every symbol has a bar."""
    symbols = bars.agg(F.countDistinct("symbol")).scalar()
    times = bars.groupBy("timestamp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == symbols).select("timestamp")
    return bars.join(times, "timestamp", "left_semi")


DAILY_SQL = """daily_lines AS (
  SELECT l_returnflag AS symbol, l_shipdate AS timestamp, l_extendedprice / l_quantity AS p, l_quantity AS q, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
), daily_all AS (
  SELECT symbol, timestamp, first(p ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS open, max(p) AS high, min(p) AS low,
    last(p ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS close, sum(q) AS volume, sum(p * q) AS dollar_volume
  FROM daily_lines GROUP BY symbol, timestamp
), daily_full AS (
  SELECT *, dollar_volume / nullif(volume, 0) AS vwap, close / lag(close) OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS r FROM daily_all
  WHERE timestamp IN (SELECT timestamp FROM daily_all GROUP BY timestamp HAVING count(*) = (SELECT count(DISTINCT symbol) FROM daily_all))
), daily AS (SELECT * EXCLUDE (r), avg(r) OVER (PARTITION BY timestamp) AS market_ret FROM daily_full)"""

# --- weekly bars of many symbols ----------------------------------------------------------------

WEEKLY = BarSchema({r.CLOSE_TR: "close", r.VOLUME_RAW: "volume"})


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly closes of orders by priority, in weeks in which every priority has one."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("symbol"), F.date_trunc("week", F.col("o_orderdate").cast("timestamp")).alias("timestamp"), F.col("o_totalprice").alias("p"), F.struct("o_orderdate", "o_orderkey").alias("k"))
    return complete(orders.groupBy("symbol", "timestamp").agg(F.max_by("p", "k").alias("close"), F.count(F.lit(1)).cast("double").alias("volume")))


WEEKLY_SQL = """weekly_all AS (
  SELECT o_orderpriority AS symbol, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS timestamp, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2
), weekly AS (
  SELECT * FROM weekly_all WHERE timestamp IN (SELECT timestamp FROM weekly_all GROUP BY timestamp HAVING count(*) = (SELECT count(DISTINCT symbol) FROM weekly_all))
)"""

# --- ticks and intraday bars --------------------------------------------------------------------


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades: price value + 1, size k + 1, quotes around the price."""
    k = F.get_json_object("props", "$.k").cast("double")
    price = F.col("value") + 1
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("timestamp"), price.alias("price"), (k + 1).alias("size"), (price - (k % 3) / 100).alias("bid"), (price + (k % 4) / 100).alias("ask"), F.col("event_id").alias("seq")
    )


TICKS_SQL = """ticks AS (
  SELECT event_type AS symbol, ts AS timestamp, value + 1 AS price, k + 1 AS size, value + 1 - (k % 3) / 100 AS bid, value + 1 + (k % 4) / 100 AS ask, event_id AS seq
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events)
)"""

SIGN_SQL = {
    "none": "0",
    "tick_rule": "tick",
    "lee_ready": "CASE WHEN price > (bid + ask) / 2 THEN 1 WHEN price < (bid + ask) / 2 THEN -1 ELSE tick END",
}
BUCKET_SQL = {
    "time": lambda x: f"epoch_us(time_bucket(INTERVAL '{x}', timestamp))",
    "tick": lambda x: f"floor((row_number() OVER tape - 1) / {x})",
    "volume": lambda x: f"floor((sum(size) OVER (tape ROWS UNBOUNDED PRECEDING) - size) / {x})",
    "dollar": lambda x: f"floor((sum(size * price) OVER (tape ROWS UNBOUNDED PRECEDING) - size * price) / {x})",
}


def bars_sql(kind: str, knob, rule: str, name: str = "bars") -> str:
    """CTEs that end in bars of the CTE ticks."""
    atomic = "bucket0" if kind == "time" else "min(bucket0) OVER (PARTITION BY symbol, timestamp)"
    return f"""changes AS (SELECT *, nullif(sign(price - lag(price) OVER tape), 0) AS change FROM ticks WINDOW tape AS (PARTITION BY symbol ORDER BY timestamp, seq)
), moved AS (SELECT *, coalesce(last_value(change IGNORE NULLS) OVER (tape ROWS UNBOUNDED PRECEDING), 0) AS tick, {BUCKET_SQL[kind](knob)} AS bucket0 FROM changes WINDOW tape AS (PARTITION BY symbol ORDER BY timestamp, seq)
), signed AS (SELECT *, {SIGN_SQL[rule]} AS s, {atomic} AS bucket FROM moved
), {name}_open AS (
  SELECT symbol, max(timestamp) AS timestamp, first(price ORDER BY timestamp, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY timestamp, seq) AS close, sum(size) AS volume, sum(price * size) AS pv, count(*) AS trade_count,
    sum(size * s) AS signed_volume, coalesce(sum(CASE WHEN s > 0 THEN size END), 0) AS buy_volume, coalesce(sum(CASE WHEN s < 0 THEN size END), 0) AS sell_volume, sum(price * size * s) AS signed_dollar
  FROM signed GROUP BY symbol, bucket
), {name} AS (SELECT *, pv / nullif(volume, 0) AS vwap, timestamp < max(timestamp) OVER (PARTITION BY symbol) AS closed FROM {name}_open)"""


INTRADAY = BarSchema.quotes(bid_size="bid_size", ask_size="ask_size", dollar_volume=None, signed_volume="signed_volume", buy_volume="buy_volume", sell_volume="sell_volume", signed_dollar="signed_dollar", trade_count="trade_count")


def intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed hourly bars of the ticks, with quotes and depth made from them."""
    from ..operators.bars import BarKind, BarSpec, build_bars

    bars = build_bars(ticks(spark, sf_dir), BarSpec(BarKind.TIME, interval="1h")).where("closed")
    half = (F.col("trade_count") % 7 + 1) / 1000
    deep = {f"{side}_size_l{k}": F.col(f"{way}_volume") + 1 + k for side, way in (("bid", "buy"), ("ask", "sell")) for k in range(3)}
    return bars.withColumns({"bid": F.col("close") - half, "ask": F.col("close") + half * 2, "bid_size": F.col("buy_volume") + 1, "ask_size": F.col("sell_volume") + 1} | deep)


INTRADAY_SQL = (
    TICKS_SQL
    + ", "
    + bars_sql("time", "1 hour", "tick_rule")
    + """, intraday AS (
  SELECT *, close - (trade_count % 7 + 1) / 1000.0 AS bid, close + (trade_count % 7 + 1) / 500.0 AS ask, buy_volume + 1 AS bid_size, sell_volume + 1 AS ask_size,
    buy_volume + 1 AS bid_size_l0, buy_volume + 2 AS bid_size_l1, buy_volume + 3 AS bid_size_l2, sell_volume + 1 AS ask_size_l0, sell_volume + 2 AS ask_size_l1, sell_volume + 3 AS ask_size_l2
  FROM bars WHERE closed
)"""
)
