"""Market-data views over the star-schema tables: bars, signals, trades, fills, equity, dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeloom.operators.joins import blocked_sum, ieee


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(events: DataFrame, asset: Column, at: Column) -> DataFrame:
    order = F.struct("ts", "event_id")
    return events.groupBy(asset.alias("asset"), at.cast("timestamp_ntz").alias("timestamp")).agg(
        F.min_by("value", order).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", order).alias("close"),
        F.round(F.sum("value"), 4).alias("volume"),
    )


def bars_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars, one asset per user (gaps)."""
    return _bars(table(spark, sf_dir, "events"), F.col("user_id").cast("string"), F.to_date("ts"))


def bars_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars, one asset per event type (dense)."""
    return _bars(table(spark, sf_dir, "events"), F.col("event_type"), F.date_trunc("hour", "ts"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily score of an asset: mean of its values less 100."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").cast("string").alias("asset"), F.to_date("ts").cast("timestamp_ntz").alias("timestamp")).agg(F.round(F.avg("value") - 100, 6).alias("score"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular ticks: asset, ts, event_id, price, size."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("asset"), "ts", "event_id", F.col("value").alias("price"), F.col("user_id").cast("double").alias("size"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey)


def _line_id() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def extremes(ret: Column, above: str = "slippage", below: str = "entry_slippage") -> dict[str, Column]:
    """Excursions of a round trip with a return: the slippages go beyond it."""
    return {"mfe": F.greatest(ret, F.lit(0.0)) + F.col(above), "mae": F.least(ret, F.lit(0.0)) - F.col(below)}


def _round_trips(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """Order lines and their parts as round trips, with what their orders give where these are joined; quotients are plain, as the SQL's."""
    dated = "o_orderdate" in lines.columns
    base = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("o_orderpriority").alias("run_id") if dated else "l_orderkey",
        _line_id().alias("trade_id"),
        F.col("l_partkey").cast("string").alias("symbol"),
        *([F.col("o_orderdate").alias("entry_time")] if dated else []),
        F.col("l_shipdate").alias("exit_time"),
        F.col("p_retailprice").alias("entry_price"),
        ieee(F.col("l_extendedprice"), F.col("l_quantity")).alias("exit_price"),
        F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"),
        "l_tax", "l_discount", "l_linenumber",
    )
    side = F.signum("quantity")
    ret = side * (ieee(F.col("exit_price"), F.col("entry_price")) - 1)
    out = base.withColumns({
        "direction": F.when(F.col("quantity") > 0, "long").otherwise("short"),
        "pnl_percent": ret,
        "fees": F.col("entry_price") * F.abs("quantity") * F.col("l_tax") * 0.01,
        **({"bars_held": F.datediff("exit_time", "entry_time")} if dated else {}),
        "slippage": F.col("l_discount"),
        "entry_slippage": F.col("l_tax"),
        **extremes(ret, "l_discount", "l_tax"),
        "multiplier": F.lit(1.0),
        "exit_reason": F.element_at(F.array(*map(F.lit, ("stop_loss", "take_profit", "signal", "time_exit"))), F.col("l_linenumber") % 4 + 1),
        "status": F.when(F.col("l_linenumber") == 7, "open").otherwise("closed"),
    })
    out = out.withColumn("pnl", (F.col("exit_price") - F.col("entry_price")) * F.col("quantity") - F.col("fees"))
    return out.drop("l_tax", "l_discount", "l_linenumber")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trips: order lines shipped after their order date."""
    return _round_trips(_lines(spark, sf_dir).filter("l_shipdate > o_orderdate"), table(spark, sf_dir, "part"))


def narrow_trades(spark: SparkSession, sf_dir: str, *columns: str | Column) -> DataFrame:
    """run_id and some columns of trades, of those that lines and parts give. They are worked out before the join with orders, so that only they are shuffled."""
    told = _round_trips(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")).select("l_orderkey", "exit_time", *columns)
    held = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("exit_time") > F.col("o_orderdate"))
    return told.join(table(spark, sf_dir, "orders"), held).select(F.col("o_orderpriority").alias("run_id"), *told.columns[2:])


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills: every order line, by supplier; returned or open ones sell."""
    return _lines(spark, sf_dir).select(
        F.col("o_orderpriority").alias("run_id"), _line_id().alias("order_id"), F.col("l_suppkey").cast("string").alias("asset"), F.col("l_shipdate").alias("timestamp"),
        F.when(F.col("l_returnflag") == "N", "buy").otherwise("sell").alias("side"), F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.col("l_tax") * 10).alias("commission"), F.col("l_discount").alias("slippage"),
    )


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One curve per order priority: a million and the running sum of signed daily order totals."""
    signed = F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice")) * 0.01
    daily = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("run_id"), F.col("o_orderdate").alias("timestamp")).agg(F.round(F.sum(signed), 4).alias("change"))
    run = W.partitionBy("run_id").orderBy("timestamp").rowsBetween(W.unboundedPreceding, 0)
    return daily.select("run_id", "timestamp", F.round(F.sum("change").over(run) + 1e6, 4).alias("equity"))


def equity_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraday curve of each event type: 100,000 and the running sum of values less their usual size."""
    ticks = table(spark, sf_dir, "events").select(F.col("event_type").alias("run_id"), F.col("ts").alias("timestamp"), "event_id", (F.col("value") - 100).alias("change"))
    summed = blocked_sum(ticks, ["run_id"], F.to_date("timestamp"), ["timestamp", "event_id"], "change", "total")
    return summed.select("run_id", "timestamp", F.round(F.col("total") + 100000, 2).alias("equity"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market values by order date: signed order totals of a run's customers' nations."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    signed = F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("o_orderpriority").alias("run_id"), F.col("o_orderdate").alias("timestamp"), F.col("c_nationkey").cast("string").alias("asset")).agg(F.round(F.sum(signed), 2).alias("value"))


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the events' weekdays, 14:30 to 21:00 UTC (18:00 on Fridays), a break 17:00 to 17:30, no 15th."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("session_date")).distinct().filter("weekday(session_date) < 5 and day(session_date) != 15")
    at = lambda h, m: (F.col("session_date").cast("timestamp_ntz") + F.expr(f"interval '{h}:{m:02d}' hour to minute"))
    return days.select("session_date", at(14, 30).alias("market_open"), F.when(F.weekday("session_date") == 4, at(18, 0)).otherwise(at(21, 0)).alias("market_close"), at(17, 0).alias("break_start"), at(17, 30).alias("break_end"))


#: The same views for DuckDB.
SQL_VIEWS = r"""
WITH RECURSIVE bu AS (SELECT user_id::VARCHAR AS asset, date_trunc('day', ts)::TIMESTAMP AS timestamp, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, round(sum(value), 4) AS volume FROM events GROUP BY 1, 2),
bt AS (SELECT event_type AS asset, date_trunc('hour', ts)::TIMESTAMP AS timestamp, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, round(sum(value), 4) AS volume FROM events GROUP BY 1, 2),
sg AS (SELECT user_id::VARCHAR AS asset, date_trunc('day', ts)::TIMESTAMP AS timestamp, round(avg(value) - 100, 6) AS score FROM events GROUP BY 1, 2),
tk AS (SELECT event_type AS asset, ts, event_id, value AS price, user_id::DOUBLE AS size FROM events),
ln AS (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
tr0 AS (SELECT o_orderpriority AS run_id, line_id AS trade_id, l_partkey::VARCHAR AS symbol, o_orderdate AS entry_time, l_shipdate AS exit_time, p_retailprice AS entry_price,
  l_extendedprice / l_quantity AS exit_price, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity, l_tax, l_discount, l_linenumber
  FROM ln JOIN part ON l_partkey = p_partkey WHERE l_shipdate > o_orderdate),
tr1 AS (SELECT *, sign(quantity) * (exit_price / entry_price - 1) AS pnl_percent, entry_price * abs(quantity) * l_tax * 0.01 AS fees FROM tr0),
tr AS (SELECT run_id, trade_id, symbol, entry_time, exit_time, entry_price, exit_price, quantity, CASE WHEN quantity > 0 THEN 'long' ELSE 'short' END AS direction, pnl_percent, fees,
  date_diff('day', entry_time, exit_time)::INT AS bars_held, l_discount AS slippage, l_tax AS entry_slippage, greatest(pnl_percent, 0) + l_discount AS mfe, least(pnl_percent, 0) - l_tax AS mae, 1.0::DOUBLE AS multiplier,
  ['stop_loss', 'take_profit', 'signal', 'time_exit'][l_linenumber % 4 + 1] AS exit_reason, CASE WHEN l_linenumber = 7 THEN 'open' ELSE 'closed' END AS status, (exit_price - entry_price) * quantity - fees AS pnl FROM tr1),
fl AS (SELECT o_orderpriority AS run_id, line_id AS order_id, l_suppkey::VARCHAR AS asset, l_shipdate AS timestamp, CASE WHEN l_returnflag = 'N' THEN 'buy' ELSE 'sell' END AS side, l_quantity AS quantity,
  l_extendedprice / l_quantity AS price, l_tax * 10 AS commission, l_discount AS slippage FROM ln),
eq0 AS (SELECT o_orderpriority AS run_id, o_orderdate AS timestamp, round(sum(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END * 0.01), 4) AS change FROM orders GROUP BY 1, 2),
eq AS (SELECT run_id, timestamp, round(sum(change) OVER (PARTITION BY run_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) + 1e6, 4) AS equity FROM eq0),
et AS (SELECT event_type AS run_id, ts AS timestamp, round(sum(value - 100) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 100000, 2) AS equity FROM events),
ps AS (SELECT o_orderpriority AS run_id, o_orderdate AS timestamp, c_nationkey::VARCHAR AS asset, round(sum(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
sc AS (SELECT d AS session_date, d + INTERVAL 870 MINUTE AS market_open, d + CASE WHEN isodow(d) = 5 THEN INTERVAL 18 HOUR ELSE INTERVAL 21 HOUR END AS market_close, d + INTERVAL 17 HOUR AS break_start, d + INTERVAL 1050 MINUTE AS break_end
  FROM (SELECT DISTINCT ts::DATE AS d FROM events) WHERE isodow(d) < 6 AND day(d) <> 15)
"""


def sql(body: str) -> str:
    """A query over the views: CTEs ``, name AS (...)`` and a final SELECT."""
    return SQL_VIEWS + body
