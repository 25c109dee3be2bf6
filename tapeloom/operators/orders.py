"""Order resolution against bars: fill prices, partial fills, limit, stop, trailing and bracket orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeloom.functions import costs
from tapeloom.operators import towers
from tapeloom.operators.joins import interval_join
from tapeloom.sources.results import stored


def by_asset():
    return W.partitionBy("asset").orderBy("timestamp")


def fill_base_price(bars: DataFrame, mode: str, price: str = "close") -> DataFrame:
    """bars with base_price: the next bar's open, or of this bar close, open, mid or vwap (the close)."""
    if mode == "next_bar":
        return bars.withColumn("base_price", F.lead("open").over(by_asset()))
    mid = F.coalesce((F.col("high") + F.col("low")) / 2, F.col("close"))
    return bars.withColumn("base_price", {"open": F.col("open"), "mid": mid}.get(price, F.col("close")))


Model = Callable[[Column, Column], Column]


def price_fills(orders: DataFrame, impact: Model | None = None, slippage: Model | None = None, commission: Model = costs.commission_none, limit: Callable[[Column], Column] | None = None, multiplier: Column | None = None) -> DataFrame:
    """orders with base_price, side and quantity: ``limit`` bounds the quantity (column filled), then impact moves the price, slippage
    worsens it, and commission is taken on the fill price. Models are functions of signed quantity and price; those of ``costs`` take
    further columns of orders by closure."""
    filled = F.col("quantity") if limit is None else limit(F.col("quantity"))
    out = orders.withColumn("filled", filled).withColumn("signed", F.when(F.col("side") == "buy", F.col("filled")).otherwise(-F.col("filled")))
    q, multiplier = F.col("signed"), F.lit(1.0) if multiplier is None else multiplier
    out = out.withColumn("fill_price", F.col("base_price") + (impact(q, F.col("base_price")) if impact else F.lit(0.0)))
    if slippage:
        out = out.withColumn("fill_price", F.col("fill_price") + F.signum(q) * slippage(q, F.col("fill_price")))
    out = out.withColumn("commission", F.when(q == 0, F.lit(0.0)).otherwise(commission(q, F.col("fill_price"))))
    return out.withColumn("cash_change", -F.col("signed") * F.col("fill_price") * multiplier - F.col("commission"))


def partial_fill_schedule(orders: DataFrame, bars: DataFrame, rate: float, seconds: int) -> DataFrame:
    """One fill a bar (of start..end) up to rate of its volume until the order's quantity is done."""
    seen = interval_join(orders, bars.select("asset", "timestamp", "close", "volume"), ["asset"], "start", "end", "timestamp", seconds)
    run = W.partitionBy("order_id").orderBy("timestamp").rowsBetween(W.unboundedPreceding, -1)
    seen = seen.withColumn("_cap", F.col("volume") * rate)
    left = F.greatest(F.col("quantity") - F.coalesce(F.sum("_cap").over(run), F.lit(0.0)), F.lit(0.0))
    return seen.withColumn("filled", F.least(F.col("_cap"), left)).filter("filled > 1e-9").select("order_id", "asset", "timestamp", "close", "filled")


def resolve_limit_stop_orders(orders: DataFrame, bars: DataFrame, seconds: int, there: DataFrame | None = None) -> DataFrame:
    """First bar of start..end that fills each order (kind limit or stop, level): time and price.

    A search over block extremes (``towers``): an order meets a few rows however long it lives. The bars' tower is written once
    unless one is given (``there``)."""
    buy, limit, level = F.col("side") == "buy", F.col("kind") == "limit", F.col("level")
    hits = towers.first_touch(orders.withColumn("up", buy != limit), there or stored(towers.tower(bars, seconds)), seconds)
    price = F.when(limit, level).when(buy, F.greatest("_open", level)).otherwise(F.least("_open", level))
    return orders.join(hits.select("order_id", F.col("time").alias("fill_time"), F.col("open").alias("_open")), "order_id").withColumn("fill_price", price).drop("_open")


def resolve_trailing_stop_orders(orders: DataFrame, bars: DataFrame, seconds: int, there: DataFrame | None = None) -> DataFrame:
    """SELL stops trail the highest high, BUY stops the lowest low, this bar's included; gaps fill at the open."""
    sell = F.col("side") == "sell"
    hits = towers.trailing_touch(orders.withColumn("sell", sell), there or stored(towers.tower(bars, seconds)), seconds)
    found = orders.select("order_id", sell.alias("_sell")).join(hits, "order_id")
    return found.select("order_id", F.col("time").alias("fill_time"), F.when(F.col("_sell"), F.least("open", "stop")).otherwise(F.greatest("open", "stop")).alias("fill_price"))


def resolve_brackets(entries: DataFrame, bars: DataFrame, seconds: int) -> DataFrame:
    """Long entries with take_profit and stop_loss, live from the entry bar: the first leg to fill; the take-profit wins a shared bar.

    inverted: the take-profit lies below the stop-loss (equal levels, as of a price of 0, do not)."""
    leg = lambda name, kind, column: entries.select("order_id", "asset", "start", "end", F.lit("sell").alias("side"), F.lit(kind).alias("kind"), F.col(column).alias("level"), F.lit(name).alias("leg"))
    legs = leg("take_profit", "limit", "take_profit").unionByName(leg("stop_loss", "stop", "stop_loss")).withColumn("order_id", F.concat_ws("|", "order_id", "leg"))
    done = resolve_limit_stop_orders(legs, bars, seconds).withColumn("order_id", F.substring_index("order_id", "|", 1))
    first = F.struct("fill_time", (F.col("leg") == "stop_loss").alias("_second"))
    out = done.groupBy("order_id").agg(F.min("fill_time").alias("fill_time"), F.min_by("leg", first).alias("leg"), F.min_by("fill_price", first).alias("fill_price"))
    return out.join(entries.select("order_id", (F.col("take_profit") < F.col("stop_loss")).alias("inverted")), "order_id")


def rejected_orders(orders: DataFrame) -> DataFrame:
    """Number of rejected orders of an asset and the last one's reason."""
    return orders.filter("status = 'rejected'").groupBy("asset").agg(F.count("*").alias("n"), F.max_by("reason", F.struct("created_at", "order_id")).alias("last_reason"))


def sequence_orders(orders: DataFrame, held: str = "position", largest_first: bool = True) -> DataFrame:
    """Per bar: exits (which reduce and do not reverse) first, then entries by notional; ties by submission."""
    signed = F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    is_exit = (F.col(held) * signed < 0) & (F.abs(signed) <= F.abs(held))
    notional = F.when(is_exit, F.lit(0.0)).otherwise(F.col("quantity") * F.col("price"))
    order = F.desc("_notional") if largest_first else F.asc("_notional")
    out = orders.withColumns({"is_exit": is_exit, "_notional": notional})
    return out.withColumn("sequence", F.row_number().over(W.partitionBy("timestamp").orderBy(F.desc("is_exit"), order, "submitted"))).drop("_notional")
