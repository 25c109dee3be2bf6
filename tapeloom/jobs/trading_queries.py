"""Queries of cost, order, ledger and exit operators, with their SQL."""

from __future__ import annotations

from decimal import Decimal
from functools import partial

from pyspark.sql import functions as F

from tapeloom.functions import costs
from tapeloom.jobs import panel_queries
from tapeloom.jobs.panel_queries import rounded
from tapeloom.operators import exits, joins, ledger, orders, panel, signals
from tapeloom.sources import views as v

QUERIES: dict = {}
SQL: dict[str, str] = {}
register = partial(panel_queries.register, queries=QUERIES, oracles=SQL)
DAY = 86400
_nine, _twelve = partial(rounded, digits=9), partial(rounded, digits=12)


@register("E1_fill_base_price", " SELECT asset, timestamp, lead(open) OVER (PARTITION BY asset ORDER BY timestamp) AS next_bar, (high + low) / 2 AS mid FROM bt")
def e1(spark, d):
    out = orders.fill_base_price(v.bars_type(spark, d), "next_bar").withColumnRenamed("base_price", "next_bar")
    return orders.fill_base_price(out, "same_bar", "mid").select("asset", "timestamp", "next_bar", F.col("base_price").alias("mid"))


@register("E2_commission", """ SELECT order_id, asset, round(abs(quantity * price) * 0.001, 6) AS percent, round(greatest(abs(quantity) * 0.005, 1), 6) AS per_share, round(abs(quantity * price) * CASE WHEN abs(quantity * price) <= 10000 THEN 0.002 WHEN abs(quantity * price) <= 30000 THEN 0.001 ELSE 0.0005 END, 6) AS tiered,
  round(abs(quantity * price) * 0.001 + 2, 6) AS combined, round(greatest(5, 0.85 * abs(quantity), 0.0001 * abs(quantity) * price * 50), 6) AS futures FROM fl""")
def e2(spark, d):
    q, p = F.col("quantity"), F.col("price")
    return rounded(v.fills(spark, d).select("order_id", "asset", costs.commission_percent(q, p, 0.001).alias("percent"), costs.commission_per_share(q, p, 0.005, 1.0).alias("per_share"), costs.commission_tiered(q, p, [(10000, 0.002), (30000, 0.001), (1e9, 0.0005)]).alias("tiered"), costs.commission_combined(q, p, 0.001, 2.0).alias("combined"), costs.commission_futures(q, p, 5.0, 0.85, 0.0001, 50.0).alias("futures")))


@register("E3_slippage", " SELECT order_id, asset, 0.01::DOUBLE AS fixed, round(price * 0.001, 12) AS percent, round(price * (quantity / (quantity * 7)) * 0.1, 12) AS volume, round(quantity * 0.25 * 50, 12) AS futures FROM fl")
def e3(spark, d):
    q, p = F.col("quantity"), F.col("price")
    return _twelve(v.fills(spark, d).select("order_id", "asset", costs.slippage_fixed(q, p, 0.01).alias("fixed"), costs.slippage_percent(q, p, 0.001).alias("percent"), costs.slippage_volume(q, p, q * 7, 0.1).alias("volume"), costs.slippage_futures(q, 0.25, 50.0).alias("futures")))


@register("E4_market_impact", """, s AS (SELECT order_id, asset, price, CASE WHEN side = 'buy' THEN quantity ELSE -quantity END AS q, CASE WHEN quantity < 5 THEN 0 ELSE 1000.0 END AS vol FROM fl)
  SELECT order_id, asset, round(sign(q) * CASE WHEN vol > 0 THEN 0.1 * (abs(q) / vol) * price ELSE 0 END, 9) + 0 AS linear, round(sign(q) * CASE WHEN vol > 0 THEN 0.5 * 0.02 * sqrt(abs(q) / vol) * price ELSE 0 END, 9) + 0 AS sqrt, round(sign(q) * greatest(CASE WHEN vol > 0 THEN 0.1 * pow(abs(q) / vol, 0.6) * price ELSE 0.05 END, 0.05), 9) + 0 AS power FROM s""")
def e4(spark, d):
    p, vol = F.col("price"), F.when(F.col("quantity") < 5, 0.0).otherwise(1000.0)
    q = ledger.signed_quantity()
    return _nine(v.fills(spark, d).select("order_id", "asset", costs.impact("linear", q, p, vol, 0.1).alias("linear"), costs.impact("sqrt", q, p, vol, 0.5).alias("sqrt"), costs.impact("power", q, p, vol, 0.1, exponent=0.6, minimum=0.05).alias("power")))


@register("E5_participation_limit", " SELECT order_id, asset, CASE WHEN price * 0.01 < 10 THEN 0.0 ELSE least(quantity, price * 0.01 * 0.5) END AS fillable, round(least(greatest(0.1 * (1 - 0.5 * (quantity / 25 - 1)), 0.02), 0.25), 9) AS rate FROM fl")
def e5(spark, d):
    return v.fills(spark, d).select("order_id", "asset", costs.fillable(F.col("quantity"), F.col("price") * 0.01, 0.5, 10.0).alias("fillable"), F.round(costs.adaptive_rate(0.1, 0.5, F.col("quantity"), F.lit(25.0)), 9).alias("rate"))


@register("E6_price_fills", """, s AS (SELECT *, CASE WHEN side = 'buy' THEN 1 ELSE -1 END * least(quantity, 40.0 * CASE WHEN side = 'buy' THEN 1.0 ELSE 0.5 END) AS q FROM fl), m AS (SELECT *, price + sign(q) * 0.5 * 0.02 * sqrt(abs(q) / 1000.0) * price AS moved FROM s), f AS (SELECT *, moved + sign(q) * (moved * (abs(q) / 1000.0) * 0.1) AS fp FROM m)
  SELECT order_id, asset, abs(q) AS filled, round(fp, 6) AS fill_price, round(greatest(abs(q) * 0.01, 0.2), 6) AS commission, round(-q * fp * 2.0 - greatest(abs(q) * 0.01, 0.2), 4) AS cash_change FROM f""")
def e6(spark, d):
    priced = v.fills(spark, d).drop("commission").withColumns({"base_price": F.col("price"), "volume": F.lit(1000.0)})
    out = orders.price_fills(
        priced, impact=lambda q, p: costs.impact("sqrt", q, p, F.col("volume"), 0.5), slippage=lambda q, p: costs.slippage_volume(q, p, F.col("volume"), 0.1),
        commission=lambda q, p: costs.commission_per_share(q, p, 0.01, 0.2), limit=lambda q: costs.fillable(q, F.when(F.col("side") == "buy", 40.0).otherwise(20.0), 1.0), multiplier=F.lit(2.0),
    )
    return out.select("order_id", "asset", "filled", F.round("fill_price", 6).alias("fill_price"), F.round("commission", 6).alias("commission"), F.round("cash_change", 4).alias("cash_change"))


def some_orders(spark, d, days=10):
    """An order at every bar of an asset, live for ``days``."""
    bars = v.bars_user(spark, d)
    return bars.select(F.concat_ws("-", "asset", F.date_format("timestamp", "dd")).alias("order_id"), "asset", F.col("timestamp").alias("start"), (F.col("timestamp") + F.expr(f"interval {days} day")).alias("end"), F.when(F.col("asset").cast("int") % 2 == 0, "buy").otherwise("sell").alias("side"), "close", "volume")


_ORDERS = """, od AS (SELECT concat_ws('-', asset, strftime(timestamp, '%d')) AS order_id, asset, timestamp AS start, timestamp + INTERVAL 10 DAY AS "end", CASE WHEN asset::INT % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, close, volume FROM bu),
  ob AS (SELECT od.order_id, od.asset, side, od.close AS c0, od.volume AS v0, od.start, b.timestamp, b.open, b.high, b.low, b.close, b.volume FROM od JOIN bu b ON b.asset = od.asset AND b.timestamp BETWEEN od.start AND od."end")"""


@register("E7_partial_fill_schedule", _ORDERS + """, c AS (SELECT *, volume * 0.1 AS cap, coalesce(sum(volume * 0.1) OVER (PARTITION BY order_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ob)
  SELECT order_id, asset, timestamp, close, round(least(cap, greatest(v0 * 0.5 - before, 0)), 6) AS filled FROM c WHERE least(cap, greatest(v0 * 0.5 - before, 0)) > 1e-9""")
def e7(spark, d):
    todo = some_orders(spark, d).select("order_id", "asset", "start", "end", (F.col("volume") * 0.5).alias("quantity"))
    return orders.partial_fill_schedule(todo, v.bars_user(spark, d), 0.1, 5 * DAY).withColumn("filled", F.round("filled", 6))


@register("E8_resolve_limit_stop_orders", _ORDERS + """, k AS (SELECT *, CASE WHEN hash_ = 0 THEN 'limit' ELSE 'stop' END AS kind, CASE WHEN (hash_ = 0) = (side = 'buy') THEN c0 * 0.7 ELSE c0 * 1.3 END AS level FROM (SELECT *, day(start) % 2 AS hash_ FROM ob)),
  h AS (SELECT * FROM k WHERE CASE WHEN kind = 'limit' THEN CASE WHEN side = 'buy' THEN low <= level ELSE high >= level END ELSE CASE WHEN side = 'buy' THEN high >= level ELSE low <= level END END)
  SELECT order_id, kind, min(timestamp) AS fill_time, round(arg_min(CASE WHEN kind = 'limit' THEN level WHEN side = 'buy' THEN greatest(open, level) ELSE least(open, level) END, timestamp), 6) AS fill_price FROM h GROUP BY 1, 2""")
def e8(spark, d):
    limit = F.dayofmonth("start") % 2 == 0
    todo = some_orders(spark, d).withColumns({"kind": F.when(limit, "limit").otherwise("stop"), "level": F.when(limit == (F.col("side") == "buy"), F.col("close") * 0.7).otherwise(F.col("close") * 1.3)}).drop("close", "volume")
    return rounded(orders.resolve_limit_stop_orders(todo, v.bars_user(spark, d), 5 * DAY).select("order_id", "kind", "fill_time", "fill_price"))


@register("E9_resolve_trailing_stop_orders", _ORDERS + """, t AS (SELECT *, CASE WHEN side = 'sell' THEN max(high - c0 * 0.5) OVER w ELSE min(low + c0 * 0.5) OVER w END AS stop FROM ob WINDOW w AS (PARTITION BY order_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING))
  SELECT order_id, min(timestamp) AS fill_time, round(arg_min(CASE WHEN side = 'sell' THEN least(open, stop) ELSE greatest(open, stop) END, timestamp), 6) AS fill_price FROM t WHERE CASE WHEN side = 'sell' THEN low <= stop ELSE high >= stop END GROUP BY 1""")
def e9(spark, d):
    todo = some_orders(spark, d).withColumn("trail", F.col("close") * 0.5).drop("close", "volume")
    return rounded(orders.resolve_trailing_stop_orders(todo, v.bars_user(spark, d), 5 * DAY))


@register("E10_resolve_brackets", _ORDERS + """, l AS (SELECT order_id, timestamp, 0 AS second, 'take_profit' AS leg, c0 * 1.4 AS price FROM ob WHERE high >= c0 * 1.4 UNION ALL SELECT order_id, timestamp, 1, 'stop_loss', least(open, c0 * 0.6) FROM ob WHERE low <= c0 * 0.6),
  r AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY timestamp, second) AS n FROM l) SELECT order_id, timestamp AS fill_time, leg, round(price, 6) AS fill_price, false AS inverted FROM r WHERE n = 1""")
def e10(spark, d):
    todo = some_orders(spark, d).withColumns({"take_profit": F.col("close") * 1.4, "stop_loss": F.col("close") * 0.6})
    return rounded(orders.resolve_brackets(todo, v.bars_user(spark, d), 5 * DAY))


@register("E11_stop_slippage", " SELECT order_id, asset, round(CASE WHEN side = 'sell' THEN price * 0.998 ELSE price * 1.002 END, 9) AS fill FROM fl")
def e11(spark, d):
    return _nine(v.fills(spark, d).select("order_id", "asset", costs.stop_slippage(F.col("price"), 0.002, F.col("side") == "sell").alias("fill")))


@register("E12_rejected_orders", " SELECT o_custkey::VARCHAR AS asset, count(*) AS n, max_by(o_orderpriority, (o_orderdate, o_orderkey)) AS last_reason FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def e12(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "rejected").otherwise("filled")
    return orders.rejected_orders(v.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("asset"), status.alias("status"), F.col("o_orderpriority").alias("reason"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("order_id")))


@register("E13_sequence_orders", """, s AS (SELECT *, CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE -l_quantity END AS q, (l_partkey % 101)::DOUBLE - 50 AS held FROM ln), x AS (SELECT *, held * q < 0 AND abs(q) <= abs(held) AS is_exit FROM s)
  SELECT line_id AS order_id, l_shipdate AS timestamp, is_exit, row_number() OVER (PARTITION BY l_shipdate ORDER BY is_exit DESC, CASE WHEN is_exit THEN 0 ELSE l_quantity * l_extendedprice END DESC, line_id) AS sequence FROM x""")
def e13(spark, d):
    base = v.table(spark, d, "lineitem").withColumn("order_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    todo = base.select("order_id", F.col("l_shipdate").alias("timestamp"), F.when(F.col("l_returnflag") == "N", "buy").otherwise("sell").alias("side"), F.col("l_quantity").alias("quantity"), ((F.col("l_partkey") % 101).cast("double") - 50).alias("position"), F.col("l_extendedprice").alias("worth"), F.col("order_id").alias("submitted"))
    return orders.sequence_orders(todo.withColumn("price", F.col("worth")), "position").select("order_id", "timestamp", "is_exit", "sequence")


_RUN = """, rn AS (SELECT *, CASE WHEN side = 'buy' THEN quantity ELSE -quantity END AS q FROM fl), rp AS (SELECT *, sum(q) OVER (PARTITION BY run_id, asset ORDER BY timestamp, order_id, price ROWS UNBOUNDED PRECEDING) AS position FROM rn),
  rb AS (SELECT *, coalesce(lag(position) OVER (PARTITION BY run_id, asset ORDER BY timestamp, order_id, price), 0) AS before FROM rp),
  re AS (SELECT *, CASE WHEN before = 0 THEN 'open' WHEN position = 0 THEN 'close' WHEN before * position < 0 THEN 'flip' WHEN abs(position) > abs(before) THEN 'scale_up' ELSE 'scale_down' END AS event FROM rb)"""


@register("F1_running_positions", _RUN + " SELECT run_id, asset, order_id, timestamp, position, event FROM re")
def f1(spark, d):
    return ledger.running_positions(v.fills(spark, d)).select("run_id", "asset", "order_id", "timestamp", "position", "event")


_FOLD = _RUN + """, ep0 AS (SELECT run_id, asset, timestamp, order_id, price, 0 AS part, event, CASE WHEN event = 'flip' THEN -before ELSE q END AS q, CASE WHEN event = 'flip' THEN commission * (abs(before) / abs(q)) ELSE commission END AS fee FROM re
  UNION ALL SELECT run_id, asset, timestamp, order_id, price, 1, event, position, commission * (1 - abs(before) / abs(q)) FROM re WHERE event = 'flip'),
  ep AS MATERIALIZED (SELECT *, row_number() OVER w AS i, sum((event = 'open' OR (event = 'flip' AND part = 1))::INT) OVER (PARTITION BY run_id, asset ORDER BY timestamp, order_id, price, part ROWS UNBOUNDED PRECEDING)::INT AS episode FROM ep0 WINDOW w AS (PARTITION BY run_id, asset ORDER BY timestamp, order_id, price, part)),
  en AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run_id, asset, episode ORDER BY i) AS j FROM ep),
  fo AS (SELECT run_id, asset, episode, j, timestamp AS entry_time, q AS held, price AS entry, abs(q) AS first, fee AS entry_fee, 0.0::DOUBLE AS partial, 0 AS n_partial, NULL::DOUBLE AS exit_price, NULL::TIMESTAMP AS exit_time, q AS last, 0.0::DOUBLE AS exit_fee FROM en WHERE j = 1
  UNION ALL SELECT f.run_id, f.asset, f.episode, e.j, f.entry_time, f.held + e.q, CASE WHEN f.held * e.q > 0 THEN (f.entry * abs(f.held) + e.price * abs(e.q)) / (abs(f.held) + abs(e.q)) ELSE f.entry END, f.first, CASE WHEN f.held * e.q > 0 THEN f.entry_fee + e.fee ELSE f.entry_fee END,
  CASE WHEN f.held * e.q < 0 AND f.held + e.q <> 0 THEN f.partial + sign(f.held) * (e.price - f.entry) * abs(e.q) - f.entry_fee * abs(e.q) / f.first - e.fee ELSE f.partial END, CASE WHEN f.held * e.q < 0 AND f.held + e.q <> 0 THEN f.n_partial + 1 ELSE f.n_partial END,
  CASE WHEN f.held + e.q = 0 THEN e.price END, CASE WHEN f.held + e.q = 0 THEN e.timestamp END, CASE WHEN f.held + e.q = 0 THEN f.held ELSE f.held + e.q END, CASE WHEN f.held + e.q = 0 THEN e.fee ELSE 0 END
  FROM fo f JOIN en e ON e.run_id = f.run_id AND e.asset = f.asset AND e.episode = f.episode AND e.j = f.j + 1),
  td AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, asset, episode ORDER BY j DESC) AS k FROM fo) WHERE k = 1)"""


@register("F2_fills_to_trades", _FOLD + " SELECT run_id, asset, episode, entry_time, exit_time, round(entry, 8) AS entry_price, round(exit_price, 8) AS exit_price, last AS quantity, round((exit_price - entry) * last - (entry_fee + exit_fee), 6) AS pnl, round(entry_fee + exit_fee, 8) AS fees FROM td WHERE exit_price IS NOT NULL")
def f2(spark, d):
    out = ledger.fills_to_trades(v.fills(spark, d)).filter("not is_open")
    return out.select("run_id", "asset", "episode", "entry_time", "exit_time", F.round("entry_price", 8).alias("entry_price"), F.round("exit_price", 8).alias("exit_price"), "quantity", F.round("pnl", 6).alias("pnl"), F.round("fees", 8).alias("fees"))


@register("F3_partial_exits", _FOLD + " SELECT run_id, asset, episode, n_partial, round(partial, 3) AS partial_pnl FROM td WHERE n_partial > 0")
def f3(spark, d):
    return ledger.fills_to_trades(v.fills(spark, d)).filter("n_partial > 0").select("run_id", "asset", "episode", "n_partial", F.round("partial_pnl", 3).alias("partial_pnl"))


@register("F4_cash_ledger", ", c AS (SELECT run_id, timestamp, sum(CASE WHEN side = 'buy' THEN -quantity * price ELSE quantity * price END - commission) AS change FROM fl GROUP BY 1, 2) SELECT run_id, timestamp, round(sum(change) OVER (PARTITION BY run_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) + 1e6, 3) AS cash FROM c")
def f4(spark, d):
    change = v.fills(spark, d).withColumn("cash_change", -ledger.signed_quantity() * F.col("price") - F.col("commission"))
    return ledger.cash_ledger(change, 1e6).select("run_id", "timestamp", F.round("cash", 3).alias("cash"))


def user_fills(spark, d):
    """A fill at every daily bar of a user: buys and sells."""
    bars = v.bars_user(spark, d)
    side = F.when((F.dayofmonth("timestamp") / 3 + F.col("asset").cast("int")).cast("int") % 2 == 0, "buy").otherwise("sell")
    return bars.select(F.lit("r").alias("run_id"), "asset", "timestamp", F.concat_ws("-", "asset", "timestamp").alias("order_id"), side.alias("side"), F.lit(10.0).alias("quantity"), F.col("close").alias("price"), F.lit(1.0).alias("commission"), F.lit(0.0).alias("slippage"))


_UF = """, uf AS (SELECT asset, timestamp, CASE WHEN (day(timestamp) // 3 + asset::INT) % 2 = 0 THEN 10.0 ELSE -10.0 END AS q, close AS price FROM bu)"""


@register("F5_mark_to_market", _UF + """, p AS (SELECT b.asset, b.timestamp, b.close * coalesce((SELECT sum(q) FROM uf u WHERE u.asset = b.asset AND u.timestamp <= b.timestamp), 0) AS value FROM bu b WHERE b.asset IN (SELECT asset FROM uf)),
  ch AS (SELECT timestamp, value - coalesce(lag(value) OVER (PARTITION BY asset ORDER BY timestamp), 0) AS d FROM p), w AS (SELECT timestamp, sum(sum(d)) OVER (ORDER BY timestamp) AS worth FROM ch GROUP BY 1)
  SELECT 'r' AS run_id, timestamp, round(1e6 + worth + coalesce((SELECT sum(-q * price - 1) FROM uf u WHERE u.timestamp <= w.timestamp), 0), 3) AS equity FROM w""")
def f5(spark, d):
    return ledger.mark_to_market(user_fills(spark, d), v.bars_user(spark, d), 1e6).withColumn("equity", F.round("equity", 3))


@register("F6_open_trades", _FOLD + """, la AS (SELECT asset, max(timestamp) AS exit_time, max_by(price, (timestamp, order_id, price)) AS exit_price FROM fl GROUP BY 1)
  SELECT run_id, asset, episode, entry_time, la.exit_time, round(la.exit_price, 8) AS exit_price, last AS quantity, round((la.exit_price - entry) * last - (entry_fee + exit_fee), 6) AS pnl, 'still_open' AS exit_reason, 'open' AS status FROM td JOIN la USING (asset) WHERE td.exit_price IS NULL""")
def f6(spark, d):
    out = ledger.open_trades(ledger.fills_to_trades(v.fills(spark, d)))
    return out.select("run_id", "asset", "episode", "entry_time", "exit_time", F.round("exit_price", 8).alias("exit_price"), "quantity", panel_queries.scaled_round(F.col("pnl"), 6).alias("pnl"), "exit_reason", "status")


@register("F7_bars_held", ", t AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) AS n FROM (SELECT entry_time AS timestamp FROM tr UNION SELECT exit_time FROM tr)) SELECT trade_id, symbol, (b.n - a.n)::INT AS bars_held FROM tr JOIN t a ON a.timestamp = entry_time JOIN t b ON b.timestamp = exit_time")
def f7(spark, d):
    trades = v.trades(spark, d).drop("bars_held")
    stamps = panel.timeline(trades.select(F.col("entry_time").alias("timestamp")), trades.select(F.col("exit_time").alias("timestamp")))
    return ledger.bars_held(trades, stamps).select("trade_id", "symbol", F.col("bars_held").cast("int").alias("bars_held"))


@register("F8_mfe_mae", _ORDERS + """, s AS (SELECT order_id, c0, CASE WHEN side = 'buy' THEN 1 ELSE -1 END AS sg, CASE WHEN timestamp = start THEN close ELSE high END AS h, CASE WHEN timestamp = start THEN close ELSE low END AS l FROM ob WHERE timestamp < start + INTERVAL 10 DAY)
  SELECT order_id AS trade_id, round(greatest(max(greatest(sg * (h / c0 - 1), sg * (l / c0 - 1))), 0), 6) + 0 AS mfe, round(least(min(least(sg * (h / c0 - 1), sg * (l / c0 - 1))), 0), 6) + 0 AS mae FROM s GROUP BY 1""")
def f8(spark, d):
    """Excursions of each order at its own price; orders of one id, on equal days of several months, are one trade."""
    told = some_orders(spark, d).withColumns({"trade_id": F.concat_ws("-", "asset", F.col("start").cast("string")), "quantity": F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)})
    trades = told.select("trade_id", "order_id", "asset", F.col("start").alias("entry_time"), F.col("end").alias("exit_time"), F.col("close").alias("entry_price"), "quantity")
    out = ledger.mfe_mae(trades, v.bars_user(spark, d), 5 * DAY, extremes=True, quotient=joins.ieee)
    return rounded(out.groupBy(F.col("order_id").alias("trade_id")).agg(F.max("mfe").alias("mfe"), F.min("mae").alias("mae")))


@register("F9_settlement_holds", ", p AS (SELECT run_id, date_diff('day', DATE '1990-01-01', timestamp::DATE)::INT AS bar, sum(quantity * price) AS proceeds FROM fl WHERE side = 'sell' GROUP BY 1, 2) SELECT run_id, bar, round(sum(proceeds) OVER (PARTITION BY run_id ORDER BY bar RANGE BETWEEN 1 PRECEDING AND CURRENT ROW), 3) AS unsettled FROM p")
def f9(spark, d):
    sales = v.fills(spark, d).filter("side = 'sell'").groupBy("run_id", F.datediff("timestamp", F.lit("1990-01-01").cast("date")).alias("bar")).agg(F.sum(F.col("quantity") * F.col("price")).alias("proceeds"))
    return ledger.settlement_holds(sales, 2).select("run_id", "bar", F.round("unsettled", 3).alias("unsettled"))


@register("F10_account_snapshot", """, s AS (SELECT run_id, timestamp, sum(value) AS net, sum(CASE WHEN asset::INT % 3 = 0 THEN abs(value) * 0.01 * 120 ELSE abs(value) * 0.5 END) AS im, sum(CASE WHEN asset::INT % 3 = 0 THEN abs(value) * 0.01 * 90 WHEN value > 0 THEN value * 0.25 ELSE -value * 0.3 END) AS mm,
  sum(CASE WHEN value < 0 THEN abs(value) * 0.01 * 95 ELSE 0 END) AS short FROM ps GROUP BY 1, 2)
  SELECT run_id, timestamp, round(equity + net, 7) AS nlv, round(im, 7) AS initial_margin, round(mm, 7) AS maintenance_margin, round(greatest(0, (equity + net - im) / 0.5), 7) AS buying_power, equity + net < mm AS margin_call, round(equity - short, 7) AS proceeds_kept, round(equity - 2 * short, 7) AS locked FROM s JOIN eq USING (run_id, timestamp)""")
def f10(spark, d):
    positions = v.positions(spark, d).withColumns({"quantity": F.col("value") * 0.01, "entry_price": F.lit(95.0)})
    contracts = positions.filter("cast(asset as int) % 3 = 0").select("asset").distinct().withColumns({"initial": F.lit(120.0), "maintenance": F.lit(90.0)})
    cash = v.equity(spark, d).withColumnRenamed("equity", "cash")
    out = ledger.account_snapshot(positions, cash, 0.5, 0.25, 0.3, contracts)
    kept, locked = (ledger.spendable_cash(F.col("cash"), F.col("short_basis"), policy).alias(name) for policy, name in (("credit_proceeds", "proceeds_kept"), ("lock_notional", "locked")))
    return rounded(out.select("run_id", "timestamp", "nlv", "initial_margin", "maintenance_margin", "buying_power", "margin_call", kept, locked), 7)


@register("F11_current_weights", ", pe AS (SELECT run_id, timestamp, asset, value * -0.5 AS d FROM ps WHERE abs(value) > 500), nv AS (SELECT run_id, timestamp, asset, sum(value) AS value FROM (SELECT run_id, timestamp, asset, value FROM ps UNION ALL SELECT run_id, timestamp, 'p' || asset, d FROM pe UNION ALL SELECT run_id, timestamp, asset, d FROM pe) GROUP BY ALL) SELECT run_id, timestamp, asset, round(value / equity, 8) AS weight FROM nv JOIN eq USING (run_id, timestamp) WHERE equity > 0")
def f11(spark, d):
    held = v.positions(spark, d)
    side = F.when(F.col("value") < 0, "buy").otherwise("sell")
    waiting = held.filter("abs(value) > 500").select("run_id", "timestamp", F.explode(F.array(F.concat(F.lit("p"), "asset"), F.col("asset"))).alias("asset"), side.alias("side"), (F.abs("value") * 0.005).alias("quantity"), F.when(F.col("value") > 0, 100.0).alias("limit_price"), F.lit(100.0).alias("close"))
    return rounded(ledger.current_weights(held, v.equity(spark, d), waiting).select("run_id", "timestamp", "asset", "weight"), 8)


_WEIGHTS = """, cw AS (SELECT asset, timestamp, close / 5000 AS weight, close FROM bu), tw AS (SELECT asset, timestamp, score / sum(score) OVER (PARTITION BY timestamp) AS target FROM sg WHERE score > 0),
  cj AS (SELECT asset, timestamp, coalesce(weight, 0) AS weight, coalesce(target, 0) AS target FROM cw FULL JOIN tw USING (asset, timestamp))"""


def _weights(spark, d):
    current = v.bars_user(spark, d).select("asset", "timestamp", (F.col("close") / 5000).alias("weight"))
    target = signals.normalize_weights(v.signals(spark, d), "score").select("asset", "timestamp", F.col("weight").alias("target"))
    return current, target


@register("F12_rebalance_preview", _WEIGHTS + """, x AS (SELECT *, target - weight AS delta FROM cj) SELECT asset, timestamp, round(delta, 8) AS delta, round(delta * 1e6 / 100, 5) AS shares, CASE WHEN abs(delta) < 0.005 THEN 'weight_change_too_small' WHEN abs(delta * 1e6) < 8000 THEN 'trade_value_too_small' WHEN abs(delta * 1e6 / 100) < 1 THEN 'rounds_to_zero_shares' END AS skip_reason, target = 0 AND weight <> 0 AS close_position FROM x""")
def f12(spark, d):
    out = ledger.rebalance_preview(*_weights(spark, d), 1e6, 0.005, 8000.0, F.lit(100.0), ["timestamp", "asset"])
    return out.select("asset", "timestamp", F.round("delta", 8).alias("delta"), F.round("shares", 5).alias("shares"), "skip_reason", "close_position")


@register("F13_rebalance_orders", _WEIGHTS + """, sc2 AS (SELECT asset, timestamp, least(target * least(1.0, 0.8 / sum(abs(target)) OVER (PARTITION BY timestamp)), 0.05) AS target FROM tw),
  fj AS (SELECT asset, timestamp, coalesce(weight, 0) AS weight, coalesce(target, 0) AS target FROM cw FULL JOIN sc2 USING (asset, timestamp)), o AS (SELECT *, round_even((target - weight) * 1e6 / 100, 0) AS shares FROM fj)
  SELECT asset, timestamp, shares, CASE WHEN target = 0 AND weight <> 0 THEN 2 WHEN abs(target) < abs(weight) THEN 1 ELSE 3 END AS phase, CASE WHEN shares > 0 THEN 'buy' ELSE 'sell' END AS side FROM o WHERE abs(shares * 100) >= 1000 AND shares <> 0""")
def f13(spark, d):
    out = ledger.rebalance_orders(*_weights(spark, d), 1e6, 0.8, 0.05, 1000.0, F.lit(100.0), ["timestamp", "asset"])
    return out.select("asset", "timestamp", "shares", "phase", "side")


@register("F14_orders_to_target_value", _WEIGHTS + """, x AS (SELECT *, target * 0.98 * 1e6 - weight * 1e6 AS dv FROM cj) SELECT asset, timestamp, round(dv, 4) AS delta_value, row_number() OVER (PARTITION BY timestamp ORDER BY dv > 0, asset) AS sequence FROM x WHERE abs(dv) >= 0.01""")
def f14(spark, d):
    current, target = _weights(spark, d)
    both = current.join(target, ["asset", "timestamp"], "full_outer").fillna(0.0, ["weight", "target"])
    out = ledger.orders_to_target_value(both, 1e6, 0.98, ["timestamp", "asset"])
    return out.select("asset", "timestamp", F.round("delta_value", 4).alias("delta_value"), "sequence")


def _gappy(spark, d):
    """Daily bars without a price on every fifth day, positions, targets and equity by day."""
    bars = v.bars_user(spark, d)
    gaps = bars.withColumn("close", F.when(F.dayofmonth("timestamp") % 5 != 0, F.col("close")))
    held = bars.filter("cast(asset as int) % 2 = 0").select("asset", "timestamp", F.lit(10.0).alias("quantity"))
    worth = bars.groupBy("timestamp").agg((1e6 + 10 * F.count("*")).alias("equity"))
    return gaps, held, signals.normalize_weights(v.signals(spark, d), "score").select("asset", "timestamp", "weight"), worth


_TO = _WEIGHTS + """, ga AS (SELECT asset, timestamp, close, row_number() OVER (PARTITION BY asset ORDER BY timestamp) AS seen FROM bu WHERE day(timestamp) % 5 <> 0 AND close > 0), he AS (SELECT asset, timestamp, 10.0::DOUBLE AS quantity FROM bu WHERE asset::INT % 2 = 0),
  eo AS (SELECT timestamp, 1e6 + 10 * count(*) AS equity FROM bu GROUP BY 1), ak AS (SELECT asset, timestamp, target, coalesce(quantity, 0) AS held FROM tw FULL JOIN he USING (asset, timestamp)),
  al AS (SELECT ak.*, ga.close, ga.seen, ga.timestamp AS priced_at FROM ak ASOF LEFT JOIN ga ON ak.asset = ga.asset AND ak.timestamp >= ga.timestamp)"""


@register("F14b_orders_to_weights", _TO + """, x AS (SELECT asset, timestamp, target, close, coalesce(target, 0) * 0.98 * equity - held * close AS dv FROM al JOIN eo USING (timestamp) WHERE close IS NOT NULL AND (target IS NULL OR seen >= 3))
  SELECT asset, timestamp, CASE WHEN dv > 0 THEN 'buy' ELSE 'sell' END AS side, round(abs(dv) / close, 6) AS quantity, round(dv, 4) AS delta_value, row_number() OVER (PARTITION BY timestamp ORDER BY dv > 0, target IS NULL, asset) AS sequence FROM x WHERE abs(dv) >= 0.01""")
def f14b(spark, d):
    bars, held, targets, worth = _gappy(spark, d)
    out = ledger.target_orders(held, targets, bars, worth, headroom=0.98, policy="use_last", min_bars=3)
    return out.select("asset", "timestamp", "side", F.round("quantity", 6).alias("quantity"), F.round("delta_value", 4).alias("delta_value"), "sequence")


@register("F14c_orders_to_values", _TO + """, x AS (SELECT asset, timestamp, close, 5000 - held * close * 2 AS dv FROM al WHERE target IS NOT NULL AND priced_at = timestamp)
  SELECT asset, timestamp, CASE WHEN dv > 0 THEN 'buy' ELSE 'sell' END AS side, round(abs(dv) / (close * 2), 6) AS quantity, round(dv, 4) AS delta_value FROM x WHERE abs(dv) >= 0.01""")
def f14c(spark, d):
    bars, held, targets, worth = _gappy(spark, d)
    doubled = bars.select("asset").distinct().withColumn("multiplier", F.lit(2.0))
    out = ledger.target_orders(held, targets.select("asset", "timestamp", F.lit(5000.0).alias("value")), bars, worth, close_untargeted=False, multipliers=doubled)
    return out.select("asset", "timestamp", "side", F.round("quantity", 6).alias("quantity"), F.round("delta_value", 4).alias("delta_value"))


def entries(spark, d):
    o = some_orders(spark, d)
    return o.select(F.col("order_id").alias("position_id"), "asset", F.when(F.col("side") == "buy", "long").otherwise("short").alias("side"), F.col("start").alias("entry_time"), F.col("close").alias("entry_price"), F.col("end").alias("until"))


def bar_panel(spark, d):
    bars = v.bars_user(spark, d).select("asset", "timestamp", "open", "high", "low", "close", (F.col("high") - F.col("low")).alias("atr"))
    bars = bars.join(v.signals(spark, d), ["asset", "timestamp"])
    return exits.position_bar_panel(entries(spark, d), bars, 5 * DAY)


_PANEL = _ORDERS + """, ob2 AS (SELECT ob.*, CASE WHEN side = 'buy' THEN 1.0 ELSE -1.0 END AS sg, (SELECT score FROM sg s WHERE s.asset = ob.asset AND s.timestamp = ob.timestamp) AS score FROM ob),
  mk AS (SELECT *, CASE WHEN timestamp = start THEN greatest(c0, close) ELSE high END AS u, CASE WHEN timestamp = start THEN least(c0, close) ELSE low END AS dn FROM ob2),
  gp AS (SELECT * FROM (SELECT order_id AS position_id, start, timestamp, c0, sg, open, high, low, close, score, high - low AS atr, sg * (close / c0 - 1) AS ret, max(u) OVER b AS hwm, min(dn) OVER b AS lwm, row_number() OVER w - 1 AS held, lead(open) OVER w AS next_open FROM mk
  WINDOW w AS (PARTITION BY order_id ORDER BY timestamp), b AS (PARTITION BY order_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE timestamp > start)"""


@register("G0_position_bar_panel", _PANEL + " SELECT position_id, timestamp, round(ret, 6) AS ret, hwm, lwm, held::INT AS bars_held FROM gp")
def g0(spark, d):
    return bar_panel(spark, d).select("position_id", "timestamp", panel_queries.scaled_round(F.col("ret"), 6).alias("ret"), "hwm", "lwm", F.col("bars_held").cast("int").alias("bars_held"))


def _first(condition: str, price: str, reason: str) -> str:
    return _PANEL + f", x AS (SELECT *, {price} AS px FROM gp WHERE {condition}) SELECT position_id, min(timestamp) AS exit_time, '{reason}' AS reason, round(arg_min(px, timestamp), 6) AS price FROM x GROUP BY 1"


def _exit(*rules):
    def query(spark, d):
        return rounded(exits.first_exit(exits.with_entry_atr(bar_panel(spark, d)), *(r() for r in rules)))

    return query


def _fill(level: str, better: bool = False) -> str:
    gap = f"CASE WHEN sg > 0 THEN open {'>' if better else '<'} {level} ELSE open {'<' if better else '>'} {level} END"
    return f"CASE WHEN {gap} THEN open WHEN low <= {level} AND {level} <= high THEN {level} ELSE close END"


_ADVERSE = "CASE WHEN sg > 0 THEN low <= {0} ELSE high >= {0} END"
_SL, _TP = "(c0 * (1 - sg * 0.4))", "(c0 * (1 + sg * 0.5))"
_TRAIL = "(CASE WHEN sg > 0 THEN hwm * 0.5 ELSE lwm * 1.5 END)"
register("G1_stop_loss", _first(_ADVERSE.format(_SL), _fill(_SL), "stop_loss"))(_exit(lambda: exits.stop_loss(0.4)))
register("G2_take_profit", _first(f"CASE WHEN sg > 0 THEN high >= {_TP} ELSE low <= {_TP} END", _fill(_TP, True), "take_profit"))(_exit(lambda: exits.take_profit(0.5)))
register("G3_time_exit", _first("held >= 4", "NULL::DOUBLE", "time_exit"))(_exit(lambda: exits.time_exit(4)))
register("G4_trailing_stop", _first(_ADVERSE.format(_TRAIL), _fill(_TRAIL), "trailing_stop"))(_exit(lambda: exits.trailing_stop(0.5)))
_LIVE = "(CASE WHEN sg > 0 THEN greatest(hwm, high) * 0.5 ELSE least(lwm, low) * 1.5 END)"
register("G4b_trailing_stop_intrabar", _first(_ADVERSE.format(_LIVE), _fill(_LIVE), "trailing_stop"))(_exit(lambda: exits.trailing_stop(0.5, "intrabar")))
_CLOSE = "CASE WHEN sg > 0 THEN close <= {0} ELSE close >= {0} END"
register("G4c_trailing_stop_two_pass", _first(f"({_ADVERSE.format(_TRAIL)}) OR ({_CLOSE.format(_LIVE)})", f"CASE WHEN {_ADVERSE.format(_TRAIL)} THEN {_fill(_TRAIL)} ELSE close END", "trailing_stop"))(_exit(lambda: exits.trailing_stop(0.5, "two_pass")))
_TIGHT = "(CASE WHEN sg > 0 THEN hwm * (1 - {0}) ELSE lwm * (1 + {0}) END)".format("(CASE WHEN ret >= 0.3 THEN 0.2 WHEN ret >= 0.1 THEN 0.4 ELSE 0.6 END)")
register("G5_tightening_trail", _first(_CLOSE.format(_TIGHT), "NULL::DOUBLE", "tightening_trail"))(_exit(lambda: exits.tightening_trail([(0.0, 0.6), (0.1, 0.4), (0.3, 0.2)])))
_VS = "(c0 - sg * 0.5 * atr)"
register("G7_volatility_stop", _first(_CLOSE.format(_VS), _VS, "volatility_stop"))(_exit(lambda: exits.volatility_stop(0.5)))
_VT = "(CASE WHEN sg > 0 THEN hwm - 0.5 * atr ELSE lwm + 0.5 * atr END)"
register("G8_volatility_trail", _first(_CLOSE.format(_VT), _VT, "volatility_trail"))(_exit(lambda: exits.volatility_trail(0.5)))
register("G9_signal_exit", _first("CASE WHEN sg > 0 THEN score < -20 ELSE score > 20 END", "NULL::DOUBLE", "signal_exit"))(_exit(lambda: exits.signal_exit("score", 20.0)))


@register("G6_scaled_exit", _PANEL + """, t1 AS (SELECT position_id, min(timestamp) AS timestamp FROM gp WHERE ret >= 0.1 GROUP BY 1), t2 AS (SELECT g.position_id, min(g.timestamp) AS timestamp FROM gp g JOIN t1 USING (position_id) WHERE ret >= 0.3 AND g.timestamp > t1.timestamp GROUP BY 1)
  SELECT position_id, 1 AS target, timestamp, close AS price, 0.5::DOUBLE AS share FROM t1 JOIN gp USING (position_id, timestamp) UNION ALL SELECT position_id, 2, timestamp, close, 0.25 FROM t2 JOIN gp USING (position_id, timestamp)""")
def g6(spark, d):
    return exits.scaled_exits(bar_panel(spark, d), [(0.1, 0.5), (0.3, 0.5)])


@register("G10_first_exit", _PANEL + f""", x AS (SELECT position_id, timestamp, CASE WHEN {_ADVERSE.format(_SL)} THEN 'stop_loss' WHEN CASE WHEN sg > 0 THEN high >= {_TP} ELSE low <= {_TP} END THEN 'take_profit' WHEN held >= 6 AND CASE WHEN sg > 0 THEN score < -20 ELSE score > 20 END THEN 'time_exit AND signal_exit' END AS reason,
  CASE WHEN {_ADVERSE.format(_SL)} THEN {_fill(_SL)} WHEN CASE WHEN sg > 0 THEN high >= {_TP} ELSE low <= {_TP} END THEN {_fill(_TP, True)} END AS px FROM gp)
  SELECT position_id, min(timestamp) AS exit_time, arg_min(reason, timestamp) AS reason, round(max(px) FILTER (timestamp = f), 6) AS price FROM (SELECT *, min(timestamp) OVER (PARTITION BY position_id) AS f FROM x WHERE reason IS NOT NULL) GROUP BY 1""")
def g10(spark, d):
    return rounded(exits.first_exit(bar_panel(spark, d), exits.stop_loss(0.4), exits.take_profit(0.5), exits.all_of(exits.time_exit(6), exits.signal_exit("score", 20.0))))


@register("G11_stop_fill_price", _PANEL + f" SELECT position_id, timestamp, round({_fill(_SL)}, 6) AS stop_price, close AS close_price, CASE WHEN sg > 0 THEN low ELSE high END AS bar_extreme, next_open AS next_bar_open FROM gp")
def g11(spark, d):
    level = F.col("entry_price") * (1 - F.col("sign") * 0.4)
    out = bar_panel(spark, d).select("position_id", "timestamp", *(exits.stop_fill_price(level, "stop", m).alias(m) for m in ("stop_price", "close_price", "bar_extreme", "next_bar_open")))
    return out.withColumn("stop_price", F.round("stop_price", 6))


def sweep_grid(spark, d):
    """A parameter set a nation; its shares are decimals, as the SQL's literals are."""
    k, of = F.col("n_nationkey"), lambda x: F.lit(Decimal(x))
    grid = {"stop": of("0.1") + k * of("0.03"), "target": of("0.2") + k * of("0.03"), "trail": of("0.3") + k * of("0.02"), "hold": 3 + k % 5}
    return v.table(spark, d, "nation").select(F.concat(F.lit("n"), k.cast("string")).alias("run_id"), *(c.alias(name) for name, c in grid.items()))


@register("G12_exit_rule_sweep", _PANEL + """, pr AS (SELECT 'n' || n_nationkey AS run_id, 0.1 + n_nationkey * 0.03 AS stop, 0.2 + n_nationkey * 0.03 AS target, 0.3 + n_nationkey * 0.02 AS trail, 3 + n_nationkey % 5 AS hold FROM nation),
  x AS (SELECT run_id, position_id, timestamp, CASE WHEN CASE WHEN sg > 0 THEN low <= c0 * (1 - sg * stop) ELSE high >= c0 * (1 - sg * stop) END THEN 'stop_loss' WHEN CASE WHEN sg > 0 THEN high >= c0 * (1 + sg * target) ELSE low <= c0 * (1 + sg * target) END THEN 'take_profit'
  WHEN CASE WHEN sg > 0 THEN low <= hwm * (1 - trail) ELSE high >= lwm * (1 + trail) END THEN 'trailing_stop' WHEN held >= hold THEN 'time_exit' END AS reason FROM gp CROSS JOIN pr)
  SELECT run_id, position_id, min(timestamp) AS exit_time, arg_min(reason, timestamp) AS reason FROM x WHERE reason IS NOT NULL GROUP BY 1, 2""")
def g12(spark, d):
    return exits.exit_rule_sweep(bar_panel(spark, d), sweep_grid(spark, d)).select("run_id", "position_id", "exit_time", "reason")


_SWEPT = _PANEL + f""", pr AS (SELECT 'n' || n_nationkey AS run_id, 0.1 + n_nationkey * 0.03 AS stop, 0.2 + n_nationkey * 0.03 AS target, 0.3 + n_nationkey * 0.02 AS trail, 3 + n_nationkey % 5 AS hold FROM nation),
  xl AS (SELECT *, c0 * (1 - sg * stop) AS ls, c0 * (1 + sg * target) AS lt, CASE WHEN sg > 0 THEN hwm * (1 - trail) ELSE lwm * (1 + trail) END AS lr FROM gp CROSS JOIN pr),
  xe AS (SELECT run_id, position_id, timestamp, c0, sg, held, CASE WHEN {_ADVERSE.format("ls")} THEN 'stop_loss' WHEN CASE WHEN sg > 0 THEN high >= lt ELSE low <= lt END THEN 'take_profit' WHEN {_ADVERSE.format("lr")} THEN 'trailing_stop' WHEN held >= hold THEN 'time_exit' END AS reason,
  CASE WHEN {_ADVERSE.format("ls")} THEN {_fill("ls")} WHEN CASE WHEN sg > 0 THEN high >= lt ELSE low <= lt END THEN {_fill("lt", True)} WHEN {_ADVERSE.format("lr")} THEN {_fill("lr")} ELSE close END AS px FROM xl),
  xt AS (SELECT run_id, position_id, c0, sg, px, held, reason FROM xe WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id, position_id ORDER BY timestamp) = 1)"""
