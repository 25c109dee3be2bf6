"""A research run as one job: panel -> targets -> orders -> fills -> trades and equity -> metrics -> files."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import costs
from tapeloom.jobs import panel_queries, trading_queries
from tapeloom.operators import equity, ledger, orders, panel, signals
from tapeloom.operators.joins import MONTH, asof_join
from tapeloom.sources import results
from tapeloom.sources import views as v

QUERIES: dict = {}
SQL: dict[str, str] = {}
register = partial(panel_queries.register, queries=QUERIES, oracles=SQL)


def research_run(bars: DataFrame, scores: DataFrame, top: int, bottom: int, slippage: float, commission: float, initial: float, run_id: str = "run", path: str | None = None) -> dict[str, DataFrame]:
    """fills, trades, equity and metrics of holding the best ``top`` assets long and the worst ``bottom`` short, by last known score.

    A change of target is filled at the asset's next bar's open. Fills, trades and the curve are written once, to ``path`` or else to a scratch
    folder, and read back by what needs them; the metrics are computed from the files, and with a path written there, too."""
    spark, at = bars.sparkSession, path or results.scratch(bars.sparkSession)

    def stored(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    ranked = signals.canonical_target_shares(panel.densify_panel(scores, "score"), top, bottom)
    changes = signals.target_trace(ranked).select("asset", "timestamp", "delta")
    ahead = asof_join(changes, bars.select("asset", "timestamp", "open", F.col("timestamp").alias("at")).filter("open is not null"), ["asset"], "timestamp", "timestamp", ["open", "at"], seconds=12 * MONTH, ahead=True, strict=True)
    todo = ahead.filter("open is not null").withColumnsRenamed({"open": "base_price", "at": "fill_time"})
    todo = todo.withColumns({"side": F.when(F.col("delta") > 0, "buy").otherwise("sell"), "quantity": F.abs("delta")})
    priced = orders.price_fills(todo, slippage=lambda q, p: costs.slippage_percent(q, p, slippage), commission=lambda q, p: costs.commission_percent(q, p, commission))
    order_id = F.concat_ws("-", "asset", F.date_format("timestamp", "yyyyMMddHHmmss"))
    fills = stored("fills", priced.select(
        F.lit(run_id).alias("run_id"), order_id.alias("order_id"), "asset", F.col("fill_time").alias("timestamp"), "side", F.col("filled").alias("quantity"),
        F.col("fill_price").alias("price"), "commission", F.abs(F.col("fill_price") - F.col("base_price")).alias("slippage"),
    ))
    folded = ledger.fills_to_trades(fills)
    left = ledger.open_trades(folded, bars)
    columns = ["run_id", "asset", "episode", "entry_time", "exit_time", "entry_price", "exit_price", "quantity", "pnl", "partial_pnl", "fees", "exit_reason", "status"]
    trades = stored("trades", folded.filter("not is_open").withColumns({"exit_reason": F.lit("signal"), "status": F.lit("closed")}).select(columns).unionByName(left.select(columns)))
    curve = stored("equity", ledger.mark_to_market(fills, bars, initial))
    closed = F.col("status") == "closed"
    counts = trades.groupBy("run_id").agg(
        F.count_if(closed).alias("num_trades"), F.count_if(~closed).alias("num_open"), F.sum(F.when(closed, F.col("pnl"))).alias("closed_pnl"), F.sum(F.col("pnl") + F.col("partial_pnl")).alias("total_pnl"),
        F.avg(F.when(closed, (F.col("pnl") > 0).cast("int"))).alias("win_rate"),
    )
    spent = fills.groupBy("run_id").agg(F.sum("commission").alias("total_commission"), F.sum(F.col("slippage") * F.col("quantity")).alias("total_slippage"), F.count("*").alias("num_fills"))
    metrics = equity.equity_metrics(curve).join(counts, "run_id").join(spent, "run_id")
    out = {"fills": fills, "trades": trades, "equity": curve, "metrics": metrics}
    if path:
        results.write_result(out, path, ["metrics"])
    return out


_FILLS = panel_queries._TARGETS + """, l AS (SELECT timestamp, asset, target - lag(target, 1, 0.0) OVER (PARTITION BY asset ORDER BY timestamp) AS delta FROM tg),
  wo AS (SELECT l.asset, l.timestamp AS t0, delta, min(b.timestamp) AS timestamp FROM l JOIN bu b ON b.asset = l.asset AND b.timestamp > l.timestamp WHERE delta <> 0 GROUP BY ALL),
  wf AS MATERIALIZED (SELECT 'run' AS run_id, asset || '-' || strftime(t0, '%Y%m%d%H%M%S') AS order_id, asset, timestamp, CASE WHEN delta > 0 THEN 'buy' ELSE 'sell' END AS side, abs(delta) AS quantity, delta AS dq, open * (1 + sign(delta) * 0.001) AS price, abs(delta * open * (1 + sign(delta) * 0.001)) * 0.0005 AS commission, open * 0.001 AS slippage FROM wo JOIN bu USING (asset, timestamp))"""
_CURVE = """, wp AS (SELECT b.asset, b.timestamp, b.close * coalesce((SELECT sum(dq) FROM wf u WHERE u.asset = b.asset AND u.timestamp <= b.timestamp), 0) AS value FROM bu b WHERE b.asset IN (SELECT asset FROM wf)),
  wc AS (SELECT timestamp, value - coalesce(lag(value) OVER (PARTITION BY asset ORDER BY timestamp), 0) AS d FROM wp), ww AS (SELECT timestamp, sum(sum(d)) OVER (ORDER BY timestamp) AS worth FROM wc GROUP BY 1),
  we AS (SELECT timestamp, 1e6 + worth + coalesce((SELECT sum(-dq * price - commission) FROM wf u WHERE u.timestamp <= ww.timestamp), 0) AS equity FROM ww),
  wr AS (SELECT timestamp, equity, coalesce(equity / lag(equity) OVER (ORDER BY timestamp) - 1, 0) AS ret, equity / max(equity) OVER (ORDER BY timestamp ROWS UNBOUNDED PRECEDING) - 1 AS dd, row_number() OVER (ORDER BY timestamp) AS i FROM we),
  wm AS (SELECT count(*) AS n, arg_max(equity, timestamp) AS final, arg_min(equity, timestamp) AS initial, min(dd) AS mdd, avg(ret) FILTER (i > 1) AS m, stddev_samp(ret) FILTER (i > 1) AS s, date_diff('second', min(timestamp), max(timestamp)) / (365.25 * 86400) AS years FROM wr)"""
_LAST = """, la AS (SELECT asset, max(timestamp) AS exit_time, max_by(close, timestamp) AS exit_price FROM bu GROUP BY 1),
  wt AS (SELECT td.run_id, td.exit_price IS NULL AS is_open, (coalesce(td.exit_price, la.exit_price) - entry) * last - (entry_fee + exit_fee) AS pnl, partial FROM td JOIN la USING (asset))"""


def run(spark, d, path: str | None = None) -> dict[str, DataFrame]:
    """The run over the daily bars of all users."""
    return research_run(v.bars_user(spark, d), v.signals(spark, d), 25, 25, 0.001, 0.0005, 1e6, path=path)


@register("W1_research_run", _FILLS + trading_queries._FOLD.replace("FROM fl)", "FROM wf)") + _CURVE + _LAST + """
  SELECT 'run' AS run_id, n, round(final, 3) AS final, round(final / initial - 1, 9) AS total_return, round(mdd, 9) AS max_drawdown, round(m / s * sqrt((n - 1) / years), 6) AS sharpe, (SELECT count(*) FILTER (NOT is_open) FROM wt) AS num_trades, (SELECT count(*) FILTER (is_open) FROM wt) AS num_open,
  round((SELECT sum(pnl + partial) FROM wt), 3) AS total_pnl, round((SELECT avg((pnl > 0)::INT) FILTER (NOT is_open) FROM wt), 9) AS win_rate, round((SELECT sum(commission) FROM wf), 4) AS total_commission, (SELECT count(*) FROM wf) AS num_fills FROM wm""")
def w1(spark, d):
    m = run(spark, d)["metrics"]
    return m.select("run_id", "n", F.round("final", 3).alias("final"), *(F.round(c, 9).alias(c) for c in ("total_return", "max_drawdown")), F.round("sharpe", 6).alias("sharpe"), "num_trades", "num_open", F.round("total_pnl", 3).alias("total_pnl"), F.round("win_rate", 9).alias("win_rate"), F.round("total_commission", 4).alias("total_commission"), "num_fills")
