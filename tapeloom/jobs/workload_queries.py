"""Chained workloads: an exit-rule sweep from entries to its summary files, and a post-trade report from trades, signals and equity."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.jobs import analysis_queries, panel_queries, trading_queries
from tapeloom.operators import equity, exits, trades
from tapeloom.sources import results
from tapeloom.sources import views as v

QUERIES: dict = {}
SQL: dict[str, str] = {}
register = partial(panel_queries.register, queries=QUERIES, oracles=SQL)


def sweep(entries: DataFrame, bars: DataFrame, params: DataFrame, seconds: int, path: str) -> dict[str, DataFrame]:
    """Trades and summary of each parameter set (run_id, stop, target, trail, hold) over all entries; written below path, the summary as CSV, too.

    Shuffles: entries and bars by (asset, bucket), the panel by position, first exits by (run, position), statistics by run."""
    panel = exits.position_bar_panel(entries, bars, seconds)
    left = exits.exit_rule_sweep(panel, params)
    side = F.when(F.col("side") == "long", 1.0).otherwise(-1.0)
    closed = left.join(entries.select("position_id", "asset", "entry_time", "entry_price", side.alias("quantity")), "position_id")
    pnl = (F.col("exit_price") - F.col("entry_price")) * F.col("quantity")
    closed = closed.select(
        "run_id", F.col("position_id").alias("trade_id"), F.col("asset").alias("symbol"), "entry_time", "exit_time", "entry_price", "exit_price", "quantity", pnl.alias("pnl"), F.col("ret").alias("pnl_percent"),
        "bars_held", F.col("reason").alias("exit_reason"), F.lit("closed").alias("status"), *(F.lit(0.0).alias(c) for c in ("fees", "slippage", "entry_slippage", "mfe", "mae")), F.lit(1.0).alias("multiplier"),
    )
    closed.write.mode("overwrite").partitionBy("run_id").parquet(f"{path}/trades")
    done = params.sparkSession.read.schema(closed.schema).parquet(f"{path}/trades")
    summary = results.sweep_summary(trades.trade_stats(done), params, csv=f"{path}/summary_csv")
    summary.write.mode("overwrite").parquet(f"{path}/summary")
    return {"trades": done, "summary": params.sparkSession.read.schema(summary.schema).parquet(f"{path}/summary")}


@register("W2_exit_rule_sweep", trading_queries._SWEPT + """, ret AS (SELECT run_id, (px - c0) * sg AS pnl, sg * (px / c0 - 1) AS r, held FROM xt)
  SELECT run_id, stop, target, count(*) AS num_trades, round(avg((pnl > 0)::INT), 9) AS win_rate, round(avg(r), 9) AS avg_trade, round(CASE WHEN sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) > 0 THEN sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) ELSE 'inf'::DOUBLE END, 7) AS profit_factor
  FROM ret JOIN pr USING (run_id) GROUP BY 1, 2, 3""")
def w2(spark, d):
    bars = v.bars_user(spark, d).join(v.signals(spark, d).select("asset", "timestamp"), ["asset", "timestamp"])
    out = sweep(trading_queries.entries(spark, d), bars, trading_queries.sweep_grid(spark, d), 5 * 86400, results.scratch(spark))["summary"]
    return out.select("run_id", *(F.col(c).cast("double").alias(c) for c in ("stop", "target")), "num_trades", *(F.round(c, 9).alias(c) for c in ("win_rate", "avg_trade")), F.round("profit_factor", 7).alias("profit_factor"))


def report(closed: DataFrame, signals: DataFrame, curve: DataFrame, columns: list[str], reasons: list[str] | None, path: str, seconds: int | None = 365 * 86400) -> dict[str, DataFrame]:
    """Enriched trades (of some exit reasons, or all), their statistics by direction, symbol and reason, and a report a run; written below path.

    Enriched trades are written once and read by all statistics."""
    chosen = closed if reasons is None else closed.filter(F.col("exit_reason").isin(reasons))
    rich = trades.enrich_trades_with_signals(chosen, signals, columns, seconds=seconds)
    rich.write.mode("overwrite").partitionBy("run_id").parquet(f"{path}/trades")
    rich = closed.sparkSession.read.schema(rich.schema).parquet(f"{path}/trades")
    stats = trades.trade_stats_by(rich)
    stats.write.mode("overwrite").parquet(f"{path}/statistics")
    seen = rich.groupBy("run_id").agg(*(F.avg(f"entry_{c}").alias(f"entry_{c}") for c in columns), F.count(f"entry_{columns[0]}").alias("num_enriched"))
    runs = trades.trade_stats(rich).select("run_id", "num_trades", "win_rate", "net_profit").join(trades.optimal_exit_levels(rich, 80, 60), "run_id").join(seen, "run_id")
    runs = runs.join(equity.daily_metrics(curve, 252.0).select("run_id", "sharpe", "max_drawdown"), "run_id", "left")
    results.metrics_report_json(runs, f"{path}/report")
    return {"trades": rich, "statistics": closed.sparkSession.read.schema(stats.schema).parquet(f"{path}/statistics"), "report": closed.sparkSession.read.schema(runs.schema).json(f"{path}/report")}


@register("W3_trade_report", """, s AS (SELECT l_partkey::VARCHAR AS asset, o_orderdate AS timestamp, max(l_quantity) AS momentum, min(l_discount) AS rsi FROM ln GROUP BY 1, 2), c AS (SELECT * FROM tr WHERE exit_reason IN ('stop_loss', 'take_profit')),
  a AS (SELECT c.*, s.momentum, s.rsi FROM c ASOF LEFT JOIN s ON c.symbol = s.asset AND c.entry_time >= s.timestamp)
  SELECT run_id, count(*) FILTER (status = 'closed') AS num_trades, round(avg((pnl > 0)::INT) FILTER (status = 'closed'), 9) AS win_rate, round(sum(pnl) FILTER (status = 'closed'), 3) AS net_profit, round(quantile_cont(mae, 0.2) FILTER (pnl > 0 AND status = 'closed'), 7) AS stop_level, round(quantile_cont(mfe, 0.4) FILTER (status = 'closed'), 7) AS target_level,
  round(avg(momentum), 7) AS entry_momentum, round(avg(rsi), 7) AS entry_rsi, count(momentum) AS num_enriched FROM a GROUP BY 1""")
def w3(spark, d):
    out = report(v.trades(spark, d), analysis_queries.part_signals(spark, d), v.equity(spark, d), ["momentum", "rsi"], ["stop_loss", "take_profit"], results.scratch(spark), seconds=None)["report"]
    seven = ("stop_level", "target_level", "entry_momentum", "entry_rsi")
    return out.select("run_id", "num_trades", F.round("win_rate", 9).alias("win_rate"), F.round("net_profit", 3).alias("net_profit"), *(F.round(c, 7).alias(c) for c in seven), "num_enriched")
