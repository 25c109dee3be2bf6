"""Invariants of trades and fills, and reconciliation of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeloom.operators.trades import trade_costs


def check_trades(trades: DataFrame, tolerance: float = 1e-3, final: DataFrame | list[Column] | None = None, open_reason: str = "still_open") -> DataFrame:
    """Counts of violations per run, in one pass.

    exit_reason: losing take-profits, winning stop-losses, trailing stops without a favourable move, closed trades with the reason of open ones.
    final (run_id, initial_cash, final_equity, fill_costs): adds ``terminal``, 1 where initial cash and all P&L do not add up to the final equity
    (or with the columns of such a table as aggregates of the trades themselves, in the same pass) within the greatest of the tolerance, 1e-6 of the equity, 5 % of the fills' costs and 1e-4 of the open notional."""
    bad = lambda c, name: F.count_if(F.coalesce(c, F.lit(True))).alias(name)
    why = F.when(F.col("exit_reason") == "stop_loss", F.col("gross_pnl") > 1e-4).when(F.col("exit_reason") == "take_profit", F.col("gross_pnl") < -1e-4)
    why = why.when(F.col("exit_reason") == "trailing_stop", F.col("mfe") <= -1e-4).when(F.col("exit_reason") == open_reason, F.col("status") != "open").otherwise(False)
    is_open = F.col("status") == "open"
    counts = trade_costs(trades).groupBy("run_id").agg(
        bad(F.abs(F.col("gross_pnl") - F.col("fees") - F.col("pnl")) > tolerance, "pnl_identity"),
        bad((F.col("gross_pnl") * F.col("pnl_percent") < 0) & (F.abs("pnl_percent") > 1e-4), "sign"), bad(F.col("mfe") < 0, "mfe"), bad(F.col("mae") > 0, "mae"),
        bad((F.col("fees") < 0) | (F.col("multiplier") <= 0), "costs"), bad(F.isnan("pnl") | F.isnan("entry_price") | F.isnan("exit_price"), "nan"), bad(F.col("exit_time") < F.col("entry_time"), "order"),
        F.count_if(why).alias("exit_reason"), F.sum("pnl").alias("_pnl"), F.sum(F.when(is_open, F.abs("quantity") * F.col("exit_price") * F.col("multiplier")).otherwise(0.0)).alias("_open"), *(final if isinstance(final, list) else ()),
    )
    if final is None:
        return counts.drop("_pnl", "_open")
    within = F.greatest(F.lit(tolerance), F.abs("final_equity") * 1e-6, F.col("fill_costs") * 0.05, F.col("_open") * 1e-4)
    off = F.abs(F.col("initial_cash") + F.col("_pnl") - F.col("final_equity")) > within
    ended = counts if isinstance(final, list) else counts.join(final, "run_id", "left")
    return ended.withColumn("terminal", F.coalesce(off, F.lit(True)).cast("int")).drop("_pnl", "_open", "initial_cash", "final_equity", "fill_costs")


def check_fills(fills: DataFrame, sequence: list[str], block: Column) -> DataFrame:
    """Fills earlier than the one before them in sequence, and prices outside their limits and stops (columns order_type, limit_price, stop_price).

    block: a number that grows with the sequence; a run is checked block by block, and each block's first fill against the last one of the
    block before, so that no run is sorted in one task."""
    inside = W.partitionBy("run_id", "_block").orderBy(*sequence)
    ordered = fills.withColumn("_block", block).withColumn("_before", F.lag("timestamp").over(inside))
    buy = F.col("side") == "buy"
    limit = (F.col("order_type") == "limit") & F.when(buy, F.col("price") > F.col("limit_price") + 1e-8).otherwise(F.col("price") < F.col("limit_price") - 1e-8)
    stop = (F.col("order_type") == "stop") & F.when(buy, F.col("price") < F.col("stop_price") - 1e-8).otherwise(F.col("price") > F.col("stop_price") + 1e-8)
    at = F.struct(*sequence)
    blocks = ordered.groupBy("run_id", "_block").agg(
        F.count_if(F.col("timestamp") < F.col("_before")).alias("n"), F.count_if(limit).alias("limit"), F.count_if(stop).alias("stop"), F.min_by("timestamp", at).alias("first"), F.max_by("timestamp", at).alias("last"),
    )
    edge = F.col("first") < F.lag("last").over(W.partitionBy("run_id").orderBy("_block"))
    return blocks.withColumn("edge", F.coalesce(edge.cast("int"), F.lit(0))).groupBy("run_id").agg((F.sum("n") + F.sum("edge")).alias("out_of_order"), F.sum("limit").alias("beyond_limit"), F.sum("stop").alias("beyond_stop"))


def reconcile_trades(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """Per symbol the i-th trades of both: counts, matches within tolerance, share, pass at 99 %."""
    number = F.row_number().over(W.partitionBy("symbol").orderBy("entry_time", "exit_time", "trade_id", "entry_price", "exit_price"))
    one, two = (x.select("symbol", number.alias("i"), F.col("entry_price").alias(f"entry_{s}"), F.col("exit_price").alias(f"exit_{s}")) for x, s in ((a, "a"), (b, "b")))
    both = one.join(two, ["symbol", "i"], "full_outer")
    same = (F.abs(F.col("entry_a") - F.col("entry_b")) <= tolerance) & (F.abs(F.col("exit_a") - F.col("exit_b")) <= tolerance)
    out = both.groupBy("symbol").agg(F.count("entry_a").alias("n_a"), F.count("entry_b").alias("n_b"), F.count_if(same).alias("matched"), F.count("*").alias("n"))
    return out.withColumn("share", F.col("matched") / F.col("n")).withColumn("passed", F.col("share") >= 0.99).drop("n")


def compare_run_results(a: DataFrame, b: DataFrame, tolerances: dict[str, float]) -> DataFrame:
    """One row per run and metric: difference, tolerance, passed; and whether all of the run's pass."""
    both = a.select("run_id", *(F.col(m).cast("double").alias(f"a_{m}") for m in tolerances)).join(b.select("run_id", *(F.col(m).cast("double").alias(f"b_{m}") for m in tolerances)), "run_id")
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), F.abs(F.col(f"a_{m}") - F.col(f"b_{m}")).alias("difference"), F.lit(float(t)).alias("tolerance")) for m, t in tolerances.items()))
    out = both.select("run_id", F.explode(cells).alias("x")).select("run_id", "x.*").withColumn("passed", F.col("difference") <= F.col("tolerance"))
    return out.withColumn("all_passed", F.min("passed").over(W.partitionBy("run_id")))
