"""Portfolio risk scans over histories of positions and equity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeloom.operators.joins import MONTH, bucket, scanned


def in_order():
    return W.partitionBy("run_id").orderBy("timestamp")


def portfolio_state(positions: DataFrame, equity: DataFrame, initial: float, seconds: int = MONTH) -> DataFrame:
    """Per run and time: marks, drawdown, number of positions, gross and net value, P&L of the day. Runs are scanned in time buckets."""
    v = F.col("value")
    sums = positions.groupBy("run_id", "timestamp").agg(F.count_if(v != 0).alias("num_positions"), F.sum(F.abs(v)).alias("gross"), F.sum(v).alias("net"))
    out = equity.join(sums, ["run_id", "timestamp"], "left").fillna(0, ["num_positions", "gross", "net"])
    out = scanned(out, ["run_id"], bucket(F.col("timestamp"), seconds), ["timestamp"], hwm=("max", F.col("equity")), first_day=("first", F.to_date("timestamp")))
    out = out.withColumn("hwm", F.greatest("hwm", F.lit(initial))).withColumn("drawdown", F.greatest(F.lit(0.0), 1 - F.col("equity") / F.col("hwm")))
    day = W.partitionBy("run_id", F.to_date("timestamp")).orderBy("timestamp").rowsBetween(W.unboundedPreceding, 0)
    base = F.when(F.to_date("timestamp") == F.col("first_day"), F.lit(initial)).otherwise(F.first("equity").over(day))
    return out.withColumn("daily_pnl", F.col("equity") - base).drop("first_day")


def check_limits(state: DataFrame, drawdown: float, warn: float, positions: int, daily_loss: float, gross: float, net: tuple[float, float]) -> DataFrame:
    """One row per time and limit: breached, action. Equity not above 0 is never a breach."""
    e, ok = F.col("equity"), F.col("equity") > 0
    loss = F.try_divide(-F.col("daily_pnl"), e)
    g, n = F.try_divide("gross", "equity"), F.try_divide("net", "equity")
    rows = [
        ("max_drawdown", F.col("drawdown") >= drawdown, F.when(F.col("drawdown") >= drawdown, "halt").when(F.col("drawdown") >= warn, "warn")),
        ("max_positions", F.col("num_positions") >= positions, None), ("daily_loss", ok & (loss > daily_loss), None),
        ("gross_exposure", ok & (g > gross), None), ("net_exposure", ok & ((n > net[1]) | (n < net[0])), None),
    ]
    structs = []
    for name, breach, action in rows:
        b = F.coalesce(breach, F.lit(False))
        act = action if action is not None else F.when(b, "halt" if name == "daily_loss" else "reduce")
        structs.append(F.struct(F.lit(name).alias("limit"), b.alias("breached"), F.coalesce(act, F.lit("none")).alias("action")))
    return state.select("run_id", "timestamp", F.explode(F.array(*structs)).alias("x")).select("run_id", "timestamp", "x.*")


def check_asset_exposure(positions: DataFrame, equity: DataFrame, most: float) -> DataFrame:
    """First asset (by name) of each time whose share of equity is above the limit."""
    share = F.abs("value") / F.col("equity")
    over = positions.join(equity.filter("equity > 0"), ["run_id", "timestamp"]).withColumn("share", share).filter(F.col("share") > most)
    return over.groupBy("run_id", "timestamp").agg(F.min("asset").alias("asset"), F.min_by("share", "asset").alias("share"))


def rolling_var(returns: DataFrame, window: int = 20, level: float = 0.05) -> DataFrame:
    frame = in_order().rowsBetween(-(window - 1), 0)
    return returns.withColumn("var", F.when(F.count("ret").over(frame) >= window, -F.percentile("ret", level).over(frame)))


def rolling_cvar(returns: DataFrame, window: int = 20, level: float = 0.05) -> DataFrame:
    """Less the mean of the window's returns at or below its percentile."""
    frame = in_order().rowsBetween(-(window - 1), 0)
    out = rolling_var(returns, window, level).withColumn("_w", F.collect_list("ret").over(frame))  # window values
    tail = F.filter("_w", lambda x: x <= -F.col("var"))
    return out.withColumn("cvar", F.when(F.col("var").isNotNull(), -F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.size(tail))).drop("_w")


def check_loading(positions: DataFrame, equity: DataFrame, loadings: DataFrame, column: str, missing: float, low: float, high: float) -> DataFrame:
    """Sum of weight x loading per time (missing loadings as given) and whether it leaves the band."""
    at = positions.join(equity.filter("equity > 0"), ["run_id", "timestamp"]).join(loadings.select("asset", column), "asset", "left")
    total = F.sum(F.col("value") / F.col("equity") * F.coalesce(F.col(column), F.lit(missing)))
    return at.groupBy("run_id", "timestamp").agg(total.alias("exposure")).withColumn("breached", ~F.col("exposure").between(low, high))


def check_sector(positions: DataFrame, equity: DataFrame, sectors: DataFrame, most: float) -> DataFrame:
    at = positions.join(equity.filter("equity > 0"), ["run_id", "timestamp"]).join(sectors.select("asset", "sector"), "asset", "left")
    out = at.groupBy("run_id", "timestamp", F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg(F.sum(F.abs("value") / F.col("equity")).alias("exposure"))
    return out.withColumn("breached", F.col("exposure") > most)


def halt_timeline(results: DataFrame, seconds: int = MONTH) -> DataFrame:
    """Per time: halted from the first halt on, the latest halting limit, this time's warnings. Runs are scanned in time buckets."""
    per_time = results.groupBy("run_id", "timestamp").agg(F.max(F.col("action") == "halt").alias("halts"), F.min(F.when(F.col("action") == "halt", F.col("limit"))).alias("reason"), F.count_if(F.col("action") == "warn").alias("warnings"))
    out = scanned(per_time, ["run_id"], bucket(F.col("timestamp"), seconds), ["timestamp"], halted=("max", F.col("halts")), halt_reason=("last", F.col("reason")))
    return out.select("run_id", "timestamp", "halted", "halt_reason", "warnings")
