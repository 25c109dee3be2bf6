"""Trade analytics."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeloom.operators.joins import asof_join
from tapeloom.sources.results import stored


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _ratio(gain: Column, loss: Column) -> Column:
    """gain / loss; infinite without loss, 0 without either."""
    return F.when(loss > 0, gain / loss).when(gain > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))


def trade_costs(trades: DataFrame) -> DataFrame:
    q = F.abs("quantity")
    notional = F.col("entry_price") * q * F.col("multiplier")
    out = trades.withColumns({"gross_pnl": (F.col("exit_price") - F.col("entry_price")) * F.col("quantity") * F.col("multiplier"), "notional": notional, "total_slippage_cost": (F.col("entry_slippage") + F.col("slippage")) * q * F.col("multiplier")})
    return out.withColumns({"net_return": _div(F.col("pnl"), F.col("notional")), "cost_drag": _div(F.col("fees") + F.col("total_slippage_cost"), F.col("notional"))})


def _stats() -> list[Column]:
    pnl, ret, win, loss = F.col("pnl"), F.col("pnl_percent"), F.col("pnl") > 0, F.col("pnl") < 0
    n, zero = F.count("*"), F.lit(0.0)
    total = lambda c, x: F.coalesce(F.sum(F.when(c, x)), zero)
    mean = lambda c, x: F.coalesce(F.avg(F.when(c, x)), zero)
    rate = F.avg(win.cast("double"))
    return [
        n.alias("num_trades"), F.count_if(win).alias("num_winners"), F.count_if(loss).alias("num_losers"), rate.alias("win_rate"),
        total(win, pnl).alias("gross_profit"), F.abs(total(loss, pnl)).alias("gross_loss"), F.sum("pnl").alias("net_profit"),
        _ratio(total(win, pnl), F.abs(total(loss, pnl))).alias("profit_factor"), mean(win, ret).alias("avg_win"), mean(loss, ret).alias("avg_loss"), F.avg("pnl_percent").alias("avg_trade"),
        F.coalesce(F.max(F.when(win, ret)), zero).alias("largest_win"), F.coalesce(F.min(F.when(loss, ret)), zero).alias("largest_loss"),
        (rate * mean(win, ret) + (1 - rate) * mean(loss, ret)).alias("expectancy"), _ratio(mean(win, ret), F.abs(mean(loss, ret))).alias("payoff_ratio"),
        F.avg("bars_held").alias("avg_bars_held"), F.sum("fees").alias("total_fees"), F.sum("total_slippage_cost").alias("total_slippage"), F.sum("gross_pnl").alias("total_gross_pnl"),
        F.avg("cost_drag").alias("avg_cost_drag"), _ratio(total(F.col("gross_pnl") > 0, F.col("gross_pnl")), F.abs(total(F.col("gross_pnl") < 0, F.col("gross_pnl")))).alias("gross_profit_factor"),
        F.avg("mfe").alias("avg_mfe"), F.avg("mae").alias("avg_mae"), mean(F.col("mfe") > 0, ret / F.when(F.col("mfe") > 0, F.col("mfe"))).alias("mfe_capture_ratio"),
        mean((F.col("mae") < 0) & (ret < 0), ret / F.when(F.col("mae") < 0, F.col("mae"))).alias("mae_recovery_ratio"),
    ]


def trade_stats(trades: DataFrame, *by: str) -> DataFrame:
    """Statistics of closed trades, one row per run (or other keys)."""
    return trade_costs(trades.filter("status = 'closed'")).groupBy(*(by or ("run_id",))).agg(*_stats())


def trade_stats_by(trades: DataFrame) -> DataFrame:
    """The same over all trades, by direction, by symbol and by exit reason (grouping sets in one pass)."""
    closed = trade_costs(trades.filter("status = 'closed'"))
    level = F.grouping_id().alias("level")
    return closed.groupingSets([[], [F.col("direction")], [F.col("symbol")], [F.col("exit_reason")]], F.col("direction"), F.col("symbol"), F.col("exit_reason")).agg(level, *_stats())


#: Groups whose spans and bins may be broadcast.
FEW = 1000


def few(values: DataFrame, by: list[str]) -> bool:
    """Whether there are at most FEW groups (counted)."""
    return values.select(*by).distinct().limit(FEW + 1).count() <= FEW


def exact_quantiles(values: DataFrame, by: list[str], value: str, shares: dict[str, float], bins: int = 4096, small: bool = False) -> DataFrame:
    """Columns name=share: exact quantiles, linear between ranks, of the values (not null) of each group; groups without values are left out.

    Two passes, with no group's values in one buffer: counts in ``bins`` equal ranges of the group's span give the base rank of each range; then only
    rows of ranges that hold a wanted rank are numbered, a range at a time. With few groups (``small``) their spans and ranges, at most two a share
    and group, are broadcast, so that only rows of those ranges are shuffled."""
    sent = F.broadcast if small else lambda df: df
    rows = values.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    span = rows.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    place = F.least(F.coalesce(F.floor(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins), F.lit(0)), F.lit(bins - 1))
    binned = rows.join(sent(span), by).withColumn("_bin", place)
    counts = binned.groupBy(*by, "_bin").agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    base = F.sum("_c").over(W.partitionBy(*by).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")  # at most ``bins`` rows a group
    wanted = F.array_distinct(F.flatten(F.array(*(F.array(F.floor((F.col("_n") - 1) * q), F.ceil((F.col("_n") - 1) * q)) for q in shares.values()))))
    held = counts.withColumn("_base", base).withColumn("_ranks", F.filter(wanted, lambda r: (r >= F.col("_base")) & (r < F.col("_base") + F.col("_c")))).filter(F.size("_ranks") > 0)
    inside = binned.drop("_lo", "_hi", "_n").join(sent(held.select(*by, "_bin", "_base", "_ranks", "_n")), [*by, "_bin"])
    rank = F.row_number().over(W.partitionBy(*by, "_bin").orderBy("_v")) - 1 + F.col("_base")
    found = inside.withColumn("_rank", rank).filter(F.array_contains("_ranks", F.col("_rank")))

    def at(q: float) -> Column:
        exact = (F.col("_n") - 1) * q
        low, high = (F.max(F.when(F.col("_rank") == f(exact), F.col("_v"))) for f in (F.floor, F.ceil))
        return low + (high - low) * (F.max(exact) - F.floor(F.max(exact)))

    return found.groupBy(*by).agg(*(at(q).alias(name) for name, q in shares.items()))


def mae_mfe_stats(trades: DataFrame) -> DataFrame:
    """Distribution of excursions per run (population deviation, linear percentiles). The columns read are stored once for all passes."""
    closed, out = stored(trades.filter("status = 'closed'").select("run_id", "mfe", "mae", "pnl_percent")), []
    small = few(closed, ["run_id"])
    for c in ("mfe", "mae"):
        out += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    edge = _ratio(F.avg("mfe"), F.abs(F.avg("mae"))).alias("edge_ratio")
    efficiency = F.coalesce(F.avg(F.when(F.col("mfe") > 0, F.col("pnl_percent") / F.when(F.col("mfe") > 0, F.col("mfe")))), F.lit(0.0)).alias("efficiency")
    stats = closed.groupBy("run_id").agg(F.count("*").alias("n"), *out, edge, efficiency)
    for c in ("mfe", "mae"):
        at = {f"{c}_{n}": q for n, q in (("p10", 0.10), ("p25", 0.25), ("median", 0.50), ("p75", 0.75), ("p90", 0.90))}
        stats = stats.join(exact_quantiles(closed, ["run_id"], c, at, small=small), "run_id", "left")
    return stats


def optimal_exit_levels(trades: DataFrame, stop_percentile: float, target_percentile: float) -> DataFrame:
    """Stop from the excursions of winners (of all without any), target from all, and their ratio. The columns read are stored once for all passes."""
    closed = stored(trades.filter("status = 'closed'").select("run_id", "mfe", "mae", (F.col("pnl") > 0).alias("won")))
    quantiles = partial(exact_quantiles, by=["run_id"], small=few(closed, ["run_id"]))
    stop, target = (100 - stop_percentile) / 100, (100 - target_percentile) / 100
    levels = quantiles(closed, value="mfe", shares={"target_level": target}).join(quantiles(closed, value="mae", shares={"_all": stop}), "run_id", "full_outer")
    levels = levels.join(quantiles(closed.filter("won"), value="mae", shares={"_winners": stop}), "run_id", "left")
    levels = levels.select("run_id", F.coalesce("_winners", "_all").alias("stop_level"), "target_level")
    return levels.withColumn("risk_reward", F.when(F.col("stop_level") == 0, F.lit(float("inf"))).otherwise(F.abs(F.try_divide("target_level", "stop_level"))))


def enrich_trades_with_signals(trades: DataFrame, signals: DataFrame, columns: list[str], asset: str | None = "asset", trades_asset: str = "symbol", seconds: int | None = 365 * 86400) -> DataFrame:
    """Signal columns as of entry and exit (entry_x, exit_x); trades are kept, unmatched ones get nulls. An asset's history is split by time buckets."""
    if not columns:
        return trades
    if trades_asset not in trades.columns or (asset is not None and asset not in signals.columns):
        raise ValueError("no such asset column")
    left, right = trades.withColumn("_a", F.col(trades_asset) if asset else F.lit("")), signals.withColumn("_a", F.col(asset) if asset else F.lit(""))
    once = asof_join(left, right, ["_a"], "entry_time", "timestamp", columns, "entry_", seconds)
    return asof_join(once, right, ["_a"], "exit_time", "timestamp", columns, "exit_", seconds).drop("_a")


def asset_trading_stats(events: DataFrame, window: int = 50) -> DataFrame:
    """Per symbol in time order: totals so far, the last ``window`` events, and the session so far (column session_date)."""
    order = ["exit_time", "trade_id"]
    run = W.partitionBy("symbol").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    last = W.partitionBy("symbol").orderBy(*order).rowsBetween(-(window - 1), 0)
    session = W.partitionBy("symbol", "session_date").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    win = (F.col("pnl") > 0).cast("double")
    out = {}
    for name, frame in (("total", run), ("recent", last), ("session", session)):
        out |= {f"{name}_pnl": F.sum("pnl").over(frame), f"{name}_trades": F.count("*").over(frame), f"{name}_win_rate": F.avg(win).over(frame), f"{name}_avg": F.avg("pnl").over(frame)}
    return events.withColumns(out)


def last_trades(trades: DataFrame, n: int, per_symbol: bool = False) -> DataFrame:
    if not per_symbol:
        return trades.orderBy(F.desc("exit_time"), "trade_id", "pnl").limit(n)
    rank = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("exit_time"), "trade_id", "pnl"))
    return trades.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def trade_records(trades: DataFrame) -> DataFrame:
    seconds = F.unix_timestamp(F.col("exit_time").cast("timestamp")) - F.unix_timestamp(F.col("entry_time").cast("timestamp"))
    return trades.select(F.col("exit_time").alias("timestamp"), F.col("entry_time").alias("entry_timestamp"), "trade_id", "symbol", "direction", "entry_price", "exit_price", "quantity", "pnl", "fees", seconds.alias("duration_s"))


def fill_cost_totals(fills: DataFrame) -> DataFrame:
    return fills.groupBy("run_id").agg(F.sum("commission").alias("total_commission"), F.sum("slippage").alias("total_slippage"))


def mae_mfe_distribution(trades: DataFrame, width: float) -> DataFrame:
    """Counts of excursions in bins of a fixed width."""
    stacked = trades.select(F.explode(F.array(F.struct(F.lit("mfe").alias("kind"), F.col("mfe").alias("v")), F.struct(F.lit("mae").alias("kind"), F.col("mae").alias("v")))).alias("x"))
    return stacked.groupBy("x.kind", F.floor(F.col("x.v") / width).alias("bin")).agg(F.count("*").alias("n"))
