"""Cross-sectional signals, ranks, targets and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeloom.operators.joins import MONTH, bucket, ieee, scanned


def by_asset():
    return W.partitionBy("asset").orderBy("timestamp")


def momentum(bars: DataFrame, lookback: int) -> DataFrame:
    """close against the close lookback - 1 priced bars back, with enter (> 5 %) and exit (< -2 %) flags."""
    value = F.col("close") / F.lag("close", lookback - 1).over(by_asset()) - 1
    return bars.filter("close > 0").withColumn("momentum", value).withColumns({"enter": F.coalesce(F.col("momentum") > 0.05, F.lit(False)), "exit": F.coalesce(F.col("momentum") < -0.02, F.lit(False))})


def _z(value: Column, mean: Column, deviation: Column, count: Column, need: int) -> Column:
    return F.when((count >= need) & (deviation > 0), (value - mean) / deviation)


def zscore(bars: DataFrame, lookback: int) -> DataFrame:
    """close against mean and sample deviation of the lookback - 1 bars before it."""
    frame = by_asset().rowsBetween(-(lookback - 1), -1)
    z = _z(F.col("close"), F.avg("close").over(frame), F.stddev_samp("close").over(frame), F.count("close").over(frame), lookback - 1)
    return bars.filter("close > 0").withColumn("z", z).withColumns({"enter": F.coalesce(F.col("z") < -2, F.lit(False)), "exit": F.coalesce(F.col("z") > 0, F.lit(False))})


def pair_zscore(bars: DataFrame, a: str, b: str, lookback: int) -> DataFrame:
    """z of the ratio b / a in the trailing window, the current bar included."""
    one = bars.filter((F.col("asset") == a) & (F.col("close") > 0)).select("timestamp", F.col("close").alias("a"))
    two = bars.filter((F.col("asset") == b) & (F.col("close") > 0)).select("timestamp", F.col("close").alias("b"))
    ratio = one.join(two, "timestamp").select("timestamp", F.lit(f"{a}/{b}").alias("pair"), (F.col("b") / F.col("a")).alias("ratio"))
    frame = W.partitionBy("pair").orderBy("timestamp").rowsBetween(-(lookback - 1), 0)
    return ratio.withColumn("z", _z(F.col("ratio"), F.avg("ratio").over(frame), F.stddev_samp("ratio").over(frame), F.count("ratio").over(frame), lookback))


def signal_flags(df: DataFrame, column: str, long_above: float, short_below: float) -> DataFrame:
    s = F.coalesce(F.col(column), F.lit(0.0))
    return df.withColumns({"should_enter_long": s > long_above, "should_enter_short": s < short_below, "should_exit": (s <= long_above) & (s >= short_below)})


def rank_long_short(signals: DataFrame, column: str, n_long: int, n_short: int) -> DataFrame:
    """Top n_long and bottom n_short per timestamp, never both; ties by asset."""
    here = W.partitionBy("timestamp")
    ranked = signals.filter(F.col(column).isNotNull()).withColumns({"_d": F.row_number().over(here.orderBy(F.desc(column), "asset")), "_u": F.row_number().over(here.orderBy(column, F.desc("asset")))})
    side = F.when(F.col("_d") <= n_long, "long").when(F.col("_u") <= n_short, "short")
    return ranked.withColumn("side", side).filter("side is not null").drop("_d", "_u")


def rebalance_bars(bars: DataFrame, stamps: DataFrame, freq: int) -> DataFrame:
    """Bars whose number (stamps: timestamp, bar) is 1, 1 + freq, ...; every bar for freq 1."""
    chosen = stamps.filter((F.col("bar") - 1) % freq == 0).select("timestamp")
    return bars.join(chosen, "timestamp", "left_semi")


def canonical_target_shares(filled: DataFrame, top_n: int, bottom_n: int, long: float = 100.0, short: float = -100.0) -> DataFrame:
    """Long the top_n, short the bottom_n (which wins) of each timestamp, else 0."""
    here = W.partitionBy("timestamp")
    rank = F.row_number().over(here.orderBy(F.desc("score"), "asset"))
    n = F.count("*").over(here)
    return filled.withColumn("target", F.when(rank > n - bottom_n, F.lit(short)).when(rank <= top_n, F.lit(long)).otherwise(F.lit(0.0)))


def target_trace(targets: DataFrame) -> DataFrame:
    """Changes of each asset's target."""
    prev = F.lag("target", 1, 0.0).over(by_asset())
    out = targets.select("timestamp", "asset", prev.alias("prev"), "target").withColumn("delta", F.col("target") - F.col("prev")).filter("delta != 0")
    action = F.when(F.col("prev") == 0, "open").when(F.col("target") == 0, "close").when(F.col("prev") * F.col("target") < 0, "flip").otherwise("resize")
    return out.withColumn("action", action)


def normalize_weights(signals: DataFrame, column: str) -> DataFrame:
    positive = signals.filter(F.col(column) > 0)
    return positive.withColumn("weight", F.col(column) / F.sum(column).over(W.partitionBy("timestamp")))


def position_size(equity: Column, fraction: float, price: Column, integer: bool = True, free: float | None = None) -> Column:
    """Shares for a fraction of equity; null where none can be bought, ``free`` at a price of 0 (but not at -0.0). Quotients of 2**53 and more are whole as they are."""
    shares = F.try_divide(equity * fraction, price)
    shares = F.when(F.abs(shares) < 2.0**53, shares.cast("bigint").cast("double")).otherwise(shares) if integer else shares
    bought = F.when(shares > 0, shares)
    return bought if free is None else F.when((price == 0) & (equity * fraction > 0) & (ieee(equity * fraction, price) > 0), F.lit(free)).otherwise(bought)


def kelly_fraction(trades: DataFrame, min_trades: int, base: float = 0.1, window: int = 50) -> DataFrame:
    """Half Kelly from each symbol's earlier trades, within [0.02, 0.25]."""
    frame = W.partitionBy("symbol").orderBy("exit_time", "trade_id").rowsBetween(-window, -1)
    win, loss = F.col("pnl") > 0, F.col("pnl") <= 0
    stats = trades.withColumns({
        "_n": F.count("pnl").over(frame), "_w": F.avg(win.cast("double")).over(frame),
        "_win": F.avg(F.when(win, F.col("pnl"))).over(frame), "_loss": F.avg(F.when(loss, F.abs("pnl"))).over(frame),
    })
    ratio = F.try_divide(F.col("_win"), F.col("_loss"))
    f = F.greatest(F.lit(0.0), F.col("_w") - F.try_divide(1 - F.col("_w"), ratio)) * 0.5
    size = F.when((F.col("_n") < min_trades) | F.col("_win").isNull() | F.col("_loss").isNull(), F.lit(base)).when(F.col("_loss") == 0, F.lit(0.25)).otherwise(F.least(F.greatest(f, F.lit(0.02)), F.lit(0.25)))
    return stats.withColumn("size", size).drop("_n", "_w", "_win", "_loss")


def drawdown_sizing(curve: DataFrame, seconds: int = MONTH) -> DataFrame:
    """Scale of sizes by drawdown: 0 from 10 %, falling from 0.5 between 5 and 10 %, else recovering by 0.01 a bar up to 1.

    Curves are scanned in time buckets: first the running maximum and bar number, then the last bar that set the scale."""
    block = bucket(F.col("timestamp"), seconds)
    out = scanned(curve, ["run_id"], block, ["timestamp"], _most=("max", F.col("equity")), _i=("count", F.lit(1)))
    dd = F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("equity"), F.col("_most")))
    out = out.withColumn("dd", F.coalesce(dd, F.lit(0.0))).drop("_most")
    set_ = F.when(F.col("dd") >= 0.10, F.lit(0.0)).when(F.col("dd") >= 0.05, 0.5 * (0.10 - F.col("dd")) / 0.05)
    out = scanned(out, ["run_id"], block, ["timestamp"], _a=("last", F.when(set_.isNotNull(), F.struct(set_.alias("s"), "_i"))))
    return out.withColumn("scale", F.when(F.col("_a").isNull(), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("_a.s") + 0.01 * (F.col("_i") - F.col("_a._i"))))).drop("_i", "_a")


def signals_to_round_trips(bars: DataFrame, direction: str, quantity: float, commission: float, slippage: float, next_bar: bool = True) -> DataFrame:
    """Entries only when flat, exits only when holding (columns enter, exit); filled at the close or the next bar's open.

    When flat, entry alone counts, when holding, exit alone: a bar with entry only sets the position, one with exit only clears it, and
    one with both turns it over. So the state after a bar is that of the last bar with one flag, turned over once for each with both since.
    """
    sign = 1.0 if direction == "long" else -1.0
    price, at = (F.lead("open").over(by_asset()), F.lead("timestamp").over(by_asset())) if next_bar else (F.col("close"), F.col("timestamp"))
    enter, leave = (F.coalesce(F.col(c), F.lit(False)) for c in ("enter", "exit"))
    acts = bars.withColumns({"_p": price, "_t": at, "_on": enter, "_both": enter & leave}).filter(((F.col("_on")) | leave) & F.col("_p").isNotNull())
    upto = by_asset().rowsBetween(W.unboundedPreceding, 0)
    acts = acts.withColumn("_turns", F.sum(F.col("_both").cast("int")).over(upto))
    acts = acts.withColumn("_set", F.last(F.when(~F.col("_both"), F.struct("_on", "_turns")), ignorenulls=True).over(upto))
    odd = (F.col("_turns") - F.coalesce(F.col("_set._turns"), F.lit(0))) % 2 == 1
    acts = acts.withColumn("_held", F.coalesce(F.col("_set._on"), F.lit(False)) != odd)
    acts = acts.withColumn("_before", F.coalesce(F.lag("_held").over(by_asset()), F.lit(False))).filter("_held != _before").withColumn("_a", F.when(F.col("_held"), "in").otherwise("out"))
    legs = acts.withColumns({"_xp": F.lead("_p").over(by_asset()), "_xt": F.lead("_t").over(by_asset())}).filter("_a = 'in' and _xp is not null")
    entry, exit_ = F.col("_p") * (1 + sign * slippage), F.col("_xp") * (1 - sign * slippage)
    out = legs.select("asset", F.col("_t").alias("entry_time"), F.col("_xt").alias("exit_time"), entry.alias("entry_price"), exit_.alias("exit_price"), F.lit(sign * quantity).alias("quantity"))
    out = out.withColumns({"gross_pnl": (F.col("exit_price") - F.col("entry_price")) * F.col("quantity"), "fees": (F.col("entry_price") + F.col("exit_price")) * quantity * commission})
    return out.withColumns({"net_pnl": F.col("gross_pnl") - F.col("fees"), "pnl_percent": sign * (F.col("exit_price") / F.col("entry_price") - 1), "net_return": F.expr("(gross_pnl - fees) / (entry_price * abs(quantity))")})
