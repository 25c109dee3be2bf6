"""Positions, cash, equity, trades and margin from fills; rebalancing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeloom.operators import towers
from tapeloom.operators.joins import MONTH, asof_join, blocked_sum, bucket, scanned

FILL_ORDER = ("timestamp", "order_id", "price")


def signed_quantity() -> Column:
    return F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))


def running_positions(fills: DataFrame) -> DataFrame:
    """Signed position after each fill and the kind of event."""
    run = W.partitionBy("run_id", "asset").orderBy(*FILL_ORDER)
    total = F.sum("signed").over(run.rowsBetween(W.unboundedPreceding, 0))
    out = fills.withColumn("signed", signed_quantity()).withColumn("position", F.when(F.abs(total) < 1e-12, F.lit(0.0)).otherwise(total))
    before = F.coalesce(F.lag("position").over(run), F.lit(0.0))
    kind = (
        F.when(before == 0, "open").when(F.col("position") == 0, "close").when(before * F.col("position") < 0, "flip")
        .when(F.abs("position") > F.abs(before), "scale_up").otherwise("scale_down")
    )
    return out.withColumns({"before": before, "event": kind})


def episodes(fills: DataFrame) -> DataFrame:
    """Fills cut at zero crossings: a flip becomes a closing and an opening part, costs in proportion; ``episode`` numbers them, ``n`` the parts."""
    ran = running_positions(fills)
    part = lambda share, what, signed, before: F.struct(F.lit(what).alias("part"), signed.alias("signed"), before.alias("before"), (F.col("commission") * share).alias("commission"), (F.col("slippage") * share).alias("slippage"))
    one, before = F.lit(1.0), F.col("before")
    close_share = F.abs("before") / F.abs("signed")
    parts = F.when(F.col("event") == "flip", F.array(part(close_share, 0, -before, before), part(1 - close_share, 1, F.col("position"), F.lit(0.0)))).otherwise(F.array(part(one, 0, F.col("signed"), before)))
    cut = ran.withColumn("p", F.explode(parts)).select("run_id", "asset", "timestamp", "order_id", "price", "event", F.col("p.*"))
    opens = (F.col("event") == "open") | ((F.col("event") == "flip") & (F.col("part") == 1))
    order = W.partitionBy("run_id", "asset").orderBy(*FILL_ORDER, "part")
    return cut.withColumns({"episode": F.sum(opens.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)), "n": F.row_number().over(order)})


def _entry_map(fill: Column, so_far: Column) -> Column:
    """The entry price after one more fill as an affine map, a * entry + b, of the one before the block."""
    size, h = F.abs(fill["signed"]), F.abs(fill["before"])
    grows = fill["before"] * fill["signed"] >= 0
    return F.struct(
        F.when(grows, so_far["a"] * h / (h + size)).otherwise(so_far["a"]).alias("a"), F.when(grows, (so_far["b"] * h + fill["price"] * size) / (h + size)).otherwise(so_far["b"]).alias("b"),
        F.when(grows, so_far["fee"] + fill["commission"]).otherwise(so_far["fee"]).alias("fee"),
    )


def _folded(fill: Column, so_far: Column) -> Column:
    """The state of an episode after one more fill."""
    f, o = fill, so_far
    size, held = F.abs(f["signed"]), o["held"]
    grows = held * f["signed"] >= 0
    closes = ~grows & (F.abs(held + f["signed"]) < 1e-12)
    side = F.signum(held)
    share = f["price"] - o["entry"]
    return F.struct(
        F.when(grows, (o["entry"] * F.abs(held) + f["price"] * size) / (F.abs(held) + size)).otherwise(o["entry"]).alias("entry"),
        F.when(closes, F.lit(0.0)).otherwise(held + f["signed"]).alias("held"),
        F.when(grows & (o["first"] == 0), size).otherwise(o["first"]).alias("first"),
        F.when(grows, o["entry_fee"] + f["commission"]).otherwise(o["entry_fee"]).alias("entry_fee"),
        F.when(~grows & ~closes, o["partial"] + side * share * size - o["entry_fee"] * size / o["first"] - f["commission"]).otherwise(o["partial"]).alias("partial"),
        F.when(~grows & ~closes, o["n_partial"] + 1).otherwise(o["n_partial"]).alias("n_partial"),
        F.when(closes, f["price"]).otherwise(o["exit_price"]).alias("exit_price"), F.when(closes, f["timestamp"]).otherwise(o["exit_time"]).alias("exit_time"),
        F.when(closes, f["commission"]).otherwise(o["exit_fee"]).alias("exit_fee"), F.when(closes, held).otherwise(o["last"]).alias("last"),
    )


#: Fills of an episode that are folded at once.
FOLD = 4096


def fills_to_trades(fills: DataFrame, size: int = FOLD) -> DataFrame:
    """Average-cost round trips: one row per episode, closed or still open, with its partial exits summed.

    Episodes are dealt out in blocks of at most ``size`` fills, so one that never crosses zero is many rows: what a block does to the entry
    price is an affine map (quantities held are prefix sums) and what it adds to the entry fee a sum; the maps of the blocks before give a
    block's start, from which its fills are folded in the JVM. A partial exit's pnl carries its share of the entry commission; the
    closing trade covers what is left and the whole entry commission.
    """
    fill = F.struct(*FILL_ORDER, "part", "signed", "before", "commission")
    blocks = episodes(fills).withColumn("block", F.floor(F.col("n") / size)).groupBy("run_id", "asset", "episode", "block").agg(F.array_sort(F.collect_list(fill)).alias("fills"))
    zero, none = F.lit(0.0), F.lit(None)
    start = F.struct(F.lit(1.0).alias("a"), zero.alias("b"), zero.alias("fee"))
    blocks = blocks.withColumn("does", F.aggregate("fills", start, lambda so_far, fill: _entry_map(fill, so_far)))
    one = W.partitionBy("run_id", "asset", "episode").orderBy("block")
    before = F.collect_list("does").over(one.rowsBetween(W.unboundedPreceding, -1))  # a map a block
    enter = F.aggregate("_b", F.struct(zero.alias("entry"), zero.alias("fee")), lambda s, m: F.struct((m["a"] * s["entry"] + m["b"]).alias("entry"), (s["fee"] + m["fee"]).alias("fee")))
    blocks = blocks.withColumns({"_b": before, "_first": F.first(F.abs(F.col("fills")[0]["signed"])).over(one.rowsBetween(W.unboundedPreceding, 0))}).withColumn("_in", enter)
    state = F.struct(
        F.col("_in.entry").alias("entry"), F.col("fills")[0]["before"].alias("held"), F.when(F.size("_b") > 0, F.col("_first")).otherwise(zero).alias("first"), F.col("_in.fee").alias("entry_fee"), zero.alias("partial"),
        F.lit(0).alias("n_partial"), none.cast("double").alias("exit_price"), none.cast("timestamp_ntz").alias("exit_time"), zero.alias("exit_fee"), zero.alias("last"),
    )
    ended = blocks.withColumn("end", F.aggregate("fills", state, lambda so_far, fill: _folded(fill, so_far)))
    out = ended.groupBy("run_id", "asset", "episode").agg(
        F.max_by("end", "block").alias("end"), F.sum("end.partial").alias("partial_pnl"), F.sum("end.n_partial").cast("int").alias("n_partial"), F.min_by(F.col("fills")[0]["timestamp"], "block").alias("entry_time"),
        F.max_by(F.element_at("fills", -1), "block").alias("_last"),
    )
    end, closed = (lambda c: F.col(f"end.{c}")), F.col("end.exit_price").isNotNull()
    fees = end("entry_fee") + end("exit_fee")
    return out.select(
        "run_id", "asset", F.col("episode").cast("int").alias("episode"), "entry_time", end("exit_time").alias("exit_time"), end("entry").alias("entry_price"), end("exit_price").alias("exit_price"),
        F.when(closed, end("last")).otherwise(end("held")).alias("quantity"), F.when(closed, (end("exit_price") - end("entry")) * end("last") - fees).alias("pnl"), fees.alias("fees"),
        "n_partial", "partial_pnl", (~closed).alias("is_open"), F.struct(*(F.col(f"_last.{c}").alias(c) for c in FILL_ORDER)).alias("last_fill"),
    )


def cash_ledger(changes: DataFrame, initial: float, seconds: int = MONTH) -> DataFrame:
    """Cash of each run after each timestamp; runs are summed in time buckets, so none is one task."""
    per_time = changes.groupBy("run_id", "timestamp").agg(F.sum("cash_change").alias("change"))
    return blocked_sum(per_time, ["run_id"], bucket(F.col("timestamp"), seconds), ["timestamp"], "change", "cash").withColumn("cash", F.col("cash") + initial)


def mark_to_market(fills: DataFrame, bars: DataFrame, initial: float, seconds: int = 3 * MONTH) -> DataFrame:
    """Equity of each run at each bar time: cash and positions at the last price seen. Assets and runs are split by time buckets."""
    ran = running_positions(fills)
    held = ran.groupBy("run_id", "asset", "timestamp").agg(F.max_by("position", F.struct("order_id", "price")).alias("position"))
    owned = ran.select("run_id", "asset").distinct()
    priced = owned.join(bars.select("asset", "timestamp", "close"), "asset")
    marked = asof_join(priced, held, ["run_id", "asset"], "timestamp", "timestamp", ["position"], seconds=seconds)
    # an asset without a bar keeps its last value: changes of value are summed over time
    value = F.coalesce(F.col("position") * F.col("close"), F.lit(0.0))
    change = marked.withColumn("value", value).withColumn("d", F.col("value") - F.coalesce(F.lag("value").over(W.partitionBy("run_id", "asset").orderBy("timestamp")), F.lit(0.0)))
    per_time = change.groupBy("run_id", "timestamp").agg(F.sum("d").alias("d"))
    worth = blocked_sum(per_time, ["run_id"], bucket(F.col("timestamp"), seconds), ["timestamp"], "d", "worth")
    cash = cash_ledger(ran.withColumn("cash_change", -F.col("signed") * F.col("price") - F.col("commission")), initial, seconds)
    out = asof_join(worth.select("run_id", "timestamp", "worth"), cash, ["run_id"], "timestamp", "timestamp", ["cash"], seconds=seconds)
    return out.select("run_id", "timestamp", (F.coalesce("cash", F.lit(initial)) + F.col("worth")).alias("equity"))


def open_trades(trades: DataFrame, bars: DataFrame | None = None, reason: str = "still_open") -> DataFrame:
    """Positions left at the end, marked at the last price; without bars at that of the asset's last fill in any run, out of the trades themselves."""
    if bars is None:
        last_fill = F.max("last_fill").over(W.partitionBy("asset"))  # rows are round trips, not fills
        marked = trades.withColumn("_last", last_fill).filter("is_open").withColumns({"exit_time": F.col("_last.timestamp"), "exit_price": F.col("_last.price")}).drop("_last", "last_fill")
        return _left(marked, reason)
    last = bars.groupBy("asset").agg(F.max("timestamp").alias("exit_time"), F.max_by("close", "timestamp").alias("exit_price"))
    left = trades.filter("is_open").drop("exit_time", "exit_price", "pnl").join(last, "asset")
    return _left(left, reason)


def _left(left: DataFrame, reason: str) -> DataFrame:
    return left.withColumns({"pnl": (F.col("exit_price") - F.col("entry_price")) * F.col("quantity") - F.col("fees"), "exit_reason": F.lit(reason), "status": F.lit("open"), "slippage": F.lit(0.0)})


def bars_held(trades: DataFrame, stamps: DataFrame) -> DataFrame:
    """Feed timestamps with entry < t <= exit, from the numbers of both stamps."""
    days = stamps.select("timestamp", "bar")
    begin = trades.join(days.withColumnRenamed("bar", "_a"), F.col("entry_time") == F.col("timestamp"), "left").drop("timestamp")
    both = begin.join(days.withColumnRenamed("bar", "_b"), F.col("exit_time") == F.col("timestamp"), "left").drop("timestamp")
    return both.withColumn("bars_held", F.col("_b") - F.col("_a")).drop("_a", "_b")


def mfe_mae(trades: DataFrame, bars: DataFrame, seconds: int, extremes: bool = False, quotient: Callable[[Column, Column], Column] = F.try_divide) -> DataFrame:
    """Best and worst direction-aware return over bars from entry to before exit; the entry bar by its close.

    Range extremes from a tower of blocks: a trade meets a few rows however long it is held. On an entry price of 0 both are 0, or what
    ``quotient`` (such as ``joins.ieee``) makes of it."""
    there = towers.tower(bars, seconds, *(("high", "low") if extremes else ("close", "close")))
    spans = trades.select("trade_id", "asset", F.col("entry_time").alias("start"), (F.col("exit_time") - F.expr("interval 1 microsecond")).alias("end"))
    found = towers.range_extremes(spans, there, seconds, "trade_id", "close")
    side = F.signum("quantity")
    ends = [side * (quotient(F.col(x), F.col("entry_price")) - 1) for x in ("highest", "lowest", "entry_price")]  # of the last one 0, or what 0 / 0 gives
    out = trades.join(found, "trade_id", "left")
    return out.withColumns({"mfe": F.greatest(*ends, F.lit(0.0)), "mae": F.least(*ends, F.lit(0.0))}).drop("highest", "lowest")


def settlement_holds(proceeds: DataFrame, delay: int) -> DataFrame:
    """Sale proceeds (run_id, bar, proceeds) not yet settled at each bar."""
    frame = W.partitionBy("run_id").orderBy("bar").rangeBetween(-(delay - 1), 0)
    return proceeds.withColumn("unsettled", F.sum("proceeds").over(frame))


def spendable_cash(cash: Column, short_basis: Column, policy: str = "credit") -> Column:
    """Cash for new entries of an account without leverage: all (credit), less the cost basis of shorts (credit_proceeds), or less twice that (lock_notional)."""
    return cash - {"credit": 0.0, "credit_proceeds": 1.0, "lock_notional": 2.0}[policy] * short_basis


def account_snapshot(positions: DataFrame, cash: DataFrame, rate: float, long_rate: float, short_rate: float, contracts: DataFrame | None = None, policy: str | None = None) -> DataFrame:
    """Net value, margins, cost basis of shorts, buying power and margin call of each run and time.

    positions: run_id, timestamp, asset, value (signed), and for contracts and shorts quantity, entry_price and multiplier (1 if absent).
    contracts: asset and its fixed initial and maintenance margin for one contract, instead of rates. With a short policy the account
    has no leverage: its buying power is its spendable cash."""
    v = F.col("value")
    for name, default in (("quantity", v), ("entry_price", F.lit(1.0)), ("multiplier", F.lit(1.0))):
        if name not in positions.columns:
            positions = positions.withColumn(name, default)
    initial, maintenance = F.abs(v) * rate, F.when(v > 0, v * long_rate).otherwise(-v * short_rate)
    if contracts is not None:
        fixed = contracts.select("asset", F.col("initial").alias("_initial"), F.col("maintenance").alias("_maintenance"))
        positions = positions.join(fixed, "asset", "left")
        initial, maintenance = F.coalesce(F.abs("quantity") * F.col("_initial"), initial), F.coalesce(F.abs("quantity") * F.col("_maintenance"), maintenance)
    basis = F.when(F.col("quantity") < 0, F.abs("quantity") * F.col("entry_price") * F.col("multiplier")).otherwise(0.0)
    sums = positions.groupBy("run_id", "timestamp").agg(F.sum(v).alias("net"), F.sum(initial).alias("initial_margin"), F.sum(maintenance).alias("maintenance_margin"), F.sum(basis).alias("short_basis"))
    out = sums.join(cash, ["run_id", "timestamp"]).withColumn("nlv", F.col("cash") + F.col("net"))
    power = (F.col("nlv") - F.col("initial_margin")) / rate if policy is None else spendable_cash(F.col("cash"), F.col("short_basis"), policy)
    return out.withColumns({"buying_power": F.greatest(F.lit(0.0), power), "margin_call": F.col("nlv") < F.col("maintenance_margin")})


def current_weights(positions: DataFrame, equity: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """Value over equity of each asset; none where equity is not above 0.

    pending: open orders (asset, side, quantity, limit_price, close, multiplier if any), whose value at their limit price, else at the close,
    counts as if they were filled."""
    if pending is not None:
        price = F.coalesce(F.when(F.col("limit_price") != 0, F.col("limit_price")), F.col("close"))
        size = F.col("quantity") * price * (F.col("multiplier") if "multiplier" in pending.columns else F.lit(1.0))
        more = pending.filter(price > 0).select("run_id", "timestamp", "asset", F.when(F.col("side") == "buy", size).otherwise(-size).alias("value"))
        positions = positions.select("run_id", "timestamp", "asset", "value").unionByName(more).groupBy("run_id", "timestamp", "asset").agg(F.sum("value").alias("value"))
    return positions.join(equity, ["run_id", "timestamp"]).filter("equity > 0").withColumn("weight", F.col("value") / F.col("equity"))


def rebalance_preview(current: DataFrame, target: DataFrame, equity: float, min_weight: float, min_value: float, price: Column, keys: list[str]) -> DataFrame:
    """Current against target weight: changes, and why a trade would be left out."""
    both = current.join(target, keys, "full_outer").fillna(0.0, ["weight", "target"])
    out = both.withColumn("delta", F.col("target") - F.col("weight")).withColumns({"value": F.col("delta") * equity, "shares": F.col("delta") * equity / price})
    skip = F.when(F.abs("delta") < min_weight, "weight_change_too_small").when(F.abs("value") < min_value, "trade_value_too_small").when(F.abs("shares") < 1, "rounds_to_zero_shares")
    return out.withColumns({"skip_reason": skip, "close_position": (F.col("target") == 0) & (F.col("weight") != 0)})


def rebalance_orders(current: DataFrame, target: DataFrame, equity: float, max_gross: float, max_single: float, min_value: float, price: Column, keys: list[str], shorts: bool = True, lots: bool = True) -> DataFrame:
    """Orders to scaled and clamped targets: reductions, closings, then increases."""
    gross = F.sum(F.abs("target")).over(W.partitionBy(*[k for k in keys if k != "asset"]))
    scaled = target.withColumn("target", F.col("target") * F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(max_gross), gross), F.lit(1.0))))
    clamped = F.greatest(F.least("target", F.lit(max_single)), F.lit(-max_single if shorts else 0.0))
    both = current.join(scaled.withColumn("target", clamped), keys, "full_outer").fillna(0.0, ["weight", "target"])
    raw = (F.col("target") - F.col("weight")) * equity / price
    out = both.withColumn("shares", F.bround(raw, 0) if lots else raw.cast("bigint").cast("double"))
    out = out.filter((F.abs(F.col("shares") * price) >= min_value) & (F.col("shares") != 0))
    phase = F.when((F.col("target") == 0) & (F.col("weight") != 0), 2).when(F.abs("target") < F.abs("weight"), 1).otherwise(3)
    return out.withColumns({"phase": phase, "side": F.when(F.col("shares") > 0, "buy").otherwise("sell")})


def orders_to_target_value(current: DataFrame, equity: float, headroom: float, keys: list[str]) -> DataFrame:
    """Change of value to weight x headroom x equity; less than a cent is left out; sells first."""
    delta = F.col("target") * headroom * equity - F.col("weight") * equity
    out = current.withColumn("delta_value", delta).filter(F.abs("delta_value") >= 0.01)
    return out.withColumn("sequence", F.row_number().over(W.partitionBy(*[k for k in keys if k != "asset"]).orderBy(F.col("delta_value") > 0, "asset")))


def target_orders(
    positions: DataFrame, targets: DataFrame, bars: DataFrame, equity: DataFrame, keys: Sequence[str] = ("timestamp",), headroom: float = 1.0, policy: str = "skip",
    min_bars: int = 0, close_untargeted: bool = True, multipliers: DataFrame | None = None, seconds: int = 12 * MONTH,
) -> DataFrame:
    """Market orders that bring positions (keys, asset, quantity) to targets (keys, asset, and weight of equity or value).

    bars: asset, timestamp, close (null or not above 0: no price). Policy skip wants a price at the orders' own time, use_last takes the last one. An asset with fewer than
    min_bars priced bars so far gets no new target. Weights are scaled by headroom and need equity (keys, equity) above 0; values, of one asset or many, are taken as they are.
    Held assets without a target are closed (close_untargeted). Changes of less than a cent are left out; sells come first, those of untargeted assets last among them."""
    by_weight, by = "weight" in targets.columns, [*keys, "asset"]
    wanted = targets.select(*by, F.col("weight" if by_weight else "value").alias("_target"), F.lit(True).alias("_asked"))
    held = positions.filter("quantity != 0").select(*by, "quantity")
    both = wanted.join(held, by, "full_outer" if close_untargeted else "left").fillna(0.0, ["_target", "quantity"]).fillna(False, ["_asked"])
    if by_weight:
        both = both.join(equity.select(*keys, "equity").filter("equity > 0"), list(keys)).withColumn("_target", F.col("_target") * headroom * F.col("equity"))
    priced = scanned(bars.filter("close > 0").select("asset", "timestamp", "close"), ["asset"], bucket(F.col("timestamp"), seconds), ["timestamp"], _seen=("count", F.col("close")))
    both = asof_join(both, priced.withColumn("_at", F.col("timestamp")), ["asset"], "timestamp", "timestamp", ["close", "_seen", "_at"], seconds=seconds)
    fresh = F.lit(True) if policy == "use_last" else F.col("_at") == F.col("timestamp")
    both = both.filter(F.col("close").isNotNull() & fresh & (~F.col("_asked") | (F.col("_seen") >= min_bars)))
    unit = F.col("close")
    if multipliers is not None:
        both = both.join(multipliers.select("asset", F.col("multiplier").alias("_m")), "asset", "left")
        unit = unit * F.coalesce("_m", F.lit(1.0))
    out = both.withColumn("delta_value", F.col("_target") - F.col("quantity") * unit).filter(F.abs("delta_value") >= 0.01)
    order = W.partitionBy(*keys).orderBy(F.col("delta_value") > 0, ~F.col("_asked"), "asset")
    return out.select(*by, F.when(F.col("delta_value") > 0, "buy").otherwise("sell").alias("side"), (F.abs("delta_value") / unit).alias("quantity"), F.col("close").alias("price"), "delta_value", F.row_number().over(order).alias("sequence"))
