"""Exit rules over open positions: position x bar panel, rule columns, first exit, fill price, parameter sweep.

A rule is a function from the panel's columns to a struct (reason, price) or null.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeloom.operators import towers
from tapeloom.operators.joins import ieee, interval_join
from tapeloom.sources.results import stored


def by_position():
    return W.partitionBy("position_id").orderBy("timestamp")


def position_bar_panel(entries: DataFrame, bars: DataFrame, seconds: int, extremes: bool = True, mark: str = "fill_price") -> DataFrame:
    """Entries (position_id, asset, side, entry_time, entry_price, until) x bars after entry, with marks through the previous bar.

    Returns on an entry price of 0 are infinite or NaN. sign is whole, so that decimal shares stay exact up to their product with a price."""
    columns = [c for c in bars.columns if c != "asset"]
    seen = interval_join(entries, bars.select("asset", *columns), ["asset"], "entry_time", "until", "timestamp", seconds)
    sign = F.when(F.col("side") == "long", 1).otherwise(-1)
    at_entry = F.col("timestamp") == F.col("entry_time")
    start = F.col("entry_price") if mark == "fill_price" else F.col("close")
    up = F.when(at_entry, F.greatest(start, "close")).otherwise(F.col("high") if extremes else F.col("close"))
    down = F.when(at_entry, F.least(start, "close")).otherwise(F.col("low") if extremes else F.col("close"))
    before = by_position().rowsBetween(W.unboundedPreceding, -1)
    out = seen.withColumns({"sign": sign, "_u": up, "_d": down, "next_open": F.lead("open").over(by_position())})
    out = out.withColumns({"hwm": F.max("_u").over(before), "lwm": F.min("_d").over(before), "bars_held": F.row_number().over(by_position()) - 1})
    return out.filter("timestamp > entry_time").drop("_u", "_d").withColumn("ret", F.col("sign") * (ieee(F.col("close"), F.col("entry_price")) - 1))


def _hit(condition: Column, reason: str, price: Column | None = None) -> Column:
    price = F.lit(None).cast("double") if price is None else price.cast("double")
    return F.when(condition, F.struct(F.lit(reason).alias("reason"), price.alias("price")))


def _adverse(level: Column) -> Column:
    return F.when(F.col("sign") > 0, F.col("low") <= level).otherwise(F.col("high") >= level)


def stop_loss(pct: Column | float, base: str = "entry_price", fill: str = "stop_price") -> Column:
    """Level reached within the bar, or the close beyond it (bars whose low and high do not span their close, or are null)."""
    level = F.col(base) * (1 - F.col("sign") * pct)
    beyond = F.when(F.col("sign") > 0, F.col("close") <= level).otherwise(F.col("close") >= level)
    return _hit(F.coalesce(_adverse(level), F.lit(False)) | beyond, "stop_loss", stop_fill_price(level, "stop", fill))


def take_profit(pct: Column | float, base: str = "entry_price", fill: str = "stop_price") -> Column:
    level = F.col(base) * (1 + F.col("sign") * pct)
    reached = F.when(F.col("sign") > 0, F.col("high") >= level).otherwise(F.col("low") <= level)
    return _hit(reached, "take_profit", stop_fill_price(level, "target", fill))


def time_exit(n: Column | int) -> Column:
    return _hit(F.col("bars_held") >= n, "time_exit")


def trailing_level(pct: Column | float) -> Column:
    return F.when(F.col("sign") > 0, F.col("hwm") * (1 - pct)).otherwise(F.col("lwm") * (1 + pct))


def trailing_stop(pct: Column | float, timing: str = "lagged", fill: str = "stop_price") -> Column:
    """lagged: the mark through the previous bar; intrabar: with this bar's extremes; two_pass: lagged against the extremes, then the live mark against the close."""
    live = F.when(F.col("sign") > 0, F.greatest("hwm", "high") * (1 - pct)).otherwise(F.least("lwm", "low") * (1 + pct))
    level = live if timing == "intrabar" else trailing_level(pct)
    first = _hit(_adverse(level), "trailing_stop", stop_fill_price(level, "trailing", fill))
    if timing != "two_pass":
        return first
    beyond = F.when(F.col("sign") > 0, F.col("close") <= live).otherwise(F.col("close") >= live)
    return F.coalesce(first, _hit(beyond, "trailing_stop", F.col("close")))


def tightening_trail(schedule: list[tuple[float, float]]) -> Column:
    """Trail by the highest threshold the return has reached (else the lowest's); tested on the close."""
    steps = sorted(schedule)
    pct: Column = F.lit(steps[0][1])
    for threshold, value in steps:
        pct = F.when(F.col("ret") >= threshold, F.lit(value)).otherwise(pct)
    level = trailing_level(pct)
    return _hit(F.when(F.col("sign") > 0, F.col("close") <= level).otherwise(F.col("close") >= level), "tightening_trail")


def scaled_exits(panel: DataFrame, targets: list[tuple[float, float]]) -> DataFrame:
    """At most one target per bar, ascending: the bar each target is first met after the one before it, and the share of the entry quantity it exits."""
    out, left = None, 1.0
    last = panel.select("position_id").distinct().withColumn("_last", F.lit(None).cast("timestamp_ntz"))
    for i, (threshold, pct) in enumerate(sorted(targets)):
        open_ = panel.join(last, "position_id").filter((F.col("ret") >= threshold) & (F.col("_last").isNull() | (F.col("timestamp") > F.col("_last"))))
        hit = open_.groupBy("position_id").agg(F.min("timestamp").alias("timestamp"), F.min_by("close", "timestamp").alias("price"))
        part = hit.select("position_id", F.lit(i + 1).alias("target"), "timestamp", "price", F.lit(left * pct).alias("share"))
        out = part if out is None else out.unionByName(part)
        last = hit.select("position_id", F.col("timestamp").alias("_last"))
        left *= 1 - pct
    return out


def volatility_stop(mult: float, use_entry: bool = False) -> Column:
    """entry less mult ATR (column atr; or entry_atr, the first above 0 since entry); close test, fill at the level."""
    atr = F.col("entry_atr" if use_entry else "atr")
    level = F.col("entry_price") - F.col("sign") * mult * atr
    return _hit(F.coalesce(F.when(F.col("sign") > 0, F.col("close") <= level).otherwise(F.col("close") >= level), F.lit(False)), "volatility_stop", level)


def volatility_trail(mult: float) -> Column:
    level = F.when(F.col("sign") > 0, F.col("hwm") - mult * F.col("atr")).otherwise(F.col("lwm") + mult * F.col("atr"))
    return _hit(F.coalesce(F.when(F.col("sign") > 0, F.col("close") <= level).otherwise(F.col("close") >= level), F.lit(False)), "volatility_trail", level)


def with_entry_atr(panel: DataFrame) -> DataFrame:
    return panel.withColumn("entry_atr", F.first(F.when(F.col("atr") > 0, F.col("atr")), ignorenulls=True).over(by_position().rowsBetween(W.unboundedPreceding, 0)))


def signal_exit(column: str, threshold: float) -> Column:
    return _hit(F.coalesce(F.when(F.col("sign") > 0, F.col(column) < -threshold).otherwise(F.col(column) > threshold), F.lit(False)), "signal_exit")


def all_of(*rules: Column) -> Column:
    """All must trigger; reasons joined, no price."""
    met = rules[0].isNotNull()
    for r in rules[1:]:
        met = met & r.isNotNull()
    return F.when(met, F.struct(F.concat_ws(" AND ", *(r["reason"] for r in rules)).alias("reason"), F.lit(None).cast("double").alias("price")))


def first_exit(panel: DataFrame, *rules: Column) -> DataFrame:
    """First bar of each position on which a rule triggers, the first in order: exit_time, reason, price."""
    hit = panel.withColumn("_x", F.coalesce(*rules)).filter("_x is not null")
    return hit.groupBy("position_id").agg(F.min("timestamp").alias("exit_time"), F.min_by("_x", "timestamp").alias("_x")).select("position_id", "exit_time", "_x.reason", "_x.price")


def stop_fill_price(level: Column, kind: str, mode: str) -> Column:
    """Fill of a level: stop_price, close_price, bar_extreme or next_bar_open; trailing gaps fill at the open but for the last."""
    worse = F.when(F.col("sign") > 0, F.col("open") < level).otherwise(F.col("open") > level)
    better = F.when(F.col("sign") > 0, F.col("open") > level).otherwise(F.col("open") < level)
    gapped = better if kind == "target" else worse
    if mode == "next_bar_open":
        return F.col("next_open")
    if mode == "close_price":
        price = F.col("close")
    elif mode == "bar_extreme":
        good = F.when(F.col("sign") > 0, F.col("high")).otherwise(F.col("low"))
        bad = F.when(F.col("sign") > 0, F.col("low")).otherwise(F.col("high"))
        price = good if kind == "target" else bad
    else:
        return F.when(gapped, F.col("open")).when((F.col("low") <= level) & (level <= F.col("high")), level).otherwise(F.col("close"))
    return F.when(gapped, F.col("open")).otherwise(price) if kind == "trailing" else price


def _records(panel: DataFrame) -> Column:
    """Bars of a position that can be the first to touch some stop, target or trail: further out than all bars before them."""
    before = by_position().rowsBetween(W.unboundedPreceding, -1)
    long = F.col("sign") > 0
    worst = F.col("sign") * F.when(long, F.least("low", "close")).otherwise(F.greatest("high", "close"))
    best = F.col("sign") * F.when(long, F.col("high")).otherwise(F.col("low"))
    trailed = F.when(long, F.try_divide(F.col("low"), F.col("hwm"))).otherwise(-F.try_divide(F.col("high"), F.col("lwm")))
    least = F.min(trailed).over(before)
    near = trailed <= least + 1e-9 * F.abs(least)  # a quotient may round the other way than the product that the rule tests
    return F.coalesce((worst < F.min(worst).over(before)) | (best > F.max(best).over(before)) | near, F.lit(True))


def exit_rule_sweep(panel: DataFrame, params: DataFrame) -> DataFrame:
    """First exit of each (run_id, position) over a small grid of stop, target, trail and hold (one row per run).

    Stops, targets and trails are touched first at a bar that goes beyond all earlier ones, and a time exit falls on the bar of its number, so only
    these bars of a position meet the grid."""
    grid = params.agg(F.collect_list(F.struct("run_id", "stop", "target", "trail", "hold")).alias("_grid"))  # one row
    chosen = panel.withColumn("_record", _records(panel)).crossJoin(F.broadcast(grid))
    due = F.exists("_grid", lambda p: (p["hold"] <= F.col("bars_held")) & (p["hold"] > F.col("bars_held") - 1))
    many = chosen.filter(F.col("_record") | due).withColumn("_p", F.explode("_grid")).drop("_grid", "_record")
    rule = F.coalesce(stop_loss(F.col("_p.stop")), take_profit(F.col("_p.target")), trailing_stop(F.col("_p.trail")), time_exit(F.col("_p.hold")))
    hit = many.withColumn("_x", rule).filter("_x is not null")
    out = hit.groupBy(F.col("_p.run_id").alias("run_id"), "position_id").agg(F.min("timestamp").alias("exit_time"), F.min_by(F.struct("_x", "close", "entry_price", "sign", "bars_held"), "timestamp").alias("_r"))
    price = F.coalesce("_r._x.price", "_r.close")
    return out.select("run_id", "position_id", "exit_time", F.col("_r._x.reason").alias("reason"), price.alias("exit_price"), (F.col("_r.sign") * (ieee(price, F.col("_r.entry_price")) - 1)).alias("ret"), F.col("_r.bars_held").alias("bars_held"))


def touch_exits(entries: DataFrame, bars: DataFrame, stop: float | None, target: float | None, seconds: int, there: DataFrame | None = None) -> DataFrame:
    """First bar after entry that reaches a stop or target, as stop_loss and take_profit in that order: position_id, exit_time, reason, price.

    For long lives: searches in the bars' tower instead of a panel of position x bar. Bars' highs and lows have to span their close."""
    sign = F.when(F.col("side") == "long", 1.0).otherwise(-1.0)
    after = entries.select("position_id", "asset", (F.col("entry_time") + F.expr("interval 1 microsecond")).alias("start"), F.col("until").alias("end"), sign.alias("sign"), "entry_price")
    there, found = there or stored(towers.tower(bars, seconds)), None
    for i, (reason, pct, way) in enumerate((("stop_loss", stop, -1), ("take_profit", target, 1))):
        if pct is None:
            continue
        asked = after.withColumns({"level": F.col("entry_price") * (1 + way * F.col("sign") * pct), "up": F.col("sign") * way > 0})
        hits = asked.join(towers.first_touch(asked, there, seconds, "position_id"), "position_id")
        better, worse = F.col("open") > F.col("level"), F.col("open") < F.col("level")
        gapped = F.when(F.col("up"), better).otherwise(worse)
        one = hits.select("position_id", F.struct("time", F.lit(i).alias("i"), F.lit(reason).alias("reason"), F.when(gapped, F.col("open")).otherwise(F.col("level")).alias("price")).alias("_x"))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("position_id").agg(F.min("_x").alias("_x")).select("position_id", F.col("_x.time").alias("exit_time"), "_x.reason", "_x.price")
