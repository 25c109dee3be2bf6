"""Commission, slippage, market-impact and participation models: functions from columns to a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def commission_none(q: Column, p: Column) -> Column:
    return F.lit(0.0)


def commission_percent(q: Column, p: Column, rate: float) -> Column:
    return F.abs(q * p) * rate


def commission_per_share(q: Column, p: Column, per_share: float, minimum: float) -> Column:
    return F.greatest(F.abs(q) * per_share, F.lit(minimum))


def commission_tiered(q: Column, p: Column, tiers: list[tuple[float, float]]) -> Column:
    """Rate of the first tier whose threshold is at least the trade's value; the last one above all."""
    value = F.abs(q * p)
    rate = F.lit(tiers[-1][1])
    for threshold, r in reversed(tiers):
        rate = F.when(value <= threshold, F.lit(r)).otherwise(rate)
    return value * rate


def commission_combined(q: Column, p: Column, percent: float, fixed: float) -> Column:
    return F.abs(q * p) * percent + fixed


def commission_futures(q: Column, p: Column, per_trade: float, per_block: float, percent: float, multiplier: float) -> Column:
    return F.greatest(F.lit(per_trade), per_block * F.abs(q), percent * F.abs(q) * p * multiplier)


def slippage_fixed(q: Column, p: Column, amount: float) -> Column:
    return F.lit(amount)


def slippage_percent(q: Column, p: Column, rate: float) -> Column:
    return p * rate


def slippage_volume(q: Column, p: Column, volume: Column, factor: float) -> Column:
    return F.when(volume > 0, p * (F.abs(q) / volume) * factor).otherwise(F.lit(0.0))


def slippage_futures(q: Column, points: float, multiplier: float) -> Column:
    return F.abs(q) * points * multiplier


def impact(kind: str, signed: Column, p: Column, volume: Column, coefficient: float, volatility: float = 0.02, adv: float = 1.0, exponent: float = 0.5, minimum: float = 0.0) -> Column:
    """Signed price impact (buy +, sell -)."""
    q, side = F.abs(signed), F.signum(signed)
    share = F.when(volume > 0, q / volume)
    if kind == "linear":
        size = F.coalesce(coefficient * share * p, F.lit(0.0))
    elif kind == "sqrt":
        size = F.coalesce(coefficient * volatility * F.sqrt(share / adv) * p, F.lit(0.0))
    elif kind == "power":
        size = F.greatest(F.coalesce(coefficient * F.pow(share, F.lit(exponent)) * p, F.lit(minimum)), F.lit(minimum))
    else:
        size = F.lit(0.0)
    return side * size


def fillable(q: Column, volume: Column, most: float, min_volume: float = 0.0) -> Column:
    """Quantity the bar's volume lets through."""
    return F.when(volume.isNull(), q).when(volume < min_volume, F.lit(0.0)).otherwise(F.least(q, volume * most))


def adaptive_rate(base: float, factor: float, volatility: Column, average: Column) -> Column:
    return F.least(F.greatest(base * (1 - factor * (F.try_divide(volatility, average) - 1)), F.lit(0.02)), F.lit(0.25))


def stop_slippage(price: Column, rate: float, sells: Column) -> Column:
    return F.when(sells, price * (1 - rate)).otherwise(price * (1 + rate))
