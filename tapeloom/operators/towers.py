"""Searches over long spans of bars through a tower of block extremes: first touch, trailing touch, range extremes.

Level 1 of a tower holds each asset's bars in arrays, one a time bucket; a row of a higher level holds what ``radix``
rows of the level below amount to. A span of bars is its first and last bucket and, in between, at most two rows of
each level (more of the top level alone, where the span is longer than the tower), so a search joins about 2 * levels rows
instead of all bars of the span, then goes down from the first row that must hold the answer, one equi-join a level. All
joins and groups are by (asset, level, block): no asset's history is one task.

A row's summary: highest high, lowest low, deepest fall (a high before or at a low) and greatest rise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.joins import bucket

RADIX = 32
LEVELS = 3


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def _summary(kids: Column) -> Column:
    """Highest, lowest, fall and rise of rows in order."""
    start = F.struct(*(F.lit(None).cast("double").alias(c) for c in ("hi", "lo", "fall", "rise")))
    return F.aggregate(
        kids, start, lambda s, k: F.struct(
            F.greatest(s["hi"], k["hi"]).alias("hi"), F.least(s["lo"], k["lo"]).alias("lo"),
            F.greatest(s["fall"], k["fall"], s["hi"] - k["lo"]).alias("fall"), F.greatest(s["rise"], k["rise"], k["hi"] - s["lo"]).alias("rise"),
        ),
    )


def tower(bars: DataFrame, seconds: int, high: str = "high", low: str = "low", radix: int = RADIX, levels: int = LEVELS) -> DataFrame:
    """Rows (asset, lvl, block, kids) of bars' buckets of ``seconds`` (of some tens of bars) and the levels above them.

    A kid of level 1 is a bar (at: its microseconds), one of a higher level a row below (at: its block)."""
    hi, lo = F.col(high).cast("double"), F.col(low).cast("double")
    bar = F.struct(
        micros(F.col("timestamp")).alias("at"), F.col("timestamp").alias("time"), F.col("open").cast("double").alias("open"), F.col("close").cast("double").alias("close"),
        hi.alias("hi"), lo.alias("lo"), (hi - lo).alias("fall"), (hi - lo).alias("rise"),
    )
    row = bars.groupBy("asset", bucket(F.col("timestamp"), seconds).alias("block")).agg(F.sort_array(F.collect_list(bar)).alias("kids"))
    kind = row.schema["kids"].dataType.elementType
    out = row.withColumn("lvl", F.lit(1))
    for lvl in range(2, levels + 1):
        s = row.withColumn("_s", _summary(F.col("kids")))
        parts = {"at": F.col("block"), "hi": F.col("_s.hi"), "lo": F.col("_s.lo"), "fall": F.col("_s.fall"), "rise": F.col("_s.rise")}
        kid = F.struct(*(parts.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind))
        row = s.groupBy("asset", F.floor(F.col("block") / radix).alias("block")).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        out = out.unionByName(row.withColumn("lvl", F.lit(lvl)))
    return out.select("asset", "lvl", "block", "kids")


def pieces(start: Column, end: Column, seconds: int, radix: int = RADIX, levels: int = LEVELS) -> Column:
    """The rows of a tower that make up start..end: an array of (key, lvl, block, from, to); keys are in order of time, from..to bound the kids' at."""
    a, b = bucket(start, seconds), bucket(end, seconds)
    lowest, highest = micros(start), micros(end)
    first = F.array(_piece(a, 1, a, lowest, highest))
    both = F.array(_piece(a, 1, a, lowest, highest), _piece(b, 1, b, lowest, highest))
    found, low, high = [F.when((lowest > highest) | (a == b), first).otherwise(both)], a + 1, b - 1  # low..high: the rows in between
    for lvl in range(2, levels + 1):
        found.append(F.when(low <= high, _parents(low, high, lvl, lvl == levels, radix)).otherwise(F.array().cast(_PIECES)))
        low, high = F.ceil(low / radix), F.floor((high + 1) / radix) - 1  # those whose parents are whole
    return F.concat(*found)


_PIECES = "array<struct<key:bigint,lvl:int,block:bigint,from:bigint,to:bigint>>"


def _piece(key: Column, lvl: int, block: Column, low: Column, high: Column) -> Column:
    return F.struct(key.cast("long").alias("key"), F.lit(lvl).alias("lvl"), block.cast("long").alias("block"), low.cast("long").alias("from"), high.cast("long").alias("to"))


def _parents(low: Column, high: Column, lvl: int, top: bool, radix: int) -> Column:
    """Pieces of level lvl for the rows low..high below it: all parents at the top, else those that are not whole."""
    first, last = F.floor(low / radix), F.floor(high / radix)
    inner = F.filter(F.array_distinct(F.array(first, last)), lambda p: (p * radix < low) | (p * radix + radix - 1 > high))
    return F.transform(
        F.sequence(first, last) if top else inner,
        lambda p: _piece(F.greatest(low, p * radix) * radix ** (lvl - 2), lvl, p, F.greatest(low, p * radix), F.least(high, p * radix + radix - 1)),
    )


def _met(spans: DataFrame, there: DataFrame, start: str, end: str, seconds: int) -> DataFrame:
    """spans x the rows of their pieces, with the kids that belong to each."""
    rows = spans.withColumn("_p", F.explode(pieces(F.col(start), F.col(end), seconds))).select("*", "_p.*").drop("_p")
    return rows.join(there, ["asset", "lvl", "block"]).withColumn("kids", F.filter("kids", lambda k: (k["at"] >= F.col("from")) & (k["at"] <= F.col("to"))))


def _below(state: DataFrame, there: DataFrame, lvl: int, key: str) -> DataFrame:
    """state with the kids of row (asset, lvl, block) where its lvl is this one; the others keep their place, spread by a hash of key."""
    now = F.col("lvl") == lvl
    rows = there.filter(F.col("lvl") == lvl).select("asset", F.col("lvl").alias("_l"), F.col("block").alias("_b"), F.col("kids").alias("_kids"))
    asked = state.withColumns({"_l": F.when(now, lvl).otherwise(0), "_b": F.when(now, F.col("block")).otherwise(F.xxhash64(key))})
    return asked.join(rows, ["asset", "_l", "_b"], "left").drop("_l", "_b")


def first_touch(orders: DataFrame, there: DataFrame, seconds: int, key: str = "order_id") -> DataFrame:
    """(key, time, open): the first bar of start..end whose high is at or above level (``up``) or whose low is at or below it.

    orders: key, asset, start, end, up, level; there: the bars' tower."""
    touched = lambda k: F.when(F.col("up"), k["hi"] >= F.col("level")).otherwise(k["lo"] <= F.col("level"))
    first = lambda kids: F.array_min(F.filter(kids, touched))
    met = _met(orders.select(key, "asset", "start", "end", "up", "level"), there, "start", "end", seconds).withColumn("hit", first(F.col("kids"))).filter("hit is not null")
    best = met.groupBy(key).agg(F.min_by(F.struct("asset", "up", "level", "lvl", "hit"), "key").alias("_r")).select(key, "_r.*")
    state = best.withColumns({"lvl": F.col("lvl") - 1, "block": F.col("hit.at")})  # what hit names: a bar (0) or a row of that level
    for lvl in range(LEVELS - 1, 0, -1):
        now = F.col("lvl") == lvl
        state = _below(state, there, lvl, key).withColumn("hit", F.when(now, first(F.col("_kids"))).otherwise(F.col("hit"))).drop("_kids")
        state = state.withColumns({"block": F.col("hit.at"), "lvl": F.when(now, lvl - 1).otherwise(F.col("lvl"))})
    return state.select(key, F.col("hit.time").alias("time"), F.col("hit.open").alias("open"))


def trailing_touch(orders: DataFrame, there: DataFrame, seconds: int, key: str = "order_id") -> DataFrame:
    """(key, time, open, stop): the first bar of start..end that is ``trail`` or more away from the mark, this bar's included.

    The mark is the highest high so far (``sell``), whose stop is below it, or the lowest low. Lows are mirrored for the latter. What a search
    carries from row to row is the mark. A bar is tested against its rounded stop; a row above bars only by its deepest fall, which may round
    the other way. So rows within that doubt are gone down into, too, besides the first one beyond it, and an order's first bar of all is its touch."""
    high = lambda k: F.when(F.col("sell"), k["hi"]).otherwise(-k["lo"])
    low = lambda k: F.when(F.col("sell"), k["lo"]).otherwise(-k["hi"])
    fall = lambda k: F.when(F.col("sell"), k["fall"]).otherwise(k["rise"])
    kind = there.schema["kids"].dataType.elementType

    def beyond(mark: Column, k: Column, way: int) -> Column:
        doubt = 1e-12 * F.greatest(F.abs(k["hi"]), F.abs(k["lo"]), F.abs(mark), F.abs("trail"))
        return F.coalesce(F.greatest(mark - low(k), fall(k)) >= F.col("trail") + way * doubt, F.lit(False))

    def walk(rows: Column, mark: Column, bars: bool) -> Column:
        """(at, mark before it) of the rows, by their at or key, that may hold the touch: up to the first that must."""
        place = F.array().cast("array<struct<at:bigint,mark:double>>")
        start = F.struct(mark.cast("double").alias("mark"), F.lit(False).alias("done"), place.alias("found"))

        def step(s: Column, k: Column) -> Column:
            reached = F.greatest(s["mark"], high(k))
            touched = F.coalesce(low(k) <= reached - F.col("trail"), F.lit(False))
            may, must = (touched, touched) if bars else (beyond(s["mark"], k, -1), beyond(s["mark"], k, 1))
            here = F.array(F.struct(k["at"].alias("at"), s["mark"].alias("mark")))
            return F.when(s["done"], s).otherwise(F.struct(reached.alias("mark"), must.alias("done"), F.when(may, F.concat(s["found"], here)).otherwise(s["found"]).alias("found")))

        return F.aggregate(rows, start, step, lambda s: s["found"])

    met = _met(orders.select(key, "asset", "start", "end", "sell", "trail"), there, "start", "end", seconds)
    part = met.withColumn("_s", _summary(F.col("kids"))).select(key, "asset", "sell", "trail", F.struct(F.col("key").alias("at"), "lvl", "block", "from", "to", "_s.hi", "_s.lo", "_s.fall", "_s.rise").alias("part"))
    per = part.groupBy(key).agg(*(F.first(c).alias(c) for c in ("asset", "sell", "trail")), F.sort_array(F.collect_list("part")).alias("parts"))  # about 2 * levels parts
    per = per.withColumn("_w", F.explode(walk(F.col("parts"), F.lit(None), False)))
    chosen = F.filter("parts", lambda p: p["at"] == F.col("_w.at"))[0]
    state = per.withColumn("_c", chosen).select(key, "asset", "sell", "trail", F.col("_w.mark").alias("mark"), "_c.lvl", "_c.block", "_c.from", "_c.to", F.lit(None).cast(kind).alias("bar"))
    for lvl in range(LEVELS, 0, -1):
        now = F.col("lvl") == lvl
        state = _below(state, there, lvl, key).withColumn("_kids", F.filter("_kids", lambda k: (k["at"] >= F.col("from")) & (k["at"] <= F.col("to"))))
        stay = F.array(F.struct(F.lit(None).cast("bigint").alias("at"), F.col("mark").alias("mark")))
        state = state.withColumn("_w", F.explode(F.when(now, walk(F.col("_kids"), F.col("mark"), lvl == 1)).otherwise(stay)))
        found = F.filter("_kids", lambda k: k["at"] == F.col("_w.at"))[0]
        step = {"mark": F.when(now, F.col("_w.mark")).otherwise(F.col("mark")), "block": F.when(now, F.col("_w.at")).otherwise(F.col("block")), "lvl": F.when(now, lvl - 1).otherwise(F.col("lvl")), "from": F.when(now, F.lit(-(2**63))).otherwise(F.col("from")), "to": F.when(now, F.lit(2**63 - 1)).otherwise(F.col("to"))}
        state = state.withColumns(step | ({"bar": found} if lvl == 1 else {})).drop("_kids", "_w")
    mark = F.greatest(F.col("mark"), high(F.col("bar")))
    stop = F.when(F.col("sell"), mark - F.col("trail")).otherwise(F.col("trail") - mark)
    touch = state.select(key, F.struct(F.col("bar.at").alias("at"), F.col("bar.time").alias("time"), F.col("bar.open").alias("open"), stop.alias("stop")).alias("_r"))
    return touch.groupBy(key).agg(F.min("_r").alias("_r")).select(key, "_r.time", "_r.open", "_r.stop")


def range_extremes(spans: DataFrame, there: DataFrame, seconds: int, key: str, at_start: str | None = None) -> DataFrame:
    """(key, highest, lowest) of the bars of start..end; at_start: a field (close) that stands for high and low in the bar at start itself."""
    entry = lambda k, c: F.when((F.col("lvl") == 1) & (k["at"] == micros(F.col("start"))), k[at_start]).otherwise(k[c]) if at_start else k[c]
    met = _met(spans.select(key, "asset", "start", "end"), there, "start", "end", seconds)
    return met.groupBy(key).agg(F.max(F.array_max(F.transform("kids", lambda k: entry(k, "hi")))).alias("highest"), F.min(F.array_min(F.transform("kids", lambda k: entry(k, "lo")))).alias("lowest"))
