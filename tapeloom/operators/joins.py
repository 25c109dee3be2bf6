"""As-of join, interval join and blocked scans, as compositions of DataFrame operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def asof_join(
    probe: DataFrame, build: DataFrame, by: Sequence[str], probe_time: str, build_time: str, values: Sequence[str], prefix: str = "", seconds: int | None = None, ahead: bool = False, strict: bool = False
) -> DataFrame:
    """probe with the values of build's last row at or before its time (``ahead``: the first at or after it; ``strict``: never at it), null if there is none; row count kept.

    Both sides are stacked and the last build row is carried along, in one shuffle on ``by``. With ``seconds`` that shuffle is on
    (by, time bucket), so that a hot key is many tasks: the last build row of each bucket is carried into the later buckets that hold
    probes by a scan of buckets, and stands before their rows.
    """
    carried = F.struct(*(F.col(v) for v in values))
    extra, keys = [], list(by)
    if seconds:
        probe, build = (x.withColumn("_bucket", bucket(F.col(t), seconds)) for x, t in ((probe, probe_time), (build, build_time)))
        extra, keys = [F.col("_bucket")], [*by, "_bucket"]
    kept = [c for c in probe.columns if c != "_bucket"]
    rank = 1 if strict else -1  # build rows of the probe's own time stand behind or before it
    left = probe.select(*by, *extra, F.col(probe_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*(F.col(c) for c in kept)).alias("_row"), F.lit(None).cast(build.select(carried.alias("x")).schema["x"].dataType).alias("_v"))
    none = F.lit(None).cast(left.schema["_row"].dataType).alias("_row")
    rows = left.unionByName(build.select(*by, *extra, F.col(build_time).alias("_t"), F.lit(rank).alias("_side"), none, carried.alias("_v")))
    if seconds:
        nearest = F.min_by if ahead else F.max_by
        ends = build.filter(F.col(build_time).isNotNull()).groupBy(*keys).agg(nearest(carried, F.col(build_time)).alias("_v")).withColumn("_asked", F.lit(False))
        asked = probe.select(*keys).distinct().select(*keys, F.lit(None).cast(ends.schema["_v"].dataType).alias("_v"), F.lit(True).alias("_asked"))
        order = F.desc("_bucket") if ahead else F.asc("_bucket")
        run = W.partitionBy(*by).orderBy(order).rangeBetween(W.unboundedPreceding, -1)
        brought = ends.unionByName(asked).withColumn("_v", F.last("_v", ignorenulls=True).over(run)).filter("_asked and _v is not null")
        rows = rows.unionByName(brought.select(*keys, F.lit(None).cast(rows.schema["_t"].dataType).alias("_t"), F.lit(rank).alias("_side"), none, "_v"))
    time = F.desc_nulls_first("_t") if ahead else F.asc_nulls_first("_t")
    run = W.partitionBy(*keys).orderBy(time, "_side").rowsBetween(W.unboundedPreceding, 0)
    found = rows.withColumn("_v", F.last("_v", ignorenulls=True).over(run)).filter("_side = 0")
    return found.select("_row.*", *(F.col(f"_v.{v}").alias(f"{prefix}{v}") for v in values))


def bucket(time: Column, seconds: int) -> Column:
    """Number of the time bucket of a TIMESTAMP_NTZ column."""
    return F.floor(F.unix_timestamp(time.cast("timestamp")) / seconds)


def ieee(a: Column, b: Column) -> Column:
    """a / b of doubles, infinite (by the signs of both, -0.0 is a negative b) or NaN instead of an error where b is 0."""
    endless = F.when(b.cast("string").startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(b == 0, a * endless).otherwise(F.try_divide(a, b))


def interval_join(spans: DataFrame, points: DataFrame, by: Sequence[str], start: str, end: str, time: str, seconds: int) -> DataFrame:
    """spans x points with equal ``by`` and start <= time <= end.

    Spans are put into all time buckets they touch, so the join is an equi-join on (by, bucket); a
    bucket of about the median span keeps both copies and candidates few.
    """
    cells = spans.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(start), seconds), bucket(F.col(end), seconds))))
    there = points.withColumn("_bucket", bucket(F.col(time), seconds))
    return cells.join(there, [*by, "_bucket"]).filter((F.col(time) >= F.col(start)) & (F.col(time) <= F.col(end))).drop("_bucket")


def blocked_sum(df: DataFrame, by: Sequence[str], block: Column, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Running sum for long curves: sums of blocks, their prefix sums, and running sums inside the blocks."""
    blocks = df.withColumn("_block", block)
    sums = blocks.groupBy(*by, "_block").agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select(*by, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_base"))
    inside = W.partitionBy(*by, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return blocks.join(bases, [*by, "_block"]).withColumn(out, F.sum(value).over(inside) + F.col("_base")).drop("_block", "_base")


MONTH = 30 * 86400


def scanned(df: DataFrame, by: Sequence[str], block: Column, order: Sequence[str], **columns: tuple[str, Column]) -> DataFrame:
    """df with running columns, name=(kind, value), over the rows so far of each ``by`` in ``order``.

    Kinds: sum, count (of values not null), max, min, first and last (value not null). Windows run inside blocks (block grows with order);
    what the blocks before amount to is joined in, so that no ``by`` is one task. Only rows of blocks, one each, are scanned by ``by`` alone."""
    inside = W.partitionBy(*by, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = df.withColumn("_block", block)
    whole, base, out = [], [], {}
    for name, (kind, value) in columns.items():
        at, b = F.when(value.isNotNull(), F.struct(*order)), F.col(f"_{name}")
        if kind in ("sum", "count"):
            whole.append((F.sum(value) if kind == "sum" else F.count(value)).alias(f"_{name}"))
            base.append(F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}"))
            out[name] = (F.sum(value) if kind == "sum" else F.count(value)).over(inside) + b
        elif kind in ("max", "min"):
            f, pick = (F.max, F.greatest) if kind == "max" else (F.min, F.least)
            whole.append(f(value).alias(f"_{name}"))
            base.append(f(f"_{name}").over(before).alias(f"_{name}"))
            out[name] = pick(f(value).over(inside), b)
        elif kind == "last":
            whole.append(F.max_by(value, at).alias(f"_{name}"))
            base.append(F.last(f"_{name}", ignorenulls=True).over(before).alias(f"_{name}"))
            out[name] = F.coalesce(F.last(value, ignorenulls=True).over(inside), b)
        else:
            whole.append(F.min_by(value, at).alias(f"_{name}"))
            base.append(F.first(f"_{name}", ignorenulls=True).over(before).alias(f"_{name}"))
            out[name] = F.coalesce(b, F.first(value, ignorenulls=True).over(inside))
    ends = blocks.groupBy(*by, "_block").agg(*whole).select(*by, "_block", *base)
    return blocks.join(ends, [*by, "_block"]).withColumns(out).drop("_block", *(f"_{n}" for n in columns))


def numbered(stamps: DataFrame, time: str, seconds: int = MONTH) -> DataFrame:
    """Rows of distinct times with their number from 1 (bar) and their count (n_bars).

    Rows are numbered inside time buckets; a bucket's base is the prefix sum of the counts before it. Only the buckets' counts, a row each, meet in one task."""
    blocks = stamps.withColumn("_block", bucket(F.col(time), seconds))
    counts = blocks.groupBy("_block").agg(F.count("*").alias("_n"))
    upto = W.orderBy("_block").rowsBetween(W.unboundedPreceding, 0)
    bases = counts.select("_block", (F.sum("_n").over(upto) - F.col("_n")).alias("_base"), F.sum("_n").over(W.partitionBy()).alias("n_bars"))
    inside = F.row_number().over(W.partitionBy("_block").orderBy(time))
    return blocks.join(bases, "_block").withColumn("bar", (inside + F.col("_base")).cast("int")).drop("_block", "_base").select(*stamps.columns, "bar", "n_bars")
