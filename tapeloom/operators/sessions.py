"""Calendars and sessions. Schedules are small tables: session_date, market_open, market_close (UTC) and breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Session start (hour, minute) by calendar; 0:00 for others.
SESSION_STARTS = {
    "CME_Equity": (17, 0),
    "CME_Agriculture": (17, 0),
    "CME_Interest_Rate": (17, 0),
    "CBOT": (17, 0),
    "NYMEX": (18, 0),
    "COMEX": (18, 0),
    "NYSE": (9, 30),
    "NASDAQ": (9, 30),
    "LSE": (8, 0),
    "XETRA": (9, 0),
}
#: Trading days a year by calendar, whatever its case.
ANNUAL = {
    "crypto": 365,
    "NYSE": 252,
    "NASDAQ": 252,
    "CME_Equity": 252,
    "CME_Agriculture": 252,
    "CME_Globex_Energy_and_Metals": 252,
    "LSE": 253,
    "XETRA": 252,
    "TSX": 252,
    "HKEX": 252,
    "JPX": 245,
}
MINUTES = {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "1h": 60}


def build_schedule(spark: SparkSession, start: str, end: str, open_at: str, close_at: str, tz: str, holidays: DataFrame | None = None, early: DataFrame | None = None, breaks: tuple[str, str] | None = None) -> DataFrame:
    """One row per weekday that is no holiday (column date); early closes: (date, close); breaks: start and end of each day's break, if any. Local times to UTC."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("session_date")) if start <= end else spark.createDataFrame([], "session_date date")
    days = days.filter(F.weekday("session_date") < 5)
    if holidays is not None:
        days = days.join(F.broadcast(holidays.select(F.col("date").alias("session_date"))), "session_date", "left_anti")
    close = F.lit(close_at)
    if early is not None:
        days = days.join(F.broadcast(early.select(F.col("date").alias("session_date"), F.col("close").alias("_early"))), "session_date", "left")
        close = F.coalesce("_early", close)
    none = F.lit(None).cast("timestamp_ntz")
    utc = lambda t: F.to_utc_timestamp(F.concat_ws(" ", F.col("session_date").cast("string"), t), tz).cast("timestamp_ntz")
    pause = [(utc(F.lit(breaks[i])) if breaks else none).alias(name) for i, name in enumerate(("break_start", "break_end"))]
    return days.select("session_date", utc(F.lit(open_at)).alias("market_open"), utc(close).alias("market_close"), F.lit(tz).alias("timezone"), *pause)


def trading_days(schedule: DataFrame, start, end) -> DataFrame:
    return schedule.filter(F.col("session_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("session_date")


def flag_trading_day(df: DataFrame, schedule: DataFrame, time: str = "timestamp") -> DataFrame:
    days = F.broadcast(schedule.select(F.col("session_date").alias("_d"), F.lit(True).alias("_yes")))  # a row per day
    return df.join(days, F.to_date(time) == F.col("_d"), "left").withColumn("is_trading_day", F.col("_yes").isNotNull()).drop("_d", "_yes")


def _by_day(schedule: DataFrame) -> DataFrame:
    """Sessions at all days they touch."""
    return schedule.withColumn("_d", F.explode(F.sequence(F.to_date("market_open"), F.to_date("market_close"))))


def flag_market_open(df: DataFrame, schedule: DataFrame, time: str = "timestamp") -> DataFrame:
    """True from open to before close, but not in a break; sessions do not overlap."""
    cells = F.broadcast(_by_day(schedule).select("_d", F.col("market_open").alias("_o"), F.col("market_close").alias("_c"), F.col("break_start").alias("_b"), F.col("break_end").alias("_e")))
    t = F.col(time)
    inside = (F.to_date(t) == F.col("_d")) & (t >= F.col("_o")) & (t < F.col("_c"))
    on = F.col("_o").isNotNull() & ~F.coalesce((t >= F.col("_b")) & (t < F.col("_e")), F.lit(False))
    return df.join(cells, inside, "left").withColumn("is_open", on).drop("_d", "_o", "_c", "_b", "_e")


def shift_trading_days(df: DataFrame, schedule: DataFrame, n: int, day: str = "date") -> DataFrame:
    """The n-th trading day strictly after (n > 0) or before (n < 0) each row's date."""
    numbered = schedule.select("session_date", F.row_number().over(W.orderBy("session_date")).alias("_i"))  # a row per day
    dates = df.select(F.col(day).alias("_d")).distinct()
    marked = dates.select("_d", F.lit(1).alias("_ask"), F.lit(0).alias("_day")).unionByName(numbered.select(F.col("session_date").alias("_d"), F.lit(0).alias("_ask"), F.lit(1).alias("_day")))
    upto = F.sum("_day").over(W.orderBy("_d").rangeBetween(W.unboundedPreceding, 0))
    below = F.sum("_day").over(W.orderBy("_d").rangeBetween(W.unboundedPreceding, 0)) - F.max("_day").over(W.partitionBy("_d"))
    index = (upto + n) if n > 0 else (below + n + 1)
    asked = marked.withColumn("_i", index.cast("int")).filter("_ask = 1").select("_d", "_i")
    found = asked.join(numbered.withColumnRenamed("session_date", "shifted"), "_i", "left").select("_d", "shifted")
    return df.join(found, F.col(day) == F.col("_d"), "left").drop("_d")


def holidays(spark: SparkSession, schedule: DataFrame) -> DataFrame:
    """Weekdays within the schedule's range without a session."""
    span = schedule.agg(F.min("session_date").alias("a"), F.max("session_date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("date")).filter(F.weekday("date") < 5)
    return days.join(schedule.select(F.col("session_date").alias("date")), "date", "left_anti")


def filter_to_trading_days(df: DataFrame, schedule: DataFrame, time: str = "timestamp") -> DataFrame:
    return df.join(F.broadcast(schedule.select(F.col("session_date").alias("_d"))), F.to_date(time) == F.col("_d"), "left_semi")


def filter_to_trading_sessions(df: DataFrame, schedule: DataFrame, time: str = "timestamp", naive_tz: str = "UTC", include_breaks: bool = False) -> DataFrame:
    """Rows within sessions (without breaks unless asked for); naive times are naive_tz's; output time is UTC."""
    utc = df if naive_tz == "UTC" else df.withColumn(time, F.to_utc_timestamp(F.col(time).cast("timestamp"), naive_tz).cast("timestamp_ntz"))
    kept = flag_market_open(utc, schedule if not include_breaks else schedule.withColumn("break_start", F.lit(None).cast("timestamp_ntz")), time)
    return kept.filter("is_open").drop("is_open")


def trading_minutes(schedule: DataFrame, freq: str, include_close: bool = False) -> DataFrame:
    """Timestamps of every session and break segment at freq, from open to before close, and the close if asked for."""
    if freq not in MINUTES:
        raise ValueError(f"freq must be one of {sorted(MINUTES)}")
    parts = F.array(F.struct(F.col("market_open").alias("a"), F.least("market_close", F.coalesce("break_start", "market_close")).alias("b")), F.struct(F.col("break_end").alias("a"), F.col("market_close").alias("b")))
    cells = schedule.select("session_date", "market_close", F.explode(parts).alias("s")).filter("s.a is not null and s.a < s.b")
    step = F.expr(f"interval {MINUTES[freq]} minute")
    out = cells.select("session_date", F.explode(F.sequence("s.a", F.col("s.b") - F.expr("interval 1 microsecond"), step)).alias("timestamp"))
    if include_close:
        out = out.union(schedule.select("session_date", "market_close")).distinct()
    return out


def resample_to_bars(ticks: DataFrame, freq: str, price: str = "price", size: str = "size", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Bars from irregular ticks by tumbling windows."""
    at = F.struct(*order)
    out = ticks.groupBy("asset", F.window("ts", freq).alias("w")).agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(size).alias("volume"))
    return out.select("asset", F.col("w.start").cast("timestamp_ntz").alias("timestamp"), "open", "high", "low", "close", "volume")


def early_closes(schedule: DataFrame, tz: str) -> DataFrame:
    """Days whose local close is before the usual (most frequent) one."""
    local = schedule.withColumn("local_close", F.date_format(F.from_utc_timestamp(F.col("market_close").cast("timestamp"), tz), "HH:mm"))
    usual = local.groupBy("local_close").agg(F.count("*").alias("n")).agg(F.max_by("local_close", F.struct("n", "local_close")).alias("usual"))
    return local.crossJoin(F.broadcast(usual)).filter("local_close < usual").select("session_date", "local_close")  # usual: one row


def session_date(time: Column, calendar: str = "CME_Equity", start: tuple[int, int] | None = None) -> Column:
    """Session of a local wall time: evening starts open the next date, morning starts close the previous one.

    Calendars that SESSION_STARTS does not name start at 0:00, if no start is given."""
    hour, minute = start or SESSION_STARTS.get(calendar, (0, 0))
    minutes = F.hour(time) * 60 + F.minute(time)
    at, day = hour * 60 + minute, F.to_date(time)
    return F.when(minutes >= at, F.date_add(day, 1)).otherwise(day) if hour >= 12 else F.when(minutes < at, F.date_sub(day, 1)).otherwise(day)


def session_pnl(curve: DataFrame, session: Column, tie: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """Per run and session: prices of the curve, P&L, returns against the previous session's close."""
    at = F.struct(*tie)
    days = curve.groupBy("run_id", session.alias("session_date")).agg(
        F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.min_by("equity", at).alias("open_equity"), F.max_by("equity", at).alias("close_equity"),
        F.max("equity").alias("high_equity"), F.min("equity").alias("low_equity"), F.count("*").cast("int").alias("num_bars"),
    )
    run = W.partitionBy("run_id").orderBy("session_date")
    before = F.lag("close_equity").over(run)
    first = F.first("open_equity").over(run.rowsBetween(W.unboundedPreceding, 0))
    return days.withColumns({
        "pnl": F.round(F.col("close_equity") - F.col("open_equity"), 6),
        "return_pct": F.round(F.coalesce(F.try_divide(F.col("close_equity") - before, before), F.lit(0.0)), 9),
        "intra_session_dd": F.round(F.coalesce(F.try_divide(F.col("low_equity") - F.col("high_equity"), F.col("high_equity")), F.lit(0.0)), 9),
        "cumulative_return": F.round(F.coalesce(F.try_divide(F.col("close_equity"), first) - 1, F.lit(0.0)), 9),
    })


def enforce_sessions(bars: DataFrame, schedule: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bars on trading days, one row with skipped_bars: distinct timestamps left out)."""
    flagged = flag_trading_day(bars, schedule)
    skipped = flagged.filter("not is_trading_day").agg(F.count_distinct("timestamp").alias("skipped_bars"))
    return flagged.filter("is_trading_day").drop("is_trading_day"), skipped


def annualization_factor(name: Column, sessions_a_year: Column | None = None) -> Column:
    """Trading days a year by calendar name; null: 252; unknown: the given count, else 252."""
    known = F.create_map(*(x for k, v in ANNUAL.items() for x in (F.lit(k.upper()), F.lit(v))))
    other = F.coalesce(sessions_a_year, F.lit(252)) if sessions_a_year is not None else F.lit(252)
    return F.when(name.isNull(), F.lit(252)).otherwise(F.coalesce(F.try_element_at(known, F.upper(name)), other))
