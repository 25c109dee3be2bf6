"""Structured Streaming jobs: bars, session P&L, trading statistics, enrichment."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def stream_bars(ticks: DataFrame, freq: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    """Tumbling bars of a stream of ticks (asset, ts, event_id, price, size); later than the watermark is dropped."""
    at = F.struct("ts", "event_id")
    bars = ticks.withWatermark("ts", delay).groupBy("asset", F.window("ts", freq).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume")
    )
    return bars.select("asset", F.col("w.start").alias("timestamp"), "open", "high", "low", "close", "volume")


def stream_session_pnl(curve: DataFrame, hour: int = 17, delay: str = "1 hour") -> DataFrame:
    """P&L of sessions that start at ``hour``, as daily windows shifted to it; a session closes with the watermark."""
    window = F.window("timestamp", "1 day", "1 day", f"{hour} hours")
    days = curve.withWatermark("timestamp", delay).groupBy("run_id", window.alias("w")).agg(
        F.min_by("equity", "timestamp").alias("open_equity"), F.max_by("equity", "timestamp").alias("close_equity"), F.max("equity").alias("high_equity"), F.min("equity").alias("low_equity"), F.count("*").alias("num_bars")
    )
    return days.select("run_id", F.to_date("w.end").alias("session_date"), "open_equity", "close_equity", "high_equity", "low_equity", "num_bars", (F.col("close_equity") - F.col("open_equity")).alias("pnl"))


_STATS = "asset string, kind string, session_date date, n long, pnl double, win_rate double, recent_pnl double, recent_win_rate double"


class _TradingStats(StatefulProcessor):
    """State of one asset: totals, the last ``window`` P&L values, and its open sessions, each with a timer at its end."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "n long, wins long, pnl double")
        self.recent = handle.getListState("recent", "pnl double")
        self.sessions = handle.getMapState("sessions", "end_ms long", "n long, wins long, pnl double")
        self.handle = handle

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"])  # one asset's rows of a micro-batch
        n, wins, total = self.totals.get() if self.totals.exists() else (0, 0, 0.0)
        recent = [x[0] for x in self.recent.get()] if self.recent.exists() else []
        values = new["pnl"].astype(float)
        n, wins, total = n + len(values), wins + int((values > 0).sum()), total + float(values.sum())
        recent = [*recent, *values.tolist()][-self.window :]
        self.totals.update((n, wins, total))
        self.recent.put([(x,) for x in recent])
        ends = (new["ts"].dt.normalize() + pd.Timedelta(days=1)).map(lambda t: int(t.timestamp() * 1000))
        for end, part in values.groupby(ends):
            if end <= timerValues.getCurrentWatermarkInMs():
                continue  # the session has been closed and sent: what is later than the watermark is dropped
            had = self.sessions.getValue((end,)) if self.sessions.containsKey((end,)) else (0, 0, 0.0)
            self.sessions.updateValue((end,), (had[0] + len(part), had[1] + int((part > 0).sum()), had[2] + float(part.sum())))
            self.handle.registerTimer(end)
        yield self._row(key, "total", None, n, total, wins, sum(recent), sum(x > 0 for x in recent) / len(recent))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        if self.sessions.containsKey((end,)):
            n, wins, total = self.sessions.getValue((end,))
            self.sessions.removeKey((end,))
            yield self._row(key, "session", (pd.Timestamp(end, unit="ms") - pd.Timedelta(days=1)).date(), n, total, wins, None, None)

    def _row(self, key, kind, day, n, total, wins, recent, share) -> pd.DataFrame:
        return pd.DataFrame({"asset": [key[0]], "kind": [kind], "session_date": [day], "n": [n], "pnl": [total], "win_rate": [wins / n], "recent_pnl": [recent], "recent_win_rate": [share]})

    def close(self) -> None:
        pass


def stream_trading_stats(events: DataFrame, window: int = 50, delay: str = "1 hour", mode: str = "append") -> DataFrame:
    """Trading statistics of P&L events (asset, ts, event_id, pnl), kept in state by asset.

    Rows of kind ``total``: after each micro-batch the totals so far and over the last ``window`` events. Rows of kind ``session``: a day's statistics, once
    the watermark has passed its end (a timer a session). Start it within ``rocksdb_state``."""
    timed = events.withWatermark("ts", delay).groupBy("asset")
    return timed.transformWithStateInPandas(_TradingStats(window), _STATS, mode, "EventTime")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started in the block keep their state in RocksDB, which stateful processors need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append all that the stream's sources hold now to Parquet files, from where the checkpoint left off; the files read as a table."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def stream_enrich(bars: DataFrame, signals: DataFrame, delay: str = "10 minutes", static: DataFrame | None = None, on: Column | None = None) -> DataFrame:
    """Bars with signals of the same asset and time (left outer, bounded by both watermarks), and a static table."""
    left = bars.withWatermark("timestamp", delay)
    right = signals.withWatermark("timestamp", delay).withColumnsRenamed({"asset": "_asset", "timestamp": "_time"})
    same = (F.col("asset") == F.col("_asset")) & (F.col("timestamp") == F.col("_time"))
    out = left.join(right, same, "left").drop("_asset", "_time")
    return out if static is None else out.join(static, on, "left")
