"""Queries of the streaming operators: file source, availableNow, checkpoint, Parquet sink, then a read of the sink. Their SQL is the batch twin."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.jobs import panel_queries
from tapeloom.jobs.panel_queries import rounded
from tapeloom.sources import results
from tapeloom.sources import views as v
from tapeloom.streaming import streams

QUERIES: dict = {}
SQL: dict[str, str] = {}
register = partial(panel_queries.register, queries=QUERIES, oracles=SQL)


def landed(df: DataFrame) -> DataFrame:
    """A stream of files that hold df's rows, its times as TIMESTAMP."""
    spark, path = df.sparkSession, results.scratch(df.sparkSession)
    timed = df.select(*(F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes))
    timed.write.parquet(path)
    return spark.readStream.schema(timed.schema).parquet(path)


def sunk(stream: DataFrame) -> DataFrame:
    """All of the stream through a sink; times without zone again."""
    at = results.scratch(stream.sparkSession)
    out = streams.run_available(stream, f"{at}/table", f"{at}/checkpoint")
    return out.select(*(F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in out.dtypes))


@register("L1_stream_bars", """, w AS (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) AS b FROM tk), m AS (SELECT max(ts) AS latest FROM tk)
  SELECT asset, b AS timestamp, arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, event_id)) AS close, round(sum(size), 4) AS volume FROM w, m WHERE b + INTERVAL 15 MINUTE <= latest - INTERVAL 10 MINUTE GROUP BY 1, 2""")
def l1(spark: SparkSession, d: str) -> DataFrame:
    return sunk(streams.stream_bars(landed(v.ticks(spark, d)))).withColumn("volume", F.round("volume", 4))


@register("L2_stream_session_pnl", """, w AS (SELECT run_id, timestamp, equity, (timestamp + INTERVAL 7 HOUR)::DATE AS session_date FROM et), m AS (SELECT max(timestamp) AS latest FROM et)
  SELECT run_id, session_date, arg_min(equity, timestamp) AS open_equity, arg_max(equity, timestamp) AS close_equity, max(equity) AS high_equity, min(equity) AS low_equity, count(*) AS num_bars, round(arg_max(equity, timestamp) - arg_min(equity, timestamp), 4) AS pnl
  FROM w, m WHERE session_date + INTERVAL 17 HOUR <= latest - INTERVAL 1 HOUR GROUP BY 1, 2""", dates=("session_date",))
def l2(spark: SparkSession, d: str) -> DataFrame:
    return sunk(streams.stream_session_pnl(landed(v.equity_ticks(spark, d)))).withColumn("pnl", F.round("pnl", 4))


@register("L3_stream_trading_stats", """, e AS (SELECT asset, ts, event_id, price - 100 AS pnl FROM tk), m AS (SELECT max(ts) AS latest FROM e),
  r AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts DESC, event_id DESC) AS i FROM e)
  SELECT asset, 'total' AS kind, NULL::VARCHAR AS session_date, count(*) AS n, round(sum(pnl), 4) AS pnl, round(avg((pnl > 0)::INT), 9) AS win_rate, round(sum(pnl) FILTER (i <= 50), 6) AS recent_pnl, round(avg((pnl > 0)::INT) FILTER (i <= 50), 9) AS recent_win_rate FROM r GROUP BY 1
  UNION ALL SELECT asset, 'session', ts::DATE::VARCHAR, count(*), round(sum(pnl), 4), round(avg((pnl > 0)::INT), 9), NULL, NULL FROM e, m WHERE ts::DATE + INTERVAL 1 DAY <= latest - INTERVAL 1 HOUR GROUP BY asset, ts::DATE""")
def l3(spark: SparkSession, d: str) -> DataFrame:
    pnl = v.ticks(spark, d).select("asset", "ts", "event_id", (F.col("price") - 100).alias("pnl"))
    with streams.rocksdb_state(spark):
        out = sunk(streams.stream_trading_stats(landed(pnl)))
    last = out.groupBy("asset", "kind", "session_date").agg(F.max_by(F.struct("n", "pnl", "win_rate", "recent_pnl", "recent_win_rate"), "n").alias("x")).select("asset", "kind", F.col("session_date").cast("string").alias("session_date"), "x.*")
    return last.select("asset", "kind", "session_date", "n", F.round("pnl", 4).alias("pnl"), F.round("win_rate", 9).alias("win_rate"), F.round("recent_pnl", 6).alias("recent_pnl"), F.round("recent_win_rate", 9).alias("recent_win_rate"))


@register("L4_stream_enrich", """, s AS (SELECT asset, timestamp, score FROM sg WHERE score > 0), m AS (SELECT least((SELECT max(timestamp) FROM bu), (SELECT max(timestamp) FROM s)) - INTERVAL 10 MINUTE AS mark)
  SELECT asset, timestamp, close, score FROM bu LEFT JOIN s USING (asset, timestamp), m WHERE score IS NOT NULL OR timestamp <= mark""")
def l4(spark: SparkSession, d: str) -> DataFrame:
    bars, scores = v.bars_user(spark, d).select("asset", "timestamp", "close"), v.signals(spark, d).filter("score > 0")
    return sunk(streams.stream_enrich(landed(bars), landed(scores)))
