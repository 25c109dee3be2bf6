"""Streams through files, sinks and checkpoints: restarts, state, timers and late rows."""

import datetime as dt

from pyspark.sql import functions as F

from tapeloom.streaming import streams

TICK = "asset string, ts timestamp, event_id long, price double, size double"
EVENT = "asset string, ts timestamp, event_id long, pnl double"


def at(day, hour=0, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


def land(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path / "in" / name))


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(path / "in"))


def go(make, spark, path, schema):
    return streams.run_available(make(source(spark, path, schema)), str(path / "out"), str(path / "checkpoint"))


def test_bars_go_on_from_the_checkpoint(spark, tmp_path):
    land(spark, tmp_path, "a", [("A", at(1, 0, 1), 1, 10.0, 1.0), ("A", at(1, 0, 14), 2, 12.0, 1.0), ("A", at(1, 1, 0), 3, 11.0, 1.0)], TICK)
    first = go(streams.stream_bars, spark, tmp_path, TICK).collect()
    assert [(r["timestamp"], r["open"], r["close"]) for r in first] == [(at(1), 10.0, 12.0)]
    # the window of 01:00 is open in the state; one row comes late, within the delay for none of the closed windows
    land(spark, tmp_path, "b", [("A", at(1, 1, 5), 4, 15.0, 2.0), ("A", at(1, 0, 2), 5, 99.0, 1.0), ("A", at(1, 3, 0), 6, 9.0, 1.0)], TICK)
    second = go(streams.stream_bars, spark, tmp_path, TICK).orderBy("timestamp").collect()
    assert [(r["timestamp"], r["open"], r["high"], r["close"], r["volume"]) for r in second] == [(at(1), 10.0, 12.0, 12.0, 2.0), (at(1, 1), 11.0, 15.0, 15.0, 3.0)]
    assert go(streams.stream_bars, spark, tmp_path, TICK).count() == 2  # nothing new, nothing twice


def test_statistics_keep_windows_sessions_and_timers_over_a_restart(spark, tmp_path):
    make = lambda s: streams.stream_trading_stats(s, window=3)
    with streams.rocksdb_state(spark):
        land(spark, tmp_path, "a", [("A", at(1, 10), 1, 5.0), ("A", at(1, 9), 2, -1.0), ("B", at(1, 12), 3, 2.0), ("A", at(2, 8), 4, 4.0)], EVENT)
        first = go(make, spark, tmp_path, EVENT)
        assert {(r["asset"], r["n"], r["pnl"], r["recent_pnl"]) for r in first.filter("kind = 'total'").collect()} == {("A", 3, 8.0, 8.0), ("B", 1, 2.0, 2.0)}
        assert {(r["asset"], str(r["session_date"]), r["n"], r["pnl"], r["win_rate"]) for r in first.filter("kind = 'session'").collect()} == {("A", "2024-01-01", 2, 4.0, 0.5), ("B", "2024-01-01", 1, 2.0, 1.0)}
        land(spark, tmp_path, "b", [("A", at(2, 9), 5, -2.0), ("A", at(3, 9), 6, 7.0), ("A", at(1, 23), 7, 50.0)], EVENT)  # the last one is later than its session's end
        second = go(make, spark, tmp_path, EVENT)
    last = second.filter("kind = 'total' and asset = 'A'").orderBy(F.desc("n")).first()
    assert last["n"] in (5, 6) and last["recent_pnl"] == (4.0 - 2.0 + 7.0 if last["n"] == 5 else -2.0 + 7.0 + 50.0)
    sessions = {(r["asset"], str(r["session_date"]), r["n"], r["pnl"]) for r in second.filter("kind = 'session'").collect()}
    assert sessions == {("A", "2024-01-01", 2, 4.0), ("B", "2024-01-01", 1, 2.0), ("A", "2024-01-02", 2, 2.0)}
    name = "spark.sql.streaming.stateStore.providerClass"
    assert "RocksDB" not in spark.conf.get(name)


def test_enrichment_waits_for_the_watermark(spark, tmp_path):
    bar, signal = "asset string, timestamp timestamp, close double", "asset string, timestamp timestamp, score double"
    for d, n in (("bars", "a"), ("signals", "a")):
        (tmp_path / d).mkdir()
    spark.createDataFrame([("A", at(1), 1.0), ("B", at(1), 2.0), ("A", at(2), 3.0)], bar).write.parquet(str(tmp_path / "bars" / "a"))
    spark.createDataFrame([("A", at(1), 0.5), ("A", at(2), 0.6)], signal).write.parquet(str(tmp_path / "signals" / "a"))
    read = lambda name, schema: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / name))
    out = streams.run_available(streams.stream_enrich(read("bars", bar), read("signals", signal)), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {(r["asset"], r["timestamp"], r["score"]) for r in out.collect()} == {("A", at(1), 0.5), ("A", at(2), 0.6), ("B", at(1), None)}
