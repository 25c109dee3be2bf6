"""Hand-computed values on small frames, and streams against their batch twins."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import equity, exits, joins, ledger, panel, sessions, signals, trades
from tapeloom.streaming import streams


def t(s):
    return dt.datetime.fromisoformat(s)


BAR = "timestamp timestamp_ntz, asset string, open double, high double, low double, close double, volume double"


def test_resolve_entity_and_defaults(spark):
    df = spark.createDataFrame([("A", 1.0)], "ticker string, close double")
    out = panel.normalize_ohlcv(panel.resolve_entity(df)).first()
    assert (out["asset"], out["open"], out["volume"]) == ("A", 1.0, 0.0)
    with pytest.raises(ValueError):
        panel.resolve_entity(df.drop("ticker"))


def test_asof_enrichment(spark):
    s = spark.createDataFrame([(t("2024-01-01 10:00"), 0.5), (t("2024-01-01 12:00"), 0.6), (t("2024-01-01 14:00"), 0.7), (t("2024-01-02 10:00"), 0.3), (t("2024-01-02 16:00"), 0.2)], "timestamp timestamp_ntz, momentum double")
    tr = spark.createDataFrame([("AAPL", t("2024-01-01 10:00"), t("2024-01-01 14:00")), ("AAPL", t("2024-01-02 10:00"), t("2024-01-02 15:00")), ("MSFT", t("2023-12-31 00:00"), t("2024-01-01 11:00"))], "symbol string, entry_time timestamp_ntz, exit_time timestamp_ntz")
    got = {(r["symbol"], r["entry_time"]): (r["entry_momentum"], r["exit_momentum"]) for r in trades.enrich_trades_with_signals(tr, s, ["momentum"], asset=None).collect()}
    assert got == {("AAPL", t("2024-01-01 10:00")): (0.5, 0.7), ("AAPL", t("2024-01-02 10:00")): (0.3, 0.3), ("MSFT", t("2023-12-31 00:00")): (None, 0.5)}


def test_sessions_of_evening_start(spark):
    rows = [("01-08 18:00", 100000.0), ("01-08 20:00", 100100.0), ("01-09 08:00", 100200.0), ("01-09 18:00", 100300.0), ("01-09 20:00", 100500.0)]
    curve = spark.createDataFrame([("r", t(f"2024-{a}"), e) for a, e in rows], "run_id string, timestamp timestamp_ntz, equity double")
    out = sessions.session_pnl(curve, sessions.session_date(F.col("timestamp"), "CME_Equity")).orderBy("session_date").collect()
    assert [(str(r["session_date"]), r["pnl"], r["num_bars"]) for r in out] == [("2024-01-09", 200.0, 3), ("2024-01-10", 200.0, 2)]


def test_drawdown_of_empty_and_short_curves(spark):
    curve = spark.createDataFrame([("r", t(f"2024-01-0{i + 1}"), e) for i, e in enumerate([100.0, 120.0, 90.0, 130.0])], "run_id string, timestamp timestamp_ntz, equity double")
    r = equity.max_drawdown(curve).first()
    assert (round(r["max_drawdown"], 9), r["trough"], r["peak"]) == (-0.25, t("2024-01-03"), t("2024-01-02"))
    assert equity.equity_metrics(curve.limit(0)).count() == 0


def fold(fills):
    """Plain average-cost fold."""
    out, held, entry, fee, first, partial = [], 0.0, 0.0, 0.0, 0.0, 0.0
    for q, p, c in fills:
        while q:
            if held == 0 or held * q > 0:
                entry, fee, first, held, q = (entry * abs(held) + p * abs(q)) / (abs(held) + abs(q)), fee + c, first or abs(q), held + q, 0
            elif abs(q) < abs(held):
                held, q = held + q, 0
            else:
                share = abs(held) / abs(q)
                out.append((held, round((p - entry) * held - fee - c * share, 6)))
                q, c, held, entry, fee, first = q + held, c * (1 - share), 0.0, 0.0, 0.0, 0.0
    return out


def test_fills_to_trades_against_a_plain_fold(spark):
    import random

    random.seed(5)
    fills = [(random.choice([-1, 1]) * random.randint(1, 5), random.randint(90, 110) * 1.0, 0.5) for _ in range(60)]
    rows = [("r", f"{i:03d}", "A", t("2024-01-01") + dt.timedelta(days=i), "buy" if q > 0 else "sell", float(abs(q)), p, c, 0.0) for i, (q, p, c) in enumerate(fills)]
    df = spark.createDataFrame(rows, "run_id string, order_id string, asset string, timestamp timestamp_ntz, side string, quantity double, price double, commission double, slippage double")
    got = [(r["quantity"], round(r["pnl"], 6)) for r in ledger.fills_to_trades(df).filter("not is_open").orderBy("episode").collect()]
    assert got == fold(fills)


@pytest.mark.parametrize("direction", ["long", "short"])
@pytest.mark.parametrize("prices", [(100.0, 110.0), (100.0, 90.0), (50.0, 75.0)])
def test_round_trip(spark, direction, prices):
    bars = spark.createDataFrame([(t("2024-01-01"), "A", prices[0], True, False), (t("2024-01-02"), "A", prices[1], False, True), (t("2024-01-03"), "A", prices[1], False, False)], "timestamp timestamp_ntz, asset string, close double, enter boolean, exit boolean").withColumn("open", F.col("close"))
    r = signals.signals_to_round_trips(bars, direction, 100.0, 0.001, 0.0, next_bar=False).first()
    gross = (prices[1] - prices[0]) * 100 * (1 if direction == "long" else -1)
    assert r["gross_pnl"] == pytest.approx(gross) and r["net_pnl"] == pytest.approx(gross - sum(prices) * 0.1)


def test_stop_fills_at_the_open_on_a_gap(spark):
    bars = spark.createDataFrame([(t("2024-01-01"), "A", 100.0, 101.0, 99.0, 100.0, 1.0), (t("2024-01-02"), "A", 90.0, 92.0, 88.0, 91.0, 1.0)], BAR)
    entries = spark.createDataFrame([("p", "A", "long", t("2024-01-01"), 100.0, t("2024-01-05"))], "position_id string, asset string, side string, entry_time timestamp_ntz, entry_price double, until timestamp_ntz")
    r = exits.first_exit(exits.position_bar_panel(entries, bars, 86400), exits.stop_loss(0.05)).first()
    assert (r["reason"], r["price"]) == ("stop_loss", 90.0)


def test_blocked_sum_equals_a_window(spark):
    df = spark.range(100).select(F.lit("r").alias("run_id"), F.col("id").cast("int").alias("i"), (F.col("id") % 7).cast("double").alias("x"))
    out = joins.blocked_sum(df, ["run_id"], F.floor(F.col("i") / 9), ["i"], "x", "total").orderBy("i").collect()
    run = 0.0
    for r in out:
        run += r["x"]
        assert r["total"] == run


def _run(spark, rows, schema, make, name, tmp_path, mode="append"):
    src = tmp_path / "in"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(src / f"b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_stream_bars_match_batch(spark, tmp_path):
    schema = "asset string, ts timestamp, event_id long, price double, size double"
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [[("A", at(1), 1, 10.0, 1.0), ("A", at(5), 2, 12.0, 1.0)], [("A", at(16), 3, 11.0, 1.0)], [("A", at(59), 4, 9.0, 2.0)], [("A", dt.datetime(2024, 1, 1, 3, 0), 5, 9.0, 2.0)]]
    got = {r["timestamp"]: (r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in _run(spark, rows, schema, streams.stream_bars, "bars_out", tmp_path).collect()}
    assert got[dt.datetime(2024, 1, 1, 0, 0)] == (10.0, 12.0, 10.0, 12.0, 2.0) and got[dt.datetime(2024, 1, 1, 0, 15)] == (11.0, 11.0, 11.0, 11.0, 1.0)


def test_stream_session_pnl_matches_batch(spark, tmp_path):
    schema = "run_id string, timestamp timestamp, equity double"
    at = [dt.datetime(2024, 1, 8, 18), dt.datetime(2024, 1, 8, 20), dt.datetime(2024, 1, 9, 8), dt.datetime(2024, 1, 9, 18), dt.datetime(2024, 1, 9, 20), dt.datetime(2024, 1, 12, 1)]
    rows = [[("r", a, 100000.0 + 100 * i)] for i, a in enumerate(at)]
    got = {str(r["session_date"]): (r["pnl"], r["num_bars"]) for r in _run(spark, rows, schema, streams.stream_session_pnl, "pnl_out", tmp_path).collect()}
    curve = spark.createDataFrame([x for part in rows for x in part], schema).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    batch = {str(r["session_date"]): (r["pnl"], r["num_bars"]) for r in sessions.session_pnl(curve, sessions.session_date(F.col("timestamp"), "CME_Equity")).collect()}
    assert got == {k: x for k, x in batch.items() if k < "2024-01-12"} and len(got) == 2


def test_stream_enrich_matches_batch(spark, tmp_path):
    schema = "asset string, timestamp timestamp, close double, score double"
    at = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [[("A", at(1), 1.0, 0.5), ("B", at(1), 2.0, None)], [("A", at(2), 3.0, 0.7)], [("A", at(9), 9.0, 0.9)], [("A", at(20), 9.0, 0.9)]]
    make = lambda s: streams.stream_enrich(s.select("asset", "timestamp", "close"), s.filter("score is not null").select("asset", "timestamp", "score"))
    got = {(r["asset"], r["timestamp"]): (r["close"], r["score"]) for r in _run(spark, rows, schema, make, "rich_out", tmp_path).collect()}
    assert got[("A", at(1))] == (1.0, 0.5) and got[("A", at(2))] == (3.0, 0.7) and got[("B", at(1))] == (2.0, None)


def test_made_schedules_serve_the_operators_of_schedules(spark):
    plan = sessions.build_schedule(spark, "2024-01-02", "2024-01-03", "09:30:00", "16:00:00", "America/New_York", breaks=("12:00:00", "13:00:00"))
    bars = spark.createDataFrame([(t("2024-01-02 14:30"), 1), (t("2024-01-02 17:30"), 2), (t("2024-01-02 21:00"), 3), (t("2024-01-04 15:00"), 4)], "timestamp timestamp_ntz, i int")
    assert {r["i"] for r in sessions.flag_market_open(bars, plan).filter("is_open").collect()} == {1}
    whole = sessions.build_schedule(spark, "2024-01-02", "2024-01-03", "09:30:00", "16:00:00", "America/New_York")
    assert {r["i"] for r in sessions.flag_market_open(bars, whole).filter("is_open").collect()} == {1, 2}
    assert sessions.filter_to_trading_sessions(bars, plan).count() == 1 and sessions.trading_minutes(plan, "1h").count() > 0


def test_calendars_by_their_names(spark):
    row = spark.range(1).select(F.lit("2024-01-08 18:00").cast("timestamp_ntz").alias("t"))
    assert [str(row.select(sessions.session_date(F.col("t"), c)).first()[0]) for c in ("CME_Equity", "CBOT", "NYMEX", "elsewhere")] == ["2024-01-09", "2024-01-09", "2024-01-09", "2024-01-08"]
    assert [row.select(sessions.annualization_factor(F.lit(c), F.lit(255))).first()[0] for c in ("XETRA", "tsx", "CRYPTO", "none")] == [252, 252, 365, 255]


def test_entry_alone_counts_when_flat_and_exit_alone_when_holding(spark):
    import random

    rng = random.Random(3)
    flags = [(rng.random() < 0.5, rng.random() < 0.5) for _ in range(60)]
    bars = spark.createDataFrame([(t("2024-01-01") + dt.timedelta(days=i), "A", 100.0 + i, a, b) for i, (a, b) in enumerate(flags)], "timestamp timestamp_ntz, asset string, close double, enter boolean, exit boolean").withColumn("open", F.col("close"))
    want, since = [], None
    for i, (a, b) in enumerate(flags):
        if since is None:
            since = i if a else None
        elif b:
            want.append((100.0 + since, 100.0 + i))
            since = None
    got = signals.signals_to_round_trips(bars, "long", 1.0, 0.0, 0.0, next_bar=False).orderBy("entry_time").collect()
    assert [(r["entry_price"], r["exit_price"]) for r in got] == want


def test_reports_tell_when_rows_are_missing(spark):
    from tapeloom.sources import results

    bars = spark.createDataFrame([(t("2024-01-01"), "A", 1.0)], "timestamp timestamp_ntz, asset string, close double")
    for call in (lambda: panel.top_coverage_assets(bars, 2), lambda: panel.last_n_sessions(bars, 2)):
        with pytest.raises(ValueError):
            call()
    metrics, params = spark.createDataFrame([("a", 1.0)], "run_id string, sharpe double"), spark.createDataFrame([("a",), ("b",)], "run_id string")
    with pytest.raises(ValueError):
        results.sweep_summary(metrics, params)


def test_a_run_adds_up(spark, tmp_path):
    from tapeloom.jobs import research_run
    from tapeloom.operators import checks

    rng = __import__("random").Random(8)
    rows = [(t("2024-01-01") + dt.timedelta(days=d), f"A{a}", *([100.0 + rng.random() * 10] * 4), 1.0, rng.random()) for d in range(12) for a in range(6) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, BAR + ", score double")
    out = research_run.research_run(df.drop("score"), df.select("asset", "timestamp", "score"), 2, 2, 0.001, 0.0005, 1e5, path=str(tmp_path / "run"))
    m = out["metrics"].first()
    assert m["final"] - 1e5 == pytest.approx(m["total_pnl"], abs=1e-6) and m["num_fills"] > 10
    kinds = out["fills"].withColumns({"order_type": F.lit(""), "limit_price": F.lit(None).cast("double"), "stop_price": F.lit(None).cast("double")})
    assert checks.check_fills(kinds, ["timestamp", "order_id"], F.to_date("timestamp")).first()["out_of_order"] == 0
    assert spark.read.parquet(str(tmp_path / "run" / "fills")).count() == m["num_fills"]
