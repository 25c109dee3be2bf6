"""Cases of the findings of round 3: prices of 0, exact ties, curves that never fall."""

from collections import Counter
from datetime import datetime
from decimal import Decimal
from math import inf, isnan

import duckdb
from pyspark.sql import functions as F

from tapeloom.jobs.registry import QUERIES, SQL
from tapeloom.jobs.workload_queries import report
from tapeloom.operators import checks, equity, exits, ledger, orders, panel, signals, trades
from tapeloom.operators.joins import ieee

DAY = 86400


def t(day):
    return datetime(2024, 1, day)


def bars_of(spark, *rows):
    """Bars (day, open, high, low, close) of asset A."""
    return spark.createDataFrame([("A", t(d), *map(float, p)) for d, *p in rows], "asset string, timestamp timestamp_ntz, open double, high double, low double, close double")


def opened(spark, *rows):
    """Positions (id, side, day, price), open to the 30th."""
    return spark.createDataFrame([(i, "A", side, t(d), float(p), t(30)) for i, side, d, p in rows], "position_id string, asset string, side string, entry_time timestamp_ntz, entry_price double, until timestamp_ntz")


def free(spark):
    """A long and a short position at a price of 0, then a bar at 0 and one at 5."""
    return exits.position_bar_panel(opened(spark, ("l", "long", 1, 0), ("s", "short", 1, 0)), bars_of(spark, (1, 0, 0, 0, 0), (2, 0, 0, 0, 0), (3, 5, 5, 5, 5)), 5 * DAY)


def test_panel_at_a_price_of_zero(spark):
    got = {(r["position_id"], r["timestamp"].day): r["ret"] for r in free(spark).collect()}
    assert got["l", 3] == inf and got["s", 3] == -inf and isnan(got["l", 2]) and isnan(got["s", 2])


def test_tightening_trail_at_a_price_of_zero(spark):
    got = {r["position_id"]: r["exit_time"] for r in exits.first_exit(free(spark), exits.tightening_trail([(0.0, 0.6), (0.1, 0.4), (0.3, 0.2)])).collect()}
    assert got == {"l": t(2), "s": t(2)}


def test_scaled_exit_at_a_price_of_zero(spark):
    got = {(r["position_id"], r["target"], r["timestamp"].day) for r in exits.scaled_exits(free(spark), [(0.1, 0.5), (0.3, 0.5)]).collect()}
    assert got == {("l", 1, 2), ("l", 2, 3), ("s", 1, 2)}  # a return of 0 / 0 stands above every threshold, as in the SQL


def test_sweep_at_a_price_of_zero(spark):
    grid = spark.createDataFrame([("a", 0.1, 0.2, 0.9, 9)], "run_id string, stop double, target double, trail double, hold int")
    got = {r["position_id"]: (r["reason"], r["exit_price"], r["ret"]) for r in exits.exit_rule_sweep(free(spark).filter("timestamp > timestamp_ntz'2024-01-02'"), grid).collect()}
    assert got == {"l": ("take_profit", 5.0, inf), "s": ("stop_loss", 5.0, -inf)}


def test_late_assets_with_a_bar_at_zero(spark):
    bars = bars_of(spark, (1, 0, 0, 0, 0), (2, 1, 1, 1, 1), (3, 1, 1, 1, 1))
    days = lambda **how: [r["timestamp"].day for r in panel.late_asset_filter(bars, 2, **how).orderBy("timestamp").collect()]
    assert days(unpriced=True) == [2, 3] and days() == [3]


def test_position_size_at_a_price_of_zero(spark):
    prices = spark.createDataFrame([(0.0,), (3.0,), (9000.0,)], "p double")
    size = lambda **how: [r[0] for r in prices.orderBy("p").select(signals.position_size(F.lit(100.0), 0.1, F.col("p"), **how)).collect()]
    assert size(free=inf) == [inf, 3.0, None] and size() == [None, 3.0, None]


def test_bracket_of_equal_levels_is_not_inverted(spark):
    rows = [("zero", 0.0, 0.0), ("right", 6.0, 4.0), ("inverted", 4.0, 6.0)]
    todo = spark.createDataFrame([(i, "A", t(1), t(9), tp, sl) for i, tp, sl in rows], "order_id string, asset string, start timestamp_ntz, end timestamp_ntz, take_profit double, stop_loss double")
    got = {r["order_id"]: r["inverted"] for r in orders.resolve_brackets(todo, bars_of(spark, (1, 5, 9, 0, 5)), 5 * DAY).collect()}
    assert got == {"zero": False, "right": False, "inverted": True}


def test_trailing_stop_at_an_exact_tie(spark):
    """Where high - low and trail round apart from low and high - trail, the stop decides; a bar in doubt does not end the search."""
    cents = [(h / 100, low / 100, (h - low) / 100) for h in range(110, 500, 7) for low in range(3, 90, 5)]
    met = next(x for x in cents if x[0] - x[1] < x[2] and x[1] <= x[0] - x[2])
    missed = next(x for x in cents if x[0] - x[1] >= x[2] and x[1] > x[0] - x[2])
    for (high, low, trail), day in ((met, 2), (missed, 20)):
        bars = bars_of(spark, (1, high, high, high, high), (2, high, high, low, high), (20, high, high, 0, 0))
        todo = spark.createDataFrame([("o", "A", t(1), t(25), "sell", trail)], "order_id string, asset string, start timestamp_ntz, end timestamp_ntz, side string, trail double")
        got = orders.resolve_trailing_stop_orders(todo, bars, 5 * DAY).collect()
        assert [(r["fill_time"], r["fill_price"]) for r in got] == [(t(day), high - trail)]


def test_excursions_at_a_price_of_zero(spark):
    held = spark.createDataFrame([(i, "A", t(1), t(9), 0.0, q) for i, q in (("l", 1.0), ("s", -1.0))], "trade_id string, asset string, entry_time timestamp_ntz, exit_time timestamp_ntz, entry_price double, quantity double")
    bars = bars_of(spark, (1, 0, 0, 0, 0), (2, 5, 5, 5, 5))
    got = {r["trade_id"]: (r["mfe"], r["mae"]) for r in ledger.mfe_mae(held, bars, 5 * DAY, extremes=True, quotient=ieee).collect()}
    assert isnan(got["l"][0]) and got["l"][1] == 0.0 and isnan(got["s"][0]) and got["s"][1] == -inf
    assert {tuple(r) for r in ledger.mfe_mae(held, bars, 5 * DAY, extremes=True).select("mfe", "mae").collect()} == {(0.0, 0.0)}


def test_sweep_with_decimal_shares(spark):
    """Levels are those of the decimal shares, not of doubles such as 1 + (0.2 + k * 0.03)."""
    k = next(k for k in range(25) if 64 * (1 + (0.2 + k * 0.03)) > 64 * float(1 + (Decimal("0.2") + k * Decimal("0.03"))))
    share = Decimal("0.2") + k * Decimal("0.03")
    high = 64 * float(1 + share)
    seen = exits.position_bar_panel(opened(spark, ("l", "long", 1, 64)), bars_of(spark, (1, 64, 64, 64, 64), (2, 64, high, 64, 64)), 5 * DAY)
    one = spark.range(1).select(F.lit("a").alias("run_id"), F.lit(Decimal("0.9")).alias("stop"), F.lit(share).alias("target"), F.lit(Decimal("0.99")).alias("trail"), F.lit(99).alias("hold"))
    assert [r["reason"] for r in exits.exit_rule_sweep(seen, one).collect()] == ["take_profit"]


def rising(spark):
    """A curve that only rises and one with a single fall."""
    rows = [(run, t(d), e) for run, curve in (("up", (100, 110, 130, 135)), ("dip", (100, 110, 105, 120))) for d, e in enumerate(map(float, curve), 1)]
    return spark.createDataFrame(rows, "run_id string, timestamp timestamp_ntz, equity double")


def test_plain_metrics_of_a_curve_that_never_falls(spark):
    got = {r["run_id"]: r for r in equity.equity_metrics(rising(spark), plain=True).collect()}
    assert got["up"]["sortino"] is None and got["dip"]["sortino"] is None and got["up"]["sharpe"] > 0 and got["up"]["calmar"] == inf
    assert {r["sortino"] for r in equity.equity_metrics(rising(spark)).collect()} == {inf}


def test_plain_ratios_of_a_curve_that_never_falls(spark):
    got = {r["run_id"]: (r["sharpe"], r["sortino"]) for r in equity.annualised_ratios(rising(spark), 0.03, plain=True).collect()}
    assert got["up"][1] is None and got["dip"][1] is None and got["up"][0] > 0


def round_trips(spark):
    rows = [(run, f"{run}{i}", "long", i % 7 - 3.0, (i % 7 - 3) / 10, (i % 11) / 10, -(i % 5) / 10) for run, n in (("a", 40), ("b", 3)) for i in range(n)]
    out = spark.createDataFrame(rows, "run_id string, trade_id string, direction string, pnl double, pnl_percent double, mfe double, mae double")
    return out.withColumns({"status": F.lit("closed"), "exit_reason": F.lit("signal"), "symbol": F.col("run_id"), "entry_time": F.lit(t(1)).cast("timestamp_ntz"), "exit_time": F.lit(t(3)).cast("timestamp_ntz"),
        "entry_price": F.lit(10.0), "exit_price": F.lit(11.0), "quantity": F.lit(1.0), "multiplier": F.lit(1.0), "fees": F.lit(0.5), "slippage": F.lit(0.0), "entry_slippage": F.lit(0.0), "bars_held": F.lit(2)})


def reads_source(df):
    """Whether a DataFrame still reads the rows it was made from, instead of files."""
    return any(x in df._jdf.queryExecution().optimizedPlan().toString() for x in ("LogicalRDD", "LocalRelation", "ExistingRDD"))


def test_excursion_statistics_read_their_trades_once(spark):
    source = round_trips(spark)
    out = trades.mae_mfe_stats(source)
    assert reads_source(source) and not reads_source(out)
    sent, shuffled = ({tuple(r) for r in trades.exact_quantiles(source, ["run_id"], "mfe", {"low": 0.3, "high": 0.8}, small=small).collect()} for small in (True, False))
    assert sent == shuffled and {(r["run_id"], r["mfe_median"]) for r in out.collect()} == {("a", 0.45), ("b", 0.1)}


def test_exit_levels_read_their_trades_once(spark):
    out = trades.optimal_exit_levels(round_trips(spark), 80, 60)
    assert not reads_source(out) and {r["run_id"] for r in out.collect()} == {"a", "b"}


def test_check_of_trades_with_ends_of_their_own(spark):
    """Ends as aggregates of the trades give what a table of ends gives."""
    source = round_trips(spark)
    cash = F.max(F.when(F.col("run_id") != "b", 100.0))
    ends = [cash.alias("initial_cash"), (cash + F.sum("pnl")).alias("final_equity"), (F.count("*") * 0.01).alias("fill_costs")]
    table = source.groupBy("run_id").agg(*ends).filter("run_id != 'b'")
    one, two = ({tuple(r) for r in checks.check_trades(source, final=f).collect()} for f in (ends, table))
    assert one == two and {(r[0], r[-1]) for r in one} == {("a", 0), ("b", 1)}


def test_open_trades_from_their_last_fills(spark):
    rows = [("r", "1", "A", t(1), "buy", 5.0, 10.0), ("r", "2", "A", t(2), "sell", 2.0, 12.0), ("s", "3", "A", t(3), "buy", 1.0, 20.0), ("s", "4", "A", t(3), "sell", 1.0, 30.0), ("r", "5", "B", t(1), "sell", 1.0, 7.0)]
    fills = spark.createDataFrame(rows, "run_id string, order_id string, asset string, timestamp timestamp_ntz, side string, quantity double, price double").withColumns({"commission": F.lit(0.0), "slippage": F.lit(0.0)})
    got = {(r["run_id"], r["asset"]): (r["exit_time"], r["exit_price"], r["quantity"], r["pnl"]) for r in ledger.open_trades(ledger.fills_to_trades(fills)).collect()}
    assert got == {("r", "A"): (t(3), 30.0, 3.0, 60.0), ("r", "B"): (t(1), 7.0, -1.0, 0.0)}


def test_enriched_trades_carry_what_is_asked_for(spark):
    plan = QUERIES["H6_enrich_trades_with_signals"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    plan = " ".join(x for x in plan.splitlines() if "Relation [" not in x)
    assert "l_tax" not in plan and "l_returnflag" not in plan and "l_partkey" in plan


def test_report_over_whole_histories(spark, tmp_path):
    told = spark.createDataFrame([(s, t(d), x) for s, d, x in (("a", 1, 1.0), ("a", 2, 2.0), ("b", 2, 3.0))], "asset string, timestamp timestamp_ntz, momentum double")
    curve = spark.createDataFrame([(r, t(d), 100.0 + d) for r in "ab" for d in range(1, 5)], "run_id string, timestamp timestamp_ntz, equity double")
    one, two = ({tuple(map(str, r)) for r in report(round_trips(spark), told, curve, ["momentum"], None, f"{tmp_path}/{s}", seconds=s)["report"].collect()} for s in (None, 86400))
    assert one == two and len(one) == 2


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over sf0.001, with tables of DuckDB's SQL in place of some, each row with its count."""
    con, given = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("nation", "customer", "part", "orders", "lineitem", "events"):
        con.sql(f"create view {t}_given as from '{given}/{t}.parquet'")
        con.sql(f"copy ({tables.get(t, f'from {t}_given')}) to '{folder}/{t}.parquet' (format parquet)")
        con.sql(f"create view {t} as from '{folder}/{t}.parquet'")
    sql = con.sql(SQL[name])
    got = QUERIES[name](spark, str(folder)).select(*sql.columns).collect()
    return Counter(map(tuple, got)), Counter(sql.fetchall())


#: Events of value 0 on every third day of half the users, long and short ones.
FREE = "select * replace (case when user_id % 4 < 2 and day(ts) % 3 = 1 then 0.0 else value end as value) from events_given"


def test_tightening_trail_query_with_bars_at_zero(spark, tmp_path):
    got, sql = both(spark, tmp_path, "G5_tightening_trail", events=FREE)
    assert got == sql and len(got) > 100


def test_scaled_exit_query_with_bars_at_zero(spark, tmp_path):
    got, sql = both(spark, tmp_path, "G6_scaled_exit", events=FREE)
    assert got == sql and len(got) > 100


def test_excursion_queries_shuffle_few_columns(spark, monkeypatch):
    """Returns are worked out of lines and parts before these meet orders; prices do not go through that join."""
    seen = []
    monkeypatch.setattr(trades, "stored", lambda df: seen.append(df) or df)
    for name, told in (("H4_mae_mfe_stats", ("pnl_percent", "slippage")), ("H5_optimal_exit_levels", ("mfe", "mae"))):
        QUERIES[name](spark, "/root/testdata/sf0.001")
        plan = seen[-1]._jdf.queryExecution().optimizedPlan().toString().splitlines()
        at = next(i for i, x in enumerate(plan) if "Join Inner" in x)  # the outermost
        assert "o_orderkey" in plan[at] and all(f" AS {c}#" in plan[at + 1] for c in told)


def test_excursion_queries_with_a_quantity_of_zero(spark, tmp_path):
    """Lines without a quantity, of which some are no closed round trips, stop nothing; quotients are the SQL's."""
    none = "select * replace (case when l_orderkey % 50 = 0 and l_linenumber in (2, 7) then 0.0 else l_quantity end as l_quantity) from lineitem_given"
    for name in ("H4_mae_mfe_stats", "H5_optimal_exit_levels"):
        got, sql = both(spark, tmp_path, name, lineitem=none)
        assert len(got) == 5 and {tuple(map(str, r)) for r in got} == {tuple(map(str, r)) for r in sql}
