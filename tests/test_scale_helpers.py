"""Towers, blocked scans, bucketed as-of joins, folds and numbering against plain versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeloom.operators import exits, joins, ledger, orders, panel, risk, signals, towers, trades

T0 = dt.datetime(2020, 1, 1)
DAY = 86400
BAR = "asset string, timestamp timestamp_ntz, open double, high double, low double, close double"


def day(n):
    return T0 + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def walk():
    """Two assets of six years with gaps, a null price and repeated prices."""
    r = random.Random(11)
    rows = []
    for asset in ("A", "B"):
        p = 100.0
        for n in range(2200):
            if r.random() < 0.1:
                continue
            o = round(p * r.uniform(0.98, 1.02), 2)
            c = round(o * r.uniform(0.97, 1.031), 2)
            rows.append((asset, day(n), o, round(max(o, c) * r.uniform(1, 1.02), 2), round(min(o, c) * r.uniform(0.98, 1), 2), c))
            p = min(max(c, 20.0), 500.0)
    return rows


@pytest.fixture(scope="module")
def bars(spark, walk):
    return spark.createDataFrame(walk, BAR).repartition(4)


@pytest.fixture(scope="module")
def spans(walk):
    """Spans of a day to six years, some from before the first bar, past the last, of an unknown asset, or turned round."""
    r = random.Random(12)
    out = []
    for i in range(150):
        a = r.randrange(-20, 2150)
        out.append((f"o{i}", r.choice("AB"), day(a), day(a + r.choice([0, 1, 3, 40, 400, 2500]))))
    return [*out, ("x", "C", day(0), day(900)), ("y", "A", day(50), day(40))]


def lived(walk, asset, start, end):
    return [b for b in walk if b[0] == asset and start <= b[1] <= end]


def test_first_touch_over_long_lives(spark, walk, bars, spans):
    r = random.Random(13)
    rows, want = [], set()
    for key, asset, start, end in spans:
        kind, side, level = r.choice(["limit", "stop"]), r.choice(["buy", "sell"]), round(r.uniform(20, 400), 2)
        rows.append((key, asset, start, end, kind, side, level))
        up = (kind == "stop") == (side == "buy")
        hit = next((b for b in lived(walk, asset, start, end) if (b[3] >= level if up else b[4] <= level)), None)
        if hit:
            want.add((key, hit[1], level if kind == "limit" else max(hit[2], level) if side == "buy" else min(hit[2], level)))
    todo = spark.createDataFrame(rows, "order_id string, asset string, start timestamp_ntz, end timestamp_ntz, kind string, side string, level double")
    got = orders.resolve_limit_stop_orders(todo, bars, 7 * DAY).select("order_id", "fill_time", "fill_price").collect()
    assert {tuple(x) for x in got} == want and len(want) > 60


def test_trailing_touch_over_long_lives(spark, walk, bars, spans):
    r = random.Random(14)
    rows, want = [], {}
    for key, asset, start, end in spans:
        side, trail = r.choice(["buy", "sell"]), r.choice([2.0, 10.0, 60.0, 150.0])
        rows.append((key, asset, start, end, side, trail))
        mark = None
        for b in lived(walk, asset, start, end):
            if side == "sell":
                mark = b[3] if mark is None else max(mark, b[3])
                stop, hit = mark - trail, mark - b[4] >= trail
            else:
                mark = b[4] if mark is None else min(mark, b[4])
                stop, hit = mark + trail, b[3] - mark >= trail
            if hit:
                want[key] = (b[1], min(b[2], stop) if side == "sell" else max(b[2], stop))
                break
    todo = spark.createDataFrame(rows, "order_id string, asset string, start timestamp_ntz, end timestamp_ntz, side string, trail double")
    got = {x[0]: (x[1], x[2]) for x in orders.resolve_trailing_stop_orders(todo, bars, 7 * DAY).select("order_id", "fill_time", "fill_price").collect()}
    assert got.keys() == want.keys() and len(want) > 60
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_range_extremes_over_long_lives(spark, walk, bars, spans):
    held = [(k, a, s, e, 100.0, 1.0) for k, a, s, e in spans]
    held_trades = spark.createDataFrame(held, "trade_id string, asset string, entry_time timestamp_ntz, exit_time timestamp_ntz, entry_price double, quantity double")
    got = {x["trade_id"]: (x["mfe"], x["mae"]) for x in ledger.mfe_mae(held_trades, bars, 7 * DAY, extremes=True).collect()}
    for key, asset, start, end, _, _ in held:
        seen = [b for b in lived(walk, asset, start, end) if b[1] < end]
        high, low = [b[5] if b[1] == start else b[3] for b in seen], [b[5] if b[1] == start else b[4] for b in seen]
        assert got[key] == pytest.approx((max([0.0, *(h / 100 - 1 for h in high)]), min([0.0, *(x / 100 - 1 for x in low)])))


def test_a_long_life_meets_few_rows(spark):
    """Spans of 1 to 4,000 days: the rows that a search joins do not grow with the span."""
    at = lambda n: F.lit(day(n)).cast("timestamp_ntz")
    sizes = spark.range(1).select(*(F.size(towers.pieces(at(3), at(3 + n), 5 * DAY)).alias(f"n{n}") for n in (1, 10, 100, 1000, 4000))).first()
    assert max(sizes) <= 2 * towers.LEVELS + 1 and sizes["n1"] <= 2


def test_touch_exits_equal_the_panel(spark, bars, spans):
    entries = [(k, a, random.Random(k).choice(["long", "short"]), s, 100.0, e) for k, a, s, e in spans if s < e and (e - s).days < 500]
    opened = spark.createDataFrame(entries, "position_id string, asset string, side string, entry_time timestamp_ntz, entry_price double, until timestamp_ntz")
    seen = exits.position_bar_panel(opened, bars, 30 * DAY)
    # the panel's gap rule fills at the close where the level is outside of the bar, which a touched bar's level never is unless it gapped
    want = exits.first_exit(seen, exits.stop_loss(0.3), exits.take_profit(0.4))
    got = exits.touch_exits(opened, bars, 0.3, 0.4, 7 * DAY)
    assert {tuple(x) for x in got.collect()} == {tuple(x) for x in want.collect()} and got.count() > 30


def test_sweep_by_records_equals_all_bars(spark, bars, spans):
    entries = [(k, a, random.Random(k).choice(["long", "short"]), s, 100.0, e) for k, a, s, e in spans if s < e and (e - s).days < 500]
    opened = spark.createDataFrame(entries, "position_id string, asset string, side string, entry_time timestamp_ntz, entry_price double, until timestamp_ntz")
    seen = exits.position_bar_panel(opened, bars, 30 * DAY)
    grid = [("a", 0.1, 0.2, 0.15, 20), ("b", 0.5, 0.9, 0.3, 300), ("c", 0.02, 0.9, 0.5, 2), ("d", 9.0, 9.0, 0.05, 10**6)]
    got = {(x["run_id"], x["position_id"]): (x["exit_time"], x["reason"]) for x in exits.exit_rule_sweep(seen, spark.createDataFrame(grid, "run_id string, stop double, target double, trail double, hold int")).collect()}
    want = {}
    for run, stop, target, trail, hold in grid:
        for x in exits.first_exit(seen, exits.stop_loss(stop), exits.take_profit(target), exits.trailing_stop(trail), exits.time_exit(hold)).collect():
            want[run, x["position_id"]] = (x["exit_time"], x["reason"])
    assert got == want and len(want) > 200


@pytest.mark.parametrize("ahead", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_in_buckets(spark, ahead, strict):
    r = random.Random(15)
    build = [(r.choice("AB"), n, float(n)) for n in range(0, 3000, 3) if r.random() < 0.05]
    probe = [(r.choice("ABC"), r.randrange(-50, 3100), i) for i in range(300)]
    b = spark.createDataFrame([(a, day(n), x) for a, n, x in {(a, n): (a, n, x) for a, n, x in build}.values()], "asset string, at timestamp_ntz, x double")
    p = spark.createDataFrame([(a, day(n), i) for a, n, i in probe], "asset string, t timestamp_ntz, i int")
    got = {x["i"]: x["x"] for x in joins.asof_join(p, b, ["asset"], "t", "at", ["x"], seconds=100 * DAY, ahead=ahead, strict=strict).collect()}
    plain = {x["i"]: x["x"] for x in joins.asof_join(p, b, ["asset"], "t", "at", ["x"], ahead=ahead, strict=strict).collect()}
    for a, n, i in probe:
        ok = [m for c, m, _ in build if c == a and (m == n and not strict or (m > n if ahead else m < n))]
        assert got[i] == plain[i] == (float(min(ok) if ahead else max(ok)) if ok else None)


def test_scans_equal_windows(spark):
    r = random.Random(16)
    rows = [(r.choice("ab"), day(n), r.choice([None, r.uniform(-5, 5)])) for n in range(400)]
    df = spark.createDataFrame(rows, "run_id string, timestamp timestamp_ntz, x double")
    x = F.col("x")
    got = joins.scanned(df, ["run_id"], joins.bucket(F.col("timestamp"), 17 * DAY), ["timestamp"], s=("sum", F.coalesce(x, F.lit(0.0))), n=("count", x), hi=("max", x), lo=("min", x), first=("first", x), last=("last", x))
    run = W.partitionBy("run_id").orderBy("timestamp").rowsBetween(W.unboundedPreceding, 0)
    want = df.withColumns({"s": F.sum(F.coalesce(x, F.lit(0.0))).over(run), "n": F.count(x).over(run), "hi": F.max(x).over(run), "lo": F.min(x).over(run), "first": F.first(x, True).over(run), "last": F.last(x, True).over(run)})
    for g, w in zip(got.orderBy("timestamp").collect(), want.orderBy("timestamp").collect(), strict=True):
        assert g["s"] == pytest.approx(w["s"]) and all(g[c] == w[c] for c in ("run_id", "n", "hi", "lo", "first", "last"))


def test_densify_and_timeline(spark):
    r = random.Random(17)
    rows = [(a, day(n), float(n)) for n in range(0, 900, 2) for a in "abc" if r.random() < 0.02 or n == 500]
    df = spark.createDataFrame(rows, "asset string, timestamp timestamp_ntz, close double")
    stamps, have = sorted({t for _, t, _ in rows}), {(a, t): x for a, t, x in rows}
    want = set()
    for a in "abc":
        for t in stamps:
            before, behind = [s for s in stamps if (a, s) in have and s <= t], [s for s in stamps if (a, s) in have and s >= t]
            want.add((t, a, have[a, before[-1]] if before else have[a, behind[0]]))
    assert {tuple(x) for x in panel.densify_panel(df).collect()} == want
    line = panel.timeline(df)
    assert [(x["timestamp"], x["bar"], x["n_bars"]) for x in line.orderBy("bar").collect()] == [(t, i + 1, len(stamps)) for i, t in enumerate(stamps)]


def test_blocked_states(spark):
    rows = [("r", day(n), 100.0 + (n * 37) % 61 - n / 50) for n in range(500)]
    curve = spark.createDataFrame(rows, "run_id string, timestamp timestamp_ntz, equity double")
    assert {tuple(x) for x in signals.drawdown_sizing(curve, 20 * DAY).collect()} == {tuple(x) for x in signals.drawdown_sizing(curve, 10**5 * DAY).collect()}
    flags = spark.createDataFrame([("r", day(n), "max_drawdown" if n % 2 else "loss", "halt" if n in (77, 200) else "warn" if n % 9 == 0 else "none") for n in range(400)], "run_id string, timestamp timestamp_ntz, limit string, action string")
    got = {x["timestamp"]: (x["halted"], x["halt_reason"]) for x in risk.halt_timeline(flags, 30 * DAY).collect()}
    assert got[day(76)] == (False, None) and got[day(77)] == (True, "max_drawdown") and got[day(399)] == (True, "loss")


@pytest.mark.parametrize("size", [3, 1000])
def test_folds_over_blocks(spark, size):
    """Average cost of long episodes, folded block by block, against one plain fold: scale-ins, partial exits, closings and flips."""
    r = random.Random(18)
    rows, held = [], 0.0
    for i in range(400):
        q = r.choice([1, 1, 1, 2, 3, -1, -1, -2]) if i % 90 < 80 else -held if held and i % 90 == 80 else r.choice([-1, 1]) * 4
        held += q
        rows.append((q, round(r.uniform(90, 110), 2), round(r.uniform(0, 1), 2)))
    schema = "run_id string, order_id string, asset string, timestamp timestamp_ntz, side string, quantity double, price double, commission double, slippage double"
    fills = spark.createDataFrame([("r", f"{i:04d}", "A", day(i), "buy" if q > 0 else "sell", float(abs(q)), p, c, 0.0) for i, (q, p, c) in enumerate(rows)], schema)
    got = [tuple(x) for x in ledger.fills_to_trades(fills, size).orderBy("episode").select("quantity", "entry_price", "pnl", "partial_pnl", "n_partial", "fees", "entry_time").collect()]
    want, state = [], None

    def close(s, p, c):
        return (s["held"], s["entry"], (p - s["entry"]) * s["held"] - s["fee"] - c, s["partial"], s["n"], s["fee"] + c, s["at"])

    for i, (q, p, c) in enumerate(rows):
        if state is None:
            state = {"held": q, "entry": p, "fee": c, "first": abs(q), "partial": 0.0, "n": 0, "at": day(i)}
        elif state["held"] * q > 0:
            state["entry"] = (state["entry"] * abs(state["held"]) + p * abs(q)) / (abs(state["held"]) + abs(q))
            state["held"], state["fee"] = state["held"] + q, state["fee"] + c
        elif abs(q) < abs(state["held"]):
            side = 1 if state["held"] > 0 else -1
            state["partial"] += side * (p - state["entry"]) * abs(q) - state["fee"] * abs(q) / state["first"] - c
            state["held"], state["n"] = state["held"] + q, state["n"] + 1
        else:
            share = abs(state["held"]) / abs(q)
            want.append(close(state, p, c * share))
            left = state["held"] + q
            state = {"held": left, "entry": p, "fee": c * (1 - share), "first": abs(left), "partial": 0.0, "n": 0, "at": day(i)} if left else None
    if state:
        want.append((state["held"], state["entry"], None, state["partial"], state["n"], state["fee"], state["at"]))
    assert len(got) == len(want) > 5
    for g, w in zip(got, want, strict=True):
        assert g[:2] == pytest.approx(w[:2]) and g[3:6] == pytest.approx(w[3:6]) and g[6] == w[6] and (g[2] == pytest.approx(w[2]) if w[2] is not None else g[2] is None)


@pytest.mark.parametrize("bins", [1, 7, 4096])
def test_exact_quantiles(spark, bins):
    r = random.Random(19)
    rows = [(g, v) for g, many in (("a", 1000), ("b", 1), ("c", 50)) for v in ([5.0] * (many // 2) + [r.gauss(0, 3) for _ in range(many - many // 2)])] + [("a", None), ("d", None), ("e", 2.0), ("e", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    at = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p77": 0.77, "p100": 1.0}
    got = {x["g"]: tuple(x[c] for c in at) for x in trades.exact_quantiles(df, ["g"], "v", at, bins).collect()}
    want = {x["g"]: tuple(x[c] for c in at) for x in df.groupBy("g").agg(*(F.percentile("v", q).alias(c) for c, q in at.items())).collect()}
    assert got.keys() == want.keys() - {"d"} and all(got[g] == pytest.approx(want[g]) for g in got)


def test_clustered_tables_are_read_in_part(spark, tmp_path):
    """Files and row groups that a filter on asset and time has to touch, by their statistics."""
    import glob

    import pyarrow.parquet as pq

    from tapeloom.sources import results

    df = spark.range(200_000).select(F.concat(F.lit("A"), F.format_string("%02d", F.col("id") % 20)).alias("asset"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval((F.col("id") / 20).cast("int"))).alias("timestamp"), F.rand(1).alias("close"))
    path = results.write_clustered(df.repartition(5), str(tmp_path / "t"), ["asset", "timestamp"], 8, 2000)
    start, end = day(1000), day(1100)
    got = results.read_span(spark, path, ["A07"], str(start), str(end))
    assert got.count() == 100 and got.agg(F.min("timestamp"), F.max("timestamp")).first() == (start, day(1099))
    pushed = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp" in pushed and "asset" in pushed.split("PushedFilters")[1]
    groups, touched, files = 0, 0, set()
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            a, t = (meta.row_group(g).column(i).statistics for i in (0, 1))
            groups += 1
            if a.min <= "A07" <= a.max and t.min < end and t.max >= start:
                touched += 1
                files.add(f)
    assert len(files) <= 2 and touched <= groups // 4, (len(files), touched, groups)  # an asset may stand on both sides of a bound between files


def test_target_orders_of_one_asset(spark):
    bars = spark.createDataFrame([("A", day(0), 10.0), ("A", day(1), 20.0), ("B", day(0), 5.0), ("B", day(1), None), ("C", day(1), -1.0)], "asset string, timestamp timestamp_ntz, close double")
    held = spark.createDataFrame([(day(1), "A", 4.0), (day(1), "B", 2.0), (day(1), "D", 1.0)], "timestamp timestamp_ntz, asset string, quantity double")
    worth = spark.createDataFrame([(day(1), 1000.0)], "timestamp timestamp_ntz, equity double")
    orders_of = lambda rows, column, **more: [(r["asset"], r["side"], r["quantity"], r["price"]) for r in ledger.target_orders(held, spark.createDataFrame([(day(1), *x) for x in rows], f"timestamp timestamp_ntz, asset string, {column} double"), bars, worth, **more).orderBy("sequence").collect()]
    assert orders_of([("A", 0.1)], "weight", close_untargeted=False) == [("A", "buy", 1.0, 20.0)]
    assert orders_of([("A", 80.0)], "value", close_untargeted=False) == []  # nothing to do
    assert orders_of([("A", -20.0), ("B", 50.0), ("C", 1.0)], "value", close_untargeted=False) == [("A", "sell", 5.0, 20.0)]  # no price of B and C today
    assert orders_of([("A", 0.1)], "weight", policy="use_last") == [("B", "sell", 2.0, 5.0), ("A", "buy", 1.0, 20.0)]  # D has never had a price
    assert orders_of([("A", 0.1), ("B", 0.1)], "weight", policy="use_last", min_bars=2) == [("A", "buy", 1.0, 20.0)]
    assert orders_of([("A", 0.1)], "weight", headroom=0.5, close_untargeted=False) == [("A", "sell", 1.5, 20.0)]
