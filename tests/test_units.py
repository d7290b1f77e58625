"""Small cases with known answers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.functions import folds
from touchline.operators import backtest, enrich, model, rules, simulation
from touchline.plans import layout
from touchline.sources import candles as K
from touchline.sources import tables

BAR = "instrument string, bar_idx long, time timestamp_ntz, open double, high double, low double, close double"


def bars(spark, rows):
    plain = spark.createDataFrame([("X", i, *map(float, r)) for i, r in enumerate(rows)], "instrument string, bar_idx long, open double, high double, low double, close double")
    return plain.withColumn("time", F.expr("timestampadd(HOUR, CAST(bar_idx AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00')"))


def test_tie_goes_to_the_named_barrier(spark):
    c = bars(spark, [(100, 100, 100, 100), (100, 102, 98, 100), (100, 100, 100, 100)])
    for tie, outcome in (("sl", "loss"), ("tp", "win")):
        got = simulation.first_touch(c, [0.01], [0.01], 2, tie=tie).collect()
        assert {(r.trade_type, r.outcome, r.exit_idx) for r in got} == {("buy", outcome, 1), ("sell", outcome, 1)}


def test_first_hits_against_a_plain_loop():
    rng = np.random.default_rng(1)
    high, levels = rng.normal(0, 1, 300).cumsum(), rng.normal(0, 5, (280, 6))
    want = [[next((j for j in range(1, 21) if i + j < 300 and high[i + j] >= b), 0) for b in levels[i]] for i in range(280)]
    assert (simulation.first_hits(high, levels, 20, True) == np.array(want)).all()


def test_blocks_see_all_later_bars(spark):
    c = spark.range(100).select(F.lit("X").alias("instrument"), F.col("id").alias("bar_idx"))
    found = simulation.blocked(c, 25, 10).groupBy("block").agg(F.sort_array(F.collect_list("bar_idx")).alias("b"), F.sum(F.col("entry").cast("int")).alias("n")).collect()
    for r in found:
        assert r.n == 10 and r.b == list(range(r.block * 10, min(100, r.block * 10 + 35)))


def test_swings_and_wilder():
    s, r = folds.swings(np.array([10, 12, 11, 9, 10, 13.0]), np.array([9, 11, 8, 7, 9, 12.0]), np.full(6, 2.0))
    assert np.isnan(s[0]) and s[1:].tolist() == [9, 9, 9, 7, 7] and r[1:].tolist() == [10, 12, 12, 12, 12]
    assert folds.wilder(np.array([1.0, 2, 3, 4]), 2, 0).tolist()[1:] == [1.5, 2.25, 3.125]


def test_swings_of_a_walk():
    """Every value against the definition, bar by bar: the extreme of the leg that the last turn before the bar ended."""
    rng = np.random.default_rng(5)
    close = np.cumsum(rng.normal(size=3000)).astype(np.float32)
    high, low, limit = close + np.float32(0.4), close - np.float32(0.3), rng.uniform(1, 6, 3000)
    support, resistance = folds.swings(high.astype(float), low.astype(float), limit)
    turns, start, up = [], 0, True
    for i in range(1, 3000):
        leg = (high if up else -low)[start:i].max()
        new = (high if up else -low)[i]
        if new <= leg and (low if up else -high)[i] < leg - limit[i]:
            turns.append((i, up, leg if up else -leg))
            start, up = i, not up
    assert len(turns) > 50
    for i in (1, 7, 100, 101, 1500, 2999):
        for top, got, first in ((True, resistance, high[0]), (False, support, low[0])):
            assert got[i] == next((x for at, side, x in reversed(turns) if at <= i and side == top), first)


def test_rule_texts(spark):
    assert rules.conditions("`a b` > 1.5 and `c` <= -1e-05") == [("a b", ">", 1.5), ("c", "<=", -1e-05)] and rules.conditions("") == []
    texts = ["`a` > 1.5 and `a` > 2.0 and `b` <= 1e-05", "", None, "`z` <= 3 and `a` > -1 and `z` <= 2.5 and `z` > 0"]
    got = [r[0] for r in rules.simplified(spark.createDataFrame([(t,) for t in texts], "market_rule string")).collect()]
    assert got == ["`a` > 2.0 and `b` <= 1.0E-5", "", "", "`a` > -1.0 and `z` <= 2.5 and `z` > 0.0"]
    assert all(rules.conditions(g) for g in got if g)


def test_mined_rules_leave_known_ones_out(spark):
    rows = [("k", float(i), int(i > 120)) for i in range(200)]
    joined = spark.createDataFrame(rows, "key string, f double, trade_count int")
    found = rules.mine(joined, ["f"], depth=3, least=10)
    assert [(r.key, r.market_rule, r.n_candles) for r in found.collect()] == [("k", "`f` > 120.5", 79)]
    known = spark.createDataFrame([("k", ["`f` > 120.5"])], "key string, rules array<string>")
    assert rules.mine(joined, ["f"], known, depth=3, least=10).count() == 0


def test_split_and_metrics_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(f"2024-01-{1 + i // 7:02d} {i % 7:02d}:00:00", int(rng.integers(0, 2)), float(rng.choice([0.0, 1.0, 0.25, rng.random()]))) for i in range(150)]
    df = spark.createDataFrame(rows, "time string, target int, score double").selectExpr("CAST(time AS timestamp) AS entry_time", "target", "score")
    split = model.time_split(df.union(df)).collect()
    assert len(split) == 300 and {r.entry_time for r in split if r.validation} == set(sorted({r.entry_time for r in split})[-30:])
    y, s = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    a, b = s[y == 1][:, None], s[y == 0][None, :]
    got = model.metrics(df).first()
    assert got.roc_auc == pytest.approx(((a > b) + 0.5 * (a == b)).mean()) and got.accuracy == pytest.approx(((s > 0.5) == y).mean())
    assert model.bps_columns(["sl_dist_to_a_bps", "tp_dist_to_a_bps", "sl_dist_to_a_atr", "x"]) == (["sl_dist_to_a_bps"], ["tp_dist_to_a_bps"])


def test_tree_finds_the_split():
    x = np.arange(200.0)[:, None]
    got = rules.leaves(x, (x[:, 0] > 120).astype(float), ["f"], 3, 10)
    assert {(r, n, m) for r, n, m in got} == {("`f` <= 120.5", 121, 0.0), ("`f` > 120.5", 79, 1.0)}


def test_expired_trade_ends_on_the_last_bar(spark):
    c = bars(spark, [(100, 100.1, 99.9, 100)] * 5)
    e = spark.createDataFrame([(1, "X", 1, 100.0, "buy", 90.0, 110.0)], "id long, instrument string, entry_idx long, entry_price double, trade_type string, sl_price double, tp_price double")
    r = backtest.touched(e, c, 50).first()
    assert (r.outcome, r.exit_idx, r.exit_price) == ("expired", 4, 100.0)


def test_metrics_without_losses(spark):
    log = spark.createDataFrame([("k", 0, 1.0), ("k", 1, 2.0)], "k string, entry_idx long, pnl double")
    r = backtest.performance(log, ["k"], ["entry_idx"]).first()
    assert (r.profit_factor, r.win_rate, r.avg_loss, r.max_drawdown_pts) == (float("inf"), 100.0, 0.0, 0.0)
    one = backtest.performance(log.limit(1), ["k"], ["entry_idx"]).first()
    assert one.sqn == 0.0


@pytest.mark.parametrize(("score", "want"), [(-200, -1), (-100, -1), (-50, -0.5), (0, 0), (50, 0.5), (100, 1), (200, 1), (None, 0)])
def test_compress(spark, score, want):
    df = spark.createDataFrame([(score,)], "s int")
    assert df.select(enrich.compress(F.col("s"))).first()[0] == want


def test_csv_reading(spark, tmp_path):
    (tmp_path / "EURUSD15.csv").write_text("2024.01.01 00:15,1,2,0.5,1.5,10\nbad,1,2,0.5,1.5,10\n2024.01.01 00:00,1,x,0.5,1.5,10\n2024-01-01 00:00:00,1,2,0.5,1.5,\n")
    got = K.clean(K.scan_csv(spark, str(tmp_path / "EURUSD15.csv"))).orderBy("bar_idx").collect()
    assert [(r.instrument, str(r.time), r.bar_idx) for r in got] == [("EURUSD", "2024-01-01 00:00:00", 0), ("EURUSD", "2024-01-01 00:15:00", 1)]
    (tmp_path / "few.csv").write_text("1,2,3\n")
    with pytest.raises(ValueError, match="at least five"):
        K.scan_csv(spark, str(tmp_path / "few.csv"))


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1)], "target long, score double")
    assert model.metrics(df).first().roc_auc == pytest.approx(0.875)


def test_streaming_candles_and_state(spark, tmp_path):
    from touchline.streaming import live

    src = tmp_path / "in"
    spark.createDataFrame([("A", f"2024-01-01 00:{m:02d}:00", float(m)) for m in range(0, 60, 5)], "symbol string, ts string, price double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(src))
    stream = spark.readStream.schema("symbol string, ts timestamp, price double").parquet(str(src))
    q = live.closed_candles(stream, 15, "0 seconds").writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM closed ORDER BY time").collect()
    assert [(r.open, r.close) for r in got] == [(0.0, 10.0), (15.0, 25.0), (30.0, 40.0)]
    q = live.bar_cache(stream.select("symbol", F.col("ts").alias("time"), F.col("price").alias("close")), 3).writeStream.format("memory").queryName("cache").option("checkpointLocation", str(tmp_path / "d")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT max(bars), max(mean_close) FROM cache").first() == (3, 50.0)


def test_scaling_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(enrich, "BLOCK_BARS", 8)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2, 61)).round(3)
    x[0, 10:25] = 2.5  # a stretch without deviation
    rows = [(f"i{k}", j + 3, None if j == 40 else float(x[k, j]), "kept") for k in range(2) for j in range(61)]
    df = spark.createDataFrame(rows, "instrument string, bar_idx long, x double, label string")
    got = enrich.rolling_zscore(df, ["x"], window=5, least=2, fill="none")
    assert got.columns == df.columns
    by = {(r.instrument, r.bar_idx): r for r in got.collect()}
    assert len(by) == 122 and {r.label for r in by.values()} == {"kept"}
    for k in range(2):
        s = pd.Series(x[k])
        s[40] = 0.0
        spread = s.rolling(5, min_periods=2).std()
        want = ((s - s.rolling(5, min_periods=2).mean()) / spread).where(spread > 1e-12)
        for j in range(61):
            z = by[f"i{k}", j + 3].x
            assert (z is None) == bool(np.isnan(want[j])) and (z is None or abs(z - want[j]) < 1e-6)
    filled = {(r.instrument, r.bar_idx): r.x for r in enrich.rolling_zscore(df, ["x"], window=5, least=2).collect()}
    assert filled["i0", 3] == by["i0", 4].x and filled["i0", 20] == by["i0", 28].x
    assert enrich.rolling_zscore(df.limit(0), ["x"]).count() == 0


def test_selection():
    names = ["EURUSD15", "EURUSD5", "XAUUSD60"]
    assert tables.selected(names, "all") == ["EURUSD5", "EURUSD15", "XAUUSD60"] and tables.selected(names, "3, 1, EURUSD5") == ["XAUUSD60", "EURUSD5"]
    with pytest.raises(ValueError, match="no such choice"):
        tables.selected(names, "4")


def test_all_layers_in_order(spark, tmp_path):
    """One run of each tail over small candles: every layer is written and read again, and trades agree from end to end."""
    c = K.event_candles(spark, "/root/testdata/sf0.01", 60).where("instrument = 'click'")
    got = layout.Pipeline(spark, layout.Layout(f"{tmp_path}/dt"), [0.0005], [0.001, 0.002], 24).run(c, least=20)
    assert got["trades"].count() > 1000 and got["enriched"].count() <= got["trades"].count()
    assert got["combinations"].where("num_candles < 20").count() == 0 and got["targets"].agg(F.sum("trade_count")).first()[0] > 0
    assert set(got["strategies"].columns) == {"key", "market_rule", "n_candles", "avg_density"}
    other = layout.Pipeline(spark, layout.Layout(f"{tmp_path}/xgb"), [0.0005], [0.001, 0.002], 24)
    matrix = other.run(c, tail="xgb")["matrix"]
    times = got["gold"].select("instrument", F.col("time").alias("entry_time"))
    assert matrix.where("validation").count() > 0 and matrix.count() == got["enriched"].join(times, ["instrument", "entry_time"], "left_semi").count()
    with pytest.raises(ValueError, match="unknown tail"):
        other.run(c, tail="x")
