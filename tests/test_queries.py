"""Queries against DuckDB over the smallest table set."""

import collections
import hashlib
import math
from pathlib import Path

import duckdb
import pytest

from touchline.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
FAST = [
    "candles", "scan_csv_ohlc", "clean_time", "drop_invalid", "upsert_append_dedup", "explore_row", "pip_size", "filename_config", "grid_presets", "first_touch", "spread_in_tp", "balanced_sample", "sma", "ema", "rsi",
    "macd_hist", "atr", "adx", "candle_patterns", "zigzag_sr", "cci", "session", "fractal_sr", "bfill_sr", "vol_regime", "place_pct_dist_bps", "relational", "rolling_zscore", "combinations", "consolidate", "rule_simplify", "rule_zeroing", "matrix_encode",
    "time_split", "metrics", "rule_eval", "level_sltp", "deep_log", "max_drawdown", "report_regime", "pass_sort", "regime_unpack", "position_limit", "tick_to_candle",
    "incremental_scan", "prepare_missing", "processed_log", "select_inputs", "sltp_bps_columns",
]


def rows(frame):
    frame = frame[sorted(frame.columns)]
    tell = lambda x: "~" if x is None or x != x else f"{float(x):.7g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(tell(x.item() if hasattr(x, "item") else x) for x in r) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", FAST)
def test_same_as_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).df())


def test_duplicate_times_between_seconds(spark, tmp_path):
    """Duplicates of times with fractions: below, at and over a half, on either side of 1970, null, and two times of one second."""
    times = ["2024-01-01 00:00:00", "2024-01-01 00:00:00.499999", "2024-01-01 00:00:00.5", "2024-01-01 00:00:01.5", "2024-01-01 00:00:01.500001", "2024-01-01 00:00:02.999999"]
    times += ["1969-12-31 23:59:58.5", "1969-12-31 23:59:57.5", "1969-12-31 23:59:59.25", "1900-03-01 12:00:00.75", "9999-12-31 23:59:59.999999"]
    rows_ = [(kind, t) for t in [*times, None] for kind, n in (("a", 2), (None, 3), ("once", 1)) for _ in range(n)]
    con = duckdb.connect()
    con.execute("CREATE TABLE held (event_type VARCHAR, ts TIMESTAMP)")
    con.executemany("INSERT INTO held VALUES (?, CAST(? AS TIMESTAMP))", rows_)
    con.execute(f"COPY held TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    want, got = con.execute(ORACLE_SQL["duplicate_times"]).fetchall(), QUERIES["duplicate_times"](spark, str(tmp_path))
    assert got.columns == ["instrument", "t", "n"]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want) and len(want) == 2 * len(times) + 2


def test_entry_without_the_corpus_operators():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_all_blueprints(spark):
    from touchline.plans import queries

    counted, candles = collections.Counter(), collections.defaultdict(set)
    trades = queries.enriched(spark, SF).withColumn("t", queries.t("entry_time")).toPandas().to_dict("records")
    for x in trades:
        for level in ("sma", "slow"):
            for own, other in (("sl", "tp"), ("tp", "sl")):
                for kind, value, most in (("Pct", x[f"{own}_place_pct_to_{level}"] * 10, 20), ("BPS", x[f"{own}_dist_to_{level}_bps"] / 5, 10)):
                    if math.isnan(value) or not -most <= math.floor(value) <= most:
                        continue
                    ends = {own: (level, float(math.floor(value) * (1 if kind == "Pct" else 5))), other: ("ratio", round(x[f"{other}_ratio"], 5))}
                    blueprint = (x["instrument"], f"{own.upper()}-{kind}", *ends["sl"], *ends["tp"], x["trade_type"])
                    counted[(*blueprint, x["t"])] += 1
                    candles[blueprint].add(x["t"])
    assert {b[1] for b in candles} == {"SL-Pct", "TP-Pct", "SL-BPS", "TP-BPS"}
    got = QUERIES["blueprint_agg_all"](spark, SF).collect()
    assert {tuple(r)[:-1]: r.trade_count for r in got} == dict(counted) and len(got) == len(counted)

    def key(b):
        return hashlib.sha256(f"{b[1]}-{b[2]}-{b[3]:.5f}-{b[4]}-{b[5]:.5f}-{b[6]}".encode()).hexdigest()[:16]

    kept = {b: len(c) for b, c in candles.items() if len(c) >= 20}
    names = ["instrument", "type", "sl_def", "sl_bin", "tp_def", "tp_bin", "trade_type"]
    rows_ = QUERIES["combinations_all"](spark, SF).collect()
    assert {tuple(r[n] for n in names): (r.key, r.num_candles) for r in rows_} == {b: (key(b), n) for b, n in kept.items()} and len(rows_) == len(kept)
    want = collections.Counter()
    for b, n in counted.items():
        if b[:-1] in kept:
            want[b[0], key(b), b[-1]] += n
    assert {(r.instrument, r.key, r.t): r.trade_count for r in QUERIES["consolidate_all"](spark, SF).collect()} == dict(want)
    assert any("Pct" in b[1] for b in kept)
