"""Every operator as a query over the driver's tables, and its SQL.

Prices are walks over ``events``, one instrument for each event type; see ``sources.candles``. Times come out as seconds since
1970 and doubles rounded, so that two engines can be compared.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline import config
from touchline.functions.frames import back_fill, safe_divide
from touchline.operators import backtest as B
from touchline.operators import blueprints as P
from touchline.operators import dashboard as D
from touchline.operators import enrich as E
from touchline.operators import indicators as I
from touchline.operators import model as M
from touchline.operators import rules as R
from touchline.operators import simulation as S
from touchline.sources import candles as K
from touchline.sources import tables as T
from touchline.streaming import live as L

C = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

WALK = """walk AS MATERIALIZED (SELECT event_type AS instrument, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rank,
  1000.0::DOUBLE + 0.01::DOUBLE * (sum(CAST(value AS DECIMAL(18,2)) - 50) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::DOUBLE AS price FROM events)"""
BASE = f"""{WALK}, raw AS MATERIALIZED (SELECT instrument, floor(epoch(ts) / 3600)::BIGINT * 3600 AS t, arg_min(price, rank) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, rank) AS close, count(*)::DOUBLE AS volume FROM walk GROUP BY ALL),
candles AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY t) - 1 AS bar_idx FROM raw)"""
W = "PARTITION BY instrument ORDER BY bar_idx"


def mean(x: str, n: int, least: int | None = None) -> str:
    frame = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} >= {least or n} THEN avg({x}) {frame} END"


#: A plain mean range stands for the ATR, and the mean body share for the ADX, where an operator takes them as given.
GIVEN = f"""{BASE}, given AS MATERIALIZED (SELECT *, {mean('high - low', 14)} AS atr, 100 * {mean('abs(close - open)', 14)} / nullif({mean('high - low', 14)}, 0) AS adx,
  {mean('close', 20)} AS sma, {mean('close', 50)} AS slow FROM candles)"""
STOPS, TAKES, BARS = [0.0005, 0.001, 0.002], [0.0005, 0.001, 0.002, 0.004], 24
TRADES = f"""{GIVEN}, ends AS (SELECT instrument, max(bar_idx) AS last FROM candles GROUP BY 1),
entries AS (SELECT g.* FROM given g JOIN ends USING (instrument) WHERE bar_idx <= last - {BARS}),
sls AS (SELECT unnest({STOPS})::DOUBLE AS sl_ratio), tps AS (SELECT unnest({TAKES})::DOUBLE AS tp_ratio), sides AS (SELECT unnest(['buy', 'sell']) AS trade_type),
slhit AS MATERIALIZED (SELECT e.instrument, e.bar_idx, trade_type, sl_ratio, min(c.bar_idx) AS j FROM entries e CROSS JOIN sls CROSS JOIN sides CROSS JOIN (SELECT unnest(range(1, {BARS + 1})) AS k) JOIN candles c
  ON c.instrument = e.instrument AND c.bar_idx = e.bar_idx + k WHERE CASE WHEN trade_type = 'buy' THEN c.low <= e.close * (1 - sl_ratio) ELSE c.high >= e.close * (1 + sl_ratio) END GROUP BY ALL),
tphit AS MATERIALIZED (SELECT e.instrument, e.bar_idx, trade_type, tp_ratio, min(c.bar_idx) AS j FROM entries e CROSS JOIN tps CROSS JOIN sides CROSS JOIN (SELECT unnest(range(1, {BARS + 1})) AS k) JOIN candles c
  ON c.instrument = e.instrument AND c.bar_idx = e.bar_idx + k WHERE CASE WHEN trade_type = 'buy' THEN c.high >= e.close * (1 + tp_ratio) ELSE c.low <= e.close * (1 - tp_ratio) END GROUP BY ALL),
trades AS MATERIALIZED (SELECT e.instrument, e.t, e.bar_idx AS entry_idx, sides.trade_type, e.close AS entry_price,
  e.close * (1 + CASE WHEN sides.trade_type = 'buy' THEN -1 ELSE 1 END * sls.sl_ratio) AS sl_price, e.close * (1 + CASE WHEN sides.trade_type = 'buy' THEN 1 ELSE -1 END * tps.tp_ratio) AS tp_price,
  sls.sl_ratio, tps.tp_ratio, CASE WHEN b.j IS NOT NULL AND (a.j IS NULL OR b.j < a.j) THEN b.j ELSE a.j END AS exit_idx,
  CASE WHEN b.j IS NOT NULL AND (a.j IS NULL OR b.j < a.j) THEN 'win' ELSE 'loss' END AS outcome
  FROM entries e CROSS JOIN sls CROSS JOIN tps CROSS JOIN sides
  LEFT JOIN slhit a ON a.instrument = e.instrument AND a.bar_idx = e.bar_idx AND a.trade_type = sides.trade_type AND a.sl_ratio = sls.sl_ratio
  LEFT JOIN tphit b ON b.instrument = e.instrument AND b.bar_idx = e.bar_idx AND b.trade_type = sides.trade_type AND b.tp_ratio = tps.tp_ratio
  WHERE a.j IS NOT NULL OR b.j IS NOT NULL)"""


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def candles(spark: SparkSession, sf: str) -> DataFrame:
    return K.event_candles(spark, sf, 60)


def given(spark: SparkSession, sf: str) -> DataFrame:
    """Candles with plain means that stand for indicators."""
    out = candles(spark, sf)
    span, body = I.rolling(C("high") - C("low"), 14), I.rolling(F.abs(C("close") - C("open")), 14)
    return out.withColumns({"atr": span, "adx": F.try_divide(100 * body, span), "sma": I.sma(20), "slow": I.sma(50)})


def trades(spark: SparkSession, sf: str, source: DataFrame | None = None) -> DataFrame:
    return S.first_touch(source if source is not None else candles(spark, sf), STOPS, TAKES, BARS)


def t(column: str = "time") -> Column:
    return K.seconds(column).alias("t")


def r(c: Column | str, n: int = 6) -> Column:
    return F.round(C(c) if isinstance(c, str) else c, n)


def out(df: DataFrame, *columns: Column | str) -> DataFrame:
    return df.select("instrument", t(), *columns)


def sql(select: str, ctes: str = BASE) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


def scratch(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    folder = folder or tempfile.mkdtemp(prefix="tables-")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


# ---- Scans, sources, sinks ------------------------------------------------------------------------------------------


@query("candles", sql("SELECT instrument, t, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, bar_idx FROM candles"))
def _candles(spark, sf):
    return out(candles(spark, sf), *(r(p).alias(p) for p in K.PRICES), "volume", "bar_idx")


@query("scan_csv_ohlc", sql("SELECT instrument, t, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, bar_idx FROM candles"))
def _scan_csv(spark, sf):
    path = scratch(spark)
    for_file = candles(spark, sf).select("instrument", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), *(F.format_string("%.10f", p).alias(p) for p in K.PRICES), "volume")
    for_file.write.partitionBy("instrument").csv(path, sep=";")
    names = [row[0] for row in for_file.select("instrument").distinct().collect()]
    parts = [K.clean(K.scan_csv(spark, f"{path}/instrument={n}", n)) for n in sorted(names)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return out(whole, *(r(p).alias(p) for p in K.PRICES), "volume", "bar_idx")


RAW = "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS time, CASE WHEN event_id % 5 = 0 THEN 'x' ELSE CAST(user_id AS VARCHAR) END AS price FROM events"


def raw_text(spark, sf):
    ev = read(spark, sf, "events")
    return ev.select("event_id", F.when(C("event_id") % 7 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("time"), F.when(C("event_id") % 5 == 0, "x").otherwise(C("user_id").cast("string")).alias("price"))


@query("clean_time", f"SELECT event_id, epoch(try_cast(time AS TIMESTAMP))::BIGINT AS t FROM ({RAW})")
def _clean_time(spark, sf):
    return raw_text(spark, sf).select("event_id", K.clean_time().alias("time")).select("event_id", t())


@query("clean_numeric", f"SELECT event_id, try_cast(price AS DOUBLE) AS price FROM ({RAW})")
def _clean_numeric(spark, sf):
    return raw_text(spark, sf).select("event_id", K.clean_number("price").alias("price"))


@query("drop_invalid", f"SELECT count(*) AS total, count(*) FILTER (try_cast(time AS TIMESTAMP) IS NULL OR try_cast(price AS DOUBLE) IS NULL) AS dropped FROM ({RAW})")
def _drop_invalid(spark, sf):
    typed = raw_text(spark, sf).select(K.clean_time().alias("time"), *(K.clean_number("price").alias(p) for p in K.PRICES))
    return typed.agg(F.count("*").alias("total")).crossJoin(K.drop_invalid(typed).agg(F.count("*").alias("kept"))).select("total", (C("total") - C("kept")).alias("dropped"))


@query("sort_time", sql("SELECT instrument, t, bar_idx FROM candles"))
def _sort_time(spark, sf):
    return out(K.with_bar_index(candles(spark, sf).drop("bar_idx")), "bar_idx")


@query("duplicate_times", "SELECT event_type AS instrument, epoch(ts)::BIGINT AS t, count(*) AS n FROM events GROUP BY event_type, ts HAVING count(*) > 1")
def _duplicate_times(spark, sf):
    found = K.duplicate_times(read(spark, sf, "events").select(C("event_type").alias("instrument"), C("ts").alias("time")))
    return found.select("instrument", K.nearest_seconds("time").alias("t"), "n")


@query("scan_parquet", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(l_extendedprice, 2) AS price FROM lineitem WHERE l_quantity > 45")
def _scan_parquet(spark, sf):
    return read(spark, sf, "lineitem").where("l_quantity > 45").select("l_orderkey", C("l_linenumber").cast("long").alias("l_linenumber"), r("l_extendedprice", 2).alias("price"))


@query("scan_parquet_meta", "SELECT 'lineitem' AS name, count(*) AS n_rows, 11::BIGINT AS n_columns FROM lineitem")
def _scan_meta(spark, sf):
    df = read(spark, sf, "lineitem")
    return df.agg(F.count("*").alias("n_rows")).select(F.lit("lineitem").alias("name"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"))


@query("sink_parquet_roundtrip", sql("SELECT instrument, count(*) AS n, round(sum(close), 4) AS total FROM candles GROUP BY 1"))
def _sink(spark, sf):
    path = scratch(spark)
    T.write_table(candles(spark, sf), path, ["instrument"], 1000)
    return spark.read.parquet(path).groupBy("instrument").agg(F.count("*").alias("n"), r(F.sum("close"), 4).alias("total"))


@query("sink_csv_roundtrip", "SELECT n_nationkey, n_name FROM nation")
def _sink_csv(spark, sf):
    path = scratch(spark)
    T.write_csv(read(spark, sf, "nation").select("n_nationkey", "n_name"), path)
    return spark.read.option("header", True).csv(path).select(C("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


@query("upsert_append_dedup", "SELECT o_orderkey, coalesce(b.src, a.src) AS src FROM (SELECT o_orderkey, 'old' AS src FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey, 'new' AS src FROM orders WHERE o_orderkey % 2 = 0) b USING (o_orderkey)")
def _upsert(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey")
    return T.upsert(o.where("o_orderkey % 3 != 0").withColumn("src", F.lit("old")), o.where("o_orderkey % 2 = 0").withColumn("src", F.lit("new")), ["o_orderkey"])


@query("incremental_scan", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 3 <> 0)")
def _incremental(spark, sf):
    done = read(spark, sf, "orders").where("o_orderkey % 2 = 0 AND o_custkey % 3 <> 0").select(C("o_custkey").alias("c_custkey"))
    return T.pending_inputs(read(spark, sf, "customer").select("c_custkey"), done, "c_custkey")


@query("prepare_missing", sql(f"SELECT instrument, bar_idx, CASE WHEN instrument < 'm' THEN close ELSE {mean('close', 20)} END IS NULL AS lacks, round(CASE WHEN instrument >= 'm' THEN {mean('close', 20)} END, 6) AS sma FROM candles"))
def _prepare_missing(spark, sf):
    """Features exist (as nulls) for some instruments; for the others they are made."""
    all_ = candles(spark, sf)
    done = all_.where("instrument < 'm'").select("instrument", "bar_idx", F.lit(False).alias("lacks"), F.lit(None).cast("double").alias("sma"))
    make = lambda some: some.withColumn("sma", I.sma(20)).select("instrument", "bar_idx", C("sma").isNull().alias("lacks"), r("sma").alias("sma"))
    return T.prepared(all_, done, "instrument", make)


@query("processed_log", "SELECT DISTINCT 'k' || (l_suppkey % 40) AS key FROM lineitem WHERE l_suppkey % 40 < 25")
def _processed_log(spark, sf):
    """Two runs that overlap, and a third that finds nothing left of the first two."""
    path, keys = scratch(spark), read(spark, sf, "lineitem").select(F.concat(F.lit("k"), C("l_suppkey") % 40).alias("key"), (C("l_suppkey") % 40).alias("n")).distinct()
    for some in ("n < 15", "n BETWEEN 10 AND 24", "n < 25"):
        T.mark_processed(T.pending_inputs(keys.where(some).select("key"), T.processed(spark, path), "key"), path)
    return T.processed(spark, path)


@query("select_inputs", "SELECT n_name AS name FROM (SELECT n_name, row_number() OVER (ORDER BY regexp_extract(n_name, '[0-9]+$')::INT) AS k FROM nation) WHERE k IN (2, 11) OR n_name = 'NATION_20'")
def _select_inputs(spark, sf):
    """Names come to the driver as an argument of the command line does: they name tables, not rows."""
    names = [row[0] for row in read(spark, sf, "nation").select("n_name").collect()]
    return spark.createDataFrame([(n,) for n in T.selected(names, "2, 11, NATION_20, 2")], "name string")


@query("sltp_bps_columns", "SELECT unnest(['sl', 'sl', 'tp', 'tp']) AS side, unnest(['sl_dist_to_slow_bps', 'sl_dist_to_sma_bps', 'tp_dist_to_slow_bps', 'tp_dist_to_sma_bps']) AS name")
def _bps_columns(spark, sf):
    found = M.bps_columns(enriched(spark, sf).columns)
    return spark.createDataFrame([(side, name) for side, names in zip(("sl", "tp"), found, strict=True) for name in sorted(names)], "side string, name string")


@query("init_empty_state", "SELECT ''::VARCHAR AS key, ''::VARCHAR AS market_rule, 0::BIGINT AS n_candles, 0::DOUBLE AS avg_density WHERE false")
def _empty(spark, sf):
    return T.empty_state(spark, "strategies")


@query("explore_headings", "SELECT column_index::BIGINT - 1 AS position, column_name AS name FROM duckdb_columns() WHERE false UNION ALL SELECT * FROM (VALUES (0::BIGINT, 'r_regionkey'), (1, 'r_name'))")
def _headings(spark, sf):
    return T.headings(read(spark, sf, "region").select("r_regionkey", "r_name")).select(C("position").cast("long").alias("position"), "name")


@query("explore_preview", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 10")
def _preview(spark, sf):
    return T.preview(read(spark, sf, "events").select("event_id", "event_type"), 10, ["event_id"])


@query("explore_row", "SELECT unnest(['n_nationkey', 'n_name']) AS name, unnest([CAST(n_nationkey AS VARCHAR), n_name]) AS value FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 7)")
def _row(spark, sf):
    return T.nth_row(read(spark, sf, "nation").select("n_nationkey", "n_name"), 7, ["n_nationkey"])


# ---- Simulation -------------------------------------------------------------------------------------------------------

NAMES = ["EURUSD15.csv", "USDJPY5.csv", "XAUUSD60.csv", "BTCUSD240.csv", "US3060.csv", "SPX1.csv", "junk.csv"]
PIP_SQL = "CASE {0}" + "".join(f" WHEN n = '{k}' THEN {v}" for k, v in config.PIPS.items()) + "".join(f" WHEN contains(n, '{k}') THEN {v}" for k, v in config.PIPS.items()) + f" ELSE {config.PIP_DEFAULT} END"
PIP_SQL = PIP_SQL.replace("CASE {0}", "CASE")


@query("pip_size", f"SELECT n AS name, ({PIP_SQL})::DOUBLE AS pip FROM (SELECT DISTINCT upper(event_type) || 'JPY' AS n FROM events UNION SELECT unnest(['EURUSD', 'XAUJPY', 'US30', 'SPX500']))")
def _pip(spark, sf):
    names = read(spark, sf, "events").select(F.concat(F.upper("event_type"), F.lit("JPY")).alias("name")).union(spark.createDataFrame([("EURUSD",), ("XAUJPY",), ("US30",), ("SPX500",)], "name string")).distinct()
    return names.select("name", S.pip_size(C("name")).alias("pip"))


@query("filename_config", "SELECT file, regexp_extract(file, '^([A-Za-z0-9]*?)([0-9]+)[.]csv$', 1) AS instrument, p.timeframe::BIGINT AS timeframe, p.bars::BIGINT AS bars FROM (SELECT unnest(" + str(NAMES) + ") AS file) f JOIN (VALUES (1, 200), (5, 300), (15, 400), (30, 500), (60, 600), (240, 800)) p(timeframe, bars) ON try_cast(regexp_extract(file, '^([A-Za-z0-9]*?)([0-9]+)[.]csv$', 2) AS INT) = p.timeframe")
def _filename(spark, sf):
    return S.from_file_name(spark.createDataFrame([(n,) for n in NAMES], "file string")).select("file", "instrument", C("timeframe").cast("long").alias("timeframe"), C("bars").cast("long").alias("bars"))


@query("sltp_grid", f"SELECT sl_ratio, tp_ratio, trade_type FROM (SELECT unnest({STOPS})::DOUBLE AS sl_ratio), (SELECT unnest({TAKES})::DOUBLE AS tp_ratio), (SELECT unnest(['buy', 'sell']) AS trade_type)")
def _grid(spark, sf):
    return S.grid(spark, STOPS, TAKES)


@query("grid_presets", "SELECT * FROM (VALUES (1::BIGINT, 1600::BIGINT, 200::BIGINT), (5, 3422, 300), (15, 2352, 400), (30, 4488, 500), (60, 8832, 600), (240, 34762, 800)) p(timeframe, outcomes, bars)")
def _presets(spark, sf):
    return spark.createDataFrame([(k, 2 * len(g.ratios(g.stops)) * len(g.ratios(g.takes)), g.bars) for k, g in config.GRIDS.items()], "timeframe long, outcomes long, bars long")


@query("barrier_price", sql(f"SELECT instrument, t, ratio, round(close * (1 + ratio), 8) AS above, round(close * (1 - ratio), 8) AS below FROM candles, (SELECT unnest({STOPS})::DOUBLE AS ratio)"))
def _barrier(spark, sf):
    ratios = F.explode(F.array(*map(F.lit, STOPS)))
    return out(candles(spark, sf).withColumn("ratio", ratios), "ratio", r(S.barrier(C("close"), C("ratio"), F.lit(1)), 8).alias("above"), r(S.barrier(C("close"), C("ratio"), F.lit(-1)), 8).alias("below"))


@query("entry_window", sql(f"SELECT instrument, t, bar_idx FROM candles JOIN (SELECT instrument, max(bar_idx) AS last FROM candles GROUP BY 1) USING (instrument) WHERE bar_idx <= last - {BARS}"))
def _entry_window(spark, sf):
    c = candles(spark, sf)
    return out(S.full_window(c, c, BARS), "bar_idx")


TRADE_COLUMNS = "instrument, t, entry_idx, trade_type, round(entry_price, 8) AS entry_price, round(sl_price, 8) AS sl_price, round(tp_price, 8) AS tp_price, sl_ratio, tp_ratio, exit_idx, outcome"


def trade_rows(df: DataFrame) -> DataFrame:
    return df.select("instrument", t("entry_time"), "entry_idx", "trade_type", *(r(c, 8).alias(c) for c in ("entry_price", "sl_price", "tp_price")), "sl_ratio", "tp_ratio", C("exit_idx").cast("long").alias("exit_idx"), "outcome")


@query("first_touch", sql(f"SELECT {TRADE_COLUMNS} FROM trades", TRADES))
def _first_touch(spark, sf):
    return trade_rows(trades(spark, sf))


GRID = config.GRIDS[15]
WALK15 = BASE.replace("epoch(ts) / 3600)::BIGINT * 3600", "epoch(ts) / 900)::BIGINT * 900")


def hits(side: str, kind: str, ratios: list[float]) -> str:
    """The first bar of an entry's window that reaches each barrier, from running extremes: entries x bars, then entries x ratios."""
    up = (side == "buy") == (kind == "tp")
    extreme, reached = ("max(c.high)", ">=") if up else ("min(c.low)", "<=")
    return f"""run_{side}_{kind} AS MATERIALIZED (SELECT e.instrument, e.bar_idx, e.close, c.bar_idx - e.bar_idx AS k, {extreme} OVER (PARTITION BY e.instrument, e.bar_idx ORDER BY c.bar_idx) AS x
  FROM entries e JOIN candles c ON c.instrument = e.instrument AND c.bar_idx BETWEEN e.bar_idx + 1 AND e.bar_idx + {GRID.bars}),
{side}_{kind} AS MATERIALIZED (SELECT instrument, bar_idx, '{side}' AS trade_type, ratio, min(k) AS k FROM run_{side}_{kind} CROSS JOIN (SELECT unnest({ratios})::DOUBLE AS ratio)
  WHERE x {reached} close * (1 {'+' if up else '-'} ratio) GROUP BY ALL)"""


PRESET = f"""{WALK15}, ends AS (SELECT instrument, max(bar_idx) AS last FROM candles GROUP BY 1), entries AS MATERIALIZED (SELECT g.* FROM candles g JOIN ends USING (instrument) WHERE bar_idx <= last - {GRID.bars}),
{', '.join(hits(side, kind, GRID.ratios(bounds)) for side in ('buy', 'sell') for kind, bounds in (('sl', GRID.stops), ('tp', GRID.takes)))},
stops AS (FROM buy_sl UNION ALL FROM sell_sl), takes AS (FROM buy_tp UNION ALL FROM sell_tp),
counted AS (SELECT coalesce(s.instrument, t.instrument) AS instrument, coalesce(s.trade_type, t.trade_type) AS trade_type, s.ratio AS sl_ratio, t.ratio AS tp_ratio, s.k AS sk, t.k AS tk
  FROM (SELECT e.instrument, e.bar_idx, trade_type, ratio, k FROM entries e CROSS JOIN (SELECT unnest(['buy', 'sell']) AS trade_type) CROSS JOIN (SELECT unnest({GRID.ratios(GRID.stops)})::DOUBLE AS ratio) LEFT JOIN stops USING (instrument, bar_idx, trade_type, ratio)) s
  JOIN (SELECT e.instrument, e.bar_idx, trade_type, ratio, k FROM entries e CROSS JOIN (SELECT unnest(['buy', 'sell']) AS trade_type) CROSS JOIN (SELECT unnest({GRID.ratios(GRID.takes)})::DOUBLE AS ratio) LEFT JOIN takes USING (instrument, bar_idx, trade_type, ratio)) t
  USING (instrument, bar_idx, trade_type) WHERE s.k IS NOT NULL OR t.k IS NOT NULL)"""


@query("first_touch_15m", sql("SELECT instrument, trade_type, sl_ratio, tp_ratio, count(*) AS trades, count(*) FILTER (WHERE tk IS NOT NULL AND (sk IS NULL OR tk < sk)) AS wins, sum(CASE WHEN tk IS NOT NULL AND (sk IS NULL OR tk < sk) THEN tk ELSE sk END)::BIGINT AS bars FROM counted GROUP BY ALL", PRESET))
def _first_touch_preset(spark, sf):
    """All trades of the 15-minute preset, 24 x 49 ratios both ways over 400 bars, counted by pair of ratios."""
    found = S.first_touch(K.event_candles(spark, sf, 15), GRID.ratios(GRID.stops), GRID.ratios(GRID.takes), GRID.bars)
    return found.groupBy("instrument", "trade_type", "sl_ratio", "tp_ratio").agg(F.count("*").alias("trades"), F.count_if(C("outcome") == "win").alias("wins"), F.sum(C("exit_idx") - C("entry_idx")).cast("long").alias("bars"))


@query("spread_in_tp", sql(f"SELECT {TRADE_COLUMNS} FROM trades", TRADES.replace("c.high >= e.close * (1 + tp_ratio)", "c.high >= e.close * (1 + tp_ratio) + 0.15").replace("c.low <= e.close * (1 - tp_ratio)", "c.low <= e.close * (1 - tp_ratio) - 0.15")))
def _spread(spark, sf):
    return trade_rows(S.first_touch(candles(spark, sf), STOPS, TAKES, BARS, spread=0.15))


@query("exit_time", sql("SELECT r.instrument, r.t, trade_type, sl_ratio, tp_ratio, c.t AS exit_t FROM trades r JOIN candles c ON c.instrument = r.instrument AND c.bar_idx = r.exit_idx", TRADES))
def _exit_time(spark, sf):
    return S.with_exit_time(trades(spark, sf), candles(spark, sf)).select("instrument", t("entry_time"), "trade_type", "sl_ratio", "tp_ratio", K.seconds("exit_time").alias("exit_t"))


@query("outcome_decode", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS trade_type, CASE WHEN event_id % 3 = 0 THEN 'win' ELSE 'loss' END AS outcome FROM events")
def _decode(spark, sf):
    coded = read(spark, sf, "events").select("event_id", F.when(C("event_id") % 2 == 0, 1).otherwise(-1).alias("direction"), F.when(C("event_id") % 3 == 0, 1).otherwise(0).alias("won"))
    return S.decode(coded)


@query("gen_mode", sql("SELECT instrument, trade_type, outcome, count(*) AS n FROM trades WHERE outcome = 'win' GROUP BY ALL", TRADES))
def _mode(spark, sf):
    return S.by_mode(trades(spark, sf), "WINS_ONLY").groupBy("instrument", "trade_type", "outcome").agg(F.count("*").alias("n"))


BALANCED = f"""{TRADES}, tagged AS (SELECT *, entry_idx // 200 AS chunk FROM trades), wins AS (SELECT instrument, chunk, count(*) AS w FROM tagged WHERE outcome = 'win' GROUP BY ALL),
ranked AS (SELECT g.*, w, row_number() OVER (PARTITION BY g.instrument, g.chunk ORDER BY md5(concat_ws('|', '42', entry_idx, trade_type, printf('%.5f', sl_ratio), printf('%.5f', tp_ratio)))) AS rk
  FROM tagged g JOIN wins USING (instrument, chunk) WHERE outcome = 'loss')"""


@query("balanced_sample", sql("SELECT instrument, entry_idx, trade_type, sl_ratio, tp_ratio, outcome FROM tagged WHERE outcome = 'win' UNION ALL SELECT instrument, entry_idx, trade_type, sl_ratio, tp_ratio, outcome FROM ranked WHERE rk <= w", BALANCED))
def _balanced(spark, sf):
    return S.balanced(trades(spark, sf), 200).select("instrument", "entry_idx", "trade_type", "sl_ratio", "tp_ratio", "outcome")


@query("sim_stats", sql("SELECT outcome, count(*) AS n FROM trades GROUP BY 1", TRADES))
def _stats(spark, sf):
    return S.totals(trades(spark, sf))


# ---- Indicators -------------------------------------------------------------------------------------------------------


@query("sma", sql("SELECT instrument, t, " + ", ".join(f"round({mean('close', p)}, 8) AS sma_{p}" for p in config.SMA_PERIODS) + " FROM candles"))
def _sma(spark, sf):
    return out(candles(spark, sf), *(r(I.sma(p), 8).alias(f"sma_{p}") for p in config.SMA_PERIODS))


EMA = f"""{BASE}, ema AS (SELECT instrument, t, bar_idx, {', '.join(f'close AS e{p}' for p in config.EMA_PERIODS)} FROM candles WHERE bar_idx = 0
UNION ALL SELECT c.instrument, c.t, c.bar_idx, {', '.join(f'c.close * (2.0::DOUBLE / {p + 1}) + e.e{p} * (1 - 2.0::DOUBLE / {p + 1})' for p in config.EMA_PERIODS)} FROM ema e JOIN candles c ON c.instrument = e.instrument AND c.bar_idx = e.bar_idx + 1)"""


@query("ema", sql("SELECT instrument, t, " + ", ".join(f"round(CASE WHEN bar_idx >= {p - 1} THEN e{p} END, 5) AS ema_{p}" for p in config.EMA_PERIODS) + " FROM ema", EMA))
def _ema(spark, sf):
    return out(nan_free(I.recursive(candles(spark, sf))), *(r(f"EMA_{p}", 5).alias(f"ema_{p}") for p in config.EMA_PERIODS))


def nan_free(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.when(~F.isnan(C(n)), C(n)) for n, kind in df.dtypes if kind in ("double", "float")})


BB = f"{mean('close', 20)}", f"CASE WHEN count(close) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 20 THEN stddev_pop(close) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END"


@query("bbands", sql(f"SELECT instrument, t, round({BB[0]} + 2 * {BB[1]}, 4) AS upper, round({BB[0]} - 2 * {BB[1]}, 4) AS lower FROM candles"))
def _bbands(spark, sf):
    upper, lower = I.bands()
    return out(candles(spark, sf), r(upper, 4).alias("upper"), r(lower, 4).alias("lower"))


RSI = f"""{BASE}, moves AS (SELECT instrument, t, bar_idx, greatest(coalesce(close - lag(close) OVER ({W}), 0), 0) AS up, greatest(coalesce(lag(close) OVER ({W}) - close, 0), 0) AS down FROM candles),
rsi AS (SELECT instrument, t, bar_idx, up::DOUBLE AS g, down::DOUBLE AS l FROM moves WHERE bar_idx = 0
UNION ALL SELECT m.instrument, m.t, m.bar_idx, r.g * (1 - 1.0::DOUBLE / 14) + m.up * (1.0::DOUBLE / 14), r.l * (1 - 1.0::DOUBLE / 14) + m.down * (1.0::DOUBLE / 14) FROM rsi r JOIN moves m ON m.instrument = r.instrument AND m.bar_idx = r.bar_idx + 1)"""


@query("rsi", sql("SELECT instrument, t, round(CASE WHEN bar_idx < 13 THEN NULL WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 4) AS rsi FROM rsi", RSI))
def _rsi(spark, sf):
    return out(nan_free(I.recursive(candles(spark, sf))), r("RSI_14", 4).alias("rsi"))


MACD = f"""{BASE}, macd AS (SELECT instrument, t, bar_idx, close AS f, close AS s, 0::DOUBLE AS g FROM candles WHERE bar_idx = 0
UNION ALL SELECT c.instrument, c.t, c.bar_idx, c.close * (2.0::DOUBLE / 13) + m.f * (11.0::DOUBLE / 13), c.close * (2.0::DOUBLE / 27) + m.s * (25.0::DOUBLE / 27),
  0.2::DOUBLE * (c.close * (2.0::DOUBLE / 13) + m.f * (11.0::DOUBLE / 13) - c.close * (2.0::DOUBLE / 27) - m.s * (25.0::DOUBLE / 27)) + 0.8::DOUBLE * m.g
  FROM macd m JOIN candles c ON c.instrument = m.instrument AND c.bar_idx = m.bar_idx + 1)"""


@query("macd_hist", sql("SELECT instrument, t, round(CASE WHEN bar_idx >= 33 THEN f - s - g END, 5) AS macd_hist FROM macd", MACD))
def _macd(spark, sf):
    return out(nan_free(I.recursive(candles(spark, sf))), r("MACD_hist_12_26_9", 5).alias("macd_hist"))


TR = f"{BASE}, tr AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER ({W})), 0), coalesce(abs(low - lag(close) OVER ({W})), 0)) AS tr FROM candles)"
ATR = f"""{TR}, atr AS (SELECT instrument, t, bar_idx, (SELECT avg(tr) FROM tr x WHERE x.instrument = y.instrument AND x.bar_idx < 14) AS a FROM tr y WHERE bar_idx = 13
UNION ALL SELECT c.instrument, c.t, c.bar_idx, (m.a * 13 + c.tr) / 14 FROM atr m JOIN tr c ON c.instrument = m.instrument AND c.bar_idx = m.bar_idx + 1)"""


@query("atr", sql("SELECT c.instrument, c.t, round(coalesce(a.a, 0), 5) AS atr FROM candles c LEFT JOIN atr a USING (instrument, bar_idx)", ATR))
def _atr(spark, sf):
    return out(I.recursive(candles(spark, sf)), r("ATR_14", 5).alias("atr"))


#: Wilder's sums start from plain means of the first 14 ranges and movements; the index is the same mean of 14 directional values.
ADX = f"""{TR}, moves AS (SELECT *, high - lag(high) OVER ({W}) AS up, lag(low) OVER ({W}) - low AS down FROM tr),
dm AS (SELECT instrument, bar_idx, tr, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END::DOUBLE AS p, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END::DOUBLE AS m FROM moves),
di AS (SELECT instrument, 14::BIGINT AS bar_idx, avg(tr) AS r, avg(p) AS p, avg(m) AS m FROM dm WHERE bar_idx BETWEEN 1 AND 14 GROUP BY instrument HAVING count(*) = 14
UNION ALL SELECT d.instrument, c.bar_idx, (d.r * 13 + c.tr) / 14, (d.p * 13 + c.p) / 14, (d.m * 13 + c.m) / 14 FROM di d JOIN dm c ON c.instrument = d.instrument AND c.bar_idx = d.bar_idx + 1),
dx AS MATERIALIZED (SELECT instrument, bar_idx, CASE WHEN p + m > 0 AND r > 0 THEN 100 * abs(p - m) / (p + m) ELSE 0 END::DOUBLE AS dx FROM di),
adx AS (SELECT instrument, 27::BIGINT AS bar_idx, avg(dx) FILTER (bar_idx <= 27) AS a FROM dx GROUP BY instrument HAVING count(*) > 14
UNION ALL SELECT a.instrument, x.bar_idx, (a.a * 13 + x.dx) / 14 FROM adx a JOIN dx x ON x.instrument = a.instrument AND x.bar_idx = a.bar_idx + 1)"""


@query("adx", sql("SELECT c.instrument, c.t, round(coalesce(a.a, 0), 4) AS adx FROM candles c LEFT JOIN adx a USING (instrument, bar_idx)", ADX))
def _adx(spark, sf):
    return out(I.recursive(candles(spark, sf)), r("ADX_14", 4).alias("adx"))


@query("roc", sql(f"SELECT instrument, t, round((close - lag(close, 10) OVER ({W})) / lag(close, 10) OVER ({W}) * 100, 6) AS roc FROM candles"))
def _roc(spark, sf):
    return out(candles(spark, sf), r(I.roc()).alias("roc"))


CCI = f"""{BASE}, typical AS (SELECT *, (high + low + close) / 3 AS tp, list((high + low + close) / 3) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS w, avg((high + low + close) / 3) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m FROM candles)"""


@query("cci", sql("SELECT instrument, t, round(CASE WHEN len(w) >= 20 THEN (tp - m) / nullif(0.015 * list_sum([abs(x - m) for x in w]) / 20, 0) END, 3) AS cci FROM typical", CCI))
def _cci(spark, sf):
    return out(candles(spark, sf), r(I.cci(), 3).alias("cci"))


@query("atr_bands", sql("SELECT instrument, t, round(close + atr, 6) AS up1, round(close - atr, 6) AS down1, round(close + 2 * atr, 6) AS up2, round(close - 2 * atr, 6) AS down2 FROM given", GIVEN))
def _atr_bands(spark, sf):
    made = I.atr_bands("atr")
    return out(given(spark, sf), *(r(made[f"ATR_level_{s}_{m}_14"]).alias(n) for n, s, m in (("up1", "up", "1p0x"), ("down1", "down", "1p0x"), ("up2", "up", "2p0x"), ("down2", "down", "2p0x"))))


def pattern_sql() -> str:
    """The patterns over columns of the rows before: o1, c1 ... are the candle one back."""
    lags = ", ".join(f"lag({c}, {k}) OVER ({W}) AS {c[0]}{k}" for c in ("open", "high", "low", "close") for k in (1, 2)) + f", lag(close, 5) OVER ({W}) AS c5"
    ctes = f"""{BASE}, l AS (SELECT *, abs(close - open) AS b, {lags}, avg(abs(close - open)) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS usual, avg(high - low) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS span,
    high - greatest(open, close) AS u, least(open, close) - low AS d FROM candles),
    p AS (SELECT *, abs(c1 - o1) AS b1, abs(c2 - o2) AS b2, greatest(open, close) AS x0, least(open, close) AS y0, CASE WHEN o1 IS NOT NULL THEN greatest(o1, c1) END AS x1, CASE WHEN o1 IS NOT NULL THEN least(o1, c1) END AS y1,
    CASE WHEN o2 IS NOT NULL THEN greatest(o2, c2) END AS x2, CASE WHEN o2 IS NOT NULL THEN least(o2, c2) END AS y2 FROM l)"""
    hammer, inverted, star = "b < usual AND d > 2 * b AND u < 0.1 * span", "b < usual AND u > 2 * b AND d < 0.1 * span", "b1 < b2 * 0.3 AND b > b2 * 0.5"
    engulfs, inside, plain = "x0 >= x1 AND y0 <= y1 AND b > b1", "x0 < x1 AND y0 > y1 AND b1 > usual", "b > usual AND u < 0.05 * (high - low) AND d < 0.05 * (high - low)"
    bull = {
        "CDLDOJI": "b <= 0.1 * span", "CDLHAMMER": f"{hammer} AND c1 < c5", "CDLINVERTEDHAMMER": f"{inverted} AND c1 < c5", "CDLENGULFING": f"close > open AND c1 < o1 AND {engulfs}", "CDLHARAMI": f"c1 < o1 AND {inside}",
        "CDLMORNINGSTAR": f"c2 < o2 AND {star} AND close > open AND x1 < y2 AND close > (o2 + c2) / 2", "CDLMARUBOZU": f"close > open AND {plain}", "CDLSPINNINGTOP": "close > open AND b < usual AND u > b AND d > b",
        "CDL3WHITESOLDIERS": "close > open AND c1 > o1 AND c2 > o2 AND close > c1 AND c1 > c2 AND open BETWEEN y1 AND x1 AND o1 BETWEEN y2 AND x2",
        "CDLPIERCING": "c1 < o1 AND b1 > usual AND close > open AND open < l1 AND close > (o1 + c1) / 2 AND close < o1",
    }
    bear = {
        "CDLHANGINGMAN": f"{hammer} AND c1 > c5", "CDLSHOOTINGSTAR": f"{inverted} AND c1 > c5", "CDLENGULFING": f"close < open AND c1 > o1 AND {engulfs}", "CDLHARAMI": f"c1 > o1 AND {inside}",
        "CDLEVENINGSTAR": f"c2 > o2 AND {star} AND close < open AND y1 > x2 AND close < (o2 + c2) / 2", "CDLMARUBOZU": f"close < open AND {plain}", "CDLSPINNINGTOP": "close < open AND b < usual AND u > b AND d > b",
        "CDL3BLACKCROWS": "close < open AND c1 < o1 AND c2 < o2 AND close < c1 AND c1 < c2 AND open BETWEEN y1 AND x1 AND o1 BETWEEN y2 AND x2",
        "CDLDARKCLOUDCOVER": "c1 > o1 AND b1 > usual AND close < open AND open > h1 AND close < (o1 + c1) / 2 AND close > o1",
    }
    cases = [f"(CASE WHEN {bull.get(n, 'false')} THEN 100 WHEN {bear.get(n, 'false')} THEN -100 ELSE 0 END)::BIGINT AS {n}" for n in dict.fromkeys([*bull, *bear])]
    return sql(f"SELECT instrument, t, {', '.join(cases)} FROM p", ctes)


@query("candle_patterns", pattern_sql())
def _patterns(spark, sf):
    return out(candles(spark, sf), *(c.cast("long").alias(n) for n, c in I.patterns().items()))


# ---- Structure, time, price action, regimes ----------------------------------------------------------------------------


#: One bar a step: a rising leg ends when a low lies under its highest high by more than the threshold, a falling one likewise.
ZIGZAG = f"""{GIVEN}, bars AS MATERIALIZED (SELECT instrument, bar_idx, high::FLOAT AS h, low::FLOAT AS l, coalesce(atr, 0) * {float(config.SWING_ATR)}::DOUBLE AS gap FROM given),
legs AS (SELECT instrument, bar_idx, true AS rising, h AS extreme, l AS floor_, h AS ceiling_ FROM bars WHERE bar_idx = 0
UNION ALL SELECT b.instrument, b.bar_idx, CASE WHEN s.rising THEN NOT (b.h <= s.extreme AND b.l::DOUBLE < s.extreme::DOUBLE - b.gap) ELSE b.l >= s.extreme AND b.h::DOUBLE > s.extreme::DOUBLE + b.gap END,
  CASE WHEN s.rising THEN CASE WHEN b.h > s.extreme THEN b.h WHEN b.l::DOUBLE < s.extreme::DOUBLE - b.gap THEN b.l ELSE s.extreme END
    ELSE CASE WHEN b.l < s.extreme THEN b.l WHEN b.h::DOUBLE > s.extreme::DOUBLE + b.gap THEN b.h ELSE s.extreme END END,
  CASE WHEN NOT s.rising AND b.l >= s.extreme AND b.h::DOUBLE > s.extreme::DOUBLE + b.gap THEN s.extreme ELSE s.floor_ END,
  CASE WHEN s.rising AND b.h <= s.extreme AND b.l::DOUBLE < s.extreme::DOUBLE - b.gap THEN s.extreme ELSE s.ceiling_ END
  FROM legs s JOIN bars b ON b.instrument = s.instrument AND b.bar_idx = s.bar_idx + 1)"""


@query("zigzag_sr", sql("SELECT c.instrument, c.t, round(s.floor_::DOUBLE, 4) AS support, round(s.ceiling_::DOUBLE, 4) AS resistance FROM candles c LEFT JOIN legs s ON s.instrument = c.instrument AND s.bar_idx = greatest(c.bar_idx, 1)", ZIGZAG))
def _zigzag(spark, sf):
    return out(I.zigzag(given(spark, sf).na.fill(0.0, ["atr"]), "atr"), r(C("support").cast("double"), 4).alias("support"), r(C("resistance").cast("double"), 4).alias("resistance"))


@query("bfill_sr", sql(f"SELECT instrument, t, round(first_value(slow IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS filled FROM given", GIVEN))
def _bfill(spark, sf):
    return out(given(spark, sf), r(back_fill(C("slow"))).alias("filled"))


FRACTAL = f"""{BASE}, w AS (SELECT *, count(*) OVER f AS n, min(low) OVER f AS lo, max(high) OVER f AS hi FROM candles WINDOW f AS ({W} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
m AS (SELECT *, CASE WHEN n = 21 AND low = lo THEN low END AS pl, CASE WHEN n = 21 AND high = hi THEN high END AS ph FROM w)"""


@query("fractal_sr", sql(f"SELECT instrument, t, round(last_value(pl IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 6) AS support, round(last_value(ph IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 6) AS resistance FROM m", FRACTAL))
def _fractal(spark, sf):
    return out(I.fractals(candles(spark, sf)), r("support").alias("support"), r("resistance").alias("resistance"))


HOUR = "(t // 3600) % 24"
SESSION_SQL = "CASE " + " ".join(f"WHEN {HOUR} <= {e} THEN '{s}'" for s, e in config.SESSIONS) + " END"


@query("session", sql(f"SELECT instrument, t, {SESSION_SQL} AS session FROM candles"))
def _session(spark, sf):
    return out(candles(spark, sf), I.session(F.hour("time")).alias("session"))


@query("hour_weekday", sql(f"SELECT instrument, t, {HOUR} AS hour, (t // 86400 + 3) % 7 AS weekday FROM candles"))
def _hour(spark, sf):
    return out(candles(spark, sf), F.hour("time").cast("long").alias("hour"), F.weekday("time").cast("long").alias("weekday"))


ACTION = {"bullish_ratio": "(CASE WHEN close > open THEN 1 ELSE 0 END)", "avg_body": "abs(close - open)", "avg_range": "(high - low)"}


@query("bullish_ratio", sql("SELECT instrument, t, " + ", ".join(f"round({mean(ACTION['bullish_ratio'], n)}, 6) AS bullish_ratio_last_{n}" for n in config.ACTION_WINDOWS) + " FROM candles"))
def _bullish(spark, sf):
    return out(candles(spark, sf), *(r(c).alias(n) for n, c in I.price_action().items() if n.startswith("bullish")))


@query("avg_body_range", sql("SELECT instrument, t, " + ", ".join(f"round({mean(ACTION[k], n)}, 6) AS {k}_last_{n}" for n in config.ACTION_WINDOWS for k in ("avg_body", "avg_range")) + " FROM candles"))
def _body(spark, sf):
    return out(candles(spark, sf), *(r(c).alias(n) for n, c in I.price_action().items() if n.startswith("avg")))


@query("live_price_action", sql("SELECT instrument, t, " + ", ".join(f"round({mean(x, n, 1)}, 6) AS {k}_last_{n}" for n in config.ACTION_WINDOWS for k, x in ACTION.items()) + " FROM candles"))
def _live_action(spark, sf):
    return out(candles(spark, sf), *(r(c).alias(n) for n, c in I.price_action(live=True).items()))


@query("trend_regime", sql("SELECT instrument, t, CASE WHEN adx > 25 THEN 'trend' ELSE 'range' END AS trend_regime FROM given", GIVEN))
def _trend(spark, sf):
    return out(given(spark, sf), I.trend_regime("adx").alias("trend_regime"))


VOL = f"{GIVEN}, vol AS (SELECT *, {mean('atr', 50)} AS usual FROM given)"


@query("vol_regime", sql("SELECT instrument, t, CASE WHEN atr > usual THEN 'high_vol' ELSE 'low_vol' END AS vol_regime FROM vol", VOL))
def _vol(spark, sf):
    return out(given(spark, sf), I.volatility_regime("atr").alias("vol_regime"))


@query("warmup_trim", sql("SELECT instrument, t, bar_idx FROM candles JOIN (SELECT instrument FROM candles GROUP BY 1 HAVING count(*) >= 300) USING (instrument) WHERE bar_idx >= 200"))
def _trim(spark, sf):
    return out(I.trim(candles(spark, sf)), "bar_idx")


@query("downcast", sql("SELECT instrument, t, round(close::FLOAT::DOUBLE, 3) AS close, bar_idx::INT::BIGINT AS bar_idx FROM candles"))
def _downcast(spark, sf):
    return out(I.downcast(candles(spark, sf)), r(C("close").cast("double"), 3).alias("close"), C("bar_idx").cast("long").alias("bar_idx"))


@query("concat_features")
def _features(spark, sf):
    df = I.features(candles(spark, sf))
    return out(df, *(r(C(n).cast("double"), 4).alias(n) if kind in ("double", "float") else n for n, kind in df.dtypes if n not in ("instrument", "time")))


# ---- Enrichment and gold ------------------------------------------------------------------------------------------------

ENRICHED = f"""{TRADES}, enriched AS MATERIALIZED (SELECT r.*, g.atr, g.sma, g.slow, {', '.join(
    f"({k}_price - g.{x}) / CASE WHEN g.atr = 0 THEN 1e-5 ELSE g.atr END AS {k}_dist_to_{x}_atr, CASE WHEN abs(g.{x} - entry_price) < 1e-9 THEN 0 ELSE coalesce(({k}_price - entry_price) / (g.{x} - entry_price), 0) END AS {k}_place_pct_to_{x}, ({k}_price - g.{x}) / entry_price * 1e4 AS {k}_dist_to_{x}_bps"
    for x in ('sma', 'slow') for k in ('sl', 'tp'))} FROM trades r JOIN given g ON g.instrument = r.instrument AND g.bar_idx = r.entry_idx WHERE g.slow IS NOT NULL)"""


def enriched(spark, sf):
    g = given(spark, sf)
    return E.enrich(trades(spark, sf), g.where("slow IS NOT NULL"), ["sma", "slow"], "atr")


KEYS4 = ["instrument", "entry_idx", "trade_type", "sl_ratio", "tp_ratio"]


@query("enrich_join", sql("SELECT instrument, count(*) AS n FROM enriched GROUP BY 1", ENRICHED))
def _enrich_join(spark, sf):
    return enriched(spark, sf).groupBy("instrument").agg(F.count("*").alias("n"))


@query("atr_distance", sql(f"SELECT {', '.join(KEYS4)}, round(sl_dist_to_sma_atr, 4) AS sl_atr, round(tp_dist_to_slow_atr, 4) AS tp_atr FROM enriched", ENRICHED))
def _atr_distance(spark, sf):
    return enriched(spark, sf).select(*KEYS4, r("sl_dist_to_sma_atr", 4).alias("sl_atr"), r("tp_dist_to_slow_atr", 4).alias("tp_atr"))


@query("safe_divide", "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 0 ELSE round(value / (user_id % 3), 6) END AS ratio FROM events")
def _safe_divide(spark, sf):
    return read(spark, sf, "events").select("event_id", r(safe_divide(C("value"), (C("user_id") % 3).cast("double"))).alias("ratio"))


@query("vector_scale", sql(f"SELECT {', '.join(KEYS4)}, round(sl_place_pct_to_sma, 3) AS sl_scale, round(tp_place_pct_to_slow, 3) AS tp_scale FROM enriched WHERE abs(sma - entry_price) > 0.01 AND abs(slow - entry_price) > 0.01", ENRICHED))
def _scale(spark, sf):
    g = given(spark, sf).select("instrument", C("bar_idx").alias("entry_idx"), "sma", "slow")
    return enriched(spark, sf).join(g, ["instrument", "entry_idx"]).where("abs(sma - entry_price) > 0.01 AND abs(slow - entry_price) > 0.01").select(*KEYS4, r("sl_place_scale_sma", 3).alias("sl_scale"), r("tp_place_scale_slow", 3).alias("tp_scale"))


@query("place_pct_dist_bps", sql(f"SELECT {', '.join(KEYS4)}, round(sl_dist_to_sma_bps, 4) AS sl_bps, round(tp_dist_to_slow_bps, 4) AS tp_bps FROM enriched", ENRICHED))
def _bps(spark, sf):
    return enriched(spark, sf).select(*KEYS4, r("sl_dist_to_sma_bps", 4).alias("sl_bps"), r("tp_dist_to_slow_bps", 4).alias("tp_bps"))


RELATIONAL = {"open": ("close",), "high": ("close", "open"), "low": ("close", "open"), "SMA_20": ("close",), "SMA_200": ("close",)}


def with_sma(spark, sf):
    return candles(spark, sf).withColumns({"SMA_20": I.sma(20), "SMA_200": I.sma(200)})


@query("relational", sql("SELECT instrument, t, " + ", ".join(f"round(({x} - {a}) / nullif({a}, 0), 8) AS {x}_rel_{a}" for x, anchors in RELATIONAL.items() for a in anchors) + ", round((close - SMA_200) / SMA_200, 8) AS close_rel_SMA_200 FROM s", f"{BASE}, s AS (SELECT *, {mean('close', 20)} AS SMA_20, {mean('close', 200)} AS SMA_200 FROM candles)"))
def _relational(spark, sf):
    df = E.relational(with_sma(spark, sf))
    return out(df, *(r(c, 8).alias(c) for c in df.columns if "_rel_" in c))


@query("drop_absolute", sql("SELECT unnest(['bar_idx', 'close_rel_SMA_200', 'high_rel_close', 'high_rel_open', 'instrument', 'low_rel_close', 'low_rel_open', 'open_rel_close', 'SMA_200_rel_close', 'SMA_20_rel_close', 'time']) AS name"))
def _drop_absolute(spark, sf):
    return spark.createDataFrame([(c,) for c in E.relational(with_sma(spark, sf)).columns], "name string")


@query("one_hot", sql("SELECT instrument, t, " + ", ".join(f"({SESSION_SQL} = '{s}')::INT::DOUBLE AS session_{s}" for s, _ in config.SESSIONS) + " FROM candles"))
def _one_hot(spark, sf):
    df = E.one_hot(candles(spark, sf).withColumn("session", I.session(F.hour("time"))))
    return out(df, *(f"session_{s}" for s, _ in config.SESSIONS))


@query("compress_patterns", "SELECT event_id, CASE WHEN x >= 100 THEN 1.0 WHEN x > 0 THEN 0.5 WHEN x <= -100 THEN -1.0 WHEN x < 0 THEN -0.5 ELSE 0.0 END::DOUBLE AS score FROM (SELECT event_id, (event_id % 9 - 4) * 50 AS x FROM events)")
def _compress(spark, sf):
    return read(spark, sf, "events").select("event_id", E.compress((C("event_id") % 9 - 4) * 50).alias("score"))


Z = f"""{BASE}, z0 AS (SELECT *, count(*) OVER f AS n, avg(volume) OVER f AS m, stddev_samp(volume) OVER f AS s FROM candles WINDOW f AS ({W} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
z1 AS (SELECT *, CASE WHEN n >= 20 AND s > 1e-12 THEN (volume - m) / s END AS z FROM z0)"""


@query("rolling_zscore", sql(f"SELECT instrument, t, round(coalesce(first_value(z IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 4) AS z FROM z1", Z))
def _zscore(spark, sf):
    return out(E.rolling_zscore(candles(spark, sf), ["volume"]), r("volume", 4).alias("z"))


@query("live_zscore", sql("SELECT instrument, t, round(coalesce(CASE WHEN n >= 2 AND s > 1e-12 THEN (volume - m) / s END, 0), 4) AS z FROM z0", Z))
def _live_zscore(spark, sf):
    return out(E.rolling_zscore(candles(spark, sf), ["volume"], least=2, fill="zero"), r("volume", 4).alias("z"))


@query("gold_driver")
def _gold(spark, sf):
    df = E.gold(I.features(candles(spark, sf)))
    return out(df, *(r(C(n).cast("double"), 3).alias(n) for n in df.columns if n not in ("instrument", "time", "bar_idx")))


@query("live_features")
def _live(spark, sf):
    df = E.gold(I.features(candles(spark, sf), live=True), live=True)
    return out(df, *(r(C(n).cast("double"), 3).alias(n) for n in df.columns if n not in ("instrument", "time", "bar_idx")))


# ---- Blueprints ---------------------------------------------------------------------------------------------------------


@query("ratio_round", sql("SELECT instrument, entry_idx, trade_type, sl_ratio, tp_ratio, round(sl_ratio::FLOAT::DOUBLE, 5) AS sl5, round(tp_ratio::FLOAT::DOUBLE, 5) AS tp5 FROM trades", TRADES))
def _ratio_round(spark, sf):
    return trades(spark, sf).select(*KEYS4, *(F.bround(C(c).cast("float").cast("double"), 5).alias(n) for c, n in (("sl_ratio", "sl5"), ("tp_ratio", "tp5"))))


@query("bin_pct", "SELECT event_id, floor((value - 50) / 17 * 10)::DOUBLE AS bin FROM events")
def _bin_pct(spark, sf):
    return read(spark, sf, "events").select("event_id", P.bin_pct((C("value") - 50) / 17).alias("bin"))


@query("bin_bps", "SELECT event_id, (floor((value - 50) / 5) * 5)::DOUBLE AS bin FROM events")
def _bin_bps(spark, sf):
    return read(spark, sf, "events").select("event_id", P.bin_bps(C("value") - 50).alias("bin"))


@query("outlier_filter", "SELECT event_id, floor((value - 50) / 17 * 10)::DOUBLE AS bin FROM events WHERE floor((value - 50) / 17 * 10) BETWEEN -20 AND 20")
def _outlier(spark, sf):
    return read(spark, sf, "events").select("event_id", P.bin_pct((C("value") - 50) / 17).alias("bin")).where("bin BETWEEN -20 AND 20")


def kind_sql(own: str, kind: str, level: str) -> str:
    other = "tp" if own == "sl" else "sl"
    bin_ = f"floor({own}_place_pct_to_{level} * 10)" if kind == "Pct" else f"floor({own}_dist_to_{level}_bps / 5) * 5"
    ends = {own: (f"'{level}'", bin_), other: ("'ratio'", f"round({other}_ratio, 5)")}
    most = 20 if kind == "Pct" else 50
    return f"SELECT instrument, t, trade_type, '{own.upper()}-{kind}' AS type, {ends['sl'][0]} AS sl_def, {ends['sl'][1]}::DOUBLE AS sl_bin, {ends['tp'][0]} AS tp_def, {ends['tp'][1]}::DOUBLE AS tp_bin FROM enriched WHERE {bin_} BETWEEN -{most} AND {most}"


#: Placements by tenths of the way are compared for the far level only where no bin edge is near (see ``vector_scale``).
PLACED = ENRICHED + ", placed AS (" + " UNION ALL ".join(kind_sql(o, "BPS", x) for x in ("sma", "slow") for o in ("sl", "tp")) + """),
counts AS MATERIALIZED (SELECT instrument, type, sl_def, sl_bin, tp_def, tp_bin, trade_type, t, count(*) AS trade_count,
  substr(sha256(concat_ws('-', type, sl_def, printf('%.5f', sl_bin), tp_def, printf('%.5f', tp_bin), trade_type)), 1, 16) AS key FROM placed GROUP BY instrument, type, sl_def, sl_bin, tp_def, tp_bin, trade_type, t),
catalogue AS (SELECT instrument, key, type, sl_def, sl_bin, tp_def, tp_bin, trade_type, count(DISTINCT t) AS num_candles FROM counts GROUP BY ALL HAVING count(DISTINCT t) >= 20)"""


def all_counts(spark, sf):
    """Blueprints of all four types."""
    return P.count_blueprints(enriched(spark, sf), ["sma", "slow"])


def counts(spark, sf):
    """The two types that SQL tells too: those by pips. Queries named ``_all`` have all four."""
    return all_counts(spark, sf).where("type LIKE '%BPS'")


def catalogue(spark, sf):
    return P.combinations(counts(spark, sf), 20)


@query("blueprint_agg", sql("SELECT instrument, type, sl_def, sl_bin, tp_def, tp_bin, trade_type, t, trade_count FROM counts", PLACED))
def _blueprint_agg(spark, sf):
    return counts(spark, sf).select("instrument", "type", "sl_def", "sl_bin", "tp_def", "tp_bin", "trade_type", t("entry_time"), "trade_count")


@query("blueprint_agg_all")
def _blueprint_agg_all(spark, sf):
    return all_counts(spark, sf).select("instrument", "type", "sl_def", "sl_bin", "tp_def", "tp_bin", "trade_type", t("entry_time"), "trade_count")


@query("blueprint_agg_pct")
def _blueprint_pct(spark, sf):
    return P.count_blueprints(enriched(spark, sf), ["sma", "slow"]).where("type LIKE '%Pct'").groupBy("instrument", "type", "trade_type").agg(F.count("*").alias("n"), F.sum("trade_count").alias("trades"))


@query("blueprint_key", "SELECT event_id, substr(sha256(concat_ws('-', event_type, printf('%.5f', value))), 1, 16) AS key FROM events")
def _key(spark, sf):
    return read(spark, sf, "events").select("event_id", P.key(C("event_type"), F.format_string("%.5f", "value")).alias("key"))


@query("shuffle_shards", "SELECT event_id, (('0x' || substr(sha256(event_type || event_id), 1, 16))::UBIGINT % 128)::BIGINT AS shard FROM events")
def _shards(spark, sf):
    return read(spark, sf, "events").select("event_id", P.shard(P.key(F.concat("event_type", C("event_id").cast("string")))).cast("long").alias("shard"))


@query("consolidate", sql("SELECT c.instrument, c.key, t, sum(trade_count)::BIGINT AS trade_count FROM counts c JOIN (SELECT instrument, key FROM catalogue) k ON k.instrument = c.instrument AND k.key = c.key GROUP BY ALL", PLACED))
def _consolidate(spark, sf):
    return P.targets(counts(spark, sf), catalogue(spark, sf)).select("instrument", "key", t("entry_time"), "trade_count")


@query("combinations", sql("SELECT * FROM catalogue", PLACED))
def _combinations(spark, sf):
    return catalogue(spark, sf)


@query("consolidate_all")
def _consolidate_all(spark, sf):
    found = all_counts(spark, sf)
    return P.targets(found, P.combinations(found, 20)).select("instrument", "key", t("entry_time"), "trade_count")


@query("combinations_all")
def _combinations_all(spark, sf):
    return P.combinations(all_counts(spark, sf), 20)


# ---- Rules --------------------------------------------------------------------------------------------------------------

STATE = """cat AS (SELECT 'k' || p_partkey AS key, p_size::BIGINT * 5 AS num_candles FROM part), done AS (SELECT 'k' || p_partkey AS key FROM part WHERE p_partkey % 4 = 0), tired AS (SELECT 'k' || p_partkey AS key FROM part WHERE p_partkey % 6 = 0), bad AS (SELECT 'k' || p_partkey AS key, 'r' || (p_partkey % 5) AS market_rule FROM part WHERE p_partkey % 5 < 2)"""


def state(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_size", F.concat(F.lit("k"), C("p_partkey").cast("string")).alias("key"))
    cat = p.select("key", (C("p_size").cast("long") * 5).alias("num_candles"))
    bad = p.where("p_partkey % 5 < 2").select("key", F.concat(F.lit("r"), (C("p_partkey") % 5).cast("string")).alias("market_rule"))
    return cat, p.where("p_partkey % 4 = 0").select("key"), p.where("p_partkey % 6 = 0").select("key"), bad


@query("pending_keys", f"WITH {STATE} SELECT * FROM cat WHERE num_candles >= 100 AND key NOT IN (SELECT key FROM tired) AND key NOT IN (SELECT key FROM done)")
def _pending(spark, sf):
    cat, done, tired, _ = state(spark, sf)
    return R.pending(cat, tired, done)


@query("improvement_keys", f"WITH {STATE} SELECT * FROM cat WHERE num_candles >= 100 AND key IN (SELECT key FROM bad) AND key NOT IN (SELECT key FROM tired)")
def _improvable(spark, sf):
    cat, _, tired, bad = state(spark, sf)
    return R.improvable(cat, bad, tired)


@query("exclusion_rules", f"WITH {STATE}, good AS (SELECT key, 'g' AS market_rule FROM done) SELECT key, string_agg(market_rule, '|' ORDER BY market_rule) AS rules FROM (SELECT * FROM good UNION SELECT * FROM bad) GROUP BY 1")
def _exclusions(spark, sf):
    _, done, _, bad = state(spark, sf)
    return R.exclusions(done.withColumn("market_rule", F.lit("g")), bad).select("key", F.concat_ws("|", "rules").alias("rules"))


RULES = ["`sma` > 999.5 and `volume` > 2", "`adx` <= 40 and `close` > 1000.5", "`slow` <= 1000.25"]
RULES_SQL = [x.replace("`", '"') for x in RULES]
HEAT = "(instrument, bar_idx, trade_count)"
DENSITY = f"{TRADES}, dense AS MATERIALIZED (SELECT g.*, coalesce(n, 0)::BIGINT AS trade_count FROM given g LEFT JOIN (SELECT instrument, entry_idx AS bar_idx, count(*) AS n FROM trades WHERE outcome = 'win' GROUP BY ALL) USING (instrument, bar_idx))"


def dense(spark, sf):
    n = trades(spark, sf).where("outcome = 'win'").groupBy("instrument", C("entry_idx").alias("bar_idx")).agg(F.count("*").alias("trade_count"))
    return given(spark, sf).join(n, ["instrument", "bar_idx"], "left").na.fill(0, ["trade_count"]).withColumn("key", C("instrument"))


@query("target_join", sql("SELECT instrument, t, trade_count FROM dense", DENSITY))
def _target_join(spark, sf):
    return out(dense(spark, sf), "trade_count")


@query("rule_zeroing", sql(f"SELECT instrument, t, CASE WHEN {' OR '.join(f'({x})' for x in RULES_SQL[:2])} THEN 0 ELSE trade_count END AS trade_count FROM dense", DENSITY))
def _zeroing(spark, sf):
    return out(R.zeroed(dense(spark, sf), RULES[:2]), "trade_count")


@query("baseline_density", sql("SELECT instrument AS key, round(avg(trade_count), 6) AS density, count(*) AS n_candles, sum(trade_count) = 0 AS exhausted FROM dense GROUP BY 1", DENSITY))
def _baseline(spark, sf):
    return R.baseline(dense(spark, sf)).select("key", r("density").alias("density"), "n_candles", "exhausted")


@query("tree_regress")
def _tree(spark, sf):
    return R.mine(dense(spark, sf).where("slow IS NOT NULL"), ["volume", "atr", "adx", "sma", "slow"], lift=1.05, depth=4, least=30)


@query("lift_filter")
def _lift(spark, sf):
    known = spark.createDataFrame([("click", ["`volume` > 2.0"])], "key string, rules array<string>")
    return R.mine(dense(spark, sf).where("slow IS NOT NULL"), ["volume", "atr", "adx"], known, lift=1.1, depth=3, least=30).select("key", "market_rule", "n_candles", r("avg_density", 4).alias("avg_density"))


RAW_RULES = ["`a` > 1.5 and `a` > 2.0 and `b` <= 3.0", "`b` <= 3.0 and `b` <= 1.0E-5", "", "`x y` > -0.5 and `x y` <= 0.5 and `x y` > -2.0"]
RULE_PARTS = """src AS (SELECT unnest(range(4)) AS id, unnest([{0}]) AS rule), parts AS (SELECT id, unnest(regexp_extract_all(rule, '`[^`]+`\\s*(?:<=|>)\\s*-?[0-9.]+(?:[eE][-+]?[0-9]+)?')) AS c FROM src),
bounds AS (SELECT id, regexp_extract(c, '`([^`]+)`', 1) AS f, regexp_extract(c, '(<=|>)', 1) AS s, regexp_extract(c, '(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)$', 1)::DOUBLE AS v FROM parts),
tight AS (SELECT id, f, s, CASE WHEN s = '<=' THEN min(v) ELSE max(v) END AS v FROM bounds GROUP BY id, f, s)""".replace("{0}", ", ".join(f"'{x}'" for x in RAW_RULES))


@query("rule_simplify", f"WITH {RULE_PARTS} SELECT any_value(rule) AS raw, coalesce(string_agg('`' || f || '` ' || s || ' ' || printf('%.6f', v), ' and ' ORDER BY f, s), '') AS market_rule FROM src LEFT JOIN tight ON tight.id = src.id GROUP BY src.id")
def _simplify(spark, sf):
    rules = spark.createDataFrame([(x, x) for x in RAW_RULES], "raw string, market_rule string")
    bound = lambda part: F.substring_index(part, " ", -1)
    told = lambda part: F.concat(F.substring(part, F.lit(1), F.length(part) - F.length(bound(part))), F.format_string("%.6f", bound(part).cast("double")))
    parts = F.filter(F.split("market_rule", " and "), lambda part: part != "")
    return R.simplified(rules).select("raw", F.array_join(F.transform(parts, told), " and ").alias("market_rule"))


@query("strategy_upsert", f"WITH {STATE} SELECT key, market_rule, max(n) AS n_candles FROM (SELECT key, market_rule, 1::BIGINT AS n FROM bad UNION ALL SELECT key, 'r0', 2::BIGINT FROM done) GROUP BY ALL")
def _strategy_upsert(spark, sf):
    _, done, _, bad = state(spark, sf)
    return T.upsert(bad.withColumn("n_candles", F.lit(1).cast("long")), done.select("key", F.lit("r0").alias("market_rule"), F.lit(2).cast("long").alias("n_candles")), ["key", "market_rule"])


# ---- Training matrix and model ----------------------------------------------------------------------------------------------


def matrix(spark, sf):
    g = given(spark, sf).where("slow IS NOT NULL")
    return M.matrix(E.enrich(trades(spark, sf), g, ["sma"], "atr"), g.select("instrument", "time", "bar_idx", "adx", "volume"))


@query("matrix_join", sql("SELECT instrument, count(*) AS n, sum((outcome = 'win')::INT)::BIGINT AS wins, sum((trade_type = 'buy')::INT)::BIGINT AS buys FROM enriched GROUP BY 1", ENRICHED))
def _matrix_join(spark, sf):
    return matrix(spark, sf).groupBy("instrument").agg(F.count("*").alias("n"), F.sum(C("target").cast("long")).alias("wins"), F.sum(C("is_buy").cast("long")).alias("buys"))


@query("matrix_encode", sql("SELECT instrument, t, sl_ratio, tp_ratio, (outcome = 'win')::INT::BIGINT AS target, (trade_type = 'buy')::INT::BIGINT AS is_buy, round(sl_dist_to_sma_atr, 4) AS sl_atr FROM enriched", ENRICHED))
def _matrix_encode(spark, sf):
    return matrix(spark, sf).select("instrument", t("entry_time"), "sl_ratio", "tp_ratio", C("target").cast("long").alias("target"), C("is_buy").cast("long").alias("is_buy"), r("sl_dist_to_sma_atr", 4).alias("sl_atr"))


@query("time_split", sql("SELECT validation, count(*) AS n FROM (SELECT t > (SELECT min(t) FROM (SELECT DISTINCT t FROM enriched ORDER BY t DESC LIMIT (SELECT greatest(1, floor(count(DISTINCT t) * 0.2))::BIGINT FROM enriched))) - 1 AS validation FROM enriched) GROUP BY 1", ENRICHED))
def _split(spark, sf):
    return M.time_split(matrix(spark, sf)).groupBy("validation").agg(F.count("*").alias("n"))


FEATURES = ["sl_ratio", "tp_ratio", "is_buy", "adx", "volume"]


@query("boost_train")
def _boost(spark, sf):
    rows = M.time_split(matrix(spark, sf)).repartition(8, "instrument", "entry_time").cache()
    model = M.boost(rows, FEATURES, rounds=3, depth=3)
    rows.unpersist()
    return M.metrics(M.predict(model, rows.where("validation"), FEATURES))


@query("importance")
def _importance(spark, sf):
    rows = M.time_split(matrix(spark, sf)).repartition(8, "instrument", "entry_time").cache()
    model = M.boost(rows, FEATURES, rounds=2, depth=3)
    rows.unpersist()
    return M.importances(model, FEATURES, spark)


SCORED = "s AS (SELECT (quality)::BIGINT AS target, ((doc_id * 37) % 101) / 101.0::DOUBLE + quality * 0.2 AS score FROM labels)"


@query("metrics", f"""WITH {SCORED}, k AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s)
SELECT round(avg(((score > 0.5)::INT = target)::INT), 6) AS accuracy, round(sum((score > 0.5)::INT * target) / sum((score > 0.5)::INT), 6) AS precision, round(sum((score > 0.5)::INT * target) / sum(target), 6) AS recall,
round((sum(rk * target) - sum(target) * (sum(target) + 1) / 2.0) / (sum(target) * sum(1 - target)), 6) AS roc_auc FROM k""")
def _metrics(spark, sf):
    s = read(spark, sf, "labels").select(C("quality").cast("long").alias("target"), ((C("doc_id") * 37) % 101 / F.lit(101.0) + C("quality") * F.lit(0.2)).alias("score"))
    m = M.metrics(s)
    return m.select(*(r(c).alias(c) for c in m.columns))


# ---- Triggers, backtest, reports ------------------------------------------------------------------------------------------------

HOLDS = f"{GIVEN}, hits AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT instrument, t, bar_idx, 's{i}' AS trigger_key FROM given WHERE {x}" for i, x in enumerate(RULES_SQL)) + ")"


def triggers(spark, sf):
    return R.evaluate(given(spark, sf), [(f"s{i}", x) for i, x in enumerate(RULES)])


@query("rule_eval", sql("SELECT instrument, t, trigger_key FROM hits", HOLDS))
def _rule_eval(spark, sf):
    return out(triggers(spark, sf), "trigger_key")


@query("same_timeframe", "SELECT p_partkey AS market, p_size::BIGINT AS timeframe FROM part WHERE p_size = 15")
def _same_timeframe(spark, sf):
    return B.same_timeframe(read(spark, sf, "part").select(C("p_partkey").alias("market"), C("p_size").cast("long").alias("timeframe")), 15)


@query("strategy_enrich", f"WITH {STATE} SELECT b.key, b.market_rule, c.num_candles, substr(sha256(b.key || '-' || b.market_rule), 1, 16) AS trigger_key FROM bad b LEFT JOIN cat c USING (key)")
def _strategy_enrich(spark, sf):
    cat, _, _, bad = state(spark, sf)
    return B.with_blueprints(bad, cat).select("key", "market_rule", "num_candles", "trigger_key")


@query("new_strategies", f"WITH {STATE} SELECT * FROM bad WHERE key NOT IN (SELECT key FROM done)")
def _new_strategies(spark, sf):
    _, done, _, bad = state(spark, sf)
    return B.new_strategies(bad, done.join(bad, "key"))


#: Three strategies: a ratio pair, a stop beyond a level by tenths, a take beyond a level by pips.
PLANS = [("s0", "SL-Pct", "ratio", 0.001, "ratio", 0.001, "buy"), ("s1", "SL-Pct", "sma", 3.0, "ratio", 0.0015, "sell"), ("s2", "TP-BPS", "ratio", 0.002, "slow", 4.0, "buy")]
PLAN_SQL = "plans AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d}::DOUBLE, '{e}', {f}::DOUBLE, '{g}')" for a, b, c, d, e, f, g in PLANS) + ") p(trigger_key, type, sl_def, sl_bin, tp_def, tp_bin, trade_type))"


def price_sql(kind: str, way: str) -> str:
    level = f"CASE {kind}_def WHEN 'sma' THEN sma WHEN 'slow' THEN slow END"
    return f"CASE WHEN contains({kind}_def, 'ratio') THEN close * (1 + {way} * {kind}_bin) ELSE ({level}) + {way} * CASE WHEN contains(type, 'Pct') THEN abs(close - ({level})) * ({kind}_bin / 10) ELSE {kind}_bin * 0.01::DOUBLE * 10 END END"


SIGN = "(CASE WHEN trade_type = 'buy' THEN 1 ELSE -1 END)"
LOG = f"""{HOLDS}, {PLAN_SQL}, priced AS (SELECT p.*, g.instrument, g.t, g.bar_idx AS entry_idx, g.close AS entry_price, g.atr, g.adx, {price_sql('sl', '-' + SIGN)} AS sl_price, {price_sql('tp', SIGN)} AS tp_price
  FROM hits h JOIN given g ON g.instrument = h.instrument AND g.bar_idx = h.bar_idx JOIN plans p USING (trigger_key)),
ready AS MATERIALIZED (SELECT * FROM priced WHERE sl_price IS NOT NULL AND tp_price IS NOT NULL), ends AS (SELECT instrument, max(bar_idx) AS last FROM candles GROUP BY 1),
touch AS MATERIALIZED (SELECT r.trigger_key, r.instrument, r.entry_idx, min(c.bar_idx) AS j FROM ready r CROSS JOIN (SELECT unnest(range(1, 41)) AS k) JOIN candles c ON c.instrument = r.instrument AND c.bar_idx = r.entry_idx + k WHERE CASE WHEN trade_type = 'buy' THEN c.high >= tp_price OR c.low <= sl_price ELSE c.low <= tp_price OR c.high >= sl_price END GROUP BY ALL),
done AS (SELECT r.*, e.last, t.j, CASE WHEN t.j IS NULL THEN 'expired' WHEN CASE WHEN trade_type = 'buy' THEN c.high >= tp_price ELSE c.low <= tp_price END THEN 'win' ELSE 'loss' END AS outcome
  FROM ready r JOIN ends e USING (instrument) LEFT JOIN touch t ON t.trigger_key = r.trigger_key AND t.instrument = r.instrument AND t.entry_idx = r.entry_idx LEFT JOIN candles c ON c.instrument = r.instrument AND c.bar_idx = t.j),
log AS MATERIALIZED (SELECT *, coalesce(j, least(entry_idx + 40, last)) AS exit_idx, coalesce(j, least(entry_idx + 40, last)) - entry_idx AS duration_candles,
  (CASE outcome WHEN 'win' THEN tp_price WHEN 'loss' THEN sl_price ELSE entry_price END - entry_price) * {SIGN} - 0.03::DOUBLE - (7.0::DOUBLE / 100000) * entry_price AS pnl, instrument AS market,
  CASE WHEN adx > 25 THEN 'trend' ELSE 'range' END AS trend_regime, CASE WHEN atr > 0.5 THEN 'high_vol' ELSE 'low_vol' END AS vol_regime, {SESSION_SQL} AS session FROM done),
full_log AS MATERIALIZED (SELECT *, CASE WHEN atr > 0 THEN pnl / atr END AS pnl_atr_norm FROM log)"""


def log(spark, sf):
    """The deep trade log of the three strategies."""
    plans = spark.createDataFrame(PLANS, "trigger_key string, type string, sl_def string, sl_bin double, tp_def string, tp_bin double, trade_type string")
    g = given(spark, sf)
    side = g.withColumns({"trend_regime_14": I.trend_regime("adx"), "vol_regime_14": F.when(C("atr") > 0.5, "high_vol").otherwise("low_vol"), "session": I.session(F.hour("time")), "RSI_14": C("adx"), "ATR_14": C("atr")})
    return B.backtest(triggers(spark, sf).join(F.broadcast(plans), "trigger_key"), side, g, ["sma", "slow"], F.lit(0.01), F.lit(0.03), 40)


@query("level_sltp", sql("SELECT trigger_key, instrument, t, round(sl_price, 8) AS sl_price, round(tp_price, 8) AS tp_price FROM ready", LOG))
def _level_sltp(spark, sf):
    plans = spark.createDataFrame(PLANS, "trigger_key string, type string, sl_def string, sl_bin double, tp_def string, tp_bin double, trade_type string")
    side = given(spark, sf).select("instrument", "time", C("close").alias("entry_price"), "sma", "slow")
    rows = B.barriers(triggers(spark, sf).join(F.broadcast(plans), "trigger_key").join(side, ["instrument", "time"]), ["sma", "slow"], F.lit(0.01))
    return rows.select("trigger_key", "instrument", t(), r("sl_price", 8).alias("sl_price"), r("tp_price", 8).alias("tp_price"))


@query("backtest_touch", sql("SELECT trigger_key, market, entry_idx, exit_idx, outcome FROM full_log", LOG))
def _backtest_touch(spark, sf):
    return log(spark, sf).select("trigger_key", "market", "entry_idx", "exit_idx", "outcome")


@query("net_pnl", sql("SELECT trigger_key, market, entry_idx, round(pnl, 5) AS pnl FROM full_log", LOG))
def _net_pnl(spark, sf):
    return log(spark, sf).select("trigger_key", "market", "entry_idx", r("pnl", 5).alias("pnl"))


@query("pnl_atr_duration", sql("SELECT trigger_key, market, entry_idx, round(pnl_atr_norm, 4) AS pnl_atr_norm, duration_candles::BIGINT AS duration_candles FROM full_log", LOG))
def _pnl_atr(spark, sf):
    return log(spark, sf).select("trigger_key", "market", "entry_idx", r("pnl_atr_norm", 4).alias("pnl_atr_norm"), C("duration_candles").cast("long").alias("duration_candles"))


@query("deep_log", sql("SELECT trigger_key, market, t, type AS bp_type, trade_type, sl_def, sl_bin, tp_def, tp_bin, trend_regime, vol_regime, session FROM full_log", LOG))
def _deep_log(spark, sf):
    return log(spark, sf).select("trigger_key", "market", t("entry_time"), "bp_type", "trade_type", "sl_def", "sl_bin", "tp_def", "tp_bin", "trend_regime", "vol_regime", "session")


PF = "CASE WHEN abs(sum(CASE WHEN pnl <= 0 THEN pnl ELSE 0 END)) = 0 THEN 'inf'::DOUBLE ELSE sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / abs(sum(CASE WHEN pnl <= 0 THEN pnl ELSE 0 END)) END"
GROUP = ["trigger_key", "market"]


@query("metrics_core", sql(f"SELECT trigger_key, market, count(*) AS total_trades, round({PF}, 4) AS profit_factor, round(avg((pnl > 0)::INT) * 100, 4) AS win_rate, round(coalesce(avg(pnl) FILTER (pnl > 0), 0), 5) AS avg_win, round(coalesce(avg(pnl) FILTER (pnl <= 0), 0), 5) AS avg_loss FROM full_log GROUP BY ALL", LOG))
def _core(spark, sf):
    m = log(spark, sf).groupBy(*GROUP).agg(*B.core())
    return m.select(*GROUP, "total_trades", r("profit_factor", 4).alias("profit_factor"), r("win_rate", 4).alias("win_rate"), r("avg_win", 5).alias("avg_win"), r("avg_loss", 5).alias("avg_loss"))


DRAW = f"""{LOG}, curve AS (SELECT trigger_key, market, entry_idx, sum(pnl) OVER (PARTITION BY trigger_key, market ORDER BY entry_idx ROWS UNBOUNDED PRECEDING) AS c FROM full_log),
peaks AS (SELECT *, max(c) OVER (PARTITION BY trigger_key, market ORDER BY entry_idx ROWS UNBOUNDED PRECEDING) AS p FROM curve)"""


@query("max_drawdown", sql("SELECT trigger_key, market, round(max(p - c), 4) AS max_drawdown_pts FROM peaks GROUP BY ALL", DRAW))
def _drawdown(spark, sf):
    return B.drawdowns(log(spark, sf), GROUP, ["entry_idx"]).select(*GROUP, r("max_drawdown_pts", 4).alias("max_drawdown_pts"))


@query("sqn", sql("SELECT trigger_key, market, round(CASE WHEN stddev_samp(pnl) > 0 THEN sqrt(count(*)) * avg(pnl) / stddev_samp(pnl) ELSE 0 END, 4) AS sqn FROM full_log GROUP BY ALL", LOG))
def _sqn(spark, sf):
    return log(spark, sf).groupBy(*GROUP).agg(B.sqn()).select(*GROUP, r("sqn", 4).alias("sqn"))


MASTER = f"""{DRAW}, perf AS (SELECT trigger_key, market, count(*) AS n, {PF} AS pf, CASE WHEN stddev_samp(pnl) > 0 THEN sqrt(count(*)) * avg(pnl) / stddev_samp(pnl) ELSE 0 END AS q FROM full_log GROUP BY ALL),
dd AS (SELECT trigger_key, market, max(p - c) AS dd FROM peaks GROUP BY ALL), judged AS (SELECT *, pf >= 0.8 AND dd <= 50 AND n >= 20 AND q >= -3 AS master FROM perf JOIN dd USING (trigger_key, market))"""


@query("master_filter", sql("SELECT trigger_key, market, master FROM judged", MASTER))
def _master(spark, sf):
    return B.performance(log(spark, sf), GROUP, ["entry_idx"]).select(*GROUP, B.is_master(0.8, 50.0, 20, -3.0).alias("master"))


@query("blacklist_update", f"WITH {STATE} SELECT key, market_rule FROM bad UNION SELECT key, 'r0' FROM done")
def _blacklist(spark, sf):
    _, done, _, bad = state(spark, sf)
    return B.blacklisted(bad, done.withColumn("market_rule", F.lit("r0")))


DETAIL = f"count(*) AS total_trades, round({PF}, 2) AS profit_factor, round(avg((pnl > 0)::INT) * 100, 2) AS win_rate, round(avg(duration_candles), 2) AS avg_duration, round(avg(pnl_atr_norm), 4) AS avg_pnl_per_atr"


@query("report_detailed", sql(f"SELECT trigger_key, market, {DETAIL} FROM full_log GROUP BY ALL", LOG))
def _detailed(spark, sf):
    return B.report_detailed(log(spark, sf))


@query("report_summary", sql(f"SELECT trigger_key, round(avg(total_trades), 4) AS total_trades, round(avg(win_rate), 4) AS win_rate, round(avg(avg_duration), 4) AS avg_duration FROM (SELECT trigger_key, market, {DETAIL} FROM full_log GROUP BY ALL) GROUP BY 1", LOG))
def _summary(spark, sf):
    return B.report_summary(B.report_detailed(log(spark, sf))).select("trigger_key", *(r(c, 4).alias(c) for c in ("total_trades", "win_rate", "avg_duration")))


@query("report_regime", sql(f"""SELECT trigger_key, 'trend_regime' AS regime_type, trend_regime AS regime_value, {DETAIL} FROM full_log GROUP BY ALL UNION ALL SELECT trigger_key, 'vol_regime', vol_regime, {DETAIL} FROM full_log GROUP BY ALL
UNION ALL SELECT trigger_key, 'session', session, {DETAIL} FROM full_log GROUP BY ALL""", LOG))
def _regime(spark, sf):
    return B.report_regime(log(spark, sf))


# ---- Dashboard ----------------------------------------------------------------------------------------------------------------------

SUMMARY = "summary AS (SELECT s_suppkey AS strategy_id, s_acctbal / 1000 AS avg_profit_factor, (s_suppkey % 5) || '/' || (s_suppkey % 3 + 5) AS validation_markets_passed FROM supplier), mastery AS (SELECT s_suppkey AS strategy_id, CASE WHEN s_suppkey % 9 = 0 THEN 'inf'::DOUBLE ELSE s_acctbal / 50 END AS profit_factor, s_acctbal / 700 AS sharpe_ratio FROM supplier WHERE s_suppkey % 4 <> 1)"


def summary(spark, sf):
    s = read(spark, sf, "supplier")
    one = s.select(C("s_suppkey").alias("strategy_id"), (C("s_acctbal") / 1000).alias("avg_profit_factor"), F.concat((C("s_suppkey") % 5).cast("string"), F.lit("/"), (C("s_suppkey") % 3 + 5).cast("string")).alias("validation_markets_passed"))
    two = s.where("s_suppkey % 4 != 1").select(C("s_suppkey").alias("strategy_id"), F.when(C("s_suppkey") % 9 == 0, float("inf")).otherwise(C("s_acctbal") / 50).alias("profit_factor"), (C("s_acctbal") / 700).alias("sharpe_ratio"))
    return one, two


CAPPED = "CASE WHEN isinf(profit_factor) THEN 100 WHEN profit_factor > 100 THEN 100 ELSE profit_factor END"
VIEW = f"{SUMMARY}, view AS (SELECT s.*, {CAPPED} AS master_profit_factor, CASE WHEN sharpe_ratio > 10 THEN 10 ELSE sharpe_ratio END AS master_sharpe_ratio FROM summary s LEFT JOIN mastery USING (strategy_id))"


@query("master_view", f"WITH {VIEW} SELECT strategy_id, avg_profit_factor, validation_markets_passed, round(master_profit_factor, 6) AS master_profit_factor, round(master_sharpe_ratio, 6) AS master_sharpe_ratio FROM view")
def _master_view(spark, sf):
    return D.master_view(*summary(spark, sf)).select("strategy_id", "avg_profit_factor", "validation_markets_passed", r("master_profit_factor").alias("master_profit_factor"), r("master_sharpe_ratio").alias("master_sharpe_ratio"))


@query("cap_metrics", f"WITH {SUMMARY} SELECT strategy_id, round({CAPPED}, 6) AS profit_factor FROM mastery")
def _cap(spark, sf):
    return summary(spark, sf)[1].select("strategy_id", r(D.capped(C("profit_factor"), 100.0)).alias("profit_factor"))


@query("screen_filter", f"WITH {VIEW} SELECT strategy_id FROM view WHERE avg_profit_factor >= 1 AND coalesce(master_profit_factor, 0) >= 5 AND coalesce(master_sharpe_ratio, 0) <= 9")
def _screen(spark, sf):
    return D.screen(D.master_view(*summary(spark, sf)), {"avg_profit_factor": 1.0, "master_profit_factor": 5.0}, {"master_sharpe_ratio": 9.0}).select("strategy_id")


@query("pass_sort", f"WITH {SUMMARY} SELECT strategy_id, row_number() OVER (ORDER BY split_part(validation_markets_passed, '/', 2)::INT DESC, split_part(validation_markets_passed, '/', 1)::INT DESC, strategy_id) AS position FROM summary ORDER BY position LIMIT 25")
def _pass_sort(spark, sf):
    best = summary(spark, sf)[0].orderBy(*D.pass_order(), "strategy_id").limit(25)
    return best.withColumn("position", F.row_number().over(Window.orderBy(*D.pass_order(), "strategy_id")).cast("long")).select("strategy_id", "position")


@query("manual_blacklist", f"WITH {STATE} SELECT DISTINCT key, market_rule FROM (SELECT * FROM bad UNION ALL SELECT 'k1', 'r1' UNION ALL SELECT 'mine', 'r9')")
def _manual(spark, sf):
    return T.upsert(state(spark, sf)[3], spark.createDataFrame([("k1", "r1"), ("mine", "r9")], "key string, market_rule string"), ["key", "market_rule"])


@query("market_internals", sql("SELECT instrument AS market, round(avg((adx > 25)::INT) * 100, 4) AS pct_trend, round((arg_max(close, bar_idx) - arg_min(close, bar_idx)) / arg_min(close, bar_idx) * 100, 6) AS price_change_pct FROM (SELECT instrument, bar_idx, close, coalesce(adx, 0) AS adx FROM given) GROUP BY 1", GIVEN))
def _internals(spark, sf):
    g = given(spark, sf).withColumns({"trend_regime_14": I.trend_regime("adx"), "vol_regime_14": F.lit("low_vol"), "BB_upper_20": C("high"), "BB_lower_20": C("low")})
    return D.market_internals(g).select("market", r("pct_trend", 4).alias("pct_trend"), r("price_change_pct").alias("price_change_pct"))


@query("perf_union", f"WITH {SUMMARY} SELECT strategy_id, 'master' AS market, sharpe_ratio FROM mastery UNION ALL SELECT strategy_id, 'other', NULL FROM summary")
def _perf_union(spark, sf):
    one, two = summary(spark, sf)
    return D.performance_union(two.select("strategy_id", F.lit("master").alias("market"), "sharpe_ratio"), one.select("strategy_id", F.lit("other").alias("market")))


@query("regime_unpack", "SELECT n_nationkey AS id, unnest(['trend', 'range']) AS regime, unnest([n_nationkey + 0.5, 99.5 - n_nationkey])::DOUBLE AS pct FROM nation")
def _unpack(spark, sf):
    rows = read(spark, sf, "nation").select(C("n_nationkey").alias("id"), F.expr("concat('{''trend'': ', n_nationkey + 0.5, ', ''range'': ', 99.5 - n_nationkey, '}')").alias("d"))
    return D.unpack_regimes(rows, "d", ["id"])


@query("internals_vs_perf", "SELECT n_name AS market, n_nationkey AS score, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 1.5 END, 0)::DOUBLE AS pct_trend FROM nation")
def _internals_vs(spark, sf):
    n = read(spark, sf, "nation").select(C("n_name").alias("market"), C("n_nationkey").alias("score"))
    return D.internals_with_performance(n, n.where("score % 2 = 0").select("market", (C("score") * F.lit(1.5)).alias("pct_trend")))


@query("trade_overlay", sql("SELECT market, t, round(entry_price, 6) AS close, outcome FROM full_log WHERE outcome <> 'expired'", LOG))
def _overlay(spark, sf):
    return D.overlay(log(spark, sf), candles(spark, sf)).select("market", t("entry_time"), r("close").alias("close"), "outcome")


@query("price_series_read", sql("SELECT t, round(close, 6) AS close FROM candles WHERE instrument = 'click'"))
def _series(spark, sf):
    return candles(spark, sf).where("instrument = 'click'").select(t(), r("close").alias("close"))


@query("trade_log_read", sql("SELECT t, round(pnl, 5) AS pnl FROM full_log WHERE trigger_key = 's0' AND market = 'click'", LOG))
def _log_read(spark, sf):
    path = scratch(spark)
    T.write_table(log(spark, sf), path, ["market", "trigger_key"])
    return spark.read.parquet(path).where("trigger_key = 's0' AND market = 'click'").select(t("entry_time"), r("pnl", 5).alias("pnl"))


@query("report_list", "SELECT file, regexp_extract(file, '^(.+)_(detailed|summary|regime)_report[.]csv$', 1) AS instrument, regexp_extract(file, '^(.+)_(detailed|summary|regime)_report[.]csv$', 2) AS kind FROM (SELECT unnest(['EURUSD15_detailed_report.csv', 'X_summary_report.csv', 'notes.txt']) AS file) WHERE regexp_matches(file, '_(detailed|summary|regime)_report[.]csv$')")
def _report_list(spark, sf):
    return D.report_names(spark.createDataFrame([("EURUSD15_detailed_report.csv",), ("X_summary_report.csv",), ("notes.txt",)], "file string"))


@query("heat_map", sql(f"SELECT (t // 86400 + 3) % 7 AS weekday, {HOUR} AS hour, count(*) AS trades, round(avg(pnl), 5) AS avg_pnl FROM full_log GROUP BY ALL", LOG))
def _heat(spark, sf):
    return D.heat_map(log(spark, sf)).select(C("weekday").cast("long").alias("weekday"), C("hour").cast("long").alias("hour"), "trades", r("avg_pnl", 5).alias("avg_pnl"))


@query("duration_histogram", sql("SELECT duration_candles // 10 * 10 AS bars, count(*) AS trades FROM full_log GROUP BY ALL", LOG))
def _durations(spark, sf):
    return D.duration_histogram(log(spark, sf))


@query("equity_curve", sql("SELECT trigger_key, market, entry_idx, round(sum(pnl) OVER (PARTITION BY trigger_key, market ORDER BY entry_idx ROWS UNBOUNDED PRECEDING), 4) AS equity FROM full_log", LOG))
def _equity(spark, sf):
    return D.equity_curve(log(spark, sf), GROUP, ["entry_idx"]).select(*GROUP, "entry_idx", r("equity", 4).alias("equity"))


@query("longest_losing_run", sql("SELECT trigger_key, market, max(n) AS max_consecutive_losses FROM (SELECT trigger_key, market, w, sum((pnl <= 0)::INT)::BIGINT AS n FROM (SELECT *, sum((pnl > 0)::INT) OVER (PARTITION BY trigger_key, market ORDER BY entry_idx ROWS UNBOUNDED PRECEDING) AS w FROM full_log) GROUP BY ALL) GROUP BY ALL", LOG))
def _losing(spark, sf):
    return D.longest_losing_run(log(spark, sf), GROUP, ["entry_idx"])


@query("regime_pivot", sql(f"SELECT trigger_key, max(win_rate) FILTER (v = 'trend') AS trend, max(win_rate) FILTER (v = 'range') AS range FROM (SELECT trigger_key, trend_regime AS v, {DETAIL} FROM full_log GROUP BY ALL) GROUP BY 1", LOG))
def _pivot(spark, sf):
    return D.regime_pivot(B.report_regime(log(spark, sf)).where("regime_type = 'trend_regime'"), ["trend", "range"])


@query("monte_carlo")
def _monte(spark, sf):
    return D.monte_carlo(log(spark, sf), GROUP, 20)


# ---- Live -----------------------------------------------------------------------------------------------------------------------------


def bars(spark, sf):
    return candles(spark, sf).withColumnRenamed("instrument", "symbol")


@query("bar_cache", sql("SELECT instrument AS symbol, t FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY t DESC) AS n FROM candles) WHERE n <= 500"))
def _cache(spark, sf):
    return L.recent(bars(spark, sf)).select("symbol", t())


@query("closed_bar_only", sql("SELECT instrument AS symbol, t FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY t DESC) AS n FROM candles) WHERE n = 2"))
def _closed(spark, sf):
    return L.last_closed(bars(spark, sf)).select("symbol", t())


@query("min_history_guard", sql("SELECT instrument AS symbol, t FROM candles JOIN (SELECT instrument FROM candles GROUP BY 1 HAVING count(*) >= 500) USING (instrument)"))
def _guard(spark, sf):
    return L.enough_history(bars(spark, sf)).select("symbol", t())


@query("signal_match", sql("SELECT h.instrument, h.t, trigger_key FROM hits h JOIN (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY t DESC) AS n FROM candles) c ON c.instrument = h.instrument AND c.bar_idx = h.bar_idx WHERE n = 2", HOLDS))
def _match(spark, sf):
    last = L.last_closed(given(spark, sf).withColumn("symbol", C("instrument")))
    return out(L.signals(last, [(f"s{i}", x) for i, x in enumerate(RULES)]), "trigger_key")


OPENED = "wanted AS (SELECT DISTINCT event_type AS symbol, 'k' || (user_id % 50) AS trigger_key FROM events), opened AS (SELECT event_type AS symbol, 'k' || (user_id % 50) AS trigger_key FROM events WHERE event_id % 9 = 0)"


@query("position_limit", f"WITH {OPENED} SELECT * FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM opened o WHERE o.symbol = w.symbol AND o.trigger_key = w.trigger_key)")
def _limit(spark, sf):
    ev = read(spark, sf, "events").select("event_id", C("event_type").alias("symbol"), F.concat(F.lit("k"), (C("user_id") % 50).cast("string")).alias("trigger_key"))
    return L.within_limit(ev.select("symbol", "trigger_key").distinct(), ev.where("event_id % 9 = 0"))


@query("order_request", sql("SELECT instrument AS symbol, trigger_key, round(entry_price, 2) AS price, round(sl_price, 2) AS sl, round(tp_price, 2) AS tp FROM ready WHERE abs(sl_price * 100 - floor(sl_price * 100) - 0.5) > 1e-4 AND abs(tp_price * 100 - floor(tp_price * 100) - 0.5) > 1e-4 AND abs(entry_price * 100 - floor(entry_price * 100) - 0.5) > 1e-4", LOG))
def _orders(spark, sf):
    plans = spark.createDataFrame(PLANS, "trigger_key string, type string, sl_def string, sl_bin double, tp_def string, tp_bin double, trade_type string")
    side = given(spark, sf).select("instrument", "time", C("close").alias("entry_price"), "sma", "slow", F.lit(2).alias("digits"), C("instrument").alias("symbol"))
    rows = triggers(spark, sf).join(F.broadcast(plans), "trigger_key").join(side, ["instrument", "time"])
    near = " AND ".join(f"abs({c} * 100 - floor({c} * 100) - 0.5) > 1e-4" for c in ("sl_price", "tp_price", "entry_price"))
    priced = B.barriers(rows, ["sma", "slow"], F.lit(0.01)).where(near)
    return L.orders(priced.drop("sl_price", "tp_price"), ["sma", "slow"], F.lit(0.01)).select("symbol", "trigger_key", r("price", 2).alias("price"), r("sl", 2).alias("sl"), r("tp", 2).alias("tp"))


@query("strategy_load", sql("SELECT * FROM plans", PLAN_SQL).replace("SELECT * FROM plans", "SELECT trigger_key AS key, '' AS market_rule, type, sl_def, sl_bin, tp_def, tp_bin, trade_type FROM plans"))
def _load(spark, sf):
    plans = spark.createDataFrame(PLANS, "key string, type string, sl_def string, sl_bin double, tp_def string, tp_bin double, trade_type string")
    return L.load_strategies(plans.withColumn("market_rule", F.lit("")).withColumn("extra", F.lit(1)))


@query("tick_to_candle", sql("SELECT instrument AS symbol, t, round(high, 6) AS high, round(low, 6) AS low, volume FROM candles"))
def _ticks(spark, sf):
    """The streaming query over all ticks as one available batch; in batch mode every window is closed."""
    ticks = K.walk(read(spark, sf, "events")).select(C("instrument").alias("symbol"), C("ts").cast("timestamp").alias("ts"), "price")
    return L.closed_candles(ticks, 60).select("symbol", F.unix_timestamp(C("time")).alias("t"), r("high").alias("high"), r("low").alias("low"), "volume")
