"""Queries over reports: master views, screens, market internals, regimes, and the planned post-mortem charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col
CAPS = {"profit_factor": 100.0, "sharpe_ratio": 10.0}


def report_names(files: DataFrame, column: str = "file") -> DataFrame:
    """Instrument and kind of report files named ``{instrument}_{kind}_report.csv``."""
    pattern = r"^(.+)_(detailed|summary|regime)_report\.csv$"
    return files.where(C(column).rlike(pattern)).withColumn("instrument", F.regexp_extract(column, pattern, 1)).withColumn("kind", F.regexp_extract(column, pattern, 2))


def capped(value: Column, cap: float) -> Column:
    """Infinities and what is above the cap as the cap; nulls stay."""
    return F.when(F.abs(value) == float("inf"), cap).otherwise(F.when(value > cap, cap).otherwise(value))


def master_view(summary: DataFrame, mastery: DataFrame) -> DataFrame:
    """Summary rows with the master market's metrics, null where it has none, capped."""
    names = [c for c in mastery.columns if c != "strategy_id"]
    out = summary.join(mastery.select("strategy_id", *(C(c).alias(f"master_{c}") for c in names)), "strategy_id", "left")
    return out.withColumns({f"master_{c}": capped(C(f"master_{c}"), CAPS[c]) for c in names if c in CAPS})


def screen(view: DataFrame, least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """Rows that meet all thresholds; a missing metric counts as 0."""
    out = view.na.fill(0, subset=[*least, *most])
    for c, x in least.items():
        out = out.where(C(c) >= x)
    for c, x in most.items():
        out = out.where(C(c) <= x)
    return out


def pass_order(column: str = "validation_markets_passed") -> list[Column]:
    """Order of 'a/b': by b, then a, both descending."""
    part = F.split(column, "/")
    return [F.desc_nulls_last(F.expr(f"try_cast(split({column}, '/')[1] AS INT)")), F.desc_nulls_last(part[0].try_cast("int"))]


def market_internals(features: DataFrame) -> DataFrame:
    """Shares of time in trend and in high volatility, mean band width, and the change from first to last close."""
    share = lambda c, v: F.avg((C(c) == v).cast("double")) * 100
    first, last = F.min_by("close", "bar_idx"), F.max_by("close", "bar_idx")
    return features.groupBy(C("instrument").alias("market")).agg(
        share("trend_regime_14", "trend").alias("pct_trend"),
        share("vol_regime_14", "high_vol").alias("pct_high_vol"),
        F.avg(C("BB_upper_20") - C("BB_lower_20")).alias("avg_bb_width"),
        ((last - first) / first * 100).alias("price_change_pct"),
    )


def performance_union(mastery: DataFrame, validation: DataFrame) -> DataFrame:
    return mastery.unionByName(validation, allowMissingColumns=True)


def unpack_regimes(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """A row for each entry of a dict written as text with single quotes; text that is no dict gives none."""
    parsed = F.from_json(F.replace(C(column), F.lit("'"), F.lit('"')), "map<string,double>")
    return rows.select(*keys, F.explode(parsed).alias("regime", "pct"))


def internals_with_performance(performance: DataFrame, internals: DataFrame) -> DataFrame:
    return performance.join(internals, "market", "left").na.fill(0)


def overlay(log: DataFrame, prices: DataFrame) -> DataFrame:
    """Trades as points on the price line, wins and losses told apart."""
    side = prices.select(C("instrument").alias("market"), C("time").alias("entry_time"), "close")
    return log.where("outcome IN ('win', 'loss')").join(side, ["market", "entry_time"]).select("market", "entry_time", "close", "outcome")


def funnel(tested: DataFrame, catalogue: DataFrame, strategies: DataFrame, masters: DataFrame) -> DataFrame:
    """How many candidates each step leaves."""
    out = None
    for i, (name, df) in enumerate((("combinations", tested), ("blueprints", catalogue), ("strategies", strategies), ("masters", masters))):
        row = df.agg(F.count("*").alias("n")).select(F.lit(i).alias("step"), F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def equity_curve(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return log.select(*keys, *order, F.sum("pnl").over(so_far).alias("equity"), F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("trade"))


def monte_carlo(log: DataFrame, keys: list[str], runs: int = 200) -> DataFrame:
    """The largest drawdown of each of ``runs`` seeded reorderings of a strategy's trades."""
    shuffled = log.select(*keys, "entry_idx", "pnl").withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs)))).withColumn("draw", F.xxhash64("run", "entry_idx"))
    so_far = Window.partitionBy(*keys, "run").orderBy("draw", "entry_idx").rowsBetween(Window.unboundedPreceding, 0)
    curve = shuffled.withColumn("sum", F.sum("pnl").over(so_far)).withColumn("peak", F.max("sum").over(so_far))
    return curve.groupBy(*keys, "run").agg(F.max(C("peak") - C("sum")).alias("max_drawdown_pts"))


def regime_pivot(regimes: DataFrame, values: list[str], metric: str = "win_rate") -> DataFrame:
    return regimes.groupBy("trigger_key").pivot("regime_value", values).agg(F.first(metric))


def heat_map(log: DataFrame) -> DataFrame:
    """Mean profit by weekday and hour of entry."""
    return log.groupBy(F.weekday("entry_time").alias("weekday"), F.hour("entry_time").alias("hour")).agg(F.count("*").alias("trades"), F.avg("pnl").alias("avg_pnl"))


def duration_histogram(log: DataFrame, width: int = 10) -> DataFrame:
    return log.groupBy((F.floor(C("duration_candles") / width) * width).alias("bars")).agg(F.count("*").alias("trades"))


def longest_losing_run(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    whole = Window.partitionBy(*keys).orderBy(*order)
    marked = log.withColumn("__run", F.sum((C("pnl") > 0).cast("int")).over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(*keys, "__run").agg(F.sum((C("pnl") <= 0).cast("long")).alias("n"))
    return runs.groupBy(*keys).agg(F.max("n").alias("max_consecutive_losses"))
