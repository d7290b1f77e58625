"""Strategies on other markets: triggers, cost-aware backtests, metrics, filters and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline import config
from touchline.operators.blueprints import key

C = F.col
INF = float("inf")


def same_timeframe(markets: DataFrame, timeframe: int) -> DataFrame:
    return markets.where(C("timeframe") == timeframe)


def with_blueprints(strategies: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Strategies with their blueprint's parts and a trigger key."""
    return strategies.join(catalogue, "key", "left").withColumn("trigger_key", key(C("key"), C("market_rule")))


def new_strategies(strategies: DataFrame, known: DataFrame) -> DataFrame:
    return strategies.join(known, ["key", "market_rule"], "left_anti")


def level_price(levels: list[str], name: Column) -> Column:
    """The price of the level that ``name`` names; null where there is none."""
    return F.try_element_at(F.map_from_arrays(F.array(*map(F.lit, levels)), F.array(*(C(x).cast("double") for x in levels))), name)


def barriers(triggers: DataFrame, levels: list[str], pip: Column) -> DataFrame:
    """``sl_price`` and ``tp_price`` of triggers that carry ``entry_price, trade_type``, a blueprint and the levels.

    A ratio counts from the entry. A placement is tenths of the way from entry to level, or ten pips for each bin, beyond the
    level. Triggers whose level has no price go.
    """
    sign = F.when(C("trade_type") == "buy", 1).otherwise(-1)
    for kind, way in (("sl", -sign), ("tp", sign)):
        level, bin_ = level_price(levels, C(f"{kind}_def")), C(f"{kind}_bin")
        far = F.when(C("type").contains("Pct"), F.abs(C("entry_price") - level) * (bin_ / 10)).otherwise(bin_ * pip * 10)
        triggers = triggers.withColumn(f"{kind}_price", F.when(C(f"{kind}_def").contains("ratio"), C("entry_price") * (1 + way * bin_)).otherwise(level + way * far))
    return triggers.where("sl_price IS NOT NULL AND tp_price IS NOT NULL")


def touched(entries: DataFrame, candles: DataFrame, bars: int = config.BACKTEST_BARS) -> DataFrame:
    """Entries with ``exit_idx, exit_price, outcome``: the first barrier within ``bars`` bars, the take first in a bar.

    Entries: ``id, instrument, entry_idx, entry_price, trade_type, sl_price, tp_price``. Where no barrier is touched the trade
    expires at its entry price on the last bar it may see. A range join by equal buckets of ``bars`` bars: each entry meets
    the bars of two buckets, and only the earliest touch leaves the join's tasks.
    """
    probes = entries.select("id", "instrument", "entry_idx", "trade_type", "sl_price", "tp_price").withColumn("bucket", F.explode(F.array(F.floor(C("entry_idx") / bars), F.floor(C("entry_idx") / bars) + 1)))
    seen = candles.select("instrument", "bar_idx", "high", "low").withColumn("bucket", F.floor(C("bar_idx") / bars))
    buy = C("trade_type") == "buy"
    take = F.when(buy, C("high") >= C("tp_price")).otherwise(C("low") <= C("tp_price"))
    stop = F.when(buy, C("low") <= C("sl_price")).otherwise(C("high") >= C("sl_price"))
    inside = (C("bar_idx") > C("entry_idx")) & (C("bar_idx") <= C("entry_idx") + bars)
    hits = probes.join(seen, ["instrument", "bucket"]).where(inside & (take | stop)).groupBy("id").agg(F.min(F.struct("bar_idx", F.when(take, 0).otherwise(1).alias("lost"))).alias("hit"))
    ends = candles.groupBy("instrument").agg(F.max("bar_idx").alias("end"))
    out = entries.join(hits, "id", "left").join(ends, "instrument")
    won, lost = C("hit.lost") == 0, C("hit.lost") == 1
    return out.withColumns(
        {
            "exit_idx": F.coalesce("hit.bar_idx", F.least(C("entry_idx") + bars, "end")),
            "exit_price": F.when(won, C("tp_price")).when(lost, C("sl_price")).otherwise(C("entry_price")),
            "outcome": F.when(won, "win").when(lost, "loss").otherwise("expired"),
        }
    ).drop("hit", "end")


def net_pnl(spread: Column, commission: float = config.COMMISSION) -> Column:
    sign = F.when(C("trade_type") == "buy", 1).otherwise(-1)
    return (C("exit_price") - C("entry_price")) * sign - spread - (commission / config.LOT) * C("entry_price")


def with_result(trades: DataFrame, spread: Column, atr: str = "atr") -> DataFrame:
    """``pnl``, ``pnl_atr_norm`` (null without a positive ATR) and ``duration_candles``."""
    return trades.withColumn("pnl", net_pnl(spread)).withColumn("pnl_atr_norm", F.when(C(atr) > 0, C("pnl") / C(atr))).withColumn("duration_candles", (C("exit_idx") - C("entry_idx")).cast("int"))


def backtest(triggers: DataFrame, features: DataFrame, candles: DataFrame, levels: list[str], pip: Column, spread: Column, bars: int = config.BACKTEST_BARS) -> DataFrame:
    """The deep trade log of triggers (``instrument, time, trigger_key`` and a blueprint), with the market's state at entry."""
    state = ["trend_regime_14", "vol_regime_14", "session", "RSI_14", "ATR_14"]
    side = features.select("instrument", "time", "bar_idx", C("close").alias("entry_price"), *levels, *state)
    entries = barriers(triggers.join(side, ["instrument", "time"]), levels, pip)
    entries = entries.withColumnRenamed("bar_idx", "entry_idx").withColumnRenamed("time", "entry_time").withColumn("id", F.xxhash64("trigger_key", "instrument", "entry_idx"))
    done = with_result(touched(entries.drop(*levels), candles, bars), spread, "ATR_14")
    return done.select("trigger_key", C("instrument").alias("market"), "entry_time", "entry_idx", "exit_idx", "duration_candles", "pnl", "pnl_atr_norm", "outcome", C("type").alias("bp_type"), "trade_type", "sl_def", "sl_bin", "tp_def", "tp_bin", C("trend_regime_14").alias("trend_regime"), C("vol_regime_14").alias("vol_regime"), "session", "RSI_14")


def core() -> list[Column]:
    """Trades, profit factor (infinite without a loss), win rate, mean win and mean loss."""
    gain, loss = F.sum(F.when(C("pnl") > 0, C("pnl")).otherwise(0.0)), F.abs(F.sum(F.when(C("pnl") <= 0, C("pnl")).otherwise(0.0)))
    return [
        F.count("*").alias("total_trades"),
        F.when(loss == 0, F.lit(INF)).otherwise(F.try_divide(gain, loss)).alias("profit_factor"),
        (F.avg((C("pnl") > 0).cast("double")) * 100).alias("win_rate"),
        F.coalesce(F.avg(F.when(C("pnl") > 0, C("pnl"))), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(C("pnl") <= 0, C("pnl"))), F.lit(0.0)).alias("avg_loss"),
    ]


def drawdowns(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The largest fall of cumulative profit below its running peak, which starts at the first trade."""
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    curve = log.withColumn("__sum", F.sum("pnl").over(so_far)).withColumn("__peak", F.max("__sum").over(so_far))
    return curve.groupBy(*keys).agg(F.max(C("__peak") - C("__sum")).alias("max_drawdown_pts"))


def sqn() -> Column:
    """System quality number: root of the number of trades times mean over deviation, 0 without a deviation."""
    spread = F.stddev_samp("pnl")
    return F.when(spread > 0, F.sqrt(F.count("*").cast("double")) * F.avg("pnl") / spread).otherwise(0.0).alias("sqn")


def performance(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return log.groupBy(*keys).agg(*core(), sqn()).join(drawdowns(log, keys, order), keys)


def is_master(profit_factor: float = 1.5, drawdown: float = 0.2, trades: int = 50, quality: float = 1.8) -> Column:
    """Whether all thresholds are met; a missing metric fails."""
    return F.coalesce((C("profit_factor") >= profit_factor) & (C("max_drawdown_pts") <= drawdown) & (C("total_trades") >= trades) & (C("sqn") >= quality), F.lit(False))


def blacklisted(blacklist: DataFrame, failed: DataFrame) -> DataFrame:
    return blacklist.select("key", "market_rule").union(failed.select("key", "market_rule")).distinct()


def detail() -> list[Column]:
    return [F.round(c, 2).alias(n) for c, n in zip(core()[:3], ("total_trades", "profit_factor", "win_rate"), strict=True)] + [F.round(F.avg("duration_candles"), 2).alias("avg_duration"), F.round(F.avg("pnl_atr_norm"), 4).alias("avg_pnl_per_atr")]


def report_detailed(log: DataFrame) -> DataFrame:
    return log.groupBy("trigger_key", "market").agg(*detail())


def report_summary(detailed: DataFrame) -> DataFrame:
    names = [c for c in detailed.columns if c not in ("trigger_key", "market")]
    return detailed.groupBy("trigger_key").agg(*(F.avg(c).alias(c) for c in names))


def report_regime(log: DataFrame) -> DataFrame:
    """The detailed metrics by each kind of regime, from one scan of the log."""
    kinds = F.array(*(F.struct(F.lit(k).alias("regime_type"), C(k).alias("regime_value")) for k in ("trend_regime", "vol_regime", "session")))
    return log.select("trigger_key", "pnl", "pnl_atr_norm", "duration_candles", F.inline(kinds)).groupBy("trigger_key", "regime_type", "regime_value").agg(*detail())
