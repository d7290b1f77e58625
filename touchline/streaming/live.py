"""Live signals: ticks to closed candles by event time, bounded bar history, rule matches, position limits and orders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from touchline.operators.backtest import barriers
from touchline.operators.rules import evaluate

C = F.col
CACHE_BARS = 500


def closed_candles(ticks: DataFrame, minutes: int = 15, late: str = "5 minutes") -> DataFrame:
    """Candles of a stream of ``symbol, ts, price``, each once and only when the watermark has passed its end."""
    window = F.window("ts", f"{minutes} minutes")
    found = ticks.withWatermark("ts", late).groupBy(window.alias("w"), "symbol").agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.count("*").cast("double").alias("volume")
    )
    return found.select("symbol", C("w.start").alias("time"), "open", "high", "low", "close", "volume")


def without_overlap(bars: DataFrame, late: str = "1 day") -> DataFrame:
    """Each bar of a symbol once, although sources send the last known bar again."""
    return bars.withWatermark("time", late).dropDuplicatesWithinWatermark(["symbol", "time"])


def recent(bars: DataFrame, n: int = CACHE_BARS) -> DataFrame:
    """The last ``n`` bars of each symbol."""
    return bars.withColumn("__n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("time")))).where(C("__n") <= n).drop("__n")


def last_closed(bars: DataFrame) -> DataFrame:
    """The bar before the last of each symbol: the last one may still change."""
    return bars.withColumn("__n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("time")))).where("__n = 2").drop("__n")


def enough_history(bars: DataFrame, n: int = CACHE_BARS) -> DataFrame:
    counts = bars.groupBy("symbol").agg(F.count("*").alias("n")).where(C("n") >= n)
    return bars.join(counts, "symbol", "left_semi")


def bar_cache(bars: DataFrame, n: int = CACHE_BARS) -> DataFrame:
    """A stream of ``symbol, time, close`` with the number and mean of the last ``n`` closes, kept as bounded state."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for frame in frames:
            frame = frame.sort_values("time", ignore_index=True)
            means, counts = [], []
            for x in frame["close"].tolist():
                held = [*held, x][-n:]
                counts.append(len(held))
                means.append(sum(held) / len(held))
            yield frame.assign(bars=counts, mean_close=means)[["symbol", "time", "close", "bars", "mean_close"]]
        state.update((held,))

    return bars.groupBy("symbol").applyInPandasWithState(update, "symbol string, time timestamp, close double, bars long, mean_close double", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def signals(features: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules that hold on candles, batch or stream: a projection without state."""
    return evaluate(features, rules)


def within_limit(wanted: DataFrame, open_positions: DataFrame, limit: int = 1) -> DataFrame:
    """Signals of a symbol and strategy that has fewer than ``limit`` open positions."""
    counts = open_positions.groupBy("symbol", "trigger_key").agg(F.count("*").alias("__open"))
    return wanted.join(counts, ["symbol", "trigger_key"], "left").where(F.coalesce("__open", F.lit(0)) < limit).drop("__open")


def limited(wanted: DataFrame) -> DataFrame:
    """The first signal of each symbol and strategy of a stream of ``symbol, trigger_key, time``; a position stays open."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("time", ignore_index=True)
        if not state.exists:
            state.update((True,))
            yield rows.iloc[:1][["symbol", "trigger_key", "time"]]

    return wanted.groupBy("symbol", "trigger_key").applyInPandasWithState(update, "symbol string, trigger_key string, time timestamp", "open boolean", "append", GroupStateTimeout.NoTimeout)


def orders(wanted: DataFrame, levels: list[str], pip: Column, lot: float = 0.01) -> DataFrame:
    """Order rows with prices rounded to the symbol's digits; signals without both barriers give none. Nothing is sent."""
    priced = barriers(wanted, levels, pip).where("sl_price > 0 AND tp_price > 0")
    digit = lambda c: F.expr(f"round({c} * pow(10, digits)) / pow(10, digits)")
    return priced.select("symbol", "trigger_key", "trade_type", F.lit(lot).alias("volume"), digit("entry_price").alias("price"), digit("sl_price").alias("sl"), digit("tp_price").alias("tp"))


def load_strategies(table: DataFrame) -> DataFrame:
    needed = ["key", "market_rule", "type", "sl_def", "sl_bin", "tp_def", "tp_bin", "trade_type"]
    if missing := [c for c in needed if c not in table.columns]:
        raise ValueError(f"missing columns: {missing}")
    return table.select(*needed, *(c for c in ("trigger_key", "timeframe") if c in table.columns))


def run_each(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``work`` on each micro-batch, each once when the sink is idempotent by batch number."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).start()
