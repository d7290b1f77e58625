"""Exhaustive first-touch simulation of stop-loss and take-profit grids.

A barrier's first touch depends on the candle, the direction and that barrier alone. So each candle is searched once for
each stop and once for each take, not once for each pair of them; pairs are then formed from the hit bars. Candles are dealt
into blocks of bars with the bars that trades of the block may still see, so that parallelism follows the number of candles
rather than the number of instruments, and a block needs a bounded amount of memory.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline import config


def pip_size(name: Column) -> Column:
    """The exact entry of a name, else the first entry whose key the name contains, else the default."""
    out = F.lit(config.PIP_DEFAULT)
    for key, pip in reversed(config.PIPS.items()):
        out = F.when(name.contains(key), pip).otherwise(out)
    for key, pip in config.PIPS.items():
        out = F.when(name == key, pip).otherwise(out)
    return out


def from_file_name(files: DataFrame, column: str = "file") -> DataFrame:
    """Instrument, timeframe, preset and spread from names like ``EURUSD15.csv``."""
    out = files.withColumn("instrument", F.regexp_extract(column, r"^([A-Za-z0-9]*?)(\d+)\.csv$", 1)).withColumn("timeframe", F.expr(f"try_cast(regexp_extract({column}, '^([A-Za-z0-9]*?)([0-9]+)[.]csv$', 2) AS INT)"))
    presets = files.sparkSession.createDataFrame([(k, g.bars, len(g.ratios(g.stops)), len(g.ratios(g.takes))) for k, g in config.GRIDS.items()], "timeframe int, bars int, stops int, takes int")
    return out.join(F.broadcast(presets), "timeframe").withColumn("spread", F.lit(config.SPREAD_PIPS) * pip_size(F.col("instrument")))


def grid(spark: SparkSession, stops: list[float], takes: list[float]) -> DataFrame:
    """All pairs of ratios in both directions: a few thousand rows at most, given by the preset."""
    frame = lambda name, values: spark.createDataFrame([(float(v),) for v in values], f"{name} double")
    return frame("sl_ratio", stops).crossJoin(F.broadcast(frame("tp_ratio", takes))).crossJoin(F.broadcast(spark.createDataFrame([("buy",), ("sell",)], "trade_type string")))


def barrier(price: Column, ratio: Column, sign: Column) -> Column:
    """``price * (1 + sign * ratio)``: a take of a buy and a stop of a sell lie above."""
    return price * (F.lit(1.0) + sign * ratio)


def full_window(rows: DataFrame, candles: DataFrame, bars: int) -> DataFrame:
    """The rows whose candle has ``bars`` candles after it."""
    last = candles.groupBy("instrument").agg(F.max("bar_idx").alias("__last"))
    return rows.join(last, "instrument").where(F.col("bar_idx") <= F.col("__last") - bars).drop("__last")


def blocked(candles: DataFrame, ahead: int, rows: int = 4096) -> DataFrame:
    """Candles with their block of bars, and as ``entry = false`` the ``ahead`` bars after a block."""
    own = F.floor(F.col("bar_idx") / rows)
    first = F.greatest(F.lit(0), F.ceil((F.col("bar_idx") - ahead - rows + 1) / rows))
    spread = candles.withColumn("block", F.explode(F.sequence(F.least(first, own), own)))
    return spread.withColumn("entry", F.col("block") == own)


def first_hits(values: np.ndarray, barriers: np.ndarray, ahead: int, above: bool) -> np.ndarray:
    """For each entry and barrier the number of bars until ``values`` first reach it (0: not within ``ahead``).

    ``barriers``: entries x barriers. Running extremes of the window are monotone, so a hit is a count of bars before it.
    """
    n = len(barriers)
    padded = np.concatenate((values[1:], np.full(ahead + 1, -np.inf if above else np.inf)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, ahead)[:n]
    out = np.zeros(barriers.shape, np.int32)
    for s in range(0, n, 256):
        extreme = (np.maximum if above else np.minimum).accumulate(windows[s : s + 256], axis=1)
        for k in range(barriers.shape[1]):
            b = barriers[s : s + 256, k, None]
            before = ((extreme < b) if above else (extreme > b)).sum(1)
            out[s : s + 256, k] = np.where(before < ahead, before + 1, 0)
    return out


def first_touch(candles: DataFrame, stops: list[float], takes: list[float], bars: int, spread: float = 0.0, tie: str = "sl", require_full: bool = True) -> DataFrame:
    """Trades that end at a barrier within ``bars`` bars; one row for each candle, direction, stop and take that does.

    A take of a buy is hit when the high reaches it plus the spread; of a sell, when the low reaches it minus the spread. If
    both barriers are hit in one bar, ``tie`` names the one that counts. ``require_full`` leaves out entries near the end.
    """
    sl, tp = np.array(stops), np.array(takes)

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bar_idx", ignore_index=True)
        n = int(frame["entry"].sum())
        price = frame["close"].to_numpy()[:n, None]
        high, low = frame["high"].to_numpy(), frame["low"].to_numpy()
        parts = []
        for name, sign in (("buy", 1), ("sell", -1)):
            stop, take = price * (1 - sign * sl), price * (1 + sign * tp) + sign * spread
            hits = first_hits(low if sign > 0 else high, stop, bars, sign < 0), first_hits(high if sign > 0 else low, take, bars, sign > 0)
            parts.append(frame.iloc[:n][["instrument", "time", "bar_idx", "close"]].assign(trade_type=name, sl_hits=list(hits[0]), tp_hits=list(hits[1])))
        return pd.concat(parts)

    entries = blocked(candles.select("instrument", "time", "bar_idx", "high", "low", "close"), bars)
    hits = entries.groupBy("instrument", "block").applyInPandas(block, "instrument string, time timestamp_ntz, bar_idx long, close double, trade_type string, sl_hits array<int>, tp_hits array<int>")
    if require_full:
        hits = full_window(hits, candles, bars)
    stop_list, take_list = F.array(*map(F.lit, sl.tolist())), F.array(*map(F.lit, tp.tolist()))
    pairs = hits.select("*", F.posexplode("sl_hits").alias("s", "sl_bars")).select("*", F.posexplode("tp_hits").alias("t", "tp_bars"))
    win = (F.col("tp_bars") > 0) & ((F.col("sl_bars") == 0) | (F.col("tp_bars") < F.col("sl_bars") if tie == "sl" else F.col("tp_bars") <= F.col("sl_bars")))
    sign = F.when(F.col("trade_type") == "buy", 1).otherwise(-1)
    pairs = pairs.where("sl_bars > 0 OR tp_bars > 0").withColumn("won", win).withColumn("sl_ratio", F.get(stop_list, "s")).withColumn("tp_ratio", F.get(take_list, "t"))
    return pairs.select(
        "instrument",
        F.col("time").alias("entry_time"),
        F.col("bar_idx").alias("entry_idx"),
        "trade_type",
        F.col("close").alias("entry_price"),
        barrier(F.col("close"), F.col("sl_ratio"), -sign).alias("sl_price"),
        barrier(F.col("close"), F.col("tp_ratio"), sign).alias("tp_price"),
        "sl_ratio",
        "tp_ratio",
        (F.col("bar_idx") + F.when(F.col("won"), F.col("tp_bars")).otherwise(F.col("sl_bars"))).alias("exit_idx"),
        F.when(F.col("won"), "win").otherwise("loss").alias("outcome"),
    )


def with_exit_time(trades: DataFrame, candles: DataFrame) -> DataFrame:
    times = candles.select("instrument", F.col("bar_idx").alias("exit_idx"), F.col("time").alias("exit_time"))
    return trades.join(times, ["instrument", "exit_idx"])


def balanced(trades: DataFrame, chunk: int = config.CHUNK, seed: str = "42") -> DataFrame:
    """All wins, and of each chunk's losses as many as it has wins, chosen by hash; a chunk without wins keeps none."""
    keys = ("instrument", "chunk")
    tagged = trades.withColumn("chunk", F.floor(F.col("entry_idx") / chunk))
    wins = tagged.where("outcome = 'win'").groupBy(*keys).agg(F.count("*").alias("__wins"))
    draw = F.md5(F.concat_ws("|", F.lit(seed), "entry_idx", "trade_type", F.format_string("%.5f", "sl_ratio"), F.format_string("%.5f", "tp_ratio")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__draw"))
    losses = tagged.where("outcome = 'loss'").join(wins, list(keys)).withColumn("__draw", draw).withColumn("__rank", rank).where("__rank <= __wins")
    return tagged.where("outcome = 'win'").unionByName(losses.select(tagged.columns)).drop("chunk")


def by_mode(trades: DataFrame, mode: str) -> DataFrame:
    """``WINS_ONLY``, ``ALL`` or ``BALANCED``."""
    if mode not in ("WINS_ONLY", "ALL", "BALANCED"):
        raise ValueError(f"unknown mode {mode}")
    return trades.where("outcome = 'win'") if mode == "WINS_ONLY" else trades if mode == "ALL" else balanced(trades)


def decode(coded: DataFrame) -> DataFrame:
    """``direction`` 1 or -1 and ``won`` 1 or 0 as words; numbers as floats."""
    out = coded.withColumn("trade_type", F.when(F.col("direction") == 1, "buy").otherwise("sell")).withColumn("outcome", F.when(F.col("won") == 1, "win").otherwise("loss"))
    return out.drop("direction", "won").select(*(F.col(n).cast("float") if t == "double" else F.col(n) for n, t in out.drop("direction", "won").dtypes))


def totals(trades: DataFrame) -> DataFrame:
    return trades.groupBy("outcome").agg(F.count("*").alias("n"))
