"""Discovery of strategy blueprints: binned stop and take placements, counted by candle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline import config

C = F.col


def level_names(columns: list[str]) -> list[str]:
    return sorted({m[1] for c in columns if (m := re.match(r"^sl_place_pct_to_(.+)$", c))})


def bin_pct(value: Column) -> Column:
    return F.floor(value * 10).cast("double")


def bin_bps(value: Column, width: float = config.BIN_BPS) -> Column:
    return (F.floor(value / width) * width).cast("double")


def key(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts, joined by hyphens."""
    return F.substring(F.sha2(F.concat_ws("-", *parts), 256), 1, 16)


def shard(key_: Column, shards: int = 128) -> Column:
    """A key's shard: its number modulo ``shards``."""
    return F.pmod(F.conv(key_, 16, 10).cast("decimal(20,0)"), F.lit(shards)).cast("int")


def placements(enriched: DataFrame, levels: list[str]) -> DataFrame:
    """A row for each trade, level and kind of placement: the barrier at a binned distance, the other at a ratio."""
    kinds = []
    for level in levels:
        for own, other in (("sl", "tp"), ("tp", "sl")):
            for kind, column, binned in (("Pct", f"{own}_place_pct_to_{level}", bin_pct), ("BPS", f"{own}_dist_to_{level}_bps", bin_bps)):
                ratio, bin_ = F.round(C(f"{other}_ratio").cast("double"), 5), binned(C(column).cast("double"))
                ends = {own: (F.lit(level), bin_), other: (F.lit("ratio"), ratio)}
                kinds.append(F.struct(F.lit(f"{own.upper()}-{kind}").alias("type"), *(x.alias(f"{e}_{n}") for e in ("sl", "tp") for n, x in zip(("def", "bin"), ends[e], strict=True)), bin_.alias("bin"), F.lit(20.0 if kind == "Pct" else 50.0).alias("most")))
    rows = enriched.select("instrument", "entry_time", "trade_type", F.inline(F.array(*kinds)))
    return rows.where("bin BETWEEN -most AND most").drop("bin", "most")


def count_blueprints(enriched: DataFrame, levels: list[str], outcome: str | None = None) -> DataFrame:
    """``key, entry_time, trade_count`` with the blueprint's six parts. All outcomes count unless one is named.

    Trades are counted before the shuffle, so that what moves is a row for each blueprint, candle and task.
    """
    rows = placements(enriched.where(C("outcome") == outcome) if outcome else enriched, levels)
    names = ["type", "sl_def", "sl_bin", "tp_def", "tp_bin", "trade_type"]
    counts = rows.groupBy("instrument", *names, "entry_time").agg(F.count("*").alias("trade_count"))
    parts = [C(n) if not n.endswith("_bin") else F.format_string("%.5f", n) for n in names]
    return counts.withColumn("key", key(*parts))


def combinations(counts: DataFrame, least: int = config.LEAST_CANDLES) -> DataFrame:
    """The catalogue of blueprints with enough candles."""
    names = ["instrument", "key", "type", "sl_def", "sl_bin", "tp_def", "tp_bin", "trade_type"]
    return counts.groupBy(*names).agg(F.count_distinct("entry_time").alias("num_candles")).where(C("num_candles") >= least)


def targets(counts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Trades by candle of the blueprints in the catalogue."""
    return counts.join(catalogue, ["instrument", "key"], "left_semi").groupBy("instrument", "key", "entry_time").agg(F.sum("trade_count").alias("trade_count"))
