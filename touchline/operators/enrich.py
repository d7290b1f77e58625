"""Trades placed relative to price levels, and candle features made ready for learning."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline import config
from touchline.functions.frames import back_fill, order

C = F.col
#: Rows of an instrument that are scaled in one task.
BLOCK_BARS = 4096
#: Anchors, and the columns that are taken relative to each.
ANCHORS = (
    ("close", r"^(open|high|low|SMA_.*|EMA_.*|BB_.*|support|resistance|ATR_level.*)$"),
    ("open", r"^(high|low)$"),
    ("SMA_200", r"^(close)$"),
    ("SMA_20", r"^(BB_upper_20|BB_lower_20)$"),
)


def atr_distance(price: Column, level: Column, atr: Column) -> Column:
    return F.try_divide(price - level, F.when(atr == 0, 1e-5).otherwise(atr))


def place(price: Column, entry: Column, level: Column) -> Column:
    """0 at the entry, 1 at the level; 0 where the two are one, or anything is missing."""
    apart = level - entry
    return F.when(F.abs(apart) < 1e-9, 0.0).otherwise(F.coalesce(F.try_divide(price - entry, apart), F.lit(0.0)))


def bps(price: Column, entry: Column, level: Column) -> Column:
    return F.try_divide(price - level, entry) * 1e4


def enrich(trades: DataFrame, features: DataFrame, levels: list[str], atr: str = "ATR_14") -> DataFrame:
    """Trades with their distances to each level at entry; trades without features at their time go.

    The features of all candles are far fewer than trades, but grow too; the join strategy is left to size estimates.
    """
    side = features.select("instrument", C("time").alias("entry_time"), C(atr).alias("__atr"), *(C(x).cast("double").alias(f"__{x}") for x in levels))
    out = trades.join(side, ["instrument", "entry_time"])
    made: dict[str, Column] = {}
    for x in levels:
        level, entry = C(f"__{x}"), C("entry_price")
        for kind in ("sl", "tp"):
            price = C(f"{kind}_price")
            made[f"{kind}_dist_to_{x}_atr"] = atr_distance(price, level, C("__atr"))
            made[f"{kind}_place_scale_{x}"] = place(price, entry, level)
            made[f"{kind}_place_pct_to_{x}"] = place(price, entry, level)
            made[f"{kind}_dist_to_{x}_bps"] = bps(price, entry, level)
    return out.select(*trades.columns, *(c.alias(n) for n, c in made.items()))


def relational(features: DataFrame) -> DataFrame:
    """``{column}_rel_{anchor}`` for all anchors, then without the absolute columns. A zero anchor gives null.

    Which columns go with which anchor follows from the schema alone.
    """
    present = [(column, anchor) for anchor, pattern in ANCHORS if anchor in features.columns for column in features.columns if re.match(pattern, column)]
    relations = {f"{column}_rel_{anchor}": F.try_divide(C(column) - C(anchor), C(anchor)) for column, anchor in present if column != anchor}
    return features.withColumns(relations).drop("volume", *{name for pair in present for name in pair})


def live_relational(features: DataFrame) -> DataFrame:
    """The live profile: one anchor, and names that end in ``_dist_norm``."""
    targets = [c for c in features.columns if re.match(ANCHORS[0][1], c)]
    return features.withColumns({f"{t}_dist_norm": F.try_divide(C(t) - C("close"), C("close")) for t in targets}).drop(*targets, "close", "volume")


def one_hot(df: DataFrame, categories: dict[str, tuple[str, ...]] = config.CATEGORIES) -> DataFrame:
    """A double 0 or 1 for each value of each categorical column, in place of the column."""
    present = {c: v for c, v in categories.items() if c in df.columns}
    return df.withColumns({f"{c}_{v}": F.coalesce((C(c) == v).cast("double"), F.lit(0.0)) for c, vs in present.items() for v in vs}).drop(*present)


def compress(score: Column) -> Column:
    return F.when(score >= 100, 1.0).when(score > 0, 0.5).when(score <= -100, -1.0).when(score < 0, -0.5).otherwise(0.0)


def compress_patterns(df: DataFrame) -> DataFrame:
    return df.withColumns({c: compress(C(c)) for c in df.columns if c.startswith("CDL")})


def scaled_columns(df: DataFrame, live: bool = False) -> list[str]:
    """Numbers to be scaled: not patterns, one-hots, keys, and (but live) relations and calendar."""
    hot = {f"{c}_{v}" for c, vs in config.CATEGORIES.items() for v in vs}
    numeric = {"double", "float", "int", "bigint"}
    fixed = {"bar_idx"} | (set() if live else {"hour", "weekday"})
    return [n for n, t in df.dtypes if t in numeric and n not in hot | fixed and not n.startswith("CDL") and (live or "_rel_" not in n)]


def rolling_zscore(df: DataFrame, columns: list[str] | None = None, window: int = config.SCALE_WINDOW, least: int | None = None, fill: str = "back") -> DataFrame:
    """(x - mean) / deviation of each column over an instrument's last ``window`` rows. Missing values count as 0.

    Rows without a deviation are filled from the rows after them (``fill='back'``, which looks ahead) or with 0; ``'none'``
    leaves them null. Rows go in blocks that carry the ``window - 1`` rows before them, so that one instrument is many tasks,
    and means and deviations roll on instead of being added up again for each row and column, as a frame of Spark's would.
    """
    columns = scaled_columns(df) if columns is None else columns
    least = max(2, window // 10) if least is None else least
    block, names = max(BLOCK_BARS, window), df.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("__row")
        own = pc.equal(table["__own"], table["__block"]).to_numpy()
        x = pd.DataFrame({c: table[c].to_numpy() for c in columns}).fillna(0.0)
        rolled = x.rolling(window, min_periods=least)
        spread = rolled.std()
        z = ((x - rolled.mean()) / spread).where(spread > 1e-12)[own]
        mine = table.filter(pa.array(own))
        return pa.table({n: pa.array(z[n].to_numpy(), from_pandas=True) if n in columns else mine[n] for n in names})

    rows = df.withColumns({c: C(c).cast("double") for c in columns}).withColumn("__row", F.row_number().over(order()) - 1)
    rows = rows.withColumn("__own", F.floor(C("__row") / block)).withColumn("__ahead", C("__row") % block > block - window)
    rows = rows.withColumn("__block", F.explode(F.when(C("__ahead"), F.array("__own", C("__own") + 1)).otherwise(F.array("__own")))).drop("__ahead")
    schema = ", ".join(f"`{f.name}` {'double' if f.name in columns else f.dataType.simpleString()}" for f in df.schema)
    out = rows.groupBy("instrument", "__block").applyInArrow(run, schema)
    if fill == "none":
        return out
    return out.withColumns({c: F.coalesce(back_fill(C(c)) if fill == "back" else C(c), F.lit(0.0)) for c in columns})


def gold(features: DataFrame, live: bool = False) -> DataFrame:
    """The four steps in order: relations, one-hots, patterns, scaling."""
    related = live_relational(features) if live else relational(features)
    shaped = compress_patterns(one_hot(related))
    return rolling_zscore(shaped, scaled_columns(shaped, live), least=2 if live else None)


