"""Technical indicators, candle patterns, market structure, sessions and regimes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline import config
from touchline.functions import folds
from touchline.functions.frames import back_fill, forward_fill, last, order, rolling

C = F.col


def sma(period: int) -> Column:
    return rolling(C("close"), period)


def bands(period: int = config.BB_PERIOD, width: float = config.BB_WIDTH) -> tuple[Column, Column]:
    """Upper and lower Bollinger bands, with the population's deviation."""
    middle = rolling(C("close"), period)
    apart = width * F.stddev_pop("close").over(last(period))
    return middle + apart, middle - apart


def roc(period: int = config.ROC_PERIOD) -> Column:
    before = F.lag("close", period).over(order())
    return F.try_divide(C("close") - before, before) * 100


def cci(period: int = config.CCI_PERIOD) -> Column:
    """(typical - mean) / (0.015 mean absolute deviation around the window's mean)."""
    typical = (C("high") + C("low") + C("close")) / 3
    window = F.collect_list(typical).over(last(period))
    mean = F.avg(typical).over(last(period))
    apart = F.aggregate(window, F.lit(0.0), lambda s, x: s + F.abs(x - mean)) / period
    return F.when(F.count(typical).over(last(period)) >= period, F.try_divide(typical - mean, 0.015 * apart))


def true_range() -> Column:
    before = F.lag("close").over(order())
    return F.greatest(C("high") - C("low"), F.abs(C("high") - before), F.abs(C("low") - before))


def recursive(candles: DataFrame) -> DataFrame:
    """EMA, RSI, MACD histogram, ATR and ADX, in one fold for each instrument."""
    names = [*(f"EMA_{p}" for p in config.EMA_PERIODS), f"RSI_{config.RSI_PERIOD}", "MACD_hist_12_26_9", f"ATR_{config.ATR_PERIOD}", f"ADX_{config.ADX_PERIOD}"]

    def compute(frame):
        import numpy as np

        close, high, low = (frame[c].to_numpy(float) for c in ("close", "high", "low"))
        out = {f"EMA_{p}": folds.exponential(close, 2 / (p + 1), p) for p in config.EMA_PERIODS}
        change = np.diff(close, prepend=close[:1])
        gain, loss = (folds.exponential(np.maximum(s * change, 0), 1 / config.RSI_PERIOD, config.RSI_PERIOD) for s in (1, -1))
        with np.errstate(divide="ignore", invalid="ignore"):
            out[f"RSI_{config.RSI_PERIOD}"] = np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss))
        out[f"RSI_{config.RSI_PERIOD}"][np.isnan(loss)] = np.nan
        fast, slow, signal = config.MACD
        line = folds.exponential(close, 2 / (fast + 1)) - folds.exponential(close, 2 / (slow + 1))
        hist = line - folds.exponential(line, 2 / (signal + 1))
        hist[: slow + signal - 2] = np.nan
        out["MACD_hist_12_26_9"] = hist
        out[f"ATR_{config.ATR_PERIOD}"] = np.nan_to_num(folds.wilder(folds.true_range(high, low, close), config.ATR_PERIOD, 0))
        out[f"ADX_{config.ADX_PERIOD}"] = np.nan_to_num(folds.directional(high, low, close, config.ADX_PERIOD))
        return out

    return folds.fold(candles, dict.fromkeys(names, "double"), compute)


def band_name(multiple: float) -> str:
    return f"{multiple}".replace(".", "p") + "x"


def atr_bands(atr: str = "ATR_14", live: bool = False) -> dict[str, Column]:
    """``close`` plus and minus multiples of the ATR; the live profile has the first multiple only, under a short name."""
    multiples = config.BAND_MULTIPLES[:1] if live else config.BAND_MULTIPLES
    return {f"ATR_level_{side}_{'1x' if live else band_name(m)}_14": C("close") + (m if side == "up" else -m) * C(atr) for m in multiples for side in ("up", "down")}


def patterns() -> dict[str, Column]:
    """Candle patterns as -100, 0 or 100, from bodies, shadows and trailing means of both."""
    at = lambda c, k=0: C(c) if k == 0 else F.lag(c, k).over(order())
    body = lambda k=0: F.abs(at("close", k) - at("open", k))
    size = lambda k=0: at("high", k) - at("low", k)
    up = lambda k=0: at("close", k) > at("open", k)
    down = lambda k=0: at("close", k) < at("open", k)
    before = order().rowsBetween(-10, -1)
    usual = F.avg(F.abs(C("close") - C("open"))).over(before)
    span = F.avg(C("high") - C("low")).over(before)
    upper, lower = C("high") - F.greatest("open", "close"), F.least("open", "close") - C("low")
    long_, short = body() > usual, body() < usual
    falling, rising = at("close", 1) < at("close", 5), at("close", 1) > at("close", 5)
    top, bottom = lambda k: F.greatest(at("open", k), at("close", k)), lambda k: F.least(at("open", k), at("close", k))
    inside = (top(0) < top(1)) & (bottom(0) > bottom(1))
    engulfs = (top(0) >= top(1)) & (bottom(0) <= bottom(1)) & (body() > body(1))
    middle = (at("open", 1) + at("close", 1)) / 2
    star = (body(1) < body(2) * 0.3) & (body() > body(2) * 0.5)
    hammer = short & (lower > 2 * body()) & (upper < 0.1 * span)
    inverted = short & (upper > 2 * body()) & (lower < 0.1 * span)
    steps = lambda side: reduce(lambda a, b: a & b, [side(k) for k in range(3)])
    score = lambda bull, bear=None: F.when(bull, 100).when(bear, -100).otherwise(0) if bear is not None else F.when(bull, 100).otherwise(0)
    bear = lambda c: F.when(c, -100).otherwise(0)
    return {
        "CDLDOJI": score(body() <= 0.1 * span),
        "CDLHAMMER": score(hammer & falling),
        "CDLHANGINGMAN": bear(hammer & rising),
        "CDLINVERTEDHAMMER": score(inverted & falling),
        "CDLSHOOTINGSTAR": bear(inverted & rising),
        "CDLENGULFING": score(up() & down(1) & engulfs, down() & up(1) & engulfs),
        "CDLHARAMI": score(down(1) & inside & (body(1) > usual), up(1) & inside & (body(1) > usual)),
        "CDLMORNINGSTAR": score(down(2) & star & up() & (top(1) < bottom(2)) & (at("close") > (at("open", 2) + at("close", 2)) / 2)),
        "CDLEVENINGSTAR": bear(up(2) & star & down() & (bottom(1) > top(2)) & (at("close") < (at("open", 2) + at("close", 2)) / 2)),
        "CDL3WHITESOLDIERS": score(steps(up) & (at("close") > at("close", 1)) & (at("close", 1) > at("close", 2)) & at("open").between(bottom(1), top(1)) & at("open", 1).between(bottom(2), top(2))),
        "CDL3BLACKCROWS": bear(steps(down) & (at("close") < at("close", 1)) & (at("close", 1) < at("close", 2)) & at("open").between(bottom(1), top(1)) & at("open", 1).between(bottom(2), top(2))),
        "CDLMARUBOZU": score(up() & long_ & (upper < 0.05 * size()) & (lower < 0.05 * size()), down() & long_ & (upper < 0.05 * size()) & (lower < 0.05 * size())),
        "CDLSPINNINGTOP": score(up() & short & (upper > body()) & (lower > body()), down() & short & (upper > body()) & (lower > body())),
        "CDLPIERCING": score(down(1) & (body(1) > usual) & up() & (at("open") < at("low", 1)) & (at("close") > middle) & (at("close") < at("open", 1))),
        "CDLDARKCLOUDCOVER": bear(up(1) & (body(1) > usual) & down() & (at("open") > at("high", 1)) & (at("close") < middle) & (at("close") > at("open", 1))),
    }


def zigzag(candles: DataFrame, atr: str = "ATR_14", multiple: float = config.SWING_ATR, fill: bool = True) -> DataFrame:
    """``support`` and ``resistance`` from confirmed swings; the leading gap is filled backwards unless ``fill`` is off."""

    def compute(frame):
        s, r = folds.swings(frame["high"].to_numpy(float), frame["low"].to_numpy(float), frame[atr].to_numpy(float) * multiple)
        return {"support": s, "resistance": r}

    out = folds.fold(candles, {"support": "float", "resistance": "float"}, compute)
    out = out.withColumns({c: F.when(~F.isnan(c), C(c)) for c in ("support", "resistance")})
    return out.withColumns({c: back_fill(C(c)) for c in ("support", "resistance")}) if fill else out


def fractals(candles: DataFrame, wing: int = 10) -> DataFrame:
    """``support`` and ``resistance`` as the last bar that was the extreme of ``wing`` bars to both sides."""
    window = order().rowsBetween(-wing, wing)
    whole = F.count("*").over(window) == 2 * wing + 1
    low, high = F.when(whole & (C("low") == F.min("low").over(window)), C("low")), F.when(whole & (C("high") == F.max("high").over(window)), C("high"))
    marked = candles.withColumn("__low", low).withColumn("__high", high)
    return marked.withColumn("support", forward_fill(C("__low"))).withColumn("resistance", forward_fill(C("__high"))).drop("__low", "__high")


def session(hour: Column) -> Column:
    out = F.lit(None).cast("string")
    for label, end in reversed(config.SESSIONS):
        out = F.when(hour <= end, label).otherwise(out)
    return out


def calendar() -> dict[str, Column]:
    return {"session": session(F.hour("time")), "hour": F.hour("time"), "weekday": F.weekday("time")}


def price_action(live: bool = False) -> dict[str, Column]:
    """Rolling share of rising candles, mean body and mean range; the live profile starts from the first candle."""
    values = {"bullish_ratio": (C("close") > C("open")).cast("int"), "avg_body": F.abs(C("close") - C("open")), "avg_range": C("high") - C("low")}
    return {f"{name}_last_{n}": rolling(v, n, 1 if live else n) for n in config.ACTION_WINDOWS for name, v in values.items()}


def trend_regime(adx: str = "ADX_14") -> Column:
    return F.when(C(adx) > config.TREND_ADX, "trend").otherwise("range")


def volatility_regime(atr: str = "ATR_14") -> Column:
    return F.when(C(atr) > rolling(C(atr), config.VOLATILITY_MEAN), "high_vol").otherwise("low_vol")


def trim(candles: DataFrame, warmup: int = config.WARMUP_BARS, least: int = config.LEAST_BARS) -> DataFrame:
    """Candles after the warm-up, of instruments that have enough of them."""
    counts = candles.groupBy("instrument").agg(F.count("*").alias("__n")).where(C("__n") >= least)
    return candles.join(counts.drop("__n"), "instrument", "left_semi").where(C("bar_idx") >= warmup)


def downcast(df: DataFrame) -> DataFrame:
    """Doubles as floats and longs as ints, as tables are stored."""
    to = {"double": "float", "bigint": "int"}
    return df.select(*(C(f"`{n}`").cast(to[t]).alias(n) if t in to else C(f"`{n}`") for n, t in df.dtypes))


def levels() -> list[str]:
    """The price levels of a feature table."""
    return [
        *(f"SMA_{p}" for p in config.SMA_PERIODS),
        *(f"EMA_{p}" for p in config.EMA_PERIODS),
        "BB_upper_20",
        "BB_lower_20",
        *atr_bands(),
        "support",
        "resistance",
    ]


def features(candles: DataFrame, live: bool = False) -> DataFrame:
    """All candle features: one fold for what is recursive, then one projection over shared windows."""
    folded = recursive(candles)
    structured = fractals(folded) if live else zigzag(folded)
    upper, lower = bands()
    wide = structured.withColumns({f"SMA_{p}": sma(p) for p in config.SMA_PERIODS} | {"BB_upper_20": upper, "BB_lower_20": lower, "MOM_10": roc(), "CCI_20": cci()})
    wide = wide.withColumns(atr_bands(live=live) | patterns() | calendar() | price_action(live) | {"trend_regime_14": trend_regime(), "vol_regime_14": volatility_regime()})
    return wide if live else trim(wide)


