"""Settings that results depend on. All of them can be passed to the operators instead."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

# Indicator periods, regimes, sessions, pip sizes and thresholds of the strategies' data model.
SMA_PERIODS = (20, 50, 100, 200)
EMA_PERIODS = (8, 13, 21, 50)
BB_PERIOD, BB_WIDTH = 20, 2.0
RSI_PERIOD, ATR_PERIOD, ADX_PERIOD, ROC_PERIOD, CCI_PERIOD = 14, 14, 14, 10, 20
MACD = (12, 26, 9)
BAND_MULTIPLES = (1.0, 2.0)
ACTION_WINDOWS = (3, 5, 10, 20, 50)
SWING_ATR = 2.0
WARMUP_BARS, LEAST_BARS = 200, 300
SCALE_WINDOW = 200
TREND_ADX, VOLATILITY_MEAN = 25.0, 50
#: The last hour of each session.
SESSIONS = (("Tokyo", 0), ("Tokyo_London_Overlap", 8), ("London", 9), ("London_NY_Overlap", 13), ("New_York", 17), ("Sydney", 23))
CATEGORIES = {"session": tuple(s for s, _ in SESSIONS), "trend_regime_14": ("trend", "range"), "vol_regime_14": ("high_vol", "low_vol")}
#: Exact names first, then the first that an instrument's name contains, in this order.
PIPS = {"JPY": 0.01, "XAU": 0.01, "XAG": 0.01, "BTC": 1.0, "ETH": 1.0, "US30": 1.0, "SPX": 0.1}
PIP_DEFAULT = 0.0001
SPREAD_PIPS, COMMISSION, LOT = 3.0, 7.0, 100_000.0
BIN_BPS, LEAST_CANDLES, TREE_DEPTH, LEAST_LEAF, LIFT = 5.0, 100, 7, 50, 1.5
BACKTEST_BARS, CHUNK = 500, 5000


@dataclass(frozen=True)
class Grid:
    """Stop-loss and take-profit ratios from a start to before an end, and how many bars a trade may last."""

    step: float
    stops: tuple[float, float]
    takes: tuple[float, float]
    bars: int

    def ratios(self, bounds: tuple[float, float]) -> list[float]:
        """The start plus multiples of the step, up to before the end."""
        start, end = bounds
        return [start + i * self.step for i in range(ceil((end - start) / self.step - 1e-9))]


# Grid presets by timeframe in minutes.
GRIDS = {
    1: Grid(0.0005, (0.0005, 0.0105), (0.0005, 0.0205), 200),
    5: Grid(0.0005, (0.001, 0.0155), (0.001, 0.0305), 300),
    15: Grid(0.001, (0.002, 0.0255), (0.002, 0.0505), 400),
    30: Grid(0.001, (0.003, 0.0355), (0.003, 0.0705), 500),
    60: Grid(0.001, (0.005, 0.0505), (0.005, 0.1005), 600),
    240: Grid(0.001, (0.010, 0.1005), (0.010, 0.2005), 800),
}
