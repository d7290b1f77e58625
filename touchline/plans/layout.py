"""Where tables live, logging, and the ordered run of all layers in one session."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from logging.handlers import RotatingFileHandler

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import blueprints, enrich, indicators, model, rules, simulation
from touchline.sources.tables import write_table


@dataclass(frozen=True)
class Layout:
    """Table paths under one root, which may be any store that Spark can read."""

    root: str

    def table(self, layer: str, name: str) -> str:
        return f"{self.root.rstrip('/')}/{layer}/{name}"


def logger(name: str, file: str | None = None, level: int = logging.INFO) -> logging.Logger:
    out = logging.getLogger(name)
    if not out.handlers:
        out.setLevel(level)
        for handler in (logging.StreamHandler(), *([RotatingFileHandler(file, maxBytes=5_000_000, backupCount=3)] if file else [])):
            handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
            out.addHandler(handler)
    return out


@dataclass
class Pipeline:
    """All layers, each written before the next reads it; an exception stops the run."""

    spark: SparkSession
    layout: Layout
    stops: list[float]
    takes: list[float]
    bars: int
    spread: float = 0.0

    def step(self, layer: str, name: str, df: DataFrame) -> DataFrame:
        path = self.layout.table(layer, name)
        write_table(df, path, ["instrument"] if "instrument" in df.columns else None)
        return self.spark.read.parquet(path)

    def run(self, candles: DataFrame, tail: str = "dt", generation: str = "ALL", least: int = 100) -> dict[str, DataFrame]:
        """``tail``: ``dt`` mines rules for each blueprint, ``xgb`` ends with the training matrix."""
        if tail not in ("dt", "xgb"):
            raise ValueError(f"unknown tail {tail}")
        out = {"candles": self.step("raw", "candles", candles)}
        out["trades"] = self.step("bronze", "trades", simulation.by_mode(simulation.first_touch(out["candles"], self.stops, self.takes, self.bars, self.spread), generation))
        out["features"] = self.step("silver", "features", indicators.features(out["candles"]))
        out["enriched"] = self.step("silver", "outcomes", enrich.enrich(out["trades"], out["features"], indicators.levels()))
        out["gold"] = self.step("gold", "features", enrich.gold(out["features"]))
        if tail == "xgb":
            out["matrix"] = self.step("platinum", "matrix", model.time_split(model.matrix(out["enriched"], out["gold"])))
            return out
        counts = self.step("platinum", "counts", blueprints.count_blueprints(out["enriched"], indicators.levels()))
        out["combinations"] = self.step("platinum", "combinations", blueprints.combinations(counts, least))
        out["targets"] = self.step("platinum", "targets", blueprints.targets(counts, out["combinations"]))
        names = [c for c in out["gold"].columns if c not in ("instrument", "time", "bar_idx")]
        joined = out["targets"].join(out["gold"].withColumnRenamed("time", "entry_time"), ["instrument", "entry_time"])
        joined = joined.withColumn("key", F.concat_ws("/", "instrument", "key"))
        out["strategies"] = self.step("platinum", "strategies", rules.mine(joined, names))
        return out
