"""Mining of market rules: exact regression trees on candle features, one for each blueprint."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline import config

C = F.col


def conditions(rule: str) -> list[tuple[str, str, float]]:
    """A rule's conditions as (feature, sign, bound)."""
    out = []
    for part in rule.split(" and ") if rule else ():
        sign = "<=" if "<=" in part else ">"
        feature, bound = part.rsplit(sign, 1)
        out.append((feature.strip().strip("`"), sign, float(bound)))
    return out


def simplified(rules: DataFrame, column: str = "market_rule") -> DataFrame:
    """Rules with the tightest bound of each feature and side alone, in order of their text: one projection, nothing moves."""
    parts = F.filter(F.split(C(column), " and "), lambda p: F.trim(p) != "")

    def parsed(part: Column) -> Column:
        sign = F.when(part.contains("<="), "<=").otherwise(">")
        return F.struct(F.trim(F.split_part(part, sign, F.lit(1))).alias("f"), sign.alias("s"), F.trim(F.split_part(part, sign, F.lit(2))).cast("double").alias("v"))

    bounds = F.transform(parts, parsed)
    sides = F.array_distinct(F.transform(bounds, lambda b: F.struct(b["f"].alias("f"), b["s"].alias("s"))))

    def tightest(side: Column) -> Column:
        own = F.transform(F.filter(bounds, lambda b: (b["f"] == side["f"]) & (b["s"] == side["s"])), lambda b: b["v"])
        value = F.when(side["s"] == "<=", F.array_min(own)).otherwise(F.array_max(own))
        return F.concat(side["f"], F.lit(" "), side["s"], F.lit(" "), value.cast("string"))

    return rules.withColumn(column, F.coalesce(F.array_join(F.array_sort(F.transform(sides, tightest)), " and "), F.lit("")))


def pending(catalogue: DataFrame, exhausted: DataFrame, processed: DataFrame, least: int = config.LEAST_CANDLES) -> DataFrame:
    return catalogue.where(C("num_candles") >= least).join(exhausted, "key", "left_anti").join(processed, "key", "left_anti")


def improvable(catalogue: DataFrame, blacklist: DataFrame, exhausted: DataFrame, least: int = config.LEAST_CANDLES) -> DataFrame:
    return catalogue.where(C("num_candles") >= least).join(blacklist, "key", "left_semi").join(exhausted, "key", "left_anti")


def exclusions(strategies: DataFrame, blacklist: DataFrame) -> DataFrame:
    """``key, rules``: rules already known, good or bad."""
    return strategies.select("key", "market_rule").union(blacklist.select("key", "market_rule")).distinct().groupBy("key").agg(F.array_sort(F.collect_list("market_rule")).alias("rules"))


def any_rule(rules: list[str]) -> str:
    return " OR ".join(f"({r})" for r in rules) or "false"


def zeroed(joined: DataFrame, rules: list[str]) -> DataFrame:
    """Counts set to zero where an excluded rule holds; a null condition does not hold."""
    return joined.withColumn("trade_count", F.when(F.expr(any_rule(rules)), F.lit(0).cast("long")).otherwise(C("trade_count")))


def baseline(joined: DataFrame) -> DataFrame:
    """Mean density of each key before exclusion; keys with no trades are exhausted."""
    return joined.groupBy("key").agg(F.avg("trade_count").alias("density"), F.count("*").alias("n_candles"), (F.sum("trade_count") == 0).alias("exhausted"))


def best_split(x: np.ndarray, y: np.ndarray, least: int) -> tuple[float, int, float] | None:
    """The split of largest gain in squared error: gain, feature, threshold (midway between neighbours)."""
    n, best = len(y), None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, s = x[order, f], np.cumsum(y[order])
        k = np.arange(least, n - least + 1)
        k = k[v[k - 1] < v[k]] if len(k) else k
        if not len(k):
            continue
        gain = s[k - 1] ** 2 / k + (s[-1] - s[k - 1]) ** 2 / (n - k) - s[-1] ** 2 / n
        i = int(gain.argmax())
        if gain[i] > 1e-9 and (best is None or gain[i] > best[0] + 1e-12):
            best = float(gain[i]), f, float((v[k[i] - 1] + v[k[i]]) / 2)
    return best


def leaves(x: np.ndarray, y: np.ndarray, names: list[str], depth: int = config.TREE_DEPTH, least: int = config.LEAST_LEAF) -> list[tuple[str, int, float]]:
    """The leaves of a regression tree as (rule, rows, mean), with thresholds rounded to five places."""
    split = best_split(x, y, least) if depth and len(y) >= 2 * least else None
    if not split:
        return [("", len(y), float(y.mean()))]
    _, f, at = split
    low = x[:, f] <= at
    out = []
    for side, sign in ((low, "<="), (~low, ">")):
        out += [(f"`{names[f]}` {sign} {round(at, 5)}" + (f" and {r}" if r else ""), n, m) for r, n, m in leaves(x[side], y[side], names, depth - 1, least)]
    return out


def mine(joined: DataFrame, features: list[str], known: DataFrame | None = None, lift: float = config.LIFT, depth: int = config.TREE_DEPTH, least: int = config.LEAST_LEAF) -> DataFrame:
    """``key, market_rule, n_candles, avg_density``: leaves of each key's tree whose mean is ``lift`` times the key's baseline.

    ``joined``: ``key, trade_count`` and features, one row for each candle of a key; ``known``: ``key, rules`` to leave out, whose
    candles count as zero. One task holds one blueprint's candles, at most as many as an instrument has.
    """
    rows = joined.join(known, "key", "left") if known is not None else joined.withColumn("rules", F.lit(None).cast("array<string>"))

    def tree(frame: pd.DataFrame) -> pd.DataFrame:
        y = frame["trade_count"].to_numpy(float)
        base = float(y.mean()) if len(y) else 0.0
        rules = frame["rules"].iloc[0]
        rules = [] if rules is None else list(rules)
        for rule in rules:
            hit = np.ones(len(frame), bool)
            for f, sign, value in conditions(rule):
                hit &= (frame[f] <= value).to_numpy() if sign == "<=" else (frame[f] > value).to_numpy()
            y = np.where(hit, 0.0, y)
        if base <= 0 or y.sum() <= 0:
            found = []
        else:
            found = [(r, n, m) for r, n, m in leaves(frame[features].to_numpy(float), y, features, depth, least) if r and m >= lift * base]
        return pd.DataFrame([(frame["key"].iloc[0], r, n, m) for r, n, m in found], columns=["key", "market_rule", "n_candles", "avg_density"])

    found = rows.select("key", "trade_count", "rules", *(C(f).cast("double") for f in features)).groupBy("key").applyInPandas(tree, "key string, market_rule string, n_candles long, avg_density double")
    found = simplified(found)
    return found if known is None else found.join(known.select("key", F.explode("rules").alias("market_rule")), ["key", "market_rule"], "left_anti")


def evaluate(features: DataFrame, rules: list[tuple[str, str]], batch: int = 200) -> DataFrame:
    """``instrument, time, trigger_key`` wherever a rule holds: all rules of a batch in one pass over the candles.

    ``rules``: (trigger_key, predicate). A null predicate does not hold.
    """
    out = None
    for i in range(0, len(rules), batch):
        hits = F.array(*(F.when(F.expr(rule), F.lit(k)) for k, rule in rules[i : i + batch]))
        part = features.select("instrument", "time", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("trigger_key"))
        out = part if out is None else out.unionByName(part)
    return features.select("instrument", "time", F.lit("").alias("trigger_key")).limit(0) if out is None else out
