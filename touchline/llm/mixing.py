"""Mixing sources to target weights by fitting budgets as subset sums.

A document's size is its number of words. Sources share the sum of all sizes by weight; a target stops at ``cap`` times
its source's size, and what is over is shared again. A source whose target is r times its size and something takes all of
its documents r times, and the rest of the budget is fitted exactly where that can be done: documents are counted by exact
length, the bulk of the rest is taken from all lengths in proportion, lengths are added greedily while the budget is large,
and a bounded-knapsack dynamic programme over the counts closes the remaining gap. Which documents of a length are taken
again follows from a seeded hash, so that reruns agree.

Nulls: a null text has size 0; rows with a null source are a source of their own, last in order. Repeated rows are separate
documents: the hash is of doc_id, source, text and the row's number among its equals, so that some of them may be taken
and not others. Documents of size 0 are taken with 0 words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import bounded, checkpointed, read

#: The largest remaining budget that the dynamic programme closes, and the hash ranges that split a length's documents.
GAP, RANGES = 1 << 15, 1024
#: Equal rows that are numbered in one task; more are dealt over so many.
EQUALS, SALTS = 100_000, 64


def words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")


def targets(sizes: list[int], weights: list[float], cap: float = 3.0) -> list[float]:
    """Shares of the sum of ``sizes`` by weight, none above ``cap`` times its size; the excess goes to the others by weight."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = cap * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
        left = max(left, 0.0)
    return out


def closest(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take, at most ``counts``, so that their sum is the largest reachable one up to ``budget``.

    Bounded knapsack: a length's count is split into powers of two and a rest; ``by`` keeps the item that first reached a sum.
    """
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    by = np.full(budget + 1, -1, np.int64)
    items: list[tuple[int, int]] = []
    for k in np.argsort(-lengths, kind="stable"):
        if not 0 < lengths[k] <= budget or reached[budget]:
            continue
        left, part = int(min(counts[k], budget // lengths[k])), 1
        while left > 0:
            n = min(part, left)
            step = n * int(lengths[k])
            if step <= budget:
                fresh = reached[: budget + 1 - step] & ~reached[step:]
                by[step:][fresh] = len(items)
                reached[step:] |= fresh
                items.append((int(k), n))
            left, part = left - n, part * 2
    out, at = np.zeros(len(lengths), np.int64), int(np.flatnonzero(reached)[-1])
    while at:
        k, n = items[by[at]]
        out[k] += n
        at -= n * int(lengths[k])
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, target: float) -> tuple[int, np.ndarray]:
    """Whole repeats of a source, and how many documents of each length to take once more, for a sum near ``target``."""
    size = int((lengths * counts).sum())
    if size == 0:
        return 1, np.zeros(len(lengths), np.int64)
    whole = int(target // size)
    rest = round(target - whole * size)
    extra = np.floor(counts * max(0.0, (rest - GAP) / size)).astype(np.int64)
    rest -= int((extra * lengths).sum())
    for k in np.argsort(-lengths, kind="stable"):
        if rest <= GAP:
            break
        if lengths[k]:
            n = min(int(counts[k] - extra[k]), -(-(rest - GAP) // int(lengths[k])), rest // int(lengths[k]))
            extra[k] += n
            rest -= n * int(lengths[k])
    return whole, extra + closest(lengths, counts - extra, min(max(rest, 0), GAP)) if rest <= GAP else extra


def light(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` (``doc_id, source, text`` and any others) with ``size`` and ``draw``, the seeded hash that orders a length's documents.

    Equal rows are numbered, so that each has a draw of its own; which of them has which is all the same.
    """
    told = [F.col("doc_id").cast("string"), F.col("doc_id").isNull(), F.col("source"), F.col("source").isNull(), F.col("text"), F.col("text").isNull()]
    rows = docs.withColumn("size", words(F.col("text"))).withColumn("__key", F.xxhash64(F.lit(seed), *told))
    same = checkpointed(docs.select(F.xxhash64(F.lit(seed), *told).alias("__key")).groupBy("__key").agg(F.count("*").alias("__n")).where("__n > 1"))
    if same.take(1):
        rows = rows.join(bounded(same), "__key", "left")
        many = rows.where("__n IS NOT NULL").withColumn("__salt", F.when(F.col("__n") > EQUALS, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))).otherwise(F.lit(0)))
        many = many.withColumn("__no", F.row_number().over(Window.partitionBy("__key", "__salt").orderBy("__key")) * SALTS + F.col("__salt")).drop("__salt")
        rows = rows.where("__n IS NULL").withColumn("__no", F.lit(0).cast("long")).unionByName(many).drop("__n")
    else:
        rows = rows.withColumn("__no", F.lit(0).cast("long"))
    draw = F.xxhash64("__key", "__no")
    return rows.withColumn("draw", draw).withColumn("range", F.pmod(F.shiftright("draw", 20), F.lit(RANGES)).cast("int")).drop("__key", "__no")


KEYS = ["nameless", "named", "size"]


def named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("named", F.coalesce(F.col("source"), F.lit(""))).withColumn("nameless", F.col("source").isNull())


def quotas(rows: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """For each source, length and hash range: the source's size and target, ``whole`` repeats, and ``cutoff``, the largest
    hash that is taken once more.

    Sources are few next to documents: their names and sizes come to the driver, nothing else does.
    """
    rows = named(rows)
    sums = sorted(rows.groupBy("nameless", "named").agg(F.sum("size")).collect(), key=lambda r: (r[0], r[1].encode("utf-8", "surrogatepass")))
    goal = targets([r[2] for r in sums], [weights[i % len(weights)] for i in range(len(sums))], cap)
    plan = rows.sparkSession.createDataFrame([(r[0], r[1], r[2], float(g)) for r, g in zip(sums, goal, strict=True)], "nameless boolean, named string, source_size long, target double")
    # Documents of a length are told apart by ranges of their hash, so that no length's documents meet in one task.
    fine = rows.groupBy(*KEYS, "range").agg(F.count("*").alias("n"))
    counts = fine.groupBy(*KEYS).agg(F.sum("n").alias("n")).join(plan, ["nameless", "named"])

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size", ignore_index=True)
        whole, extra = fit(frame["size"].to_numpy(np.int64), frame["n"].to_numpy(np.int64), float(frame["target"].iloc[0]))
        return frame.assign(whole=whole, extra=extra)[[*KEYS, "source_size", "target", "whole", "extra"]]

    solved = counts.groupBy("nameless", "named").applyInPandas(solve, "nameless boolean, named string, size long, source_size long, target double, whole long, extra long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*KEYS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = fine.withColumn("before", before).join(solved, KEYS).select(*KEYS, "range", "source_size", "target", "whole", (F.col("extra") - F.col("before")).alias("open"), "n")
    quota = checkpointed(quota)
    # Only the one range of a length that is taken in part needs an order.
    order = Window.partitionBy(*KEYS, "range").orderBy("draw")
    edge = quota.where(F.col("open").between(F.lit(1), F.col("n") - 1)).select(*KEYS, "range", "open")
    ranked = rows.select(*KEYS, "range", "draw").join(edge, [*KEYS, "range"]).withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("draw").over(order))
    cut = ranked.where("rank = open").select(*KEYS, "range", F.when(F.col("next") == F.col("draw"), F.col("draw") - 1).otherwise(F.col("draw")).alias("cut"))
    cutoff = F.coalesce("cut", F.when(F.col("open") >= F.col("n"), F.lit((1 << 63) - 1)).otherwise(F.lit(-(1 << 63))))
    return quota.join(cut, [*KEYS, "range"], "left").select(*KEYS, "range", "source_size", "target", "whole", cutoff.alias("cutoff"))


def taken(rows: DataFrame, quota: DataFrame) -> DataFrame:
    """``rows`` with ``source_size, target, times, taken`` of each."""
    out = named(rows).join(quota, [*KEYS, "range"]).withColumn("times", F.col("whole") + (F.col("draw") <= F.col("cutoff")).cast("long"))
    return out.withColumn("taken", F.col("times") * F.col("size")).drop("nameless", "named", "range", "whole", "cutoff", "draw")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 42) -> DataFrame:
    """``doc_id, source, size, source_size, target, times, taken`` for each row of ``docs`` (``doc_id, source, text``)."""
    rows = checkpointed(light(docs.select("doc_id", "source", "text"), seed).drop("text"))
    return taken(rows, quotas(rows, weights, cap))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "times")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 42) -> DataFrame:
    """The rows that the mix takes, each as often as it is taken; a row that is not taken goes. Texts move once.

    Null texts have size 0 and stay; a null source is a source; repeated rows are documents of their own; all columns stay.
    """
    rows = docs.select("doc_id", "source", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    quota = quotas(checkpointed(light(docs.select("doc_id", "source", "text"), seed).drop("text")), weights, cap)
    return taken(light(rows, seed), quota).where("times > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("row.*")
