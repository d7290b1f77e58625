"""Tables between stages: state tables, keep-last upserts, manifests, explorers and sinks."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Schemas of the discovery state.
STATE = {
    "strategies": "key string, market_rule string, n_candles long, avg_density double",
    "blacklist": "key string, market_rule string",
    "exhausted": "key string",
    "combinations": "key string, type string, sl_def string, sl_bin double, tp_def string, tp_bin double, trade_type string, num_candles long",
    "targets": "key string, entry_time timestamp_ntz, trade_count long",
    "processed": "key string",
}


def empty_state(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], STATE[name])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of both, one for each key: the new table's before the old one's, and of one table the last by ``order``."""
    rows = old.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)), allowMissingColumns=True)
    latest = Window.partitionBy(*keys).orderBy(F.desc("__age"), *(F.desc(c) for c in order or []))
    return rows.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n", "__age")


def pending_inputs(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs that have no output yet."""
    return inputs.join(done, key, "left_anti")


def prepared(inputs: DataFrame, done: DataFrame, key: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``done`` and, for the inputs that it lacks, what ``make`` makes of them."""
    return done.unionByName(make(pending_inputs(inputs, done.select(key).distinct(), key)))


def mark_processed(keys: DataFrame, path: str) -> None:
    """Adds keys to the log of what was processed; a batch that is run again after a failure may add some twice."""
    keys.select("key").write.mode("append").parquet(path)


def processed(spark: SparkSession, path: str) -> DataFrame:
    """The keys in the log, each once; none where there is no log yet."""
    try:
        return spark.read.parquet(path).select("key").distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty_state(spark, "processed")


def natural(name: str) -> list[tuple[int, int, str]]:
    """Sort key of a name: runs of digits as numbers."""
    return [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.findall(r"\d+|\D+", name)]


def selected(names: list[str], answer: str) -> list[str]:
    """The names, in natural order, that an answer tells: ``all``, or their numbers (from 1) or themselves, between commas."""
    ordered, out = sorted(names, key=natural), []
    if answer.strip().lower() in ("", "a", "all"):
        return ordered
    for word in (w.strip() for w in answer.split(",")):
        found = word if word in ordered else ordered[int(word) - 1] if word.isdigit() and 0 < int(word) <= len(ordered) else None
        if found is None:
            raise ValueError(f"no such choice: {word}")
        out += [found] * (found not in out)
    return out


def headings(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)], "position int, name string, type string")


def preview(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def nth_row(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Row ``n`` (from zero) in order, as one ``name, value`` row for each column."""
    row = df.orderBy(*order).offset(n).limit(1)
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns))
    return row.select(F.inline(pairs))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, most_rows: int = 5_000_000, mode: str = "overwrite") -> None:
    """Parquet, with files of bounded size. Many small groups become partitions of few columns, never a file for each key."""
    writer = df.write.mode(mode).option("maxRecordsPerFile", most_rows)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)
