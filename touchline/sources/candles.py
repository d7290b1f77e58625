"""Reading, cleaning and building candles.

Candles are ``instrument, time, open, high, low, close, volume, bar_idx``; time is a timestamp without zone, so that no
result depends on the session's zone. ``bar_idx`` counts an instrument's candles from zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")
EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def seconds(time: str) -> Column:
    """Seconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(SECOND, {EPOCH}, {time})")


def nearest_seconds(time: str) -> Column:
    """The whole seconds since 1970 nearest to a timestamp without zone, the even ones at a half."""
    return F.expr(f"CAST(rint(timestampdiff(MICROSECOND, {EPOCH}, {time}) / 1e6D) AS BIGINT)")


def sniff_separator(line: str) -> str:
    """The separator of a headerless price file: the candidate that splits its first line into most columns."""
    return max(",;\t|", key=line.count) if any(c in line for c in ",;\t|") else " "


def scan_csv(spark: SparkSession, path: str, instrument: str | None = None, separator: str | None = None) -> DataFrame:
    """A headerless file of time, four prices and perhaps a volume, all as text; fewer than five columns are an error.

    Only the first line comes to the driver, to find the separator. Names follow from position.
    """
    first = spark.read.text(path).limit(1).collect()
    separator = separator or sniff_separator(first[0][0] if first else ",,,,")
    columns = len(first[0][0].split(separator)) if first else 6
    if columns < 5:
        raise ValueError(f"{path}: {columns} columns; at least five are needed")
    names = ["time", *PRICES, "volume"]
    raw = spark.read.csv(path, sep=separator, schema=", ".join(f"c{i} string" for i in range(max(columns, 6))))
    named = raw.select(*(F.trim(f"c{i}").alias(n) for i, n in enumerate(names)), F.col("_metadata.file_name").alias("file"))
    return named.withColumn("instrument", F.lit(instrument) if instrument else F.regexp_extract("file", r"^(.+?)(\d+)\.csv$", 1)).drop("file")


def clean_time(column: str = "time") -> Column:
    """Null where the text is no time; a zone in it is applied and dropped (UTC)."""
    text = F.regexp_replace(column, r"(\d{4})\.(\d{2})\.(\d{2})", "$1-$2-$3")
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def clean_number(column: str) -> Column:
    """Null where the text is no finite or infinite number; NaN counts as null."""
    value = F.expr(f"try_cast({column} AS DOUBLE)")
    return F.when(~F.isnan(value), value)


def drop_invalid(candles: DataFrame) -> DataFrame:
    return candles.na.drop(subset=["time", *PRICES])


def with_bar_index(candles: DataFrame) -> DataFrame:
    """The sorted position of each candle of its instrument. Duplicate times are an error of the data: see ``duplicate_times``."""
    return candles.withColumn("bar_idx", (F.row_number().over(Window.partitionBy("instrument").orderBy("time")) - 1).cast("long"))


def duplicate_times(candles: DataFrame) -> DataFrame:
    return candles.groupBy("instrument", "time").agg(F.count("*").alias("n")).where("n > 1")


def clean(raw: DataFrame) -> DataFrame:
    """Typed, valid and numbered candles from text columns."""
    typed = raw.select("instrument", clean_time().alias("time"), *(clean_number(p).alias(p) for p in PRICES), clean_number("volume").alias("volume"))
    return with_bar_index(drop_invalid(typed))


def walk(events: DataFrame) -> DataFrame:
    """A price walk for each event type, exact in decimals: the engine's test prices."""
    order = Window.partitionBy("event_type").orderBy("ts", "event_id")
    total = F.sum(F.col("value").cast("decimal(18,2)") - 50).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rank = F.row_number().over(order)
    return events.select(F.col("event_type").alias("instrument"), "ts", rank.alias("rank"), (F.lit(1000.0) + F.lit(0.01) * total.cast("double")).alias("price"))


def to_candles(ticks: DataFrame, minutes: int) -> DataFrame:
    """Candles of ``ticks`` (``instrument, ts, rank, price``); rank orders ticks of one time."""
    start = F.expr(f"timestampadd(SECOND, CAST(floor(timestampdiff(SECOND, {EPOCH}, ts) / {minutes * 60}) * {minutes * 60} AS INT), {EPOCH})")
    found = ticks.groupBy("instrument", start.alias("time")).agg(
        F.min_by("price", "rank").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "rank").alias("close"), F.count("*").cast("double").alias("volume")
    )
    return with_bar_index(found)


def event_candles(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    return to_candles(walk(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "event_id", "value")), minutes)
