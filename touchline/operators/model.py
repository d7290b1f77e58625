"""The training matrix, a boosted classifier, its metrics and its importances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

C = F.col
#: Steps of scores from 0 to 1 that are ranked apart.
STEPS = 4096
DROPPED = ("entry_time", "exit_time", "entry_price", "sl_price", "tp_price", "outcome", "trade_type", "exit_idx", "entry_idx")


def matrix(enriched: DataFrame, gold: DataFrame) -> DataFrame:
    """Trades joined with candle features at entry, with ``target`` and ``is_buy``; ``entry_time`` stays for the split."""
    side = gold.withColumnRenamed("time", "entry_time").drop("bar_idx")
    out = enriched.join(side, ["instrument", "entry_time"])
    out = out.withColumn("target", (C("outcome") == "win").cast("tinyint")).withColumn("is_buy", (C("trade_type") == "buy").cast("tinyint"))
    return out.drop(*(c for c in DROPPED if c != "entry_time"))


def bps_columns(columns: list[str]) -> tuple[list[str], list[str]]:
    """The columns that tell the distance of stops, and of takes, to a level in basis points."""
    return tuple([c for c in columns if c.startswith(f"{side}_dist_to_") and c.endswith("_bps")] for side in ("sl", "tp"))


def time_split(rows: DataFrame, share: float = 0.2) -> DataFrame:
    """``validation``: the last ``share`` of distinct entry times, at least one.

    Distinct times are counted by day; days alone are ranked in one task, and the times of a day within it.
    """
    times = rows.select("entry_time").distinct().withColumn("__day", F.to_date("entry_time"))
    days = times.groupBy("__day").agg(F.count("*").alias("__times"))
    ranked = days.withColumn("__before", F.sum("__times").over(Window.orderBy("__day")) - C("__times")).withColumn("__all", F.sum("__times").over(Window.partitionBy()))
    place = C("__before") + F.row_number().over(Window.partitionBy("__day").orderBy("entry_time"))
    late = times.join(ranked.drop("__times"), "__day").withColumn("validation", place > C("__all") - F.greatest(F.lit(1), F.floor(C("__all") * share)))
    return rows.join(late.select("entry_time", "validation"), "entry_time")


def assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    filled = rows.withColumns({f: F.coalesce(C(f).cast("double"), F.lit(0.0)) for f in features})
    return VectorAssembler(inputCols=features, outputCol="features").transform(filled)


def boost(rows: DataFrame, features: list[str], rounds: int = 1000, rate: float = 0.05, depth: int = 8, sample: float = 0.8, seed: int = 42):
    """Gradient-boosted trees on log loss; rows marked ``validation`` stop the boosting early."""
    from pyspark.ml.classification import GBTClassifier

    model = GBTClassifier(labelCol="target", featuresCol="features", maxIter=rounds, stepSize=rate, maxDepth=depth, subsamplingRate=sample, featureSubsetStrategy=str(sample), validationIndicatorCol="validation", seed=seed)
    return model.fit(assembled(rows, features).withColumn("target", C("target").cast("double")))


def predict(model, rows: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(assembled(rows, features)).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def metrics(scored: DataFrame) -> DataFrame:
    """Accuracy, precision and recall at one half, and the area under the ROC curve from rank sums with mean ranks.

    ``scored``: ``target`` and ``score``. Ranks come from counts of distinct scores, which run on within steps of 1/``STEPS``; the
    steps' own sums alone meet in one task.
    """
    counts = scored.groupBy("score").agg(F.sum(C("target").cast("long")).alias("p"), F.count("*").alias("n")).withColumn("step", F.floor(C("score") * STEPS))
    steps = counts.groupBy("step").agg(F.sum("n").alias("__n"))
    steps = steps.select("step", (F.sum("__n").over(Window.orderBy("step")) - C("__n")).alias("before"))
    running = F.sum("n").over(Window.partitionBy("step").orderBy("score").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("running", running).join(steps, "step").withColumn("rank", C("before") + C("running") - (C("n") - 1) / 2)
    hit = C("score") > 0.5
    total = ranked.agg(
        F.sum("p").alias("pos"),
        F.sum(C("n") - C("p")).alias("neg"),
        F.sum(C("rank") * C("p")).alias("ranks"),
        F.sum(F.when(hit, C("p")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, C("n") - C("p")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, C("n") - C("p")).otherwise(0)).alias("tn"),
    )
    return total.select(
        ((C("tp") + C("tn")) / (C("pos") + C("neg"))).alias("accuracy"),
        F.coalesce(F.try_divide("tp", C("tp") + C("fp")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide("tp", "pos"), F.lit(0.0)).alias("recall"),
        F.try_divide(C("ranks") - C("pos") * (C("pos") + 1) / 2, C("pos") * C("neg")).alias("roc_auc"),
    )


def importances(model, features: list[str], spark) -> DataFrame:
    values = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, values, strict=True)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def save(model, path: str) -> None:
    model.write().overwrite().save(path)
