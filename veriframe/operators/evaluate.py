"""Summaries and reports over labels and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import schema as S


def summary(predictions: DataFrame, label: str = "label") -> DataFrame:
    """``label, n`` for both labels, whether they occur or not; null labels (failed images) don't count."""
    both = predictions.sparkSession.createDataFrame([(x,) for x in S.LABELS], "label string")
    counts = predictions.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return both.join(F.broadcast(counts), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def confusion(df: DataFrame, truth: str = "label", predicted: str = "predicted") -> DataFrame:
    """``truth, predicted, n`` of all pairs that occur."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, truth: str = "label", predicted: str = "predicted", target: float = 0.70) -> DataFrame:
    hit = (F.col(truth) == F.col(predicted)).cast("double")
    return df.agg(F.avg(hit).alias("accuracy"), F.count("*").alias("n")).withColumn("meets_target", F.col("accuracy") >= target)


def report(df: DataFrame, truth: str = "label", predicted: str = "predicted") -> DataFrame:
    """``class, precision, recall, f1, support`` for classes 0 and 1 and their macro and weighted means; a division by zero gives 0.

    One pass over the rows: everything comes from the few counts of the confusion table.
    """
    t, p = F.col("truth"), F.col("predicted")
    cells = confusion(df, truth, predicted).where(t.isin(0, 1))
    counts = [F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias(name) for y in (0, 1) for name, cond in ((f"tp{y}", (t == y) & (p == y)), (f"pp{y}", p == y), (f"ap{y}", t == y))]
    one = cells.agg(*counts)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rows = []
    for y in (0, 1):
        precision, recall = ratio(F.col(f"tp{y}"), F.col(f"pp{y}")), ratio(F.col(f"tp{y}"), F.col(f"ap{y}"))
        rows.append(F.struct(F.lit(S.LABELS[y]).alias("class"), precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"), F.col(f"ap{y}").alias("support")))
    classes = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    mean = lambda c: F.avg(c).alias(c)
    weighted = lambda c: ratio(F.sum(F.col(c) * F.col("support")), F.sum("support").cast("double")).alias(c)
    names = ("precision", "recall", "f1")
    macro = classes.agg(*map(mean, names), F.sum("support").alias("support")).select(F.lit("macro avg").alias("class"), *names, "support")
    average = classes.agg(*map(weighted, names), F.sum("support").alias("support")).select(F.lit("weighted avg").alias("class"), *names, "support")
    return classes.unionByName(macro).unionByName(average)
