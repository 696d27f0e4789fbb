"""Accuracy of column labels."""

from pyspark.sql import DataFrame, functions as F

from .ordered import running_total


def prefix_right(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """At each position: are all labelled positions up to here right? Label -1 is no label."""
    wrong = F.when((F.col("label") != -1) & (F.col("pred") != F.col("label")), 1).otherwise(0)
    out = running_total(df, keys, position, wrong, "__wrong")
    return out.withColumn("prefix_right", F.col("__wrong") == 0).drop("__wrong")


def label_accuracy(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Share of positions with an all-right prefix, and share of examples that are all right."""
    right = prefix_right(df, keys, position)
    per = right.groupBy(*keys).agg(
        F.count_if("prefix_right").alias("right"), F.count(F.lit(1)).alias("n"), F.min(F.col("prefix_right").cast("int")).alias("whole")
    )
    return per.agg((F.sum("right") / F.sum("n")).alias("by_position"), F.avg("whole").alias("by_example"))
