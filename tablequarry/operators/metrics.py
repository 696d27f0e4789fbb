"""Task metrics from label and score columns."""

from pyspark.sql import DataFrame, functions as F

from .ordered import running_total


def binary_metrics(df: DataFrame, pred: str, label: str) -> DataFrame:
    """Accuracy, F1, their mean and Matthews correlation from one pass of counts."""
    p, y = F.col(pred) == 1, F.col(label) == 1
    c = df.agg(
        F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"),
        F.count(F.lit(1)).alias("n"),
    )
    d = lambda x: F.col(x).cast("double")
    acc = (d("tp") + d("tn")) / d("n")
    f1 = F.when(d("tp") == 0, 0.0).otherwise(2 * d("tp") / (2 * d("tp") + d("fp") + d("fn")))
    under = F.sqrt((d("tp") + d("fp")) * (d("tp") + d("fn")) * (d("tn") + d("fp")) * (d("tn") + d("fn")))
    mcc = F.when(under == 0, 0.0).otherwise((d("tp") * d("tn") - d("fp") * d("fn")) / F.when(under == 0, 1.0).otherwise(under))
    return c.select(acc.alias("acc"), f1.alias("f1"), ((acc + f1) / 2).alias("acc_and_f1"), mcc.alias("mcc"))


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the rank of each value; equal values share the mean of their ranks.

    Ranks come from counts per distinct value, added up over ranges of values, so no task
    sorts the whole column.
    """
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    upto = running_total(counts, [], column, F.col("__n"), "__upto")
    ranks = upto.select(column, (F.col("__upto") - (F.col("__n") - 1) / 2).alias(out))
    return df.join(ranks, column)


def score_correlations(df: DataFrame, pred: str, label: str) -> DataFrame:
    """Pearson, Spearman and their mean."""
    ranked = average_ranks(average_ranks(df.select(pred, label), pred, "__rp"), label, "__rl")
    both = ranked.agg(F.corr(pred, label).alias("pearson"), F.corr("__rp", "__rl").alias("spearman"))
    return both.withColumn("mean", (F.col("pearson") + F.col("spearman")) / 2)
