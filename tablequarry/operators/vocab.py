"""Label maps: ids by frequency."""

from pyspark.sql import DataFrame, functions as F

from .ordered import numbered_in_order


def frequency_ids(df: DataFrame, label: str, n: str = "n", out: str = "label_id") -> DataFrame:
    """One row per label with its count and its id, 1 for the most frequent; ties by label.

    Only the counts are put in order, one row per distinct label, over ranges of them.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias(n)).withColumn("__less", -F.col(n))
    return numbered_in_order(counts, ["__less", label], out).withColumn(out, F.col(out).cast("int")).drop("__less")
