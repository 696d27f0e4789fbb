"""Observed productions of query trees, numbered with offset ranges."""

from pyspark.sql import DataFrame, Window, functions as F


def observed_rules(nodes: DataFrame, lists: DataFrame) -> DataFrame:
    """Numbered rules: rule_id, parent, child, first_id, last_id.

    nodes: sum_type, type, fields (the fields present); lists: list_type, length. Rules
    are, in this order, constructors per sum type, field sets per type and lengths per
    list type, each sorted by name. Only distinct productions are numbered; their number
    does not grow with the data.
    """
    sums = nodes.select(F.lit(0).alias("kind"), F.col("sum_type").alias("parent"), F.col("type").alias("child")).filter("parent is not null")
    fields = nodes.select(F.lit(1).alias("kind"), F.col("type").alias("parent"), F.col("fields").alias("child"))
    sizes = lists.select(F.lit(2).alias("kind"), F.concat("list_type", F.lit("*")).alias("parent"), F.col("length").cast("string").alias("child"))
    rules = sums.unionByName(fields).unionByName(sizes).distinct()
    numbered = rules.withColumn("rule_id", F.row_number().over(Window.orderBy("kind", "parent", "child")) - 1)
    own = Window.partitionBy("kind", "parent")
    return numbered.select("rule_id", "parent", "child", F.min("rule_id").over(own).alias("first_id"), F.max("rule_id").over(own).alias("last_id"))
