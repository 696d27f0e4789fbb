"""Numbering and running sums over groups that may be too large for one task.

Rows are put in ranges of about equal size by group and order, so a large group lies in
several neighbouring ranges and a range holds many small groups. Each range adds up its own
part of a group; what the ranges before it hold of the same group is added to that. Only one
row a range and group goes into the second step, and no task sees a whole group.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F


def _same(names: list[str]) -> Column:
    """Equal in all columns, NULL being equal to NULL."""
    test = F.lit(True)
    for k in names:
        test = test & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return test


def in_ranges(df: DataFrame, order: list[str], size: int | None = None) -> DataFrame:
    """The rows with ``__range``, the number of their range in this order.

    They are written once to the checkpoint folder: made a second time, the ranges may be cut
    at other places. With ``size`` a range has about so many rows, else there is one range a
    shuffle partition.
    """
    from ..session import cut_lineage

    parts = [] if size is None else [max(1, -(-df.count() // size))]
    return cut_lineage(df.repartitionByRange(*parts, *order).withColumn("__range", F.spark_partition_id()))


def _running(df, keys, order, value, out, size, merge=F.sum):
    ranged = in_ranges(df, [*keys, *order], size).withColumn("__value", value)
    inside = Window.partitionBy("__range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__range", *keys).agg(merge("__value").alias("__total"))
    starts = totals.select("__range", *keys, merge("__total").over(before).alias("__start")).filter("__start is not null")
    group = ["__range", *keys]
    starts = starts.select(*[F.col(k).alias(f"__k_{k}") for k in group], "__start")
    both = F.greatest("__inside", "__start") if merge is F.max else F.col("__inside") + F.coalesce("__start", F.lit(0))
    return (
        ranged.withColumn("__inside", merge("__value").over(inside)).join(starts, _same(group), "left")
        .withColumn(out, both).drop("__inside", "__start", "__value", "__range", *[f"__k_{k}" for k in group])
    )


def _names(order: str | list[str]) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def running_number(df: DataFrame, keys: list[str], order: str | list[str], out: str, block: int | None = None) -> DataFrame:
    """Number the rows of each group from 1 by columns that tell them apart, of any type.

    ``block``, here and below: about so many rows a range (``in_ranges``).
    """
    return running_total(df, keys, order, F.lit(1).cast("long"), out, block)


def numbered_in_order(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Number all rows from 1 by columns that tell them apart, whatever their type or spread.

    The order columns are cut into ranges of about equal size; each range is numbered on its
    own and the sizes of the ranges before it are added. Only one row a range goes through
    one task.
    """
    ranged = in_ranges(df, order)
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return ranged.withColumn(out, inside).join(starts, "__range").withColumn(out, F.col(out) + F.col("__start")).drop("__range", "__start")


def running_total(df: DataFrame, keys: list[str], order: str | list[str], value, out: str, block: int | None = None) -> DataFrame:
    """Running sum of ``value`` in each group up to and with the current row; NULLs add nothing."""
    return _running(df, keys, _names(order), F.coalesce(value, F.lit(0)), out, block)


def carried_marker(df: DataFrame, keys: list[str], order: str | list[str], marker, out: str, block: int | None = None) -> DataFrame:
    """The last marker at or before each row, for markers that grow with the order; NULL before the first."""
    return _running(df, keys, _names(order), marker, out, block, merge=F.max)


def next_line(df: DataFrame, keys: list[str], line: str, text: str, out: str) -> DataFrame:
    """Each line with the next one of its document; the last line has no partner and is left out.

    Line numbers have no gaps, so this is a join on the next number and no document is
    sorted in one task.
    """
    after = df.select(*keys, (F.col(line) - 1).alias(line), F.col(text).alias(out))
    return df.join(after, [*keys, line])


def ranked_by_score(df: DataFrame, keys: list[str], order: list, k: int, out: str) -> DataFrame:
    """The first k rows of each group, numbered from 1; the order must be total.

    Spark keeps the k best rows of each group before the shuffle, so a group of any size
    leaves k rows a task.
    """
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= k)
